"""Summarise the physical plan of every registered query into PLANS.md.

For each query: shuffles by kind, broadcasts, and the operators that matter
at scale. Red flags (none expected): cartesian or nested-loop joins, and an
unpartitioned window whose input is not a top-k or a bounded side table.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablelens.plans.catalogue import CATALOGUE  # noqa: E402
from tablelens.session import get_session  # noqa: E402

NOTABLE = [
    "TakeOrderedAndProject",
    "WindowGroupLimit",
    "BroadcastHashJoin",
    "SortMergeJoin",
    "Expand",
    "Generate",
    "ObjectHashAggregate",
    "SortAggregate",
    "CollectMetrics",
]
FLAGS = ["CartesianProduct", "BroadcastNestedLoopJoin"]


def summarise(plan: str) -> dict:
    out = {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcast": plan.count("BroadcastExchange"),
        "reused": plan.count("ReusedExchange"),
        "ops": [op for op in NOTABLE if op in plan],
        "flags": [f for f in FLAGS if f in plan],
    }
    # An unpartitioned window prints two bracket groups (expressions, order)
    # instead of three. It is fine on a top-k, on a per-partition or
    # per-column side table, or on the k groups a semi-join kept.
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" not in line or "WindowGroupLimit" in line:
            continue
        body = line[line.index("Window [") + len("Window ") :]
        groups, depth, cur = [], 0, ""
        for ch in body:
            if ch == "[":
                depth += 1
            elif ch == "]":
                depth -= 1
                if depth == 0:
                    groups.append(cur)
                    cur = ""
                    continue
            if depth > 0:
                cur += ch
        # (exprs, partition, order) or (exprs, partition): partitioned.
        # (exprs, order): unpartitioned.
        if len(groups) >= 3 or (len(groups) == 2 and not re.search(r" (ASC|DESC)", groups[1])):
            continue
        below = "\n".join(lines[i + 1 : i + 12])
        bounded = (
            "TakeOrderedAndProject" in below
            or "_part" in line
            or "unique_count" in line
            or "LeftSemi" in below
        )
        if not bounded:
            out.setdefault("windows", []).append(line.strip()[:100])
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans of the registered queries\n")
    print(
        f"Generated by `tools/plan_report.py` at `{sf}` (`local[8]`, AQE on; counts are from the "
        "initial physical plan, before AQE coalescing). Shuffles: hash / range / single-partition "
        "exchanges. Broadcasts are explicit only for bounded sides (a `limit(k)` frame, one row per "
        "column or per range partition) or chosen by Spark below its size threshold.\n"
    )
    print("| Query | hash | range | single | broadcast | notable operators | flags |")
    print("|---|---|---|---|---|---|---|")
    total_flags = 0
    for name, (fn, _sql) in CATALOGUE.items():
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        flags = s["flags"] + [f"unbounded window? {w}" for w in s.get("windows", [])]
        total_flags += len(flags)
        print(
            f"| {name} | {s['hash']} | {s['range']} | {s['single']} | {s['broadcast']} | "
            f"{', '.join(s['ops'])} | {'; '.join(flags) or '-'} |"
        )
    print(f"\nFlags in total: {total_flags}.")
    spark.stop()


if __name__ == "__main__":
    main()
