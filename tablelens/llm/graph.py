"""Connected components as alternating star contractions.

Large-star links every larger neighbour of a node to the smallest node it
knows; small-star does the same for the smaller neighbours. Alternating them
turns any graph into a forest of stars whose centres are the smallest node of
each component (Kiveris et al., "Connected Components in MapReduce and
Beyond"). Every step is a grouped minimum (map-side combined) and a join; each
round is written to the shared folder, so lineage stays one round long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import stage


def _smallest(pairs: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Per ``key`` the smallest ``value``. The rebalance makes the joins that
    follow plain shuffles on both sides, whose hot keys AQE can split."""
    return pairs.groupBy(key).agg(F.min(value).alias(name)).hint("rebalance")


def _is_star_forest(edges: DataFrame) -> bool:
    """True if every larger end has one centre and no centre is a larger end."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = (
        ends.groupBy("node")
        .agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        .where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    )
    return bad.isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node that can be reached. Loops, repeated
    edges and edges with a null end add nothing; without edges the result is
    empty.
    """
    e = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        large = (
            both.where("v > u")
            .join(_smallest(both, "u", "v", "m"), "u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
            .distinct()
        )
        large = stage(large, "large-star")
        centres = _smallest(large, "hi", "lo", "m")
        small = (
            large.join(centres, "hi")
            .where("lo != m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(large.groupBy("hi").agg(F.min("lo").alias("lo")))
            .distinct()
        )
        e = stage(small, "small-star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
