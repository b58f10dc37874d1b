"""Plan shapes that keep the operators scalable, asserted on physical plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plan_report import summarise  # noqa: E402

from tablelens.plans.catalogue import CATALOGUE  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_stats_aggregate_partially_before_the_shuffle(spark):
    plan = plan_of(CATALOGUE["top_group_drilldown_null_key"][0](spark, SF))
    # The hot NULL key (a third of the rows) collapses in the map-side partial aggregate.
    assert "partial_count" in plan and "partial_sum" in plan
    assert plan.index("TakeOrderedAndProject") < plan.index("Exchange hashpartitioning")


def test_per_metric_rankings_limit_before_the_shuffle(spark):
    plan = plan_of(CATALOGUE["category_rankings_part_top5"][0](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_semi_join_broadcasts_only_the_top_k(spark):
    plan = plan_of(CATALOGUE["top_group_drilldown_semijoin"][0](spark, SF))
    build = plan[plan.index("BroadcastExchange") :]
    assert "TakeOrderedAndProject(limit=3" in build
    assert "LeftSemi" in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(CATALOGUE["page_engagement_top10"][0](spark, SF))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_tax:double>" in plan


@pytest.mark.parametrize("name", sorted(n for n in CATALOGUE if not n.startswith("stream_")))
def test_no_red_flags(spark, name):
    s = summarise(plan_of(CATALOGUE[name][0](spark, SF)))
    assert not s["flags"] and not s.get("windows"), s
