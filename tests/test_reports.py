"""The three analyses end to end on the stand-in tables, and streaming."""


import pytest
from pyspark.sql import functions as F

from tablelens.plans.reports import ads_report, posts_report, tweets_report
from tablelens.streaming import read_stream, run_available, stream_engagement, stream_group_sizes, stream_window_sizes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_tweets_report(events):
    rep = tweets_report(
        events, key_sets=[["event_type"], ["user_id"]], metrics=["value"], engagement_keys=["event_type"],
        id_columns=["event_id", "user_id"],
    )
    ov = rep["overview"].first()
    assert ov.row_count == events.count() and ov.duplicates_removed == 0
    assert {"numeric_profile", "text_profile", "groups_event_type_top", "engagement_event_type"} <= set(rep)
    assert rep["groups_user_id_top"].count() == 10
    for name, frame in rep.items():
        frame.collect()


def test_tweets_report_without_staging_agrees(events):
    a = tweets_report(events, key_sets=[["event_type"]], metrics=["value"], engagement_keys=[], stage=True)
    b = tweets_report(events, key_sets=[["event_type"]], metrics=["value"], engagement_keys=[], stage=False)
    assert a["overview"].collect() == b["overview"].collect()
    assert sorted(a["groups_event_type_top"].collect()) == sorted(b["groups_event_type_top"].collect())


def test_posts_report(lineitem):
    rep = posts_report(
        lineitem, page_key="l_suppkey", post_key="l_orderkey", category_key="l_returnflag",
        metrics=["l_quantity", "l_extendedprice", "l_tax"], ranking_metrics=["l_quantity", "l_tax"],
        order_by="l_orderkey",
    )
    assert rep["page_engagement"].count() == 10
    assert rep["category_share"].agg(F.sum("count")).first()[0] == lineitem.count()
    assert rep["first_pages"].count() == 10
    for frame in rep.values():
        frame.collect()


def test_ads_report(lineitem):
    rep = ads_report(
        lineitem, key_sets=[["l_suppkey"], ["l_suppkey", "l_partkey"]], json_columns=[],
        id_columns=["l_orderkey", "l_partkey", "l_suppkey"],
    )
    # l_returnflag (3 values) and l_linestatus (2) qualify; the fewest wins.
    best = rep["grouping_candidates"].where("choice = 1").first()
    assert best.column_name == "l_linestatus"
    assert "candidate_l_linestatus_top" in rep
    qs = rep["numeric_profile"].where("column_name = 'l_quantity'").first()
    assert qs.q25 <= qs.q50 <= qs.q75
    for frame in rep.values():
        frame.collect()


def test_reference_column_names(spark):
    # The reference's own names (with a space) work as defaults.
    d = spark.createDataFrame(
        [("1", "10", "page1", "Politics", "5", "2", "1"), ("2", "11", "page2", "News", "7", "", "3")],
        "post_id string, x string, Facebook_Id string, `Page Category` string, Likes string, Comments string, Shares string",
    )
    rep = posts_report(d)
    assert rep["category_share"].count() == 2
    top = rep["page_engagement"].orderBy("rank").first()
    assert (top.Facebook_Id, top.total_engagement) == ("page2", 10.0)  # 7 + empty(0) + 3


def test_streaming_matches_batch(spark, events, tmp_path):
    src = str(tmp_path / "events")
    events.repartition(4).write.parquet(src)
    stream = read_stream(spark, src, events.schema, max_files_per_trigger=2)
    sizes = run_available(stream_group_sizes(stream, ["event_type"]), "sizes")
    batch = events.groupBy("event_type").count()
    assert sorted((r.event_type, r.size) for r in sizes.collect()) == sorted(tuple(r) for r in batch.collect())
    eng = run_available(stream_engagement(read_stream(spark, src, events.schema), "event_type", ["value"]), "eng")
    assert eng.agg(F.sum("posts")).first()[0] == events.count()
    win = run_available(
        stream_window_sizes(read_stream(spark, src, events.schema), "ts", ["event_type"], "1 day", "1 hour"),
        "win",
        output_mode="append",
    )
    # Append mode holds the windows that the watermark (the latest event less an hour) has closed.
    latest = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    days = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count()
    closed = days.where(F.col("w.end") <= F.lit(latest) - F.expr("INTERVAL 1 HOUR"))
    want = sorted((r.w.start, r.event_type, r["count"]) for r in closed.collect())
    assert sorted((r.window_start, r.event_type, r.size) for r in win.collect()) == want


def test_stream_resumes_in_its_folder(spark, events, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "run")
    stream = lambda: stream_group_sizes(read_stream(spark, src, events.schema), ["event_type"])
    spark.createDataFrame([], events.schema).write.parquet(src)
    run = lambda: {r.event_type: r.size for r in run_available(stream(), "again", folder=folder).collect()}
    assert run() == {}
    events.write.mode("append").parquet(src)
    once = run()
    assert run() == once and sum(once.values()) == events.count()
    events.write.mode("append").parquet(src)
    assert run() == {k: 2 * n for k, n in once.items()}


def test_missing_keys_are_skipped_whole_and_listed(lineitem):
    """A key set is never shortened."""
    ads = ads_report(lineitem, key_sets=[["l_suppkey", "nope"], ["l_suppkey"]], json_columns=[], candidate=False)
    assert ads.skipped == {("l_suppkey", "nope"): ["nope"]}
    assert [n for n in ads if n.startswith("groups")] == ["groups_l_suppkey_size_stats", "groups_l_suppkey_top", "groups_l_suppkey_drilldown"]
    tweets = tweets_report(lineitem, key_sets=[["x", "l_suppkey"]], metrics=["l_tax"], engagement_keys=["y"])
    assert tweets.skipped == {("x", "l_suppkey"): ["x"], ("y",): ["y"]} and not [n for n in tweets if n.startswith("groups")]
    posts = posts_report(lineitem, page_key="l_suppkey", post_key="nope", category_key="l_returnflag", metrics=["l_tax"])
    assert posts.skipped == {("l_suppkey", "nope"): ["nope"]} and "page_post_count" not in posts


def test_report_parameters_reach_the_frames(lineitem):
    rep = ads_report(lineitem, key_sets=[["l_suppkey", "l_partkey"]], json_columns=[], candidate=False, drill_cols=None, drill_k=2, top_k=4, id_columns=["l_orderkey", "l_partkey", "l_suppkey"])
    drilled = rep["groups_l_suppkey_l_partkey_drilldown"].collect()
    assert len({r.column_name for r in drilled}) == 5 and max(r["rank"] for r in drilled) == 2
    assert rep["groups_l_suppkey_l_partkey_top"].count() == 4


@pytest.mark.parametrize("stage", [True, False])
def test_duplicates_removed_counted(spark, stage):
    rows = [("a", "1"), ("a", "1"), ("a", "1"), ("b", "NULL"), ("b", None), ("c", "2")]
    d = spark.createDataFrame(rows, "source string, likeCount string")
    rep = tweets_report(d, key_sets=[["source"]], engagement_keys=["source"], stage=stage)
    ov = rep["overview"].first()
    # 'NULL' folds to NULL, so the two b rows are duplicates too: 6 rows -> 3.
    assert (ov.row_count, ov.duplicates_removed) == (3, 3)
    top = rep["engagement_source"].orderBy("rank").first()
    assert (top.source, top.total_engagement) == ("c", 2.0)


def test_on_frame_sees_every_frame(events):
    seen = []
    rep = tweets_report(events, key_sets=[["event_type"]], metrics=["value"], engagement_keys=[],
                        on_frame=lambda name, frame: seen.append(name))
    assert seen == list(rep)


def test_tweet_ids_are_not_coerced(spark):
    big = 2**53
    rows = [(str(big), "web", "1"), (str(big + 1), "web", "2"), (str(big + 1), "app", "3")]
    d = spark.createDataFrame(rows, "id string, source string, likeCount string")
    rep = tweets_report(d, stage=False)
    top = {(r.id, r.source): r.size for r in rep["groups_id_source_top"].collect()}
    # Through a double both ids would be 2^53 and merge; as keys they stay apart.
    assert top == {(str(big), "web"): 1, (str(big + 1), "web"): 1, (str(big + 1), "app"): 1}


def test_ads_report_looks_for_the_candidate_only_when_asked(spark, tmp_path):
    d = spark.range(200).select(F.col("id").cast("string").alias("page_id"), (F.col("id") % 3).cast("string").alias("v"), F.concat(F.lit("t"), F.col("id") % 4).alias("kind"))
    rep = ads_report(d, key_sets=[["page_id"]], json_columns=[])
    spark.sparkContext.setJobGroup("built", "report")
    tracker = spark.sparkContext.statusTracker()
    assert rep["overview"].first().row_count == 200
    seen = len(tracker.getJobIdsForGroup("built"))
    assert "candidate_kind_top" not in rep._plans
    assert rep["candidate_kind_top"].count() == 4 and "candidate_kind_top" in list(rep)
    assert len(tracker.getJobIdsForGroup("built")) > seen
    spark.sparkContext.setJobGroup("", "")
    with pytest.raises(KeyError):
        rep["no such frame"]
