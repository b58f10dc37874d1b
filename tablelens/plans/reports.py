"""The three end-to-end analyses as lazy report builders (§3 of the survey).

Each returns a ``Report``, a mapping from name to DataFrame; nothing is printed or collected except
the few driver-side decisions the analyses need before later plans can be
built: column roles (one row per column), the dedup counts (two numbers,
observed while staging) and, for ads, the grouping-candidate column (one row).
Frames are planned when they are first asked for; ``on_frame`` receives each
frame as soon as it is planned (given it, all frames are planned at once).

A key set with a column that the table lacks is left out as a whole and listed
in ``report.skipped``; a key set is never shortened. ``order_by`` names the
column that holds the file order: it takes no part in typing, profiles and
dedup. Numbers of columns that a frame covers are parameters, with the
reference's numbers as defaults.

Column names are parameters with the reference's names as defaults; callers
pass their own. ``stage=True`` writes the cleaned table once as Parquet in the
shared checkpoint folder and reads it back, so every report frame starts from
the cleaned columns instead of re-running the dedup shuffle (or re-parsing a
text source) once per frame, and a lost executor recomputes from Parquet.
It is the default for tweets and ads, which deduplicate; posts only applies
column expressions, which Spark fuses into each frame's scan, so it defaults
to no staging.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablelens.functions.nulls import col_of
from tablelens.operators import clean, engagement, groups, profile, roles
from tablelens.session import shared_dir

# The reference's column names, used only as defaults.
ADS_KEY_SETS = (("page_id",), ("page_id", "ad_id"), ("ad_id",))
ADS_JSON_COLUMNS = ("delivery_by_region", "demographic_distribution", "publisher_platforms")
POSTS_METRICS = ("Likes", "Comments", "Shares")
POSTS_RANKING_METRICS = ("Likes", "Comments", "Shares", "Love", "Wow", "Haha", "Sad", "Angry", "Care")
TWEETS_KEY_SETS = (("source",), ("id", "source"), ("lang",))
TWEETS_METRICS = ("retweetCount", "replyCount", "likeCount", "quoteCount", "bookmarkCount")
TWEETS_ENGAGEMENT_KEYS = ("source", "lang")
TWEETS_ID_COLUMNS = ("id",)  # never coerced: 64-bit ids must not pass through double (V25)


OnFrame = Callable[[str, DataFrame], None]


class Report(Mapping):
    """Frames by name, each planned when it is first read (threads may read at once)."""

    def __init__(self, on_frame: OnFrame | None = None):
        self._plans: dict[str, Callable[[], DataFrame]] = {}
        self._on_frame = on_frame
        self._later: list[Callable[[], None]] = []
        #: Key sets that were left out, with the columns that the table lacks.
        self.skipped: dict[tuple[str, ...], list[str]] = {}

    def add_later(self, block: Callable[[], None]) -> None:
        """``block`` adds frames whose names are known only after a job: when all names or one of them are asked for."""
        self._later.append(_once(block))

    def _settle(self) -> None:
        for block in self._later:
            block()

    def add(self, name: str, plan: Callable[[], DataFrame]) -> None:
        self._plans[name] = _once(plan)
        if self._on_frame is not None:
            self._on_frame(name, self[name])

    def has_keys(self, d: DataFrame, keys: Sequence[str]) -> bool:
        """True if ``d`` has all ``keys``; otherwise the set is listed as skipped."""
        missing = [k for k in keys if k not in d.columns]
        if missing:
            self.skipped[tuple(keys)] = missing
        return not missing

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._plans:
            self._settle()
        return self._plans[name]()

    def __iter__(self):
        self._settle()
        return iter(list(self._plans))

    def __len__(self) -> int:
        self._settle()
        return len(self._plans)


def _without(d: DataFrame, order_by: str | None) -> DataFrame:
    """The table's own columns: all but the one that holds the file order."""
    return d.select(*[col_of(c) for c in d.columns if c != order_by])


@dataclass
class Staged:
    """A cleaned table written once, with what was observed while writing it."""

    frame: DataFrame
    rows: int  # rows written
    rows_before: int  # rows before dedup (equal to ``rows`` without dedup)
    counts: dict  # ``ratio_aggregates`` counters


def stage_table(
    d: DataFrame, name: str, dedup: bool = False, typed_columns: Sequence[str] | None = None
) -> Staged:
    """Write ``d`` (deduplicated if asked) as Parquet in the shared folder.

    The typing counters and the row counts before and after dedup are
    computed by ``observe`` inside the same write job (no extra pass over the
    source). With ``dedup`` the rows
    are grouped on all columns with a count, so the rows before dedup are
    the sum of those counts. The observation sits in the write's result
    stage, whose task results count once even when tasks are retried.
    """
    cols = d.columns
    if dedup:
        # groupBy on every column = dropDuplicates, keeping the multiplicity.
        d = d.groupBy(*[col_of(c) for c in cols]).agg(F.count(F.lit(1)).alias("_dup_n"))
        before = F.sum("_dup_n")
    else:
        before = F.count(F.lit(1))
    obs = Observation(f"stage-{name}-{uuid.uuid4().hex[:8]}")  # unique per run
    exprs = [
        F.count(F.lit(1)).alias("_rows"),
        before.alias("_before"),
        *roles.ratio_aggregates(d, list(typed_columns or cols)),
    ]
    target = shared_dir(d.sparkSession, name)
    d.observe(obs, *exprs).select(*[col_of(c) for c in cols]).write.mode("overwrite").parquet(target)
    m = obs.get
    return Staged(
        frame=d.sparkSession.read.parquet(target),
        rows=m["_rows"],
        rows_before=m["_before"] or 0,
        counts={k: v for k, v in m.items() if k.startswith(("_n", "_k"))},
    )


def _once(make: Callable):
    """A function that gives ``make``'s result, made at its first call (by one thread)."""
    made: list = []
    lock = Lock()

    def get():
        with lock:
            if not made:
                made.append(make())
        return made[0]

    return get


def _overview_with_dups(ov: DataFrame, raw: DataFrame, deduped: DataFrame, st: Staged | None) -> DataFrame:
    """Overview plus ``duplicates_removed`` = rows before - rows after dedup.

    Staged: both counts were observed while writing. Otherwise two scalar
    subqueries over row counts, not a second all-column shuffle.
    """
    if st is not None:
        return ov.withColumn("duplicates_removed", F.lit(st.rows_before - st.rows).cast("long"))
    before = raw.select(F.count(F.lit(1))).scalar()
    after = deduped.select(F.count(F.lit(1))).scalar()
    return ov.withColumn("duplicates_removed", (before - after).cast("long"))


def _group_block(
    out: Report,
    d: DataFrame,
    keys: Sequence[str],
    numeric: Sequence[str],
    prefix: str,
    top_k: int,
    drill_k: int,
    drill_cols: int | None,
    exact_scale: int | None,
) -> None:
    """Size statistics, top groups and drill-down of one key set, from one group table."""
    if not out.has_keys(d, keys):
        return
    tag = f"{prefix}_{'_'.join(keys)}"
    drilled = list(numeric)[:drill_cols]

    def write() -> DataFrame:
        target = shared_dir(d.sparkSession, "groups")
        planned = groups.group_table(d, keys, drilled, exact_scale=exact_scale)
        planned.write.parquet(target)
        return d.sparkSession.read.schema(planned.schema).parquet(target)

    table = _once(write)  # when a frame of the block is first asked for
    out.add(f"{tag}_size_stats", lambda: groups.size_stats_of(table().select(groups.SIZE)))
    out.add(f"{tag}_top", lambda: groups.top_of(table(), keys, top_k))
    if drilled:
        out.add(f"{tag}_drilldown", lambda: groups.drilldown_of(table(), keys, drilled, drill_k))


def tweets_report(
    d: DataFrame,
    key_sets: Sequence[Sequence[str]] = TWEETS_KEY_SETS,
    metrics: Sequence[str] = TWEETS_METRICS,
    engagement_keys: Sequence[str] = TWEETS_ENGAGEMENT_KEYS,
    id_columns: Sequence[str] = TWEETS_ID_COLUMNS,
    null_tokens: str = "folded",
    stage: bool = True,
    exact_scale: int | None = None,
    on_frame: OnFrame | None = None,
    order_by: str | None = None,
    top_k: int = 10,
    stat_cols: int | None = 3,
) -> Report:
    """Tweets: folded null tokens, dedup, ratio typing, overview, groups, engagement.

    Order: normalise and dedup (staged once), classify on the deduplicated
    rows, coerce numeric columns lazily (a per-frame projection).
    """
    normalised = clean.normalise_nulls(_without(d, order_by), null_tokens)
    st = None
    if stage:
        st = stage_table(normalised, "tweets-clean", dedup=True)
        cleaned = st.frame
        r = roles.roles_from_counts(cleaned.columns, st.counts, 0.8, False, id_columns=id_columns)
    else:
        cleaned = clean.dedup(normalised)
        r = roles.classify_columns(cleaned, threshold=0.8, inclusive=False, id_columns=id_columns)
    typed = clean.coerce_numeric(cleaned, r.numeric)
    out = Report(on_frame)
    both = _once(lambda: profile.overview_and_profile(typed, r, decimals=2, exact_scale=exact_scale))
    out.add("overview", lambda: _overview_with_dups(both()[0], normalised, cleaned, st))
    out.add("numeric_profile", lambda: both()[1])
    out.add("text_profile", lambda: profile.categorical_profile(typed, r.text))
    for keys in map(list, key_sets):
        if not out.has_keys(typed, keys):
            continue
        tag = "_".join(keys)
        out.add(f"groups_{tag}_top", lambda keys=keys: groups.top_groups(typed, keys, k=top_k))
        out.add(
            f"groups_{tag}_count",
            lambda keys=keys: groups.group_sizes(typed, keys).agg(F.count(F.lit(1)).alias("group_count")),
        )
        if r.numeric:
            out.add(
                f"groups_{tag}_numeric",
                lambda keys=keys: groups.grouped_numeric_stats(
                    typed, keys, r.numeric, k=top_k, max_cols=stat_cols, exact_scale=exact_scale
                ),
            )
    present = engagement.available_metrics(typed, metrics)
    for key in engagement_keys if present else ():
        if out.has_keys(typed, [key]):
            out.add(
                f"engagement_{key}",
                lambda key=key: engagement.engagement_by_group(typed, key, present, k=top_k, exact_scale=exact_scale),
            )
    return out


def posts_report(
    d: DataFrame,
    page_key: str = "Facebook_Id",
    post_key: str = "post_id",
    category_key: str = "Page Category",
    metrics: Sequence[str] = POSTS_METRICS,
    ranking_metrics: Sequence[str] = POSTS_RANKING_METRICS,
    order_by: str | None = None,
    stage: bool = False,
    exact_scale: int | None = None,
    on_frame: OnFrame | None = None,
    top_k: int = 10,
    ranking_k: int = 5,
    first_page_cols: int | None = 3,
    first_post_cols: int | None = 2,
    mean_cols: int | None = 4,
    ranked_metrics: int | None = 3,
) -> Report:
    """Posts: empty-only nulls, ratio typing, profiles, page / post / category analyses.

    ``order_by`` (e.g. the column ``read_table(..., row_seq=...)`` adds, or a
    column of the table itself) defines "first appearance" for the first-groups
    samples; without it those samples are not in the report, since Spark rows
    have no file order. A struct column is taken to be a file order and left out
    of everything else.
    """
    seq = order_by if order_by and isinstance(d.schema[order_by].dataType, StructType) else None
    cleaned = clean.normalise_nulls(d, "empty", trim=False)
    own = [c for c in cleaned.columns if c != seq]
    ids = [page_key, post_key]
    if stage:
        st = stage_table(cleaned, "posts-clean", typed_columns=own)
        cleaned = st.frame
        r = roles.roles_from_counts(own, st.counts, 0.8, False, id_columns=ids)
    else:
        r = roles.classify_columns(_without(cleaned, seq), threshold=0.8, inclusive=False, id_columns=ids)
    placed = clean.coerce_numeric(cleaned, r.numeric)
    typed = _without(placed, seq)
    out = Report(on_frame)
    both = _once(lambda: profile.overview_and_profile(typed, r, decimals=2, exact_scale=exact_scale))
    out.add("overview", lambda: both()[0])
    out.add("numeric_profile", lambda: both()[1])
    out.add("text_profile", lambda: profile.categorical_profile(typed, r.text))

    def first(keys: list[str], cols: int | None) -> DataFrame:
        return groups.first_groups(
            placed, keys, order_by, k=top_k, cols=r.numeric, max_cols=cols, exact_scale=exact_scale
        )

    if out.has_keys(typed, [page_key]):
        out.add("page_count", lambda: profile.distinct_counts(typed, [page_key]))
        if order_by:
            out.add("first_pages", lambda: first([page_key], first_page_cols))
    if out.has_keys(typed, [page_key, post_key]):
        out.add(
            "page_post_count",
            lambda: clean.distinct_keys(typed, [page_key, post_key]).agg(F.count(F.lit(1)).alias("combinations")),
        )
        if order_by:
            out.add("first_page_posts", lambda: first([page_key, post_key], first_post_cols))
    if out.has_keys(typed, [category_key]):
        out.add("category_share", lambda: engagement.category_share(typed, category_key))
        if r.numeric:
            out.add(
                "category_means",
                lambda: engagement.category_means(
                    typed, category_key, r.numeric, max_cols=mean_cols, exact_scale=exact_scale
                ),
            )
        ranking = engagement.available_metrics(typed, ranking_metrics)
        if ranking:
            out.add(
                "category_rankings",
                lambda: engagement.category_rankings(
                    typed, category_key, ranking, k=ranking_k, max_metrics=ranked_metrics, exact_scale=exact_scale
                ),
            )
    page_metrics = engagement.available_metrics(typed, metrics)
    if page_key in typed.columns and page_metrics:
        out.add(
            "page_engagement",
            lambda: engagement.page_engagement(typed, page_key, page_metrics, k=top_k, exact_scale=exact_scale),
        )
    return out


def ads_report(
    d: DataFrame,
    key_sets: Sequence[Sequence[str]] = ADS_KEY_SETS,
    json_columns: Sequence[str] = ADS_JSON_COLUMNS,
    id_columns: Sequence[str] = ("page_id", "ad_id"),
    candidate: bool = True,
    stage: bool = True,
    exact_scale: int | None = None,
    on_frame: OnFrame | None = None,
    order_by: str | None = None,
    parse_dates: bool = False,
    top_k: int = 10,
    drill_k: int = 3,
    drill_cols: int | None = 3,
    profile_cols: int | None = 5,
    candidate_cols: int | None = 10,
) -> Report:
    """Ads: strict null tokens, JSON text, unanimous typing, dedup, profiles, group analyses.

    ``parse_dates`` turns text columns whose every value is a date or time
    into timestamps before typing. The grouping candidate (a text column with
    2-20 distinct values) names the key of the last group analysis; it is looked
    for (one row is collected) when the report is gone through or a frame of
    that analysis is asked for, not while the report is built.
    """
    normalised = clean.normalise_json(clean.normalise_nulls(_without(d, order_by), "strict"), json_columns)
    if parse_dates:
        normalised = clean.coerce_dates(normalised)
    role_args = dict(
        threshold=1.0,
        inclusive=True,
        force_text=[c for c in json_columns if c in d.columns],
        id_columns=[c for c in id_columns if c in d.columns],
    )
    st = None
    if stage:
        st = stage_table(normalised, "ads-clean", dedup=True)
        cleaned = st.frame
        r = roles.roles_from_counts(cleaned.columns, st.counts, **role_args)
    else:
        cleaned = clean.dedup(normalised)
        r = roles.classify_columns(cleaned, **role_args)
    typed = clean.coerce_numeric(cleaned, r.numeric)
    out = Report(on_frame)
    both = _once(lambda: profile.overview_and_profile(typed, r, exact_scale=exact_scale))
    out.add("overview", lambda: _overview_with_dups(both()[0], normalised, cleaned, st))
    out.add("numeric_profile", lambda: profile.with_quantiles(both()[1], typed, r.numeric, (0.25, 0.5, 0.75)))
    out.add("text_profile", lambda: profile.categorical_profile(typed, r.text, max_cols=profile_cols))
    blocks = dict(top_k=top_k, drill_k=drill_k, drill_cols=drill_cols, exact_scale=exact_scale)
    for keys in map(list, key_sets):
        _group_block(out, typed, keys, r.numeric, "groups", **blocks)
    if candidate and r.text:
        cands = groups.grouping_candidates(typed, r.text, exclude=list(id_columns), max_cols=candidate_cols)
        # One row for each candidate, looked for once for both frames that need it.
        found = _once(lambda: typed.sparkSession.createDataFrame(cands.collect(), cands.schema))
        out.add("grouping_candidates", found)

        def by_candidate() -> None:
            best = found().where(F.col("choice") == 1).select("column_name").collect()
            if best:
                _group_block(out, typed, [best[0]["column_name"]], r.numeric, "candidate", **blocks)

        out.add_later(by_candidate)
    return out
