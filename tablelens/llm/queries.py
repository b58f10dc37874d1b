"""Registered queries of the training-data operators, with their SQL where SQL can express them.

Each query applies one operator with production parameters to its whole table.
``LLM_QUERIES`` maps a name to ``(query, sql or None)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.alignment import link_support, token_pair
from tablelens.llm.decontaminate import MASKS, SIMILARITY, WINDOW, benchmark_overlaps
from tablelens.llm.fingerprints import edited_pairs
from tablelens.llm.langid import identify_languages
from tablelens.llm.lexical import ranked_search
from tablelens.llm.linededup import dedup_lines
from tablelens.llm.packing import pack_documents, word_tokenizer
from tablelens.llm.quality import quality_posteriors
from tablelens.llm.secret_scan import BASE_RULES, MORE_RULES, scan_secrets
from tablelens.llm.simhash import simhash_components
from tablelens.llm.suffix_dedup import remove_repeats
from tablelens.llm.toxicity import toxicity
from tablelens.llm.warc import archive_roundtrip
from tablelens.sources.tables import read_parquet

LLM_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = (fn, sql)
        return fn

    return register


def public_tokenizer(name: str = TOKENIZER):
    """A maker of the tokenizer that a task calls for; the file's place is looked up there."""

    def make():
        import public_tokenizers

        return word_tokenizer(public_tokenizers.path(name))

    return make


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(read_parquet(spark, sf_dir, "documents"))
    unknown = F.lit(0.0)  # two texts that share nothing known
    return pairs.withColumns({c: F.coalesce(c, unknown) for c in ("near_edited", "near_next")})


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_parquet(spark, sf_dir, "documents"))


def _seed_sql(table: str, key: str, mask: str, number: int) -> str:
    """Each position of a text with the words that a mask keeps, in DuckDB SQL."""
    kept = [i for i, c in enumerate(mask) if c == "1"]
    words = ", ".join(f"lead(w, {i}) OVER p AS w{n}" for n, i in enumerate(kept))
    return f"""SELECT {key}, at_word, {number} AS mask, {words} FROM {table}
  WINDOW p AS (PARTITION BY {key} ORDER BY at_word) QUALIFY lead(w, {len(mask) - 1}) OVER p IS NOT NULL"""


def decontamination_sql() -> str:
    """``benchmark_overlaps`` of ``documents`` (unique ids), words compared as such."""

    def words(table: str, key: str) -> str:
        return f"""SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS at_word FROM
  (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM {table}) s"""

    seeds = {k: " UNION ALL ".join(_seed_sql(t, k, m, n) for n, m in enumerate(MASKS)) for t, k in (("dw", "doc_id"), ("iw", "item_id"))}
    same = " AND ".join(f"a.w{n} = b.w{n}" for n in range(MASKS[0].count("1")))
    return f"""
WITH dw AS ({words('documents', 'doc_id')}), iw AS ({words('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS size, least(count(*), {WINDOW}) AS span FROM iw GROUP BY item_id),
h AS (SELECT DISTINCT doc_id, item_id, a.at_word - b.at_word AS begins FROM ({seeds['doc_id']}) a JOIN ({seeds['item_id']}) b ON a.mask = b.mask AND {same}),
g AS (SELECT h.doc_id, h.item_id, begins, iw.at_word, CASE WHEN dw.w = iw.w THEN 1 ELSE 0 END AS agree
  FROM h JOIN iw ON h.item_id = iw.item_id LEFT JOIN dw ON dw.doc_id = h.doc_id AND dw.at_word = begins + iw.at_word),
t AS (SELECT g.doc_id, g.item_id, begins, at_word, size, span, sum(agree) OVER (PARTITION BY g.doc_id, g.item_id, begins ORDER BY at_word
  ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS total FROM g JOIN n ON g.item_id = n.item_id),
b AS (SELECT doc_id, item_id, begins, span, max(total) AS matched FROM t WHERE at_word <= size - span GROUP BY ALL)
SELECT doc_id, item_id, CAST(begins AS INTEGER) AS position, CAST(matched AS INTEGER) AS matched, CAST(span AS INTEGER) AS compared
FROM b WHERE matched >= {SIMILARITY} * span
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, begins) = 1"""


@query("op3_decontamination", decontamination_sql())
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = benchmark_overlaps(read_parquet(spark, sf_dir, "documents"), read_parquet(spark, sf_dir, "benchmark"))
    return leaks.drop("doc_key")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_parquet(spark, sf_dir, "documents"), public_tokenizer())


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM o"""


@query("op5_warc", WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_roundtrip(read_parquet(spark, sf_dir, "pages"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_parquet(spark, sf_dir, "documents"), read_parquet(spark, sf_dir, "labels"))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_parquet(spark, sf_dir, "documents"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents' host is their source; the path below it starts with their language."""
    return quality_posteriors(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(read_parquet(spark, sf_dir, "documents"), read_parquet(spark, sf_dir, "labels"))
    return scores.drop("doc_key")


def _either_case(words: str) -> str:
    """ASCII letters outside classes and escapes in either case, for an engine that folds Unicode."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def secrets_sql() -> str:
    """``scan_secrets`` in DuckDB SQL: positions from the pieces between matches."""
    parts = []
    for k, r in enumerate((*BASE_RULES, *MORE_RULES)):
        head, end, tail = r.pattern.partition(")")
        pattern = (_either_case(head) + end + tail if r.kind == "assign" else r.pattern).replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{pattern}') AS ms,
  regexp_extract_all(text, '{pattern}', {r.group}) AS gs, string_split_regex(text, '{pattern}') AS ps FROM d"""
        )
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    n = len(BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
p AS (SELECT doc_id, k, kind, least, length(gs[i]) AS own, length(ms[i]) AS size,
  CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS begins FROM e),
s AS (SELECT doc_id, k, begins, kind || ':' || begins || ':' || (begins + size) AS span FROM p WHERE own >= least)
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg(span, ',' ORDER BY begins, k) FILTER (WHERE k < {n}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY begins, k), '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


@query("op9_secrets", secrets_sql())
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_parquet(spark, sf_dir, "documents"))


def line_dedup_sql(source: str) -> str:
    """``doc_id, removed_lines, text`` of ``source`` (doc_id unique) in DuckDB SQL."""
    return f"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
f AS (SELECT doc_id, pos AS a1, trim(line) AS l1,
  lead(trim(line)) OVER w AS l2, lead(trim(line), 2) OVER w AS l3, lead(pos, 2) OVER w AS a3
  FROM l WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, a1) AS nth FROM f WHERE l3 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(a1, a3)) AS pos FROM n WHERE nth > 1),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept, count(*) AS n_kept FROM l ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(gone, 0) AS BIGINT) AS removed_lines,
  CASE WHEN gone IS NULL THEN d.text ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id"""


@query("op10_line_dedup", line_dedup_sql("documents"))
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_parquet(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, removed_col="removed_lines").select("doc_id", "removed_lines", F.col("text"))


def public_token_pair(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model"):
    """A maker of both tokenizers that a task calls for; the files' places are looked up there."""

    def make():
        import public_tokenizers

        return token_pair(public_tokenizers.path(a), public_tokenizers.path(b))

    return make


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_support(read_parquet(spark, sf_dir, "documents"), public_token_pair())


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_parquet(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["begin"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _lexical_terms(table: str, key: str) -> str:
    """``key, terms`` of each row that has a term, in DuckDB SQL."""
    upper = "".join(map(chr, range(65, 91)))
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""SELECT {key}, ts FROM (SELECT {key},
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{term}') AS ts FROM {table}) s WHERE len(ts) > 0"""


def ranked_search_sql(k: int = 10) -> str:
    """``ranked_search`` of ``documents`` for ``benchmark`` (unique ids) in DuckDB SQL."""
    return f"""
WITH d AS ({_lexical_terms('documents', 'doc_id')}),
s AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS length FROM d),
t AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(ts) AS term FROM ({_lexical_terms('benchmark', 'item_id')}) b) u),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) f, s),
p AS (SELECT i.item_id, tf.doc_id, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * docs) // length))) AS part
  FROM i JOIN tf ON i.term = tf.term JOIN w ON i.term = w.term, s),
r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM p GROUP BY item_id, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY rank <= {k}"""


@query("op13_lexical", ranked_search_sql())
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_parquet(spark, sf_dir, "documents"), read_parquet(spark, sf_dir, "benchmark"))
