"""WARC archives with revisit resolution.

Writing: only headers (page id, payload digest, length) are shuffled by digest;
a grouped minimum finds the original of each repeated payload. The decision goes
back to the pages by page id, payloads of revisits are dropped, and Spark's text
writer lays the records down as gzipped WARC files: a row is a record, and the
line separator is the blank lines that end one.

Reading: Spark's text reader delivers a file's bytes back in order, cut at the
same separator; a parser in the task joins them up again by Content-Length, so
a payload may hold the separator itself and no file is held whole. Revisits get
their payload's length from the response that they refer to, by a join of the
headers on the digest.

Spark's writer makes one gzip stream of a file, not a member for each record, so
other readers can go through the files but not seek in them; each file begins
with whatever record its task has first, there is no warcinfo record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import carry_package, pick, sql_type, stage
from tablelens.session import shared_dir

#: Payloads of fewer bytes are always written out.
MIN_PAYLOAD = 100
#: Records per archive file (a file is read by one task).
RECORDS_PER_FILE = 50_000
# Fixed values of the WARC 1.1 format.
CRLF = "\r\n"
END = CRLF + CRLF
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column) -> Column:
    """``<urn:page:id:...>``, percent-encoded; ``<urn:page:none>`` for a null id."""
    return F.when(page_id.isNull(), F.lit("<urn:page:none>")).otherwise(
        F.concat(F.lit("<urn:page:id:"), F.url_encode(page_id.cast("string")), F.lit(">"))
    )


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def classified(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``(page_id, url, payload, digest, n_bytes, refers_to, refers_url)``; see ``write_archives``."""
    payload = F.coalesce("payload", F.lit(""))
    digested = pages.withColumn("payload", payload).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n_bytes")
    )
    headers = digested.where(F.col("n_bytes") >= min_payload).select("page_id", "digest", "url")
    originals = (
        headers.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("refers_url"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL")
        .drop("n")
        .hint("rebalance")
    )
    revisits = (
        headers.drop("url")
        .join(originals, "digest")
        .where("page_id IS NULL OR page_id != refers_to")
        .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to", "refers_url")
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    return digested.join(revisits, same, "left").drop("r_id", "r_digest")


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_payload: int = MIN_PAYLOAD,
    date: str | None = None,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write one WARC record per row under ``path``, as gzipped files.

    Of the rows with equal payloads of at least ``min_payload`` bytes, those
    with the smallest id are ``response`` records with the payload, the others
    ``revisit`` records that refer to it. Smaller payloads and a null payload
    (an empty one) are always responses. Rows that repeat the smallest id are
    all responses; rows with a null id come after all ids, and stay responses
    if no copy has an id. Line breaks in a URL are percent-encoded, a null URL
    gives no target header. All records have one date, by default the time of
    this call; revisits name target and date of what they refer to. An empty
    table gives an archive without records.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = classified(pick(pages, page_id=id_col, url=url_col, payload=payload_col), min_payload)
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(END),
    )

    def target(c: str) -> Column:
        return F.replace(F.replace(F.col(c), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    record = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", target("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(IDENTICAL))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, target("refers_url"))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(F.concat(http, body)).cast("string")),
        F.lit(CRLF),
        http,
        body,
    )
    writer = rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, payload)`` of each record of a stream of file parts.

    Each part is followed by the separator, which the reader took away.
    """
    buffer, ends = bytearray(), END.encode()

    def fill() -> bool:
        part = next(chunks, None)
        if part is not None:
            buffer.extend(part)
            buffer.extend(ends)
        return part is not None

    while True:
        # Line breaks left over between records (a payload may end with some).
        while buffer[:1] in (b"\r", b"\n"):
            del buffer[: len(buffer) - len(buffer.lstrip(b"\r\n"))]
        if not buffer:
            if not fill():
                return
            continue
        while (at := buffer.find(ends)) < 0:
            if not fill():
                raise ValueError("a record's header is cut off")
        lines = buffer[:at].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = at + len(ends)
        end = begin + int(headers["content-length"])
        while len(buffer) < end:
            if not fill():
                raise ValueError("a record's block is cut off")
        block = bytes(buffer[begin:end])
        del buffer[:end]
        http = headers.get("content-type", "").startswith("application/http")
        yield headers, block[block.index(ends) + len(ends) :] if http and ends in block else block


def checked_digest(claim: str | None, payload: bytes | None) -> str | None:
    """A payload's SHA-256 in hex, after its header's claim (``sha256:`` hex or ``sha1:`` base32) is held against it.

    Without a payload (a revisit) the claimed SHA-256, or None for a claim of
    another kind.
    """
    kind, _, value = (claim or "").partition(":")
    if payload is None:
        return value if kind == "sha256" else None
    found = hashlib.sha256(payload).hexdigest()
    own = {"sha256": found, "sha1": base64.b32encode(hashlib.sha1(payload).digest()).decode()}.get(kind)
    if own is not None and own.lower() != value.lower():
        raise ValueError(f"payload digest {own} differs from the header's {value}")
    return found


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", payload: bool = False) -> DataFrame:
    """Response and revisit records of the archives under ``path``, one row each.

    Columns: ``page_id`` (null for record ids that ``write_archives`` did not
    make), ``url, record_type, refers_to, payload_digest`` (bare SHA-256 hex; a
    response's is computed from the payload that was read, and must agree with
    its header, if that has a SHA-256 or SHA-1; a revisit's is its header's
    SHA-256, else null), ``own_bytes`` (the payload bytes in the record itself)
    and, if asked for, ``payload`` (empty for revisits). Other records, as
    warcinfo or request, are passed over.
    """
    carry_package(spark)
    text = spark.read.option("lineSep", END).text(path)

    def page(record_id: str) -> str | None:
        inner = record_id.strip("<>")
        return unquote_plus(inner.removeprefix("urn:page:id:")) if inner.startswith("urn:page:id:") else None

    names = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    schema = ", ".join(f"{n} string" for n in names) + ", own_bytes bigint" + ", payload binary" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (v.as_buffer().to_pybytes() for b in batches for v in b.column(0))
        out: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            kinds = [pa.string()] * 5 + [pa.int64()] + [pa.binary()] * payload
            columns = zip(*out, strict=True)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names + ["own_bytes"] + ["payload"] * payload)

        for headers, body in parse_records(parts):
            kind = headers["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            digest = checked_digest(headers.get("warc-payload-digest"), body if kind == "response" else None)
            refers = page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
            row = (page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, refers, digest, len(body))
            out.append(row + (body,) * payload)
            held += len(body) * payload
            if len(out) >= 2000 or held > 16_000_000:
                yield emit()
                held = 0
        if out:
            yield emit()

    records = text.mapInArrow(run, schema)
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` with full lengths.

    Headers of revisits are joined to those of responses by digest. A revisit
    whose response is missing from the archives has a null ``payload_bytes``.
    """
    responses = records.where("record_type = 'response'")
    lengths = responses.groupBy(F.col("payload_digest").alias("digest")).agg(F.max("own_bytes").alias("n_bytes"))
    revisits = records.where("record_type = 'revisit'")
    full = revisits.join(lengths.hint("rebalance"), F.col("payload_digest") == F.col("digest"), "left")
    columns = ["payload_digest", "record_type", "refers_to"]
    return responses.select("page_id", F.col("own_bytes").alias("payload_bytes"), *columns).unionByName(
        full.select("page_id", F.col("n_bytes").alias("payload_bytes"), *columns)
    )


def archive_roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, resolve revisits."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    id_type = sql_type(pick(pages, page_id=id_col), "page_id")
    return resolve_revisits(stage(read_archives(spark, path, id_type), "warc-headers"))
