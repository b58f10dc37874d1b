import base64
import glob
import gzip
import hashlib
import random
from datetime import UTC, datetime

import duckdb
import pytest

from tablelens.llm.queries import WARC_SQL
from tablelens.llm.warc import archive_roundtrip, checked_digest, parse_records, read_archives, write_archives

PAGES = "page_id bigint, url string, html string"


def some_pages():
    rng = random.Random(8)
    body = lambda n: "".join(rng.choices(["<p>", "é", "😀", "\r\n", "\r\n\r\n", "\r", "\n", "WARC/1.1\r\n", "x"], k=n))
    shared = [body(200), "y" * 99, "z" * 100, "é" * 50, body(300) + "\r\n", "\r\n\r\n" * 60]
    pages = [(i, f"http://h{i % 5}.example/{i}", rng.choice([*shared, body(i), None, ""])) for i in range(120)]
    return [*pages, (500, None, shared[0]), (501, "http://a\r\nWARC-Type: x", shared[2]), (502, "u", "q" * 3_000_000)]


def brute(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == data and j is not None]
        revisit = len(data) >= 100 and same and i != min(same)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_roundtrip_matches_brute_force_and_sql(spark):
    pages = some_pages()
    random.Random(1).shuffle(pages)
    got = rows(archive_roundtrip(spark.createDataFrame(pages, PAGES).repartition(3)))
    assert got == sorted(brute(pages), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert got == sorted(con.execute(WARC_SQL).fetchall(), key=str)


def test_archives_hold_valid_records_and_payloads(spark, tmp_path):
    pages, path = some_pages(), str(tmp_path / "warc")
    frame = spark.createDataFrame(pages, PAGES).repartition(2)
    write_archives(frame, path, records_per_file=25)
    files = glob.glob(f"{path}/*.gz")
    assert len(files) > 4
    found = {}
    for f in files:
        for headers, payload in parse_records(iter([gzip.open(f).read()])):
            found[headers["warc-record-id"]] = (headers, payload)
    assert len(found) == len(pages)
    back = {r.page_id: r for r in read_archives(spark, path, payload=True).collect()}
    for i, url, html in pages:
        headers, payload = found[f"<urn:page:id:{i}>"]
        assert payload == bytes(back[i].payload)
        if headers["warc-type"] == "response":
            assert payload == (html or "").encode()
        else:
            assert payload == b"" and headers["warc-refers-to"] == f"<urn:page:id:{back[i].refers_to}>"
        assert back[i].url == (url and url.replace("\r", "%0D").replace("\n", "%0A"))


def test_null_and_repeated_ids(spark):
    big, other = "b" * 200, "c" * 200
    pages = [(None, "n", big), (4, "u", big), (4, "v", big), (6, "w", big), (None, "x", other), (None, "y", other)]
    got = rows(archive_roundtrip(spark.createDataFrame(pages, PAGES)))
    assert sorted(((r[0], r[3], r[4]) for r in got), key=str) == sorted(
        [(None, "revisit", 4), (4, "response", None), (4, "response", None), (6, "revisit", 4), (None, "response", None), (None, "response", None)],
        key=str,
    )


def test_string_ids_clashing_columns_and_empty_table(spark):
    schema = "page_id string, url string, html string, PAGE_ID string, digest string, refers_to string"
    pages = [("a b/ü", "u", "x" * 100, "1", "2", "3"), ("z>", "u", "x" * 100, None, None, None)]
    got = rows(archive_roundtrip(spark.createDataFrame(pages, schema)))
    assert [(r[0], r[3], r[4]) for r in got] == [("a b/ü", "response", None), ("z>", "revisit", "a b/ü")]
    assert archive_roundtrip(spark.createDataFrame([], PAGES)).collect() == []


def test_cut_off_records_are_noticed():
    with pytest.raises(ValueError, match="cut off"):
        list(parse_records(iter([b"WARC/1.1\r\nContent-Length: 50", b"HTTP"])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(parse_records(iter([b"garbage"])))


def test_fresh_headers(spark, tmp_path):
    """A date of now, or the one given; revisits name target and date of their response."""
    pages, path = some_pages(), str(tmp_path / "warc")
    frame = spark.createDataFrame(pages, PAGES)
    before = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    write_archives(frame, path)
    urls = {f"<urn:page:id:{i}>": url for i, url, _ in pages}
    dates = set()
    for f in glob.glob(f"{path}/*.gz"):
        for headers, _ in parse_records(iter([gzip.open(f).read()])):
            dates.add(headers["warc-date"])
            if headers["warc-type"] == "revisit":
                assert headers["warc-refers-to-date"] == headers["warc-date"]
                assert headers.get("warc-refers-to-target-uri") == urls[headers["warc-refers-to"]]
    assert len(dates) == 1 and before <= dates.pop() <= datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    write_archives(frame.limit(1), str(tmp_path / "dated"), date="2020-01-02T03:04:05Z")
    (f,) = glob.glob(f"{tmp_path}/dated/*.gz")
    assert b"WARC-Date: 2020-01-02T03:04:05Z" in gzip.open(f).read()


def record(kind, body, *headers, http=True):
    block = (b"HTTP/1.1 200 OK\r\n\r\n" if http else b"") + body
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", *headers, f"Content-Length: {len(block)}"]
    head.append("Content-Type: " + ("application/http; msgtype=response" if http else "application/warc-fields"))
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """A gzip member for each record, SHA-1 or no digests, other ids and kinds of record."""
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    records = [
        record("warcinfo", b"software: other\r\n", http=False), record("response", b"one", f"WARC-Payload-Digest: {sha1}", "WARC-Target-URI: http://a"),
        record("response", b"two"), record("revisit", b"", f"WARC-Payload-Digest: {sha1}", "WARC-Refers-To: <urn:uuid:9>"), record("request", b"GET"),
    ]
    (tmp_path / "other.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = [tuple(r) for r in read_archives(spark, str(tmp_path)).collect()]
    digests = [hashlib.sha256(x).hexdigest() for x in (b"one", b"two")]
    assert got == [(None, "http://a", "response", None, digests[0], 3), (None, None, "response", None, digests[1], 3), (None, None, "revisit", None, None, 0)]
    with pytest.raises(ValueError, match="differs"):
        checked_digest(sha1, b"two")
