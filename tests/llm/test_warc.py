import base64
import collections
import hashlib
import io
import zlib

import pytest

from chainlake.llm import warc

BIG, OTHER = "<p>é</p>" * 400, "x" * 1000
PAGES = [(1, "u1", BIG), (5, "u5", BIG), (3, "u3\r\nWARC-Type: x", BIG), (7, "u", OTHER), (7, "u", OTHER), (8, None, "small"), (9, "u", "small"), (10, "u", None), (11, "u", ""), (None, "u", BIG), (-4, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 200), (12, "u", "y" * 300_000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "x", "x") for p in PAGES], "page_id bigint, url string, html string, digest string, salt string")


def test_round_trip(spark, pages):
    from pyspark.sql import functions as F

    index, folder = warc.archive_pages(pages)
    rows = warc.chunk_table(index, folder).withColumn("page_id", warc.page_column(F.col("record_id"))).withColumn("to", warc.page_column(F.col("refers_to"))).collect()
    last = collections.Counter((r["page_id"], r["bytes_so_far"], r["sha1_so_far"], r["record_type"], r["to"]) for r in rows if r["is_last"])
    want = collections.Counter()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        top = max((j for j, _, h in PAGES if j is not None and h == html), default=None)
        to = top if len(raw) >= 1000 and i != top else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to] += 1
    assert last == want
    long = sorted((r for r in rows if r["page_id"] == 12), key=lambda r: r["chunk_no"])
    assert b"".join(bytes(r["data"]) for r in long) == b"y" * 300_000 and len(long) == 5
    assert [r["bytes_so_far"] for r in long] == [65536, 131072, 196608, 262144, 300000]
    assert max(len(r["data"]) for r in rows) <= warc.CHUNK


def test_empty_table(spark, pages):
    index, folder = warc.archive_pages(pages.where("false"))
    assert index.count() == 0 and warc.chunk_table(index, folder).count() == 0


def test_ids():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        assert warc.record_id(i).startswith("<urn:uuid:")
    assert len({warc.record_id(i) for i in (None, 0, 1, -1)}) == 4


def test_damage_is_noticed():
    digest = hashlib.sha1(b"abc").hexdigest()
    good = b"".join(warc.head_of(1, "u", 3, digest, None)) + b"abc\r\n\r\n"

    def read(raw):
        packed = zlib.compressobj(wbits=31)
        data = packed.compress(raw) + packed.flush()
        return list(warc.read_chunks(io.BytesIO(data), len(data)))

    assert read(good)[0]["sha1_so_far"] == digest
    for bad in (good.replace(b"abc", b"abd"), good[:-6], good.replace(b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(warc.WarcError):
            read(bad)


def test_hot_payload_is_spread(spark):
    rows = spark.range(3000).selectExpr("id as page_id", "concat('u', id) as url", "if(id % 3 = 0, repeat('z', 2000), concat(repeat('q', 2000), id)) as html")
    from pyspark.sql import functions as F

    got = warc.with_revisits(rows.select("page_id", "url", F.col("html").cast("binary").alias("payload")))
    assert got.where("refers_to = 2997").count() == 999 and got.where("refers_to is null").count() == 2001


def packed(*records, plain=False):
    out = b""
    for r in records:
        gz = zlib.compressobj(wbits=31)
        out += r if plain else gz.compress(r) + gz.flush()
    return out


def record(kind, block, *fields, version="1.0"):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", *fields, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nX-Name: caf\xe9 \xff\r\n\r\n"
BODY = b"<p>body</p>" * 10_000
SAID = "WARC-Payload-Digest: SHA1:" + base64.b32encode(hashlib.sha1(BODY).digest()).decode()
WORLD = (
    record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
    record("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://x/"),
    record("response", HTTP + BODY, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://x/", SAID, version="1.1"),
    record("metadata", b"a: b\r\n\r\n", "WARC-Concurrent-To: <urn:uuid:response>", "X-Long: one", "  two"),
    record("revisit", HTTP, "Content-Type: application/http", "WARC-Refers-To: <urn:uuid:response>", SAID),
    record("resource", b"", "WARC-Payload-Digest: md5:abc"),
    record("response", b"no head at all" * 100_000, "Content-Type: application/http"),
    record("conversion", b"\r\n\r\n\r\n"),
)


@pytest.mark.parametrize("plain", [False, True])
def test_archives_of_others(spark, tmp_path, plain):
    """Records of all types, base32 digests, heads that aren't UTF-8, no private field; gzip members or none."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / ("a.warc" if plain else "a.warc.gz")).write_bytes(packed(*WORLD, plain=plain))
    index = warc.archive_index(spark, f"file://{tmp_path}")
    rows = warc.chunk_table(index, f"file://{tmp_path}").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["record_type"]].append(r)
    payload = lambda kind: b"".join(bytes(r["data"]) for r in by[kind])
    assert payload("warcinfo") == b"software: x\r\n" and payload("request") == b"" and payload("metadata") == b"a: b\r\n\r\n" and payload("conversion") == b"\r\n\r\n\r\n"
    assert payload("response") == BODY + b"no head at all" * 100_000 and max(len(r["data"]) for r in rows) <= warc.CHUNK
    (revisit,) = by["revisit"]
    assert (revisit["sha1_so_far"], revisit["bytes_so_far"], revisit["refers_to"]) == (hashlib.sha1(BODY).hexdigest(), None, "<urn:uuid:response>")
    assert [r["bytes_so_far"] for r in by["resource"]] == [0] and by["request"][0]["target_uri"] == "http://x/"
    assert warc.archive_index(spark, f"file://{tmp_path / 'in'}").count() == 1
    with pytest.raises(warc.WarcError):
        raw = packed(record("response", b"x", "WARC-Block-Digest: sha1:" + "0" * 40))
        list(warc.read_chunks(io.BytesIO(raw), len(raw)))


def test_urls_of_any_length(spark):
    long = "http://x/" + "é" * 2_000_000
    df = spark.createDataFrame([(1, long, "text"), (2, None, None)], "Page_ID bigint, URL string, html string")
    index, folder = warc.archive_pages(df)
    rows = {r["record_id"]: r for r in warc.chunk_table(index, folder).collect()}
    assert rows[warc.record_id(1)]["target_uri"] == long and rows[warc.record_id(1)]["bytes_so_far"] == 4 and rows[warc.record_id(2)]["bytes_so_far"] == 0


def test_the_registered_query_and_its_sql(spark):
    import duckdb

    from chainlake.llm import queries

    sf = "/root/testdata/sf0.001"
    for name, sql in queries.ORACLE_SQL.items():
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.sql(sql)
        got = queries.QUERIES[name](spark, sf).select(*want.columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
