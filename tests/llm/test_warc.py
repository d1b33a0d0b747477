"""WARC: round trips, revisits, pushed filters, plain and foreign files."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from talentgrid.llm import warc
from talentgrid.session import new_path


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_query(spark, small):
    from talentgrid.llm.queries import QUERIES

    pages = sorted((r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{small}/pages.parquet").collect())
    first = {}
    for i, h in pages:
        first.setdefault(h, i)
    want = {(i, len(h), digest(h), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in pages}
    assert {tuple(r) for r in QUERIES["op9_warc"](spark, small).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want


def written(spark):
    df = spark.createDataFrame(
        [(1, "u1", "a" * 5000), (2, "u2", "a" * 5000), (3, None, None), (None, "x", ""), (4, "http://b\r\nEvil: 1", "é"), (5, "u5", "a")],
        "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("sha", F.lit(1))
    path = new_path(spark, "warc")
    warc.write_warc(warc.with_revisits(df), path)
    return path


def test_revisits_and_headers(spark):
    path = written(spark)
    got = {r.record_key: r for r in warc.read_warc(spark, path).collect()}
    assert got[2].record_type == "revisit" and got[2].refers_to_key == 1 and got[2].payload is None and got[2].payload_bytes == 5000
    assert got[1].payload == b"a" * 5000 and got[4].payload == "é".encode() and got[4].target_uri == "http://b Evil: 1"
    assert got[None].refers_to_key == 3 and got[3].payload == b"" and got[3].target_uri is None
    assert all(r.payload_digest == digest(r.payload) for r in got.values() if r.payload is not None)
    least = warc.with_revisits(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), min_bytes=3)
    assert {r.record_type for r in least.collect()} == {"response"}


def test_filters_reach_the_reader(spark):
    path = written(spark)
    got = warc.read_warc(spark, path).where("record_type = 'revisit' AND record_key > 0 AND payload_bytes = 5000")
    assert [r.record_key for r in got.collect()] == [2]
    assert [r.record_key for r in warc.read_warc(spark, path, ["record_key"], target_prefix="u", record_type="response").orderBy("record_key").collect()] == [1, 5]
    reader = warc.WarcReader(path, ["record_key", "payload"], {})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 1),
                                    warc.StringStartsWith(("target_uri",), "u")]))
    assert len(left) == 1 and reader.equal == {"record_type": {"response"}} and reader.prefix == {"target_uri": ["u"]}


def test_plain_and_foreign_archives(spark, tmp_path):
    rows = [{"record_type": "response", "record_key": i, "target_uri": f"u{i}", "payload": bytes([65 + i]) * (i * 3000), "refers_to_key": None}
            for i in range(4)]
    records = [warc.record_bytes(r) for r in rows]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\nabc: d\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [info, *records]))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(warc._compressed(r) for r in records))
    got = warc.read_warc(spark, str(tmp_path), partition_bytes="1").collect()
    assert sorted(r.payload for r in got if r.record_type == "response") == sorted(r["payload"] for r in rows for _ in range(3))
    assert [r.payload for r in got if r.record_type == "warcinfo"] == [b"abc: d"] * 2
    lean = warc.read_warc(spark, str(tmp_path), ["record_key", "payload_bytes"], record_type="response").collect()
    assert sorted(r.payload_bytes for r in lean) == sorted(len(r["payload"]) for r in rows for _ in range(3))


def test_no_rows(spark, none):
    path = new_path(spark, "warc")
    warc.write_warc(warc.with_revisits(none, "id", "row", "text"), path)
    assert warc.read_warc(spark, path).collect() == []
