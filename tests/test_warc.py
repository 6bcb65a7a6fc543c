"""WARC records, shards and the data source."""

from __future__ import annotations

import glob
import gzip
import re
from datetime import datetime

from crawlframe import schemas
from crawlframe.operators.archive import body_text, warc_records
from crawlframe.session import fresh_path
from crawlframe.sources import warc

T0 = datetime(2024, 2, 29, 23, 59, 59, 999_999)


def fetches(spark, rows):
    return spark.createDataFrame(
        [(u, "a.x", T0, 1, s, v, h, b, "Other") for u, s, v, h, b in rows], schemas.FETCH_RESULTS
    )


ROWS = [
    ("http://a.x/ü", 200, "HTTP/1.1", [("b", "2"), ("a", "1"), ("b", "ß")], "grün €".encode()),
    ("http://a.x/empty", 404, "HTTP/2.0", [], b""),
    ("http://a.x/bytes", 799, "HTTP/1.0", [("x", "")], b"\xff\x00\r\n\r\nWARC/1.1\r\n"),
]


def test_record_bytes(spark):
    got = {r.target_uri: r for r in warc_records(fetches(spark, ROWS)).collect()}
    row = got["http://a.x/ü"]
    head = "HTTP/1.1 200 OK\r\nb: 2\r\na: 1\r\nb: ß\r\n\r\n".encode()
    body = "grün €".encode()
    assert re.fullmatch(r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", row.record_id)
    assert bytes(row.record) == (
        "WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\n"
        f"WARC-Record-ID: {row.record_id}\r\nWARC-Target-URI: http://a.x/ü\r\n"
        f"Content-Length: {len(head) + len(body)}\r\nWARC-Date: 2024-02-29T23:59:59Z\r\n\r\n"
    ).encode() + head + body + b"\r\n\r\n"
    assert bytes(got["http://a.x/empty"].record).endswith(b"\r\n\r\nHTTP/2.0 404 Not Found\r\n\r\n\r\n\r\n")
    assert b"HTTP/1.0 799 <unknown status code>\r\nx: \r\n\r\n\xff" in bytes(got["http://a.x/bytes"].record)


def test_body_text(spark):
    df = spark.createDataFrame([(1, b"a\xffb"), (2, "ü€".encode()), (3, b"")], "page_id bigint, body binary")
    assert {r.page_id: r.n_chars for r in body_text(df).collect()} == {1: 3, 2: 2, 3: 0}


def test_roundtrip_and_modes(spark):
    warc.register(spark)
    path = fresh_path(spark, "warc")
    records = warc_records(fetches(spark, ROWS))
    records.write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    got = {r.target_uri: bytes(r.http) for r in read.collect()}
    assert set(got) == {u for u, *_ in ROWS}
    for url, _, _, _, body in ROWS:
        assert got[url].split(b"\r\n\r\n", 1)[1] == body
    records.write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 6
    records.limit(1).write.format("warc").mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).count() == 1
    lean = spark.read.format("warc").option("payload", "false").load(path).first()
    assert lean.http is None and lean.content_length > 0
    assert not glob.glob(f"{path}/_temporary*")


def test_shards_rotate_after_the_limit(spark):
    warc.register(spark)
    size = 2**20 // 4

    def shards(extra: int) -> list[int]:
        path = fresh_path(spark, "warc")
        rows = spark.range(0, 9, 1, 1).selectExpr(
            f"cast(rpad('', {size}, 'x') AS binary) AS record"
        ) if not extra else spark.range(0, 9, 1, 1).selectExpr(
            f"cast(rpad('', {size + extra}, 'x') AS binary) AS record"
        )
        rows.write.format("warc").mode("append").save(path)
        return [len(gzip.open(f).read()) for f in sorted(glob.glob(f"{path}/archive_*_00000_*.warc.gz"))]

    # exactly 1 MiB does not close a shard, one byte more does
    assert shards(0) == [5 * size, 4 * size]
    assert shards(1) == [4 * (size + 1), 4 * (size + 1), size + 1]


def test_reader_takes_one_member_per_shard(spark, tmp_path):
    warc.register(spark)
    records = [bytes(r.record) for r in warc_records(fetches(spark, ROWS)).collect()]
    with gzip.open(tmp_path / "archive_000.warc.gz", "wb") as f:
        f.write(b"".join(records))
    got = spark.read.format("warc").load(str(tmp_path)).select("target_uri").collect()
    assert sorted(r.target_uri for r in got) == sorted(u for u, *_ in ROWS)
    assert spark.read.format("warc").load(fresh_path(spark, "nothing")).count() == 0
