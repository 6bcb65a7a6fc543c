"""Archives with an index: lookups, what they open, commits by manifests."""

from __future__ import annotations

import glob
import gzip
import os
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlframe import schemas
from crawlframe.operators import archive
from crawlframe.session import fresh_path
from crawlframe.sources import manifests, warc

T0 = datetime(2024, 1, 1)


def fetches(spark, urls):
    rows = [(u, "a", T0 + timedelta(days=i), 1, 200, "HTTP/1.1", [], f"body {i} of {u}".encode(), "Other") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, schemas.FETCH_RESULTS)


URLS = [f"http://www.site{s}.example/p/{k}?q={k % 3}" for s in range(20) for k in range(40)]
ODD = [
    "https://a.example/x", "http://a.example:80/x#f", "http://u:p@a.example/x", "http://a.example/x?", "http://a.example/x/y",
    "http://b.a.example/x", "http://aa.example/x", "http://bücher.example/x", "http://10.0.0.1/x", "http://10.0.0.1:8080/x",
    "http://[::1]/x", "no url", "",
]


@pytest.fixture(scope="module")
def place(spark):
    path = fresh_path(spark, "archive")
    records = archive.archive_records(fetches(spark, ODD + URLS + URLS[:5]))
    warc.write_sorted(records, path, shard_bytes=4000)
    return path


def uris(df) -> list[str]:
    return sorted(r.target_uri for r in df.select("target_uri").collect())


def test_keys(spark):
    rows = spark.createDataFrame([(u,) for u in [*ODD, None]], "url string")
    got = {r.url: r.key for r in archive.with_archive_key(rows).collect()}
    assert got["https://a.example/x"] == got["http://a.example:80/x#f"] == got["http://u:p@a.example/x"] == "example,a)/x"
    assert got["http://a.example/x?"] == "example,a)/x?"
    assert got["http://bücher.example/x"] == "example,xn--bcher-kva)/x"
    assert got["http://10.0.0.1:8080/x"] == "10.0.0.1)/x" and got["http://[::1]/x"] == "[::1])/x"
    assert got["no url"] == "~no url" and got[""] == "~" and got[None] is None


def test_captures_of_few_urls(spark, place):
    found = archive.captures(spark, place, ["http://a.example/x", URLS[2], "http://nowhere.example/", "no url"])
    assert uris(found) == sorted([*ODD[:3], URLS[2], URLS[2], "no url"])
    bodies = {bytes(r.http).split(b"\r\n\r\n", 1)[1] for r in found.filter(F.col("target_uri") == URLS[2]).collect()}
    assert bodies == {f"body {i} of {URLS[2]}".encode() for i in (len(ODD) + 2, len(ODD) + len(URLS) + 2)}
    assert archive.captures(spark, place, []).count() == 0


def test_captures_below(spark, place):
    assert uris(archive.captures_below(spark, place, "a.example", "/x")) == sorted([*ODD[:5]])
    assert uris(archive.captures_below(spark, place, "A.example", "/x/")) == ["http://a.example/x/y"]
    assert uris(archive.captures_below(spark, place, "a.example", "/x", subdomains=True)) == sorted(ODD[:6])
    assert uris(archive.captures_below(spark, place, "10.0.0.1")) == sorted(ODD[8:10])
    some = archive.captures_below(spark, place, "www.site7.example", "/p/1")
    assert uris(some) == sorted(u for u in URLS if u.startswith("http://www.site7.example/p/1"))


def test_captures_of_a_table(spark, place):
    wanted = URLS[::7] + URLS[:3] + ["https://b.a.example/x", "http://not.example/"]
    table = spark.createDataFrame([(u,) for u in wanted * 2 + [None]], "url string")
    got = archive.captures_of(table, place)
    expected = [u for u in URLS + URLS[:5] if u in wanted] + ["http://b.a.example/x"]
    assert uris(got) == sorted(expected)
    assert got.filter("http IS NULL OR key IS NULL").count() == 0


def test_a_lookup_opens_only_matching_shards(spark, place):
    """All shards outside the wanted range of keys may be gone: nobody opens them."""
    path = fresh_path(spark, "lean")
    warc.write_sorted(archive.archive_records(fetches(spark, URLS)), path, shard_bytes=4000)
    prefix = "example,site7,www)"
    kept = 0
    for task in manifests.committed(path):
        files, root = manifests.place(path)
        part = manifests.Part([(task.manifest, 0, 1)], [])
        for _, name, entry in manifests.files_of(path, part):
            if entry.high < prefix or (entry.low > prefix and not entry.low.startswith(prefix)):
                os.remove(name)
                os.remove(name + warc.INDEX)
            else:
                kept += 1
    assert 0 < kept < 12 and len(glob.glob(f"{path}/*.warc.gz")) == kept
    assert len(uris(archive.captures_below(spark, path, "www.site7.example"))) == 40


def test_all_keys_come_back_in_a_full_scan(spark, place):
    rows = spark.read.format("warc").load(place)
    again = archive.with_archive_key(rows.drop("key"), "target_uri")
    assert rows.select("target_uri", "key").exceptAll(again.select("target_uri", "key")).count() == 0
    assert rows.count() == len(ODD) + len(URLS) + 5


def test_keys_that_nobody_wrote(spark):
    path = fresh_path(spark, "plain")
    warc.register(spark)
    archive.warc_records(fetches(spark, URLS[:3])).select("record").write.format("warc").mode("append").save(path)
    assert [r.key for r in spark.read.format("warc").load(path).collect()] == [None] * 3
    with pytest.raises(Exception, match="written without keys"):
        archive.captures(spark, path, URLS[:1]).collect()


def test_only_committed_files_count(spark, place):
    path = fresh_path(spark, "commits")
    records = archive.archive_records(fetches(spark, URLS[:50]))
    warc.write_sorted(records, path, shard_bytes=4000)
    before = len(glob.glob(f"{path}/*.warc.gz"))
    # a task that failed after its first shard, and one whose job never committed
    lost = f"{path}/archive_dead_00000_1_000.warc.gz"
    with open(lost, "wb") as f:
        f.write(b"\x1f\x8b broken")
    assert spark.read.format("warc").load(path).count() == 50
    warc.write_sorted(records.limit(7), path, mode="overwrite", shard_bytes=4000)
    assert spark.read.format("warc").load(path).count() == 7
    assert len(glob.glob(f"{path}/*.warc.gz")) > before  # overwritten shards are hidden, not yet gone
    gone = manifests.vacuum(spark, path, (warc.SUFFIX, warc.SUFFIX + warc.INDEX))
    assert gone >= 2 * before + 1 and not os.path.exists(lost)
    assert spark.read.format("warc").load(path).count() == 7
    empty = records.filter("false")
    warc.write_sorted(empty, path, mode="overwrite")
    assert spark.read.format("warc").load(path).count() == 0


def test_a_failed_job_leaves_no_commit(spark):
    path = fresh_path(spark, "failed")
    warc.register(spark)
    bad = spark.range(0, 40, 1, 4).selectExpr("CASE WHEN id = 39 THEN raise_error('stop') ELSE cast('x' AS binary) END AS record")
    with pytest.raises(Exception):
        bad.write.format("warc").mode("append").save(path)
    assert manifests.committed(path) == [] and spark.read.format("warc").load(path).count() == 0


def test_large_tasks_are_read_in_slices(tmp_path):
    files, root = manifests.place(str(tmp_path))
    done = [manifests.File(f"f{k}", 10, f"k{k}", f"k{k}") for k in range(7)]
    task = manifests.finish_task(files, root, "job", "0", done)
    manifests.commit(str(tmp_path), "job", [task, None, manifests.finish_task(files, root, "job", "1", [])], False)
    parts = manifests.plan(str(tmp_path), 20, ".gz")
    names = [entry.name for part in parts for _, _, entry in manifests.files_of(str(tmp_path), part)]
    assert len(parts) == 4 and sorted(names) == sorted(f.name for f in done)
    assert manifests.plan(str(tmp_path), 20, ".gz", lambda t: t.low > "k9") == [manifests.Part([], [])]


def test_packing_works_on_few_bytes_at_a_time():
    """Before, a batch of any size came out as one, with all its records held twice."""
    sizes = [3, None, 5_000_000, 5_000_000, 9_000_000, 0, 7]
    records = [None if n is None else bytes(n) for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{k}" for k in range(7)]), pa.array(records, pa.binary())], names=["key", "record"])
    got = list(warc.pack_batch(batch.slice(0, 7), 1))
    assert [b.num_rows for b in got] == [4, 1, 2] and all(b.schema.names == ["key", "member", "plain"] for b in got)
    rows = [row for b in got for row in b.to_pylist()]
    assert [(r["key"], r["plain"], gzip.decompress(r["member"])) for r in rows] == [
        (f"k{k}", n or 0, bytes(n or 0)) for k, n in enumerate(sizes)
    ]
    assert [b.num_rows for b in warc.pack_batch(batch.slice(2, 3), 1)] == [2, 1] and not list(warc.pack_batch(batch.slice(0, 0), 1))
