"""Operators 11 to 13, and what was mended in 4, 6 and 10, against plain versions and literal rows."""

from __future__ import annotations

import collections
import glob
import gzip
import hashlib
import math
import random
import re
import zlib

import pytest
import sentencepiece
from compare import compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlframe.llm import align, catalog, htmlmain, jaccard, mixing, resample, warcsource
from crawlframe.session import fresh_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_warc_source"])
def test_query_equals_its_sql(spark, name):
    got = compare(spark, name, catalog.QUERIES[name], catalog.ORACLE[name], SF)
    assert got["columns"] and not got["missing"] and not got["extra"] and got["rows"] > 0, got


# Operator 11


def plain_alignment(rows):
    """Tokens, groups and links text by text, and the counts over all of them."""
    left = Tokenizer.from_file(f"{align.FOLDER}/{align.LEFT}")
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.RIGHT}")
    letters = align.byte_letters()
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        whole = (" " + text).encode() if text else b""
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in left.id_to_token(t)) for t in a]
        b_bytes = [
            bytes([int(right.id_to_piece(t)[3:5], 16)]) if right.is_byte(t) else right.id_to_piece(t).replace("▁", " ").encode() for t in b
        ]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = []
        for pieces in (a_bytes, b_bytes):
            at, stops = 0, []
            for piece in pieces:
                at += len(piece)
                stops.append(at)
            ends.append(stops)
        links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in ends[0] if e in set(ends[1])]
        groups, last = [], 0
        for e in ends[0]:
            if e in set(ends[1]):
                part = ["," .join(str(t) for t, stop in zip(ids, stops) if last < stop <= e) for ids, stops in ((a, ends[0]), (b, ends[1]))]
                groups.append("|".join(part))
                last = e
        counts.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (
            doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, n_a, n_b, groups, links in found
    ]


def odd_texts() -> list[str | None]:
    rng = random.Random(7)
    parts = ["hello", "Straße", "日本語", "\n", "  ", " \t", "x1,y", "<|endoftext|>", "</s>", "<0x41>", "🎉", "’s", "l'été", "　", "\x1c", "a\x00b"]
    texts: list[str | None] = [None, "", " ", "  two  spaces ", "a▁b", "﻿x", "é", "</s>[INST] <unk>"]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    return texts + texts[10:20]


def test_alignment_equals_the_plain_version(spark):
    rows = [(k % 50 if k % 9 else None, t) for k, t in enumerate(odd_texts())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_a int, chunk string").repartition(3)
    got = align.alignment(df, chunk_bytes=300, call_bytes=50)
    assert got.columns == [c.split()[0] for c in align.RESULT.split(", ")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_alignment(rows), key=repr)
    assert align.alignment(df.filter("false")).count() == 0


def test_long_texts_are_cut_at_seams_alone(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice(["wort", "été", "x\ny", "a  b", "日本", "1.5"]) + str(rng.randrange(99)) for _ in range(20_000)) + " "
    pieces = align.segments(text, 1000)
    assert len(pieces) > 50 and " ".join(pieces) == text
    solid = "x" * 5000
    assert align.segments(solid, 100) == [solid]
    rows = [(1, text), (2, solid)]
    got = align.alignment(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk_bytes=2000, call_bytes=500).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b) for r in got) == [r[:3] for r in plain_tokens(rows)]


def plain_tokens(rows):
    left = Tokenizer.from_file(f"{align.FOLDER}/{align.LEFT}")
    right = sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.RIGHT}")
    return [(k, len(left.encode(" " + t, add_special_tokens=False).ids), len(right.encode(t))) for k, t in rows]


# Operator 12


def plain_resampling(docs, target, runs=1, buckets=10_000):
    def features(text):
        ws = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        found = [" ".join(ws[k : k + n]) for n in range(1, runs + 1) for k in range(len(ws) - n + 1)]
        return len(ws), [zlib.crc32(f.encode()) % buckets for f in found]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = [
        math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)
    ]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fit[: 10 * len(fit) // 100], 1):
        row[5] = rank
    return [(r[0], r[1], r[2], r[3], r[5]) for r in rows]


def resampling_rows():
    rng = random.Random(9)
    words = ["alpha", "Beta", "gämma", "d9", "ÉTÉ", "x_y", "日本", "\x7f", "z"]
    texts = [None, "", " - ", "one"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 80))) for _ in range(300)]
    rows = [(k * 7 % 311, t) for k, t in enumerate(texts)]
    return rows + rows[50:60] * 3 + [(None, texts[60]), (None, texts[61])], ["alpha d9 d9", "日本 z", None, ""]


@pytest.mark.parametrize("runs,buckets", [(1, 10_000), (3, 97)])
def test_resampling_equals_the_plain_version(spark, runs, buckets):
    docs, target = resampling_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, score int, _row int").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.report(df, bench, longest_run=runs, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resampling(docs, target, runs, buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    taken = resample.resampled(df, bench, longest_run=runs, buckets=buckets)
    assert taken.columns == df.columns
    assert sorted(r.doc_id for r in taken.collect()) == sorted(w[0] for w in want if w[4])


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resample.report(none, none).count() == 0 and resample.resampled(none, none).count() == 0
    one = spark.createDataFrame([(1, "w " * 30)], "doc_id bigint, text string")
    assert [r.rank for r in resample.report(one, none).collect()] == [None]  # a tenth of one document is none


def test_quickselect(spark):
    rng = random.Random(10)
    rows = [(rng.randrange(20), rng.choice("abc")) for _ in range(500)] + [(7, "b")] * 300
    df = spark.createDataFrame(rows, "x int, y string").repartition(5)
    ordered = sorted(rows)
    for k in (1, 2, 250, 400, 799, 800):
        key, below = resample.kth_key(df, ["x", "y"], k, pivots=4)
        assert key == ordered[k - 1] and below == sum(r < key for r in rows)
    with pytest.raises(ValueError):
        resample.kth_key(df, ["x", "y"], 801)


# Operator 13


def test_archive_rows(spark):
    big = "ü" * 300_000
    rows = [
        (1, "http://a/", "<p>x"), (2, "http://b/\r\nWARC-Type: revisit", "<p>x"), (3, "u", None), (4, None, ""), (5, "é", big),
        (None, "n", big), (5, "again", big), (None, "m", "alone"), (None, "m", "alone"), (6, "crlf", "\r\n\r\nWARC/1.1\r\n"),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    path = fresh_path(spark, "records")
    got = sorted(map(tuple, warcsource.archived(pages, path).collect()), key=repr)
    import base64

    def row(page, html, kind, to):
        raw = (html or "").encode()
        return (page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, to)

    want = [
        row(1, "<p>x", "response", None), row(2, "<p>x", "revisit", 1), row(3, "", "response", None), row(4, "", "revisit", 3),
        row(5, big, "response", None), row(None, big, "revisit", 5), row(5, big, "response", None),
        row(None, "alone", "response", None), row(None, "alone", "response", None), row(6, "\r\n\r\nWARC/1.1\r\n", "response", None),
    ]
    assert got == sorted(want, key=repr)
    assert warcsource.archived(pages.filter("false")).count() == 0
    small = sorted(r.record_type for r in warcsource.archived(pages, least_bytes=5).collect())
    assert small.count("revisit") == 1  # payloads of four bytes and none are all kept
    # any gzip reader finds the payloads, and revisits hold none
    plain = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/response-*.warc.gz"))
    assert plain.count(big.encode()) == 2 and plain.count(b"<p>x") == 1


def test_pushed_predicates_and_skipped_payloads(spark):
    pages = spark.createDataFrame([(k, f"http://s{k % 3}/{k}", "x" * 50_000 if k % 2 else f"own {k}") for k in range(60)], "page_id bigint, url string, html string")
    path = fresh_path(spark, "records")
    assert warcsource.archived(pages, path).count() == 60
    read = spark.read.format(warcsource.NAME).load(path)
    some = read.filter("target_uri LIKE 'http://s1/%' AND record_type = 'response' AND record_id IN ('urn:page:4', 'urn:page:7', 'urn:page:1')")
    assert sorted(r.record_id for r in some.collect()) == ["urn:page:1", "urn:page:4"]
    assert read.filter("refers_to IS NULL").count() == 31 and read.filter("refers_to = 'urn:page:1'").count() == 29
    assert read.filter("content_length > 40000").count() == 1  # left to Spark
    heads = spark.read.format(warcsource.NAME).option("payload", "false").load(path)
    assert heads.filter("payload IS NOT NULL").count() == 0 and heads.filter("payload_length = 50000").count() == 30


def test_a_step_over_does_not_inflate(tmp_path):
    """A damaged body does no harm to a reader that steps over it."""
    rows = [
        {"record_type": "response", "record_id": f"urn:page:{k}", "target_uri": "u", "warc_date": None, "payload_digest": None,
         "payload_length": None, "refers_to": None, "payload": random.Random(k).randbytes(300_000)}
        for k in range(3)
    ]
    members = [bytearray(warcsource.member(warcsource.record_bytes(r), 6)) for r in rows]
    members[1][150_000:290_000] = bytes(140_000)
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    reader = warcsource.RecordReader({"path": str(tmp_path), "payload": "false"})
    with open(tmp_path / "x.warc.gz", "rb") as f:
        assert [r["record_id"] for r in reader.records(warcsource.Stream(f))] == ["urn:page:0", "urn:page:1", "urn:page:2"]
    whole = warcsource.RecordReader({"path": str(tmp_path)})
    with open(tmp_path / "x.warc.gz", "rb") as f, pytest.raises(zlib.error):
        list(whole.records(warcsource.Stream(f)))


@pytest.mark.parametrize("form", ["plain.warc", "one.warc.gz", "many.warc.gz"])
def test_archives_of_other_programs(spark, tmp_path, form):
    records = [
        b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: http://x/%d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, k, len(body), body)
        for k, (kind, body) in enumerate([(b"warcinfo", b"a: b\r\n"), (b"response", b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * 200_000), (b"resource", b"z" * 70_000)])
    ]
    data = b"".join(records) if form != "many.warc.gz" else b"".join(map(gzip.compress, records))
    (tmp_path / form).write_bytes(gzip.compress(data) if form == "one.warc.gz" else data)
    warcsource.register(spark)
    rows = spark.read.format(warcsource.NAME).load(str(tmp_path)).orderBy("target_uri").collect()
    assert [(r.record_type, len(r.payload)) for r in rows] == [("warcinfo", 6), ("response", 200_000), ("resource", 70_000)]
    last = spark.read.format(warcsource.NAME).load(str(tmp_path)).filter("record_type = 'resource'").collect()
    assert [bytes(r.payload) for r in last] == [b"z" * 70_000]


# Mended operators

BODY = "<p>" + "Plain words stand here, many of them, and they go on. " * 12 + "</p>"
WANT = ("Plain words stand here, many of them, and they go on. " * 12).strip()
PAGES = {
    "bad section": f"<html><body><![foo[x]]><article>{BODY}</article></body></html>",
    "blank section": f"<html><body><![ x ]><article>{BODY}</article></body></html>",
    "odd declaration": f"<!><!x <html><body><?php x ?><article>{BODY}</article></body></html>",
    "no end of head": f"<html><head><title>t</title><body><article>{BODY}</article></body></html>",
    "no body either": f"<title>t</title><meta charset=utf-8><article>{BODY}</article>",
    "short comments": f"<html><body><!--><!---><!-- a --!><article>{BODY}</article></body></html>",
    "open comment": f"<html><body><article>{BODY}</article><!-- x <p>hidden",
    "bare paragraphs": f"<html><body>{BODY}</body></html>",
    "table": f"<html><body><table><tr><td>{BODY}</td></tr></table></body></html>",
}


def test_broken_pages_keep_their_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = htmlmain.train(pages)
    rows = spark.createDataFrame([(k, n, h) for k, (n, h) in enumerate(PAGES.items())], "page_id bigint, url string, html string")
    got = {r.url: r.text for r in htmlmain.main_text(rows, model=model).collect()}
    assert got == dict.fromkeys(PAGES, WANT)
    for odd in ("<![", "<!", "<!-", "<!--", "<?", "</", "<", "<a", "<![CDATA[x", "\x00", "<head>", "<p" * 2000):
        assert isinstance(htmlmain.extract([odd], model)[0], str)


def test_rows_with_clashing_names_stay_as_they_are(spark):
    text = " ".join(f"w{k}" for k in range(60))
    names = ["_size", "_copy", "_text_key", "none", "print", "_c_id", "copies", "row"]
    rows = [(k, t, "s", *range(k, k + len(names))) for k, t in enumerate([text, text, text + " more", "other words entirely"])]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, source string, {', '.join(f'{n} bigint' for n in names)}")
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows)
    again = docs.union(docs.filter("doc_id = 0")).union(docs.withColumn("doc_id", F.lit(None).cast("bigint")).filter("doc_id IS NULL"))
    assert sorted(r.doc_id is None for r in jaccard.keep_one_of_each(again).collect()) == [False, False]
