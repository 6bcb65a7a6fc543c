"""What the workers of the pipeline hold at a time, beside the heap of their executor."""

from __future__ import annotations

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from crawlframe.llm import jaccard, maglev


class Sent(Exception):
    """The function that a job sends to its workers."""


class Docs:
    """Stands for a table; gives away what it is mapped with."""

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        raise Sent(function)


def sent(job, *args):
    try:
        job(Docs(), *args)
    except Sent as found:
        return found.args[0]


def peak_mb(function, batch: pa.RecordBatch) -> float:
    tracemalloc.start()
    try:
        for _ in function(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts(rows: int, words: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(f"{rng.randrange(10**9)}" for _ in range(words)) for _ in range(rows)]


def test_repeated_tokens_are_looked_for_in_one_array():
    """1.2 million words, most of them different: before, 400,000 stayed in a cache and the sets were copied three times."""
    batch = pa.RecordBatch.from_pydict({"text": texts(1_200, 1_000)})
    assert peak_mb(sent(jaccard.frequent_tokens, "text"), batch) < 48 + 25  # the array, whose pages are not all touched


def test_prefixes_do_not_hold_their_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "frequent_tokens", lambda *_: (np.empty(0, np.int64),) * 2)
    rows = 1_500
    batch = pa.RecordBatch.from_pydict({"id": list(range(rows)), "text_key": [0] * rows, "text": texts(rows, 1_000)})
    whole = rows * 1_000 * 8 / 1e6
    cache = 50_000 * 250 / 1e6
    assert peak_mb(sent(jaccard.document_sets, "id", "text"), batch) < whole + cache


def test_repeated_tokens_equal_a_count(monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_TOKENS", 7)
    rng = random.Random(5)
    for size in (0, 1, 2, 3, 50, 400):
        tokens = [rng.randrange(-60, 60) for _ in range(size)]
        want = {t: n for t, n in collections.Counter(tokens).items() if n > 1}
        batches = list(jaccard.repeated_tokens(np.array(tokens, np.int64)))
        assert all(b.num_rows <= 7 for b in batches)
        assert [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))] == sorted(want.items())


def test_every_set_is_counted_whatever_the_array_holds(monkeypatch):
    """Sets longer than the array, and arrays that fill within a batch: each group of sets is counted as before."""
    monkeypatch.setattr(jaccard, "HELD_TOKENS", 40)
    monkeypatch.setattr(jaccard, "SENT_TOKENS", 8)
    rng = random.Random(8)
    rows = [" ".join(f"w{rng.randrange(4)}" for _ in range(rng.choice([0, 3, 9, 30, 200]))) for _ in range(300)]
    hashes = jaccard.WordHashes()
    want, held, seen = collections.Counter(), [], set()

    def flush():
        want.update({t: n for t, n in collections.Counter(held).items() if n > 1})
        held.clear(), seen.clear()

    for one in rows:
        tokens = jaccard.shingles(one.encode().split(), hashes)
        if tokens.tobytes() not in seen:
            seen.add(tokens.tobytes())
            held.extend(tokens.tolist())
            if len(held) > 40:
                flush()
    flush()
    got = collections.Counter()
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(rows[at : at + 70], pa.string())}) for at in range(0, 300, 70)]
    for found in sent(jaccard.frequent_tokens, "text")(iter(batches)):
        for token, n in zip(*(c.to_pylist() for c in found.columns)):
            got[token] += n
    assert got == want


def test_the_lookup_table_starts_no_python(spark):
    names = ["a", 'quote " and \\', "é 😀", "", " blank\n"]
    table = maglev.lookup_table(spark, names, 11)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan
    assert {r.shard for r in table.collect()} == set(names)
    assert table.schema.simpleString() == "struct<slot:bigint,shard:string>"
