"""Importance resampling towards a target text collection, and a distributed quickselect.

Words and runs of words are hashed into a fixed number of buckets. A bucket's
gain is the log ratio of its smoothed share in the target and in the documents;
a document's weight is the floored mean gain of its features. The gains are one
array of as many numbers as there are buckets, so a document is scored by array
look-ups where it is read. Gumbel noise from the document's id turns the draw
without replacement into a choice of the highest scores.

The lowest score that is still drawn is found by quickselect: random pivot keys
of the live range are drawn, every row is counted below, at or above them, and
the live range shrinks to the part that holds the wanted place. Only pivots and
counts reach the driver. The winners alone are sorted, range by range, and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.operators.skew import with_dense_ids
from crawlframe.session import written

BUCKETS = 10_000
LONGEST_RUN = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
PIVOTS = 15

# Words are runs of ASCII digits and letters and of all characters beyond ASCII,
# whose UTF-8 bytes are all above 127. Every other byte becomes a blank.
WORD_BYTES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()

Key = tuple


def words(raw: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8 after A to Z became a to z; none for NULL."""
    return raw.translate(WORD_BYTES).split() if raw else []


def runs(found: list[bytes], longest_run: int) -> Iterable[bytes]:
    """All runs of 1 to ``longest_run`` consecutive words, joined by one space, repeats kept."""
    yield from found
    for n in range(2, longest_run + 1):
        for at in range(len(found) - n + 1):
            yield b" ".join(found[at : at + n])


def run_count(n_words: int, longest_run: int) -> int:
    return sum(max(0, n_words - n + 1) for n in range(1, longest_run + 1))


def bucket_of(found: list[bytes], longest_run: int, buckets: int) -> np.ndarray:
    """The bucket of every feature: its CRC-32 modulo the number of buckets."""
    hashes = map(crc32, found if longest_run == 1 else runs(found, longest_run))
    return np.fromiter(hashes, np.uint32, run_count(len(found), longest_run)) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, longest_run: int, buckets: int) -> list[int]:
    """How often each bucket occurs among the texts.

    A task counts in one array; at most ``buckets`` rows leave it, and as many
    reach the driver, however large the table is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()):
                total += np.bincount(bucket_of(words(raw.as_py()), longest_run, buckets), minlength=buckets)
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["b", "n"])

    counts = [0] * buckets
    for b, n in texts.select("text").mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n")).collect():
        counts[b] = n
    return counts


def gains(of_docs: list[int], of_target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    size, docs, target = len(of_docs), float(sum(of_docs)), float(sum(of_target))
    return [
        math.floor(1000 * math.log((t + 1.0) * (docs + size) / ((s + 1.0) * (target + size))))
        for s, t in zip(of_docs, of_target)
    ]


def noise(key: str, seed: int) -> str:
    """Thousandths of a standard Gumbel draw, rounded down, fixed by seed and key."""
    h = f"cast(conv(substr(sha2(concat('{seed}:', coalesce(cast({key} AS string), '')), 256), 1, 8), 16, 10) AS double)"
    return f"floor(-1000 * ln(-ln(({h} + 0.5) / 4294967296)))"


def scored(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    keep: list[str] | None = None,
    longest_run: int = LONGEST_RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(``keep``, n_words, n_features, weight, score) of every row of ``docs``.

    Both tables have a column ``text``. A NULL or empty text, or one without
    words, has no features and weight 0; a NULL key draws its noise as an empty
    one; repeated rows score alike. Texts are read whole, of any length, once
    for the counts and once for the scores, and never shuffled. Empty tables
    count as nothing seen. ``keep`` is the key alone unless given; other columns
    play no part, whatever their names.
    """
    array = gains(
        bucket_counts(docs.select("text"), longest_run, buckets),
        bucket_counts(target.select("text"), longest_run, buckets),
    )

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weighed(texts: pa.Array) -> pa.Array:
        table = np.array(array, np.int64)
        rows = []
        for raw in texts.cast(pa.binary()):
            found = words(raw.as_py())
            each = bucket_of(found, longest_run, buckets)
            rows.append((len(found), len(each), int(table[each].sum()) // max(1, len(each))))
        columns = zip(*rows) if rows else [()] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n_words", "n_features", "weight"])

    # The row travels in one struct, so that no column of it can clash with those added here.
    row = F.struct(*[F.col(f"`{c}`") for c in keep or [key]]).alias("_row")
    return (
        docs.select(row, F.expr(noise(f"`{key}`", seed)).alias("_noise"), weighed(F.col("text")).alias("_w"))
        .selectExpr("_row", "_w.n_words", "_w.n_features", "_w.weight", "_w.weight + _noise AS score")
    )


def _sql(value: object) -> str:
    return repr(value) if isinstance(value, int) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _beyond(columns: list[str], pivot: Key) -> str:
    """Whether a row's key is larger than ``pivot``, first column first."""
    later = "false"
    for name, value in reversed(list(zip(columns, map(_sql, pivot)))):
        later = f"({name} > {value} OR ({name} = {value} AND {later}))"
    return later


def _same(columns: list[str], pivot: Key) -> str:
    return "(" + " AND ".join(f"{c} = {_sql(v)}" for c, v in zip(columns, pivot)) + ")"


def kth_key(rows: DataFrame, columns: list[str], k: int, pivots: int = PIVOTS) -> tuple[Key, int]:
    """The ``k``-th smallest key (from 1) and how many rows have a smaller one.

    Keys are integers or strings and hold no NULL. Every round counts the live
    rows below, at and above each pivot exactly and draws the next pivots in each
    part: of every class of hashes the key of least hash. The live range shrinks by about the
    number of pivots and always loses them, so the search ends, also when all
    keys are equal. A round is one pass; about twice the square of ``pivots``
    rows reach the driver, whatever the table's size. Pass a written table.
    """
    below, live, chosen, turn = 0, rows.select(*columns), [], 0
    while True:
        turn += 1
        place = " + ".join(f"cast({_beyond(columns, p)} AS int)" for p in chosen) or "0"
        same = " OR ".join(_same(columns, p) for p in chosen) or "false"
        names = ", ".join(columns)
        found = (
            live.selectExpr(*columns, f"{place} AS place", f"{same} AS same", f"pmod(xxhash64({names}, {turn}), {pivots}) AS dealt")
            .groupBy("place", "same", "dealt")
            .agg(F.count(F.lit(1)).alias("n"), F.expr(f"min_by(struct({names}), xxhash64({names}, -{turn}))").alias("pivot"))
            .collect()
        )
        parts: dict[tuple[int, bool], tuple[int, set[Key]]] = {}
        for r in found:
            n, drawn_here = parts.get((r.place, r.same), (0, set()))
            parts[r.place, r.same] = n + r.n, drawn_here | {tuple(r.pivot)}
        for at in range(len(chosen) + 1):
            between, inside = parts.get((at, False), (0, set()))
            if below + between >= k:
                if at > 0:
                    live = live.filter(_beyond(columns, chosen[at - 1]))
                if at < len(chosen):
                    live = live.filter(f"NOT {_beyond(columns, chosen[at])} AND NOT {_same(columns, chosen[at])}")
                chosen = sorted(inside)
                break
            below += between
            if at < len(chosen):
                equal, _ = parts.get((at, True), (0, set()))
                if below + equal >= k:
                    return chosen[at], below
                below += equal
        else:
            raise ValueError(f"there is no place {k}: only {below} rows")


def _ordered(scores: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """The rows with their sort key: highest score first, then smallest id, NULL ids last."""
    id_type = dict(scores.select(f"_row.`{key}`").dtypes)[key]
    blank = "''" if id_type == "string" else "0"
    columns = {
        "_down": "-score",
        "_none": f"cast(_row.`{key}` IS NULL AS int)",
        "_id": f"coalesce(_row.`{key}`, cast({blank} AS {id_type}))",
    }
    return scores.selectExpr("*", *[f"{value} AS {name}" for name, value in columns.items()]), list(columns)


def places(total: int, percent: int) -> int:
    return percent * total // 100


def drawn(scores: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``scores`` (from :func:`scored`) with ``rank``, 1 for the first drawn, NULL for the rest.

    Of the n rows with at least ``least_words`` words, ``percent * n // 100`` are
    drawn: the highest scores, ties to the smaller id. Exactly as many are drawn
    also where repeated rows tie at the last place.
    """
    rows, columns = _ordered(written(scores, "scores"), key)
    fit = f"n_words >= {int(least_words)}"
    k = places(rows.filter(fit).count(), percent)
    plain = [c for c in rows.columns if c not in columns]
    if k == 0:
        return rows.select(*plain, F.lit(None).cast("bigint").alias("rank"))
    last, _ = kth_key(rows.filter(fit), columns, k)
    out = f"NOT {fit} OR {_beyond(columns, last)}"
    ranked = with_dense_ids(rows.filter(f"NOT ({out})"), columns, "_place", 1)
    won = ranked.select(*plain, F.when(F.col("_place") <= k, F.col("_place")).cast("bigint").alias("rank"))
    return won.unionByName(rows.filter(out).select(*plain, F.lit(None).cast("bigint").alias("rank")))


def report(docs: DataFrame, target: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document."""
    return drawn(scored(docs, target, key, **settings), key).select(f"_row.`{key}`", "n_features", "weight", "score", "rank")


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, **settings
) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, as they are.

    No text is written or shuffled: only keys and scores are stored to find the
    last place; then the documents are scored again where they are read.
    """
    full = scored(docs, target, key, keep=docs.columns, **settings)
    narrow, columns = _ordered(full.select(F.struct(f"_row.`{key}`").alias("_row"), "n_words", "score"), key)
    narrow = written(narrow.select("n_words", *columns), "scores").filter(F.col("n_words") >= least_words)
    k = places(narrow.count(), percent)
    if k == 0:
        return docs.limit(0)
    last, before = kth_key(narrow, columns, k)
    tie = _same(columns, last)
    rows, _ = _ordered(full.filter(F.col("n_words") >= least_words), key)
    ahead = f"NOT {_beyond(columns, last)}"
    if narrow.filter(tie).count() == k - before:
        return rows.filter(ahead).select("_row.*")
    first = rows.filter(tie).limit(k - before)
    return rows.filter(f"{ahead} AND NOT {tie}").unionByName(first).select("_row.*")
