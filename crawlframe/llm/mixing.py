"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies of each of its
documents, a fraction. Rounding every document on its own would miss the target
by much; pivotal rounding pairs two fractions and moves mass from one to the
other, at random but fair to both, until one is a whole number. Words are what
is moved, so a source's words stay what they were and in the end one document
per source is left to round. Pieces of a source are rounded side by side, and
what is left of each is combined level by level.
"""

from __future__ import annotations


import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import WORD
from crawlframe.operators.skew import with_dense_ids
from crawlframe.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2.0  # copies of a document
PIECE = 2_000  # documents rounded in one task
FAN_IN = 256  # residuals combined in one task
SLACK = 1e-9


def words_in(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size), null sources included.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all words. A target stops at ``most`` times its source's size;
    the excess is shared again by weight among the others until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Spark orders strings by their UTF-8 bytes, which is the order of code points.
    ranked = with_dense_ids(
        totals.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "rank", 0
    ).drop("_none")
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", turn).withColumn("cap", most * F.col("source_size")), "sources")
    wanted = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped_before = 0.0, -1
    while True:
        # Sources at their cap for this level; a higher level only adds some.
        at_cap = F.col("weight") * level > F.col("cap")
        capped, fixed, open_weight = ranked.agg(
            F.count_if(at_cap), F.sum(F.when(at_cap, F.col("cap"))), F.sum(F.when(~at_cap, F.col("weight")))
        ).first()
        if capped == capped_before or not open_weight:
            break
        capped_before, level = capped, (wanted - (fixed or 0.0)) / open_weight
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _uniform(*parts: int) -> float:
    """A number from 0 to 1 that depends on its arguments alone."""
    return (xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode()) >> 11) / (1 << 53)


def pivot(units: list[tuple[int, float]], seeds: list[int]) -> list[float]:
    """Round (mass of a whole copy, fraction) units pairwise; all but one end at 0 or 1.

    For two units, either the first gives all it can to the second or takes all
    it can from it, with the odds that leave both expectations as they were. The
    sum of mass times fraction never changes.
    """
    out = [fraction for _, fraction in units]
    held = None
    for k, (mass, fraction) in enumerate(units):
        if not SLACK < fraction < 1 - SLACK:
            out[k] = float(round(fraction))
            continue
        if held is None:
            held = k
            continue
        m, x, y = units[held][0], out[held], fraction
        up = min((1 - x) * m, y * mass)  # mass that may move to the held unit
        down = min(x * m, (1 - y) * mass)  # or away from it
        move = up if _uniform(seeds[held], seeds[k]) * (up + down) < down else -down
        x, y = x + move / m, y - move / mass
        out[held] = 0.0 if x <= SLACK else 1.0 if x >= 1 - SLACK else x
        out[k] = 0.0 if y <= SLACK else 1.0 if y >= 1 - SLACK else y
        if out[held] in (0.0, 1.0):
            held = k if out[k] not in (0.0, 1.0) else None
    return out


UNITS = "rank bigint, key bigint, id bigint, source string, size bigint, mass bigint, whole bigint, fraction double, part bigint"


def _round_groups(units: DataFrame) -> DataFrame:
    """One pass of rounding inside each (source, part)."""

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "id", "size"], kind="stable", na_position="last")
        pairs = list(zip(group["mass"].tolist(), group["fraction"].tolist()))
        return group.assign(fraction=pivot(pairs, group["key"].tolist()))

    return units.groupBy("rank", "part").applyInPandas(rounded, UNITS)


def copies_of(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies), one row for each distinct (id, source, size).

    ``copies`` is how often the mix takes each row of that id, source and size;
    repeated rows have the same. Documents without words are not taken. Random
    choices depend on ids and sizes only, so runs agree, and a lost task makes
    the same choices again.
    """
    units = written(
        docs.select(
            F.col(key).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), words_in(F.col(text)).alias("size")
        )
        .groupBy("id", "source", "size")
        .agg(F.count(F.lit(1)).alias("rows")),
        "units",
    )
    targets = source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")))
    counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("units"))
    known = written(
        targets.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key_hash = F.xxhash64("id", "source", "size")
    start = (
        units.join(known.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .filter("size > 0")
        .select(
            F.xxhash64("source").alias("rank"),
            key_hash.alias("key"),
            "id",
            "source",
            "size",
            (F.col("size") * F.col("rows")).alias("mass"),
            F.floor(rate + SLACK).cast("bigint").alias("whole"),
            F.greatest(rate - F.floor(rate + SLACK), F.lit(0.0)).alias("fraction"),
            F.pmod(F.xxhash64(key_hash), F.ceil(F.col("units") / PIECE)).alias("part"),
        )
    )
    done, open_ = None, start
    while True:
        level = written(_round_groups(open_), "rounded")
        settled = level.filter("fraction in (0, 1)")
        rest = level.filter("fraction not in (0, 1)")
        done = settled if done is None else done.union(settled)
        # One residual at most is left of each part; parts of a source meet on the next level.
        parts, sources = rest.agg(F.count(F.lit(1)), F.count_distinct("rank")).first()
        if parts == sources:
            last = F.when(_draw(F.col("key")) < F.col("fraction"), 1.0).otherwise(0.0)
            done = done.union(rest.withColumn("fraction", last))
            break
        open_ = rest.withColumn("part", F.floor(F.col("part") / FAN_IN))
    copies = done.select("id", "source", "size", (F.col("whole") + F.col("fraction")).cast("bigint").alias("copies"))
    copies = copies.union(units.filter("size = 0").select("id", "source", "size", F.lit(0).cast("bigint")))
    named = known.select(F.col("source").alias("_s"), "source_size", "target")
    return copies.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _draw(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("last")), 11) / F.lit(float(1 << 53))


def _with_copies(docs: DataFrame, copies: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(row, size, source_size, target, copies): each row in one struct, so that none of its columns can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, docs[key].cast("bigint").alias("_id"), docs[source].cast("string").alias("_source"), words_in(docs[text]).alias("_size"))
    same = (
        keyed["_id"].eqNullSafe(copies["id"]) & keyed["_source"].eqNullSafe(copies["source"]) & (keyed["_size"] == copies["size"])
    )
    return keyed.join(copies, same).select("row", "size", "source_size", "target", "copies")


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target and the words the mix takes."""
    copies = written(copies_of(docs, key, text, source), "copies")
    narrow = docs.select(key, source, text)
    return _with_copies(narrow, copies, key, text, source).select(
        F.col(f"row.`{key}`").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    copies = written(copies_of(docs, key, text, source), "copies")
    taken = _with_copies(docs, copies.filter("copies > 0"), key, text, source)
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")
