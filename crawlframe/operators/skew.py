"""Joins and ids that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.session import written


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Keys that own at least 1/``parts`` of all rows, with the pieces to split them into.

    At most ``parts`` keys can reach that share and their pieces sum to at most
    twice ``parts``, so the result has a proven bound and may be broadcast. The
    counting aggregates before it shuffles.
    """
    parts = parts or shuffle_width(df)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    share = F.col("_n") * F.lit(parts) / total
    return counts.filter(F.col(key).isNotNull() & (share >= 1)).select(
        key, F.ceil(share).cast("int").alias("_pieces")
    )


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate puts ``df`` below its broadcast threshold."""
    spark = df.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()
    unit = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40, "p": 2**50}.get(limit.rstrip("b")[-1:], 1)
    allowed = int(limit.rstrip("bkmgtp")) * unit
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= allowed


def split_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str],
    how: str = "left",
    parts: int | None = None,
    store: bool = False,
) -> DataFrame:
    """Equi-join of many rows to one row per key, safe when a key is hot on the left.

    A small ``right`` needs no shuffle, so Spark joins it as it likes. Otherwise
    rows of hot keys are dealt over several pieces by a hash of the ``spread``
    columns, and only their single right-hand rows are repeated per piece. The
    left side is read twice then; ``store`` writes it first where computing it
    costs more than a copy.
    """
    if fits_broadcast(right):
        return left.join(right, key, how)
    if store:
        left = written(left, "left")
    hot = F.broadcast(written(hot_keys(left, key, parts), "hot"))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    dealt = (
        left.join(hot, key, "left")
        .withColumn("_piece", F.pmod(F.xxhash64(*spread), pieces).cast("int"))
        .drop("_pieces")
    )
    repeated = (
        right.join(hot, key, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_pieces")
    )
    return dealt.join(repeated, [key, "_piece"], how).drop("_piece")


ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_dense_ids(df: DataFrame, order: Sequence[str], column: str, first: int) -> DataFrame:
    """Number the rows ``first``, ``first + 1``, … by ``order`` without a global sort in one task.

    Rows are range-partitioned and sorted, written once with their place inside
    the partition, and shifted by the row counts of the partitions before. Only
    those counts, one number per partition, pass through the driver.
    """
    placed = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ids",
    ).withColumn("_part", F.shiftright("_at", ROW_BITS).cast("int"))
    counts = dict(placed.groupBy("_part").count().collect())
    shifts = list(accumulate((counts.get(p, 0) for p in range(max(counts, default=0))), initial=first))
    place = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    shift = F.lit(shifts).cast("array<bigint>")[F.col("_part")]
    return placed.withColumn(column, shift + place).drop("_at", "_part")
