"""Sharding by a permutation-filled lookup table, in DataFrame and SQL functions only.

Every shard has its own preference order of the table's slots: a start and a
stride, which visit all slots because the table size is prime. The shards take
turns; at its turn a shard claims the next slot of its order that is still
free, until the table is full. Shards own equally many slots up to one, and
when a shard goes, few keys of the others move. A row's shard is one look-up of
its key's slot in the broadcast table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS_PER_SHARD = 100
AHEAD = 64  # preferences looked at in one step while most slots are free


def prime_from(n: int) -> int:
    """The smallest prime that is not below ``n``."""
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(shards: int, slots: int | None = None) -> int:
    """The prime number of slots for so many shards."""
    return prime_from(max(slots or SLOTS_PER_SHARD * shards, shards, 3))


def hashed(value: Column, salt: str) -> Column:
    """A non-negative 32-bit number from the MD5 digest, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), value)), 1, 8), 16, 10).cast("bigint")


def lookup_table(spark: SparkSession, shards: list[str], slots: int | None = None) -> DataFrame:
    """(slot, shard): the filled table, one row per slot.

    ``slots`` is raised to a prime; by default it is at least a hundred per
    shard, which keeps the shards' shares within one per cent. The fill is one
    fold over the turns. Its state is the table as two bytes per slot and each
    shard's place in its order.
    """
    if not shards or len(shards) != len(set(shards)) or len(shards) > 65_000:
        raise ValueError("name 1 to 65,000 distinct shards")
    size = table_size(len(shards), slots)
    count = len(shards)
    # One literal: rows made in Python would start workers on the executors to turn them.
    listed = F.from_json(F.lit(json.dumps(shards)), "array<string>")
    named = spark.range(0, 1, 1, 1).select(F.posexplode(listed).alias("at", "name"))
    orders = named.select(
        "at",
        (hashed(F.col("name"), "start:") % size).alias("start"),
        (hashed(F.col("name"), "step:") % (size - 1) + 1).alias("step"),
    ).agg(
        F.expr("transform(sort_array(collect_list(struct(at, start))), x -> x.start)").alias("starts"),
        F.expr("transform(sort_array(collect_list(struct(at, step))), x -> x.step)").alias("steps"),
    )
    free = f"j -> substring(s.owners, cast(2 * ((starts[t % {count}] + j * steps[t % {count}]) % {size}) + 1 as int), 2) = X'FFFF'"
    place = f"s.places[t % {count}]"
    found = (
        f"coalesce(try_element_at(filter(sequence({place}, least({place} + {AHEAD}, {size - 1})), {free}), 1),"
        f" try_element_at(filter(sequence({place}, {size - 1}), {free}), 1))"
    )
    # First the preference that is claimed (as ``found``), then the new state.
    claim = f"""
        aggregate(
            sequence(0, {size - 1}),
            named_struct('owners', unhex(repeat('FFFF', {size})), 'places', transform(starts, x -> 0)),
            (s, t) -> element_at(transform(array({found}), j -> named_struct(
                'owners', overlay(s.owners PLACING unhex(lpad(hex(t % {count}), 4, '0'))
                    FROM cast(2 * ((starts[t % {count}] + j * steps[t % {count}]) % {size}) + 1 as int) FOR 2),
                'places', transform(s.places, (p, i) -> if(i = t % {count}, j + 1, p)))), 1)
        )
    """
    filled = orders.select(F.expr(claim).alias("s")).select(
        F.expr(f"posexplode(transform(sequence(0, {size - 1}), k -> cast(conv(hex(substring(s.owners, 2 * k + 1, 2)), 16, 10) as int)))").alias("slot", "at")
    )
    return filled.join(F.broadcast(named), "at").select(F.col("slot").cast("bigint").alias("slot"), F.col("name").alias("shard"))


def assign(docs: DataFrame, table: DataFrame, key: str, slots: int) -> DataFrame:
    """The rows of ``docs`` with two new columns, ``slot`` and ``shard``.

    The table has ``slots`` rows whatever the input, so it is broadcast. A row
    depends on its key alone: equal keys, repeated rows among them, share a
    shard, and null keys have one too (that of an empty key). Input columns
    of these names are replaced.
    """
    slot = (hashed(F.coalesce(F.col(key).cast("string"), F.lit("")), "key:") % slots).alias("slot")
    kept = [docs[c] for c in docs.columns if c not in ("shard", "slot")]
    return docs.select(*kept, slot).join(F.broadcast(table), "slot").select(*(c.name for c in docs.select(*kept).schema), "slot", "shard")


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(count)]
