"""Per-site politeness: moving average of fetch times and the next allowed fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.operators.robots import gate
from crawlframe.operators.skew import hot_keys, shuffle_width
from crawlframe.session import written

SAMPLES = 10
FLOOR_US = 150_000
WAIT_FACTOR = 3


def clamped(log: DataFrame) -> DataFrame:
    """The log with ``d``, the clamped duration of a status-200 fetch, else NULL."""
    return log.selectExpr(
        "authority",
        "event_id",
        "start",
        "status = 200 AS ok",
        f"CASE WHEN status = 200 THEN greatest(duration_us, {FLOOR_US}L) END AS d",
    )


def time_chunks(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Add ``_chunk``: busy authorities are cut into ranges of (start, event_id) of similar size.

    Only authorities that hold at least 1/``parts`` of the rows are cut: their
    rows are range-partitioned into ``parts`` pieces and written once, so every
    branch of a plan sees the same chunks. ``_cut`` tells cut authorities from
    the others, whose only chunk is 0.
    """
    parts = parts or shuffle_width(rows)
    hot = F.broadcast(written(hot_keys(rows, "authority", parts).select("authority"), "hot"))
    busy = written(
        rows.join(hot, "authority", "left_semi")
        .repartitionByRange(parts, "authority", "start", "event_id")
        .withColumn("_chunk", F.spark_partition_id()),
        "busy",
    )
    others = rows.join(hot, "authority", "left_anti").withColumn("_chunk", F.lit(0))
    return others.withColumn("_cut", F.lit(False)).unionByName(busy.withColumn("_cut", F.lit(True)))


def samples_before(chunked: DataFrame) -> DataFrame:
    """For each chunk of a cut authority, the last ten samples of its earlier chunks.

    At most twice ``parts`` rows: one per chunk, and only busy authorities have
    chunks. The ranking drops all but ten rows per chunk before it shuffles. The
    remaining samples are numbered per authority, and a chunk takes the ten
    numbers up to where it starts.
    """
    busy = chunked.filter("_cut")
    ranked = busy.filter("ok").selectExpr(
        "authority", "_chunk", "start", "event_id", "d",
        "row_number() OVER (PARTITION BY authority, _chunk"
        " ORDER BY start DESC, event_id DESC) AS _r",
    ).filter(F.col("_r") <= SAMPLES)
    samples = ranked.selectExpr("authority", "_chunk", "struct(start, event_id, d) AS t")
    starts = busy.select("authority", "_chunk").distinct()
    return (
        samples.unionByName(starts, allowMissingColumns=True)
        .selectExpr(
            "*",
            "count(t) OVER (PARTITION BY authority ORDER BY _chunk, t NULLS FIRST"
            " ROWS UNBOUNDED PRECEDING) AS _i",
        )
        .selectExpr(
            "authority", "_chunk", "t",
            "sort_array(collect_list(t) OVER (PARTITION BY authority ORDER BY _i"
            f" RANGE BETWEEN {SAMPLES - 1} PRECEDING AND CURRENT ROW)) AS before",
        )
        .filter("t IS NULL AND size(before) > 0")
        .drop("t")
    )


def politeness(log: DataFrame, parts: int | None = None) -> DataFrame:
    """State after each fetch: average and earliest next fetch, NULL before the first 200.

    ``log``: authority, event_id, start, duration_us, status. Fetches other than
    200 keep the state as it is. The log is shuffled once, by authority and chunk,
    and the rows of busy authorities once before, into their chunks; what a chunk
    needs from earlier ones is a small table.
    """
    chunked = time_chunks(clamped(log), parts)
    window = "PARTITION BY authority, _chunk{0} ORDER BY start, event_id ROWS {1} PRECEDING"
    ten = window.format(", ok", SAMPLES - 1)
    summed = chunked.repartition("authority", "_chunk").selectExpr(
        "*", f"sum(d) OVER ({ten}) AS _sum", f"count(d) OVER ({ten}) AS _count"
    )

    def total(samples: str) -> str:
        return f"aggregate({samples}, 0L, (a, x) -> a + x.d)"

    started = f"{total('before')} DIV size(before)"
    return (
        summed.join(F.broadcast(samples_before(chunked)), ["authority", "_chunk"], "left")
        .selectExpr(
            "authority", "_chunk", "event_id", "start", "before",
            f"least(cast({SAMPLES} - _count AS int), coalesce(size(before), 0)) AS _take",
            f"""CASE WHEN _take > 0 THEN {total('slice(before, -_take, _take)')}
                ELSE 0L END AS _earlier""",
            "CASE WHEN ok THEN (_sum + _earlier) DIV (_count + _take) END AS _avg",
            f"""CASE WHEN ok THEN named_struct('avg_us', _avg,
                'until_us', unix_micros(start) + {WAIT_FACTOR} * _avg) END AS _own""",
            f"""CASE WHEN before IS NOT NULL THEN named_struct('avg_us', {started}, 'until_us',
                unix_micros(element_at(before, -1).start) + {WAIT_FACTOR} * ({started}))
                END AS _inherited""",
        )
        .selectExpr(
            "authority",
            "event_id",
            f"coalesce(last(_own, true) OVER ({window.format('', 'UNBOUNDED')}), _inherited) AS s",
        )
        .select("authority", "event_id", "s.avg_us", "s.until_us")
    )


def next_allowed(log: DataFrame) -> DataFrame:
    """Latest state per authority; only its last ten samples are shuffled."""
    ranked = clamped(log).filter("ok").selectExpr(
        "*",
        "row_number() OVER (PARTITION BY authority ORDER BY start DESC, event_id DESC) AS _r",
    ).filter(F.col("_r") <= SAMPLES)
    return ranked.groupBy("authority").agg(
        F.expr("sum(d) DIV count(d)").alias("avg_us"),
        F.expr(f"unix_micros(max(start)) + {WAIT_FACTOR} * (sum(d) DIV count(d))").alias("until_us"),
    )


def fetch_schedule(waiting: DataFrame, robots: DataFrame, log: DataFrame) -> DataFrame:
    """Allowed URLs of the next hand-out with the earliest time to fetch each.

    ``waiting`` comes from :func:`frontier.select_urls`: a few rows per domain. A
    site without history may be fetched at once (0).
    """
    rows = waiting.withColumn("authority", F.col("name"))
    gated = gate(rows, robots, ["path", "query"]).filter("decision = 'Allowed'")
    timed = gated.join(next_allowed(log), "authority", "left")
    return timed.selectExpr(
        "name", "path", "query", "rank", "coalesce(until_us, 0L) AS earliest_us"
    )
