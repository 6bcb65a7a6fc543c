"""The frontier as tables bucketed by key, so that a batch meets the history without moving it.

Every URL has a key, a digest of its name, path and query that is never NULL.
``url`` and ``handed_out`` are bucketed by the key and ``domain`` by the name, and
each batch is a partition of its own with one file per bucket. A batch is dealt to
the same buckets before it is joined, so all that moves is the batch: the tasks
read the bucket files of the history where they lie.

The tables are external: their files below ``root`` are all there is to keep, and
any session can open them again. One writer; a batch reads the batches before it
and replaces its own partition, also with nothing. What a batch adds to the ids
is noted with it, so the next one does not look for the largest.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe import schemas
from crawlframe.operators.frontier import KEY
from crawlframe.operators.skew import split_join, with_dense_ids
from crawlframe.plans.crawl_round import Round
from crawlframe.session import written

URL_COLUMNS = (
    "key binary, url_id bigint, domain_id bigint, path string, query string, context string, "
    "crawl_depth smallint, crawl_priority float, http_etag string, http_last_modified timestamp"
)
TABLES = {
    "domain": ("name string, domain_id bigint", "name"),
    "url": (URL_COLUMNS, "key"),
    "handed_out": ("key binary, url_id bigint", "key"),
}
PLAIN = {
    "ids": "next_domain_id bigint, next_url_id bigint",
    "reject": "stage string, key string, reason string",
    "retry": "url string, retry_s int, next_attempt timestamp",
}


def url_key(name: str = "name", path: str = "path", query: str = "query") -> str:
    """SQL: 128 bits that stand for a frontier key; no query and an empty one differ."""
    return f"unhex(md5(to_json(named_struct('n', {name}, 'p', {path}, 'q', {query}))))"


class KeyedFrontier:
    """``buckets`` is fixed when the tables are made; choose it so that a bucket of the history fits a task."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.prefix = f"frontier_{hashlib.md5(root.encode()).hexdigest()[:12]}"
        for table, (columns, key) in TABLES.items():
            place = posixpath.join(root, table)
            spark.sql(
                f"""CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}, batch_id bigint) USING parquet
                PARTITIONED BY (batch_id) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'"""
            )
            if self._files(place, f"{columns}, batch_id bigint") is not None:
                spark.sql(f"ALTER TABLE {self.name(table)} RECOVER PARTITIONS")

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """``url``, ``domain`` or ``handed_out``, optionally only the batches before ``before``."""
        self.spark.catalog.refreshTable(self.name(table))
        rows = self.spark.table(self.name(table))
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def _files(self, path: str, schema: str) -> DataFrame | None:
        """The files below a path, None where there is no such path yet."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read_plain(self, table: str, before: int | None = None) -> DataFrame:
        schema = f"{PLAIN[table]}, batch_id bigint"
        found = self._files(posixpath.join(self.root, table), schema)
        rows = schemas.empty(self.spark, schema) if found is None else found
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def next_ids(self, batch_id: int) -> tuple[int, int]:
        """First free domain and URL id: one row per earlier batch is read."""
        row = self.read_plain("ids", batch_id).agg(F.max("next_domain_id"), F.max("next_url_id")).first()
        return row[0] or 1, row[1] or 1

    def fresh(self, offered: DataFrame, batch_id: int) -> DataFrame:
        """The offered keys (name, path, query, …) that no earlier batch has, with their ``key``."""
        known = self.read("url", batch_id).select("key")
        keyed = offered.withColumn("key", F.expr(url_key())).repartition(self.buckets, "key")
        return keyed.join(known.hint("merge"), "key", "left_anti")

    def merge(self, offered: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """New ``domain`` and ``url`` rows for distinct offered keys; ids go to new rows alone.

        Only what is new meets the domain names, and only once the history has
        been passed, so the second join is as small as the batch.
        """
        new = written(self.fresh(offered, batch_id), "fresh")
        first_domain, first_url = self.next_ids(batch_id)
        names = new.select("name").distinct().repartition(self.buckets, "name")
        known = self.read("domain", batch_id).select("name", "domain_id")
        met = written(names.join(known.hint("merge"), "name", "left"), "names")
        unknown = met.filter("domain_id IS NULL").select("name")
        new_domains = with_dense_ids(unknown, ["name"], "domain_id", first_domain).select(
            "domain_id", "name", F.lit(batch_id).cast("bigint").alias("batch_id")
        )
        ids = met.filter("domain_id IS NOT NULL").select("domain_id", "name").unionByName(new_domains.select("domain_id", "name"))
        placed = split_join(new, ids, "name", ["key"], how="inner")
        new_urls = with_dense_ids(placed, list(KEY), "url_id", first_url).selectExpr(
            "url_id", "domain_id", "path", "query", "context", "cast(0 AS smallint) AS crawl_depth",
            "cast(1 AS float) AS crawl_priority", "cast(NULL AS string) AS http_etag",
            "cast(NULL AS timestamp) AS http_last_modified", f"{batch_id}L AS batch_id", "key",
        )
        return new_domains, new_urls

    def write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """Replace a batch's partition of a bucketed table, one file per bucket."""
        columns, key = TABLES[table]
        names = [c.split()[0] for c in columns.split(", ")]
        view = f"{self.prefix}_batch"
        rows.select(*names).repartition(self.buckets, key).sortWithinPartitions(key).createOrReplaceTempView(view)
        session = rows.sparkSession  # that of a micro-batch, where the view is
        session.sql(f"INSERT OVERWRITE TABLE {self.name(table)} PARTITION (batch_id = {batch_id}) SELECT * FROM {view}")
        session.catalog.dropTempView(view)

    def write_plain(self, table: str, rows: DataFrame, batch_id: int) -> None:
        path = posixpath.join(self.root, table, f"batch_id={batch_id}")
        rows.select(*[c.split()[0] for c in PLAIN[table].split(", ")]).write.mode("overwrite").parquet(path)

    def add(self, offered: DataFrame, batch_id: int) -> None:
        """Merge distinct offered keys as a batch of their own."""
        new_domains, new_urls = self.merge(offered, batch_id)
        self._store(new_domains, new_urls, batch_id)

    def write_round(self, done: Round, batch_id: int) -> None:
        """Everything a crawl round adds, when the round was merged by :meth:`merge`."""
        self.write_plain("reject", done.rejects, batch_id)
        self.write_plain("retry", done.retries, batch_id)
        self._store(done.new_domains, done.new_urls, batch_id)

    def _store(self, new_domains: DataFrame, new_urls: DataFrame, batch_id: int) -> None:
        first_domain, first_url = self.next_ids(batch_id)
        domains, urls = written(new_domains, "new_domains"), written(new_urls, "new_urls")
        self.write("domain", domains, batch_id)
        self.write("url", urls, batch_id)
        counts = domains.agg(F.count(F.lit(1)).alias("d")).join(urls.agg(F.count(F.lit(1)).alias("u")), F.lit(True))
        ids = counts.select((F.col("d") + first_domain).alias("next_domain_id"), (F.col("u") + first_url).alias("next_url_id"))
        self.write_plain("ids", ids, batch_id)

    def hand_out(self, batch_id: int, names: Sequence[str] | None = None, per_domain: int = 10) -> DataFrame:
        """Up to ``per_domain`` URLs of each domain that no batch handed out before.

        Lowest ids first (``rank``); ``turn`` is the order, last in, first out.
        URLs and what was handed out lie in the same buckets, so that join moves
        nothing. Ranking moves ids alone, at most ``per_domain`` per domain and
        task; path and query are fetched by key for the chosen ones.
        """
        rows = self.read("url").select("key", "url_id", "domain_id")
        chosen = self.read("domain").select("domain_id", "name")
        if names is not None:
            chosen = chosen.filter(F.col("name").isin(list(names)))
            wanted = [r.domain_id for r in chosen.select("domain_id").collect()]  # at most one per name asked for
            rows = rows.filter(F.col("domain_id").isin(wanted))
        gone = self.read("handed_out", batch_id).select("key")
        waiting = rows.join(gone.hint("merge"), "key", "left_anti")
        ranked = waiting.selectExpr(
            "*", "row_number() OVER (PARTITION BY domain_id ORDER BY url_id) AS rank"
        ).filter(F.col("rank") <= per_domain)
        turned = ranked.selectExpr("*", "cast(count(1) OVER (PARTITION BY domain_id) - rank + 1 AS int) AS turn")
        few = turned.join(chosen, "domain_id").repartition(self.buckets, "key")
        texts = self.read("url").select("key", "path", "query")
        return few.join(texts.hint("merge"), "key").select("key", "url_id", *KEY, "rank", "turn")

    def mark(self, handed: DataFrame, batch_id: int) -> None:
        """Note the rows of a hand-out, so that later ones leave them out."""
        self.write("handed_out", written(handed.select("key", "url_id"), "handed"), batch_id)
