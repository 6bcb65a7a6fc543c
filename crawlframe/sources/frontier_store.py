"""The frontier on files: ``domain/batch_id=N``, ``url/batch_id=N``, and what a batch rejects or puts off.

One writer. A batch reads the batches before it and replaces its own folder, so
running a batch again changes nothing.
"""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe import schemas
from crawlframe.plans.crawl_round import Round


TABLES = {
    "domain": schemas.DOMAIN,
    "url": schemas.URL,
    "reject": f"{schemas.REJECTS}, batch_id bigint",
    "retry": f"{schemas.RETRIES}, batch_id bigint",
}


class FrontierStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _path(self, table: str) -> str:
        return posixpath.join(self.root, table)

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """``domain``, ``url``, ``reject`` or ``retry``, optionally only the batches before ``before``.

        The batch is a partition column, so later batches are not read. A table
        that does not exist yet is empty.
        """
        schema = TABLES[table]
        try:
            rows = self.spark.read.schema(schema).parquet(self._path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = schemas.empty(self.spark, schema)
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """Replace the folder of a batch, also when the batch has no rows any more."""
        path = posixpath.join(self._path(table), f"batch_id={batch_id}")
        rows.drop("batch_id").write.mode("overwrite").parquet(path)

    def write_round(self, done: Round, batch_id: int) -> None:
        """Everything that a crawl round adds; the URLs last, as they make the batch count."""
        self.write("reject", done.rejects, batch_id)
        self.write("retry", done.retries, batch_id)
        self.write("domain", done.new_domains, batch_id)
        self.write("url", done.new_urls, batch_id)
