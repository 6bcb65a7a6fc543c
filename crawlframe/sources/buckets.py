"""A table on files that is bucketed by a key and written part by part.

A join of a small table with it on the key moves the small table alone. The
table is external: its files are all there is to keep, and any session can open
them again.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTable:
    """``part`` is the partition column; a part is replaced as a whole, also by nothing.

    The number of buckets is fixed when the table is made; choose it so that a
    bucket of the whole table fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, buckets: int, part: str = "batch_id"):
        self.spark, self.columns, self.key, self.buckets, self.part = spark, columns, key, buckets, part
        self.name = f"buckets_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {part} bigint) USING parquet
            PARTITIONED BY ({part}) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"""
        )
        try:
            spark.read.schema(f"{columns}, {part} bigint").parquet(path)
        except AnalysisException as error:  # nothing was written yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of the parts before ``before`` alone."""
        self.spark.catalog.refreshTable(self.name)
        rows = self.spark.table(self.name)
        return rows if before is None else rows.filter(F.col(self.part) < before)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with the key, dealt to the same buckets, ready to meet the table."""
        return rows.repartition(self.buckets, self.key)

    def write(self, rows: DataFrame, part: int) -> None:
        """Replace a part, one file per bucket."""
        names = [c.split()[0] for c in self.columns.split(", ")]
        view = f"{self.name}_part"
        session = rows.sparkSession  # that of a micro-batch, where the view is
        self.dealt(rows.select(*names)).sortWithinPartitions(self.key).createOrReplaceTempView(view)
        session.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION ({self.part} = {part}) SELECT * FROM {view}")
        session.catalog.dropTempView(view)
