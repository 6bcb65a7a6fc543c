"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
ROWS_AT_ONCE = 256
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(column: pa.Array) -> Iterator:
    """The Python values of a column, of which few exist at a time."""
    for at in range(0, len(column), ROWS_AT_ONCE):
        yield from column.slice(at, ROWS_AT_ONCE).to_pylist()


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, split at ASCII white space only.

    ``bytes.split`` splits at exactly the six characters that ``WORD`` excludes.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same after lower-casing A to Z; ``bytes.lower`` leaves other letters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
