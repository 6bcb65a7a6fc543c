"""Run a registered query and its SQL side by side and compare rows as multisets."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        if os.path.exists(f"{sf}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def compare(spark, name: str, query, sql: str, sf: str) -> dict:
    started = time.time()
    df = query(spark, sf)
    got_columns, got_rows = df.columns, df.collect()
    seconds = time.time() - started
    want = duck(sf).execute(sql)
    want_columns = [d[0] for d in want.description]
    expected = rows_of(want_columns, want.fetchall())
    got = rows_of(got_columns, [tuple(r) for r in got_rows])
    return {
        "name": name,
        "seconds": round(seconds, 2),
        "rows": len(got_rows),
        "columns": sorted(got_columns) == sorted(want_columns),
        "missing": list((expected - got).items())[:3],
        "extra": list((got - expected).items())[:3],
    }


if __name__ == "__main__":
    from crawlframe.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    chosen = sys.argv[2:] or list(queries())
    for name in chosen:
        try:
            print(compare(spark, name, queries()[name], oracle_sql()[name], sf), flush=True)
        except Exception as error:  # report and go on with the next query
            print({"name": name, "error": str(error)[:600]}, flush=True)
