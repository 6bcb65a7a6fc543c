"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest
from compare import compare

from crawlframe.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.ORACLE)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    got = compare(spark, name, catalog.queries()[name], oracle.ORACLE[name], SF)
    assert got["columns"] and not got["missing"] and not got["extra"], got
    assert got["rows"] > 0


@pytest.mark.parametrize("name", ["robots_gate", "fetch_gate", "robots_state", "frontier_insert", "crawl_round"])
def test_query_with_split_joins(spark, name):
    """The same rows when nothing may be broadcast and hot keys are dealt over pieces."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = compare(spark, name, catalog.queries()[name], oracle.ORACLE[name], SF)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got["columns"] and not got["missing"] and not got["extra"], got
