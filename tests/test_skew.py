"""Skew-safe joins and dense ids against their plain forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crawlframe.operators import skew


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def skewed(spark):
    """3,000 rows; key 0 owns a third, some keys have no partner."""
    return spark.range(3000).selectExpr(
        "id", "CASE WHEN id < 1000 THEN 'k0' ELSE concat('k', id % 40) END AS key"
    )


def test_hot_keys_are_few_and_split(spark):
    got = {r.key: r._pieces for r in skew.hot_keys(skewed(spark), "key", 20).collect()}
    assert got == {"k0": 7}
    assert skew.hot_keys(skewed(spark), "key", 2).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_equals_join(spark, no_broadcast, how):
    left = skewed(spark)
    right = spark.range(30).selectExpr("concat('k', id) AS key", "id * 10 AS value")
    got = skew.split_join(left, right, "key", ["id"], how, parts=20).orderBy("id").collect()
    assert got == left.join(right, "key", how).orderBy("id").collect()


def test_split_join_deals_a_hot_key_over_pieces(spark, no_broadcast):
    left = skewed(spark)
    right = spark.range(30).selectExpr("concat('k', id) AS key", "id AS value")
    plan = skew.split_join(left, right, "key", ["id"], parts=20)
    assert "_piece" in plan._jdf.queryExecution().executedPlan().toString()


def test_dense_ids(spark):
    rows = spark.range(5000).selectExpr("md5(cast(id AS string)) AS name", "id % 7 AS n")
    got = skew.with_dense_ids(rows, ["name"], "i", 11).orderBy("name").collect()
    assert [r.i for r in got] == list(range(11, 5011))
    assert skew.with_dense_ids(rows.filter(F.lit(False)), ["name"], "i", 1).count() == 0
