from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.frames import explained, frame, rows
from visitledger.operators import drop_excluded, null_aware_anti


def test_drop_excluded_drops_null(spark):
    df = frame(spark, "c string", [{"c": "a"}, {"c": "b"}, {"c": None}])
    assert rows(drop_excluded(df, "c", ["a", "zz"])) == [("b",)]


def _column(rng: random.Random, size: int, nulls: float) -> list[int | None]:
    return [None if rng.random() < nulls else rng.randrange(8) for _ in range(size)]


@pytest.mark.parametrize("seed", range(12))
def test_same_as_not_in(spark, seed):
    rng = random.Random(seed)
    left = _column(rng, rng.choice([0, 5, 20]), rng.choice([0.0, 0.3]))
    right = _column(rng, rng.choice([0, 1, 6]), rng.choice([0.0, 0.0, 0.3]))
    a = frame(spark, "k int, n int", [{"k": x, "n": i} for i, x in enumerate(left)])
    b = frame(spark, "m int", [{"m": x} for x in right])
    a.createOrReplaceTempView("not_in_left")
    b.createOrReplaceTempView("not_in_right")
    sql = "SELECT * FROM not_in_left WHERE k NOT IN (SELECT m FROM not_in_right)"
    assert rows(null_aware_anti(a, b, "k", "m")) == rows(spark.sql(sql))


def test_struct_keys_on_the_same_table(spark):
    df = frame(
        spark,
        "a string, b double, drop boolean",
        [
            {"a": "x", "b": 0.0, "drop": True},
            {"a": "x", "b": 0.0, "drop": False},
            {"a": "x", "b": 1.0, "drop": False},
            {"a": None, "b": 0.0, "drop": False},
        ],
    )
    key = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.struct("a", "b"))
    got = null_aware_anti(df, df.where("drop"), key, key)
    assert rows(got, "a", "b") == [("x", 1.0)]


def test_never_broadcasts_a_large_side(spark, no_broadcast):
    a = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = explained(null_aware_anti(a, b, "o_orderkey", "l_orderkey"))
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
