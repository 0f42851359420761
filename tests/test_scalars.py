from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tests.frames import at, frame, rows
from visitledger.functions import (
    base_id,
    cents,
    first_word,
    half_even,
    normal_name,
    quarter_hours,
    squeeze_once,
    trim_ws,
)

START = "2024-05-01 08:00:00"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_quarter_hours(spark, kind):
    ends = {
        "2024-05-01 09:07:59": 1.0,
        "2024-05-01 09:08:00": 1.25,
        "2024-05-01 09:22:59": 1.25,
        "2024-05-01 09:23:00": 1.5,
        "2024-05-01 09:37:00": 1.5,
        "2024-05-01 09:38:00": 1.75,
        "2024-05-01 09:52:00": 1.75,
        "2024-05-01 09:53:00": 2.0,
        "2024-05-01 08:00:00": 0.0,
        "2024-05-02 19:10:00": 35.25,  # over a day: not wrapped
        "2024-05-01 06:10:00": -1.0,  # -1 h -50 min: negative minutes credit nothing
        None: None,
    }
    df = frame(spark, f"a {kind}, b {kind}", [{"a": at(START), "b": at(e)} for e in ends])
    got = [r[0] for r in df.select(quarter_hours("a", "b")).collect()]
    assert got == list(ends.values())


def test_missing_time_in(spark):
    df = frame(spark, "a timestamp, b timestamp", [{"b": at(START)}])
    assert rows(df.select(quarter_hours("a", "b").alias("h"))) == [(None,)]


def test_text(spark):
    texts = ["\t A  B   C \n", " x y　", "", None, "one"]
    df = frame(spark, "t string", [{"t": t} for t in texts])
    got = df.select(
        trim_ws("t").alias("t"),
        squeeze_once(trim_ws("t")).alias("s"),
        first_word(trim_ws("t")).alias("w"),
        normal_name("t").alias("n"),
    ).collect()
    assert [r["t"] for r in got] == ["A  B   C", "x y", "", None, "one"]
    # Three blanks leave two: one pass only.
    assert [r["s"] for r in got] == ["A B  C", "x y", "", None, "one"]
    assert [r["w"] for r in got] == ["A", "x", "", None, "one"]
    assert [r["n"] for r in got] == ["a  b   c", "x y", "", None, "one"]


def test_base_id(spark):
    ids = {"X.1": "X", "X.1.2": "X", ".5": "", "X": "X", "": "", None: None}
    df = frame(spark, "t string", [{"t": t} for t in ids])
    assert [r[0] for r in df.select(base_id("t")).collect()] == list(ids.values())


def test_half_even(spark):
    values = {2.5: 2.0, 3.5: 4.0, -0.5: 0.0, 1.49: 1.0, None: None}
    df = frame(spark, "v double", [{"v": v} for v in values])
    got = [r[0] for r in df.select(half_even("v")).collect()]
    assert got == list(values.values())
    negative_zero = df.where("v < 0").select(half_even("v").cast("string").alias("z"))
    assert rows(negative_zero) == [("0.0",)]


def test_no_python_workers(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    plan = df.select(trim_ws("t"), base_id("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_cents_is_round(spark):
    """The fast way and the slow one agree on halves, next to halves, and on what has no cents."""
    odd = [None, 0.0, -0.0, 1.005, -1.005, 0.125, -0.125, 62.9375, 1e-300, 999999999.995, 1e9, 1e15 + 0.5, -1e22, 1.7e308]
    odd += [float("nan"), float("inf"), float("-inf")]
    near = [math.nextafter(h, to) for i in range(200) for h in [i * 7.31 + 0.005] for to in (-1e9, 1e9)]
    plain = [i * 0.125 * r for i in range(-50, 50) for r in (20.35, 81.1, 333.33)]
    df = frame(spark, "x double", [{"x": x} for x in [*odd, *near, *plain]])
    both = df.select(cents("x").alias("fast"), F.round("x", 2).alias("slow"))
    assert both.where("NOT (fast <=> slow)").count() == 0
    assert [repr(a) for a, _ in both.collect()] == [repr(b) for _, b in both.collect()]
