from __future__ import annotations

import random
from bisect import bisect_left
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.frames import explained, frame, rows
from visitledger.operators import (
    cover_anti,
    cover_semi,
    first_cover,
    interval_left_join,
    spans_without_points,
)
from visitledger.operators.intervals import crowded_hits, point_rows
from visitledger.operators.keys import count_below

BASE = date(1969, 10, 1)  # either side of day number zero
LENGTHS = (0, 1, 30, 62, 63, 64, 65, 90, 510, 511, 512, 513, 3000, -5)
ARGS = {"eq": [("p", "q"), ("a", "b")], "point": "d", "lo": "lo", "hi": "hi"}


def _case(seed: int):
    rng = random.Random(seed)

    def key():
        return rng.choice(["hot", "hot", "x", "y", None]), rng.choice(["n", "n", "s", None])

    points, spans = [], []
    for i in range(120):
        p, a = key()
        d = None if rng.random() < 0.05 else BASE + timedelta(rng.randrange(400))
        points.append({"i": i, "p": p, "a": a, "d": d})
    for j in range(60):
        q, b = key()
        lo = BASE + timedelta(rng.randrange(-300, 420))
        hi = lo + timedelta(rng.choice(LENGTHS))
        if rng.random() < 0.1:
            hi = date(9999, 12, 31)
        spans.append(
            {
                "j": j,
                "q": q,
                "b": b,
                "lo": None if rng.random() < 0.05 else lo,
                "hi": None if rng.random() < 0.05 else hi,
                "rank": rng.randrange(10),
            }
        )
    spans += [dict(s, j=s["j"] + 1000) for s in spans[:5]]  # same bounds twice
    return points, spans


def _inside(point: dict, span: dict) -> bool:
    values = (point["p"], point["a"], point["d"], span["q"], span["b"], span["lo"], span["hi"])
    if any(v is None for v in values):
        return False
    same = point["p"] == span["q"] and point["a"] == span["b"]
    return same and span["lo"] <= point["d"] <= span["hi"]


def _frames(spark, seed):
    points, spans = _case(seed)
    left = frame(spark, "i int, p string, a string, d date", points)
    right = frame(spark, "j int, q string, b string, lo date, hi date, rank int", spans)
    return points, spans, left, right


def _key(row):
    return [(v is not None, v) for v in row]


@pytest.mark.parametrize("seed", range(4))
def test_left_join_keeps_every_match(spark, seed):
    points, spans, left, right = _frames(spark, seed)
    expected = []
    for p in points:
        found = [s["j"] for s in spans if _inside(p, s)] or [None]
        expected += [(p["i"], j) for j in found]
    got = interval_left_join(left, right, take=["j"], **ARGS)
    assert rows(got, "i", "j") == sorted(expected, key=_key)


@pytest.mark.parametrize("seed", range(4))
def test_first_cover(spark, seed):
    points, spans, left, right = _frames(spark, seed)
    expected = set()
    for p in points:
        found = [s for s in spans if _inside(p, s)]
        if found:
            best = min(found, key=lambda s: (s["rank"], s["j"]))
            expected.add((p["p"], p["a"], p["d"], best["j"]))
    order = [F.col("rank").asc(), F.col("j").asc()]
    got = first_cover(left, right, order=order, take=["rank", "j"], **ARGS)
    assert rows(got, "p", "a", "d", "j") == sorted(expected)


@pytest.mark.parametrize("seed", range(4))
def test_cover_and_its_opposite(spark, seed):
    points, spans, left, right = _frames(spark, seed)
    inside = [(p["i"],) for p in points if any(_inside(p, s) for s in spans)]
    outside = [(p["i"],) for p in points if not any(_inside(p, s) for s in spans)]
    assert inside and outside
    assert rows(cover_semi(left, right, **ARGS), "i") == inside
    assert rows(cover_anti(left, right, **ARGS), "i") == outside


@pytest.mark.parametrize("seed", range(4))
def test_spans_without_points(spark, seed):
    points, spans, left, right = _frames(spark, seed)
    expected = sorted((s["j"],) for s in spans if not any(_inside(p, s) for p in points))
    assert expected
    assert rows(spans_without_points(right, left, **ARGS), "j") == expected


@pytest.mark.parametrize("seed", range(4))
def test_hits_of_crowded_keys(spark, seed):
    """Spans with equal bounds, whole copies, open and reversed ones: each meets every distinct day inside once."""
    points, spans, left, right = _frames(spark, seed)
    spans += spans[:7]
    expected = sorted({(p["p"], p["a"], p["d"], i, s["j"]) for p in points for i, s in enumerate(spans) if _inside(p, s)})
    assert expected
    eq = ARGS["eq"]
    got = crowded_hits(point_rows(left, eq, "d", []), right.union(right.where("j < 7")), eq, "lo", "hi", ["j"])
    assert rows(got, "__k0", "__k1", "__at", "j") == sorted((p, a, d, j) for p, a, d, _, j in expected)


def test_no_spans_at_all(spark):
    _, _, left, right = _frames(spark, 0)
    none = right.where("j < 0")
    assert interval_left_join(left, none, take=["j"], **ARGS).where("j IS NULL").count() == 120
    assert cover_semi(left, none, **ARGS).count() == 0
    assert cover_anti(left, none, **ARGS).count() == 120


def test_plans_without_pairing_whole_keys(spark, no_broadcast):
    _, _, left, right = _frames(spark, 0)
    plan = explained(interval_left_join(left, right, take=["j"], **ARGS))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Subquery" not in plan
    # Existence needs no join of points with spans at all, only the way back.
    assert explained(cover_semi(left, right, **ARGS)).count("SortMergeJoin") == 1


@pytest.mark.parametrize("share", [0, 3])
def test_hot_key_makes_no_more_pairs(spark, share):
    """A third of both tables on one key: pairs stay linear in the spans."""
    size = 30000
    hot = (F.col("id") % share == 0) if share else F.lit(False)

    def table(salt):
        start = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)).cast("int")
        return spark.range(size).select(
            "id",
            F.when(hot, F.lit(-1)).otherwise(F.col("id") % 3000).alias("k"),
            F.date_add(F.lit(BASE), start).alias("d"),
        )

    spans = table(2).withColumn("hi", F.date_add("d", 9))
    order = [F.col("id").asc()]
    got = first_cover(
        table(1), spans, eq=[("k", "k")], point="d", lo="d", hi="hi", order=order, take=["id"]
    )
    most = got.groupBy("k").count().agg(F.max("count")).collect()[0][0]
    assert most <= 1000
    if share:
        assert got.where("k = -1").count() == 1000


@pytest.mark.parametrize("hi", ["date_add(d, 599)", "DATE '9999-12-31'", "date_add(d, cast(5000 + id % 900 as int))"])
def test_long_spans_meet_only_the_points_inside(spark, hi):
    """One key, many days, long and open spans: days are one row, spans meet it once, the rest are hits."""
    from visitledger.operators import intervals

    days = spark.range(400).select(F.lit("k").alias("__k0"), F.expr("date_add(DATE '1995-06-30', cast(id * 5 as int))").alias("__at"))
    spans = spark.range(300).select("id", F.lit("k").alias("__k0"), F.expr("date_add(DATE '1994-01-01', cast(id * 7 as int))").alias("d"))
    spans = spans.select("__k0", F.col("d").alias("__lo"), F.expr(hi).alias("__hi"))
    pairs = intervals._inside(days, spans, ["__k0"])
    inside = days.join(spans, "__k0").where(F.col("__at").between(F.col("__lo"), F.col("__hi")))
    assert rows(pairs) == rows(inside.select(*pairs.columns)) and pairs.count() > 0
    joined, _, generated = explained(pairs).partition("Generate")[2].partition("Join")
    assert generated.count("ObjectHashAggregate") + generated.count("SortAggregate") == 2 and "Generate" not in generated


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.lists(st.integers(-60, 60), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_binary_search(spark, values, bounds):
    values = sorted(values)
    df = spark.createDataFrame([(values, b) for b in bounds], "v array<int>, b int")
    got = df.select("b", count_below(F.col("v"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == [bisect_left(values, r["b"]) for r in got]
