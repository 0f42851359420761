from __future__ import annotations

import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import at, explained, frame, rows
from visitledger.operators import (
    as_of,
    first_per_key,
    latest_per_key,
    snapshot_dates,
    spread_left_join,
    version_spans,
    versions_on,
)
from visitledger.operators.keys import known_on_day


def test_snapshot_dates_newest_first(spark):
    stamps = ["2024-01-02 01:00:00", "2024-01-10 00:00:00", "2024-01-02 23:59:59", None]
    df = frame(spark, "ts timestamp", [{"ts": at(t)} for t in stamps])
    got = [r[0] for r in snapshot_dates(df, "ts").collect()]
    assert got == ["2024-01-10", "2024-01-02", None]


def test_as_of_leaves_the_day_out(spark):
    stamps = ["2024-01-01 23:59:59", "2024-01-02 00:00:00", "2024-01-03 00:00:00", None]
    df = frame(spark, "ts timestamp", [{"ts": at(t)} for t in stamps])
    assert rows(as_of(df, "ts", date(2024, 1, 2))) == [(at(stamps[0]),)]


def test_as_of_reaches_the_reader(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = explained(as_of(df, "ts", date(2024, 1, 20)).select("user_id"))
    assert "LessThan(ts,2024-01-20T00:00" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_latest_per_key(spark):
    versions = [
        {"k": "a", "v": 1, "t": "x"},
        {"k": "a", "v": 2, "t": "y"},
        {"k": "a", "v": 2, "t": "w"},  # tie: lowest tie-break value wins
        {"k": "b", "v": None, "t": "p"},
        {"k": "b", "v": 1, "t": "q"},  # NULL versions are the oldest
        {"k": None, "v": 1, "t": "r"},
        {"k": None, "v": 5, "t": "s"},  # NULL keys are one group
    ]
    df = frame(spark, "k string, v int, t string", versions)
    got = rows(latest_per_key(df, ["k"], "v", ["t"]))
    assert got == [(None, 5, "s"), ("a", 2, "w"), ("b", 1, "q")]


def test_first_per_key_takes_null_first(spark):
    df = frame(spark, "k string, v int", [{"k": "a", "v": 1}, {"k": "a"}])
    assert rows(first_per_key(df, ["k"], [F.col("v").asc_nulls_first()])) == [("a", None)]


def test_rows_are_thinned_before_the_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = explained(latest_per_key(df, ["l_orderkey"], "l_shipdate", ["l_partkey"]))
    assert "row_number(), 1, Partial" in plan
    assert plan.index("row_number(), 1, Final") < plan.index("Exchange") < plan.index("1, Partial")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_days_are_utc_days(spark, zone, tmp_path):
    """Instants around midnight, under any session zone, with the bound in the reader."""
    before = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2024-01-01 23:59:59", "2024-01-02 00:00:00", "2024-01-02 02:00:00"]
    spark.sql("SELECT explode(array(" + ", ".join(f"timestamp'{t} UTC'" for t in texts) + ")) AS at").write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.read.parquet(f"{tmp_path}/t")
        assert as_of(df, "at", date(2024, 1, 2)).count() == 1
        assert "LessThan(at" in explained(as_of(df, "at", date(2024, 1, 2)))
        assert [r[0] for r in snapshot_dates(df, "at").collect()] == ["2024-01-02", "2024-01-01"]
        naive = df.select(F.expr("timestamp_ntz'2024-01-01 23:30:00'").alias("at"))
        assert as_of(naive, "at", date(2024, 1, 2)).count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_versions_that_tie_are_equal(spark):
    """The choice among versions of one instant does not hang on the partitioning."""
    from visitledger.plans.visits import visit_versions
    from visitledger.sources.schemas import VISITS

    base = {"unique_visit_id": "v", "updated_at": datetime(2024, 1, 1), "target_date": date(2024, 1, 1)}
    made = [base | {"provider_last": p, "mileage": m} for p in ("a", "b", None) for m in (1.0, 2.0, None)]
    found = set()
    for seed in range(4):
        random.Random(seed).shuffle(made)
        df = spark.createDataFrame([tuple(r.get(c) for c in VISITS.names) for r in made], VISITS).repartition(seed + 1)
        found.add(visit_versions(df, date(2025, 1, 1)).first())
    assert len(found) == 1


def test_sources_are_typed_like_the_warehouse(spark):
    from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

    from visitledger.sources.tables import conform

    schema = StructType(
        [StructField("n", LongType()), StructField("mrn", StringType()), StructField("day", DateType()), StructField("no", StringType())]
    )
    df = spark.sql(
        "SELECT * FROM VALUES (2.5D, 12345.0D, timestamp'2024-01-02 02:00:00 UTC'),"
        " (0.6D, 0.5D, timestamp'2024-01-01 23:00:00 UTC'), (NULL, NULL, NULL) AS t(n, mrn, day)"
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = conform(df, schema).collect()
        spark.conf.set("spark.sql.session.timeZone", before)
        assert [tuple(r) for r in got] == [
            (3, "12345", date(2024, 1, 2), None),
            (1, "0.5", date(2024, 1, 1), None),
            (None, None, None, None),
        ]


def _history(rng, keys):
    rows = []
    for i in range(300):
        recorded = datetime(2024, 1, 1) + timedelta(hours=12 * rng.randrange(60))
        rows.append((rng.choice(keys), recorded if rng.random() > 0.05 else None, rng.choice("abc"), i))
    return rows


@pytest.mark.parametrize("zoned", [True, False])
def test_version_spans_are_the_snapshots(spark, zoned):
    """For every day, before, between and after: the versions that as_of and latest_per_key give."""
    made = _history(random.Random(7), ["k", "l", "m", None])
    df = spark.createDataFrame(made, f"k string, at timestamp{'' if zoned else '_ntz'}, a string, b int")
    spans = version_spans(df, ["k"], "at", ["a", "b"])
    days = [date(2023, 12, 31) + timedelta(days=i) for i in range(35)]
    want = [(d, *r) for d in days for r in rows(latest_per_key(as_of(df, "at", d), ["k"], "at", ["a", "b"]))]
    assert rows(versions_on(spans, days + days[:3]), "snapshot", "k", "at", "a", "b") == want
    assert rows(known_on_day(spans, days[9])) == [r[1:] for r in want if r[0] == days[9]]
    assert versions_on(spans, []).count() == 0
    narrow = version_spans(df, ["k"], "at", ["a", "b"], ["a"])
    assert "b" not in narrow.columns and rows(narrow, "k", "at", "a") == rows(spans, "k", "at", "a")
    with pytest.raises(ValueError):
        latest_per_key(df.withColumn("c", F.lit(1)), ["k"], "at", ["a"], ["c"])


def test_rows_without_key_are_spread(spark, no_broadcast):
    """A third of the rows without a key: the join is that of Spark, and no task gets them all."""
    left = spark.range(30_000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 500).alias("k"), F.when(F.col("id") % 7 != 0, F.lit("x")).alias("j"))
    right = spark.range(400).select(F.col("id").alias("r"), F.lit("x").alias("s"), (F.col("id") * 10).alias("v"))
    right = right.unionByName(spark.sql("SELECT NULL AS r, 'x' AS s, 1L AS v UNION ALL SELECT 5, NULL, 2L"))
    on = [("k", "r"), ("j", "s")]
    name = "spark.sql.adaptive.enabled"
    spark.conf.set(name, "false")
    try:
        got = spread_left_join(left, right, on)
        want = left.join(right, (F.col("k") == F.col("r")) & (F.col("j") == F.col("s")), "left")
        assert got.columns == want.columns and rows(got) == rows(want)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = [r["count"] for r in want.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set(name, "true")
    assert max(sizes) < 2 * statistics.median(sizes) and max(plain) > 2 * statistics.median(plain)


@pytest.mark.parametrize("zoned", [True, False])
def test_versions_of_some_days_move_once(spark, no_broadcast, zoned):
    """Asked for some days, the history gives their snapshots as before, and is dealt out by key alone."""
    made = _history(random.Random(11), ["k", "l", "m", None])
    df = spark.createDataFrame(made, f"k string, at timestamp{'' if zoned else '_ntz'}, a string, b int")
    days = [date(2023, 12, 31), date(2024, 1, 9), date(2024, 1, 10), date(2024, 1, 25), date(2024, 3, 1)]
    spans = version_spans(df, ["k"], "at", ["a", "b"], days=[days[3], *days])
    whole = version_spans(df, ["k"], "at", ["a", "b"])
    assert spans.dtypes == whole.dtypes
    want = rows(versions_on(whole, days), "snapshot", "k", "at", "a", "b")
    assert rows(versions_on(spans, days), "snapshot", "k", "at", "a", "b") == want != []
    for day in days:
        assert rows(known_on_day(spans, day)) == rows(known_on_day(whole, day))
    assert explained(spans).split("== Initial Plan")[0].count("Exchange hash") == 1
    assert rows(version_spans(df, ["k"], "at", ["a"], ["a"], days), "k", "a") == rows(spans, "k", "a")
