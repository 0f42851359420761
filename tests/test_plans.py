"""The plans of the steps as they look when no table is small."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.frames import explained, rows
from visitledger.plans import claims, episodes, report, revenue, visits
from visitledger.sources.staging import drop_staged, stage, stage_all, staging_folder, temporary_tables
from visitledger.sources.tables import read_parquet_inputs
from workload.queries import QUERIES
from workload.roles import SNAPSHOT, inputs

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairing_of_everything(spark, no_broadcast, name):
    plan = explained(QUERIES[name](spark, SF_DIR))
    for word in ("NestedLoop", "Cartesian", "Broadcast", "Python", "MapInPandas"):
        assert word not in plan, word


def test_visits_are_ranked_once(spark, no_broadcast):
    """The version choice is the one window over visits; mappings get their own."""
    found = inputs(spark, SF_DIR)
    plan = explained(
        visits.clean_visits(found.visits, found.task_map, found.insurance_map, SNAPSHOT)
    )
    assert plan.count("unique_visit_id") and plan.count("Window [") == 3


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The ten tables as files with every column of their schemas."""
    folder = str(tmp_path_factory.mktemp("inputs"))
    for name, df in inputs(spark, SF_DIR)._asdict().items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return read_parquet_inputs(spark, folder)


def _read(spark, df, table):
    """The columns that the scan of a table asks its files for."""
    long = {"spark.sql.maxMetadataValueLength": "10000", "spark.sql.debug.maxToStringFields": "1000"}
    for name, value in long.items():
        spark.conf.set(name, value)
    try:
        scans = [line for line in explained(df).splitlines() if "FileScan" in line and f"/{table}.parquet" in line]
    finally:
        for name in long:
            spark.conf.unset(name)
    (scan,) = scans
    return set(re.findall(r"(\w+)#", scan.split("FileScan parquet [")[1].split("]")[0]))


def test_history_is_pruned_before_it_is_ranked(spark, written):
    """Of files with all columns the report reads what it uses, and the rank needs nothing else."""
    pdgm = episodes.pdgm_episodes(written.pdgm_episodes, written.insurance_map, SNAPSHOT, report.PERIOD_COLUMNS)
    used = set(report.PERIOD_COLUMNS) - {"payment_multiplier"} | {"insurance", "updated_at", "total_missed_visits"}
    assert _read(spark, pdgm, "pdgm_episodes") == used
    managed = episodes.managed_care_episodes(written.mc_episodes, written.insurance_map, SNAPSHOT, report.MANAGED_COLUMNS)
    counts = {"total_scheduled_visits", "total_completed_visits", "total_missed_visits"}
    assert _read(spark, managed, "mc_episodes") == {*report.MANAGED_COLUMNS, "updated_at"} | counts
    done = visits.clean_visits(written.visits, written.task_map, written.insurance_map, SNAPSHOT, visits.REPORT_COLUMNS)
    made = {"target_date", "medical_record_number", "time_in", "time_out", "patient_last", "task_name", "task_type"}
    assert _read(spark, done, "visits") == made | {"status", "insurance", "agency", "updated_at", "unique_visit_id"}
    assert "Window" in explained(done)


@pytest.mark.parametrize("columns", [["status"], ["mrn", "task_group"], ["provider_last", "payment_model", "total_hours"], list(visits.REPORT_COLUMNS)])
def test_narrow_versions_are_the_whole_ones(spark, written, columns):
    """Whatever columns are asked for, ties included, the rows are those of the full choice."""
    doubled = written.visits.unionByName(written.visits.withColumn("provider_last", F.lit("Z")).withColumn("status", F.reverse("status")))
    maps = written.task_map, written.insurance_map, SNAPSHOT
    whole = visits.clean_visits(doubled, *maps).select("unique_visit_id", *(c for c in columns if c != "unique_visit_id"))
    narrow = visits.clean_visits(doubled, *maps, columns=["unique_visit_id", *(c for c in columns if c != "unique_visit_id")])
    assert rows(narrow) == rows(whole)


def test_visit_rows_are_shuffled_once_for_proration(spark, no_broadcast):
    days = QUERIES["prorate_by_month"](spark, SF_DIR)
    plan = explained(days)
    wide = [line for line in plan.splitlines() if "Exchange" in line and "episode_identifier" in line]
    # The rows themselves, and the day counts made from them.
    assert len(wide) <= 3


def test_staged_tables_keep_their_schema_and_are_pruned(spark):
    df = spark.range(10).selectExpr("id", "CAST(id AS string) AS t", "id * 2 AS u")
    again = stage(df, "numbers")
    assert again.dtypes == df.dtypes
    assert again.count() == 10
    assert "ReadSchema: struct<u:bigint>" in explained(again.select("u"))
    assert staging_folder(spark).endswith(spark.sparkContext.applicationId)


class Elsewhere:
    """A session on a cluster, as far as staging looks at it."""

    applicationId, master = "app-1", "yarn"

    def __init__(self, settings, directory=None):
        self.settings = {"spark.sql.warehouse.dir": "hdfs://shared/house"} | settings
        self.conf = self.sparkContext = self
        self.directory = directory

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getCheckpointDir(self):  # noqa: N802
        return self.directory


def test_staged_tables_go_to_a_shared_folder():
    named = Elsewhere({"spark.checkpoint.dir": "hdfs://shared/tmp/"}, "hdfs://other")
    assert staging_folder(named) == "hdfs://shared/tmp/app-1"
    assert staging_folder(Elsewhere({}, "hdfs://set")) == "hdfs://set/app-1"
    assert staging_folder(Elsewhere({})) == "hdfs://shared/house/_staged/app-1"
    local = Elsewhere({"spark.sql.warehouse.dir": "file:/home/spark-warehouse"})
    with pytest.raises(ValueError):  # the executors would not see it
        staging_folder(local)
    local.master = "local[2]"
    assert staging_folder(local) == "file:/home/spark-warehouse/_staged/app-1"


def test_staging_removes_shuffles_and_its_own_files(spark, tmp_path):
    df = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert df.count() == 7
    mine = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert mine.exists()
    with temporary_tables(spark):
        inner = stage_all({"x": df.select("k"), "y": df.select("count")})
        places = [Path(t.inputFiles()[0].removeprefix("file://")).parent for t in inner]
        assert all(p.exists() for p in places)
    assert not any(p.exists() for p in places) and mine.exists()
    drop_staged(df)
    assert not mine.exists()
    with pytest.raises(AnalysisException):
        stage_all({"a": spark.range(3).select("id"), "b": spark.range(3).selectExpr("nothing")})


def test_the_report_reads_what_it_needs(spark, no_broadcast, monkeypatch):
    """Each staged step of the report: no pairing, history scanned once, wide rows moved once."""
    found = inputs(spark, SF_DIR)
    known = report.known_on(found, SNAPSHOT)
    fact = stage(report.price_visits(known, found), "revenue")
    paid = stage(report.paid_periods(claims.latest_claims(claims.allocate_first_claim(known.claims, fact))), "paid")
    plan = explained(report.open_receivables_by_day(fact, paid)).split("== Initial Plan")[0]
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    staged = [Path(f).parent.name.rsplit("-", 1)[0] for f in report.open_receivables_by_day(fact, paid).inputFiles()]
    assert set(staged) == {"revenue", "billed_days"}  # no table of billed ids
    standing = explained(claims.standing_claims(found.claims, SNAPSHOT))
    assert standing.count("FileScan") == 1


def test_the_report_prices_only_what_is_open(spark, no_broadcast, monkeypatch):
    """Episodes, shares and what is billed are found on days; no priced visits are written to look them up."""
    names, write = [], stage
    monkeypatch.setattr(report, "stage", lambda df, name: names.append(name) or write(df, name))
    found = report.staged_mappings(inputs(spark, SF_DIR))
    known = report.known_on(found, SNAPSHOT)
    got = report._open(known, found)
    assert names == ["patient_days", "paid_periods", "billed_days", "marked_days"]
    fact = stage(report.price_visits(known, found), "revenue")
    paid = stage(report.paid_periods(claims.latest_claims(claims.allocate_first_claim(known.claims, fact))), "paid")
    assert rows(got) == rows(report.open_receivables(fact, paid)) and got.count() > 500


def test_rate_cards_do_not_move_the_visits(spark):
    found = inputs(spark, SF_DIR)
    done = stage(visits.completed_visits(visits.tidy_visits(found.visits)).withColumn("payment_model", F.lit(None).cast("string")), "done")
    cards = stage(found.rate_cards, "cards")
    plan = explained(revenue.rate_card_revenue(done, cards))
    assert "hashpartitioning" not in plan and plan.count("FileScan") == 2
