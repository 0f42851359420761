"""What must hold on any data, checked on the derived inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from visitledger import constants as k
from visitledger.operators import ageing_matrix, open_total
from visitledger.plans.claims import allocate_first_claim, latest_claims
from visitledger.plans.report import (
    billed_visits,
    known_on,
    open_receivables,
    paid_periods,
    price_visits,
    whole_amounts,
)
from visitledger.session import cluster_settings
from visitledger.sources.staging import stage
from workload.roles import SNAPSHOT, TODAY, inputs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    found = inputs(spark, SF_DIR)
    known = known_on(found, SNAPSHOT)
    revenue = stage(price_visits(known, found), "revenue")
    allocated = stage(allocate_first_claim(known.claims, revenue), "allocated")
    paid = stage(paid_periods(latest_claims(allocated)), "paid")
    return known, revenue, allocated, paid, stage(open_receivables(revenue, paid), "open")


def test_every_priced_visit_is_open_or_billed(results):
    _, revenue, _, paid, still_open = results
    billed = billed_visits(revenue, paid)
    private = ~F.col("insurance").isin(*k.PRIVATE_PAYERS)
    assert 0 < billed.count() < revenue.count()
    both = billed.where(private).count() + still_open.count()
    assert both == revenue.where(private).count()
    assert billed.join(still_open, "unique_id", "left_semi").count() == 0


def test_a_day_is_credited_once(results):
    known, revenue, allocated, _, _ = results
    days = revenue.select("mrn", "agency", "visit_date", "unique_id", "revenue")
    first = days.groupBy("mrn", "agency", "visit_date").agg(
        F.min_by("revenue", F.struct("unique_id", "revenue")).alias("revenue")
    )
    claims = known.claims.select(
        "mrn", "agency", "billing_period_start_date", "billing_period_end_date"
    ).distinct()
    covered = first.join(claims, ["mrn", "agency"]).where(
        "visit_date BETWEEN billing_period_start_date AND billing_period_end_date"
    )
    credit = covered.select("mrn", "agency", "visit_date", "revenue").distinct()
    total = credit.agg(F.sum("revenue")).collect()[0][0]
    assert allocated.agg(F.sum("expected_revenue")).collect()[0][0] == pytest.approx(total)


def test_no_visit_is_lost_or_made_up(results):
    known, revenue, _, _, _ = results
    assert revenue.select("unique_id").distinct().count() <= known.visits.count()
    made_up = revenue.join(
        known.visits, revenue["unique_id"] == known.visits["unique_visit_id"], "left_anti"
    )
    assert made_up.count() == 0


@pytest.mark.parametrize("key", ["agency", "insurance"])
def test_matrix_adds_up(results, key):
    report = whole_amounts(results[-1])
    matrix = ageing_matrix(report, key, "visit_date", "open_amount", TODAY).collect()
    for column in range(1, len(matrix[0])):
        assert sum(r[column] for r in matrix[:-1]) == matrix[-1][column]
    past = report.where(F.col("visit_date") <= F.lit(TODAY)).where(F.col(key).isNotNull())
    assert matrix[-1]["Row_Total"] == open_total(past, "open_amount").collect()[0][0]


def test_cluster_settings_grow_with_the_data():
    name = "spark.sql.shuffle.partitions"
    assert cluster_settings(0)[name] == "200"
    assert cluster_settings(10 * 1024**4)[name] == "81920"
    assert cluster_settings(100 * 1024**4)[name] == "819200"
