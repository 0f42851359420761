from __future__ import annotations

from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.frames import at, day, frame, rows
from tests.test_claims import claim
from tests.test_episodes import episode
from tests.test_visits import visit
from visitledger import constants as k
from visitledger.operators import aged_detail, ageing_matrix, date_bounds, in_date_range, open_total
from visitledger.plans import report
from visitledger.plans.report import dashboard, open_receivables, open_report, open_reports, paid_periods
from visitledger.sources import schemas, staging
from visitledger.sources.tables import (
    SCHEMAS,
    Inputs,
    read_catalog_inputs,
    read_detail,
    read_parquet_inputs,
    write_detail,
)

D = date(2024, 3, 1)
TODAY = date(2024, 3, 31)
BUCKETS = [name for name, _, _ in k.AGE_BUCKETS]


def revenue(spark, *found):
    base = {"mrn": "1", "agency": "N", "insurance": "M", "visit_date": day("2024-01-05"), "revenue": 10.0}
    return frame(spark, schemas.REVENUE, [base | r for r in found])


def paid(spark, *found):
    return paid_periods(frame(spark, schemas.CLAIMS, list(found)))


def test_open_receivables(spark):
    rows_in = revenue(
        spark,
        {"unique_id": "billed"},
        {"unique_id": "open", "visit_date": day("2024-02-05")},
        {"unique_id": "twice", "visit_date": day("2024-02-05")},
        {"unique_id": "twice", "visit_date": day("2024-02-05"), "revenue": 11.0},
        {"unique_id": "private", "visit_date": day("2024-02-05"), "insurance": "Private Pay"},
        {"unique_id": "no payer", "visit_date": day("2024-02-05"), "insurance": None},
        {"unique_id": None, "visit_date": day("2024-02-05")},
    )
    got = open_receivables(rows_in, paid(spark, claim("c")))
    assert got.columns == schemas.OPEN_RECEIVABLES.names
    assert rows(got, "unique_id", "open_amount") == [("open", 10.0), ("twice", 10.0), ("twice", 11.0)]


def test_nothing_billed_keeps_rows_without_id(spark):
    rows_in = revenue(spark, {"unique_id": None}, {"unique_id": "a"})
    unpaid = paid(spark, claim("c", anticipated_payment=None))
    assert open_receivables(rows_in, unpaid).count() == 2


def test_billed_row_without_id_empties_the_report(spark):
    rows_in = revenue(spark, {"unique_id": None}, {"unique_id": "a", "visit_date": day("2024-02-05")})
    assert open_receivables(rows_in, paid(spark, claim("c"))).count() == 0


AGED = "who string, d date, amount double"


def aged(spark):
    ages = {-1: 1.0, 0: 2.0, 30: 4.0, 31: 8.0, 365: 16.0, 366: 32.0}
    found = [{"who": "a", "d": date.fromordinal(TODAY.toordinal() - n), "amount": v} for n, v in ages.items()]
    found += [
        {"who": "b", "d": day("2024-03-01")},
        {"who": None, "d": day("2024-03-01"), "amount": 64.0},
        {"who": "a", "amount": 128.0},
    ]
    return frame(spark, AGED, found)


def test_ageing_matrix(spark):
    got = ageing_matrix(aged(spark), "who", "d", "amount", TODAY)
    assert got.columns == ["who", *BUCKETS, "Row_Total"]
    a = ("a", 6.0, 8.0, 0.0, 0.0, 0.0, 0.0, 0.0, 16.0, 32.0, 62.0)
    b = ("b", *[0.0] * 10)
    assert [tuple(r) for r in got.collect()] == [a, b, ("Column_Total", *a[1:])]


def test_total_counts_what_the_matrix_leaves_out(spark):
    assert rows(open_total(aged(spark), "amount")) == [(255.0,)]
    assert rows(open_total(aged(spark).where("false"), "amount")) == [(0.0,)]
    assert rows(open_total(aged(spark).where("who = 'b'"), "amount")) == [(0.0,)]


def test_aged_detail_and_range(spark):
    detail = aged_detail(aged(spark), "d", "amount", TODAY)
    future = detail.where("days_difference < 0").collect()[0]
    assert [future[b] for b in BUCKETS] == [0.0] * 9
    assert rows(date_bounds(aged(spark), "d")) == [(day("2023-03-31"), day("2024-04-01"))]
    inside = in_date_range(aged(spark), "d", day("2024-02-29"), day("2024-03-01"))
    assert rows(inside, "amount") == [(None,), (4.0,), (8.0,), (64.0,)]


def small_inputs(spark) -> Inputs:
    """Two patients; what is open is worked out by hand below."""
    payers = [
        {"insurance": "Medicare", "office": "North", "payment_model": k.EPISODIC, "payment_multiplier": 1.0},
        {"insurance": "Cash Co", "office": "North", "payment_model": k.PER_VISIT, "payment_multiplier": 1.0},
    ]
    later = {"time_in": at("2024-02-05 09:00:00"), "time_out": at("2024-02-05 10:10:00")}
    tables = {
        "visits": [
            visit("v1"),
            visit("v2", task_type="PT"),
            visit("v3", target_date=day("2024-02-05")),
            visit("v4", medical_record_number="2", insurance="Cash Co", target_date=day("2024-02-05"), **later),
            visit("v5", medical_record_number="2", insurance="Private Pay"),
            visit("v6", task_name="Chart"),
            visit("v7", task_name="Transfer Summary"),
            visit("v8", status="Missed Visit"),
        ],
        "pdgm_episodes": [
            episode("X1", anticipated_30_day_payment=3000.0),
            episode(
                "X2.1",
                episode_start_date=day("2024-01-01"),
                billing_period_start_date=day("2024-01-31"),
                billing_period_end_date=day("2024-02-29"),
                eoe_anticipated_payment=2000.0,
            ),
        ],
        "mc_episodes": [],
        "claims": [claim("c1", agency="North"), claim("c2", agency="North", start="2024-02-01", end="2024-02-28", anticipated_payment=None)],
        "task_map": [{"task_name": "SN Visit", "task_group": "g", "discipline_type": "d"}],
        "insurance_map": payers,
        "non_billable_tasks": [{"task_name": "Chart"}],
        "rate_cards": [
            {"insurer": "Cash Co", "task_name": "SN Visit", "location": "north", "type": "Hourly", "rate": 50.0, "from_date": day("2024-01-01"), "to_date": day("9999-12-31")}
        ],
        "pdgm_flags": [{"office": "North", "insurance": "Medicare", "pdgm_non_pdgm": "PDGM"}],
        "revenue_exceptions": [],
    }
    return Inputs(**{n: frame(spark, SCHEMAS[n], tables[n]) for n in Inputs._fields})


# v1 and v2 are billed by c1; v3 earns 2000 / 4 in the closed period X2, and c2
# does not bill it because its payment is unknown; v4 is 1.25 h at 50.
EXPECTED = [
    ("v3", 500.0, "X2", "E1", "PDGM", "g"),
    ("v4", 62.5, None, None, "Non PDGM", "g"),
]
COLUMNS = ("unique_id", "open_amount", "billing_period_id", "episode_identifier", "pdgm_non_pdgm", "task_group")


def test_whole_report(spark):
    report = open_report(small_inputs(spark), D)
    assert rows(report, *COLUMNS) == EXPECTED
    shown = dashboard(report, TODAY)
    assert rows(shown.total) == [(562.0,)]
    assert len(shown.detail.columns) == 46
    line = [0.0, 562.0, *[0.0] * 7, 562.0]
    assert [list(r) for r in shown.by_agency.collect()] == [["North", *line], ["Column_Total", *line]]
    assert rows(shown.by_insurance, "insurance", "Row_Total") == [
        ("Cash Co", 62.0),
        ("Column_Total", 562.0),
        ("Medicare", 500.0),
    ]
    none = dashboard(report, TODAY, day("2024-02-06"))
    assert rows(none.total) == [(0.0,)]


def test_before_the_first_record_nothing_is_known(spark):
    assert open_report(small_inputs(spark), date(2024, 2, 1)).count() == 0


def test_row_order_and_partitions_do_not_matter(spark):
    shuffled = Inputs(*[df.repartition(5, F.rand(7)) for df in small_inputs(spark)])
    assert rows(open_report(shuffled, D), *COLUMNS) == EXPECTED


def test_reading_and_writing(spark, tmp_path):
    inputs = small_inputs(spark)
    for name, df in inputs._asdict().items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    again = read_parquet_inputs(spark, str(tmp_path))
    for name, df in again._asdict().items():
        assert df.schema == SCHEMAS[name]
        assert rows(df.select(*df.columns[:1])) == rows(inputs._asdict()[name].select(*df.columns[:1]))
        df.createOrReplaceTempView(f"in_{name}")
    named = read_catalog_inputs(spark, {n: f"in_{n}" for n in Inputs._fields})
    assert named.visits.count() == inputs.visits.count()

    write_detail(inputs.claims, f"{tmp_path}/out.parquet")
    write_detail(inputs.claims, f"{tmp_path}/out.csv", "csv")
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 2
    assert spark.read.csv(f"{tmp_path}/out.csv", header=True).columns == inputs.claims.columns
    with pytest.raises(ValueError):
        write_detail(inputs.claims, f"{tmp_path}/out.x", "xlsx")


_ODD = ["", None, " ", " a ", '"', '""', 'a "b", c', "two\nlines", "cr\rhere", "\\", '\\"', "a,b", "é你🎉", "null", "\t", "#x"]


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_export_keeps_types_and_texts(spark, tmp_path, form):
    schema = "t string, n bigint, x double, d date, at timestamp, naive timestamp_ntz, m decimal(12,3), b boolean, u string"
    made = [
        (t, i - 3, [0.1, 1e300, -0.0, float("inf"), 1 / 3][i % 5], date(1, 1, 1) if i else None, datetime(2024, 1, 2, 3, 4, 5, 678901), datetime(1969, 12, 31, 23, 59, 59, 1), None, i % 2 == 0, _ODD[-i])
        for i, t in enumerate(_ODD)
    ]
    df = spark.createDataFrame(made, schema).withColumn("m", F.col("n").cast("decimal(12,3)") / 7)
    path = f"{tmp_path}/out"
    write_detail(df.limit(2), path, form)
    write_detail(df.repartition(3), path, form)
    again = read_detail(spark, path)
    assert again.schema.simpleString() == df.schema.simpleString()
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, df.collect()))
    write_detail(df.limit(0), path, form)
    assert read_detail(spark, path).count() == 0 and read_detail(spark, path).dtypes == df.dtypes
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception):  # noqa: B017
        write_detail(df.withColumn("t", F.raise_error(F.lit("no"))), path, form)
    assert read_detail(spark, path).count() == 0  # the former export is still there


def test_csv_holds_no_nested_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        write_detail(spark.range(1).select(F.array("id").alias("a")), f"{tmp_path}/out", "csv")


def test_reports_of_days_are_the_single_reports(spark):
    """Several days, one of them twice, from one scan of the history."""
    inputs = small_inputs(spark)
    days = [date(2024, 1, 20), date(2024, 2, 20), D]
    got = rows(open_reports(inputs, [*days, D]), "snapshot", *COLUMNS)
    assert got == [(d, *r) for d in days for r in rows(open_report(inputs, d), *COLUMNS)] and got


def test_mappings_are_staged_once_for_all_days(spark, monkeypatch):
    """Spark knows their size then, and the visits need not move to meet them; known claims are not written again."""
    names, write = [], staging.stage
    for place in (staging, report):
        monkeypatch.setattr(place, "stage", lambda df, name: names.append(name) or write(df, name))
    open_reports(small_inputs(spark), [date(2024, 1, 20), D])
    for name in ("task_map", "insurance_map", "non_billable_tasks", "rate_cards", "pdgm_flags", "claim_history"):
        assert names.count(name) == 1, name
    assert names.count("visits") == 2 and "claims" not in names and "managed" not in names
