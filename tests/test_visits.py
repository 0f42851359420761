from __future__ import annotations

import itertools
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.frames import at, day, explained, frame, rows
from visitledger.plans.visits import (
    REPORT_COLUMNS,
    attach_episode,
    billable_visits,
    blank_open,
    clean_visits,
    current_visits,
    joined_texts,
    packed,
    split_texts,
    text_runs,
    unpacked,
    visit_versions,
)
from visitledger.sources import schemas

D = date(2024, 3, 1)


def visit(ident: str | None, **changes) -> dict:
    base = {
        "unique_visit_id": ident,
        "updated_at": at("2024-02-01 10:00:00"),
        "target_date": day("2024-01-10"),
        "patient_last": "Doe",
        "medical_record_number": "1",
        "task_name": "SN Visit",
        "task_type": "SN",
        "provider_last": "Smith RN",
        "status": "Completed",
        "time_in": at("2024-01-10 09:00:00"),
        "time_out": at("2024-01-10 10:10:00"),
        "insurance": "Medicare",
        "agency": "North",
    }
    return base | changes


def clean(spark, visits, tasks=(), payers=()):
    return clean_visits(
        frame(spark, schemas.VISITS, visits),
        frame(spark, schemas.TASK_MAP, list(tasks)),
        frame(spark, schemas.INSURANCE_MAP, list(payers)),
        D,
    )


def test_versions(spark):
    visits = [
        visit("a", task_name="old", updated_at=at("2024-01-01 00:00:00")),
        visit("a", task_name="new"),
        visit("a", task_name="too late", updated_at=at("2024-03-01 00:00:00")),
        visit("only late", updated_at=at("2024-03-05 00:00:00")),
        visit("tie", status="B"),
        visit("tie", status="A"),
        visit(None, task_name="first without id", updated_at=at("2024-01-01 00:00:00")),
        visit(None, task_name="last without id"),
    ]
    got = rows(clean(spark, visits), "unique_visit_id", "task_name", "status")
    assert got == [
        (None, "last without id", "Completed"),
        ("a", "new", "Completed"),
        ("tie", "SN Visit", "A"),
    ]


def test_status_is_judged_on_the_newest_version(spark):
    visits = [
        visit("a"),
        visit("a", status="Missed Visit", updated_at=at("2024-02-02 00:00:00")),
    ]
    assert rows(clean(spark, visits)) == []


def test_filters(spark):
    visits = [
        visit("kept", status=" Completed "),
        visit("no status", status=None),
        visit("open", status=" Not Started (MV)"),
        visit("no type", task_type=None),
        visit("other type", task_type="DIET"),
        visit("trimmed type", task_type=" HHA\t"),
        visit("test", patient_last="ZZZZ"),
        visit("no name", patient_last=None),
    ]
    got = rows(clean(spark, visits), "unique_visit_id", "visit_type")
    assert got == [("kept", "Clinical"), ("trimmed type", "HHA")]


def test_columns(spark):
    visits = [visit("a", task_name="\tSN   Visit ", insurance=" Medicare ", time_in=None)]
    got = clean(spark, visits).select(
        "task_name", "insurance", "provider_last", "total_hours", "visit_date", "mrn"
    )
    assert rows(got) == [("SN  Visit", "Medicare", "Smith", None, day("2024-01-10"), "1")]


def test_repeated_mappings_do_not_repeat_visits(spark):
    tasks = [
        {"task_name": "SN Visit", "task_group": "b", "discipline_type": "x"},
        {"task_name": "SN Visit", "task_group": "a", "discipline_type": "y"},
    ]
    payers = [
        {"insurance": "Medicare", "office": "North", "parent_insurance": "q"},
        {"insurance": "Medicare", "office": "North", "parent_insurance": "p"},
        {"insurance": "Medicare", "office": "South", "parent_insurance": "o"},
    ]
    visits = [visit("a"), visit("b", insurance=None), visit("c", task_name="unknown")]
    got = rows(
        clean(spark, visits, tasks, payers),
        "unique_visit_id",
        "task_group",
        "discipline_type",
        "parent_insurance",
    )
    assert got == [("a", "a", "y", "p"), ("b", "a", "y", None), ("c", None, None, "p")]


def test_billable(spark):
    visits = frame(
        spark, "unique_visit_id string, task_name string", [
            {"unique_visit_id": "a", "task_name": "SN Visit"},
            {"unique_visit_id": "b", "task_name": "Chart"},
            {"unique_visit_id": "c"},
        ]
    )
    listed = frame(spark, "name string", [{"name": "Chart"}])
    with_null = frame(spark, "name string", [{"name": "Chart"}, {}])
    assert rows(billable_visits(visits, listed), "unique_visit_id") == [("a",)]
    assert rows(billable_visits(visits, with_null)) == []
    assert billable_visits(visits, listed.where("false")).count() == 3


def test_episode_of_a_visit(spark):
    columns = "unique_visit_id string, mrn string, agency string, visit_date date"
    visits = frame(
        spark,
        columns,
        [
            {"unique_visit_id": "two", "mrn": "1", "agency": "N", "visit_date": day("2024-01-20")},
            {"unique_visit_id": "same day", "mrn": "1", "agency": "N", "visit_date": day("2024-01-20")},
            {"unique_visit_id": "last day", "mrn": "1", "agency": "N", "visit_date": day("2024-02-29")},
            {"unique_visit_id": "none", "mrn": "1", "agency": "N", "visit_date": day("2024-03-01")},
            {"unique_visit_id": "other agency", "mrn": "1", "agency": "S", "visit_date": day("2024-01-20")},
            {"unique_visit_id": "no date", "mrn": "1", "agency": "N"},
        ],
    )
    episodes = frame(
        spark,
        "agency string, mrn string, episode_start_date date, episode_end_date date, episode_identifier string",
        [
            {"agency": "N", "mrn": "1", "episode_start_date": day("2024-01-15"), "episode_end_date": day("2024-02-29"), "episode_identifier": "late"},
            {"agency": "N", "mrn": "1", "episode_start_date": day("2024-01-01"), "episode_end_date": day("2024-01-31"), "episode_identifier": "early"},
            {"agency": "N", "mrn": "1", "episode_end_date": day("2024-12-31"), "episode_identifier": "no start"},
        ],
    )
    got = rows(attach_episode(visits, episodes), "unique_visit_id", "episode_identifier")
    assert got == [
        ("last day", "late"),
        ("no date", None),
        ("none", None),
        ("other agency", None),
        ("same day", "early"),
        ("two", "early"),
    ]


def test_open_versions_bring_only_what_is_compared(spark):
    """Ties of completed and open versions come out as among whole rows, which are no longer moved whole."""
    kinds = [("Completed", "SN"), ("Missed Visit", "SN"), ("Completed", "DIET"), (None, "SN"), ("Submitted", "SN"), ("Submitted", None)]
    found = [
        visit(f"{i}{j}", status=status, task_type=kind, insurance=insurance, patient_last=name)
        for i, a in enumerate(kinds)
        for j, b in enumerate(kinds)
        for (status, kind), insurance, name in ((a, "Z", "Y"), (b, "A", "ZZZZ"), (b, "A", "X"))
    ]
    maps = frame(spark, schemas.TASK_MAP, []), frame(spark, schemas.INSURANCE_MAP, [])
    df = frame(spark, schemas.VISITS, found)
    whole = current_visits(visit_versions(df, D), *maps)
    assert rows(clean_visits(df, *maps, D), *whole.columns) == rows(whole) != []
    versions = blank_open(df).where("status = 'Missed Visit'")
    assert set(versions.select("insurance", "patient_last", "time_in", "agency").distinct().collect()) == {(None, None, None, None)}


@pytest.mark.parametrize("zoned", [True, False])
def test_packed_versions_come_out_in_the_same_order(spark, zoned):
    """Times as distance from the day and surnames as their place: the choice among ties is that of the whole rows."""
    names = [None, "Again", "Abel", "Test", "Test1", "Test2", "ZZZZ", "Zz", "", "AAAA"]
    times = [None, at("2024-01-05 08:00:00.000001"), at("2023-12-31 23:59:59"), at("2024-03-10 02:30:00")]
    days = [day("2024-01-05"), None, day("0001-01-01")]
    rng = random.Random(5)
    found = [
        visit(str(rng.randrange(40)), target_date=rng.choice(days), time_in=rng.choice(times), time_out=rng.choice(times), patient_last=rng.choice(names))
        for _ in range(400)
    ]
    df = frame(spark, schemas.VISITS, found)
    if not zoned:
        df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("updated_at", "time_in", "time_out")})
    maps = frame(spark, schemas.TASK_MAP, []), frame(spark, schemas.INSURANCE_MAP, [])
    whole = current_visits(visit_versions(df, D), *maps)
    for columns in (REPORT_COLUMNS, (*REPORT_COLUMNS, "provider_last"), None):
        got = clean_visits(df, *maps, D, columns)
        assert rows(got) == rows(whole, *got.columns) != []
    small = dict(packed(df, ["time_in", "time_out", "patient_last"]).dtypes)
    assert small["patient_last"] == "int" and "timestamp" not in small["time_in"] + small["time_out"]
    again = unpacked(packed(df), df)
    assert again.dtypes == df.dtypes and rows(again) == rows(df)


def test_texts_that_move_as_one_keep_their_order(spark):
    """NULL, empty texts and the signs that mark their ends: the order is that of the texts one by one."""
    texts = [None, "", "\0", "\1", "\2", "\0\2", "\1\1", "\1\2", "\2\1", "a", "a\0", "a\1b", "ab", "a\uffff", "\U0001f600"]
    found = [visit(str(i), task_name=a, task_type=b, status=c) for i, (a, b, c) in enumerate(itertools.product(texts, texts, texts))]
    df = frame(spark, schemas.VISITS, found).select("unique_visit_id", "task_name", "task_type", "status")
    runs = text_runs(df, ["task_name", "status"])
    assert list(runs.values()) == [["task_name", "task_type", "status"]]
    joined = joined_texts(df, runs)
    assert len(joined.columns) == 2
    assert rows(split_texts(joined, runs), *df.columns) == rows(df)
    order = [F.col(c).asc_nulls_first() for c in runs["__texts0"]]
    plain = [r[0] for r in df.orderBy(*order).select("unique_visit_id").collect()]
    assert [r[0] for r in joined.orderBy("__texts0").select("unique_visit_id").collect()] == plain


def test_versions_move_their_texts_as_one(spark, no_broadcast):
    df = frame(spark, schemas.VISITS, [visit("a")])
    maps = frame(spark, schemas.TASK_MAP, []), frame(spark, schemas.INSURANCE_MAP, [])
    plan = explained(clean_visits(df, *maps, D, ["visit_date", "mrn", "task_name", "status", "insurance", "unique_visit_id"]))
    moved = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert moved and all("__texts" in line and "task_name" not in line and "insurance" not in line for line in moved)
