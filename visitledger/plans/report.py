"""The report: what is not billed yet, as known on a chosen day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger import constants as k
from visitledger.functions import half_even
from visitledger.operators import (
    aged_detail,
    ageing_matrix,
    cover_semi,
    drop_excluded,
    in_date_range,
    null_aware_anti,
    open_total,
)
from visitledger.operators.exclusion import exclusion_state
from visitledger.operators.intervals import covered_days, covered_points, join_hits, point_rows
from visitledger.operators.keys import known_on_day
from visitledger.plans.claims import (
    CLAIM_COLUMNS,
    CLAIM_EQ,
    PERIOD,
    drop_advance_claims,
    latest_claims,
    standing_claims,
    surviving_claims,
)
from visitledger.plans.episodes import (
    billing_periods,
    current_managed,
    current_pdgm,
    episode_set,
    managed_care_episodes,
    managed_spans,
    pdgm_episodes,
    pdgm_spans,
)
from visitledger.plans.revenue import (
    EPISODE_EQ,
    episodic_payers,
    per_visit_payers,
    priced_visits,
    prorated_days,
    rate_card_revenue,
    revenue_fact,
    with_exceptions,
)
from visitledger.plans.visits import (
    PATIENT_EQ,
    REPORT_COLUMNS,
    attach_days,
    billable_visits,
    blank_open,
    clean_visits,
    current_visits,
    day_episodes,
    map_visits,
    visit_spans,
    visit_type,
)
from visitledger.sources.schemas import OPEN_RECEIVABLES
from visitledger.sources.staging import stage, stage_all
from visitledger.sources.tables import Inputs


def paid_periods(claims: DataFrame) -> DataFrame:
    """Patient, agency and period of the claims with a known payment."""
    paid = claims.where(F.col("anticipated_payment").isNotNull())
    return paid.select("mrn", "agency", *PERIOD.values())


def billed_visits(revenue: DataFrame, paid: DataFrame) -> DataFrame:
    """Revenue rows whose day lies in a paid period of the patient and agency."""
    return cover_semi(revenue, paid, CLAIM_EQ, "visit_date", **PERIOD)


def open_receivables(revenue: DataFrame, paid: DataFrame) -> DataFrame:
    """Revenue rows not billed in any of the `paid` periods, private payers out.

    The exclusion is by visit id with SQL's NOT IN rules: a billed row without
    an id empties the result, and an id that is billed on one day is out on all.
    `revenue` is read more than once: stage it first.
    """
    billed = billed_visits(revenue, paid).select("unique_id")
    return _open_columns(null_aware_anti(revenue, billed, "unique_id", "unique_id"))


def open_receivables_by_day(revenue: DataFrame, paid: DataFrame) -> DataFrame:
    """The same where all rows of an id share patient, agency and day, as in the report.

    An id is then billed exactly if its day is, so the wide rows move once, on
    patient, agency and day, and no table of billed ids is made.
    """
    covered = stage(covered_points(revenue, paid, CLAIM_EQ, "visit_date", **PERIOD), "billed_days")
    kept = revenue.where(_may_stay(revenue, covered, "unique_id"))
    return _open_columns(kept.join(covered, _DAY, "left_anti"))


_DAY = [*(c for c, _ in CLAIM_EQ), "visit_date"]


def _may_stay(rows: DataFrame, covered: DataFrame, ident: str) -> Column:
    """SQL's NULL rules for `ident` NOT IN the ids of the rows whose day is `covered`."""
    nameless = rows.where(F.col(ident).isNull()).join(covered, _DAY, "left_semi")
    days = covered.select(F.lit(False).alias("missing"))
    state = exclusion_state(days.union(nameless.select(F.lit(True).alias("missing"))))
    return (state == "empty") | ((state == "keys") & F.col(ident).isNotNull())


def _open_columns(rows: DataFrame) -> DataFrame:
    open_rows = drop_excluded(rows, "insurance", k.PRIVATE_PAYERS)
    return open_rows.withColumn("open_amount", F.col("revenue")).select(*OPEN_RECEIVABLES.fieldNames())


PERIOD_COLUMNS = (
    "agency",
    "mrn",
    "episode_start_date",
    "episode_end_date",
    "unique_id",
    "episode_identifier",
    "billing_period_start_date",
    "billing_period_end_date",
    "billing_period",
    "anticipated_30_day_payment",
    "eoe_anticipated_payment",
    "payment_multiplier",
    "total_scheduled_visits",
    "total_completed_visits",
    "lupa_level",
    "eoe_date",
)


# What visits bring to the price; what mappings add besides, and is not needed before, is looked up there.
VISIT_COLUMNS = tuple(
    c
    for c in REPORT_COLUMNS
    if c not in ("visit_type", "task_group", "discipline_type", "parent_insurance", "insurance_type")
)

MANAGED_COLUMNS = ("agency", "mrn", "episode_start_date", "episode_end_date", "unique_id")


class Known(NamedTuple):
    """What was known on the day, each table reduced to what the report uses: of billable visits those with a price."""

    pdgm: DataFrame
    managed: DataFrame
    visits: DataFrame
    claims: DataFrame


def known_on(inputs: Inputs, day: date) -> Known:
    """Stage the four tables that feed several branches of the report.

    Raw history is scanned and ranked once, and only the columns the branches
    need are read and written.
    """
    return _stage_known(
        pdgm_episodes(inputs.pdgm_episodes, inputs.insurance_map, day, PERIOD_COLUMNS),
        managed_care_episodes(inputs.mc_episodes, inputs.insurance_map, day, MANAGED_COLUMNS),
        with_exceptions(
            priced_visits(
                billable_visits(
                    clean_visits(inputs.visits, inputs.task_map, inputs.insurance_map, day, VISIT_COLUMNS),
                    inputs.non_billable_tasks,
                )
            ),
            inputs.revenue_exceptions,
        ),
        standing_claims(inputs.claims, day),
    )


def _stage_known(pdgm: DataFrame, managed: DataFrame, visits: DataFrame, claims: DataFrame) -> Known:
    frames = {
        "pdgm": pdgm,
        "managed": managed,
        "visits": visits,
        "claims": claims.select(*CLAIM_COLUMNS),
    }
    return _known(*stage_all(frames))


def _known(pdgm: DataFrame, managed: DataFrame, visits: DataFrame, claims: DataFrame) -> Known:
    return Known(pdgm, managed, visits, drop_advance_claims(claims))


class History(NamedTuple):
    """What the report needs of all versions, with the days on which each is the newest."""

    pdgm: DataFrame
    managed: DataFrame
    visits: DataFrame
    claims: DataFrame


def history(inputs: Inputs, days: Sequence[date] | None = None) -> History:
    """Scan and rank the history once, for reports of any number of days, or of `days` alone."""
    visits = visit_spans(blank_open(inputs.visits), REPORT_COLUMNS, days)
    frames = {
        "pdgm_history": pdgm_spans(inputs.pdgm_episodes, PERIOD_COLUMNS, days),
        "managed_history": managed_spans(inputs.mc_episodes, MANAGED_COLUMNS, days),
        "visit_history": with_exceptions(visits, inputs.revenue_exceptions),
        "claim_history": inputs.claims.select(*CLAIM_COLUMNS),
    }
    return History(*stage_all(frames))


def known_from(past: History, inputs: Inputs, day: date) -> Known:
    """`known_on` from a staged history: a range lookup for each table.

    Managed-care episodes and claims are filtered rows of the history, and are read
    from it wherever they are used; the others are staged.
    """
    visits = current_visits(
        known_on_day(past.visits, day), inputs.task_map, inputs.insurance_map, (*VISIT_COLUMNS, "new_revenues")
    )
    frames = {
        "pdgm": current_pdgm(known_on_day(past.pdgm, day), inputs.insurance_map, PERIOD_COLUMNS),
        "visits": priced_visits(billable_visits(visits, inputs.non_billable_tasks)),
    }
    pdgm, visits = stage_all(frames)
    managed = current_managed(known_on_day(past.managed, day), inputs.insurance_map, MANAGED_COLUMNS)
    return _known(pdgm, managed, visits, standing_claims(past.claims, day))


def price_visits(known: Known, inputs: Inputs) -> DataFrame:
    """The revenue fact: every known billable visit, priced."""
    chosen = _placed(known, stage(patient_days(known.visits), "patient_days"))
    return _priced(known.visits, stage(chosen, "placed_days"), billing_periods(known.pdgm), inputs)


def patient_days(visits: DataFrame) -> DataFrame:
    """Patient, agency and day of the visits, with how many are paid by episode; visits without one of the three are left out."""
    episodic = F.count_if(F.col("payment_model") == k.EPISODIC)
    return visits.dropna(subset=_DAY).groupBy(*_DAY).agg(episodic.alias("episodic_visits"))


def _placed(known: Known, days: DataFrame) -> DataFrame:
    """The patient days inside an episode, with the first one."""
    points = point_rows(days, PATIENT_EQ, "visit_date", ["episodic_visits"])
    return day_episodes(points, episode_set(known.pdgm, known.managed))


def _priced(visits: DataFrame, days: DataFrame, periods: DataFrame, inputs: Inputs) -> DataFrame:
    """Visits priced by rate card or as a share of their episode's payments.

    `days` brings the episode of a patient, agency and day. Shares are worked out
    on days alone, so visits move once, to meet all that their day brings. Those
    of days that are `billed` go.
    """
    inside = days.where(F.col("episode_identifier").isNotNull() & (F.col("episodic_visits") > 0))
    counts = inside.groupBy(F.col("episode_identifier").alias("__k0"), F.col("visit_date").alias("__at"))
    shares = prorated_days(counts.agg(F.sum("episodic_visits").alias("day_visits")), periods)

    def met(rows: DataFrame, known_days: DataFrame) -> DataFrame:
        # what follows from task and payer does not move
        found = attach_days(rows.drop("payment_model"), known_days.drop("episodic_visits"))
        if "billed" in days.columns:
            found = found.where(F.col("billed").isNull()).drop("billed")
        return map_visits(found.withColumn("visit_type", visit_type("task_type")), inputs.task_map, inputs.insurance_map)

    return revenue_fact(
        rate_card_revenue(met(per_visit_payers(visits), days), inputs.rate_cards),
        met(episodic_payers(visits), join_hits(days, shares, EPISODE_EQ, "visit_date")),
        inputs.pdgm_flags,
    )


def open_report(inputs: Inputs, day: date) -> DataFrame:
    """All receivables open as known before `day`: one row per priced visit.

    Only visits, episodes and claims are rolled back to `day`; mappings and rate
    cards are used as they are now. The earliest recorded day itself gives an
    empty report, because nothing was known before it.
    """
    inputs = staged_mappings(inputs)
    return _open(known_on(inputs, day), inputs)


_MAPPINGS = ("task_map", "insurance_map", "non_billable_tasks", "rate_cards", "pdgm_flags")


def staged_mappings(inputs: Inputs) -> Inputs:
    """The mappings and rate cards written once: several steps, and all days, read them.

    Spark then knows their size, so the visits do not move to meet small ones.
    """
    staged = stage_all({name: getattr(inputs, name) for name in _MAPPINGS})
    return inputs._replace(**dict(zip(_MAPPINGS, staged)))


def open_reports(inputs: Inputs, days: Sequence[date]) -> DataFrame:
    """The reports of several days, with the day as `snapshot`.

    The history is scanned and ranked once and staged with the days on which each
    version was the newest; every report then looks its versions up by day. Each
    report is staged, so the plan does not grow with the number of days.
    """
    past = history(inputs, days)
    inputs = staged_mappings(inputs)
    reports = [
        stage(_open(known_from(past, inputs, day), inputs).withColumn("snapshot", F.lit(day)), "report")
        for day in dict.fromkeys(days)
    ]
    return reduce(DataFrame.unionByName, reports)


def _open(known: Known, inputs: Inputs) -> DataFrame:
    """`open_receivables` of `price_visits`, with what is billed found on patient days, before visits are priced.

    All rows of an id share patient, agency and day, so an id is billed exactly if
    its day is: see `open_receivables_by_day`. The days of the priced visits are
    all that claims are allocated to.
    """
    visits = known.visits
    days = stage(patient_days(visits), "patient_days")
    paid = stage(paid_periods(latest_claims(surviving_claims(known.claims, days))), "paid_periods")
    points = point_rows(days, CLAIM_EQ, "visit_date", [])
    covered = stage(covered_days(points, paid, CLAIM_EQ, "visit_date", **PERIOD), "billed_days")
    billed = covered.withColumn("billed", F.lit(True))
    marked = stage(_placed(known, days).join(billed, _DAY, "full"), "marked_days")
    kept = visits.where(_may_stay(visits, covered, "unique_visit_id"))
    return _open_columns(_priced(kept, marked, billing_periods(known.pdgm), inputs))


class Dashboard(NamedTuple):
    """What the report page shows."""

    detail: DataFrame
    total: DataFrame
    by_agency: DataFrame
    by_insurance: DataFrame


def whole_amounts(report: DataFrame) -> DataFrame:
    """Amounts rounded to whole units, halves to even, before any sum."""
    return report.withColumn("open_amount", half_even("open_amount"))


def dashboard(
    report: DataFrame, today: date, start: date | None = None, end: date | None = None
) -> Dashboard:
    """Total, ageing tables and aged detail of a report.

    Without `start` and `end` the range is the first to the last visit date,
    which still leaves out rows without one. The report is staged because four
    results come out of it.
    """
    rows = whole_amounts(report)
    if start is None and end is None:
        rows = rows.where(F.col("visit_date").isNotNull())
    else:
        rows = in_date_range(rows, "visit_date", start or date.min, end or date.max)
    rows = stage(rows, "report")
    return Dashboard(
        detail=aged_detail(rows, "visit_date", "open_amount", today),
        total=open_total(rows, "open_amount"),
        by_agency=ageing_matrix(rows, "agency", "visit_date", "open_amount", today),
        by_insurance=ageing_matrix(rows, "insurance", "visit_date", "open_amount", today),
    )
