"""Schemas of the ten input tables and of the results."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

_TYPES = {
    "string": StringType(),
    "date": DateType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "timestamp": TimestampType(),
}


def _schema(*parts: tuple[str, str]) -> StructType:
    """Build a schema from (type, "name name ..") pairs; all columns nullable."""
    schema = StructType()
    for kind, names in parts:
        for name in names.split():
            schema.add(name, _TYPES[kind])
    return schema


def every_column(schema: StructType, first: tuple[str, ...], *without: str) -> tuple[str, ...]:
    """`first` and then all other columns of `schema` but `without`."""
    return (*first, *(c for c in schema.fieldNames() if c not in first and c not in without))


VISITS = _schema(
    ("string", "unique_visit_id"),
    ("timestamp", "updated_at"),
    ("date", "target_date"),
    ("string", "patient_last patient_first medical_record_number phone"),
    ("string", "task_name task_type provider_last provider_first status"),
    ("timestamp", "time_in time_out"),
    ("double", "documentation_time_min travel_time_min"),
    ("string", "address city state zip_code insurance"),
    ("double", "productivity_units mileage"),
    ("string", "employee_id agency"),
)

PDGM_EPISODES = _schema(
    ("string", "unique_id episode_identifier patient_last_name patient_first_name mrn"),
    ("string", "medicare_ branch clinic physician_last_name physician_first_name suffix"),
    ("date", "dob soc_date episode_start_date episode_end_date"),
    ("date", "billing_period_start_date billing_period_end_date first_billable_visit"),
    ("date", "rap_date rap_payment_date take_back_date eoe_date eoe_payment_date"),
    ("date", "referral_date"),
    ("bigint", "billing_period total_scheduled_visits total_completed_visits"),
    ("bigint", "total_missed_visits sn pt ot st hha msw total_therapy_visits"),
    ("bigint", "lupa_level number_of_outstanding_orders"),
    ("string", "primary_diagnosis diagnosis_description initial_hipps"),
    ("string", "admission_source admission_timing clinical_grouping"),
    ("string", "functional_level comorbidity_level pcr_tracking_number"),
    ("string", "referral_sources insurance patient_address patient_city zip_code"),
    ("string", "oasis_type cbsa fips_code agency"),
    ("double", "case_mix_weight wage_index anticipated_30_day_payment rural_add_on"),
    ("double", "lupa_add_on lupa_payment outlier sequester charge"),
    ("double", "rap_anticipated_payment rap_payment eoe_anticipated_payment eoe_payment"),
    ("timestamp", "updated_at"),
)

MC_EPISODES = _schema(
    ("string", "unique_id patient_last_name patient_first_name mrn policy_ branch"),
    ("string", "clinic insurance zip_code physician_last_name physician_first_name"),
    ("string", "agency"),
    ("date", "dob soc_date episode_start_date episode_end_date last_payment_date"),
    ("bigint", "total_scheduled_visits total_completed_visits total_missed_visits"),
    ("bigint", "total_orphan_visits sn pt ot st hha msw"),
    ("double", "total_allowed total_charges total_payments"),
    ("timestamp", "updated_at"),
)

CLAIMS = _schema(
    ("string", "unique_claim_id patient_name mrn claim_number claim_status tob"),
    ("string", "insurance payer_type branch medicare_subscriber_number agency"),
    ("date", "billed_date billing_period_start_date billing_period_end_date"),
    ("double", "anticipated_payment"),
    ("timestamp", "updated_at"),
)

TASK_MAP = _schema(("string", "task_name task_group discipline_type"))

INSURANCE_MAP = _schema(
    ("string", "insurance office parent_insurance insurance_type payment_model"),
    ("double", "payment_multiplier"),
)

NON_BILLABLE_TASKS = _schema(("string", "task_name"))

RATE_CARDS = _schema(
    ("string", "insurer task_name location type"),
    ("date", "from_date to_date"),
    ("double", "rate"),
)

PDGM_FLAGS = _schema(("string", "office insurance pdgm_non_pdgm"))

REVENUE_EXCEPTIONS = _schema(("string", "unique_id"), ("double", "new_revenue"))

REVENUE = _schema(
    ("string", "mrn unique_id"),
    ("date", "episode_start_date episode_end_date"),
    ("string", "episode_identifier"),
    ("date", "billing_period_start_date billing_period_end_date revenue_date"),
    ("string", "billing_period_id"),
    ("double", "revenue closed_revenue ongoing_revenue"),
    ("string", "payment_model parent_insurance insurance_type insurance agency"),
    ("timestamp", "updated_at"),
    ("bigint", "billing_period_days_in_month"),
    ("double", "prorate_percent"),
    ("bigint", "total_scheduled_visits total_completed_visits lupa_level"),
    ("date", "eoe_date"),
    ("string", "task_name status"),
    ("date", "visit_date"),
    ("string", "task_type"),
    ("double", "hours_worked"),
    ("string", "visit_type task_group discipline_type rate_type"),
    ("double", "rate"),
    ("string", "pdgm_non_pdgm"),
)

# The report: the revenue columns with the open amount before the PDGM flag.
OPEN_RECEIVABLES = StructType(
    [*REVENUE.fields[:-1]]
).add("open_amount", DoubleType()).add(REVENUE["pdgm_non_pdgm"])
