"""The driver's star tables cast in the roles of the report's ten inputs.

Orders become episodes and claims, line items visits, and the mapping and rate
tables are derived from orders and parts. The texts are plain SQL that Spark and
DuckDB read alike, so both sides of a check start from the same rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from visitledger.sources.tables import SCHEMAS, Inputs, conform

# The day the report is asked for, and the day it is aged to. Some visits are
# dated later than either.
SNAPSHOT = date(2001, 1, 1)
TODAY = date(2000, 11, 15)
# Days for reports from one scan: before everything, two in the middle, and the one above.
REPORT_DAYS = (date(1990, 1, 1), date(1997, 5, 3), date(1999, 12, 31), SNAPSHOT)

_AGENCY = """CASE o_custkey % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'South' ELSE 'East' END"""
_TASK = """CASE {k} % 10 WHEN 0 THEN 'SN Visit' WHEN 1 THEN ' PT  Visit ' WHEN 2 THEN 'OT Visit'
    WHEN 3 THEN 'ST Visit' WHEN 4 THEN 'MSW Visit' WHEN 5 THEN 'HHA Visit'
    WHEN 6 THEN 'Aide Care Plan' WHEN 7 THEN 'Discharge Summary' WHEN 8 THEN 'Chart Review'
    ELSE 'SN   Visit' END"""
_TASK_CLEAN = """CASE {k} % 7 WHEN 0 THEN 'SN Visit' WHEN 1 THEN 'PT Visit' WHEN 2 THEN 'OT Visit'
    WHEN 3 THEN 'ST Visit' WHEN 4 THEN 'MSW Visit' WHEN 5 THEN 'HHA Visit' ELSE 'SN  Visit' END"""

ROLES = {
    "visits": f"""
        SELECT l_orderkey || '-' || l_linenumber AS unique_visit_id,
               l_shipdate + INTERVAL '1' DAY * (l_partkey % 40)
                          + INTERVAL '1' HOUR * (l_suppkey % 24) AS updated_at,
               CAST(l_shipdate AS date) AS target_date,
               CASE WHEN o_custkey % 97 = 0 THEN 'Test' WHEN o_custkey % 89 = 0 THEN NULL
                    ELSE 'Patient' || o_custkey END AS patient_last,
               'Given' || (o_custkey % 10) AS patient_first,
               CAST(o_custkey AS string) AS medical_record_number,
               CASE WHEN l_suppkey % 50 = 0 THEN NULL
                    ELSE {_TASK.format(k="l_partkey")} END AS task_name,
               CASE l_suppkey % 8 WHEN 0 THEN 'OT' WHEN 1 THEN 'PT' WHEN 2 THEN ' SN' WHEN 3 THEN 'ST'
                    WHEN 4 THEN 'MSW' WHEN 5 THEN 'HHA ' WHEN 6 THEN 'SN' ELSE 'DIET' END AS task_type,
               'Ann ' || l_suppkey AS provider_last,
               'Lee' AS provider_first,
               CASE CAST(l_quantity AS bigint) % 9 WHEN 0 THEN 'Missed Visit' WHEN 1 THEN NULL
                    WHEN 2 THEN ' Saved (MV)' WHEN 3 THEN 'Submitted' ELSE 'Completed' END AS status,
               CASE WHEN l_partkey % 31 = 0 THEN NULL
                    ELSE l_shipdate + INTERVAL '8' HOUR END AS time_in,
               l_shipdate + INTERVAL '8' HOUR + INTERVAL '1' MINUTE * (l_partkey % 130 - 5)
                          + INTERVAL '1' SECOND * (l_suppkey % 60) AS time_out,
               CASE WHEN o_custkey % 29 = 0 THEN NULL WHEN o_custkey % 23 = 0 THEN 'Private Pay'
                    ELSE ' ' || o_orderpriority END AS insurance,
               {_AGENCY} AS agency
        FROM {{lineitem}} AS l JOIN {{orders}} AS o ON l_orderkey = o_orderkey""",
    "pdgm_episodes": f"""
        SELECT o_custkey || 'E' || (o_orderkey % 5)
                 || CASE WHEN o_orderkey % 2 = 0 THEN '.' || (o_orderkey % 7) ELSE '' END AS unique_id,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL
                    ELSE o_custkey || '/' || (o_orderkey % 5 % 2) END AS episode_identifier,
               CAST(o_custkey AS string) AS mrn,
               CAST(o_orderdate AS date) AS episode_start_date,
               CAST(o_orderdate + INTERVAL '1' DAY * (59 + o_orderkey % 3) AS date) AS episode_end_date,
               CAST(o_orderdate AS date) AS billing_period_start_date,
               CAST(o_orderdate + INTERVAL '29' DAY AS date) AS billing_period_end_date,
               o_orderkey % 3 AS billing_period,
               o_orderkey % 11 AS total_scheduled_visits,
               o_orderkey % 4 AS total_completed_visits,
               o_orderkey % 3 AS total_missed_visits,
               2 + o_orderkey % 4 AS lupa_level,
               CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS date) END AS eoe_date,
               o_totalprice / 64 AS anticipated_30_day_payment,
               CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice / 32 END AS eoe_anticipated_payment,
               o_orderpriority || ' ' AS insurance,
               {_AGENCY} AS agency,
               o_orderdate + INTERVAL '1' DAY * (o_orderkey % 30) AS updated_at
        FROM {{orders}} WHERE o_orderkey % 3 <> 0""",
    "mc_episodes": f"""
        SELECT o_custkey || '.M' || (o_orderkey % 5) AS unique_id,
               CAST(o_custkey AS string) AS mrn,
               o_orderpriority AS insurance,
               CAST(o_orderdate AS date) AS episode_start_date,
               CASE WHEN o_orderkey % 13 = 0 THEN DATE '9999-12-31'
                    ELSE CAST(o_orderdate + INTERVAL '89' DAY AS date) END AS episode_end_date,
               o_orderkey % 9 AS total_scheduled_visits,
               o_orderkey % 4 AS total_completed_visits,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 2 END AS total_missed_visits,
               {_AGENCY} AS agency,
               o_orderdate + INTERVAL '1' DAY * (o_orderkey % 30) AS updated_at
        FROM {{orders}} WHERE o_orderkey % 3 = 0""",
    "claims": f"""
        SELECT o_custkey || 'C' || (o_orderkey % 7) AS unique_claim_id,
               'Patient' || o_custkey AS patient_name,
               CAST(o_custkey AS string) AS mrn,
               CAST(o_orderkey AS string) AS claim_number,
               CASE WHEN o_orderkey % 19 = 0 THEN 'Void' WHEN o_orderkey % 43 = 0 THEN NULL
                    ELSE 'Paid' END AS claim_status,
               CASE WHEN o_orderkey % 17 = 0 THEN '322' ELSE '329' END AS tob,
               o_orderpriority AS insurance,
               {_AGENCY} AS agency,
               CAST(o_orderdate + INTERVAL '1' DAY * (100 + o_orderkey % 40) AS date) AS billed_date,
               CAST(o_orderdate AS date) AS billing_period_start_date,
               CASE WHEN o_orderkey % 17 = 0 THEN CAST(o_orderdate AS date)
                    ELSE CAST(o_orderdate + INTERVAL '99' DAY AS date) END AS billing_period_end_date,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0.0
                    ELSE o_totalprice END AS anticipated_payment,
               o_orderdate + INTERVAL '1' DAY * (o_orderkey % 50) AS updated_at
        FROM {{orders}}""",
    "task_map": f"""
        SELECT DISTINCT {_TASK_CLEAN.format(k="p_partkey")} AS task_name,
               'Group ' || (p_partkey % 7 % 3) AS task_group,
               'Discipline ' || (p_partkey % 2) AS discipline_type
        FROM {{part}} WHERE p_partkey % 7 <> 4""",
    "insurance_map": f"""
        SELECT DISTINCT o_orderpriority AS insurance, {_AGENCY} AS office,
               'Parent ' || (o_custkey % 2) AS parent_insurance,
               CASE WHEN o_orderpriority < '3' THEN 'Medicare' ELSE 'Commercial' END AS insurance_type,
               CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'Episodic Payment'
                    WHEN '2' THEN 'Per Visit Payment' WHEN '3' THEN 'Episodic Payment'
                    WHEN '4' THEN NULL ELSE 'Capitated' END AS payment_model,
               CASE WHEN o_custkey % 3 = 2 AND o_orderpriority > '3' THEN NULL
                    WHEN o_orderpriority < '3' THEN 0.75 ELSE 1.25 END AS payment_multiplier
        FROM {{orders}}""",
    "non_billable_tasks": f"""
        SELECT DISTINCT {_TASK.format(k="p_partkey")} AS task_name FROM {{part}}
        WHERE p_partkey % 10 = 8""",
    "rate_cards": f"""
        SELECT o_orderpriority AS insurer, {_TASK_CLEAN.format(k="o_orderkey")} AS task_name,
               CASE o_custkey % 3 WHEN 0 THEN ' NORTH' WHEN 1 THEN 'south ' ELSE 'East' END AS location,
               CASE MAX(o_orderkey) % 5 WHEN 0 THEN 'Unit' WHEN 1 THEN 'Flat' ELSE 'Hourly' END AS type,
               CAST(MIN(o_orderdate) AS date) AS from_date,
               CASE WHEN MIN(o_orderkey) % 4 = 0 THEN DATE '9999-12-31'
                    WHEN MIN(o_orderkey) % 9 = 0 THEN NULL ELSE CAST(MAX(o_orderdate) AS date) END AS to_date,
               CAST(20 + MIN(o_orderkey) % 80 AS double) + 0.35 AS rate
        FROM {{orders}}
        GROUP BY o_orderpriority, o_custkey % 3, o_orderkey % 7, EXTRACT(YEAR FROM o_orderdate)""",
    "pdgm_flags": f"""
        SELECT DISTINCT {_AGENCY} AS office, o_orderpriority AS insurance,
               CASE WHEN o_orderpriority < '4' THEN 'PDGM' ELSE 'Other' END AS pdgm_non_pdgm
        FROM {{orders}} WHERE o_custkey % 3 < 2""",
    "revenue_exceptions": """
        SELECT l_orderkey || '-' || l_linenumber AS unique_id, l_extendedprice AS new_revenue
        FROM {lineitem} WHERE l_partkey % 6 = 0""",
}

_TABLES = ("lineitem", "orders", "part")

# Column types of the driver's tables, given so that no file is opened just to
# find them out.
COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
    " o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the report, derived from the driver's tables."""
    text = ROLES[name]
    used = {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text}
    return conform(spark.sql(text, **used), SCHEMAS[name])


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(**{name: role(spark, sf_dir, name) for name in Inputs._fields})


def role_sql(name: str) -> str:
    """The same table for DuckDB."""
    return ROLES[name].format(**{t: t for t in _TABLES})
