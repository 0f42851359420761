"""The expected result of each query as DuckDB SQL.

Written for clarity: plain joins, EXISTS and NOT IN straight from the rule, with
none of the reshaping the Spark operators do for scale.
"""

from __future__ import annotations

import re
from datetime import date

from visitledger import constants as k
from visitledger.plans.claims import CLAIM_COLUMNS
from visitledger.plans.episodes import MANAGED_TIEBREAK, PDGM_TIEBREAK
from visitledger.plans.visits import REPORT_COLUMNS, VERSION_TIEBREAK
from visitledger.sources.schemas import OPEN_RECEIVABLES, REVENUE
from visitledger.sources.tables import SCHEMAS
from workload.roles import REPORT_DAYS, ROLES, SNAPSHOT, TODAY, role_sql


def _list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _first(columns) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in columns)


def _tied(role: str, columns) -> list[str]:
    """Those of `columns` that the role's table has; the others are NULL in Spark."""
    found = set(re.findall(r"\bAS (\w+)", ROLES[role]))
    return [c for c in columns if c in found]


def _trim(text: str) -> str:
    return f"trim({text}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"


def _hours(start: str, end: str) -> str:
    minutes = f"trunc((epoch_us({end}) - epoch_us({start})) / 60000000.0)"
    rest = f"({minutes} - 60 * trunc({minutes} / 60))"
    return f"""CAST(trunc({minutes} / 60) + CASE WHEN {rest} <= 7 THEN 0 WHEN {rest} <= 22 THEN 0.25
        WHEN {rest} <= 37 THEN 0.5 WHEN {rest} <= 52 THEN 0.75 ELSE 1 END AS DOUBLE)"""


def _whole(text: str) -> str:
    return f"(round_even({text}, 0) + 0.0)"


def _buckets(amount: str) -> dict[str, str]:
    return {
        name: f"CASE WHEN age >= {low}"
        + (f" AND age <= {high}" if high is not None else "")
        + f" THEN {amount} ELSE 0 END"
        for name, low, high in k.AGE_BUCKETS
    }


def _matrix(rows: str, key: str, day: str, amount: str, today: str) -> str:
    sums = {n: f"coalesce(sum({e}), 0)" for n, e in _buckets(amount).items()}
    cells = ", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in sums.items())
    total = " + ".join(sums.values())
    aged = f"SELECT *, DATE '{today}' - {day} AS age FROM {rows} WHERE {key} IS NOT NULL"
    return f"""
        SELECT {key} AS {key}, {cells}, CAST({total} AS DOUBLE) AS "Row_Total" FROM ({aged}) GROUP BY {key}
        UNION ALL
        SELECT 'Column_Total', {cells}, CAST({total} AS DOUBLE) FROM ({aged})"""


D = f"DATE '{SNAPSHOT}'"

CLAIM_COLUMNS_FILLED = [c for c in CLAIM_COLUMNS if c not in ("payer_type", "branch", "medicare_subscriber_number")]

# Named steps; a query's WITH clause is built from the ones it mentions.
STEPS = {name: role_sql(name) for name in ROLES}

STEPS["done_all"] = f"""
    SELECT *, target_date AS visit_date, medical_record_number AS mrn,
           replace({_trim("task_name")}, '  ', ' ') AS task, {_trim("task_type")} AS kind,
           {_trim("status")} AS state, {_trim("insurance")} AS payer,
           CASE WHEN {_trim("task_type")} = 'HHA' THEN 'HHA' ELSE 'Clinical' END AS visit_type,
           {_hours("time_in", "time_out")} AS total_hours,
           split_part(provider_last, ' ', 1) AS provider
    FROM visits
    WHERE {_trim("task_type")} IN ({_list(k.DISCIPLINES)})
      AND {_trim("status")} NOT IN ({_list(k.OPEN_STATUSES)})
      AND patient_last NOT IN ({_list(k.TEST_SURNAMES)})"""

STEPS["newest_visit"] = f"""
    SELECT * FROM visits WHERE CAST(updated_at AS DATE) < {D}
    QUALIFY row_number() OVER (PARTITION BY unique_visit_id
        ORDER BY updated_at DESC NULLS LAST, {_first(_tied("visits", VERSION_TIEBREAK))}) = 1"""

STEPS["done"] = STEPS["done_all"].replace("FROM visits", "FROM newest_visit")

STEPS["payer_map"] = """
    SELECT * FROM insurance_map
    QUALIFY row_number() OVER (PARTITION BY insurance, office ORDER BY parent_insurance NULLS FIRST,
        insurance_type NULLS FIRST, payment_model NULLS FIRST, payment_multiplier NULLS FIRST) = 1"""

STEPS["clean"] = """
    SELECT v.visit_date, v.mrn, v.task AS task_name, v.kind AS task_type, v.visit_type, v.state AS status,
           v.payer AS insurance, v.agency, v.updated_at, v.unique_visit_id, v.total_hours, v.provider,
           t.task_group, t.discipline_type, i.parent_insurance, i.insurance_type, i.payment_model
    FROM done v LEFT JOIN task_map t ON v.task = t.task_name
    LEFT JOIN insurance_map i ON v.payer = i.insurance AND v.agency = i.office
    QUALIFY row_number() OVER (PARTITION BY v.unique_visit_id ORDER BY t.task_group NULLS FIRST,
        t.discipline_type NULLS FIRST, i.parent_insurance NULLS FIRST, i.insurance_type NULLS FIRST,
        i.payment_model NULLS FIRST) = 1"""

_ACTIVE = """total_scheduled_visits <> 0
      AND (total_completed_visits <> 0 OR total_missed_visits <> 0)"""

STEPS["pdgm"] = f"""
    SELECT e.* EXCLUDE (insurance), trim(e.insurance) AS insurance, i.parent_insurance, i.insurance_type,
           i.payment_model, i.payment_multiplier
    FROM (SELECT * REPLACE (CASE WHEN position('.' IN unique_id) > 0
                 THEN substr(unique_id, 1, position('.' IN unique_id) - 1) ELSE unique_id END AS unique_id)
          FROM (SELECT * FROM pdgm_episodes WHERE CAST(updated_at AS DATE) < {D}
                QUALIFY row_number() OVER (PARTITION BY unique_id
                    ORDER BY updated_at DESC NULLS LAST, {_first(_tied("pdgm_episodes", PDGM_TIEBREAK))}) = 1)
          WHERE {_ACTIVE}) AS e
    LEFT JOIN payer_map i ON trim(e.insurance) = i.insurance AND e.agency = i.office
    QUALIFY row_number() OVER (PARTITION BY unique_id
        ORDER BY updated_at DESC NULLS LAST, {_first(f"e.{c}" for c in _tied("pdgm_episodes", PDGM_TIEBREAK))}) = 1"""

STEPS["managed"] = f"""
    SELECT e.*, i.parent_insurance, i.payment_model
    FROM (SELECT * FROM mc_episodes WHERE CAST(updated_at AS DATE) < {D}
          QUALIFY row_number() OVER (PARTITION BY unique_id
              ORDER BY updated_at DESC NULLS LAST, {_first(_tied("mc_episodes", MANAGED_TIEBREAK))}) = 1) AS e
    LEFT JOIN payer_map i ON e.insurance = i.insurance AND e.agency = i.office
    WHERE {_ACTIVE}"""

STEPS["care"] = """
    SELECT agency, mrn, episode_start_date, episode_end_date, episode_identifier FROM (
        SELECT * FROM pdgm QUALIFY row_number() OVER (PARTITION BY episode_identifier
            ORDER BY episode_end_date NULLS FIRST, episode_start_date NULLS FIRST, mrn NULLS FIRST,
                     agency NULLS FIRST) = 1)
    UNION
    SELECT agency, mrn, episode_start_date, episode_end_date, unique_id FROM managed"""

STEPS["periods"] = """
    SELECT unique_id AS billing_period_id, episode_identifier, billing_period_start_date,
           billing_period_end_date, billing_period,
           anticipated_30_day_payment * payment_multiplier AS period_ongoing_revenue,
           eoe_anticipated_payment * payment_multiplier AS period_closed_revenue,
           total_scheduled_visits, total_completed_visits, lupa_level, eoe_date
    FROM pdgm"""

STEPS["placed"] = """
    SELECT v.*, e.episode_start_date, e.episode_end_date, e.episode_identifier
    FROM (SELECT * FROM clean WHERE task_name NOT IN (SELECT task_name FROM non_billable_tasks)) v
    LEFT JOIN care e ON v.mrn = e.mrn AND v.agency = e.agency
         AND v.visit_date BETWEEN e.episode_start_date AND e.episode_end_date
    QUALIFY row_number() OVER (PARTITION BY v.unique_visit_id ORDER BY e.episode_start_date NULLS FIRST,
        e.episode_end_date NULLS FIRST, e.episode_identifier NULLS FIRST) = 1"""


def _rated(visits: str) -> str:
    return f"""
    SELECT v.*, r.type AS rate_type, r.rate, r.from_date AS rate_card_from_date, r.to_date AS rate_card_to_date,
           CAST(CASE r.type WHEN 'Unit' THEN r.rate
                WHEN 'Hourly' THEN round(CAST(CAST(r.rate * v.total_hours AS VARCHAR) AS DECIMAL(38, 17)), 2)
           END AS DOUBLE) AS revenue
    FROM {visits} v LEFT JOIN rate_cards r ON v.insurance = r.insurer AND v.task_name = r.task_name
         AND lower({_trim("v.agency")}) = lower({_trim("r.location")})
         AND v.visit_date BETWEEN r.from_date AND r.to_date
    WHERE v.task_name NOT IN ({_list(k.UNPRICED_TASKS)})
      AND coalesce(v.payment_model, 'Per Visit Payment') = 'Per Visit Payment'"""


def _prorated(visits: str, periods: str, carry: str) -> str:
    """Visits with each period they fall in and their share of its payment."""
    return f"""
    SELECT m.*, closed / nullif(completed, 0) AS closed_revenue,
           ongoing * prorate_percent / nullif(visits_in_month, 0) AS ongoing_revenue
    FROM (SELECT w.*, days / day(last_day(visit_date)) AS prorate_percent,
                 CASE WHEN billing_period_id IS NOT NULL THEN count(*) OVER (
                     PARTITION BY billing_period_id, last_day(visit_date)) END AS visits_in_month
          FROM (SELECT v.*, p.billing_period_id, {carry} p.total_completed_visits AS completed,
                       p.period_closed_revenue AS closed, p.period_ongoing_revenue AS ongoing,
                       date_diff('day',
                           CASE WHEN p.billing_period_start_date > CAST(date_trunc('month', v.visit_date) AS DATE)
                                THEN p.billing_period_start_date
                                WHEN p.billing_period_start_date IS NOT NULL
                                THEN CAST(date_trunc('month', v.visit_date) AS DATE) END,
                           CASE WHEN p.billing_period_end_date < last_day(v.visit_date)
                                THEN p.billing_period_end_date ELSE last_day(v.visit_date) END) + 1 AS days
                FROM {visits} v LEFT JOIN {periods} p ON v.episode_identifier = p.episode_identifier
                     AND v.visit_date BETWEEN p.billing_period_start_date AND p.billing_period_end_date) w) m"""


STEPS["rated"] = _rated("placed")
STEPS["episodic"] = f"""
    SELECT * FROM placed WHERE payment_model = 'Episodic Payment'
      AND task_name NOT IN ({_list(k.UNPRICED_TASKS)})"""
STEPS["prorated"] = _prorated(
    "episodic",
    "periods",
    "p.billing_period_start_date, p.billing_period_end_date, p.total_scheduled_visits, "
    "p.total_completed_visits, p.lupa_level, p.eoe_date, ",
)

_RENAMED = {
    "unique_id": "x.unique_visit_id",
    "revenue_date": "x.visit_date",
    "hours_worked": "x.total_hours",
    "revenue": "coalesce(x.amount, e.new_revenue)",
    "pdgm_non_pdgm": "coalesce(f.pdgm_non_pdgm, 'Non PDGM')",
    "billing_period_days_in_month": "CAST(x.days AS BIGINT)",
}
STEPS["priced"] = """
    SELECT *, revenue AS amount FROM rated
    UNION ALL BY NAME
    SELECT *, coalesce(closed_revenue, ongoing_revenue) AS amount FROM prorated"""
STEPS["revenue"] = f"""
    SELECT {", ".join(f"{_RENAMED.get(c, 'x.' + c)} AS {c}" for c in REVENUE.fieldNames())}
    FROM priced x
    LEFT JOIN (SELECT * FROM pdgm_flags WHERE pdgm_non_pdgm = 'PDGM') f
         ON x.agency = f.office AND x.insurance = f.insurance
    LEFT JOIN revenue_exceptions e ON x.unique_visit_id = e.unique_id"""

STEPS["standing"] = f"""
    SELECT * FROM claims WHERE CAST(updated_at AS DATE) < {D}
      AND claim_status NOT IN ({_list(k.VOID_CLAIM_STATUSES)})"""
STEPS["advance"] = """
    SELECT unique_claim_id || '|' || anticipated_payment AS pair FROM standing
    WHERE tob = '322' AND billing_period_start_date = billing_period_end_date AND anticipated_payment = 0"""
STEPS["real_claims"] = """
    SELECT * FROM standing
    WHERE unique_claim_id || '|' || anticipated_payment NOT IN (SELECT pair FROM advance)"""

_CLAIM_ORDER = [
    c
    for c in CLAIM_COLUMNS
    if c in SCHEMAS["claims"].names
    and c
    not in ("billed_date", "updated_at", "mrn", "agency", "payer_type", "branch", "medicare_subscriber_number")
]


def _allocated(claims: str, revenue: str) -> str:
    group = ["unique_claim_id", "claim_number", "mrn", "agency", "billed_date", "updated_at"]
    group += ["billing_period_start_date", "billing_period_end_date", "anticipated_payment"]
    group += ["patient_name", "claim_status", "tob", "insurance"]
    columns = ", ".join(group)
    return f"""
    SELECT {columns}, CAST(sum(CAST(round(revenue * 1000000) AS BIGINT)) AS DOUBLE) / 1000000
        AS expected_revenue FROM (
        SELECT c.*, r.visit_date, r.revenue
        FROM {claims} c LEFT JOIN {revenue} r ON c.mrn = r.mrn AND c.agency = r.agency
             AND r.visit_date BETWEEN c.billing_period_start_date AND c.billing_period_end_date
        QUALIFY r.visit_date IS NULL OR row_number() OVER (PARTITION BY r.visit_date, c.mrn, c.agency
            ORDER BY c.billed_date NULLS FIRST, c.updated_at DESC NULLS LAST,
                     {_first(f"c.{c}" for c in _CLAIM_ORDER)}, r.unique_id NULLS FIRST, r.revenue NULLS FIRST) = 1)
    GROUP BY ALL"""


def _counted(allocated: str) -> str:
    return f"""
    SELECT * FROM {allocated}
    QUALIFY row_number() OVER (PARTITION BY unique_claim_id ORDER BY updated_at DESC NULLS LAST,
        billed_date NULLS FIRST, claim_number NULLS FIRST) = 1"""


def _open(revenue: str, counted: str) -> str:
    return f"""
    SELECT * FROM {revenue}
    WHERE insurance NOT IN ({_list(k.PRIVATE_PAYERS)})
      AND unique_id NOT IN (
          SELECT r.unique_id FROM {revenue} r JOIN {counted} c ON r.mrn = c.mrn AND r.agency = c.agency
               AND r.visit_date BETWEEN c.billing_period_start_date AND c.billing_period_end_date
          WHERE c.anticipated_payment IS NOT NULL)"""


STEPS["allocated"] = _allocated("real_claims", "revenue")
STEPS["counted"] = _counted("allocated")
STEPS["open_rows"] = _open("revenue", "counted")
STEPS["report"] = (
    "SELECT "
    + ", ".join("revenue AS open_amount" if c == "open_amount" else c for c in OPEN_RECEIVABLES.names)
    + " FROM open_rows"
)
STEPS["dashboard_rows"] = f"""
    SELECT * REPLACE ({_whole("open_amount")} AS open_amount) FROM report WHERE visit_date IS NOT NULL"""

STEPS["shipments"] = """
    SELECT l_orderkey, l_partkey, l_suppkey, o_custkey AS custkey, CAST(l_shipdate AS DATE) AS ship_day
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
STEPS["spans"] = """
    SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS span_start,
           CASE WHEN o_orderkey % 200 = 1 THEN DATE '9999-12-31'
                WHEN o_orderkey % 50 = 0 THEN CAST(o_orderdate AS DATE) + 2500
                ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS span_end
    FROM orders"""
STEPS["customer_orders"] = f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN c_mktsegment END AS segment, n_name AS nation,
           CAST(o_orderdate AS DATE) AS day,
           {_whole("CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END")} AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
STEPS["order_visits"] = """
    SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey AS unique_visit_id,
           CASE WHEN l_suppkey % 20 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS episode_identifier,
           CAST(l_shipdate AS DATE) AS visit_date
    FROM lineitem"""
STEPS["order_periods"] = """
    SELECT CASE WHEN o_orderkey % 31 <> 0 THEN prefix || o_orderkey END AS billing_period_id,
           CAST(o_orderkey AS VARCHAR) AS episode_identifier,
           CAST(o_orderdate AS DATE) + shift AS billing_period_start_date,
           CAST(o_orderdate AS DATE) + shift + 399 AS billing_period_end_date,
           o_totalprice AS period_ongoing_revenue,
           CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS period_closed_revenue,
           o_orderkey % 4 AS total_completed_visits
    FROM orders JOIN (VALUES ('a', 0, 1), ('b', 45, 5)) AS s(prefix, shift, step) ON o_orderkey % step = 0"""
STEPS["order_revenue"] = """
    SELECT l_orderkey || '-' || l_partkey AS unique_id, CAST(o_custkey AS VARCHAR) AS mrn,
           l_returnflag AS agency, CAST(l_shipdate AS DATE) AS visit_date, l_extendedprice AS revenue,
           CASE WHEN l_suppkey % 10 <> 0 THEN o_orderpriority END AS insurance
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
STEPS["order_claims"] = """
    SELECT o_custkey || '-' || (o_orderkey % 8) AS unique_claim_id, o_orderdate AS updated_at,
           CAST(o_orderdate AS DATE) + 130 AS billed_date, 'p' AS patient_name,
           CAST(o_custkey AS VARCHAR) AS mrn, CAST(o_orderkey AS VARCHAR) AS claim_number,
           o_orderpriority AS claim_status, CAST(o_orderdate AS DATE) AS billing_period_start_date,
           CAST(o_orderdate AS DATE) + 120 AS billing_period_end_date, '329' AS tob,
           CAST(NULL AS VARCHAR) AS insurance,
           CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS anticipated_payment,
           CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS agency
    FROM orders"""
STEPS["order_allocated"] = _allocated("order_claims", "order_revenue")
STEPS["order_counted"] = _counted("order_allocated")
STEPS["order_open"] = _open("order_revenue", "order_counted")
STEPS["loose_visits"] = """
    SELECT unique_visit_id, updated_at, visit_date, task AS task_name, payer AS insurance, agency, total_hours,
           CAST(NULL AS VARCHAR) AS payment_model FROM done_all"""


def _needed(text: str, found: list[str]) -> list[str]:
    """The steps `text` reads, each after the ones it reads itself."""
    for name in STEPS:
        if name not in found and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
            _needed(STEPS[name], found)
            if name not in found:
                found.append(name)
    return found


def _query(text: str) -> str:
    steps = _needed(text, [])
    if not steps:
        return text.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in steps) + "\n" + text.strip()


SPAN_MATCH = "custkey = o_custkey AND ship_day BETWEEN span_start AND span_end"
_ALL_REPORT = ", ".join(OPEN_RECEIVABLES.names)

_TEXTS = {
    "snapshot_dates": "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS snapshot_date FROM events",
    "latest_as_of": """
        SELECT user_id, event_id, ts, event_type, value FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id NULLS FIRST) = 1""",
    "first_per_key_ties": """
        SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate NULLS FIRST,
            l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_extendedprice NULLS FIRST) = 1""",
    "quarter_hours": f"""
        SELECT user_id, day, {_hours("a", "b")} AS hours_forward, {_hours("b", "a")} AS hours_backward
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS a,
                     CASE WHEN count(*) > 1 THEN max(ts) END AS b FROM events GROUP BY ALL)""",
    "clean_text": """
        SELECT p_partkey, p_name || '   ' || p_type AS trimmed, p_name || '  ' || p_type AS squeezed,
               split_part(p_name, ' ', 1) AS word, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS base,
               lower(p_brand) AS place
        FROM part""",
    "exclude_values": """
        SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus NOT IN ('P', 'F', 'X')""",
    "exclude_anti": """
        SELECT o_orderkey, key, o_custkey
        FROM (SELECT *, CASE WHEN o_custkey % 10 <> 0 THEN o_orderkey END AS key FROM orders)
        WHERE key NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""",
    "exclude_anti_null": """
        SELECT 'kept' AS side, count(*) AS n_rows FROM orders WHERE o_orderkey NOT IN (
            SELECT CASE WHEN l_orderkey % 100 <> 0 THEN l_orderkey END FROM lineitem WHERE l_quantity > 45)
        UNION ALL SELECT 'all', count(*) FROM orders""",
    "exclude_anti_empty": """
        SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_orderkey END AS key FROM orders
        WHERE CASE WHEN o_custkey % 10 <> 0 THEN o_orderkey END NOT IN (
            SELECT l_orderkey FROM lineitem WHERE l_quantity < 0)""",
    "interval_left_join": """
        SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship_day, kind, span_end
        FROM lineitem LEFT JOIN (
            SELECT o_orderkey, CAST(o_orderdate AS DATE) AS span_start, kind,
                   CASE kind WHEN 'short' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER)
                        WHEN 'long' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 1500 AS INTEGER)
                        ELSE CASE WHEN o_orderkey % 4 = 0 THEN DATE '9999-12-31' END END AS span_end
            FROM orders CROSS JOIN (VALUES ('short'), ('long'), ('open')) AS k(kind)) s
        ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) BETWEEN span_start AND span_end""",
    "cover_semi": f"SELECT * FROM shipments WHERE EXISTS (SELECT 1 FROM spans WHERE {SPAN_MATCH})",
    "cover_anti": f"SELECT * FROM shipments WHERE NOT EXISTS (SELECT 1 FROM spans WHERE {SPAN_MATCH})",
    "spans_without_points": f"""
        SELECT * FROM spans WHERE NOT EXISTS (SELECT 1 FROM shipments WHERE {SPAN_MATCH})""",
    "ageing_matrix": _matrix("customer_orders", "segment", "day", "amount", "2001-06-01"),
    "ageing_by_second_key": _matrix("customer_orders", "nation", "day", "amount", "2001-06-01"),
    "aged_detail": "SELECT * EXCLUDE (age), CAST(age AS BIGINT) AS days_difference, "
    + ", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in _buckets("amount").items())
    + " FROM (SELECT *, DATE '2001-06-01' - day AS age FROM customer_orders)",
    "open_total": "SELECT coalesce(sum(amount), 0.0) AS total FROM customer_orders",
    "date_bounds": "SELECT min(day) AS start_date, max(day) AS end_date FROM customer_orders",
    "date_range": """
        SELECT * FROM customer_orders
        WHERE o_orderkey % 9 <> 0 AND day BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
    "clean_visits": f"SELECT {', '.join(REPORT_COLUMNS)}, provider AS provider_last FROM clean",
    "billable_visits": """
        SELECT unique_visit_id, updated_at, task AS task_name FROM done_all
        WHERE task NOT IN (SELECT task_name FROM non_billable_tasks)""",
    "active_episodes": f"""
        SELECT unique_id, mrn, episode_start_date, total_completed_visits FROM mc_episodes WHERE {_ACTIVE}""",
    "pdgm_episodes": """
        SELECT unique_id, episode_identifier, mrn, agency, insurance, episode_start_date, episode_end_date,
               billing_period_start_date, billing_period_end_date, billing_period, total_scheduled_visits,
               total_completed_visits, total_missed_visits, lupa_level, eoe_date, updated_at,
               CAST(anticipated_30_day_payment AS DOUBLE) AS anticipated_30_day_payment,
               CAST(eoe_anticipated_payment AS DOUBLE) AS eoe_anticipated_payment,
               parent_insurance, insurance_type, payment_model,
               CAST(payment_multiplier AS DOUBLE) AS payment_multiplier
        FROM pdgm""",
    "managed_care_episodes": """
        SELECT unique_id, mrn, agency, episode_start_date, episode_end_date, parent_insurance, payment_model
        FROM managed""",
    "episode_set": "SELECT * FROM care",
    "billing_periods": """
        SELECT * REPLACE (CAST(period_ongoing_revenue AS DOUBLE) AS period_ongoing_revenue,
                          CAST(period_closed_revenue AS DOUBLE) AS period_closed_revenue) FROM periods""",
    "attach_episode": """
        SELECT v.* EXCLUDE (n), e.episode_start_date, e.episode_end_date, e.episode_identifier
        FROM (SELECT unique_visit_id, updated_at, mrn, agency, visit_date,
                     row_number() OVER (ORDER BY unique_visit_id, updated_at) AS n FROM done_all) v
        LEFT JOIN care e ON v.mrn = e.mrn AND v.agency = e.agency
             AND v.visit_date BETWEEN e.episode_start_date AND e.episode_end_date
        QUALIFY row_number() OVER (PARTITION BY n ORDER BY e.episode_start_date NULLS FIRST,
            e.episode_end_date NULLS FIRST, e.episode_identifier NULLS FIRST) = 1""",
    "rate_card_revenue": f"""
        SELECT unique_visit_id, updated_at, task_name, insurance, total_hours, rate_type, rate,
               rate_card_from_date, rate_card_to_date, revenue
        FROM ({_rated("loose_visits")})""",
    "prorate_by_month": f"""
        SELECT unique_visit_id, visit_date, billing_period_id,
               CAST(days AS BIGINT) AS billing_period_days_in_month, prorate_percent, visits_in_month,
               ongoing_revenue, closed_revenue
        FROM ({_prorated("order_visits", "order_periods", "")})""",
    "interval_periods": """
        SELECT unique_visit_id, visit_date, billing_period_id
        FROM order_visits v LEFT JOIN order_periods p ON v.episode_identifier = p.episode_identifier
             AND visit_date BETWEEN billing_period_start_date AND billing_period_end_date""",
    "align_revenue": """
        SELECT unique_visit_id AS unique_id, mrn, agency, visit_date AS revenue_date, total_hours AS hours_worked,
               CAST(NULL AS VARCHAR) AS billing_period_id, CAST(NULL AS DOUBLE) AS revenue,
               CAST(NULL AS DATE) AS eoe_date
        FROM done_all""",
    "add_flags_and_exceptions": """
        SELECT v.unique_visit_id AS unique_id, v.updated_at, payer AS insurance,
               coalesce(CASE WHEN visit_type = 'Clinical' AND total_hours > 1 THEN total_hours END,
                        closed_revenue, ongoing_revenue, new_revenue) AS revenue,
               closed_revenue, ongoing_revenue, coalesce(pdgm_non_pdgm, 'Non PDGM') AS pdgm_non_pdgm
        FROM (SELECT *, CASE WHEN visit_type = 'HHA' AND total_hours > 2 THEN CAST(5 AS DOUBLE) END AS closed_revenue,
                     CASE WHEN visit_type = 'HHA' AND total_hours > 1 THEN CAST(3 AS DOUBLE) END AS ongoing_revenue
              FROM done_all) v
        LEFT JOIN (SELECT * FROM pdgm_flags WHERE pdgm_non_pdgm = 'PDGM') f
             ON v.agency = f.office AND payer = f.insurance
        LEFT JOIN revenue_exceptions e ON v.unique_visit_id = e.unique_id""",
    "allocate_first_claim": f"""
        SELECT {', '.join(CLAIM_COLUMNS_FILLED)}, expected_revenue FROM order_allocated""",
    "latest_claims": f"SELECT {', '.join(CLAIM_COLUMNS_FILLED)} FROM order_counted",
    "open_receivables": """
        SELECT unique_id, mrn, agency, visit_date, insurance, revenue AS open_amount FROM order_open""",
    "drop_advance_claims": """
        SELECT * REPLACE (CAST(anticipated_payment AS DOUBLE) AS anticipated_payment) FROM real_claims""",
    "map_claims": """
        SELECT claim_number, agency, c.insurance, parent_insurance, insurance_type
        FROM claims c LEFT JOIN payer_map i ON c.insurance = i.insurance AND c.agency = i.office""",
    "revenue_fact": "SELECT * FROM revenue",
    "open_report": f"SELECT {_ALL_REPORT} FROM report",
    "read_and_report": f"SELECT {_ALL_REPORT} FROM report",
    "export_round_trip": "SELECT * FROM orders",
    "open_detail": f"SELECT {_ALL_REPORT}, CAST(age AS BIGINT) AS days_difference, "
    + ", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in _buckets("open_amount").items())
    + f""" FROM (SELECT *, DATE '{TODAY}' - visit_date AS age FROM dashboard_rows)
        WHERE visit_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'""",
    "open_amount_total": "SELECT coalesce(sum(open_amount), 0.0) AS total FROM dashboard_rows",
    "open_by_agency": _matrix("dashboard_rows", "agency", "visit_date", "open_amount", str(TODAY)),
    "open_by_insurance": _matrix("dashboard_rows", "insurance", "visit_date", "open_amount", str(TODAY)),
}

_TEXTS["rate_cards_crowded"] = """
    WITH cards AS (
        SELECT CASE WHEN o_orderkey % 1000 = 1 THEN 'PT Visit' ELSE 'SN Visit' END AS card_task,
               ['north', 'south', 'east'][o_custkey % 3 + 1] AS place, CAST(o_orderdate AS DATE) AS from_date,
               CASE WHEN o_orderkey % 2000 = 0 THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) END AS to_date,
               CASE WHEN o_orderkey % 2 = 0 THEN 'Unit' ELSE 'Hourly' END AS rate_type, o_totalprice AS rate
        FROM orders),
    seen AS (
        SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 30 <> 0 THEN 'Cash' END AS payer,
               CASE WHEN l_partkey % 100 = 0 THEN 'PT Visit' ELSE 'SN Visit' END AS task_name,
               ['north', 'SOUTH', 'West'][l_suppkey % 3 + 1] AS agency, CAST(l_shipdate AS DATE) AS visit_date
        FROM lineitem)
    SELECT l_orderkey, l_linenumber, task_name, agency, visit_date, from_date AS rate_card_from_date,
           to_date AS rate_card_to_date, rate_type, rate,
           CASE rate_type WHEN 'Unit' THEN rate
                WHEN 'Hourly' THEN CAST(round(CAST(CAST(rate * 2.0::DOUBLE AS VARCHAR) AS DECIMAL(38, 17)), 2) AS DOUBLE)
           END AS revenue
    FROM seen LEFT JOIN cards ON payer = 'Cash' AND card_task = task_name AND place = lower(agency)
         AND visit_date BETWEEN from_date AND to_date"""
_TEXTS["catalog_report"] = _TEXTS["open_report"]
_TEXTS["export_detail"] = f"""
    SELECT *, 'parquet' AS form FROM ({_TEXTS["open_detail"]})
    UNION ALL SELECT *, 'csv' AS form FROM ({_TEXTS["open_detail"]})"""
_TEXTS["export_texts"] = """
    SELECT o_orderkey, o_totalprice, o_orderdate, CAST(o_orderdate AS DATE) AS day,
           CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'a "b", c'
                WHEN 3 THEN ' two' || chr(10) || 'lines' || chr(92) || ' ' WHEN 4 THEN '""' ELSE o_orderpriority END AS note
    FROM orders"""
_TEXTS["conform_types"] = """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(round(l_extendedprice / 100) AS BIGINT) AS whole,
           CASE WHEN l_partkey % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
                ELSE CAST(l_quantity + 0.5 AS VARCHAR) END AS number,
           CASE WHEN l_partkey % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
                WHEN l_tax = 0 THEN '0' ELSE CAST(CAST(l_tax AS DECIMAL(12, 2)) AS VARCHAR) END AS exact,
           CAST(l_shipdate + INTERVAL '1' SECOND * (l_suppkey * 977 % 86400) AS DATE) AS day,
           CAST(NULL AS VARCHAR) AS missing
    FROM lineitem"""
_TEXTS["version_spans"] = " UNION ALL ".join(
    f"""SELECT DATE '{day}' AS snapshot, unique_visit_id, updated_at, status FROM (
        SELECT * FROM visits WHERE CAST(updated_at AS DATE) < DATE '{day}'
        QUALIFY row_number() OVER (PARTITION BY unique_visit_id
            ORDER BY updated_at DESC, {_first(_tied("visits", VERSION_TIEBREAK))}) = 1)"""
    for day in REPORT_DAYS
)


def _on(day: date) -> str:
    """The report of another day: the same text with that day in it."""
    report = _query(f"SELECT {_ALL_REPORT} FROM report").replace(str(SNAPSHOT), str(day))
    return f"SELECT DATE '{day}' AS snapshot, * FROM ({report})"


ORACLE = {name: _query(text) for name, text in _TEXTS.items()}
ORACLE["reports_of_days"] = " UNION ALL ".join(_on(day) for day in REPORT_DAYS)
