"""One query per operator, and the report as a whole, on the driver's tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from visitledger.functions import (
    base_id,
    first_word,
    half_even,
    normal_name,
    quarter_hours,
    squeeze_once,
    trim_ws,
)
from visitledger.operators import (
    aged_detail,
    ageing_matrix,
    as_of,
    cover_anti,
    cover_semi,
    date_bounds,
    drop_excluded,
    first_per_key,
    in_date_range,
    interval_left_join,
    latest_per_key,
    null_aware_anti,
    open_total,
    snapshot_dates,
    spans_without_points,
    version_spans,
    versions_on,
)
from visitledger.plans.claims import (
    CLAIM_COLUMNS,
    allocate_first_claim,
    drop_advance_claims,
    latest_claims,
    map_claims,
    standing_claims,
)
from visitledger.plans.episodes import (
    active_episodes,
    billing_periods,
    episode_set,
    managed_care_episodes,
    pdgm_episodes,
)
from visitledger.plans.report import (
    MANAGED_COLUMNS,
    PERIOD_COLUMNS,
    dashboard,
    known_on,
    open_receivables,
    open_report,
    open_reports,
    paid_periods,
    price_visits,
)
from visitledger.plans.revenue import (
    EPISODE_EQ,
    align_revenue,
    per_visit_payers,
    prorate_by_month,
    rate_card_revenue,
    revenue_fact,
)
from visitledger.plans.visits import (
    REPORT_COLUMNS,
    VERSION_TIEBREAK,
    attach_episode,
    billable_visits,
    clean_visits,
    completed_visits,
    tidy_visits,
)
from visitledger.sources.staging import owned_path, stage
from visitledger.sources.tables import conform, read_catalog_inputs, read_detail, read_parquet_inputs, write_detail
from workload.roles import REPORT_DAYS, SNAPSHOT, TODAY, inputs, role, table

EVENTS_DAY = date(2024, 1, 20)
ORDERS_TODAY = date(2001, 6, 1)


# ---- single operators on the star tables ------------------------------------


def q_snapshot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_dates(table(spark, sf_dir, "events"), "ts")


def q_latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = as_of(table(spark, sf_dir, "events"), "ts", EVENTS_DAY)
    latest = latest_per_key(known, ["user_id"], "ts", ["event_id"])
    return latest.select("user_id", "event_id", "ts", "event_type", "value")


def q_first_per_key_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    first = first_per_key(
        lines, ["l_orderkey", "l_linenumber"], [F.col(c).asc_nulls_first() for c in order]
    )
    return first.select("l_orderkey", "l_linenumber", *order)


def q_quarter_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("time_in"),
        F.when(F.count(F.lit(1)) > 1, F.max("ts")).alias("time_out"),
    )
    return days.select(
        "user_id",
        "day",
        quarter_hours("time_in", "time_out").alias("hours_forward"),
        quarter_hours("time_out", "time_in").alias("hours_backward"),
    )


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    padded = F.concat(F.lit("\t "), "p_name", F.lit("   "), "p_type", F.lit(" \n"))
    dotted = F.when(
        F.col("p_size") % 7 != 0, F.concat("p_brand", F.lit("."), F.col("p_size").cast("string"))
    )
    return part.select(
        "p_partkey",
        trim_ws(padded).alias("trimmed"),
        squeeze_once(trim_ws(padded)).alias("squeezed"),
        first_word("p_name").alias("word"),
        base_id(dotted).alias("base"),
        normal_name(F.concat(F.lit(" "), "p_brand", F.lit("\t"))).alias("place"),
    )


def q_exclude_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn(
        "status", F.nullif("o_orderstatus", F.lit("P"))
    )
    kept = drop_excluded(orders, "status", ["F", "X"])
    return kept.select("o_orderkey", "status")


def _bulky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45)


def q_exclude_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn(
        "key", F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderkey"))
    )
    kept = null_aware_anti(orders, _bulky(spark, sf_dir), "key", "l_orderkey")
    return kept.select("o_orderkey", "key", "o_custkey")


def q_exclude_anti_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing may survive a NULL on the right; the count row shows it ran."""
    orders = table(spark, sf_dir, "orders")
    right = _bulky(spark, sf_dir).withColumn(
        "key", F.when(F.col("l_orderkey") % 100 != 0, F.col("l_orderkey"))
    )
    kept = null_aware_anti(orders, right, "o_orderkey", "key")
    survivors = kept.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("kept").alias("side"), "n_rows")
    whole = orders.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("all").alias("side"), "n_rows")
    return survivors.unionByName(whole)


def q_exclude_anti_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With nothing on the right even NULL keys stay."""
    orders = table(spark, sf_dir, "orders").withColumn(
        "key", F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderkey"))
    )
    none = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") < 0)
    return null_aware_anti(orders, none, "key", "l_orderkey").select("o_orderkey", "key")


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the customer of their order: points in time."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("o_custkey").alias("custkey"),
        F.to_date("l_shipdate").alias("ship_day"),
    )


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans of very different lengths per customer."""
    start = F.to_date("o_orderdate")
    length = (F.when(F.col("o_orderkey") % 50 == 0, 2500).otherwise(F.col("o_orderkey") % 90)).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        start.alias("span_start"),
        F.when(F.col("o_orderkey") % 200 == 1, F.lit(date(9999, 12, 31)))
        .otherwise(F.date_add(start, length))
        .alias("span_end"),
    )


SPAN = {"eq": [("custkey", "o_custkey")], "point": "ship_day", "lo": "span_start", "hi": "span_end"}


def q_interval_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in a short, a long and an open span of their own order."""
    orders = table(spark, sf_dir, "orders")
    start = F.to_date("o_orderdate")
    ends = {
        "short": F.date_add(start, (F.col("o_orderkey") % 90).cast("int")),
        "long": F.date_add(start, (F.col("o_orderkey") % 1500).cast("int")),
        "open": F.when(F.col("o_orderkey") % 4 == 0, F.lit(date(9999, 12, 31))),
    }
    kinds = F.explode(
        F.array(*[F.struct(F.lit(n).alias("kind"), e.alias("span_end")) for n, e in ends.items()])
    )
    spans = orders.select("o_orderkey", start.alias("span_start"), kinds.alias("span"))
    lines = table(spark, sf_dir, "lineitem").withColumn("ship_day", F.to_date("l_shipdate"))
    joined = interval_left_join(
        lines,
        spans.select("o_orderkey", "span_start", "span.kind", "span.span_end"),
        eq=[("l_orderkey", "o_orderkey")],
        point="ship_day",
        lo="span_start",
        hi="span_end",
        take=["kind", "span_end"],
    )
    return joined.select("l_orderkey", "l_partkey", "l_suppkey", "ship_day", "kind", "span_end")


def q_cover_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_semi(_shipments(spark, sf_dir), _order_spans(spark, sf_dir), **SPAN)


def q_cover_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_anti(_shipments(spark, sf_dir), _order_spans(spark, sf_dir), **SPAN)


def q_spans_without_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_without_points(_order_spans(spark, sf_dir), _shipments(spark, sf_dir), **SPAN)


def _customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with segment and nation; every seventh segment is missing."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .select(
            "o_orderkey",
            F.when(F.col("o_orderkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"),
            F.col("n_name").alias("nation"),
            F.to_date("o_orderdate").alias("day"),
            half_even(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))).alias("amount"),
        )
    )


def q_ageing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ageing_matrix(_customer_orders(spark, sf_dir), "segment", "day", "amount", ORDERS_TODAY)


def q_ageing_by_second_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ageing_matrix(_customer_orders(spark, sf_dir), "nation", "day", "amount", ORDERS_TODAY)


def q_aged_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aged_detail(_customer_orders(spark, sf_dir), "day", "amount", ORDERS_TODAY)


def q_open_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_total(_customer_orders(spark, sf_dir), "amount")


def q_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return date_bounds(_customer_orders(spark, sf_dir), "day")


def q_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customer_orders(spark, sf_dir).withColumn(
        "day", F.when(F.col("o_orderkey") % 9 != 0, F.col("day"))
    )
    return in_date_range(rows, "day", date(1997, 3, 1), date(1998, 2, 28))


# ---- the steps of the report on the derived inputs --------------------------


def q_clean_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = {n: role(spark, sf_dir, n) for n in ("visits", "task_map", "insurance_map")}
    return clean_visits(**load, day=SNAPSHOT, columns=[*REPORT_COLUMNS, "provider_last"])


def _done_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All completed visit versions, cleaned but neither dated back nor mapped."""
    return completed_visits(tidy_visits(role(spark, sf_dir, "visits")))


def q_billable_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = billable_visits(_done_visits(spark, sf_dir), role(spark, sf_dir, "non_billable_tasks"))
    return kept.select("unique_visit_id", "updated_at", "task_name")


def q_active_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = active_episodes(role(spark, sf_dir, "mc_episodes"))
    return rows.select("unique_id", "mrn", "episode_start_date", "total_completed_visits")


def _pdgm(spark: SparkSession, sf_dir: str, columns: Sequence[str] = PERIOD_COLUMNS) -> DataFrame:
    load = [role(spark, sf_dir, n) for n in ("pdgm_episodes", "insurance_map")]
    return pdgm_episodes(*load, SNAPSHOT, columns)


def _managed(spark: SparkSession, sf_dir: str, columns: Sequence[str] = MANAGED_COLUMNS) -> DataFrame:
    load = [role(spark, sf_dir, n) for n in ("mc_episodes", "insurance_map")]
    return managed_care_episodes(*load, SNAPSHOT, columns)


def q_pdgm_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        "unique_id",
        "episode_identifier",
        "mrn",
        "agency",
        "insurance",
        "episode_start_date",
        "episode_end_date",
        "billing_period_start_date",
        "billing_period_end_date",
        "billing_period",
        "total_scheduled_visits",
        "total_completed_visits",
        "total_missed_visits",
        "lupa_level",
        "eoe_date",
        "updated_at",
        "anticipated_30_day_payment",
        "eoe_anticipated_payment",
        "parent_insurance",
        "insurance_type",
        "payment_model",
        "payment_multiplier",
    ]
    return _pdgm(spark, sf_dir, columns)


def q_managed_care_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _managed(spark, sf_dir, [*MANAGED_COLUMNS, "parent_insurance", "payment_model"])


def q_episode_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_set(_pdgm(spark, sf_dir), _managed(spark, sf_dir))


def q_billing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_periods(_pdgm(spark, sf_dir))


def q_attach_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _done_visits(spark, sf_dir).select("unique_visit_id", "updated_at", "mrn", "agency", "visit_date")
    episodes = episode_set(_pdgm(spark, sf_dir), _managed(spark, sf_dir))
    return attach_episode(visits, episodes)


def q_rate_card_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _done_visits(spark, sf_dir).withColumn("payment_model", F.lit(None).cast("string"))
    priced = rate_card_revenue(per_visit_payers(visits), role(spark, sf_dir, "rate_cards"))
    return priced.select(
        "unique_visit_id",
        "updated_at",
        "task_name",
        "insurance",
        "total_hours",
        "rate_type",
        "rate",
        "rate_card_from_date",
        "rate_card_to_date",
        "revenue",
    )


def q_rate_cards_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items priced by the orders' days as cards: three keys hold all but a few of them."""
    place = F.element_at(F.array(*map(F.lit, (" North", "South", "East "))), (F.col("o_custkey") % 3 + 1).cast("int"))
    start = F.to_date("o_orderdate")
    cards = table(spark, sf_dir, "orders").select(
        F.lit("Cash").alias("insurer"),
        F.when(F.col("o_orderkey") % 1000 == 1, "PT Visit").otherwise("SN Visit").alias("task_name"),
        place.alias("location"),
        start.alias("from_date"),
        F.when(F.col("o_orderkey") % 2000 == 0, F.lit(date(9999, 12, 31))).otherwise(start).alias("to_date"),
        F.when(F.col("o_orderkey") % 2 == 0, "Unit").otherwise("Hourly").alias("type"),
        F.col("o_totalprice").alias("rate"),
    )
    visits = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_suppkey") % 30 != 0, "Cash").alias("insurance"),
        F.when(F.col("l_partkey") % 100 == 0, "PT Visit").otherwise("SN Visit").alias("task_name"),
        F.element_at(F.array(*map(F.lit, ("north", "SOUTH", "West"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("agency"),
        F.to_date("l_shipdate").alias("visit_date"),
        F.lit(2.0).alias("total_hours"),
    )
    return rate_card_revenue(visits, cards).drop("insurance", "total_hours")


def _order_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as episodic visits of their own order."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("unique_visit_id"),
        F.when(F.col("l_suppkey") % 20 != 0, F.col("l_orderkey").cast("string")).alias("episode_identifier"),
        F.to_date("l_shipdate").alias("visit_date"),
    )


def _order_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as billing periods of 400 days, some twice over, some without id."""
    orders = table(spark, sf_dir, "orders")
    start = F.to_date("o_orderdate")

    def periods(df: DataFrame, prefix: str, shift: int) -> DataFrame:
        ident = F.concat(F.lit(prefix), F.col("o_orderkey").cast("string"))
        return df.select(
            F.when(F.col("o_orderkey") % 31 != 0, ident).alias("billing_period_id"),
            F.col("o_orderkey").cast("string").alias("episode_identifier"),
            F.date_add(start, shift).alias("billing_period_start_date"),
            F.date_add(start, shift + 399).alias("billing_period_end_date"),
            F.col("o_totalprice").alias("period_ongoing_revenue"),
            F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("period_closed_revenue"),
            (F.col("o_orderkey") % 4).alias("total_completed_visits"),
        )

    late = orders.where(F.col("o_orderkey") % 5 == 0)
    return periods(orders, "a", 0).unionByName(periods(late, "b", 45))


def q_prorate_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = prorate_by_month(_order_visits(spark, sf_dir), _order_periods(spark, sf_dir))
    return spread.select(
        "unique_visit_id",
        "visit_date",
        "billing_period_id",
        "billing_period_days_in_month",
        "prorate_percent",
        "visits_in_month",
        "ongoing_revenue",
        "closed_revenue",
    )


def q_interval_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = interval_left_join(
        _order_visits(spark, sf_dir),
        _order_periods(spark, sf_dir),
        EPISODE_EQ,
        "visit_date",
        "billing_period_start_date",
        "billing_period_end_date",
        ["billing_period_id"],
    )
    return joined.select("unique_visit_id", "visit_date", "billing_period_id")


def q_align_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _done_visits(spark, sf_dir).select("unique_visit_id", "mrn", "agency", "visit_date", "total_hours")
    return align_revenue(visits).select(
        "unique_id", "mrn", "agency", "revenue_date", "hours_worked", "billing_period_id", "revenue", "eoe_date"
    )


def q_add_flags_and_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of the revenue fact on visits that all lack a price."""
    visits = _done_visits(spark, sf_dir)
    rated = visits.where(F.col("visit_type") == "Clinical").withColumn(
        "revenue", F.when(F.col("total_hours") > 1, F.col("total_hours"))
    )
    spread = visits.where(F.col("visit_type") == "HHA").withColumns(
        {
            "closed_revenue": F.when(F.col("total_hours") > 2, F.lit(5.0)),
            "ongoing_revenue": F.when(F.col("total_hours") > 1, F.lit(3.0)),
        }
    )
    load = [role(spark, sf_dir, n) for n in ("pdgm_flags", "revenue_exceptions")]
    return revenue_fact(rated, spread, *load).select(
        "unique_id", "updated_at", "insurance", "revenue", "closed_revenue", "ongoing_revenue", "pdgm_non_pdgm"
    )


# The columns of a claim that the star tables can fill.
CLAIMS_FILLED = [c for c in CLAIM_COLUMNS if c not in ("payer_type", "branch", "medicare_subscriber_number")]


def _claim_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as priced visits of a customer at an agency."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    sold = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return sold.select(
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("unique_id"),
        F.col("o_custkey").cast("string").alias("mrn"),
        F.col("l_returnflag").alias("agency"),
        F.to_date("l_shipdate").alias("visit_date"),
        F.col("l_extendedprice").alias("revenue"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("o_orderpriority")).alias("insurance"),
    )


def _order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims of 121 days, several versions to a claim id."""
    start = F.to_date("o_orderdate")
    status = F.col("o_orderstatus")
    empty = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat_ws("-", "o_custkey", F.col("o_orderkey") % 8).alias("unique_claim_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.date_add(start, 130).alias("billed_date"),
        F.lit("p").alias("patient_name"),
        F.col("o_custkey").cast("string").alias("mrn"),
        F.col("o_orderkey").cast("string").alias("claim_number"),
        F.col("o_orderpriority").alias("claim_status"),
        start.alias("billing_period_start_date"),
        F.date_add(start, 120).alias("billing_period_end_date"),
        F.lit("329").alias("tob"),
        empty.alias("insurance"),
        empty.alias("payer_type"),
        empty.alias("branch"),
        empty.alias("medicare_subscriber_number"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("anticipated_payment"),
        F.when(status == "F", "A").when(status == "O", "N").otherwise("R").alias("agency"),
    )


def q_allocate_first_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    allocated = allocate_first_claim(_order_claims(spark, sf_dir), _claim_revenue(spark, sf_dir))
    return allocated.select(*CLAIMS_FILLED, "expected_revenue")


def q_latest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    allocated = allocate_first_claim(_order_claims(spark, sf_dir), _claim_revenue(spark, sf_dir))
    return latest_claims(allocated).select(*CLAIMS_FILLED)


def q_open_receivables(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = stage(_claim_revenue(spark, sf_dir), "revenue")
    counted = latest_claims(allocate_first_claim(_order_claims(spark, sf_dir), revenue))
    priced = revenue.withColumnsRenamed({"unique_id": "unique_visit_id"}).withColumn(
        "total_hours", F.lit(0.0)
    )
    fact = align_revenue(priced).withColumn("pdgm_non_pdgm", F.lit("Non PDGM"))
    rows = open_receivables(fact, stage(paid_periods(counted), "paid_periods"))
    return rows.select("unique_id", "mrn", "agency", "visit_date", "insurance", "open_amount")


def q_drop_advance_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = drop_advance_claims(standing_claims(role(spark, sf_dir, "claims"), SNAPSHOT))
    return claims.select(*CLAIMS_FILLED)


def q_map_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = [role(spark, sf_dir, n) for n in ("claims", "insurance_map")]
    return map_claims(*load).select("claim_number", "agency", "insurance", "parent_insurance", "insurance_type")


# ---- the report -------------------------------------------------------------


def q_revenue_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs(spark, sf_dir)
    return price_visits(known_on(found, SNAPSHOT), found)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_report(inputs(spark, sf_dir), SNAPSHOT)


def q_open_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


def q_read_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report from tables in files, through the library's own reader."""
    folder = owned_path(spark, "inputs")
    for name, df in inputs(spark, sf_dir)._asdict().items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return open_report(read_parquet_inputs(spark, folder), SNAPSHOT)


def q_export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders exported as Parquet and read back."""
    path = owned_path(spark, "export")
    write_detail(table(spark, sf_dir, "orders"), path)
    return read_detail(spark, path)


def q_open_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = (date(1999, 1, 1), date(2000, 12, 31))
    return dashboard(_report(spark, sf_dir), TODAY, *span).detail


def q_export_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aged detail with all its columns, exported in both forms and read back with its types."""
    span = (date(1999, 1, 1), date(2000, 12, 31))
    detail = stage(dashboard(_report(spark, sf_dir), TODAY, *span).detail, "detail")
    found = []
    for form in ("parquet", "csv"):
        path = owned_path(spark, f"detail-{form}")
        write_detail(detail, path, form)
        write_detail(detail, path, form)  # replaces the former as a whole
        found.append(read_detail(spark, path).withColumn("form", F.lit(form)))
    return found[0].unionByName(found[1])


def q_export_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, line ends, blanks at their ends, nothing and NULL, through CSV."""
    key = F.col("o_orderkey")
    odd = F.when(key % 7 == 0, F.lit("")).when(key % 7 == 1, F.lit(None)).when(key % 7 == 2, F.lit('a "b", c'))
    odd = odd.when(key % 7 == 3, F.lit(" two\nlines\\ ")).when(key % 7 == 4, F.lit('""')).otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", odd.alias("note"), "o_totalprice", "o_orderdate", F.to_date("o_orderdate").alias("day"))
    path = owned_path(spark, "texts")
    write_detail(rows, path, "csv")
    return read_detail(spark, path)


def q_reports_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several days' reports from one scan of the history."""
    return open_reports(inputs(spark, sf_dir), REPORT_DAYS)


def q_version_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visit versions known on each of several days."""
    spans = version_spans(role(spark, sf_dir, "visits"), ["unique_visit_id"], "updated_at", VERSION_TIEBREAK, ["status"])
    return versions_on(spans, REPORT_DAYS).select("snapshot", "unique_visit_id", "updated_at", "status")


def q_conform_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions as integers, numbers and decimals as text, instants as days."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") / 100).alias("whole"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") + 0.5).alias("number"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_tax")).cast("decimal(12,2)").alias("exact"),
        F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_suppkey") * 977 % 86400).alias("day"),
    )
    wanted = StructType.fromDDL(
        "l_orderkey bigint, l_linenumber bigint, whole bigint, number string, exact string, day date, missing string"
    )
    return conform(lines, wanted)


def q_catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report from tables of the session's catalog."""
    names = {}
    for name, df in inputs(spark, sf_dir)._asdict().items():
        names[name] = f"catalog_{name}"
        df.createOrReplaceTempView(names[name])
    return open_report(read_catalog_inputs(spark, names), SNAPSHOT)


def q_open_amount_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard(_report(spark, sf_dir), TODAY).total


def q_open_by_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard(_report(spark, sf_dir), TODAY).by_agency


def q_open_by_insurance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard(_report(spark, sf_dir), TODAY).by_insurance


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
