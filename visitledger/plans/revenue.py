"""Expected revenue per visit: rate card, or a share of an episodic payment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from visitledger import constants as k
from visitledger.functions import cents, normal_name
from visitledger.operators import drop_excluded, interval_hits, spread_left_join
from visitledger.operators.intervals import crowded_hits, join_hits, point_rows
from visitledger.sources.schemas import REVENUE
from visitledger.sources.staging import stage
from visitledger.sources.tables import conform

# What both kinds of pricing bring, before the PDGM flag is added.
PRICED = StructType([f for f in REVENUE.fields if f.name != "pdgm_non_pdgm"])

EPISODE_EQ = [("episode_identifier", "episode_identifier")]


def priced_visits(visits: DataFrame) -> DataFrame:
    """The visits of `per_visit_payers` and `episodic_payers` together."""
    model = F.col("payment_model")
    priced = drop_excluded(visits, "task_name", k.UNPRICED_TASKS)
    return priced.where(model.isin(k.PER_VISIT, k.EPISODIC) | model.isNull())


def per_visit_payers(visits: DataFrame) -> DataFrame:
    """Priced tasks of visits paid per visit or of no known payment model."""
    model = F.col("payment_model")
    priced = drop_excluded(visits, "task_name", k.UNPRICED_TASKS)
    return priced.where((model == k.PER_VISIT) | model.isNull())


def episodic_payers(visits: DataFrame) -> DataFrame:
    """Priced tasks of visits paid by episode."""
    priced = drop_excluded(visits, "task_name", k.UNPRICED_TASKS)
    return priced.where(F.col("payment_model") == k.EPISODIC)


#: Cards of one payer, task and place that a visit is compared with one by one at most.
CROWD = 64
#: Cards of one day that travel together at most.
CARD_LIST = 256

_CARD_KEY = ["card_insurer", "card_task", "card_place"]
_VISIT_KEY = ["insurance", "task_name", "__place"]
_CARD_EQ = list(zip(_VISIT_KEY, _CARD_KEY))
_CARD_SPAN = {"lo": "rate_card_from_date", "hi": "rate_card_to_date"}


def rate_card_revenue(visits: DataFrame, rate_cards: DataFrame) -> DataFrame:
    """Add rate type, rate, validity and revenue from the cards valid on the visit day.

    Hourly cards pay rate x hours rounded to cents, unit cards the rate; other
    types pay NULL. Overlapping cards repeat the visit, as they do in the total.

    Rate cards are a mapping: one left join on payer, task and place with the
    dates beside it. Spark broadcasts the cards while they are under its own
    limit, and the visits are read once and do not move. Where a key has more
    than CROWD cards, its visits are priced by day (`_price_by_day`), so no visit
    is compared with them one by one.
    """
    cards = rate_cards.select(
        F.col("insurer").alias("card_insurer"),
        F.col("task_name").alias("card_task"),
        normal_name("location").alias("card_place"),
        F.col("from_date").alias("rate_card_from_date"),
        F.col("to_date").alias("rate_card_to_date"),
        F.col("type").alias("rate_type"),
        "rate",
    )
    placed = visits.withColumn("__place", normal_name("agency"))
    crowds = cards.groupBy(*_CARD_KEY).count().where(F.col("count") > CROWD).dropna().select(*_CARD_KEY)
    if crowds.isEmpty():
        priced = _price(placed, cards)
    else:
        crowds = stage(crowds, "crowded_cards")
        crowded = [F.col(a) == F.col(b) for a, b in _CARD_EQ]
        # what is left is mostly small, and Spark knows it once written: the other visits do not move then
        others = stage(cards.join(crowds, _CARD_KEY, "left_anti"), "other_cards")
        few = _price(placed.join(crowds, crowded, "left_anti"), others)
        many = _price_by_day(placed.join(crowds, crowded, "left_semi"), cards.join(crowds, _CARD_KEY, "left_semi"))
        priced = few.unionByName(many)
    rate, kind = F.col("rate"), F.col("rate_type")
    amount = F.when(kind == k.HOURLY, cents(rate * F.col("total_hours"))).when(
        kind == k.UNIT, rate
    )
    return priced.drop("__place").withColumn("revenue", amount.cast("double"))


def _price(visits: DataFrame, cards: DataFrame) -> DataFrame:
    """Each visit with the cards of its key that are valid on its day."""
    valid = [F.col(a) == F.col(b) for a, b in _CARD_EQ]
    valid.append(F.col("visit_date").between(*(F.col(c) for c in _CARD_SPAN.values())))
    return visits.join(cards, valid, "left").drop(*_CARD_KEY)


def _price_by_day(visits: DataFrame, cards: DataFrame) -> DataFrame:
    """The same for keys with many cards: the cards of every day on which a key has visits are found first.

    The bounds of cards, each pair once, look their first and last day up among the
    days of their key, cards meet the days of their bounds, and the
    visits then meet the cards of their day by equality alone. The cards of a day
    come as lists of CARD_LIST at most, so a visit meets few rows and is repeated
    for each card only at the very end, without being compared or copied before.
    The lists are put together in tasks dealt out by key and day, and staged. They are
    merged with the visits whatever their size: their files are far smaller than they are
    in memory, and what a task does depends on the pairs and not on the bytes it reads,
    so its tasks are not put together by size either.
    """
    take = [*_CARD_SPAN.values(), "rate_type", "rate"]
    hits = crowded_hits(point_rows(visits, _CARD_EQ, "visit_date", []), cards, _CARD_EQ, take=take, **_CARD_SPAN)
    day = [c for c in hits.columns if c not in take]
    nth = F.row_number().over(Window.partitionBy(*day).orderBy("__at"))  # any order will do
    parts = hits.repartition(*day).withColumn("__part", F.floor((nth - 1) / CARD_LIST)).groupBy(*day, "__part")
    lists = parts.agg(F.collect_list(F.struct(*take)).alias("__cards")).drop("__part")
    tasks = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = join_hits(visits, stage(lists, "cards_by_day").hint("merge"), _CARD_EQ, "visit_date", tasks)
    return met.select("*", F.inline_outer("__cards")).drop("__cards")


def prorate_by_month(visits: DataFrame, periods: DataFrame) -> DataFrame:
    """Spread each period payment over the visits of each calendar month.

    Adds the period's columns, the days of the period in the visit's month, that
    as a share of the month, the visits sharing it, and the ongoing and closed
    revenue per visit. Visits in no period keep NULLs; a visit in several
    periods appears once for each.

    Everything is worked out per (episode, day) with the number of visits on
    that day, so visits of a crowded month are counted by summing days and the
    visit rows themselves are shuffled once.
    """
    days = (
        visits.where(F.col("episode_identifier").isNotNull() & F.col("visit_date").isNotNull())
        .groupBy(F.col("episode_identifier").alias("__k0"), F.col("visit_date").alias("__at"))
        .agg(F.count(F.lit(1)).alias("day_visits"))
    )
    return join_hits(visits, prorated_days(days, periods), EPISODE_EQ, "visit_date")


def prorated_days(days: DataFrame, periods: DataFrame) -> DataFrame:
    """What `prorate_by_month` adds, for each episode (`__k0`) and day (`__at`) with `day_visits` visits."""
    take = [c for c in periods.columns if c != "episode_identifier"]
    hits = interval_hits(
        days,
        periods,
        EPISODE_EQ,
        "billing_period_start_date",
        "billing_period_end_date",
        take,
    ).withColumn("month_start", F.trunc("__at", "month").cast("date"))

    # A period without an id has no count of its own: NULL keys do not join.
    crowd = (
        hits.where(F.col("billing_period_id").isNotNull())
        .groupBy("billing_period_id", "month_start")
        .agg(F.sum("day_visits").alias("visits_in_month"))
    )
    shared = hits.join(crowd, ["billing_period_id", "month_start"], "left")

    # A hit always has both bounds, so clamping to the month never meets a NULL.
    month_end = F.last_day("month_start")
    overlap = F.date_diff(
        F.least("billing_period_end_date", month_end),
        F.greatest("billing_period_start_date", "month_start"),
    )
    month_days = F.dayofmonth(month_end)
    share = F.col("billing_period_days_in_month") / month_days
    ongoing = F.col("period_ongoing_revenue") * F.col("prorate_percent")
    return (
        shared.withColumn("billing_period_days_in_month", (overlap + 1).cast("bigint"))
        .withColumn("prorate_percent", share)
        .withColumn("ongoing_revenue", ongoing / F.nullif("visits_in_month", F.lit(0)))
        .withColumn(
            "closed_revenue",
            F.col("period_closed_revenue") / F.nullif("total_completed_visits", F.lit(0)),
        )
        .drop("month_start", "day_visits")
    )


def align_revenue(df: DataFrame) -> DataFrame:
    """Rename visit columns to report columns and fill the missing ones."""
    return _aligned(df, PRICED)


def _aligned(df: DataFrame, schema: StructType) -> DataFrame:
    renamed = (
        df.withColumnRenamed("unique_visit_id", "unique_id")
        .withColumnRenamed("total_hours", "hours_worked")
        .withColumn("revenue_date", F.col("visit_date"))
    )
    return conform(renamed, schema)


def with_exceptions(visits: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Visits with the amounts of their exceptions as `new_revenues`, for `revenue_fact`.

    Where the newest version of a visit has just been found, the visits are dealt
    out by id already, and only the exceptions move. Repeated ones are kept, as
    elements of the list, so visits are not repeated before they are counted.
    """
    known = exceptions.where(F.col("unique_id").isNotNull())
    fixes = known.groupBy(F.col("unique_id").alias("__fixed")).agg(F.collect_list(F.struct("new_revenue")).alias("new_revenues"))
    return visits.join(fixes, F.col("unique_visit_id") == F.col("__fixed"), "left").drop("__fixed")


def revenue_fact(
    rated: DataFrame,
    prorated: DataFrame,
    pdgm_flags: DataFrame,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """Both kinds of priced visits in one table of 35 columns.

    Episodic revenue is the closed amount where known, else the ongoing one. An
    exception fills in a missing amount but never replaces one. Repeated flags
    or exceptions repeat the visit. Without `exceptions` the visits bring theirs
    along, from `with_exceptions`.
    """
    amount = F.coalesce("closed_revenue", "ongoing_revenue")
    brought = [rated.schema["new_revenues"]] if exceptions is None else []
    schema = StructType([*PRICED.fields, *brought])
    both = _aligned(rated, schema).unionByName(
        _aligned(prorated.withColumn("revenue", amount), schema)
    )
    flags = pdgm_flags.where(F.col("pdgm_non_pdgm") == k.PDGM).select(
        F.col("office").alias("agency"), "insurance", "pdgm_non_pdgm"
    )
    flagged = both.join(flags, ["agency", "insurance"], "left")
    if exceptions is None:
        fixed = flagged.withColumn("__fix", F.explode_outer("new_revenues")).withColumn("new_revenue", F.col("__fix.new_revenue"))
    else:
        fixes = exceptions.select(F.col("unique_id").alias("__fixed"), "new_revenue")
        fixed = spread_left_join(flagged, fixes, [("unique_id", "__fixed")])
    return (
        fixed.withColumn("pdgm_non_pdgm", F.coalesce("pdgm_non_pdgm", F.lit(k.NON_PDGM)))
        .withColumn("revenue", F.coalesce("revenue", "new_revenue"))
        .select(*REVENUE.fieldNames())
    )
