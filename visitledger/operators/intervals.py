"""Points in date intervals, built to survive one key holding most of the rows.

A join on the key with the range as a residual filter compares every point of a
key with every interval of it. That is fine for an ordinary patient and
quadratic for a hot one, so the operators here

- reduce points to distinct (key, day) before comparing. A key then has at most
  one point per calendar day, however many rows it holds;
- keep the days of a key as one sorted array, which the calendar bounds, and look
  the two ends of every interval up in it by binary search, so that an interval
  costs as much as the points inside it, whatever its length;
- or replace the comparison by a running maximum over days where only the
  existence of a match counts.

Dates are whole days and both interval ends are inclusive. A NULL key, point or
bound matches nothing, and neither does an interval that ends before it starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitledger.operators.keys import count_below, first_per_key, spread_left_join

Keys = Sequence[tuple[str, str]]


def _names(eq: Keys) -> list[str]:
    return [f"__k{i}" for i in range(len(eq))]


def point_rows(df: DataFrame, eq: Keys, point: str, keep: Sequence[str]) -> DataFrame:
    """Rows with a key and a day, as `__k0`, .., `__at` and the `keep` columns."""
    keys = [F.col(left).alias(k) for (left, _), k in zip(eq, _names(eq))]
    return df.select(*keys, F.col(point).alias("__at"), *keep).dropna(
        subset=[*_names(eq), "__at"]
    )


def _span_rows(
    df: DataFrame, eq: Keys, lo: str, hi: str, keep: Sequence[str]
) -> DataFrame:
    keys = [F.col(right).alias(k) for (_, right), k in zip(eq, _names(eq))]
    bounds = [F.col(lo).alias("__lo"), F.col(hi).alias("__hi")]
    return (
        df.select(*keys, *bounds, *keep)
        .dropna(subset=_names(eq))
        .where(F.col("__lo") <= F.col("__hi"))
    )


def distinct_points(df: DataFrame, eq: Keys, point: str) -> DataFrame:
    """Distinct (key, day) of the non-NULL points, combined before the shuffle."""
    return point_rows(df, eq, point, []).distinct()


def _rest(points: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in points.columns if c not in (*keys, "__at")]


def _looked_up(points: DataFrame, spans: DataFrame, keys: list[str], how: str = "inner", gather=F.collect_set) -> DataFrame:
    """Spans with the sorted days of their key, and where those inside begin (`__first`) and end (`__until`)."""
    rest = _rest(points, keys)
    # bare days become distinct by `collect_set`, per task and then per key: they move once
    found = F.collect_list(F.struct("__at", *rest)) if rest else gather("__at")
    days = points.groupBy(*keys).agg(F.sort_array(found).alias("__days"))
    # the days by themselves, made once per key: the search looks at single elements
    days = days.withColumn("__ats", F.transform("__days", lambda x: x["__at"]) if rest else F.col("__days"))
    met = spans.join(days if rest else days.drop("__days"), keys, how)
    first = count_below(F.col("__ats"), F.col("__lo"))
    until = count_below(F.col("__ats"), F.date_add("__hi", 1))
    return met.withColumn("__first", first).withColumn("__until", until)


def _by_day(found: DataFrame, points: DataFrame, spans: DataFrame, keys: list[str], explode=F.explode) -> DataFrame:
    """What `_looked_up` found, a row for each day inside."""
    rest = _rest(points, keys)
    within = F.slice("__days" if rest else "__ats", F.col("__first") + 1, F.col("__until") - F.col("__first"))
    hit = found.withColumn("__day", explode(F.when(F.col("__first") < F.col("__until"), within)))
    day = [F.col("__day")[c].alias(c) for c in ("__at", *rest)] if rest else [F.col("__day").alias("__at")]
    return hit.select(*keys, *day, *(c for c in spans.columns if c not in keys))


def _inside(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each (point, span) pair with the point inside the span, exactly once.

    `points` are distinct in key and `__at`, or have nothing else. They move once and
    become one row per key; spans move once, and only those of keys with points go on. Where a
    key holds most of the spans, Spark's handling of skewed joins deals them out.
    """
    return _by_day(_looked_up(points, spans, keys).where("__first < __until"), points, spans, keys)


def interval_hits(
    points: DataFrame, spans: DataFrame, eq: Keys, lo: str, hi: str, take: Sequence[str]
) -> DataFrame:
    """All spans over each distinct point, with the `take` columns of the span.

    `points` comes from `point_rows`, and is unique in key and day if columns ride
    along. The result has the key as `__k0`, `__k1`, .. and the day as `__at`.
    """
    rows = _span_rows(spans, eq, lo, hi, take)
    return _inside(points, rows, _names(eq)).drop("__lo", "__hi")


def crowded_hits(
    points: DataFrame, spans: DataFrame, eq: Keys, lo: str, hi: str, take: Sequence[str]
) -> DataFrame:
    """`interval_hits` of bare points, for keys with many times more spans than days.

    Distinct bounds are looked up among the days of their key, and every span then
    meets the days of its own bounds by equality. So no span goes along with all days
    of its key, and the spans are dealt out by key and bounds; where very many have
    the same, Spark's handling of skewed joins splits them.
    """
    keys = _names(eq)
    bounds = [*keys, "__lo", "__hi"]
    rows = _span_rows(spans, eq, lo, hi, take)
    found = _looked_up(points, rows.select(*bounds).distinct(), keys).where("__first < __until")
    within = F.slice("__ats", F.col("__first") + 1, F.col("__until") - F.col("__first"))
    met = rows.join(found.select(*bounds, within.alias("__within")), bounds)
    return met.select(*keys, F.explode("__within").alias("__at"), *take)


def join_hits(left: DataFrame, hits: DataFrame, eq: Keys, point: str, tasks: int | None = None) -> DataFrame:
    """Left join of rows to what `interval_hits` found for their key and day."""
    on = [*((c, k) for (c, _), k in zip(eq, _names(eq))), (point, "__at")]
    return spread_left_join(left, hits, on, tasks).drop(*_names(eq), "__at")


def interval_left_join(
    left: DataFrame,
    right: DataFrame,
    eq: Keys,
    point: str,
    lo: str,
    hi: str,
    take: Sequence[str],
) -> DataFrame:
    """Left outer join on key equality and `lo <= point <= hi`, all matches kept.

    `left` is read twice, once for the few columns of its distinct points; stage
    it first if it is expensive. The wide rows move once, on (key, day).
    """
    points = point_rows(left, eq, point, [])
    hits = interval_hits(points, right, eq, lo, hi, take)
    return join_hits(left, hits, eq, point)


def cover_days(
    days: DataFrame,
    spans: DataFrame,
    eq: Keys,
    lo: str,
    hi: str,
    order: Sequence[Column],
    take: Sequence[str],
) -> DataFrame:
    """For each of `days` the first span over it under `order`.

    `days` is from `point_rows`; if unique in (`__k0`, .., `__at`) it may carry more
    columns, which come back with `take`; days no span covers are absent. Of the spans with the
    same key and bounds only the first can ever be chosen, so the rest are
    dropped per task, before the shuffle; a hot key is thus left with one row
    per distinct pair of dates.
    """
    keys = _names(eq)
    rows = _span_rows(spans, eq, lo, hi, take)
    best = first_per_key(rows, [*keys, "__lo", "__hi"], order)
    pairs = _inside(days, best, keys)
    return first_per_key(pairs, [*keys, "__at"], order).drop("__lo", "__hi")


def cover_days_or_none(
    days: DataFrame,
    spans: DataFrame,
    eq: Keys,
    lo: str,
    hi: str,
    order: Sequence[Column],
    take: Sequence[str],
) -> DataFrame:
    """`cover_days`, and besides every span that contains no day, with NULL for the day.

    Only spans with a key that do not end before they start are looked at. They
    move once and stay with their key to the end, so all spans of a key meet in
    one task: keys with very many of them are for `cover_days` and
    `spans_without_points`. `days` are distinct.
    """
    keys = _names(eq)
    rows = _span_rows(spans, eq, lo, hi, take).repartition(*keys)
    alike = Window.partitionBy(*keys, "__lo", "__hi").orderBy(*order)
    found = _looked_up(days, rows.withColumn("__nth", F.row_number().over(alike)), keys, "left", F.collect_list)
    idle = ~F.coalesce(F.col("__first") < F.col("__until"), F.lit(False))
    pairs = _by_day(found.where(idle | (F.col("__nth") == 1)), days, rows, keys, F.explode_outer)
    rival = Window.partitionBy(*keys, "__at").orderBy(*order)
    ranked = pairs.withColumn("__rank", F.row_number().over(rival))
    return ranked.where(F.col("__at").isNull() | (F.col("__rank") == 1)).drop("__rank", "__lo", "__hi")


def first_cover(
    points: DataFrame,
    spans: DataFrame,
    eq: Keys,
    point: str,
    lo: str,
    hi: str,
    order: Sequence[Column],
    take: Sequence[str],
) -> DataFrame:
    """For each distinct (key, day) of `points` the first span over it.

    Returns key columns and day under their `points` names plus `take`; days no
    span covers are absent. `order` may use `take` columns only.
    """
    days = point_rows(points, eq, point, [])
    chosen = cover_days(days, spans, eq, lo, hi, order, take)
    names = [F.col(k).alias(left) for (left, _), k in zip(eq, _names(eq))]
    return chosen.select(*names, F.col("__at").alias(point), *take)


def covered_points(
    points: DataFrame, spans: DataFrame, eq: Keys, point: str, lo: str, hi: str
) -> DataFrame:
    """Distinct (key, day) of the points that lie in at least one span.

    A day is covered when the latest end among the spans begun so far has not
    passed. Per key that is a running maximum over distinct days, so no point is
    ever paired with a span.
    """
    return covered_days(distinct_points(points, eq, point), spans, eq, point, lo, hi)


def covered_days(days: DataFrame, spans: DataFrame, eq: Keys, point: str, lo: str, hi: str) -> DataFrame:
    """`covered_points` of days that are distinct already, from `point_rows`."""
    keys = _names(eq)
    reach = (
        _span_rows(spans, eq, lo, hi, [])
        .groupBy(*keys, F.col("__lo").alias("__at"))
        .agg(F.max("__hi").alias("__reach"))
    )
    marks = days.select(
        *keys, "__at", F.lit(None).cast("date").alias("__reach"), F.lit(True).alias("__is_point")
    ).unionByName(reach.withColumn("__is_point", F.lit(False)))
    # The default frame takes in all rows of the current day, whatever their order.
    so_far = Window.partitionBy(*keys).orderBy("__at")
    names = [F.col(k).alias(left) for (left, _), k in zip(eq, keys)]
    return (
        marks.withColumn("__until", F.max("__reach").over(so_far))
        .where(F.col("__is_point") & (F.col("__until") >= F.col("__at")))
        .select(*names, F.col("__at").alias(point))
    )


def cover_semi(
    left: DataFrame, spans: DataFrame, eq: Keys, point: str, lo: str, hi: str
) -> DataFrame:
    """Rows of `left` whose point lies in some span of their key."""
    covered = covered_points(left, spans, eq, point, lo, hi)
    return left.join(covered, [*(c for c, _ in eq), point], "left_semi")


def cover_anti(
    left: DataFrame, spans: DataFrame, eq: Keys, point: str, lo: str, hi: str
) -> DataFrame:
    """Rows of `left` in no span of their key; NULL keys and points stay."""
    covered = covered_points(left, spans, eq, point, lo, hi)
    return left.join(covered, [*(c for c, _ in eq), point], "left_anti")


def spans_without_points(
    spans: DataFrame, points: DataFrame, eq: Keys, point: str, lo: str, hi: str
) -> DataFrame:
    """Rows of `spans` that contain no point of their key.

    The mirror of `covered_points`: the nearest point on or after each distinct
    start, found by a running minimum from the last day back. `eq` pairs are
    (point column, span column) as everywhere here.
    """
    keys = _names(eq)
    days = distinct_points(points, eq, point)
    starts = _span_rows(spans, eq, lo, hi, []).select(*keys, F.col("__lo").alias("__at"))
    marks = days.select(
        *keys, "__at", F.col("__at").alias("__day"), F.lit(False).alias("__is_start")
    ).unionByName(
        starts.distinct()
        .withColumn("__day", F.lit(None).cast("date"))
        .withColumn("__is_start", F.lit(True))
    )
    onward = Window.partitionBy(*keys).orderBy(F.col("__at").desc())
    nearest = (
        marks.withColumn("__next", F.min("__day").over(onward))
        .where(F.col("__is_start") & F.col("__next").isNotNull())
        .select(*keys, "__at", "__next")
    )
    on = [F.col(right) == F.col(k) for (_, right), k in zip(eq, keys)]
    on += [F.col(lo) == F.col("__at"), F.col(hi) >= F.col("__next")]
    return spans.join(nearest, on, "left_anti")
