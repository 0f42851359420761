"""Snapshots and one-row-per-key selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType


def _zoned(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, TimestampType)


def _day(df: DataFrame, column: str) -> Column:
    """The calendar date of a timestamp; of an instant the one in UTC."""
    if _zoned(df, column):
        return F.date_from_unix_date(F.floor(F.unix_seconds(column) / 86400).cast("int"))
    return F.to_date(column)


def snapshot_dates(df: DataFrame, updated: str) -> DataFrame:
    """Distinct calendar dates of `updated` as ISO text, newest first; UTC for instants."""
    days = df.select(_day(df, updated).cast("string").alias("snapshot_date"))
    return days.distinct().orderBy(F.col("snapshot_date").desc())


def as_of(df: DataFrame, updated: str, day: date) -> DataFrame:
    """Rows recorded before `day`; the day itself is out.

    Spark turns the date comparison into a timestamp bound that reaches the
    Parquet reader, so older-only files and row groups are all that is read. The
    bound of instants is midnight UTC, whatever the session's zone.
    """
    if _zoned(df, updated):
        midnight = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
        return df.where(F.col(updated) < F.timestamp_seconds(F.lit(int(midnight.timestamp()))))
    return df.where(F.to_date(updated) < F.lit(day))


def count_below(values: Column, bound: Column) -> Column:
    """How many elements of a sorted array are below `bound`, by binary search."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(values).cast("long"))))

    def halve(s: Column, _: Column) -> Column:
        low, high = s["low"], s["high"]
        middle = F.shiftright(low + high, 1)
        upper = F.struct((middle + 1).alias("low"), high.alias("high"))
        lower = F.struct(low.alias("low"), middle.alias("high"))
        return F.when(low >= high, s).when(F.get(values, middle) < bound, upper).otherwise(lower)

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve)["low"]


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The first row of each key under `order`; NULL keys form one group.

    End `order` with tie-break columns to make the choice repeatable. Spark cuts
    each task's input to one row per key before the shuffle (WindowGroupLimit),
    so a key holding most of the rows still sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(window))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


#: Over so many parts left rows without a key are dealt out.
SPREAD = 4096


def spread_left_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], tasks: int | None = None) -> DataFrame:
    """Left join on pairs of column names, which differ, with all columns of both sides.

    Rows of `left` with a NULL key match nothing, but a join would send them all
    to one task. Here they get a number of their own, made of all their columns,
    as one more key, which no row of `right` has. With `tasks` the join has so many,
    even where few bytes are read.
    """
    nothing = reduce(or_, (F.col(a).isNull() for a, _ in on))
    own = F.when(nothing, F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("long"))
    # always 0, but not a literal, which the optimiser would take out of the join
    none = F.pmod(F.xxhash64(*(b for _, b in on)), F.lit(1))
    spread, plain = left.withColumn("__own", own), right.withColumn("__none", none)
    if tasks is not None:
        spread = spread.repartition(tasks, *(a for a, _ in on), "__own")
    same = [F.col(a) == F.col(b) for a, b in (*on, ("__own", "__none"))]
    return spread.join(plain, same, "left").drop("__own", "__none")


def narrowed(
    df: DataFrame, keys: Sequence[str], version: str, tiebreak: Sequence[str], columns: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """What choosing versions needs if only `columns` are used, and the tie-break among that.

    Versions are compared on `tiebreak` up to the last used column. Those that
    still tie agree in all that is used, so the choice is that of the whole rows
    and the rest of the history is not read.
    """
    used = [c for c in dict.fromkeys(columns) if c not in (*keys, version)]
    unordered = [c for c in used if c not in tiebreak]
    if unordered:
        raise ValueError(f"versions that tie may differ in {unordered}, which the tie-break lacks")
    compared = list(tiebreak)[: max((list(tiebreak).index(c) + 1 for c in used), default=0)]
    return df.select(*dict.fromkeys([*keys, version, *compared])), compared


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    version: str,
    tiebreak: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The newest version of each key; ties go to the lowest `tiebreak` values.

    With `columns`, the ones the caller goes on to use, only these and what
    `narrowed` compares besides are read, moved and returned.
    """
    if columns is not None:
        df, tiebreak = narrowed(df, keys, version, tiebreak, columns)
    return first_per_key(df, keys, _newest(version, tiebreak))


def _newest(version: str, tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(version).desc_nulls_last(), *(F.col(c).asc_nulls_first() for c in tiebreak)]


def version_spans(
    df: DataFrame,
    keys: Sequence[str],
    version: str,
    tiebreak: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    days: Sequence[date] | None = None,
) -> DataFrame:
    """The days on which each version is the newest one known, as `known_from` and `known_to`.

    A row is known from the day after it was recorded, until the day on which the
    key is recorded anew; `known_to` is NULL for the newest. So for any day D the
    rows with D inside their span are `latest_per_key(as_of(df, version, D), ..)`,
    and one pass over the history serves all days. Of the versions of one day the
    last counts. Rows never recorded are left out.

    Versions are first thinned to one per key and day, per task and before the
    shuffle, so a key has at most one row per calendar day however hot it is.
    With `days` only what is the newest on one of these is kept, and the versions
    move once instead of twice: see `_spans_on`.
    """
    if columns is not None:
        df, tiebreak = narrowed(df, keys, version, tiebreak, columns)
    dated = df.where(F.col(version).isNotNull()).withColumn("__day", _day(df, version))
    if days and isinstance(df.schema[version].dataType, (TimestampType, TimestampNTZType)):
        return _spans_on(dated, keys, version, tiebreak, sorted(set(days)))
    daily = first_per_key(dated, [*keys, "__day"], _newest(version, tiebreak))
    onward = Window.partitionBy(*keys).orderBy("__day")
    spans = daily.withColumn("known_to", F.lead("__day").over(onward))
    return spans.withColumn("known_from", F.date_add("__day", 1)).drop("__day")


def _spans_on(dated: DataFrame, keys: Sequence[str], version: str, tiebreak: Sequence[str], days: Sequence[date]) -> DataFrame:
    """`version_spans` for some days: per key one minimum for each, over the versions known since the one before.

    The minimum is of version and tie-break as one value, that is the newest version.
    It is taken per task before the shuffle: a hot key sends one row per task.
    """
    zoned, epoch = _zoned(dated, version), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    age = -F.unix_micros(version) if zoned else epoch - F.col(version)
    rest = [c for c in dated.columns if c not in (*keys, version, "__day", *tiebreak)]
    row = F.struct(age.alias("__age"), *dict.fromkeys([*tiebreak, *rest]))
    slot = count_below(F.array(*[F.lit(d) for d in days]), F.date_add("__day", 1))
    newest = [F.min(F.when(F.col("__slot") == i, F.col("__row"))).alias(f"__{i}") for i in range(len(days))]
    slots = dated.select(*keys, slot.alias("__slot"), row.alias("__row")).where(F.col("__slot") < len(days))
    known = [F.struct(F.lit(d).alias("known_from"), F.col(f"__{i}").alias("row")) for i, d in enumerate(days)]
    found = F.filter(F.array(*known), lambda x: x["row"].isNotNull())

    def bounded(x: Column, i: Column) -> Column:
        until = F.date_sub(F.get("__found", i + 1)["known_from"], 1)
        return F.struct(x["row"].alias("row"), x["known_from"].alias("known_from"), until.alias("known_to"))

    spans = slots.groupBy(*keys).agg(*newest).select(*keys, found.alias("__found"))
    spans = spans.select(*keys, F.explode(F.transform("__found", bounded)).alias("__span"))
    kept = F.col("__span.row.__age")
    made = {c: F.col(f"__span.row.{c}") for c in (*tiebreak, *rest)} | {c: F.col(c) for c in keys}
    made[version] = F.timestamp_micros(-kept) if zoned else epoch - kept
    columns = [made[c].alias(c) for c in dated.columns if c != "__day"]
    return spans.select(*columns, F.col("__span.known_to").alias("known_to"), F.col("__span.known_from").alias("known_from"))


def known_on_day(spans: DataFrame, day: date) -> DataFrame:
    """The rows of `version_spans` known on `day`; the bounds reach the Parquet reader."""
    known = (F.col("known_from") <= F.lit(day)) & (F.col("known_to").isNull() | (F.col("known_to") >= F.lit(day)))
    return spans.where(known).drop("known_from", "known_to")


def versions_on(spans: DataFrame, days: Sequence[date]) -> DataFrame:
    """The rows of `version_spans` known on each of `days`, with the day as `snapshot`.

    A span finds its first and last day by binary search and is repeated for
    those between; one that holds no day, and nothing else, is dropped.
    """
    wanted = F.array(*[F.lit(d) for d in sorted(set(days))]) if days else F.array().cast("array<date>")
    first = count_below(wanted, F.col("known_from"))
    last = F.when(F.col("known_to").isNull(), F.size(wanted)).otherwise(count_below(wanted, F.date_add("known_to", 1)))
    placed = spans.withColumn("__first", first).withColumn("__many", last - F.col("__first"))
    found = placed.where("__many > 0").withColumn("snapshot", F.explode(F.slice(wanted, F.col("__first") + 1, F.col("__many"))))
    return found.drop("__first", "__many", "known_from", "known_to")
