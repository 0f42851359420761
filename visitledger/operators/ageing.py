"""The last mile: rounding, date range, totals and ageing tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger.constants import AGE_BUCKETS

COLUMN_TOTAL = "Column_Total"
ROW_TOTAL = "Row_Total"


def in_date_range(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Rows with start <= column <= end; rows without a date go."""
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row with the first and last date, the default range of the report."""
    return df.agg(F.min(column).alias("start_date"), F.max(column).alias("end_date"))


def open_total(df: DataFrame, amount: str) -> DataFrame:
    """One row with the sum of `amount`; no rows or only NULLs give zero.

    Counts future-dated rows and rows without a key, which the ageing matrices
    leave out, so the two need not agree.
    """
    return df.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"))


def _bucket(age: Column, low: int, high: int | None, amount: Column) -> Column:
    inside = age >= low if high is None else age.between(low, high)
    return F.when(inside, amount).otherwise(F.lit(0.0))


def aged_detail(df: DataFrame, day: str, amount: str, today: date) -> DataFrame:
    """Add `days_difference` up to `today` and one column per age bucket.

    The amount shows in the bucket of its age and 0 in the others; rows dated
    after `today` show 0 everywhere.
    """
    age = F.date_diff(F.lit(today), F.col(day)).cast("bigint")
    aged = df.withColumn("days_difference", age)
    values = {
        name: _bucket(F.col("days_difference"), low, high, F.col(amount))
        for name, low, high in AGE_BUCKETS
    }
    return aged.withColumns(values)


def ageing_matrix(
    df: DataFrame, key: str, day: str, amount: str, today: date
) -> DataFrame:
    """Bucket sums per key, a `Row_Total` column and a last `Column_Total` row.

    Rows with a NULL key are left out. Rows are combined to one per key before
    the totals row is added, so the rollup only ever sees the key list.
    """
    names = [name for name, _, _ in AGE_BUCKETS]
    aged = aged_detail(
        df.select(F.col(key).alias("__key"), F.col(day).alias("__day"), F.col(amount).alias("__amount"))
        .where(F.col("__key").isNotNull()),
        "__day",
        "__amount",
        today,
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.col(f"`{name}`")), F.lit(0.0)).alias(name)

    per_key = aged.groupBy("__key").agg(*[total(n) for n in names])
    whole = per_key.rollup("__key").agg(
        F.grouping("__key").alias("__total"), *[total(n) for n in names]
    )
    row_total = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    label = F.when(F.col("__total") == 1, COLUMN_TOTAL).otherwise(F.col("__key").cast("string"))
    return whole.orderBy("__total", "__key").select(
        label.alias(key), *[F.col(f"`{n}`") for n in names], row_total.alias(ROW_TOTAL)
    )
