"""Small hand-made frames."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def day(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def frame(spark: SparkSession, schema: StructType | str, rows: list[dict]) -> DataFrame:
    """Rows given by name; what is left out is NULL."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Result rows as sorted tuples, NULLs first."""
    found = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns or df.columns)).collect()]
    return sorted(found, key=lambda r: [(v is not None, v) for v in r])


def explained(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
