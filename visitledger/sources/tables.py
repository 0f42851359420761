"""Reading the input tables and writing the detail."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    FractionalType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from visitledger.sources import schemas
from visitledger.sources.files import get_text, put_text, replace_folder


class Inputs(NamedTuple):
    """The ten tables the report reads."""

    visits: DataFrame
    pdgm_episodes: DataFrame
    mc_episodes: DataFrame
    claims: DataFrame
    task_map: DataFrame
    insurance_map: DataFrame
    non_billable_tasks: DataFrame
    rate_cards: DataFrame
    pdgm_flags: DataFrame
    revenue_exceptions: DataFrame


SCHEMAS = {name: getattr(schemas, name.upper()) for name in Inputs._fields}


def _typed(name: str, kind: DataType, want: DataType) -> str:
    """SQL for a column of type `kind` as `want`.

    Fractions become integers by rounding, halves up. A whole number stored as a
    double or with decimal places reads like an integer, so that it matches the
    same number kept as text. Instants become dates in UTC, whatever the session's zone.
    """
    cast = f"CAST({name} AS {want.simpleString()})"
    if isinstance(want, LongType) and isinstance(kind, FractionalType):
        return f"CAST(ROUND({name}) AS bigint)"
    if isinstance(want, StringType) and isinstance(kind, (DoubleType, FloatType)):
        whole = f"{name} = ROUND({name}) AND ABS({name}) < 1e15"
        return f"CASE WHEN {whole} THEN CAST(CAST({name} AS bigint) AS string) ELSE {cast} END"
    if isinstance(want, StringType) and isinstance(kind, DecimalType) and kind.scale > 0:
        return f"CASE WHEN {name} = ROUND({name}) THEN CAST(CAST({name} AS decimal(38, 0)) AS string) ELSE {cast} END"
    if isinstance(want, DateType) and isinstance(kind, TimestampType):
        return f"DATE_FROM_UNIX_DATE(CAST(FLOOR(UNIX_SECONDS({name}) / 86400) AS int))"
    return cast


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of `schema` in order and type; columns `df` lacks are NULL.

    Columns that have the type already are left bare, so filters on them reach
    the file reader, and timestamps without a zone stay as they are.
    """
    have = {f.name: f.dataType for f in df.schema.fields}

    def text(field: StructField) -> str:
        kind = have.get(field.name)
        zoneless = isinstance(field.dataType, TimestampType) and isinstance(
            kind, TimestampNTZType
        )
        if kind == field.dataType or zoneless:
            return f"`{field.name}`"
        if kind is None:
            return f"CAST(NULL AS {field.dataType.simpleString()}) AS `{field.name}`"
        return f"{_typed(f'`{field.name}`', kind, field.dataType)} AS `{field.name}`"

    return df.selectExpr(*[text(f) for f in schema.fields])


def _inputs(load: Callable[[str], DataFrame]) -> Inputs:
    return Inputs(**{name: conform(load(name), SCHEMAS[name]) for name in Inputs._fields})


def read_parquet_inputs(spark: SparkSession, folder: str) -> Inputs:
    """Read the tables from `<folder>/<table>.parquet`; only used columns are scanned."""
    return _inputs(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))


def read_catalog_inputs(spark: SparkSession, names: dict[str, str]) -> Inputs:
    """Read the tables from the catalog; `names` maps table to catalog name."""
    return _inputs(lambda name: spark.table(names.get(name, name)))


#: How CSV is written and read: NULL is nothing, empty text is quoted, and texts
#: keep their blanks, quotes and line ends; instants keep their microseconds.
_CSV = {
    "header": "true",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "lineSep": "\n",
    "dateFormat": "yyyy-MM-dd",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_SCHEMA_FILE = "_schema.json"


def write_detail(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Export all columns as Parquet, or as CSV with a header line.

    The schema is kept beside the files, for `read_detail`. Files are written to a
    folder of their own next to `path` and take its place when all are there, so
    an earlier export is replaced as a whole and a failed one leaves it alone.
    """
    if form not in ("parquet", "csv"):
        raise ValueError(f"unknown export format: {form}")
    if form == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, BinaryType, MapType, StructType))]
        if nested:
            raise ValueError(f"CSV cannot hold {nested}")
    spark = df.sparkSession
    target, fresh = path.rstrip("/"), f"{path.rstrip('/')}.new-{uuid4().hex}"
    df.write.format(form).options(**(_CSV if form == "csv" else {})).save(fresh)
    put_text(spark, f"{fresh}/{_SCHEMA_FILE}", json.dumps({"form": form, "schema": df.schema.jsonValue()}))
    replace_folder(spark, fresh, target)


def read_detail(spark: SparkSession, path: str) -> DataFrame:
    """What `write_detail` exported, with the types it had."""
    kept = json.loads(get_text(spark, f"{path.rstrip('/')}/{_SCHEMA_FILE}"))
    reader = spark.read.schema(StructType.fromJson(kept["schema"]))
    if kept["form"] == "csv":
        # nothing at all stands for NULL and the quoted nothing for empty text; the reader
        # marks the former with a text that no file holds
        own = {"nullValue": uuid4().hex, "emptyValue": "", "multiLine": "true", "mode": "FAILFAST"}
        return reader.options(**_CSV | own).csv(path)
    return reader.parquet(path)
