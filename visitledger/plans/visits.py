"""Visits: latest version, cleaning, mappings, care episode, billability."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from itertools import groupby
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType

from visitledger import constants as k
from visitledger.functions import first_word, quarter_hours, squeeze_once, trim_ws
from visitledger.operators import (
    as_of,
    drop_excluded,
    first_per_key,
    latest_per_key,
    null_aware_anti,
    spread_left_join,
    version_spans,
)
from visitledger.operators.intervals import cover_days, point_rows
from visitledger.sources.schemas import VISITS, every_column

# Order among versions of a visit recorded at the same instant: these columns, then
# all others, so that versions that tie are equal.
_FIRST_TIEBREAK = (
    "target_date",
    "task_name",
    "task_type",
    "status",
    "time_in",
    "time_out",
    "insurance",
    "agency",
    "medical_record_number",
    "patient_last",
)
VERSION_TIEBREAK = every_column(VISITS, _FIRST_TIEBREAK, "unique_visit_id", "updated_at")

# Looked at after `status` where versions tie.
_AFTER_STATUS = VERSION_TIEBREAK[VERSION_TIEBREAK.index("status") + 1 :]

# The columns of a clean visit that the report goes on to use.
REPORT_COLUMNS = (
    "visit_date",
    "mrn",
    "task_name",
    "task_type",
    "visit_type",
    "status",
    "insurance",
    "agency",
    "updated_at",
    "unique_visit_id",
    "total_hours",
    "task_group",
    "discipline_type",
    "parent_insurance",
    "insurance_type",
    "payment_model",
)


def one_per_key(dim: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One mapping row per key, the lowest values first.

    A mapping listed twice would double the visits, and the report keeps one
    copy of each. Thinning the mapping gives that without ranking the visits.
    """
    order = [F.col(c).asc_nulls_first() for c in values]
    return first_per_key(dim.select(*keys, *values), keys, order)


def insurance_lookup(insurance_map: DataFrame) -> DataFrame:
    """One row per (insurance, agency) of the payer mapping."""
    lookup = one_per_key(
        insurance_map,
        ["insurance", "office"],
        ["parent_insurance", "insurance_type", "payment_model", "payment_multiplier"],
    )
    return lookup.withColumnRenamed("office", "agency")


def visit_versions(visits: DataFrame, day: date, columns: Sequence[str] | None = None) -> DataFrame:
    """The newest version of every visit known before `day`; only `columns` of it, if given."""
    known = as_of(visits, "updated_at", day)
    return latest_per_key(known, ["unique_visit_id"], "updated_at", VERSION_TIEBREAK, columns)


# Columns of tidy visits that are not named like the one they are made of.
_MADE_OF = {
    "visit_date": ("target_date",),
    "mrn": ("medical_record_number",),
    "visit_type": ("task_type",),
    "total_hours": ("time_in", "time_out"),
}
# What the mappings add, and the columns they are looked up by.
_LOOKED_UP = {
    "task_group": ("task_name",),
    "discipline_type": ("task_name",),
    "parent_insurance": ("insurance", "agency"),
    "insurance_type": ("insurance", "agency"),
    "payment_model": ("insurance", "agency"),
}
_FILTERED = ("task_type", "status", "patient_last")


def visit_type(task_type: Column | str) -> Column:
    """Aide or clinical, from the trimmed type of the task."""
    found = F.col(task_type) if isinstance(task_type, str) else task_type
    return F.when(found == k.AIDE, k.AIDE).otherwise("Clinical")


def tidy_visits(versions: DataFrame) -> DataFrame:
    """Typed and trimmed visit columns with hours worked, as far as `versions` has what they are made of."""
    tidy = {
        "visit_date": F.col("target_date").cast("date"),
        "provider_last": first_word("provider_last"),
        "provider_first": first_word("provider_first"),
        "patient_last": F.col("patient_last"),
        "patient_first": F.col("patient_first"),
        "mrn": F.col("medical_record_number").cast("string"),
        "task_name": squeeze_once(trim_ws("task_name")),
        "task_type": trim_ws("task_type"),
        "visit_type": visit_type(trim_ws("task_type")),
        "status": trim_ws("status"),
        "insurance": trim_ws("insurance"),
        "total_hours": quarter_hours("time_in", "time_out"),
    }
    same = (
        "time_in",
        "time_out",
        "documentation_time_min",
        "travel_time_min",
        "productivity_units",
        "mileage",
        "phone",
        "address",
        "city",
        "state",
        "zip_code",
        "employee_id",
        "agency",
        "updated_at",
        "unique_visit_id",
        "new_revenues",
    )
    tidy |= {c: F.col(c) for c in same}
    have = set(versions.columns)
    return versions.select(*[e.alias(c) for c, e in tidy.items() if have.issuperset(_MADE_OF.get(c, (c,)))])


def _took_place(task_type: Column, status: Column) -> Column:
    return task_type.isin(*k.DISCIPLINES) & ~status.isin(*k.OPEN_STATUSES)


def completed_visits(tidy: DataFrame) -> DataFrame:
    """Visits of the six disciplines that took place, test patients left out."""
    done = tidy.where(_took_place(F.col("task_type"), F.col("status")))
    return drop_excluded(done, "patient_last", k.TEST_SURNAMES)


def blank_open(visits: DataFrame) -> DataFrame:
    """Versions of visits that `completed_visits` drops by type or status, without what they need not bring.

    Such a version only takes the place of others. It differs from one that took
    place in type or status, so a tie of the two is settled before the columns
    that are made NULL here: what comes out of `completed_visits` is the same, and
    less is moved to find the newest version.
    """
    done = _took_place(trim_ws("task_type"), trim_ws("status"))
    return visits.withColumns({c: F.when(done, F.col(c)) for c in _AFTER_STATUS if c in visits.columns})


def packed(visits: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Versions in a form that takes less room to move and comes out in the same order; `unpacked` undoes it.

    Times are counted from the visit's day, which is compared before them. Where
    the surname is the last of the used `columns` that is compared, its place among
    the test surnames stands for it: 1, 3, .. are these, even numbers lie between.
    """
    day = F.coalesce(F.col("target_date"), F.lit(date(1970, 1, 1)))
    small = {c: _since(visits, c, day) for c in _TIMES if _timed(visits, c)}
    if _surname_last(columns):
        name = F.col("patient_last")
        below = [F.when(name > t, 2).when(name == t, 1).otherwise(0) for t in k.TEST_SURNAMES]
        small["patient_last"] = F.when(name.isNotNull(), reduce(add, below))
    return visits.withColumns(small)


def unpacked(versions: DataFrame, like: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What `packed` made of `like`, as it was, but for surnames that stand for all of their place."""
    day = F.coalesce(F.col("target_date"), F.lit(date(1970, 1, 1)))
    whole = {c: _after(like, c, day) for c in _TIMES if c in versions.columns and _timed(like, c)}
    if _surname_last(columns):
        place = F.col("patient_last")
        whole["patient_last"] = F.when(place % 2 == 1, k.TEST_SURNAMES[0]).when(place.isNotNull(), "")
    return versions.withColumns(whole)


def text_runs(visits: DataFrame, columns: Sequence[str] | None) -> dict[str, list[str]]:
    """Texts that are compared one after the other where `columns` are used, under the name of the one text they make."""
    if columns is None:
        return {}
    last = max((VERSION_TIEBREAK.index(c) for c in columns if c in VERSION_TIEBREAK), default=-1)
    texts = {f.name for f in visits.schema.fields if isinstance(f.dataType, StringType)}
    found = [list(run) for text, run in groupby(VERSION_TIEBREAK[: last + 1], texts.__contains__) if text]
    return {f"__texts{i}": run for i, run in enumerate(found) if len(run) > 1}


def _by_run(columns: Sequence[str], runs: dict[str, list[str]]) -> list[str]:
    """The columns with the runs in place of their texts."""
    of = {c: name for name, run in runs.items() for c in run}
    return list(dict.fromkeys(of.get(c, c) for c in columns))


def joined_texts(visits: DataFrame, runs: dict[str, list[str]]) -> DataFrame:
    """Each run as one text, which takes less room to move and is ordered like its texts, NULLs first; `split_texts` undoes it.

    A text begins with U+0001 and ends with U+0000, a NULL is the end alone. Either sign
    inside a text becomes U+0001 and one more.
    """

    def one(name: str) -> Column:
        text = F.replace(F.col(name), F.lit("\1"), F.lit("\1\2"))
        text = F.replace(text, F.lit("\0"), F.lit("\1\1"))
        return F.coalesce(F.concat(F.lit("\1"), text, F.lit("\0")), F.lit("\0"))

    made = {name: F.concat(*[one(c) for c in run]) for name, run in runs.items()}
    return visits.withColumns(made).drop(*(c for run in runs.values() for c in run))


def split_texts(visits: DataFrame, runs: dict[str, list[str]]) -> DataFrame:
    """The texts that `joined_texts` made one of."""

    def one(name: str, i: int) -> Column:
        part = F.get(F.col(name), F.lit(i))
        text = F.replace(F.substr(part, F.lit(2)), F.lit("\1\1"), F.lit("\0"))
        return F.when(part != "", F.replace(text, F.lit("\1\2"), F.lit("\1")))

    parts = visits.withColumns({name: F.split(name, "\\x00") for name in runs})
    return parts.withColumns({c: one(name, i) for name, run in runs.items() for i, c in enumerate(run)}).drop(*runs)


_TIMES = ("time_in", "time_out")


def _timed(df: DataFrame, column: str) -> bool:
    return {"target_date", column} <= set(df.columns) and isinstance(
        df.schema[column].dataType, (TimestampType, TimestampNTZType)
    )


def _since(df: DataFrame, column: str, day: Column) -> Column:
    """A time as distance from the start of a day, in UTC for instants."""
    if isinstance(df.schema[column].dataType, TimestampType):
        return F.unix_micros(column) - F.unix_date(day).cast("long") * _DAY
    return F.col(column) - day.cast("timestamp_ntz")


def _after(df: DataFrame, column: str, day: Column) -> Column:
    if isinstance(df.schema[column].dataType, TimestampType):
        return F.timestamp_micros(F.col(column) + F.unix_date(day).cast("long") * _DAY)
    return day.cast("timestamp_ntz") + F.col(column)


_DAY = 24 * 3600 * 1_000_000


def _surname_last(columns: Sequence[str] | None) -> bool:
    """Whether no column that the versions are compared on comes after the surname."""
    used = [VERSION_TIEBREAK.index(c) for c in columns or VERSION_TIEBREAK if c in VERSION_TIEBREAK]
    return VERSION_TIEBREAK.index("patient_last") == max(used, default=-1)


def map_visits(
    visits: DataFrame, task_map: DataFrame | None, insurance_map: DataFrame | None
) -> DataFrame:
    """Attach task group, discipline and payer; unmapped visits keep NULLs. A mapping that is None is left out.

    Join strategy is left to Spark: small mappings are broadcast under its size
    limit, larger ones are shuffled with skew handling.
    """
    if task_map is not None:
        tasks = one_per_key(task_map, ["task_name"], ["task_group", "discipline_type"])
        visits = visits.join(tasks, "task_name", "left")
    if insurance_map is not None:
        payers = insurance_lookup(insurance_map).drop("payment_multiplier")
        payers = payers.withColumnsRenamed({"insurance": "__insurance", "agency": "__agency"})
        on = [("insurance", "__insurance"), ("agency", "__agency")]
        visits = spread_left_join(visits, payers, on).drop("__insurance", "__agency")
    return visits


def clean_visits(
    visits: DataFrame,
    task_map: DataFrame,
    insurance_map: DataFrame,
    day: date,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Completed visits as known before `day`, one row per visit id, mapped.

    With `columns` the result has these, and of the history only what they are
    made of is read and ranked. The rows are the same either way.
    """
    read = _read(columns)
    if read is None:
        versions = visit_versions(packed(blank_open(visits)), day)
    else:
        small = packed(blank_open(visits), read)
        runs = text_runs(small, read)
        known = as_of(joined_texts(small, runs), "updated_at", day)
        tiebreak, used = _by_run(VERSION_TIEBREAK, runs), _by_run(read, runs)
        versions = split_texts(latest_per_key(known, ["unique_visit_id"], "updated_at", tiebreak, used), runs)
    return current_visits(unpacked(versions, visits, read), task_map, insurance_map, columns)


def _read(columns: Sequence[str] | None) -> list[str] | None:
    """The columns of the history behind `columns` of clean visits."""
    if columns is None:
        return None
    tidy = [c for name in columns for c in _LOOKED_UP.get(name, (name,))]
    return list(dict.fromkeys([*(c for name in tidy for c in _MADE_OF.get(name, (name,))), *_FILTERED]))


def visit_spans(
    visits: DataFrame, columns: Sequence[str] | None = None, days: Sequence[date] | None = None
) -> DataFrame:
    """The days, or which of `days`, each version of a visit is the newest on."""
    read = _read(columns)
    small = packed(visits, read)
    runs = text_runs(small, read)
    tiebreak, used = _by_run(VERSION_TIEBREAK, runs), read and _by_run(read, runs)
    spans = version_spans(joined_texts(small, runs), ["unique_visit_id"], "updated_at", tiebreak, used, days)
    return unpacked(split_texts(spans, runs), visits, read)


def current_visits(
    versions: DataFrame, task_map: DataFrame, insurance_map: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """`clean_visits` once the newest version of every visit is known."""
    done = completed_visits(tidy_visits(versions))
    if columns is None:
        return map_visits(done, task_map, insurance_map)
    if not any(c in _LOOKED_UP for c in columns):
        return done.select(*columns)
    tasks = any(c in columns for c in ("task_group", "discipline_type"))
    payers = any(c in columns for c in ("parent_insurance", "insurance_type", "payment_model"))
    return map_visits(done, task_map if tasks else None, insurance_map if payers else None).select(*columns)


def attach_episode(visits: DataFrame, episodes: DataFrame) -> DataFrame:
    """The earliest-starting episode around each visit, NULLs if there is none.

    The choice depends on patient, agency and day alone, so it is made once per
    patient day and joined back; visits without one of them skip the join's keys.
    `visits` is read twice: stage it first.
    """
    chosen = day_episodes(point_rows(visits, PATIENT_EQ, "visit_date", []), episodes)
    return attach_days(visits, chosen)


PATIENT_EQ = [("mrn", "mrn"), ("agency", "agency")]


def day_episodes(days: DataFrame, episodes: DataFrame) -> DataFrame:
    """The earliest-starting episode around each patient day, by patient, agency and day; days outside all are absent.

    `days` is from `point_rows` on PATIENT_EQ; columns of distinct days come back.
    """
    order = [
        F.col("episode_start_date").asc_nulls_first(),
        F.col("episode_end_date").asc_nulls_first(),
        F.col("episode_identifier").asc_nulls_first(),
    ]
    chosen = cover_days(
        days,
        episodes,
        eq=PATIENT_EQ,
        lo="episode_start_date",
        hi="episode_end_date",
        order=order,
        take=["episode_start_date", "episode_end_date", "episode_identifier"],
    )
    return chosen.withColumnsRenamed({"__k0": "mrn", "__k1": "agency", "__at": "visit_date"})


def attach_days(visits: DataFrame, days: DataFrame) -> DataFrame:
    """Visits with what is known of their patient, agency and day, NULLs if nothing is."""
    chosen = days.withColumnsRenamed({"mrn": "__mrn", "agency": "__agency", "visit_date": "__day"})
    on = [("mrn", "__mrn"), ("agency", "__agency"), ("visit_date", "__day")]
    return spread_left_join(visits, chosen, on).drop("__mrn", "__agency", "__day")


def billable_visits(visits: DataFrame, non_billable_tasks: DataFrame) -> DataFrame:
    """Visits whose task is not listed in the one-column exclusion table."""
    (listed,) = non_billable_tasks.columns
    return null_aware_anti(visits, non_billable_tasks, "task_name", listed)
