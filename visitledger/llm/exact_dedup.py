"""Exact deduplication by a tree of merged digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger.sources.staging import stage

#: Runs the rows are dealt into, and how many runs one round merges into one.
RUNS = 64
FAN_IN = 4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """`text` with A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def keyed(id_col: Column) -> Column:
    """An id as a join key that is never null, so that one shuffle serves a join and what follows."""
    return F.coalesce(id_col.cast("string"), F.lit("null"))


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs meets ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row but maps, which have no order."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, row, raw, digest, n_bytes.

    `row` tells repeated rows apart; it is only fixed once the result is written.
    `raw` is a hash of the text as it stands.
    """
    text = F.encode(normalised(F.col("text")), "utf-8")
    raw = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .select("id", F.monotonically_increasing_id().alias("row"), raw.alias("raw"), text.alias("bytes"))
        .select(
            "id",
            "row",
            "raw",
            F.unhex(F.sha2("bytes", 256)).alias("digest"),
            F.octet_length("bytes").cast("long").alias("n_bytes"),
        )
    )


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Merge the digest runs of `rows` (id, row, digest, n_bytes) up a tree.

    The rows are dealt into `runs` runs. Each run is reduced to one entry per
    digest before anything moves; every round then sends `fan_in` neighbouring
    runs to each other, sorted, and keeps of each digest the entry that stays and
    the number of rows behind it. A digest with a third of all rows therefore
    contributes one entry per run to the first round and `fan_in` to later ones.
    Entries only merge if their byte lengths agree as well as their digests.
    """
    keys = ["run", "digest", "n_bytes"]
    merged = (
        rows.withColumn("run", F.pmod("row", F.lit(runs)).cast("int"))
        .groupBy(*keys)
        .agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition(*keys)
            .sortWithinPartitions(*keys)
            .groupBy(*keys)
            .agg(F.max("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
    return merged.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which row stays of each group of equal texts.

    One row per input row: id, raw (hash of the text as it stands), digest (binary
    SHA-256 of the normalised text), n_bytes, keep_id, group_size, kept. Texts are equal if they agree after
    lower-casing A-Z; of equal texts the row with the largest id stays.

    Null text counts as empty, and all empty texts are one group. A null id is
    smaller than any other. Of rows that share the largest id and the text
    exactly one is kept. An empty table gives an empty result. Other columns of
    `docs` are not read.
    """
    rows = stage(digests(docs, id_col, text_col), "digests")
    groups = stage(merge_runs(rows), "digest-groups")
    return rows.join(groups, ["digest", "n_bytes"]).select(
        "id",
        "raw",
        "digest",
        "n_bytes",
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns kept.

    The digests are merged up the tree without the texts; then a row of `docs`
    stays if its id and its text's hash are those of a row that is kept. Rows
    that agree in both are thinned to one.
    """
    keep = exact_dedup(docs, id_col, text_col).where("kept")
    keep = stage(keep.select(keyed(F.col("id")).alias("_kept_id"), F.col("raw").alias("_kept_raw")), "kept")
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.select(whole(docs), keyed(F.col(id_col)).alias("id"), raw.alias("raw"))
    same = (marked["id"] == keep["_kept_id"]) & (marked["raw"] == keep["_kept_raw"])
    return marked.join(keep, same, "left_semi").dropDuplicates(["id", "raw"]).select("doc.*")
