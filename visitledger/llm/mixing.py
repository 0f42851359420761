"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitledger.llm.exact_dedup import keyed, row_hash, whole
from visitledger.sources.staging import stage

#: Weight of the first, second, ... source, repeating, and how each one's rate
#: changes over the run: 1 + ramp * (2 t - 1) times its mean, t from 0 to 1.
WEIGHTS = (5, 2, 1)
RAMPS = (-0.5, 0.0, 0.5)
#: How often a document may be used.
MOST_PASSES = 3


def n_words(text: Column) -> Column:
    """Words of `text` between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _cycle(place: Column, values: Sequence[float]) -> Column:
    found = F.lit(values[-1])
    for i in reversed(range(len(values) - 1)):
        found = F.when(place % len(values) == i, F.lit(values[i])).otherwise(found)
    return found


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ramps: Sequence[float] = RAMPS, most: int = MOST_PASSES
) -> DataFrame:
    """Target of each source: source, source_size, target, ramp.

    `sizes` has source and size. Sources in code point order (null last) weigh
    `weights` in turn and share the total of all sizes. No target exceeds `most`
    times its source; the excess goes to the others by weight. Taken by cap per
    weight, the capped sources come first, so running sums find the one level
    per weight that all others get. The windows hold one row per source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()

    def rest(column: str) -> Column:
        return F.sum(column).over(everything) - F.coalesce(F.sum(column).over(before), F.lit(0))

    levels = (
        sizes.groupBy("source")
        .agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", _cycle(F.col("place"), [int(w) for w in weights]).cast("long"))
        .withColumn("ramp", _cycle(F.col("place"), [float(r) for r in ramps]))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("rank", F.row_number().over(by_cap))
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left_size").cast("double") / rest("weight").cast("double"))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("free", F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(everything))
    )
    capped = F.col("free").isNull() | (F.col("rank") < F.col("free.rank"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("free.level") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"), "ramp")


def _position(words: Column) -> Column:
    """When a source's demand reaches `words`, from 0 to 1.

    With ramp a the demand up to t is target * (a t^2 + (1 - a) t); this is its
    inverse.
    """
    share = words.cast("double") / F.nullif(F.col("target"), F.lit(0.0))
    flat = F.lit(1.0) - F.col("ramp")
    return (F.lit(2.0) * share) / (flat + F.sqrt(flat * flat + F.lit(4.0) * F.col("ramp") * share))


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    ramps: Sequence[float] = RAMPS,
) -> DataFrame:
    """How much of each document the mix takes and when.

    One row per input row: id, source, size (words), row_hash (of all columns),
    source_size, target, ramp, before (words of its source ahead of it), copies
    (array of pass, words, position).

    A source offers its documents in the order of their ids' MD5, up to
    MOST_PASSES times over, until its target is reached; the last copy is cut.
    A copy's position is the time at which the source's integrated rate reaches
    the words ahead of it. The result is sorted by first position over all
    partitions; what is not taken comes last.

    Running sums are taken inside 4096 slices of each source's order and over the
    slice totals, so a source with a third of all rows is spread out.

    Null or empty texts have size 0 and no copies. Null sources are one source,
    the last. Null ids come first in their source. Rows equal in all columns are
    interchangeable. An empty table gives an empty result.
    """
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        row_hash(docs).alias("row_hash"),
        F.md5(F.col(id_col).cast("string")).alias("key"),
    )
    slice_of = F.coalesce(F.conv(F.substring("key", 1, 3), 16, 10).cast("int"), F.lit(0))
    rows = stage(narrow.withColumn("slice", slice_of), "mix-sizes")
    targets = stage(source_targets(rows, weights, ramps), "mix-targets")

    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        rows.groupBy("source", "slice")
        .agg(F.sum("size").alias("slice_size"))
        .withColumn("slice_start", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), "slice_start", "source_size", "target", "ramp")
    )
    inside = (
        Window.partitionBy("source", "slice")
        .orderBy(F.asc_nulls_first("key"), "id", "row_hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        rows.withColumn("in_slice", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(slices, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
        .withColumn("before", F.col("slice_start") + F.col("in_slice"))
    )
    passes = [
        F.struct(
            F.lit(k).alias("pass"),
            F.greatest(
                F.least(F.floor("target") - F.col("before") - F.col("source_size") * k, F.col("size")), F.lit(0)
            ).alias("words"),
            _position(F.col("before") + F.col("source_size") * k).alias("position"),
        )
        for k in range(MOST_PASSES)
    ]
    plan = placed.select(
        "id",
        "source",
        "size",
        "row_hash",
        "source_size",
        "target",
        "ramp",
        "before",
        F.filter(F.array(*passes), lambda copy: copy["words"] > 0).alias("copies"),
    )
    first = F.try_element_at("copies", F.lit(1))["position"]
    order = [F.asc_nulls_last("_first"), F.asc("id"), F.asc("row_hash")]
    plan = plan.withColumn("_first", first)
    return plan.repartitionByRange(*order).sortWithinPartitions(*order).drop("_first")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: the rows of `docs` as often as the mix takes them.

    Same columns, one row per copy, in training order; the text of a copy that
    reaches its source's target ends there.
    """
    plan = mixing_plan(docs, id_col, text_col, source_col)
    copies = plan.select("id", "row_hash", "size", F.explode("copies").alias("copy"))
    # equal rows have one hash: together they offer all their copies to one of them
    copies = stage(copies.groupBy("id", "row_hash", "size").agg(F.collect_list("copy").alias("copies")), "mix-copies")
    copies = copies.select(keyed(F.col("id")).alias("mixed_id"), F.col("row_hash").alias("mixed_hash"), "size", "copies")
    hashed = docs.select(whole(docs), keyed(F.col(id_col)).alias("id"), row_hash(docs).alias("row_hash"))
    found = hashed.join(copies, (hashed["id"] == copies["mixed_id"]) & (hashed["row_hash"] == copies["mixed_hash"]))
    found = found.dropDuplicates(["id", "row_hash"]).withColumn("copy", F.explode("copies"))
    text = F.col("doc").getField(text_col)
    starts = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(starts, F.lit(1), F.col("copy.words").cast("int")), "")
    text = F.when(F.col("copy.words") < F.col("size"), cut).otherwise(text)
    order = ["copy.position", "id", "row_hash", "copy.pass"]
    ordered = found.withColumn("doc", F.col("doc").withField(text_col, text)).repartitionByRange(*order)
    return ordered.sortWithinPartitions(*order).select("doc.*")
