"""One query per operator, over the whole of its table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitledger.llm.exact_dedup import exact_dedup
from visitledger.llm.jaccard import jaccard_classes
from visitledger.llm.language import fit, held_out, identify
from visitledger.llm.mixing import mixing_plan
from visitledger.llm.packing import pack
from visitledger.llm.quality import quality_scores
from visitledger.llm.repeats import remove_repeats
from visitledger.llm.search import search
from visitledger.llm.sharding import assign_shards
from visitledger.llm.spelling import spelling_variants
from visitledger.llm.spots import fingerprint, fingerprints
from visitledger.llm.token_files import round_trip as token_round_trip
from visitledger.llm.warc import round_trip


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(documents(spark, sf_dir))
    taken = F.aggregate(F.transform("copies", lambda c: c["words"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return plan.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        F.try_element_at("copies", F.lit(1))["position"].alias("first_position"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        F.col("id").alias("doc_id"), "evidence", "host_rate", "path_rate", F.col("quality").alias("quality_score"), "keep"
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    number = r"^<urn:page:(-?\d+)>$"
    response = F.col("record_type") == "response"
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        F.regexp_extract("record_id", number, 1).try_cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", number, 1).try_cast("long").alias("refers_to"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(documents(spark, sf_dir))
    return placed.select("doc.doc_id", "slot", "shard")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).drop("row").withColumnRenamed("id", "doc_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(documents(spark, sf_dir)).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_language": op6_language,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling": op11_spelling,
    "op12_search": op12_search,
    "op13_token_files": op13_token_files,
    "pipeline": corpus_pipeline.run,
}
