"""Concepts from model replies: payload shapes, strict validation, per-source diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunk import source_chunks

#: Kinds and levels of concepts.
CONCEPT_TYPES = ("mechanism", "pattern", "mental-model", "heuristic", "observation", "gotcha")
LEVELS = ("concrete-example", "specific-technique", "general-principle", "meta-concept")
#: Outcomes of a source.
OUTCOMES = ("already_processed", "too_short", "provider_error", "invalid_output", "no_valid_concepts", "non_extractable", "created")


#: The columns of an item of a reply.
ITEM_SCHEMA = "title string, content string, suggested_tags array<string>, concept_type string, abstraction_level string"


def payload_items(replies: DataFrame) -> DataFrame:
    """replies (..., raw) with valid and items: a list under ``concepts`` or a bare list; else not valid."""
    v = F.try_parse_json(T.json_from_reply(F.col("raw")))
    df = replies.withColumn("_v", v)
    items = F.coalesce(F.try_variant_get("_v", "$.concepts", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"))
    return df.withColumn("items", items).withColumn("valid", F.col("items").isNotNull()).drop("_v")


def concepts(replies: DataFrame, types=CONCEPT_TYPES, levels=LEVELS) -> DataFrame:
    """One row for each item of the valid replies, its fields stripped, with ok for those that pass all checks."""
    keys = [c for c in replies.columns if c != "raw"]
    rows = payload_items(replies).where("valid").select(*keys, F.posexplode("items").alias("item_pos", "x"))
    get = lambda p, t="string": F.try_variant_get("x", p, t)
    is_string = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get("x", p, "variant")) == "STRING", F.lit(False))
    tags = F.coalesce(get("$.suggested_tags", "array<string>"), F.array().cast("array<string>"))
    tag_kind = F.coalesce(F.schema_of_variant(F.try_variant_get("x", "$.suggested_tags", "variant")) == "ARRAY<STRING>", F.lit(False))
    rows = rows.select(*keys, "item_pos", T.strip(get("$.title")).alias("title"), T.strip(get("$.content")).alias("content"), F.transform(tags, T.strip).alias("tags"),
                       get("$.concept_type").alias("concept_type"), get("$.abstraction_level").alias("abstraction_level"), (is_string("$.title") & is_string("$.content") & tag_kind).alias("_kinds"))
    ok = F.col("_kinds") & (F.col("title") != "") & (F.col("content") != "") & F.size("tags").between(2, 3) & F.forall("tags", lambda t: t != "") & F.col("concept_type").isin(*types) & F.col("abstraction_level").isin(*levels)
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_kinds")


def valid_concepts(replies: DataFrame, types=CONCEPT_TYPES, levels=LEVELS) -> DataFrame:
    """The items that pass all checks, without counts of the others, as rows of ITEM_SCHEMA behind their keys."""
    rows = concepts(replies, types, levels).where("ok")
    return rows.drop("ok").withColumnRenamed("tags", "suggested_tags")


def extracted(sources: DataFrame, extractor: Callable[[DataFrame], DataFrame], target: int = 4000, cap: int = 6000) -> DataFrame:
    """(source_id, chunk_pos, raw, status): each chunk of sources (source_id, content) sent to the extractor.

    extractor maps rows (source_id, chunk_pos, chunk) to (source_id, chunk_pos, raw, status), where
    status is ok or provider_error; it is where a hosted model would be called, in batches.
    """
    chunks = sources.select("source_id", F.posexplode(source_chunks(F.col("content"), target, cap)).alias("chunk_pos", "chunk"))
    return extractor(chunks)


def outcomes(sources: DataFrame, replies: DataFrame, min_chars: int = 100) -> DataFrame:
    """(source_id, outcome, n_chunks, n_invalid_chunks, n_invalid_items, n_concepts) of sources (source_id, content)."""
    judged = payload_items(replies).groupBy("source_id").agg(
        F.count("*").alias("n_chunks"), F.count_if(~F.col("valid") | (F.col("status") != "ok")).alias("n_invalid_chunks"), F.count_if(F.col("status") == "provider_error").alias("n_errors"))
    items = concepts(replies).groupBy("source_id").agg(F.count_if(~F.col("ok")).alias("n_invalid_items"), F.count_if("ok").alias("n_concepts"))
    df = sources.join(judged, "source_id", "left").join(items, "source_id", "left").fillna(0, ["n_chunks", "n_invalid_chunks", "n_errors", "n_invalid_items", "n_concepts"])
    c = F.col("content")
    outcome = (
        F.when(T.is_processed(c), "already_processed")
        .when(F.length(T.strip(c)) < min_chars, "too_short")
        .when(F.col("n_concepts") > 0, "created")
        .when((F.col("n_errors") > 0) & (F.col("n_errors") == F.col("n_invalid_chunks")) & (F.col("n_invalid_items") == 0), "provider_error")
        .when((F.col("n_invalid_chunks") > 0) | (F.col("n_invalid_items") > 0), "invalid_output")
        .when(T.is_non_extractable(c), "non_extractable")
        .otherwise("no_valid_concepts")
    )
    return df.select("source_id", outcome.alias("outcome"), "n_chunks", "n_invalid_chunks", "n_invalid_items", "n_concepts")


def summary(found: DataFrame) -> DataFrame:
    """(outcome, n) for all outcomes, zeros included."""
    spark = found.sparkSession
    names = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return names.join(found.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
