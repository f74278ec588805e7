"""Batches: build, two-level groups, statistics, metric views and folder counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.cluster import folder_number, folders

APPROVED = 0.8


def batch_build(docs: DataFrame) -> DataFrame:
    """B1: folder numbers, and per batch pages, approved (over 0.8) and review (the rest)."""
    return docs.groupBy("batch_id").agg(
        F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.count_if(F.col("confidence") > APPROVED).alias("approved"), F.count_if(F.col("confidence") <= APPROVED).alias("review"), F.countDistinct(folder_number(F.col("folder_code"))).alias("folders")
    )


def built_documents(docs: DataFrame) -> DataFrame:
    """B1: a batch's documents with their ids, batch and place (from 0) in order of seq, and their folders' numbers (0 if unknown)."""
    order = Window.partitionBy("batch_id").orderBy("seq", "folder_code", "page_count", "confidence", "employee_code", "cache_hit")
    place = F.row_number().over(order) - 1
    return docs.select("batch_id", F.format_string("%d-%d", "batch_id", place).alias("id"), "seq", folder_number(F.col("folder_code")).alias("folder_number"), "confidence", "page_count")


def batch_groups(docs: DataFrame) -> DataFrame:
    """B2: documents and pages per folder and employee, null employees as `unknown`."""
    return docs.groupBy(folder_number(F.col("folder_code")).alias("folder_number"), F.coalesce("employee_code", F.lit("unknown")).alias("employee")).agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"))


def batch_statistics(docs: DataFrame, calls: DataFrame) -> DataFrame:
    """Documents, pages, cache hits, calls, tokens, cost and rates per batch. Both sides are aggregated before they meet."""
    d = docs.groupBy("batch_id").agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.count_if(F.col("confidence") > APPROVED).alias("approved"), F.count_if(F.col("confidence") <= APPROVED).alias("review"), F.count_if("cache_hit").alias("cache_hits"), F.avg("confidence").alias("mean_confidence"))
    c = calls.groupBy("batch_id").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").alias("cost"))
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return d.join(c, "batch_id", "left").select(
        "batch_id", "documents", "pages", "approved", "review", "cache_hits", F.round("mean_confidence", 6).alias("mean_confidence"), zero("calls"), zero("tokens"),
        F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"),
        F.round(F.coalesce("cost", F.lit(0.0)) / F.greatest(F.lit(1), "documents"), 6).alias("cost_per_document"),
        F.round(F.col("cache_hits") / F.greatest(F.lit(1), "documents"), 6).alias("cache_hit_rate"),
    )


def folder_counters(docs: DataFrame) -> DataFrame:
    """Every folder with its counts; `detected` if it has a document, else `missing`."""
    found = docs.groupBy(F.col("folder_code").alias("code")).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") > APPROVED).alias("ok"))
    return folders(docs.sparkSession).join(found, "code", "left").select(
        "number", "code", F.when(F.col("n") > 0, "detected").otherwise("missing").alias("status"), F.coalesce("n", F.lit(0)).alias("document_count"), F.coalesce("ok", F.lit(0)).alias("approved_count"), F.coalesce(F.col("n") - F.col("ok"), F.lit(0)).alias("review_count")
    )


def provider_calls(calls: DataFrame) -> DataFrame:
    """Calls, tokens, mean latency and cost per provider and status."""
    return calls.groupBy("provider_id", "status").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.round(F.sum("cost"), 4).alias("cost"))
