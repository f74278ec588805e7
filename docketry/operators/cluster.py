"""Buckets, averages, funnel and period summaries of routed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.dims import FOLDER_OF, FOLDERS, FUNNEL_LAYERS

OUTLIERS = "OUTLIERS"
#: Least confidence of a bucket, and that below which an item goes to review.
GROUPED, SURE = 0.34, 0.7


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FOLDERS), "number int, code string, label string")


def folder_number(code: F.Column) -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FOLDER_OF.items() for x in pair]), code), F.lit(0))


def with_bucket(routes: DataFrame) -> DataFrame:
    """K1: the folder's code if it has one and the route is sure enough, else outliers."""
    return routes.withColumn("bucket", F.when((folder_number(F.col("document_code")) > 0) & (F.col("confidence") >= GROUPED), F.col("document_code")).otherwise(OUTLIERS))


def buckets(routes: DataFrame) -> DataFrame:
    """K1, K2: every bucket, also empty ones, with its items and average confidence, folders first."""
    spark = routes.sparkSession
    every = folders(spark).select("number", F.col("code").alias("bucket")).union(spark.createDataFrame([(14, OUTLIERS)], "number int, bucket string"))
    found = with_bucket(routes).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    return every.join(found, "bucket", "left").select("number", "bucket", F.coalesce("n", F.lit(0)).alias("items"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("average_confidence")).orderBy("number")


def periods(routes: DataFrame) -> DataFrame:
    """K6: items and grouped items per detected period."""
    known = with_bucket(routes).where("target_year IS NOT NULL AND target_month IS NOT NULL")
    return known.groupBy("target_year", "target_month").agg(F.count("*").alias("items"), F.count_if(F.col("bucket") != OUTLIERS).alias("grouped")).orderBy("target_year", "target_month")


def totals(routes: DataFrame) -> DataFrame:
    """K7: one row for the run."""
    return with_bucket(routes).agg(F.count("*").alias("items"), F.count_if(F.col("bucket") != OUTLIERS).alias("grouped"), F.count_if(F.col("bucket") == OUTLIERS).alias("outliers"))


def layer(stage: F.Column, ocr: F.Column, cached: F.Column) -> F.Column:
    """K3: the deciding layer. Explicit proofs count as unmatched, as their reasons name no layer; scanned unknowns as text and layout."""
    return F.when(cached, "cache").when(stage == "learned", "learned_sections").when(stage == "hint", "filename_taxonomy").when(stage.isin("pattern", "payslip") | ((stage == "unknown") & ocr), "pdf_text_layout").otherwise("unmatched")


def with_layer(routes: DataFrame) -> DataFrame:
    """routes with K1's bucket and K3's layer; a route is cached if it has a column `cached` that says so."""
    cached = F.coalesce("cached", F.lit(False)) if "cached" in routes.columns else F.lit(False)
    return with_bucket(routes).withColumn("layer", layer(F.col("stage"), F.col("ocr"), cached))


def other_period(year: int, month: int) -> F.Column:
    return F.coalesce(F.col("target_year") != year, F.lit(False)) | F.coalesce(F.col("target_month") != month, F.lit(False))


def funnel_traces(routes: DataFrame) -> DataFrame:
    """K4: doc_id, place, layer and status (matched, missed, skipped, rejected) of every item in every layer.

    Row-local: each item's eight states are an array that is laid out as rows.
    """
    order = F.create_map(*[F.lit(x) for k, name in enumerate(FUNNEL_LAYERS) for x in (name, k)])
    at = F.coalesce(F.try_element_at(order, F.col("layer")), F.lit(-1))
    by_layer = lambda k: F.when(F.col("layer") == FUNNEL_LAYERS[k], "matched").when((at > k) | ((F.col("layer") == "unmatched") & F.lit(k > 1)), "missed").otherwise("skipped")
    sure = (F.col("confidence") >= GROUPED) & (folder_number(F.col("document_code")) > 0)
    gate = F.when(sure, "matched").otherwise("rejected")
    status = [F.lit("matched"), by_layer(1), by_layer(2), by_layer(3), by_layer(4), F.lit("matched"), gate, gate]
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("layer"), s.alias("status")) for k, (name, s) in enumerate(zip(FUNNEL_LAYERS, status, strict=True))])
    return with_layer(routes).select("doc_id", rows.alias("rows")).select("doc_id", F.inline("rows"))


def funnel(routes: DataFrame) -> DataFrame:
    """K5: items matched, rejected and missed in each of the eight layers, also in layers without any."""
    spark = routes.sparkSession
    counts = funnel_traces(routes).groupBy("layer").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "rejected", "missed")])
    every = spark.createDataFrame([(k, n) for k, n in enumerate(FUNNEL_LAYERS)], "place int, layer string")
    return every.join(counts, "layer", "left").select("place", "layer", *[F.coalesce(s, F.lit(0)).alias(s) for s in ("matched", "rejected", "missed")]).orderBy("place")


def evidence(routes: DataFrame, year: int, month: int, examples: int = 0, sections: int = 0) -> DataFrame:
    """K8: what speaks for each item, as labels in order."""
    cached = F.coalesce("cached", F.lit(False)) if "cached" in routes.columns else F.lit(False)
    grouped = with_bucket(routes)
    labels = F.array(
        F.when(cached, "Exact file cache match"),
        F.lit("Company example/rules similarity") if examples else F.lit(None),
        F.lit(f"Learned section fingerprints: {sections}" if sections else "No learned section fingerprints yet"),
        F.lit("Filename pattern analysis"),
        F.lit("PDF text/layout/metadata signal analysis"),
        F.when(other_period(year, month), "Period mismatch detected but not blocking global clustering").when(F.col("target_year").isNotNull() | F.col("target_month").isNotNull(), "Period detection"),
        F.when(F.col("bucket") == OUTLIERS, "Outlier gate: low confidence, unknown, or non-target family").when(F.col("bucket") == "RV", "Accepted into folder 1 payslip cluster for Final Join").otherwise("Accepted into folder 2-13 cluster"),
    )
    return grouped.select("doc_id", F.filter(labels, lambda x: x.isNotNull()).alias("evidence"))


def period_signals(fingerprints: DataFrame) -> DataFrame:
    """K9: anchors, whether there is a mark, and detection rate of every code with a period signal.

    fingerprints: company_id, document_code, anchor_phrases, mark (null if none), detection_rate (null if no signal).
    """
    known = fingerprints.where("detection_rate IS NOT NULL OR anchor_phrases IS NOT NULL")
    return known.select("company_id", "document_code", F.coalesce("anchor_phrases", F.array().cast("array<string>")).alias("anchor_phrases"), F.col("mark").isNotNull().alias("has_mark"), F.coalesce("detection_rate", F.lit(0.0)).alias("detection_rate"))


def merged_uploads(items: DataFrame, uploads: DataFrame) -> DataFrame:
    """Cluster items and the files of direct uploads to folders 0 to 13, at confidence 1, by folder.

    items: folder_number, source_hash, confidence, year, month. uploads: id, folder_number, year, month,
    status, files array<struct<name, hash>>. A file whose folder already has its hash is left out, and
    of equal files the first; a file without a hash goes by its upload's id and its name. Its year
    counts only with a month.
    """
    files = uploads.where("status <> 'archived' AND folder_number BETWEEN 0 AND 13").select("id", "folder_number", "year", "month", F.inline("files"))
    own = F.coalesce("hash", F.concat_ws("-", "id", "name"))
    direct = files.select("folder_number", own.alias("source_hash"), F.lit(1.0).alias("confidence"), F.when(F.col("month").isNotNull(), F.col("year")).alias("year"), "month", "id")
    first = direct.groupBy("folder_number", "source_hash").agg(F.min(F.struct("id", "confidence", "year", "month")).alias("f")).select("folder_number", "source_hash", "f.confidence", "f.year", "f.month")
    new = first.join(items.select("folder_number", "source_hash").distinct(), ["folder_number", "source_hash"], "left_anti")
    return items.select("folder_number", "source_hash", "confidence", "year", "month").unionByName(new)


def needs_review(year: int, month: int) -> F.Column:
    """C14: no evidence folder, not sure enough, or another period than asked for."""
    number = folder_number(F.col("document_code"))
    return (number < 2) | (F.col("confidence") < SURE) | other_period(year, month)


def review_split(routes: DataFrame, year: int, month: int) -> DataFrame:
    """C14: items by folder that are approved at once or go to review."""
    return routes.withColumn("status", F.when(needs_review(year, month), "review").otherwise("approved")).groupBy("document_code", "status").agg(F.count("*").alias("items"))
