"""Checks over batches: exact duplicates, document boundaries, costs, corrections, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.cluster import folder_number
from docketry.operators.joins import small


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per content hash that occurs more than once, its rows and the smallest id."""
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def document_boundaries(pages: DataFrame) -> DataFrame:
    """Logical documents over pages: a new one starts where the type changes or a page does not continue."""
    order = Window.partitionBy("reference_id").orderBy("page")
    starts = F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != F.col("kind")) | ~F.col("continuation")
    numbered = pages.withColumn("start", starts.cast("int")).withColumn("document", F.sum("start").over(order))
    return numbered.groupBy("reference_id", "document").agg(F.min("page").alias("first_page"), F.count("*").alias("pages"), F.min("kind").alias("kind"))


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens / 1e6 x the price in force at the call's time, per provider."""
    in_force = (calls["provider_id"] == prices["provider"]) & (calls["timestamp"] >= prices["valid_from"]) & (calls["timestamp"] < prices["valid_to"])
    priced = calls.join(small(prices), in_force)
    return priced.groupBy("provider_id").agg(F.count("*").alias("calls"), F.round(F.sum((F.col("input_tokens") + F.col("output_tokens")) / 1e6 * F.col("price")), 6).alias("cost"))


def correction_patterns(corrections: DataFrame, least: int = 3) -> DataFrame:
    """Equal corrections that occur at least `least` times."""
    return corrections.groupBy("from_code", "to_code").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled, matched and share per label."""
    both = labels.join(predicted, "doc_id")
    return both.groupBy("label").agg(F.count("*").alias("labelled"), F.count_if(F.col("label") == F.col("predicted")).alias("matched"))


def compliance_order(docs: DataFrame) -> DataFrame:
    """Place of each document in its batch: folder number with unknown ones last, employee (none last), seq."""
    number = folder_number(F.col("folder_code"))
    order = Window.partitionBy("batch_id").orderBy(F.when(number == 0, 99).otherwise(number), F.col("employee_code").asc_nulls_last(), "seq", "page_count")
    return docs.select("batch_id", "seq", "page_count", F.row_number().over(order).alias("place"))


def roster_check(roster: DataFrame, payslips: DataFrame) -> DataFrame:
    """Employees of the roster without a payslip, and payslips of employees that are not on it."""
    key = ["batch_id", "employee_code"]
    a, b = roster.select(*key).dropna().distinct().withColumn("listed", F.lit(1)), payslips.select(*key).dropna().distinct().withColumn("paid", F.lit(1))
    issue = F.when(F.col("paid").isNull(), "missing_payslip_for_roster_employee").when(F.col("listed").isNull(), "unexpected_payslip_employee")
    return a.join(b, key, "full_outer").select(*key, issue.alias("issue")).where("issue IS NOT NULL")


def mature_companies(months: DataFrame, least: int = 100, accuracy: float = 0.95) -> DataFrame:
    """Per company and month whether its last three months hold enough approved items at enough accuracy.

    months: company_id, period, approved, reviewed.
    """
    three = Window.partitionBy("company_id").orderBy("period").rowsBetween(-2, 0)
    seen = months.select("company_id", "period", F.sum("approved").over(three).alias("approved"), F.sum("reviewed").over(three).alias("reviewed"))
    return seen.withColumn("mature", (F.col("approved") >= least) & (F.col("approved") >= accuracy * F.col("reviewed")))
