"""Keyed state: upserts, decisions, gates, plans and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.cluster import folders
from docketry.operators.reports import DONE


def upsert(table: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `updates` replace those with the same key."""
    return table.join(updates.select(*key).distinct(), key, "left_anti").unionByName(updates)


def new_files(files: DataFrame, reviews: DataFrame) -> DataFrame:
    """Files whose hash no review of the workspace holds yet."""
    return files.join(reviews.select("source_hash").distinct(), "source_hash", "left_anti")


def first_source(sources: DataFrame) -> DataFrame:
    """Of the rows of one (workspace_key, source_hash) the first by priority, then seq."""
    order = Window.partitionBy("workspace_key", "source_hash").orderBy("priority", "seq")
    return sources.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def gate(workspaces: DataFrame) -> DataFrame:
    """(workspace_key, folder_number, status, pending) to the state of each workspace's bundle."""
    done = F.col("status").isin("approved", "done")
    seen = workspaces.groupBy("workspace_key").agg(F.max("pending").alias("pending"), F.min(F.when(F.col("folder_number").between(2, 13), done.cast("int"))).alias("all_done"))
    return seen.select("workspace_key", F.when(F.col("pending") > 0, "blocked").when(F.coalesce("all_done", F.lit(1)) == 0, "needs_confirmation").otherwise("ready").alias("state"))


def missing_folders(documents: DataFrame) -> DataFrame:
    """The evidence folders 2 to 13 without a document, per workspace."""
    keys = documents.select("workspace_key").distinct()
    every = keys.join(F.broadcast(folders(documents.sparkSession).where("number >= 2").select(F.col("number").alias("folder_number"))))  # 12 rows
    return every.join(documents.select("workspace_key", "folder_number").distinct(), ["workspace_key", "folder_number"], "left_anti").groupBy("workspace_key").agg(F.count("*").alias("missing"), (12 - F.count("*")).alias("included"))


def assembly_plan(approved: DataFrame) -> DataFrame:
    """Documents of folders 2 to 13 in order of folder, time and seq, with the pages each one takes up."""
    order = Window.partitionBy("workspace_key").orderBy("folder_number", "approved_at", "seq")
    upto = F.sum("page_count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return approved.where("folder_number BETWEEN 2 AND 13").select("workspace_key", "seq", F.row_number().over(order).alias("place"), (upto - F.col("page_count") + 1).alias("first_page"), upto.alias("last_page"))


def structure_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Each expected section's position, whether it is found, and whether it comes after all found before it."""
    both = expected.join(actual, ["reference_id", "code"], "left")
    earlier = F.max("position").over(Window.partitionBy("reference_id").orderBy("section_order").rowsBetween(Window.unboundedPreceding, -1))
    return both.select("reference_id", "code", "section_order", F.col("position").isNotNull().alias("found"), F.coalesce(F.col("position") > F.coalesce(earlier, F.lit(-1)), F.lit(False)).alias("order_match"))


def upload_roll_up(uploads: DataFrame) -> DataFrame:
    """V1, V4: files, pending and processing uploads and the latest date per company, year and folder."""
    return uploads.where("status <> 'archived'").groupBy("company_id", "year", "folder_number").agg(
        F.count("*").alias("uploads"), F.sum("files").alias("files"), F.count_if(F.col("status") == "submitted").alias("pending"), F.count_if(F.col("status") == "processing").alias("processing"), F.max("submitted_at").alias("latest")
    )


def month_grid(uploads: DataFrame, bundles: DataFrame) -> DataFrame:
    """V5: twelve months for every company and year that has uploads: done, submitted, has data (an upload or a bundle) or empty. bundles: company_id, year, month, status."""
    months = uploads.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    every = uploads.select("company_id", "year").distinct().join(F.broadcast(months))  # 12 rows
    found = uploads.groupBy("company_id", "year", "month").agg(F.count("*").alias("n"), F.max(F.col("status") == "submitted").alias("new"))
    key = ["company_id", "year", "month"]
    of = bundles.groupBy(*key).agg(F.bool_or(F.col("status").isin(*DONE)).alias("done"))
    cell = F.when(F.col("done"), "done").when(F.col("new"), "submitted").when((F.col("n") > 0) | F.col("done").isNotNull(), "has_data").otherwise("empty")
    return every.join(found, key, "left").join(of, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("uploads"), cell.alias("cell"))


def snapshot_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files per group before and now, added and removed names, and whether the group changed."""
    key = ["group_no", "file_name"]
    a, b = before.select(*key).distinct().withColumn("old", F.lit(1)), now.select(*key).distinct().withColumn("new", F.lit(1))
    both = a.join(b, key, "full_outer")
    added, removed = F.count_if(F.col("old").isNull()), F.count_if(F.col("new").isNull())
    return both.groupBy("group_no").agg(F.count("old").alias("before"), F.count("new").alias("now"), added.alias("added"), removed.alias("removed"), (added + removed > 0).alias("changed"))
