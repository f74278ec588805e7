"""Decisions on reviews, files and uploads, applied to many rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decide(status: DataFrame, decisions: DataFrame) -> DataFrame:
    """Folder counters after approving or passing reviews.

    status: workspace_key, folder_number, document_count, review_count. decisions: workspace_key,
    seq, from_folder, to_folder, approved; a passed review stays in its folder. Counters that leave
    stop at 0 before those that arrive are added. The last decision by seq names the folder's
    status, clears its reviews, and an approval counts its documents (at least 1) as approved.
    All changes meet the old counters in one aggregation.
    """
    key = F.col("workspace_key")
    none = F.lit(None).cast("struct<seq:long,approved:boolean>")
    zero = F.lit(0).cast("long")
    old = status.select(key, "folder_number", F.col("document_count").alias("d"), F.col("review_count").alias("r"), zero.alias("gone"), zero.alias("come"), none.alias("verdict"))
    moved = F.col("approved") & (F.col("from_folder") != F.col("to_folder"))
    leave = decisions.where(moved).select(key, F.col("from_folder").alias("folder_number"), zero.alias("d"), zero.alias("r"), F.lit(1).cast("long").alias("gone"), zero.alias("come"), none.alias("verdict"))
    arrive = decisions.select(key, F.when(F.col("approved"), F.col("to_folder")).otherwise(F.col("from_folder")).alias("folder_number"), zero.alias("d"), zero.alias("r"), zero.alias("gone"), F.when(moved, 1).otherwise(0).cast("long").alias("come"), F.struct("seq", "approved").alias("verdict"))
    all_rows = old.unionByName(leave).unionByName(arrive)
    sums = all_rows.groupBy("workspace_key", "folder_number").agg(F.sum("d").alias("d"), F.sum("r").alias("r"), F.sum("gone").alias("gone"), F.sum("come").alias("come"), F.max("verdict").alias("verdict"))
    now = sums.withColumn("document_count", F.greatest(zero, F.col("d") - F.col("gone")) + F.col("come"))
    yes = F.col("verdict.approved")
    return now.select(
        "workspace_key", "folder_number", "document_count",
        F.when(yes.isNotNull(), 0).otherwise(F.greatest(zero, F.col("r") - F.col("gone"))).cast("long").alias("review_count"),
        F.when(yes, F.greatest(F.lit(1), "document_count")).otherwise(0).cast("long").alias("approved_count"),
        F.when(yes, "approved").when(~yes, "passed").when(F.col("document_count") == 0, "missing").otherwise("unchanged").alias("status"),
    )


def newly_approved(approved: DataFrame, decisions: DataFrame) -> DataFrame:
    """(workspace_key, source_hash) of approvals not recorded yet, each once, with its last folder."""
    last = decisions.where("approved AND source_hash IS NOT NULL").groupBy("workspace_key", "source_hash").agg(F.max_by("to_folder", "seq").alias("folder_number"))
    return last.join(approved.select("workspace_key", "source_hash").distinct(), ["workspace_key", "source_hash"], "left_anti")


def review_inbox(reviews: DataFrame) -> DataFrame:
    """All, pending and approved reviews per workspace."""
    return reviews.groupBy("workspace_key").agg(F.count("*").alias("reviews"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "approved").alias("approved"))


def pending_reviews(reviews: DataFrame) -> DataFrame:
    """The rows of the inbox: pending reviews in order, with how many reviews their workspace has and how many are approved."""
    counts = review_inbox(reviews).select("workspace_key", "reviews", "approved")
    place = F.row_number().over(Window.partitionBy("workspace_key").orderBy("seq"))
    return reviews.where("status = 'pending'").withColumn("place", place).join(counts, "workspace_key").select("workspace_key", "seq", "place", "reviews", "approved")


def set_status_by_hash(uploads: DataFrame, hashes: DataFrame, status: str) -> DataFrame:
    """Uploads of which any file has a listed hash get `status`. uploads: seq, status, files array<struct<name, hash>>."""
    hit = uploads.select("seq", F.explode("files.hash").alias("hash")).join(hashes.select("hash").distinct(), "hash", "left_semi").select("seq").distinct()
    return set_upload_status(uploads, hit, status)


def without_files(tables: dict[str, DataFrame], hashes: DataFrame) -> dict[str, DataFrame]:
    """Reviews, approvals and cached routes without the rows of removed files, by (workspace_key or company_id, source_hash), whichever a table has."""
    out = {}
    for name, df in tables.items():
        key = [k for k in ("workspace_key", "company_id", "source_hash") if k in df.columns and k in hashes.columns]
        out[name] = df.join(hashes.select(*key).distinct(), key, "left_anti")
    return out


def confirm_items(status: DataFrame, items: DataFrame) -> DataFrame:
    """Folder counters that are at least the number of confirmed items."""
    n = items.groupBy("workspace_key", "folder_number").agg(F.count("*").alias("items"))
    return status.join(n, ["workspace_key", "folder_number"], "full_outer").select("workspace_key", "folder_number", F.greatest(F.coalesce("document_count", F.lit(0)), F.coalesce("items", F.lit(0))).alias("document_count"))


def final_plan(payslips: DataFrame, plan: DataFrame) -> DataFrame:
    """Per payslip its own pages, then the pages of the workspace's base bundle as one part."""
    base = plan.groupBy("workspace_key").agg(F.max("last_page").alias("base_pages"))
    both = payslips.join(base, "workspace_key", "left").withColumn("base_pages", F.coalesce("base_pages", F.lit(0)))
    parts = F.array(F.struct(F.lit(1).alias("part"), F.lit(1).cast("long").alias("first_page"), F.col("page_count").alias("last_page")), F.struct(F.lit(2).alias("part"), (F.col("page_count") + 1).alias("first_page"), (F.col("page_count") + F.col("base_pages")).alias("last_page")))
    return both.select("workspace_key", "seq", F.inline(parts)).where("last_page >= first_page")


def remove_files(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """Documents left in the folders that held one of the removed (workspace_key, source_hash)."""
    gone = hashes.select("workspace_key", "source_hash").distinct().withColumn("gone", F.lit(1))
    marked = documents.join(gone, ["workspace_key", "source_hash"], "left")
    left = marked.groupBy("workspace_key", "folder_number").agg(F.count_if(F.col("gone").isNull()).alias("document_count"), F.count("gone").alias("removed")).where("removed > 0")
    return left.withColumn("status", F.when(F.col("document_count") > 0, "approved").otherwise("missing"))


def set_upload_status(uploads: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """The uploads whose seq is listed get `status`."""
    listed = ids.select("seq").distinct().withColumn("hit", F.lit(True))
    return uploads.join(listed, "seq", "left").withColumn("status", F.when(F.col("hit"), status).otherwise(F.col("status"))).drop("hit").select(*uploads.columns)


def archive_year(uploads: DataFrame, company: int, year: int) -> DataFrame:
    """All uploads of a company and year become archived."""
    return uploads.withColumn("status", F.when((F.col("company_id") == company) & (F.col("year") == year), "archived").otherwise(F.col("status")))


def output_gate(requests: DataFrame, bundles: DataFrame, employees: DataFrame) -> DataFrame:
    """Ok, or why a final bundle cannot be given out.

    requests: workspace_key, employee. bundles: workspace_key, status. employees: workspace_key, employee, final_status.
    """
    seen = requests.join(bundles.select("workspace_key", F.col("status").alias("base")), "workspace_key", "left").join(employees, ["workspace_key", "employee"], "left")
    reason = F.when(~F.col("base").eqNullSafe("current"), "base bundle is not current").when(F.col("final_status").isNull(), "unknown employee").when(F.col("final_status") != "current", "final bundle is not current").otherwise("ok")
    return seen.select("workspace_key", "employee", reason.alias("result"))
