"""Roll-ups for the screens: uploads by year and folder, cells, panels, workflow counters, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.cluster import OUTLIERS, SURE, with_bucket

#: Statuses under which an upload is being worked on.
BUSY = ("grouped", "month_detected", "approved")
#: Statuses of a bundle that is finished.
DONE = ("approved", "done", "generated")


def years(uploads: DataFrame, current: int) -> DataFrame:
    """V2: files and latest date per year; the years around `current` are there without uploads too."""
    found = uploads.groupBy("year").agg(F.sum("files").alias("files"), F.max("submitted_at").alias("latest"))
    around = uploads.sparkSession.range(current - 1, current + 2).select(F.col("id").cast("int").alias("year"))
    return around.join(found, "year", "full_outer").select("year", F.coalesce("files", F.lit(0)).alias("files"), "latest")


def upload_totals(uploads: DataFrame, bundles: DataFrame) -> DataFrame:
    """V3: new and busy files, months with a bundle or an upload, and the latest date, in one row.

    bundles: company_id, year, month, status; completed are those of DONE.
    """
    active = uploads.where("status <> 'archived'")
    months = bundles.select("year", "month").union(active.where("month IS NOT NULL").select("year", "month")).distinct().agg(F.count("*").alias("active_months"))
    files = lambda which: F.coalesce(F.sum(F.when(which, F.col("files"))), F.lit(0))
    sums = active.agg(files(F.col("status") == "submitted").alias("new_files"), files(F.col("status").isin(*BUSY)).alias("busy_files"), F.max("submitted_at").alias("latest"))
    done = bundles.agg(F.count_if(F.col("status").isin(*DONE)).alias("completed_months"))
    return sums.join(F.broadcast(months)).join(F.broadcast(done))  # one row each


def year_cards(uploads: DataFrame, bundles: DataFrame, current: int) -> DataFrame:
    """V4: company_id, year, total, pending and busy files, months with a bundle and those done, latest date, badge; also for years with bundles only, and the current one.

    Archived uploads count, as they do on the card.
    """
    files = lambda which: F.coalesce(F.sum(F.when(which, F.col("files"))), F.lit(0))
    up = uploads.groupBy("company_id", "year").agg(F.sum("files").alias("total"), files(F.col("status") == "submitted").alias("pending"), files(F.col("status").isin(*BUSY)).alias("busy"), F.max("submitted_at").alias("latest"))
    of = bundles.groupBy("company_id", "year").agg(F.count("*").alias("months"), F.count_if(F.col("status").isin(*DONE)).alias("done"))
    companies = uploads.select("company_id").union(bundles.select("company_id")).distinct().withColumn("year", F.lit(current))
    out = up.join(of, ["company_id", "year"], "full_outer").join(companies, ["company_id", "year"], "full_outer").fillna(0, ["total", "pending", "busy", "months", "done"])
    badge = F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" file(s) pending"))).when(F.col("months") > 0, F.concat(F.col("done").cast("string"), F.lit("/"), F.col("months").cast("string"), F.lit(" months done"))).otherwise("No data yet")
    return out.select("company_id", "year", "total", "pending", "busy", "months", "done", "latest", badge.alias("badge"), (F.col("year") == current).alias("current"))


def folder_panel(uploads: DataFrame, shown: int = 10) -> DataFrame:
    """V6: the first `shown` uploads of each company and folder, with the folder's files and how many more there are."""
    key = ["company_id", "folder_number"]
    first = uploads.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("submitted_at"), "seq"))).where(F.col("place") <= shown)
    sums = uploads.groupBy(*key).agg(F.sum("files").alias("total_files"), F.count("*").alias("n"))
    return first.join(sums, key).select(*key, "place", "seq", "total_files", F.greatest(F.col("n") - shown, F.lit(0)).alias("remaining"))


def items_by_month(routes: DataFrame) -> DataFrame:
    """V7: items of each folder by month, months in order and the unknown one last."""
    found = with_bucket(routes).groupBy("bucket", "target_year", "target_month").agg(F.count("*").alias("items"), F.min("file_name").alias("first_file"))
    late = F.coalesce(F.col("target_year") * 100 + F.col("target_month"), F.lit(999912))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(late, "target_year", "target_month")))


def month_items(routes: DataFrame) -> DataFrame:
    """V7: the items themselves: bucket, place of the month and place in it by file name, months in order and the unknown one last."""
    late = F.coalesce(F.col("target_year") * 100 + F.col("target_month"), F.lit(999912))
    months = F.dense_rank().over(Window.partitionBy("bucket").orderBy(late, "target_year", "target_month"))
    inside = F.row_number().over(Window.partitionBy("bucket", "target_year", "target_month").orderBy("file_name", "doc_id"))
    return with_bucket(routes).withColumns({"month_place": months, "place": inside}).select("bucket", "doc_id", "file_name", "month_place", "place")


def workflow_counters(routes: DataFrame, received: int | None = None) -> DataFrame:
    """Grouped items, those that need review (no period or not sure), and the months that are ready.

    received: files taken in and files uploaded, whichever are more; with the items it gives the
    `received` counter, the most of the three.
    """
    if received is not None:
        return workflow_counters(routes).join(F.broadcast(routes.agg(F.greatest(F.count("*"), F.lit(received).cast("long")).alias("received"))))  # one row each
    dated = F.col("target_year").isNotNull() & F.col("target_month").isNotNull()
    return routes.agg(
        F.count_if(F.col("document_code") != "UNKNOWN").alias("grouped"),
        F.count_if(~dated | (F.col("confidence") < SURE)).alias("needs_review"),
        F.countDistinct(F.when(dated, F.col("target_year") * 100 + F.col("target_month"))).alias("months_ready"),
    )


def month_detection(routes: DataFrame) -> DataFrame:
    """Distinct periods and items without one, per bucket that has items."""
    dated = F.col("target_year").isNotNull() & F.col("target_month").isNotNull()
    return with_bucket(routes).groupBy("bucket").agg(F.countDistinct(F.when(dated, F.col("target_year") * 100 + F.col("target_month"))).alias("periods"), F.count_if(~dated).alias("without_period"))


def folder_sums(status: DataFrame) -> DataFrame:
    """Documents, those in review and empty folders per workspace."""
    return status.groupBy("workspace_key").agg(F.sum("document_count").alias("documents"), F.sum("review_count").alias("review"), F.count_if(F.col("document_count") == 0).alias("empty"))


def folder_cards(uploads: DataFrame) -> DataFrame:
    """Submitted and total files of each company, year and folder, and whether it is archived or busy."""
    archived = F.min(F.coalesce(F.col("status") == "archived", F.lit(False)))
    files = F.coalesce(F.sum(F.when(F.col("status") == "submitted", F.col("files"))), F.lit(0))
    card = uploads.groupBy("company_id", "year", "folder_number").agg(files.alias("submitted_files"), F.sum("files").alias("total_files"), archived.alias("archived"), F.max(F.coalesce(F.col("status").isin(*BUSY), F.lit(False))).alias("busy"))
    return card.withColumn("busy", ~F.col("archived") & F.col("busy"))


def next_of_same_code(items: DataFrame) -> DataFrame:
    """The item that follows in the queue of the same workspace and folder; null after the last."""
    order = Window.partitionBy("workspace_key", "folder_number").orderBy("seq")
    return items.select("workspace_key", "folder_number", "seq", F.lead("seq").over(order).alias("next_seq"))


def scan_report(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Files of each group a scan should find; groups without any are `missing`."""
    found = files.groupBy("group_no").agg(F.count("*").alias("n"), F.countDistinct("file_name").alias("names"))
    missing = F.col("n").isNull()
    message = F.when(missing, F.format_string("Group %02d: no files found", "group_no"))
    return groups.join(found, "group_no", "left").select("group_no", F.coalesce("n", F.lit(0)).alias("files"), F.coalesce("names", F.lit(0)).alias("names"), missing.alias("missing"), message.alias("message"))


def outlier_share(routes: DataFrame) -> DataFrame:
    """Items and outliers per deciding stage of the cascade."""
    return with_bucket(routes).groupBy("stage").agg(F.count("*").alias("items"), F.count_if(F.col("bucket") == OUTLIERS).alias("outliers"))
