"""Sources and sinks: upload catalogs, logs, state, content hashes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.sources.state import read_or_empty

UPLOAD_SCHEMA = "id string, company_id string, year int, folder_number int, month int, status string, submitted_at timestamp, files array<struct<name:string,size:bigint,hash:string,url:string,content_type:string>>"
CALL_SCHEMA = "id string, batch_id string, provider_id string, document_type string, status string, input_tokens bigint, output_tokens bigint, latency_ms bigint, cost double, timestamp timestamp"


def upload_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every metadata.json below `root`; unreadable ones are dropped."""
    reader = spark.read.schema(UPLOAD_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").option("mode", "DROPMALFORMED").option("multiLine", True)
    return reader.json(root).where("id IS NOT NULL")


def listed(uploads: DataFrame) -> DataFrame:
    """Uploads as a company's list shows them: place by folder, then time. A place per company and year, so no sort of all rows."""
    order = Window.partitionBy("company_id", "year").orderBy("folder_number", "submitted_at", "id")
    return uploads.withColumn("place", F.row_number().over(order))


def append_calls(calls: DataFrame, root: str) -> None:
    """JSON lines, one folder per batch."""
    calls.write.mode("append").partitionBy("batch_id").json(root)


def call_log(spark: SparkSession, root: str) -> DataFrame:
    """The calls below `root`; blank lines are skipped and a missing folder is an empty log."""
    return read_or_empty(spark, CALL_SCHEMA, lambda: spark.read.schema(CALL_SCHEMA).json(root))


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """One row per distinct content below `root`: hash, and the smallest path and the length of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("hash")).groupBy("hash").agg(F.min("path").alias("path"), F.first("length").alias("length"))


def generated_files(names: DataFrame, company: str | None = None) -> DataFrame:
    """Bundles by file name, newest period first; the company follows the last underscore."""
    base, final = r"^BJ_([0-9]{4})([0-9]{2})_(.+)\.pdf$", r"^CF_([0-9]{4})([0-9]{2})_(.+)_([^_]+)\.pdf$"
    is_base, is_final = F.col("file_name").rlike(base), F.col("file_name").rlike(final)
    pick = lambda b, f: F.when(is_base, F.regexp_extract("file_name", base, b)).when(is_final, F.regexp_extract("file_name", final, f))
    found = names.where(is_base | is_final).select("file_name", F.when(is_base, "base").otherwise("final").alias("kind"), pick(1, 1).cast("int").alias("year"), pick(2, 2).cast("int").alias("month"), F.when(is_final, F.regexp_extract("file_name", final, 3)).alias("employee"), pick(3, 4).alias("company"))
    return (found.where(F.col("company") == company) if company else found).orderBy(F.desc("year"), F.desc("month"), "file_name")


def intake_limits(files: DataFrame, each: int, in_all: int, most: int) -> DataFrame:
    """Per batch whether every file's type and size and the batch's size and count are allowed."""
    allowed = F.col("content_type").isin("application/pdf", "image/png", "image/jpeg")
    return files.groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), (F.bool_and(allowed) & (F.max("size") <= each) & (F.sum("size") <= in_all) & (F.count("*") <= most)).alias("accepted"))


def report_lines(buckets: DataFrame) -> DataFrame:
    """A cluster report as Markdown table lines, in order."""
    return buckets.orderBy("number").select(F.format_string("| %02d | %s | %d | %.2f |", "number", "bucket", "items", "average_confidence").alias("value"))


def write_report(items: DataFrame, buckets: DataFrame, root: str) -> None:
    """A cluster report in full: JSON lines of items, a folder per bucket, and its table of buckets as Markdown."""
    items.write.mode("overwrite").partitionBy("bucket").json(f"{root}/items")
    report_lines(buckets).coalesce(1).write.mode("overwrite").text(f"{root}/table")  # a line per bucket, fourteen at most
