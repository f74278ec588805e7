"""Streaming forms of the append-only logs, of intake, and of keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.sources.state import KeyedTable, read_or_empty

INTAKE = "path string, length bigint, modified timestamp, source_hash string, mode string, run int, position int"


def call_totals(calls: DataFrame, lateness: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Calls, tokens and cost per window, provider and status; also works on a static table."""
    timed = calls.withWatermark("timestamp", lateness) if calls.isStreaming else calls
    return timed.groupBy(F.window("timestamp", span).alias("window"), "provider_id", "status").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")).select(F.col("window.start").alias("window_start"), "provider_id", "status", "calls", "tokens")


def first_arrivals(files: DataFrame, lateness: str = "1 day", reviews: DataFrame | None = None) -> DataFrame:
    """The first file of each company and hash, without hashes that `reviews` holds already.

    State is kept for `lateness` of event time. A copy that comes within it is dropped; one whose own
    time is older than the watermark is dropped as late; one that comes after its first file's state
    has gone counts as first again, and a store by hash then keeps it once.
    """
    new = files.join(reviews.select("source_hash").distinct(), "source_hash", "left_anti") if reviews is not None else files
    return new.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["company_id", "source_hash"])


def upsert_stream(updates: DataFrame, table: KeyedTable, checkpoint: str, order: str | None = None, merge: Callable[[Column, Column], Column] | None = None) -> StreamingQuery:
    """Every micro-batch is put into `table` once, however often it is run; all that is available is read."""
    put = lambda batch, batch_id: table.apply(batch, batch_id, order, merge)
    return updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_intake(spark: SparkSession, folder: str, log: str, checkpoint: str, run: int = 0, replace: bool = False, files: int = 1) -> StreamingQuery:
    """Files of a folder, `files` at a time in order of arrival, into a log of intake (INTAKE).

    A picked selection (`replace`) begins anew with its first file and appends the others; a folder
    appends all. A file is taken once for a checkpoint, also after a restart: its place in the log
    is the micro-batch's, which writes it over when it is run again.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.{pdf,png,jpg,jpeg}").load(folder)
    rows = source.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("source_hash"))

    def put(batch: DataFrame, batch_id: int) -> None:
        mode = "replace" if replace and batch_id == 0 else "append"
        batch.withColumn("mode", F.lit(mode)).write.mode("overwrite").json(f"{log}/run={run}/position={batch_id + 1}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake_log(spark: SparkSession, log: str) -> DataFrame:
    return read_or_empty(spark, INTAKE, lambda: spark.read.schema(INTAKE).option("basePath", log).json(log))


def current_intake(entries: DataFrame) -> DataFrame:
    """The files that count: those since the last run that began anew."""
    last = entries.agg(F.coalesce(F.max(F.when(F.col("mode") == "replace", F.col("run"))), F.lit(0)).alias("since"))
    return entries.join(F.broadcast(last), F.col("run") >= F.col("since")).drop("since")  # one row
