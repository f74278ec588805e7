"""Queries over batches, uploads, workspaces and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import batch, quality, state
from docketry.operators.dims import FOLDER_OF, FOLDERS
from docketry.plans.inputs import table, with_inputs
from docketry.plans.registry import register
from docketry.streaming import streams

NUMBER = "coalesce(CASE folder_code " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in FOLDER_OF.items()) + " END, 0)"


@register("batch_build", with_inputs(f"SELECT batch_id, count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages, count(*) FILTER (WHERE confidence > 0.8) AS approved, count(*) FILTER (WHERE confidence <= 0.8) AS review, count(DISTINCT {NUMBER}) AS folders FROM batch_documents GROUP BY 1", "batch_documents"))
def batch_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_build(table(spark, sf_dir, "batch_documents"))


@register("built_documents", with_inputs(f"SELECT batch_id, CAST(batch_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY batch_id ORDER BY seq, folder_code, page_count, confidence, employee_code NULLS FIRST, cache_hit) - 1 AS VARCHAR) AS id, seq, CAST({NUMBER} AS INTEGER) AS folder_number, confidence, page_count FROM batch_documents", "batch_documents"))
def built_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.built_documents(table(spark, sf_dir, "batch_documents"))


@register("batch_groups", with_inputs(f"SELECT CAST({NUMBER} AS INTEGER) AS folder_number, coalesce(employee_code, 'unknown') AS employee, count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages FROM batch_documents GROUP BY 1, 2", "batch_documents"))
def batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_groups(table(spark, sf_dir, "batch_documents"))


@register(
    "batch_statistics",
    with_inputs(
        """WITH d AS (SELECT batch_id, count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages, count(*) FILTER (WHERE confidence > 0.8) AS approved, count(*) FILTER (WHERE confidence <= 0.8) AS review, count(*) FILTER (WHERE cache_hit) AS cache_hits, avg(confidence) AS m FROM batch_documents GROUP BY 1), c AS (SELECT batch_id, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, sum(cost) AS cost FROM provider_calls GROUP BY 1)
    SELECT batch_id, documents, pages, approved, review, cache_hits, round(coalesce(cost, 0) / CAST(greatest(1, documents) AS DOUBLE), 6) AS cost_per_document, round(m, 6) AS mean_confidence, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, round(coalesce(cost, 0), 4) AS cost, round(cache_hits / CAST(greatest(1, documents) AS DOUBLE), 6) AS cache_hit_rate FROM d LEFT JOIN c USING (batch_id)""",
        "batch_documents",
        "provider_calls",
    ),
)
def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_statistics(table(spark, sf_dir, "batch_documents"), table(spark, sf_dir, "provider_calls"))


EVERY = ", ".join(f"({n}, '{c}')" for n, c, _ in FOLDERS)


@register("folder_counters", with_inputs(f"SELECT CAST(number AS INTEGER) AS number, code, CASE WHEN count(folder_code) > 0 THEN 'detected' ELSE 'missing' END AS status, count(folder_code) AS document_count, count(folder_code) FILTER (WHERE confidence > 0.8) AS approved_count, count(folder_code) FILTER (WHERE confidence <= 0.8) AS review_count FROM (VALUES {EVERY}) e(number, code) LEFT JOIN batch_documents ON code = folder_code GROUP BY 1, 2", "batch_documents"))
def folder_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.folder_counters(table(spark, sf_dir, "batch_documents"))


@register("provider_call_totals", with_inputs("SELECT provider_id, status, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, round(avg(latency_ms), 4) AS mean_latency, round(sum(cost), 4) AS cost FROM provider_calls GROUP BY 1, 2", "provider_calls"))
def provider_call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.provider_calls(table(spark, sf_dir, "provider_calls"))


@register("call_totals_by_day", with_inputs("SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS window_start, provider_id, status, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM provider_calls GROUP BY 1, 2, 3", "provider_calls"))
def call_totals_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.call_totals(table(spark, sf_dir, "provider_calls"))


@register("upload_roll_up", with_inputs("SELECT company_id, year, folder_number, count(*) AS uploads, CAST(sum(files) AS BIGINT) AS files, count(*) FILTER (WHERE status = 'submitted') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, max(submitted_at) AS latest FROM uploads WHERE status <> 'archived' GROUP BY 1, 2, 3", "uploads"))
def upload_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upload_roll_up(table(spark, sf_dir, "uploads"))


@register(
    "month_grid",
    with_inputs(
        """WITH y AS (SELECT DISTINCT company_id, year FROM uploads), g AS (SELECT company_id, year, CAST(m AS INTEGER) AS month FROM y, range(1, 13) r(m)), b AS (SELECT company_id, year, month, bool_or(status IN ('approved', 'done', 'generated')) AS done FROM bundle_months GROUP BY 1, 2, 3)
    SELECT g.company_id, g.year, g.month, count(u.status) AS uploads, CASE WHEN bool_or(done) THEN 'done' WHEN bool_or(u.status = 'submitted') THEN 'submitted' WHEN count(u.status) > 0 OR count(b.done) > 0 THEN 'has_data' ELSE 'empty' END AS cell
    FROM g LEFT JOIN uploads u ON g.company_id = u.company_id AND g.year = u.year AND g.month = u.month LEFT JOIN b ON g.company_id = b.company_id AND g.year = b.year AND g.month = b.month GROUP BY 1, 2, 3""",
        "uploads",
        "bundle_months",
    ),
)
def month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.month_grid(table(spark, sf_dir, "uploads"), table(spark, sf_dir, "bundle_months"))


@register("first_source", with_inputs("SELECT workspace_key, source_hash, priority, seq FROM (SELECT *, row_number() OVER (PARTITION BY workspace_key, source_hash ORDER BY priority, seq) AS nth FROM approved_documents) WHERE nth = 1", "approved_documents"))
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.first_source(table(spark, sf_dir, "approved_documents")).select("workspace_key", "source_hash", "priority", "seq")


@register(
    "assembly_plan",
    with_inputs(
        "WITH o AS (SELECT *, row_number() OVER w AS nth, sum(page_count) OVER (PARTITION BY workspace_key ORDER BY folder_number, approved_at, seq ROWS UNBOUNDED PRECEDING) AS upto FROM approved_documents WHERE folder_number BETWEEN 2 AND 13 WINDOW w AS (PARTITION BY workspace_key ORDER BY folder_number, approved_at, seq)) SELECT workspace_key, seq, CAST(nth AS INTEGER) AS place, CAST(upto - page_count + 1 AS BIGINT) AS first_page, CAST(upto AS BIGINT) AS last_page FROM o",
        "approved_documents",
    ),
)
def assembly_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.assembly_plan(table(spark, sf_dir, "approved_documents"))


@register(
    "workspace_gate",
    with_inputs(
        "WITH s AS (SELECT company_id AS workspace_key, folder_number, status, CASE WHEN status = 'processing' AND files = 3 THEN 1 ELSE 0 END AS pending FROM uploads) SELECT workspace_key, CASE WHEN max(pending) > 0 THEN 'blocked' WHEN coalesce(min(CASE WHEN folder_number BETWEEN 2 AND 13 THEN CASE WHEN status IN ('approved', 'done') THEN 1 ELSE 0 END END), 1) = 0 THEN 'needs_confirmation' ELSE 'ready' END AS state FROM s GROUP BY 1",
        "uploads",
    ),
)
def workspace_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = table(spark, sf_dir, "uploads").select(F.col("company_id").alias("workspace_key"), "folder_number", "status", F.when((F.col("status") == "processing") & (F.col("files") == 3), 1).otherwise(0).alias("pending"))
    return state.gate(up)


@register(
    "snapshot_changes",
    with_inputs(
        "WITH a AS (SELECT DISTINCT group_no, file_name, 1 AS o FROM snapshot_files WHERE NOT late), b AS (SELECT DISTINCT group_no, file_name, 1 AS n FROM snapshot_files WHERE late) SELECT group_no, count(o) AS before, count(n) AS now, count(*) FILTER (WHERE o IS NULL) AS added, count(*) FILTER (WHERE n IS NULL) AS removed, count(*) FILTER (WHERE o IS NULL OR n IS NULL) > 0 AS changed FROM a FULL JOIN b USING (group_no, file_name) GROUP BY 1",
        "snapshot_files",
    ),
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "snapshot_files")
    return state.snapshot_changes(files.where("NOT late"), files.where("late"))


@register("correction_patterns", with_inputs("SELECT from_code, to_code, count(*) AS n FROM corrections GROUP BY 1, 2 HAVING count(*) >= 3", "corrections"))
def correction_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.correction_patterns(table(spark, sf_dir, "corrections"))
