"""Queries over workspaces, answers and caches, payslips, and the product's checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import checks, cluster, learn, workspace
from docketry.operators.dims import FOLDER_OF
from docketry.plans.inputs import SEQ, table, with_inputs
from docketry.plans.registry import register

YEAR, MONTH = 1996, 6
NUMBER = "coalesce(CASE document_code " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in FOLDER_OF.items()) + " END, 0)"
OTHER = f"coalesce(target_year <> {YEAR}, false) OR coalesce(target_month <> {MONTH}, false)"


@register("cached_routes", with_inputs("SELECT seq, source_hash, c.document_code AS document_code, CASE WHEN c.source_hash IS NOT NULL THEN 'cache' END AS route_source FROM route_rows r LEFT JOIN (SELECT * FROM cache_rows WHERE rules_version = company_id % 3 OR route_source = 'operator') c USING (company_id, source_hash)", "route_rows", "cache_rows"))
def cached_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "cache_rows")
    versions = cache.select("company_id").distinct().withColumn("rules_version", (F.col("company_id") % 3).cast("int"))
    return workspace.cached_routes(table(spark, sf_dir, "route_rows").select("company_id", "seq", "source_hash"), cache, versions).select("seq", "source_hash", "document_code", "route_source")


ASKED = f"route_source <> 'cache' AND ({NUMBER} < 2 OR confidence < 0.7 OR {OTHER})"
ANSWERED = f"""WITH q AS (SELECT *, {ASKED} AS asked, CASE WHEN seq % 3 <> 0 THEN CASE WHEN seq % 2 = 0 THEN 'GIR' ELSE 'EBI' END END AS code FROM route_rows),
  answered AS (SELECT seq, CASE WHEN asked AND code IS NOT NULL THEN code ELSE document_code END AS document_code, CASE WHEN asked AND code IS NOT NULL THEN CAST(0.8 AS DOUBLE) WHEN asked THEN least(confidence, CAST(0.69 AS DOUBLE)) ELSE confidence END AS confidence, CASE WHEN asked AND code IS NOT NULL THEN 'llm' WHEN asked THEN 'fallback' ELSE route_source END AS route_source FROM q)"""


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "route_rows")
    answers = rows.where("seq % 3 <> 0").select("seq", F.when(F.col("seq") % 2 == 0, "GIR").otherwise("EBI").alias("code"), F.lit(0.8).alias("answer_confidence")).distinct()
    return workspace.answered(rows, answers, YEAR, MONTH)


@register("answered_routes", with_inputs(ANSWERED + " SELECT * FROM answered", "route_rows"))
def answered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir)


@register("route_counts", with_inputs(ANSWERED + " SELECT route_source, count(*) AS n FROM answered GROUP BY 1", "route_rows"))
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.route_counts(answered(spark, sf_dir))


ANSWER = "concat('{\"document_code\": \"', CASE WHEN l_partkey % 4 = 0 THEN 'XX' ELSE 'PIR' END, '\", \"confidence\": ', CASE WHEN l_partkey % 5 = 0 THEN 'null' WHEN l_partkey % 5 = 1 THEN '\"0.5\"' ELSE '0.9' END, ', \"reason\": \"', CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE 'ok' END, '\", \"target_year\": \"', CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 7 = 1 THEN '1999' ELSE '2025' END, '\", \"target_month\": ', CAST(l_linenumber * 2 AS VARCHAR(4)), '}')"


@register(
    "repaired_answers",
    f"""WITH a AS (SELECT {SEQ} AS seq, CAST({ANSWER} AS JSON) AS j FROM lineitem), f AS (SELECT seq, j->>'$.document_code' AS c, coalesce(TRY_CAST(j->>'$.confidence' AS DOUBLE), 0) AS confidence, j->>'$.reason' AS r, TRY_CAST(nullif(j->>'$.target_year', '') AS INTEGER) AS target_year, TRY_CAST(j->>'$.target_month' AS INTEGER) AS target_month FROM a)
    SELECT seq, CASE WHEN c = 'PIR' THEN c ELSE 'UNKNOWN' END AS document_code, confidence, CASE WHEN trim(r) = '' THEN 'Sem evidência suficiente para classificação automática.' ELSE r END AS reason, target_year, target_month, coalesce(target_year NOT BETWEEN 2000 AND 2100, false) OR target_month NOT BETWEEN 1 AND 12 AS rejected FROM f""",
)
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(F.expr(SEQ).alias("seq"), F.expr(ANSWER).alias("answer"))
    return workspace.repaired_answers(raw).drop("employee_name")


@register("cache_writes", with_inputs(f"SELECT company_id, document_code, count(*) FILTER (WHERE {NUMBER} >= 2 AND confidence >= 0.7) AS classified, count(*) FILTER (WHERE {NUMBER} >= 1 AND confidence >= 0.34 AND route_source <> 'cache') AS clustered FROM route_rows WHERE NOT ({OTHER}) AND ({NUMBER} >= 2 AND confidence >= 0.7 OR {NUMBER} >= 1 AND confidence >= 0.34 AND route_source <> 'cache') GROUP BY 1, 2", "route_rows"))
def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "route_rows")
    both = workspace.cache_rows(rows, YEAR, MONTH).select("company_id", "document_code", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(workspace.cache_rows(rows, YEAR, MONTH, True).select("company_id", "document_code", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("company_id", "document_code").agg(F.sum("a").alias("classified"), F.sum("b").alias("clustered"))


@register("periods_to_apply", with_inputs("SELECT workspace_key, target_year AS year, target_month AS month, count(*) AS items, count(*) FILTER (WHERE confidence >= 0.7) AS sure FROM route_rows GROUP BY 1, 2, 3", "route_rows"))
def periods_to_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.periods_to_apply(table(spark, sf_dir, "route_rows").withColumnsRenamed({"target_year": "year", "target_month": "month"}))


@register("applied_periods", with_inputs(f"WITH k AS (SELECT *, {NUMBER} AS n, confidence < 0.7 AS review FROM route_rows) SELECT workspace_key, target_year AS year, target_month AS month, CAST(n AS INTEGER) AS folder_number, count(*) AS document_count, count(*) FILTER (WHERE NOT review) AS approved_count, count(*) FILTER (WHERE review) AS review_count, CASE WHEN max({{s: seq, d: document_code, c: confidence, r: review}}).r THEN 'review' ELSE 'approved' END AS status FROM k WHERE n > 0 GROUP BY 1, 2, 3, 4", "route_rows"))
def applied_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.applied_periods(table(spark, sf_dir, "route_rows").withColumnsRenamed({"target_year": "year", "target_month": "month"}))


@register(
    "new_employees",
    with_inputs("WITH h AS (SELECT workspace_key, count(*) AS have FROM employees GROUP BY 1), n AS (SELECT workspace_key, seq, row_number() OVER (PARTITION BY workspace_key ORDER BY seq) + coalesce(have, 0) AS nth FROM route_rows LEFT JOIN h USING (workspace_key) WHERE document_code = 'RV') SELECT workspace_key, seq, printf('E%04d', nth) AS employee_code, printf('Employee %d', nth) AS employee_name, printf('CF_199606_E%04d.pdf', nth) AS file_name FROM n", "route_rows", "employees"),
)
def new_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    payslips = table(spark, sf_dir, "route_rows").where("document_code = 'RV'").select("workspace_key", "seq", F.lit(None).cast("string").alias("employee_name"))
    return workspace.new_employees(payslips, table(spark, sf_dir, "employees"), YEAR, MONTH)


@register("classified_folders", with_inputs(f"SELECT workspace_key, CAST({NUMBER} AS INTEGER) AS folder_number, count(*) AS document_count, count(*) FILTER (WHERE confidence >= 0.7) AS approved_count, count(*) FILTER (WHERE confidence < 0.7) AS review_count, CASE WHEN arg_max(confidence < 0.7, seq) THEN 'review' ELSE 'approved' END AS status FROM route_rows WHERE {NUMBER} > 0 GROUP BY 1, 2", "route_rows"))
def classified_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.classified_folders(table(spark, sf_dir, "route_rows").withColumn("review", F.col("confidence") < 0.7))


@register(
    "audit_manifest",
    with_inputs(
        """WITH d AS (SELECT batch_id, count(*) AS n, CAST(sum(page_count) AS BIGINT) AS input_pages, count(*) FILTER (WHERE confidence > 0.8) AS ok, count(*) FILTER (WHERE confidence <= 0.8) AS re, count(*) FILTER (WHERE cache_hit) AS hits FROM batch_documents GROUP BY 1), c AS (SELECT batch_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, sum(cost) AS cost, avg(latency_ms) AS latency FROM provider_calls GROUP BY 1)
    SELECT batch_id, input_pages, ok + re AS classified_pages, re AS reviewed_pages, ok AS approved_pages, round(ok / CAST(n AS DOUBLE), 6) AS accuracy, CAST(1 AS DOUBLE) AS grouping_accuracy, coalesce(tokens, 0) AS tokens, round(hits / CAST(n AS DOUBLE), 6) AS cache_hit_rate, round(hits / CAST(n AS DOUBLE), 6) AS rule_hit_rate, 150 AS average_latency_ms, round(coalesce(latency, 0), 4) AS true_latency_ms, round(coalesce(cost, 0), 4) AS cost FROM d LEFT JOIN c USING (batch_id)""",
        "batch_documents",
        "provider_calls",
    ),
)
def audit_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.audit_manifest(table(spark, sf_dir, "batch_documents"), table(spark, sf_dir, "provider_calls"))


@register("batch_activity", with_inputs("SELECT batch_id, count(*) AS intake, printf('Batch %d: %d documents, %d pages', batch_id, count(*), CAST(sum(page_count) AS BIGINT)) AS text FROM batch_documents GROUP BY 1", "batch_documents"))
def batch_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.batch_activity(table(spark, sf_dir, "batch_documents"))


@register("export_bundles", with_inputs("SELECT workspace_key AS batch_id, printf('BJ_%d%02d_%d.pdf', year, month, company_id) AS file_name, 'pdf' AS format, 1 AS page_count FROM workspace_rows", "workspace_rows"))
def export_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.export_bundles(table(spark, sf_dir, "workspace_rows").withColumnRenamed("workspace_key", "batch_id"))


@register(
    "database_roll_up",
    with_inputs(
        """WITH e AS (SELECT workspace_key, count(*) AS n, count(*) FILTER (WHERE final_status = 'current') AS c, count(*) FILTER (WHERE final_status LIKE 'ready%') AS r FROM employees GROUP BY 1), f AS (SELECT workspace_key, count(*) FILTER (WHERE status <> 'review') AS folders FROM folder_states GROUP BY 1), p AS (SELECT workspace_key, count(*) FILTER (WHERE status = 'pending') AS pending FROM reviews GROUP BY 1)
    SELECT company_id, year, CAST(row_number() OVER (PARTITION BY company_id, year ORDER BY month, workspace_key) AS INTEGER) AS nth, month, workspace_key, coalesce(n, 0) AS employees, coalesce(c, 0) AS current, coalesce(r, 0) AS ready, greatest(0, coalesce(n, 0) - coalesce(c, 0) - coalesce(r, 0)) AS blocked, coalesce(folders, 0) AS folders, coalesce(pending, 0) AS pending FROM workspace_rows LEFT JOIN e USING (workspace_key) LEFT JOIN f USING (workspace_key) LEFT JOIN p USING (workspace_key)""",
        "workspace_rows",
        "employees",
        "folder_states",
        "reviews",
    ),
)
def database_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = workspace.database_roll_up(table(spark, sf_dir, "workspace_rows"), table(spark, sf_dir, "employees"), table(spark, sf_dir, "folder_states"), table(spark, sf_dir, "reviews"))
    months = tree.select("company_id", F.inline("years")).select("company_id", "year", F.posexplode("months").alias("pos", "m"))
    return months.select("company_id", "year", (F.col("pos") + 1).alias("nth"), "m.*")


@register(
    "opened_months",
    with_inputs(
        """WITH q AS (SELECT DISTINCT company_id, CAST((project_id + 1) % 4 AS BIGINT) AS project_id, year, month FROM workspace_rows), n AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM workspace_rows w WHERE w.company_id = q.company_id AND w.project_id = q.project_id AND w.year = q.year AND w.month = q.month)),
    t AS (SELECT n.*, w.workspace_key AS template, row_number() OVER (PARTITION BY n.company_id, n.project_id, n.year, n.month ORDER BY w.project_id = n.project_id DESC, w.year DESC, w.month DESC, w.workspace_key DESC) AS nth FROM n JOIN workspace_rows w ON w.company_id = n.company_id)
    SELECT company_id, project_id, year, month, template, CAST(f AS INTEGER) AS folder_number, 'missing' AS status FROM t, range(1, 14) r(f) WHERE nth = 1""",
        "workspace_rows",
    ),
)
def opened_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "workspace_rows")
    return workspace.opened_months(rows.select("company_id", ((F.col("project_id") + 1) % 4).alias("project_id"), "year", "month").distinct(), rows)


@register("new_companies", "WITH r AS (SELECT CAST(c_custkey AS BIGINT) AS seq, nullif(regexp_replace(regexp_replace(lower('Co. ' || CAST(c_custkey % 90 AS VARCHAR)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS id, CASE WHEN c_custkey % 5 = 0 THEN '12' ELSE '123456789' END AS nif FROM customer) SELECT seq, id, CASE WHEN nif = '12' THEN 'invalid code or NIF' WHEN id IN ('co-1', 'co-2') OR row_number() OVER (PARTITION BY id ORDER BY seq) > 1 THEN 'already there' ELSE 'created' END AS result FROM r")
def new_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("seq"), F.concat(F.lit("Co. "), (F.col("c_custkey") % 90).cast("string")).alias("code"), F.when(F.col("c_custkey") % 5 == 0, "12").otherwise("123456789").alias("nif"))
    return workspace.new_companies(requests, requests.select(F.explode(F.array(F.lit("co-1"), F.lit("co-2"))).alias("id")).distinct())


@register("updated_reviews", with_inputs("WITH u AS (SELECT seq, CASE seq % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'correct' END AS action, CASE WHEN seq % 2 = 0 THEN 'GIR' END AS code FROM reviews WHERE seq % 5 < 3) SELECT workspace_key, r.seq AS seq, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'passed' WHEN 'correct' THEN 'pending' ELSE status END AS status, coalesce(code, 'LC') AS proposed_code FROM reviews r LEFT JOIN u USING (seq)", "reviews"))
def updated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "reviews").withColumn("proposed_code", F.lit("LC"))
    updates = rows.where("seq % 5 < 3").select("seq", F.lit(1).alias("nth"), F.expr("CASE seq % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'correct' END").alias("action"), F.expr("CASE WHEN seq % 2 = 0 THEN 'GIR' END").alias("code"))
    return workspace.updated_reviews(rows, updates)


@register("finals_to_make", with_inputs("SELECT workspace_key, count(*) AS n FROM employees WHERE final_status LIKE 'ready%' AND payslip_hash IS NOT NULL GROUP BY 1", "employees"))
def finals_to_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.finals_to_make(table(spark, sf_dir, "employees")).groupBy("workspace_key").agg(F.count("*").alias("n"))


FILES = "SELECT workspace_key, seq, concat('01_RV_', employee_name, '_2025-01.pdf') AS file_name FROM employees WHERE seq % 11 = 0"


@register(
    "resolved_payslips",
    with_inputs(
        f"""WITH w AS (SELECT * FROM employees WHERE final_status <> 'blocked'), f AS ({FILES}), s AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS payslip_hash, concat('h', CAST(p_partkey AS VARCHAR), '.pdf') AS by_hash FROM part WHERE p_partkey % 2 = 0),
    b AS (SELECT * FROM w LEFT JOIN s USING (payslip_hash)), m AS (SELECT b.workspace_key, b.employee_code, min({{s: f.seq, f: f.file_name}}).f AS by_name FROM b JOIN f ON f.workspace_key = b.workspace_key AND contains(replace(lower(f.file_name), ' ', ''), replace(lower(b.employee_name), ' ', '')) WHERE by_hash IS NULL GROUP BY 1, 2), o AS (SELECT workspace_key, min(file_name) AS only_file FROM f GROUP BY 1 HAVING count(*) = 1)
    SELECT workspace_key, employee_code, coalesce(by_hash, by_name, only_file) AS file_name, CASE WHEN by_hash IS NOT NULL THEN 'hash' WHEN by_name IS NOT NULL THEN 'name' WHEN only_file IS NOT NULL THEN 'only file' ELSE 'none' END AS how FROM b LEFT JOIN m USING (workspace_key, employee_code) LEFT JOIN o USING (workspace_key)""",
        "employees",
    ),
)
def resolved_payslips(spark: SparkSession, sf_dir: str) -> DataFrame:
    staff = table(spark, sf_dir, "employees")
    files = staff.where("seq % 11 = 0").select("workspace_key", "seq", F.concat(F.lit("01_RV_"), "employee_name", F.lit("_2025-01.pdf")).alias("file_name"))
    stored = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("long").alias("source_hash"), F.concat(F.lit("h"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("file_name")).distinct()
    return workspace.resolved_payslips(staff.where("final_status <> 'blocked'"), stored, files)


@register(
    "detected_payslips",
    with_inputs("WITH f AS (SELECT company_id, seq, folder_number, status, concat(CASE WHEN seq % 2 = 0 THEN '01_RV_' ELSE 'x_' END, 'Ana_', CAST(seq % 400 AS VARCHAR(8)), '.pdf') AS file_name FROM uploads) SELECT company_id, file_name, CASE WHEN file_name LIKE '01%' THEN replace(file_name[7:length(file_name) - 4], '_', ' ') ELSE replace(file_name[:length(file_name) - 4], '_', ' ') END AS employee_name, seq, folder_number FROM (SELECT *, row_number() OVER (PARTITION BY company_id, file_name ORDER BY folder_number <> 1, seq) AS nth FROM f WHERE folder_number = 1 OR folder_number = 0 AND status <> 'archived' AND file_name LIKE '01%') WHERE nth = 1", "uploads"),
)
def detected_payslips(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = table(spark, sf_dir, "uploads").withColumn("file_name", F.expr("concat(CASE WHEN seq % 2 = 0 THEN '01_RV_' ELSE 'x_' END, 'Ana_', CAST(seq % 400 AS STRING), '.pdf')"))
    return workspace.detected_payslips(up)


@register("reassigned_cache", with_inputs("WITH n AS (SELECT company_id, source_hash, arg_max(document_code, seq) AS document_code FROM route_rows WHERE folder_number = 3 AND document_code <> 'UNKNOWN' GROUP BY 1, 2) SELECT company_id, source_hash, coalesce(n.document_code, c.document_code) AS document_code, CASE WHEN n.source_hash IS NOT NULL THEN 'operator' ELSE c.route_source END AS route_source FROM cache_rows c FULL JOIN n USING (company_id, source_hash)", "route_rows", "cache_rows"))
def reassigned_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "route_rows").where("folder_number = 3").select("company_id", "source_hash", F.col("seq").alias("nth"), "document_code")
    return workspace.reassigned(table(spark, sf_dir, "cache_rows"), new).select("company_id", "source_hash", "document_code", "route_source")


BUNDLE = "concat('BJ_', CAST(workspace_key AS VARCHAR(12)), '.pdf')"


@register("after_deleted_exports", with_inputs(f"WITH b AS (SELECT workspace_key FROM workspace_rows WHERE workspace_key % 4 = 0) SELECT e.workspace_key AS workspace_key, seq, CASE WHEN seq % 9 = 0 OR b.workspace_key IS NOT NULL AND final_status = 'current' THEN 'ready' ELSE final_status END AS final_status FROM employees e LEFT JOIN b ON b.workspace_key = e.workspace_key", "employees", "workspace_rows"))
def after_deleted_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    staff = table(spark, sf_dir, "employees").withColumn("file_name", F.concat(F.lit("CF_"), F.col("seq").cast("string"), F.lit(".pdf")))
    bundles = table(spark, sf_dir, "workspace_rows").withColumn("file_name", F.expr(BUNDLE.replace("VARCHAR(12)", "STRING")))
    deleted = staff.where("seq % 9 = 0").select("file_name").unionByName(bundles.where("workspace_key % 4 = 0").select("file_name"))
    return workspace.after_deleted_exports(staff, bundles, deleted)[0].select("workspace_key", "seq", "final_status")


@register("reset_companies", with_inputs("SELECT workspace_key FROM workspace_rows WHERE NOT (company_id = 1 OR company_id = 2 AND project_id = 0)", "workspace_rows"))
def reset_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "workspace_rows")
    asked = rows.where("company_id = 1").select("company_id", F.lit(None).cast("long").alias("project_id")).unionByName(rows.where("company_id = 2 AND project_id = 0").select("company_id", "project_id"))
    return workspace.reset_companies(rows, rows.select("company_id").distinct(), asked)[0].select("workspace_key")


@register("invalidated_workspaces", with_inputs("SELECT workspace_key, CASE WHEN workspace_key % 3 < 2 AND status <> 'blocked' THEN 'blocked' ELSE status END AS status, CASE WHEN workspace_key % 3 = 0 THEN 5 WHEN workspace_key % 3 = 1 THEN intake + 5 ELSE intake END AS intake, workspace_key % 3 = 0 AS cleared FROM workspace_rows", "workspace_rows"))
def invalidated_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "workspace_rows")
    return workspace.invalidated(rows, rows.where("workspace_key % 3 < 2").select("workspace_key", F.when(F.col("workspace_key") % 3 == 0, "replace").otherwise("append").alias("mode"), F.lit(5).cast("long").alias("files")))


@register("finals_by_month", with_inputs("SELECT CAST(workspace_key % 5 AS BIGINT) AS company_id, CAST(2023 + workspace_key % 2 AS INTEGER) AS year, CAST(seq % 12 + 1 AS INTEGER) AS month, count(*) AS n, min(employee_code) AS first, CAST(row_number() OVER (PARTITION BY workspace_key % 5 ORDER BY 2023 + workspace_key % 2 DESC, seq % 12 DESC) AS INTEGER) AS place FROM employees GROUP BY workspace_key % 5, workspace_key % 2, seq % 12", "employees"))
def finals_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    finals = table(spark, sf_dir, "employees").select((F.col("workspace_key") % 5).alias("company_id"), (2023 + F.col("workspace_key") % 2).cast("int").alias("year"), (F.col("seq") % 12 + 1).cast("int").alias("month"), "employee_code")
    return workspace.finals_by_month(finals).select("company_id", "year", "month", F.size("employees").cast("long").alias("n"), F.col("employees")[0].alias("first"), "place")


@register("items_to_confirm", with_inputs(f"SELECT folder_number, CASE WHEN target_year IS NOT NULL AND target_month IS NOT NULL THEN target_year ELSE {YEAR} END AS target_year, CASE WHEN target_year IS NOT NULL AND target_month IS NOT NULL THEN target_month ELSE {MONTH} END AS target_month, count(*) AS n FROM route_rows WHERE folder_number BETWEEN 2 AND 13 GROUP BY 1, 2, 3", "route_rows"))
def items_to_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.items_to_confirm(table(spark, sf_dir, "route_rows"), YEAR, MONTH).groupBy("folder_number", "target_year", "target_month").agg(F.count("*").alias("n"))


@register("workspace_counters", with_inputs("SELECT workspace_key, (SELECT count(*) FROM folder_states f WHERE f.workspace_key = w.workspace_key AND status IN ('approved', 'passed')) AS approved_folders, (SELECT count(*) FROM reviews r WHERE r.workspace_key = w.workspace_key AND status = 'pending') AS pending_reviews, (SELECT count(*) FROM employees e WHERE e.workspace_key = w.workspace_key AND final_status = 'current') AS current_finals FROM workspace_rows w", "workspace_rows", "folder_states", "reviews", "employees"))
def workspace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "workspace_rows")
    references = rows.select("workspace_key", F.lit("base_join").alias("kind"))
    return workspace.workspace_counters(rows, table(spark, sf_dir, "folder_states"), table(spark, sf_dir, "reviews"), table(spark, sf_dir, "employees"), references).drop("base_references", "final_references")


@register("cell_files", with_inputs("SELECT company_id, year, CAST(coalesce(sum(files) FILTER (WHERE status = 'submitted'), 0) AS BIGINT) AS files, bool_or(status IN ('grouped', 'month_detected', 'approved', 'archived')) AS processing FROM uploads WHERE folder_number = 3 AND month = 6 GROUP BY 1, 2", "uploads"))
def cell_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.cell_files(table(spark, sf_dir, "uploads"), 3, 6)


@register("bundles_of_payslips", with_inputs("WITH p AS (SELECT company_id, concat('Ana ', CAST(seq % 50 AS VARCHAR(8)), '.pdf') AS file_name FROM uploads WHERE folder_number = 1), f AS (SELECT company_id, concat('Ana_', CAST(seq % 50 AS VARCHAR(8))) AS employee_code, count(*) AS n FROM uploads WHERE folder_number = 2 GROUP BY 1, 2) SELECT company_id, file_name, replace(file_name[:length(file_name) - 4], ' ', '_') AS employee_code, coalesce(n, 0) AS bundles FROM p LEFT JOIN f ON p.company_id = f.company_id AND f.employee_code = replace(file_name[:length(file_name) - 4], ' ', '_')".replace("SELECT company_id, file_name, replace", "SELECT p.company_id AS company_id, file_name, replace"), "uploads"))
def bundles_of_payslips(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = table(spark, sf_dir, "uploads")
    name = F.concat(F.lit("Ana "), (F.col("seq") % 50).cast("string"))
    return workspace.bundles_of_payslips(up.where("folder_number = 1").select("company_id", F.concat(name, F.lit(".pdf")).alias("file_name")), up.where("folder_number = 2").select("company_id", F.regexp_replace(name, " ", "_").alias("employee_code")))


@register("items_left", with_inputs("WITH g AS (SELECT DISTINCT document_code, source_hash FROM route_rows WHERE confidence < 0.5) SELECT document_code AS bucket, count(*) FILTER (WHERE g.source_hash IS NULL) AS items, count(g.source_hash) AS removed FROM route_rows LEFT JOIN g USING (document_code, source_hash) GROUP BY 1 HAVING count(*) FILTER (WHERE g.source_hash IS NULL) > 0 OR document_code <> 'UNKNOWN'", "route_rows"))
def items_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "route_rows").withColumnRenamed("document_code", "bucket")
    return workspace.without_items(rows, rows.where("confidence < 0.5"))


@register("file_locations", with_inputs("SELECT seq, r.source_hash AS source_hash, CASE WHEN c.source_hash IS NOT NULL THEN 'cache' WHEN r.source_hash % 3 = 0 THEN 'upload' ELSE 'skipped' END AS place FROM route_rows r LEFT JOIN (SELECT DISTINCT source_hash FROM cache_rows WHERE source_hash % 2 = 0) c ON c.source_hash = r.source_hash", "route_rows", "cache_rows"))
def file_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cache = table(spark, sf_dir, "route_rows"), table(spark, sf_dir, "cache_rows")
    uploaded = rows.where("source_hash % 3 = 0").select("source_hash").distinct().withColumn("path", F.lit("p"))
    return workspace.file_locations(rows, cache.where("source_hash % 2 = 0").select("source_hash").distinct(), uploaded)


@register("activity_log", with_inputs("SELECT workspace_key, seq, CAST(place AS INTEGER) AS place FROM (SELECT workspace_key, seq, row_number() OVER (PARTITION BY workspace_key ORDER BY approved_at DESC, seq DESC) AS place FROM approved_documents) WHERE place <= 20", "approved_documents"))
def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.activity_log(table(spark, sf_dir, "approved_documents").withColumnRenamed("approved_at", "at")).select("workspace_key", "seq", "place")


@register("merged_uploads", with_inputs("WITH i AS (SELECT DISTINCT folder_number, CAST(source_hash AS VARCHAR) AS source_hash FROM route_rows WHERE folder_number > 0 AND source_hash % 2 = 0), n AS (SELECT DISTINCT folder_number, CAST(seq % 3000 AS VARCHAR) AS source_hash FROM uploads WHERE status <> 'archived') SELECT folder_number, count(*) AS items FROM (SELECT * FROM i UNION SELECT * FROM n) GROUP BY 1", "route_rows", "uploads"))
def merged_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "route_rows").where("folder_number > 0 AND source_hash % 2 = 0").select("folder_number", F.col("source_hash").cast("string").alias("source_hash"), F.lit(0.5).alias("confidence"), F.col("target_year").alias("year"), F.col("target_month").alias("month")).dropDuplicates(["folder_number", "source_hash"])
    up = table(spark, sf_dir, "uploads").select(F.col("seq").cast("string").alias("id"), "folder_number", "year", "month", "status", F.array(F.struct(F.lit("a.pdf").alias("name"), (F.col("seq") % 3000).cast("string").alias("hash"))).alias("files"))
    return cluster.merged_uploads(items, up).groupBy("folder_number").agg(F.count("*").alias("items"))


# Every component of a confidence moves by a law of its own, so none is the same for all.
COMPONENTS = {"entity": "1 - CAST(seq % 5 AS DOUBLE) / 10", "period": "0.5 + CAST(seq % 6 AS DOUBLE) / 10", "evidence": "CAST(page_count % 5 AS DOUBLE) / 4", "boundary": "1 - CAST(seq % 3 AS DOUBLE) / 4", "source": "0.6 + CAST(page_count % 4 AS DOUBLE) / 10", "rule": "CAST(seq % 4 AS DOUBLE) / 40", "example": "CAST(seq % 7 AS DOUBLE) / 70"}


@register(
    "final_confidence",
    with_inputs(
        f"""WITH c AS (SELECT batch_id, seq, confidence, page_count % 3 AS k, page_count % 2 AS m, {', '.join(f'{v} AS {n}' for n, v in COMPONENTS.items())} FROM batch_documents), f AS (SELECT *, round(greatest(0, least(1, 0.3 * confidence + 0.2 * entity + 0.15 * period + 0.15 * evidence + 0.1 * boundary + 0.1 * source + rule + example - least(0.6, 0.2 * CASE WHEN k = 2 THEN 1 ELSE 0 END) - least(0.45, 0.15 * CASE WHEN k = 1 THEN m ELSE 0 END))), 6) AS v FROM c)
    SELECT batch_id, count(*) FILTER (WHERE k = 2 OR k = 1 AND m > 0 OR v < 0.75) AS review, count(*) FILTER (WHERE NOT (k = 2 OR k = 1 AND m > 0) AND v >= 0.9) AS automatic, round(sum(v), 4) AS total FROM f GROUP BY 1""",
        "batch_documents",
    ),
)
def final_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "batch_documents")
    k, m = F.col("page_count") % 3, F.col("page_count") % 2
    part = {n: F.expr(v) for n, v in COMPONENTS.items()}
    rows = docs.withColumns({"type_confidence": F.col("confidence"), "entity_confidence": part["entity"], "period_confidence": part["period"], "evidence_confidence": part["evidence"], "boundary_confidence": part["boundary"], "source_quality_confidence": part["source"], "rule_adjustment": part["rule"], "example_adjustment": part["example"], "conflicts": F.when(k == 2, 1).otherwise(0), "missing_fields": F.when(k == 1, m).otherwise(0)})
    return checks.final_confidence(rows).groupBy("batch_id").agg(F.count_if(F.col("band") == "review").alias("review"), F.count_if(F.col("band") == "automatic").alias("automatic"), F.round(F.sum("final_confidence"), 4).alias("total"))


PERIOD_LAW = "CASE WHEN seq % 4 = 0 THEN NULL ELSE CAST(202401 + seq % 3 * (seq % 2) AS INT) END"


@register(
    "batch_anomalies",
    with_inputs(
        f"""WITH c AS (SELECT batch_id, folder_code, count(*) AS k FROM batch_documents GROUP BY 1, 2), t AS (SELECT batch_id, count(*) AS n FROM batch_documents GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY k DESC, folder_code) AS nth, max(k) OVER (PARTITION BY batch_id) AS top FROM c JOIN t USING (batch_id)), e AS (SELECT batch_id, coalesce(employee_code, '') AS employee, count(*) AS k FROM batch_documents WHERE employee_code IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT batch_id, CAST(period AS VARCHAR) AS period, count(*) AS k FROM (SELECT batch_id, {PERIOD_LAW} AS period FROM batch_documents) WHERE period IS NOT NULL GROUP BY 1, 2)
    SELECT batch_id, 'outlier_type' AS anomaly, folder_code AS detail FROM r WHERE nth > 1 AND top >= 0.3 * n UNION ALL SELECT batch_id, 'entity_mismatch', employee FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY k DESC, employee) AS nth FROM e) WHERE nth > 1 UNION ALL SELECT batch_id, 'period_drift', period FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY k DESC, period) AS nth FROM p) WHERE nth > 1
    UNION ALL SELECT batch_id, 'missing_evidence', 'GIR' FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.batch_id = t.batch_id AND folder_code = 'GIR')""",
        "batch_documents",
    ),
)
def batch_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "batch_documents").select("batch_id", F.col("folder_code").alias("code"), F.expr(PERIOD_LAW).alias("period"), F.col("employee_code").alias("entity"))
    return checks.batch_anomalies(docs, docs.select("batch_id").distinct().withColumn("code", F.lit("GIR")), 0.3)


@register(
    "entity_groups",
    with_inputs(
        """WITH d AS (SELECT CASE WHEN seq % 3 = 0 THEN CAST(100000000 + company_id AS VARCHAR) END AS nif, 'acme ' || CAST(company_id % 7 AS VARCHAR) AS plain, target_year AS y, target_month AS m FROM route_rows), n AS (SELECT plain, count(DISTINCT nif) AS k, min(nif) AS one FROM d WHERE nif IS NOT NULL GROUP BY 1), g AS (SELECT plain, k, coalesce(nif, CASE WHEN k = 1 THEN one END, plain) AS e, y * 100 + m AS p FROM d LEFT JOIN n USING (plain))
    SELECT CASE WHEN p IS NULL THEN 'review' ELSE e END AS entity, p AS period, count(*) AS documents, count(DISTINCT plain) AS names, coalesce(bool_or(k > 1), false) AS conflict FROM g GROUP BY 1, 2""",
        "route_rows",
    ),
)
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "route_rows").select(F.when(F.col("seq") % 3 == 0, (100000000 + F.col("company_id")).cast("string")).alias("nif"), F.concat(F.lit("Acme "), (F.col("company_id") % 7).cast("string"), F.lit(", Lda.")).alias("name"), F.col("target_year").alias("year"), F.col("target_month").alias("month"))
    return checks.entity_groups(docs.withColumn("name", F.regexp_replace("name", ",", "")))


# Records with something wrong here and there: confidence, month, number, date, and codes of other domains.
DOMAINS = {"irs": ("GIR", "LIR", "PIR"), "banking": ("TV", "EBV", "TSA", "EBSA", "EBI"), "payroll": ("RV", "LC")}
RECORD = {"c": "CASE WHEN seq % 7 = 0 THEN confidence * 2 ELSE confidence END", "m": "CASE WHEN seq % 11 = 0 THEN target_month + 10 ELSE target_month END", "nif": "CASE WHEN seq % 4 = 0 THEN '12' WHEN seq % 4 = 1 THEN '123456789' END", "dated": "CASE WHEN seq % 5 = 0 THEN '2025-1-2' WHEN seq % 5 = 1 THEN '2025-01-02' END", "domain": "CASE CAST(seq % 3 AS INT) WHEN 0 THEN 'irs' WHEN 1 THEN 'banking' ELSE 'payroll' END"}
_BELONGS = " OR ".join(f"domain = '{d}' AND document_code IN ({', '.join(repr(c) for c in codes)})" for d, codes in DOMAINS.items())


@register(
    "schema_problems",
    with_inputs(
        f"""WITH r AS (SELECT seq, document_code, {', '.join(f'{v} AS {k}' for k, v in RECORD.items())} FROM route_rows)
    SELECT seq AS doc_id, CASE WHEN m BETWEEN 1 AND 12 THEN CAST((m + 2) // 3 AS VARCHAR) || 'T' END AS quarter, array_to_string(list_filter([CASE WHEN NOT coalesce(c BETWEEN 0 AND 1, false) THEN 'confidence' END, CASE WHEN m NOT BETWEEN 1 AND 12 THEN 'month' END, CASE WHEN nif = '12' THEN 'nif' END, CASE WHEN dated = '2025-1-2' THEN 'date' END, CASE WHEN NOT ({_BELONGS} OR document_code = 'UNKNOWN') THEN 'domain' END], lambda x: x IS NOT NULL), ',') AS problems FROM r""",
        "route_rows",
    ),
)
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = {k: F.expr(v) for k, v in RECORD.items()}
    docs = table(spark, sf_dir, "route_rows").select(F.col("seq").alias("doc_id"), said["c"].alias("confidence"), said["m"].alias("month"), said["nif"].alias("nif"), said["dated"].alias("document_date"), said["domain"].alias("domain"), F.col("document_code").alias("code"))
    return checks.schema_problems(docs, spark.createDataFrame([(d, c) for d, codes in DOMAINS.items() for c in codes], "domain string, code string"))


@register("recorded_references", with_inputs("WITH n AS (SELECT DISTINCT company_id, source_hash, document_code FROM route_rows WHERE seq % 2 = 0 EXCEPT SELECT company_id, source_hash, document_code FROM cache_rows) SELECT company_id, 1 + count(source_hash) AS rules_version FROM (SELECT DISTINCT company_id FROM cache_rows) c LEFT JOIN n USING (company_id) GROUP BY 1", "route_rows", "cache_rows"))
def recorded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, rows = table(spark, sf_dir, "cache_rows"), table(spark, sf_dir, "route_rows")
    known = cache.select("company_id", "source_hash", F.col("document_code").alias("kind"), F.lit(0).cast("long").alias("seq"))
    new = rows.where("seq % 2 = 0").select("company_id", "source_hash", F.col("document_code").alias("kind"), "seq")
    return learn.recorded_references(known, new, cache.select("company_id").distinct().withColumn("rules_version", F.lit(1).cast("long")))[1]
