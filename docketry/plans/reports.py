"""Queries over screens' roll-ups, decisions, phrases and batch checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import decisions, learn, quality, reports, state
from docketry.operators.dims import FOLDER_OF
from docketry.plans.documents import TOKENS_SQL, duck_routes, routes, tokens
from docketry.plans.inputs import table, with_inputs
from docketry.plans.registry import register

CURRENT = 1998
BUSY = "status IN ('grouped', 'month_detected', 'approved')"
DATED = "target_year IS NOT NULL AND target_month IS NOT NULL"


@register("upload_years", with_inputs(f"WITH f AS (SELECT year, CAST(sum(files) AS BIGINT) AS files, max(submitted_at) AS latest FROM uploads GROUP BY 1), a AS (SELECT CAST(y AS INTEGER) AS year FROM range({CURRENT - 1}, {CURRENT + 2}) r(y)) SELECT year, coalesce(files, 0) AS files, latest FROM a FULL JOIN f USING (year)", "uploads"))
def upload_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.years(table(spark, sf_dir, "uploads"), CURRENT)


DONE = "status IN ('approved', 'done', 'generated')"


@register(
    "upload_totals",
    with_inputs(
        f"WITH a AS (SELECT * FROM uploads WHERE status <> 'archived'), m AS (SELECT year, month FROM bundle_months UNION SELECT year, month FROM a WHERE month IS NOT NULL) SELECT CAST(coalesce(sum(files) FILTER (WHERE status = 'submitted'), 0) AS BIGINT) AS new_files, CAST(coalesce(sum(files) FILTER (WHERE {BUSY}), 0) AS BIGINT) AS busy_files, max(submitted_at) AS latest, (SELECT count(*) FROM m) AS active_months, (SELECT count(*) FROM bundle_months WHERE {DONE}) AS completed_months FROM a",
        "uploads",
        "bundle_months",
    ),
)
def upload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.upload_totals(table(spark, sf_dir, "uploads"), table(spark, sf_dir, "bundle_months"))


@register(
    "year_cards",
    with_inputs(
        f"""WITH u AS (SELECT company_id, year, sum(files) AS total, coalesce(sum(files) FILTER (WHERE status = 'submitted'), 0) AS pending, coalesce(sum(files) FILTER (WHERE {BUSY}), 0) AS busy, max(submitted_at) AS latest FROM uploads GROUP BY 1, 2), b AS (SELECT company_id, year, count(*) AS months, count(*) FILTER (WHERE {DONE}) AS done FROM bundle_months GROUP BY 1, 2),
    k AS (SELECT company_id, year FROM u UNION SELECT company_id, year FROM b UNION SELECT company_id, CAST({CURRENT} AS INTEGER) FROM (SELECT company_id FROM u UNION SELECT company_id FROM b)),
    c AS (SELECT k.company_id AS company_id, k.year AS year, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(pending, 0) AS BIGINT) AS pending, CAST(coalesce(busy, 0) AS BIGINT) AS busy, coalesce(months, 0) AS months, coalesce(done, 0) AS done, latest FROM k LEFT JOIN u ON u.company_id = k.company_id AND u.year = k.year LEFT JOIN b ON b.company_id = k.company_id AND b.year = k.year)
    SELECT *, CASE WHEN pending > 0 THEN CAST(pending AS VARCHAR) || ' file(s) pending' WHEN months > 0 THEN CAST(done AS VARCHAR) || '/' || CAST(months AS VARCHAR) || ' months done' ELSE 'No data yet' END AS badge, year = {CURRENT} AS current FROM c""",
        "uploads",
        "bundle_months",
    ),
)
def year_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.year_cards(table(spark, sf_dir, "uploads"), table(spark, sf_dir, "bundle_months"), CURRENT)


@register("folder_panel", with_inputs("WITH p AS (SELECT company_id, folder_number, seq, row_number() OVER (PARTITION BY company_id, folder_number ORDER BY submitted_at DESC, seq) AS place, sum(files) OVER (PARTITION BY company_id, folder_number) AS total, count(*) OVER (PARTITION BY company_id, folder_number) AS n FROM uploads) SELECT company_id, folder_number, CAST(place AS INTEGER) AS place, seq, CAST(total AS BIGINT) AS total_files, greatest(n - 10, 0) AS remaining FROM p WHERE place <= 10", "uploads"))
def folder_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.folder_panel(table(spark, sf_dir, "uploads"))


@register("folder_cards", with_inputs(f"SELECT company_id, year, folder_number, CAST(coalesce(sum(files) FILTER (WHERE status = 'submitted'), 0) AS BIGINT) AS submitted_files, CAST(sum(files) AS BIGINT) AS total_files, bool_and(status = 'archived') AS archived, NOT bool_and(status = 'archived') AND bool_or({BUSY}) AS busy FROM uploads GROUP BY 1, 2, 3", "uploads"))
def folder_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.folder_cards(table(spark, sf_dir, "uploads"))


@register("items_by_month", duck_routes("SELECT bucket, target_year, target_month, count(*) AS items, min(file_name) AS first_file, CAST(row_number() OVER (PARTITION BY bucket ORDER BY coalesce(target_year * 100 + target_month, 999912), target_year NULLS FIRST, target_month NULLS FIRST) AS INTEGER) AS place FROM bucketed GROUP BY 1, 2, 3"))
def items_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.items_by_month(routes(spark, sf_dir))


@register("month_items", duck_routes("SELECT bucket, doc_id, file_name, CAST(dense_rank() OVER (PARTITION BY bucket ORDER BY coalesce(target_year * 100 + target_month, 999912), target_year NULLS FIRST, target_month NULLS FIRST) AS INTEGER) AS month_place, CAST(row_number() OVER (PARTITION BY bucket, target_year, target_month ORDER BY file_name, doc_id) AS INTEGER) AS place FROM bucketed"))
def month_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.month_items(routes(spark, sf_dir))


@register("workflow_counters", duck_routes(f"SELECT count(*) FILTER (WHERE document_code <> 'UNKNOWN') AS grouped, count(*) FILTER (WHERE NOT ({DATED}) OR confidence < 0.7) AS needs_review, count(DISTINCT CASE WHEN {DATED} THEN target_year * 100 + target_month END) AS months_ready, greatest(count(*), (SELECT CAST(sum(1 + o_orderkey % 3) AS BIGINT) FROM orders)) AS received FROM routes"))
def workflow_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploaded = table(spark, sf_dir, "uploads").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first()["n"]
    return reports.workflow_counters(routes(spark, sf_dir), uploaded)


@register("month_detection", duck_routes(f"SELECT bucket, count(DISTINCT CASE WHEN {DATED} THEN target_year * 100 + target_month END) AS periods, count(*) FILTER (WHERE NOT ({DATED})) AS without_period FROM bucketed GROUP BY 1"))
def month_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.month_detection(routes(spark, sf_dir))


@register("outlier_share", duck_routes("SELECT stage, count(*) AS items, count(*) FILTER (WHERE bucket = 'OUTLIERS') AS outliers FROM bucketed GROUP BY 1"))
def outlier_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outlier_share(routes(spark, sf_dir))


@register("folder_sums", with_inputs("SELECT workspace_key, CAST(sum(document_count) AS BIGINT) AS documents, CAST(sum(review_count) AS BIGINT) AS review, count(*) FILTER (WHERE document_count = 0) AS empty FROM folder_status GROUP BY 1", "folder_status"))
def folder_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.folder_sums(table(spark, sf_dir, "folder_status"))


@register("next_in_queue", with_inputs("SELECT workspace_key, folder_number, seq, lead(seq) OVER (PARTITION BY workspace_key, folder_number ORDER BY seq) AS next_seq FROM approved_documents", "approved_documents"))
def next_in_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.next_of_same_code(table(spark, sf_dir, "approved_documents"))


@register("scan_report", with_inputs("WITH g AS (SELECT CAST(n AS INTEGER) AS group_no FROM range(1, 17) r(n)), f AS (SELECT group_no, count(*) AS n, count(DISTINCT file_name) AS names FROM snapshot_files GROUP BY 1) SELECT group_no, coalesce(n, 0) AS files, coalesce(names, 0) AS names, n IS NULL AS missing, CASE WHEN n IS NULL THEN printf('Group %02d: no files found', group_no) END AS message FROM g LEFT JOIN f USING (group_no)", "snapshot_files"))
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_report(table(spark, sf_dir, "snapshot_files"), spark.range(1, 17).select(F.col("id").cast("int").alias("group_no")))


@register(
    "decide_reviews",
    with_inputs(
        """WITH moves AS (SELECT *, approved AND from_folder <> to_folder AS moved FROM decisions), o AS (SELECT workspace_key, from_folder AS folder_number, count(*) AS gone FROM moves WHERE moved GROUP BY 1, 2),
    i AS (SELECT workspace_key, CASE WHEN approved THEN to_folder ELSE from_folder END AS folder_number, count(*) FILTER (WHERE moved) AS come, arg_max(approved, seq) AS yes FROM moves GROUP BY 1, 2),
    j AS (SELECT workspace_key, folder_number, coalesce(review_count, 0) AS r, coalesce(gone, 0) AS gone, greatest(0, coalesce(document_count, 0) - coalesce(gone, 0)) + coalesce(come, 0) AS document_count, yes FROM folder_status FULL JOIN o USING (workspace_key, folder_number) FULL JOIN i USING (workspace_key, folder_number))
    SELECT workspace_key, folder_number, document_count, CASE WHEN yes IS NOT NULL THEN 0 ELSE greatest(0, r - gone) END AS review_count, CAST(CASE WHEN yes THEN greatest(1, document_count) ELSE 0 END AS BIGINT) AS approved_count, CASE WHEN yes THEN 'approved' WHEN NOT yes THEN 'passed' WHEN document_count = 0 THEN 'missing' ELSE 'unchanged' END AS status FROM j""",
        "folder_status",
        "decisions",
    ),
)
def decide_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decide(table(spark, sf_dir, "folder_status"), table(spark, sf_dir, "decisions"))


@register("newly_approved", with_inputs("WITH l AS (SELECT workspace_key, source_hash, arg_max(to_folder, seq) AS folder_number FROM decisions WHERE approved GROUP BY 1, 2) SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM approved_documents a WHERE a.priority = 1 AND a.workspace_key = l.workspace_key AND a.source_hash = l.source_hash)", "decisions", "approved_documents"))
def newly_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.newly_approved(table(spark, sf_dir, "approved_documents").where("priority = 1"), table(spark, sf_dir, "decisions"))


@register("review_inbox", with_inputs("SELECT workspace_key, count(*) AS reviews, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'approved') AS approved FROM reviews GROUP BY 1", "reviews"))
def review_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.review_inbox(table(spark, sf_dir, "reviews"))


@register("pending_reviews", with_inputs("WITH n AS (SELECT workspace_key, count(*) AS reviews, count(*) FILTER (WHERE status = 'approved') AS approved FROM reviews GROUP BY 1) SELECT workspace_key, seq, CAST(row_number() OVER (PARTITION BY workspace_key ORDER BY seq) AS INTEGER) AS place, reviews, approved FROM reviews JOIN n USING (workspace_key) WHERE status = 'pending'", "reviews"))
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.pending_reviews(table(spark, sf_dir, "reviews"))


@register("confirm_items", with_inputs("WITH n AS (SELECT workspace_key, folder_number, count(*) AS items FROM approved_documents WHERE priority < 3 GROUP BY 1, 2) SELECT workspace_key, folder_number, greatest(coalesce(document_count, 0), coalesce(items, 0)) AS document_count FROM folder_status FULL JOIN n USING (workspace_key, folder_number)", "folder_status", "approved_documents"))
def confirm_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.confirm_items(table(spark, sf_dir, "folder_status"), table(spark, sf_dir, "approved_documents").where("priority < 3"))


@register(
    "final_plan",
    with_inputs(
        "WITH b AS (SELECT workspace_key, CAST(sum(page_count) AS BIGINT) AS base FROM approved_documents WHERE folder_number BETWEEN 2 AND 13 GROUP BY 1), p AS (SELECT workspace_key, seq, page_count, coalesce(base, 0) AS base FROM approved_documents LEFT JOIN b USING (workspace_key) WHERE folder_number = 1) SELECT workspace_key, seq, 1 AS part, CAST(1 AS BIGINT) AS first_page, page_count AS last_page FROM p WHERE page_count >= 1 UNION ALL SELECT workspace_key, seq, 2, page_count + 1, page_count + base FROM p WHERE base >= 1",
        "approved_documents",
    ),
)
def final_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "approved_documents")
    return decisions.final_plan(docs.where("folder_number = 1").select("workspace_key", "seq", "page_count"), state.assembly_plan(docs))


@register("remove_files", with_inputs("WITH h AS (SELECT DISTINCT workspace_key, source_hash, 1 AS gone FROM approved_documents WHERE priority = 3 AND page_count = 1), l AS (SELECT workspace_key, folder_number, count(*) FILTER (WHERE gone IS NULL) AS document_count, count(gone) AS removed FROM approved_documents LEFT JOIN h USING (workspace_key, source_hash) GROUP BY 1, 2) SELECT *, CASE WHEN document_count > 0 THEN 'approved' ELSE 'missing' END AS status FROM l WHERE removed > 0", "approved_documents"))
def remove_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "approved_documents")
    return decisions.remove_files(docs, docs.where("priority = 3 AND page_count = 1"))


@register("uploads_after_approval", with_inputs("SELECT status, count(*) AS uploads FROM (SELECT CASE WHEN status = 'submitted' AND files = 3 THEN 'approved' ELSE status END AS status FROM uploads) GROUP BY 1", "uploads"))
def uploads_after_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = table(spark, sf_dir, "uploads")
    return decisions.set_upload_status(up, up.where("status = 'submitted' AND files = 3"), "approved").groupBy("status").agg(F.count("*").alias("uploads"))


@register(
    "exclusive_phrases",
    TOKENS_SQL + """, h AS (SELECT reference_id, token, count(DISTINCT section) = 1 AS own FROM e GROUP BY 1, 2),
    m AS (SELECT reference_id, section, seq, token, own, lead(token) OVER w AS t1, lead(own) OVER w AS o1, lead(token, 2) OVER w AS t2, lead(own, 2) OVER w AS o2 FROM e JOIN h USING (reference_id, token) WINDOW w AS (PARTITION BY reference_id, section ORDER BY seq)),
    p AS (SELECT reference_id, section, seq * 2 AS place, concat(token, ' ', t1) AS phrase FROM m WHERE t1 IS NOT NULL AND (own OR o1) UNION ALL SELECT reference_id, section, seq * 2 + 1, concat(token, ' ', t1, ' ', t2) FROM m WHERE t2 IS NOT NULL AND (own OR o1 OR o2)),
    c AS (SELECT reference_id, section, phrase, count(*) AS hits, min(place) AS first FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY reference_id, section ORDER BY hits DESC, first) AS rank FROM c)
    SELECT reference_id, section, CAST(rank AS INTEGER) AS rank, phrase, hits FROM r WHERE rank <= 10""",
)
def exclusive_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.exclusive_phrases(tokens(spark, sf_dir))


@register(
    "negative_terms",
    TOKENS_SQL + """, tf AS (SELECT reference_id, section, token, count(*) AS tf, min(seq) AS first FROM e GROUP BY 1, 2, 3), k AS (SELECT DISTINCT section FROM tf), c AS (SELECT section, section + p AS competitor, p AS place FROM k, range(1, 3) r(p)),
    o AS (SELECT reference_id, c.section AS section, token, min(place * 1000000000 + first) AS first FROM tf JOIN c ON tf.section = c.competitor WHERE tf >= 2 AND length(token) > 3 GROUP BY 1, 2, 3),
    f AS (SELECT * FROM o WHERE EXISTS (SELECT 1 FROM tf t WHERE t.reference_id = o.reference_id AND t.section = o.section) AND NOT EXISTS (SELECT 1 FROM tf t WHERE t.reference_id = o.reference_id AND t.section = o.section AND t.token = o.token)),
    r AS (SELECT *, row_number() OVER (PARTITION BY reference_id, section ORDER BY first, token) AS rank FROM f) SELECT reference_id, section, CAST(rank AS INTEGER) AS rank, token FROM r WHERE rank <= 12""",
)
def negative_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(spark, sf_dir)
    every = words.select("section").distinct()
    competitors = every.select("section", F.posexplode(F.array(F.col("section") + 1, F.col("section") + 2)).alias("place", "competitor"))
    return learn.negative_terms(words, competitors)


@register(
    "period_vote",
    with_inputs(
        """WITH s AS (SELECT section, count(format) / CAST(count(*) AS DOUBLE) AS rate FROM signals GROUP BY 1), f AS (SELECT section, format, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, min(seq)) AS nth FROM signals WHERE format IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT section, coalesce(position, 'body') AS position, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, min(seq)) AS nth FROM signals WHERE format IS NOT NULL GROUP BY 1, 2)
    SELECT section, format, position, round(rate, 6) AS detection_rate FROM s JOIN f USING (section) JOIN p USING (section) WHERE rate >= 0.5 AND f.nth = 1 AND p.nth = 1""",
        "signals",
    ),
)
def period_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.period_vote(table(spark, sf_dir, "signals"))


@register("rule_context", with_inputs("SELECT company_id, seq, CAST(age AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seq DESC) AS age FROM uploads) WHERE age <= 25", "uploads"))
def rule_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.rule_context(table(spark, sf_dir, "uploads")).select("company_id", "seq", "age")


NUMBER = "coalesce(CASE folder_code " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in FOLDER_OF.items()) + " END, 99)"


@register("compliance_order", with_inputs(f"SELECT batch_id, seq, page_count, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY {NUMBER}, employee_code NULLS LAST, seq, page_count) AS INTEGER) AS place FROM batch_documents", "batch_documents"))
def compliance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compliance_order(table(spark, sf_dir, "batch_documents"))


@register(
    "roster_check",
    with_inputs(
        "WITH a AS (SELECT DISTINCT batch_id, employee_code, 1 AS listed FROM batch_documents WHERE folder_code <> 'RV' AND employee_code IS NOT NULL), b AS (SELECT DISTINCT batch_id, employee_code, 1 AS paid FROM batch_documents WHERE folder_code = 'RV' AND employee_code IS NOT NULL) SELECT batch_id, employee_code, CASE WHEN paid IS NULL THEN 'missing_payslip_for_roster_employee' ELSE 'unexpected_payslip_employee' END AS issue FROM a FULL JOIN b USING (batch_id, employee_code) WHERE paid IS NULL OR listed IS NULL",
        "batch_documents",
    ),
)
def roster_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "batch_documents")
    return quality.roster_check(docs.where("folder_code <> 'RV'"), docs.where("folder_code = 'RV'"))


@register(
    "mature_companies",
    with_inputs(
        "WITH m AS (SELECT company_id, year * 100 + month AS period, count(*) FILTER (WHERE status <> 'archived') AS approved, count(*) AS reviewed FROM uploads GROUP BY 1, 2), t AS (SELECT company_id, period, CAST(sum(approved) OVER w AS BIGINT) AS approved, CAST(sum(reviewed) OVER w AS BIGINT) AS reviewed FROM m WINDOW w AS (PARTITION BY company_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT *, approved >= 100 AND approved >= CAST(0.95 AS DOUBLE) * reviewed AS mature FROM t",
        "uploads",
    ),
)
def mature_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "uploads").groupBy("company_id", (F.col("year") * 100 + F.col("month")).alias("period")).agg(F.count_if(F.col("status") != "archived").alias("approved"), F.count("*").alias("reviewed"))
    return quality.mature_companies(months)
