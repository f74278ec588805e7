"""Queries over checks that must add up, and groups of like pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import groups, ledgers, quality, state
from docketry.operators.cluster import folders
from docketry.operators.dims import FOLDERS
from docketry.plans.checking import normal_period
from docketry.plans.inputs import table, with_inputs
from docketry.plans.registry import register

# Pages of classified documents: a document's page_count pages are taken in; laws say which are classified, reviewed and exported.
PAGE_LAWS = {"classified": "(document + page) % 11 <> 0", "reviewed": "confidence < 0.7 AND (document + page) % 11 <> 0", "exported": "confidence >= 0.7 AND (document + 3 * page) % 13 <> 0"}
PAGES_SQL = f"""WITH taken AS (SELECT batch_id, seq AS document, confidence, page_count, CAST(unnest(range(1, page_count + 1)) AS BIGINT) AS page FROM (SELECT batch_id, seq, max(confidence) AS confidence, max(page_count) AS page_count FROM batch_documents GROUP BY 1, 2)),
  classified AS (SELECT * FROM taken WHERE {PAGE_LAWS['classified']}), reviewed AS (SELECT * FROM taken WHERE {PAGE_LAWS['reviewed']}),
  exported AS (SELECT batch_id, document, page FROM taken WHERE {PAGE_LAWS['exported']} UNION ALL SELECT batch_id, document, page FROM taken WHERE document % 97 = 0 AND confidence >= 0.7 UNION ALL SELECT batch_id, document, page + 100 FROM taken WHERE document % 89 = 0 AND page = 1),
  doubled AS (SELECT batch_id, document, page, count(*) AS copies FROM exported GROUP BY 1, 2, 3),
  states AS (SELECT coalesce(t.batch_id, x.batch_id) AS batch_id, coalesce(t.document, x.document) AS document, coalesce(t.page, x.page) AS page, coalesce(copies, 0) AS copies,
    CASE WHEN t.page IS NULL THEN 'unexpected' WHEN x.page IS NOT NULL THEN 'exported' WHEN r.page IS NOT NULL THEN 'reviewed' WHEN c.page IS NOT NULL THEN 'classified' ELSE 'lost' END AS state
    FROM taken t FULL JOIN doubled x ON x.batch_id = t.batch_id AND x.document = t.document AND x.page = t.page LEFT JOIN reviewed r ON r.batch_id = t.batch_id AND r.document = t.document AND r.page = t.page LEFT JOIN classified c ON c.batch_id = t.batch_id AND c.document = t.document AND c.page = t.page)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "batch_documents").groupBy("batch_id", F.col("seq").alias("document")).agg(F.max("confidence").alias("confidence"), F.max("page_count").alias("page_count"))
    taken = docs.withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), "page_count")))
    again = taken.where("document % 97 = 0 AND confidence >= 0.7")
    stray = taken.where("document % 89 = 0 AND page = 1").withColumn("page", F.col("page") + 100)
    return ledgers.page_ledger(taken, taken.where(PAGE_LAWS["classified"]), taken.where(PAGE_LAWS["reviewed"]), taken.where(PAGE_LAWS["exported"]).unionByName(again).unionByName(stray))


@register("page_states", with_inputs(PAGES_SQL + " SELECT state, count(*) AS pages, CAST(sum(copies) AS BIGINT) AS exports FROM states GROUP BY 1", "batch_documents"))
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("state").agg(F.count("*").alias("pages"), F.sum("copies").alias("exports"))


@register(
    "page_reconciliation",
    with_inputs(
        PAGES_SQL + """, n AS (SELECT batch_id, count(*) FILTER (WHERE state <> 'unexpected') AS input_pages, count(*) FILTER (WHERE state = 'exported') AS exported_pages, count(*) FILTER (WHERE state = 'reviewed') AS reviewed_pages, count(*) FILTER (WHERE state = 'classified') AS waiting_pages, count(*) FILTER (WHERE state = 'lost') AS lost_pages,
    count(*) FILTER (WHERE state = 'unexpected') AS unexpected_pages, count(*) FILTER (WHERE copies > 1) AS doubled_pages FROM states GROUP BY 1)
    SELECT *, round((exported_pages + reviewed_pages) / CAST(greatest(1, input_pages) AS DOUBLE), 6) AS preserved, (exported_pages + reviewed_pages) / CAST(greatest(1, input_pages) AS DOUBLE) >= 0.95 AS enough, lost_pages + doubled_pages + unexpected_pages + waiting_pages = 0 AS reconciled FROM n""",
        "batch_documents",
    ),
)
def page_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.reconciliation(ledger(spark, sf_dir))


SIGNALS = {
    "continuation": "CASE CAST((conv_id + turn) % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END",
    "company_nif": "CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL ELSE CAST(500000000 + (conv_id + turn) // 4 AS VARCHAR(12)) END",
    "employee_nif": "CASE WHEN turn % 2 = 0 THEN NULL ELSE CAST(200000000 + turn // 3 AS VARCHAR(12)) END",
    "entity": "CASE WHEN turn % 4 = 3 THEN NULL ELSE concat('e', CAST((conv_id * 3 + turn) // 6 AS VARCHAR(12))) END",
    "period": "CASE WHEN turn % 3 = 1 THEN NULL ELSE CAST(202501 + turn // 5 AS INT) END",
    "kind": "CASE CAST((conv_id * 5 + turn // 2) % 4 AS INT) WHEN 0 THEN 'RV' WHEN 1 THEN 'GIR' WHEN 2 THEN 'LC' END",
}
_LAST = "last_value({0} IGNORE NULLS) OVER (PARTITION BY file ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_REASON = "CASE WHEN coalesce({0} <> {1}, false){2} THEN '{3}' END"
REASONS = ", ".join(_REASON.format(k, _LAST.format(k), " AND coalesce(kind = 'RV', false)" if k == "employee_nif" else "", "type" if k == "kind" else k) for k in ("kind", "company_nif", "employee_nif", "entity", "period"))


@register(
    "logical_documents",
    f"""WITH p AS (SELECT conv_id AS file, turn AS page, {', '.join(f'{v} AS {k}' for k, v in SIGNALS.items())} FROM conversations),
    s AS (SELECT *, list_filter([CASE WHEN row_number() OVER (PARTITION BY file ORDER BY page) = 1 THEN 'first_page' END, CASE WHEN NOT coalesce(continuation, true) AND row_number() OVER (PARTITION BY file ORDER BY page) > 1 THEN 'not_continued' END, {REASONS}], lambda x: x IS NOT NULL) AS reasons FROM p),
    d AS (SELECT *, CAST(sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY page) AS BIGINT) AS document FROM s)
    SELECT file, document, min(page) AS first_page, count(*) AS pages, arg_min(kind, page) FILTER (WHERE kind IS NOT NULL) AS kind, array_to_string(arg_min(reasons, page), ',') AS reasons, count(*) FILTER (WHERE coalesce(continuation, false) AND len(list_filter(reasons, lambda x: x <> 'first_page')) > 0) AS conflicts FROM d GROUP BY 1, 2""",
)
def logical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page"), *[F.expr(v.replace("//", "div").replace("VARCHAR(12)", "STRING")).alias(k) for k, v in SIGNALS.items()])
    found = ledgers.logical_documents(said.withColumn("employee_kind", F.col("kind") == "RV"))
    return found.withColumn("reasons", F.array_join("reasons", ","))


EVERY = "(VALUES " + ", ".join(f"({n}, '{c}')" for n, c, _ in FOLDERS) + ") f(number, code)"
EXPECTED = "(workspace_key * 7 + number * 3) % 5 < 3 AND number > 1"
SECTION_ORDER = "(number * 5 + workspace_key) % 13"
STRUCTURE = f"""WITH sections AS (SELECT workspace_key, code, CAST(number AS INTEGER) AS folder_number, row_number() OVER (PARTITION BY workspace_key ORDER BY {SECTION_ORDER}, code) - 1 AS expected_position FROM workspace_rows, {EVERY} WHERE {EXPECTED}),
  states AS (SELECT workspace_key, folder_number, CASE WHEN min(status) = 'approved' AND (workspace_key + folder_number) % 4 <> 0 THEN 'approved' WHEN max(status) = 'review' AND (workspace_key + folder_number) % 3 = 0 THEN 'passed' ELSE 'review' END AS status FROM folder_states GROUP BY 1, 2),
  kept AS (SELECT s.*, code, row_number() OVER (PARTITION BY workspace_key ORDER BY folder_number) - 1 AS actual_position FROM states s JOIN {EVERY} ON number = folder_number WHERE status IN ('approved', 'passed') AND folder_number >= 2),
  checked AS (SELECT s.*, actual_position, actual_position IS NOT NULL AS found, coalesce(actual_position > coalesce((SELECT max(k2.actual_position) FROM sections s2 JOIN kept k2 ON k2.workspace_key = s2.workspace_key AND k2.folder_number = s2.folder_number WHERE s2.workspace_key = s.workspace_key AND s2.expected_position < s.expected_position), -1), false) AS order_match
    FROM sections s LEFT JOIN kept k ON k.workspace_key = s.workspace_key AND k.folder_number = s.folder_number)"""


def structure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = F.broadcast(folders(spark).select("number", "code"))  # 13 rows
    expected = table(spark, sf_dir, "workspace_rows").select("workspace_key").join(every).where(EXPECTED).select("workspace_key", "code", F.col("number").alias("folder_number"), F.expr(SECTION_ORDER).alias("section_order"))
    status = F.expr("CASE WHEN low = 'approved' AND (workspace_key + folder_number) % 4 <> 0 THEN 'approved' WHEN high = 'review' AND (workspace_key + folder_number) % 3 = 0 THEN 'passed' ELSE 'review' END")
    states = table(spark, sf_dir, "folder_states").groupBy("workspace_key", "folder_number").agg(F.min("status").alias("low"), F.max("status").alias("high"))
    return expected, states.withColumn("status", status).join(every.withColumnRenamed("number", "folder_number"), "folder_number").select("workspace_key", "folder_number", "code", "status")


@register("structure_sections", with_inputs(STRUCTURE + " SELECT workspace_key, code, folder_number, CAST(expected_position AS INTEGER) AS expected_position, CAST(actual_position AS INTEGER) AS actual_position, found, order_match FROM checked", "workspace_rows", "folder_states"))
def structure_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.structure_sections(*structure(spark, sf_dir))


@register(
    "structure_summary",
    with_inputs(
        STRUCTURE + """, n AS (SELECT workspace_key, count(*) AS n, count(*) FILTER (WHERE found) AS f, count(*) FILTER (WHERE order_match) AS o, coalesce(string_agg(code, ',' ORDER BY expected_position) FILTER (WHERE NOT found), '') AS missing FROM checked GROUP BY 1),
    x AS (SELECT workspace_key, string_agg(code, ',' ORDER BY folder_number) AS unexpected FROM kept k WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.workspace_key = k.workspace_key AND s.folder_number = k.folder_number) GROUP BY 1),
    r AS (SELECT *, f / CAST(n AS DOUBLE) AS coverage, CASE WHEN f > 0 THEN o / CAST(f AS DOUBLE) ELSE 0 END AS aligned, coalesce(CASE WHEN workspace_key % 5 > 0 THEN (workspace_key % 5) / CAST(5 AS DOUBLE) END, 0) AS quality FROM n)
    SELECT r.workspace_key AS workspace_key, round(coverage, 6) AS coverage, round(aligned, 6) AS order_alignment, round(CAST(0.5 AS DOUBLE) * coverage + CAST(0.3 AS DOUBLE) * aligned + CAST(0.2 AS DOUBLE) * quality, 6) AS confidence, missing, coalesce(unexpected, '') AS unexpected FROM r LEFT JOIN x ON x.workspace_key = r.workspace_key""",
        "workspace_rows",
        "folder_states",
    ),
)
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, states = structure(spark, sf_dir)
    rated = table(spark, sf_dir, "workspace_rows").where("workspace_key % 5 > 0").select("workspace_key", (F.col("workspace_key") % 5 / 5.0).cast("double").alias("quality"))
    found = ledgers.structure_summary(ledgers.structure_sections(expected, states), states, rated)
    return found.withColumns({k: F.array_join(k, ",") for k in ("missing", "unexpected")})


@register(
    "rule_corrections",
    with_inputs(
        """WITH u AS (SELECT seq, route_source || ':' || document_code AS rule, document_code AS code FROM route_rows), c AS (SELECT seq, CASE seq % 3 WHEN 0 THEN 'GIR' WHEN 1 THEN 'LC' ELSE 'PSS' END AS to_code, seq % 1000 = 7 AS high_value FROM route_rows WHERE confidence < 0.2 OR source_hash % 50 = 1),
    b AS (SELECT u.*, to_code, coalesce(high_value, false) AS high_value, coalesce(to_code <> code, false) AS wrong FROM u LEFT JOIN c USING (seq)), a AS (SELECT rule, code, to_code, count(*) AS k, bool_or(high_value) AS marked FROM b WHERE wrong GROUP BY 1, 2, 3)
    SELECT b.rule AS rule, count(*) AS uses, count(*) FILTER (WHERE wrong) AS corrections, round(count(*) FILTER (WHERE wrong) / CAST(count(*) AS DOUBLE), 6) AS rate, count(*) FILTER (WHERE wrong) / CAST(count(*) AS DOUBLE) > CAST(0.1 AS DOUBLE) AS flagged, (SELECT count(*) FROM a WHERE a.rule = b.rule AND (k >= 3 OR marked)) AS proposals FROM b GROUP BY 1""",
        "route_rows",
    ),
)
def rule_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "route_rows")
    uses = rows.select("seq", F.concat("route_source", F.lit(":"), "document_code").alias("rule"), F.col("document_code").alias("code"))
    wrong = rows.where("confidence < 0.2 OR source_hash % 50 = 1").select("seq", F.expr("CASE seq % 3 WHEN 0 THEN 'GIR' WHEN 1 THEN 'LC' ELSE 'PSS' END").alias("to_code"), (F.col("seq") % 1000 == 7).alias("high_value"))
    return ledgers.rule_corrections(uses, wrong)


ALL_CODES = "[" + ", ".join(f"'{c}'" for _, c, _ in FOLDERS) + "]"


@register(
    "evidence_checklist",
    with_inputs(
        f"""WITH h AS (SELECT batch_id, list(DISTINCT folder_code) AS codes FROM batch_documents GROUP BY 1), r AS (SELECT DISTINCT batch_id, employee_code FROM batch_documents WHERE folder_code = 'RV' AND employee_code IS NOT NULL), g AS (SELECT DISTINCT batch_id, employee_code FROM batch_documents WHERE folder_code = 'GIR' AND employee_code IS NOT NULL),
    n AS (SELECT batch_id, count(*) AS k FROM (SELECT * FROM r EXCEPT SELECT * FROM g) GROUP BY 1)
    SELECT h.batch_id AS "group", array_to_string(list_filter({ALL_CODES}, lambda c: NOT list_contains(codes, c)), ',') AS missing, array_to_string(list_filter([CASE WHEN list_contains(codes, 'EBV') AND NOT list_contains(codes, 'TV') THEN 'EBV' END, CASE WHEN list_contains(codes, 'EBSA') AND NOT list_contains(codes, 'TSA') THEN 'EBSA' END, CASE WHEN list_contains(codes, 'PIR') AND NOT list_contains(codes, 'LIR') THEN 'PIR' END], lambda x: x IS NOT NULL), ',') AS without_detail, coalesce(k, 0) AS uncovered_employees FROM h LEFT JOIN n ON n.batch_id = h.batch_id""",
        "batch_documents",
    ),
)
def evidence_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "batch_documents").withColumnRenamed("batch_id", "group")
    found = ledgers.evidence_checklist(docs, docs.where("folder_code = 'RV'"))
    return found.withColumns({k: F.array_join(k, ",") for k in ("missing", "without_detail")})


@register(
    "provider_costs",
    with_inputs(
        """WITH p AS (SELECT provider, price, valid_from, valid_to FROM (VALUES ('first', CAST(0.5 AS DOUBLE), TIMESTAMP '1970-01-01', TIMESTAMP '2024-01-10'), ('first', 0.75, TIMESTAMP '2024-01-10', TIMESTAMP '2999-01-01'), ('second', 2.0, TIMESTAMP '1970-01-01', TIMESTAMP '2999-01-01')) v(provider, price, valid_from, valid_to))
    SELECT provider_id, count(*) AS calls, round(sum((input_tokens + output_tokens) / CAST(1e6 AS DOUBLE) * price), 6) AS cost FROM provider_calls JOIN p ON provider = provider_id AND "timestamp" >= valid_from AND "timestamp" < valid_to GROUP BY 1""",
        "provider_calls",
    ),
)
def provider_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    list_of = "SELECT * FROM VALUES ('first', 0.5D, TIMESTAMP '1970-01-01', TIMESTAMP '2024-01-10'), ('first', 0.75D, TIMESTAMP '2024-01-10', TIMESTAMP '2999-01-01'), ('second', 2.0D, TIMESTAMP '1970-01-01', TIMESTAMP '2999-01-01') AS v(provider, price, valid_from, valid_to)"
    return quality.costs(table(spark, sf_dir, "provider_calls"), spark.sql(list_of))


# Folders that really are missing: of every workspace only some folders have documents.
SPARSE = "(workspace_key + folder_number) % 4 < 2"


@register("missing_folders", with_inputs(f"WITH k AS (SELECT DISTINCT workspace_key FROM approved_documents WHERE {SPARSE}), d AS (SELECT workspace_key, count(DISTINCT folder_number) AS n FROM approved_documents WHERE {SPARSE} AND folder_number BETWEEN 2 AND 13 GROUP BY 1) SELECT workspace_key, 12 - coalesce(n, 0) AS missing, coalesce(n, 0) AS included FROM k LEFT JOIN d USING (workspace_key) WHERE coalesce(n, 0) < 12", "approved_documents"))
def missing_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.missing_folders(table(spark, sf_dir, "approved_documents").where(SPARSE))


# Pages that look alike, by all pairs on the checking engine's side.

@register(
    "like_pages",
    f"""WITH RECURSIVE w AS (SELECT page_id, list_filter(string_split({normal_period("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, ' '), lambda x: x <> '') AS ws FROM pages),
    s AS (SELECT page_id, list_distinct(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS runs FROM w WHERE len(ws) >= 3),
    e AS (SELECT page_id, unnest(runs) AS r FROM s), c AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS n FROM e a JOIN e b ON a.r = b.r AND a.page_id < b.page_id GROUP BY 1, 2),
    p AS (SELECT a, b FROM c JOIN s x ON x.page_id = a JOIN s y ON y.page_id = b WHERE n / CAST(len(x.runs) + len(y.runs) - n AS DOUBLE) >= 0.5), both_ways AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON t.a = r.b),
    roots AS (SELECT a AS doc_id, least(a, min(b)) AS group_id FROM reach GROUP BY 1)
    SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS members FROM roots""",
)
def like_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return groups.alike_groups(pages)
