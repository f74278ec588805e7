"""Queries over document text: periods, the classification cascade, buckets, segmentation, learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.period import period, routing_period
from docketry.functions.text import normal_period, section_tokens
from docketry.operators import classify, cluster, learn, quality, segment
from docketry.operators.dims import FOLDER_OF, FOLDERS, FUNNEL_LAYERS
from docketry.plans import checking
from docketry.plans.inputs import table, with_inputs
from docketry.plans.registry import register

YEAR, MONTH = 2025, 6


def duck_routes(select: str, ignore_period: bool = True) -> str:
    """`select` over `routes` and `bucketed`, as the checking engine makes them."""
    return with_inputs(f"WITH {checking.route_tables(YEAR, MONTH, ignore_period)} {select}", "doc_inputs")


def routes(spark: SparkSession, sf_dir: str, ignore_period: bool = True) -> DataFrame:
    """Routes as clustering a folder makes them, or with `ignore_period=False` as classifying for one month does."""
    return classify.local_route(table(spark, sf_dir, "doc_inputs"), YEAR, MONTH, ignore_period)


PERIOD_TABLES = "WITH n AS (SELECT doc_id, " + checking.normal_period("body") + " AS pt FROM doc_inputs), " + checking.period_tables("n", "doc_id", "pt", "periods")
ROUTING_TABLES = f"WITH n AS (SELECT doc_id, {checking.normal_route('body')} AS st FROM doc_inputs), m AS (SELECT *, {checking.normal_period('st')} AS pt FROM n), {checking.period_tables('m', 'doc_id, st', 'pt', 'p')}, {checking.late_tables('p', 'doc_id', 'st', 'periods')}"


@register("route_documents", duck_routes("SELECT doc_id, document_code, round(confidence, 6) AS confidence, stage, target_year, target_month FROM routes", False))
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(spark, sf_dir, False).select("doc_id", "document_code", F.round("confidence", 6).alias("confidence"), "stage", "target_year", "target_month")


@register("period_by_document", with_inputs(PERIOD_TABLES + " SELECT doc_id, CAST(p1 AS INTEGER) AS period FROM periods", "doc_inputs"))
def period_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_inputs").select("doc_id", period("body").alias("period"))


@register("period_counts", with_inputs(PERIOD_TABLES + " SELECT CAST(p1 AS INTEGER) AS period, count(*) AS n FROM periods GROUP BY 1", "doc_inputs"))
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_by_document(spark, sf_dir).groupBy("period").agg(F.count("*").alias("n"))


@register("routing_periods", with_inputs(ROUTING_TABLES + " SELECT doc_id, CAST(period AS INTEGER) AS period FROM periods", "doc_inputs"))
def routing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_inputs").select("doc_id", routing_period("body").alias("period"))


EVERY = ", ".join(f"({n}, '{c}')" for n, c, _ in FOLDERS) + ", (14, 'OUTLIERS')"


@register("cluster_buckets", duck_routes(f"SELECT CAST(number AS INTEGER) AS number, e.bucket AS bucket, count(b.doc_id) AS items, round(coalesce(avg(confidence), 0), 6) AS average_confidence FROM (VALUES {EVERY}) e(number, bucket) LEFT JOIN bucketed b ON e.bucket = b.bucket GROUP BY 1, 2"))
def cluster_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.buckets(routes(spark, sf_dir))


@register("cluster_periods", duck_routes("SELECT target_year, target_month, count(*) AS items, count(*) FILTER (WHERE bucket <> 'OUTLIERS') AS grouped FROM bucketed WHERE target_year IS NOT NULL AND target_month IS NOT NULL GROUP BY 1, 2"))
def cluster_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.periods(routes(spark, sf_dir))


@register("cluster_totals", duck_routes("SELECT count(*) AS items, count(*) FILTER (WHERE bucket <> 'OUTLIERS') AS grouped, count(*) FILTER (WHERE bucket = 'OUTLIERS') AS outliers FROM bucketed"))
def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.totals(routes(spark, sf_dir))


LAYERS = ", ".join(f"({k}, '{n}')" for k, n in enumerate(FUNNEL_LAYERS))
TRACES = f"""SELECT doc_id, place, l.layer, CASE WHEN place IN (0, 5) THEN 'matched' WHEN place > 5 THEN CASE WHEN bucket = 'OUTLIERS' THEN 'rejected' ELSE 'matched' END
  WHEN l.layer = b.layer THEN 'matched' WHEN place < b.at OR b.at = -1 AND place > 1 THEN 'missed' ELSE 'skipped' END AS status
  FROM (SELECT *, CASE stage WHEN 'hint' THEN 'filename_taxonomy' WHEN 'pattern' THEN 'pdf_text_layout' WHEN 'payslip' THEN 'pdf_text_layout' ELSE 'unmatched' END AS layer, CASE stage WHEN 'hint' THEN 3 WHEN 'pattern' THEN 4 WHEN 'payslip' THEN 4 ELSE -1 END AS at FROM bucketed) b, (VALUES {LAYERS}) l(place, layer)"""


@register("funnel_traces", duck_routes(TRACES))
def funnel_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.funnel_traces(routes(spark, sf_dir))


@register("funnel_summary", duck_routes(f"SELECT place, layer, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'missed') AS missed FROM ({TRACES}) GROUP BY 1, 2"))
def funnel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.funnel(routes(spark, sf_dir))


@register(
    "cluster_evidence",
    duck_routes(
        f"""SELECT doc_id, array_to_string(list_filter(['No learned section fingerprints yet', 'Filename pattern analysis', 'PDF text/layout/metadata signal analysis',
    CASE WHEN target_year <> {YEAR} OR target_month <> {MONTH} THEN 'Period mismatch detected but not blocking global clustering' WHEN target_year IS NOT NULL THEN 'Period detection' END,
    CASE bucket WHEN 'OUTLIERS' THEN 'Outlier gate: low confidence, unknown, or non-target family' WHEN 'RV' THEN 'Accepted into folder 1 payslip cluster for Final Join' ELSE 'Accepted into folder 2-13 cluster' END], lambda x: x IS NOT NULL), '|') AS evidence FROM bucketed"""
    ),
)
def cluster_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.evidence(routes(spark, sf_dir), YEAR, MONTH).select("doc_id", F.array_join("evidence", "|").alias("evidence"))


@register("review_split", duck_routes(f"SELECT document_code, CASE WHEN document_code IN ('RV', 'UNKNOWN') OR confidence < 0.7 OR coalesce(target_year <> {YEAR}, false) OR coalesce(target_month <> {MONTH}, false) THEN 'review' ELSE 'approved' END AS status, count(*) AS items FROM routes GROUP BY 1, 2", False))
def review_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.review_split(routes(spark, sf_dir, False), YEAR, MONTH)


NUMBER_SQL = "CASE {} " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in FOLDER_OF.items()) + " END"
PAGES_SQL = f"""WITH runs AS (SELECT *, count(strong_code) OVER (PARTITION BY reference_id ORDER BY page) AS run FROM reference_pages),
 held AS (SELECT *, first_value(strong_code) OVER (PARTITION BY reference_id, run ORDER BY page) AS code,
   coalesce(max(CASE WHEN strong_code IS NULL AND bank THEN 1 ELSE 0 END) OVER (PARTITION BY reference_id, run ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM runs WHERE run > 0),
 states AS (SELECT *, CASE WHEN {NUMBER_SQL.format('code')} >= 9 AND seen = 1 THEN 'EBI' ELSE code END AS state FROM held),
 labelled AS (SELECT reference_id, page, CASE WHEN strong_code IS NOT NULL THEN strong_code WHEN bank AND {NUMBER_SQL.format('code')} >= 9 THEN 'EBI' WHEN continuation AND state IN ('LC', 'EBV', 'EBSA', 'SSD', 'EBI') THEN state END AS label FROM states)"""


@register("page_labels", with_inputs(PAGES_SQL + " SELECT * FROM labelled WHERE label IS NOT NULL", "reference_pages"))
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.label_pages(table(spark, sf_dir, "reference_pages"))


@register("sections", with_inputs(PAGES_SQL + " SELECT reference_id, label, count(*) AS pages, min(page) AS first_page, CAST(row_number() OVER (PARTITION BY reference_id ORDER BY min(page)) AS INTEGER) AS section_order FROM labelled WHERE label IS NOT NULL GROUP BY 1, 2", "reference_pages"))
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sections(segment.label_pages(table(spark, sf_dir, "reference_pages")))


@register(
    "folder_requirements",
    with_inputs(
        PAGES_SQL + """, s AS (SELECT reference_id, label AS code, count(*) AS pages FROM labelled WHERE label IS NOT NULL GROUP BY 1, 2)
    SELECT code, count(DISTINCT reference_id) AS hits, CASE WHEN count(DISTINCT reference_id) / (SELECT CAST(count(DISTINCT reference_id) AS DOUBLE) FROM s) >= 0.6 THEN 'required' ELSE 'optional' END AS need,
    list_sort(list(pages))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS expected_pages FROM s GROUP BY code""",
        "reference_pages",
    ),
)
def folder_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.sections(segment.label_pages(table(spark, sf_dir, "reference_pages")))
    return learn.folder_requirements(found.select("reference_id", F.col("label").alias("code"), "pages"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("reference_id"), F.col("turn").alias("section"), F.expr(normal_period("text")).alias("t"))
    return pages.select("reference_id", "section", F.posexplode(section_tokens(F.col("t"))).alias("seq", "token"))


TOKENS_SQL = f"""WITH t AS (SELECT conv_id AS reference_id, turn AS section, list_filter(string_split({checking.normal_period('text')}, ' '), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$')) AS ts FROM conversations),
 e AS (SELECT reference_id, section, unnest(ts) AS token, unnest(range(len(ts))) AS seq FROM t)"""


@register(
    "tf_idf_terms",
    TOKENS_SQL + """, tf AS (SELECT reference_id, section, token, count(*) AS tf, min(seq) AS first FROM e GROUP BY 1, 2, 3), df AS (SELECT reference_id, token, count(*) AS df FROM tf GROUP BY 1, 2),
    n AS (SELECT reference_id, count(DISTINCT section) AS sections FROM tf GROUP BY 1), scored AS (SELECT *, tf * ln((1.0 + sections) / (1.0 + df)) AS score FROM tf JOIN df USING (reference_id, token) JOIN n USING (reference_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY reference_id, section ORDER BY score DESC, first) AS rank FROM scored WHERE score > 0)
    SELECT reference_id, section, CAST(rank AS INTEGER) AS rank, token, round(score, 6) AS score FROM ranked WHERE rank <= 20""",
)
def tf_idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.tf_idf(tokens(spark, sf_dir))


@register(
    "term_coverage",
    TOKENS_SQL + """, seen AS (SELECT DISTINCT section, reference_id AS instance, token AS term FROM e), n AS (SELECT section, count(DISTINCT instance) AS instances FROM seen GROUP BY 1),
    c AS (SELECT section, term, count(*) AS hits, count(*) / CAST(max(instances) AS DOUBLE) AS coverage FROM seen JOIN n USING (section) GROUP BY 1, 2)
    SELECT section, term, hits, round(coverage, 6) AS coverage, CASE WHEN coverage >= 0.6 THEN 'required' ELSE 'optional' END AS kind FROM c WHERE coverage >= 0.2""",
)
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.term_coverage(tokens(spark, sf_dir).select("section", F.col("reference_id").alias("instance"), F.col("token").alias("term")))


@register("exact_duplicates", "SELECT sha256(coalesce(text, '')) AS source_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exact_duplicates(table(spark, sf_dir, "documents"))


@register(
    "document_boundaries",
    with_inputs(
        """WITH k AS (SELECT reference_id, page, coalesce(strong_code, 'WEAK') AS kind, continuation FROM reference_pages), b AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY reference_id ORDER BY page) IS NULL OR lag(kind) OVER (PARTITION BY reference_id ORDER BY page) <> kind OR NOT continuation THEN 1 ELSE 0 END AS start FROM k),
    d AS (SELECT *, CAST(sum(start) OVER (PARTITION BY reference_id ORDER BY page) AS BIGINT) AS document FROM b) SELECT reference_id, document, min(page) AS first_page, count(*) AS pages, min(kind) AS kind FROM d GROUP BY 1, 2""",
        "reference_pages",
    ),
)
def document_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "reference_pages").select("reference_id", "page", F.coalesce("strong_code", F.lit("WEAK")).alias("kind"), "continuation")
    return quality.document_boundaries(pages)


@register("label_accuracy", "WITH p AS (SELECT doc_id, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS predicted FROM documents) SELECT quality AS label, count(*) AS labelled, count(*) FILTER (WHERE quality = predicted) AS matched FROM labels JOIN p USING (doc_id) GROUP BY 1")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("predicted"))
    return quality.accuracy(predicted, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
