"""Queries over what operators and companies teach: periods from marks, anchors and zones, date candidates, signals, and hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import file_tokens, normal_route
from docketry.operators import dates, layout, learn, learned
from docketry.operators.cluster import folder_number
from docketry.operators.dates import AGAINST_PERIOD, FOR_PERIOD, MONTH_STARTS
from docketry.operators.dims import GENERIC_TERMS
from docketry.plans import checking
from docketry.plans.checking import normal_period, period_tables
from docketry.plans.inputs import table, with_inputs
from docketry.plans.layout import LINES, MARK, PROFILES, layouts, mark_tables
from docketry.plans.learning import CODES, LABELLED_SQL, NUMBER, labelled, profiles
from docketry.plans.registry import register

# Dates on pages, with their places.

# The checking engine's spelling of the date patterns: word boundaries for what stands beside a date.
DAY_MONTH_YEAR, MONTH_YEAR, YEAR_MONTH = r"\b(\d{1,2})[./\-](\d{1,2})[./\-](20[2-3]\d)\b", r"\b(0?[1-9]|1[0-2])[/\-](20[2-3]\d)\b", r"\b(20[2-3]\d)[/\-](0[1-9]|1[0-2])\b"
NAMED_MONTH = r"(?i)\b(janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)(?:\s+de)?\s+(20[2-3]\d)\b"


def _gaps(k: int, pattern: str) -> str:
    """Matches of one pattern on each page, with what lies before each: kind, nth, phrase, begin."""
    flag, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    flat = bare.replace("(0?", "(?:0?").replace("(20", "(?:20").replace("(0[", "(?:0[").replace("(jan", "(?:jan").replace("(\\d", "(?:\\d")
    found = f"regexp_extract_all(full_text, '{flag}(?s)(.*?)({flat})', "
    return f"SELECT doc_id, page, full_text, {k} AS kind, unnest({found}2)) AS phrase, unnest({found}1)) AS gap, generate_subscripts({found}2), 1) - 1 AS nth FROM whole"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


CANDIDATES_SQL = f"""WITH kept AS (SELECT i.doc_id, i.page, seq, text, x / width AS x, (height - y) / height AS y FROM (SELECT doc_id, page, seq, text, x, y FROM page_items) i JOIN page_sizes s ON s.doc_id = i.doc_id AND s.page = i.page WHERE i.page <= 4 AND trim(text) <> ''),
  placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM kept),
  whole AS (SELECT doc_id, page, string_agg(text || ' ', '' ORDER BY seq) AS full_text FROM kept GROUP BY 1, 2),
  matches AS ({' UNION ALL '.join(_gaps(k, p) for k, p in enumerate((DAY_MONTH_YEAR, MONTH_YEAR, YEAR_MONTH, NAMED_MONTH)))}),
  begun AS (SELECT *, sum(length(gap) + length(phrase)) OVER (PARTITION BY doc_id, page, kind ORDER BY nth) - length(phrase) AS begin FROM matches),
  dated AS (SELECT *, CASE kind WHEN 0 THEN CAST(regexp_extract(phrase, '{DAY_MONTH_YEAR}', 3) AS INTEGER) WHEN 1 THEN CAST(regexp_extract(phrase, '{MONTH_YEAR}', 2) AS INTEGER) WHEN 2 THEN CAST(regexp_extract(phrase, '{YEAR_MONTH}', 1) AS INTEGER) ELSE CAST(regexp_extract(phrase, '{NAMED_MONTH}', 2) AS INTEGER) END AS year,
    CASE kind WHEN 0 THEN CAST(regexp_extract(phrase, '{DAY_MONTH_YEAR}', 2) AS INTEGER) WHEN 1 THEN CAST(regexp_extract(phrase, '{MONTH_YEAR}', 1) AS INTEGER) WHEN 2 THEN CAST(regexp_extract(phrase, '{YEAR_MONTH}', 2) AS INTEGER) ELSE list_position({_list(MONTH_STARTS)}, left(lower(phrase), 3)) END AS month,
    CASE WHEN kind = 0 THEN CAST(regexp_extract(phrase, '{DAY_MONTH_YEAR}', 1) AS INTEGER) BETWEEN 1 AND 31 AND CAST(regexp_extract(phrase, '{DAY_MONTH_YEAR}', 2) AS INTEGER) BETWEEN 1 AND 12 ELSE true END AS valid,
    {normal_period("substring(full_text, CAST(greatest(begin - 120, 0) + 1 AS INTEGER), CAST(least(begin, 120) + length(phrase) + 120 AS INTEGER))")} AS near FROM begun),
  spots AS (SELECT d.*, (SELECT arg_max(p.x, p.start) FROM placed p WHERE p.doc_id = d.doc_id AND p.page = d.page AND p.start <= d.begin) AS x, (SELECT arg_max(p.y, p.start) FROM placed p WHERE p.doc_id = d.doc_id AND p.page = d.page AND p.start <= d.begin) AS y FROM dated d WHERE valid),
  scored AS (SELECT *, round(greatest(0, least(1, CAST(0.5 AS DOUBLE) + CASE WHEN len(list_filter({_list(FOR_PERIOD)}, lambda w: contains(near, w))) > 0 THEN CAST(0.4 AS DOUBLE) ELSE 0 END - CASE WHEN len(list_filter({_list(AGAINST_PERIOD)}, lambda w: contains(near, w))) > 0 THEN CAST(0.35 AS DOUBLE) ELSE 0 END + CASE WHEN y <= 0.20 THEN CAST(0.15 AS DOUBLE) ELSE 0 END - CASE WHEN y >= 0.85 THEN CAST(0.2 AS DOUBLE) ELSE 0 END)), 6) AS score FROM spots),
  best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, year, month ORDER BY score DESC, page, kind, nth) AS k, min(page * 10000000 + kind * 1000000 + nth) OVER (PARTITION BY doc_id, year, month) AS seen FROM scored),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seen) AS rank FROM best WHERE k = 1)
  SELECT doc_id, CAST(rank AS INTEGER) AS rank, year, CAST(month AS INTEGER) AS month, phrase, page, round(x, 6) AS x, round(y, 6) AS y, score FROM ranked WHERE rank <= 4"""


@register("date_candidates", with_inputs(CANDIDATES_SQL, "page_items", "page_sizes"))
def date_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "page_sizes")
    items = table(spark, sf_dir, "page_items").drop("width").join(sizes, ["doc_id", "page"]).select("doc_id", "page", "seq", "text", (F.col("x") / F.col("width")).alias("x"), ((F.col("height") - F.col("y")) / F.col("height")).alias("y"))
    return dates.date_candidates(items).withColumns({k: F.round(k, 6) for k in ("x", "y")})


# Periods that were taught by marks, anchors and zones.

MARKED, DATE_TEXT = "doc_id % 5 = 0", "CASE WHEN doc_id % 3 = 0 THEN '06/2025' END"
ANCHORS = ("Período", "vencimento")
SIGNAL_LAW = f"""CASE CAST(doc_id % 5 AS INT)
  WHEN 0 THEN named_struct('position', CAST(NULL AS STRING), 'anchor_phrases', CAST(array() AS ARRAY<STRING>), 'detection_rate', 0.1D, 'mark', named_struct('page', {MARK['page']}, 'x', {MARK['x']}, 'y', {MARK['y']}, 'date_text', {DATE_TEXT}, 'label', 'Data', 'context_text', CAST(NULL AS STRING)))
  WHEN 1 THEN named_struct('position', CAST(NULL AS STRING), 'anchor_phrases', array('{ANCHORS[0]}', '{ANCHORS[1]}'), 'detection_rate', 0.1D, 'mark', CAST(NULL AS STRUCT<page: INT, x: DOUBLE, y: DOUBLE, date_text: STRING, label: STRING, context_text: STRING>))
  WHEN 2 THEN named_struct('position', 'header', 'anchor_phrases', CAST(array() AS ARRAY<STRING>), 'detection_rate', 0.9D, 'mark', CAST(NULL AS STRUCT<page: INT, x: DOUBLE, y: DOUBLE, date_text: STRING, label: STRING, context_text: STRING>))
  WHEN 3 THEN named_struct('position', 'footer', 'anchor_phrases', CAST(array() AS ARRAY<STRING>), 'detection_rate', 0.6D, 'mark', CAST(NULL AS STRUCT<page: INT, x: DOUBLE, y: DOUBLE, date_text: STRING, label: STRING, context_text: STRING>))
  ELSE named_struct('position', 'body', 'anchor_phrases', CAST(array() AS ARRAY<STRING>), 'detection_rate', 0.1D, 'mark', CAST(NULL AS STRUCT<page: INT, x: DOUBLE, y: DOUBLE, date_text: STRING, label: STRING, context_text: STRING>)) END"""
_AT = "strpos(t, a)"
TAUGHT_SQL = f"""WITH {LINES}, {PROFILES}, {mark_tables(MARKED).replace('texts AS', 'near_texts AS')},
  fulls AS (SELECT doc_id, string_agg('[Page ' || CAST(page AS VARCHAR) || '] ' || t, chr(10) ORDER BY page) AS whole_text FROM profiles WHERE t IS NOT NULL GROUP BY 1),
  firsts AS (SELECT doc_id, header, footer FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM profiles) WHERE r = 1),
  d AS (SELECT doc_id, whole_text, {normal_period('whole_text')} AS t, header, footer FROM fulls JOIN firsts USING (doc_id)),
  anchors AS (SELECT doc_id, t, {normal_period('anchor')} AS a, anchor, nth FROM d, (VALUES ('{ANCHORS[0]}', 1), ('{ANCHORS[1]}', 2)) v(anchor, nth) WHERE doc_id % 5 = 1),
  cut AS (SELECT doc_id, nth, a, t, CASE WHEN {_AT} > 0 THEN {_AT} WHEN length(a) >= 8 THEN strpos(t, left(a, CAST(floor(length(a) * 0.7) AS INTEGER))) ELSE 0 END AS pos FROM anchors),
  tried AS (SELECT doc_id, 1 AS src, 'mark-nearby' AS source, 1 AS nth, {DATE_TEXT} AS text FROM d WHERE {MARKED} UNION ALL SELECT doc_id, 1, 'mark-nearby', 2, 'Data' FROM d WHERE {MARKED}
    UNION ALL SELECT doc_id, 2, 'anchor-window', nth, anchor FROM anchors
    UNION ALL SELECT doc_id, 3, 'mark-nearby', 1, band FROM near_texts UNION ALL SELECT doc_id, 3, 'mark-nearby', 2, around FROM near_texts UNION ALL SELECT doc_id, 3, 'mark-nearby', 3, five FROM near_texts UNION ALL SELECT doc_id, 3, 'mark-nearby', 4, one FROM near_texts
    UNION ALL SELECT doc_id, 4, 'anchor-window', nth, substring(t, CAST(greatest(pos - 160, 1) AS INTEGER), CAST(least(pos - 1, 160) + length(a) + 240 AS INTEGER)) FROM cut WHERE pos > 0
    UNION ALL SELECT doc_id, 5, 'zone', 1, CASE WHEN doc_id % 5 = 2 THEN header ELSE footer END FROM d WHERE doc_id % 5 IN (2, 3) UNION ALL SELECT doc_id, 6, 'document', 1, whole_text FROM d WHERE doc_id % 5 < 4),
  normal AS (SELECT doc_id, src, source, nth, {normal_period('text')} AS t FROM tried WHERE text IS NOT NULL),
  {period_tables('normal', 'doc_id, src, source, nth, t', 't', 'bare', False)}, {period_tables('normal', 'doc_id, src, source, nth, t', 't', 'full_dates')},
  both_kinds AS (SELECT *, 1 AS pass FROM bare WHERE p1 IS NOT NULL UNION ALL SELECT *, 2 FROM full_dates WHERE p1 IS NOT NULL),
  found AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src, pass, nth) AS r FROM both_kinds)"""


def taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, sizes = table(spark, sf_dir, "page_items"), table(spark, sf_dir, "page_sizes")
    first = layout.page_profiles(items, sizes).groupBy("doc_id").agg(F.min_by(F.struct("header", "footer"), "page").alias("z")).select("doc_id", "z.header", "z.footer")
    docs = layout.document_texts(items).withColumnRenamed("text", "full").join(first, "doc_id").join(layouts(spark, sf_dir), "doc_id")
    return dates.learned_period(docs.withColumn("body", F.col("full")).withColumn("signal", F.expr(SIGNAL_LAW)))


@register("taught_periods", with_inputs(TAUGHT_SQL + " SELECT d.doc_id AS doc_id, CAST(p1 AS INTEGER) AS period, source, md5(left(f.t, 180)) AS evidence FROM d LEFT JOIN found f ON f.doc_id = d.doc_id AND r = 1", "page_items", "page_sizes"))
def taught_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taught(spark, sf_dir).select("doc_id", F.col("learned.period").cast("int").alias("period"), F.col("learned.source").alias("source"), F.md5("learned.evidence").alias("evidence"))


ROUTED, ANSWERED, HINTED = "doc_id % 3 = 1", "doc_id % 4 = 2", "doc_id % 7 = 3"


@register(
    "month_decisions",
    with_inputs(
        TAUGHT_SQL + f""", l AS (SELECT d.doc_id AS doc_id, CAST(p1 AS INTEGER) AS l, CASE WHEN {ROUTED.replace('doc_id', 'd.doc_id')} THEN 202401 END AS r, CASE WHEN {ANSWERED.replace('doc_id', 'd.doc_id')} THEN 202402 END AS a, d.doc_id % 6 = 4 AS failed FROM d LEFT JOIN found f ON f.doc_id = d.doc_id AND r = 1),
    m AS (SELECT doc_id, CASE WHEN NOT failed THEN coalesce(l, r, a) END AS again, CASE WHEN failed THEN 'error' WHEN coalesce(l, r) IS NOT NULL THEN 'rules' WHEN a IS NOT NULL THEN 'provider' ELSE 'unknown' END AS source FROM l)
    SELECT doc_id, source, CASE WHEN doc_id % 9 = 0 THEN 202312 WHEN {HINTED} THEN 202403 ELSE again END AS period, CASE WHEN doc_id % 9 = 0 THEN 'operator' WHEN {HINTED} THEN 'folder' WHEN again IS NOT NULL THEN 'rules' ELSE 'unknown' END AS decided_by FROM m""",
        "page_items",
        "page_sizes",
    ),
)
def month_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taught(spark, sf_dir).select("doc_id", F.col("learned.period").cast("int").alias("period"))
    docs = found.select("doc_id", (F.col("doc_id") % 6 == 4).alias("failed"))
    some = lambda where, period: docs.where(where).select("doc_id", F.lit(period).alias("period"))
    again = dates.reclassified_months(docs, found, some(ROUTED, 202401), some(ANSWERED, 202402).withColumn("phrase", F.lit("mes")))
    items = docs.select(F.col("doc_id").alias("source_hash"), "doc_id", F.when(F.col("doc_id") % 9 == 0, "operator").otherwise("rules").alias("route_source"), F.lit(202312).alias("period"), F.when(F.expr(HINTED), "march").otherwise("none").alias("sub_folder"))
    decided = dates.month_priority(items, spark.createDataFrame([("march", 202403)], "sub_folder string, hint int"), again)
    return decided.withColumnRenamed("source_hash", "doc_id").join(again.select("doc_id", "source"), "doc_id").select("doc_id", "source", "period", "decided_by")


# What anchors, zones and marks do to a code's signal.

SIGNALS_SQL = f"""WITH p AS (SELECT source_hash, CASE WHEN source_hash % 4 < 3 THEN ['Mês de', 'ano ' || CAST(source_hash % 9 AS VARCHAR), 'fim'] END AS anchors, CASE WHEN source_hash % 4 < 3 THEN CAST(source_hash % 100 AS DOUBLE) / 100 END AS rate, CASE WHEN source_hash % 5 = 0 THEN 'body' END AS position FROM cache_rows),
  a AS (SELECT *, CASE WHEN source_hash % 3 = 0 THEN list_prepend('ANO 3', list_filter(coalesce(anchors, []), lambda x: lower(x) <> 'ano 3'))[:8] ELSE anchors END AS a1, CASE WHEN source_hash % 3 = 0 THEN round(CASE WHEN rate IS NULL THEN CAST(0.56 AS DOUBLE) ELSE least(CAST(0.95 AS DOUBLE), rate + CAST(0.06 AS DOUBLE)) END, 6) ELSE rate END AS r1 FROM p),
  z AS (SELECT *, CASE WHEN source_hash % 6 = 1 THEN 'header' ELSE position END AS p2, CASE WHEN source_hash % 6 = 1 THEN coalesce(a1, []) ELSE a1 END AS a2, CASE WHEN source_hash % 6 = 1 THEN greatest(coalesce(r1, 0.5), CAST(0.5 AS DOUBLE)) ELSE r1 END AS r2 FROM a),
  m AS (SELECT *, source_hash % 7 = 2 AND source_hash % 11 <> 0 AS hit, ['06/2025', 'Fim'] AS fresh FROM z)
  SELECT source_hash, p2 AS position, array_to_string(CASE WHEN hit THEN list_concat(fresh, list_filter(coalesce(a2, []), lambda x: lower(x) NOT IN ('06/2025', 'fim')))[:8] ELSE a2 END, '|') AS anchors, CASE WHEN hit THEN greatest(coalesce(r2, 0.5), CAST(0.5 AS DOUBLE)) ELSE r2 END AS rate FROM m"""


@register("taught_signals", with_inputs(SIGNALS_SQL, "cache_rows"))
def taught_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cache_rows")
    has = F.col("source_hash") % 4 < 3
    prints = rows.select(F.lit(1).cast("long").alias("company_id"), F.col("source_hash").cast("string").alias("document_code"), F.when(F.col("source_hash") % 5 == 0, "body").alias("position"), F.when(has, F.array(F.lit("Mês de"), F.concat(F.lit("ano "), (F.col("source_hash") % 9).cast("string")), F.lit("fim"))).alias("anchor_phrases"), F.when(has, (F.col("source_hash") % 100).cast("double") / 100).alias("detection_rate"))
    key = lambda where: rows.where(where).select(F.lit(1).cast("long").alias("company_id"), F.col("source_hash").cast("string").alias("document_code"), "source_hash")
    anchored = learn.with_anchor(prints, key("source_hash % 3 = 0").withColumn("phrase", F.lit(" ANO 3 ")).drop("source_hash"))
    zoned = learn.with_zone(anchored, key("source_hash % 6 = 1").withColumn("zone", F.lit("header")).drop("source_hash"))
    marks = key("source_hash % 7 = 2").select("company_id", "document_code", F.lit(1).alias("page"), F.when(F.col("source_hash") % 11 == 0, 1.5).otherwise(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit("06/2025").alias("date_text"), F.lit("Fim").alias("label"), F.lit(" ").alias("context_text"))
    marked = learn.with_mark(zoned, marks)
    return marked.select(F.col("document_code").cast("long").alias("source_hash"), "position", F.array_join("anchor_phrases", "|").alias("anchors"), F.col("detection_rate").alias("rate"))


# Hints from enriched fingerprints and approved examples.

LISTS = {"required_terms": (1, 4), "header_terms": (1, 2), "tfidf_terms": (3, 8), "ngrams": (2, 3), "llm_descriptors": (5, 6), "optional_terms": (7, 12), "negative_terms": (13, 14)}
_GENERIC = "[" + ", ".join(f"'{t}'" for t in GENERIC_TERMS) + "]"


def _weights(name: str, many: float, one: float, useful: bool, most: int) -> str:
    able = f"length(x) > 2 AND NOT list_contains({_GENERIC}, x) AND NOT regexp_matches(x, '^[0-9]+$')" if useful else "x <> ''"
    weight = f"CASE WHEN contains(x, ' ') THEN CAST({many} AS DOUBLE) ELSE CAST({one} AS DOUBLE) END"
    return f"list_transform({name}[:{most}], lambda x: CASE WHEN {able} AND contains(t, x) THEN {weight} ELSE CAST(0 AS DOUBLE) END)"


_SCORES = "list_concat(" * (len(learned.ENRICHED) - 1) + _weights(*[learned.ENRICHED[0][k] for k in (0, 2, 3, 4, 1)]) + "".join(f", {_weights(n, m, o, u, k)})" for n, k, m, o, u in learned.ENRICHED[1:])


@register(
    "enriched_hints",
    with_inputs(
        f"""WITH f AS (SELECT CAST(conv_id % 20 AS BIGINT) AS company_id, conv_id * 100 + turn AS seq, {CODES} AS code, string_split({checking.normal_route('text')}, ' ') AS w FROM conversations), p AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seq DESC) AS age, {', '.join(f"w[{a}:{b}] AS {n}" if n != 'ngrams' else f"[array_to_string(w[{a}:{b}], ' ')] AS {n}" for n, (a, b) in LISTS.items())} FROM f),
    d AS (SELECT doc_id, CAST(doc_id % 20 AS BIGINT) AS company_id, {checking.normal_route("coalesce(file_name, '')")} || ' ' || {checking.normal_route("coalesce(body, '')")} AS t FROM doc_inputs),
    s AS (SELECT doc_id, seq, code, greatest(0, least(CAST(0.98 AS DOUBLE), list_reduce(list_prepend(CAST(0 AS DOUBLE), {_SCORES}), lambda a, b: a + b))) AS score FROM d JOIN p ON d.company_id = p.company_id AND age <= 80),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) AS nth FROM s)
    SELECT d.doc_id AS doc_id, CASE WHEN score >= 0.28 THEN code END AS learned_code, CASE WHEN score >= 0.28 THEN round(score, 6) END AS learned_score FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND nth = 1""",
        "doc_inputs",
    ),
)
def enriched_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.expr(normal_route("text")), " ")
    lists = [(F.array(F.array_join(F.slice(words, a, b - a + 1), " ")) if n == "ngrams" else F.slice(words, a, b - a + 1)).alias(n) for n, (a, b) in LISTS.items()]
    prints = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).cast("long").alias("company_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.expr(CODES).alias("document_code"), *lists)
    docs = learned.normal_texts(table(spark, sf_dir, "doc_inputs").withColumn("company_id", (F.col("doc_id") % 20).cast("long")))
    return learned.enriched_hint(docs, prints).select("doc_id", "learned_code", F.round("learned_score", 6).alias("learned_score"))


@register(
    "example_similarity",
    f"""WITH e AS (SELECT CAST(p_partkey % 20 AS BIGINT) AS company_id, CAST(p_partkey AS BIGINT) AS seq, CASE p_partkey % 3 WHEN 0 THEN 'GIR' WHEN 1 THEN 'LC' ELSE 'EBI' END AS code, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 2)[:8] AS tokens FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seq DESC) AS age FROM e),
    d AS (SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(p_partkey % 20 AS BIGINT) AS company_id, ' ' || {checking.normal_route("p_name || '_' || p_brand")} || ' ' AS t FROM part),
    s AS (SELECT doc_id, code, len(list_filter(tokens, lambda x: contains(t, ' ' || x || ' '))) / CAST(len(tokens) AS DOUBLE) AS share FROM d JOIN k ON k.company_id = d.company_id AND age <= 25 AND len(tokens) > 0)
    SELECT doc_id, code, round(max(share), 6) AS share FROM s GROUP BY 1, 2""",
)
def example_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    company = (F.col("p_partkey") % 20).cast("long").alias("company_id")
    code = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'GIR' WHEN 1 THEN 'LC' ELSE 'EBI' END").alias("document_code")
    examples = part.select(company, F.col("p_partkey").cast("long").alias("seq"), code, file_tokens(F.col("p_name")).alias("filename_tokens"))
    docs = part.select(F.col("p_partkey").cast("long").alias("doc_id"), company, F.concat("p_name", F.lit("_"), "p_brand").alias("file_name"), F.lit("").alias("body"))
    shares = learned.example_shares(learned.normal_texts(docs), examples)
    return shares.select("doc_id", F.explode("example_scores").alias("code", "share")).withColumn("share", F.round("share", 6))


# The learning layers of a reference, with descriptors, and what was learnt per folder.

DESCRIBED = "reference_id % 3 = 0"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles(spark, sf_dir)
    told = found.where(DESCRIBED).select("reference_id", "label", F.array(*[F.concat(F.lit(f"d{k} "), "label") for k in range(8)]).alias("phrases"))
    return learn.enriched_sections(found, told)


@register(
    "learning_layers",
    with_inputs(
        LABELLED_SQL + f""", g AS (SELECT reference_id, count(*) AS pages FROM page_texts GROUP BY 1), s AS (SELECT reference_id, count(DISTINCT label) AS n FROM labelled GROUP BY 1), f AS (SELECT g.reference_id AS reference_id, pages, coalesce(n, 0) AS n, CASE WHEN g.{DESCRIBED} THEN coalesce(n, 0) ELSE 0 END AS told FROM g LEFT JOIN s ON s.reference_id = g.reference_id)
    SELECT reference_id, unnest([{{place: 0, layer: 'input', status: 'done', n: pages}}, {{place: 1, layer: 'structure', status: 'done', n: n}}, {{place: 2, layer: 'ocr', status: 'skipped', n: 0}}, {{place: 3, layer: 'tfidf', status: 'done', n: n}}, {{place: 4, layer: 'llm', status: CASE WHEN told > 0 THEN 'done' ELSE 'skipped' END, n: told}}], max_depth := 2) FROM f""",
        "page_texts",
    ),
)
def learning_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.layer_log(table(spark, sf_dir, "page_texts"), described(spark, sf_dir))


@register(
    "section_descriptors",
    with_inputs(LABELLED_SQL + f""", s AS (SELECT DISTINCT reference_id, label FROM labelled) SELECT reference_id, label, CASE WHEN {DESCRIBED} THEN array_to_string(list_transform(range(6), lambda k: 'd' || CAST(k AS VARCHAR) || ' ' || label), '|') ELSE '' END AS descriptors FROM s""", "page_texts"),
)
def section_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("reference_id", "label", F.array_join("llm_descriptors", "|").alias("descriptors"))


KIND = "CASE WHEN reference_id % 4 = 0 THEN 'final_join' ELSE 'base_join' END"


@register(
    "learning_coverage",
    with_inputs(LABELLED_SQL + f""", s AS (SELECT DISTINCT reference_id, label, {KIND} AS kind, CAST({NUMBER.format('label')} AS INTEGER) AS folder_number FROM labelled) SELECT kind, folder_number, count(*) AS sections, count(*) FILTER (WHERE {DESCRIBED}) AS enriched FROM s GROUP BY 1, 2""", "page_texts"),
)
def learning_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = labelled(spark, sf_dir).select("reference_id", "label").distinct()
    sections = pages.withColumns({"kind": F.expr(KIND), "folder_number": folder_number(F.col("label")).cast("int")})
    return learn.learning_coverage(sections, pages.where(DESCRIBED))
