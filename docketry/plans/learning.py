"""Queries over pages and what is learnt from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import normal_route
from docketry.operators import learn, learned, segment
from docketry.operators.joins import held
from docketry.operators.dims import BANK_PAGE, CONTINUATION, FOLDER_OF, FOLDERS, LEARNING_STOP, PAGE_NUMBER_MARKER, PAGE_PATTERNS, PAGE_TERMS, SAMPLE_STOP
from docketry.plans import checking
from docketry.plans.checking import normal_period
from docketry.plans.inputs import table, with_inputs
from docketry.plans.registry import register


def _texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _duck_score(number: int, code: str, label: str) -> str:
    """A struct of the folder's number, code and hits: [weight, label] of everything it shows on a page `t`."""
    hits = [f"CASE WHEN regexp_matches(t, '{PAGE_NUMBER_MARKER.replace('{0}', str(number))}') THEN {{w: 0.6, l: 'folder {number:02d}'}} END", f"CASE WHEN regexp_matches(t, '\\b{code.lower()}\\b') THEN {{w: 0.45, l: '{code}'}} END"]
    for term in (f"'{code.lower()}'", normal_period(f"'{label}'"), *(f"'{x}'" for x in PAGE_TERMS[code])):
        hits.append(f"CASE WHEN length({term}) > 2 AND contains(t, {term}) THEN {{w: CASE WHEN contains({term}, ' ') THEN 0.35 ELSE 0.16 END, l: {term}}} END")
    hits += [f"CASE WHEN regexp_matches(t, '{p}') THEN {{w: {w}, l: '{name}'}} END" for p, w, name in PAGE_PATTERNS[code]]
    return f"{{number: {number}, code: '{code}', hits: list_filter([{', '.join(hits)}], lambda h: h IS NOT NULL)}}"


PAGES_SQL = f"""WITH kept AS (SELECT reference_id, page, text, {normal_period('text')} AS t FROM page_texts WHERE page <= 120 AND trim(coalesce(text, '')) <> ''),
  shown AS (SELECT reference_id, page, unnest([{', '.join(_duck_score(*f) for f in FOLDERS if f[0] > 1)}], max_depth := 2) FROM kept),
  sums AS (SELECT reference_id, page, number, code, coalesce(list_sum(list_transform(hits, lambda h: CAST(h.w AS DOUBLE))), 0) AS score, list_transform(hits, lambda h: h.l) AS labels FROM shown),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference_id, page ORDER BY round(score, 9) DESC, number) AS nth FROM sums) WHERE nth = 1),
  scored AS (SELECT k.reference_id, k.page, k.text, round(score, 6) AS score, CASE WHEN score >= 0.42 THEN code END AS strong_code, CASE WHEN score >= 0.42 THEN labels END AS labels, regexp_matches(t, '{BANK_PAGE}') AS bank, regexp_matches(t, '{CONTINUATION}') AS continuation FROM kept k JOIN best b ON k.reference_id = b.reference_id AND k.page = b.page)"""
NUMBER = "CASE {} " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in FOLDER_OF.items()) + " END"
# the sequential rule, page by page, as a fold over a reference's pages
LABELLED_SQL = PAGES_SQL + f""", folded AS (SELECT reference_id, list_reduce(list_prepend({{page: CAST(0 AS BIGINT), strong: NULL, labels: CAST([] AS VARCHAR[]), bank: false, cont: false, text: '', code: CAST(NULL AS VARCHAR), out: CAST([] AS STRUCT(page BIGINT, label VARCHAR, labels VARCHAR[], text VARCHAR)[])}},
    list({{page: page, strong: strong_code, labels: labels, bank: bank, cont: continuation, text: text, code: CAST(NULL AS VARCHAR), out: CAST([] AS STRUCT(page BIGINT, label VARCHAR, labels VARCHAR[], text VARCHAR)[])}} ORDER BY page)), lambda a, p:
    CASE WHEN p.strong IS NOT NULL THEN {{page: p.page, strong: p.strong, labels: p.labels, bank: p.bank, cont: p.cont, text: p.text, code: p.strong, out: list_append(a.out, {{page: p.page, label: p.strong, labels: p.labels, text: p.text}})}}
    WHEN p.bank AND {NUMBER.format('a.code')} >= 9 THEN {{page: p.page, strong: p.strong, labels: ['bank statement after tax/IRS section', 'sequence/order inference'], bank: p.bank, cont: p.cont, text: p.text, code: 'EBI', out: list_append(a.out, {{page: p.page, label: 'EBI', labels: ['bank statement after tax/IRS section', 'sequence/order inference'], text: p.text}})}}
    WHEN p.cont AND a.code IN ('LC', 'EBV', 'EBSA', 'SSD', 'EBI') THEN {{page: p.page, strong: p.strong, labels: a.labels, bank: p.bank, cont: p.cont, text: p.text, code: a.code, out: list_append(a.out, {{page: p.page, label: a.code, labels: list_append(a.labels, 'continuation page'), text: p.text}})}}
    ELSE a END).out AS pages FROM scored GROUP BY 1),
  labelled AS (SELECT reference_id, unnest(pages, max_depth := 2) FROM folded)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.scored_pages(table(spark, sf_dir, "page_texts"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.label_pages(scored(spark, sf_dir))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.section_profiles(labelled(spark, sf_dir))


@register("page_scores", with_inputs(PAGES_SQL + " SELECT reference_id, page, strong_code, score, array_to_string(list_sort(list_distinct(labels)), '|') AS labels, bank, continuation FROM scored", "page_texts"))
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("reference_id", "page", "strong_code", "score", F.array_join(F.array_sort("matched"), "|").alias("labels"), "bank", "continuation")


@register("pages_by_rule", with_inputs(LABELLED_SQL + " SELECT reference_id, page, label FROM labelled", "page_texts"))
def pages_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("reference_id", "page", "label")


DATED = segment.DATE_ON_PAGE
PROFILE_SQL = LABELLED_SQL + f""", lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS ls FROM labelled),
  placed AS (SELECT *, CASE WHEN len(list_filter(ls[1:greatest(1, CAST(floor(len(ls) * 0.2) AS INT))], lambda l: regexp_matches(l, '{DATED}'))) > 0 THEN 'header' WHEN len(list_filter(ls[CAST(floor(len(ls) * 0.8) AS INT) + 1:], lambda l: regexp_matches(l, '{DATED}'))) > 0 THEN 'footer' WHEN len(list_filter(ls, lambda l: regexp_matches(l, '{DATED}'))) > 0 THEN 'body' END AS position FROM lines),
  profiles AS (SELECT reference_id, label, count(*) AS page_count, min(page) AS first_page, first(position ORDER BY page) FILTER (WHERE position IS NOT NULL) AS date_position, trim((' ' || string_agg(text, ' ' ORDER BY page))[1:12000]) AS raw_text FROM placed GROUP BY 1, 2)"""


@register("section_profiles", with_inputs(PROFILE_SQL + " SELECT reference_id, label, CAST(page_count AS INTEGER) AS page_count, date_position, CAST(row_number() OVER (PARTITION BY reference_id ORDER BY first_page) AS INTEGER) AS section_order, md5(raw_text) AS digest FROM profiles", "page_texts"))
def section_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("reference_id", "label", "page_count", "date_position", "section_order", F.md5("raw_text").alias("digest"))


@register(
    "section_labels",
    with_inputs(
        LABELLED_SQL + """, e AS (SELECT reference_id, label, page, unnest(labels) AS item, generate_subscripts(labels, 1) AS ix FROM labelled), f AS (SELECT reference_id, label, item, min(page * 100 + ix) AS first FROM e GROUP BY 1, 2, 3)
    SELECT reference_id, label, count(*) AS n, string_agg(item, '|' ORDER BY first) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY reference_id, label ORDER BY first) AS nth FROM f) WHERE nth <= 20 GROUP BY 1, 2""",
        "page_texts",
    ),
)
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("reference_id", "label", F.size("header_terms").cast("long").alias("n"), F.array_join("header_terms", "|").alias("terms"))


@register(
    "sample_tokens",
    with_inputs(
        LABELLED_SQL + f""", w AS (SELECT reference_id, label, page, list_filter(string_split({normal_period('text')}, ' '), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$'))[1:160] AS ws FROM labelled), e AS (SELECT reference_id, label, page, unnest(ws) AS token, generate_subscripts(ws, 1) AS ix FROM w),
    c AS (SELECT reference_id, label, token, count(*) AS n, min(page * 1000 + ix) AS first FROM e WHERE NOT list_contains({_texts(SAMPLE_STOP)}, token) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY reference_id, label ORDER BY n DESC, first) AS nth FROM c)
    SELECT reference_id, label, string_agg(token, ' ' ORDER BY nth) AS tokens FROM r WHERE nth <= 35 GROUP BY 1, 2""",
        "page_texts",
    ),
)
def sample_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample_tokens(labelled(spark, sf_dir)).select("reference_id", "label", F.array_join("sample_tokens", " ").alias("tokens"))


@register("text_density", with_inputs("SELECT reference_id, count(*) AS text_pages, round(avg(length(text)), 6) AS mean_length, avg(length(text)) < 80 AS scanned FROM page_texts WHERE page <= 120 AND trim(coalesce(text, '')) <> '' GROUP BY 1", "page_texts"))
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.text_density(table(spark, sf_dir, "page_texts"))


def _duck_format(n: int, name: str, pattern: str) -> str:
    words = f"list_filter(string_split(right(regexp_extract(t, '(?s)^(.*?){pattern}', 1), 40), ' '), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$'))"
    return f"CASE WHEN regexp_matches(t, '{pattern}') THEN {{n: {n}, format: '{name}', anchors: {words}}} END"


FORMATS_SQL = PROFILE_SQL + f", signals AS (SELECT reference_id, label, list_filter([{', '.join(_duck_format(k, *f) for k, f in enumerate(segment.PERIOD_FORMATS))}], lambda x: x IS NOT NULL)[1] AS s FROM (SELECT *, {normal_period('raw_text')} AS t FROM profiles))"


@register("period_formats", with_inputs(FORMATS_SQL + " SELECT reference_id, label, s.format AS format, array_to_string(s.anchors[-3:], ' ') AS anchors FROM signals", "page_texts"))
def period_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).withColumn("s", segment.period_format("raw_text")).select("reference_id", "label", F.col("s.format").alias("format"), F.array_join("s.anchors", " ").alias("anchors"))


STOP = _texts(LEARNING_STOP)
WORDS_SQL = PROFILE_SQL + f""", words AS (SELECT reference_id, label, list_filter(string_split({normal_period('raw_text')}, ' '), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9]{{1,3}}$') AND NOT list_contains({STOP}, x)) AS ws FROM profiles), e AS (SELECT reference_id, label, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS seq FROM words),
  tf AS (SELECT reference_id, label, token, count(*) AS tf, min(seq) AS first FROM e GROUP BY 1, 2, 3), df AS (SELECT reference_id, token, count(*) AS df FROM tf GROUP BY 1, 2), sn AS (SELECT reference_id, count(DISTINCT label) AS n FROM tf GROUP BY 1),
  terms AS (SELECT reference_id, label, token, nth FROM (SELECT tf.*, tf * ln((1.0 + n) / (1.0 + df)) AS score, row_number() OVER (PARTITION BY reference_id, label ORDER BY tf * ln((1.0 + n) / (1.0 + df)) DESC, first) AS nth FROM tf JOIN df USING (reference_id, token) JOIN sn USING (reference_id)) WHERE score > 0 AND nth <= 20),
  runs AS (SELECT reference_id, label, seq * 2 AS place, token || ' ' || lead(token) OVER w AS phrase, [token, lead(token) OVER w] AS parts FROM e WINDOW w AS (PARTITION BY reference_id, label ORDER BY seq) UNION ALL SELECT reference_id, label, seq * 2 + 1, token || ' ' || lead(token) OVER w || ' ' || lead(token, 2) OVER w, [token, lead(token) OVER w, lead(token, 2) OVER w] FROM e WINDOW w AS (PARTITION BY reference_id, label ORDER BY seq)),
  often AS (SELECT reference_id, label, phrase, first(parts) AS parts, count(*) AS n, min(place) AS first FROM runs WHERE phrase IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  phrases AS (SELECT *, row_number() OVER (PARTITION BY reference_id, label ORDER BY n DESC, first) AS nth FROM often o WHERE EXISTS (SELECT 1 FROM df WHERE df.reference_id = o.reference_id AND list_contains(o.parts, df.token) AND df.df = 1))"""


@register(
    "enriched_sections",
    with_inputs(
        WORDS_SQL + """ SELECT p.reference_id, p.label, coalesce((SELECT string_agg(token, ' ' ORDER BY nth) FROM terms t WHERE t.reference_id = p.reference_id AND t.label = p.label), '') AS terms, coalesce((SELECT string_agg(phrase, '|' ORDER BY nth) FROM phrases t WHERE t.reference_id = p.reference_id AND t.label = p.label AND nth <= 10), '') AS phrases FROM profiles p""",
        "page_texts",
    ),
)
def enriched_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.enriched_sections(profiles(spark, sf_dir)).select("reference_id", "label", F.array_join("tfidf_terms", " ").alias("terms"), F.array_join("ngrams", "|").alias("phrases"))


@register(
    "example_quality",
    with_inputs(
        WORDS_SQL + """, q AS (SELECT p.reference_id, (SELECT count(*) FROM terms t WHERE t.reference_id = p.reference_id AND t.label = p.label) AS a, (SELECT count(*) FROM phrases t WHERE t.reference_id = p.reference_id AND t.label = p.label) AS b FROM profiles p)
    SELECT reference_id, round(0.4 * avg(CASE WHEN a >= 5 THEN 1.0 ELSE 0 END) + 0.2 * avg(CASE WHEN b >= 2 THEN 1.0 ELSE 0 END), 6) AS quality FROM q GROUP BY 1""",
        "page_texts",
    ),
)
def example_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.example_quality(learn.enriched_sections(profiles(spark, sf_dir)))


COMPANY = "CAST(reference_id % 20 AS BIGINT)"


def instances(spark: SparkSession, sf_dir: str, enrich: bool = False) -> DataFrame:
    """Sections as examples of twenty companies: plain, or enriched."""
    found, none = profiles(spark, sf_dir), F.array().cast("array<string>")
    if enrich:
        found = learn.enriched_sections(found)
    else:
        signal = segment.period_format("raw_text")
        found = found.withColumn("s", signal).select("*", *[none.alias(c) for c in ("tfidf_terms", "ngrams", "negative_terms", "llm_descriptors")], F.col("s.format").alias("format"), F.coalesce("s.anchors", none).alias("anchors")).drop("s")
    columns = ["label", "header_terms", "tfidf_terms", "ngrams", "llm_descriptors", "negative_terms", "sample_tokens", "date_position", "format", "anchors"]
    return found.select(F.expr(COMPANY).alias("company_id"), F.col("reference_id").alias("seq"), *columns)


@register(
    "learned_prints",
    with_inputs(
        FORMATS_SQL + f""", i AS (SELECT {COMPANY} AS company_id, reference_id, label, s.format AS format, s.anchors[-3:] AS anchors FROM signals), x AS (SELECT company_id, count(DISTINCT reference_id) AS examples FROM i GROUP BY 1), c AS (SELECT company_id, label, count(*) AS n, count(format) AS shown FROM i GROUP BY 1, 2),
    e AS (SELECT {COMPANY} AS company_id, reference_id, label, page, unnest(labels) AS item, generate_subscripts(labels, 1) AS ix FROM labelled), ef AS (SELECT company_id, reference_id, label, item, min(page * 100 + ix) AS first FROM e GROUP BY 1, 2, 3, 4), et AS (SELECT *, row_number() OVER (PARTITION BY reference_id, label ORDER BY first) AS pos FROM ef),
    r AS (SELECT t.company_id, t.label, item, count(*) / CAST(max(n) AS DOUBLE) AS rate, min(reference_id * 1000 + pos) AS first FROM et t JOIN c ON t.company_id = c.company_id AND t.label = c.label WHERE pos <= 20 GROUP BY 1, 2, 3),
    q AS (SELECT *, row_number() OVER (PARTITION BY company_id, label ORDER BY first) AS nth FROM r WHERE rate >= 0.6), o AS (SELECT *, row_number() OVER (PARTITION BY company_id, label ORDER BY first) AS nth FROM r WHERE rate >= 0.2 AND rate < 0.6),
    v AS (SELECT company_id, label, format, row_number() OVER (PARTITION BY company_id, label ORDER BY count(*) DESC, min(reference_id)) AS nth FROM i WHERE format IS NOT NULL GROUP BY 1, 2, 3)
    SELECT c.company_id, c.label, round(n / CAST(examples AS DOUBLE), 6) AS coverage, coalesce((SELECT string_agg(item, '|' ORDER BY nth) FROM q WHERE q.company_id = c.company_id AND q.label = c.label AND nth <= 20), '') AS required, coalesce((SELECT string_agg(item, '|' ORDER BY nth) FROM o WHERE o.company_id = c.company_id AND o.label = c.label AND nth <= 15), '') AS optional,
    CASE WHEN shown / CAST(n AS DOUBLE) >= 0.5 THEN (SELECT format FROM v WHERE v.company_id = c.company_id AND v.label = c.label AND nth = 1) END AS format FROM c JOIN x USING (company_id)""",
        "page_texts",
    ),
)
def learned_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.fingerprints(instances(spark, sf_dir)).select("company_id", "label", "coverage", F.array_join("required_terms", "|").alias("required"), F.array_join("optional_terms", "|").alias("optional"), "format")


@register("trained_companies")
def trained_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both are read a dozen times: their lineage ends here
    rich = held(instances(spark, sf_dir, True).where("company_id % 3 <> 0"))  # the other companies learn from plain sections
    rules = spark.range(20).select(F.col("id").alias("company_id"), F.lit(1).alias("rules_version"))
    return learn.trained_companies(rich, held(instances(spark, sf_dir)), rules).select("company_id", "rules_version", "rounds", "quality", F.size("prints").alias("n"))


CODES = "CASE CAST(conv_id % 13 AS INT) " + " ".join(f"WHEN {n - 1} THEN '{c}'" for n, c, _ in FOLDERS) + " END"


@register(
    "learned_hints",
    with_inputs(
        f"""WITH f AS (SELECT CAST(conv_id % 20 AS BIGINT) AS company_id, conv_id * 100 + turn AS seq, {CODES} AS code, string_split({checking.normal_route('text')}, ' ') AS w FROM conversations), p AS (SELECT *, CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] ELSE w[1] END AS head, list_filter(w[3:14], lambda t: length(t) > 2) AS tokens, row_number() OVER (PARTITION BY company_id ORDER BY seq DESC) AS age FROM f),
    d AS (SELECT doc_id, CAST(doc_id % 20 AS BIGINT) AS company_id, {checking.normal_route("coalesce(file_name, '')")} || ' ' || {checking.normal_route("coalesce(body, '')")} AS t FROM doc_inputs),
    s AS (SELECT doc_id, seq, code, CASE WHEN head <> '' AND contains(t, head) THEN CASE WHEN contains(head, ' ') THEN CAST(0.28 AS DOUBLE) ELSE 0.12 END ELSE 0 END + CASE WHEN len(tokens) > 0 THEN least(CAST(0.55 AS DOUBLE), CAST(len(list_filter(tokens, lambda x: contains(' ' || t || ' ', ' ' || x || ' '))) AS DOUBLE) / len(tokens) * CAST(1.2 AS DOUBLE)) ELSE 0 END AS score FROM d JOIN p ON d.company_id = p.company_id AND age <= 80),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score > 0.92 DESC, CASE WHEN score > 0.92 THEN -seq ELSE -score END, seq) AS nth FROM s)
    SELECT d.doc_id AS doc_id, CASE WHEN score >= 0.3 THEN code END AS learned_code, CASE WHEN score >= 0.3 THEN round(least(0.92, score), 6) END AS learned_score FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND nth = 1""",
        "doc_inputs",
    ),
)
def learned_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.expr(normal_route("text")), " ")
    prints = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).cast("long").alias("company_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.expr(CODES).alias("document_code"), F.array(F.array_join(F.slice(words, 1, 2), " ")).alias("header_terms"), F.slice(words, 3, 12).alias("sample_tokens"))
    docs = learned.normal_texts(table(spark, sf_dir, "doc_inputs").withColumn("company_id", (F.col("doc_id") % 20).cast("long")))
    return learned.section_hint(docs, prints).select("doc_id", "learned_code", F.round("learned_score", 6).alias("learned_score"))


SECTIONS_SQL = PROFILE_SQL + ", places AS (SELECT CAST(reference_id % 20 AS BIGINT) AS company_id, reference_id AS seq, label AS code, row_number() OVER (PARTITION BY reference_id ORDER BY first_page) AS section_order FROM profiles)"


def company_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select(F.expr(COMPANY).alias("company_id"), F.col("reference_id").alias("seq"), F.col("label").alias("code"), "section_order")


@register("folder_sequence", with_inputs(SECTIONS_SQL + " SELECT company_id, string_agg(code, ',' ORDER BY first, code) AS sequence FROM (SELECT company_id, code, min(section_order) AS first FROM places GROUP BY 1, 2) GROUP BY 1", "page_texts"))
def folder_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.folder_sequence(company_sections(spark, sf_dir)).withColumn("sequence", F.array_join("sequence", ","))


@register("section_context", with_inputs(SECTIONS_SQL + " SELECT company_id, seq, code, CAST(age AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seq DESC, section_order DESC, code DESC) AS age FROM places) WHERE age <= 10", "page_texts"))
def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    # fewer than the default of 80, which the given references would not reach
    return learn.section_context(company_sections(spark, sf_dir), 10).select("company_id", "seq", "code", "age")
