"""Queries over page layout: lines, profiles, numbering, hierarchy, context of picked spans, and periods read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import HEADER_STOP
from docketry.operators import dates, layout
from docketry.plans.checking import normal_period
from docketry.plans.inputs import table, with_inputs
from docketry.plans.registry import register

WHITE = r"[\t\n\x0B\f\r ]+"


def one_space(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITE}', ' ', 'g'))"


CLEAN = f"clean AS (SELECT * REPLACE ({one_space('text')} AS text) FROM page_items WHERE {one_space('text')} <> '')"
# lines by ranks over items instead of groups: an item opens a line where no item of its bucket stands to its left
LINES = f"""{CLEAN}, bucketed AS (SELECT *, CAST(floor(y / 4 + 0.5) AS BIGINT) AS b FROM clean),
  whole AS (SELECT DISTINCT doc_id, page, b, string_agg(text, ' ') OVER w AS text, min(x) OVER w AS x, avg(y) OVER w AS y, sum(width) OVER w AS width, count(*) OVER w AS items FROM bucketed
    WINDOW w AS (PARTITION BY doc_id, page, b ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  lines AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY b DESC) AS line, text, CAST(floor(x + 0.5) AS BIGINT) AS x, CAST(floor(y + 0.5) AS BIGINT) AS y, CAST(floor(width + 0.5) AS BIGINT) AS width, items FROM whole WHERE length(text) > 1)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_lines(table(spark, sf_dir, "page_items"))


@register("page_lines", with_inputs(f"WITH {LINES} SELECT doc_id, page, CAST(line AS INTEGER) AS line, text, x, y, width, items FROM lines", "page_items"))
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir)


NUMBERED = r"^\s*(?:(\d{1,2})[.)\-_]|\b(\d{1,2})\s+-)\s*(.+)$"
PATTERNS = f"""{LINES}, found AS (SELECT doc_id, page, line, regexp_extract(text, '{NUMBERED}', ['a', 'b', 'label']) AS m FROM lines WHERE regexp_matches(text, '{NUMBERED}')),
  numbers AS (SELECT doc_id, page, line, CAST(CASE WHEN m.a <> '' THEN m.a ELSE m.b END AS INTEGER) AS number, trim(m.label) AS label FROM found),
  kinds AS (SELECT *, CASE WHEN number <= 13 THEN '1-13 candidate' ELSE 'numbered list' END AS kind FROM numbers WHERE number > 0 AND length(label) >= 2),
  latest AS (SELECT k.*, row_number() OVER (PARTITION BY doc_id, page, kind, number ORDER BY line DESC) AS age, min(line) OVER (PARTITION BY doc_id, page, kind) AS place FROM kinds k),
  patterns AS (SELECT doc_id, page, kind, min(number) AS first, max(number) AS last, count(*) AS count, list(label ORDER BY number)[:16] AS labels, min(place) AS place FROM latest WHERE age = 1 GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@register("numbering_patterns", with_inputs(f"WITH {PATTERNS} SELECT doc_id, page, kind, first, last, count, array_to_string(labels, '|') AS labels FROM patterns", "page_items"))
def numbering_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.numbering_patterns(lines(spark, sf_dir)).select("doc_id", "page", "kind", "first", "last", "count", F.array_join("labels", "|").alias("labels"))


BEGINS = r"^\s*\d{1,2}[.)\-_]?\s+"
HINTS = f"""children AS (SELECT a.doc_id, a.page, a.line, a.text AS title, b.text AS child, row_number() OVER (PARTITION BY a.doc_id, a.page, a.line ORDER BY b.line) AS nth FROM lines a JOIN lines b
    ON a.doc_id = b.doc_id AND a.page = b.page AND b.line BETWEEN a.line + 1 AND a.line + 17 AND b.x > a.x + 20 WHERE regexp_matches(b.text, '{BEGINS}') AND NOT regexp_matches(a.text, '{BEGINS}') AND length(a.text) > 3 AND length(a.text) < 90),
  titles AS (SELECT doc_id, page, line, title, count(*) AS child_count, string_agg(child, '|' ORDER BY nth) AS children FROM children WHERE nth <= 14 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
  hints AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS nth FROM titles) WHERE nth <= 8)"""


@register("hierarchy_hints", with_inputs(f"WITH {LINES}, {HINTS} SELECT doc_id, page, CAST(nth AS INTEGER) AS nth, title, CAST(child_count AS INTEGER) AS child_count, children FROM hints", "page_items"))
def hierarchy_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.hierarchy_hints(lines(spark, sf_dir)).withColumn("children", F.array_join("children", "|"))


PROFILES = f"""texts AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY seq) AS t, list(text ORDER BY seq) AS ts FROM clean GROUP BY 1, 2),
  profiles AS (SELECT s.doc_id AS doc_id, s.page AS page, CAST(floor(width + 0.5) AS BIGINT) AS width, CAST(floor(height + 0.5) AS BIGINT) AS height, CASE WHEN abs(width - height) < 20 THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation,
    coalesce(length(t), 0) AS text_length, coalesce(array_to_string(ts[:12], ' ')[:260], '') AS header, coalesce(array_to_string(ts[-12:], ' ')[:260], '') AS footer, t FROM page_sizes s LEFT JOIN texts x ON x.doc_id = s.doc_id AND x.page = s.page WHERE s.page <= 20)"""


@register("page_profiles", with_inputs(f"WITH {CLEAN}, {PROFILES} SELECT doc_id, page, width, height, orientation, text_length, header, footer FROM profiles", "page_items", "page_sizes"))
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_profiles(table(spark, sf_dir, "page_items"), table(spark, sf_dir, "page_sizes"))


@register("profile_lines", with_inputs(f"WITH {LINES} SELECT doc_id, page, count(*) AS kept, md5(string_agg(text || '@' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR), chr(10) ORDER BY line)) AS digest FROM lines WHERE line <= 80 GROUP BY 1, 2", "page_items"))
def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = layout.page_lines_kept(lines(spark, sf_dir))
    one = F.transform("lines", lambda r: F.concat(r["text"], F.lit("@"), r["x"].cast("string"), F.lit(","), r["y"].cast("string")))
    return kept.select("doc_id", "page", F.size("lines").cast("long").alias("kept"), F.md5(F.array_join(one, "\n")).alias("digest"))


@register("document_texts", with_inputs(f"WITH {CLEAN}, {PROFILES} SELECT doc_id, length(left(t, 6000)) AS characters, md5(left(t, 6000)) AS digest FROM (SELECT doc_id, string_agg('[Page ' || CAST(page AS VARCHAR) || '] ' || t, chr(10) ORDER BY page) AS t FROM profiles WHERE t IS NOT NULL GROUP BY 1)", "page_items", "page_sizes"))
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a smaller budget than the default: the given pages would not reach it
    found = layout.document_texts(table(spark, sf_dir, "page_items"), characters=6000)
    return found.select("doc_id", F.length("text").cast("long").alias("characters"), F.md5("text").alias("digest"))


STOP = "[" + ", ".join(f"'{w}'" for w in HEADER_STOP) + "]"
DOCUMENTS = f"""{PATTERNS}, {HINTS}, {PROFILES},
  seen AS (SELECT doc_id, avg(text_length) AS mean_length, arg_min(orientation, page) AS orientation, bool_or(orientation = 'landscape') AS landscape FROM profiles GROUP BY 1),
  pages AS (SELECT doc_id, count(*) AS page_count FROM page_sizes GROUP BY 1),
  lined AS (SELECT DISTINCT doc_id FROM lines WHERE page <= 20 AND line = 5),
  hinted AS (SELECT doc_id, least(12, count(*)) AS n_hints FROM hints WHERE page <= 20 GROUP BY 1),
  patterned AS (SELECT doc_id, count(*) FILTER (WHERE nth <= 12) AS n_patterns, coalesce(bool_or(first = 1 AND last >= 13) FILTER (WHERE nth <= 12), false) AS folders FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, place) AS nth FROM patterns WHERE page <= 20) GROUP BY 1),
  joined AS (SELECT doc_id, {normal_period("string_agg(header || ' ' || footer, ' ' ORDER BY page)")} AS t FROM profiles GROUP BY 1),
  tokens AS (SELECT doc_id, unnest(string_split(t, ' ')) AS token, generate_subscripts(string_split(t, ' '), 1) AS pos FROM joined),
  best AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS nth FROM tokens WHERE length(token) > 2 AND NOT list_contains({STOP}, token) AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY 1, 2),
  topped AS (SELECT doc_id, list(token ORDER BY nth) AS tokens FROM best WHERE nth <= 45 GROUP BY 1),
  facts AS (SELECT p.doc_id AS doc_id, page_count, coalesce(mean_length, 0) AS mean_length, orientation, coalesce(landscape, false) AS landscape, l.doc_id IS NOT NULL AS lined, coalesce(n_hints, 0) AS n_hints, coalesce(n_patterns, 0) AS n_patterns, coalesce(folders, false) AS folders, coalesce(tokens, []) AS tokens, nullif(creator, '') AS creator, nullif(producer, '') AS producer
    FROM pages p LEFT JOIN seen s ON s.doc_id = p.doc_id LEFT JOIN lined l ON l.doc_id = p.doc_id LEFT JOIN hinted h ON h.doc_id = p.doc_id LEFT JOIN patterned r ON r.doc_id = p.doc_id LEFT JOIN topped t ON t.doc_id = p.doc_id LEFT JOIN document_programs g ON g.doc_id = p.doc_id)"""
DOCUMENT_INPUTS = ("page_items", "page_sizes", "document_programs")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.document_profiles(*[table(spark, sf_dir, name) for name in DOCUMENT_INPUTS])


@register("document_profiles", with_inputs(f"WITH {DOCUMENTS} SELECT doc_id, page_count, round(mean_length, 6) AS mean_length, mean_length < 80 AS ocr_recommended, n_hints, n_patterns FROM facts", *DOCUMENT_INPUTS))
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "page_count", F.round("mean_length", 6).alias("mean_length"), "ocr_recommended", F.size("hints").cast("long").alias("n_hints"), F.size("patterns").cast("long").alias("n_patterns"))


@register(
    "layout_tokens",
    with_inputs(
        f"""WITH {DOCUMENTS} SELECT doc_id, array_to_string(list_concat(list_filter(['pages-' || CAST(page_count AS VARCHAR), coalesce('first-' || orientation, 'unknown-orientation'), 'avgtext-' || CAST(CAST(floor(mean_length + 0.5) AS BIGINT) AS VARCHAR), 'creator-' || left({normal_period('creator')}, 36), 'producer-' || left({normal_period('producer')}, 36),
    CASE WHEN folders THEN 'numbered-1-13-structure' END, CASE WHEN n_hints > 0 THEN 'hierarchy-detected' END], lambda x: x IS NOT NULL), tokens), '|') AS tokens FROM facts""",
        *DOCUMENT_INPUTS,
    ),
)
def layout_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join("layout_tokens", "|").alias("tokens"))


@register(
    "layout_diagnostics",
    with_inputs(
        f"""WITH {DOCUMENTS}, said AS (SELECT doc_id, unnest(['PDF creator: ' || creator || '.', 'PDF producer: ' || producer || '.', CASE WHEN mean_length < 80 THEN 'Low/no PDF text layer detected. Local OCR should be used before relying on text similarity.' END, CASE WHEN landscape THEN 'Landscape page detected; often useful for accounting/bank statement grouping.' END,
    CASE WHEN lined THEN 'Coordinate-aware text lines extracted for layout/hierarchy analysis.' END, CASE WHEN folders THEN 'Detected a numbered 1-13 document/folder structure.' END, CASE WHEN n_hints > 0 THEN 'Detected ' || CAST(n_hints AS VARCHAR) || ' hierarchy/list hint(s) from positioned text.' END, CASE WHEN page_count > 20 THEN 'Only first 20 of ' || CAST(page_count AS VARCHAR) || ' pages inspected for fast clustering.' END]) AS message FROM facts)
    SELECT doc_id, message FROM said WHERE message IS NOT NULL""",
        *DOCUMENT_INPUTS,
    ),
)
def layout_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode("diagnostics").alias("message"))


SPANS = f"""{CLEAN}, spans AS (SELECT c.doc_id AS doc_id, c.page AS page, seq, text, x AS "left", c.width AS width, CAST(10 AS DOUBLE) AS height, s.height - y AS baseline FROM clean c JOIN page_sizes s ON s.doc_id = c.doc_id AND s.page = c.page)"""
PICKS = "seq % 29 = 3"
PICK = "doc_id * 100000000 + page * 100000 + seq"


def last_words(text: str, n: int) -> str:
    return f"array_to_string(list_filter(string_split({text}, ' '), lambda w: w <> '')[-{n}:], ' ')"


@register(
    "picked_context",
    with_inputs(
        f"""WITH {SPANS}, near AS (SELECT {PICK.replace('doc_id', 'a.doc_id').replace('page', 'a.page').replace('seq', 'a.seq')} AS pick, b.seq AS seq, b.text AS text, b."left" AS l, b.baseline AS y, abs(a.baseline - b.baseline) < a.height * CAST(0.6 AS DOUBLE) AND b."left" < a."left" AS labels,
      abs(a.baseline - b.baseline) < a.height * CAST(0.75 AS DOUBLE) OR abs(a.baseline - b.baseline) < a.height * CAST(4.6 AS DOUBLE) AND abs(b."left" + b.width / 2 - a."left" - a.width / 2) < 420 AS around FROM spans a JOIN spans b ON b.doc_id = a.doc_id AND b.page = a.page WHERE a.{PICKS})
    SELECT pick, {last_words("coalesce(string_agg(text, ' ' ORDER BY l, seq) FILTER (WHERE labels), '')", 6)} AS label, coalesce(string_agg(text, ' ' ORDER BY y DESC, l, seq) FILTER (WHERE around), '') AS context FROM near GROUP BY 1""",
        "page_items",
        "page_sizes",
    ),
)
def picked_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = layout.spans_of(layout.clean_items(table(spark, sf_dir, "page_items")), table(spark, sf_dir, "page_sizes"))
    return layout.picked_context(spans.where(PICKS).withColumn("pick", F.expr(PICK)), spans)


# A rectangle a little left of and above every 41st span, as wide as two of them; every third lies off the page's items.
SELECTION = 'seq % 41 = 7'
BOX = {"x0": '"left" - 3 + CASE WHEN seq % 3 = 0 THEN 2000 ELSE 0 END', "y0": "baseline - 14", "x1": '"left" + width * 2 + CASE WHEN seq % 3 = 0 THEN 2000 ELSE 0 END', "y1": "baseline + 1"}


@register(
    "selected_context",
    with_inputs(
        f"""WITH {SPANS}, asked AS (SELECT {PICK} AS pick, doc_id, page, {', '.join(f'{v} AS {k}' for k, v in BOX.items())} FROM spans WHERE {SELECTION}),
    on_page AS (SELECT a.*, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, s.* EXCLUDE (doc_id, page), "left" <= x1 AND "left" + width >= x0 AND baseline - height <= y1 AND baseline >= y0 AS touches FROM asked a JOIN spans s ON s.doc_id = a.doc_id AND s.page = a.page),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY pick ORDER BY NOT touches, CASE WHEN touches THEN 0 ELSE round(sqrt(pow("left" + width / 2 - mx, 2) + pow(baseline - height / 2 - my, 2)), 9) END, seq) AS nth, min("left") FILTER (WHERE touches) OVER (PARTITION BY pick) AS lo, max("left" + width) FILTER (WHERE touches) OVER (PARTITION BY pick) AS hi FROM on_page),
    stands AS (SELECT pick, doc_id, page, mx, seq, height, baseline, coalesce(lo, "left") AS lo, coalesce(hi, "left" + width) AS hi FROM firsts WHERE nth = 1),
    near AS (SELECT a.pick, a.seq AS seq, b.seq AS o, text, "left" AS l, b.baseline AS y, abs(a.baseline - b.baseline) < a.height * CAST(0.7 AS DOUBLE) AND "left" + width < lo AS before, abs(a.baseline - b.baseline) < a.height * CAST(0.7 AS DOUBLE) AND "left" > hi AS behind,
      abs(a.baseline - b.baseline) < a.height * CAST(0.9 AS DOUBLE) OR abs(a.baseline - b.baseline) < a.height * CAST(4.8 AS DOUBLE) AND abs("left" + width / 2 - mx) < 520 AS around FROM stands a JOIN spans b ON b.doc_id = a.doc_id AND b.page = a.page),
    told AS (SELECT pick, seq, {last_words("coalesce(string_agg(text, ' ' ORDER BY l, o) FILTER (WHERE before), '')", 10)} AS b4, array_to_string(list_filter(string_split(coalesce(string_agg(text, ' ' ORDER BY l, o) FILTER (WHERE behind), ''), ' '), lambda w: w <> '')[:8], ' ') AS aft, string_agg(text, ' ' ORDER BY y DESC, l, o) FILTER (WHERE around) AS context FROM near GROUP BY 1, 2)
    SELECT pick, seq, array_to_string(list_filter([b4, aft], lambda t: t <> ''), ' | ') AS label, coalesce(context, '') AS context FROM told""",
        "page_items",
        "page_sizes",
    ),
)
def selected_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = layout.spans_of(layout.clean_items(table(spark, sf_dir, "page_items")), table(spark, sf_dir, "page_sizes"))
    box = {k: F.expr(v.replace('"', "`")) for k, v in BOX.items()}
    asked = spans.where(SELECTION).select(F.expr(PICK).alias("pick"), "doc_id", "page", *[c.alias(k) for k, c in box.items()])
    return layout.selected_context(asked, spans)


# Periods read from lines.

MARKS = "doc_id % 3 = 0"
MARK = {"page": "CAST(doc_id % 6 + 1 AS INT)", "x": "CAST(doc_id % 7 AS DOUBLE) / 8", "y": "CAST(doc_id % 5 AS DOUBLE) / 6 + 0.15D"}


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_layouts(lines(spark, sf_dir), table(spark, sf_dir, "page_sizes"))


def mark_tables(where: str) -> str:
    """Common tables after those of lines, that end with `texts`: the texts near each marked document's mark."""
    return f"""asked AS (SELECT DISTINCT doc_id, {', '.join(f"{v.replace('0.15D', 'CAST(0.15 AS DOUBLE)')} AS m{k}" for k, v in MARK.items())} FROM page_sizes WHERE {where}),
  numbered AS (SELECT doc_id, page, width, height, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS nth FROM page_sizes WHERE page <= 20),
  chosen AS (SELECT * FROM (SELECT a.*, n.page, n.width AS w, n.height AS h, row_number() OVER (PARTITION BY a.doc_id ORDER BY n.page = mpage DESC) AS r FROM asked a JOIN numbered n ON n.doc_id = a.doc_id AND (n.page = mpage OR n.nth = mpage)) WHERE r = 1),
  spots AS (SELECT c.doc_id, my, l.line, text, l.x / w AS nx, l.y / h AS ny, sqrt(pow(l.x / w - mx, 2) + pow(l.y / h - my, 2)) AS d FROM chosen c JOIN lines l ON l.doc_id = c.doc_id AND l.page = c.page WHERE line <= 80),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(d, 12), line) AS nth FROM spots), nearest AS (SELECT doc_id, text AS one, ny AS ny1 FROM ranked WHERE nth = 1),
  texts AS (SELECT r.doc_id, string_agg(text, ' ' ORDER BY nx, nth) FILTER (WHERE abs(ny - my) <= CAST(0.065 AS DOUBLE)) AS band, string_agg(text, ' ' ORDER BY -ny, nx, nth) FILTER (WHERE abs(ny - ny1) <= CAST(0.11 AS DOUBLE)) AS around, string_agg(text, ' ' ORDER BY nth) FILTER (WHERE nth <= 5) AS five, any_value(one) AS one FROM ranked r JOIN nearest n ON n.doc_id = r.doc_id GROUP BY 1)"""


@register("mark_texts", with_inputs(f"WITH {LINES}, {mark_tables(MARKS)} SELECT a.doc_id AS doc_id, md5(coalesce(array_to_string(list_filter([band, around, five, one], lambda t: t IS NOT NULL), '|'), '')) AS digest FROM asked a LEFT JOIN texts t ON t.doc_id = a.doc_id", "page_items", "page_sizes"))
def mark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.struct(*[F.expr(v).alias(k) for k, v in MARK.items()])
    marked = layouts(spark, sf_dir).where(MARKS).withColumn("mark", mark)
    return marked.select("doc_id", F.md5(F.array_join(F.expr(dates.mark_texts("mark")), "|")).alias("digest"))
