"""Pages to sections: strong pages carry their folder to the weak pages that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import normal_period, quoted, section_tokens, settled
from docketry.operators.classify import alternatives, double, is_plain, needed_words
from docketry.operators.dims import BANK_AFTER_TAX, BANK_PAGE, CONTINUATION, FOLDER_OF, FOLDERS, PAGE_GOES_ON, PAGE_NUMBER_MARKER, PAGE_PATTERNS, PAGE_SCORE, PAGE_TERMS, SAMPLE_STOP

#: Pages of a reference that are read.
PAGES = 120  # a fixed value
# Codes whose sections run over several pages.
CONTINUED = ("LC", "EBV", "EBSA", "SSD", "EBI")
BANK_FROM = 9  # a fixed value


def label_pages(pages: DataFrame) -> DataFrame:
    """(reference_id, page, strong_code, bank, continuation) with the code each page ends up with.

    A weak bank page after a label of number 9 or more becomes EBI; a weak continuation page keeps
    a label that runs on; other weak pages are dropped. Within the run of a strong page the state
    changes at most once, to EBI, so a running maximum replaces the sequential rule.
    """
    order = Window.partitionBy("reference_id").orderBy("page")
    runs = pages.withColumn("run", F.count("strong_code").over(order)).where("run > 0")
    number = F.element_at(F.create_map(*[F.lit(x) for pair in FOLDER_OF.items() for x in pair]), F.col("code"))
    state = Window.partitionBy("reference_id", "run").orderBy("page")
    held = runs.withColumn("code", F.first("strong_code").over(state)).withColumn("number", number)
    before = F.coalesce(F.max(F.col("strong_code").isNull() & F.col("bank")).over(state.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    held = held.withColumn("state", F.when((F.col("number") >= BANK_FROM) & before, "EBI").otherwise(F.col("code")))
    late = (F.col("state") == "EBI") | (F.col("number") >= BANK_FROM)
    label = F.when(F.col("strong_code").isNotNull(), F.col("strong_code")).when(F.col("bank") & late, "EBI").when(F.col("continuation") & F.col("state").isin(*CONTINUED), F.col("state"))
    labelled = held.withColumn("label", label).where("label IS NOT NULL")
    if "matched" not in pages.columns:
        return labelled.select("reference_id", "page", "label")
    own = F.first("matched").over(state)
    inferred = F.array(*map(F.lit, BANK_AFTER_TAX))
    carried = F.when((F.col("state") == "EBI") & before, inferred).otherwise(own)
    matched = F.when(F.col("strong_code").isNotNull(), F.col("matched")).when(F.col("bank") & late, inferred).otherwise(F.slice(F.array_distinct(F.concat(carried, F.array(F.lit(PAGE_GOES_ON)))), 1, 8))
    return labelled.withColumn("labels", matched).select("reference_id", "page", "label", F.col("labels").alias("matched"), "text")


def page_terms(code: str) -> list[str]:
    """Terms of a folder on a page in normal form, longer than two letters: its code, label and further ones."""
    label = next(name for _, c, name in FOLDERS if c == code)
    return [quoted(code.lower()), normal_period(quoted(label)), *map(quoted, PAGE_TERMS[code])] if len(code) > 2 else [normal_period(quoted(label)), *map(quoted, PAGE_TERMS[code])]


def _shows(t: str, pattern: str) -> str:
    tests = []
    for branch in alternatives(pattern):
        need = [f"contains({t}, {quoted(w)})" for w in needed_words(branch)]
        tests.append(" AND ".join(need if is_plain(branch) else [*need, f"{t} RLIKE {quoted(branch)}"]))
    return "(" + " OR ".join(f"({x})" for x in tests) + ")"


def page_score(code: str) -> str:
    """(code, score, matched) of a folder on a page `t`: number and code markers, terms, weighted patterns."""
    number = FOLDER_OF[code]
    found = [(f"t RLIKE {quoted(PAGE_NUMBER_MARKER.replace('{0}', str(number)))}", PAGE_SCORE["number"], quoted(f"folder {number:02d}")), (f"t RLIKE {quoted(rf'\\b{code.lower()}\\b')}", PAGE_SCORE["code"], quoted(code))]
    hits = [f"CASE WHEN {when} THEN named_struct('weight', {double(w)}, 'label', {label}) END" for when, w, label in found]
    terms = f"transform(filter(array({', '.join(page_terms(code))}), x -> contains(t, x)), x -> named_struct('weight', CASE WHEN contains(x, ' ') THEN {double(PAGE_SCORE['phrase'])} ELSE {double(PAGE_SCORE['term'])} END, 'label', x))"
    late = [f"CASE WHEN {_shows('t', p)} THEN named_struct('weight', {double(w)}, 'label', {quoted(label)}) END" for p, w, label in PAGE_PATTERNS[code]]
    every = f"filter(concat(array({', '.join(hits)}), {terms}, array({', '.join(late)})), h -> h IS NOT NULL)"
    return settled(every, f"named_struct('code', '{code}', 'score', aggregate(hits, 0D, (s, h) -> s + h.weight), 'matched', slice(array_distinct(transform(hits, h -> h.label)), 1, 8))", "hits")


def scored_pages(pages: DataFrame, folder_one: bool = False) -> DataFrame:
    """The first PAGES pages that hold text, with the folder that each shows strongly (null if none), its labels, and whether it goes on or is a bank statement.

    pages: reference_id, page (from 1), text. Ties go to the lower folder number; folder 1 only takes part in final bundles.
    """
    codes = [c for n, c, _ in FOLDERS if folder_one or n > 1]
    kept = pages.where((F.col("page") <= PAGES) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    none = "named_struct('code', CAST(NULL AS STRING), 'score', -1D, 'matched', CAST(array() AS ARRAY<STRING>))"
    best = f"aggregate(array({', '.join(map(page_score, codes))}), {none}, (best, x) -> CASE WHEN x.score > best.score THEN x ELSE best END)"
    facts = f"named_struct('best', {best}, 'bank', t RLIKE {quoted(BANK_PAGE)}, 'continuation', t RLIKE {quoted(CONTINUATION)})"
    seen = kept.withColumn("seen", F.expr(settled(normal_period("text"), facts)))
    strong = F.col("seen.best.score") >= PAGE_SCORE["least"]
    return seen.select("reference_id", "page", F.when(strong, F.col("seen.best.code")).alias("strong_code"), F.when(strong, F.col("seen.best.matched")).alias("matched"), F.round("seen.best.score", 6).alias("score"), F.col("seen.bank").alias("bank"), F.col("seen.continuation").alias("continuation"), "text")


# A date with its month on a page.
DATE_ON_PAGE = r"(?i)\b(20[0-9]{2})\b.*\b(0[1-9]|1[0-2])\b|\b(0[1-9]|1[0-2])\b.*\b(20[0-9]{2})\b|\b(janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\b.*\b(20[0-9]{2})\b"


def date_position(text: str) -> F.Column:
    """P10: whether a date stands in the first fifth of a page's lines, the last fifth, or between; accents stay."""
    dated = lambda lines: f"exists({lines}, l -> l RLIKE {quoted(DATE_ON_PAGE)})"
    head, foot = "slice(lines, 1, CAST(greatest(1, floor(size(lines) * 0.2D)) AS INT))", "slice(lines, CAST(floor(size(lines) * 0.8D) AS INT) + 1, size(lines))"
    return F.expr(settled(f"filter(split({text}, '\n'), l -> trim(l) <> '')", f"CASE WHEN {dated(head)} THEN 'header' WHEN {dated(foot)} THEN 'footer' WHEN {dated('lines')} THEN 'body' END", "lines"))


# How a section writes its period (format and pattern), in order.
PERIOD_FORMATS = (
    ("explicit_label", r"(?:ano\s+mes\s+de\s+referencia|ano\s+mes\s+ref|ano\s+mes|periodo|referencia)\s+20[2-3][0-9]\s+(?:0?[1-9]|1[0-2])"),
    ("named_month", r"(?:janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+20[2-3][0-9]"),
    ("compact_yyyymm", r"\b20[2-3][0-9](?:0[1-9]|1[0-2])\b"),
    ("operation_date", r"(?:data\s+valor|data\s+do\s+movimento|data\s+de\s+movimento|data\s+emissao|data\s+de\s+emissao)"),
)


def period_format(text: str) -> F.Column:
    """(format, anchors) of a raw text: how it writes its period, and up to three words from the 40 characters before."""
    before = lambda p: f"right(regexp_extract(t, {quoted(rf'(?s)^(.*?){p}')}, 1), 40)"
    words = lambda p: f"filter(split({before(p)}, ' '), w -> length(w) > 2 AND NOT w RLIKE '^[0-9]+$')"
    last = lambda p: f"reverse(slice(reverse({words(p)}), 1, 3))"
    cases = " ".join(f"WHEN t RLIKE {quoted(p)} THEN named_struct('format', '{name}', 'anchors', {last(p)})" for name, p in PERIOD_FORMATS)
    return F.expr(settled(normal_period(text), f"CASE {cases} END"))


def sample_tokens(labelled: DataFrame, each: int = 160, top: int = 35) -> DataFrame:
    """reference_id, label, sample_tokens: of each page's first tokens the most frequent of the section, ties first seen."""
    words = labelled.select("reference_id", "label", "page", F.posexplode(F.slice(section_tokens(F.expr(normal_period("text"))), 1, each)).alias("seq", "token"))
    counted = words.groupBy("reference_id", "label", "token").agg(F.count("*").alias("n"), F.min(F.struct("page", "seq")).alias("first")).where(~F.col("token").isin(*SAMPLE_STOP))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("reference_id", "label").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= top)
    return ranked.groupBy("reference_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("sample_tokens"))


def section_profiles(labelled: DataFrame, most: int = 12_000) -> DataFrame:
    """Per section its pages, first 20 labels, first date position, order, sample tokens and first `most` characters.

    labelled: from label_pages over scored pages, so a section has PAGES pages at most.
    """
    page = F.struct("page", "matched", date_position("text").alias("position"), F.substring("text", 1, most).alias("text"))
    rows = labelled.groupBy("reference_id", "label").agg(F.array_sort(F.collect_list(page)).alias("rows"), F.min("page").alias("first_page"))
    order = F.row_number().over(Window.partitionBy("reference_id").orderBy("first_page"))
    text = F.trim(F.substring(F.concat(F.lit(" "), F.array_join(F.transform("rows", lambda r: r["text"]), " ")), 1, most))
    found = rows.select(
        "reference_id", "label", F.size("rows").alias("page_count"), F.slice(F.transform("rows", lambda r: r["page"]), 1, 20).alias("page_numbers"), F.slice(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["matched"]))), 1, 20).alias("header_terms"),
        F.get(F.filter(F.transform("rows", lambda r: r["position"]), lambda p: p.isNotNull()), F.lit(0)).alias("date_position"), order.alias("section_order"), text.alias("raw_text"),
    )
    return found.join(sample_tokens(labelled), ["reference_id", "label"], "left").withColumn("sample_tokens", F.coalesce("sample_tokens", F.array().cast("array<string>")))


def text_density(pages: DataFrame) -> DataFrame:
    """Per reference the pages that hold text and their mean length, and whether it looks scanned."""
    kept = pages.where((F.col("page") <= PAGES) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.groupBy("reference_id").agg(F.count("*").alias("text_pages"), F.round(F.avg(F.length("text")), 6).alias("mean_length")).withColumn("scanned", F.col("mean_length") < 80)


def sections(labelled: DataFrame) -> DataFrame:
    """Pages of each section and the order in which sections first appear."""
    found = labelled.groupBy("reference_id", "label").agg(F.count("*").alias("pages"), F.min("page").alias("first_page"))
    return found.withColumn("section_order", F.row_number().over(Window.partitionBy("reference_id").orderBy("first_page")))
