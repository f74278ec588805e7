"""Periods that were taught: near marks, after anchors, in zones; candidates for them; and who decides a month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.period import first_period
from docketry.functions.text import normal_period, quoted, settled

#: The signal that was learnt for a code.
SIGNAL = "struct<position:string,anchor_phrases:array<string>,detection_rate:double,mark:struct<page:int,x:double,y:double,date_text:string,label:string,context_text:string>>"
#: A document's pages with their lines, in points from the lower left corner.
LAYOUT = "array<struct<page:int,width:double,height:double,lines:array<struct<text:string,x:double,y:double>>>>"


def mark_texts(mark: str = "signal.mark", pages: str = "pages") -> str:
    """P4, as SQL: candidate texts near a mark: its band, the nearest line's surroundings, the five closest lines, the nearest one.

    Lines are compared in shares of the page; a page is found by its number, else by its place. The
    mark's y is measured as the lines' is, from the bottom.
    """
    page = f"coalesce(get(filter({pages}, p -> p.page = {mark}.page), 0), get({pages}, {mark}.page - 1))"
    placed = f"array_sort(transform(q.lines, (l, i) -> named_struct('d', hypot(l.x / q.width - {mark}.x, l.y / q.height - {mark}.y), 'i', i, 'nx', l.x / q.width, 'ny', l.y / q.height, 'text', l.text)))"
    joined = lambda rows, order: f"array_join(transform(array_sort(transform({rows}, l -> named_struct('a', {order[0]}, 'b', {order[1]}, 'd', l.d, 'i', l.i, 'text', l.text))), l -> l.text), ' ')"
    texts = f"""filter(array({joined(f"filter(ls, l -> abs(l.ny - {mark}.y) <= 0.065D)", ("l.nx", "0D"))}, {joined("filter(ls, l -> abs(l.ny - ls[0].ny) <= 0.11D)", ("-l.ny", "l.nx"))}, array_join(transform(slice(ls, 1, 5), l -> l.text), ' '), ls[0].text), t -> t <> '')"""
    able = "q IS NULL OR coalesce(q.width, 0) = 0 OR coalesce(q.height, 0) = 0 OR size(q.lines) = 0"
    return settled(page, f"CASE WHEN {mark} IS NULL OR {able} THEN CAST(array() AS ARRAY<STRING>) ELSE {settled(placed, texts, 'ls')} END", "q")


def _windows(anchors: str, full: str) -> str:
    """Of each anchor found in the text, 160 characters before it to 240 behind; of long ones their first 70 % will do."""
    at = lambda what: f"instr(t, {what})"
    cut = lambda pos: f"substring(t, greatest({pos} - 160, 1), least({pos} - 1, 160) + length(a) + 240)"
    short = "substring(a, 1, CAST(floor(length(a) * 0.7D) AS INT))"
    one = f"CASE WHEN {at('a')} > 0 THEN {cut(at('a'))} WHEN length(a) >= 8 AND {at(short)} > 0 THEN {cut(at(short))} END"
    return settled(normal_period(full), f"filter(transform(filter(transform({anchors}, x -> {normal_period('x')}), a -> a <> ''), a -> {one}), w -> w IS NOT NULL)", "t")


def learned_period(docs: DataFrame) -> DataFrame:
    """Docs with learned: struct of period, source and evidence; null where the code has no usable signal or nothing is found.

    docs: signal (SIGNAL; null if the code has none), pages (LAYOUT), full, header, body, footer (texts).
    The mark's own texts come first, then the anchors themselves, texts near the mark, windows
    around the anchors, the zone, the whole document. A signal is usable with a mark or anchors, or
    if it was found in half of the examples.
    """
    anchors = "coalesce(signal.anchor_phrases, CAST(array() AS ARRAY<STRING>))"
    zone = "CASE signal.position WHEN 'header' THEN header WHEN 'footer' THEN footer ELSE body END"
    tried = [
        ("mark-nearby", "filter(array(signal.mark.date_text, signal.mark.label, signal.mark.context_text), t -> coalesce(trim(t), '') <> '')"),
        ("anchor-window", anchors),
        ("mark-nearby", mark_texts()),
        ("anchor-window", _windows(anchors, "full")),
        ("zone", f"CASE WHEN signal.position IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE array({zone}) END"),
        ("document", "array(full)"),
    ]
    candidates = "array(" + ", ".join(f"named_struct('source', {quoted(s)}, 'texts', {t})" for s, t in tried) + ")"
    usable = f"signal.mark IS NOT NULL OR size({anchors}) > 0 OR signal.detection_rate >= 0.5D"
    found = f"get(filter(transform({candidates}, c -> named_struct('source', c.source, 'f', {first_period('c.texts')})), c -> c.f IS NOT NULL), 0)"
    picked = docs.withColumn("learned", F.expr(f"CASE WHEN {usable} THEN {found} END"))
    return picked.withColumn("learned", F.when(F.col("learned").isNotNull(), F.struct(F.col("learned.f.period").alias("period"), F.col("learned.source").alias("source"), F.col("learned.f.evidence").alias("evidence"))))


def learned_periods(docs: DataFrame, signals: DataFrame, key: list[str]) -> DataFrame:
    """Docs with learned_periods: by code the learnt period, and whether it was found in half of the examples.

    signals: key columns, document_code, signal; a company has 13 codes at most. A code whose signal
    is not usable is not in the map; one whose signal finds nothing is, with a null period.
    """
    spread = docs.join(signals, key, "left").withColumn("usable", F.expr("signal.mark IS NOT NULL OR size(coalesce(signal.anchor_phrases, CAST(array() AS ARRAY<STRING>))) > 0 OR signal.detection_rate >= 0.5D"))
    found = learned_period(spread).where("usable").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("document_code", F.struct(F.col("learned.period").alias("period"), (F.coalesce("signal.detection_rate", F.lit(0.0)) >= 0.5).alias("rated"))))).alias("learned_periods"))
    return docs.join(found, "doc_id", "left")


# Dates with their months in a page's text (pattern, group of the day, of the month, of the year).
DATE_PATTERNS = (
    (r"(?<![0-9A-Za-z_])([0-9]{1,2})[./\-]([0-9]{1,2})[./\-](20[2-3][0-9])(?![0-9A-Za-z_])", 1, 2, 3),
    (r"(?<![0-9A-Za-z_])(0?[1-9]|1[0-2])[/\-](20[2-3][0-9])(?![0-9A-Za-z_])", 0, 1, 2),
    (r"(?<![0-9A-Za-z_])(20[2-3][0-9])[/\-](0[1-9]|1[0-2])(?![0-9A-Za-z_])", 0, 2, 1),
    (r"(?i)(?<![0-9A-Za-z_])(janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)(?:\s+de)?\s+(20[2-3][0-9])(?![0-9A-Za-z_])", 0, 1, 2),
)
# Words beside a date that speak for it as a period, and against it.
FOR_PERIOD = ("periodo", "referencia", "competencia", "mes", "vencimento", "vencimentos", "salario", "subsidio", "ordenado", "remuneracao", "folha", "processamento", "diario de salarios", "diario salarios")
AGAINST_PERIOD = ("pagamento", "emissao", "emitido", "data de", "emitida", "data emissao", "processado em", "gerado", "impresso", "licenca", "versao", "v25", "artsoft")
MONTH_STARTS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def date_candidates(items: DataFrame, top: int = 4, pages: int = 4) -> DataFrame:
    """Per document the `top` best dates with a month on its first pages: doc_id, rank, year, month, phrase, page, x, y, score.

    items: doc_id, page (from 1), seq, text, x, y (shares of the page, y from the top). A page's text
    is its items in order, each followed by a space; a match belongs to the item in which it begins.
    The offsets of matches are the lengths of what lies between them, so none is sought again. Words
    within 120 characters raise or lower a score, and so does a place at the page's top or bottom. Of
    one period the best counts, the first of equals.
    """
    kept = items.where((F.col("page") <= pages) & (F.trim("text") != ""))
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    placed = kept.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = placed.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("start", "text", "x", "y"))).alias("items"))
    whole = whole.withColumn("full", F.concat(F.array_join(F.transform("items", lambda i: i["text"]), " "), F.lit(" ")))
    found = []
    for k, (pattern, day, month, year) in enumerate(DATE_PATTERNS):
        flag, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        flat = bare.replace("(0?", "(?:0?").replace("(20", "(?:20").replace("([0", "(?:[0").replace("(0[", "(?:0[").replace("(jan", "(?:jan")
        gaps, hits = (f"regexp_extract_all(full, {quoted(f'{flag}(?s)(.*?)({flat})')}, {g})" for g in (1, 2))
        part = lambda g, p=pattern: f"regexp_extract(h, {quoted(p)}, {g})"
        number = "CASE " + " ".join(f"WHEN lower({part(month)}) LIKE '{m}%' THEN {n}" for n, m in enumerate(MONTH_STARTS, 1)) + " END" if k == 3 else f"CAST({part(month)} AS INT)"
        valid = f"CAST({part(day)} AS INT) BETWEEN 1 AND 31 AND CAST({part(month)} AS INT) BETWEEN 1 AND 12" if day else "true"
        one = f"named_struct('kind', {k}, 'nth', i, 'phrase', h, 'year', CAST({part(year)} AS INT), 'month', {number}, 'valid', {valid}, 'at', aggregate(slice(gs, 1, i + 1), 0, (s, g) -> s + length(g)) + aggregate(slice(hs, 1, i), 0, (s, g) -> s + length(g)))"
        found.append(settled(gaps, settled(hits, f"transform(hs, (h, i) -> {one})", "hs"), "gs"))
    rows = whole.withColumn("found", F.expr(f"filter(flatten(array({', '.join(found)})), f -> f.valid)")).where("size(found) > 0").select("doc_id", "page", "items", "full", F.inline("found"))
    near = F.expr(settled("trim(substring(full, greatest(at - 120, 0) + 1, least(at, 120) + length(phrase) + 120))", normal_period("c"), "c"))
    item = F.expr("element_at(filter(items, i -> i.start <= at), -1)")
    seen = rows.withColumn("near", near).withColumn("item", item)
    speaks = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("near"), w))
    score = F.lit(0.5) + F.when(speaks(FOR_PERIOD), 0.4).otherwise(0.0) - F.when(speaks(AGAINST_PERIOD), 0.35).otherwise(0.0) + F.when(F.col("item.y") <= 0.20, 0.15).otherwise(0.0) - F.when(F.col("item.y") >= 0.85, 0.2).otherwise(0.0)
    scored = seen.select("doc_id", "page", "kind", "nth", "phrase", "year", "month", F.col("item.x").alias("x"), F.col("item.y").alias("y"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))
    first = F.struct((-F.col("score")).alias("s"), "page", "kind", "nth", "phrase", "x", "y", "score")
    by_period = scored.groupBy("doc_id", "year", "month").agg(F.min(first).alias("b"), F.min(F.struct("page", "kind", "nth")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("b.score"), "seen"))
    return by_period.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "year", "month", "b.phrase", "b.page", "b.x", "b.y", "b.score")


def reclassified_months(docs: DataFrame, learned: DataFrame, routed: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, period, source: of a known code the learnt period, else the routed one, else a provider's answer; `error` where the document failed.

    docs: doc_id, failed. learned, routed, answers: doc_id, period (answers also phrase, whose text is learnt as an anchor).
    """
    near = docs.join(learned.select("doc_id", F.col("period").alias("l")), "doc_id", "left").join(routed.select("doc_id", F.col("period").alias("r")), "doc_id", "left").join(answers.select("doc_id", F.col("period").alias("a"), "phrase"), "doc_id", "left")
    rules = F.coalesce("l", "r")
    source = F.when(F.col("failed"), "error").when(rules.isNotNull(), "rules").when(F.col("a").isNotNull(), "provider").otherwise("unknown")
    return near.select("doc_id", F.when(~F.col("failed"), F.coalesce(rules, "a")).alias("period"), source.alias("source"), F.when(source == "provider", F.col("phrase")).alias("phrase"))


def month_priority(items: DataFrame, hints: DataFrame, reclassified: DataFrame) -> DataFrame:
    """source_hash, period, decided_by: a period that an operator confirmed stays; else the sub-folder's name; else reclassification.

    items: source_hash, doc_id, route_source, period, sub_folder. hints: sub_folder, hint.
    """
    both = items.join(hints, "sub_folder", "left").join(reclassified.select("doc_id", F.col("period").alias("again")), "doc_id", "left")
    kept = F.when(F.col("route_source") == "operator", F.col("period"))
    by = F.when(kept.isNotNull(), "operator").when(F.col("hint").isNotNull(), "folder").when(F.col("again").isNotNull(), "rules").otherwise("unknown")
    return both.select("source_hash", F.coalesce(kept, "hint", "again").alias("period"), by.alias("decided_by"))
