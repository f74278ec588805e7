"""Page layout: lines, profiles, numbering, hierarchy and the context of a picked span, from positioned text items.

items: doc_id, page (from 1), seq, text, x, y (points from the lower left corner), width.
sizes: doc_id, page, width, height: a row for every page, also for those without items.

What is gathered in one row is a line, or the first and last items of a page; whole documents meet
only as prefix sums of lengths. A page is bounded by its paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import HEADER_STOP, SPACE, normal_period, one_spaced, quoted

# Height of a line's bucket, pages and characters that are inspected, lines of a profile, items of a header or
# footer and their characters, mean length of a page's text below which it is taken for an image.
BUCKET, PAGES, CHARACTERS, LINES, EDGE_ITEMS, EDGE_CHARACTERS, SCANNED = 4, 20, 80_000, 80, 12, 260, 80
# A numbered line (number, number, label), one that begins with a number, the last number of folders.
NUMBERED = r"^\s*(?:([0-9]{1,2})[.)\-_]|\b([0-9]{1,2})\s+-)\s*(.+)$"
BEGINS_NUMBERED = r"^\s*[0-9]{1,2}[.)\-_]?\s+"
LAST_FOLDER = 13
# Numbered lines that make a pattern or a hierarchy, labels and children kept, lines looked ahead, indentation,
# hints of a page, and hints and patterns of a document.
LEAST, LABELS, CHILDREN, AHEAD, INDENT, PAGE_HINTS, DOCUMENT_HINTS = 3, 16, 14, 17, 20, 8, 12
# Tokens of headers and footers that are kept, and characters of a program's name.
TOKENS, PROGRAM = 45, 36

PAGE = ["doc_id", "page"]


def rounded(value: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(value + 0.5)


def collapsed(text: str) -> Column:
    return F.expr(one_spaced(f"translate({text}, {quoted(SPACE)}, '{' ' * len(SPACE)}')"))


def clean_items(items: DataFrame) -> DataFrame:
    """Items with their texts trimmed, empty ones dropped."""
    return items.withColumn("text", F.trim("text", F.lit(SPACE + " "))).where("text <> ''")


def page_lines(items: DataFrame) -> DataFrame:
    """Y2: doc_id, page, line (from 1, top down), text, x, y, width, items.

    Items meet by the bucket of their height and are read from left to right, so a group is one line.
    """
    bucket = rounded(F.col("y") / BUCKET).cast("long") * BUCKET
    read = F.array_sort(F.collect_list(F.struct("x", "seq", "text")))
    rows = clean_items(items).groupBy(*PAGE, bucket.alias("bucket")).agg(
        F.array_join(F.transform(read, lambda i: i["text"]), " ").alias("text"), rounded(F.min("x")).alias("x"), rounded(F.avg("y")).alias("y"), rounded(F.sum("width")).alias("width"), F.count("*").alias("items")
    )
    lines = rows.withColumn("text", collapsed("text")).where("length(text) > 1")
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("bucket")))
    return lines.select(*PAGE, place.alias("line"), "text", "x", "y", "width", "items")


def page_profiles(items: DataFrame, sizes: DataFrame, pages: int = PAGES) -> DataFrame:
    """doc_id, page, width, height, orientation, text_length, header, footer of the first pages, with or without items."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    kept = clean_items(items).where(F.col("page") <= pages).withColumn("text", collapsed("text"))
    placed = kept.withColumns({"nth": F.row_number().over(order), "of": F.count("*").over(Window.partitionBy(*PAGE))})
    first, last = F.col("nth") <= EDGE_ITEMS, F.col("nth") > F.col("of") - EDGE_ITEMS
    edge = lambda inside: F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("nth", "text")))), lambda i: i["text"]), " "), 1, EDGE_CHARACTERS)
    length = F.sum(F.length("text") + 1) - 1  # items are trimmed, so one space lies between any two
    seen = placed.groupBy(*PAGE).agg(length.alias("text_length"), edge(first).alias("header"), edge(last).alias("footer"))
    width, height = rounded(F.col("width")), rounded(F.col("height"))
    shape = F.when(F.abs(width - height) < 20, "square").when(width > height, "landscape").otherwise("portrait")
    every = sizes.where(F.col("page") <= pages).select(*PAGE, width.alias("width"), height.alias("height"), shape.alias("orientation"))
    return every.join(seen, PAGE, "left").fillna({"text_length": 0, "header": "", "footer": ""})


def page_lines_kept(lines: DataFrame) -> DataFrame:
    """Per page its first lines, in order, as a profile keeps them."""
    kept = lines.where(F.col("line") <= LINES)
    return kept.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "text", "x", "y", "width", "items"))).alias("lines"))


def numbering_patterns(lines: DataFrame) -> DataFrame:
    """doc_id, page, kind, first, last, count, labels, place: numbered lines of a page, up to the last folder's number and beyond it.

    Of lines with one number the last gives the label; three numbers make a pattern.
    """
    part = lambda g: F.regexp_extract("text", NUMBERED, g)
    number = F.coalesce(F.nullif(part(1), F.lit("")), F.nullif(part(2), F.lit(""))).cast("int")
    found = lines.select(*PAGE, "line", number.alias("number"), F.trim(part(3)).alias("label")).where("number > 0 AND length(label) >= 2")
    kind = F.when(F.col("number") <= LAST_FOLDER, "1-13 candidate").otherwise("numbered list")
    once = found.groupBy(*PAGE, kind.alias("kind"), "number").agg(F.max_by("label", "line").alias("label"), F.min("line").alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("number", "label")))  # 99 at most
    grouped = once.groupBy(*PAGE, "kind").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("count"), F.slice(F.transform(rows, lambda r: r["label"]), 1, LABELS).alias("labels"), F.min("line").alias("place"))
    return grouped.where(F.col("count") >= LEAST)


def hierarchy_hints(lines: DataFrame) -> DataFrame:
    """doc_id, page, nth, title, child_count, children: titles with three numbered and indented lines among the next ones."""
    ahead = Window.partitionBy(*PAGE).orderBy("line").rowsBetween(1, AHEAD)
    seen = lines.withColumn("ahead", F.collect_list(F.struct("x", "text")).over(ahead))
    children = F.slice(F.transform(F.filter("ahead", lambda c: (c["x"] > F.col("x") + INDENT) & c["text"].rlike(BEGINS_NUMBERED)), lambda c: c["text"]), 1, CHILDREN)
    able = F.length("text").between(4, 89) & ~F.col("text").rlike(BEGINS_NUMBERED)
    hints = seen.where(able).withColumn("children", children).where(F.size("children") >= LEAST)
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line"))
    return hints.withColumn("nth", nth).where(F.col("nth") <= PAGE_HINTS).select(*PAGE, "nth", F.col("text").alias("title"), F.size("children").alias("child_count"), "children")


def document_texts(items: DataFrame, pages: int = PAGES, characters: int = CHARACTERS) -> DataFrame:
    """doc_id, text: `[Page n] ` and the text of each page with items, a line each, up to a number of characters.

    An item's offset is a prefix sum of lengths over its document's first pages; items that begin
    beyond the budget are left out before any text is joined.
    """
    kept = clean_items(items).where(F.col("page") <= pages).withColumn("text", collapsed("text"))
    order = Window.partitionBy("doc_id").orderBy("page", "seq")
    new_page = ~F.col("page").eqNullSafe(F.lag("page").over(order))
    head = F.when(F.lag("page").over(order).isNull(), "").otherwise("\n")
    piece = F.when(new_page, F.concat(head, F.lit("[Page "), F.col("page").cast("string"), F.lit("] "), "text")).otherwise(F.concat(F.lit(" "), "text"))
    placed = kept.withColumn("piece", piece)
    start = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = placed.withColumn("start", start).where(F.col("start") < characters)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]), "")
    return inside.groupBy("doc_id").agg(F.substring(joined, 1, characters).alias("text"))


def edge_tokens(profiles: DataFrame, top: int = TOKENS) -> DataFrame:
    """T6 over the headers and footers of a document's pages: doc_id, tokens: the most frequent ones, ties first seen."""
    words = F.split(F.expr(normal_period("concat_ws(' ', header, footer)")), " ")
    seen = profiles.select("doc_id", "page", F.posexplode(words).alias("at", "token"))
    able = (F.length("token") > 2) & ~F.col("token").isin(*HEADER_STOP) & ~F.col("token").rlike("^[0-9]+$")
    counted = seen.where(able).groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min(F.struct("page", "at")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    best = counted.withColumn("nth", nth).where(F.col("nth") <= top)
    return best.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "token"))), lambda t: t["token"]).alias("tokens"))


def document_profiles(items: DataFrame, sizes: DataFrame, programs: DataFrame, pages: int = PAGES) -> DataFrame:
    """doc_id, page_count, mean_length, ocr_recommended, hints, patterns, layout_tokens, diagnostics.

    programs: doc_id, creator, producer; a document may have none. Texts are `document_texts`.
    """
    lines = page_lines(items).where(F.col("page") <= pages)
    profiles = page_profiles(items, sizes, pages)
    first = F.min_by("orientation", "page")
    seen = profiles.groupBy("doc_id").agg(F.avg("text_length").alias("mean_length"), first.alias("orientation"), F.bool_or(F.col("orientation") == "landscape").alias("landscape"))
    counted = sizes.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    lined = lines.groupBy(*PAGE).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.bool_or(F.least("n", F.lit(LINES)) >= 5).alias("lined"))
    whole = lambda rows, *fields: F.slice(F.array_sort(F.collect_list(F.struct(*fields))), 1, DOCUMENT_HINTS).alias(rows)
    hints = hierarchy_hints(lines).groupBy("doc_id").agg(whole("hints", "page", "nth", "title", "child_count"))  # 160 at most
    patterns = numbering_patterns(lines).groupBy("doc_id").agg(whole("patterns", "page", "place", "kind", "first", "last", "count"))  # 40 at most
    folders = F.exists("patterns", lambda p: (p["first"] == 1) & (p["last"] >= LAST_FOLDER))
    out = counted
    for more in (seen, lined, hints, patterns, edge_tokens(profiles), programs):
        out = out.join(more, "doc_id", "left")
    none = lambda kind: F.array().cast(kind)
    out = out.withColumns({
        "mean_length": F.coalesce("mean_length", F.lit(0.0)), "tokens": F.coalesce("tokens", none("array<string>")), "lined": F.coalesce("lined", F.lit(False)),
        "hints": F.coalesce("hints", none(out.schema["hints"].dataType)), "patterns": F.coalesce("patterns", none(out.schema["patterns"].dataType)),
    })
    scanned = F.col("mean_length") < SCANNED
    program = lambda k: F.when(F.col(k) != "", F.concat(F.lit(f"{k}-"), F.substring(F.expr(normal_period(k)), 1, PROGRAM)))
    tokens = [
        F.format_string("pages-%d", "page_count"), F.coalesce(F.concat(F.lit("first-"), "orientation"), F.lit("unknown-orientation")), F.format_string("avgtext-%d", rounded(F.col("mean_length"))),
        program("creator"), program("producer"), F.when(folders, "numbered-1-13-structure"), F.when(F.size("hints") > 0, "hierarchy-detected"),
    ]
    # The messages.
    messages = [
        F.when(F.col("creator") != "", F.concat(F.lit("PDF creator: "), "creator", F.lit("."))),
        F.when(F.col("producer") != "", F.concat(F.lit("PDF producer: "), "producer", F.lit("."))),
        F.when(scanned, "Low/no PDF text layer detected. Local OCR should be used before relying on text similarity."),
        F.when(F.col("landscape"), "Landscape page detected; often useful for accounting/bank statement grouping."),
        F.when(F.col("lined"), "Coordinate-aware text lines extracted for layout/hierarchy analysis."),
        F.when(folders, "Detected a numbered 1-13 document/folder structure."),
        F.when(F.size("hints") > 0, F.format_string("Detected %d hierarchy/list hint(s) from positioned text.", F.size("hints"))),
        F.when(F.col("page_count") > pages, F.format_string(f"Only first {pages} of %d pages inspected for fast clustering.", "page_count")),
    ]
    return out.select("doc_id", "page_count", "mean_length", scanned.alias("ocr_recommended"), "hints", "patterns", F.concat(F.array_compact(F.array(*tokens)), "tokens").alias("layout_tokens"), F.array_compact(F.array(*messages)).alias("diagnostics"))


# What lies on a picked or selected span's line and around it, in its heights, how far to the side, and words of labels.
PICK_LINE, PICK_BAND, PICK_NEAR, PICK_SIDE, PICK_WORDS = 0.6, 0.75, 4.6, 420, 6
SELECT_LINE, SELECT_BAND, SELECT_NEAR, SELECT_SIDE, LEFT_WORDS, RIGHT_WORDS = 0.7, 0.9, 4.8, 520, 10, 8
#: Height of the bins in which spans meet. Taller ones are in more bins' reach, none in fewer.
BIN = 50.0


def _around(picked: DataFrame, spans: DataFrame, reach: float) -> DataFrame:
    """picked rows with every span of their page within `reach` of their height: they meet by bins of the baseline, not by page."""
    bins = lambda a: F.floor(a / BIN).cast("long")
    far = F.col("height") * reach
    wide = picked.withColumn("bin", F.explode(F.sequence(bins(F.col("baseline") - far), bins(F.col("baseline") + far))))
    other = spans.select(*PAGE, bins(F.col("baseline")).alias("bin"), *[F.col(k).alias(f"o_{k}") for k in ("seq", "text", "left", "width", "baseline")])
    return wide.join(other, [*PAGE, "bin"])


def _words(text: Column, first: int, n: int) -> Column:
    """n words of a collapsed text, from the front, or from the end if first is negative."""
    parts = F.filter(F.split(text, " "), lambda w: w != "")
    return F.array_join(F.slice(parts, 1, n) if first > 0 else F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), " ")


def _gathered(near: DataFrame, key: list[str], parts: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """Per pick, the texts of the spans of each part in the part's order. What is gathered lies within the reach of one pick."""
    lists = [F.collect_list(F.when(inside, F.struct(*[o.alias(f"k{n}") for n, o in enumerate(order)], F.col("o_seq").alias("seq"), F.col("o_text").alias("text")))).alias(k) for k, (inside, order) in parts.items()]
    out = near.groupBy(*key).agg(*lists)
    for k in parts:
        out = out.withColumn(k, F.array_join(F.transform(F.array_sort(k), lambda r: r["text"]), " ")).withColumn(k, collapsed(k))
    return out


def picked_context(picks: DataFrame, spans: DataFrame) -> DataFrame:
    """Pick, label, context: six words to the left on a picked span's line, and the texts of its band and near it.

    picks: pick, doc_id, page, left, width, height, baseline of the span. spans: doc_id, page, seq,
    text, left, width, height, baseline (both from the page's top). Context reads from the bottom up,
    lines from left to right, spans of one place by seq.
    """
    near = _around(picks, clean_items(spans), PICK_NEAR)
    apart, side = F.abs(F.col("o_baseline") - F.col("baseline")), F.abs(F.col("o_left") + F.col("o_width") / 2 - F.col("left") - F.col("width") / 2)
    label = (apart < F.col("height") * PICK_LINE) & (F.col("o_left") < F.col("left"))
    context = (apart < F.col("height") * PICK_BAND) | ((apart < F.col("height") * PICK_NEAR) & (side < PICK_SIDE))
    got = _gathered(near, ["pick"], {"label": (label, [F.col("o_left")]), "context": (context, [-F.col("o_baseline"), F.col("o_left")])})
    whole = picks.select("pick").join(got, "pick", "left")
    return whole.select("pick", F.coalesce(_words(F.col("label"), -1, PICK_WORDS), F.lit("")).alias("label"), F.coalesce("context", F.lit("")).alias("context"))


def selected_context(selections: DataFrame, spans: DataFrame) -> DataFrame:
    """Pick, seq, label, context of selected rectangles: ten words to the left and eight to the right of what is selected, and what is near.

    selections: pick, doc_id, page, x0, y0, x1, y1 (from the page's left and top). A selection stands
    on the first span that it touches, else on the one whose middle is nearest to its own; on a page
    without spans it has no context (seq is null).
    """
    able = clean_items(spans).select(*PAGE, "seq", "text", "left", "width", "height", "baseline")
    middle = {"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2}
    asked = selections.withColumns(middle)
    top = F.col("baseline") - F.col("height")
    both = asked.join(able, PAGE)  # a page's spans, once per selection on that page
    touches = (F.col("left") <= F.col("x1")) & (F.col("left") + F.col("width") >= F.col("x0")) & (top <= F.col("y1")) & (F.col("baseline") >= F.col("y0"))
    apart = F.hypot(F.col("left") + F.col("width") / 2 - F.col("mx"), top + F.col("height") / 2 - F.col("my"))
    it = F.struct("seq", "left", "width", "height", "baseline")
    rank = F.struct(F.when(touches, 0).otherwise(1), F.when(touches, 0.0).otherwise(F.round(apart, 9)), "seq")
    stands = both.groupBy("pick", *PAGE, "mx").agg(F.min_by(it, rank).alias("on"), F.min(F.when(touches, F.col("left"))).alias("from"), F.max(F.when(touches, F.col("left") + F.col("width"))).alias("to"))
    picked = stands.select("pick", *PAGE, "mx", "on.*", F.coalesce("from", "on.left").alias("from"), F.coalesce("to", F.col("on.left") + F.col("on.width")).alias("to"))
    near = _around(picked, able, SELECT_NEAR)
    far, side = F.abs(F.col("o_baseline") - F.col("baseline")), F.abs(F.col("o_left") + F.col("o_width") / 2 - F.col("mx"))
    line = far < F.col("height") * SELECT_LINE
    context = (far < F.col("height") * SELECT_BAND) | ((far < F.col("height") * SELECT_NEAR) & (side < SELECT_SIDE))
    got = _gathered(near, ["pick", "seq"], {
        "before": (line & (F.col("o_left") + F.col("o_width") < F.col("from")), [F.col("o_left")]),
        "behind": (line & (F.col("o_left") > F.col("to")), [F.col("o_left")]),
        "context": (context, [-F.col("o_baseline"), F.col("o_left")]),
    })
    label = F.array_join(F.filter(F.array(_words(F.col("before"), -1, LEFT_WORDS), _words(F.col("behind"), 1, RIGHT_WORDS)), lambda t: t != ""), " | ")
    whole = selections.select("pick").join(got, "pick", "left")
    return whole.select("pick", "seq", F.coalesce(label, F.lit("")).alias("label"), F.coalesce("context", F.lit("")).alias("context"))


def spans_of(items: DataFrame, sizes: DataFrame, height: float = 10.0) -> DataFrame:
    """Spans of items that tell no height of their own: places from the page's top."""
    page = sizes.select(*PAGE, F.col("height").alias("page_height"))
    return items.join(page, PAGE).select(*PAGE, "seq", "text", F.col("x").alias("left"), "width", F.lit(height).alias("height"), (F.col("page_height") - F.col("y")).alias("baseline"))


def line_layouts(lines: DataFrame, sizes: DataFrame, pages: int = PAGES) -> DataFrame:
    """doc_id, pages: a document's lines as taught periods read them (`dates.LAYOUT`), its first pages only."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line", "text", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))), lambda r: F.struct(r["text"].alias("text"), r["x"].alias("x"), r["y"].alias("y")))
    kept = lines.where((F.col("page") <= pages) & (F.col("line") <= LINES)).groupBy(*PAGE).agg(rows.alias("lines"))
    page = F.struct(F.col("page").cast("int").alias("page"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "lines")
    sized = sizes.where(F.col("page") <= pages).join(kept, PAGE, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<struct<text:string,x:double,y:double>>")))
    return sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
