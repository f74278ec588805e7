"""Learning from examples: distinctive terms, coverage votes, folder requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import learning_tokens, normal_period, settled
from docketry.operators.classify import settled_rows
from docketry.operators.dims import COMPETITORS, LEARNING_STOP
from docketry.operators.segment import period_format


def tf_idf(tokens: DataFrame, top: int = 20) -> DataFrame:
    """L1: per (reference_id, section) the `top` terms by tf x ln((1 + N) / (1 + df)), ties first seen.

    tokens: reference_id, section, seq, token. Counts are taken before any window, so a hot token
    is one row per section.
    """
    tf = tokens.groupBy("reference_id", "section", "token").agg(F.count("*").alias("tf"), F.min("seq").alias("first"))
    df = tf.groupBy("reference_id", "token").agg(F.count("*").alias("df"))
    n = tf.groupBy("reference_id").agg(F.countDistinct("section").alias("sections"))
    scored = tf.join(df, ["reference_id", "token"]).join(n, "reference_id").withColumn("score", F.col("tf") * F.log((1.0 + F.col("sections")) / (1.0 + F.col("df"))))
    order = Window.partitionBy("reference_id", "section").orderBy(F.col("score").desc(), "first")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("reference_id", "section", "rank", "token", F.round("score", 6).alias("score"))


def term_coverage(terms: DataFrame, required: float = 0.6, optional: float = 0.2) -> DataFrame:
    """Share of a section's instances that hold a term; required, optional or dropped.

    terms: section, instance, term. Empty terms are dropped.
    """
    seen = terms.where("term <> ''").select("section", "instance", "term").distinct()
    instances = seen.groupBy("section").agg(F.countDistinct("instance").alias("instances"))
    share = seen.groupBy("section", "term").agg(F.count("*").alias("hits")).join(instances, "section").withColumn("coverage", F.col("hits") / F.col("instances"))
    return share.where(F.col("coverage") >= optional).select("section", "term", "hits", F.round("coverage", 6).alias("coverage"), F.when(F.col("coverage") >= required, "required").otherwise("optional").alias("kind"))


def folder_requirements(sections: DataFrame) -> DataFrame:
    """Per code the share of references that have it, its need, and the upper median of its pages.

    The median comes from counts by page number, so no list of a hot code's sections is gathered.
    """
    references = sections.agg(F.countDistinct("reference_id").alias("total"))
    hits = sections.groupBy("code").agg(F.countDistinct("reference_id").alias("hits"), F.count("*").alias("n"))
    by_pages = sections.groupBy("code", "pages").agg(F.count("*").alias("k"))
    upto = by_pages.withColumn("upto", F.sum("k").over(Window.partitionBy("code").orderBy("pages")))
    median = upto.join(hits.select("code", "n"), "code").where(F.col("upto") >= F.floor(F.col("n") / 2) + 1).groupBy("code").agg(F.min("pages").alias("expected_pages"))
    return hits.join(median, "code").join(F.broadcast(references)).select("code", "hits", F.when(F.col("hits") / F.col("total") >= 0.6, "required").otherwise("optional").alias("need"), "expected_pages")


def exclusive_phrases(tokens: DataFrame, top: int = 10) -> DataFrame:
    """L2: runs of two or three tokens seen twice or more, one of them in no other section of the reference; the `top` by count, ties first seen."""
    homes = tokens.groupBy("reference_id", "token").agg(F.countDistinct("section").alias("homes"))
    order = Window.partitionBy("reference_id", "section").orderBy("seq")
    marked = tokens.join(homes, ["reference_id", "token"]).withColumn("own", F.col("homes") == 1)
    for k in (1, 2):
        marked = marked.withColumn(f"t{k}", F.lead("token", k).over(order)).withColumn(f"o{k}", F.lead("own", k).over(order))
    runs = F.array(
        F.struct(F.lit(2).alias("n"), F.concat_ws(" ", "token", "t1").alias("phrase"), (F.col("own") | F.col("o1")).alias("own"), F.col("t1").isNotNull().alias("whole")),
        F.struct(F.lit(3).alias("n"), F.concat_ws(" ", "token", "t1", "t2").alias("phrase"), (F.col("own") | F.col("o1") | F.col("o2")).alias("own"), F.col("t2").isNotNull().alias("whole")),
    )
    spread = marked.select("reference_id", "section", "seq", F.inline(runs)).where("whole AND own")
    counted = spread.groupBy("reference_id", "section", "phrase").agg(F.count("*").alias("hits"), F.min(F.struct("seq", "n")).alias("first")).where("hits >= 2")
    place = F.row_number().over(Window.partitionBy("reference_id", "section").orderBy(F.desc("hits"), "first"))
    return counted.withColumn("rank", place).where(F.col("rank") <= top).select("reference_id", "section", "rank", "phrase", "hits")


def negative_terms(tokens: DataFrame, competitors: DataFrame, top: int = 12) -> DataFrame:
    """L3: tokens over three letters seen twice or more in a competing section and never in one's own; in the order of competitors, then first seen.

    competitors: section, competitor, place.
    """
    tf = tokens.groupBy("reference_id", "section", "token").agg(F.count("*").alias("tf"), F.min("seq").alias("first"))
    theirs = tf.where("tf >= 2 AND length(token) > 3").withColumnRenamed("section", "competitor")
    offered = theirs.join(competitors, "competitor").groupBy("reference_id", "section", "token").agg(F.min(F.struct("place", "first")).alias("first"))
    present = tf.select("reference_id", "section").distinct()
    fresh = offered.join(present, ["reference_id", "section"], "left_semi").join(tf.select("reference_id", "section", "token"), ["reference_id", "section", "token"], "left_anti")
    place = F.row_number().over(Window.partitionBy("reference_id", "section").orderBy("first", "token"))
    return fresh.withColumn("rank", place).where(F.col("rank") <= top).select("reference_id", "section", "rank", "token")


def period_vote(signals: DataFrame) -> DataFrame:
    """Per section the format and position most of its instances show, if at least half of them show any; ties first seen.

    signals: section, seq, format, position; a null position counts as `body`.
    """
    share = signals.groupBy("section").agg((F.count("format") / F.count("*")).alias("detection_rate"))
    shown = signals.where("format IS NOT NULL").withColumn("position", F.coalesce("position", F.lit("body")))
    best = None
    for kind in ("format", "position"):
        votes = shown.groupBy("section", kind).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
        won = votes.groupBy("section").agg(F.max_by(kind, F.struct("n", F.negate("seq"))).alias(kind))
        best = won if best is None else best.join(won, "section")
    return share.where("detection_rate >= 0.5").join(best, "section").select("section", "format", "position", F.round("detection_rate", 6).alias("detection_rate"))


def learned_tokens(sections: DataFrame) -> DataFrame:
    """reference_id, section, seq, token of each section's text, as learning takes them."""
    words = learning_tokens(F.expr(normal_period("raw_text")), list(LEARNING_STOP))
    return sections.select("reference_id", F.col("label").alias("section"), F.posexplode(words).alias("seq", "token"))


def competitors(spark) -> DataFrame:
    """section, competitor, place of the codes that compete with each other."""
    rows = [(c, o, k) for group in COMPETITORS for c in group for k, o in enumerate(x for x in group if x != c)]
    return spark.createDataFrame(rows, "section string, competitor string, place int")


def _listed(ranked: DataFrame, item: str, name: str) -> DataFrame:
    return ranked.groupBy("reference_id", F.col("section").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias(name))


def enriched_sections(sections: DataFrame, descriptors: DataFrame | None = None) -> DataFrame:
    """Sections with their distinctive terms, phrases, negative terms, descriptors (6 at most) and period signal.

    sections: from section_profiles. descriptors: reference_id, label, phrases, as a provider gave them.
    """
    tokens, key, none = learned_tokens(sections), ["reference_id", "label"], F.array().cast("array<string>")
    out = sections
    for found, item, name in ((tf_idf(tokens), "token", "tfidf_terms"), (exclusive_phrases(tokens), "phrase", "ngrams"), (negative_terms(tokens, competitors(sections.sparkSession)), "token", "negative_terms")):
        out = out.join(_listed(found, item, name), key, "left").withColumn(name, F.coalesce(name, none))
    if descriptors is not None:
        out = out.join(descriptors.select(*key, F.slice("phrases", 1, 6).alias("llm_descriptors")), key, "left")
    else:
        out = out.withColumn("llm_descriptors", none)
    signal = period_format("raw_text")
    return out.withColumn("llm_descriptors", F.coalesce("llm_descriptors", none)).withColumn("signal", signal).select("*", F.col("signal.format").alias("format"), F.coalesce("signal.anchors", none).alias("anchors")).drop("signal")


def example_quality(enriched: DataFrame) -> DataFrame:
    """Per reference how much was learnt from it: shares of sections with terms, with phrases and with descriptors."""
    share = lambda what: F.avg(F.when(what, 1.0).otherwise(0.0))
    return enriched.groupBy("reference_id").agg(F.round(F.least(F.lit(1.0), 0.4 * share(F.size("tfidf_terms") >= 5) + 0.2 * share(F.size("ngrams") >= 2) + 0.4 * share(F.size("llm_descriptors") > 0)), 6).alias("quality"))


def layer_log(pages: DataFrame, enriched: DataFrame) -> DataFrame:
    """reference_id, place, layer, status and number of each learning layer: pages, sections, none, sections, described sections."""
    seen = pages.groupBy("reference_id").agg(F.count("*").alias("pages"))
    learnt = enriched.groupBy("reference_id").agg(F.count("*").alias("sections"), F.count_if(F.size("llm_descriptors") > 0).alias("described"))
    both = seen.join(learnt, "reference_id", "left").fillna(0, ["sections", "described"])
    row = lambda k, name, status, n: F.struct(F.lit(k).alias("place"), F.lit(name).alias("layer"), status.alias("status"), n.cast("long").alias("n"))
    done, skipped = F.lit("done"), F.lit("skipped")
    rows = F.array(row(0, "input", done, F.col("pages")), row(1, "structure", done, F.col("sections")), row(2, "ocr", skipped, F.lit(0)), row(3, "tfidf", done, F.col("sections")), row(4, "llm", F.when(F.col("described") > 0, done).otherwise(skipped), F.col("described")))
    return both.select("reference_id", F.inline(rows))


def fingerprints(instances: DataFrame) -> DataFrame:
    """One row per company and code over its examples' sections.

    instances: company_id, seq (order of examples), label, header_terms, tfidf_terms, ngrams,
    llm_descriptors, negative_terms, sample_tokens, date_position, format, anchors. Terms found in at
    least 60 % of a code's instances are required (20), those in at least 20 % optional (15), in the
    order first seen; negative terms are merged (15). The richest instance, the first of several,
    gives the other lists. A period signal needs a format in half of the instances; its anchors are
    those of at least 40 % of these (6).
    """
    key = ["company_id", "label"]
    at = lambda n: Window.partitionBy(*key).orderBy(n)
    total = instances.groupBy("company_id").agg(F.countDistinct("seq").alias("examples"))
    counts = instances.groupBy(*key).agg(F.count("*").alias("instances"), F.count("format").alias("shown"))
    words = instances.select(*key, "seq", F.posexplode(F.array_distinct(F.concat("header_terms", "tfidf_terms", "ngrams", "llm_descriptors"))).alias("pos", "term")).where("term <> ''")
    rated = words.groupBy(*key, "term").agg(F.count("*").alias("hits"), F.min(F.struct("seq", "pos")).alias("first")).join(counts, key).withColumn("rate", F.col("hits") / F.col("instances"))

    def listed(rows: DataFrame, item: str, most: int, name: str, order) -> DataFrame:
        kept = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)
        return kept.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias(name))

    required = listed(rated.where("rate >= 0.6"), "term", 20, "required_terms", ["first"])
    optional = listed(rated.where("rate >= 0.2 AND rate < 0.6"), "term", 15, "optional_terms", ["first"])
    against = instances.select(*key, "seq", F.posexplode("negative_terms").alias("pos", "term")).groupBy(*key, "term").agg(F.min(F.struct("seq", "pos")).alias("first"))
    negative = listed(against, "term", 15, "negatives", ["first"])
    anchors = instances.where("format IS NOT NULL").select(*key, "seq", F.posexplode("anchors").alias("pos", "phrase")).groupBy(*key, "phrase").agg(F.count("*").alias("hits"), F.min(F.struct("seq", "pos")).alias("first"))
    phrases = listed(anchors.join(counts, key).where("hits >= 0.4D * shown"), "phrase", 6, "anchor_phrases", [F.desc("hits"), "first"])
    rich = F.size("tfidf_terms") + F.size("llm_descriptors") + F.size("ngrams")
    base = instances.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(rich.desc(), "seq"))).where("nth = 1").select(*key, "header_terms", "tfidf_terms", "ngrams", "llm_descriptors", "sample_tokens")
    voted = period_vote(instances.select(F.concat_ws(":", *key).alias("section"), "seq", "format", F.col("date_position").alias("position"))).withColumnRenamed("position", "voted_position")
    out = base.join(counts, key).join(total, "company_id")
    for more in (required, optional, negative, phrases):
        out = out.join(more, key, "left")
    out = out.join(voted, F.concat_ws(":", *key) == voted["section"], "left")
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty).alias(n) for c, n in (("required_terms", "required_terms"), ("optional_terms", "optional_terms"), ("negatives", "negative_terms"))]
    return out.select(*key, "header_terms", "tfidf_terms", "ngrams", "llm_descriptors", "sample_tokens", *lists, F.round(F.col("instances") / F.col("examples"), 6).alias("coverage"), "format", F.col("voted_position").alias("position"), F.when(F.col("format").isNotNull(), F.coalesce("anchor_phrases", empty)).alias("anchor_phrases"), "detection_rate")


# How many terms of each list are scored, and by what.
POOL = (("required", 15, 0.5), ("header", 10, 0.3), ("tfidf", 12, 0.2), ("ngrams", 8, 0.45), ("descriptors", 6, 0.4), ("negative", 8, -0.25))


def validated(prints: DataFrame, rounds: int = 3, enough: float = 0.75) -> DataFrame:
    """company_id, rounds, quality and prints (label, recall, precision, required terms) after self-validation.

    A company has one print a code, 13 at most, so its prints lie in one row and every round is an
    expression over them: each print's own terms are scored against all prints. A round ends the
    search when both means are enough; else weak prints take five more sample tokens into their
    required terms, 25 at most. Empty terms are no hits.
    """
    normal = lambda c: F.expr(f"filter(transform({c}, x -> {normal_period('x')}), x -> x <> '')")
    one = F.struct("label", "required_terms", "sample_tokens", *[normal(c).alias(n) for c, n in (("header_terms", "header"), ("tfidf_terms", "tfidf"), ("ngrams", "ngrams"), ("llm_descriptors", "descriptors"), ("negative_terms", "negative"))])
    company = prints.groupBy("company_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)).alias("prints"))
    company = settled_rows(company)
    company = company.withColumns({"done": F.lit(False), "rounds": F.lit(0), "results": F.expr("transform(prints, p -> named_struct('recall', 0D, 'precision', 0D))")})
    pool = "concat(" + ", ".join(f"transform(slice({'required' if k == 'required' else 'p.' + k}, 1, {n}), t -> named_struct('t', t, 'w', {w}D))" for k, n, w in POOL) + ")"
    required = f"filter(transform(p.required_terms, x -> {normal_period('x')}), x -> x <> '')"
    own = normal_period("concat_ws(' ', p.required_terms, slice(p.header, 1, 8), slice(p.tfidf, 1, 10), slice(p.ngrams, 1, 6), p.descriptors)")
    score = "greatest(0D, aggregate(q.pool, 0D, (s, x) -> s + CASE WHEN contains(p.own, x.t) THEN x.w ELSE 0D END))"
    verdict = "named_struct('recall', CASE WHEN p.own = '' THEN 0D WHEN mine > other THEN 1D WHEN mine > 0 AND mine > other * 0.7D THEN 0.6D ELSE 0D END, 'precision', CASE WHEN p.own <> '' AND mine > 0 THEN mine / greatest(1D, mine + other) ELSE 0D END)"
    for k in range(1, rounds + 1):
        ready = F.expr(f"transform(prints, p -> named_struct('label', p.label, 'own', {own}, 'pool', {settled(required, pool, 'required')}))")
        company = settled_rows(company.withColumn("ready", ready))
        each = settled(f"element_at(transform(filter(ready, q -> q.label = p.label), q -> {score}), 1)", settled(f"aggregate(transform(filter(ready, q -> q.label <> p.label), q -> {score}), 0D, (m, x) -> greatest(m, x))", verdict, "other"), "mine")
        company = company.withColumn("results", F.expr(f"CASE WHEN done THEN results ELSE transform(ready, p -> {each}) END")).withColumn("rounds", F.when(F.col("done"), F.col("rounds")).otherwise(k)).drop("ready")
        company = settled_rows(company)
        mean = lambda what: F.expr(f"aggregate(results, 0D, (s, r) -> s + r.{what}) / greatest(1, size(results))")
        company = company.withColumn("done", F.col("done") | ((mean("recall") >= enough) & (mean("precision") >= enough)))
        if k < rounds:
            more = "slice(filter(p.sample_tokens, t -> NOT array_contains(p.required_terms, t)), 1, 5)"
            kept = ", ".join(f"'{f}', p.{f}" for f in ("sample_tokens", "header", "tfidf", "ngrams", "descriptors", "negative"))
            grown = f"transform(prints, (p, i) -> named_struct('label', p.label, 'required_terms', CASE WHEN results[i].recall < {enough}D THEN slice(concat(p.required_terms, {more}), 1, 25) ELSE p.required_terms END, {kept}))"
            company = settled_rows(company.withColumn("prints", F.expr(f"CASE WHEN done THEN prints ELSE {grown} END")))
    quality = F.round((mean("recall") + mean("precision")) / 2, 6)
    shown = F.expr("transform(prints, (p, i) -> named_struct('label', p.label, 'recall', results[i].recall, 'precision', round(results[i].precision, 6), 'required_terms', p.required_terms))")
    return settled_rows(company.select("company_id", "rounds", quality.alias("quality"), shown.alias("prints")))


def trained_companies(enriched: DataFrame, plain: DataFrame, rules: DataFrame) -> DataFrame:
    """company_id, rounds, quality, prints and the next rules_version of every company with examples.

    Enriched sections are learnt from where a company has any, else its plain ones, whose learned
    lists are empty. Both have the columns of `fingerprints`' instances; rules: company_id, rules_version.
    """
    has = enriched.select("company_id").distinct()
    return validated(fingerprints(enriched.unionByName(plain.join(has, "company_id", "left_anti")))).join(rules, "company_id").withColumn("rules_version", F.col("rules_version") + 1)


def recorded_references(known: DataFrame, new: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references with the new ones, rules) where of each company, hash and kind only the first counts; the version moves by one for each new one.

    known, new: company_id, source_hash, kind, seq. rules: company_id, rules_version.
    """
    key = ["company_id", "source_hash", "kind"]
    fresh = new.groupBy(*key).agg(F.min("seq").alias("seq")).join(known.select(*key), key, "left_anti")
    added = fresh.groupBy("company_id").agg(F.count("*").alias("added"))
    moved = rules.join(added, "company_id", "left").select("company_id", (F.col("rules_version") + F.coalesce("added", F.lit(0))).alias("rules_version"))
    return known.select(*key, "seq").unionByName(fresh.select(*key, "seq")), moved


def _prepended(phrases: F.Column, new: F.Column, most: int = 8) -> F.Column:
    others = F.filter(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: F.lower(p) != F.lower(new))
    return F.slice(F.concat(F.array(new), others), 1, most)


def with_anchor(prints: DataFrame, anchors: DataFrame) -> DataFrame:
    """Prints whose code got an anchor: it comes first, once, of eight; the rate rises by 0.06 to 0.95, and a new signal starts at 0.56.

    prints: company_id, document_code, position, anchor_phrases, detection_rate (both null without a signal).
    anchors: company_id, document_code, phrase; one per code.
    """
    key = ["company_id", "document_code"]
    phrase = F.trim("phrase")
    rate = F.when(F.col("anchor_phrases").isNull() & F.col("detection_rate").isNull(), 0.56).otherwise(F.least(F.lit(0.95), F.coalesce("detection_rate", F.lit(0.5)) + 0.06))
    seen = prints.join(anchors, key, "left")
    return seen.select(*key, "position", F.when(phrase.isNull(), F.col("anchor_phrases")).otherwise(_prepended(F.col("anchor_phrases"), phrase)).alias("anchor_phrases"), F.when(phrase.isNull(), F.col("detection_rate")).otherwise(F.round(rate, 6)).alias("detection_rate"))


def with_zone(prints: DataFrame, zones: DataFrame) -> DataFrame:
    """Prints whose code got a zone: its position, and a rate of at least 0.5. zones: company_id, document_code, zone."""
    key, hit = ["company_id", "document_code"], F.col("zone").isNotNull()
    rate = F.greatest(F.coalesce("detection_rate", F.lit(0.5)), F.lit(0.5))
    phrases = F.coalesce("anchor_phrases", F.array().cast("array<string>"))
    return prints.join(zones, key, "left").select(*key, F.when(hit, F.col("zone")).otherwise(F.col("position")).alias("position"), F.when(hit, phrases).otherwise(F.col("anchor_phrases")).alias("anchor_phrases"), F.when(hit, rate).otherwise(F.col("detection_rate")).alias("detection_rate"))


def with_mark(prints: DataFrame, marks: DataFrame) -> DataFrame:
    """Prints whose code got a mark: date, label and context (220 characters) come first among its anchors, and a rate of at least 0.5.

    marks: company_id, document_code, page, x, y, date_text, label, context_text; those with x or y outside 0 to 1 are dropped.
    """
    key = ["company_id", "document_code"]
    clean = marks.where("x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1").select(*key, F.struct("page", "x", "y", F.trim("date_text").alias("date_text"), F.trim("label").alias("label"), F.substring(F.trim("context_text"), 1, 220).alias("context_text")).alias("mark"))
    seen = prints.join(clean, key, "left")
    new = F.filter(F.array("mark.date_text", "mark.label", "mark.context_text"), lambda x: F.coalesce(x, F.lit("")) != "")
    signalled = F.col("anchor_phrases").isNotNull() | F.col("detection_rate").isNotNull()
    put = F.aggregate(F.reverse(new), F.coalesce("anchor_phrases", F.array().cast("array<string>")), lambda held, x: F.slice(F.concat(F.array(x), F.filter(held, lambda p: F.lower(p) != F.lower(x))), 1, 8))
    hit = F.col("mark").isNotNull()
    return seen.select(*key, "position", F.when(hit & signalled, put).when(hit, F.slice(new, 1, 8)).otherwise(F.col("anchor_phrases")).alias("anchor_phrases"), F.when(hit, F.greatest(F.coalesce("detection_rate", F.lit(0.5)), F.lit(0.5))).otherwise(F.col("detection_rate")).alias("detection_rate"), "mark")


def learning_coverage(sections: DataFrame, enriched: DataFrame) -> DataFrame:
    """Per kind and folder the learned sections, and those with an enriched section of the same label in their reference.

    sections: reference_id, kind, folder_number, label. enriched: reference_id, label.
    """
    rich = enriched.select("reference_id", "label").distinct().withColumn("rich", F.lit(1))
    return sections.join(rich, ["reference_id", "label"], "left").groupBy("kind", "folder_number").agg(F.count("*").alias("sections"), F.count("rich").alias("enriched"))


def folder_sequence(sections: DataFrame) -> DataFrame:
    """company_id, sequence: the codes of its sections, each once, in order of their places. sections: company_id, code, section_order."""
    first = sections.groupBy("company_id", "code").agg(F.min("section_order").alias("first"))
    return first.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "code"))), lambda x: x["code"]).alias("sequence"))  # 13 codes


def section_context(sections: DataFrame, last: int = 80) -> DataFrame:
    """The `last` newest section fingerprints over a company's examples, in their own order. sections: company_id, seq, section_order, code."""
    newest = Window.partitionBy("company_id").orderBy(F.desc("seq"), F.desc("section_order"), F.desc("code"))
    return sections.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= last)


def rule_context(examples: DataFrame, last: int = 25) -> DataFrame:
    """The `last` newest examples of each company, in their own order."""
    newest = Window.partitionBy("company_id").orderBy(F.desc("seq"))
    return examples.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= last)
