"""Routes from what a company has taught: section fingerprints, enriched fingerprints, approved examples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import normal_route, quoted
from docketry.operators.classify import capped_best
from docketry.operators.dims import FOLDER_OF, GENERIC_TERMS
from docketry.operators.joins import beside_texts

#: Fingerprints and examples of a company that routes look at, at most.
FINGERPRINTS, EXAMPLES = 80, 25
# Caps and least scores of the two kinds of fingerprints.
SECTION_CAP, SECTION_LEAST, ENRICHED_CAP, ENRICHED_LEAST = 0.92, 0.3, 0.98, 0.28
#: Characters of all companies' prints, as JSON, that every Python worker gets; larger tables are joined.
MOST_TAUGHT = 16 << 20
#: Texts scored at once, bits of a run of four bytes, and runs of a term that are looked up before the term itself.
AT_ONCE, GRAM_BITS, MOST_GRAMS = 256, 18, 12


def _latest(rows: DataFrame, most: int, *columns) -> DataFrame:
    """One row per company with the last `most` of its rows by seq, in order."""
    newest = Window.partitionBy("company_id").orderBy(F.desc("seq"))
    kept = rows.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= most)
    return kept.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("seq", *columns)), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("taught"))


def _plain(name: str) -> F.Column:
    return F.expr(f"filter(transform(coalesce({name}, CAST(array() AS ARRAY<STRING>)), x -> {normal_route('x')}), x -> x <> '')").alias(name)


def section_hint(docs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Docs with learned_code and learned_score from the company's last section fingerprints; null below SECTION_LEAST.

    docs: company_id, name_text, body_text (normal forms of routes). fingerprints: company_id, seq,
    document_code, header_terms, sample_tokens. Header terms count as parts of the text, sample
    tokens as whole words; each raw score is held against the capped best so far.
    """
    able = fingerprints.where(F.col("document_code").isin(*FOLDER_OF))
    company = _latest(able, FINGERPRINTS, "document_code", _plain("header_terms"), _plain("sample_tokens"))
    both = beside_texts(docs, company, "company_id", "taught").withColumn("both", F.concat_ws(" ", "name_text", "body_text")).withColumn("spaced", F.concat(F.lit(" "), "both", F.lit(" ")))
    tokens = "slice(filter(f.sample_tokens, t -> length(t) > 2), 1, 35)"
    hits = f"size(filter({tokens}, t -> NOT contains(t, ' ') AND contains(spaced, concat(' ', t, ' '))))"
    header = "aggregate(f.header_terms, 0D, (s, t) -> s + CASE WHEN contains(both, t) THEN CASE WHEN contains(t, ' ') THEN 0.28D ELSE 0.12D END ELSE 0D END)"
    score = f"{header} + CASE WHEN size({tokens}) > 0 THEN least(0.55D, CAST({hits} AS DOUBLE) / size({tokens}) * 1.2D) ELSE 0D END"
    best = F.expr(capped_best(f"transform(coalesce(taught, array()), f -> named_struct('code', f.document_code, 'score', {score}))", SECTION_CAP))
    sure = F.col("best.score") >= SECTION_LEAST
    return both.withColumn("best", best).select(*docs.columns, F.when(sure, F.col("best.code")).alias("learned_code"), F.when(sure, F.col("best.score")).alias("learned_score"))


# Lists of an enriched fingerprint with how many terms count and for how much (of several words or of one), and whether generic terms are left out.
ENRICHED = (("required_terms", 15, 0.5, 0.5, True), ("header_terms", 10, 0.3, 0.14, False), ("tfidf_terms", 12, 0.2, 0.2, True), ("ngrams", 8, 0.45, 0.45, False), ("llm_descriptors", 6, 0.4, 0.4, False), ("optional_terms", 10, 0.08, 0.08, True), ("negative_terms", 8, -0.28, -0.28, False))


def _best_prints(table: dict[str, list[tuple[str, list[tuple[str, float]]]]]):
    """A function of (company, text): code and score of the company's best print, the first on ties.

    table: by company the prints in order, each a code and its terms with their weights. A term is looked
    for once a text however many prints have it, and only where the text shows its first runs of four bytes.
    """

    def grams(raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        return ((b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS) if len(b) > 3 else np.zeros(0, np.uint32)

    def of_company(prints: list[tuple[str, list[tuple[str, float]]]]):
        place: dict[str, int] = {}
        for _, terms in prints:
            for term, _ in terms:
                place.setdefault(term, len(place))
        widest = max(len(terms) for _, terms in prints)
        at, weight = np.full((len(prints), widest), len(place)), np.zeros((len(prints), widest))  # beyond a print's terms: one that no text holds
        for k, (_, terms) in enumerate(prints):
            at[k, : len(terms)], weight[k, : len(terms)] = [place[term] for term, _ in terms], [w for _, w in terms]
        sought = [term.encode() for term in place]
        first = np.full((len(sought), MOST_GRAMS), 1 << GRAM_BITS)  # beyond a term's runs: one that all texts show
        for k, raw in enumerate(sought):
            own = grams(raw)[:MOST_GRAMS]
            first[k, : len(own)] = own
        return np.array([code for code, _ in prints], object), at, weight, sought, first

    def held(text: str, sought: list[bytes], first: np.ndarray) -> np.ndarray:
        raw = text.encode()
        shown = np.zeros((1 << GRAM_BITS) + 1, bool)
        shown[-1] = True
        shown[grams(raw)] = True
        row = np.zeros(len(sought) + 1, bool)
        able = np.flatnonzero(shown[first].all(axis=1))
        row[able] = [sought[j] in raw for j in able.tolist()]
        return row

    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        met = {}
        for companies, texts in batches:
            codes, scores = np.full(len(texts), None, object), np.zeros(len(texts))
            for company, rows in companies.groupby(companies).indices.items():
                if company not in table:
                    continue
                if company not in met:
                    met[company] = of_company(table[company])
                names, at, weight, *terms = met[company]
                for chunk in np.array_split(rows, -(-len(rows) // AT_ONCE)):
                    holds = np.stack([held(text, *terms) for text in texts.iloc[chunk]])
                    total = np.zeros((len(chunk), len(names)))
                    for j in range(at.shape[1]):  # term after term, as a sum in order
                        total += weight[:, j] * holds[:, at[:, j]]
                    total = np.clip(total, 0, ENRICHED_CAP)
                    first = total.argmax(axis=1)
                    scores[chunk] = total[np.arange(len(chunk)), first]
                    codes[chunk] = np.where(scores[chunk] > 0, names[first], None)
            yield pd.DataFrame({"code": codes, "score": scores})

    return F.pandas_udf(best, "code string, score double")


def enriched_hint(docs: DataFrame, prints: DataFrame, own_names: tuple[str, ...] = ()) -> DataFrame:
    """The same from enriched fingerprints, which take the place of C2's where they are switched on.

    prints: company_id, seq, document_code and the lists of ENRICHED. own_names: further words that
    tell nothing, as the owner's name on every document. Scores are held between 0 and
    0.98 before they are compared, so the first of the best wins.
    """
    generic = ", ".join(map(quoted, (*GENERIC_TERMS, *own_names)))
    lists = []
    for name, most, many, one, useful in ENRICHED:  # what a term is and weighs is the print's: found once, not for each document
        weight = f"{many}D" if many == one else f"CASE WHEN contains(x, ' ') THEN {many}D ELSE {one}D END"
        fit = f"length(t.n) > 2 AND NOT t.n IN ({generic}) AND NOT t.n RLIKE '^[0-9]+$'" if useful else "t.n <> ''"
        lists.append(f"filter(transform(slice(coalesce({name}, CAST(array() AS ARRAY<STRING>)), 1, {most}), x -> named_struct('n', {normal_route('x')}, 'w', {weight})), t -> {fit})")
    company = _latest(prints.where(F.col("document_code").isin(*FOLDER_OF)), FINGERPRINTS, "document_code", F.expr(f"concat({', '.join(lists)})").alias("terms")).where("company_id IS NOT NULL")
    text = F.concat_ws(" ", "name_text", "body_text")
    size = company.agg(F.coalesce(F.sum(F.length(F.to_json("taught"))), F.lit(0)).alias("n")).first()["n"]
    if size <= MOST_TAUGHT:
        table = {r["id"]: [(f["document_code"], [(t["n"], t["w"]) for t in f["terms"]]) for f in r["taught"]] for r in company.select(F.col("company_id").cast("string").alias("id"), "taught").collect()}
        both = docs.withColumn("best", _best_prints(table)(F.col("company_id").cast("string"), text))
    else:
        score = "aggregate(f.terms, 0D, (s, t) -> s + CASE WHEN contains(both, t.n) THEN t.w ELSE 0D END)"
        best = F.expr(capped_best(f"transform(coalesce(taught, array()), f -> named_struct('code', f.document_code, 'score', greatest(0D, least({ENRICHED_CAP}D, {score}))))", 1.0))
        both = beside_texts(docs, company, "company_id", "taught").withColumn("both", text).withColumn("best", best)
    sure = F.col("best.score") >= ENRICHED_LEAST
    return both.select(*docs.columns, F.when(sure, F.col("best.code")).alias("learned_code"), F.when(sure, F.col("best.score")).alias("learned_score"))


def example_shares(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """Docs with example_scores: by code the largest share of an approved example's tokens that are in the file's name.

    docs: company_id, name_text. examples: company_id, seq, document_code, filename_tokens.
    """
    tokens = F.expr(f"filter(filename_tokens, x -> length(x) > 2)")  # noqa: F541
    company = _latest(examples, EXAMPLES, "document_code", tokens.alias("tokens"))
    both = beside_texts(docs, company, "company_id", "taught").withColumn("spaced", F.concat(F.lit(" "), "name_text", F.lit(" ")))
    one = f"named_struct('code', e.document_code, 'share', CAST(size(filter(e.tokens, x -> {normal_route('x')} <> '' AND length({normal_route('x')}) > 2 AND contains(spaced, concat(' ', {normal_route('x')}, ' ')))) AS DOUBLE) / greatest(1, size(e.tokens)))"
    shares = f"transform(filter(coalesce(taught, array()), e -> size(e.tokens) > 0), e -> {one})"
    both = both.withColumn("shares", F.expr(shares))
    best = F.expr("map_from_entries(transform(array_distinct(transform(shares, s -> s.code)), c -> struct(c, array_max(transform(filter(shares, s -> s.code = c), s -> s.share)))))")
    return both.select(*docs.columns, best.alias("example_scores"))


def normal_texts(docs: DataFrame) -> DataFrame:
    """docs with name_text and body_text, as routes normalise them."""
    return docs.withColumn("name_text", F.expr(normal_route("coalesce(file_name, '')"))).withColumn("body_text", F.expr(normal_route("coalesce(body, '')")))
