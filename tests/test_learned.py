"""Learned routes, taught periods, date candidates, self-validation and product checks on hand-worked tables."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docketry.operators import checks, dates, joins, learn, learned, segment, workspace


def test_section_hints(spark):
    prints = [
        (1, 1, "GIR", ["Guia IRS", "retencao"], ["guia", "irs", "valor", "codigo"]), (1, 2, "LC", ["total"], []), (1, 3, "XX", ["guia irs"], ["guia"]),
        (2, 1, "GIR", ["guia irs"], ["guia", "irs"]), (2, 2, "PIR", ["guia irs", "irs valor", "valor total"], ["guia", "irs"]), (2, 3, "SSR", ["guia irs", "irs valor", "valor total"], ["guia", "irs"]),
    ]
    docs = spark.createDataFrame([(k, k, "x.pdf", "Guia IRS valor total") for k in (1, 2, 3)], "doc_id long, company_id long, file_name string, body string")
    table = spark.createDataFrame(prints, "company_id long, seq long, document_code string, header_terms array<string>, sample_tokens array<string>")
    got = {r["doc_id"]: (r["learned_code"], r["learned_score"] and round(r["learned_score"], 6)) for r in learned.section_hint(learned.normal_texts(docs), table).collect()}
    assert got == {1: ("GIR", 0.83), 2: ("SSR", 0.92), 3: (None, None)}  # of scores over the cap the last wins
    lists = ["required_terms", "header_terms", "tfidf_terms", "ngrams", "llm_descriptors", "optional_terms", "negative_terms"]
    rich = spark.createDataFrame([(1, 1, "GIR", ["guia irs", "total"], ["irs"], [], [], [], ["valor"], []), (1, 2, "PIR", [], ["guia irs"], [], [], [], [], ["valor"])], "company_id long, seq long, document_code string, " + ", ".join(f"{n} array<string>" for n in lists))
    got = {r["doc_id"]: (r["learned_code"], r["learned_score"] and round(r["learned_score"], 6)) for r in learned.enriched_hint(learned.normal_texts(docs), rich).collect()}
    assert got == {1: ("GIR", 0.64), 2: (None, None), 3: (None, None)}  # `total` and `valor` are generic
    examples = spark.createDataFrame([(1, 1, "GIR", ["guia", "irs", "junho"]), (1, 2, "GIR", ["nada", "aqui"]), (1, 3, "LC", [])], "company_id long, seq long, document_code string, filename_tokens array<string>")
    named = spark.createDataFrame([(1, 1, "guia_irs_maio.pdf", "")], "doc_id long, company_id long, file_name string, body string")
    assert learned.example_shares(learned.normal_texts(named), examples).first()["example_scores"] == {"GIR": 2 / 3}


@pytest.mark.parametrize("most", [1 << 24, -1])  # prints in every worker, or joined
def test_enriched_hints_against_every_print_and_term(spark, monkeypatch, most):
    rng = random.Random(8)
    raw = ["Guia_IRS", "guia", "irs", "ir", "r", "Retenção na fonte", "fonte/recibo", "recibo", "Ção", "12", "valor", "--", "", None, "número três", "vencimento", "venci", "😀 fim", "fim"]
    normal = ["guia irs", "guia", "irs", "ir", "r", "retencao na fonte", "fonte recibo", "recibo", "cao", "12", "valor", "", "", None, "numero tres", "vencimento", "venci", "😀 fim", "fim"]
    plain = dict(zip(raw, normal))
    lists = [n for n, *_ in learned.ENRICHED]
    prints = [(None if k % 20 == 0 else 0 if k % 3 == 0 else k % 97, k, rng.choice(["GIR", "LC", "XX", "PIR"]), *[rng.choices(raw, k=rng.choice([0, 1, 2, 20])) if rng.random() < 0.3 else None for _ in lists]) for k in range(400)]
    words = " ".join(x for x in normal if x).split(" ") + ["guiairs", "xretencao", "na", "reci", "tr\u0101s"]
    docs = [(k, rng.choice([0, 200, None, *range(1, 97)]), " ".join(rng.choices(words, k=rng.choice([0, 1, 3]))), " ".join(rng.choices(words, k=rng.choice([0, 1, 6, 40])))) for k in range(600)]
    docs.append((600, 0, "x" * 50_000 + " retencao na fonte", "numero tresvencimento"))
    want = {}
    for key, company, name, body in docs:
        taught = sorted((p for p in prints if p[0] == company is not None and p[2] != "XX"), key=lambda p: -p[1])[: learned.FINGERPRINTS]
        best = (None, 0.0)
        for p in reversed(taught):
            score = 0.0
            for (_, most_terms, many, one, useful), terms in zip(learned.ENRICHED, p[3:]):
                for x in (terms or [])[:most_terms]:
                    n = plain[x]
                    fit = n and (not useful or len(n) > 2 and n not in learned.GENERIC_TERMS and not n.isdigit())
                    score += (many if " " in x else one) if fit and n in f"{name} {body}" else 0.0
            score = max(0.0, min(0.98, score))
            best = (p[2], score) if score > best[1] else best
        want[key] = best if best[1] >= learned.ENRICHED_LEAST else (None, None)
    monkeypatch.setattr(learned, "MOST_TAUGHT", most)
    table = spark.createDataFrame(prints, "company_id long, seq long, document_code string, " + ", ".join(f"{n} array<string>" for n in lists))
    found = learned.enriched_hint(spark.createDataFrame(docs, "doc_id long, company_id long, name_text string, body_text string"), table)
    assert {r["doc_id"]: (r["learned_code"], r["learned_score"]) for r in found.collect()} == want and len({v for v in want.values()}) > 20
    assert found.columns == ["doc_id", "company_id", "name_text", "body_text", "learned_code", "learned_score"]
    none = learned.enriched_hint(found.select("doc_id", "company_id", "name_text", "body_text"), table.where("seq < 0"))
    assert none.where("learned_code IS NULL AND learned_score IS NULL").count() == len(docs)


def test_terms_of_prints_are_brought_into_normal_form_once(spark):
    prints = spark.range(1).selectExpr("1L AS company_id", "id AS seq", "'GIR' AS document_code", *[f"array('Guia IRS') AS {n}" for n, *_ in learned.ENRICHED])
    docs = spark.range(5).selectExpr("id AS doc_id", "1L AS company_id", "'x' AS name_text", "'guia irs' AS body_text")
    found = learned.enriched_hint(docs, prints)
    assert found.where("learned_score = 0.98").count() == 5
    assert "translate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no document does so for each term of each print


def test_taught_periods(spark):
    lines = [("Periodo", 10.0, 90.0), ("03/2025", 30.0, 90.0), ("Outro 01/2024", 10.0, 20.0)]
    rows = [
        (1, (None, [], 0.1, (1, 0.3, 0.9, "06/2025", None, None)), "maio 2025", "", "", ""),
        (2, (None, ["competencia"], 0.1, None), "valor pago 10/07/2025 competencia 05/2025", "", "", ""),
        (3, ("header", [], 0.9, None), "maio 2025", "Junho 2025", "", ""),
        (4, None, "maio 2025", "", "", ""),
        (5, (None, [], 0.1, (1, 0.3, 0.9, None, None, None)), "maio 2024", "", "", ""),
        (6, (None, [], 0.6, None), "nada", "", "", ""),
        (7, ("footer", [], 0.2, None), "maio 2025", "", "", ""),
    ]
    docs = spark.createDataFrame(rows, f"doc_id long, signal {dates.SIGNAL}, full string, header string, body string, footer string").withColumn("pages", F.lit(None).cast(dates.LAYOUT))
    docs = docs.withColumn("pages", F.array(F.struct(F.lit(1).alias("page"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y")) for t, x, y in lines]).alias("lines"))))
    got = {r["doc_id"]: r["learned"] and (r["learned"]["period"], r["learned"]["source"]) for r in dates.learned_period(docs).collect()}
    assert got == {1: (202506, "mark-nearby"), 2: (202505, "anchor-window"), 3: (202506, "zone"), 4: None, 5: (202503, "mark-nearby"), 6: None, 7: None}


def test_date_candidates_and_who_decides(spark):
    items = [(1, 1, 0, "Periodo", 0.1, 0.1), (1, 1, 1, "03/2025", 0.2, 0.1), (1, 1, 2, "pagamento 15.04.2025", 0.1, 0.9), (1, 5, 0, "01/2025", 0.1, 0.1), (2, 1, 0, "nada", 0.1, 0.1)]
    got = dates.date_candidates(spark.createDataFrame(items, "doc_id long, page int, seq int, text string, x double, y double")).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"], r["year"], r["month"], r["phrase"], r["x"], r["score"]) for r in got] == [(1, 1, 2025, 3, "03/2025", 0.2, 0.7), (1, 2, 2025, 4, "15.04.2025", 0.1, 0.35)]
    docs = spark.createDataFrame([(k, k == 5) for k in range(1, 6)], "doc_id long, failed boolean")
    period = lambda rows: spark.createDataFrame(rows, "doc_id long, period int")
    answers = spark.createDataFrame([(3, 202503, "marco"), (1, 202501, "x")], "doc_id long, period int, phrase string")
    again = dates.reclassified_months(docs, period([(1, 202506)]), period([(1, 202505), (2, 202504), (5, 202502)]), answers)
    assert {r["doc_id"]: (r["period"], r["source"], r["phrase"]) for r in again.collect()} == {1: (202506, "rules", None), 2: (202504, "rules", None), 3: (202503, "provider", "marco"), 4: (None, "unknown", None), 5: (None, "error", None)}
    items = spark.createDataFrame([("a", 1, "operator", 202401, "x"), ("b", 1, "rules", 202401, "06 junho"), ("c", 1, "rules", 202401, None), ("d", 4, "rules", None, None)], "source_hash string, doc_id long, route_source string, period int, sub_folder string")
    hints = spark.createDataFrame([("06 junho", 202506), ("x", 202505)], "sub_folder string, hint int")
    assert {r["source_hash"]: (r["period"], r["decided_by"]) for r in dates.month_priority(items, hints, again).collect()} == {"a": (202401, "operator"), "b": (202506, "folder"), "c": (202506, "rules"), "d": (None, "unknown")}


def test_self_validation(spark):
    rows = [(1, "GIR", ["guia"], [], [], ["guia irs"], [], [], ["retencao", "duc"]), (1, "LC", ["diario"], [], [], [], [], [], []), (2, "TV", ["banco"], [], [], [], [], [], []), (2, "EBV", ["banco"], [], [], [], [], [], ["extrato"])]
    schema = "company_id long, label string, required_terms array<string>, header_terms array<string>, tfidf_terms array<string>, ngrams array<string>, llm_descriptors array<string>, negative_terms array<string>, sample_tokens array<string>"
    got = {r["company_id"]: r for r in learn.validated(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["rounds"] == 1 and [p["recall"] for p in got[1]["prints"]] == [1.0, 1.0] and [p["precision"] for p in got[1]["prints"]] == [0.95, 0.5] or got[1]["rounds"] == 3
    two = {p["label"]: (p["recall"], p["required_terms"]) for p in got[2]["prints"]}
    assert got[2]["rounds"] == 3 and two["EBV"] == (1.0, ["banco", "extrato"]) and two["TV"][0] == 0.6  # a taken sample token parts them


def test_marks_and_anchors(spark):
    prints = spark.createDataFrame([(1, "GIR", None, ["Mes de", "ano"], 0.92), (1, "LC", "body", None, None)], "company_id long, document_code string, position string, anchor_phrases array<string>, detection_rate double")
    row = lambda df: {r["document_code"]: tuple(r)[2:5] for r in df.collect()}
    anchors = spark.createDataFrame([(1, "GIR", " ANO "), (1, "LC", "mes")], "company_id long, document_code string, phrase string")
    assert row(learn.with_anchor(prints, anchors)) == {"GIR": (None, ["ANO", "Mes de"], 0.95), "LC": ("body", ["mes"], 0.56)}
    zones = spark.createDataFrame([(1, "LC", "header")], "company_id long, document_code string, zone string")
    assert row(learn.with_zone(prints, zones)) == {"GIR": (None, ["Mes de", "ano"], 0.92), "LC": ("header", [], 0.5)}
    marks = spark.createDataFrame([(1, "GIR", 1, 0.5, 0.5, "06/2025", "Ano", "x" * 300), (1, "LC", 1, 1.5, 0.5, "a", "b", "c")], "company_id long, document_code string, page int, x double, y double, date_text string, label string, context_text string")
    got = {r["document_code"]: r for r in learn.with_mark(prints, marks).collect()}
    assert got["GIR"]["anchor_phrases"] == ["06/2025", "Ano", "x" * 220, "Mes de"] and got["GIR"]["mark"]["page"] == 1 and got["LC"]["mark"] is None and got["LC"]["detection_rate"] is None


def test_page_dates_and_likeness(spark):
    texts = [("pagina\n\nJunho 2025\nfim",), ("a\nb\nc\nd\ne\njunho 2025",), ("nada",), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").coalesce(1).select(segment.date_position("t")).collect()]
    assert got == ["body", "footer", None, None]
    edge = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, edge), (2, edge), (3, edge + " mais"), (4, "outra coisa qualquer aqui"), (5, None), (6, "")], "doc_id long, edge string")
    assert [(r["a"], r["b"]) for r in checks.like_headers(docs).collect()] == [(1, 3)]
    up = spark.createDataFrame([(1, 1, [("a", "h1"), ("b", "h2")]), (1, 2, [("a", "h1")]), (2, 3, [("c", "h1")]), (3, 4, [])], "company_id long, seq long, files array<struct<name:string,hash:string>>")
    gone = spark.createDataFrame([(1, "h1")], "company_id long, hash string")
    assert {r["seq"]: (len(r["files"]), r["deleted"]) for r in workspace.without_hashes(up, gone).collect()} == {1: (1, 1), 3: (1, 0), 4: (0, 0)}
    assert workspace.without_company(up, gone).count() == 2


def _plain(text):
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[_\-./:;()\[\]]+", " ", text)).strip()


def _rounds(prints):
    """Self-validation of one company's prints, print by print and term by term."""
    prints = [dict(p) for p in prints]
    pool = (("required_terms", 15, 0.5), ("header_terms", 10, 0.3), ("tfidf_terms", 12, 0.2), ("ngrams", 8, 0.45), ("llm_descriptors", 6, 0.4), ("negative_terms", 8, -0.25))
    told = lambda p, k: [t for t in map(_plain, p[k]) if t]
    for turn in (1, 2, 3):
        for p in prints:
            own = _plain(" ".join([*p["required_terms"], *told(p, "header_terms")[:8], *told(p, "tfidf_terms")[:10], *told(p, "ngrams")[:6], *told(p, "llm_descriptors")]))
            scores = [max(0.0, sum(w for k, n, w in pool for t in told(q, k)[:n] if t in own)) for q in prints]
            mine = scores[prints.index(p)]
            other = max([s for q, s in zip(prints, scores) if q is not p], default=0.0)
            p["recall"] = 0.0 if not own else 1.0 if mine > other else 0.6 if mine > 0 and mine > 0.7 * other else 0.0
            p["precision"] = mine / max(1.0, mine + other) if own and mine > 0 else 0.0
        recall, precision = (sum(p[k] for p in prints) / len(prints) for k in ("recall", "precision"))
        if recall >= 0.75 and precision >= 0.75 or turn == 3:
            return turn, (recall + precision) / 2, {p["label"]: (p["recall"], round(p["precision"], 6), p["required_terms"]) for p in prints}
        for p in prints:
            if p["recall"] < 0.75:
                p["required_terms"] = [*p["required_terms"], *[t for t in p["sample_tokens"] if t not in p["required_terms"]][:5]][:25]


def test_trained_companies_follow_the_rounds(spark):
    from docketry.plans import learning

    folder = "/root/testdata/sf0.001"
    few = "company_id IN (3, 7, 9)"
    rich = joins.held(learning.instances(spark, folder, True).where("company_id % 3 <> 0").where(few))
    plain = joins.held(learning.instances(spark, folder).where(few))
    rules = spark.createDataFrame([(c, 5 + c) for c in range(20)], "company_id long, rules_version long")
    got = {r["company_id"]: r for r in learn.trained_companies(rich, plain, rules).collect()}
    has = {r["company_id"] for r in rich.select("company_id").distinct().collect()}
    examples = rich.unionByName(plain.where(~F.col("company_id").isin([*has]) if has else F.lit(True)))
    by = {}
    for r in learn.fingerprints(examples).collect():
        by.setdefault(r["company_id"], []).append(r.asDict())
    assert got.keys() == by.keys() == {3, 7, 9} and has == {7}
    for company, prints in by.items():
        turn, quality, shown = _rounds(sorted(prints, key=lambda p: p["label"]))
        r = got[company]
        assert (r["rounds"], r["rules_version"]) == (turn, 6 + company) and abs(r["quality"] - quality) < 2e-6
        assert {p["label"]: (p["recall"], round(p["precision"], 6), p["required_terms"]) for p in r["prints"]} == shown
