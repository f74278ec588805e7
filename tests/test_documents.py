"""Period cases, normal forms, text scalars, segmentation and state on hand-worked tables."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions.period import folder_period, period, routing_period
from docketry.operators import classify, cluster, learn, quality, segment, state
from docketry.sources import files

PERIODS = [
    ("01/2025", 202501), ("02/2026", 202602), ("12/2024", 202412), ("Janeiro 2025", 202501), ("Fevereiro 2026", 202602), ("Março 2024", 202403), ("Abril 2025", 202504), ("Maio 2026", 202605),
    ("Junho 2025", 202506), ("Julho 2025", 202507), ("Agosto 2024", 202408), ("Setembro 2025", 202509), ("Outubro 2025", 202510), ("Novembro 2025", 202511), ("Dezembro 2025", 202512),
    ("Vencimento 01 2025", 202501), ("Salario 12 2024", 202412), ("Jan 2025", 202501), ("Dez 2025", 202512), ("Subsidio Alimentacao Junh 2025", 202506), ("2025", None), ("Invoice document", None), ("Jan 2019", None), ("Jan 2099", None), ("Relatório 2025", None),
    ("Recibo de Vencimento Janeiro 2025", 202501), ("06-2025", 202506), ("15.03.2025", 202503), ("Subsídio Alimentação 03 2025", 202503), ("Sub Refeicao Mar 2025", 202503), ("Cartao Refeicao Junh 2025", 202506), ("Janeiro 2019", None), ("Dezembro 2099", None), ("Comprovativo de Pagamento", None),
    ("Marc\u0327o 2025", 202503), ("Mar\u00e7o 2025", 202503), ("Setembro\u00a02025", 202509), ("MARÇO DE 2024", 202403),
    ("Periodo 2025 12", 202501), ("Periodo 12/2025", 202512), ("Dezembro 2037", 203712), ("vencimento 05 2037 ref 2025 03", None), ("Cartao Refeicao Junh-D46RP717 04-07-2025", 202506), ("pagina outubro saldo e mais texto sem nada a ver aqui 30.09.2025", 202509),
]


def test_periods(spark):
    df = spark.createDataFrame(PERIODS, "t string, want int").withColumn("got", period("t"))
    assert df.where("NOT (want <=> got)").collect() == []


def test_exact_months(spark):
    assert spark.createDataFrame([("Periodo 2025 12",)], "t string").select(period("t", exact_months=True)).first()[0] == 202512


def test_normal_forms_and_scalars(spark):
    df = spark.createDataFrame([("Março 2025", "01/02/2025")], "a string, b string")
    assert tuple(df.select(F.expr(T.normal_period("a")), F.expr(T.normal_period("b"))).first()) == ("marco 2025", "01 02 2025")
    one = spark.createDataFrame([("Acme & Filhos, Lda", "09_GIR_x.pdf", "243581902", None)], "a string, b string, c string, d int")
    got = one.select(T.slug(F.col("a")), T.safe_segment(F.lit("//")), T.folder_prefix(F.col("b")), T.is_tax_number(F.col("c")), T.display_code(F.col("a"), F.lit(3), F.col("d"), F.lit(7)), T.redacted(F.lit("x  243581902 y")), T.loose_boolean(F.lit(" Sim "))).first()
    assert tuple(got) == ("acme-filhos-lda", "item", 9, True, "ACMEFILH-F03-UNK-07", "x [NIF] y", True)
    assert spark.range(1).select(folder_period(F.lit("03 marco"), 2025), folder_period(F.lit("2024-11"), 2025), folder_period(F.lit("fotos"), 2025)).first()[:] == (202503, 202411, None)


ROUTING = [
    # the routing rules after the period rules have found nothing
    ("vencimento 05 2037 ref periodo 2025 03", 202503), ("vencimento 05 2037 maio 2025", 202505), ("vencimento 05 2037 2025 03 periodo", 202503), ("vencimento 05 2037 202504", 202504), ("vencimento 05 2037 data valor 15 03 2025", 202503), ("vencimento 05 2037 data emissao 2025 03 15", 202503),
    ("vencimento 05 2037", None), ("06/2025", 202506), (None, None), ("", None),
]


def test_routing_periods(spark):
    df = spark.createDataFrame(ROUTING, "t string, want int").withColumn("got", routing_period("t"))
    assert df.where("NOT (want <=> got)").collect() == []


# doc_id, file name, body, (code, confidence, stage, year, month) asked for June 2025, worked by hand
ROUTES = [
    (1, "a.pdf", "Dados da operação pagamento TSU 06/2025", ("PSS", 0.68, "proof", 2025, 6)),
    (2, "b.pdf", "Dados da operação Multi Imposto março 2024", ("PIR", 0.64, "proof", 2024, 3)),
    (3, "c.pdf", "Extrato conta período 03/2025 autoridade tributária", ("EBI", 0.58, "proof", 2025, 3)),
    (4, "d.pdf", "Entrega de ficheiro de remunerações - extrato de resumo", ("SSR", 0.66, "proof", None, None)),
    (5, "m.pdf", "mapa de liquidação de IRS 202504", ("LIR", 0.66, "proof", 2025, 4)),
    (6, "05_TSA_cartao.pdf", "junho 2025", ("TSA", 0.88, "hint", 2025, 6)),  # 0.54 + 0.5, held at 0.88
    (7, "x.pdf", "cartao refeicao maio 2025", ("UNKNOWN", 0.35, "unknown", 2025, 5)),  # terms in the text: 0.2; weak hit: 0.05
    (8, "cartao refeicao.pdf", "maio 2025", ("TSA", 0.44, "hint", 2025, 5)),
    (9, "doc.pdf", "recibo de remunerac Junho 2025", ("RV", 0.64, "payslip", 2025, 6)),
    (10, "lancamento contabil.pdf", "balancete junho 2025", ("LC", 0.44, "hint", 2025, 6)),
    (11, "transferencia.pdf", "transferencia vencimento junho 2025", ("TV", 0.63, "pattern", 2025, 6)),  # 0.36 + 0.08 + 2 x 0.05, and 0.04 + 0.05 for the period
    (12, "x.pdf", "nada", ("UNKNOWN", 0.35, "unknown", None, None)),
    (13, None, None, ("UNKNOWN", 0.35, "unknown", None, None)),
]


def test_routes_worked_by_hand(spark):
    docs = spark.createDataFrame([r[:3] for r in ROUTES], "doc_id long, file_name string, body string")
    got = {r["doc_id"]: (r["document_code"], round(r["confidence"], 6), r["stage"], r["target_year"], r["target_month"]) for r in classify.local_route(docs, 2025, 6).collect()}
    assert got == {r[0]: r[3] for r in ROUTES}
    buckets = {r["bucket"]: r["items"] for r in cluster.buckets(classify.local_route(docs, 2025, 6)).collect()}
    assert len(buckets) == 14 and sum(buckets.values()) == 13 and buckets["OUTLIERS"] == 0 + sum(r[3][0] == "UNKNOWN" for r in ROUTES)


def test_learned_branches_and_periods(spark):
    marks = lambda code, period, rated=True: {code: (period, rated)}
    rows = [
        (1, "a.pdf", "dados da operacao pagamento tsu 05/2025", None, None, marks("PSS", 202506), None, None),  # the mark's period, +0.1
        (2, "a.pdf", "dados da operacao pagamento tsu 06/2025", None, None, marks("PSS", 202505), None, None),  # another period: -0.15
        (3, "a.pdf", "dados da operacao pagamento tsu 06/2025", None, None, marks("PSS", None), None, None),  # mark without result: text's period
        (4, "x.pdf", "nada 06/2025", "GIR", 0.5, None, None, None),  # learned section: +0.04 + 0.05
        (5, "x.pdf", "nada 05/2025", "GIR", 0.5, None, None, None),  # +0.04 - 0.18
        (6, "x.pdf", "nada 05/2025", "GIR", 0.3, marks("GIR", 202506), None, None),  # 0.38 + 0.1
        (7, "x.pdf", "nada 05/2025", "GIR", 0.5, marks("GIR", 202504), None, None),  # - 0.25
        (8, "x.pdf", "nada", None, None, None, None, True),  # scanned
        (9, "guia.pdf", "guia retencao na fonte autoridade tributaria", None, None, marks("GIR", 202506, False), {"GIR": 1.0}, None),
    ]
    schema = "doc_id long, file_name string, body string, learned_code string, learned_score double, learned_periods map<string,struct<period:int,rated:boolean>>, example_scores map<string,double>, ocr boolean"
    docs = spark.createDataFrame(rows, schema)
    got = {r["doc_id"]: (r["document_code"], round(r["confidence"], 4), r["stage"], r["target_month"]) for r in classify.local_route(docs, 2025, 6).collect()}
    assert [got[k] for k in range(1, 9)] == [("PSS", 0.78, "proof", 6), ("PSS", 0.53, "proof", 5), ("PSS", 0.68, "proof", 6), ("GIR", 0.59, "learned", 6), ("GIR", 0.36, "learned", 5), ("GIR", 0.48, "learned", 6), ("GIR", 0.25, "learned", 4), ("UNKNOWN", 0.18, "unknown", None)]
    assert got[9][0] == "GIR" and got[9][3] is None  # a mark that is not rated does not date a pattern's route
    layers = {r["doc_id"]: r["layer"] for r in cluster.with_layer(classify.local_route(docs, 2025, 6)).collect()}
    assert layers[1] == "unmatched" and layers[4] == "learned_sections" and layers[8] == "pdf_text_layout"
    traces = {(r["doc_id"], r["layer"]): r["status"] for r in cluster.funnel_traces(classify.local_route(docs, 2025, 6)).collect()}
    assert traces[4, "cache"] == "missed" and traces[4, "filename_taxonomy"] == "skipped" and traces[1, "learned_sections"] == "missed" and traces[1, "cache"] == "skipped" and traces[8, "cluster_bucket"] == "rejected"
    assert len(traces) == 9 * 8


def _sequential(pages):
    out, state_code = [], None
    numbers = {"LC": 2, "GIR": 9, "EBV": 4, "PIR": 12, "SSD": 8, "EBI": 13}
    for page, strong, bank, cont in pages:
        if strong:
            state_code = strong
            out.append((page, strong))
        elif state_code and bank and numbers[state_code] >= 9:
            state_code = "EBI"
            out.append((page, "EBI"))
        elif state_code and cont and state_code in ("LC", "EBV", "EBSA", "SSD", "EBI"):
            out.append((page, state_code))
    return out


def test_page_labels_follow_the_sequential_rule(spark):
    import random

    rng = random.Random(3)
    rows = [(ref, p, rng.choice(["LC", "GIR", "EBV", "PIR", "SSD", None, None, None, None]), rng.random() < 0.4, rng.random() < 0.5) for ref in range(60) for p in range(1, 15)]
    df = spark.createDataFrame(rows, "reference_id int, page int, strong_code string, bank boolean, continuation boolean")
    got = sorted((r["reference_id"], r["page"], r["label"]) for r in segment.label_pages(df).collect())
    assert got == sorted((ref, p, c) for ref in range(60) for p, c in _sequential([r[1:] for r in rows if r[0] == ref]))


def test_learning(spark):
    terms = spark.createDataFrame([("A", i, "x") for i in range(3)] + [("A", i, "z") for i in range(5)] + [("A", 0, "y"), ("A", 0, "")], "section string, instance int, term string")
    assert {r["term"]: r["kind"] for r in learn.term_coverage(terms).collect()} == {"x": "required", "y": "optional", "z": "required"}
    sections = spark.createDataFrame([(k, "LC", k) for k in (1, 2, 3, 4)], "reference_id int, code string, pages long")
    assert learn.folder_requirements(sections).first()["expected_pages"] == 3


def test_state(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, state.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    expected = spark.createDataFrame([(1, c, k) for k, c in enumerate("ABCDE")], "reference_id int, code string, section_order int")
    actual = spark.createDataFrame([(1, "A", 0), (1, "B", 3), (1, "C", 1), (1, "D", 4)], "reference_id int, code string, position int")
    got = {r["code"]: (r["found"], r["order_match"]) for r in state.structure_check(expected, actual).collect()}
    assert got == {"A": (True, True), "B": (True, True), "C": (True, False), "D": (True, True), "E": (False, False)}
    same = spark.createDataFrame([(2, "a"), (2, "b")], "group_no int, file_name string")
    assert not state.snapshot_changes(same, same.orderBy(F.desc("file_name"))).first()["changed"]
    assert quality.correction_patterns(spark.createDataFrame([("A", "B")] * 3 + [("A", "C")], "from_code string, to_code string")).count() == 1


def test_sources(spark, tmp_path):
    names = spark.createDataFrame([("BJ_202601_acme.pdf",), ("CF_202601_E1_A_acme.pdf",), ("other.pdf",)], "file_name string")
    assert [(r["kind"], r["employee"], r["company"]) for r in files.generated_files(names, "acme").collect()] == [("base", None, "acme"), ("final", "E1_A", "acme")]
    assert files.call_log(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    assert files.content_hashes(spark, str(tmp_path)).count() == 1


def test_streamed_totals_equal_batch(spark, tmp_path):
    from docketry.streaming import streams

    rows = spark.sql("SELECT 'p' AS provider_id, 'ok' AS status, id AS input_tokens, id AS output_tokens, timestamp'2025-01-01' + make_interval(0, 0, 0, 0, id) AS timestamp FROM range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    query = streams.call_totals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, streams.call_totals(rows).collect()))


@pytest.mark.parametrize("name", ["batch_statistics", "month_grid", "snapshot_changes", "page_labels", "tf_idf_terms"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))
