"""Ledgers, structures, groups of like documents, and queries that have SQL of their own."""

import collections
import itertools
import random

import pytest
from docketry.operators import groups, joins, ledgers
from pyspark.sql import functions as F


def test_pages_are_in_one_place_each(spark):
    rows = lambda pages: spark.createDataFrame([("b", d, p) for d, p in pages], "batch_id string, document long, page long")
    taken = rows([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)])
    ledger = ledgers.page_ledger(taken, rows([(1, 1), (1, 2), (2, 1)]), rows([(2, 1)]), rows([(1, 1), (1, 1), (9, 9)]))
    assert {(r["document"], r["page"]): (r["state"], r["copies"]) for r in ledger.collect()} == {(1, 1): ("exported", 2), (1, 2): ("classified", 0), (2, 1): ("reviewed", 0), (2, 2): ("lost", 0), (3, 1): ("lost", 0), (9, 9): ("unexpected", 1)}
    r = ledgers.reconciliation(ledger).first()
    assert (r["input_pages"], r["exported_pages"], r["reviewed_pages"], r["waiting_pages"], r["lost_pages"], r["unexpected_pages"], r["doubled_pages"]) == (5, 1, 1, 1, 2, 1, 1)
    assert r["input_pages"] == r["exported_pages"] + r["reviewed_pages"] + r["waiting_pages"] + r["lost_pages"] and r["preserved"] == 0.4 and not r["enough"] and not r["reconciled"]
    none = rows([])
    assert ledgers.reconciliation(ledgers.page_ledger(taken, none, none, taken)).first()["reconciled"] and ledgers.page_ledger(none, none, none, none).count() == 0


def test_logical_documents(spark):
    schema = "file int, page int, kind string, continuation boolean, company_nif string, employee_nif string, entity string, period int, employee_kind boolean"
    rows = [
        (1, 1, "RV", True, "5", "1", "e", 202501, True), (1, 2, "RV", True, None, None, None, None, True), (1, 3, "RV", True, "5", "2", "e", 202501, True),
        (1, 4, "LC", None, "5", "3", "e", 202501, False), (1, 5, "LC", True, "5", "4", "e", 202501, False), (1, 6, "LC", True, "5", "4", "f", 202502, False), (1, 7, None, False, None, None, None, None, None),
    ]
    got = [(r["first_page"], r["pages"], r["kind"], r["reasons"], r["conflicts"]) for r in ledgers.logical_documents(spark.createDataFrame(rows, schema)).orderBy("document").collect()]
    assert got == [(1, 2, "RV", ["first_page"], 0), (3, 1, "RV", ["employee_nif"], 1), (4, 2, "LC", ["type"], 0), (6, 1, "LC", ["entity", "period"], 1), (7, 1, None, ["not_continued"], 0)]


def test_structure(spark):
    expected = spark.createDataFrame([(1, "GIR", 9, 1), (1, "LC", 2, 2), (1, "PIR", 12, 3), (1, "SSD", 8, 4)], "workspace_key long, code string, folder_number int, section_order int")
    folders = spark.createDataFrame([(1, 2, "LC", "approved"), (1, 9, "GIR", "passed"), (1, 12, "PIR", "approved"), (1, 13, "EBI", "approved"), (1, 8, "SSD", "review"), (1, 1, "RV", "approved")], "workspace_key long, folder_number int, code string, status string")
    sections = ledgers.structure_sections(expected, folders)
    assert [(r["code"], r["actual_position"], r["found"], r["order_match"]) for r in sections.orderBy("expected_position").collect()] == [("GIR", 1, True, True), ("LC", 0, True, False), ("PIR", 2, True, True), ("SSD", None, False, False)]
    r = ledgers.structure_summary(sections, folders, spark.createDataFrame([(1, 0.5)], "workspace_key long, quality double")).first()
    assert (r["coverage"], r["order_alignment"], r["missing"], r["unexpected"]) == (0.75, 0.666667, ["SSD"], ["EBI"]) and r["confidence"] == 0.675


def test_rules_under_correction_and_evidence(spark):
    uses = spark.createDataFrame([("a", k, "GIR") for k in range(20)] + [("b", 100 + k, "LC") for k in range(20)], "rule string, seq long, code string")
    fixes = spark.createDataFrame([(0, "LC", False), (1, "LC", False), (2, "LC", False), (3, "GIR", False), (100, "GIR", True)], "seq long, to_code string, high_value boolean")
    assert {r["rule"]: (r["corrections"], r["flagged"], r["proposals"]) for r in ledgers.rule_corrections(uses, fixes).collect()} == {"a": (3, True, 1), "b": (1, False, 1)}
    docs = spark.createDataFrame([("g", "RV", "E1"), ("g", "RV", "E2"), ("g", "GIR", "E1"), ("g", "EBV", None)], "group string, folder_code string, employee_code string")
    r = ledgers.evidence_checklist(docs, docs.where("folder_code = 'RV'")).first()
    assert "RV" not in r["missing"] and "TV" in r["missing"] and r["without_detail"] == ["EBV"] and r["uncovered_employees"] == 1


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, 200 + k) for k in range(30)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)] + [(rng.randrange(400, 440), rng.randrange(400, 440)) for _ in range(25)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["member"]: r["root"] for r in groups.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_like_pages_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    pages = pages.unionByName(pages.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 100_000)).unionByName(spark.createDataFrame([(900_000, None), (900_001, ""), (900_002, "two words")], "doc_id long, text string"))
    runs = {r["doc_id"]: set(r["runs"]) for r in groups.run_hashes(pages).collect()}
    alike = [(a, b) for a, b in itertools.combinations(sorted(runs), 2) if len(runs[a] & runs[b]) >= groups.LIKE * len(runs[a] | runs[b])]
    group = {r["doc_id"]: r["group_id"] for r in groups.alike_groups(pages).collect()}
    together = [group.get(a) is not None and group.get(a) == group.get(b) for a, b in alike]
    assert len(alike) > 30 and sum(together) >= 0.9 * len(alike)
    assert all(group[k] == group[k + 100_000] for k in range(3)) and not {900_000, 900_001, 900_002} & set(group)


def _roots(runs, like=groups.LIKE):
    """The smallest id that each text is joined to, by all pairs; texts that are alone are left out."""
    root = {k: k for k in runs}
    for a, b in itertools.combinations(sorted(runs), 2):
        shared = len(runs[a] & runs[b])
        if shared / (len(runs[a]) + len(runs[b]) - shared) >= like:
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    count = collections.Counter(root.values())
    return {k: (r, count[r]) for k, r in root.items() if count[r] > 1}


def test_no_pair_is_lost_between_bands(spark):
    texts = {}
    for k in (1, 2, 423, 822, 1268):  # pairs with a likeness of exactly 0.5; bands of minima pass over the last three
        mine = lambda part, n, k=k: [f"{part}{k}x{j}" for j in range(n)]
        texts[2 * k], texts[2 * k + 1] = " ".join(mine("s", 32) + mine("a", 15)), " ".join(mine("s", 32) + mine("b", 15))
    found = groups.alike_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["group_id"], r["members"]) for r in found} == {k: (k // 2 * 2, 2) for k in texts}


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_links_between_groups_against_all_pairs(spark, at_once):
    rng = random.Random(11)
    lines = [[rng.randrange(10**6) for _ in range(rng.randint(1, 12))] for _ in range(30)]  # some are on most documents
    runs = {}
    for k in range(120):
        shown = [line for j, line in enumerate(lines) if rng.random() < (0.9 if j < 4 else 0.2)]
        runs[k] = {x for line in shown for x in line} | {rng.randrange(10**6) for _ in range(rng.randint(1, 25))}
    runs[120], runs[121] = set(range(9)), set(range(9)) | set(range(100, 109))  # exactly 0.5
    group = {k: k - k % 3 if k < 60 else k for k in runs}
    docs = spark.createDataFrame([(k, group[k], sorted(r)) for k, r in runs.items()], "doc_id long, group_id long, runs array<long>")
    for like in (0.5, 0.3, 0.8):
        alike = {(a, b) for a, b in itertools.combinations(sorted(runs), 2) if group[a] != group[b] and len(runs[a] & runs[b]) / len(runs[a] | runs[b]) >= like}
        got = groups.links_between(docs, like, at_once).collect()
        assert alike and alike <= {tuple(sorted((r["a"], r["b"]))) for r in got} and len({frozenset((r["a"], r["b"])) for r in got}) == len(got)
        assert all((r["a_group"], r["b_group"]) == (group[r["a"]], group[r["b"]]) and r["a_group"] != r["b_group"] for r in got)


def test_groups_equal_those_of_all_pairs(spark):
    rng = random.Random(5)
    base = [f"w{j}" for j in range(40)]
    texts = {}
    for k in range(150):  # chains of texts that drift apart, copies, and lines that all show
        words = list(base) if k % 30 == 0 else texts[k - 1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(4000)}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    runs = {k: set(zip(*[t.split()[j:] for j in range(groups.RUN)])) for k, t in texts.items()}
    assert {r["doc_id"]: (r["group_id"], r["members"]) for r in groups.alike_groups(docs).collect()} == _roots(runs)


def test_texts_beside_a_large_table_do_not_need_its_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k % 3 if k % 7 else None, "t" * 50) for k in range(60)], "id int, company_id int, text string")
    taught = spark.createDataFrame([(c, [f"x{c}"] * 3) for c in range(2)], "company_id int, taught array<string>")
    want = sorted(map(str, joins.beside_texts(rows, taught, "company_id", "taught").select("id", "taught").collect()))
    monkeypatch.setattr(joins, "MOST_CHARACTERS", 1)
    assert sorted(map(str, joins.beside_texts(rows, taught, "company_id", "taught", salts=5).select("id", "taught").collect())) == want
    monkeypatch.setattr(joins, "MOST_ROWS", 1)
    assert joins.small(taught, 1) is taught and joins.small(taught, 2) is not taught


QUERIES = ["page_states", "page_reconciliation", "logical_documents", "structure_sections", "structure_summary", "rule_corrections", "evidence_checklist", "provider_costs", "missing_folders", "like_pages", "resolved_payslips", "opened_months", "date_candidates", "taught_periods", "month_decisions", "taught_signals", "enriched_hints", "example_similarity", "learning_layers", "section_descriptors", "learning_coverage", "month_items", "workflow_counters", "pending_reviews", "applied_periods", "built_documents", "year_cards", "upload_totals", "folder_sequence", "section_context"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "conversations", "pages", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder)
    cols = [f'"{c}"' for c in sorted(got.columns)]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*[c.strip('"') for c in cols]).collect()))) == sorted(map(str, want))
