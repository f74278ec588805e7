"""Decisions, phrases, votes and checks on hand-worked tables; report queries against their SQL."""

import pytest

from docketry.operators import decisions, learn, quality, reports


def test_decisions_move_counters_and_the_last_one_names_the_status(spark):
    status = spark.createDataFrame([(1, 2, 1, 1), (1, 3, 5, 2), (1, 4, 0, 0), (1, 5, 2, 0)], "workspace_key long, folder_number int, document_count long, review_count long")
    made = spark.createDataFrame([(1, 1, 2, 3, True, 7), (1, 2, 2, 3, True, 7), (1, 3, 5, 9, False, 8)], "workspace_key long, seq long, from_folder int, to_folder int, approved boolean, source_hash long")
    got = {r["folder_number"]: tuple(r)[2:] for r in decisions.decide(status, made).collect()}
    assert got == {2: (0, 0, 0, "missing"), 3: (7, 0, 7, "approved"), 4: (0, 0, 0, "missing"), 5: (2, 0, 0, "passed")}
    known = spark.createDataFrame([(1, 9)], "workspace_key long, source_hash long")
    assert [tuple(r) for r in decisions.newly_approved(known, made).collect()] == [(1, 7, 3)]
    assert decisions.decide(status.where("false"), made.where("false")).count() == 0


def test_files_leave_only_their_own_folders(spark):
    docs = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "c", 3), (2, "a", 2)], "workspace_key long, source_hash string, folder_number int")
    gone = spark.createDataFrame([(1, "a"), (1, "c"), (1, "a")], "workspace_key long, source_hash string")
    assert sorted(map(tuple, decisions.remove_files(docs, gone).collect())) == [(1, 2, 1, 1, "approved"), (1, 3, 0, 1, "missing")]


def test_gate_and_status_changes(spark):
    asked = spark.createDataFrame([(1, "e"), (1, "f"), (2, "e"), (1, "x"), (3, None)], "workspace_key long, employee string")
    bundles = spark.createDataFrame([(1, "current"), (2, "blocked")], "workspace_key long, status string")
    people = spark.createDataFrame([(1, "e", "current"), (1, "f", "ready")], "workspace_key long, employee string, final_status string")
    got = {(r["workspace_key"], r["employee"]): r["result"] for r in decisions.output_gate(asked, bundles, people).collect()}
    assert got == {(1, "e"): "ok", (1, "f"): "final bundle is not current", (1, "x"): "unknown employee", (2, "e"): "base bundle is not current", (3, None): "base bundle is not current"}
    up = spark.createDataFrame([(1, 1, 2025, "submitted"), (2, 1, 2024, "submitted"), (None, 1, 2025, None)], "seq long, company_id int, year int, status string")
    assert sorted(str(r["status"]) for r in decisions.archive_year(up, 1, 2025).collect()) == ["archived", "archived", "submitted"]
    assert sorted(str(r["status"]) for r in decisions.set_upload_status(up, up.where("seq = 2"), "grouped").collect()) == ["None", "grouped", "submitted"]


def test_phrases_and_negative_terms(spark):
    words = [(1, s, k, w) for s, text in (("A", "red fox runs red fox sits"), ("B", "fox runs blue blue bluebird bluebird red")) for k, w in enumerate(text.split())]
    tokens = spark.createDataFrame(words, "reference_id int, section string, seq int, token string")
    assert learn.exclusive_phrases(tokens).count() == 0  # `red fox` occurs twice, but both words are in B too
    alone = tokens.where("section = 'A'")
    assert [(r["phrase"], r["hits"]) for r in learn.exclusive_phrases(alone).collect()] == [("red fox", 2)]
    rivals = spark.createDataFrame([("A", "B", 1), ("B", "A", 1)], "section string, competitor string, place int")
    assert [(r["section"], r["token"]) for r in learn.negative_terms(tokens, rivals).orderBy("rank").collect()] == [("A", "blue"), ("A", "bluebird")]


def test_votes_and_checks(spark):
    signals = spark.createDataFrame([("s", 1, "a", None), ("s", 2, "b", "header"), ("s", 3, None, None), ("t", 1, None, None), ("t", 2, None, "body"), ("t", 3, "a", None)], "section string, seq int, format string, position string")
    assert [tuple(r) for r in learn.period_vote(signals).collect()] == [("s", "a", "body", 0.666667)]
    roster, paid = (spark.createDataFrame([(1, e) for e in names], "batch_id int, employee_code string") for names in (["a", "b", None], ["b", "c", "c"]))
    assert sorted((r["employee_code"], r["issue"][:7]) for r in quality.roster_check(roster, paid).collect()) == [("a", "missing"), ("c", "unexpec")]
    months = spark.createDataFrame([(1, p, 40, 40 + (p == 1)) for p in (1, 2, 3, 4)], "company_id int, period int, approved long, reviewed long")
    assert [r["mature"] for r in quality.mature_companies(months).orderBy("period").collect()] == [False, False, True, True]
    queue = spark.createDataFrame([(1, 2, 5), (1, 2, 7), (1, 3, 6)], "workspace_key int, folder_number int, seq int")
    assert {r["seq"]: r["next_seq"] for r in reports.next_of_same_code(queue).collect()} == {5: 7, 7: None, 6: None}


@pytest.mark.parametrize("name", ["upload_years", "upload_totals", "folder_panel", "folder_cards", "folder_sums", "scan_report", "decide_reviews", "newly_approved", "confirm_items", "final_plan", "remove_files", "exclusive_phrases", "negative_terms", "period_vote", "compliance_order", "roster_check", "mature_companies"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))
