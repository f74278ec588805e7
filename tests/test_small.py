"""Small operators and scalars worked by hand."""

import datetime
import json

from docketry.functions import text
from docketry.operators import cluster, decisions, workspace
from docketry.sources import files
from pyspark.sql import functions as F

DAY = datetime.datetime(2025, 1, 1)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    one = lambda sql: value(spark, F.expr(sql))
    assert one(text.normal_folder("'  Março__2025 / Pasta-03 '")) == "marco 2025 pasta 03"
    assert value(spark, text.top_tokens(F.lit("guia irs guia total 2025 ab irs guia banco"))) == ["guia", "irs", "banco"]
    many = " ".join(f"w{k:03d}" for k in range(60)) + " w059"
    assert value(spark, text.top_tokens(F.lit(many))) == ["w059", *[f"w{k:03d}" for k in range(44)]]
    assert value(spark, text.file_tokens(F.lit("02_Listagem-GERAL de ação.v2.PDF"))) == ["listagem", "geral"]
    assert value(spark, text.file_tokens(F.lit(" ".join(f"tok{k}" for k in range(12)) + ".pdf"))) == [f"tok{k}" for k in range(8)]
    assert (value(spark, text.month_key(F.lit(2025), F.lit(3))), value(spark, text.month_key(F.lit(2025), F.lit(3), True))) == ("202503", "2025-03")
    assert value(spark, text.clean_hints(F.array(F.lit(" nif 123456789 "), F.lit("  "), *[F.lit(f"h{k}") for k in range(20)]))) == ["nif [NIF]", *[f"h{k}" for k in range(11)]]
    status = lambda upload, item, confidence, month: value(spark, text.file_status(F.lit(upload), F.lit(item), F.lit(confidence), F.lit(month).cast("int")))
    assert [status("submitted", False, None, 3), status("submitted", True, 0.5, None), status("submitted", True, 0.9, None), status("processing", False, None, None), status("ready", False, None, None), status("submitted", False, None, None)] == ["Month detected", "Needs review", "Grouped", "Processing pending", "Ready", "Submitted"]
    names = lambda *keys: value(spark, text.bundle_name(F.array(*map(F.lit, keys)).cast("array<string>")))
    assert (names("2025-01"), names("2025-01", "2025-02", "2025-04"), names()) == ("base_2025-01", "base_2025-01_to_2025-04", None)
    kind = lambda declared, name: value(spark, text.media_type(F.lit(declared), F.lit(name)))
    assert [kind("image/png", "a.pdf"), kind("", "A.PDF"), kind(None, "b.jpeg"), kind("", "c.txt")] == ["image/png", "application/pdf", "image/jpeg", ""]


def test_signals_periods_and_activity(spark):
    prints = spark.createDataFrame([(1, "GIR", ["mes"], "m", 0.8), (1, "LC", None, None, None), (1, "PIR", None, None, 0.5)], "company_id long, document_code string, anchor_phrases array<string>, mark string, detection_rate double")
    assert {r["document_code"]: (r["anchor_phrases"], r["has_mark"], r["detection_rate"]) for r in cluster.period_signals(prints).collect()} == {"GIR": (["mes"], True, 0.8), "PIR": ([], False, 0.5)}
    spaces = spark.createDataFrame([(1, 2025), (2, 2024)], "workspace_key long, year int")
    detected = spark.createDataFrame([(1, 2025, 1), (1, 2025, 2)], "workspace_key long, year int, month int")
    keys = spark.createDataFrame([(1, "2025-02"), (1, "2025-03"), (2, "2025-02")], "workspace_key long, period_key string")
    months = spark.createDataFrame([(1, 7), (2, 5)], "workspace_key long, month int")
    assert sorted(tuple(r) for r in workspace.selected_periods(spaces, detected, keys, months).collect()) == [(1, 2025, 2), (2, 2024, 5)]
    trained = spark.createDataFrame([(1, 4, 0.705), (2, 3, 0.6999)], "company_id long, n int, quality double")
    assert {r["company_id"]: (r["text"], r["tone"]) for r in workspace.training_activity(trained).collect()} == {1: ("4 fingerprints trained, quality 71%", "success"), 2: ("3 fingerprints trained, quality 70%", "warning")}


def test_inbox_and_statuses_by_hash(spark):
    schema = "company_id int, year int, folder_number int, status string, seq long, files array<struct<name:string,hash:string,url:string>>"
    up = spark.createDataFrame([(1, 2025, 0, "submitted", 1, [("a", "h1", "u"), ("b", "h2", "")]), (1, 2025, 0, "archived", 2, [("c", "h1", "u")]), (1, 2025, 3, "submitted", 3, [("d", "h3", "u")]), (1, 2024, 0, "submitted", 4, [("e", "h4", None)])], schema)
    assert [(r["seq"], r["name"]) for r in workspace.inbox_files(up, 1, 2025).collect()] == [(1, "a")]
    done = decisions.set_status_by_hash(up, spark.createDataFrame([("h1",), ("h1",), ("zz",)], "hash string"), "approved")
    assert {r["seq"]: r["status"] for r in done.collect()} == {1: "approved", 2: "approved", 3: "submitted", 4: "submitted"}
    tables = {"reviews": spark.createDataFrame([(1, "h1", 5), (1, "h2", 6), (2, "h1", 7)], "workspace_key int, source_hash string, seq int"), "cache": spark.createDataFrame([("h1", "GIR"), ("h9", "LC")], "source_hash string, code string")}
    left = decisions.without_files(tables, spark.createDataFrame([(1, "h1")], "workspace_key int, source_hash string"))
    assert sorted(r["seq"] for r in left["reviews"].collect()) == [6, 7] and [r["source_hash"] for r in left["cache"].collect()] == ["h9"]


def test_catalog_limits_and_call_log(spark, tmp_path):
    for name, body in {"1/2025/x": json.dumps({"id": "x", "company_id": "1", "year": 2025, "folder_number": 3, "status": "submitted", "files": [{"name": "a.pdf", "size": 5}]}), "1/2025/y": "{broken", "1/2025/z": json.dumps({"company_id": "1"})}.items():
        (tmp_path / "up" / name).mkdir(parents=True)
        (tmp_path / "up" / name / "metadata.json").write_text(body)
    (tmp_path / "up/1/2025/x/other.json").write_text('{"id": "no"}')
    assert [(r["id"], r["files"][0]["size"]) for r in files.upload_catalog(spark, str(tmp_path / "up")).collect()] == [("x", 5)]
    batch = spark.createDataFrame([("a", 10, "application/pdf"), ("a", 15, "image/png"), ("b", 16, "application/pdf"), ("c", 1, "text/plain"), *[("d", 1, "image/jpeg")] * 3], "batch_id string, size long, content_type string")
    assert {r["batch_id"]: r["accepted"] for r in files.intake_limits(batch, 15, 25, 2).collect()} == {"a": True, "b": False, "c": False, "d": False}
    calls = spark.createDataFrame([("1", "b1", "first", "GIR", "success", 5, 6, 7, 0.5, DAY), ("2", "b2", "first", "GIR", "failed", 0, 0, 9, 0.0, DAY)], files.CALL_SCHEMA)
    files.append_calls(calls, str(tmp_path / "log"))
    files.append_calls(calls.where("id = '2'"), str(tmp_path / "log"))
    log = files.call_log(spark, str(tmp_path / "log"))
    assert sorted((r["batch_id"], r["input_tokens"]) for r in log.collect()) == [("b1", 5), ("b2", 0), ("b2", 0)]
