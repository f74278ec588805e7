"""State sources, keyed tables under replay, the content store, and streams that stop and start again."""

import datetime
import hashlib
import json
import os

from docketry.operators import state as operators
from docketry.sources import files, state
from docketry.streaming import streams
from pyspark.sql import functions as F

DAY = datetime.datetime(2025, 1, 1)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_state_documents_round_trip(spark, tmp_path):
    value = "company_id string, year int, folders array<struct<number:int,status:string>>, approved_documents array<string>"
    assert state.state_rows(spark, str(tmp_path / "none"), value).count() == 0
    old = {"workspaces": {"p:c:2025:1": {"company_id": "c", "year": 2025, "folders": [{"number": 2, "status": "missing"}]}, "p:c:2025:2": {"company_id": None, "year": 2025, "folders": [], "approved_documents": ["h"]}}}
    old["workspaces"] |= {f"p:c:2024:{m}": {"company_id": "c", "year": 2024, "folders": []} for m in range(1, 13)}
    (tmp_path / "state.json").write_text(json.dumps(old, indent=2))
    rows = state.state_rows(spark, str(tmp_path / "state.json"), value)
    got = {r["key"]: r for r in rows.collect()}
    assert got["p:c:2025:1"]["approved_documents"] == [] and got["p:c:2025:2"]["approved_documents"] == ["h"] and got["p:c:2025:1"]["folders"][0]["status"] == "missing"
    state.write_state(rows, str(tmp_path / "out"), 3)
    assert rows_of(state.state_rows(spark, str(tmp_path / "out"), value)) == rows_of(rows)
    maps = spark.read.text(str(tmp_path / "out")).collect()
    assert len(maps) == 3 and all(json.loads(r["value"])["workspaces"] for r in maps)  # one document each, none with all keys


def test_batches_replace_themselves_only(spark, tmp_path):
    path = str(tmp_path / "batches")
    assert state.read_batches(spark, path).count() == 0
    docs = [(b, "c", 2025, 1, DAY, k, f"{b}-{k}", f"h{k}", f"{k}.pdf", "GIR", 9, 0.5 + 0.2 * k, 2, None, False) for b in ("x", "y") for k in range(3)]
    schema = "batch_id string, company_id string, year int, month int, created_at timestamp, seq int, doc_id string, source_hash string, filename string, folder_code string, folder_number int, confidence double, page_count bigint, employee_code string, cache_hit boolean"
    batches = state.batch_rows(spark.createDataFrame(docs, schema))
    state.write_batches(batches, path)
    back = state.read_batches(spark, path)
    assert rows_of(back.select(*batches.columns)) == rows_of(batches) and back.where("approved_count = 1 AND review_count = 2 AND total_pages = 6").count() == 2
    state.write_batches(batches.where("batch_id = 'x'").withColumn("company_id", F.lit("new")), path)
    assert {(r["batch_id"], r["company_id"]) for r in state.read_batches(spark, path).collect()} == {("x", "new"), ("y", "c")}


def test_cache_hits(spark, tmp_path):
    path = str(tmp_path / "hits")
    hits = spark.createDataFrame([("a", "GIR", 0.0, DAY, None), ("b", "LC", None, DAY, "E1"), ("c", "LC", 0.4, DAY, None)], "source_hash string, document_code string, confidence double, timestamp timestamp, employee_code string")
    assert state.hit_log(spark, path).count() == 0
    state.append_hits(hits, path)
    state.append_hits(hits.where("source_hash = 'c'"), path)
    assert sorted((r["source_hash"], r["confidence"], r["hit_count"]) for r in state.hit_log(spark, path).collect()) == [("a", 0.85, 1), ("b", 0.85, 1), ("c", 0.4, 1), ("c", 0.4, 1)]
    assert files.call_log(spark, str(tmp_path / "calls")).count() == 0


def test_contents_are_stored_once(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for name, content in (("a.pdf", b"one"), ("b.PNG", b"two"), ("c.pdf", b"one"), ("empty.jpg", b"")):
        (source / name).write_bytes(content)
    read = lambda: spark.read.format("binaryFile").load(str(source))
    state.store_contents(read(), root)
    state.store_contents(read(), root)
    (source / "d.jpeg").write_bytes(b"three")
    state.store_contents(read(), root)
    got = {r["hash"]: r for r in state.stored_contents(spark, root).collect()}
    assert state.stored_contents(spark, root).count() == 3 == len(got)  # the reader passes an empty file over
    one = got[hashlib.sha256(b"one").hexdigest()]
    assert (one["name"], one["media_type"], bytes(one["content"]), one["length"], one["shelf"]) == ("a.pdf", "application/pdf", b"one", 3, one["hash"][:2])
    assert got[hashlib.sha256(b"two").hexdigest()]["media_type"] == "image/png" and got[hashlib.sha256(b"three").hexdigest()]["media_type"] == "image/jpeg"


def test_listing_and_report(spark, tmp_path):
    up = spark.createDataFrame([("b", 1, 2025, 3, DAY), ("a", 1, 2025, 2, DAY), ("c", 2, 2025, 9, DAY)], "id string, company_id int, year int, folder_number int, submitted_at timestamp")
    assert {r["id"]: r["place"] for r in files.listed(up).collect()} == {"a": 1, "b": 2, "c": 1}
    items = spark.createDataFrame([("GIR", "x.pdf"), ("OUTLIERS", "y.pdf")], "bucket string, file_name string")
    buckets = spark.createDataFrame([(9, "GIR", 1, 0.5), (99, "OUTLIERS", 1, 0.1)], "number int, bucket string, items int, average_confidence double")
    files.write_report(items, buckets, str(tmp_path / "report"))
    assert rows_of(spark.read.json(str(tmp_path / "report/items")).select("bucket", "file_name")) == rows_of(items)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report/table")).collect()] == ["| 09 | GIR | 1 | 0.50 |", "| 99 | OUTLIERS | 1 | 0.10 |"]


COUNTS = "workspace_key long, n long, last string, seq long"


def counted(old, new):
    """A transition that would go wrong if it were applied twice."""
    return F.struct(new["workspace_key"].alias("workspace_key"), (F.coalesce(old["n"], F.lit(0)) + new["n"]).alias("n"), new["last"].alias("last"), new["seq"].alias("seq"))


def test_keyed_table_under_replay(spark, tmp_path):
    table = state.KeyedTable(spark, str(tmp_path / "t"), COUNTS, ["workspace_key"], buckets=4)
    batches = [[(1, 1, "a", 1), (2, 5, "b", 2), (1, 2, "c", 3)], [(1, 10, "d", 4), (9, 7, "e", 5)], []]
    frames = [spark.createDataFrame(b, COUNTS) for b in batches]
    assert table.read().count() == 0
    for k, f in enumerate(frames):
        table.apply(f, k, order="seq", merge=counted)
    want = {1: (12, "d"), 2: (5, "b"), 9: (7, "e")}
    read = lambda: {r["workspace_key"]: (r["n"], r["last"]) for r in table.read().collect()}
    assert read() == want
    for k in (1, 0, 1):  # replayed batches, and older ones, change nothing
        table.apply(frames[k], k, order="seq", merge=counted)
        assert read() == want
    table.apply(spark.createDataFrame([(2, 1, "z", 9)], COUNTS), 3)
    assert read() == want | {2: (1, "z")}
    keyed = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert rows_of(operators.upsert(keyed, keyed.where("k = 2").withColumn("v", F.lit("w")), ["k"])) == ["Row(k=1, v='x')", "Row(k=2, v='w')"]


def forget_last_commit(checkpoint):
    """As if the driver had been lost between a batch's work and its acknowledgement."""
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")


def test_upsert_stream_that_loses_its_last_commit(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    table = state.KeyedTable(spark, str(tmp_path / "t"), COUNTS, ["workspace_key"], buckets=4)
    spark.createDataFrame([(k % 3, 1, "a", k) for k in range(6)], COUNTS).groupBy("workspace_key").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("seq").alias("seq")).coalesce(1).write.parquet(source)

    def run():
        updates = spark.readStream.schema(COUNTS).option("maxFilesPerTrigger", 1).parquet(source)
        streams.upsert_stream(updates, table, checkpoint, order="seq", merge=counted).awaitTermination()
        return {r["workspace_key"]: r["n"] for r in table.read().collect()}

    assert run() == {0: 2, 1: 2, 2: 2}
    spark.createDataFrame([(0, 3, "b", 9)], COUNTS).coalesce(1).write.mode("append").parquet(source)
    assert run() == {0: 5, 1: 2, 2: 2}
    forget_last_commit(checkpoint)
    assert run() == {0: 5, 1: 2, 2: 2}  # the batch is run again and finds its rows written


def test_intake_file_by_file_with_a_restart(spark, tmp_path):
    folder, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp")
    folder.mkdir()
    assert streams.intake_log(spark, log).count() == 0

    def put(*names):
        for n in names:
            (folder / n).write_bytes(n.encode())

    def run(**how):
        streams.incremental_intake(spark, str(folder), log, how.pop("checkpoint", checkpoint), **how).awaitTermination()
        return streams.intake_log(spark, log)

    put("a.pdf", "b.png", "c.jpg", "notes.txt")
    assert run().select("position").distinct().count() == 3
    put("d.jpeg", "e.pdf")
    entries = run()
    names = sorted(r["path"].rsplit("/", 1)[1] for r in entries.collect())
    assert names == ["a.pdf", "b.png", "c.jpg", "d.jpeg", "e.pdf"] and entries.select("position").distinct().count() == 5
    assert {r["source_hash"] for r in entries.collect()} == {hashlib.sha256(n.encode()).hexdigest() for n in names}
    forget_last_commit(checkpoint)  # stopped before its last file was acknowledged
    assert run().count() == 5
    assert run(checkpoint=str(tmp_path / "cp2"), run=1, replace=True).count() == 10
    current = streams.current_intake(streams.intake_log(spark, log)).collect()
    assert len(current) == 5 and sorted(r["mode"] for r in current) == ["append"] * 4 + ["replace"] and {r["run"] for r in current} == {1}


def test_first_arrivals_and_late_copies(spark, tmp_path):
    hour = lambda h: DAY + datetime.timedelta(hours=h)
    schema = "company_id int, source_hash string, timestamp timestamp, seq int"
    parts = [
        [(1, "a", hour(0), 0), (1, "b", hour(1), 1), (1, "a", hour(2), 2), (2, "a", hour(2), 3), (1, "known", hour(2), 4)],
        [(1, "b", hour(3), 5), (1, "c", hour(20), 6)],  # a late copy within the watermark
        [(1, "a", hour(5), 7), (1, "d", hour(40), 8)],
        [(1, "late", hour(1), 9)],  # beyond the watermark: dropped, new or not
        [(1, "c", hour(41), 10)],  # its first file's state has not gone
        [(1, "x", hour(120), 11)],
        [(1, "a", hour(121), 12)],  # long after: counts as first again
    ]
    source = str(tmp_path / "in")
    reviews = spark.createDataFrame([("known",)], "source_hash string")
    os.makedirs(source)
    query = streams.first_arrivals(spark.readStream.schema(schema).parquet(source), "1 day", reviews).writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(r["seq"] for r in spark.table("arrivals").collect())
    assert got == [0, 1, 3, 6, 8, 11, 12]
    # where no copy comes later than the watermark allows, the stream gives what the whole input gives
    early = [r for part in parts[:3] for r in part]
    whole = operators.new_files(spark.createDataFrame(early, schema), reviews)
    first = whole.groupBy("company_id", "source_hash").agg(F.min("seq").alias("seq"))
    assert sorted(r["seq"] for r in first.collect()) == [s for s in got if s <= 8]
