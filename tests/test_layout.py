"""Page layout against sequential Python, and its queries against their SQL."""

import math
import random
import re

import pytest
from docketry.operators import layout

ITEMS = "doc_id long, page int, seq long, text string, x double, y double, width double"
SIZES = "doc_id long, page int, width double, height double"


def half_up(v):
    return math.floor(v + 0.5)


def sequential_lines(items):
    """Buckets of a page in reading order, one after the other."""
    buckets = {}
    for seq, text, x, y, width in sorted(items):
        text = (text or "").strip()
        if text:
            buckets.setdefault(half_up(y / 4) * 4, []).append((x, seq, text, y, width))
    out = []
    for b in sorted(buckets, reverse=True):
        row = sorted(buckets[b])
        text = re.sub(r"\s+", " ", " ".join(r[2] for r in row)).strip()
        if len(text) > 1:
            out.append((text, half_up(min(r[0] for r in row)), half_up(sum(r[3] for r in row) / len(row)), half_up(sum(r[4] for r in row)), len(row)))
    return out


def sequential_hints(lines):
    begins, out = re.compile(r"^\s*\d{1,2}[.)\-_]?\s+"), []
    for k, line in enumerate(lines):
        children = [c[0] for c in lines[k + 1 : k + 18] if c[1] > line[1] + 20 and begins.search(c[0])][:14]
        if 3 < len(line[0]) < 90 and not begins.search(line[0]) and len(children) >= 3:
            out.append((line[0], children))
    return out[:8]


def sequential_patterns(lines):
    groups = {}
    for line in lines:
        m = re.match(r"^\s*(?:(\d{1,2})[.)\-_]|\b(\d{1,2})\s+-)\s*(.+)$", line[0])
        if m and int(m[1] or m[2]) and len(m[3].strip()) >= 2:
            n = int(m[1] or m[2])
            groups.setdefault("1-13 candidate" if n <= 13 else "numbered list", {})[n] = m[3].strip()
    return {k: (min(v), max(v), len(v), [v[n] for n in sorted(v)][:16]) for k, v in groups.items() if len(v) >= 3}


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    rows = []
    for doc in range(6):
        for page in range(1, 4):
            seq = 0
            for line in range(rng.randrange(0, 45)):
                numbered = rng.random() < 0.5
                for col in range(rng.randrange(1, 6)):
                    text = rng.choice(["a", "Total  due", " x ", "", None, "valor", "Mês pago", "12", "b\nc"])
                    if numbered and col == 0:
                        text = f"{rng.randrange(0, 30)}{rng.choice(['.', ')', ' -', '', '_'])}"
                    rows.append((doc, page, seq, text, 40.0 + (30 if numbered else 0) + 60 * rng.choice([col, col, 0]), 800 - 12.0 * line + rng.choice([0, 0.5, -2, 2, 1]), rng.choice([10.0, 22.5])))
                    seq += 1
    return rows, spark.createDataFrame(rows, ITEMS).repartition(5)


def of_page(rows, doc, page):
    return [r[2:] for r in rows if r[0] == doc and r[1] == page]


def test_lines_patterns_and_hints_follow_the_sequential_rules(pages):
    rows, items = pages
    lines = layout.page_lines(items)
    got, hints, patterns = {}, {}, {}
    for r in lines.orderBy("doc_id", "page", "line").collect():
        got.setdefault((r["doc_id"], r["page"]), []).append((r["text"], r["x"], r["y"], r["width"], r["items"]))
    for r in layout.hierarchy_hints(lines).orderBy("doc_id", "page", "nth").collect():
        hints.setdefault((r["doc_id"], r["page"]), []).append((r["title"], r["children"]))
    for r in layout.numbering_patterns(lines).collect():
        patterns.setdefault((r["doc_id"], r["page"]), {})[r["kind"]] = (r["first"], r["last"], r["count"], r["labels"])
    assert patterns and hints
    for doc in range(6):
        for page in range(1, 4):
            want = sequential_lines(of_page(rows, doc, page))
            assert got.get((doc, page), []) == want
            assert hints.get((doc, page), []) == sequential_hints(want)
            assert patterns.get((doc, page), {}) == sequential_patterns(want)


def test_profiles_with_and_without_items(spark, pages):
    rows, items = pages
    sizes = spark.createDataFrame([(d, p, 600.4, 590.0 if p == 1 else 842.0) for d in range(7) for p in range(1, 26)], SIZES)
    programs = spark.createDataFrame([(0, "Ácme v1", ""), (1, None, "Lib")], "doc_id long, creator string, producer string")
    got = {(r["doc_id"], r["page"]): r for r in layout.page_profiles(items, sizes).collect()}
    assert len(got) == 7 * 20  # pages beyond the twentieth are not inspected
    for (doc, page), r in got.items():
        texts = [re.sub(r"\s+", " ", t.strip()) for _, t, *_ in sorted(of_page(rows, doc, page)) if (t or "").strip()]
        assert (r["text_length"], r["header"], r["footer"]) == (len(" ".join(texts)), " ".join(texts[:12])[:260], " ".join(texts[-12:])[:260])
        assert r["orientation"] == ("square" if page == 1 else "portrait")
    whole = {r["doc_id"]: r for r in layout.document_profiles(items, sizes, programs).collect()}
    assert len(whole) == 7 and whole[6]["mean_length"] == 0 and whole[6]["ocr_recommended"] and whole[6]["hints"] == [] and whole[6]["page_count"] == 25
    assert whole[6]["layout_tokens"] == ["pages-25", "first-square", "avgtext-0"]
    assert whole[0]["layout_tokens"][3] == "creator-acme v1" and whole[0]["diagnostics"][0] == "PDF creator: Ácme v1." and whole[1]["diagnostics"][0] == "PDF producer: Lib."
    assert whole[6]["diagnostics"][-1].startswith("Only first 20 of 25")
    for limit in (40, 500, 80_000):
        texts = {r["doc_id"]: r["text"] for r in layout.document_texts(items, characters=limit).collect()}
        for doc in range(6):
            parts = [(p, [re.sub(r"\s+", " ", t.strip()) for _, t, *_ in sorted(of_page(rows, doc, p)) if (t or "").strip()]) for p in range(1, 4)]
            assert texts.get(doc, "") == "\n".join(f"[Page {p}] " + " ".join(ts) for p, ts in parts if ts)[:limit]


def test_context_of_a_pick(spark):
    spans = [(1, 1, k, t, left, 50.0, 10.0, base) for k, (t, left, base) in enumerate([("a", 0.0, 100.0), ("b c", 60.0, 104.0), ("PICK", 200.0, 100.0), ("right", 300.0, 100.0), ("below", 220.0, 140.0), ("far", 900.0, 130.0), ("above", 210.0, 60.0), ("off", 200.0, 700.0)])]
    spans = spark.createDataFrame(spans, "doc_id long, page int, seq long, text string, left double, width double, height double, baseline double")
    pick = spans.where("text = 'PICK'").withColumn("pick", spans["seq"])
    r = layout.picked_context(pick, spans).first()
    assert (r["label"], r["context"]) == ("a b c", "below b c a PICK right above")
    boxes = spark.createDataFrame([(1, 1, 1, 205.0, 95.0, 260.0, 99.0), (2, 1, 1, 195.0, 690.0, 500.0, 705.0), (3, 1, 1, 2000.0, 130.0, 2010.0, 131.0), (4, 9, 9, 0.0, 0.0, 1.0, 1.0)], "pick long, doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    got = {r["pick"]: r.asDict() for r in layout.selected_context(boxes, spans).collect()}
    assert (got[1]["seq"], got[1]["label"]) == (2, "a b c | right") and got[1]["context"] == "below b c a PICK right above"
    assert (got[2]["seq"], got[2]["label"], got[2]["context"]) == (7, "", "off")
    assert got[3]["seq"] == 5 and (got[4]["seq"], got[4]["label"], got[4]["context"]) == (None, "", "")


QUERIES = ["page_lines", "numbering_patterns", "hierarchy_hints", "page_profiles", "profile_lines", "document_texts", "document_profiles", "layout_tokens", "layout_diagnostics", "picked_context", "selected_context", "mark_texts"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = entry.queries()[name](spark, folder)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))
