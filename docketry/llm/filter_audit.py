"""Audit of how five filters interact: what each removes in every order, and what only it finds.

Each document fails a subset of the filters, its mask. Masks are counted per part (a source) with
their good and toxic documents, at most 32 cells a part, by aggregates that combine before they
shuffle. Then a Gray code walks all 32 subsets of filters: each step toggles one filter, moves the
active-failure counter of every cell that fails it up or down, and adds or takes from the running
survivors the cells whose counter left or reached 0. The survivors of all 32 states are kept, and a
filter's removal at a step of an order is the difference of two of them.

Filters, over whole texts: A under 200 words; B distinct words under half of the words; C ASCII
capitals over 2 % of the code points; D holds one of `#$%&*|`; E equals the text of a smaller
doc_id anywhere in the table.

Defined results: a null text is empty and equals other empty ones; it fails A only, and E if a
smaller id is empty too (0 < 0 is false in B and C). A null doc_id is smaller than none and has no
smaller one, so it never fails E; rows that repeat an id and its text fail E alike. A null source is
the part ''. Of repeated labels of an id the larger count; documents without a label are neither
good nor toxic. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import Scratch, text_key
from docketry.llm._words import buffer_of, mix, row_groups, words_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
STATES = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The index of an order's subset after each step, and of the filter that the step applies.
SUBSET = np.array([np.bitwise_or.accumulate([1 << FILTERS.index(c) for c in order]) for order in ORDERS])
FILTER = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
COUNTED = ("docs", "good", "toxic")
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
TEXT = ("key_a", "key_b", "key_n")

_MARKED = np.zeros(256, dtype=bool)
_MARKED[[ord(c) for c in "#$%&*|"]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


def own_failures(column: pa.Array) -> np.ndarray:
    """The mask of the filters A to D that each whole text of an Arrow column fails."""
    buf = buffer_of(column)
    out = np.zeros(len(buf.start), np.int32)
    for rows in row_groups(buf):
        s, e, n = buf.start[rows], buf.end[rows], rows.stop - rows.start
        w = words_of(buf, rows)
        row = w.row - rows.start
        words = np.bincount(row, minlength=n)
        _, first = np.unique(mix(w.hash + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        distinct = np.bincount(row[first], minlength=n)
        lo, hi = int(s.min()), int(e.max())
        data = buf.data[lo:hi]

        def count(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(hi - lo + 1, np.int64)
            np.cumsum(flags[data], out=sums[1:])  # noqa: B023
            return sums[e - lo] - sums[s - lo]  # noqa: B023

        fails = (words < LEAST_WORDS, 100 * distinct < 50 * words, 100 * count(_CAPITAL) > 2 * count(_HEAD), count(_MARKED) > 0)
        out[rows] = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
    return out


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = {k: b.column(k) for k in ("doc_id", "part", *TEXT)}
        yield pa.RecordBatch.from_pydict(cols | {"mask": pa.array(own_failures(b.column("text")))})


def document_masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part, mask of all five filters and rows: rows alike in id, text and part are one row with their number.

    Whole texts take part in no exchange: they are known by two hashes and their length. A text's
    smallest id is found by an aggregate, and meets its rows by id and text, so copies spread.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, part string, key_a long, key_b long, key_n long, mask int"
    found = slim.select("*", *text_key()).mapInArrow(_mask_batches, schema)
    rows = scratch.written(found.groupBy("doc_id", "part", *TEXT, "mask").agg(F.count("*").alias("rows")), "masks")
    first = rows.where("doc_id IS NOT NULL").groupBy(*TEXT).agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["doc_id", *TEXT], "left").select("doc_id", "part", (F.col("mask") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), "rows")


def mask_cells(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, and `cells`: by mask, an array of 32 structs of docs, good and toxic. One row per part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("long").alias("good"), (F.col("toxic") == 1).cast("long").alias("toxic"))
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = document_masks(docs, scratch).join(known, "doc_id", "left")
    cells = joined.groupBy("part", "mask").agg(F.sum("rows").alias("docs"), *[F.coalesce(F.sum(F.col("rows") * F.coalesce(F.col(k), F.lit(0))), F.lit(0)).alias(k) for k in ("good", "toxic")])
    at = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(k))), F.lit(0)) for k in COUNTED for m in range(STATES)]
    return cells.groupBy("part").agg(F.array(*at).alias("cells"))  # one row per part, whatever the number of documents


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """cells: counts by (any leading axes, mask). The survivors by (the same axes, subset of active filters)."""
    out = np.zeros(cells.shape, np.int64)
    mask = np.arange(STATES)
    failing = np.zeros(STATES, np.int64)  # active filters that each cell fails
    running = cells.sum(axis=-1)
    state = 0
    out[..., 0] = running
    for step in range(1, STATES):
        bit = (step & -step).bit_length() - 1  # the filter that this step of the code toggles
        state ^= 1 << bit
        hit = (mask >> bit) & 1
        if state >> bit & 1:
            running = running - cells[..., (failing == 0) & (hit == 1)].sum(axis=-1)
            failing += hit
        else:
            failing -= hit
            running = running + cells[..., (failing == 0) & (hit == 1)].sum(axis=-1)
        out[..., state] = running
    return out


def part_reports(cells: np.ndarray) -> dict[str, np.ndarray]:
    """cells by (part, COUNTED, mask). The report's counts by (part, order, step)."""
    left = gray_walk(cells)
    before = np.concatenate([np.zeros((len(ORDERS), 1), SUBSET.dtype), SUBSET[:, :-1]], axis=1)
    kept, lost = left[:, :, SUBSET], left[:, :, before] - left[:, :, SUBSET]
    removed = lost[:, 0]
    failing = np.stack([cells[:, 0, (np.arange(STATES) >> k & 1) == 1].sum(axis=-1) for k in range(len(FILTERS))], axis=1)
    alone = cells[:, 0, [1 << k for k in range(len(FILTERS))]]
    shapley = np.stack([removed[:, FILTER == k].sum(axis=-1) for k in range(len(FILTERS))], axis=1)
    return {
        "kept": kept[:, 0], "removed": removed, "redundant": failing[:, FILTER] - removed, "unique_fails": alone[:, FILTER],
        "good_lost": lost[:, 1], "toxic_lost": lost[:, 2], "shapley": shapley[:, FILTER],
    }


def _report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    for whole in batches:
        for at in range(0, whole.num_rows, 100):  # 600 rows each
            b = whole.slice(at, 100)
            cells = b.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(COUNTED), STATES)
            got = part_reports(cells)
            part = b.column("part").take(pa.array(np.repeat(np.arange(b.num_rows), len(orders))))
            cols = {"part": part, "filter_order": pa.array(np.tile(orders, b.num_rows)), "step": pa.array(np.tile(steps, b.num_rows))}
            yield pa.RecordBatch.from_pydict(cols | {k: pa.array(v.reshape(-1)) for k, v in got.items()})


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """REPORT: a row per part, order of the filters and step."""
    scratch = Scratch(docs.sparkSession, "filters")
    try:
        cells = scratch.written(mask_cells(docs, labels, scratch), "cells", keep=True)
    finally:
        scratch.clear()
    return cells.mapInArrow(_report_batches, REPORT)


#: The same rows from the definitions: every document's failures, and every order applied left to right.
SQL = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), smallest AS (SELECT text, min(doc_id) AS lo FROM words GROUP BY text),
known AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > lo, false) AS e
  FROM words LEFT JOIN smallest USING (text) LEFT JOIN known USING (doc_id)
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (SELECT filter_order, CAST(n AS INTEGER) AS step, substr(filter_order, n, 1) AS applied FROM orders, range(1, 6) r(n)),
cells AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
walked AS (
  SELECT part, filter_order, step, applied, n, good, toxic,
         least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 9 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 9 END,
               CASE WHEN c THEN strpos(filter_order, 'C') ELSE 9 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 9 END,
               CASE WHEN e THEN strpos(filter_order, 'E') ELSE 9 END) AS gone,
         CASE applied WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
         CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER) + CAST(e AS INTEGER) AS n_fails
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, applied,
         coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND gone < step), 0) AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
  FROM walked GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, applied) AS BIGINT) AS shapley
FROM counted
"""
