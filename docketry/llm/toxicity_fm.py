"""Toxicity scores by a factorization machine over hashed terms.

A text's features are its distinct terms and their leading 4, 5 and 6 bytes, hashed to SLOTS slots.
The machine adds a weight per slot and, for every pair of slots, the product of their factors, so
that two harmless terms can be harmful together.

Training reads at most TRAIN_ROWS labelled rows of each label, those of the smallest hash of
doc_id, from the rows that are not held out. All their slots reach the driver, where the machine is
fitted on those found in LEAST_ROWS rows or more, whatever a slot says by itself; weights and
factors that the labels do not hold up are drawn to 0. Every document is then scored, over its
whole text, by one pass without exchange.

Defined results: null and empty texts have no features and get the machine's base score. A null
label, or a label without its document, trains nothing; of repeated labels the larger counts, and of
rows that repeat an id one is learnt from. With
no labelled rows of both kinds every score is 0. Repeated rows are scored alike; a null doc_id is
not held out. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._words import LOWER_CODE, NOT_TERM, buffer_of, mix, range_hashes, row_groups, words_of

#: Labelled rows of each label that the machine is fitted on, at most.
TRAIN_ROWS = 4000
SLOTS, LEAST_ROWS = 1 << 18, 3
FACTORS, EPOCHS, SEED = 4, (14, 120, 14), 7
#: What a weight must gain over the training rows, in rows, not to be drawn to 0; by what share of a step factors are.
WEIGHT_DRAW, FACTOR_DRAW = 6.0, 0.5
#: A slot that parts the labels by this many standard errors keeps its weight whatever the draw says.
LEAST_Z = 4.0
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)


def text_features(buf, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """(row within the run, slot) pairs, each once, in order."""
    w = words_of(buf, rows, LOWER_CODE, NOT_TERM)
    row = (w.row - rows.start).astype(np.uint64)
    per_text = mix(w.hash + row * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(per_text, return_index=True)
    start, end, row = w.start[first], w.end[first], row[first]
    order = np.argsort(start, kind="stable")
    start, end, row, whole = start[order], end[order], row[order], w.hash[first][order]
    kinds = [(row, whole)]
    for k in PREFIXES:
        longer = np.flatnonzero(end - start > k)
        if len(longer):
            base = int(start[longer[0]])
            part = np.searchsorted(start[longer], np.arange(base, int(start[longer[-1]]) + 1, 2 << 20))
            for a, b in zip(part, [*part[1:], len(longer)], strict=True):
                at = longer[a:b]
                if len(at):
                    kinds.append((row[at], mix(range_hashes(buf.data, start[at], start[at] + k, LOWER_CODE) + np.uint64(k))))
    row, feature = np.concatenate([x[0] for x in kinds]), np.concatenate([x[1] for x in kinds])
    pairs = np.unique(row.astype(np.int64) * SLOTS + (mix(feature) & np.uint64(SLOTS - 1)).astype(np.int64))
    return pairs // SLOTS, pairs % SLOTS


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf = buffer_of(b.column("text"))
        for rows in row_groups(buf):
            row, feature = text_features(buf, rows)
            ends = np.searchsorted(row, np.arange(1, rows.stop - rows.start))
            packed = pa.array([x.tobytes() for x in np.split(feature.astype("<i4"), ends)], pa.binary())
            part = b.slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), packed], names=["doc_id", "toxic", "features"])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, features (slots, 4 bytes each) of the rows that the machine learns from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    present = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    picked = [present.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for x in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * most rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    found = texts.mapInArrow(_feature_batches, "doc_id long, toxic int, features binary")
    return found.groupBy("doc_id", "toxic").agg(F.min("features").alias("features"))  # of rows that repeat an id, one


@dataclass
class Machine:
    """bias, and weight and factors by slot, of the fitted machine."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        buf = buffer_of(column)
        out = np.zeros(len(buf.start))
        for rows in row_groups(buf):
            n = rows.stop - rows.start
            row, slot = text_features(buf, rows)
            out[rows] = 1 / (1 + np.exp(-np.clip(margins(row, slot, n, self.bias, self.weight, self.factors)[0], -30, 30)))
        return out


def margins(row: np.ndarray, slot: np.ndarray, n: int, bias: float, weight: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each of n rows, the machine's sum, and its sums of the slots' factors."""
    margin = bias + np.bincount(row, weight[slot], minlength=n)
    sums = []
    for f in factors.T:
        at = f[slot].astype(np.float64)
        sums.append(np.bincount(row, at, minlength=n))
        margin += 0.5 * (sums[-1] ** 2 - np.bincount(row, at * at, minlength=n))
    return margin, sums


@dataclass
class Rows:
    """The slots of many texts, end to end."""

    slot: np.ndarray
    size: np.ndarray

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row within the choice, slot) of some rows."""
        size = self.size[at]
        first = np.cumsum(self.size)[at] - size
        return np.repeat(np.arange(len(at)), size), self.slot[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def limited(self, place: np.ndarray) -> Rows:
        """The same with slots renamed by `place`; those without a place left out."""
        new = place[self.slot]
        have = np.zeros(len(new) + 1, np.int32)
        np.cumsum(new >= 0, out=have[1:])
        end = np.cumsum(self.size)
        return Rows(new[new >= 0], have[end] - have[end - self.size])

    def counts(self, at: np.ndarray, slots: int) -> np.ndarray:
        """How many of some rows have each slot."""
        return sum((np.bincount(self.of(at[a : a + 256])[1], minlength=slots) for a in range(0, len(at), 256)), np.zeros(slots, np.int64))


def _descend(rows: Rows, y: np.ndarray, theta: list[np.ndarray], parts: tuple[int, ...], epochs: int, rate: float, scale: float, draw, rng: np.random.Generator) -> None:
    """Moves those parts of theta (bias, weights, factors) down the logistic loss, by Adam in small batches."""
    slots, step = theta[1].shape[1], 0
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 256):
            at = order[a : a + 256]
            row, slot = rows.of(at)
            margin, sums = margins(row, slot, len(at), theta[0][0], theta[1][0], theta[2].T if 2 in parts else theta[2].T[:, :0])
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[at]) / len(at)
            each = np.bincount(slot, err[row], minlength=slots)
            step += 1
            for k in parts:
                g = np.array([err.sum()]) if k == 0 else each[None] if k == 1 else np.stack([np.bincount(slot, (err * s)[row], minlength=slots) for s in sums]) - theta[2] * each
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                size, now = np.sqrt(second[k] / (1 - 0.999**step)) + (scale if k else 1e-6), rate * (1 - epoch / epochs)
                theta[k] -= now * (first[k] / (1 - 0.9**step)) / size
                if k:
                    theta[k] = np.sign(theta[k]) * np.maximum(np.abs(theta[k]) - now * draw(size), 0)


def fit_machine(rows: Rows, y: np.ndarray, slots: int, factors: int = FACTORS, epochs: tuple[int, int, int] = EPOCHS, seed: int = SEED) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights of all slots drawn to 0; those left again without the draw; then factors of all slots, for what weights leave over."""
    rng = np.random.default_rng(seed)
    n = len(y)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    theta = [np.array([np.log(share / (1 - share))]), np.zeros((1, slots)), rng.normal(0, 0.02, (factors, slots))]
    _descend(rows, y, theta, (0, 1), epochs[0], 0.1, 0.01, lambda size: WEIGHT_DRAW / n / size, rng)
    bad = y.sum()
    in_bad, in_all = (rows.counts(np.flatnonzero(y >= least), slots) for least in (1, 0))
    part = in_all / n
    z = np.abs(in_bad / bad - (in_all - in_bad) / (n - bad)) / np.sqrt(part * (1.000001 - part) * (1 / bad + 1 / (n - bad)))
    left = np.flatnonzero((theta[1][0] != 0) | (z >= LEAST_Z))
    place = np.full(slots, -1, np.int32)
    place[left] = np.arange(len(left))
    again = [theta[0], theta[1][:, left], theta[2][:, left]]
    _descend(rows.limited(place), y, again, (0, 1), epochs[1], 0.03, 1e-6, lambda size: 1e-3, rng)
    theta[0], theta[1][:, left] = again[0], again[1]
    _descend(rows, y, theta, (0, 2), epochs[2], 0.05, 1e-5, lambda size: FACTOR_DRAW, rng)
    return float(theta[0][0]), theta[1][0], theta[2].T


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    from docketry.llm._shared import Scratch

    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.written(training_rows(docs, labels, most), "rows").orderBy("toxic", "doc_id", "features").select("toxic", "features").toArrow()  # at most 2 * most rows
    scratch.clear()
    toxic = sample.column("toxic").to_numpy().astype(float)
    weight, factors = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32)
    if not toxic.any() or toxic.all():
        return Machine(-30.0, weight, factors)
    texts = sample.column("features").combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    del sample
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] // 4
    rows = Rows(np.frombuffer(data, "<i4")[ends[0] : ends[-1]], np.diff(ends))
    kept = np.flatnonzero(rows.counts(np.arange(len(toxic)), SLOTS) >= LEAST_ROWS)
    place = np.full(SLOTS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rows = rows.limited(place)
    del texts, data
    pa.default_memory_pool().release_unused()
    bias, weight[kept], factors[kept] = fit_machine(rows, toxic, len(kept))
    return Machine(bias, weight, factors)


def toxicity_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(machine.scores(b.column("text")))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, whose text scores under `threshold`; no exchange of rows."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(machine.scores(b.column("text")) < threshold))

    return docs.mapInArrow(keep, docs.schema)
