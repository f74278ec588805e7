"""Quality scores learnt from preferences: a Bradley-Terry model over the statistics and word shapes of texts.

A text's features are a few statistics (length, word length, capitals, symbols, repeated words and
runs, line breaks), each spread over hat functions at quantiles of the training rows, and the
shares of its words' shapes, hashed to SHAPES slots. A text's strength is a weighted sum of them.
Every training row of good quality is preferred to PARTNERS rows of poor quality and the other way
round; the weights minimise the logistic loss of the differences of the features of each pair, so
the model learns which of two texts is better and needs no intercept.

The strengths are cut at a quantile: the share of poor rows among all labelled rows that are not
held out. A text of that strength scores 0.5, and others by the odds of being preferred to it.

All labelled rows that are not held out train: the quantiles of the hats, the pairs and the cut are
theirs. Rows are dealt by a hash of doc_id into blocks of some BLOCK_ROWS, in which they find their
partners; rows of the rarer label are copied to several blocks where a block would have fewer than
RARE_ROWS of them. Each step of Newton's method is one pass over the blocks, whose sums (a gradient
and a matrix of curvature, of the number of weights, not of rows) are added up by Spark. The cut is
found by histograms that are refined down to CUT_VALUES strengths. Features are taken from every
whole text by one pass without exchange; the query keeps them, 1 KB a row before compression, so
that training and scores read no text again.

Defined results: null and empty texts have no words and are scored as such. A null label, or a label
without its document, trains nothing; of repeated labels the larger counts, and of rows that repeat
an id one is learnt from. Where a label has no rows there are no pairs, and every score is 0.5.
Repeated rows are scored alike; a null doc_id is not held out. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import Scratch
from docketry.llm._words import buffer_of, mix, range_hashes, row_groups, window_hashes, words_of

#: Rows of the other label that each training row is compared with.
PARTNERS = 16
#: Rows of a block of training rows, and the rarer label's among them at least, both on average.
BLOCK_ROWS, RARE_ROWS = 1024, 64
SHAPES, KNOTS = 256, 9
STATISTICS = ("words", "word_length", "capitals", "symbols", "repeated_runs", "same_as_last", "repeated_words", "breaks")
#: Decimals that quantiles of statistics are taken to.
DECIMALS = 4
#: Steps of the descent at most, the gain below which a step is the last, and the weight of the squared weights in the loss.
STEPS, GAIN, RIDGE = 100, 1e-8, 1e-3
#: Groups of lines that the sums of the blocks are added up in.
STRIPS = 16
#: Bins of a histogram of strengths, and different strengths that the cut is looked for among.
BINS, CUT_VALUES = 1024, 4096
THRESHOLD = 0.5

#: Bytes as shapes have them: capitals, other letters and digits are one byte each, all else stays.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48
_LETTER = np.isin(_CLASS, (65, 97, 48))
_HEAD = (np.arange(256) & 0xC0) != 0x80
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _counts(flags: np.ndarray, lo: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end - lo] - sums[start - lo]


def _distinct(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Per row, how many codes it has."""
    _, first = np.unique(mix(code + row.astype(np.uint64) * _SALT), return_index=True)
    return np.bincount(row[first], minlength=n)


def _shape_slots(data: np.ndarray, w) -> np.ndarray:
    """The slot of each word's shape: its bytes' classes, runs of one class taken once."""
    if not len(w):
        return np.zeros(0, np.int64)
    lo, hi = int(w.start[0]), int(w.end[-1])
    kind = _CLASS[data[lo:hi]]
    new = np.ones(hi - lo, dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start - lo] = True
    place = np.zeros(hi - lo + 1, np.int64)
    np.cumsum(new, out=place[1:])
    return (range_hashes(kind[new], place[w.start - lo], place[w.end - lo]) & np.uint64(SHAPES - 1)).astype(np.int64)


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """STATISTICS of every whole text of an Arrow column, and the square roots of its shapes' shares."""
    buf = buffer_of(column)
    stats, shapes = np.zeros((len(buf.start), len(STATISTICS)), np.float32), np.zeros((len(buf.start), SHAPES), np.float32)
    for rows in row_groups(buf):
        n, s, e = rows.stop - rows.start, buf.start[rows], buf.end[rows]
        w = words_of(buf, rows)
        row = w.row - rows.start
        lo, hi = int(s.min()), int(e.max())
        data = buf.data[lo:hi]
        words = np.bincount(row, minlength=n)
        whole = np.maximum(words, 1)
        heads = np.maximum(_counts(_HEAD[data], lo, s, e), 1)
        marks = ~_LETTER[data] & (data > 32)
        run_row, run = window_hashes(w, 3)
        runs = np.bincount(run_row - rows.start, minlength=n)
        same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])) if len(w) > 1 else np.zeros(0, np.int64)
        out = stats[rows]
        out[:, 0] = np.log1p(words)
        out[:, 1] = np.log1p(heads / whole)
        out[:, 2] = _counts((data >= 65) & (data < 91), lo, s, e) / heads
        out[:, 3] = _counts(marks, lo, s, e) / heads
        out[:, 4] = 1 - _distinct(run_row - rows.start, run, n) / np.maximum(runs, 1)
        out[:, 5] = np.bincount(row[same], minlength=n) / whole
        out[:, 6] = 1 - _distinct(row, w.hash, n) / whole
        out[:, 7] = _counts(data == 10, lo, s, e) / whole
        out[words == 0, 4], out[runs == 0, 4], out[words == 0, 6] = 0, 0, 0
        slot = _shape_slots(buf.data, w)
        pairs, count = np.unique(row * SHAPES + slot, return_counts=True)
        shapes[rows.start + pairs // SHAPES, pairs % SHAPES] = np.sqrt(count / whole[pairs // SHAPES])
    return stats, shapes


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = np.hstack(text_features(b.column("text"))).astype("<f4")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in packed], pa.binary())], names=["doc_id", "features"])


def features_of(docs: DataFrame) -> DataFrame:
    """doc_id, features of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_feature_batches, "doc_id long, features binary")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(table: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, features of the rows of `features_of` that have a label and are not held out, each id once.

    They meet in one aggregate: a join would send whole tables of labels to every task, or not, by their size.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    both = table.select("doc_id", F.lit(None).cast("int").alias("quality"), "features").unionByName(known.withColumn("features", F.lit(None).cast("binary")))
    free = both.where(F.col("doc_id").isNotNull() & ~held_out())
    return free.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("features").alias("features")).where("quality IS NOT NULL AND features IS NOT NULL")


def _unpacked(features: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(features, "<f4").reshape(-1, len(STATISTICS) + SHAPES)
    return both[:, : len(STATISTICS)], both[:, len(STATISTICS) :]


def statistic_knots(rows: DataFrame) -> list[np.ndarray]:
    """The KNOTS quantiles of each statistic over all rows."""

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, _ = _unpacked(b"".join(b.column("features").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.float64)) for x in stats.T], names=list(STATISTICS))

    wide = rows.select("features").mapInArrow(statistics, ", ".join(f"{x} double" for x in STATISTICS))
    at = [float(x) for x in np.linspace(0, 1, KNOTS)]
    found = wide.agg(*[F.percentile(F.round(x, DECIMALS), at).alias(x) for x in STATISTICS]).first()
    knots = [np.unique(np.array(found[x])) for x in STATISTICS]
    return [x if len(x) > 1 else np.array([x[0], x[0] + 1]) for x in knots]


def _packed(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("quality", "ascending"), ("doc_id", "ascending")])
    good = int(np.sum(rows.column("quality").to_numpy()))
    packed = zlib.compress(b"".join(rows.column("features").to_pylist()), 1)
    return pa.table({"block": rows.column("block")[:1], "poor": pa.array([len(rows) - good], pa.int32()), "features": pa.array([packed], pa.binary())})


def training_blocks(rows: DataFrame, total: dict[int, int]) -> DataFrame:
    """block, poor, features: the rows dealt into blocks, a row per block, its poor rows first."""
    rare = min(total, key=lambda x: (total[x], x))
    blocks = -(-sum(total.values()) // BLOCK_ROWS)
    copies = min(-(-RARE_ROWS * blocks // total[rare]), blocks)
    places = F.sequence(F.lit(0), F.when(F.col("quality") == rare, copies - 1).otherwise(0))
    dealt = rows.select("doc_id", "quality", "features", F.explode(places).alias("copy"))
    block = F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) + F.col("copy"), F.lit(blocks)).cast("long")
    return dealt.select(block.alias("block"), "doc_id", "quality", "features").groupBy("block").applyInArrow(_packed, "block long, poor int, features binary")


@dataclass
class Model:
    """knots: by statistic; weight: of the hats of all statistics, then of the shapes; cut: the strength that scores 0.5."""

    knots: list[np.ndarray]
    weight: np.ndarray
    cut: float

    def strengths(self, stats: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        total, at = (shapes * self.weight[-SHAPES:]).sum(axis=1), 0  # row by row, so that equal rows get equal strengths
        for k, knots in enumerate(self.knots):
            total = total + np.interp(stats[:, k], knots, self.weight[at : at + len(knots)])  # a sum of hats
            at += len(knots)
        return total

    def scores(self, stats: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strengths(stats, shapes) - self.cut, -30, 30)))


def _hats(stats: np.ndarray, knots: list[np.ndarray]) -> np.ndarray:
    return np.hstack([np.stack([np.interp(stats[:, k], at, np.eye(len(at))[j]) for j in range(len(at))], axis=1) for k, at in enumerate(knots)])


def preference_pairs(good: np.ndarray, poor: np.ndarray, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other) places: each row of the longer side meets `partners` of the other, spread evenly over it."""
    n, m = len(good), len(poor)
    k = np.arange(max(n, m))
    shift = np.arange(min(partners, min(n, m))) * max(min(n, m) // partners, 1)
    a, b = np.repeat(k, len(shift)), (k[:, None] + shift[None]).reshape(-1)
    return good[a % n if n >= m else b % n], poor[b % m if n >= m else a % m]


def pair_sums(features: np.ndarray, better: np.ndarray, worse: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums over pairs, by rows: the loss log(1 + exp(-weight . difference)) and the pairs' number, each at its row's start, the gradient, the curvature."""
    n, d = features.shape
    strength = features @ weight
    margin = strength[better] - strength[worse]
    miss = 1 / (1 + np.exp(np.clip(margin, -30, 30)))
    bend = miss * (1 - miss)
    left, row = np.unique(better, return_inverse=True)
    right, column = np.unique(worse, return_inverse=True)
    both = np.bincount(row * len(right) + column, bend, minlength=len(left) * len(right)).reshape(len(left), len(right))
    cross = features[left].T @ (both @ features[right])
    each = np.bincount(better, bend, minlength=n) + np.bincount(worse, bend, minlength=n)
    out = np.zeros((d + 3, d))
    out[:2, 0] = np.logaddexp(0, -margin).sum(), len(better)
    out[2] = (np.bincount(worse, miss, minlength=n) - np.bincount(better, miss, minlength=n)) @ features
    out[3:] = (features * each[:, None]).T @ features - cross - cross.T
    return out


def newton(sums: Callable[[np.ndarray], np.ndarray], d: int, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise the mean loss of `pair_sums` and RIDGE / 2 of the squared weights; a step that goes too far is halved."""

    def at(weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found = sums(weight)
        pairs = found[1, 0]
        return found[0, 0] / pairs + RIDGE / 2 * weight @ weight, found[2] / pairs + RIDGE * weight, found[3:] / pairs + RIDGE * np.eye(d)

    weight = np.zeros(d)
    loss, slope, bend = at(weight)
    for _ in range(steps):
        step = np.linalg.solve(bend, slope)
        gain, size = slope @ step, 1.0
        if gain < GAIN:
            return weight - step
        tried = at(weight - step)
        while tried[0] > loss - size * gain / 10000 and size > 1e-6:
            size /= 2
            tried = at(weight - size * step)
        weight, (loss, slope, bend) = weight - size * step, tried
    return weight


def fit(features: np.ndarray, better: np.ndarray, worse: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-weight . (features[better] - features[worse]))), of rows in memory."""
    return newton(lambda weight: pair_sums(features, better, worse, weight), features.shape[1], steps)


def block_sums(blocks: DataFrame, knots: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """`pair_sums` of all blocks."""
    shape = len(weight) + 3, len(weight)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for poor, packed in zip(b.column("poor").to_pylist(), b.column("features").to_pylist(), strict=True):
                stats, shapes = _unpacked(zlib.decompress(packed))
                if 0 < poor < len(stats):
                    total += pair_sums(np.hstack([_hats(stats, knots), shapes]), *preference_pairs(np.arange(poor, len(stats)), np.arange(poor)), weight)
        if total[1, 0]:
            strips = [x.tobytes() for x in np.array_split(total, STRIPS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(STRIPS), pa.int32()), pa.array(strips, pa.binary())], names=["strip", "sums"])

    def added(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in sorted(parts.column("sums").to_pylist()))
        return pa.table({"strip": parts.column("strip")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    lines = blocks.select("poor", "features").mapInArrow(of_task, "strip int, sums binary").groupBy("strip").applyInArrow(added, "strip int, sums binary")
    strips = lines.toArrow().sort_by("strip").column("sums").to_pylist()  # STRIPS rows
    return np.frombuffer(b"".join(strips)).reshape(shape)


def quantile_cut(strength: np.ndarray, weight: np.ndarray, share: float) -> float:
    """Halfway between the last strength within the lowest `share` of the weight and the next."""
    order = np.argsort(strength, kind="stable")
    within = np.cumsum(weight[order]) <= share * weight.sum() * (1 + 1e-9)
    at = min(max(int(within.sum()), 1), len(order) - 1)
    return float(strength[order[at - 1 : at + 1]].mean())


def strength_cut(strengths: DataFrame, share: float, most: int = CUT_VALUES) -> float:
    """`quantile_cut` of all rows of strength, rows (each strength once): all but the bin of the cut are only counted, time and again."""
    part = strengths
    total = strengths.agg(F.sum("rows")).first()[0]
    lower, upper = (0.0, 0), (0.0, 0)  # the next strength below and above `part`, and all rows there
    while True:
        n, low, high = part.agg(F.count("*"), F.min("strength"), F.max("strength")).first()
        if n <= most:
            break
        bin_ = F.least(F.floor((F.col("strength") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = part.groupBy(bin_.alias("bin")).agg(F.min("strength"), F.max("strength"), F.sum("rows")).orderBy("bin").collect()  # BINS rows at most
        upto = lower[1] + np.cumsum([r[3] for r in bins])
        at = min(int(np.searchsorted(upto, share * total * (1 + 1e-9), "right")), len(bins) - 1)  # the first that ends beyond the share
        if at > 0:
            lower = bins[at - 1][2], int(upto[at - 1])
        if at + 1 < len(bins):
            upper = bins[at + 1][1], total - int(upto[at])
        part = part.where(F.col("strength").between(bins[at][1], bins[at][2]))
    near = part.collect()  # `most` rows at most
    found = sorted([(r["strength"], r["rows"]) for r in near] + [x for x in (lower, upper) if x[1]])
    return quantile_cut(np.array([x[0] for x in found]), np.array([x[1] for x in found], np.float64), share) if len(found) > 1 else found[0][0]


def strengths_of(rows: DataFrame, model: Model) -> DataFrame:
    """strength, rows: how many training rows have it."""

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strengths(*_unpacked(b"".join(b.column("features").to_pylist()))))], names=["strength"])

    return rows.select("features").mapInArrow(strengths, "strength double").groupBy("strength").agg(F.count("*").alias("rows"))


def _learned(table: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    rows = scratch.written(training_rows(table, labels), "rows")
    total = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}  # two rows at most
    if len(total) < 2:
        return Model([np.array([0.0, 1.0])] * len(STATISTICS), np.zeros(2 * len(STATISTICS) + SHAPES), 0.0)
    knots = statistic_knots(rows)
    blocks = scratch.written(training_blocks(rows, total), "blocks")
    model = Model(knots, newton(lambda weight: block_sums(blocks, knots, weight), sum(map(len, knots)) + SHAPES), 0.0)
    model.cut = strength_cut(scratch.written(strengths_of(rows, model), "strengths"), total[0] / (total[0] + total[1]))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    scratch = Scratch(docs.sparkSession, "preferences")
    try:
        return _learned(scratch.written(features_of(docs), "features"), labels, scratch)
    finally:
        scratch.clear()


def _scored(table: DataFrame, column: str, scores: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column(column)))], names=["doc_id", "score"])

    scored = table.select("doc_id", column).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(slim, "text", lambda texts: model.scores(*text_features(texts)))


def trained_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`quality_scores` by the model that `train` learns from the same documents, whose texts are read once for both."""
    scratch = Scratch(docs.sparkSession, "preferences")
    try:
        table = scratch.written(features_of(docs), "features", keep=True)  # the result reads it
        model = _learned(table, labels, scratch)
    finally:
        scratch.clear()
    return _scored(table, "features", lambda packed: model.scores(*_unpacked(b"".join(packed.to_pylist()))))
