"""Quality rules: robust multivariate outliers among the statistics of texts.

Every text gets a vector of transformed statistics. Per (lang, source) a minimum-covariance-
determinant estimate of centre and scatter is found over its distinct texts, so that copies do not
weigh, by concentration steps: distances under the present estimate, the nearest H_SHARE of the
group's texts, their mean and covariance, and again until the determinant no longer falls. They begin
at three starts (medians and quartiles, each column's shortest half, spatial signs), and the core of
the smallest determinant is taken: the least found, not proven to be the least of all subsets.
A step is one pass over one narrow row per text: moments are summed by bins of distance about 1 %
wide, and the nearest bins that hold H_SHARE of the group make its core. No group is ever gathered.

The same is done, from the second start, for each language and for all texts. A group is judged by a mean of its own
estimate, its language's and the common one, where its own weighs n / (n + PRIOR_ROWS) for n texts
and its language's likewise in what is left: a source of a few texts is judged nearly by its
language, and nothing jumps as it grows.

A text is rejected when its squared Mahalanobis distance passes a chi-square quantile.

Defined results: a null text counts as empty; null lang or source count as ''. Repeated rows are
judged alike, whatever their ids. An empty table gives an empty result. Extra columns are ignored by
the verdicts and kept by `kept_rows`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import Scratch, spread_join, text_key, unused
from docketry.llm._words import SEPARATOR, WINDOW_BYTES, buffer_of, mix, range_hashes, row_groups, window_hashes, words_of

#: Share of a group's texts that a concentration step keeps.
H_SHARE = 0.5
#: Texts whose weight the estimate above has in a group's own.
PRIOR_ROWS = 200
#: Estimates that are broadcast to the texts, at most: some 10 MB. More are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: A start has settled when the logarithm of its determinant falls by no more than this; STEPS only guards against cycles.
SETTLED, STEPS = 0.01, 50
#: Bins of squared distance to a doubling, and the doublings covered on either side of 1.
BINS, DOUBLINGS = 64, 40
#: Quantiles that the starts are made from, and the accuracy of all quantiles.
GRID, ACCURACY = 40, 1000
#: Share of clean rows of a normal group beyond the rejecting distance.
ALPHA = 1e-3
#: What chance alone moves in a short text: a tenth of its words, one line or repeated run in some twenty, a symbol or capital
#: in a hundred. Its variance is added to the core's, which may be 0 where half of a group's texts have one value.
FLOORS = {"z_words": 0.1, "z_length": 0.05, "z_symbols": 0.01, "z_repeats": 0.08, "z_lines": 0.05, "z_shout": 0.01}
VECTOR = tuple(FLOORS)
#: The columns that name a group, and those of an estimate.
MODEL = ("level", "m_lang", "m_source")
ESTIMATE = "level int, m_lang string, m_source string, start int, n long, centre array<double>, precision array<double>, scatter array<double>, size double, settled boolean"
TEXT = ("key_a", "key_b", "key_n")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[[*range(65, 91), 33]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _sums(flags: np.ndarray, lo: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end - lo] - total[start - lo]


def _repeated_words(w, first: int, n: int) -> np.ndarray:
    """Per row: words that lie in a 3-word window found twice or more in the row's text."""
    if len(w) < 3:
        return np.zeros(n, np.int64)
    size = len(w) - 2
    whole = w.row[:size] == w.row[2:]
    at = np.flatnonzero(whole)
    row, tri = window_hashes(w, 3)
    _, inverse, count = np.unique(mix(tri + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    often = at[count[inverse] > 1]
    covered = np.zeros(len(w), dtype=bool)
    for k in range(3):
        covered[often + k] = True
    return np.bincount(w.row[covered] - first, minlength=n)


def _lines(data: np.ndarray, start: np.ndarray, end: np.ndarray, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines that hold a word, and those of them equal to an earlier one."""
    n, lo, hi = len(start), int(start.min()), int(end.max())
    breaks = np.flatnonzero(data[lo:hi] == 10) + lo
    s = np.concatenate([start, breaks + 1])
    e = np.concatenate([breaks, end])
    s.sort()
    e.sort()
    keep = (s < e) & (np.searchsorted(word_start, e) > np.searchsorted(word_start, s))
    s, e = s[keep], e[keep]
    filled = np.flatnonzero(end > start)
    row = filled[np.searchsorted(start[filled], s, side="right") - 1] if len(s) else np.zeros(0, np.int64)
    inside = e <= end[row]
    s, e, row = s[inside], e[inside], row[inside]
    code = np.zeros(len(s), np.uint64)
    long = e - s > WINDOW_BYTES
    block = np.cumsum(e - s) // WINDOW_BYTES
    for b in np.unique(block[~long]) if len(s) else ():
        part = np.flatnonzero((block == b) & ~long)
        code[part] = range_hashes(data, s[part], e[part])
    for k in np.flatnonzero(long):
        code[k] = np.frombuffer(hashlib.blake2b(data[s[k] : e[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    key = mix(code + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(row, minlength=n)
    return lines, lines - np.bincount(row[first], minlength=n)


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text of an Arrow column."""
    buf = buffer_of(column)
    out = {k: np.zeros(len(buf.start), np.int64) for k in COUNTS}
    for rows in row_groups(buf):
        w = words_of(buf, rows)
        s, e = buf.start[rows], buf.end[rows]
        lo, hi, n = int(s.min()), int(e.max()), rows.stop - rows.start
        data = buf.data[lo:hi]
        out["n_words"][rows] = np.bincount(w.row - rows.start, minlength=n)
        out["word_chars"][rows] = _sums(_HEAD[data] & ~SEPARATOR[data], lo, s, e)
        out["n_symbols"][rows] = _sums(_SYMBOL[data], lo, s, e)
        out["n_upper"][rows] = _sums(_UPPER[data], lo, s, e)
        out["n_repeat_words"][rows] = _repeated_words(w, rows.start, n)
        if hi > lo:
            out["n_lines"][rows], out["n_dup_lines"][rows] = _lines(buf.data, s, e, w.start)
    return out


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = text_counts(b.column("text"))
        cols = {k: b.column(k) for k in ("doc_id", "lang", "source", *TEXT)} | {k: pa.array(v) for k, v in got.items()}
        yield pa.RecordBatch.from_pydict(cols)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the text's key, the counts of each whole text and its transformed vector."""
    schema = "doc_id long, lang string, source string, key_a long, key_b long, key_n long, " + ", ".join(f"{k} long" for k in COUNTS)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    slim = slim.withColumn("text", F.coalesce("text", F.lit(""))).select("*", *text_key())
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda part, whole: F.col(part) / whole
    return slim.mapInArrow(_stat_batches, schema).select(
        "*",
        F.log1p("n_words").alias("z_words"),
        F.log(chars / words).alias("z_length"),
        share("n_symbols", chars).alias("z_symbols"),
        share("n_repeat_words", words).alias("z_repeats"),
        share("n_dup_lines", F.col("n_lines") + 5).alias("z_lines"),
        share("n_upper", chars).alias("z_shout"),
    )


def chi_square_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for k in range(dof // 2):
        total += term
        term *= half / (k + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dof) < p else (lo, mid)
    return hi


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]


def _distance() -> F.Column:
    """Squared Mahalanobis distance of the row's vector under the row's centre and precision."""
    d = [F.col(z) - F.col("centre")[i] for i, z in enumerate(VECTOR)]
    terms = [d[i] * d[j] * F.col("precision")[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_pairs())]
    return sum(terms[1:], terms[0])


def _floored(cov: np.ndarray) -> np.ndarray:
    p = len(VECTOR)
    cov[:, range(p), range(p)] += np.array([v * v for v in FLOORS.values()])
    return cov


def _estimates(keys: pd.DataFrame, mean: np.ndarray, cov: np.ndarray, last: np.ndarray) -> pd.DataFrame:
    inverse, size = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
    flat = lambda m: [[x[i, j] for i, j in _pairs()] for x in m]
    return keys.reset_index(drop=True).assign(centre=list(mean), precision=flat(inverse), scatter=flat(cov), size=size, settled=np.abs(last - size) <= SETTLED)


def _squares(flat: pd.Series) -> np.ndarray:
    p = len(VECTOR)
    values, out = np.stack(flat.to_numpy()).astype(float), np.zeros((len(flat), p, p))
    for k, (i, j) in enumerate(_pairs()):
        out[:, i, j] = out[:, j, i] = values[:, k]
    return out


def _concentrated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From the moments of the kept rows to centre and scatter, for many groups at once."""
    p = len(VECTOR)
    trim = H_SHARE / chi_square_cdf(chi_square_quantile(H_SHARE, p), p + 2)
    for pdf in batches:
        if len(pdf):
            mean = np.stack(pdf["means"].to_numpy()).astype(float)
            cov = _floored((_squares(pdf["seconds"]) - mean[:, :, None] * mean[:, None, :]) * trim)
            yield _estimates(pdf[[*MODEL, "start", "n"]], mean, cov, pdf["last"].to_numpy(float))


def _column_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Starts 0 and 1: medians and quartiles, and the middle and width of each column's shortest half."""
    floor, half = np.array(list(FLOORS.values())), GRID // 2
    for pdf in batches:
        if not len(pdf):
            continue
        q = np.stack([np.stack(pdf[z].to_numpy()) for z in VECTOR], axis=2).astype(float)  # group, quantile, column
        width = q[:, half:] - q[:, : half + 1]
        at = width.argmin(axis=1)[:, None, :]
        low, high = np.take_along_axis(q, at, 1)[:, 0], np.take_along_axis(q, at + half, 1)[:, 0]
        quartiles = q[:, 3 * GRID // 4] - q[:, GRID // 4]
        for start, mean, spread in ((0, q[:, half], quartiles), (1, (low + high) / 2, high - low)):
            cov = np.zeros((len(pdf), len(VECTOR), len(VECTOR)))
            cov[:, range(len(VECTOR)), range(len(VECTOR))] = np.maximum(spread / 1.349, floor) ** 2
            yield _estimates(pdf[[*MODEL, "n"]].assign(start=start)[[*MODEL, "start", "n"]], mean, cov, np.full(len(pdf), np.inf))


def _sign_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start 2: the scatter of the directions from start 1's centre, in its widths."""
    p = len(VECTOR)
    for pdf in batches:
        if len(pdf):
            wide = np.sqrt(np.diagonal(_squares(pdf["scatter"]), axis1=1, axis2=2))
            cov = _floored(_squares(pdf["signs"]) * p * wide[:, :, None] * wide[:, None, :])
            yield _estimates(pdf[[*MODEL, "n"]].assign(start=2)[[*MODEL, "start", "n"]], np.stack(pdf["centre"].to_numpy()).astype(float), cov, np.full(len(pdf), np.inf))


def _of_group() -> list[F.Column]:
    return [F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))]


def distinct_texts(stats: DataFrame) -> DataFrame:
    """Each text once for its (lang, source), its language, and all texts: levels 0, 1 and 2."""
    lang, source = _of_group()
    none = F.lit("")
    group = lambda level, a, b: F.struct(F.lit(level).alias("level"), a.alias("m_lang"), b.alias("m_source"))
    own = stats.groupBy(lang.alias("m_lang"), source.alias("m_source"), *TEXT).agg(*[F.first(z).alias(z) for z in VECTOR])
    every = own.select(F.explode(F.array(group(0, F.col("m_lang"), F.col("m_source")), group(1, F.col("m_lang"), none), group(2, none, none))).alias("g"), *TEXT, *VECTOR)
    return every.groupBy("g", *TEXT).agg(*[F.first(z).alias(z) for z in VECTOR]).select("g.*", *VECTOR)


def _joined(rows: DataFrame, table: DataFrame, on: list[str], total: int, size: int) -> DataFrame:
    """rows with a table of estimates, which is broadcast only if it is small."""
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on)
    table.most_rows_of_a_key = table.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return spread_join(rows, table, on, total)


def mcd_starts(texts: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    quantiles = texts.groupBy(*MODEL).agg(F.count("*").alias("n"), *[F.percentile_approx(z, grid, ACCURACY).alias(z) for z in VECTOR])
    columns = scratch.written(quantiles.mapInPandas(_column_starts, ESTIMATE), "starts")
    first, size = columns.where("start = 1"), columns.count()
    place = {k: n for n, k in enumerate(_pairs())}
    u = [(F.col(z) - F.col("centre")[i]) * F.sqrt(F.col("precision")[place[i, i]]) for i, z in enumerate(VECTOR)]
    scaled = _joined(texts.where("level = 0"), first, [*MODEL], total, size).select(*MODEL, *[x.alias(z) for x, z in zip(u, VECTOR, strict=True)])
    length = F.greatest(sum((F.col(z) * F.col(z) for z in VECTOR[1:]), F.col(VECTOR[0]) * F.col(VECTOR[0])), F.lit(1e-12))
    signs = scaled.withColumn("length", length).groupBy(*MODEL).agg(F.array(*[F.avg(F.col(VECTOR[i]) * F.col(VECTOR[j]) / F.col("length")) for i, j in _pairs()]).alias("signs"))
    return columns.where("level = 0 OR start = 1").unionByName(signs.join(first, [*MODEL]).mapInPandas(_sign_starts, ESTIMATE))


def mcd_estimates(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Per group: n, centre, precision and scatter of the core of the smallest determinant, over all its texts."""
    total = texts.count()
    left = F.count_if(~F.col("settled"))
    present, seen = scratch.measured(mcd_starts(texts, total, scratch), "estimate", n=F.count("*"), left=left)
    size, ended = seen["n"], []  # none is added later
    key, moments = [*MODEL, "start"], [f"m{k}" for k in range(len(VECTOR) + len(_pairs()))]
    bin_of = F.greatest(F.least(F.floor(F.log2(F.greatest("d2", F.lit(1e-300))) * BINS), F.lit(DOUBLINGS * BINS)), F.lit(-DOUBLINGS * BINS))
    nearer = Window.partitionBy(*key).orderBy("bin")
    for step in range(STEPS):
        near = _joined(texts, present, [*MODEL], 3 * total, size).select(*key, F.col("size").alias("last"), *VECTOR, _distance().alias("d2"))
        values = [F.col(z) for z in VECTOR] + [F.col(VECTOR[i]) * F.col(VECTOR[j]) for i, j in _pairs()]
        binned = near.groupBy(*key, bin_of.alias("bin")).agg(F.count("*").alias("k"), F.first("last").alias("last"), *[F.sum(v).alias(m) for v, m in zip(values, moments, strict=True)])
        core = binned.withColumn("n", F.sum("k").over(Window.partitionBy(*key))).withColumn("before", F.sum("k").over(nearer) - F.col("k")).where(F.col("before") < H_SHARE * F.col("n"))
        of_core = core.groupBy(*key).agg(F.first("n").alias("n"), F.first("last").alias("last"), F.sum("k").alias("k"), *[F.sum(m).alias(m) for m in moments])
        means = F.array(*[F.col(m) / F.col("k") for m in moments])
        found = of_core.select(*key, "n", "last", F.slice(means, 1, len(VECTOR)).alias("means"), F.slice(means, len(VECTOR) + 1, len(_pairs())).alias("seconds"))
        present, seen = scratch.measured(found.mapInPandas(_concentrated, ESTIMATE), "estimate", left=left)
        ended.append(present.where("settled") if step < STEPS - 1 else present)
        present = present.where("NOT settled")
        if not seen["left"]:
            break
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    best = every.groupBy(*MODEL).agg(F.min(F.struct("size", "start", "n", "centre", "precision", "scatter")).alias("best"))
    return scratch.written(best.select(*MODEL, "best.n", "best.centre", "best.precision", "best.scatter"), "core")


def _blended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and precision that judge a group, from its own estimate and those above it."""
    for pdf in batches:
        if len(pdf):
            centres = [np.stack(pdf[f"centre{k}"].to_numpy()).astype(float) for k in range(3)]
            scatters = [_squares(pdf[f"scatter{k}"]) for k in range(3)]
            own, lang = (pdf[f"n{k}"].to_numpy(float) / (pdf[f"n{k}"].to_numpy(float) + PRIOR_ROWS) for k in range(2))
            weights = [own, (1 - own) * lang, (1 - own) * (1 - lang)]
            centre = sum(w[:, None] * c for w, c in zip(weights, centres, strict=True))
            inverse = np.linalg.inv(sum(w[:, None, None] * s for w, s in zip(weights, scatters, strict=True)))
            yield pdf[["m_lang", "m_source", "n"]].assign(centre=list(centre), precision=[[x[i, j] for i, j in _pairs()] for x in inverse])


def group_models(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """m_lang, m_source, n (rows), centre, precision of every (lang, source)."""
    core = mcd_estimates(scratch.written(distinct_texts(stats), "texts"), scratch)
    of = lambda level: core.where(F.col("level") == level).select("m_lang", "m_source", *[F.col(k).alias(f"{k}{level}") for k in ("n", "centre", "scatter")])
    lang, source = _of_group()
    rows = stats.groupBy(lang.alias("m_lang"), source.alias("m_source")).agg(F.count("*").alias("n"))
    models = rows.join(of(0), ["m_lang", "m_source"]).join(of(1).drop("m_source"), "m_lang").join(of(2).drop("m_lang", "m_source").withColumn("one", F.lit(1)), F.col("one") == 1)  # one row
    return scratch.written(models.mapInPandas(_blended, "m_lang string, m_source string, n long, centre array<double>, precision array<double>"), "models", keep=True)


def judged_texts(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, lang, source, the text's key, the counts, base_failed, distance and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.written(text_statistics(docs), "stats", keep=True)
    models = group_models(stats, scratch)
    cut = chi_square_quantile(1 - alpha, len(VECTOR))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lang, source = _of_group()
    named = stats.withColumn("m_lang", lang).withColumn("m_source", source)
    rows = _joined(named, models, ["m_lang", "m_source"], stats.count(), models.count())
    scratch.clear()
    return rows.select("doc_id", "lang", "source", *TEXT, *COUNTS[:5], failed.alias("base_failed"), _distance().alias("distance")).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cut))


def quality_verdicts(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, distance and kept."""
    return judged_texts(docs, alpha).select("doc_id", *COUNTS[:5], "base_failed", "distance", "kept")


def kept_rows(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The rows of docs, all their columns, that the rules keep.

    A verdict depends on a row's text, lang and source; the row's id joins with them, so that no
    text with many copies is one key.
    """
    own, good = unused(docs.columns, "own", "good")
    known = ("doc_id", "lang", "source", *TEXT)
    passed = judged_texts(docs, alpha).where("kept").select(F.struct(*known).alias(good)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), *text_key(text)]
    named = docs.withColumn(own, F.struct(*[c.alias(k) for c, k in zip(mine, known, strict=True)]))
    return named.join(passed, F.col(own).eqNullSafe(F.col(good)), "left_semi").select(*docs.columns)
