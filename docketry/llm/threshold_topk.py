"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors become integers, so scores and bounds are exact. Candidates are packed into blocks; in each
block every dimension has a list of rows sorted by component. For a query the lists are read from
the end that its component's sign favours, some depth at a time, all dimensions in step; rows that
turn up are scored in full, and reading stops when the bound, the score of a row that had every
list's next value, cannot beat the kth score so far, or when every row has turned up. Blocks meet
query blocks, each pair gives at most k rows a query, and a ranked window merges them.

A block's rows are packed in the narrowest integers that hold them. A cell of the table of blocks is
one candidate block and QUERY_TILE query blocks: the candidates travel once per tile of queries, the
queries once per candidate block, and a block's lists are sorted once in a cell.

Where vectors have no direction that stands out, as random ones of 64 dimensions, each list's next
value stays so large that every row turns up before the bound can stop; `rows_scored` counts them:
one for every inner product that is made.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor
does one with a component whose integer a long cannot hold; neither do vectors of null id; vectors of
another length than the query's are no candidates for it. Ranks follow the exact integers; a score
that a long cannot hold is given as the nearest long. Equal scores go to the smaller vec_id;
repeated ids are rows of their own, but no row of the query's own id is its candidate. Fewer
candidates than k give all of them. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import written

#: Rows of a candidate block and of a query block, and query blocks of a cell: bounds of what one task holds.
CANDIDATE_ROWS, QUERY_ROWS, QUERY_TILE = 8192, 1024, 8
#: Entries of every list read before the bound is looked at for the first time.
DEPTH = 16
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole_vectors(table: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and its components as floor(scale * x); rows that take no part are left out."""
    able = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < 9.2e18)
    return (
        table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", able))
        .select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    )


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's rows as two byte strings: ids and a row-major matrix of the narrowest integers."""
    rows = np.stack(pdf["v"].to_numpy()).astype(np.int64)
    low, high = int(rows.min(initial=0)), int(rows.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    ids = pdf["vec_id"].to_numpy(np.int64)
    order = np.argsort(ids, kind="stable")
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "width": [rows.shape[1]], "kind": [np.dtype(kind).str], "ids": [ids[order].tobytes()], "rows": [rows[order].astype(kind).tobytes()]})


def _unpacked(r) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r.ids, np.int64)
    return ids, np.frombuffer(r.rows, np.dtype(r.kind)).reshape(len(ids), r.width)


def blocks_of(vectors: DataFrame, rows: int) -> DataFrame:
    """(block, width, kind, ids, rows): about `rows` vectors of one length to a block."""
    sizes = vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    parted = vectors.withColumn("width", F.size("v")).join(F.broadcast(sizes), "width")  # one row a vector length
    spot = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / rows).cast("long"))
    return parted.select("vec_id", "v", F.concat_ws(":", "width", spot).alias("block")).groupBy("block").applyInPandas(_pack, "block string, width int, kind string, ids binary, rows binary")


class SortedLists:
    """A block's rows and, for each dimension, their order by component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)  # [dimension, rank]
        self.values = np.take_along_axis(rows.T, self.order, axis=1).astype(np.int64)
        self.most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
        self.scored = 0

    def _numbers(self, queries: np.ndarray):
        """The type in which every sum of products is exact: floats as far as they hold it, else Python's integers."""
        top = max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0)))) * self.most * max(queries.shape[1], 1)
        return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query, ids and scores of the k best rows but its own, by the threshold algorithm."""
        kind = self._numbers(queries)
        rows, q = self.rows.astype(kind), queries.astype(kind)
        reads = [_Reading(self, rows, int(i), queries[n], q[n], k) for n, i in enumerate(query_ids)]
        for r in reads:
            while not r.done:
                r.go_on()
        self.scored += sum(r.n_scored for r in reads)
        return [(r.ids, r.scores) for r in reads]


class _Reading:
    """How far one query has read a block's lists, and its best rows so far."""

    def __init__(self, lists: SortedLists, rows: np.ndarray, own: int, query: np.ndarray, q: np.ndarray, k: int):
        self.lists, self.rows, self.own, self.q, self.k = lists, rows, own, q, k
        self.up, self.down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        self.weights = [q[self.up], q[self.down]]
        self.seen, self.n_scored = np.zeros(len(lists.ids), dtype=bool), 0
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        self.at, self.step, self.done = 0, DEPTH, False

    def go_on(self) -> None:
        """Reads all lists some entries deeper and scores the rows that turn up in them for the first time, no others."""
        lists, n = self.lists, len(self.seen)
        stop = min(self.at + self.step, n)
        if not len(self.up) and not len(self.down):
            stop = n  # a query of zeros scores every row alike
            fresh = np.arange(n)
        else:
            new = np.zeros(n, dtype=bool)
            new[lists.order[self.up, self.at : stop].ravel()] = True
            new[lists.order[self.down, n - stop : n - self.at].ravel()] = True
            fresh = np.flatnonzero(new & ~self.seen)
        self.seen[fresh] = True
        got = self.rows[fresh] @ self.q
        self.n_scored += len(got)
        if len(self.ids) == self.k:
            near = got >= self.scores[-1]
            fresh, got = fresh[near], got[near]
        other = lists.ids[fresh] != self.own
        self._keep(np.concatenate([self.ids, lists.ids[fresh[other]]]), np.concatenate([self.scores, got[other]]))
        if stop == n or self.n_scored == n:
            self.done = True
        elif len(self.ids) == self.k:
            kind = np.float64 if self.q.dtype != object else object
            edges = [lists.values[self.up, stop - 1], lists.values[self.down, n - stop]]
            bound = sum((e.astype(kind) @ w.astype(kind) for e, w in zip(edges, self.weights, strict=True) if len(w)), 0)
            self.done = bool(bound < self.scores[-1])
        self.at, self.step = stop, self.step * 2

    def _keep(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > 4 * self.k and scores.dtype != object:
            able = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            ids, scores = ids[able], scores[able]
        best = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        self.ids, self.scores = ids[best], scores[best]


def _longs(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(x), _LONG[0]), _LONG[1]) for x in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


def _matches(k: int, count: bool):
    """Rows of one cell; a score that is no long travels in whole as text besides."""

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0, np.int64)], "exact": []}
        for c in candidates.itertuples():
            lists = SortedLists(*_unpacked(c))
            if count:
                asked = 0
            for r in queries.itertuples():
                query_ids, rows = _unpacked(r)
                if count:
                    asked += len(query_ids)
                for q, (ids, scores) in zip(query_ids, lists.top(query_ids, rows, k), strict=True):
                    out["query_id"].append(np.full(len(ids), q))
                    out["vec_id"].append(ids)
                    out["score"].append(_longs(scores))
                    out["exact"] += [str(x) if not _LONG[0] <= x <= _LONG[1] else None for x in scores] if scores.dtype == object else [None] * len(ids)
            if count:
                return pd.DataFrame({"pairs": [asked * len(lists.ids)], "scored": [lists.scored]})
        return pd.DataFrame({c: np.concatenate(v) if c != "exact" else pd.Series(v, dtype=object) for c, v in out.items()})

    return run


def _cells(vectors: DataFrame, queries: DataFrame):
    """Candidate blocks and query blocks, grouped together cell by cell.

    Only names and counts of blocks are listed with the other side; the blocks themselves meet in
    their cell: the stated query set against all rows, in blocks.
    """
    candidate = written(blocks_of(vectors, CANDIDATE_ROWS), "topk-candidates")
    query = written(blocks_of(queries, QUERY_ROWS), "topk-queries")
    tile = F.floor(F.element_at(F.split("block", ":"), 2).cast("long") / QUERY_TILE)
    tiled = query.withColumn("tile", tile)
    tiles = tiled.groupBy("width").agg((F.max("tile") + 1).alias("tiles"))
    blocks = candidate.groupBy("width").agg(F.max(F.element_at(F.split("block", ":"), 2).cast("long")).alias("last"))
    left = candidate.join(tiles, "width").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop("tiles")
    right = tiled.join(blocks, "width").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    right = right.select(F.concat_ws(":", "width", "cell").alias("block"), "width", "kind", "ids", "rows", "tile")
    return left.select("block", "width", "kind", "ids", "rows", "tile").groupBy("block", "tile").cogroup(right.groupBy("block", "tile"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, itself excepted.

    `vectors` and `queries` come from whole_vectors().
    """
    found = _cells(vectors, queries).applyInPandas(_matches(k, False), "query_id long, vec_id long, score long, exact string")
    # beyond a long, exact scores rank by sign, then by length and digits of the integer
    size, sign = F.length("exact"), F.when(F.col("score") < 0, -1).otherwise(1)
    big = F.col("exact").isNotNull()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.when(big, sign * size).desc(), F.when(big & (sign > 0), F.col("exact")).desc(), F.when(big & (sign < 0), F.col("exact")), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def rows_scored(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """pairs, scored: the pairs of queries and candidates, and those that the algorithm scored, in all."""
    return _cells(vectors, queries).applyInPandas(_matches(k, True), "pairs long, scored long").agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))
