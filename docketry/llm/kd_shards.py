"""Shards by k-d tree: equal texts stay together, sizes come out near equal.

A point stands for one distinct text with the bytes of all its copies as weight. Its coordinates
are metadata: smallest doc_id, size, source and language, each spread over [0, 1]. A node is cut
at the weighted median of its widest coordinate, found by histograms that all workers fill
together and that are refined inside the bucket of the median; only the few bucket sums of a node
reach the driver. Leaves are cut until they hold at most the target bytes.

Everything on this path is DataFrame expressions. Rows meet their point's leaf in one join without
texts, and slots come from per-block row numbers plus block offsets, so no shard is sorted in one
task.

Defined results: a null text has no bytes and size 1, and null and empty texts are one group; null doc_id, lang or source take coordinate 0; repeated rows are rows of their own
with slots of their own; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm._shared import written

AXES = ("at_id", "at_size", "at_source", "at_lang")
#: Buckets of a histogram pass, passes at most, and the share of a node's weight at which its cut is fine enough.
BUCKETS, PASSES, FINE = 256, 5, 0.0005
#: Share of a node's weight by which its halves may differ before another axis is tried.
UNEVEN = 0.004
#: Rows of a block, inside which one task numbers rows.
BLOCK_ROWS = 20_000


@dataclass
class Cut:
    node: int
    axis: str
    value: float
    off: float = 0.0  # how far the lighter side lies under half of the node's weight, as a share of it


def _spread(col: Column) -> Column:
    """A category's place in [0, 1), the texts of one category spread over its share."""
    place = F.pmod(F.xxhash64(col), F.lit(1 << 20)).cast("double")
    return F.when(col.isNull(), F.lit(0.0)).otherwise((place + F.col("u")) / float(1 << 20))


def sized_rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").__add__(F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )


GROUP = ("key", "text_crc32", "size")


def points(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its weight in bytes and its coordinates."""
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("weight"), F.min("doc_id").alias("first_id"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    u = F.pmod(F.xxhash64("key", F.lit("spread")), F.lit(1 << 30)) / float(1 << 30)
    ids = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("size").alias("most")).first()
    lo, width = float(ids["lo"] or 0), max(float((ids["hi"] or 0) - (ids["lo"] or 0)), 1.0)
    most = float(ids["most"] or 1) + 1.0
    placed = groups.withColumn("u", u)
    return placed.select(
        *GROUP,
        "weight",
        F.coalesce((F.col("first_id") + F.col("u") - lo) / (width + 1.0), F.lit(0.0)).alias("at_id"),
        (F.log2(F.col("size") + F.col("u")) / F.log2(F.lit(most + 1.0))).alias("at_size"),
        _spread(F.col("source")).alias("at_source"),
        _spread(F.col("lang")).alias("at_lang"),
    )


def node_of(cuts: list[Cut], label: dict[int, int] | None = None) -> Column:
    """The node a point lies in (root 1, children 2n and 2n + 1), or that node's label."""
    by_node = {c.node: c for c in cuts}

    def below(n: int) -> Column:
        if n not in by_node:
            return F.lit(n if label is None else label[n])
        c = by_node[n]
        return F.when(F.col(c.axis) < F.lit(c.value), below(2 * n)).otherwise(below(2 * n + 1))

    return below(1)


def _medians(pts: DataFrame, at: Column, axis: dict[int, str], bounds: dict[int, tuple[float, float]], weight: dict[int, float]) -> list[Cut]:
    """The weighted median of each node's axis, by histograms refined around it."""
    found: dict[int, Cut] = {}
    nearer: dict[int, Cut] = {}  # the better edge so far, for a node whose passes end
    before = dict.fromkeys(axis, 0.0)

    def nearer_edge(n: int, low: float, width: float, under: float, w: float) -> Cut:
        short, over = weight[n] / 2 - under, under + w - weight[n] / 2
        return Cut(n, axis[n], low if short < over else low + width, min(short, over) / weight[n])

    for _ in range(PASSES):
        left = [n for n in axis if n not in found]
        if not left:
            break
        value, lo, hi = F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)
        for n in left:
            value = F.when(F.col("node") == n, F.col(axis[n])).otherwise(value)
            lo = F.when(F.col("node") == n, F.lit(bounds[n][0])).otherwise(lo)
            hi = F.when(F.col("node") == n, F.lit(bounds[n][1])).otherwise(hi)
        spots = pts.select(at.alias("node"), *AXES, "weight").where(F.col("node").isin(left)).select("node", "weight", value.alias("x"), lo.alias("lo"), hi.alias("hi"))
        inside = spots.where("x >= lo AND x < hi").select("node", "weight", F.least(F.lit(BUCKETS - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS)).alias("bucket"))
        sums: dict[int, list[tuple[int, float]]] = {n: [] for n in left}
        for r in inside.groupBy("node", "bucket").agg(F.sum("weight").alias("w")).collect():  # at most BUCKETS rows a node
            sums[r["node"]].append((r["bucket"], float(r["w"])))
        for n in left:
            half, total, (a, b) = weight[n] / 2, before[n], bounds[n]
            width = (b - a) / BUCKETS
            for bucket, w in sorted(sums[n]):
                if total + w >= half:
                    low = a + bucket * width
                    if w <= FINE * weight[n] or width < 1e-13:
                        found[n] = nearer_edge(n, low, width, total, w)
                    else:
                        bounds[n], before[n] = (low, low + width), total
                        nearer[n] = nearer_edge(n, low, width, total, w)
                    break
                total += w
    return [found.get(n) or nearer[n] for n in axis if n in found or n in nearer]


def kd_cuts(pts: DataFrame, target_bytes: float, depth: int) -> list[Cut]:
    """Cuts, parents first, until every leaf holds at most `target_bytes` or lies `depth` deep."""
    cuts: list[Cut] = []
    done: set[int] = set()
    for level in range(depth):
        at = node_of(cuts)
        aggs = [f(a).alias(f"{k}_{a}") for a in AXES for k, f in (("lo", F.min), ("hi", F.max))]
        found = pts.select(at.alias("node"), *AXES, "weight").groupBy("node").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *aggs).collect()
        widths, edges, weight = {}, {}, {}
        for r in sorted(found, key=lambda r: r["node"]):
            n = r["node"]
            if n < 1 << level or n in done or r["w"] <= target_bytes or r["n"] < 2:
                done.add(n)
                continue
            edges[n] = {a: (r[f"lo_{a}"], r[f"hi_{a}"]) for a in AXES}
            widths[n] = sorted((a for a in AXES if edges[n][a][1] > edges[n][a][0]), key=lambda a: (edges[n][a][0] - edges[n][a][1], AXES.index(a)))
            if not widths[n]:
                done.add(n)
                continue
            weight[n] = float(r["w"])
        best: dict[int, Cut] = {}
        for k in range(len(AXES)):  # a heavy group on the median of the widest axis: try the next one
            axis = {n: w[k] for n, w in widths.items() if k < len(w) and (n not in best or best[n].off > UNEVEN)}
            if not axis:
                break
            bounds = {n: (edges[n][a][0], edges[n][a][1] * (1 + 1e-9) + 1e-12) for n, a in axis.items()}
            for c in _medians(pts, at, axis, bounds, weight):
                if c.node not in best or c.off < best[c.node].off:
                    best[c.node] = c
        if not best:
            break
        cuts += best.values()
    return cuts


def leaf_numbers(cuts: list[Cut], depth: int) -> dict[int, int]:
    """Leaves by place at the tree's foot: a leaf above it takes its first place there."""
    cut = {c.node for c in cuts}
    leaves = {1} if not cut else {child for n in cut for child in (2 * n, 2 * n + 1) if child not in cut}
    return {n: (n << (depth - (n.bit_length() - 1))) - (1 << depth) for n in leaves}


def kd_shards(docs: DataFrame, depth: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (0 to 2^depth - 1), slot, grown_shard.

    The target of a leaf is the table's bytes over 2^depth; medians halve each node, so leaves at
    the tree's foot are near that size unless one group of equal texts is larger than a leaf.
    """
    rows = written(sized_rows(docs), "shard-rows")
    pts = written(points(rows), "shard-points")
    total = pts.agg(F.sum("weight")).first()[0] or 0
    cuts = kd_cuts(pts, 0.5 * total / (1 << depth), depth)
    homes = pts.select(*GROUP, node_of(cuts, leaf_numbers(cuts, depth)).cast("int").alias("shard"))
    blocks = max(1, (rows.count() // (1 << depth)) // BLOCK_ROWS + 1)
    placed = written(
        rows.join(homes, list(GROUP)).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")),
        "shard-placed",
    )
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """Gapless slots: the row's number in its block after the rows of the shard's earlier blocks."""
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    earlier = sizes.selectExpr("shard", "block", "CAST(SUM(n) OVER (PARTITION BY shard ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before")
    in_block = placed.selectExpr("*", "ROW_NUMBER() OVER (PARTITION BY shard, block ORDER BY doc_id, text_crc32) AS nth")
    return in_block.join(earlier, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.coalesce("before", F.lit(0)) + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
