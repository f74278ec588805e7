"""Near-duplicate texts by DartMinHash signatures, banded joining and an exact check.

A text is the set of its runs of five words (of a text with fewer words, one run of all of them),
each with a weight: 1, or with weights="count" its number of occurrences. Darts fall on every
element as a fixed random process over (weight, rank); those inside the element's weight region,
earliest ranks first, are dealt to SIGNATURE coordinates, and the earliest dart of each coordinate
is the signature. Only ranks up to a bound in proportion to 1 / total weight are thrown, and the
bound is doubled for texts with coordinates still empty, so a text costs about
SIGNATURE * ln SIGNATURE darts, however long it is.

Equal texts are one class from the start. Classes that agree on a band are candidates. In a large
bucket they are first compared with one hub, the class that shares most bands with others, then with
a second hub that the first did not reach; only those that stay apart are compared in blocks, so a
group of thousands of near copies needs thousands of comparisons and not their square. Every
candidate pair is checked by the exact similarity of the whole sets, and classes linked by pairs of
at least `threshold` form one group.

No join puts a hot key's rows into one task: tables with one row per bucket, hub or text join by
`spread_join`, and block pairs are dealt out in cells.

Defined results: a text without words is a class with its exact equals only, and a null text is a
class of its own row. class_id is the smallest doc_id of the group (null when it has none). Of rows
that repeat a doc_id with one text, all are in one class. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import Scratch, spread_join, text_key, unused
from docketry.llm._words import buffer_of, mix, row_groups, window_hashes, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of ROWS coordinates each: a pair of similarity 0.8 misses all bands once in 300,000 times.
BANDS, ROWS = 42, 6
SIGNATURE = BANDS * ROWS
#: A bucket with more classes is compared with its hub first.
SMALL_BUCKET = 12
#: Rounds of hub comparisons before what stays apart is compared in blocks.
HUB_ROUNDS = 2
#: Classes in a block, and elements of their sets, about.
BLOCK, BLOCK_ELEMENTS = 128, 1 << 16
#: Blocks along each side of a cell of block pairs.
TILE = 4
#: Pairs of one class that meet one copy of its set.
PER_COPY = 512

_POISSON = np.cumsum([np.exp(-1.0) / float(f) for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])
_UNIT = 1.0 / (1 << 53)
_RANK_BITS = 40


def shingles(buf, rows: slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row within the run, shingle, occurrences): the weighted set of each text."""
    w = words_of(buf, rows)
    row, code = window_hashes(w, size)
    per_row = np.bincount(w.row - rows.start, minlength=rows.stop - rows.start)
    few = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(few):
        first = np.searchsorted(w.row, few + rows.start)
        extra = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            have = per_row[few] > k
            extra[have] = mix(extra[have] + w.hash[first[have] + k] + np.uint64(k + 1))
        row, code = np.concatenate([row, few + rows.start]), np.concatenate([code, extra])
    row = row - rows.start
    key = mix(code + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(row[first], kind="stable")
    return row[first][order], code[first][order], count[order]


def _throw(element: np.ndarray, weight: np.ndarray, row: np.ndarray, level: np.ndarray, coordinates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of the cells (element, weight unit, rank unit): row, coordinate and rank of each inside its region.

    A unit cell holds a Poisson(1) number of darts; level: the rank units of each element.
    """
    units = np.ceil(weight).astype(np.int64)
    cells = units * level
    at = np.repeat(np.arange(len(element)), cells)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    unit, rank = nth // level[at], nth % level[at]
    cell = mix(element[at] + unit.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + rank.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(np.float64) * _UNIT, side="right")
    which = np.repeat(np.arange(len(at)), darts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(cell[which] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    height = (mix(dart) >> np.uint64(11)).astype(np.float64) * _UNIT + unit[which]
    src = at[which]
    inside = height <= weight[src]
    dart, src, which = dart[inside], src[inside], which[inside]
    low = dart & np.uint64((1 << _RANK_BITS) - 1)
    return row[src], ((dart >> np.uint64(_RANK_BITS)) % np.uint64(coordinates)).astype(np.int64), (rank[which].astype(np.uint64) << np.uint64(_RANK_BITS)) | low


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, coordinates: int = SIGNATURE) -> np.ndarray:
    """[n, coordinates] earliest ranks; rows without elements keep the largest value."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, coordinates), none, np.uint64)
    total = np.bincount(row, weights=weight, minlength=n)
    want = coordinates * np.log(coordinates) + 2 * coordinates
    todo = total > 0
    reach = np.ones(n, np.int64)
    reach[todo] = np.maximum(1, np.ceil(want / total[todo])).astype(np.int64)
    while todo.any():
        use = np.flatnonzero(todo[row])
        cells = np.cumsum(reach[row[use]] * np.ceil(weight[use]).astype(np.int64))
        a = 0
        while a < len(use):
            b = max(a + 1, int(np.searchsorted(cells, (cells[a - 1] if a else 0) + 400_000)))
            part = use[a:b]
            r, c, rank = _throw(element[part], weight[part], row[part], reach[row[part]], coordinates)
            np.minimum.at(out.reshape(-1), r * coordinates + c, rank)
            a = b
        # a coordinate's earliest dart is known once it lies within the ranks that were thrown
        todo &= (out == none).any(axis=1)
        reach[todo] *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    got = np.zeros((len(signature), bands), np.uint64)
    cut = signature.reshape(len(signature), bands, rows)
    for k in range(rows):
        got = mix(got + cut[:, :, k] + np.uint64(k + 1))
    return got.view(np.int64)


def _signed(weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf = buffer_of(b.column("text"))
            for rows in row_groups(buf):
                n = rows.stop - rows.start
                row, code, count = shingles(buf, rows)
                weight = count.astype(float) if weights == "count" else np.ones(len(row))
                bands = band_hashes(dart_signatures(row, code, weight, n))
                sizes = np.bincount(row, weights=weight, minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
                keep = [b.column(c).slice(rows.start, n) for c in ("doc_id", "key_a", "key_b", "key_n")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes), lists], names=["doc_id", "key_a", "key_b", "key_n", "size", "bands"])

    return run


def _sets(weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf = buffer_of(b.column("text"))
            for rows in row_groups(buf):
                n = rows.stop - rows.start
                row, code, count = shingles(buf, rows)
                if weights == "count":  # the k-th occurrence is an element of its own
                    at = np.repeat(np.arange(len(row)), count)
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                    row, code = row[at], mix(code[at] + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("uid").slice(rows.start, n), lists], names=["uid", "elements"])

    return run


KEY = ["key_a", "key_b", "key_n"]


def signatures(docs: DataFrame, weights: str = "set") -> DataFrame:
    """uid, doc_id, the text's key, its total weight and its band hashes, one row per document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", *text_key())
    schema = "doc_id long, key_a long, key_b long, key_n long, size double, bands array<long>"
    return slim.mapInArrow(_signed(weights), schema).withColumn("uid", F.monotonically_increasing_id())


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, weights: str, scratch: Scratch) -> DataFrame:
    """uid, elements: the whole set of each wanted class, from one of its rows, found by its id and text."""
    ours = classes.join(wanted, "uid").select("uid", *[F.col(k).alias(f"our_{k}") for k in KEY], F.col("doc_id").alias("row_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", *text_key()).where("text IS NOT NULL")
    same = F.col("doc_id").eqNullSafe(F.col("row_id"))
    for k in KEY:
        same = same & (F.col(k) == F.col(f"our_{k}"))
    found = texts.join(ours, same).select("uid", "text")
    return scratch.written(found.mapInArrow(_sets(weights), "uid long, elements array<long>").dropDuplicates(["uid"]), "sets")


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str, total: int, scratch: Scratch, often: DataFrame | None = None) -> DataFrame:
    """pairs with the whole set of their class `side`; a hub's set is copied once for every PER_COPY of its pairs."""
    often = often or scratch.by_key(pairs.groupBy(side).agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / PER_COPY).cast("long")), "often")
    dealt = spread_join(pairs, often, [side], total).withColumn("copy", F.pmod(F.xxhash64("a", "b"), F.col("copies"))).drop("n", "copies")
    copied = sets.join(often.withColumnRenamed(side, "uid"), "uid").select(F.col("uid").alias(side), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("elements").alias(f"e{side}"))
    return dealt.join(copied, [side, "copy"]).drop("copy")


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by intersecting the whole sets."""
    pairs, seen = scratch.measured(pairs, "pairs", n=F.count("*"))
    one = _with_sets(pairs, sets, "a", seen["n"], scratch)
    often = scratch.by_key(pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / PER_COPY).cast("long")), "often")
    joined = _with_sets(one, sets, "b", seen["n"], scratch, often).withColumn("both", F.size(F.array_intersect("ea", "eb")))
    return scratch.written(joined.where(F.col("both") >= threshold * (F.size("ea") + F.size("eb") - F.col("both"))).select("a", "b"), "links")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, root: the smallest uid that each linked uid reaches, by large-star and small-star rounds."""
    edges, seen = scratch.measured(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", n=F.count("*"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        least, of = scratch.measured(stars, "least", most=F.coalesce(F.max("n"), F.lit(0)), open=F.count_if((F.col("m") != F.col("a")) & (F.col("n") > 1)))
        if not of["open"]:
            break  # whoever is not the smallest of its neighbours has one alone: every component is a star around its smallest
        least.most_rows_of_a_key = of["most"]
        large = spread_join(both.where("b > a"), least, ["a"], 2 * seen["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = scratch.written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "down")
        low = scratch.by_key(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = spread_join(down, low, ["a"], 2 * seen["n"]).select("b", "m").union(low.select("a", "m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges, seen = scratch.measured(small, "edges", n=F.count("*"))
    return edges.select(F.col("a").alias("uid"), F.col("b").alias("root"))


def _alike(x: str, y: str, threshold: float) -> F.Column:
    """Sets of too different sizes cannot be similar enough."""
    return (F.least(F.col(x), F.col(y)) >= threshold * F.greatest(F.col(x), F.col(y))) & (F.greatest(F.col(x), F.col(y)) > 0)


BUCKET = ["band", "h"]


def linked_classes(docs: DataFrame, classes: DataFrame, threshold: float, weights: str, scratch: Scratch) -> DataFrame:
    """uid, root of the classes of different texts that belong together."""
    total = classes.count()  # rows of a band; a hot bucket holds more than one in HOT_KEYS of them, so at most HOT_KEYS buckets a band are hot
    spread = classes.where("size > 0").select("uid", "size", F.posexplode("bands").alias("band", "h"))
    full = scratch.by_key(spread.groupBy(*BUCKET).agg(F.count("*").alias("n")).where("n > 1"), "full")
    member = scratch.written(spread_join(spread, full, BUCKET, total), "buckets")
    sets = _whole_sets(docs, classes, member.select("uid").distinct(), weights, scratch)
    small = member.where(F.col("n") <= SMALL_BUCKET)
    a = small.select(*BUCKET, F.col("uid").alias("a"), F.col("size").alias("sa"))
    b = small.select(*BUCKET, F.col("uid").alias("b"), F.col("size").alias("sb"))
    pairs = a.join(b, BUCKET).where((F.col("a") < F.col("b")) & _alike("sa", "sb", threshold)).select("a", "b").distinct()

    share = member.groupBy("uid").agg(F.sum("n").alias("share"))
    big = member.where(F.col("n") > SMALL_BUCKET).join(share, "uid").select(*BUCKET, "n", "uid", "size", "share", F.col("uid").alias("root"))
    big = scratch.written(big.withColumn("first_hub", F.lit(None).cast("long")).withColumn("main", F.lit(None).cast("long")), "large")
    links = None
    for _ in range(HUB_ROUNDS):
        unmet = F.col("main").isNull() | (F.col("root") != F.col("main"))  # a later hub is one that the first did not reach
        hub = F.max(F.when(unmet, F.struct("share", F.negate("uid").alias("least"), "size", "root")))
        apart = big.groupBy(*BUCKET).agg(F.first("n").alias("n"), hub.alias("hub"), F.max("first_hub").alias("first_hub"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
        apart = scratch.by_key(apart.withColumn("first_hub", F.coalesce("first_hub", -F.col("hub.least"))).select(*BUCKET, "n", "hub", "first_hub"), "hubs")
        star = spread_join(big.drop("first_hub", "n"), apart, BUCKET, total).where((F.col("root") != F.col("hub.root")) & _alike("size", "hub.size", threshold))
        star = star.select(F.least(F.col("uid"), -F.col("hub.least")).alias("a"), F.greatest(F.col("uid"), -F.col("hub.least")).alias("b")).distinct()
        more = _checked(star if links is not None else pairs.union(star).distinct(), sets, threshold, scratch)
        links = more if links is None else scratch.written(links.union(more), "links")
        roots = components(links, scratch)
        heads = apart.select(*BUCKET, "n", "first_hub").join(roots.select(F.col("uid").alias("first_hub"), F.col("root").alias("main")), "first_hub", "left")
        heads = scratch.by_key(heads.withColumn("main", F.coalesce("main", "first_hub")), "heads")
        moved = big.drop("root", "first_hub", "main", "n").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        big = _still_apart(scratch.written(spread_join(moved, heads, BUCKET, total), "large"), total, scratch)
    return components(links.union(_linked_in_blocks(big, sets, threshold, total, scratch)), scratch)


def _linking(threshold: float):
    """Links between two blocks' classes of different roots, as few as join what they join."""

    def columns(lists: pa.ListArray, at: int):
        part = lists.slice(at, 1).flatten()
        sets = part.field("elements")
        numbers = [part.field(k).to_numpy(zero_copy_only=False) for k in ("uid", "root", "size")]
        return *numbers, sets.flatten().to_numpy(zero_copy_only=False), np.diff(sets.offsets.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("left_rows"), b.column("right_rows")
            for at in range(b.num_rows):
                ua, ra, na, ea, la = columns(left, at)
                ub, rb, nb, eb, lb = columns(right, at)
                fit = (ra[:, None] != rb) & (np.minimum(na[:, None], nb) >= threshold * np.maximum(na[:, None], nb))
                if not fit.any():
                    continue
                _, code, often = np.unique(np.concatenate([ea, eb]), return_inverse=True, return_counts=True)
                shared = often > 1  # the others are in no intersection
                column = (np.cumsum(shared) - 1)[code]
                use = shared[code]
                row = np.repeat(np.arange(len(ua) + len(ub)), np.concatenate([la, lb]))
                has = np.zeros((len(ua) + len(ub), int(shared.sum())), np.float32)
                has[row[use], column[use]] = 1
                both = has[: len(ua)] @ has[len(ua) :].T
                x, y = np.nonzero(fit & (both >= threshold * (na[:, None] + nb - both)))
                keep, parent = [], {}

                def find(r, parent=parent):
                    while parent.setdefault(r, r) != r:
                        r = parent[r]
                    return r

                for k, (i, j) in enumerate(zip(ra[x].tolist(), rb[y].tolist(), strict=True)):
                    i, j = find(i), find(j)
                    if i != j:
                        parent[max(i, j)] = min(i, j)
                        keep.append(k)
                x, y = x[keep], y[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ua[x], ub[y])), pa.array(np.maximum(ua[x], ub[y]))], names=["a", "b"])

    return run


def _linked_in_blocks(big: DataFrame, sets: DataFrame, threshold: float, total: int, scratch: Scratch) -> DataFrame:
    """a, b: links among the classes left in large buckets, by the exact similarity of whole sets.

    A bucket's classes lie in blocks of about BLOCK classes and at most about BLOCK_ELEMENTS
    elements. Classes that the first hub reached need no comparison with each other, so only the
    others' blocks are compared, with every block; no pair becomes a row unless it is a link.

    The pairs of blocks form a table with a row and a column per block, cut into cells of TILE by TILE
    blocks. A cell is a key of its own, so a bucket's work spreads over as many tasks as it has cells,
    and a block travels once for each cell of its row or column.
    """
    sided = big.withColumn("met", F.col("root") == F.col("main"))
    size = lambda met: F.ceil(F.greatest(F.count_if(met) / BLOCK, F.sum(F.when(met, F.col("size")).otherwise(0)) / BLOCK_ELEMENTS)).cast("long")
    parts = sided.groupBy(*BUCKET).agg(F.first("n").alias("n"), size(F.col("met")).alias("met_blocks"), size(~F.col("met")).alias("own_blocks")).where("own_blocks > 0")
    parts = scratch.by_key(parts, "parts")
    placed = spread_join(sided.drop("n"), parts, BUCKET, total)
    # blocks of one bucket are numbered through: those to compare first, then those that the hub reached
    first = F.pmod(F.xxhash64("uid", F.lit(7)), F.greatest(F.when(F.col("met"), F.col("met_blocks")).otherwise(F.col("own_blocks")), F.lit(1)))
    placed = placed.withColumn("block", F.when(F.col("met"), F.col("own_blocks") + first).otherwise(first))
    rows = F.collect_list(F.struct("uid", "root", "size", "elements"))
    blocks = placed.join(sets, "uid").groupBy(*BUCKET, "block", "met", "own_blocks", "met_blocks").agg(rows.alias("rows"))  # about BLOCK classes each
    blocks = scratch.written(blocks.withColumn("tile", F.floor(F.col("block") / TILE)), "blocks")
    last = lambda n: F.greatest(F.ceil(F.col(n) / TILE) - 1, F.lit(0)).cast("long")
    every = (F.ceil((F.col("own_blocks") + F.col("met_blocks")) / TILE) - 1).cast("long")
    x = blocks.where("NOT met").select(*BUCKET, F.col("block").alias("i"), F.col("tile").alias("row_tile"), F.explode(F.sequence(F.col("tile"), every)).alias("column_tile"), F.col("rows").alias("left_rows"))
    y = blocks.select(*BUCKET, "met", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(last("own_blocks"), F.col("tile")))).alias("row_tile"), F.col("tile").alias("column_tile"), F.col("rows").alias("right_rows"))
    both = x.join(y, [*BUCKET, "row_tile", "column_tile"]).where("met OR i <= j").select("left_rows", "right_rows")
    return scratch.written(both.mapInArrow(_linking(threshold), "a long, b long").distinct(), "links")


def _still_apart(big: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """The rows of buckets whose members do not yet share one root."""
    apart = big.groupBy(*BUCKET).agg(F.first("n").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select(*BUCKET, "n")
    return scratch.written(spread_join(big.drop("n"), scratch.by_key(apart, "still"), BUCKET, total), "apart")


OWN = "CASE WHEN key_n IS NULL THEN uid ELSE -1 END AS own"  # a null text equals no other


def grouped_texts(docs: DataFrame, threshold: float, weights: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows: uid, doc_id and the text's key; classes of equal texts: uid, key, own, doc_id, copies, root)."""
    signed = scratch.written(signatures(docs, weights), "signed", keep=True)
    classes = signed.groupBy(*KEY, F.expr(OWN)).agg(F.min("uid").alias("uid"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = scratch.written(classes, "classes")
    roots = linked_classes(docs, classes, threshold, weights, scratch)
    rooted = classes.select("uid", *KEY, "own", "doc_id", "copies").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    return signed, scratch.written(rooted, "rooted")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "set") -> DataFrame:
    """One row per document: doc_id, class_id, and class_size, the rows of its group."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    signed, rooted = grouped_texts(docs, threshold, weights, scratch)
    named = scratch.by_key(rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size")), "named")
    homes = spread_join(rooted, named, ["root"], rooted.count())
    key = ["a", "b", "length", "own"]
    flat = [F.coalesce("key_a", F.lit(0)).alias("a"), F.coalesce("key_b", F.lit(0)).alias("b"), F.coalesce("key_n", F.lit(-1)).alias("length")]
    homes = scratch.by_key(homes.select(*flat, "own", F.col("copies").alias("n"), "class_id", "class_size"), "homes", keep=True)
    rows = signed.select("doc_id", *flat, F.expr(OWN))
    out = spread_join(rows, homes, key, signed.count()).select("doc_id", "class_id", "class_size")
    scratch.clear()
    return out


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "set") -> DataFrame:
    """The rows of docs, all their columns, without near-duplicates: of each group one row stays.

    It is a row of the group's smallest doc_id, and of several such rows one of the smallest text
    key; a group whose rows all lack an id keeps one of them. Rows with a null text all stay.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    signed, rooted = grouped_texts(docs, threshold, weights, scratch)
    own, kept = unused(docs.columns, "own", "kept")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *KEY)
    least = rooted.where("key_n IS NOT NULL").groupBy("root").agg(F.min(order).alias("c"))
    chosen = scratch.written(least.select(F.struct("c.doc_id", *[f"c.{k}" for k in KEY]).alias(kept)), "chosen", keep=True)
    mine = [F.col("doc_id").cast("long"), *text_key(F.col("text").cast("string"))]
    named = docs.withColumn(own, F.struct(*[c.alias(k) for c, k in zip(mine, ["doc_id", *KEY], strict=True)])).where(F.col("text").isNotNull())
    same = F.col(own).eqNullSafe(F.col(kept))
    left = named.join(chosen, same, "left_semi")
    often = signed.where("key_n IS NOT NULL").groupBy("doc_id", *KEY).agg(F.count("*").alias("n")).where("n > 1")
    often = scratch.written(often.select(F.struct("doc_id", *KEY).alias(kept)), "often", keep=True)
    once = left.join(often, same, "left_anti").select(*docs.columns)
    repeated = left.join(often, same, "left_semi").dropDuplicates([own]).select(*docs.columns)
    scratch.clear()
    return once.unionByName(repeated).unionByName(docs.where(F.col("text").isNull()))
