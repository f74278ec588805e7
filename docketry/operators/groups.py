"""Groups of documents that look alike, by word runs of their texts: candidates, exact checks, connected components.

Bands of minima find most links at little cost and fold large groups; a join by prefixes then finds every link
between the groups that are left, so none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import normal_period
from docketry.operators.joins import held, small

#: Word runs and likeness of a pair, bands and minima of a band. At a likeness of 0.5 a pair shares a band with probability 0.995.
RUN, LIKE, BANDS, ROWS = 3, 0.5, 40, 3
#: Documents of a run that are met at once, about: a run of more is dealt out in blocks. No document is left out.
AT_ONCE = 1000
#: Ids that are broadcast to run sets, at most: so many take some 20 MB; of more, run sets and ids meet by a shuffle.
MOST_IDS = 500_000


def run_hashes(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, runs: the distinct hashes of each text's word runs, of texts of that many words."""
    words = F.filter(F.split(F.expr(normal_period("text")), " "), lambda w: w != "")
    cut = docs.select("doc_id", words.alias("words")).where(F.size("words") >= run)
    runs = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - run), lambda k: F.xxhash64(F.slice("words", k + 1, run)))))
    return cut.select("doc_id", runs.alias("runs"))


def candidate_links(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """a < b: ids that share a band of minima: each member of a bucket with the bucket's smallest id, never all pairs."""
    minima = [f"array_min(transform(runs, h -> xxhash64(h, {k})))" for k in range(bands * rows)]  # a hash function for each k
    table = docs.select("doc_id", F.array(*[F.expr(m) for m in minima]).alias("m"))
    keys = F.expr(f"transform(sequence(0, {bands - 1}), b -> struct(b AS band, xxhash64(slice(m, b * {rows} + 1, {rows})) AS key))")
    members = table.select("doc_id", F.inline(keys))
    least = members.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return members.join(least, ["band", "key"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()


def links_between(docs: DataFrame, like: float = LIKE, at_once: int = AT_ONCE) -> DataFrame:
    """a, a_group, b, b_group: every pair of different groups that can be `like` alike, and few that are not.

    docs: doc_id, group_id, runs. Two documents that are alike have like / (1 + like) of both sizes in
    common, so in any one order of all runs the first of each document (its prefix; the smaller one's
    is shorter) hold a common run. Runs of one group alone go first in that order, as they link nothing,
    then those of few documents. A run's documents of one group are one row, or one for some `at_once`
    of them, and rows of one group never meet.
    """
    here = Window.partitionBy("run")
    shown = docs.select("doc_id", "group_id", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    between = F.min("group_id").over(here) < F.max("group_id").over(here)
    open_runs = shown.withColumns({"ids": F.count("*").over(here), "between": between}).where("between").groupBy("doc_id", "group_id", "n").agg(F.array_sort(F.collect_list(F.struct("ids", "run"))).alias("open"))
    # the least that a pair has in common: of the larger one's size, of the smaller one's, of both (a whole number stays one)
    of_large, of_small, of_both = (lambda n, share=share: f"ceil({share!r}D * {n} - 1e-9D)" for share in (like, 2 * like / (1 + like), like / (1 + like)))
    placed = open_runs.where(f"size(open) >= {of_large('n')}").select("doc_id", "group_id", "n", F.expr("n - size(open)").alias("before"), F.posexplode("open").alias("i", "x"))
    prefix = placed.select("group_id", "x.ids", "x.run", F.struct("doc_id", "n", F.expr("before + i + 1").alias("place")).alias("member")).where(f"member.place <= member.n - {of_large('member.n')} + 1")
    rows = prefix.withColumn("between", between).where("between").withColumn("part", F.expr(f"pmod(xxhash64(member.doc_id), 1 + ids div {at_once})")).groupBy("run", "group_id", "part").agg(F.first("ids").alias("ids"), F.collect_list("member").alias("members"))
    # a run of many documents is met block by block, in as many tasks
    left = rows.select("run", F.col("group_id").alias("a_group"), F.col("members").alias("a_members"), F.explode(F.expr(f"sequence(0, ids div {at_once})")).alias("block"))
    shorter = F.expr(f"filter(members, m -> m.place <= m.n - {of_small('m.n')} + 1)")
    right = rows.select("run", F.col("group_id").alias("b_group"), shorter.alias("b_members"), F.expr(f"pmod(xxhash64(group_id, part), 1 + ids div {at_once})").alias("block")).where("size(b_members) > 0")
    met = left.join(right, ["run", "block"]).where("a_group <> b_group").select("a_group", "b_group", F.explode("a_members").alias("x"), "b_members").select("a_group", "b_group", "x", F.explode("b_members").alias("y"))
    able = met.where(f"(y.n < x.n OR y.n = x.n AND y.doc_id < x.doc_id) AND y.n >= {of_large('x.n')} AND 1 + least(x.n - x.place, y.n - y.place) >= {of_both('(x.n + y.n)')}")
    return able.select(F.col("x.doc_id").alias("a"), "a_group", F.col("y.doc_id").alias("b"), "b_group").distinct()


def like_pairs(docs: DataFrame, links: DataFrame, like: float = LIKE) -> DataFrame:
    """a, b, similarity: those links whose run sets are at least `like` alike, exactly."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("runs").alias("a_runs"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("runs").alias("b_runs"))
    both = links.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("a_runs", "b_runs"))
    return both.select("a", "b", (shared / (F.size("a_runs") + F.size("b_runs") - shared)).alias("similarity")).where(F.col("similarity") >= like)


def components(links: DataFrame) -> DataFrame:
    """member, root: the smallest id that each linked id (long) is joined to, by alternating large and small stars.

    A round is two aggregates and two joins over the links that are left; their number falls with the
    logarithm of the longest chain. Every round's links are checkpointed, none leave the executors.
    """
    edges = held(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = held(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    ids = edges.select(F.col("v").alias("member")).distinct().select("member", F.col("member").alias("root"))
    return edges.select(F.col("u").alias("member"), F.col("v").alias("root")).unionByName(ids)


def alike_groups(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id, group_id, members: documents whose texts are alike, directly or through others; those alone are left out.

    docs: doc_id (long), text. Equal run sets stand for one another, so a group of copies is one row
    until its members are counted.
    """
    # copies find their class by the run set's hashes and size, not by the set
    key = ["x", "y", "z"]
    runs = held(run_hashes(docs).select("doc_id", "runs", F.xxhash64("runs").alias("x"), F.hash("runs").alias("y"), F.size("runs").alias("z")))
    copies = held(runs.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("ids")))
    one = runs.join(small(copies.select("doc_id", *key), MOST_IDS), ["doc_id", *key], "left_semi").select("doc_id", "runs")
    roots = components(like_pairs(one, candidate_links(one), like))
    named = held(copies.join(roots, F.col("doc_id") == F.col("member"), "left").select("doc_id", *key, "ids", F.coalesce("root", "doc_id").alias("group_id")))
    # bands may pass over a link; what they left apart is joined exactly, and groups are joined by their names
    between = held(links_between(one.join(small(named.select("doc_id", "group_id"), MOST_IDS), "doc_id"), like))
    links = between.join(like_pairs(one, between.select("a", "b"), like).select("a", "b"), ["a", "b"]).select(F.col("a_group").alias("a"), F.col("b_group").alias("b"))
    named = named.join(components(links), F.col("group_id") == F.col("member"), "left").select(*key, "ids", F.coalesce("root", "group_id").alias("group_id"))
    counted = named.groupBy("group_id").agg(F.sum("ids").alias("members")).where("members > 1")
    return runs.select("doc_id", *key).join(named.join(counted, "group_id"), key).select("doc_id", "group_id", "members")
