"""Least edits that turn a damaged conversation into one of well-formed turns.

Rows are kept, given another role, deleted, or joined by inserted empty ones, until the role initials
read `(s?(ua)+)?`. Positions between rows and what may come next are the nodes of a lattice, edits
its edges. A bidirectional Dijkstra search finds the cheapest edits: a heap from the start and one
from the ends advance in turn, and when they have met, every crossing of the same cost is finished.
Then the least audit (the edits' initials, by ASCII) is read off the edges that lie on cheapest
ways: an audit names each row's fate and every insertion, so it leads to one node only, and taking
the least initial at each node gives the least audit of all.

Conversations are dealt out whole and sorted in their task, a bounded number of rows and bytes each.
A conversation over LONG_ROWS rows or LONG_BYTES bytes is cut into blocks by a range partition of its
rows instead, so no task holds it: blocks give the costs from each state to each, these are added up
from the end, every block is searched for each state that it can be entered in, and the ways are
joined. Only its hash, which is sequential by nature, is made by one task from a stream of its
repaired rows, in the memory of one batch.

Defined results: rows are ordered by turn, nulls first, then role and text. Null roles and texts are
one space, also in the damage's key; a null conv_id is a conversation of its own. A role's first
character decides; roles of other initials fit nowhere. Repeated rows are damaged alike; whichever of
equal rows comes first, the rest are duplicates. Empty tables give an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import Scratch

#: Rows and text bytes of a conversation that one task may hold; over them it is cut into blocks.
LONG_ROWS, LONG_BYTES = 100_000, 64 << 20
#: Rows of a block, about.
BLOCK_ROWS = 20_000
#: Ids of long conversations that are broadcast, at most: the limits above rise with the table so that there are no more.
MOST_LONG = 100_000

FAULTS = ("none", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing yet, after a system row, after a user, after an assistant. A conversation may end in the first and last.
STATES, ENDS = 4, (0, 3)
FAR = 1 << 60
#: The role that an insertion or a new role takes in a state, and the state it leads to.
NEXT_ROLE, NEXT_STATE = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: What each initial leads to from each state; None: not allowed.
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
LEGAL_PAIRS = ("su", "ua", "au")
BETWEEN_WORDS = " \t\n\x0b\x0c\r"


@dataclass
class Lattice:
    """initial and fault of each row; may_end: insertions after the last row are allowed here, not in a next block."""

    initial: list[str]
    fault: list[int]
    may_end: bool = True

    def __len__(self) -> int:
        return len(self.initial)

    def out(self, at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        """(at, state, cost, initial) of the edits that leave a node, by initial."""
        if at < len(self):
            fault = self.fault[at]
            yield at + 1, state, DELETE, "D"
        if at < len(self) or self.may_end:
            yield at, NEXT_STATE[state], INSERT, "I"
        if at < len(self) and fault not in (BLANK, DUPLICATE):
            more = CUT if fault == TRUNCATED else 0
            kept = STEP.get(self.initial[at], (None,) * STATES)[state]
            if kept is not None:
                yield at + 1, kept, KEEP + more, "K"
            yield at + 1, NEXT_STATE[state], REROLE + more, "R"

    def into(self, at: int, state: int) -> Iterator[tuple[int, int, int]]:
        """(at, state, cost) of the edits that reach a node."""
        if at < len(self) or self.may_end:
            for s in range(STATES):
                if NEXT_STATE[s] == state:
                    yield at, s, INSERT
        if at > 0:
            fault = self.fault[at - 1]
            yield at - 1, state, DELETE
            if fault not in (BLANK, DUPLICATE):
                more = CUT if fault == TRUNCATED else 0
                kept = STEP.get(self.initial[at - 1], (None,) * STATES)
                for s in range(STATES):
                    if kept[s] == state:
                        yield at - 1, s, KEEP + more
                    if NEXT_STATE[s] == state:
                        yield at - 1, s, REROLE + more


def search(lattice: Lattice, start: int, end_cost: list[int]) -> tuple[int, str, int] | None:
    """(cost, least audit, state at the end) of the cheapest edits from a state; end_cost: what is still to pay in each end state."""
    n = len(lattice)
    ahead = {start: 0}  # node = at * STATES + state
    behind = {n * STATES + s: c for s, c in enumerate(end_cost) if c < FAR}
    heaps = [[(0, start)], [(c, v) for v, c in behind.items()]]
    heapq.heapify(heaps[1])
    settled: tuple[set[int], set[int]] = (set(), set())
    best = min((c for v, c in behind.items() if v == start), default=FAR)
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:  # equal costs are finished
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        cost, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        at, state = divmod(node, STATES)
        mine, other = (ahead, behind) if side == 0 else (behind, ahead)
        for to_at, to_state, step, *_ in lattice.out(at, state) if side == 0 else lattice.into(at, state):
            to, total = to_at * STATES + to_state, cost + step
            if total < mine.get(to, FAR):
                mine[to] = total
                heapq.heappush(heaps[side], (total, to))
            if to in other:
                best = min(best, total + other[to])
    if best >= FAR:
        return None
    # Crossings: edges from what the forward search has reached to what the backward one has, at the least cost in all.
    on_way = {v for v in ahead if ahead[v] + behind.get(v, FAR) == best}
    stack = list(on_way)
    while stack:  # back along tight edges of the forward search
        at, state = divmod(stack.pop(), STATES)
        for from_at, from_state, step in lattice.into(at, state):
            before = from_at * STATES + from_state
            if before not in on_way and ahead.get(before, FAR) + step == ahead.get(at * STATES + state):
                on_way.add(before)
                stack.append(before)
    audit, node, paid = [], start, 0
    while not (node // STATES == n and behind.get(node) is not None and paid + end_cost[node % STATES] == best):
        at, state = divmod(node, STATES)
        for to_at, to_state, step, name in lattice.out(at, state):
            to = to_at * STATES + to_state
            if paid + step + behind.get(to, FAR) == best or (to in on_way and ahead[to] == paid + step):
                audit.append(name)
                node, paid = to, paid + step
                break
        else:
            raise AssertionError("no cheapest edit leaves a node on a cheapest way")
    return best, "".join(audit), node % STATES


def repaired_roles(audit: str, state: int, roles: list[str]) -> list[tuple[str, int | None]]:
    """(role, place of its row, None where it is inserted) of the rows that an audit leaves from a state on."""
    left, at = [], 0
    for name in audit:
        if name == "K":
            left.append((roles[at], at))
            state = STEP[roles[at][0]][state]
        elif name != "D":
            left.append((NEXT_ROLE[state], None if name == "I" else at))
            state = NEXT_STATE[state]
        at += name != "I"
    return left


def first_faults(roles: list[str], texts: list[str]) -> list[int]:
    seen, out = set(), []
    for role, text in zip(roles, texts, strict=True):
        said = text.rstrip(BETWEEN_WORDS)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        out.append(BLANK if not said else DUPLICATE if key in seen else TRUNCATED if said[-1] not in ".!?" else 0)
        seen.add(key)
    return out


def illegal_pairs(initial: list[str]) -> int:
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initial, initial[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the rows' own keys; nulls of role and text are one space."""
    space = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


ORDER = ("conv_id", "turn", "role", "text")
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def repaired(turns: list, roles: list[str], texts: list[str]) -> dict:
    """The digest of one conversation's rows in order."""
    faults = first_faults(roles, texts)
    initial = [r[:1] for r in roles]
    cost, audit, _ = search(Lattice(initial, faults), 0, [0 if s in ENDS else FAR for s in range(STATES)])
    lines = [f"{role}:{'' if at is None else texts[at]}" for role, at in repaired_roles(audit, 0, roles)]
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": illegal_pairs(initial), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list, list[str], list[str]]]:
    """(conv_id, turns, roles, texts) of sorted rows, one conversation at a time."""
    now, held = None, ([], [], [])
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("conv_id").to_pylist()
        cols = [b.column(k).to_pylist() for k in ("turn", "role", "text")]
        edges = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1]], len(ids)]
        for lo, hi in zip(edges, edges[1:]):
            if held[1] and ids[lo] != now:
                yield now, *held
                held = ([], [], [])
            now = ids[lo]
            for have, more in zip(held, cols):
                have.extend(more[lo:hi])
    if held[1]:
        yield now, *held


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for conv_id, *rest in _conversations(batches):
        rows.append({"conv_id": conv_id, **repaired(*rest)})
        if len(rows) == 1000:
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)


_DIGEST = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in DIGEST.split(", ")])


def _marked(rows: DataFrame) -> DataFrame:
    """Rows whose conversation may be null, by a key without nulls: is it null, and which."""
    return rows.withColumn("no_id", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))


def long_conversations(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, int]:
    """no_id, conv_id of the conversations that no task should hold, and how many there are."""
    size = rows.groupBy("no_id", "conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    long = size.where((F.col("n") > max(long_rows, total["n"] // MOST_LONG)) | (F.col("bytes") > max(long_bytes, total["bytes"] // MOST_LONG)))
    return long.select("no_id", "conv_id"), long.count()


def repair_digests(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """DIGEST: one row for each conv_id of the table, also of those that damage leaves without rows."""
    scratch = Scratch(conversations.sparkSession, "repair")
    rows = _marked(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    try:
        long, n_long = long_conversations(rows, long_rows, long_bytes)
        short = rows
        found = None
        if n_long:
            hot = F.broadcast(scratch.written(long, "long"))  # at most 2 * MOST_LONG ids
            short = rows.join(hot, ["no_id", "conv_id"], "left_anti")
            found = repaired_in_blocks(rows.join(hot, ["no_id", "conv_id"], "left_semi"), scratch, block_rows)
        plain = short.select(F.when(~F.col("no_id"), F.col("conv_id")).alias("conv_id"), "turn", "role", "text")
        dealt = plain.repartition("conv_id").sortWithinPartitions(*ORDER)
        done = scratch.written(dealt.mapInArrow(_digest_batches, DIGEST), "done", keep=True)
        if found is not None:
            done = done.unionByName(scratch.written(found, "blocks-done", keep=True))
    finally:
        scratch.clear()
    same = ids["conv_id"].eqNullSafe(done["conv_id"])
    joined = ids.join(done, same, "left").select(ids["conv_id"], *[done[k] for k in done.columns[1:]])
    return joined.select("conv_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in done.columns[1:7]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


# Long conversations, in blocks.

KEY = ("no_id", "conv_id")
_KEY = "no_id boolean, conv_id long"


def _of_block(part: pd.DataFrame) -> tuple[dict, Lattice]:
    """The names of a block and its lattice, from its rows in order."""
    one = part.iloc[0]
    last = bool(one["block"] == one["last_block"])
    names = {"no_id": bool(one["no_id"]), "conv_id": int(one["conv_id"]), "block": int(one["block"])}
    return names, Lattice([r[:1] for r in part["role"]], part["fault"].tolist(), last)


def _block_costs(part: pd.DataFrame) -> pd.DataFrame:
    names, lattice = _of_block(part.sort_values("at"))
    table = []
    for s in range(STATES):
        found = [search(lattice, s, [0 if x == e else FAR for x in range(STATES)]) for e in range(STATES)]
        table.append([x[0] if x else FAR for x in found])
    counts = {k: lattice.fault.count(n) for n, k in enumerate(FAULTS) if n}
    return pd.DataFrame([names | counts | {"illegal": illegal_pairs(lattice.initial), "head": lattice.initial[0], "tail": lattice.initial[-1], "costs": table}])


def _costs_to_go(blocks: pd.DataFrame) -> pd.DataFrame:
    """From the last block of a conversation back: what is still to pay after each, by state."""
    blocks = blocks.sort_values("block", ascending=False)
    ahead, out = np.array([0 if s in ENDS else FAR for s in range(STATES)], dtype=np.int64), []
    for table in blocks["costs"]:
        out.append([int(x) for x in ahead])
        ahead = np.minimum((np.array([list(x) for x in table], dtype=np.int64) + ahead[None]).min(axis=1), FAR)
    return blocks[[*KEY, "block"]].assign(end_cost=out)


def _block_ways(part: pd.DataFrame) -> pd.DataFrame:
    """The least audit of a block from each state that it can be entered in."""
    names, lattice = _of_block(part.sort_values("at"))
    end_cost = [int(x) for x in part["end_cost"].iloc[0]]
    found = [(s, search(lattice, s, end_cost)) for s in range(STATES)]
    return pd.DataFrame([names | {"enters": s, "leaves": x[2], "cost": x[0], "audit": x[1]} for s, x in found if x], columns=[*KEY, "block", "enters", "leaves", "cost", "audit"])


def _states_entered(steps: pd.DataFrame) -> pd.DataFrame:
    """From the first block on: the state that each is entered in, and what was to pay at the first."""
    state, out = 0, []
    price = None
    for block, ways in steps.sort_values("block").groupby("block"):
        way = ways[ways["enters"] == state].iloc[0]
        price = int(way["cost"]) if price is None else price
        out.append((bool(way["no_id"]), int(way["conv_id"]), int(block), state, price))
        state = int(way["leaves"])
    return pd.DataFrame(out, columns=[*KEY, "block", "enters", "price"])


def _row_fates(part: pd.DataFrame) -> pd.DataFrame:
    """Per row of a block: the roles inserted before it, its own (null: deleted), and those inserted after it."""
    part = part.sort_values("at")
    roles, places = part["role"].tolist(), part["at"].tolist()
    before, own, after, waiting = [[] for _ in roles], [None] * len(roles), [[] for _ in roles], []
    for role, at in repaired_roles(part["audit"].iloc[0], int(part["enters"].iloc[0]), roles):
        if at is None:
            waiting.append(role)
        else:
            before[at], own[at], waiting = waiting, role, []
    after[-1] = waiting
    return pd.DataFrame({"at": places, "before": before, "own": own, "after": after})


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of sorted lines, a conversation after the other, as they stream by."""
    now, sha, empty = None, hashlib.sha256(), True
    for b in batches:
        for no_id, conv_id, lines in zip(b["no_id"], b["conv_id"], b["lines"], strict=True):
            if now is not None and now != (no_id, conv_id):
                yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*KEY, "repaired_sha256"])
                sha, empty = hashlib.sha256(), True
            now = (no_id, conv_id)
            for line in lines:
                sha.update((("" if empty else "\n") + line).encode())
                empty = False
    if now is not None:
        yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*KEY, "repaired_sha256"])


def repaired_in_blocks(rows: DataFrame, scratch: Scratch, block_rows: int) -> DataFrame:
    """DIGEST of conversations that are too long for a task.

    Only the sort and the hash carry texts; a block's search sees roles and faults. What meets by
    conversation is a row of 16 numbers for every `block_rows` rows.
    """
    total = rows.count()
    # Equal rows stand next to each other and are interchangeable: a number of their own keeps them from being one key of the range.
    order = ["no_id", "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nr"]
    numbered = scratch.written(rows.withColumn("nr", F.monotonically_increasing_id()), "numbered")
    ranged = numbered.repartitionByRange(max(-(-total // block_rows), 1), *order).sortWithinPartitions(*order)
    placed = scratch.written(ranged.withColumn("block", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "placed")
    # The first of equal rows: the least place of each (conversation, role, text), by an aggregate; it meets its row by the place.
    first = placed.groupBy(*KEY, F.xxhash64("role", "text").alias("a"), F.hash("text", "role", F.length("text")).alias("b")).agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again"))
    said = F.rtrim("text", F.lit(BETWEEN_WORDS))
    mark = F.substring(said, -1, 1)
    slim = placed.select(*KEY, "turn", "block", "at", "role", (said == "").alias("blank"), mark.isin(".", "!", "?").alias("ended")).join(first, "at", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.coalesce("again", F.lit(True)), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(0)
    last = placed.groupBy(*KEY).agg(F.max("block").alias("last_block"))  # a row per long conversation, 2 * MOST_LONG at most
    slim = scratch.written(slim.withColumn("fault", fault).drop("blank", "ended", "again").join(F.broadcast(last), list(KEY)), "slim")

    by = [*KEY, "block"]
    sums = scratch.written(slim.groupBy(*by).applyInPandas(_block_costs, f"{_KEY}, block int, blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<array<long>>"), "costs")
    to_go = sums.select(*by, "costs").groupBy(*KEY).applyInPandas(_costs_to_go, f"{_KEY}, block int, end_cost array<long>")
    ways = slim.join(scratch.written(to_go, "to-go"), by).groupBy(*by).applyInPandas(_block_ways, f"{_KEY}, block int, enters int, leaves int, cost long, audit string")
    ways = scratch.written(ways, "ways")
    entered = ways.drop("audit").groupBy(*KEY).applyInPandas(_states_entered, f"{_KEY}, block int, enters int, price long")
    taken = scratch.written(ways.select(*by, "enters", "audit").join(entered, [*by, "enters"]), "taken")

    fates = slim.join(taken, by).groupBy(*by).applyInPandas(_row_fates, "at long, before array<string>, own string, after array<string>")
    inserted = lambda k: F.transform(k, lambda x: F.concat(x, F.lit(":")))
    own = F.when(F.col("own").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat("own", F.lit(":"), "text")))
    lines = placed.join(fates, "at").select(*KEY, "at", F.concat(inserted("before"), own, inserted("after")).alias("lines"))
    hashes = lines.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInPandas(_hashes, f"{_KEY}, repaired_sha256 string")

    parts = F.sort_array(F.collect_list(F.struct("block", "audit")))  # the result's audit itself, in pieces
    audits = taken.groupBy(*KEY).agg(F.concat_ws("", F.transform(parts, lambda x: x["audit"])).alias("audit"), F.min("price").alias("cost"))
    edges = F.sort_array(F.collect_list(F.struct("block", "head", "tail")))
    counts = sums.groupBy(*KEY).agg(*[F.sum(k).alias(k) for k in (*FAULTS[1:], "illegal")], edges.alias("edges"))
    more = F.greatest(F.size("edges") - 1, F.lit(0))
    meets = F.zip_with(F.slice("edges", F.lit(1), more), F.slice("edges", F.lit(2), more), lambda a, b: F.concat(a["tail"], b["head"]))
    counts = counts.withColumn("illegal", F.col("illegal") + F.size(F.filter(meets, lambda x: ~x.isin(*LEGAL_PAIRS))))
    turns = slim.select(*KEY, "turn").distinct().groupBy(*KEY).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    done = counts.join(turns, list(KEY)).join(audits, list(KEY)).join(hashes, list(KEY))
    return done.select(F.when(~F.col("no_id"), F.col("conv_id")).alias("conv_id"), "gaps", *FAULTS[1:], "illegal", "cost", "audit", "repaired_sha256")
