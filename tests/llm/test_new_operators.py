"""Operators 11 to 13 against brute force, held-out accuracy and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("docketry.llm")

from docketry.llm import bradley_terry, conversation_repair, filter_audit  # noqa: E402
from docketry.llm._shared import Scratch, prepared  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]")
TURNS = "conv_id long, turn long, role string, text string, own_id long, at int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int"


# Conversation repair.


def brute_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """The digest of one conversation by a table over all audits' costs, least audits kept as strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        found = WORD.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    n = len(rows)
    best = {}  # (rows used, last initial) -> (cost, audit, lines), cheapest and then least, from the end on
    for at in range(n, -1, -1):
        for state in follows:
            best[at, state] = (0, "", ()) if at == n and state in ("", "a") else (10**9, "~", ())
        for _ in range(6):  # insertions lead from state to state without using a row
            for state in follows:
                ways = [best[at, state]]
                new = "a" if state == "u" else "u"
                role = {"a": "assistant", "u": "user"}[new]
                cost, audit, lines = best[at, new]
                ways.append((cost + 2, "I" + audit, (f"{role}:", *lines)))
                if at < n:
                    _, _, own, text = rows[at]
                    cost, audit, lines = best[at + 1, state]
                    ways.append((cost + 3, "D" + audit, lines))
                    if faults[at] not in ("blank", "duplicate"):
                        more = faults[at] == "truncated"
                        if own[:1] and own[:1] in follows[state]:
                            cost, audit, lines = best[at + 1, own[0]]
                            ways.append((cost + more, "K" + audit, (f"{own}:{text}", *lines)))
                        cost, audit, lines = best[at + 1, new]
                        ways.append((cost + 2 + more, "R" + audit, (f"{role}:{text}", *lines)))
                best[at, state] = min(ways)
    cost, audit, lines = best[0, ""]
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def talk(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Fine.", "Well?", "cut off", "", " \t\x0b", None, "Fine.", f"Said {rng.randrange(9)}!", "end. \n ", "é" * 40 + "."])
            rows.append((c, None if rng.random() < 0.05 else t + 3 * (rng.random() < 0.1), role, text, 1, 2))
    rows += [(None, k, "user" if k % 2 == 0 else "assistant", f"Text {k}.", 1, 2) for k in range(6)] + [(None, None, None, None, None, None)] * 2
    rows += [(997, 0, "user", "Only.", 1, 2)] * 5
    return rows


@pytest.mark.parametrize(("long_rows", "block_rows"), [(100_000, 20_000), (4, 3), (1, 1000)])
def test_repair_equals_brute_force(spark, long_rows, block_rows):
    rows = talk(long_rows)
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    got = {r["conv_id"]: r.asDict() for r in conversation_repair.repair_digests(table, long_rows=long_rows, block_rows=block_rows).collect()}
    by = {c: [] for c in {r[0] for r in rows}}
    for r in brute_damage([r[:4] for r in rows]):
        by[r[0]].append(r)
    assert got.keys() == by.keys()
    for c, left in by.items():
        assert got[c] == {"conv_id": c, **brute_repair(left)}, (c, left)


def test_search_finishes_all_equal_crossings():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(0, 9)
        roles = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(n)]
        texts = [rng.choice(["a.", "b", "", "c!"]) + str(k) * (k % 2) for k in range(n)]
        faults = conversation_repair.first_faults(roles, texts)
        cost, audit, _ = conversation_repair.search(conversation_repair.Lattice([r[0] for r in roles], faults), 0, [0, 1 << 60, 1 << 60, 0])
        want = brute_repair([(0, k, r, t) for k, (r, t) in enumerate(zip(roles, texts))])
        assert (cost, audit) == (want["cost"], want["audit"])


def test_repair_of_no_rows(spark):
    assert conversation_repair.repair_digests(spark.createDataFrame([], TURNS)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = conversation_repair.repair_digests(spark.createDataFrame([(gone, 0, "user", "x", None, None)], TURNS)).first()
    assert one.asDict() == {"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


# Filter audit.


def brute_audit(docs, labels):
    first = {}
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    failing = []
    for d, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        mine = [x for x in labels if x[0] == d and d is not None]
        failing.append((source or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {x[0] for x in failing}:
        rows = [x for x in failing if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in rows) - len(gone), sum(x[1] == {f} for x in rows), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \x0b\n", "one two", "É" * 60 + " ABC", "a " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(220)) + " #", "W " * 99 + " ".join(f"w{k}" for k in range(150)), "x" * 200_000, "UPPER CASE & more"]
    docs = [(rng.randrange(40) if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["s0", "s1", None, ""])) for _ in range(150)]
    docs += [(77, "a " * 300, "s2")] * 4 + [(78, "a " * 300, "s2"), (None, "a " * 300, "s2")]
    labels = [(rng.randrange(50), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1), (77, 1, 1)]
    table = spark.createDataFrame([(d, t, "en", s, 1, "clash", 7) for d, t, s in docs], DOCS).repartition(4)
    got = filter_audit.filter_interactions(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * 4
    assert filter_audit.filter_interactions(table.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_gray_walk_gives_the_survivors_of_every_subset():
    cells = np.random.default_rng(1).integers(0, 50, (3, 2, 32))
    left = filter_audit.gray_walk(cells)
    for subset in range(32):
        assert (left[..., subset] == sum(cells[..., m] for m in range(32) if m & subset == 0)).all()


# Quality by preferences.


def test_preferences_on_held_out_rows(spark):
    prepared(spark)
    rng = random.Random(3)
    rows, labels = [], []
    for d in range(600):
        good = d % 4 != 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 120))]
        if not good:
            junk = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if junk == 0 else [w + rng.choice(["###", "$$$"]) for w in words] if junk == 1 else [w for w in words for _ in range(5)]
        rows.append((d, " ".join(words), "en", "s", 1, "x", 1))
        labels.append((d, int(good)))
    rows += [(None, None, None, None, None, None, None), (1000, "", "en", "s", 1, "x", 1), (1001, "z" * 300_000, "en", "s", 1, "x", 1), (0, rows[0][1], "en", "s", 1, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    model = bradley_terry.train(docs, known)
    got = bradley_terry.quality_scores(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert len(held) > 150 and sum(r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth) >= 0.97 * len(held)
    nobody = bradley_terry.train(docs, known.where("quality = 1"))
    assert {r["score"] for r in bradley_terry.quality_scores(docs, nobody).collect()} == {0.5}
    assert bradley_terry.quality_scores(docs.limit(0), model).count() == 0


def test_pairs_and_quantile():
    better, worse = bradley_terry.preference_pairs(np.arange(10), np.arange(100, 130), 4)
    assert len(better) == 30 * 4 and set(better) == set(range(10)) and set(worse) == set(range(100, 130)) and len(set(zip(better, worse))) == 120
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    assert bradley_terry.fit(x, np.array([2, 3]), np.array([0, 1]))[0] > 1
    assert bradley_terry.quantile_cut(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.5) == 2.5


# Connected components of near-duplicates.


def test_components_of_chains_stars_and_rings(spark):
    from docketry.llm import dart_minhash

    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, 200 + k) for k in range(20)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)] + [(rng.randrange(400, 430), rng.randrange(400, 430)) for _ in range(20)] + [(90, 3)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for some in (links, links[40:60], []):  # all, a star alone, none
        scratch = Scratch(spark, "components")
        got = {r["uid"]: r["root"] for r in dart_minhash.components(spark.createDataFrame(some, "a long, b long"), scratch).collect()}
        assert got == {x: root(x) for x in parent if root(x) != x and any(x in p and p[0] != p[1] for p in some)}
        scratch.clear()


def test_every_labelled_row_trains(spark):
    prepared(spark)
    rng = random.Random(5)
    free = spark.range(12000).withColumnRenamed("id", "doc_id").where(~bradley_terry.held_out())
    ids = [r[0] for r in free.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect()]
    poor, plain, late = ids[:300], ids[300:4600], ids[4600:7000]  # the good ones of `late` come after 4300 others by hash
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    text = lambda end, n: " ".join(word() + end for _ in range(n))
    rows = [(d, text("##", rng.randrange(10, 40))) for d in poor] + [(d, text("", rng.randrange(10, 40))) for d in plain]
    rows += [(d, text("##", rng.randrange(10, 40)) + " " + text("7", rng.randrange(4, 9))) for d in late]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, int(k >= 300)) for k, d in enumerate(ids[:7000])], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in bradley_terry.quality_scores(docs, bradley_terry.train(docs, labels)).collect()}
    assert sum(got[d] for d in late) >= 0.99 * len(late) and sum(got[d] for d in poor) <= 3
    assert sum(1 - x for x in got.values()) == 300  # the cut leaves as many rows below it as are poor


def test_scores_from_kept_features_are_those_from_texts(spark):
    prepared(spark)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "Cde", "f##", "9x"]) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(None, "ab"), (500, None), (501, ""), (7, "other text"), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int("#" not in x)) for k, x in enumerate(texts)] + [(7, 1), (None, 0), (900, 0), (3, None)], "doc_id long, quality int")
    got, want = (sorted(map(str, x.collect())) for x in (bradley_terry.trained_scores(docs, labels), bradley_terry.quality_scores(docs, bradley_terry.train(docs, labels))))
    assert got == want and len(got) == len(rows)
    trained = bradley_terry.training_rows(bradley_terry.features_of(docs), labels).collect()
    assert sorted(r["doc_id"] for r in trained) == [k for k in range(80) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert bradley_terry.trained_scores(docs.limit(0), labels).count() == 0


def test_blocks_hold_all_rows_and_sum_as_one(spark, monkeypatch):
    prepared(spark)
    rng = np.random.default_rng(2)
    width = len(bradley_terry.STATISTICS)
    all_rows = [(k, int(k >= 6), rng.random(width + bradley_terry.SHAPES).astype("<f4").tobytes()) for k in range(200)]
    rows = spark.createDataFrame(all_rows, "doc_id long, quality int, features binary").repartition(3).cache()
    knots = bradley_terry.statistic_knots(rows)
    raw = np.stack([np.frombuffer(r[2], "<f4") for r in all_rows]).astype(np.float64)
    for k, x in enumerate(knots):
        assert np.allclose(x, np.quantile(np.round(raw[:, k], 4), np.linspace(0, 1, bradley_terry.KNOTS)))

    whole = bradley_terry.training_blocks(rows, {0: 6, 1: 194}).cache()
    assert [r["poor"] for r in whole.collect()] == [6]
    features = np.hstack([bradley_terry._hats(raw[:, :width], knots), raw[:, width:]])
    pairs = bradley_terry.preference_pairs(np.arange(6, 200), np.arange(6))
    weight = rng.normal(size=features.shape[1])
    assert np.allclose(bradley_terry.block_sums(whole, knots, weight), bradley_terry.pair_sums(features, *pairs, weight))
    fitted = bradley_terry.newton(lambda w: bradley_terry.block_sums(whole, knots, w), len(weight))
    assert np.allclose(fitted, bradley_terry.fit(features, *pairs), atol=1e-6)
    assert np.abs(bradley_terry.pair_sums(features, *pairs, fitted)[2] / len(pairs[0]) + bradley_terry.RIDGE * fitted).max() < 1e-6

    monkeypatch.setattr(bradley_terry, "BLOCK_ROWS", 20)
    monkeypatch.setattr(bradley_terry, "RARE_ROWS", 4)
    parts = bradley_terry.training_blocks(rows, {0: 6, 1: 194}).cache()
    good, poor, expected = [], [], 0
    for r in parts.collect():
        packed = zlib.decompress(r["features"])
        step = 4 * (width + bradley_terry.SHAPES)
        own = [packed[at : at + step] for at in range(0, len(packed), step)]
        poor, good = poor + own[: r["poor"]], good + own[r["poor"] :]
        x = np.stack([np.frombuffer(f, "<f4") for f in own]).astype(np.float64)
        x = np.hstack([bradley_terry._hats(x[:, :width], knots), x[:, width:]])
        assert 0 < r["poor"] < len(own)
        expected = expected + bradley_terry.pair_sums(x, *bradley_terry.preference_pairs(np.arange(r["poor"], len(own)), np.arange(r["poor"])), weight)
    assert sorted(good) == sorted(r[2] for r in all_rows[6:]) and set(poor) == {r[2] for r in all_rows[:6]} and len(poor) == 6 * 7
    assert np.allclose(bradley_terry.block_sums(parts, knots, weight), expected)


@pytest.mark.parametrize("share", [0.0001, 0.13, 0.5, 0.9, 0.9999])
def test_cut_by_refined_histograms(spark, share):
    rng = np.random.default_rng(4)
    values = [*np.unique(np.concatenate([rng.normal(size=300), rng.normal(size=300) * 1e-9 + 0.2])), 1e6]
    rows = [int(x) for x in rng.integers(1, 50, len(values))]
    table = spark.createDataFrame(list(zip(map(float, values), rows)), "strength double, rows long").cache()
    want = bradley_terry.quantile_cut(np.array(values), np.array(rows, float), share)
    assert bradley_terry.strength_cut(table, share, most=5) == bradley_terry.strength_cut(table, share) == want
    assert bradley_terry.strength_cut(table.limit(1), share, most=5) == table.limit(1).first()[0]
