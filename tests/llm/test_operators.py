"""Operators of the llm subpackage against brute force, round trips, held-out accuracy and odd inputs."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("docketry.llm")

from docketry.llm import _shared, dart_minhash, harmonic_packing, kd_shards, license_scan, pii_crf, quality_rules, sentencepiece_codec, threshold_topk, toxicity_fm, warc_archive  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string"
ODD = [None, "", " ", "one", "\n\n", "a" * 50_000, "é " * 3000, "x y z " * 400, "tail\x0b\x0cword", "<|endoftext|> A'LL b"]


def brute_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for n in range(60):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 160))]
        rows.append((n, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None]), None, "x"))
        if n % 3 == 0:
            changed = list(words)
            changed[len(changed) // 2] = "changed"
            rows.append((100 + n, " ".join(changed), "en", "s0", 1, "x"))
        if n % 10 == 0:
            rows += [(200 + n, " ".join(words), "en", "s0", 1, "x")] * 2
    rows += [(300 + k, t, "en", "s0", 1, "x") for k, t in enumerate(ODD)] + [(None, None, None, None, None, None), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_codec_equals_the_library(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, sp = sentencepiece_codec.load_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    ids = {r["doc_id"]: r["ids"] for r in sentencepiece_codec.encoded(docs, model).collect()}
    assert all(ids[k] == sp.encode(t) for k, t in texts.items())
    assert sentencepiece_codec.round_trips(docs, model).where("NOT same").count() == 0
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs, model), model).collect()}
    assert all(back[k] == t for k, t in texts.items())
    assert sentencepiece_codec.round_trips(empty, model).count() == 0


def test_unigram_segmentation_is_the_best_of_all():
    model = sentencepiece_codec.load_model(public_tokenizers.path("piece_bpe_32k.model"), unigram=True)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    score = {sp.id_to_piece(int(i)): float(model.score[i]) for i in model.ids}
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choice("aeionrstlé") for _ in range(rng.randrange(1, 30))) for _ in range(200)] + ["▁the", "▁internationalisation", "▁" + "ab" * 300]
    worst = min(score.values()) - 10.0
    for w, ids in zip(words, sentencepiece_codec.segment(model, words), strict=True):
        best = [0.0] + [-1e18] * len(w)
        for t in range(1, len(w) + 1):
            for n in range(1, min(t, model.longest) + 1):
                if w[t - n : t] in score:
                    best[t] = max(best[t], best[t - n] + score[w[t - n : t]])
            if w[t - 1] not in score:
                best[t] = max(best[t], best[t - 1] + worst)
        assert "".join(sp.id_to_piece(i) for i in ids) == w and abs(sum(float(model.score[i]) for i in ids) - best[-1]) < 1e-6 * max(1.0, abs(best[-1]))


def test_near_duplicates_equal_brute_force(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := brute_words(r["text"])) else None for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i]["text"] is not None and rows[i]["text"] == rows[j]["text"]
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r["doc_id"])
    want = sorted((d is None, d or 0, min((x for x in v if x is not None), default=None) or -1, len(v)) for v in groups.values() for d in v)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or -1, r["class_size"]) for r in dart_minhash.near_duplicates(docs).collect())
    assert got == want
    assert dart_minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot_rows", [1000, 5])
def test_near_duplicates_that_share_a_common_passage(spark, monkeypatch, hot_rows):
    """Large buckets of texts that are alike, but not enough, hold groups that no hub reaches; with and without hot keys."""
    monkeypatch.setattr(_shared, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(dart_minhash, "BLOCK", 16)
    rng = random.Random(9)
    passage = [f"shared{k}" for k in range(44)]
    rows = []
    for n in range(150):
        own = [f"own{n}x{k}" for k in range(rng.choice((6, 12)))]
        rows.append((n, " ".join(passage + own)))
        if n % 5 == 0:
            rows.append((1000 + n, " ".join(passage + own[:-1] + ["other"])))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and len(x & y) >= 0.8 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(table).collect()} == {d: find(d) for d in sets}
    assert len({find(d) for d in sets}) > 20


def test_one_of_each_group_stays(docs, empty):
    key = lambda r: (r["doc_id"], r["text"])
    left = [key(r) for r in dart_minhash.one_of_each(docs).collect()]
    rows, classes = docs.select("doc_id", "text").collect(), collections.defaultdict(set)
    for r in dart_minhash.near_duplicates(docs.where("text IS NOT NULL AND doc_id IS NOT NULL")).collect():
        classes[r["class_id"]].add(r["doc_id"])
    whole = {k for k, t in left if t is not None and k is not None}
    assert sum(t is None for _, t in left) == sum(r["text"] is None for r in rows)
    assert sorted(whole) == sorted(classes) and len(whole) == sum(t is not None and k is not None for k, t in left)
    assert all(min(v) == k for k, v in classes.items()) and dart_minhash.one_of_each(empty).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = np.arange(300), np.arange(100, 400)
    weight = rng.integers(1, 4, 400).astype(float)
    row, el, w = np.repeat([0, 1], 300), np.concatenate([codes[a], codes[b]]), np.concatenate([weight[a], weight[b]])
    s = dart_minhash.dart_signatures(row, el, w, 2)
    both = np.minimum(np.isin(np.arange(400), a) * weight, np.isin(np.arange(400), b) * weight).sum()
    assert abs((s[0] == s[1]).mean() - both / weight.sum()) < 0.12


def test_shards(docs, empty):
    got = kd_shards.kd_shards(docs).toPandas()
    assert len(got) == docs.count() and set(got["law"]) == {"bytes"} and got["shard"].between(0, 15).all()
    assert (got.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = collections.Counter((r["doc_id"] if r["doc_id"] is not None else -1, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert collections.Counter(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True)) == want
    assert kd_shards.kd_shards(empty).count() == 0


def test_quality_counts_equal_brute_force(docs, empty):
    got = collections.defaultdict(list)
    for r in quality_rules.quality_verdicts(docs).collect():
        got[r["doc_id"]].append(r)
    for r in docs.collect():
        w, t = brute_words(r["text"]), r["text"] or ""
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        often = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if brute_words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(often))
        assert want in [tuple(g[k] for k in quality_rules.COUNTS[:5]) for g in got[r["doc_id"]]]
    assert all(not g["kept"] for v in got.values() for g in v if g["base_failed"])
    assert quality_rules.quality_verdicts(empty).count() == 0


def test_quality_parts_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = quality_rules.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.97 and got[got["quality"] == 0]["kept"].mean() < 0.2


def test_quality_core_withstands_a_third_of_junk(spark):
    """Junk of one kind, some of it hot copies, as a third of its group and as 45 % of another."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for source, junk in (("third", 150), ("more", 245)):
        for n in range(300):
            rows.append((source, 1, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 200)))))
        one = " ".join("#".join(rng.choice(vocabulary).upper() for _ in range(3)) for _ in range(90))
        for n in range(junk):
            rows.append((source, 0, one if n % 3 == 0 else " ".join("#".join(rng.choice(vocabulary).upper() for _ in range(3)) for _ in range(rng.randrange(60, 200)))))
    table = spark.createDataFrame([(k, t, "en", s) for k, (s, _, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(4)
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(table).where("kept").collect()}
    clean = [k for k, (_, good, _) in enumerate(rows) if good]
    assert kept <= set(clean) and len(kept) > 0.97 * len(clean)


def test_quality_core_is_the_least_determinant(spark):
    """The core found in small groups against all halves of them; level 0 of three groups."""
    import itertools

    rng = np.random.default_rng(8)
    p, rows, best = len(quality_rules.VECTOR), [], {}
    floor = np.diag(np.array(list(quality_rules.FLOORS.values())) ** 2)
    for g in range(3):
        x = rng.normal(0, 1, (14, p)) * np.linspace(0.2, 1.0, p)
        x[:4] += rng.normal(9, 0.3, p)  # four outliers of one kind
        rows += [(0, "en", f"g{g}", *map(float, v)) for v in x]
        halves = np.array(list(itertools.combinations(range(14), 7)))
        part = x[halves] - x[halves].mean(1, keepdims=True)
        trim = 0.5 / quality_rules.chi_square_cdf(quality_rules.chi_square_quantile(0.5, p), p + 2)
        best[f"g{g}"] = np.sort(np.linalg.slogdet(np.einsum("hia,hib->hab", part, part) / 7 * trim + floor)[1])
    table = spark.createDataFrame(rows, "level int, m_lang string, m_source string, " + ", ".join(f"{z} double" for z in quality_rules.VECTOR)).repartition(3)
    scratch = _shared.Scratch(spark, "test")
    for r in quality_rules.mcd_estimates(table, scratch).collect():
        cov = quality_rules._squares(__import__("pandas").Series([np.array(r["scatter"])]))[0]
        rank = np.searchsorted(best[r["m_source"]], np.linalg.slogdet(cov)[1] - 1e-6)
        assert rank < 0.02 * len(best[r["m_source"]])  # among the best of 3432 halves
        assert np.abs(np.array(r["centre"])).max() < 2  # no outlier has moved it


def test_quality_verdicts_without_broadcast(docs, monkeypatch):
    want = sorted(map(str, quality_rules.quality_verdicts(docs).drop("distance").collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_shared, "HOT_ROWS", 8)
    assert sorted(map(str, quality_rules.quality_verdicts(docs).drop("distance").collect())) == want


def test_quality_kept_rows_by_row_and_not_by_id(docs, empty, spark):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(1, good, "en", "s", 1, "x"), (1, "too short", "en", "s", 1, "x"), (None, good + " more", "en", None, 1, "x"), (None, "short", None, None, 1, "x"), (2, None, "en", "s", 1, "x")]
    table = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    judged = [(r["doc_id"], r["n_words"]) for r in quality_rules.quality_verdicts(table).where("kept").collect()]
    left = quality_rules.kept_rows(table)
    assert left.columns == table.columns
    assert sorted(map(str, judged)) == sorted(str((r["doc_id"], len(brute_words(r["text"])))) for r in left.collect())
    assert quality_rules.kept_rows(empty).count() == 0


def test_quality_rejects_by_one_statistic(spark):
    """Lines that are nearly all copies, words repeated just under the base rule, symbols or capitals reject by themselves."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    lines = lambda n, k: [" ".join(word() for _ in range(k)) for _ in range(n)]
    texts = ["\n".join(lines(rng.randrange(6, 14), rng.randrange(9, 20))) for _ in range(300)]
    odd = [
        "\n".join(lines(20, 12) + ["x y"] * 50),  # copies of a line: 49 of 70 lines, 100 of 340 words
        "\n".join(lines(8, 8) + [f"{' '.join(lines(1, 1))} {t}" for t in ["p q r s t u v w"] * 7]),  # 56 of 127 words repeated, no line copied
        "\n".join(x.replace(" ", " ### ", 6) for x in lines(8, 12)),
        "\n".join(x.upper() for x in lines(8, 12)),
        " ".join(lines(1, 30_000)),
    ]
    table = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts + odd)], "doc_id long, text string, lang string, source string").repartition(4)
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(table).collect()}
    assert sum(got[k]["kept"] for k in range(300)) >= 294
    assert [(got[k]["base_failed"], got[k]["kept"]) for k in range(300, 305)] == [(False, False)] * 5


def _regex_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b.c", "@", "@x.y", ".", "-", " ", "1", "42", "255", "300", "+1 (", ") ", "4041894974608795", "é", "_", "%", "\n", "..", "@a-b.co.uk"]) for _ in range(rng.randrange(1, 16)))
        assert sorted(pii_crf.base_spans(text)) == sorted(_regex_spans(text)), text


def test_viterbi_equals_enumeration():
    """Best labels of whole lines, with certain words cut out, against all label sequences."""
    rng = np.random.default_rng(2)
    few = len(pii_crf.LABELS)
    for trial in range(40):
        words = [f"w{k}" for k in range(12)]
        scale = (0.5, 2.0, 6.0)[trial % 3]
        field = pii_crf.Field({"word=" + "abcdefghijkl"[k]: rng.normal(0, scale, (3, few)) for k in range(12)}, rng.normal(0, 1, (few, few)))
        words = ["abcdefghijkl"[k] for k in rng.integers(0, 12, 4)]
        e = field.emissions(words)
        best = max(np.ndindex(*[few] * 4), key=lambda y: sum(e[t, y[t]] for t in range(4)) + sum(field.pairs[y[t], y[t + 1]] for t in range(3)))
        assert tuple(field.decode([words])[0]) == best
    for trial in range(30):  # long lines: the cut decoding against one whole pass
        field = pii_crf.Field({"word=" + "abcdefghijkl"[k]: rng.normal(0, 1, (3, few)) + np.eye(few)[0] * (6 * (k % 2)) for k in range(12)}, rng.normal(0, 1, (few, few)))
        lines = [["abcdefghijkl"[k] for k in rng.integers(0, 12, n)] for n in rng.integers(1, 60, 20)]
        for words, got in zip(lines, field.decode(lines), strict=True):
            e = field.emissions(words)
            assert (field.viterbi(e[None], np.ones((1, len(words)), dtype=bool))[0] == got).all()


def test_field_finds_personal_data_it_was_not_fitted_on():
    field = pii_crf.default_field()
    held = pii_crf.labelled_table(seed=99, sentences=400)
    best = field.decode([[w for w, _ in s] for s in held])
    pairs = [(pii_crf.LABELS[b], t) for s, p in zip(held, best, strict=True) for b, (_, t) in zip(p, s, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97
    assert sum(a == b for a, b in pairs if b != "O") / sum(b != "O" for _, b in pairs) > 0.9
    found = lambda text: {(k, text[a:b]) for _, out in pii_crf.all_spans(pa.array([text]), field) for _, base, more in out for k, a, b in base + more}
    # forms and values that the table does not hold
    assert found("Jane Doe lives at 12 Baker Street, London.") == {("name", "Jane Doe"), ("address", "12 Baker Street, London")}
    assert found("Konto DE89 3704 0044 0532 0130 00 bitte") == {("id", "DE89 3704 0044 0532 0130 00")}
    assert found("write john (at) example (dot) com") == {("email", "john (at) example (dot) com")}
    assert {k for k, _ in found("password=hunter2")} | {k for k, _ in found("ghp_abcdef0123456789abcdef0123456789")} == {"secret"}
    assert found("The Great War of 1914 was long. Paris is nice.") == set() == found("Version 2.0.1 costs $12.99 on 12/03/2021")
    assert found("Maria Silva, Rua das Flores 12, Porto") == {("name", "Maria Silva"), ("address", "Rua das Flores 12, Porto")}
    assert found("My name is Ahmed Hassan") == {("name", "Ahmed Hassan")}
    assert found("commit 9fceb02d0ae598e95dc970b74767f19372d61af8") == set() == found("Erheed. Titionly.\nOuelle Ouelle Ouelle Ouelle")
    assert found('token = "9fceb02d0ae598e95dc970b74767f19372d61af8" here') == {("secret", "9fceb02d0ae598e95dc970b74767f19372d61af8")}
    text = "write to a.b@c.de or +1 (988) 555-2485 now"
    (_, ((_, base, added),)) = next(iter(pii_crf.all_spans(pa.array([text]), field)))
    assert "@" not in pii_crf.masked(text, base + added) and "555" not in pii_crf.masked(text, base + added)


def test_field_leaves_clean_prose_and_licence_lines_alone():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").combine_chunks()
    added = [(k, text[a:b], text[max(0, a - 60) : b + 20]) for _, out in pii_crf.all_spans(texts, pii_crf.default_field()) for text, _, more in out for k, a, b in more]
    kinds = collections.Counter(k for k, *_ in added)
    # the table holds numbers like cards and quoted tokens, but no names and no addresses, although its licence lines have both shapes
    assert kinds["secret"] > 100 and kinds["card"] > 100 and kinds["name"] + kinds["address"] <= 2
    assert not any("License" in span or "rights reserved" in span for _, span, _ in added)
    assert all("token" in around.lower() for k, _, around in added if k == "secret")


def test_shapes_of_words_from_bytes_equal_those_of_strings():
    field = pii_crf.default_field()
    rng = random.Random(5)
    words = ["".join(rng.choice("abZÉéß9.,\"(#@=-_xX") for _ in range(rng.randrange(1, 12))) for _ in range(3000)] + ["le", "Anna,", "...", "((a))", "É", "A", "AB", "Ab.", "street"]
    buf = pii_crf.buffer_of(pa.array([" ".join(words)]))
    w = pii_crf.words_of(buf, slice(0, 1))
    row, table = field.rows_of(buf, w.start, w.end)
    assert len(row) == len(words) and np.allclose(table[row], np.stack([field.emission(x) for x in words]), atol=1e-3)


def test_personal_data_of_odd_texts(docs, empty):
    got = pii_crf.personal_data(docs).collect()
    assert len(got) == docs.count() and {r["base_sha256"] for r in got if r["doc_id"] == 300} == {hashlib.sha256(b"").hexdigest()}
    assert pii_crf.redacted(docs).columns == docs.columns and pii_crf.personal_data(empty).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 8)]) for k in range(300)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [0.0] * 8), (904, [0.0] * 8), (None, [1.0] * 8)]
    vectors = threshold_topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    for r in threshold_topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    table = {r["vec_id"]: np.array(r["v"]) for r in vectors.collect()}
    for q in (k for k in table if k % 20 == 0):
        assert got[q] == sorted(((k, int(v @ table[q])) for k, v in table.items() if k != q), key=lambda x: (-x[1], x[0]))[:5]


def test_top_k_of_large_components_and_where_the_bound_stops(spark):
    rng = np.random.default_rng(4)
    big = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(0, 1, (60, 3)) * 10.0 ** rng.integers(3, 17, (60, 1)))] + [(90, [1e17, 1.0, 0.0]), (91, [1e300, 0.0, 0.0]), (92, [1e17, 2.0, 0.0])]
    vectors = threshold_topk.whole_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    table = {r["vec_id"]: [int(x) for x in r["v"]] for r in vectors.collect()}
    assert 91 not in table and len(table) == 62
    got = collections.defaultdict(list)
    for r in threshold_topk.exact_top_k(vectors, vectors, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q, v in table.items():
        want = sorted(((k, sum(a * b for a, b in zip(v, w, strict=True))) for k, w in table.items() if k != q), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == [(k, min(max(s, -(1 << 63)), (1 << 63) - 1)) for k, s in want]
    few = rng.normal(0, 1, (4000, 4)) * np.array([8.0, 2.0, 0.5, 0.1])  # a direction that stands out
    vectors = threshold_topk.whole_vectors(spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(few)], "vec_id long, embedding array<double>"))
    queries = vectors.where("vec_id % 100 = 0")
    made = []
    lists = threshold_topk.SortedLists(np.arange(4000), np.array([r["v"] for r in vectors.orderBy("vec_id").collect()]))

    class Counted(np.ndarray):
        def __matmul__(self, q):
            made.append(len(self))
            return np.asarray(self) @ np.asarray(q)

    whole = lists.rows
    lists.rows = type("Rows", (), {"astype": lambda self, kind: whole.astype(kind).view(Counted)})()
    lists.top(np.arange(0, 4000, 100), whole[::100], 20)
    assert lists.scored == sum(made) < 0.5 * 40 * 4000  # every product is counted, and no others are made
    n = threshold_topk.rows_scored(vectors, queries).first()
    assert n["pairs"] == 40 * 4000 and n["scored"] < 0.5 * n["pairs"]
    rows, asked = np.array([r["v"] for r in vectors.orderBy("vec_id").collect()]), {}
    for r in threshold_topk.exact_top_k(vectors, queries).collect():
        asked.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, found in asked.items():
        s = rows @ rows[q]
        best = [k for k in sorted(range(len(s)), key=lambda k: (-s[k], k)) if k != q][:20]
        assert sorted(found) == [(n + 1, k, int(s[k])) for n, k in enumerate(best)]


def test_toxicity_on_held_out_rows(spark, docs, empty):
    folder = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    machine = toxicity_fm.train(table, labels)
    got = toxicity_fm.toxicity_scores(table, machine).join(labels, "doc_id").where("held_out").toPandas()
    assert got[got["toxic"] == 0]["predicted"].mean() < 0.01 and got[got["toxic"] == 1]["predicted"].mean() > 0.8
    assert toxicity_fm.toxicity_scores(docs, machine).where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity_fm.toxicity_scores(empty, machine).count() == 0
    assert set(toxicity_fm.toxicity_scores(docs, toxicity_fm.train(docs, labels.where("false"))).toPandas()["predicted"]) == {0}


def test_toxicity_of_terms_harmless_alone(spark):
    """Each of four terms is as common in either label; only their pairs tell the labels apart."""
    rng = random.Random(3)
    rows = []
    for k in range(1600):
        pair = rng.choice([("vermin", "harlan"), ("parasite", "osmar")] if k % 2 else [("vermin", "osmar"), ("parasite", "harlan")])
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(15, 40))] + list(pair)
        rng.shuffle(words)
        rows.append((k, " ".join(words), k % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity_fm.train(table.drop("toxic"), table.drop("text"))
    got = toxicity_fm.toxicity_scores(table, machine).join(table, "doc_id").where("held_out").toPandas()
    assert got[got["toxic"] == 1]["predicted"].mean() > 0.9 and got[got["toxic"] == 0]["predicted"].mean() < 0.05
    linear = toxicity_fm.Machine(machine.bias, machine.weight, machine.factors * 0)
    alone = toxicity_fm.toxicity_scores(table, linear).join(table, "doc_id").where("held_out").toPandas()
    assert ((alone["score"] >= 0.5) == alone["toxic"]).mean() < 0.65 < 0.9 < ((got["score"] >= 0.5) == got["toxic"]).mean()
    assert set(toxicity_fm.toxicity_scores(table, toxicity_fm.train(table.where("doc_id < 12").selectExpr("doc_id", "concat('only', doc_id) AS text"), table.drop("text"))).toPandas()["predicted"]) <= {0, 1}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = harmonic_packing.packed_pieces(docs, path).toPandas()
    for (_, seq) in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["length"].cumsum() - seq["length"] == seq["offset"]).all() and seq["length"].sum() <= 4096
    for r in docs.where("doc_id IS NOT NULL AND doc_id < 200 OR doc_id >= 300").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], np.uint32)
        mine = got[got["doc_id"] == r["doc_id"]].sort_values("start")
        assert mine["length"].sum() == len(ids) == mine["doc_tokens"].iloc[0]
        for p in mine.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert harmonic_packing.packed_pieces(empty, path).count() == 0
    assert all(sum(harmonic_packing.cut_lengths(n)) == n for n in range(1, 9000, 7))


@pytest.mark.parametrize("hot_rows", [1000, 4])
def test_archives(spark, monkeypatch, hot_rows):
    rows = [(k, f"http://x/{k}", f"<p>{k % 7}</p>" * (k % 5)) for k in range(80)] + [(3, "http://x/3", "<p>3</p>" * 3), (90, None, None), (None, "u\nv", "<p>1</p>"), (None, None, "only here")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc_archive, "HOT_ROWS", hot_rows)
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    want = []
    for k, _, html in rows:
        p = (html or "").encode()
        of = first.get(html or "")
        refers = None if of is None or of == k else of
        want.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc_archive.archive_round_trip(pages).collect())
    assert warc_archive.archive_round_trip(pages.where("false")).count() == 0


def test_licenses(spark, docs, empty):
    texts = ["Intro words here.\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "He lost his driver's license.", "Licensed under CC BY-NC 4.0.", None]
    got = {r["doc_id"]: r for r in license_scan.license_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k]["families"] for k in range(6)] == ["apache", "mit", "gpl", "", "cc-by-nc", ""] and got[0]["notices"] == "1:apache"
    assert license_scan.license_notices(docs).where("n_notices > 0").count() == 0 and license_scan.license_notices(empty).count() == 0


def test_every_licence_line_and_short_notices(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    lines = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache"}
    want = {r["doc_id"]: ",".join(sorted({lines[x] for x in r["text"].split("\n") if x in lines})) for r in table.collect() if r["text"]}
    assert sum(v.count("proprietary") for v in want.values()) > 50
    got = {r["doc_id"]: r["families"] for r in license_scan.license_notices(table).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    model = license_scan.train_classifier()
    families = lambda texts: [sorted(f for _, f, _ in x) for x in license_scan.scan_column(pa.array(texts), model)[1]]
    short = {"MIT License": "mit", "License: MIT": "mit", "Licensed under MIT": "mit", "MIT-Lizenz": "mit", "Copyright 2020 Acme. All rights reserved.": "proprietary", "Rights reserved": "proprietary", "GPLv3 license": "gpl", "License: CC BY-SA 4.0": "cc-by-sa", "Apache License 2.0": "apache"}
    assert families(list(short)) == [[v] for v in short.values()]
    none = ["Mit.", "Mit Lizenz", "free of charge", "The license.", "License: CC BY-ND 4.0", "MIT", "He lost his license", "He studied at MIT and lost his license.", None, "", "--"]
    assert not any(families(none))


def test_notices_that_the_classifier_was_not_fitted_on():
    model = license_scan.train_classifier()
    # notices in other words and tongues, several in a line, and one in the midst of a long line
    held = {
        "Dual licensed under MIT and Apache 2.0": "apache mit",
        "Code is available under the MIT license and docs under CC BY 4.0.": "cc-by mit",
        "Tri-licensed under the MPL 2.0, the GPL 2.0 and the LGPL 2.1": "gpl lgpl mpl",
        "GPLv3": "gpl",
        "Distributed under the terms of the MIT licence.": "mit",
        "Dieses Programm ist freie Software. Sie können es unter den Bedingungen der GNU General Public License, wie von der Free Software Foundation veröffentlicht, weitergeben.": "gpl",
        "Este programa se distribuye bajo la licencia Apache 2.0": "apache",
        "The contents of this file are subject to the Mozilla Public License Version 1.1": "mpl",
        "intro words " * 200 + "released under the MIT License " + "and other words " * 200: "mit",
    }
    found = license_scan.scan_column(pa.array(list(held)), model)[1]
    assert [" ".join(sorted(f for _, f, _ in x)) for x in found] == list(held.values())
    assert all(p >= license_scan.LEAST for x in found for _, _, p in x)  # nothing is reported that the classifier doubts


def test_window_probabilities_equal_those_of_their_words():
    model, rng = license_scan.train_classifier(), random.Random(2)
    known = sorted({w for g in model.weights for w in g.split()})
    texts = ["\n".join(" ".join(rng.choice(known) for _ in range(rng.randrange(0, 100))) for _ in range(4)) for _ in range(30)]
    buf = license_scan.buffer_of(pa.array(texts))
    w = license_scan.words_of(buf, slice(0, len(texts)), license_scan.LOWER_CODE, license_scan.NOT_TERM)
    begin = np.array([k for k in range(0, len(w) - 40, 23) if w.row[k] == w.row[k + 30]])
    got = model.window_probabilities(w, begin, begin + 30)
    for k, p in zip(begin, got, strict=True):
        words = [buf.data[w.start[j] : w.end[j]].tobytes().decode() for j in range(k, k + 30)]
        assert np.allclose(p, model.probabilities(words), atol=1e-9)


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline

    folder, kept = "/root/testdata/sf0.001", {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == list(before.columns)
    assert kept["toxicity"] >= kept["quality"] >= kept["near_duplicates"] == kept["pii"] > 0
    assert docs.select("doc_id").distinct().count() == kept["pii"]
