"""The corpus pipeline, stage by stage and row by row, against plain Python over the same documents."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("docketry.llm")

from docketry.llm import pii_crf, quality_rules, toxicity_fm  # noqa: E402
from docketry.llm._shared import read_table  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_toxic(machine, text):
    """The machine's score from its definition: every pair of a text's slots, one after the other."""
    slots = sorted(set(toxicity_fm.text_features(toxicity_fm.buffer_of(pa.array([text or ""])), slice(0, 1))[1].tolist()))
    total = machine.bias + sum(float(machine.weight[s]) for s in slots)
    live = [s for s in slots if machine.factors[s].any()]
    total += sum(float(np.dot(machine.factors[a].astype(float), machine.factors[b].astype(float))) for k, a in enumerate(live) for b in live[k + 1 :])
    return 1 / (1 + np.exp(-total))


def brute_groups(docs):
    """Documents joined by a Jaccard likeness of 0.8 of their five-word runs, all pairs, and equal texts."""
    runs = {}
    for k, (_, text, *_rest) in enumerate(docs):
        w = words_of(text)
        runs[k] = {" ".join(w[j : j + 5]) for j in range(len(w) - 4)}
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            if docs[a][1] == docs[b][1] or (runs[a] and runs[b] and len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    out = collections.defaultdict(list)
    for k in range(len(docs)):
        out[root(k)].append(k)
    return list(out.values())


def test_every_stage_against_plain_python(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = rows(docs)

    # toxicity: the machine is fitted once and applied by hand
    machine = toxicity_fm.train(docs, read_table(spark, FOLDER, "labels"))
    kept = stages["toxicity"](spark, docs, FOLDER)
    want = [r for r in before if brute_toxic(machine, r[1]) < toxicity_fm.THRESHOLD]
    assert sorted(rows(kept), key=str) == sorted(want, key=str)

    # quality: base rules by hand, then the method's own verdict
    docs = spark.createDataFrame(want, kept.schema)
    verdict = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs).collect()}

    def fails(text):
        w = words_of(text)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(repeated) > 50 * len(w)

    cut = quality_rules.chi_square_quantile(1 - quality_rules.ALPHA, len(quality_rules.VECTOR))
    want = [r for r in want if not fails(r[1]) and verdict[r[0]]["distance"] <= cut]
    kept = stages["quality"](spark, docs, FOLDER)
    assert sorted(rows(kept), key=str) == sorted(want, key=str)

    # near duplicates: one of each group, that of the smallest id
    docs = spark.createDataFrame(want, kept.schema)
    groups = brute_groups(want)
    assert any(len(g) > 1 for g in groups)
    want = [min((want[k] for k in g), key=lambda r: r[0]) for g in groups]
    kept = stages["near_duplicates"](spark, docs, FOLDER)
    assert sorted(rows(kept), key=str) == sorted(want, key=str)

    # personal data: base spans by their patterns, added ones by the field's best labels of every line
    docs = spark.createDataFrame(want, kept.schema)
    field = pii_crf.default_field()
    masked = []
    for doc_id, text, lang, source, _ in want:
        _, ((_, base, added),) = next(iter(pii_crf.all_spans(pa.array([text]), field)))
        chars, at = [], 0
        for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
            if start >= at:
                chars += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        clean = "".join([*chars, text[at:]])
        masked.append((doc_id, clean, lang, source, len(clean)))
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", clean)
    kept = stages["pii"](spark, docs, FOLDER)
    assert sorted(rows(kept), key=str) == sorted(masked, key=str)

    # packing: every id once, in order, in sequences without gaps
    docs = spark.createDataFrame(masked, kept.schema)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2] for r in masked}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in stages["packing"](spark, docs, FOLDER).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for doc, spans in pieces.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[doc])
    held = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
        held += at if at & (at - 1) == 0 else 4096
    total = sum(map(len, ids.values()))
    assert held - total <= 0.1 * total + 4096 * 8  # little padding: a worker's last sequences only
