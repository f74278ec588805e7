"""Extra columns whose names an operator may use itself: results are those without them."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pytest.importorskip("docketry.llm")

from docketry.llm import bradley_terry, conversation_repair, dart_minhash, filter_audit, harmonic_packing, kd_shards, license_scan, pii_crf, quality_rules, threshold_topk, toxicity_fm, warc_archive  # noqa: E402
from docketry.llm.queries import tokenizer_file  # noqa: E402

NAMES = ["own", "kept", "good", "own_id", "kept_id", "own_doc_id", "good_doc_id", "own_key_a", "uid", "shard", "root", "n", "key_a", "key_b", "key_n", "score", "held_out", "part", "mask", "rows", "block", "width", "v", "toxic", "quality", "features", "digest", "kind", "copy", "bytes", "at", "nr", "class_id", "copies", "ids", "piece", "m_lang", "level", "bin", "group"]


@pytest.fixture(scope="module")
def plain(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(20, 120))), "en", f"s{k % 3}", k) for k in range(40)]
    rows += [(50 + k, rows[k][1], "en", "s0", 1) for k in range(8)] + [(60, None, None, None, None), (None, "", "en", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache()


def clashing(df):
    return df.withColumns({n: F.lit(f"mine {n}") for n in NAMES if n not in df.columns}).cache()


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("run", [dart_minhash.one_of_each, quality_rules.kept_rows, pii_crf.redacted], ids=["one_of_each", "kept_rows", "redacted"])
def test_stages_keep_all_columns_whatever_their_names(plain, run):
    wide = clashing(plain)
    left = run(wide)
    assert left.columns == wide.columns
    assert rows_of(left, *plain.columns) == rows_of(run(plain), *plain.columns)
    assert all(r[n] == f"mine {n}" for r in left.collect() for n in NAMES)


def _with_labels(of):
    def run(df):
        labels = df.sparkSession.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(40)], "doc_id long, quality int, toxic int")
        return of(df, labels)

    return run


OPERATORS = {
    "near_duplicates": dart_minhash.near_duplicates,
    "shards": kd_shards.kd_shards,
    "licenses": license_scan.license_notices,
    "quality": quality_rules.quality_verdicts,
    "pii": pii_crf.personal_data,
    "packing": lambda df: harmonic_packing.packed_pieces(df, tokenizer_file("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    "toxicity": _with_labels(lambda df, labels: toxicity_fm.toxicity_scores(df, toxicity_fm.train(df, labels))),
    "quality_model": _with_labels(lambda df, labels: bradley_terry.quality_scores(df, bradley_terry.train(df, labels))),
    "filters": _with_labels(filter_audit.filter_interactions),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_results_do_not_depend_on_extra_columns(plain, name):
    run = OPERATORS[name]
    want, got = run(plain), run(clashing(plain))
    assert got.columns == want.columns and rows_of(got, *got.columns) == rows_of(want, *want.columns)


def test_other_tables(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k}", "<p>" + "x" * (k % 4)) for k in range(12)], "page_id long, url string, html string")
    assert rows_of(warc_archive.archive_round_trip(clashing(pages)), "page_id", "payload_digest", "record_type", "refers_to") == rows_of(warc_archive.archive_round_trip(pages), "page_id", "payload_digest", "record_type", "refers_to")
    vectors = spark.createDataFrame([(k, [float(k % 5), float(k % 3) - 1]) for k in range(30)], "vec_id long, embedding array<float>")
    top = lambda t: threshold_topk.exact_top_k(threshold_topk.whole_vectors(t), threshold_topk.whole_vectors(t).where("vec_id % 10 = 0"), 3)
    assert rows_of(top(clashing(vectors.withColumnRenamed("embedding", "embedding"))), "query_id", "rank", "vec_id", "score") == rows_of(top(vectors), "query_id", "rank", "vec_id", "score")
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in range(6) for t in range(5)], "conv_id long, turn long, role string, text string")
    for limit in (100_000, 3):
        run = lambda t, limit=limit: conversation_repair.repair_digests(t, long_rows=limit, block_rows=2)
        assert rows_of(run(clashing(turns)), "conv_id", "cost", "audit", "repaired_sha256") == rows_of(run(turns), "conv_id", "cost", "audit", "repaired_sha256")
