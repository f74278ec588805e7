"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import bradley_terry, conversation_repair, dart_minhash, filter_audit, harmonic_packing, kd_shards, license_scan, pii_crf, quality_rules, sentencepiece_codec, threshold_topk, toxicity_fm, warc_archive
from docketry.llm._shared import documents, read_table, prepared


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trips(documents(spark, sf_dir), sentencepiece_codec.load_model(tokenizer_file("piece_bpe_32k.model")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(documents(spark, sf_dir))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(documents(spark, sf_dir))


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_notices(documents(spark, sf_dir))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, sf_dir))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.personal_data(documents(spark, sf_dir))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = threshold_topk.whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return threshold_topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity_fm.toxicity_scores(docs, toxicity_fm.train(docs, read_table(spark, sf_dir, "labels")))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing.packed_pieces(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archive_round_trip(read_table(spark, sf_dir, "pages"))


def quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.trained_scores(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(read_table(spark, sf_dir, "conversations"))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _ready(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_sentencepiece": sentencepiece,
        "op2_near_duplicates": near_duplicates,
        "op3_shards": shards,
        "op4_licenses": licenses,
        "op5_quality": quality,
        "op6_pii": pii,
        "op7_top_k": top_k,
        "op8_toxicity": toxicity,
        "op9_packing": packing,
        "op10_warc": warc,
        "op11_quality_classifier": quality_model,
        "op12_conversation_repair": repair,
        "op13_filter_audit": filters,
        "pipeline": pipeline,
    }
    return {name: _ready(run) for name, run in found.items()}


TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_top_k": TOP_K_SQL, "op13_filter_audit": filter_audit.SQL}
