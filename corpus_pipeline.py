"""A corpus pipeline: toxic and low-quality documents go, one of each near-duplicate group stays,
personal data is masked, and the rest is packed into training sequences.

Every stage takes the documents that the one before it kept. All but the last return the columns
of `documents`. A row's verdict is its own: rows that share an id, or have none, are told apart by
their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import dart_minhash, harmonic_packing, pii_crf, quality_rules, toxicity_fm
from docketry.llm._shared import DOCUMENT_COLUMNS, read_table, prepared, written
from docketry.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    machine = toxicity_fm.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity_fm.without_toxic(docs, machine).select(*DOCUMENT_COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return quality_rules.kept_rows(docs).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return dart_minhash.one_of_each(docs).select(*DOCUMENT_COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    clean = pii_crf.redacted(docs.select(*DOCUMENT_COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return harmonic_packing.packed_pieces(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: No stage but the packing law is SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
