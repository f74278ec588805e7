"""Joins whose small side is measured before it is broadcast, and checkpoints of tables that many steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and characters of a side that is broadcast, at most.
MOST_ROWS, MOST_CHARACTERS = 20_000, 32 << 20


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """`df`, to be broadcast if it has `most` rows or fewer: it is counted up to there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def beside_texts(rows: DataFrame, table: DataFrame, key: str, payload: str, salts: int = 0) -> DataFrame:
    """rows with the payload of their key, null where there is none; `table` has one row a key, `rows` may carry whole texts and have few keys.

    A table of few enough characters is broadcast, so no text moves. A larger one is dealt out in
    `salts` copies (as many as there are shuffle partitions, if 0), and each row meets one of them:
    a key with a third of all rows lies in as many tasks.
    """
    spark = rows.sparkSession
    size = table.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(payload)))), F.lit(0)).alias("n")).first()["n"]
    if size <= MOST_CHARACTERS:
        return rows.join(F.broadcast(table.select(key, payload)), key, "left")
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = table.select(key, payload, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return rows.withColumn("_salt", (F.rand(7) * salts).cast("int")).join(spread, [key, "_salt"], "left").drop("_salt")


def held(df: DataFrame) -> DataFrame:
    """The rows checkpointed, for tables that many later steps read; in local mode without a checkpoint folder, in one of this machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
