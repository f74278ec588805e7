"""Written tables in the folder that a cluster shares, and the schemas of the inputs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Columns of `documents`, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of this machine, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docketry-", dir=os.environ.get("TMPDIR") or None)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in a folder of their own under the shared one; `clear` deletes those not kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_path(spark, name)
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str, keep: bool = False, **what: Column) -> tuple[DataFrame, dict]:
        """`written`, and aggregates of the table that are taken while it is written."""
        seen = Observation()
        table = self.written(df.observe(seen, *[c.alias(k) for k, c in what.items()]), name, keep)
        return table, seen.get

    def by_key(self, df: DataFrame, name: str, rows_of_key: str = "n", keep: bool = False) -> DataFrame:
        """`written`, for `spread_join`: a table with one row per key and the key's number of rows."""
        table, seen = self.measured(df, name, keep, most=F.coalesce(F.max(rows_of_key), F.lit(0)))
        table.most_rows_of_a_key = seen["most"]
        return table

    def clear(self) -> None:
        """Deletes the tables that no result reads any more."""
        conf = self.spark._jsc.hadoopConfiguration()
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        self.paths = []


#: A key is hot if it has more than HOT_ROWS rows and more than one in HOT_KEYS of all, so at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 2000


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], total: int, rows_of_key: str = "n") -> DataFrame:
    """rows joined with `table` (from `Scratch.by_key`), which has one row per key and the key's number of rows.

    A hot key's rows stay where they are: the hot part of `table`, whose size has a bound, is
    broadcast to them. All others meet by a shuffle in which no key has many rows.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if table.most_rows_of_a_key <= limit:
        return rows.join(table, on)
    hot = table.where(F.col(rows_of_key) > limit)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(F.col(rows_of_key) <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def unused(columns: list[str], *stems: str) -> list[str]:
    """Names that are no column's, one for each stem, whatever the user's table is called."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker: rows are texts, and ten thousand of them may be large.
BATCH_BYTES = 4 << 20
#: Characters of a plan's text. The driver keeps the texts of the last thousand queries, and iterations make many.
PLAN_CHARS = 20_000


def prepared(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, and get their rows a few MB at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "64m", "67108864", "67108864b", "64MB"):  # as Spark has it, not set by the user
        spark.conf.set(name, str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.maxPlanStringLength", str(PLAN_CHARS + 1))) > 1 << 30:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def text_key(text: Column | None = None) -> list[Column]:
    """Two independent 64-bit hashes and the length: the identity of a text in joins that need not carry it."""
    text = F.col("text") if text is None else text
    return [
        F.xxhash64(text).alias("key_a"),
        F.hash(text, F.length(text)).cast("long").alias("key_b"),
        F.octet_length(text).cast("long").alias("key_n"),
    ]
