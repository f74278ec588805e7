"""State kept in files: maps of documents, batches, keyed tables that replayed updates leave alone, and contents by hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketry.functions.text import media_type

#: A batch's documents, and the batch as it is kept.
DOCUMENT = "struct<doc_id:string,source_hash:string,filename:string,folder_code:string,folder_number:int,confidence:double,page_count:bigint,employee_code:string,cache_hit:boolean>"
BATCH = f"batch_id string, company_id string, year int, month int, created_at timestamp, total_pages bigint, approved_count bigint, review_count bigint, documents array<{DOCUMENT}>"
#: A cache hit as it is logged, and what stands in the log for a confidence that was none or 0.
HIT = "source_hash string, document_code string, confidence double, timestamp timestamp, hit_count int, employee_code string"
UNSTATED = 0.85


def read_or_empty(spark: SparkSession, schema: str, read: Callable[[], DataFrame]) -> DataFrame:
    """What `read` gives; a path that is not there yet is an empty table of the schema."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def state_rows(spark: SparkSession, path: str, value: str, field: str = "workspaces") -> DataFrame:
    """S3: a row per entry of the maps called `field` in JSON documents: key, and the fields of `value`, a struct's schema.

    Fields that older documents lack are null, arrays among them empty. A missing path has no rows.
    """
    fields = spark.createDataFrame([], value).schema
    whole = f"{field} map<string,struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in fields)}>>"
    docs = read_or_empty(spark, whole, lambda: spark.read.schema(whole).option("multiLine", True).json(path))
    rows = docs.select(F.explode(field).alias("key", "value")).select("key", "value.*")
    return rows.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in fields if f.dataType.typeName() == "array"})


def write_state(rows: DataFrame, path: str, parts: int, field: str = "workspaces", key: str = "key") -> None:
    """S3: the same documents from rows: `parts` maps, each key in the one its hash names, so none holds all."""
    entry = F.struct(key, F.struct(*[c for c in rows.columns if c != key]))
    maps = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias(field))
    maps.select(field).repartition(parts).write.mode("overwrite").json(path)


def write_batches(batches: DataFrame, path: str) -> None:
    """A JSON document per batch (BATCH), in a folder of its own; a batch that is written again replaces itself only."""
    batches.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").json(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, BATCH, lambda: spark.read.schema(BATCH).json(path))


def batch_rows(documents: DataFrame) -> DataFrame:
    """BATCH from documents: batch_id, company_id, year, month, created_at, seq and the fields of DOCUMENT. A batch has as many documents as an intake may."""
    names = [f.split(":")[0] for f in DOCUMENT[7:-1].split(",")]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", *names))), lambda d: F.struct(*[d[n].alias(n) for n in names]))
    one = documents.groupBy("batch_id", "company_id", "year", "month", "created_at")
    return one.agg(F.sum("page_count").alias("total_pages"), F.count_if(F.col("confidence") > 0.8).alias("approved_count"), F.count_if(F.col("confidence") <= 0.8).alias("review_count"), listed.alias("documents"))


def cache_hits(hits: DataFrame) -> DataFrame:
    """Hits as they are logged; a confidence of 0 counts as none."""
    stated = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(UNSTATED))
    return hits.select("source_hash", "document_code", stated.alias("confidence"), "timestamp", F.lit(1).alias("hit_count"), "employee_code")


def append_hits(hits: DataFrame, path: str) -> None:
    cache_hits(hits).write.mode("append").json(path)


def hit_log(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, HIT, lambda: spark.read.schema(HIT).json(path))


class KeyedTable:
    """One row per key in Parquet, in buckets by the key's hash, with the batch that wrote it last.

    An update rewrites the buckets of its keys only: Spark writes them aside and swaps them in when
    all its tasks are done. A row that a batch has written is passed over when the batch comes
    again, so a batch may be replayed, whole or in part, and updates may depend on the old row. Rows
    of one key in one batch apply as the last of them by `order`. One writer at a time; readers see
    of each bucket the old rows or the new.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets
        self.columns = spark.createDataFrame([], schema).schema.fieldNames()
        self._schema = StructType(spark.createDataFrame([], f"{schema}, _batch bigint, _bucket int").schema.fields)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _kept(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._schema).option("basePath", self.root).parquet(self.root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self._schema)

    def read(self) -> DataFrame:
        return self._kept().select(*self.columns)

    def apply(self, updates: DataFrame, batch_id: int, order: str | None = None, merge: Callable[[Column, Column], Column] | None = None) -> None:
        """Puts a batch's rows in: as they are, or as merge(old, new) gives them; both are structs of the columns, old null where the key is new."""
        row = F.struct(*self.columns)
        new = updates.groupBy(*self.key).agg((F.max_by(row, order) if order else F.first(row)).alias("new"))
        new = new.withColumn("_bucket", self._bucket()).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # `buckets` numbers at most
            if not touched:
                return
            old = self._kept().where(F.col("_bucket").isin(touched)).select(*self.key, row.alias("old"), F.col("_batch").alias("was"))
            both = old.join(new.drop("_bucket"), self.key, "full_outer")
            due = F.col("new").isNotNull() & (F.coalesce("was", F.lit(-1)) < batch_id)
            put = merge(F.col("old"), F.col("new")) if merge else F.col("new")
            out = both.select(F.when(due, put).otherwise(F.col("old")).alias("row"), F.when(due, F.lit(batch_id)).otherwise(F.col("was")).alias("_batch")).select("row.*", "_batch")
            out.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.root)
        finally:
            new.unpersist()


CONTENT = "hash string, media_type string, name string, length bigint, content binary, shelf string"


def stored_contents(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, CONTENT, lambda: spark.read.schema(CONTENT).parquet(root))


def store_contents(files: DataFrame, root: str) -> None:
    """Files (path, content) into a store by SHA-256: a content that is there, or comes twice, is written once.

    Shelves by the hash's first two letters keep a lookup from reading the store. Bytes go only
    from a file's task to its shelf; what is there is known by hashes. A file without bytes has nothing to store; Spark's reader passes it over.
    """
    known = stored_contents(files.sparkSession, root).select("hash")
    hashed = files.select("path", "content", F.sha2("content", 256).alias("hash"))
    fresh = hashed.join(known, "hash", "left_anti").groupBy("hash").agg(F.min_by(F.struct("path", "content"), "path").alias("f"))
    name = F.element_at(F.split("f.path", "/"), -1)
    rows = fresh.select("hash", F.coalesce(F.nullif(media_type(F.lit(""), name), F.lit("")), F.lit("image/jpeg")).alias("media_type"), name.alias("name"), F.octet_length("f.content").cast("long").alias("length"), F.col("f.content").alias("content"), F.substring("hash", 1, 2).alias("shelf"))
    rows.repartition("shelf").write.mode("append").partitionBy("shelf").parquet(root)
