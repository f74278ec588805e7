"""Product rules: confidence model, batch anomalies, entities, quarters, likeness of headers and footers."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, MinHashLSH
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import normal_period
from docketry.operators.classify import settled_rows

# Weights of the confidence model, penalties and their caps, and its bands.
WEIGHTS = {"type_confidence": 0.30, "entity_confidence": 0.20, "period_confidence": 0.15, "evidence_confidence": 0.15, "boundary_confidence": 0.10, "source_quality_confidence": 0.10}
CONFLICT, MISSING, AUTOMATIC, VISIBLE = (0.20, 0.60), (0.15, 0.45), 0.90, 0.75
# Endings of company names that tell nothing.
LEGAL_ENDINGS = r"( (lda|limitada|sa|s a|unipessoal|sgps))+$"


def final_confidence(docs: DataFrame) -> DataFrame:
    """Docs with final_confidence and band from six components, adjustments, conflicts and missing fields."""
    sums = sum((F.lit(w) * F.col(c) for c, w in list(WEIGHTS.items())[1:]), F.lit(WEIGHTS["type_confidence"]) * F.col("type_confidence"))
    adjusted = sums + F.greatest(F.lit(-0.15), F.least(F.lit(0.15), F.col("rule_adjustment"))) + F.greatest(F.lit(0.0), F.least(F.lit(0.10), F.col("example_adjustment")))
    penalty = F.least(F.lit(CONFLICT[1]), F.lit(CONFLICT[0]) * F.col("conflicts")) + F.least(F.lit(MISSING[1]), F.lit(MISSING[0]) * F.col("missing_fields"))
    final = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), adjusted - penalty)), 6)
    blocked = (F.col("conflicts") > 0) | (F.col("missing_fields") > 0)
    band = F.when(blocked | (final < VISIBLE), "review").when(final >= AUTOMATIC, "automatic").otherwise("visible")
    return docs.withColumn("final_confidence", final).withColumn("band", band)


def batch_anomalies(docs: DataFrame, expected: DataFrame, share: float = 0.8) -> DataFrame:
    """R2: batch_id, anomaly, detail: codes beside one that holds `share` of the batch, periods beside the commonest, entities beside the commonest, expected codes that are missing.

    docs: batch_id, code, period, entity. expected: batch_id, code. Counts are taken before batches are ranked.
    """
    total = docs.groupBy("batch_id").agg(F.count("*").alias("n"))

    def beside(what: str, anomaly: str, least: float) -> DataFrame:
        counts = docs.where(F.col(what).isNotNull()).groupBy("batch_id", F.col(what).cast("string").alias("detail")).agg(F.count("*").alias("k"))
        first = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("k"), "detail"))
        top = F.max("k").over(Window.partitionBy("batch_id"))
        ranked = counts.withColumn("nth", first).withColumn("top", top).join(total, "batch_id")
        return ranked.where((F.col("nth") > 1) & (F.col("top") >= least * F.col("n"))).select("batch_id", F.lit(anomaly).alias("anomaly"), "detail")

    absent = expected.join(docs.select("batch_id", "code").distinct(), ["batch_id", "code"], "left_anti").select("batch_id", F.lit("missing_evidence").alias("anomaly"), F.col("code").alias("detail"))
    return beside("code", "outlier_type", share).unionByName(beside("period", "period_drift", 0.0)).unionByName(beside("entity", "entity_mismatch", 0.0)).unionByName(absent)


def entity_groups(docs: DataFrame) -> DataFrame:
    """Entity, period, documents, names, conflict: documents grouped by tax number, else by normal name without legal ending.

    docs: nif, name, year, month. A name that two tax numbers share is a conflict and is never merged
    through; without an entity or a period a document is in no group but `review`.
    """
    name = F.regexp_replace(F.expr(normal_period("name")), LEGAL_ENDINGS, "")
    named = docs.withColumn("plain", F.nullif(name, F.lit("")))
    numbers = named.where("nif IS NOT NULL AND plain IS NOT NULL").groupBy("plain").agg(F.countDistinct("nif").alias("numbers"), F.min("nif").alias("only_nif"))
    seen = named.join(numbers, "plain", "left")
    entity = F.coalesce("nif", F.when(F.col("numbers") == 1, F.col("only_nif")), "plain")
    whole = entity.isNotNull() & F.col("year").isNotNull() & F.col("month").isNotNull()
    grouped = seen.withColumn("entity", F.when(whole, entity).otherwise("review")).withColumn("period", F.when(whole, F.col("year") * 100 + F.col("month")))
    return grouped.groupBy("entity", "period").agg(F.count("*").alias("documents"), F.countDistinct("plain").alias("names"), F.coalesce(F.bool_or(F.col("numbers") > 1), F.lit(False)).alias("conflict"))


def quarter(month: F.Column) -> F.Column:
    """1T to 4T of a month."""
    return F.when(month.between(1, 12), F.concat(F.ceil(month / 3).cast("string"), F.lit("T")))


def schema_problems(docs: DataFrame, domains: DataFrame) -> DataFrame:
    """doc_id, quarter, problems of records: confidence and month in range, nine-digit tax numbers, ISO dates, a type that belongs to its domain. domains: domain, code."""
    seen = docs.join(domains.withColumn("belongs", F.lit(True)), ["domain", "code"], "left")
    checks = {"confidence": F.col("confidence").between(0, 1), "month": F.col("month").isNull() | F.col("month").between(1, 12), "nif": F.col("nif").isNull() | F.col("nif").rlike("^[0-9]{9}$"), "date": F.col("document_date").isNull() | F.col("document_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "domain": F.col("belongs").isNotNull() | (F.col("code") == "UNKNOWN")}
    problems = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in checks.items()]), lambda x: x.isNotNull())
    return seen.select("doc_id", quarter(F.col("month")).alias("quarter"), F.array_join(problems, ",").alias("problems"))


def like_headers(docs: DataFrame, threshold: float = 0.8, size: int = 3) -> DataFrame:
    """A, b, similarity of documents whose headers and footers share most of their word runs.

    docs: doc_id, edge (header and footer). Equal edges are one before they are compared, and stand
    for each other afterwards: `a` and `b` are the smallest ids of their edges.
    """
    words = F.filter(F.split(F.expr(normal_period("edge")), " "), lambda w: w != "")
    one = docs.withColumn("words", words).where(F.size("words") >= size).groupBy("words").agg(F.min("doc_id").alias("doc_id"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda k: F.array_join(F.slice("words", k + 1, size), " ")))
    edges = settled_rows(one.select("doc_id", runs.alias("runs")))  # no later filter is tried on texts that are too short
    hashed = HashingTF(inputCol="runs", outputCol="features", numFeatures=1 << 18, binary=True).transform(edges)
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=8, seed=7).fit(hashed)
    near = model.approxSimilarityJoin(hashed, hashed, 1 - threshold, "distance").where("datasetA.doc_id < datasetB.doc_id")
    both = F.size(F.array_intersect("datasetA.runs", "datasetB.runs"))
    exact = both / (F.size("datasetA.runs") + F.size("datasetB.runs") - both)
    return near.select(F.col("datasetA.doc_id").alias("a"), F.col("datasetB.doc_id").alias("b"), F.round(exact, 6).alias("similarity")).where(F.col("similarity") >= threshold)
