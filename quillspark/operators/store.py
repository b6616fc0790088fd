"""Catalog and store: snapshots as frames, latest-wins updates, deletes as anti joins, partition overwrites.

Tables are Parquet folders partitioned by source_id; a writer replaces or appends to whole partitions.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIVE = ("running", "cancelling")


def latest(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """The newest row of each key."""
    order = W.partitionBy(key).orderBy(*(F.desc(c) for c in newest))
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1).drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str, *newest: str) -> DataFrame:
    """old with the rows of new in place of those with their key; created_at stays that of old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    if "created_at" in old.columns:
        both = both.withColumn("created_at", F.min("created_at").over(W.partitionBy(key)))
    return latest(both, key, "_new", *newest).drop("_new")


def without_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of all sources but these: a delete that cascades when applied to each table."""
    return rows.join(sources.select("source_id").distinct(), "source_id", "left_anti")


def replaced(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with those of new in place of all rows of new's sources."""
    return without_sources(rows, new).unionByName(new)


def write_sources(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replaces (overwrite) or extends (append) the partitions of the sources in rows; others stay."""
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def kept_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share: spark.checkpoint.dir, else the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows and bytes of whole texts that go to a Python worker, or come from it, at once.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session's Arrow batches are bounded from here on, whatever its texts' lengths."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", conf.get(key))[0])
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def kept(rows: DataFrame) -> DataFrame:
    """The same rows, written once into the folder that all executors share."""
    spark, path = rows.sparkSession, kept_folder(rows.sparkSession)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, document_count, chunk_count; sources of either table."""
    d = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("document_count"))
    c = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return d.join(c, "source_id", "full_outer").select("source_id", zero("document_count"), zero("chunk_count"))


def backfilled(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Embedding columns that are missing: dimensions from the vector, provider and model from the source."""
    own = sources.select("source_id", F.col("provider").alias("_p"), F.col("model").alias("_m"))
    j = chunks.join(own, "source_id", "left")
    dims = F.when(F.coalesce("embedding_dimensions", F.lit(0)) > 0, F.col("embedding_dimensions")).otherwise(F.coalesce(F.size("embedding"), F.lit(0)))
    return j.withColumn("embedding_dimensions", dims).withColumn("embedding_provider", F.coalesce("embedding_provider", "_p")).withColumn("embedding_model", F.coalesce("embedding_model", "_m")).drop("_p", "_m")


def queryable(sources: DataFrame, provider: str, model: str) -> DataFrame:
    """Indexed sources whose embedding is the current one."""
    return sources.filter((F.col("status") == "indexed") & (F.col("provider") == provider) & (F.col("model") == model))


def stale(sources: DataFrame, provider: str, model: str) -> DataFrame:
    """Indexed sources whose embedding is another."""
    return sources.filter((F.col("status") == "indexed") & ~((F.col("provider") == provider) & (F.col("model") == model)))


def named(sources: DataFrame, provider: str, model: str, source_id: str | None = None, name: str | None = None) -> list[str] | None:
    """The ids that a search may use: all that are queryable, or the one named; none if unknown, an error if stale."""
    if source_id is None and name is None:
        return [r.source_id for r in queryable(sources, provider, model).select("source_id").collect()]  # the catalog: a row a source
    key = F.col("source_id") == source_id if source_id is not None else F.lower("name") == (name or "").lower()
    row = sources.filter(key).orderBy(F.desc("updated_at")).first()
    if row is None:
        return []
    if row.status != "indexed":
        raise ValueError(f"source {row['name']} is not indexed")
    if (row.provider, row.model) != (provider, model):
        raise ValueError(f"source {row['name']} was indexed with {row.provider} {row.model}")
    return [row.source_id]


def usable(sources: DataFrame, provider: str, model: str, source_id: str | None = None, name: str | None = None) -> DataFrame | list[str]:
    """What a search may use, as named has it; all that are queryable as a frame, so that a large catalog stays where it is."""
    if source_id is None and name is None:
        return queryable(sources, provider, model).select("source_id")
    return named(sources, provider, model, source_id, name) or []


def running_jobs(jobs: DataFrame) -> DataFrame:
    """The newest active job of each source."""
    return latest(jobs.filter(F.col("status").isin(*ACTIVE)), "source_id", "created_at", "job_id")


def progress(jobs: DataFrame) -> DataFrame:
    """jobs with percent (rounded, at most 100) and eta_seconds from the time per item so far."""
    done, total = F.col("progress_current"), F.col("progress_total")
    percent = F.when(total > 0, F.least(F.lit(100), F.round(100.0 * done / total))).cast("int")
    eta = F.when((done > 0) & (total >= done), F.col("elapsed_seconds") / done * (total - done))
    return jobs.withColumn("percent", percent).withColumn("eta_seconds", eta)
