"""A folder of document files as a stream into a chunk table.

Every micro-batch is cleaned, chunked and embedded by the batch operators and appended to the source's partition; the
checkpoint makes a restarted job go on where it stopped. Stopping the query is how a job is cancelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import text as T
from quillspark.operators.chunking import chunked
from quillspark.operators.embedding import Embedder, embedded
from quillspark.sources.files import decoded, documents_of, fallback_title, plain_path, readable, wanted

FILES_PER_BATCH = 64


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """uri, content, root of files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", FILES_PER_BATCH).load(root)
    return decoded(raw.select(plain_path(F.col("path")).alias("uri"), "content").filter(wanted(F.col("uri")))).withColumn("root", F.lit(root))


def document_stream(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    """document_id, source_id, uri, title, content of files as they arrive; only ingest, which has whole batches, fills in includes."""
    d = readable(file_stream(spark, root)).filter(F.col("content") != "")
    return d.select(F.xxhash64(F.lit(source_id), "uri").alias("document_id"), F.lit(source_id).alias("source_id"), "uri", F.coalesce(T.title(F.col("content")), fallback_title(F.col("uri"))).alias("title"), "content")


def ingest(spark: SparkSession, root: str, source_id: str, table: str, checkpoint: str, embedder: Embedder | None = None) -> StreamingQuery:
    """Starts a job that takes what is in the folder and ends; run it again for what is new. Files are read as batches read them, with
    includes and examples filled in. What changes or goes later isn't seen: streaming.captures follows that."""

    def write(batch: DataFrame, number: int) -> None:
        d = documents_of(batch, source_id).withColumn("document_id", F.xxhash64("source_id", "uri"))
        # Vectors are those of the batch engine: of title and content.
        rows = embedded(chunked(d.select("document_id", "source_id", "uri", "title", "content")).withColumn("_embedded", F.concat_ws("\n", "title", "content")), "_embedded", embedder).drop("_embedded").withColumn("batch", F.lit(number))
        # A batch that is tried again replaces what it wrote the first time.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "batch").parquet(table)

    return file_stream(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_events(progress: list[dict]) -> list[tuple[int, int, float]]:
    """(batch, rows, seconds) of a query's recentProgress."""
    return [(p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000) for p in progress]
