"""Captured files and pages as a stream of changes: the newest capture of a path or URL counts, what is gone disappears.

A folder of captures (Parquet, appended to) feeds a stateful stream keyed by URI. Its state is a time and a hash for each URI, never a
text; it passes on what is newer and differs. A micro-batch writes its changes, documents and chunks into partitions of its own, which
a second try replaces, and its commit last, so that readers see whole batches only.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

from quillspark.operators.chunking import chunked
from quillspark.operators.embedding import Embedder, embedded
from quillspark.sources import files, web

#: at: when it was captured, in any unit that grows; content: null where it is gone; root: the folder that a file was found in.
CAPTURE = "uri string, at long, length long, modified timestamp, root string, content string"
CHANGE = "uri string, at long, sha string, root string, content string"
CHANGED = "uri string, at long, sha string, batch long"
FILES_PER_BATCH = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Passes on the newest capture of a key if it is newer than the last one and differs from it. Of captures of one time the larger
    hash counts; one that is gone comes before all others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, sha string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r.at, r.sha or ""))
        at, sha = self.last.get() if self.last.exists() else (None, None)
        if at is not None and (best.at, best.sha or "") <= (at, sha or ""):
            return
        self.last.update((best.at, best.sha))
        if best.sha != sha:
            yield Row(uri=key[0], at=best.at, sha=best.sha, root=best.root, content=best.content)

    def close(self) -> None:
        pass


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def capture_folder(spark: SparkSession, root: str, captures: str, at: int | None = None) -> None:
    """Appends the files below root that changed since the last capture, and a row without content for each that is gone.

    The listing is compared by length and time of change; contents are read from the earliest changed file's time on. A folder that
    can't be read is an error and removes nothing.
    """
    at = time.time_ns() // 1000 if at is None else at
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumnsRenamed({"modificationTime": "modified"}).withColumn("uri", files.plain_path(F.col("path"))).filter(files.wanted(F.col("uri")))
    listed = every.select("uri", "length", "modified")
    last = _read(spark, captures, CAPTURE).filter(F.col("root") == root).groupBy("uri").agg(F.max(F.struct("at", F.col("content").isNotNull().alias("there"), "length", "modified")).alias("last"))
    known = last.filter("last.there").select("uri", "last.length", "last.modified")
    changed = listed.join(known, ["uri", "length", "modified"], "left_anti")
    since = changed.agg(F.min("modified")).first()[0]
    out = known.join(listed, "uri", "left_anti").withColumn("content", F.lit(None).cast("string"))
    if since is not None:
        meant = every.filter(F.col("modified") >= F.lit(since)).join(changed, ["uri", "length", "modified"], "left_semi")
        texts = files.decoded(meant.select("uri", "content")).join(changed, "uri")
        out = out.unionByName(texts.select("uri", "length", "modified", "content"))
    out.select("uri", F.lit(at).alias("at"), "length", "modified", F.lit(root).alias("root"), "content").write.mode("append").parquet(captures)


def capture_pages(pages: DataFrame, captures: str) -> None:
    """Appends pages (page_id, url, html); a null html says that the page is gone. A larger page_id is newer."""
    null = lambda kind: F.lit(None).cast(kind)
    pages.select(F.col("url").alias("uri"), F.col("page_id").cast("long").alias("at"), null("long").alias("length"), null("timestamp").alias("modified"), null("string").alias("root"), F.col("html").alias("content")).write.mode("append").parquet(captures)


def changes(spark: SparkSession, captures: str) -> DataFrame:
    """The stream of changes (uri, at, sha, root, content) of a folder of captures; rows without uri or time are left out."""
    rows = spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(captures)
    rows = rows.filter("uri is not null and at is not null").select("uri", "at", F.sha2("content", 256).alias("sha"), "root", "content")
    return rows.groupBy("uri").transformWithState(Newest(), CHANGE, "Update", "None")


def follow(spark: SparkSession, captures: str, source_id: str, store: str, checkpoint: str, embedder: Embedder | None = None) -> StreamingQuery:
    """Starts a job that brings a store up to its source's captures and ends; run it again for what is new.

    Captures with a root are files, read as batches read them, with includes filled in as they are now (a file is taken again when it
    changes itself, not when what it includes does); those without are pages. The session keeps stream state in RocksDB from here on.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, number: int) -> None:
        # Written first and read back: the stateful plan runs once.
        at = {t: f"{store}/{t}/batch={number}" for t in ("changes", "documents", "chunks", "commits")}
        batch.write.mode("overwrite").parquet(at["changes"])
        there = spark.read.schema(CHANGE).parquet(at["changes"]).filter("sha is not null")
        own = files.documents_of(there.filter("root is not null").select("uri", "content", "root"), source_id).select("uri", "title", "content")
        pages = web.markdown_pages(there.filter("root is null").select(F.col("at").alias("page_id"), F.col("uri").alias("url"), F.col("content").alias("html")))
        d = own.unionByName(pages.select(F.col("url").alias("uri"), "title", "content"))
        d.select(F.xxhash64(F.lit(source_id), "uri").alias("document_id"), F.lit(source_id).alias("source_id"), "uri", "title", "content").write.mode("overwrite").parquet(at["documents"])
        c = chunked(spark.read.parquet(at["documents"])).withColumn("chunk_id", F.xxhash64("source_id", "uri", "ordinal"))
        c = embedded(c.withColumn("_embedded", F.concat_ws("\n", "title", "content")), "_embedded", embedder).drop("_embedded")
        c.write.mode("overwrite").parquet(at["chunks"])
        spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(at["commits"])

    # A state a shuffle partition: their number is fixed by the first run.
    return changes(spark, captures).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, store: str, table: str = "chunks") -> DataFrame:
    """The documents or chunks of a store as of its last whole batch: of each URI those of its newest change, none where it is gone."""
    last = spark.read.schema("number long").parquet(f"{store}/commits").agg(F.max("number")).first()[0]
    told = spark.read.schema(CHANGED).parquet(f"{store}/changes").filter(F.col("batch") <= last)
    newest = told.groupBy("uri").agg(F.max(F.struct("batch", "sha")).alias("last")).filter("last.sha is not null").select("uri", "last.batch")
    return spark.read.parquet(f"{store}/{table}").filter(F.col("batch") <= last).join(newest, ["uri", "batch"], "left_semi").drop("batch")
