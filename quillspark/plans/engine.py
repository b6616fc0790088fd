"""The library's front door: sources, indexing jobs, search and evaluation over tables in one folder.

captures (files as they were read), documents, chunks, postings and lengths are Parquet tables partitioned by source_id and run;
sources, jobs, settings and the manifest are logs of which the latest row of a key counts. Indexing writes a run of its own into all
tables, and one row of the manifest then makes it the source's current one: a search reads the manifest once and sees each
source's last whole run in all tables, however far the next one has come. What isn't current any more stays until it is
vacuumed, for searches that still read it.
"""

from __future__ import annotations

import contextlib
import functools
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillspark.operators import search as S
from quillspark.operators import store as K
from quillspark.operators.chunking import chunked
from quillspark.operators.embedding import Embedder, embedded
from quillspark.operators.evaluate import haystack, matches, report
from quillspark.sources import files, web

TABLES = ("captures", "documents", "chunks", "postings", "lengths")
SETTING = "mode string, updated_at double"
MANIFEST = "source_id string, run string, document_count long, chunk_count long, updated_at double, deleted boolean"
MODES = ("hybrid", "keyword", "vector")
SOURCE = "source_id string, kind string, name string, version string, location string, status string, document_count long, chunk_count long, provider string, model string, error string, created_at double, updated_at double, deleted boolean"
JOB = "job_id string, source_id string, status string, message string, progress_current long, progress_total long, created_at double, updated_at double"


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder or Embedder()
        kept = self._log("settings", SETTING).orderBy(F.desc("updated_at")).first()
        self.mode = kept.mode if kept else "hybrid"

    # --- catalog ---

    def _log(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _say(self, table: str, schema: str, **row) -> None:
        names = [c.split()[0] for c in schema.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def sources(self) -> DataFrame:
        return self._present(self._log("sources", SOURCE)).orderBy(F.desc("updated_at"))

    def _present(self, log: DataFrame) -> DataFrame:
        return K.latest(log, "source_id", "updated_at").filter(~F.coalesce("deleted", F.lit(False)))

    def current(self) -> DataFrame:
        """source_id, run, document_count, chunk_count, updated_at of the run that each source shows; read once, whatever is written later."""
        return self._present(self._log("manifest", MANIFEST)).drop("deleted")

    def stored(self) -> DataFrame:
        """The sources with the folder of the files as they were captured for the current run, null without one."""
        at = F.concat(F.lit(f"{self.root}/captures/source_id="), "source_id", F.lit("/run="), "run")
        return self.sources().join(self.current().select("source_id", at.alias("snapshot")), "source_id", "left")

    def jobs(self, limit: int = 50) -> DataFrame:
        return self._jobs().orderBy(F.desc("created_at")).limit(limit)

    def _jobs(self) -> DataFrame:
        """The jobs of the sources that there are."""
        return K.latest(self._log("jobs", JOB), "job_id", "updated_at").join(self.sources().select("source_id"), "source_id", "left_semi")

    def job_log(self, job_id: str) -> DataFrame:
        """All that was said of a job, in order."""
        return self._log("jobs", JOB).filter(F.col("job_id") == job_id).orderBy("updated_at")

    def register(self, kind: str, name: str, location: str, version: str = "latest") -> str:
        """A new source; names are unique, whatever their case."""
        name = name.strip()
        if kind not in ("local", "web") or not 1 <= len(name) <= 120:
            raise ValueError(f"not a source: {kind} {name!r}")
        if not self.sources().filter(F.lower("name") == name.lower()).isEmpty():
            raise ValueError(f"there is a source {name!r}")
        now, key = time.time(), f"s{uuid.uuid4().hex}"
        self._say("sources", SOURCE, source_id=key, kind=kind, name=name, version=version, location=location, status="registered", document_count=0, chunk_count=0, created_at=now, updated_at=now)
        return key

    def _update(self, source_id: str, **values) -> dict:
        row = self.sources().filter(F.col("source_id") == source_id).first()
        if row is None:
            raise KeyError(source_id)
        self._say("sources", SOURCE, **{**row.asDict(), **values, "updated_at": time.time()})
        return row.asDict()

    def delete(self, source_id: str) -> dict | None:
        """Drops a source with its jobs and all its runs; returns its last state, None if there is none."""
        try:
            row = self._update(source_id, deleted=True)
        except KeyError:
            return None
        self._say("manifest", MANIFEST, source_id=source_id, run="", updated_at=time.time(), deleted=True)
        return row

    def vacuum(self, older_than: float = 0.0) -> int:
        """Deletes the folders of runs that were written so many seconds ago, aren't current and belong to no running job; how many."""
        ended = self._log("manifest", MANIFEST).filter(F.col("updated_at") <= time.time() - older_than).select("source_id", "run")
        failed = self._log("jobs", JOB).filter(~F.col("status").isin(*K.ACTIVE) & (F.col("updated_at") <= time.time() - older_than)).select("source_id", F.col("job_id").alias("run"))
        busy = self._jobs().filter(F.col("status").isin(*K.ACTIVE)).select(F.col("job_id").alias("run"))
        gone = ended.union(failed).distinct().join(self.current(), ["source_id", "run"], "left_anti").join(busy, "run", "left_anti").filter("run <> ''")
        return sum(self._drop(table, r.source_id, r.run) for r in gone.collect() for table in TABLES)  # runs since the last time

    def _drop(self, table: str, source_id: str, run: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/source_id={source_id}/run={run}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # --- indexing ---

    def index_local(self, source_id: str, *paths: str) -> str:
        """Indexes files and folders: a job, whose id it returns. What stood in the source before is replaced as a whole; without
        documents the job fails. Includes are filled in from the folders and from what lies beside them."""
        unique = list({p.rstrip("/").casefold(): p.rstrip("/") for p in paths}.values())
        kept = json.dumps(unique)
        if not unique:
            raise ValueError("no paths")

        def documents(run: str) -> DataFrame:
            scanned = functools.reduce(DataFrame.union, (files.scan(self.spark, p).withColumn("root", F.lit(p)) for p in unique))
            self._write(scanned.dropDuplicates(["uri"]).withColumn("source_id", F.lit(source_id)), "captures", run)
            return self._captured(source_id, run)

        return self._index(source_id, documents, location=kept)

    def refresh(self, source_id: str) -> str:
        """Indexes a local source again: from its paths, if all are still there, else from the files as they were captured last."""
        row = self.sources().filter(F.col("source_id") == source_id).first()
        if row is None:
            raise KeyError(source_id)
        with contextlib.suppress(ValueError, TypeError, AnalysisException):
            paths = json.loads(row.location)
            for p in paths:
                self.spark.read.format("binaryFile").load(p)  # fails where the path is gone
            return self.index_local(source_id, *paths)
        return self.reindex(source_id)

    def reindex(self, source_id: str) -> str:
        """Indexes a source again from its last captured files: with another embedder, say."""
        now = self.current().filter(F.col("source_id") == source_id).first()
        if now is None or self._rows("captures", source_id, now.run) is None:
            raise FileNotFoundError(f"no captured files of source {source_id}")

        def documents(run: str) -> DataFrame:
            self._write(self._rows("captures", source_id, now.run).drop("run"), "captures", run)
            return self._captured(source_id, run)

        return self._index(source_id, documents)

    def _captured(self, source_id: str, run: str) -> DataFrame:
        rows = self._rows("captures", source_id, run)
        if rows is None:
            raise ValueError("no documents")
        return files.documents_of(rows.select("uri", "content", "root"), source_id)

    def index_pages(self, source_id: str, pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> str:
        """Indexes captured pages (page_id, url, html) that pass the URL patterns."""
        own = web.latest_captures(pages.filter(web.url_passes(F.col("url"), include or [], exclude or [])))
        d = web.markdown_pages(own)
        return self._index(source_id, lambda _: d.select(F.lit(source_id).alias("source_id"), F.col("url").alias("uri"), "title", "content", F.sha2("content", 256).alias("content_hash")))

    def index_documents(self, source_id: str, documents: DataFrame) -> str:
        """Indexes documents (uri, title, content) as they are."""
        d = documents.select(F.lit(source_id).alias("source_id"), "uri", "title", "content", F.sha2("content", 256).alias("content_hash"))
        return self._index(source_id, lambda _: d)

    def _index(self, source_id: str, documents: Callable[[str], DataFrame], **values) -> str:
        if not self._active(source_id).isEmpty():
            raise ValueError(f"source {source_id} is being indexed")
        began, job = time.time(), f"j{uuid.uuid4().hex}"
        say = lambda status, message, n=0: self._say("jobs", JOB, job_id=job, source_id=source_id, status=status, message=message, progress_current=n, progress_total=n or None, created_at=began, updated_at=time.time())
        shown = self.current().filter(F.col("source_id") == source_id).first()
        # A source that shows a run goes on showing it.
        before = self._update(source_id, **({} if shown else {"status": "indexing", "error": None, "document_count": 0, "chunk_count": 0}), **values)
        say("running", "indexing")
        self.spark.sparkContext.addJobTag(job)  # a tag of the session is not seen on jobs of other threads
        try:
            d = documents(job).withColumn("document_id", F.xxhash64("source_id", "uri"))
            self._write(d, "documents", job)
            d = self._rows("documents", source_id, job)
            if d is None or d.isEmpty():
                raise ValueError("no documents")
            c = chunked(d.select("document_id", "source_id", "uri", "title", "content"))
            c = c.withColumn("chunk_id", F.xxhash64("source_id", "uri", "ordinal")).withColumn("embedding_text", F.concat_ws("\n", "title", "content"))
            self._write(embedded(c, "embedding_text", self.embedder).drop("embedding_text"), "chunks", job)
            c = self._rows("chunks", source_id, job)
            self._write(S.postings(c).repartitionByRange("term").sortWithinPartitions("term"), "postings", job)
            self._write(S.lengths(c).withColumn("source_id", F.lit(source_id)), "lengths", job)
            n = K.counts(d, c).first()
            if self._cancelling(job):
                raise InterruptedError("cancelled")
            self._say("manifest", MANIFEST, source_id=source_id, run=job, document_count=n.document_count, chunk_count=n.chunk_count, updated_at=time.time())
            self._update(source_id, status="indexed", error=None, document_count=n.document_count, chunk_count=n.chunk_count, provider=self.embedder.provider, model=self.embedder.model)
            say("succeeded", "indexed", n.document_count)
        except Exception as error:
            if self._cancelling(job):
                back = {k: before[k] for k in ("status", "document_count", "chunk_count")} if shown else {"status": "registered"}
                self._update(source_id, **back, error="cancelled")
                say("cancelled", "cancelled")
            else:
                self._update(source_id, status="failed", error=str(error)[:500], document_count=0, chunk_count=0)
                say("failed", str(error)[:500])
                raise
        finally:
            self.spark.sparkContext.removeJobTag(job)
        return job

    def _active(self, source_id: str) -> DataFrame:
        return self._jobs().filter((F.col("source_id") == source_id) & F.col("status").isin(*K.ACTIVE))

    def _cancelling(self, job: str) -> bool:
        last = self._jobs().filter(F.col("job_id") == job).first()
        return last is not None and last.status == "cancelling"

    def cancel(self, source_id: str, stale: bool = False) -> list[str]:
        """Stops a source's jobs, whose ids it returns: what runs in this session is interrupted and says that it is cancelled;
        stale jobs (of a session that is gone) are cancelled at once."""
        jobs = self._active(source_id).collect()
        for j in jobs:
            self._say("jobs", JOB, **{**j.asDict(), "status": "cancelled" if stale else "cancelling", "message": "cancelled" if stale else "cancelling", "updated_at": time.time()})
            self.spark.sparkContext.cancelJobsWithTag(j.job_id)
        if jobs and stale:
            shown = not self.current().filter(F.col("source_id") == source_id).isEmpty()
            self._update(source_id, **({} if shown else {"status": "registered"}), error="cancelled")
        return [j.job_id for j in jobs]

    def _write(self, rows: DataFrame, table: str, run: str) -> None:
        """A run's rows as a partition of their own; written again, they replace what a failed attempt left."""
        rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "run").parquet(f"{self.root}/{table}")

    def _rows(self, table: str, source_id: str, run: str) -> DataFrame | None:
        """A run's rows, None if there are none."""
        try:
            path = f"{self.root}/{table}"
            return self.spark.read.option("basePath", path).parquet(f"{path}/source_id={source_id}/run={run}")
        except AnalysisException:
            return None

    def _table(self, name: str, now: DataFrame) -> DataFrame:
        """A table's current runs: the manifest prunes partitions."""
        return self.spark.read.parquet(f"{self.root}/{name}").join(now.select("source_id", "run"), ["source_id", "run"], "left_semi")

    # --- search ---

    def search(self, query: str, source_id: str | None = None, name: str | None = None, limit: int = 8, mode: str | None = None) -> DataFrame:
        """The best chunks with summary, content and code. A source that is named must be searchable; others are left out."""
        if not 1 <= limit <= 50:
            raise ValueError("limit must lie between 1 and 50")
        sources, now = self.sources(), self.current()
        own = K.usable(sources, self.embedder.provider, self.embedder.model, source_id, name)
        chunks = self._table("chunks", now)
        at: Column = F.array(*map(F.lit, self.embedder.embed([query])[0])) if S.query_tokens(query) else F.array(F.lit(0.0))
        vectors = chunks.select("chunk_id", "source_id", "embedding")
        found = S.search(chunks, self._table("postings", now), self._table("lengths", now), vectors, query, at, limit, mode or self.mode, own)
        out = self._shaped(found.withColumns({"query_id": F.lit(0), "query": F.lit(query)}), chunks, sources)
        return out.orderBy(F.desc("score"), F.desc("keyword_score"), F.desc("vector_score"), "chunk_id").drop("query_id", "chunk_id")

    def search_many(self, queries: DataFrame) -> DataFrame:
        """query_id, rank and what search gives, for all queries in one plan; queries: query_id, query, and mode, limit and source
        (a name or id; null for all), each null for the default. What isn't searchable is left out, as is a source that is unknown."""
        sources, now = self.sources(), self.current()
        usable = K.queryable(sources, self.embedder.provider, self.embedder.model).select("source_id", "name")
        alias = F.explode(F.array_distinct(F.array(F.lower("source_id"), F.lower("name")))).alias("_alias")
        asked = queries.select("query_id", "query", F.coalesce("mode", F.lit(self.mode)).alias("mode"), F.least(F.lit(50), F.greatest(F.lit(1), F.coalesce("limit", F.lit(8)))).alias("limit"), "source")
        ids = usable.select("source_id", alias)
        named = asked.withColumn("_alias", F.lower("source")).join(ids, "_alias", "left")
        named = named.groupBy("query_id", "query", "mode", "limit", "source").agg(F.collect_set("source_id").alias("ids"))
        named = named.withColumn("source_ids", F.when(F.col("source").isNotNull(), F.col("ids"))).drop("ids", "source")
        placed = embedded(named, "query", self.embedder).withColumnRenamed("embedding", "q").drop("embedding_provider", "embedding_model", "embedding_dimensions")
        chunks = self._table("chunks", now)
        vectors = chunks.select("chunk_id", "source_id", "embedding")
        found = S.search_many(chunks, self._table("postings", now), self._table("lengths", now), vectors, placed, sources=usable)
        return self._shaped(found.join(asked.select("query_id", "query"), "query_id"), chunks, sources)

    def _shaped(self, found: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
        """Found chunks (query_id, query, chunk_id, document_id and scores) as results."""
        # Documents of the results only: their chunks give the context.
        near = chunks.join(found.select("document_id").distinct(), "document_id", "left_semi")
        wide = S.context(near).join(near.drop("content", "embedding"), "chunk_id").withColumnRenamed("context", "content").join(found.drop("document_id"), "chunk_id")
        out = S.shaped(wide, F.col("query")).join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
        score = lambda c: F.bround(c, 6).alias(c)
        own = [c for c in ("query_id", "rank") if c in found.columns]
        return out.select(*own, "source_id", "source_name", "title", "uri", F.col("excerpt").alias("content"), "summary", "code", "section_path", score("score"), score("keyword_score"), score("vector_score"), "chunk_id")

    def set_mode(self, mode: str) -> None:
        """The default search mode, kept with the store; anything unknown is hybrid."""
        self.mode = mode if mode in MODES else "hybrid"
        self._say("settings", SETTING, mode=self.mode, updated_at=time.time())

    # --- evaluation ---

    def evaluate(self, path: str, live: bool = False) -> DataFrame:
        """One row: cases, passed, pass_rate and mrr of an evaluation set; cases without a query don't count.

        A set with documents of its own is indexed into a store beside this one and asked there, unless live.
        """
        return report(*self.evaluated(path, live), 50)

    def evaluated(self, path: str, live: bool = False) -> tuple[DataFrame, DataFrame]:
        """The cases (case_id, asked) and their results (case_id, rank, matches) up to each case's max_rank."""
        told = files.evaluation_set(self.spark, path)
        store = self if live or told.documents.isEmpty() else self._fixture(told)
        cases = told.cases.withColumn("asked", F.coalesce(F.trim("query") != "", F.lit(False)))
        found = store.search_many(cases.filter("asked").select(F.col("case_id").alias("query_id"), "query", "mode", "limit", "source"))
        e = F.col("expected")
        j = found.withColumnRenamed("query_id", "case_id").join(cases.select("case_id", "max_rank", "expected"), "case_id").filter(F.col("rank") <= F.col("max_rank"))
        hit = matches(haystack(j), [e["uri_contains"], e["title_contains"], e["content_contains"]], e["terms"])
        return cases.select("case_id", "asked"), j.select("case_id", "rank", hit.alias("matches"))

    def _fixture(self, told: files.EvaluationSet) -> Engine:
        """A store of a set's sources and documents; what is wrong with them is an error."""
        wrong = told.problems.orderBy("problem", "place").limit(20).collect()
        if wrong:
            raise ValueError("; ".join(f"{r.problem}: {r.place}" for r in wrong))
        store = Engine(self.spark, f"{self.root}/evaluations/{uuid.uuid4().hex}", self.embedder)
        for r in told.sources.select("key", "kind", "name", "version", "location").collect():  # written by hand: a few
            store._say("sources", SOURCE, source_id=r.key, kind=r.kind, name=r.name, version=r.version, location=r.location, status="registered", document_count=0, chunk_count=0, created_at=time.time(), updated_at=time.time())
            store.index_documents(r.key, told.documents.filter(F.col("key") == r.key))
        return store


def as_json(rows: DataFrame) -> list[dict]:
    """A few result rows for a caller outside Spark."""
    return [json.loads(r) for r in rows.toJSON().collect()]
