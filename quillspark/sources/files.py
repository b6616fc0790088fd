"""Documents from folders, and evaluation sets from JSON."""

from __future__ import annotations

import contextlib
import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillspark.functions import text as T
from quillspark.operators.includes import EXAMPLE, INCLUDE, exampled, examples_among, expanded, included

_SCHEME = r"^[a-z][a-z0-9]*:/*(?=/)"

# Fixed values that results depend on.
SUFFIXES = ["md", "mdx", "txt", "rst", "html", "htm", "json", "yaml", "yml", "toml"]
SKIP_DIRS = [".cache", ".codex", ".git", ".hg", ".idea", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", ".vscode", "__pycache__", "build", "coverage", "dist", "node_modules", "out", "target", "venv"]


def wanted(path: Column) -> Column:
    """Whether a path has a suffix that is read and no folder that is skipped."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(SUFFIXES) & not_skipped(path)


def not_skipped(path: Column) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))


def normalized(text: Column, suffix: Column) -> Column:
    """Line ends as LF; Markdown without its front matter. HTML is left to sources.web."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(suffix.isin("md", "mdx"), T.without_front_matter(plain)).otherwise(plain)


def fallback_title(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    return F.coalesce(F.nullif(T.strip(T.capitalised(name)), F.lit("")), F.lit("Untitled"))


def suffix_of(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"\.([^./]+)$", 1))


def readable(files: DataFrame) -> DataFrame:
    """files (uri, content and more) with their texts as documents have them, in batches and streams alike: HTML as Markdown, anything
    else normalized. Only HTML goes through the parser."""
    from quillspark.sources.web import markdown

    suffix = suffix_of(F.col("uri"))
    html = F.coalesce(suffix.isin("html", "htm"), F.lit(False))
    read = lambda rows, text: rows.withColumn("content", T.compact(text))
    return read(files.filter(~html), normalized(F.col("content"), suffix)).unionByName(read(files.filter(html), markdown(F.col("content"))))


def plain_path(path: Column) -> Column:
    """A path without the scheme of its store."""
    return F.regexp_replace(path, _SCHEME, "")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """uri, content of the files below a folder (or of the file) that are read; bad bytes are replaced. A file is one row, so tasks follow
    file counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return decoded(files.select(plain_path(F.col("path")).alias("uri"), "content").filter(wanted(F.col("uri"))))


def decoded(files: DataFrame) -> DataFrame:
    import pyarrow as pa

    def apply(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode("utf-8", "replace") for c in b.column(1).to_pylist()], pa.string())], ["uri", "content"])

    return files.mapInArrow(apply, "uri string, content string")


def referenced(marked: DataFrame, root: str) -> DataFrame:
    """path, content of the files that Markdown documents below root refer to. Folders are listed for it, but only files that are meant are read."""
    spark = marked.sparkSession
    scheme = (re.match(_SCHEME, root) or [""])[0]
    own = re.sub(_SCHEME, "", root.rstrip("/"))

    def files_at(where: str) -> DataFrame | None:
        try:
            return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(scheme + where).withColumn("path", plain_path(F.col("path")))
        except AnalysisException:  # there is none
            return None

    asked: dict[str, list[str]] = {}
    for r in included(marked, own).filter(not_skipped(F.col("path"))).select("path").distinct().collect():  # paths, as the listing of a folder has them
        asked.setdefault(posixpath.dirname(r.path), []).append(re.sub(r"([\\{}\[\]*?,])", r"\\\1", posixpath.basename(r.path)))
    found = [rows for folder, names in sorted(asked.items()) if (rows := files_at(f"{folder}/{{{','.join(sorted(names))}}}"))]
    meant = [r.path for rows in found for r in rows.select("path").collect()]
    stems = exampled(marked).select("stem").distinct()
    if not stems.isEmpty() and (rows := files_at(own)):
        meant += [r.path for r in examples_among(rows.select("path").filter(not_skipped(F.col("path"))), own).join(stems, "stem", "left_semi").select("path").collect()]
    if not meant:
        return spark.createDataFrame([], "path string, content string")
    files = spark.read.format("binaryFile").load([scheme + p for p in sorted(set(meant))])
    return decoded(files.select(plain_path(F.col("path")).alias("uri"), "content")).withColumnRenamed("uri", "path")


def documents_of(files: DataFrame, source_id: str) -> DataFrame:
    """source_id, uri, title, content, content_hash of the files (uri, content, root) that aren't blank.

    Includes and examples of Markdown files are filled in from the files that they name, below or beside their root.
    """
    suffix = suffix_of(F.col("uri"))
    d = readable(files)
    is_marked = F.coalesce(suffix.isin("md", "mdx") & (F.col("content").rlike(INCLUDE) | F.col("content").rlike(EXAMPLE)), F.lit(False))
    out = d.filter(~is_marked).select("uri", "content")
    for r in d.filter(is_marked).select("root").distinct().collect():  # the folders that a source was given
        marked = d.filter(is_marked & F.col("root").eqNullSafe(F.lit(r.root))).select("uri", "content")
        filled = expanded(marked, referenced(marked, r.root), re.sub(_SCHEME, "", r.root.rstrip("/")))
        out = out.unionByName(filled.withColumn("content", T.compact(F.col("content"))))
    out = out.filter(F.col("content") != "")
    return out.select(F.lit(source_id).alias("source_id"), "uri", F.coalesce(T.title(F.col("content")), fallback_title(F.col("uri"))).alias("title"), "content", F.sha2("content", 256).alias("content_hash"))


def documents(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    """The documents of a folder's files."""
    return documents_of(scan(spark, root).withColumn("root", F.lit(root)), source_id)


# --- evaluation sets ---

_TEXTS = "string"  # a string or a list of strings
_DOCUMENT = "struct<uri: string, title: string, content: string, path: string, root: string, uri_root: string, source_id: string, source: string>"
_SOURCE = f"struct<id: string, kind: string, name: string, version: string, location: string, root: string, uri_root: string, documents: array<{_DOCUMENT}>>"
_CASE = f"struct<id: string, query: string, source: string, source_id: string, mode: string, `limit`: int, max_rank: int, expected: struct<uri_contains: {_TEXTS}, title_contains: {_TEXTS}, content_contains: {_TEXTS}, terms: {_TEXTS}>>"


@dataclass
class EvaluationSet:
    """cases: case_id, query, source, mode, limit, max_rank, expected; sources: key, kind, name, version, location;
    documents: key, uri, title, content; problems: problem, place. Sources and documents of a set without any are empty."""

    cases: DataFrame
    sources: DataFrame
    documents: DataFrame
    problems: DataFrame


def _listed(c: Column) -> Column:
    """A string or a list of strings as a list, null as null."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.when(c.isNotNull(), F.array(c)))


def _filled(*columns: str) -> Column:
    """The first of some columns that isn't blank."""
    return F.coalesce(*(F.nullif(T.strip(F.col(c)), F.lit("")) for c in columns))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, query, source, mode, limit, max_rank, expected of an evaluation set; sets without cases are an error."""
    rows = spark.read.schema(f"cases array<{_CASE}>").option("multiLine", True).json(path).select(F.explode("cases").alias("c"))
    if rows.isEmpty():
        raise ValueError(f"no cases in {path}")
    size = F.coalesce("c.limit", F.lit(8))
    wanted = F.struct(*(_listed(F.col(f"c.expected.{k}")).alias(k) for k in ("uri_contains", "title_contains", "content_contains", "terms")))
    return rows.select(F.coalesce("c.id", "c.query", F.lit("unnamed")).alias("case_id"), "c.query", _filled("c.source", "c.source_id").alias("source"), F.coalesce("c.mode", F.lit("hybrid")).alias("mode"), size.alias("limit"), F.coalesce("c.max_rank", size).alias("max_rank"), F.when(F.col("c.expected").isNotNull(), wanted).alias("expected"))


def aliases(sources: DataFrame) -> DataFrame:
    """alias, number, key: the names under which documents may refer to sources (number, id, name), `fixture` for one without any."""
    names = F.array_distinct(F.filter(F.array(_filled("id"), _filled("name")), lambda x: x.isNotNull()))
    own = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("fixture")))
    return sources.select(F.explode(own).alias("alias"), "number", "key")


def resolved(sources: DataFrame, loose: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (place, source_id, source and more) that stand beside sources (number, key, id, name) with the key of their own, and what
    is wrong with them (problem, place): an alias of several sources, a source that is unknown, none named where there are several."""
    known = aliases(sources)
    shared = known.groupBy("alias").agg(F.countDistinct("number").alias("n"), F.min("key").alias("key"))
    twice = shared.filter("n > 1").select(F.lit("duplicate source alias").alias("problem"), F.col("alias").alias("place"))
    only = sources.agg(F.when(F.count(F.lit(1)) == 1, F.first("key")).alias("only"))  # one row
    named = loose.withColumn("alias", _filled("source_id", "source")).join(shared.drop("n"), "alias", "left").crossJoin(F.broadcast(only))
    own = F.when(F.col("alias").isNull(), F.col("only")).otherwise(F.col("key"))
    problem = F.when(F.col("alias").isNull(), "names none of several sources").otherwise("unknown source")
    place = F.concat_ws(" ", "place", "alias")
    named = named.withColumn("key", own)
    return named.drop("alias", "only"), twice.union(named.filter(F.col("key").isNull()).select(problem, place))


def evaluation_set(spark: SparkSession, path: str, base: str | None = None) -> EvaluationSet:
    """A set with its own sources and documents. A document is given by uri, title and content, or by a path from the set's folder,
    else from base."""
    raw = spark.read.schema(f"source {_SOURCE}, sources array<{_SOURCE}>, documents array<{_DOCUMENT}>").option("multiLine", True).json(path)
    every = F.filter(F.coalesce("sources", F.array("source")), lambda s: s.isNotNull())
    sources = raw.select(F.posexplode(every).alias("number", "s")).select("number", "s.*")
    sources = sources.withColumn("key", F.coalesce(_filled("id"), _filled("name"), F.lit("fixture")))
    at = lambda where: F.concat(F.lit(where), (F.col("pos") + 1).cast("string"), F.lit("]"))
    inner = sources.select("key", F.col("root").alias("_root"), "location", F.col("uri_root").alias("_uri_root"), "number", F.posexplode("documents").alias("pos", "d"))
    inner = inner.select("key", "_root", "location", "_uri_root", F.concat(F.lit("sources["), (F.col("number") + 1).cast("string"), F.lit("]."), at("documents[")).alias("place"), "d.*")
    loose = raw.select(F.posexplode("documents").alias("pos", "d")).select(at("documents[").alias("place"), "d.*")
    placed, problems = resolved(sources, loose)
    more = sources.groupBy("key").agg(*(F.first(c).alias(n) for c, n in (("root", "_root"), ("location", "location"), ("uri_root", "_uri_root"))))
    both = inner.unionByName(placed.filter(F.col("key").isNotNull()).join(more, "key", "left"), allowMissingColumns=True)
    filed = _filled("path").isNotNull()
    whole = F.col("uri").isNotNull() & F.col("title").isNotNull() & F.col("content").isNotNull()
    problems = problems.union(both.filter(~filed & ~whole).select(F.lit("neither path nor uri, title and content"), "place"))
    if not both.isEmpty():
        problems = problems.union(sources.join(both.select("key").distinct(), "key", "left_anti").select(F.lit("source without documents"), "key"))
    given = both.filter(~filed & whole).select("key", "uri", "title", "content")
    read, absent = _read_documents(spark, both.filter(filed), path, base)
    known = sources.select("key", F.coalesce(_filled("kind"), F.lit("local")).alias("kind"), F.coalesce(_filled("name"), "key").alias("name"), F.coalesce(_filled("version"), F.lit("eval")).alias("version"), F.coalesce(_filled("location"), _filled("root"), F.lit("fixture")).alias("location")).dropDuplicates(["key"])
    return EvaluationSet(evaluation_cases(spark, path), known, given.union(read), problems.union(absent))


def _read_documents(spark: SparkSession, filed: DataFrame, path: str, base: str | None) -> tuple[DataFrame, DataFrame]:
    """The documents that a set gives by path, and the paths that lead nowhere. A set is written by hand: its paths are a few."""

    def found(name: str) -> str | None:
        for folder in [posixpath.dirname(path), *([base] if base else [])]:
            full = posixpath.normpath(posixpath.join(folder, name))
            with contextlib.suppress(AnalysisException):
                spark.read.format("binaryFile").load(full)
                return full
        return None

    read, absent = spark.createDataFrame([], "key string, uri string, title string, content string"), []
    for r in filed.collect():
        full = found(r.path)
        if full is None:
            absent.append(("no such file", f"{r.place} {r.path}"))
            continue
        root = found(r.root or r._root or r.location or "") or posixpath.dirname(full)
        own = documents_of(scan(spark, full).withColumn("root", F.lit(root)), r.key)
        front = r.uri_root or r._uri_root or r.location
        tail = posixpath.relpath(full, root) if full.startswith(root.rstrip("/") + "/") else posixpath.basename(full)
        read = read.union(own.select(F.lit(r.key), F.lit(posixpath.join(front, tail)) if front else F.col("uri"), "title", "content"))
    return read, spark.createDataFrame(absent, "problem string, place string")
