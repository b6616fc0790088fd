"""Markdown that refers to files: directives are joined with a table of files (path, content) and replaced."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
INCLUDE = r"\{\*\s+([^\s*]+)([^*]*)\*\}"
EXAMPLE = r"<(?:ExampleTabs|ExampleCode|ExamplePreview)\s+name=\"([^\"]+)\"\s*/>"
EXAMPLE_SUFFIXES = ["tsx", "jsx", "ts", "js", "py"]


def line_numbers(options: str) -> list[int]:
    """The lines that hl[a:b, c] names, each once, in its order."""
    found = re.search(r"hl\[([^\]]+)\]", options)
    out: list[int] = []
    for part in re.split(r"[,\s]+", found[1].strip()) if found else []:
        a, colon, b = part.partition(":")
        if re.fullmatch(r"-?\d+", a) and (not colon or re.fullmatch(r"-?\d+", b)):
            out += range(int(a), int(b or a) + 1)
    return list(dict.fromkeys(out))


def selected(text: str, options: str) -> str:
    rows, wanted = text.splitlines(), line_numbers(options)
    return "\n".join(rows[n - 1] for n in wanted if 1 <= n <= len(rows)) or text


@F.arrow_udf(StringType())
def _resolved(uri: pa.Array, target: pa.Array) -> pa.Array:
    return pa.array([posixpath.normpath(posixpath.join(posixpath.dirname(u), t)) for u, t in zip(uri.to_pylist(), target.to_pylist(), strict=True)], pa.string())


def included(documents: DataFrame, root: str) -> DataFrame:
    """uri, name, path of the includes in documents (uri, content) that lead into root or beside it."""
    near = posixpath.dirname(root.rstrip("/")).rstrip("/") + "/"
    asked = documents.select("uri", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(INCLUDE), F.lit(1)))).alias("name"))
    return asked.withColumn("path", _resolved("uri", "name")).filter(F.startswith("path", F.lit(near)))


def exampled(documents: DataFrame) -> DataFrame:
    """uri, name, stem of the examples in documents: the file names, without suffix, that stand for each."""
    asked = documents.select("uri", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(EXAMPLE), F.lit(1)))).alias("name"))
    return asked.select("uri", "name", F.explode(F.array_distinct(F.array(F.element_at(F.split("name", "/"), -1), F.regexp_replace("name", r"[/\\]", "-")))).alias("stem"))


def examples_among(files: DataFrame, root: str) -> DataFrame:
    """The files (path) below root that may be examples, with stem."""
    own = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(EXAMPLE_SUFFIXES) & F.startswith("path", F.lit(root.rstrip("/") + "/"))
    return files.filter(own).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def expanded(documents: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """documents (uri, content) with includes and examples below root replaced by fenced files; others stay, or their names.

    An include is a path from its document's folder, and must lie in root or beside it. An example is the file of its
    name (or of the name with - for /) with the shortest path, then the first.
    """
    found = included(documents, root).join(files, "path").select("uri", "name", "path", F.col("content").alias("file"), F.lit(False).alias("example"))
    order = W.partitionBy("uri", "name").orderBy(F.size(F.split("path", "/")), "path")
    examples = exampled(documents).join(examples_among(files, root), "stem").withColumn("r", F.row_number().over(order)).filter("r = 1").select("uri", "name", "path", F.col("content").alias("file"), F.lit(True).alias("example"))
    parts = found.union(examples).groupBy("uri").agg(F.collect_list(F.struct("name", "path", "file", "example")).alias("_parts"))
    joined = documents.join(parts, "uri", "left")
    others = [c for c in documents.columns if c != "content"]
    kinds = dict(documents.dtypes)

    def one(text: str | None, parts: list[dict]) -> str | None:
        if text is None:
            return None
        fence = lambda p, body: f"```{p['path'].rpartition('.')[2].lower()}\n{body.rstrip()}\n```"
        known = {(p["name"], p["example"]): p for p in parts}
        include = lambda m: fence(p, selected(p["file"], m[2])) if (p := known.get((m[1], False))) else m[0]
        example = lambda m: f"Example: {m[1]}" + (f"\n\n{fence(p, p['file'])}" if (p := known.get((m[1], True))) else "")
        return re.sub(EXAMPLE, example, re.sub(INCLUDE, include, text))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [one(t, p or []) for t, p in zip(b.column("content").to_pylist(), b.column("_parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(texts, pa.string())], [*others, "content"])

    out = joined.select(*others, "content", "_parts").mapInArrow(apply, "".join(f"`{c}` {kinds[c]}, " for c in others) + "content string")
    return out.select(*documents.columns)
