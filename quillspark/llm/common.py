"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that go to a Python worker, or come from it, at once; texts are long, and Spark's own bounds are wide.
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine has another where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session's Arrow batches are bounded from here on, since whole texts are in them."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.match(r"-?\d+", conf.get(key))[0])
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back: a task's worker lives on, idle, while other stages run beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, which gives its memory back when it ends."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return apply


#: Parquet's writer looks at sizes after 100 rows only; where rows have megabytes, it is to look at each.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Writes a frame as Parquet into the shared folder and reads it again.

    This cuts the lineage, and a lost executor costs no recomputation, since the files are in the store. large_rows: row groups of some
    16 MB, which is what a task holds in memory, whatever the number of rows in its file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {})).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """A column name like name that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def count_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap(hashes: DataFrame, bits: int = 1 << 23) -> bytes:
    """A bitmap of fixed size (a megabyte as it stands) of a frame's one column of 64-bit hashes.

    It thins out rows before an exact join: a row whose bit is unset has no partner. With many more hashes than bits
    nothing is thinned out, and nothing is lost.
    """
    import numpy as np

    h = F.col(hashes.columns[0]).bitwiseAND(F.lit(bits - 1))
    width = 1 << 15
    parts = hashes.groupBy(F.expr(f"({hashes.columns[0]} & {bits - 1}L) div {width}").alias("part")).agg(F.bitmap_construct_agg(h % width).alias("map")).collect()
    out = np.zeros((bits // width, width // 8), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.map, np.uint8)
    return out.tobytes()


def may_hold(map_: bytes, hashes):
    """Which of an array of 64-bit hashes have their bit set."""
    import numpy as np

    at = (hashes.astype(np.int64) & (len(map_) * 8 - 1)).astype(np.int64)
    return (np.frombuffer(map_, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
