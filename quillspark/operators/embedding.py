"""Embedders: functions from texts to vectors, applied to Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import TOKEN

DIMENSIONS = 256
_token = re.compile(TOKEN)


def hashed(text: str) -> list[float]:
    """Signed feature hashing of tokens by 8-byte BLAKE2b: the last byte is the dimension, bit 8 the sign; unit length."""
    v = [0.0] * DIMENSIONS
    for t in _token.findall(text or ""):
        h = int.from_bytes(hashlib.blake2b(t.lower().encode(), digest_size=8).digest(), "big")
        v[h % DIMENSIONS] += 1.0 if h >> 8 & 1 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [round(x / norm, 6) for x in v] if norm else v


@dataclass(frozen=True)
class Embedder:
    """provider and model say which vectors are comparable; embed turns a batch of texts into as many vectors."""

    provider: str = "local"
    model: str = "hash-256"
    embed: Callable[[list[str]], list[list[float]]] = lambda texts: [hashed(t) for t in texts]
    batch_size: int = 32

    def __post_init__(self) -> None:
        object.__setattr__(self, "batch_size", min(256, max(1, int(self.batch_size))))


# A fixed pattern: what counts as a number in a vector written as JSON.
NUMBER = r"^\s*(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|-?Infinity|NaN|true|false)\s*$"


def parsed_vector(text: Column) -> Column:
    """A JSON list of numbers as array<float>; null for an empty one and for anything else. Truth values count as 1 and 0."""
    items = F.split(F.regexp_extract(text, r"(?s)^\s*\[(.*)\]\s*$", 1), ",")
    number = lambda x: F.when(F.trim(x, F.lit(" \t\r\n")).isin("true", "false"), F.trim(x, F.lit(" \t\r\n")).cast("boolean").cast("float")).otherwise(F.trim(x, F.lit(" \t\r\n")).cast("float"))
    return F.when(F.forall(items, lambda x: x.rlike(NUMBER)), F.transform(items, number))


def embedded(rows: DataFrame, column: str, embedder: Embedder | None = None) -> DataFrame:
    """rows with embedding, embedding_provider, embedding_model, embedding_dimensions of a text column; other columns stay."""
    e = embedder or Embedder()
    names = rows.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, e.batch_size):
                part = b.slice(a, e.batch_size)
                vectors = e.embed([t or "" for t in part.column(names.index(column)).to_pylist()])
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([e.provider] * n), pa.array([e.model] * n), pa.array([len(v) for v in vectors], pa.int32())], [*names, "embedding", "embedding_provider", "embedding_model", "embedding_dimensions"])

    return rows.mapInArrow(apply, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", embedding array<float>, embedding_provider string, embedding_model string, embedding_dimensions int")
