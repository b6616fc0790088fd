"""An index of vectors: cells around centres, each a partition, of which a query reads those that may hold one of its nearest.

A centre is one of the vectors; a vector belongs to the nearest. By the triangle inequality nothing in a cell is nearer to a query than the
distance to its centre less its radius. The cells around the query are read first; what their k-th vector leaves possible
decides on the others. Results are those of comparing everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import search as S

MOST_CELLS = 1_024
#: The cell of vectors that have another length than the centres, or other elements than numbers; it is always read.
OTHER = -1


@dataclass
class Cells:
    """rows: chunk_id, source_id, embedding, cell; centres, radii and sizes by cell."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def write(self, path: str) -> Cells:
        """Keeps each cell as a partition."""
        self.rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        return Cells(self.rows.sparkSession.read.parquet(path).select("chunk_id", "source_id", "embedding", "cell"), self.centres, self.radii, self.sizes)

    def needed(self, q: list[float], limit: int, source_ids: list[str] | None = None) -> list[int]:
        """The cells that a query has to read."""
        if len(self.centres) == 0 or len(q) != self.centres.shape[1]:
            return [OTHER]
        d = np.sqrt(((self.centres - np.asarray(q, float)) ** 2).sum(1))
        order = np.argsort(d)
        first = order[: int(np.searchsorted(np.cumsum(self.sizes[order]), limit)) + 1].tolist()
        held = S.vector_candidates(self.rows.filter(F.col("cell").isin([OTHER, *first])), F.array(*map(F.lit, q)), limit, source_ids)
        far = held.agg(F.when(F.count(F.lit(1)) == limit, F.max(F.when(~F.isnan("distance"), F.col("distance")))).alias("far")).first().far  # one number
        reach = np.inf if far is None else far
        return [OTHER, *np.flatnonzero(d - self.radii <= reach * (1 + 1e-9) + 1e-9).tolist()]


def celled(vectors: DataFrame, most: int = MOST_CELLS) -> Cells:
    """The cells of vectors (chunk_id, source_id, embedding); as many as the square root of their number, `most` at most."""
    common = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return Cells(vectors.select("chunk_id", "source_id", "embedding", F.lit(OTHER).alias("cell")), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    n = min(most, max(1, math.isqrt(common["count"])))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    drawn = vectors.filter((F.size("embedding") == common.dims) & F.forall("embedding", number)).select("embedding").orderBy(F.xxhash64("embedding"), "chunk_id").limit(n).collect()
    centres = np.array([r.embedding for r in drawn], float).reshape(-1, common.dims)
    if not len(centres):
        return Cells(vectors.select("chunk_id", "source_id", "embedding", F.lit(OTHER).alias("cell")), centres, np.zeros(0), np.zeros(0))
    kinds = dict(vectors.dtypes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = np.full(len(b), OTHER, np.int32), np.zeros(len(b))
            for i, v in enumerate(b.column(2).to_pylist()):
                if v is not None and len(v) == centres.shape[1] and None not in v:
                    d = ((centres - np.asarray(v, float)) ** 2).sum(1)
                    if np.isfinite(d.min()):  # one with other than numbers is no cell's
                        cell[i] = d.argmin()
                        far[i] = math.sqrt(d[cell[i]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], ["chunk_id", "source_id", "embedding", "cell", "far"])

    rows = vectors.select("chunk_id", "source_id", "embedding").mapInArrow(placed, f"chunk_id {kinds['chunk_id']}, source_id {kinds['source_id']}, embedding {kinds['embedding']}, cell int, far double")
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in rows.filter(F.col("cell") >= 0).groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        radii[r.cell], sizes[r.cell] = r.far, r.n
    return Cells(rows.drop("far"), centres, radii, sizes)


def nearest(cells: Cells, q: list[float], limit: int, source_ids: list[str] | None = None) -> DataFrame:
    """The nearest vectors with vector_score and vector_rank, as search.vector_candidates finds them among all."""
    read = cells.rows.filter(F.col("cell").isin(cells.needed(q, limit, source_ids))).drop("cell")
    return S.vector_candidates(read, F.array(*map(F.lit, q)), limit, source_ids)
