"""Centroid clustering of integer vectors with a pivot table (LAESA).

Vectors of `dims` finite components are quantised, x to floor(SCALE * x), and written once with their distances to PIVOTS
fixed pivots. In a round each centroid's distances to the same pivots are computed; by the triangle inequality the largest
difference of pivot distances bounds a vector's distance to a centroid from below. The centroid with the least bound is
measured first; the others only if their bound doesn't exceed what it gave. Measured distances are exact integers, and
bounds leave room for the rounding of square roots, so pruning never changes a result.

A round reads the pivot table and sends, for each task, one row for each cluster and component: sums are exact decimals, and
only k centroids come to the driver. Nothing else is kept between rounds, so lineage doesn't grow, and a lost executor costs
its own tasks of one round.

Vectors that are null, of another length, or hold null or non-finite components take no part. Every row of the others counts,
repeated ones too; a null vec_id can't be drawn as a first centroid before any other. Components beyond 64 bits stay at the
limit, and so do distances and their sums. An empty table has an empty result, fewer vectors than k give as many centroids.
Only the columns vec_id and embedding are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import in_small_batches, written

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
PIVOTS = 16
_LIMIT = 2**63 - 1


def quantised(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, q (array of long) of the rows that take part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & F.forall("embedding", number))
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows x to the rows of c, one to one; Python integers where 64 bits could overflow."""
    most = max(abs(int(v)) for a in (x, c) for v in (a.min(initial=0), a.max(initial=0)))
    if most and 4 * most * most * max(x.shape[1], 1) > _LIMIT:
        return ((x.astype(object) - c.astype(object)) ** 2).sum(1)
    return ((x - c) ** 2).sum(1)


def roots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to each pivot, as doubles."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots.astype(float)):
        d = x.astype(float) - p
        out[:, j] = np.sqrt((d * d).sum(1))
    return out


def nearest(x: np.ndarray, far: np.ndarray, centres: np.ndarray, centre_far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), its exact squared distance, and how many distances were measured.

    far and centre_far: distances of rows and centroids to the pivots.
    """
    n, k = len(x), len(centres)
    bound = np.zeros((n, k))
    for j in range(far.shape[1]):
        np.maximum(bound, np.abs(far[:, j, None] - centre_far[None, :, j]), out=bound)
    bound -= 1e-6 + 1e-9 * (far.max(1, initial=0)[:, None] + centre_far.max(1, initial=0)[None, :])
    first = bound.argmin(1)
    best, cluster, measured = squares(x, centres[first]), first.copy(), n
    upper = np.sqrt(best.astype(float)) * (1 + 1e-9) + 1e-6
    for c in range(k):
        left = np.flatnonzero((bound[:, c] <= upper) & (first != c))
        if len(left):
            d = squares(x[left], centres[[c]])
            measured += len(left)
            better = (d < best[left]) | ((d == best[left]) & (c < cluster[left]))
            at = left[better]
            best[at], cluster[at] = d[better], c
            upper[at] = np.sqrt(best[at].astype(float)) * (1 + 1e-9) + 1e-6
    return cluster, best, measured


def _ints(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def pivot_table(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """vec_id, v (packed long), far (packed double) of quantised rows."""
    kind = dict(rows.dtypes)["vec_id"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column(1)
            x = q.values.slice(q.offsets[0].as_py() if len(q) else 0, len(q) * dims).to_numpy().reshape(-1, dims)
            far = roots(x, pivots)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary()), pa.array([r.tobytes() for r in far.astype("<f8")], pa.binary())], ["vec_id", "v", "far"])

    return rows.mapInArrow(apply, f"vec_id {kind}, v binary, far binary")


def assigned(table: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, measured (a row's mean number of distances in its batch) of a pivot table's rows."""
    kind, dims, centre_far = dict(table.dtypes)["vec_id"], centres.shape[1], roots(centres, pivots)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            far = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f8").reshape(len(b), -1)
            cluster, d, measured = nearest(_ints(b.column(1), dims), far, centres, centre_far)
            d = pa.array([min(int(v), _LIMIT) for v in d], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), d, pa.array(np.full(len(b), measured / len(b)))], ["vec_id", "cluster", "distance", "measured"])

    return table.select("vec_id", "v", "far").mapInArrow(apply, f"vec_id {kind}, cluster int, distance long, measured double")


def moved(table: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means of what is nearest to them; those of nothing stay."""
    dims, centre_far = centres.shape[1], roots(centres, pivots)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centres.shape, object), np.zeros(len(centres), np.int64)
        for b in batches:
            if not len(b):
                continue
            x, far = _ints(b.column(0), dims), np.frombuffer(b"".join(b.column(1).to_pylist()), "<f8").reshape(len(b), -1)
            cluster = nearest(x, far, centres, centre_far)[0]
            small = len(x) * max(abs(int(x.min())), abs(int(x.max()))) <= _LIMIT
            for c in np.unique(cluster):
                own = x[cluster == c]
                sums[c] += (own if small else own.astype(object)).sum(0).astype(object)
                counts[c] += len(own)
        c, i = np.nonzero(np.broadcast_to(counts[:, None] > 0, centres.shape))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(counts[c]), pa.array([Decimal(int(v)) for v in sums[c, i]], pa.decimal128(38, 0))], ["c", "i", "n", "total"])

    parts = table.select("v", "far").mapInArrow(apply, "c int, i int, n long, total decimal(38,0)")
    out = centres.copy()
    for r in parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row a centroid and component
        out[r.c, r.i] = int(r.total) // r.n
    return out


def first_centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least sha256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    drawn = rows.select(key.alias("key"), "q").orderBy(F.col("key").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r.q for r in drawn], np.int64)


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = 3, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    rows = quantised(in_small_batches(embeddings), dims)
    centres = first_centres(rows, k, seed)
    kind = dict(embeddings.dtypes)["vec_id"]
    if not len(centres):
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    fixed = np.array([r.q for r in rows.select("q").distinct().orderBy(F.xxhash64("q"), "q").limit(pivots).collect()], np.int64)
    table = written(pivot_table(rows, fixed, dims))
    for _ in range(rounds):
        centres = moved(table, centres, fixed)
    out = written(assigned(table, centres, fixed).drop("measured"))
    limit = lambda c: F.least(c, F.lit(Decimal(_LIMIT))).cast("long")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # a row a centroid
    whole = sum((r.s for r in sums), Decimal(0))
    told = [(r.cluster, ",".join(map(str, centres[r.cluster].tolist())), r.s, whole) for r in sums]
    names = embeddings.sparkSession.createDataFrame(told, "cluster int, text string, s decimal(38,0), whole decimal(38,0)")
    named = names.select("cluster", limit(F.col("s")).alias("cluster_inertia"), limit(F.col("whole")).alias("inertia"), F.sha2(F.col("text").cast("binary"), 256).alias("centroid_sha256"))
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
