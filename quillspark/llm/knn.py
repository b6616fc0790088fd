"""Exact top-k search by a Voronoi join: the largest integer inner products for a stated set of queries.

Vectors are quantised, x to floor(SCALE * x). PIVOTS vectors are drawn by hash; each vector belongs to the cell of its
nearest pivot. A cell's summary is its number of vectors and their largest distance from the pivot. Each query is
first solved in its own cell; its k-th score there is one that its k-th neighbour reaches for sure. By Cauchy-Schwarz a query
q scores no more than <q, p> + |q| d with a vector at distance d from its pivot p. So a query goes on only to cells whose
largest distance lets a vector reach that score, and there it meets only vectors that are far enough from the pivot.

Queries are few and vectors many, so it is the queries that are copied: a vector is sent to its own cell, once for each of
the two rounds, whatever the number of cells. Large cells are dealt to blocks of some DATA_BLOCK vectors. Where bounds
can't prune (vectors without clusters), a query visits all cells: the work is that of comparing it with all vectors.

Of vectors with equal components only the k + 1 smallest ids can be among anyone's top k (ties go to the smaller id,
and one of them may be the query itself); the others are left out before anything is sent.

Null vectors, and vectors with null or non-finite components, take no part; nor do rows with a null vec_id. Repeated
equal rows count once. Shorter vectors count as ending in zeros. Scores beyond 64 bits stay at the limit. A query's
candidates are all rows but those with its own vec_id. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import in_small_batches, written

K = 10
SCALE = 1024
PIVOTS = 32
#: Vectors of a cell in one block.
DATA_BLOCK = 20_000
_LIMIT = 2**63 - 1


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q (array of long) of the rows that take part, each once."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", number))
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q")).distinct()


def matrix(rows, dims: int) -> np.ndarray:
    """Vectors (packed or lists) as rows of float64, or of Python integers where floats would not be exact."""
    rows = [np.frombuffer(r, "<i8") if isinstance(r, bytes) else np.asarray(r, np.int64) for r in rows]
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, int64 where they fit, else clipped."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    big = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if a.shape[1] * big(a) * big(b) < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -_LIMIT - 1, _LIMIT).astype(np.int64)


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and a bound on its distance."""
    x, p = x.astype(float), pivots.astype(float)
    cell = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(1)) * (1 + 1e-9)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(ids) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at].astype(float) if abs(scores[at]).max(initial=0) < 2**53 else -scores[at].astype(object)))][:k]


class Cells:
    """Pivots, and for each cell its number of vectors and their largest distance."""

    def __init__(self, pivots: np.ndarray, sizes: dict[int, tuple[int, float]]):
        self.pivots, self.ids = pivots, np.array(sorted(sizes), np.int64)
        self.counts = np.array([sizes[c][0] for c in self.ids.tolist()], np.int64)
        self.reach = np.array([sizes[c][1] for c in self.ids.tolist()])
        self.blocks = {c: -(-n // DATA_BLOCK) for c, (n, _) in sizes.items()}

    def needed(self, x: np.ndarray, least: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which query has to visit which cell besides its own, and from what distance on vectors can count there."""
        f = x.astype(float)
        near = f @ self.pivots[self.ids].T.astype(float)
        length = np.linalg.norm(f, axis=1)[:, None]
        slack = 1e-3 + 1e-6 * (np.abs(near) + length * self.reach)
        i, j = np.nonzero((near + length * self.reach + slack >= least[:, None]) & (self.ids != home[:, None]))
        with np.errstate(divide="ignore", invalid="ignore"):
            far = (least[:, None] - near - slack) / length
        return i, self.ids[j], np.nan_to_num(far[i, j], nan=-1.0, neginf=-1.0)


def _visits(asked: DataFrame, data: DataFrame, cells: Cells, k: int, dims: int) -> DataFrame:
    """query_id, v, vec_id, score: each query's k best in each block of the cell it visits (asked: query_id, v, cell, need)."""
    blocks = F.create_map(*(F.lit(int(x)) for c, n in cells.blocks.items() for x in (c, n)))
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))

    def solve(qs: pa.Table, ds: pa.Table) -> pa.Table:
        ids, x, far = ds.column("vec_id").to_numpy(), matrix(ds.column("v").to_pylist(), dims), ds.column("far").to_numpy()
        order = np.argsort(-far)
        ids, x, far = ids[order], x[order], far[order]
        ask, need, packed = qs.column("query_id").to_numpy(), qs.column("need").to_numpy(), qs.column("v").to_pylist()
        found: list[tuple[np.ndarray, ...]] = []
        turn = np.argsort(-need)
        for a in range(0, len(turn), 100):
            some = turn[a : a + 100]
            reach = int(np.searchsorted(-far, -need[some].min(), "right"))  # those beyond can't count for any of these
            scores = products(matrix([packed[q] for q in some], dims), x[:reach])
            for q, row in zip(some, scores, strict=True):
                other = np.flatnonzero(ids[:reach] != ask[q])
                top = other[best(ids[other], row[other], k)]
                found.append((np.full(len(top), q), ids[top], row[top]))
        of, vec, score = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else [[]] * 3))
        return pa.table({"query_id": pa.array(ask[of], pa.int64()), "v": qs.column("v").take(pa.array(of)), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})

    return sent.groupBy("cell", "block").cogroup(data.groupBy("cell", "block")).applyInArrow(solve, "query_id long, v binary, vec_id long, score long")


def plan(embeddings: DataFrame, every: int = 100, k: int = K, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The first round's results, what goes on to other cells (query_id, v, cell, need), and its results; None without vectors."""
    rows = written(quantised(in_small_batches(embeddings)))
    first = F.row_number().over(W.partitionBy("q").orderBy("vec_id"))
    kept = rows.withColumn("r", first).filter(F.col("r") <= k + 1).drop("r")
    dims, n = rows.agg(F.max(F.size("q")), F.count(F.lit(1))).first()
    if not n:
        return None
    dims = dims or 0
    centres = matrix([r.q for r in rows.select("q").distinct().orderBy(F.xxhash64("q"), "q").limit(pivots).collect()], dims)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1).to_pylist(), dims)
            cell, far = nearest(x, centres)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary()), pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "v", "cell", "far"])

    kind = "vec_id long, v binary, cell int, far double"
    data = written(kept.mapInArrow(placed, kind))
    summary = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row a pivot
    cells = Cells(centres, {r.cell: (r.n, r.far) for r in summary})
    blocks = F.create_map(*(F.lit(int(x)) for c, m in cells.blocks.items() for x in (c, m)))
    data = data.withColumn("block", F.pmod(F.hash("vec_id"), blocks[F.col("cell")]).cast("int"))
    asked = written(rows.filter(F.col("vec_id") % every == 0).mapInArrow(placed, kind).select(F.col("vec_id").alias("query_id"), "v", "cell", F.lit(-1.0).alias("need")))
    home = written(_visits(asked, data, cells, k, dims))
    order = W.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    kth = home.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("query_id", "v", F.col("score").alias("least"))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, least = matrix(b.column(1).to_pylist(), dims), b.column(3).to_numpy(zero_copy_only=False).astype(float)
            i, cell, far = cells.needed(x, np.where(np.isnan(least), -np.inf, least), b.column(2).to_numpy())
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell, pa.int32()), pa.array(far)], ["query_id", "v", "cell", "need"])

    more = written(asked.join(kth, ["query_id", "v"], "left").select("query_id", "v", "cell", "least").mapInArrow(onward, "query_id long, v binary, cell int, need double"))
    return home, more, _visits(more, data, cells, k, dims)


def search(embeddings: DataFrame, every: int = 100, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the top k of each row whose vec_id is divisible by every."""
    planned = plan(embeddings, every, k, pivots)
    if planned is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    return planned[0].union(planned[2]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
