"""Top-k keyword search over postings in blocks that say how much their chunks can score at most.

A block holds a term's postings in one bucket of chunks, with their BM25 weights and the largest of them. Chunks of about the same
length share buckets, since a weight falls with the length: so a block's largest weight is close to that of all its chunks. A
query adds up what its terms' blocks in a bucket give at most; the buckets that may give most are scored first, the k-th score
there is a threshold, and of the others only buckets that may reach it are read at all. Results are those of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import search as S

#: Chunks of a bucket, bands of lengths in which a length doubles.
CHUNKS_A_BUCKET, BANDS = 256, 16
#: Buckets that are named in a filter, which a scan can skip by; more are joined.
NAMED = 1_000
_SLACK = 1e-9


@dataclass
class Blocks:
    """rows: term, bucket, n, most, entries (chunk_id, source_id, weight); chunks: how many there are."""

    rows: DataFrame
    chunks: int

    def write(self, path: str) -> Blocks:
        """Keeps the blocks sorted by term and bucket, so that a query's filters skip row groups."""
        self.rows.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.mode("overwrite").parquet(path)
        return Blocks(self.rows.sparkSession.read.parquet(path), self.chunks)


def blocked(index: DataFrame, sizes: DataFrame) -> Blocks:
    """The blocks of an index of postings and lengths. A term's postings meet in the tasks of their buckets, never as a whole."""
    stats = sizes.agg(F.count(F.lit(1)).alias("chunks"), F.avg("length").alias("mean")).first()  # one row
    band = F.floor(F.log2(F.greatest(F.lit(1), F.col("length")).cast("double")) * BANDS)
    banded = sizes.select("chunk_id", "length", band.alias("band"))
    parts = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / CHUNKS_A_BUCKET).cast("long").alias("parts"))
    bucket = F.col("band") * (1 << 40) + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
    placed = banded.join(F.broadcast(parts), "band").select("chunk_id", "length", bucket.alias("bucket"))  # a row a band of lengths
    hits = index.groupBy("term", "chunk_id", "source_id").agg(F.sum(F.size("positions")).cast("long").alias("hits"))
    mean = stats["mean"] or 1.0
    weight = F.col("hits") * (S.K1 + 1) / (F.col("hits") + S.K1 * (1 - S.B + S.B * F.col("length") / mean))
    entry = F.struct("chunk_id", "source_id", weight.alias("weight"))
    rows = hits.join(placed, "chunk_id").groupBy("term", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("most"), F.sort_array(F.collect_list(entry)).alias("entries"))
    return Blocks(rows, stats["chunks"])


def _weighed(blocks: Blocks, terms: list[str]) -> DataFrame:
    """term, idf of the query's terms: a block says how many chunks it has, so nothing else is read for it."""
    df = blocks.rows.filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((F.lit(blocks.chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.select("term", F.when(idf <= 0, F.lit(S.LEAST_IDF)).otherwise(idf).alias("idf"))


def plan(blocks: Blocks, query: str, limit: int, source_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the buckets that are read first, the other buckets (bucket, bound) that may hold one of the best, and those that are not read."""
    phrases = S.query_phrases(query)
    if any(len(p) > 1 for p in phrases):
        raise ValueError("phrases of several terms need postings with positions")
    asked = [p[0] for p in phrases]
    terms = sorted(set(asked))
    own = blocks.rows.filter(F.col("term").isin(terms))
    times = F.create_map(*(F.lit(x) for t in terms or [""] for x in (t, asked.count(t))))
    idf = _weighed(blocks, terms).withColumn("idf", F.col("idf") * times[F.col("term")])
    bounds = own.select("term", "bucket", "most").join(F.broadcast(idf), "term").groupBy("bucket").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))

    def scored(buckets: DataFrame) -> DataFrame:
        named = [r.bucket for r in buckets.select("bucket").limit(NAMED + 1).collect()]
        read = own.filter(F.col("bucket").isin(named)) if len(named) <= NAMED else own.join(buckets, "bucket", "left_semi")
        one = read.join(F.broadcast(idf), "term").select("idf", F.explode("entries").alias("e")).select("e.chunk_id", "e.source_id", (F.col("idf") * F.col("e.weight")).alias("score"))
        return S.allowed(one, source_ids).groupBy("chunk_id", "source_id").agg(F.sum("score").alias("score"))

    first = bounds.orderBy(F.desc("bound"), "bucket").limit(max(1, -(-limit // 8)))
    best = scored(first)
    kth = best.orderBy(F.desc("score")).limit(limit).agg(F.when(F.count(F.lit(1)) == limit, F.min("score")).alias("kth")).first().kth  # one number
    rest = bounds.join(first.select("bucket"), "bucket", "left_anti")
    may = F.lit(True) if kth is None else F.col("bound") >= kth - _SLACK
    return best.union(scored(rest.filter(may))), rest.filter(may), rest.filter(~may)


def top(blocks: Blocks, query: str, limit: int, source_ids: list[str] | None = None) -> DataFrame:
    """chunk_id, source_id, bm25 of the best chunks for a query without phrases of several terms, as search.bm25 scores them."""
    scores = plan(blocks, query, limit, source_ids)[0]
    return scores.select("chunk_id", "source_id", F.round(-F.col("score"), S.DIGITS).alias("bm25")).orderBy("bm25", "chunk_id").limit(limit)
