"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that can be reached) for every node of the links (a, b); nodes of any orderable type.

    Large-star and small-star steps in turn: every node hooks its larger neighbours, then its smaller ones, to the least
    node it knows, until nothing changes. Each edge list is written, so that a lost executor costs one step at most;
    all sums and minima are pre-aggregated, so a node with a third of all links is no bottleneck.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    known = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = written(both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(large.join(down, "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct())
        before, known = known, _state(edges)
        if before == known:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and hash sums of the edges: the same if they are the same."""
    half = lambda seed: F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), half(1), half(2)).first())
