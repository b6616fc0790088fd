"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: knots (t, weight), linear in between. The schedule's
integral gives the source's share of the token budget; its running integral is the source's cumulative demand. A
document occurrence that begins after c words of its source is due when the demand reaches c, so its training position
is the inverse of the cumulative demand at c. Sorting by that position (a range sort) gives the training order.

A source is read in passes: within a pass its documents stand in a fixed pseudo-random order (md5 of doc_id). Where
the target ends inside a document, only that document's first words are taken, so that the words taken from a source
are its target without the fraction. The order within a source is found by two prefix sums: over buckets of the hash
within a source (at most 16 ** BUCKET_DIGITS rows a source), then inside one bucket. No task holds a whole source.

Nulls: a null text has size 0; a null source is a source of its own and sorts last; a null doc_id hashes as ''.
Empty tables give empty results. Repeated rows are separate documents. Sources of size 0 have the target 0.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import count_words

#: Hexadecimal digits of the hash that split a source into buckets.
BUCKET_DIGITS = 3
MAX_REPEATS = 2


def ranked_schedule(docs: DataFrame) -> DataFrame:
    """One row a source: its knots. By rank of the source the mean weights are 3, 1, 2, repeating: the first falls,
    the second is even, the third rises over the training."""
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3
    line = lambda a, b: F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in ((0, a), (1, b))))
    return docs.select("source").distinct().select("source", F.when(rank == 0, line(4, 2)).when(rank == 1, line(1, 1)).otherwise(line(1, 3)).alias("knots"))


def _areas(knots: Column) -> Column:
    """The running integral of a schedule, one value for each knot."""
    part = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: (F.get(knots, i)["t"] - F.get(knots, i - 1)["t"]) * (F.get(knots, i)["w"] + F.get(knots, i - 1)["w"]) / 2)
    return F.transform(F.sequence(F.lit(0), F.size(knots) - 1), lambda i: F.aggregate(F.slice(part, 1, i), F.lit(0.0), lambda a, x: a + x))


def _inverse(knots: Column, areas: Column, share: Column) -> Column:
    """The time at which a schedule's running integral reaches a share of its whole."""
    area = share * F.element_at(areas, -1)
    i = F.greatest(F.lit(0), F.least(F.size(F.filter(areas, lambda a: a <= area)) - 1, F.size(knots) - 2))
    t0, w0, t1, w1 = (F.get(knots, i + k)[x] for k in (0, 1) for x in ("t", "w"))
    rest, slope = area - F.get(areas, i), (w1 - w0) / (t1 - t0)
    root = w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest))
    return F.when(root > 0, t0 + 2 * rest / root).otherwise(t0)


def targets(sizes: DataFrame, schedule: DataFrame, share: float = 1.5, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, knots, areas, target: the budget (share of all sizes) by weight, none above max_repeats
    times its size, the excess reshared by weight. One row a source, so the windows hold no more than the schedule.

    In order of cap / weight, the level (what the sources before leave, over the weights from here on) rises as long as
    sources are full and falls afterwards, so the largest is the one at which the others share.
    """
    s = sizes.join(schedule.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    s = s.withColumn("areas", _areas(F.col("knots"))).withColumn("weight", F.element_at("areas", -1)).withColumn("cap", F.col("source_size") * max_repeats)
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything.orderBy(F.lit(1))) * share - before) / after)
    s = s.withColumn("level", F.max("level").over(everything.orderBy(F.lit(1))))
    return s.select("source", "source_size", "knots", "areas", F.least(F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def assign_positions(docs: DataFrame, schedule: DataFrame, share: float = 1.5, max_repeats: int = MAX_REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, occurrences: array of (position, words) in training order,
    and the columns of docs named in keep. Documents that the mix doesn't take have taken 0 and no occurrence."""
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    d = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("_key"), *keep)
    d = d.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)).withColumn("_source", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    buckets = d.groupBy("_source", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    sizes = buckets.groupBy("_source").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goals = targets(sizes.drop("_source"), schedule, share, max_repeats).withColumn("_source", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))).drop("source")
    earlier = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select("_source", "_bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_base")).join(goals, "_source")
    inside = W.partitionBy("_source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.join(buckets, ["_source", "_bucket"]).withColumn("_start", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    d = d.withColumn("_full", full).withColumn("_rest", F.floor(F.col("target") - F.col("_full") * F.col("source_size")))
    d = d.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start"))))
    words = lambda p: F.when(p < F.col("_full"), F.col("size")).when(p == F.col("_full"), F.col("_part")).otherwise(F.lit(0))
    due = lambda p: _inverse(F.col("knots"), F.col("areas"), (p * F.col("source_size") + F.col("_start")) / F.col("target"))
    times = F.transform(F.filter(F.sequence(F.lit(0), F.lit(max_repeats)), lambda p: words(p) > 0), lambda p: F.struct(due(p).alias("position"), words(p).alias("words")))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("_full") * F.col("size") + F.col("_part")).cast("long").alias("taken"), times.alias("occurrences"), *keep)


def training_order(assigned: DataFrame) -> DataFrame:
    """One row for each occurrence, range-sorted by training position; ties by source, then doc_id."""
    flat = assigned.select("*", F.explode("occurrences").alias("_o")).select(*[c for c in assigned.columns if c != "occurrences"], "_o.position", F.col("_o.words").alias("take_words"))
    return flat.orderBy("position", F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def mixed_documents(docs: DataFrame, schedule: DataFrame, share: float = 1.5, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix with all their columns, once for each occurrence, in training order.

    An occurrence of which the mix takes less than half the words is left out; any other stays whole.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    clear = docs.select(*[F.col(c).alias(f"_in_{c}") if c in keep else F.col(c) for c in docs.columns], "text" if "text" in keep else F.lit(None).alias("text"))
    order = training_order(assign_positions(clear, schedule, share, max_repeats, tuple(f"_in_{c}" for c in keep)))
    return order.filter(2 * F.col("take_words") >= F.col("size")).select(*[F.col(f"_in_{c}").alias(c) if c in keep else F.col(c) for c in docs.columns])


def written_order(docs: DataFrame, names: tuple[str, str] = ("part", "row")) -> DataFrame:
    """docs read from Parquet files that hold them in an order, with two more columns to sort by: the file's name (Spark numbers
    the files of a range sort in its order) and the row's number within. Null and 0 for what isn't read from files."""
    try:
        return docs.select("*", F.col("_metadata.file_name").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))
    except AnalysisException:  # no files
        return docs.select("*", F.lit(None).cast("string").alias(names[0]), F.lit(0).cast("long").alias(names[1]))
