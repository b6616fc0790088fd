"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame operations only.

A text's paragraphs are what lies between line breaks and behind the punctuation that ends a clause. Each is hashed to a
wide vector, and a document's vector is the sum of its paragraphs' vectors, lane by lane, modulo a power of two. So
the order of paragraphs does not matter, equal multisets have equal vectors, and paragraphs (or documents) can be added or
taken away later (added, removed) without the text. A vector has EXACT lanes of 32 bits each from independent hashes
(256 bits, for equality), the number of paragraphs, and SKETCH lanes, each of three counters modulo 2 ** 21: how many
paragraphs have a certain hash bit set. Twice a counter less the number of paragraphs is a sum of random signs, so
the cosine of two sketches estimates the share of common paragraphs; cut to 0..1 it is the likeness. With 63 * SKETCHES
counters the standard error for unlike texts is 1 / sqrt(63 * SKETCHES), 0.089.

Null texts count as empty: no paragraph, a vector of zeros; two empty texts are alike (1), an empty and another not (0).
A fingerprint is the whole vector as a string, so likenesses follow from fingerprints alone.
doc_ids are integers. Documents follow each other by descending doc_id, null last. Rows that share a doc_id have the same next document:
of the next id's rows that with the least hash of its text. Every row gives a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARAGRAPH_END = r"(?<=[.!?,;:])\s+|[\r\n]+"
SEEDS = 4  # 64-bit hashes of a paragraph; each gives two exact lanes
SKETCHES = 2  # of those hashes, so many give 21 lanes of three counters
_BITS = 21
_ONES = 1 | 1 << _BITS | 1 << 2 * _BITS
_LOW, _TOP, _FIELD = (1 << 32) - 1, (1 << 63) - 1, (1 << _BITS) - 1
EXACT = 2 * SEEDS
SKETCH = SKETCHES * _BITS
#: A sketch whose counters are no more than this travels as bytes.
NARROW = 127
#: Doc ids are dealt by so many quantiles to find neighbours.
RANGES = 256


def _total(values: Column, term, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (_sum(a, term(x)) if mask == _TOP else a + term(x)).bitwiseAND(F.lit(mask)))


def _sum(a: Column, b: Column) -> Column:
    """Modulo 2 ** 63 under the mask _TOP; no step leaves a long, nor can the optimizer reorder it."""
    return a - (F.lit(_TOP) - b) - 1


def vector(text: Column) -> Column:
    """array<long>: EXACT lanes, the number of paragraphs, SKETCH lanes."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: p != "")
    return F.transform(F.array(paragraphs), _vector)[0]


def _vector(paragraphs: Column) -> Column:
    # The number comes first: it is the seed of the paragraph's hash, so that paragraphs that collide in one lane don't in the others.
    seeded = lambda k: F.transform(paragraphs, lambda p: F.xxhash64(F.lit(k), p))
    hashes = F.array(*map(seeded, range(SEEDS)))
    return F.transform(F.array(hashes), _lanes)[0]


def _lanes(hashes: Column) -> Column:
    exact = [_total(F.get(hashes, F.lit(k)), f, _LOW) for k in range(SEEDS) for f in (lambda x: x.bitwiseAND(F.lit(_LOW)), lambda x: F.shiftrightunsigned(x, 32))]
    sketch = [_total(F.get(hashes, F.lit(k)), lambda x, j=j: F.shiftright(x, j).bitwiseAND(F.lit(_ONES)), _TOP) for k in range(SKETCHES) for j in range(_BITS)]
    return F.array(*exact, F.size(F.get(hashes, F.lit(0))).cast("long"), *sketch)


def _combined(a: Column, b: Column, sign: int) -> Column:
    mask = lambda i: F.when(i < EXACT, F.lit(_LOW)).otherwise(F.lit(_TOP))
    both = F.zip_with(a, b, _sum if sign > 0 else lambda x, y: x - y)
    return F.transform(both, lambda x, i: x.bitwiseAND(mask(i)))


def added(a: Column, b: Column) -> Column:
    """The vector of both multisets of paragraphs together."""
    return _combined(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """The vector without the paragraphs of the second."""
    return _combined(a, b, -1)


def digest(v: Column) -> Column:
    """The whole vector as a string: the exact lanes, the number of paragraphs, the sketch lanes; vector_of gives it back."""
    hexed = lambda a, n: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat_ws("-", hexed(F.slice(v, 1, EXACT), 8), F.get(v, F.lit(EXACT)).cast("string"), hexed(F.slice(v, EXACT + 2, SKETCH), 16))


def vector_of(fingerprint: Column) -> Column:
    """The vector of a digest, for likeness, added and removed."""
    parts = F.split(fingerprint, "-")
    lanes = lambda part, n, count: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.conv(F.substring(part, i * n + 1, F.lit(n)), 16, 10).cast("long"))
    return F.concat(lanes(F.get(parts, F.lit(0)), 8, EXACT), F.array(F.get(parts, F.lit(1)).cast("long")), lanes(F.get(parts, F.lit(2)), 16, SKETCH))


def _counters(v: Column) -> Column:
    lanes = F.slice(v, F.size(v) - SKETCH + 1, F.lit(SKETCH))
    field = lambda f: F.transform(lanes, lambda x: F.shiftright(x, f * _BITS).bitwiseAND(F.lit(_FIELD)))
    return F.concat(*map(field, range(3)))


def signs(v: Column) -> Column:
    """The sums of signs behind a vector's sketch, or behind the sketch alone."""
    n = F.get(v, F.size(v) - SKETCH - 1)
    return F.transform(_counters(v), lambda c: (2 * c - n).cast("double"))


def sketch_of(v: Column) -> Column:
    """The number of paragraphs and the SKETCH lanes, which likeness needs."""
    return F.slice(v, F.size(v) - SKETCH, F.lit(SKETCH + 1))


def packed(v: Column, whole: bool) -> Column:
    """A vector, or if not whole its sketch, in fewer bytes for a shuffle; unpacked gives it back exactly."""
    n = F.get(v, F.lit(EXACT))
    exact = F.transform(F.slice(v, 1, EXACT), lambda x: (x - (1 << 31)).cast("int")) if whole else F.lit(None).cast("array<int>")
    narrow = F.when(n <= NARROW, F.transform(_counters(v), lambda c: c.cast("byte")))
    wide = F.when(n > NARROW, F.slice(v, EXACT + 2, SKETCH))
    return F.struct(exact.alias("exact"), n.alias("n"), narrow.alias("narrow"), wide.alias("wide"))


def unpacked(p: str, whole: bool) -> Column:
    """The vector or sketch of a packed column."""
    field = lambda i, f: F.shiftleft(F.get(F.col(f"{p}.narrow"), i + f * SKETCH).cast("long"), f * _BITS)
    lanes = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda i: field(i, 0) + field(i, 1) + field(i, 2))
    exact = F.transform(f"{p}.exact", lambda x: x.cast("long") + (1 << 31))
    sketch = F.array(F.col(f"{p}.n")), F.when(F.col(f"{p}.n") <= NARROW, lanes).otherwise(F.col(f"{p}.wide"))
    return F.concat(*([exact] if whole else []), *sketch)


def likeness(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(signs(a), signs(a)) * dot(signs(b), signs(b)))
    share = F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(signs(a), signs(b)) / norm))).otherwise(F.lit(0.0))
    return F.when(sketch_of(a) == sketch_of(b), F.lit(1.0)).otherwise(share)


def neighbours(docs: DataFrame) -> DataFrame:
    """key, next (by descending doc_id, round from the last to the first), need: half the longest text of that id.

    Ids are dealt into ranges by approximate quantiles; only ids and lengths move, and no task has more than a range.
    """
    ids = docs.groupBy("key").agg((F.max("n_chars") / 2).cast("long").alias("need"))
    cuts = docs.agg(F.percentile_approx("key.i", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    ids = ids.withColumn("range", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col("key.i"))) if cuts else F.lit(0))
    ids = ids.withColumn("range", F.when(F.col("key.known"), F.col("range")).otherwise(F.lit(-1)))
    tops = ids.groupBy("range").agg(F.max("key").alias("top"))  # RANGES + 1 rows at most
    down = W.orderBy(F.desc("range"))
    tops = tops.select("range", F.coalesce(F.lead("top").over(down), F.first("top").over(down)).alias("then"))
    following = F.lead("key").over(W.partitionBy("range").orderBy(F.desc("key")))
    return ids.withColumn("next", following).join(F.broadcast(tops), "range").select("key", F.coalesce("next", "then").alias("next"), "need")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, vector, edited_vector, next_sketch for each row of docs.

    Texts move twice: once to learn from whom they get and to whom they give a prefix, then the part that stays (half)
    and the prefix given (no more than is needed) meet.
    """
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("i"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key")).withColumn("n_chars", F.char_length("text").cast("long"))
    gives = neighbours(d).select(F.col("next").alias("key"), F.col("key").alias("to"), "need")
    met = d.join(gives, "key").withColumn("vector", vector(F.col("text")))
    half = F.expr("n_chars div 2")
    stays = F.struct(F.lit(1).alias("role"), F.col("key").alias("at"), F.lit(0).cast("long").alias("tie"), F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))").alias("part"), packed(F.col("vector"), True).alias("vector"))
    given = F.struct(F.lit(0).alias("role"), F.col("to").alias("at"), F.xxhash64("text").alias("tie"), F.expr("substring(text, 1, cast(need as int))").alias("part"), packed(F.col("vector"), False).alias("vector"))
    both = met.select("doc_id", "n_chars", F.explode(F.array(stays, given)).alias("x")).select("doc_id", "n_chars", "x.*")
    first = W.partitionBy("at").orderBy("role", "tie").rowsBetween(W.unboundedPreceding, 0)
    own = both.withColumn("got", F.first(F.struct("part", "vector")).over(first)).filter(F.col("role") == 1)
    own = own.withColumn("edited", F.concat("part", F.substring("got.part", F.lit(1), half.cast("int"))))
    return own.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), unpacked("vector", True).alias("vector"), vector(F.col("edited")).alias("edited_vector"), unpacked("got.vector", False).alias("next_sketch"))
