"""Phrase collocations by an FM-index for each shard of the corpus.

A task cuts its documents into words and gathers them, for each language, into shards of some SHARD_WORDS words. A shard's
text is a run of word ids with a 0 between pieces. Its index is bidirectional: the Burrows-Wheeler transforms of the text
and of the reversed text, both of suffixes sorted by their first DEPTH words only, which is all that phrases of up to DEPTH
words can tell apart. A phrase is an interval of rows in either; extending it to the left by a word reads the words that
stand before its rows in one transform, and moves the interval in the other by the number of smaller words, and the same to
the right with the sides changed. All intervals of a level are extended together.

Shards are written once and enumerated level by level; counts are summed across shards. A phrase that stands `least`
times is made of phrases that do, so words below that extend nothing, and the pairs and triples that are left decide which
phrases of three and four words a shard enumerates at all. What shards are told of frequent words, pairs and triples is a bitmap of
BITS_A_KEY bits a key, of MAX_BITS at most: beyond that it thins out less, and counts stay exact, since all that is
enumerated is counted and compared with `least` once more. Words are known by 64-bit hashes with their language, and
longer phrases by two hashes, of the pairs and words they are made of; a seed is taken under which no two frequent words and no
two frequent pairs share one. Pairs are counted by their hash first, and those that may be frequent then by both words.

Case and cuts: A-Z count as a-z; pieces end at .,;:!? and the line breaks 0A to 0D, words at blanks and tabs. A null text is
empty, a null lang is `und`; repeated rows count each time; an empty table has no phrases. A text of any length is read
whole: its pieces go to as many shards as they fill, and only a single piece is never cut. Only the columns lang and text are
read, so other columns can't clash.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import bitmap, in_small_batches, may_hold, written
from quillspark.llm.shingles import mixed

DEPTH = 4
LEAST, PERCENT, TOP = 30, 80, 2_000
SCALE = 2_000_000
SHARD_WORDS = 1_500_000
BITS_A_KEY, MAX_BITS = 64, 1 << 26
#: Phrases in one Arrow batch, texts cut into words at once.
AT_ONCE, TEXTS_AT_ONCE = 200_000, 32

#: A-Z to a-z, ends of pieces to line feeds, tabs to blanks.
_CUTS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def trimmed() -> None:
    """Gives the memory that a shard took back to the system, where the C library can: workers live on between tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_prefix(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes' starts, sorted by their first DEPTH symbols; the text counts as a ring."""
    rank, width, bound = text, 1, symbols
    while width < DEPTH:
        key = rank.astype(np.int64)
        key *= bound
        key += np.roll(rank, -width)
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        steps = np.zeros(len(text), np.int32)
        np.cumsum(key[1:] != key[:-1], out=steps[1:])
        del key
        rank = np.empty(len(text), np.int32)
        rank[order] = steps
        bound, width = int(steps[-1]) + 1, width * 2
    return order


class Index:
    """A bidirectional index: rows of (symbol before it) in suffix order, of the text and of the reversed text."""

    def __init__(self, bwt: np.ndarray, reverse: np.ndarray, symbols: int):
        self.sides, self.symbols = (bwt, reverse), symbols
        self.steps: list[np.ndarray | None] = [None, None]
        self.counts = np.bincount(bwt, minlength=symbols)
        self.starts = np.cumsum(self.counts) - self.counts

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> Index:
        back = text[::-1]
        return cls(text[by_prefix(text, symbols) - 1], back[by_prefix(back, symbols) - 1], symbols)

    def words(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals (start, start in the reverse, rows) of some symbols."""
        return self.starts[which], self.starts[which], self.counts[which]

    def extend(self, intervals: tuple[np.ndarray, np.ndarray, np.ndarray], side: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """All extensions of disjoint intervals by a symbol, to the left (side 0) or right (1): which interval, the symbol, and its interval."""
        own, other, rows = intervals[side], intervals[1 - side], intervals[2]
        if self.steps[side] is None:  # a row's row with the symbol before it in front: C[c] + Occ(c, row)
            step = np.empty(len(self.sides[side]), np.int32)
            step[np.argsort(self.sides[side], kind="stable")] = np.arange(len(step), dtype=np.int32)
            self.steps[side] = step
        before = np.cumsum(rows) - rows
        at = np.arange(before[-1] + rows[-1] if len(rows) else 0, dtype=np.int32)
        at += np.repeat((own - before).astype(np.int32), rows)
        key = np.repeat(np.arange(len(rows)) * self.symbols, rows)
        key += self.sides[side][at]
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(first, append=len(key))
        of, symbol = np.divmod(key[first], self.symbols)
        new = (self.steps[side][at[order[first]]].astype(np.int64), other[of] + first - before[of])
        keep = symbol > 0
        out = (new[side][keep], new[1 - side][keep], n[keep])
        return of[keep], symbol[keep], out


def _chosen(intervals: tuple, keep: np.ndarray) -> tuple:
    return tuple(x[keep] for x in intervals)


class _Words(dict):
    """Ids of words; those of the end of a piece and of the empty string are 0 and -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self) - 1
        return i


def word_ids(texts: list[str | None], ids: _Words) -> np.ndarray:
    """The texts' words as ids with a 0 after each text, and at ends of pieces."""
    parts = b"\n".join((t or "").encode() for t in texts).translate(_CUTS).replace(b"\n", b" \n ").split(b" ")
    out = np.fromiter(map(ids.__getitem__, parts), np.int32, len(parts))
    out = np.append(out[out >= 0], np.int32(0))
    return out[np.concatenate([[True], (out[1:] > 0) | (out[:-1] > 0)])]


def shards_of(docs: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """lang, words (joined by blanks), counts, bwt, reverse: the indexed shards of the documents."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Words, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def closed(lang: str) -> pa.RecordBatch:
            ids, parts = open_.pop(lang)
            del sizes[lang]
            index = Index.of(np.concatenate([np.zeros(1, np.int32), *parts]), len(ids) - 1)
            words = b" ".join(w for w, i in ids.items() if i > 0).decode()
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (index.counts[1:].astype("<i8"), *(s.astype("<i4") for s in index.sides))]
            del index, parts, ids
            trimmed()
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words]), *blobs], ["lang", "words", "counts", "bwt", "reverse"])

        for b in batches:
            langs = np.array([x if x is not None else "und" for x in b.column(0).to_pylist()], object)
            texts = b.column(1)
            for lang in dict.fromkeys(langs):
                ids, parts = open_.setdefault(lang, (_Words(), []))
                own = np.flatnonzero(langs == lang)
                for lo in range(0, len(own), TEXTS_AT_ONCE):
                    parts.append(word_ids(texts.take(pa.array(own[lo : lo + TEXTS_AT_ONCE])).to_pylist(), ids))
                    sizes[lang] = sizes.get(lang, 0) + len(parts[-1])
            while sum(sizes.values()) >= most:
                yield closed(max(sizes, key=sizes.get))
        for lang in list(open_):
            yield closed(lang)

    return docs.select("lang", "text").mapInArrow(apply, "lang string, words string, counts binary, bwt binary, reverse binary")


def _hashes(lang: str, words: str, seed: int) -> np.ndarray:
    """A hash for each id of a shard; 0 for the end of a piece."""
    front = f"{lang} ".encode()
    return np.array([0, *(xxhash.xxh64_intdigest(front + w, seed) for w in words.encode().split(b" ") if w)], np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) + b).view(np.int64)


def _word_counts(shards: DataFrame) -> DataFrame:
    """lang, word, n of each shard."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words.split(" ") if words else []
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(np.frombuffer(counts, "<i8"))], ["lang", "word", "n"])

    return shards.select("lang", "words", "counts").mapInArrow(apply, "lang string, word string, n long")


def _keyed(words: DataFrame, seed: int) -> DataFrame:
    """The words with their hash h."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [xxhash.xxh64_intdigest(f"{lang} {w}".encode(), seed) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(h, np.uint64).view(np.int64))], [*b.schema.names, "h"])

    return words.select("lang", "word", "n").mapInArrow(apply, "lang string, word string, n long, h long")


def _told(keys: DataFrame) -> bytes:
    """The bitmap of a frame's keys, with as many bits as they need, up to MAX_BITS."""
    need = max(1 << 16, keys.count() * BITS_A_KEY)
    return bitmap(keys, min(MAX_BITS, 1 << (need - 1).bit_length()))


def _enumerated(shards: DataFrame, seed: int, words: bytes, pairs: bytes | None = None, triples: bytes | None = None) -> DataFrame:
    """x, y, n of all shards: the pairs of frequent words (x: the pair's hash, y null); where pairs are told that may be frequent, these
    (x and y: the words' hashes) and the triples made of them (x: the pair in front, y: the last word; level 3); where the frequent
    triples are, the phrases of four words (x and y: the pairs)."""

    def rows(index: Index, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        frequent = may_hold(words, h.view(np.int64))
        frequent[0] = False
        last = np.flatnonzero(frequent)
        of, first, state = index.extend(index.words(last), 0)
        last, keep = last[of], frequent[first]
        hashes = _pair(h[first], h[last])
        if pairs is None:
            yield 2, hashes[keep], None, state[2][keep]
            return
        keep &= may_hold(pairs, hashes)
        first, last, state = first[keep], last[keep], _chosen(state, keep)
        if triples is None:
            yield 2, h[first], h[last], state[2]
        of, third, state = index.extend(state, 1)
        first, mid = first[of], last[of]
        front, back = _pair(h[first], h[mid]), _pair(h[mid], h[third])
        keep = may_hold(pairs, back)
        if triples is None:
            yield 3, front[keep], h[third[keep]], state[2][keep]
            return
        keep &= may_hold(triples, _pair(front.view(np.uint64), h[third]))
        first, mid, back, state = first[keep], mid[keep], back[keep], _chosen(state, keep)
        of, outer, state = index.extend(state, 0)
        front = _pair(h[outer], h[first[of]])
        keep = may_hold(pairs, front) & may_hold(triples, _pair(front.view(np.uint64), h[mid[of]]))
        yield 4, front[keep], back[of[keep]], state[2][keep]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, own, bwt, reverse in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = _hashes(lang, own, seed)
                for level, x, y, n in rows(Index(np.frombuffer(bwt, "<i4"), np.frombuffer(reverse, "<i4"), len(h)), h):
                    trimmed()
                    for lo in range(0, len(n), AT_ONCE):
                        some = [v if v is None else pa.array(v[lo : lo + AT_ONCE].view(np.int64)) for v in (x, y, n)]
                        size = len(some[0])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, level, np.int32)), some[0], pa.nulls(size, pa.int64()) if some[1] is None else some[1], some[2]], ["level", "x", "y", "n"])

    found = shards.select("lang", "words", "bwt", "reverse").mapInArrow(apply, "level int, x long, y long, n long")
    keys = ["x"] if pairs is None else ["level", "x", "y"]
    return found.groupBy(*keys).agg(F.sum("n").alias("n"))


def _paired(rows: DataFrame) -> DataFrame:
    """Rows (x, y, n) with h, the hash of the pair."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_pair(*(b.column(i).to_numpy().view(np.uint64) for i in (0, 1))))], ["x", "y", "n", "h"])

    return rows.mapInArrow(apply, "x long, y long, n long, h long")


def _unique(rows: DataFrame) -> bool:
    return rows.groupBy("h").count().filter(F.col("count") > 1).isEmpty()


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, n, h), phrases (key: the words' hashes, n) of two to DEPTH words, both of `least` occurrences at least,
    and the number of word occurrences of each language (lang, n)."""
    shards = written(shards_of(in_small_batches(docs), SHARD_WORDS), large_rows=True)
    counted = written(_word_counts(shards).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    often = counted.filter(F.col("n") >= least)
    many = lambda rows: rows.filter(F.col("n") >= least)
    seed = 0
    while True:  # until the words and the pairs have hashes of their own
        words = written(_keyed(often, seed))
        if _unique(words):
            told = _told(words.select("h"))
            maybe = written(many(_enumerated(shards, seed, told)))  # hashes of pairs: one that is shared counts for all of its pairs
            near = _told(maybe.select("x"))
            both = written(many(_enumerated(shards, seed, told, near)))
            pairs, triples = (written(_paired(both.filter(F.col("level") == k).select("x", "y", "n"))) for k in (2, 3))
            if _unique(pairs):
                break
        seed += 1
    fours = many(_enumerated(shards, seed, told, near, _told(triples.select("h"))))
    pair = lambda name: pairs.select(F.col("h").alias(name), F.array("x", "y").alias(f"{name}_"))
    phrases = pairs.select(F.array("x", "y").alias("key"), "n")
    phrases = phrases.union(triples.join(pair("x"), "x").select(F.concat("x_", F.array("y")), "n"))
    phrases = phrases.union(fours.join(pair("x"), "x").join(pair("y"), "y").select(F.concat("x_", "y_"), "n"))
    return words, written(phrases), counted.groupBy("lang").agg(F.sum("n").alias("n"))


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to DEPTH words.

    A phrase counts a times, its parts l and r; of its cuts the one with the lowest floor(SCALE * a / (l + r)) counts, and of
    several such the first. Phrases inside a longer one that stands percent of their times are left out. It is enough to look
    at those a word longer: no phrase is rarer than one that holds it.
    """
    words, phrases, total = frequent_phrases(docs, least)
    size = F.size("key")
    part = lambda lo, n: F.slice("key", lo, n)
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), F.slice("key", F.lit(1), k).alias("left"), F.slice("key", k + 1, size - k).alias("right")))
    around = phrases.filter(size > 2).select(F.explode(F.array(part(1, size - 1), part(2, size - 1))).alias("key"), "n").groupBy("key").agg(F.max("n").alias("around"))
    kept = phrases.join(around, "key", "left").filter(F.col("around").isNull() | (_exact("around") * 100 < _exact("n") * percent)).drop("around")
    known = phrases.union(words.select(F.array("h").alias("key"), "n"))
    side = lambda name, n: known.select(F.col("key").alias(name), F.col("n").alias(n))
    cut = kept.withColumn("cut", F.explode(cuts)).select("key", F.col("n").alias("a"), "cut.k", "cut.left", "cut.right")
    cut = cut.join(side("left", "l"), "left").drop("left").join(side("right", "r"), "right")
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cut.select("key", "a", F.struct(score.alias("score"), "k", "l", "r").alias("low")).groupBy("key", "a").agg(F.min("low").alias("low")).select("key", "a", "low.score", "low.l", "low.r")
    # Only phrases that may be among the first are spelled out: all that are as good as the last of them.
    first = lowest.withColumn("h", F.get("key", F.lit(0))).join(words.select("h", "lang"), "h").drop("h")
    near = first.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top).drop("place")
    named = near.select("*", F.posexplode("key").alias("i", "h")).join(words.select("h", "word"), "h")
    told = named.groupBy("key", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"), *(F.first(c).alias(c) for c in ("a", "l", "r", "score")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = told.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(total.select("lang", "n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
