"""Line dedup by a deletion-neighbourhood join.

A line goes if an equal line, or one within an edit (a character replaced, inserted or left out), stands earlier in the
corpus: in a document of a smaller doc_id, or above it in its own. Lines of min_exact characters or more are compared for
equality, those of min_edit or more for edits too; shorter ones stay. With min_exact=1 every line that isn't empty is compared.

Lines are known by 128-bit hashes, each with its earliest place. Two lines within an edit share all deletion variants at the
edit: the lines without the replaced character, or the longer line without the extra one and the shorter itself. Before
variants are emitted two exact filters thin the lines out: within an edit, the first or the last part (a power of
two, a quarter of the line at least) is the same, and all but one segment of SEGMENT characters and its surroundings is. So variants
are needed only within segments whose surroundings occur twice. Variants are hashed keys; lines that meet at a key are
compared with the earliest there, by edit distance on their texts. Keys say which character is gone, so any two lines
that meet are within an edit, and comparing with the earliest alone loses nothing; a common variant costs no pairs.

Nulls: a null or empty text has no line to remove. Null doc_ids come last. Rows that share a doc_id are one place: they
remove nothing of each other at the same line number. Every row gives a row; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bitmap, in_small_batches, may_hold, written
from quillspark.llm.shingles import mixed

MIN_EXACT, MIN_EDIT, SEGMENT = 10, 20, 16
#: Characters that are hashed at once.
PART_CHARS = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_powers = np.ones(1, np.uint64)


def _line_hash(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def _bits(hashes: list[bytes]) -> np.ndarray:
    """xxhash64 of line hashes, as Spark has it."""
    return np.array([xxhash.xxh64_intdigest(h, seed=42) for h in hashes], np.uint64).view(np.int64)


def _anchors(line: str) -> list[int]:
    """Hashes of the first and last part, for the line as the shorter and as the longer of two."""
    lengths = {1 << (max(1, (n - 1) // 2).bit_length() - 1) for n in (len(line), len(line) - 1)}
    return [xxhash.xxh64_intdigest(part.encode(), seed=2 * a + k) - 2**63 for a in sorted(lengths) for k, part in ((0, line[:a]), (1, line[-a:]))]


def _powers_to(n: int) -> np.ndarray:
    """Powers of the base, n at least."""
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE, np.uint64)]))
    return _powers


def prefix_hashes(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes modulo 2 ** 64 of all prefixes, and of all suffixes from the end."""
    n = len(line)
    powers = _powers_to(n)
    c = mixed(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    out = np.zeros((2, n + 1), np.uint64)
    np.cumsum(c * powers[:n], out=out[0, 1:])
    np.cumsum(c[::-1] * powers[:n], out=out[1, 1:])
    return out[0], out[1]


def _key(*parts) -> np.ndarray:
    h = np.uint64(0)
    for p in parts:
        h = mixed(np.asarray(h + np.asarray(p, np.uint64)).reshape(-1))
    return h


def segment_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, less, segment) arrays: hashes of what surrounds each segment of lines[row], as a line of its length and of one less."""
    sizes = np.array([len(s) for s in lines], np.int64)
    start, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    powers = _powers_to(int(sizes.max(initial=0)))
    c = mixed(np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    at = np.arange(n) - np.repeat(start, sizes)
    # Sums over the whole batch; those within a line are differences, since arithmetic is modulo 2 ** 64.
    first, last = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(c * powers[at], out=first[1:])
    np.cumsum(c * powers[np.repeat(sizes, sizes) - 1 - at], out=last[1:])
    out = []
    for less in (0, 1):
        count = -(-(sizes - less) // SEGMENT)
        row = np.repeat(np.arange(len(lines)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        size, a = sizes[row] - less, start[row]
        end = a + sizes[row]
        tail = np.maximum(0, size - (j + 1) * SEGMENT)
        keys = _key(size, j, first[a + j * SEGMENT] - first[a], last[end] - last[end - tail])
        out.append((row, keys.view(np.int64), np.full(len(row), less, np.int32), j.astype(np.int32)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Slices of PART_CHARS characters or a little more, one line at least."""
    a = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= PART_CHARS or i == len(sizes) - 1:
            yield slice(a, i + 1)
            a, total = i + 1, 0


def variants(line: str, regions: set[tuple[int, int]]) -> list[tuple[int, str]]:
    """(key, kind) of the deletion variants within segments. Kinds: S, the line without a character at a given place;
    A, the line itself; B, the line without a character, wherever it stood."""
    first, last = prefix_hashes(line)
    n = len(line)
    at: set[int] = set()
    for less, j in regions:
        at.update(range(j * SEGMENT, min(n, n - max(0, n - less - (j + 1) * SEGMENT))))
    p = np.array(sorted(at), np.int64)
    replaced = _key(np.full(len(p), 3), np.full(len(p), n), p, first[p], last[n - 1 - p])
    without = np.unique(first[p] + (first[n] - first[p + 1]) * _INVERSE)
    shorter = _key(np.full(len(without), 5), np.full(len(without), n - 1), without)
    itself = _key([5], [n], [first[n]])
    return [(k, kind) for keys, kind in ((replaced, "S"), (itself, "A"), (shorter, "B")) for k in keys.view(np.int64).tolist()]


def _places(docs: DataFrame, min_exact: int, min_edit: int) -> DataFrame:
    """A row for each line of min_exact characters or more: line (its hash), n, anchors, place."""
    kind = pa.schema([("line", pa.binary()), ("n", pa.int64()), ("anchors", pa.list_(pa.int64())), ("at", pa.int64()), ("no", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                rows = [(_line_hash(s), len(s), _anchors(s) if len(s) >= min_edit else None, i, no) for i, t in enumerate(part.column(2).to_pylist()) if t for no, s in enumerate(t.split("\n")) if len(s) >= min_exact]
                cols = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, kind, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols[:3], part.column(0).take(cols[3]), part.column(1).take(cols[3]), cols[4]], ["line", "n", "anchors", "doc_id", "copy", "no"])

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(apply, f"line binary, n long, anchors array<long>, doc_id {dict(docs.dtypes)['doc_id']}, copy long, no long")


def place() -> Column:
    """Where a line stands, in the corpus's order."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("d"), F.col("no").alias("no"))


def _texts(docs: DataFrame, lines: DataFrame, min_edit: int) -> DataFrame:
    """line, first, text of the lines (line, first)."""
    map_ = bitmap(lines.select(F.xxhash64("line").alias("line")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                found = list({s for t in b.column(0).slice(a, 500).to_pylist() if t for s in t.split("\n") if len(s) >= min_edit})
                hashes = [_line_hash(s) for s in found]
                keep = np.flatnonzero(may_hold(map_, _bits(hashes)))
                yield pa.RecordBatch.from_arrays([pa.array([hashes[k] for k in keep], pa.binary()), pa.array([found[k] for k in keep], pa.string())], ["line", "text"])

    return docs.select("text").mapInArrow(apply, "line binary, text string").dropDuplicates(["line"]).join(lines, "line")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another row has too."""
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n"), key)


def near_lines(docs: DataFrame, firsts: DataFrame, min_edit: int) -> DataFrame:
    """line: the hashes of lines with an earlier line within an edit, not equal."""
    anchored = firsts.filter(F.col("n") >= min_edit).select("line", F.explode("anchors").alias("key")).distinct()
    likely = written(_shared(anchored, "key").select("line").distinct().join(firsts.select("line", "first"), "line"))
    texts = written(_texts(docs, likely, min_edit))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, texts_ = b.column(0), b.column(1).to_pylist()
            for part in _parts([len(t) for t in texts_]):
                row, key, less, segment = segment_keys(texts_[part])
                yield pa.RecordBatch.from_arrays([lines.take(pa.array(row + part.start)), pa.array(key), pa.array(less), pa.array(segment)], ["line", "key", "less", "segment"])

    surrounded = _shared(texts.select("line", "text").mapInArrow(segments, "line binary, key long, less int, segment int"), "key")
    regions = surrounded.groupBy("line").agg(F.collect_set(F.struct("less", "segment")).alias("regions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, found) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                key, kind = zip(*variants(text, {(r["less"], r["segment"]) for r in found}), strict=True)
                same = pa.array([i] * len(key))
                yield pa.RecordBatch.from_arrays([b.column(2).take(same), b.column(3).take(same), pa.array(key, pa.int64()), pa.array(kind)], ["line", "first", "key", "kind"])

    kinds = dict(texts.dtypes)
    keyed = written(_shared(texts.join(regions, "line").select("text", "regions", "line", "first").mapInArrow(emit, f"line binary, first {kinds['first']}, key long, kind string"), "key"))
    whole, other = F.col("kind") == "A", F.col("kind") != "A"
    least = keyed.groupBy("key").agg(F.min(F.when(other, F.struct("first", "line"))).alias("other"), F.min(F.when(whole, F.struct("first", "line"))).alias("whole"))
    meets = keyed.join(least, "key").withColumn("w", F.when(F.col("kind") == "B", F.col("whole")).otherwise(F.col("other"))).filter(F.col("w.first") < F.col("first"))
    pairs = meets.select("line", F.col("w.line").alias("earlier")).distinct()
    text = lambda c, name: texts.select(F.col("line").alias(c), F.col("text").alias(name))
    checked = pairs.join(text("line", "x"), "line").join(text("earlier", "y"), "earlier")
    return checked.filter(F.levenshtein("x", "y", 1).between(0, 1)).select("line").distinct()


def dedup_lines(docs: DataFrame, min_exact: int = MIN_EXACT, min_edit: int = MIN_EDIT) -> DataFrame:
    """docs with two more columns: n_lines, n_removed (those of docs of these names are left out); text is what stays of it.

    min_exact and min_edit are the fewest characters of lines that are compared for equality, and for edits (4 at least).
    """
    if min_edit < 4:
        raise ValueError("min_edit must be 4 at least")
    narrow = in_small_batches(docs).select("doc_id", "text")
    places = written(_places(narrow, max(1, min_exact), min_edit))
    firsts = written(places.groupBy("line").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("anchors").alias("anchors")))
    near = written(near_lines(narrow, firsts, min_edit)).withColumn("near", F.lit(True))
    verdicts = firsts.select("line", "first", "times").join(near, "line", "left").filter((F.col("times") > 1) | F.col("near"))
    gone = places.select("line", "doc_id", "copy", "no").join(verdicts, "line").filter(F.coalesce("near", F.lit(False)) | (place() > F.col("first")))
    gone = gone.groupBy("doc_id", "copy").agg(F.collect_set("no").alias("gone")).select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "gone")
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    kinds = dict(docs.dtypes)
    row = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)))
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("copy"), "text")
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, removed = [], [], []
            for t, g in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                all_, g = (t or "").split("\n"), set(g or ())
                texts.append(t if not g else "\n".join([s for i, s in enumerate(all_) if i not in g]))
                lines.append(len(all_) if t else 0), removed.append(len(g))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_lines", "n_removed"])

    schema = f"row struct<{', '.join(f'k{i}: {kinds[c]}' for i, c in enumerate(others))}>, text string, n_lines long, n_removed long"
    done = joined.select("row", "text", "gone").mapInArrow(apply, schema)
    own = {c: F.col(f"row.k{i}").alias(c) for i, c in enumerate(others)}
    return done.select(*(own.get(c, "text") for c in docs.columns if c in own or c == "text"), "n_lines", "n_removed")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
