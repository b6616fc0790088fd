"""Suffix dedup by a depth-limited radix sort: every byte of a WINDOW-byte string that starts in an earlier document goes.

Suffixes are ordered by most significant digits, only as deep as WINDOW bytes; groups that are equal at that depth are
the repeated windows. A pass groups the suffixes by their first bytes to its depth (DEPTHS), and a group that lies in one
document drops out, so only what may repeat goes deeper. Which bytes come first is rotated: a window begins at its
anchor, the place of its least hashed DIGIT-byte string, and the bytes to its left follow those to its right. Equal windows
have equal anchors, and some 14 consecutive windows share one, so that a pass moves one digit for all of them; without the
rotation a pass would move a key for every byte of text.

1. Depth 24: the anchors' digits that two documents have.
2. The windows in a row that share an anchor are a run. A run that stands in an earlier document too is done: all its
   windows go. Of each run the earliest goes deeper, if its digit has runs of another kind.
3. Depth 37: each half of a run is known by the bytes that all its windows share; halves in one document drop out.
4. Depth 50: what is left of the runs' windows is grouped by the windows themselves. Stretches of windows go as text, which is
   shorter than a hash for each window, to the group of the core that all their windows share.

Passes 1 and 3 only thin out: their keys are hashes, and what they find comes back to the texts as a bitmap of at most
MAX_BITS bits, sized by the number of keys. Beyond that it fills up, lets more through, and loses nothing. Passes 2 and 4 decide, by
128-bit hashes (of a run: 32 bits of its digit, by which runs are dealt, and 96 of its bytes). Keys are dealt to BUCKETS_A_PARTITION groups for each shuffle partition, so groups grow with the data
only as far as the partitions set do; a task sends a key once however often it has it (for its earliest document), so a
hot passage costs a row a task. Matches never cross documents, overlaps count, and what is judged is the input.

Null and empty texts have no bytes. A null doc_id comes after all others, and with 2^63 - 1, the largest; doc_ids are integers.
Documents that share a doc_id don't remove each other's bytes; they are told apart by a 32-bit hash of their texts.
Every row gives a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bitmap, give_back, in_small_batches, may_hold, tidy, written

WINDOW, DIGIT = 50, 24
#: Depths of the passes that only thin out; the first is the digit's, the last pass has the whole window.
DEPTHS = (DIGIT, 37)
BUCKETS_A_PARTITION = 1
MAX_BITS = 1 << 28
LAST = 2**63 - 1  # the place of a null doc_id
#: Windows are hashed so many at a time, which fits a core's cache; so many keys are held before they are sent.
CHUNK, HELD = 1 << 16, 1_500_000
#: About so many go to Spark at once, in whole buckets; it holds what it gets outside its heap.
SENT = 1 << 17
_PAD = 64
_SPAN = WINDOW - DIGIT + 1
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_29, _31, _32 = (np.uint64(x) for x in (29, 31, 32))


def _from(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """The eight bytes from each of n consecutive places on, as integers."""
    return np.ndarray((n,), np.uint64, data, at, (1,))


def _digits(data: np.ndarray, at: int, n: int) -> np.ndarray:
    h = _from(data, at, n) * _A
    h ^= h >> _29
    h += _from(data, at + 8, n) * _B
    h *= _D
    h ^= h >> _31
    h += _from(data, at + 16, n) * _C
    h *= _A
    h ^= h >> _32
    h *= _D
    return h


def string_hash(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of the strings of a length from given places on."""
    every = _from(data, 0, len(data) - 7)
    h = np.full(len(at), seed, np.uint64)
    for off in (*range(0, length - 7, 8), length - 8):
        h ^= every[at + off]
        h *= _A
        h ^= h >> _29
        h *= _B
        h ^= h >> _32
    h *= _D
    return h ^ (h >> _29)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[step:], h[:-step])
        have += step
    return h


class Texts:
    """The bytes of some documents in a row, and their runs: document i, first window, end, digit of each."""

    def __init__(self, column: pa.Array):
        wide = pa.types.is_large_string(column.type)
        at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        body = column.buffers()[2]
        own = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and len(column) else np.zeros(0, np.uint8)
        self.data = np.concatenate([own, np.zeros(_PAD + WINDOW, np.uint8)])
        self.starts, self.ends, self.size = at[:-1] - at[0], at[1:] - at[0], len(own)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of at most _SPAN windows whose least digits are equal."""
        last = np.maximum(self.starts, self.ends - WINDOW + 1)  # a document's windows end here
        edge = np.zeros(self.size + 1, np.int8)  # sums are 0 or 1, whatever overflows where many documents are empty
        np.add.at(edge, last, 1), np.add.at(edge, self.ends, -1)
        inside = np.cumsum(edge, dtype=np.int8, out=edge)[: self.size] == 0
        del edge
        firsts, digits, before = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], None
        for a in range(0, self.size, CHUNK):
            n = min(CHUNK, self.size - a)
            least, own = sliding_least(_digits(self.data, a, n + _SPAN - 1), _SPAN), inside[a : a + n]
            new = own.copy()
            new[1:] &= ~own[:-1] | (least[1:] != least[:-1])
            if before is not None and own[0]:
                new[0] = least[0] != before
            before = least[-1] if own[-1] else None
            k = np.flatnonzero(new)
            firsts.append(k + a), digits.append(least[k])
        s, q = np.concatenate(firsts), np.concatenate(digits)
        i = np.searchsorted(self.ends, s, "right")
        e = np.minimum(np.append(s[1:], self.size), last[i])
        return self._cut(i, s, e, q, -(-(e - s) // _SPAN), _SPAN)

    @staticmethod
    def _cut(i: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray, pieces: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Each run in so many pieces of a length."""
        if not len(pieces) or pieces.max() == 1:
            return i, s, e, q
        k = np.repeat(np.arange(len(s)), pieces)
        s = s[k] + (np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        return i[k], s, np.minimum(e[k], s + length), q[k]

    def run_hashes(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each run: its first and last window hold all its bytes."""
        return tuple((string_hash(self.data, s, WINDOW, k) * _C + string_hash(self.data, e - 1, WINDOW, k + 1) + (e - s).astype(np.uint64)) * _D for k in (1, 3))

    def anchored(self, i: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs with the place of their anchor. Those whose windows have several places of the digit go window by window."""
        def place(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
            at = np.full(len(s), -1)
            todo = np.arange(len(s))
            for k in range(2 * _SPAN):
                todo = todo[(at[todo] < 0) & (s[todo] + k < e[todo] + _SPAN - 1)]
                if not len(todo):
                    break
                hit = todo[self._digit_at(s[todo] + k) == q[todo]]
                at[hit] = s[hit] + k
            return at

        at = place(s, e, q)
        one = (at >= e - 1) & (at <= s + _SPAN - 1)
        if one.all():
            return i, s, e, at
        j, s1, e1, q1 = self._cut(i[~one], s[~one], e[~one], q[~one], (e - s)[~one], 1)
        parts = ((i[one], j), (s[one], s1), (e[one], e1), (at[one], place(s1, e1, q1)))
        return tuple(np.concatenate(p) for p in parts)

    def _digit_at(self, at: np.ndarray) -> np.ndarray:
        every = _from(self.data, 0, len(self.data) - 7)
        h = every[at] * _A
        h ^= h >> _29
        h += every[at + 8] * _B
        h *= _D
        h ^= h >> _31
        h += every[at + 16] * _C
        h *= _A
        h ^= h >> _32
        return h * _D

    def cores(self, s: np.ndarray, e: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
        """Each run in stretches of windows that share their core of depth bytes around the anchor: the run, first, end, key.

        A window that has o bytes left of its anchor has the core that begins o - o % step bytes left of it.
        """
        step = WINDOW - depth + 1
        group = (at - s) // step - (at - e + 1) // step + 1
        k = np.repeat(np.arange(len(s)), group)
        x = (at - e + 1)[k] // step + np.arange(len(k)) - np.repeat(np.cumsum(group) - group, group)
        first, end = np.maximum(s[k], at[k] - (x + 1) * step + 1), np.minimum(e[k], at[k] - x * step + 1)
        return k, first, end, string_hash(self.data, at[k] - x * step, depth, 7)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("t", F.xxhash64("text").bitwiseAND(F.lit(2**32 - 1)).cast("long"))


def _held(batches: Iterator[pa.RecordBatch], rows_of: Callable[[Texts, np.ndarray, np.ndarray], list[np.ndarray]], flush: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], size: Callable[[list[np.ndarray]], int] = lambda rows: len(rows[0])) -> Iterator[pa.RecordBatch]:
    """What flush makes of rows_of the documents (d, t, text) of all batches, of rows of a size of some HELD at a time.

    Nothing of what was flushed is held while the next rows come together.
    """
    parts, n = [], 0

    def columns() -> list[np.ndarray]:
        each = [list(c) for c in zip(*parts, strict=True)]
        parts.clear()
        return [np.concatenate(each.pop(0)) for _ in range(len(each))]

    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            parts.append(rows_of(Texts(part.column(2)), part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.uint32)))
            n += size(parts[-1])
            if n >= HELD:
                yield from flush(columns())
                give_back()
                n = 0
    if n:
        yield from flush(columns())


def _group_tidy(meet: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group, after which its memory is given back."""

    def apply(group: pa.Table) -> pa.Table:
        out = meet(group)
        give_back()
        return out

    return apply


def _blobs(bucket: np.ndarray, columns: list[np.ndarray], types: list[str], of: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A row for each bucket: the columns' values there (of places of them, where given), byte by byte of their width, which packs well.

    They come in batches of whole buckets, some SENT values each, with the places in bucket of the values of each row.
    """
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    ends = np.append(first[1:], len(bucket))
    planes = lambda c, x, at: c[at if of is None else of[at]].astype(x, copy=False).view(np.uint8).reshape(len(at), -1).T.tobytes()
    cuts = np.flatnonzero(np.diff(first // SENT, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(first)], strict=True):
        places = [order[a:b] for a, b in zip(first[lo:hi], ends[lo:hi], strict=True)]
        values = (pa.array([planes(c, x, at) for at in places], pa.binary()) for c, x in zip(columns, types, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first[lo:hi]].astype(np.int32)), *values], ["bucket", *(f"c{i}" for i in range(len(columns)))]), places


def _column(table: pa.Table, i: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.zeros(0, kind), *(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind)[:, 0] for b in table.column(f"c{i}").to_pylist())])


def _grouped(keys: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the keys; where a key is new in it; for each place in it the least d of its key."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(d), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return order, new, np.repeat(np.minimum.reduceat(d[order], at), np.diff(np.append(at, len(d)))) if len(d) else d


def _shared_keys(docs: DataFrame, keys_of: Callable[[Texts, np.ndarray], tuple[np.ndarray, np.ndarray]], buckets: int) -> bytes:
    """The keys (their upper 40 bits) that two documents have, as a bitmap. keys_of: document and key of each."""

    wide = "<u4" if buckets >= 256 else "<u8"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(texts: Texts, d: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
            i, key = keys_of(texts, d)
            return [key >> np.uint64(24), d[i]]

        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, d = cols
            order, new, least = _grouped([key], d)
            key, several = key[order], d[order] != least
            at = np.flatnonzero(new)
            times = 1 + np.logical_or.reduceat(several, at)  # sent twice, it counts as two documents
            both = np.repeat(key[at], times)
            cols.clear()
            del key, d, order, new, least, several, at, times
            for batch, _ in _blobs((both % np.uint64(buckets)).astype(np.int64), [(both // np.uint64(buckets)).astype(wide)], [wide]):
                yield batch

        return _held(batches, rows, flush)

    def meet(group: pa.Table) -> pa.Table:
        values, n = np.unique(_column(group, 0, wide), return_counts=True)
        return pa.table({"h": pa.array((values[n > 1].astype(np.uint64) * np.uint64(buckets) + np.uint64(group.column("bucket")[0].as_py())).astype(np.int64))})

    sent = docs.select("d", "t", "text").mapInArrow(tidy(send), "bucket int, c0 binary")
    return _sized(written(sent.groupBy("bucket").applyInArrow(_group_tidy(meet), "h long")))


def _sized(hashes: DataFrame) -> bytes:
    """A bitmap of 16 bits a hash, between 2 ** 20 and MAX_BITS."""
    return bitmap(hashes, min(MAX_BITS, 1 << max(20, (16 * hashes.count()).bit_length())))


def _has(map_: bytes, key: np.ndarray) -> np.ndarray:
    return may_hold(map_, (key >> np.uint64(24)).astype(np.int64))


_GONE = "d long, t long, s int, n int"


def _repeated_runs(docs: DataFrame, rows_of: Callable[[Texts, np.ndarray, np.ndarray], list[np.ndarray]], buckets: int) -> DataFrame:
    """d, t, s, n: runs of n windows from s on that an earlier document has too; and w: who of the earliest of each run whose digit has
    runs of another kind. rows_of: two keys, d, t, s, n of runs, equal by both keys; the second begins with the digit."""
    types = ["<u8", "<u8", "<i8", "<u4", "<i4", "u1"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cols[:] = [c.astype(x, copy=False) for c, x in zip(cols, types, strict=True)]
            order, _, least = _grouped(cols[:2], cols[2])
            gone = cols[2][order] != least
            away, stay = np.sort(order[gone]), np.sort(order[~gone])
            del order, least, gone
            # What goes for an earlier document of this task needs no company: it passes through, in buckets of its own.
            none = [np.broadcast_to(np.zeros(1, c.dtype), len(c)) for c in cols[:2]]
            for at, sign in ((away, -1), (stay, 1)):
                if len(at):
                    k = (cols[1][at] >> _32) % np.uint64(buckets) if sign > 0 else cols[2][at].astype(np.uint64) % np.uint64(buckets)
                    for batch, _ in _blobs((k.astype(np.int64) + (sign < 0)) * sign, cols if sign > 0 else none + cols[2:], types, at):
                        yield batch

        return _held(batches, rows_of, flush)

    def meet(group: pa.Table) -> pa.Table:
        cols = [_column(group, i, x) for i, x in enumerate(types)]
        if group.column("bucket")[0].as_py() < 0:
            away, w = np.arange(len(cols[0])), np.zeros(0, np.int64)
        else:  # all runs of a digit are here
            order, new, least = _grouped(cols[:2], cols[2])
            away, first = order[cols[2][order] != least], np.flatnonzero(new)
            kind = order[first]
            _, digit, kinds = np.unique(cols[1][kind] >> _32, return_inverse=True, return_counts=True)
            several = kinds[digit] > 1
            w = who(cols[0][kind[several]], least[first[several]]).astype(np.int64)
        out = {c: pa.array(cols[j][away].astype(x)) for c, j, x in (("d", 2, np.int64), ("t", 3, np.int64), ("s", 4, np.int32), ("n", 5, np.int32))}
        out = {c: pa.concat_arrays([x, pa.nulls(len(w), x.type)]) for c, x in out.items()}
        return pa.table(out | {"w": pa.concat_arrays([pa.nulls(len(away), pa.int64()), pa.array(w)])})

    sent = docs.select("d", "t", "text").mapInArrow(tidy(send), "bucket int, " + ", ".join(f"c{i} binary" for i in range(len(types))))
    return sent.groupBy("bucket").applyInArrow(_group_tidy(meet), _GONE + ", w long")


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n places from each first on, one behind the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _unlike(k: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows in a row change their stretch k or whether they are gone, and how many there are from each such place on."""
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (gone[1:] != gone[:-1])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(k)))


def _repeated(data: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of stretches (document and number of windows of each, one's bytes behind the other's), as many in a row as are alike: the
    stretch, whether an earlier document of these has them, the first window's number among all, how many."""
    n = n.astype(np.int64)
    size = n + WINDOW - 1
    w = _spread(np.cumsum(size) - size, n)
    keys = [string_hash(data, w, WINDOW, 1), string_hash(data, w, WINDOW, 2)]
    del w
    wd = np.repeat(d, n)
    order, _, least = _grouped(keys, wd)
    del keys
    gone = np.zeros(len(wd), bool)
    gone[order[wd[order] != least]] = True
    del wd, order, least
    k = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at, many = _unlike(k, gone)
    return k[at], gone[at], at, many


def _repeated_windows(docs: DataFrame, left: Callable[[Texts, np.ndarray], tuple[np.ndarray, ...]], buckets: int) -> DataFrame:
    """d, t, s, n: n windows from s on that an earlier document has too, of the stretches (document, first, end, anchor) that left gives.

    Windows in a row share most of their bytes: what is sent is a stretch's text, not a hash for each window. Equal windows have
    equal cores, by which stretches are dealt.
    """
    step, types = WINDOW - DEPTHS[-1] + 1, ["<i8", "<u4", "<i4", "u1"]

    def rows(texts: Texts, d: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        """Of stretches: key, d, t, s, n; their bytes."""
        i, s, e, at = left(texts, d)
        n = e - s
        key = string_hash(texts.data, at - (at - s) // step * step, DEPTHS[-1], 7)
        return [key, d[i], t[i], (s - texts.starts[i]).astype(np.int32), n.astype(np.uint8), texts.data[_spread(s, n + WINDOW - 1)]]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(3)

        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, d, t, s, n, data = cols
            n = n.astype(np.int64)
            k, away, at, size = _repeated(data, d, n)
            off = at - (np.cumsum(n) - n)[k]  # windows of the stretch before
            begin = (np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1))[k] + off
            cols = [d[k], t[k], s[k] + off.astype(np.int32), size.astype(np.uint8)]
            for own, sign in ((np.flatnonzero(away), -1), (np.flatnonzero(~away), 1)):
                if not len(own):
                    continue
                deal = (d[k[own]].astype(np.uint64) if sign < 0 else key[k[own]]) % np.uint64(buckets)
                for batch, places in _blobs((deal.astype(np.int64) + (sign < 0)) * sign, cols, types, own):
                    texts = [tight.compress(data[_spread(begin[x], size[x] + WINDOW - 1)].tobytes()) if sign > 0 else None for x in (own[p] for p in places)]
                    yield batch.append_column("z", pa.array(texts, pa.binary()))

        return _held(batches, rows, flush, lambda rows: int(rows[4].sum(dtype=np.int64)))

    def meet(group: pa.Table) -> pa.Table:
        d, t, s, n = (_column(group, i, x) for i, x in enumerate(types))
        if group.column("bucket")[0].as_py() >= 0:
            loose = zstandard.ZstdDecompressor()
            data = np.frombuffer(b"".join(loose.decompress(z.as_py()) for z in group.column("z")), np.uint8)
            k, gone, at, many = _repeated(data, d, n)
            k, at, many = k[gone], at[gone], many[gone]
            d, t, s, n = d[k], t[k], s[k] + at - (np.cumsum(n, dtype=np.int64) - n)[k], many
        return pa.table({"d": pa.array(d), "t": pa.array(t.astype(np.int64)), "s": pa.array(s.astype(np.int32)), "n": pa.array(n.astype(np.int32))})

    sent = docs.select("d", "t", "text").mapInArrow(tidy(send), "bucket int, " + ", ".join(f"c{i} binary" for i in range(len(types))) + ", z binary")
    return sent.groupBy("bucket").applyInArrow(_group_tidy(meet), _GONE)


def who(key: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A hash of a stretch of a document, in its upper 40 bits."""
    h = (key ^ (d.astype(np.uint64) * _C)) * _A
    h ^= h >> _32
    return h * _D


def stretches(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes of windows (first, number of windows)."""
    out: list[list[int]] = []
    for s, n in sorted(places):
        e = s + n - 1 + WINDOW
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def repeated_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """d, t, s, n: windows (n from byte s on) of document d that an earlier document has too; docs as _documents gives them."""

    def first_keys(texts: Texts, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, _, _, q = texts.runs()
        return i, q

    maps = [_shared_keys(docs, first_keys, buckets)]

    def likely(texts: Texts) -> tuple[np.ndarray, ...]:
        i, s, e, q = texts.runs()
        keep = np.flatnonzero(_has(maps[0], q))
        i, s, e, q = i[keep], s[keep], e[keep], q[keep]
        return i, s, e, q, *texts.run_hashes(s, e)

    def whole(texts: Texts, d: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        i, s, e, q, c1, c2 = likely(texts)
        return [c1, q >> _32 << _32 | c2 >> _32, d[i], t[i], (s - texts.starts[i]).astype(np.int32), (e - s).astype(np.uint8)]

    second = written(_repeated_runs(docs, whole, buckets))
    deeper = _sized(second.filter(F.col("w").isNotNull()).select(F.shiftrightunsigned("w", 24).alias("h")))

    def left(texts: Texts, d: np.ndarray, levels: int) -> tuple[np.ndarray, ...]:
        """What is left of the runs after so many levels: document, first, end of stretches, anchor."""
        i, s, e, q, c1, _ = likely(texts)
        keep = np.flatnonzero(_has(deeper, who(c1, d[i])))
        i, s, e, at = texts.anchored(i[keep], s[keep], e[keep], q[keep])
        for depth, map_ in zip(DEPTHS[1 : levels + 1], maps[1:], strict=True):
            k, first, end, key = texts.cores(s, e, at, depth)
            keep = np.flatnonzero(_has(map_, key))
            i, s, e, at = i[k[keep]], first[keep], end[keep], at[k[keep]]
        return i, s, e, at

    for level, depth in enumerate(DEPTHS[1:]):

        def deeper_keys(texts: Texts, d: np.ndarray, level: int = level, depth: int = depth) -> tuple[np.ndarray, np.ndarray]:
            i, s, e, at = left(texts, d, level)
            k, _, _, key = texts.cores(s, e, at, depth)
            return i[k], key

        maps.append(_shared_keys(docs, deeper_keys, buckets))

    fourth = _repeated_windows(docs, lambda texts, d: left(texts, d, len(DEPTHS) - 1), buckets)
    return second.filter(F.col("d").isNotNull()).select("d", "t", "s", "n").union(fourth)


def remove_repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    buckets = buckets or BUCKETS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([tight.compress(t.encode()) for t in b.column(3).to_pylist()], pa.binary())], ["doc_id", "d", "t", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for z, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = loose.decompress(z)
                spans = stretches([(p["s"], p["n"]) for p in places or ()])
                kept, at = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                rows.append((len(data), sum(y - x for x, y in spans), len(spans), kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    own = _documents(in_small_batches(docs))
    places = repeated_windows(own, buckets).groupBy("d", "t").agg(F.collect_list(F.struct("s", "n")).alias("places"))
    packed = own.select("doc_id", "d", "t", "text").mapInArrow(tidy(pack), f"doc_id {kind}, d long, t long, z binary")
    return packed.join(places, ["d", "t"], "left").select("doc_id", "z", "places").mapInArrow(tidy(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
