"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A text is cut into segments before each space that a character other than white space follows. The pattern always has
a match boundary there and never looks back, so each segment encodes by itself.

1. Tasks read batches of documents (some CORPUS_CHARS characters) and send each batch's distinct segments, a packed list for
   each shard (a hash of the segment; as many shards as shuffle partitions, so they grow only as far as those are set).
2. A shard has a segment from all batches once. It splits its segments by the pattern into words and encodes all distinct
   words together: an inverted index leads from each mergeable pair's rank to the places of that pair in any of the words; a
   heap gives the ranks in order, each merge is applied at all its places, and only the neighbours of a changed place
   get new entries. So a segment is encoded once for the whole corpus. Each batch gets the ids of its segments back.
3. Batches and their replies meet, and a document is the concatenation of its segments' ids.

A batch is known by its partition and its number there. Where the input is not read in the same partitions the second time
(after a lost executor, say), the digest of its segments differs from that of the reply, and the task replays them
itself: that costs time and changes nothing else. Ranks and pattern are parameters; the vocabulary file stays where it
is. Every byte must have a rank.

Null and empty texts have no tokens. Repeated rows are encoded each; other columns of the input are not read. A word of any
length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.common import give_back, in_small_batches, tidy

#: Segments that other operators remember when a task ends, since its worker goes on with other work.
REST_ROWS = 40_000
#: Documents whose texts are handled together hold about so many characters, besides the last of them.
BATCH_CHARS = 4_000_000
#: The batches whose segments are replayed together with all others'.
CORPUS_CHARS = 8_000_000
#: Bytes of words that one replay holds, some 100 bytes of memory each, besides the last word.
REPLAY_BYTES = 1_000_000

_cut = re.compile(r" (?=\S)")
_odd = re.compile(r" (?:\s|\Z)")


def pieces_of(text: str) -> list[str]:
    """A text's segments, all but the first without their leading space."""
    return _cut.split(text) if _odd.search(text) else text.split(" ")


def segments(text: str, known: dict) -> tuple[list[str], set[str]]:
    """A text's pieces; those behind the first that aren't known."""
    pieces = pieces_of(text)
    return pieces, set(pieces[1:]).difference(known)


def forget(memory: dict, keep: int) -> None:
    """Drops all but the entries that came first, among which the common ones are."""
    for k in list(memory)[keep:]:
        del memory[k]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError(f"{path}: not every byte has a rank")
    return ranks


def _width(ranks: dict[bytes, int]) -> int:
    """Bits of a rank."""
    return max(ranks.values()).bit_length()


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of each pair of tokens that together are a token, by both tokens' ranks in one integer."""
    get, bits = ranks.get, _width(ranks)
    return {a << bits | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None}


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: dict[int, int] | None = None) -> list[list[int]]:
    """The ids of each word. Every merge runs over all words at once, in rank order; ties from left to right.

    A merge may give rise to a pair of a lower rank than its own. The places left are then put back, so that each word
    sees its lowest rank first, as if it were alone.
    """
    get = (pair_table(ranks) if pairs is None else pairs).get
    byte, bits = [ranks[bytes([i])] for i in range(256)], _width(ranks)
    parts: list[int] = []  # token ids; -1: merged away, or a gap between words, which makes no key of a pair
    for w in words:
        parts += [byte[c] for c in w]
        parts.append(-1)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
        if (r := get(a << bits | b)) is not None:
            if r in places:
                places[r].append(i)
            else:
                places[r] = [i]
    heap = list(places)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        todo = places.pop(rank)
        todo.sort()
        for k, i in enumerate(todo):
            j = after[i]
            if get(parts[i] << bits | parts[j]) != rank:
                continue
            parts[i], parts[j] = rank, -1
            after[i] = nxt = after[j]
            before[nxt] = i
            p = before[i]
            lower = False
            for at, key in ((p, parts[p] << bits | rank), (i, rank << bits | parts[nxt])):
                if (r := get(key)) is not None:
                    if r in places:
                        places[r].append(at)
                    else:
                        places[r] = [at]
                        heapq.heappush(heap, r)
                    lower = lower or r < rank
            if lower and k + 1 < len(todo):
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(heap, rank)
                places[rank] += todo[k + 1 :]
                break
    out, at = [], 0
    for w in words:
        ids, end = [], at + len(w)
        while at < end:
            ids.append(parts[at])
            at = after[at]
        out.append(ids)
        at = end + 1
    return out


class Encoder:
    """Encodes segments to packed little-endian 32-bit ids, and back. One for each Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.pairs, self.token, self.tokens = pair_table(self.ranks), {i: b for b, i in self.ranks.items()}, None
        if max(self.token) < 4 * len(self.token):  # an array of them is looked up at once
            self.tokens = np.empty(max(self.token) + 1, object)
            self.tokens[list(self.token)] = list(self.token.values())

    def encode(self, segments_: list[str]) -> list[bytes]:
        split = [[w.encode() for w in self.pattern.findall(s)] for s in segments_]
        words = list({w for ws in split for w in ws})
        ids: dict[bytes, bytes] = {}
        for a, b in runs(words, REPLAY_BYTES):
            ids.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(words[a:b], replay(words[a:b], self.ranks, self.pairs), strict=True))
        return [b"".join(map(ids.__getitem__, ws)) for ws in split]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return b"".join(map(self.token.__getitem__, ids.tolist()) if self.tokens is None else self.tokens[ids].tolist())


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def runs(texts: list[str | None] | list[bytes], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[str]]]:
    """A task's documents (doc_id, text) in batches: number, ids, texts."""
    ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        own = [t or "" for t in batch.column(1).to_pylist()]
        at = 0
        for i, t in enumerate(own):
            size += len(t)
            if size >= CORPUS_CHARS:
                yield number, pa.concat_arrays([*ids, batch.column(0).slice(at, i + 1 - at)]), texts + own[at : i + 1]
                ids, texts, size, number, at = [], [], 0, number + 1, i + 1
        if at < len(own):
            ids.append(batch.column(0).slice(at))
            texts += own[at:]
    if texts:
        yield number, pa.concat_arrays(ids), texts


def _asked(texts: Iterable[str], shards: int) -> dict[int, list[str]]:
    """The distinct segments of texts by shard. One text's pieces are held at a time: those of a batch take ten times its memory."""
    first, later = set(), set()
    for t in texts:
        rest = iter(pieces_of(t))
        first.add(next(rest))
        later.update(rest)
    first.update(map(" ".__add__, later))
    later.clear()
    found: dict[int, list[str]] = {}
    for w in sorted(first):
        found.setdefault(zlib.crc32(w.encode()) % shards, []).append(w)
    return found


def _numbered(texts: Iterable[str]) -> tuple[list[np.ndarray], list[bytes]]:
    """The numbers of each text's segments, in four bytes each; the distinct segments by number. A text is split once, a piece looked up once."""
    first, later = defaultdict(), defaultdict()
    first.default_factory, later.default_factory = first.__len__, later.__len__
    rows = []
    for t in texts:
        pieces = iter(pieces_of(t))
        rows.append(np.array([first[next(pieces)], *map(later.__getitem__, pieces)], np.int32))
    for r in rows:
        r[1:] += len(first)
    return rows, [*map(str.encode, first), *(b" " + w.encode() for w in later)]


def _by_shard(segments_: list[bytes], shards: int) -> dict[int, list[int]]:
    """The numbers of distinct segments by shard, each shard's in the order of _asked."""
    found: dict[int, list[int]] = {}
    for i in sorted(range(len(segments_)), key=segments_.__getitem__):
        found.setdefault(zlib.crc32(segments_[i]) % shards, []).append(i)
    return found


def _dealt(texts: list[str], shards: int) -> tuple[list[list[str]], dict[int, list[str]]]:
    """The segments of each text, all but the first without their leading space, and the distinct whole ones by shard."""
    return list(map(pieces_of, texts)), _asked(texts, shards)


def _packed(parts: list[bytes]) -> bytes:
    """A list of byte strings: their number and lengths, then they themselves."""
    sizes = np.array([len(parts), *map(len, parts)], "<u4")
    return zstandard.ZstdCompressor(3).compress(sizes.tobytes() + b"".join(parts))


def _unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends], ends, strict=False)]


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\0".join([b"%d" % len(parts), *parts]), digest_size=16).digest()


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (array of int) where with_ids is set, and the columns of docs named in keep."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind, kinds = dict(docs.dtypes)["doc_id"], dict(docs.dtypes)
    carried = F.struct(F.col("doc_id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    carried_kind = f"struct<doc_id:{kind}" + "".join(f",k{i}:{kinds[c]}" for i, c in enumerate(keep)) + ">"
    own = in_small_batches(docs).select(carried.alias("row"), "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _batches(batches):
            found = _asked(texts, shards)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([number] * len(found), pa.int64()), pa.array([_packed([w.encode() for w in ws]) for ws in found.values()], pa.binary())], ["shard", "batch", "asked"])

    def answer(group: pa.Table) -> pa.Table:
        give_back()  # what the last group took
        coder = encoder(path, pattern)
        asked = [_unpacked(b) for b in group.column("asked").to_pylist()]
        words = list({w for ws in asked for w in ws})
        ids = dict(zip(words, coder.encode([w.decode() for w in words]), strict=True))
        return pa.table({"shard": group.column("shard"), "batch": group.column("batch"), "digest": pa.array([_digest(ws) for ws in asked], pa.binary()), "ids": pa.array([_packed(list(map(ids.__getitem__, ws))) for ws in asked], pa.binary())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, texts in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([_packed([t.encode() for t in texts])], pa.binary())], ["batch", "rows", "texts"])

    def meet(sent: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()  # what the last group took
        coder = encoder(path, pattern)
        reply = {s: (d, b) for s, d, b in zip(*(replies.column(c).to_pylist() for c in ("shard", "digest", "ids")), strict=True)}
        out = []
        for rows, blob in zip(sent.column("rows").combine_chunks(), sent.column("texts").to_pylist(), strict=True):
            texts = _unpacked(blob)
            numbers, words = _numbered(map(bytes.decode, texts))
            ids = np.empty(len(words), object)
            for shard, at in _by_shard(words, shards).items():
                digest, got = reply.get(shard, (None, b""))
                ws = [words[i] for i in at]
                ids[at] = _unpacked(got) if digest == _digest(ws) else coder.encode(list(map(bytes.decode, ws)))
            packed = [b"".join(ids[n].tolist()) for n in numbers]
            del texts, numbers, words, ids
            flat = rows.values.flatten()
            cols = [flat[0], pa.array([len(p) // 4 for p in packed], pa.int64()), *(pa.array([hashlib.sha256(f(p)).hexdigest() for p in packed]) for f in (lambda p: p, coder.decode))]
            if with_ids:
                cols.append(pa.array([np.frombuffer(p, "<u4").astype("i4") for p in packed], pa.list_(pa.int32())))
            out.append(pa.Table.from_arrays([*cols, *flat[1:]], names))
        return pa.concat_tables(out) if out else empty

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *(f"k{i}" for i in range(len(keep)))]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + "".join(f", k{i} {kinds[c]}" for i, c in enumerate(keep))
    empty = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema).empty_table()
    replies = own.mapInArrow(tidy(ask), "shard int, batch long, asked binary").groupBy("shard").applyInArrow(answer, "shard int, batch long, digest binary, ids binary")
    sent = own.mapInArrow(tidy(send), f"batch long, rows array<{carried_kind}>, texts binary")
    done = sent.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(meet, schema)
    return done.select(*names[: len(names) - len(keep)], *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text (null where the ids are no valid UTF-8) from ids."""

    def text_of(coder: Encoder, ids: list[int] | None) -> str | None:
        try:
            return coder.decode(np.array(ids or [], "<u4").tobytes()).decode()
        except UnicodeDecodeError:
            return None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(coder, ids) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(apply, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
