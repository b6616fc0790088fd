"""Token counts of whole texts, huge ones by overlap resynchronisation.

Texts of up to CHUNK_CHARS code points are counted in one go. A huge text becomes overlapping chunks, rows of their own
that Spark spreads over tasks; each chunk is encoded by itself with offsets. Neighbouring chunks are spliced at a
boundary between two pre-tokens that both encodings have in the overlap. Such a boundary is proven stable: the splitter
never looks back, so from a common boundary on both see the same text; a boundary of the left chunk holds since the
splitter looks ahead by one character at most, and those within the length of the longest special token of the chunk's
end are not used. A pre-token's tokens don't depend on its neighbours. Where two chunks have no common boundary, the
whole text is encoded again with chunks and overlaps four times as long, until they align or one chunk holds all.

Small texts are cut into segments (see bpe.segments) which the library counts once each; counts of segments are
remembered between batches (up to CACHE_ROWS of them and those of one batch).

Special strings in texts count as the library's default has it (one token). Null and empty texts have 0 tokens and
bytes. Repeated rows are counted each; equal huge texts are encoded once. The tokenizer is a parameter: any .json of
the tokenizers library with byte-level splitting and no normalizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import REST_ROWS, forget, runs, segments
from quillspark.llm.common import in_small_batches, written

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
CACHE_ROWS = 400_000
MAX_TOKENS = 512


class Counter:
    """Counts tokens of texts and finds boundaries in chunks. One for each Python worker."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = max([0, *map(len, self.special)]) + 1
        self.spaced = any(c.isspace() for t in self.special for c in t)
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if self.spaced:
            return self._lengths(texts)
        if len(self.first) + len(self.later) > CACHE_ROWS:
            forget(self.first, CACHE_ROWS // 2), forget(self.later, CACHE_ROWS // 2)
        pieces, first, later = [], set(), set()
        for t in texts:
            ps, new = segments(t, self.later)
            later |= new
            if ps[0] not in self.first:
                first.add(ps[0])
            pieces.append(ps)
        for found, memory, lead in ((list(first), self.first, ""), (list(later), self.later, " ")):
            for i in range(0, len(found), 20_000):
                part = found[i : i + 20_000]
                memory.update(zip(part, self._lengths([lead + p for p in part]), strict=True))
        of, head = self.later.__getitem__, self.first
        return [head[ps[0]] + sum(map(of, ps[1:])) for ps in pieces]

    def boundaries(self, text: str) -> tuple[list[int], list[int], int]:
        """Offsets at which a pre-token begins, the tokens before each, and all tokens."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        at, before, last = [], [], object()
        special = set(self.special)
        for k, ((a, _), word, token) in enumerate(zip(e.offsets, e.word_ids, e.tokens, strict=True)):
            if word != last or word is None or token in special:
                at.append(a)
                before.append(k)
            last = object() if token in special else word
        return at, before, len(e.ids)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, k (number of the chunk), last, start, text of each chunk."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                step = chunk - overlap
                starts = list(range(0, max(1, len(text) - overlap), step))
                for k, a in enumerate(starts):
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "last": k == len(starts) - 1, "start": a, "text": text[a : a + chunk]}], pa.schema([("key", pa.string()), ("k", pa.int64()), ("last", pa.bool_()), ("start", pa.int64()), ("text", pa.string())]))

    return texts.select("key", "text").mapInArrow(apply, "key string, k long, last boolean, start long, text string")


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """For each chunk the boundaries in its two overlaps, as maps from the offset in the text to the tokens before."""
    pairs = pa.map_(pa.int64(), pa.int64())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            heads, tails, totals = [], [], []
            for text, start in zip(batch.column("text").to_pylist(), batch.column("start").to_pylist(), strict=True):
                at, before, n = c.boundaries(text)
                heads.append([(start + a, b) for a, b in zip(at, before, strict=True) if a < overlap])
                tails.append([(start + a, b) for a, b in zip(at, before, strict=True) if len(text) - overlap <= a <= len(text) - c.margin])
                totals.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), batch.column("last"), pa.array(heads, pairs), pa.array(tails, pairs), pa.array(totals, pa.int64())], ["key", "k", "last", "head", "tail", "n"])

    return chunks.mapInArrow(apply, "key string, k long, last boolean, head map<bigint,bigint>, tail map<bigint,bigint>, n long")


def splice(encoded: DataFrame) -> DataFrame:
    """key, n_tokens; null where two neighbouring chunks have no common boundary."""
    left = encoded.filter(~F.col("last")).select("key", (F.col("k") + 1).alias("k"), "tail")
    at = F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys("head")))
    joined = encoded.join(left.withColumnRenamed("tail", "_t"), ["key", "k"], "left").drop("tail").withColumnRenamed("_t", "tail").withColumn("at", at)
    # What is behind the boundary on the left counts there no more, nor does what is before it on the right.
    own = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.element_at("tail", F.col("at")) - F.element_at("head", F.col("at")))
    own = own + F.when(F.col("last"), F.col("n")).otherwise(F.lit(0))
    return joined.withColumn("own", own).groupBy("key").agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"))


def count_huge(texts: DataFrame, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """key, n_tokens of each row (key, text); keys are distinct."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done: DataFrame | None = None
    while True:
        chunks = _chunks(texts, chunk, overlap).repartition(tasks, "key", "k")
        counted = written(splice(written(_encoded(chunks, path, overlap))))
        good = counted.filter(F.col("n_tokens").isNotNull())
        done = good if done is None else done.union(good)
        if good.count() == counted.count():
            return done
        texts = written(texts.join(counted.filter(F.col("n_tokens").isNull()).select("key"), "key", "left_semi"))
        chunk, overlap = chunk * 4, overlap * 4


def count_tokens(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in runs(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(c.count(texts[a:b]), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        forget(c.first, REST_ROWS), forget(c.later, REST_ROWS)

    d = in_small_batches(docs).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    huge = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    small = d.filter(~huge).mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    long = d.filter(huge).withColumn("key", F.sha2("text", 256))
    counts = count_huge(long.dropDuplicates(["key"]).select("key", "text"), path, chunk, overlap)
    out = small.union(long.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
