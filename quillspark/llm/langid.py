"""Language identification of code-switched text by a linear-chain conditional random field.

Every word of a text gets a language: its scores come from its character n-grams (those with the mark of its begin or end
are its affixes; each occurrence counts), its own form and lexicons of the commonest words of each language; learned transitions
tie neighbours together; forward-backward gives each word's posteriors. A document's language is the one with the
largest mean posterior over all its words, which is its score.

Fitting: a bounded sample of rows (SAMPLE_ROWS of each language, in order of a hash of doc_id, then of the text; whole texts) of
those whose crc32(doc_id) mod 3 isn't 1, with a language. Spans of several rows are strung together, so that
the transitions learn how seldom a language changes. The model (BUCKETS x labels) is fitted on the driver in seconds.

Predicting: all words of a batch form one chain that forgets at the start of a document. The chain is cut into blocks
whose transfer matrices are computed side by side, so that one long document costs no more than many short ones. It is exact.

Null texts and texts without a letter are und, with score 0. A null doc_id hashes as ''. Repeated rows are predicted
each. With no labelled row every text is und. Equal posteriors go to the first label by code point.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.bpe import runs
from quillspark.llm.common import in_small_batches, tidy
from quillspark.llm.shingles import mixed

SAMPLE_ROWS = 100
BUCKETS = 1 << 15
ROUNDS = 25
LEXICON = 300
GRAMS = (2, 3, 4)
#: Documents handled together hold about so many characters.
BATCH_CHARS = 1_000_000
#: Below this share of its words a pipeline rejects a document's language.
MIN_SCORE = 0.5

_word = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def word_grid(words: list[str], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words that aren't empty: for each character of the marked words a row (the n-grams that begin there,
    and at a word's first the word itself; blank where there is none), and where the words' rows begin."""
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts, n = ends - lengths, len(codes)
    left = np.repeat(ends, lengths) - np.arange(n)  # characters of the word from here on
    spread = mixed(codes + np.uint64(1))
    grid = np.full((n, len(GRAMS) + 1), blank, np.int32)
    h = spread.copy()
    for k in range(1, max(GRAMS)):
        h[: n - k] = mixed(h[: n - k] * np.uint64(0x9E3779B97F4A7C15) + spread[k:])
        if k + 1 in GRAMS:
            at = np.flatnonzero(left > k)
            grid[at, GRAMS.index(k + 1)] = (mixed(h[at] + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32)
    whole = np.add.reduceat(mixed(spread + np.arange(n).astype(np.uint64) - np.repeat(starts, lengths).astype(np.uint64)), starts) if n else spread
    grid[starts, -1] = (mixed(whole) % np.uint64(BUCKETS)).astype(np.int32)
    return grid, starts


class Model:
    def __init__(self, labels: list[str], lexicons: dict[str, list[int]]):
        n = len(labels)
        self.labels, self.lexicons = labels, lexicons
        self.weights = np.zeros((BUCKETS + n + 1, n), np.float32)  # the last row stays 0: no feature
        self.transitions = np.eye(n) * 2.0
        self.start = np.zeros(n)

    def listed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words a lexicon has, and its feature."""
        found = [(i, BUCKETS + x) for i, w in enumerate(words) for x in self.lexicons.get(w, ())]
        return np.array([i for i, _ in found], np.int64), np.array([f for _, f in found], np.int64)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of label scores for each word."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for a in range(0, len(words), 10_000):  # so many at once bound the gathered weights
            some = words[a : a + 10_000]
            grid, starts = word_grid(some, len(self.weights) - 1)
            out[a : a + len(some)] = np.add.reduceat(sum(self.weights[grid[:, k]] for k in range(grid.shape[1])), starts)
        np.add.at(out, (listed := self.listed(words))[0], self.weights[listed[1]])
        return out


def forward_backward(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(scores) and the scaled forward and backward messages at each place of one chain; starts: places where it forgets."""
    n, k = scores.shape
    steps = max(1, int(np.sqrt(n)))
    blocks = -(-n // steps)
    e = np.ones((blocks * steps, k))
    e[:n] = np.exp(scores - scores.max(1, keepdims=True))
    new = np.ones(blocks * steps, bool)
    new[:n] = starts
    e, new = e.reshape(blocks, steps, k), new.reshape(blocks, steps)
    t, s = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(steps):
        product = np.where(new[:, i, None, None], product.sum(2, keepdims=True) * s, (product.reshape(-1, k) @ t).reshape(blocks, k, k)) * e[:, i, None, :]
        product /= product.max((1, 2), keepdims=True)
    into, back = np.ones((blocks + 1, k)), np.ones((blocks + 1, k))
    for b in range(blocks):
        into[b + 1] = (x := into[b] @ product[b]) / x.max()
    for b in range(blocks - 1, -1, -1):
        back[b] = (x := product[b] @ back[b + 1]) / x.max()
    ahead, behind = np.empty_like(e), np.empty_like(e)
    a = into[:-1]
    for i in range(steps):
        a = np.where(new[:, i, None], s, a @ t) * e[:, i]
        a = a / a.max(1, keepdims=True)
        ahead[:, i] = a
    b = back[1:]
    for i in range(steps - 1, -1, -1):
        behind[:, i] = b
        x = e[:, i] * b
        b = np.where(new[:, i, None], (x @ s)[:, None], x @ t.T)
        b = b / b.max(1, keepdims=True)
    return e.reshape(-1, k)[:n], ahead.reshape(-1, k)[:n], behind.reshape(-1, k)[:n]


def posteriors(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    _, ahead, behind = forward_backward(scores, starts, transitions, start)
    p = ahead * behind
    return p / p.sum(1, keepdims=True)


def fit(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> Model | None:
    """From (language, text) rows by gradient ascent with Adagrad on the likelihood of strung-together spans."""
    rows = sorted((lang, text) for lang, text in rows if _word.search(text or ""))
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    of = {lang: i for i, lang in enumerate(labels)}
    tokens = [(of[lang], words_of(text)) for lang, text in rows]
    counts = [Counter(w for y, ws in tokens if y == i for w in ws) for i in range(len(labels))]
    lexicons: dict[str, list[int]] = {}
    for i, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons.setdefault(w, []).append(i)
    rng = np.random.default_rng(7)
    spans = []
    for y, ws in tokens:
        a = 0
        while a < len(ws):
            b = a + int(rng.integers(5, 60))
            spans.append((y, ws[a:b]))
            a = b
    chain: list[str] = []
    truth: list[int] = []
    starts: list[bool] = []
    for k, i in enumerate(rng.permutation(len(spans))):
        y, ws = spans[i]
        chain += ws
        truth += [y] * len(ws)
        starts += [k % 4 == 0, *[False] * (len(ws) - 1)]
    vocabulary = {w: i for i, w in enumerate(sorted(set(chain)))}
    model = Model(labels, lexicons)
    ids, y, new = np.array([vocabulary[w] for w in chain]), np.array(truth), np.array(starts)
    gradient, k = gradient_of(model, list(vocabulary), ids, y, new), len(labels)
    squares = [np.full(model.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)]
    for _ in range(rounds):
        g, *rest = gradient()
        for w, d, q in zip((model.weights, model.transitions, model.start), (g - 0.01 * model.weights, *rest), squares, strict=True):
            q += d * d
            w += (0.3 * d / np.sqrt(q)).astype(w.dtype)
    return model


def gradient_of(model: Model, vocabulary: list[str], ids: np.ndarray, y: np.ndarray, new: np.ndarray) -> Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The gradient of the log-likelihood of labels y of a chain of words, as the model stands, by weights, transitions and
    starts; the chain forgets where new is set."""
    grid, firsts = word_grid(vocabulary, len(model.weights) - 1)
    widths = np.diff(np.append(firsts, len(grid)))
    who, which = model.listed(vocabulary)
    n, k = len(ids), len(model.labels)
    tied = np.flatnonzero(~new)

    def gradient() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, ahead, behind = forward_backward(model.scores(vocabulary)[ids], new, model.transitions, model.start)
        p = ahead * behind
        p /= p.sum(1, keepdims=True)
        off = -p
        off[np.arange(n), y] += 1
        g = np.zeros_like(model.weights)
        for j in range(k):
            by_word = np.bincount(ids, off[:, j], len(vocabulary))
            g[:, j] = np.bincount(grid.ravel(), np.repeat(by_word, widths * grid.shape[1]), len(g)) + np.bincount(which, by_word[who], len(g))
        g[-1] = 0
        t = np.exp(model.transitions - model.transitions.max())
        pair = ahead[tied - 1][:, :, None] * t * (e * behind)[tied][:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        return g, np.bincount(y[tied - 1] * k + y[tied], minlength=k * k).reshape(k, k) - pair.sum(0), off[new].sum(0)

    return gradient


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """The bounded sample: rows by narrow columns first, then their texts. Equal rows count once."""
    own = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & (F.col("text") != ""))
    known = own.select("doc_id", "lang", F.xxhash64("text").alias("h"))
    by = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    chosen = {(r.doc_id, r.h) for r in known.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= rows).collect()}
    if not chosen:
        return []
    found = own.filter(F.col("doc_id").isin([i for i, _ in chosen])).select("doc_id", "lang", "text", F.xxhash64("text").alias("h")).filter(F.col("h").isin([h for _, h in chosen]))
    return [(r.lang, r.text) for r in found.dropDuplicates(["doc_id", "lang", "h"]).collect() if (r.doc_id, r.h) in chosen]


def tag(model: Model, texts: list[str]) -> list[tuple[str, float]]:
    """The language of each text, and its score."""
    tokens = [words_of(t) for t in texts]
    place = {w: i for i, w in enumerate({w for ws in tokens for w in ws})}
    get = place.__getitem__
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ids = np.fromiter((i for ws in tokens for i in map(get, ws)), np.int64, int(lengths.sum()))
    odd = np.array([not w[0].isalpha() and not any(map(str.isalpha, w)) for w in place], bool)
    if odd.any():  # runs of number signs without a letter are no words
        lengths = np.bincount(np.repeat(np.arange(len(texts)), lengths), ~odd[ids], len(texts)).astype(np.int64)
        ids = ids[~odd[ids]]
    out = [("und", 0.0)] * len(texts)
    full = np.flatnonzero(lengths)
    if len(full):
        firsts = (np.cumsum(lengths) - lengths)[full]
        starts = np.zeros(len(ids), bool)
        starts[firsts] = True
        p = posteriors(model.scores(list(place))[ids], starts, model.transitions, model.start)
        mean = np.add.reduceat(p, firsts, axis=0) / lengths[full, None]
        best = mean.argmax(1)
        for d, i, s in zip(full.tolist(), best.tolist(), mean[np.arange(len(full)), best].tolist(), strict=True):
            out[d] = (model.labels[i], min(1.0, s))
    return out


def predict(docs: DataFrame, model: Model | None, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep, the language and its score for each row; text, and nothing else, decides."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]))
    docs = in_small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + labels) x labels weights and LEXICON words a label

    # The text goes to Python once, whether it is among the columns kept or not.
    columns = keep if "text" in keep else (*keep, "text")
    at = columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in runs(texts, BATCH_CHARS):
                lang, score = zip(*tag(shared.value, texts[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    kinds = dict(docs.dtypes)
    return docs.select(*columns).mapInArrow(tidy(apply), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", {names[0]} string, {names[1]} double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    return predict(docs, fit(sample(docs)), "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
