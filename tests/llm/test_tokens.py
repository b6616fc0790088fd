import hashlib
import tracemalloc

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe, tokencount

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["", " ", "a  b", " \n x\n\n y ", "aaaa" * 50, "don't  we'll\t'tis", "x  y  z", "lé <|endoftext|>b <|endoftext|>", "12 345\n 6", "\x1c \x1d a \x85b", "日本 \U0001f600 \U0001f600", "end ", "a \n", "\n\n", " ' 's"]

text = st.text(st.sampled_from(list("ab é\n\t '’sdl1$  \x1c\x85_-日²")) | st.characters(exclude_categories=["Cs"]), max_size=60)
one = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
counter = tokencount.Counter(JSON)
lib = Tokenizer.from_file(JSON)
own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=one.ranks, special_tokens={})


@settings(max_examples=600, deadline=None)
@given(text)
def test_encode_like_library(t):
    packed = one.encode([t, t + " " + t])
    assert [list(memoryview(p).cast("I")) for p in packed] == [own.encode_ordinary(t), own.encode_ordinary(t + " " + t)]
    assert one.decode(packed[0]) == t.encode()


@settings(max_examples=600, deadline=None)
@given(text)
def test_count_like_library(t):
    assert counter.count([t]) == [len(lib.encode(t, add_special_tokens=False).ids)]


@settings(max_examples=600, deadline=None)
@given(text)
def test_segments_encode_by_themselves(t):
    pieces, found = bpe._dealt([t], 3)
    whole = [pieces[0][0], *(f" {p}" for p in pieces[0][1:])]
    assert "".join(whole) == t and set(whole) == {w for ws in found.values() for w in ws}
    assert [i for w in whole for i in own.encode_ordinary(w)] == own.encode_ordinary(t)


def test_ranks_of_any_size():
    ranks = {bytes([i]): 2**20 + i for i in range(256)} | {b"ab": 2**21, b"abab": 2**21 + 1}
    assert bpe.replay([b"ababa", b"ba"], ranks) == [[2**21 + 1, 2**20 + 97], [2**20 + 98, 2**20 + 97]]


def test_memory_of_a_batch(monkeypatch):
    """A batch's pieces aren't held together, nor all words of a shard by one replay; the ids are the same."""
    texts = [" ".join(f"w{(i * 31 + j) % 500}" for j in range(4000)) for i in range(50)]
    tracemalloc.start()
    found = bpe._asked(texts, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(map(len, texts)) and found == bpe._dealt(texts, 3)[1]
    sizes, whole = [], bpe.replay
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 300)
    monkeypatch.setattr(bpe, "replay", lambda words, *a: sizes.append(sum(map(len, words))) or whole(words, *a))
    packed = one.encode(texts[:2])
    assert [list(memoryview(p).cast("I")) for p in packed] == [own.encode_ordinary(t) for t in texts[:2]]
    assert len(sizes) > 1 and max(sizes) < 320 and one.encode([]) == []


def test_each_text_is_split_once():
    """Where batches and replies meet, a text is split once, and its segments are known by numbers of four bytes."""
    texts = [" ".join(f"w{(i * 31 + j) % 500}" for j in range(4000)) for i in range(50)] + NASTY
    tracemalloc.start()
    numbers, words = bpe._numbered(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(map(len, texts)) and len(set(words)) == len(words)
    assert [b"".join(words[i] for i in n).decode() for n in numbers] == texts
    assert {k: [words[i].decode() for i in at] for k, at in bpe._by_shard(words, 3).items()} == bpe._asked(texts, 3)


def test_decoding_takes_no_lookup_by_token():
    packed = one.encode(["lé 日本 and more"])[0]
    assert one.decode(packed).decode() == "lé 日本 and more" and one.decode(b"") == b""
    assert isinstance(one.tokens, bpe.np.ndarray) and all(one.tokens[i] == b for b, i in one.ranks.items())


def test_other_partitions_the_second_time(spark, monkeypatch):
    """Replies to other batches than those that come are not used."""
    docs = spark.range(40).selectExpr("id as doc_id", "concat('w', id, ' some more words ', uuid()) as text").repartition(3)
    enc = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: r.text for r in bpe.decode_documents(enc, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(back) == 40 and all(t.startswith(f"w{i} some more words ") for i, t in back.items())


def test_nasty_texts():
    assert counter.count(NASTY) == [len(lib.encode(t, add_special_tokens=False).ids) for t in NASTY]
    assert [list(memoryview(p).cast("I")) for p in one.encode(NASTY)] == [own.encode_ordinary(t) for t in NASTY]


def test_replay_lower_rank_after_merge():
    rest = {bytes([i]): i + 1000 for i in range(256) if i not in b"abc"}
    ranks = rest | {b"a": 0, b"b": 1, b"c": 2, b"abc": 5, b"bc": 4, b"ab": 3}
    assert bpe.replay([b"abc", b"bcab", b""], ranks) == [[5], [4, 3], []]
    ranks = rest | {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 9}
    assert bpe.replay([b"ababc", b"abab"], ranks) == [[9, 3], [9, 9]]


def test_queries_rows(spark):
    big = ("word and more words, " * 3000) + "x" * 9000 + " " * 3000 + ("tail <|endoftext|> of it\n" * 400)
    rows = [(2**60 + 1, "a b", "x"), (None, None, "y"), (3, "", "z"), (4, big, "w"), (4, big, "w"), (5, "z" * 5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in tokencount.count_tokens(docs, JSON, chunk=2000, overlap=64).collect()}
    assert got == {(a, len((t or "").encode())): len(lib.encode(t or "", add_special_tokens=False).ids) for a, t, _ in rows}
    assert tokencount.count_tokens(docs, JSON, chunk=2000, overlap=64).count() == len(rows)
    enc = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(enc, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(a), t or "") for a, t, _ in rows)
    for r in enc.collect():
        t = next(t or "" for a, t, _ in rows if a == r.doc_id)
        assert r.ids == own.encode_ordinary(t) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    empty = docs.limit(0)
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0 == tokencount.count_tokens(empty, JSON).count()
