import hashlib

from pyspark.sql import functions as F

from quillspark.llm import fingerprint as fp
from quillspark.llm.queries import op3_fingerprints


def test_homomorphic(spark):
    texts = ["One here. Two there, and three\nfour", "and three\nTwo there,\nfour\nOne here.", "five\nsix", "One here. Two there, and three\nfour\nfive\nsix", ""]
    v = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fp.vector(F.col("t")).alias("v"))
    a, b, c, d, e = (v.filter(F.col("i") == i).select(F.col("v").alias(f"v{i}")) for i in range(5))
    row = a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)
    r = row.select(F.col("v0") == F.col("v1"), fp.added(F.col("v0"), F.col("v2")) == F.col("v3"), fp.removed(F.col("v3"), F.col("v2")) == F.col("v0"), fp.removed(F.col("v0"), F.col("v1")) == F.col("v4"), fp.likeness(F.col("v0"), F.col("v1")), fp.likeness(F.col("v0"), F.col("v4")), fp.likeness(F.col("v0"), F.col("v3"))).first()
    assert tuple(r[:4]) == (True,) * 4 and r[4] == 1 and r[5] == 0 and 0.5 < r[6] < 1


def test_query_rows(spark, tmp_path):
    text = lambda i: ". ".join(f"Sentence {i} {k} of it" for k in range(i % 40))
    rows = [(3 * i, text(i)) for i in range(1, 200)] + [(1, None), (2, ""), (None, "é" * 7), (4, "x"), (2**50, text(77))]
    rows += [(9, rows[2][1]), (9, rows[2][1])]
    spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, vector string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None]
    texts = {i: t or "" for i, t in rows}
    following = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    seen = {}
    for r in got:
        t, n = texts[r.doc_id], len(texts[r.doc_id])
        edited = t[: n - n // 2] + texts[following[r.doc_id]][: n // 2]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for s, f in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert seen.setdefault(s, f) == f
    assert len(set(seen.values())) > 0.9 * len(seen)
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_fingerprints(spark, str(tmp_path)).count() == 0


def test_likeness_of_unlike_texts(spark):
    text = lambda i: "\n".join(f"paragraph {i} {k}" for k in range(20))
    v = spark.createDataFrame([(text(i), text(i + 1000)) for i in range(600)], "a string, b string").select(fp.vector(F.col("a")).alias("a"), fp.vector(F.col("b")).alias("b"))
    got = [r[0] for r in v.select(fp.likeness(F.col("a"), F.col("b"))).collect()]
    assert sum(x > 0.2 for x in got) < 0.03 * len(got)  # 0.012 expected of 126 counters, 0.056 of 63
    assert (2 * sum(x * x for x in got) / len(got)) ** 0.5 < 0.1


def test_counters_have_all_their_bits(spark):
    lanes = [0] * fp.EXACT + [1 << 20] + [(1 << 20) << 42] * fp.SKETCH
    most = [0] * fp.EXACT + [1] + [(1 << 63) - 1] * fp.SKETCH
    v = spark.createDataFrame([(lanes, most, [0] * len(lanes))], "a array<long>, b array<long>, zero array<long>")
    back = fp.removed(fp.added(F.col("b"), F.col("b")), F.col("b"))
    r = v.select(fp.added(F.col("a"), F.col("zero")).alias("a"), back.alias("b")).first()
    assert r.a == lanes and r.b == most


def test_vectors_survive_the_shuffle(spark):
    texts = [""] + ["\n".join(f"{n} line {k % 90}" for k in range(n)) for n in (1, 5, 126, 127, 128, 129, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.v for r in docs.select("doc_id", fp.vector(F.col("text")).alias("v")).collect()}
    got = fp.fingerprints(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.vector == want[r.doc_id] and r.next_sketch == want[(r.doc_id - 1) % len(texts)][fp.EXACT :]


def plain(text):
    """The fingerprint in plain Python: exact lanes, number of paragraphs, counters of hash bits."""
    import re
    import struct

    import xxhash

    own = [p for p in re.split(fp.PARAGRAPH_END, text) if p]
    hashes = [[xxhash.xxh64_intdigest(p.encode(), seed=xxhash.xxh64_intdigest(struct.pack("<i", k), seed=42)) for p in own] for k in range(fp.SEEDS)]
    exact = [sum(half(h) for h in hs) % 2**32 for hs in hashes for half in (lambda h: h % 2**32, lambda h: h >> 32)]
    counters = [[sum(h >> (j + 21 * f) & 1 for h in hashes[k]) for f in range(3)] for k in range(fp.SKETCHES) for j in range(21)]
    string = "".join(f"{x:08x}" for x in exact) + f"-{len(own)}-" + "".join(f"{a + (b << 21) + (c << 42):016x}" for a, b, c in counters)
    return string, [2 * c - len(own) for f in range(3) for c in (x[f] for x in counters)]


def cosine(x, y):
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    norm = (dot(x, x) * dot(y, y)) ** 0.5
    return min(1.0, max(0.0, dot(x, y) / norm)) if norm else 0.0


def test_query_like_plain_python(spark, tmp_path):
    from quillspark.llm.queries import op3_fingerprints

    texts = ["One here. Two, three; four.\nFive", None, "", "Two, three; four. And six. " * 200, "One here. Two, three; four.\nFive", "é. ü. \r\n x"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_fingerprints(spark, str(tmp_path)).collect()}
    for i, t in rows:
        t, after = t or "", texts[(i - 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        (own, x), (changed, y), (then, z) = plain(t), plain(edited), plain(after)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, changed)
        assert abs(got[i].near_edited - (1.0 if own == changed else cosine(x, y))) < 1e-9
        assert abs(got[i].near_next - (1.0 if own == then else cosine(x, z))) < 1e-9
    both = spark.createDataFrame([(got[0].fingerprint, got[0].edited_fingerprint)], "a string, b string").select(fp.likeness(fp.vector_of(F.col("a")), fp.vector_of(F.col("b"))).alias("x"), fp.digest(fp.vector_of(F.col("a"))).alias("a")).first()
    assert abs(both.x - got[0].near_edited) < 1e-9 and both.a == got[0].fingerprint
