import itertools
import random
import re
from collections import Counter

import numpy as np

from quillspark.llm import phrases


def brute(rows, least, percent, top):
    n, f = Counter(), {}
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        rows_ = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), p, counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, text, _, x, y) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, text.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 300)  # several shards a task
    rng = random.Random(2)
    common = ["Alpha", "beta", "Gamma", "delta", "é", "x\x1cy", "a\tb"]
    rows = []
    for i in range(160):
        ws = [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))]
        if i % 3 == 0:
            ws += "in the long run we all".split()
        rows.append((rng.choice(["en", "de", None]), "".join(w + rng.choice([" ", " ", "  ", ". ", ",", "\n", "\v", "\t"]) for w in ws)))
    rows += [("en", None), ("en", ""), (None, " . "), ("fr", "once only"), ("en", "beta gamma " * 400)] + [("es", "same row again")] * 40
    d = spark.createDataFrame([(lang, t, 1, "z") for lang, t in rows], "lang string, text string, word int, n string").repartition(3)
    assert got(phrases.collocations(d, least=6, top=50)) == brute(rows, 6, 80, 50)
    assert got(phrases.collocations(d, least=6, percent=30)) == brute(rows, 6, 30, 2000)
    assert phrases.collocations(d.limit(0)).count() == 0


def test_full_bitmaps_lose_nothing(spark, monkeypatch):
    rows = [("en", " ".join(random.Random(i).choices("abcdef", k=50))) for i in range(30)]
    d = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "_told", lambda keys: b"\xff" * 1024)
    assert got(phrases.collocations(d, least=5)) == brute(rows, 5, 80, 2000)


def test_index_extends_both_ways():
    rng = np.random.default_rng(3)
    text = np.concatenate([[0], rng.integers(0, 6, 3000), [0]]).astype(np.int32)
    index = phrases.Index.of(text, 6)
    grams = [Counter(w for w in zip(*(text[i:].tolist() for i in range(k)), strict=False) if 0 not in w) for k in (1, 2, 3, 4)]
    for sides in itertools.product((0, 1), repeat=3):
        words = np.arange(1, 6)
        found, state = [(int(w),) for w in words], index.words(words)
        for k, side in enumerate(sides):
            of, symbol, state = index.extend(state, side)
            found = [(int(c), *found[o]) if side == 0 else (*found[o], int(c)) for o, c in zip(of, symbol, strict=True)]
            assert dict(zip(found, state[2].tolist(), strict=True)) == dict(grams[k + 1])


def test_shards_lie_in_small_row_groups(spark, monkeypatch):
    """A task holds a row group of shards in memory, not all shards of a file."""
    import glob

    import pyarrow.parquet as pq

    from quillspark.llm import common, phrases

    monkeypatch.setattr(phrases, "SHARD_WORDS", 2000)
    monkeypatch.setitem(common.LARGE_ROWS, "parquet.block.size", "40000")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    docs = spark.createDataFrame([("x", " ".join(f"w{(i * k) % 997}" for k in range(400))) for i in range(100)], "lang string, text string").coalesce(1)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows)
    spark.conf.set(rows, "5")
    phrases.frequent_phrases(docs)
    spark.conf.set(rows, usual)
    files = [pq.ParquetFile(f) for d in set(glob.glob(f"{folder}/*")) - before for f in glob.glob(f"{d}/*.parquet")]
    shards = [f.metadata for f in files if "bwt" in f.schema.names]
    assert sum(m.num_rows for m in shards) >= 15
    assert max(m.row_group(i).num_rows for m in shards for i in range(m.num_row_groups)) <= 5
