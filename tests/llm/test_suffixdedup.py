import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quillspark.llm import suffixdedup


def brute(rows):
    out = []
    for d, t in rows:
        b = (t or "").encode()
        place = (d is None, d or 0)
        earlier = {x[i : i + 50] for e, u in rows if (e is None, e or 0) < place for x in [(u or "").encode()] for i in range(len(x) - 49)}
        mark = bytearray(len(b))
        for i in range(len(b) - 49):
            if b[i : i + 50] in earlier:
                mark[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((str(d), len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out)


def test_like_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))
    pool = [" ".join(word() for _ in range(n)) for n in (12, 15, 20, 25, 40, 80)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.5 else word() for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    rows += [(100, "a" * 300), (101, "a" * 49), (102, "a" * 50 + "b" + "a" * 60), (103, None), (104, ""), (None, rows[0][1]), (None, "zq" * 40), (5, rows[5][1]), (5, "x" + rows[5][1]), (2**50, rows[3][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, d int")
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(d, buckets=8).collect()) == brute(rows)


def test_empty(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_in_a_row_are_one_row(spark, monkeypatch):
    """Pass 4 sends and returns stretches, not windows, also where the bitmaps are full."""
    monkeypatch.setattr(suffixdedup, "MAX_BITS", 1 << 15)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passages = [" ".join(word() for _ in range(12)) for _ in range(20)]
    rows = [(i, f"{word()} {passages[i % 20]} {word()} {passages[(i * 7 + i // 20) % 20]} {word()}") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixdedup.repeated_windows(suffixdedup._documents(d), 8).collect()
    windows = [(r.d, k) for r in found for k in range(r.s, r.s + r.n)]
    assert len(set(windows)) > 2000 and len(windows) > 5 * len(found)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(d, buckets=8).collect()) == brute(rows)


def peak(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_memory_of_runs():
    """Finding runs takes a few times the memory of the texts."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefgh ", k=40_000)) for _ in range(50)] + [""] * 300
    found = suffixdedup.Texts(pa.array(texts)).runs()
    assert peak(lambda: suffixdedup.Texts(pa.array(texts)).runs()) < 12 * sum(map(len, texts))
    assert (found[2] > found[1]).all() and (found[2] - found[1]).sum() == 50 * (40_000 - 49) and set(found[0].tolist()) == set(range(50))


def test_memory_of_a_task(monkeypatch):
    """Flushed rows aren't held while the next come together; rows go to Spark in batches of a few buckets each."""
    monkeypatch.setattr(suffixdedup, "HELD", 400_000)
    monkeypatch.setattr(suffixdedup, "SENT", 1 << 12)
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array(["x"])], ["d", "t", "text"])
    sums, sizes = [0, 0], []

    def flush(cols):
        for out, _ in suffixdedup._blobs(cols[0] % 100, cols, ["<i8"]):
            sums[1] += int(suffixdedup._column(pa.table(out), 0, "<i8").sum())
            sizes.append(out.nbytes)
            yield out

    def rows(texts, d, t):
        out = np.arange(100_000) * (len(sizes) + 1)
        sums[0] += int(out.sum())
        return [out]

    def task():
        for _ in suffixdedup._held(iter([batch] * 14), rows, flush):
            pass

    assert peak(task) < 5.5 * 8 * 400_000
    assert sums[0] == sums[1] and max(sizes) < 200_000
