import numpy as np

from quillspark.llm import knn


def brute(rows, every, k):
    good = {(i, tuple(int(np.floor(float(x) * 1024)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, q in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, w, strict=False)), j) for j, w in good if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 60)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(i, rows[10][1]) for i in range(400, 460)] + [(i, rows[3][1]) for i in range(40, 43)]
    rows += [(500, None), (510, [1.0, None]), (520, [float("nan")] * 8), (530, [float("inf")] * 8), (None, [1.0] * 8), (540, []), (550, [1.0, 2.0]), (20, rows[20][1]), (20, rows[20][1])]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in knn.search(d, every=10, pivots=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10, 10)


def test_small_and_empty(spark):
    d = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.search(d).orderBy("rank").collect()] == [(0, 1, 1, 2**21), (0, 2, 2, 2**21)]
    assert knn.search(d.limit(0)).count() == 0 == knn.search(d.filter("vec_id = 1")).count()


def test_large_components():
    a = np.array([[2**40, 5], [-3, 2**62]])
    assert knn.products(a, a).tolist() == [[2**63 - 1, -3 * 2**40 + 5 * 2**62 if -3 * 2**40 + 5 * 2**62 < 2**63 else 2**63 - 1], [2**63 - 1, 2**63 - 1]]


def test_few_cells_are_visited(spark):
    """Clustered vectors: queries go to few cells besides their own, and no vector is sent to a cell that isn't its own."""
    rng = np.random.default_rng(9)
    centres = np.eye(16)
    rows = [(i, (centres[i % 16] + 0.02 * rng.normal(size=16)).tolist()) for i in range(1600)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, more, _ = knn.plan(d, every=10, pivots=48)
    cells = more.select("cell").distinct().count()
    assert more.count() < 0.2 * 160 * 48 and cells <= 48
    assert set(tuple(r) for r in knn.search(d, every=10, pivots=48).collect()) == brute(rows, 10, 10)
