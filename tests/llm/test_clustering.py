import hashlib
import math
import random

import numpy as np

from quillspark.llm import clustering


def brute(rows, k, rounds, dims, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [q for _, q in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((dist(q, c), j) for j, c in enumerate(centres)) for _, q in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            own = [q for (_, q), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    most = lambda x: min(x, 2**63 - 1)
    at = [(most(d), c) for d, c in assign()]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), c, d, most(sum(x for x, y in at if y == c)), most(sum(x for x, _ in at)), sha[c]) for (i, _), (d, c) in zip(kept, at, strict=True))


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


SCHEMA = "vec_id long, embedding array<double>, cluster string, far int"


def test_like_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 4, 0.7) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(400, 430)] + [(7, rows[7][1])] * 5 + [(None, [1.0] * 6), (None, None), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0] * 5), (905, [])]
    d = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA).repartition(5)
    assert got(clustering.cluster(d, k=5, rounds=4, dims=6)) == brute(rows, 5, 4, 6)
    few = d.filter("vec_id in (1, 2)")
    assert got(clustering.cluster(few, k=5, rounds=2, dims=6)) == brute([r for r in rows if r[0] in (1, 2)], 5, 2, 6)
    assert clustering.cluster(d.limit(0), dims=6).count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0**rng.randrange(15) * 1e4 for _ in range(4)]) for i in range(40)]
    d = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA)
    assert got(clustering.cluster(d, k=3, rounds=3, dims=4)) == brute(rows, 3, 3, 4)


def test_ties_go_to_the_smaller_number_and_bounds_prune():
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [10, 0], [0, 0], [4000, 0]], np.int64)
    x = np.concatenate([np.array([[5, 0], [0, 0], [7, 1]]), rng.integers(3990, 4010, (500, 2)) * [1, 0]]).astype(np.int64)
    pivots = np.array([[0, 0], [4000, 10]], np.int64)
    cluster, d, measured = clustering.nearest(x, clustering.roots(x, pivots), centres, clustering.roots(centres, pivots))
    assert cluster[:3].tolist() == [0, 0, 1] and d[:3].tolist() == [25, 0, 10]
    assert (cluster[3:] == 3).all() and measured < 520  # four each without bounds
    huge = np.array([[2**62, 0], [-(2**62), 5]], np.int64)
    assert clustering.squares(huge, huge[::-1]).tolist() == [2**126 + 25] * 2
