import itertools
import random

import numpy as np
import pytest

from quillspark.llm import sigtree
from tests.llm.test_neardup import brute, edited, got, words


def corpus(rng):
    rows = [(i, " ".join(words(rng, rng.randrange(5, 90)))) for i in range(60)]
    for g in range(3):
        base = words(rng, 160)
        rows += [(100 + 60 * g + i, " ".join(edited(rng, base, rng.randrange(5)))) for i in range(45)]
    common = words(rng, 50)  # a passage that documents share which are not alike
    rows += [(700 + i, " ".join(common + words(rng, 60))) for i in range(40)]
    chain = words(rng, 100)
    for i in range(12):
        chain = chain[2:] + words(rng, 2)
        rows.append((400 - i, " ".join(chain)))
    longer = words(rng, 30)
    for i in range(40):
        longer += words(rng, 1 + len(longer) // 12)
        rows.append((800 - i, " ".join(longer)))
        if len(longer) > 600:
            break
    same = " ".join(words(rng, 40))
    rows += [(500 + i, same.upper() if i % 2 else same) for i in range(20)]
    return rows + [(600, None), (601, ""), (602, " \t\n"), (603, "one"), (604, "one"), (605, "ONE two"), (None, same), (None, None), (500, same), (606, "É a b c d"), (607, "é a b c d"), (608, "a b c d e f g h"), (609, "a b c d e f g h i"), (610, "a b c d e f g h i j")]


@pytest.mark.parametrize("cap", [1 << 19, 900])
def test_like_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(sigtree, "CAP", cap)  # so that components are dealt to blocks and met through the distributed tree
    monkeypatch.setattr(sigtree, "FANOUT", 3)
    rows = corpus(random.Random(4))
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, class string, n int").repartition(3)
    assert got(sigtree.jaccard_components(d, size=4, percent=85)) == brute(rows, 4, 85)


def test_empty_unique_and_very_long(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert got(sigtree.jaccard_components(d)) == [("1", 2, "1"), ("2", 2, "2")]
    assert sigtree.jaccard_components(d.limit(0)).count() == 0
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(2, " ".join(base)), (1, " ".join(edited(rng, base, 2_000))), (3, " ".join(edited(rng, base, 9_000)))]
    assert got(sigtree.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 5)


def test_front_shingles_are_shared():
    rng = np.random.default_rng(1)
    counters = rng.integers(0, 4, sigtree.COUNTERS).astype(np.uint32)
    for n in range(1, 120):
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for lost in range(n):
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, rng.integers(0, 1 + n // 6), np.uint64)]))
            if sigtree.alike(a, b, 85):
                assert np.intersect1d(sigtree.front(a, counters, 85), sigtree.front(b, counters, 85)).size >= max(sigtree.evidence(len(x), 85) for x in (a, b))


def test_trees_in_small_slices(monkeypatch):
    monkeypatch.setattr(sigtree, "AT_ONCE", 5)
    monkeypatch.setattr(sigtree, "WORDS_AT_ONCE", 40)
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 2**63, rng.integers(4, 120), np.uint64))
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 2**63, 1, np.uint64)])) for _ in range(4)]
    up = list(range(len(sets)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sigtree.alike(sets[i], sets[j], 80):
            up[find(i)] = find(j)
    parts = sigtree.Parts(list(range(len(sets))))
    for i, j in sigtree.solve(sets, list(range(len(sets))), 80):
        assert sigtree.alike(sets[i], sets[j], 80)
        parts.link(i, j)
    pairs = list(itertools.combinations(range(len(sets)), 2))
    assert [parts.find(i) == parts.find(j) for i, j in pairs] == [find(i) == find(j) for i, j in pairs]


def test_bounds_leave_out_most_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 100, np.uint64)) for _ in range(256)]
    own, sizes = np.arange(256), np.array([len(s) for s in sets])
    tree = sigtree._tree(sets, sizes, own, 16 * 100 // 64)
    none = [np.full(len(x[0]), -1) for x in tree]
    assert sum(map(len, sigtree._traverse(tree, tree, lambda: (none, none), 85))) == 0
