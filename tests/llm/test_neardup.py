import itertools
import random

from quillspark.llm import neardup
from quillspark.llm.graph import components


def sets_of(text, size):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    k = min(len(ws), size)
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def brute(rows, size, percent=80):
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
    return ws


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 6)  # so that large nodes, hubs and blocks are met
    monkeypatch.setattr(neardup, "BLOCK", 10)
    monkeypatch.setattr(neardup, "FEW", 0)
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 60))) for i in range(60)]
    for g in range(3):
        base = words(rng, 160)
        rows += [(100 + 60 * g + i, " ".join(edited(rng, base, rng.randrange(8)))) for i in range(45)]
    common = words(rng, 50)  # a passage that documents share which are not alike
    rows += [(700 + i, " ".join(common + words(rng, 60))) for i in range(40)]
    chain = words(rng, 100)
    for i in range(12):
        chain = chain[3:] + words(rng, 3)
        rows.append((400 - i, " ".join(chain)))
    same = " ".join(words(rng, 40))
    rows += [(500 + i, same.upper() if i % 2 else same) for i in range(20)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "one"), (604, "one"), (605, "ONE two"), (None, same), (None, None), (500, same), (606, "É a b c d"), (607, "é a b c d")]
    d = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, class string")
    assert got(neardup.near_duplicates(d, size=4)) == brute(rows, 4)


def test_empty_and_unique(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert got(neardup.near_duplicates(d)) == [("1", 2, "1"), ("2", 2, "2")]
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert all(roots[i] == (0 if i <= 30 else 31) for i in range(61)) and all(roots[100 + i] == 100 for i in range(50))


def loose_copies(seed, n):
    """Copies with so many edits each that their signatures seldom agree, and some more in pairs."""
    rng = random.Random(seed)
    base = words(rng, 60)
    rows = []
    for i in range(n):
        ws = edited(rng, base, rng.randrange(2, 14))
        rows.append((2 * i, " ".join(ws)))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join(edited(rng, ws, 1))))
    return rows


def test_loose_copies_are_not_dealt_as_rows(spark, monkeypatch):
    descents = []
    descend = neardup._descend
    monkeypatch.setattr(neardup, "_descend", lambda *a: descents.append(1) or descend(*a))
    monkeypatch.setattr(neardup, "FEW", 0)
    rows = loose_copies(7, 250)
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4)) == brute(rows, 4)
    assert not descents  # each copy of a level doubled the rows


def test_nodes_too_large_for_a_task(spark, monkeypatch):
    for name, value in (("SMALL", 6), ("BLOCK", 10), ("FEW", 0), ("LOCAL", 40)):
        monkeypatch.setattr(neardup, name, value)
    descents = []
    descend = neardup._descend
    monkeypatch.setattr(neardup, "_descend", lambda *a: descents.append(1) or descend(*a))
    rows = loose_copies(8, 120)
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4)) == brute(rows, 4)
    assert descents
