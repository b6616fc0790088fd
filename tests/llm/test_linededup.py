import random

import pytest

from quillspark.llm import linededup


def within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, exact=10, edit=20):
    places = [((d is None, d or 0, no), s) for d, t in rows for no, s in enumerate((t or "").split("\n"))]
    out = []
    for d, t in rows:
        kept = []
        lines = (t or "").split("\n")
        for no, s in enumerate(lines):
            at = (d is None, d or 0, no)
            same = lambda o: o == s and len(s) >= exact or len(s) >= edit and len(o) >= edit and within_one(o, s)  # noqa: B023, E731
            if not any(p < at and same(o) for p, o in places):
                kept.append(s)
        out.append((str(d), len(lines) if t else 0, (len(lines) if t else 0) - len(kept) if t else 0, "\n".join(kept) if t is not None and len(kept) < len(lines) else t))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([9, 10, 19, 20, 21, 33, 64, 150]))) for _ in range(60)]

    def edit(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice([s, s[:i] + rng.choice("abé") + s[i:], s[:i] + s[i + 1 :], s[:i] + "z" + s[i + 1 :], s[:i] + "zz" + s[i:], s[:i] + "q" + s[i + 1 :]])

    rows = [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randrange(1, 7)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, base[3] + "\nanother line of its own"), (None, base[5]), (3, rows[3][1]), (203, "x" * 500), (204, "x" * 499 + "\n" + "x" * 501)]
    d = spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, line string, n_lines int, N_removed int, _gone int, _d int, copy int")
    got = linededup.dedup_lines(d)
    assert got.columns == ["doc_id", "text", "line", "_gone", "_d", "copy", "n_lines", "n_removed"]
    assert {tuple(r) for r in got.select("line", "_gone", "_d", "copy").distinct().collect()} == {("k", 3, 4, 5)}
    assert sorted(((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in got.collect()), key=str) == brute(rows)


def test_floors(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join("".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_exact=1, min_edit=4)
    assert sorted(((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in got.collect()), key=str) == brute(rows, 1, 4)
    with pytest.raises(ValueError, match="min_edit"):
        linededup.dedup_lines(got, min_edit=3)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(d).count() == 0
