import numpy as np

from quillspark.llm import langid


def test_forward_backward_like_enumeration():
    rng = np.random.default_rng(3)
    scores, transitions, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    got = langid.posteriors(scores, starts, transitions, start)
    for a, b in ((0, 4), (4, 7)):
        total = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            s = start[path[0]] + sum(transitions[x, y] for x, y in zip(path, path[1:], strict=False)) + sum(scores[a + i, y] for i, y in enumerate(path))
            for i, y in enumerate(path):
                total[i, y] += np.exp(s)
        assert np.allclose(got[a:b], total / total.sum(1, keepdims=True))


def plain_features(word):
    """Names of a word's features: every n-gram that stands in it, and itself."""
    w = f"^{word}$"
    return [("gram", w[i : i + k]) for k in langid.GRAMS for i in range(len(w) - k + 1)] + [("word", word)]


def test_features_like_plain_ones():
    words = ["a", "banana", "élan", "x" * 400, "nab", "ban", "\U0001f600a"]
    grid, starts = langid.word_grid(words, -1)
    ends = [*starts[1:], len(grid)]
    seen = {}
    for w, a, b in zip(words, starts, ends, strict=True):
        own, names = grid[a:b], plain_features(w)
        assert (own >= 0).sum() == len(names)  # each occurrence, however long the word
        for k in langid.GRAMS:
            for i in range(len(w) + 3 - k):
                assert seen.setdefault(("gram", f"^{w}$"[i : i + k]), own[i, langid.GRAMS.index(k)]) == own[i, langid.GRAMS.index(k)]
        assert seen.setdefault(("word", w), own[0, -1]) == own[0, -1]
    assert len(set(seen.values())) > 0.95 * len(seen)


def test_gradient_like_plain_crf():
    rng = np.random.default_rng(2)
    model = langid.Model(["p", "q"], {"aba": [0], "bb": [0, 1]})
    model.weights[:-1] = rng.normal(size=model.weights[:-1].shape)
    model.transitions, model.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    words, ids, y, new = ["aba", "bb", "cab"], [0, 1, 2, 1, 0], [0, 1, 1, 0, 1], [1, 0, 0, 1, 0]

    def score(labels):
        grid, starts = langid.word_grid(words, len(model.weights) - 1)
        total = 0.0
        for i, (w, l) in enumerate(zip(ids, labels, strict=True)):
            a, b = starts[w], [*starts[1:], len(grid)][w]
            total += model.weights[grid[a:b].ravel(), l].sum(dtype=float) + sum(float(model.weights[langid.BUCKETS + x, l]) for x in model.lexicons.get(words[w], ()))
            total += model.start[l] if new[i] else model.transitions[labels[i - 1], l]
        return total

    def likelihood():
        every = [score(p) for p in np.ndindex(2, 2, 2, 2, 2)]
        return score(y) - max(every) - np.log(np.exp(np.array(every) - max(every)).sum())

    g, gt, gs = langid.gradient_of(model, words, np.array(ids), np.array(y), np.array(new, bool))()
    grid, starts = langid.word_grid(words, len(model.weights) - 1)
    places = [(model.weights, g, (int(grid[i, j]), l)) for i, j, l in ((0, 0, 0), (1, 1, 1), (starts[2], 3, 0))] + [(model.weights, g, (langid.BUCKETS, 1)), (model.transitions, gt, (0, 1)), (model.transitions, gt, (1, 1)), (model.start, gs, (0,))]
    for of, got, at in places:
        was = of[at]
        of[at] = was + 0.01
        up = likelihood()
        of[at] = was - 0.01
        down = likelihood()
        of[at] = was
        assert abs((up - down) / 0.02 - got[at]) < 2e-3


def test_sample_is_bounded_and_whole(spark):
    rows = [(i, "aa " * (i + 1), "xx") for i in range(60)] + [(0, "aa ", "xx")] * 3 + [(7, "twice", "xx"), (None, "no id", "xx")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first, again = langid.sample(d, 5), langid.sample(d.repartition(7), 5)
    assert sorted(first) == sorted(again) and len(first) == 5
    assert {t for _, t in first} <= {t for _, t, _ in rows}


def corpus(spark):
    words = {"xx": "kaza moru tiba sanu pelo gari", "yy": "strengh brught schlock wurdt", "zz": "ouilleau peaux tréau queôn"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[w].split(), 12)), w, "q") for i in range(300) for w in [list(words)[i % 3]]]
    return spark.createDataFrame([*rows, (400, "kaza moru sanu pelo tiba wurdt brught", None, None), (401, None, "xx", None), (402, "12 ² !", "yy", ""), (None, "strengh wurdt schlock", None, ""), (0, rows[0][1], "xx", "q"), (403, "", "zz", "")], "doc_id long, text string, lang string, score string")


def test_identify(spark):
    d = corpus(spark)
    rows = langid.identify(d).collect()
    assert len(rows) == d.count()
    got = {r.doc_id: r for r in rows}
    assert all(got[i].lang_pred == ("xx", "yy", "zz")[i % 3] and got[i].score > 0.9 for i in range(300))
    assert got[400].lang_pred == "xx" and 0.5 < got[400].score < 0.95 and got[None].lang_pred == "yy"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (401, 402, 403))
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.5


def test_empty_and_unlabelled(spark):
    d = corpus(spark)
    assert langid.identify(d.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(d.filter("lang is null")).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    j = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert j.filter("lang = lang_pred").count() > 0.95 * j.count()
