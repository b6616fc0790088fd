from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm import mixing


def fill(sizes, weights, share=1.5, times=2):
    """Targets by repeated clipping."""
    budget, target, open_ = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = budget - sum(target[s] for s in sizes if s not in open_)
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > times * sizes[s]}
        for s in open_:
            target[s] = times * sizes[s] if s in full else weights[s] * level
        if not full:
            break
        open_ -= full
    return target


def docs(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), f"s{i % 3}" if i % 11 else None, "q") for i in range(300)] + [(None, None, "s1", None), (7, "twice here", "s0", "a"), (7, "twice here", "s0", "a"), (1000, "", "empty source", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_targets_and_takes(spark):
    d = docs(spark)
    rows = mixing.assign_positions(d, mixing.ranked_schedule(d)).collect()
    assert len(rows) == d.count()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights)
    taken = defaultdict(int)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert sum(o.words for o in r.occurrences) == r.taken and all(0 <= o.position <= 1 for o in r.occurrences)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1.001 for s in sizes)


def test_positions_follow_schedule(spark):
    d = spark.createDataFrame([(i, "a b c d", f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    knots = spark.sql("select 's0' as source, array(named_struct('t', 0d, 'w', 2d), named_struct('t', 1d, 'w', 0d)) as knots union all select 's1', array(named_struct('t', 0d, 'w', 0d), named_struct('t', 0.5d, 'w', 0d), named_struct('t', 1d, 'w', 4d))")
    order = mixing.training_order(mixing.assign_positions(d, knots, share=1.0)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    early = [r.source for r in order if r.position < 0.5]
    assert early.count("s1") <= 1  # its weight is 0 there
    n = sum(r.source == "s0" for r in order)
    assert abs(early.count("s0") - 0.75 * n) <= 2  # half the time, three quarters of a falling weight


def test_mixed_documents_and_empty(spark):
    d = docs(spark)
    out = mixing.mixed_documents(d, mixing.ranked_schedule(d))
    assert out.columns == d.columns and out.schema == d.schema
    assert out.groupBy("doc_id", "text").count().filter(F.col("count") > 4).count() == 0
    empty = d.limit(0)
    assert mixing.mixed_documents(empty, mixing.ranked_schedule(empty)).count() == 0
    assert mixing.assign_positions(empty, mixing.ranked_schedule(empty)).count() == 0
