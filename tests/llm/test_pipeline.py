import hashlib
import random

import corpus_pipeline
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_groups


def corpus(spark):
    rng = random.Random(6)
    tongues = {"en": "the and of with that this from have been were their which would", "fr": "le la les des une dans pour qui avec sur être mais nous vous"}
    line = lambda w, n: " ".join(rng.choice(tongues[w].split()) + rng.choice("abcdefghij") * rng.randrange(3) for _ in range(n))
    rows = []
    for i in range(120):
        w = ("en", "fr")[i % 2]
        rows.append((i, "\n".join(line(w, 14) for _ in range(3)), w, f"s{i % 5}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(5)]
    base = line("en", 120).split()
    for i in range(6):
        ws = list(base)
        ws[rng.randrange(120)] = "changed"
        rows.append((300 + i, " ".join(ws[: 60 + i]) + "\n" + " ".join(ws), "en", None))
    rows += [(400, None, "en", "s1"), (401, "12 34", "fr", "s2"), (402, "", None, None), (403, line("fr", 30), None, "s3")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_one_by_one(spark):
    docs = corpus(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    told = stages["language ID"](spark, docs, "").cache()
    assert told.columns == docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id: r for r in told.collect()}
    assert set(before) - set(kept) == {400, 401, 402} and kept[403].lang == "fr"

    lined = stages["line dedup"](spark, told, "").cache()
    want = {int(d): t for d, _, n, t in brute_lines([(r.doc_id, r.text) for r in told.collect()]) if not n or t.strip()}
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = stages["MinHash near-dedup"](spark, lined, "").cache()
    groups = brute_groups([(r.doc_id, r.text) for r in lined.collect()], 5)
    assert {r.doc_id for r in single.collect()} == {int(d) for d, _, c in groups if d == c} and single.columns == docs.columns

    mixed = stages["mixing sources to target weights"](spark, single, "").cache()
    assert mixed.columns == docs.columns and {r.doc_id: r.text for r in mixed.collect()}.items() <= {r.doc_id: r.text for r in single.collect()}.items()

    from pyspark.sql import functions as F

    from quillspark.llm import mixing
    from quillspark.llm.common import count_words, written

    plan = mixing.assign_positions(single, mixing.ranked_schedule(single)).cache()
    words = {r.source: (r.n, r.longest) for r in mixed.groupBy("source").agg(F.sum(count_words(F.col("text"))).alias("n"), F.max(count_words(F.col("text"))).alias("longest")).collect()}
    for r in plan.select("source", "target").distinct().collect():
        assert abs(words[r.source][0] - r.target) <= words[r.source][1] / 2 + 1
    due = [(o.position, r.source is None, r.source or "", r.doc_id) for r in plan.collect() for o in r.occurrences if 2 * o.words >= r.size]
    encoded = stages["byte-level BPE encoding and decoding"](spark, written(mixed.coalesce(2)), "").collect()
    order = [r.doc_id for r in sorted(encoded, key=lambda r: (r.part, r.row))]
    assert order == [r.doc_id for r in mixed.collect()] == [d for *_, d in sorted(due)]

    last = stages["byte-level BPE encoding and decoding"](spark, mixed, "").collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(last) == mixed.count() and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_run(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
    corpus(spark).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
