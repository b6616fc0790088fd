import json
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search as S
from quillspark.plans import queries as P
from quillspark.plans.engine import Engine
from quillspark.sources import files


def doc(topic, **more):
    return {"uri": f"https://h.example/{topic.replace(' ', '-')}", "title": topic.title(), "content": f"# {topic.title()}\n\nAll about {topic}, with an example for the {topic.split()[0]} command.\n", **more}


CASES = [
    {"id": "string", "query": "read replicas", "source": "Second", "mode": "hybrid", "limit": 5, "max_rank": 2, "expected": {"uri_contains": "read-replicas", "terms": ["replicas"]}},
    {"id": "list", "query": "branch restore command", "limit": 5, "expected": {"uri_contains": ["absent", "branch-restore"], "terms": "branch"}},
    {"id": "elsewhere", "query": "read replicas", "source": "first", "expected": {"uri_contains": ["read-replicas"]}},
    {"id": "blank", "query": " ", "expected": {}},
]


def test_sets_with_their_own_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"name": "one", "source": {"id": "only", "kind": "web"}, "documents": [doc("read replicas"), doc("branch restore")], "cases": [{**c, "source": None} for c in CASES]}))
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "b.md").write_text("# Branch Restore\n\nThe branch restore command.\n")
    several = {"name": "two", "sources": [{"id": "first", "location": "notes", "documents": [{"path": "notes/b.md", "uri_root": "branch-restore"}]}, {"id": "x2", "name": "Second", "documents": []}], "documents": [doc("read replicas", source="Second"), doc("connection pooling", source_id="x2")], "cases": CASES}
    (tmp_path / "two.json").write_text(json.dumps(several))
    e = Engine(spark, str(tmp_path / "store"))
    r = e.evaluate(str(tmp_path / "one.json")).first()
    assert (r.cases, r.passed) == (3, 3) and r.mrr > 0
    asked, found = e.evaluated(str(tmp_path / "two.json"))
    first = {x.case_id: x.rank for x in found.filter("matches").groupBy("case_id").agg(F.min("rank").alias("rank")).collect()}
    assert first.keys() == {"string", "list"} and first["string"] <= 2 and {x.case_id for x in asked.filter("asked").collect()} == {"string", "list", "elsewhere"}
    told = files.evaluation_set(spark, str(tmp_path / "two.json"))
    assert {(x.key, x.uri) for x in told.documents.collect()} == {("first", "branch-restore/b.md"), ("x2", "https://h.example/read-replicas"), ("x2", "https://h.example/connection-pooling")}


def test_what_is_wrong_with_a_set(spark, tmp_path):
    bad = {"sources": [{"id": "a", "name": "same"}, {"id": "b", "name": "same"}, {"id": "c"}], "documents": [doc("one"), doc("two", source="nowhere"), doc("three", source="c"), {"uri": "u", "source": "c"}, {"path": "gone.md", "source": "c"}], "cases": CASES}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    wrong = {(r.problem, r.place) for r in files.evaluation_set(spark, str(tmp_path / "bad.json")).problems.collect()}
    assert wrong == {
        ("duplicate source alias", "same"),
        ("names none of several sources", "documents[1]"),
        ("unknown source", "documents[2] nowhere"),
        ("neither path nor uri, title and content", "documents[4]"),
        ("no such file", "documents[5] gone.md"),
        ("source without documents", "a"),
        ("source without documents", "b"),
    }
    with pytest.raises(ValueError, match="duplicate source alias: same"):
        Engine(spark, str(tmp_path / "store")).evaluate(str(tmp_path / "bad.json"))
    (tmp_path / "none.json").write_text('{"cases": []}')
    with pytest.raises(ValueError, match="no cases"):
        files.evaluation_cases(spark, str(tmp_path / "none.json"))


def test_many_queries_like_one_by_one(spark):
    texts = ["alpha beta web_socket gamma", "beta beta delta", "web socket alone", "alpha alpha beta", "gamma web_socket", "nothing here", "delta gamma alpha"]
    c = spark.createDataFrame([(i, f"s{i % 2}", i // 2, t) for i, t in enumerate(texts)], "chunk_id long, source_id string, document_id long, content string")
    v = spark.createDataFrame([(i, f"s{i % 2}", [float(i % 3), float(i)]) for i in range(7)] + [(99, "s0", [1.0])], "chunk_id long, source_id string, embedding array<float>")
    p, n = S.postings(c), S.lengths(c)
    asked = [("k", "web_socket beta", [1.0, 2.0], "keyword", 3, None), ("v", "alpha", [0.5, 4.0], "vector", 2, None), ("h", "beta gamma beta", [2.0, 1.0], "hybrid", 4, ["s1"]), ("n", "?!", [1.0, 1.0], "hybrid", 3, None), ("e", "alpha", [1.0, 1.0], "hybrid", 3, []), ("o", "Alpha DELTA", [1.0], "hybrid", 2, None)]
    q = spark.createDataFrame(asked, "query_id string, query string, q array<float>, mode string, limit int, source_ids array<string>")
    rows = S.search_many(c, p, n, v, q).orderBy("query_id", "rank").collect()
    for key, text, at, mode, limit, only in asked:
        want = S.search(c, p, n, v, text, F.array(*map(F.lit, at)), limit, mode, only).collect()
        got = [r for r in rows if r.query_id == key]
        assert [(r.chunk_id, r.document_id) for r in got] == [(r.chunk_id, r.document_id) for r in want]
        for a, b in zip(got, want, strict=True):
            assert max(abs(a[k] - b[k]) for k in ("score", "keyword_score", "vector_score")) < 1e-9


def test_scores_stay_with_their_chunk(spark, monkeypatch, capsys):
    """Sums of query and chunk need no shuffle of their own, each task sends its best only; phrases too many to send give the same."""
    c = spark.createDataFrame([(i, "s", i, f"alpha w{i % 3} web_socket w{i % 5}") for i in range(60)], "chunk_id long, source_id string, document_id long, content string")
    q = spark.createDataFrame([(i, f"alpha w{i} web_socket", None, "keyword", i + 1, None) for i in range(4)], "query_id long, query string, q array<float>, mode string, limit int, source_ids array<string>")
    p, n = S.postings(c), S.lengths(c)
    S.bm25_many(p, n, q).explain()
    assert not re.search(r"hashpartitioning\((query_id|key)#\d+L?, (query_id|chunk_id)", capsys.readouterr().out)
    sent = S.search_many(c, p, n, None, q)
    sent.explain()
    plan = capsys.readouterr().out
    assert re.search(r"WindowGroupLimit \[query_id#\d+L\], \[bm25#.*24, Partial", plan)
    monkeypatch.setattr(S, "PHRASES_SENT", 0)
    rows = sorted(sent.collect())
    assert rows == sorted(S.search_many(c, p, n, None, q).collect()) and [sum(r.query_id == i for r in rows) for i in range(4)] == [1, 2, 3, 4]


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(S, "VECTORS_A_BLOCK", 7)
    monkeypatch.setattr(S, "QUERIES_A_BLOCK", 3)
    v = spark.createDataFrame([(i, "s", [float(i * 7 % 31), float(i % 5)]) for i in range(40)], "chunk_id long, source_id string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 1.0], None) for i in range(8)], "query_id long, q array<float>, source_ids array<string>")
    got = {(r.query_id, r.vector_rank): r.chunk_id for r in S.vector_candidates_many(v, q, 5).collect()}
    for i in range(8):
        want = [r.chunk_id for r in S.vector_candidates(v, F.array(F.lit(float(i)), F.lit(1.0)), 5).orderBy("vector_rank").collect()]
        assert [got[i, k + 1] for k in range(5)] == want


def test_texts_stay_where_they_are(spark, capsys):
    """The results of a set's cases, a few each, go to the texts, not all texts to the results."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.createDataFrame([(i, "alpha beta", "s", "en") for i in range(9)], "doc_id long, text string, source string, lang string").write.parquet(f"{(top := tempfile.mkdtemp())}/documents.parquet")
        spark.createDataFrame([(1, "alpha"), (2, "gamma")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
        found = P.QUERIES["evaluate_many"](spark, top)
        found.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"BroadcastHashJoin \[chunk_id#\d+L?\]", capsys.readouterr().out)
    assert [tuple(r) for r in found.collect()] == [(2, 1, 0.5, 0.5)]
