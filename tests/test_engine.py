import json

import pytest

from quillspark.operators.includes import expanded, line_numbers
from quillspark.plans.engine import JOB, Engine
from quillspark.sources import files
from quillspark.streaming.ingest import document_stream


def test_engine(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for i, topic in enumerate(["branching databases", "connection pooling", "autoscaling compute", "read replicas", "point in time restore"]):
        (root / f"p{i}.md").write_text(f"# {topic.title()}\n\nThis page explains {topic} in the product.\n\n## Use\n\nCall the {topic.split()[0]} endpoint.\n\n```js\nconst x = {topic.split()[0]}();\n```\n")
    e = Engine(spark, str(tmp_path / "store"))
    s = e.register("local", "Docs", str(root))
    with pytest.raises(ValueError):
        e.register("local", " docs", "x")
    with pytest.raises(ValueError):
        e.search("pooling", source_id=s)
    e.index_local(s, str(root))
    row = e.sources().first()
    assert (row.status, row.document_count) == ("indexed", 5) and e.jobs().first().status == "succeeded"
    for mode in ("keyword", "vector", "hybrid"):
        found = e.search("connection pooling", limit=5, mode=mode).collect()
        assert found and any("p1.md" in r.uri for r in found)
    assert e.search("pooling endpoint", limit=1).first().summary
    assert e.search("?!").count() == 0
    (tmp_path / "eval.json").write_text(json.dumps({"name": "n", "cases": [{"id": "a", "query": "connection pooling", "limit": 5, "expected": {"uri_contains": ["p1.md"]}}, {"id": "b", "query": " ", "expected": {}}, {"id": "c", "query": "read replicas", "expected": {"terms": ["absent words"]}}]}))
    r = e.evaluate(str(tmp_path / "eval.json")).first()
    assert r.cases == 2 and r.passed == 1 and r.mrr > 0
    w = e.register("web", "Pages", "https://h.example")
    pages = spark.createDataFrame([(1, "https://h.example/en/a", "<article><h1>Web Page</h1><p>About webhooks only.</p></article>"), (2, "https://h.example/de/b", "<p>no</p>")], "page_id long, url string, html string")
    e.index_pages(w, pages, include=["/en/"])
    assert e.search("webhooks", name="pages").first().title == "Web Page"
    assert e.delete(s)["name"] == "Docs" and e.delete("none") is None
    assert {r.source_name for r in e.search("webhooks product", limit=20).collect()} == {"Pages"}


def test_includes(spark):
    assert line_numbers("ln[1] hl[2:3, 9,2]") == [2, 3, 9]
    files = spark.createDataFrame([("/r/code/a.py", "one\ntwo\nthree\n"), ("/r/docs/ex/tabs.tsx", "<T/>"), ("/r/docs/deep/ex/tabs.tsx", "no"), ("/x/secret.py", "no")], "path string, content string")
    docs = spark.createDataFrame([("/r/docs/p.md", 'A {* ../code/a.py hl[2:3] *} B {* ../../x/secret.py *} <ExampleTabs name="group/tabs" /> <ExampleCode name="gone"/>', 1), ("/r/docs/q.md", None, 2)], "uri string, content string, extra int")
    rows = {r.uri: r for r in expanded(docs, files, "/r/docs").collect()}
    text = rows["/r/docs/p.md"].content
    assert "```py\ntwo\nthree\n```" in text and "{* ../../x/secret.py *}" in text and "Example: group/tabs\n\n```tsx\n<T/>\n```" in text and text.endswith("Example: gone")
    assert rows["/r/docs/q.md"].content is None and rows["/r/docs/q.md"].extra == 2


def test_index_again_and_includes(spark, tmp_path):
    root, code = tmp_path / "docs", tmp_path / "code"
    root.mkdir(), code.mkdir()
    (code / "a.py").write_text("one\ntwo\nthree\n")
    (root / "p.md").write_text("# Page\n\nSee {* ../code/a.py hl[2:3] *} and {* ../gone.py *}\n")
    (root / "q.html").write_text("<article><h1>Other</h1><p>About quokkas only.</p></article>")
    e = Engine(spark, str(tmp_path / "store"))
    s = e.register("local", "Docs", str(root))
    d = {r.uri.rpartition("/")[2]: r for r in files.documents(spark, str(root), s).collect()}
    assert "```py\ntwo\nthree\n```" in d["p.md"].content and "{* ../gone.py *}" in d["p.md"].content and d["q.html"].title == "Other"
    stream = document_stream(spark, str(root), s)
    assert stream.isStreaming and stream.columns == ["document_id", "source_id", "uri", "title", "content"]
    e.index_local(s, str(root))
    assert e.sources().first().document_count == 2
    (root / "q.html").unlink()
    e.index_local(s, str(root))
    assert e.sources().first().document_count == 1 and e.search("quokkas", mode="keyword").count() == 0
    (root / "p.md").unlink()
    with pytest.raises(ValueError, match="no documents"):
        e.index_local(s, str(root))
    row = e.sources().first()
    assert (row.status, row.document_count) == ("failed", 0)


def test_guard_cancel_and_settings(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    s = e.register("local", "Docs", "x")
    e._say("jobs", JOB, job_id="old", source_id=s, status="running", message="indexing", progress_current=0, created_at=1.0, updated_at=1.0)
    later = [(f"j{i}", "other", "succeeded", "", 0, None, 2.0 + i, 2.0 + i) for i in range(60)]
    spark.createDataFrame(later, JOB).coalesce(1).write.mode("append").parquet(f"{tmp_path}/store/jobs")
    with pytest.raises(ValueError, match="being indexed"):
        e.index_local(s, "x")
    assert e.cancel(s, stale=True) == ["old"] and e.cancel(s) == []
    assert [r.status for r in e.job_log("old").collect()] == ["running", "cancelled"] and e.sources().first().error == "cancelled"
    e.set_mode("keyword")
    assert Engine(spark, str(tmp_path / "store")).mode == "keyword"
