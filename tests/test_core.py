"""Operators on small literal inputs."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking as C
from quillspark.operators import search as S
from quillspark.operators import store as K
from quillspark.operators.embedding import Embedder, embedded, hashed
from quillspark.operators.evaluate import matches, passages_in, report
from quillspark.sources import files, web
from quillspark.streaming.ingest import ingest, job_events


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_text_kernel(spark):
    assert one(spark, "Ab a x9_y 9z café /p", T.tokens) == ["ab", "x9_y", "caf"]
    assert one(spark, "Café web_socket 12", T.terms) == ["cafe", "web", "socket", "12"]
    assert one(spark, "a  \t \n b ", T.collapse) == "a b"
    assert one(spark, "a\r\nb\u2028c\n", T.lines) == ["a", "b", "c"]
    assert one(spark, "x  \n\n\n\n\ny \n", T.compact) == "x\n\n\ny"
    assert one(spark, "---\ntitle: x\n---\n\n# H\ntext", T.without_front_matter) == "# H\ntext"
    assert one(spark, "intro\n# The title \nx", T.title) == "The title"
    assert one(spark, "https://h.example/a/my-long_page?x=1", T.web_title) == "My Long Page"
    assert one(spark, "https://a.b.example.org/x", T.root_domain) == "example.org"
    assert one(spark, "Table of contents\n- a\n\n- b\ntext stays\n# Head\n![i](x)Copy page\nbody", T.clean_web) == "text stays\n# Head\nbody"
    assert one(spark, "Ask AI\nbody\nWas this page helpful?", T.web_chrome) is True


def test_shaping(spark):
    text = "Intro words here.\n\n# Setup guide\nRun the installer now.\n\n```js\nconst a = install();\n```\n\nConsole\nOther matter."
    d = spark.createDataFrame([(text, ["Guide", "Setup"], "T"), ("nothing", [], " Title ")], "content string, section_path array<string>, title string")
    r = S.shaped(d, "how to use the installer const").collect()
    assert r[0].code == "const a = install();" and "installer" in r[0].excerpt and "Console" not in r[0].excerpt and r[0].summary
    assert r[1].summary == "Title" and r[1].excerpt == "Title" and r[1].code is None


def test_sections_and_chunks(spark):
    text = "# A\nt1\n### B\nt2\n### C\nt3\n```\n# no heading\n```\n## D\nt4"
    got = [(s.path, s.text.split("\n")[0]) for s in one(spark, text, C.sections)]
    assert got == [(["A"], "# A"), (["A", "B"], "### B"), (["A", "B", "C"], "### C"), (["A", "D"], "## D")]
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    fence = "```py\n" + "x = 1\n" * 300 + "```"
    assert [b.kind for b in C.blocks(f"para\npara\n{table}\n\n- i\n  more\n\n{fence}\nend")] == ["text", "table", "list", "code", "text"]
    assert fence in C.pieces("Some sentence. " * 140 + "\n\n" + fence)[-1] or any(fence in p for p in C.pieces("Some sentence. " * 140 + "\n\n" + fence))
    pieces = C.windows("word " * 2000, 1400, 200)
    assert all(len(p) <= 1400 for p in pieces) and len(pieces) > 7
    docs = spark.createDataFrame([(1, "s", "u.md", "T", "# P\n## X\n### a\nsmall one\n### b\nsmall two"), (2, "s", "e.md", "T", None), (3, "s", "t.md", "T", f"# Tab\n{table}")], "document_id long, source_id string, uri string, title string, content string")
    rows = C.chunked(docs).orderBy("document_id", "ordinal").collect()
    assert [(r.document_id, r.chunk_kind) for r in rows][-1] == (3, "table") and all(r.document_id != 2 for r in rows)
    assert any("small one" in r.content and "small two" in r.content and r.section_path == ["P", "X"] for r in rows)
    own = C.Section("x. " * 3000 + "CHILD here. " + "y. " * 3000)
    assert own.around("CHILD here").count("CHILD") == 1 and own.around("absent") == own.text[:4798].rstrip(" .") + "." and C.Section(" a ").around("x") == "a"
    low, high = own.bounds("CHILD here")
    assert high - low == C.PARENT_CHARS and C.Section("z" * 5000).around("z" * 300) == "z" * 4800


def test_bm25_like_fts5(spark):
    docs = [(1, "s1", "alpha beta web socket beta"), (2, "s1", "beta café"), (3, "s2", "gamma web_socket web socket"), (4, "s2", "delta alone here"), (5, "s1", "gamma beta alpha alpha")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(content)")
    db.executemany("insert into f(rowid, content) values (?, ?)", [(i, t) for i, _, t in docs])
    want = dict(db.execute("select rowid, bm25(f) from f where f match '\"web_socket\" OR \"beta\" OR \"cafe\"'"))
    c = spark.createDataFrame(docs, "chunk_id long, source_id string, content string")
    got = {r.chunk_id: r.bm25 for r in S.bm25(S.postings(c), S.lengths(c), "web_socket beta cafe").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_terms_like_fts5(spark):
    texts = ["Zażółć gęślą jaźń, ŁÓDŹ", "Tiếng Việt: đường phố Hà Nội", "Ελληνικά κείμενα ΣΊΣΥΦΟΣ", "cafe\u0301 nai\u0308ve o\u031b", "Ünïcödé ǅ ſ ß ﬁ", "Привет, Ёлка ЙОД", "x_y a1b2 ǽ ǿ ḗ"]
    texts += ["a" + chr(c) + "b" for c in (*range(0xC0, 0x370), *range(0x1E00, 0x1F00)) if chr(c).isalpha() and chr(c) != "\u0130"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(c)")
    db.execute("create virtual table v using fts5vocab(f, instance)")
    db.executemany("insert into f(rowid, c) values (?, ?)", enumerate(texts))
    want = {}
    for term, i, at in db.execute("select term, doc, offset from v order by doc, offset"):
        want.setdefault(i, []).append(term)
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.terms(F.col("t")).alias("ts")).collect()
    assert {r.i: r.ts for r in rows} == want


def test_search_modes(spark):
    c = spark.createDataFrame([(i, f"s{i % 2}", i // 2, f"word{i} shared text") for i in range(8)], "chunk_id long, source_id string, document_id long, content string")
    v = spark.createDataFrame([(i, f"s{i % 2}", [float(i), 0.0]) for i in range(8)] + [(99, "s0", [1.0])], "chunk_id long, source_id string, embedding array<float>")
    p, n = S.postings(c), S.lengths(c)
    at = F.array(F.lit(2.1), F.lit(0.0))
    assert [r.chunk_id for r in S.search(c, p, n, v, "shared", at, 3, "vector").collect()] == [2, 1, 4]
    assert S.search(c, p, n, v, "?!", at, 3).count() == 0 == S.search(c, p, n, v, "shared", at, 3, source_ids=[]).count()
    both = S.search(c, p, n, v, "word3 shared", at, 4, source_ids=["s1"]).collect()
    assert {r.chunk_id for r in both} == {1, 3, 5, 7}
    with pytest.raises(ValueError):
        S.search(c, p, n, v, "x", at, 3, "other")
    weak = S.keyword_candidates(S.bm25(p, n, "word3 shared"), 8).orderBy("keyword_rank").collect()
    strong = S.keyword_candidates(S.bm25(p, n, "word3 shared"), 8, monotone=True).orderBy("keyword_rank").first()
    assert weak[-1].chunk_id == 3 == strong.chunk_id


def test_context(spark):
    c = spark.createDataFrame([(1, 1, 0, "a", "P a b"), (2, 1, 1, "b", ""), (3, 1, 2, "b", "other"), (4, 2, 0, "z", None)], "chunk_id long, document_id long, ordinal int, content string, parent_context string")
    assert {r.chunk_id: r.context for r in S.context(c).collect()} == {1: "P a b", 2: "a\n\nb", 3: "b", 4: "z"}


def test_store(spark, tmp_path):
    s = spark.createDataFrame([("a", "Aa", "indexed", "local", "m", 1, 5), ("b", "Bb", "failed", "local", "m", 1, 6), ("c", "Cc", "indexed", "local", "old", 1, 7)], "source_id string, name string, status string, provider string, model string, created_at int, updated_at int")
    assert K.named(s, "local", "m") == ["a"] and K.named(s, "local", "m", name="aa") == ["a"] and K.named(s, "local", "m", source_id="zz") == []
    for bad in ("b", "c"):
        with pytest.raises(ValueError):
            K.named(s, "local", "m", source_id=bad)
    new = s.filter("source_id = 'a'").withColumn("updated_at", F.lit(9)).withColumn("created_at", F.lit(8))
    row = K.upsert(s, new, "source_id", "updated_at").filter("source_id = 'a'").first()
    assert (row.created_at, row.updated_at) == (1, 9)
    path = f"{tmp_path}/t"
    K.write_sources(spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, x int"), path)
    K.write_sources(spark.createDataFrame([("a", 3)], "source_id string, x int"), path)
    K.write_sources(spark.createDataFrame([("b", 4)], "source_id string, x int"), path, "append")
    assert sorted((r.source_id, r.x) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2), ("b", 4)]


def test_embedding(spark):
    v = hashed("alpha beta alpha")
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-5 and hashed("?!") == [0.0] * 256
    rows = embedded(spark.createDataFrame([(1, "alpha"), (2, None)], "i long, t string"), "t").collect()
    assert rows[0].embedding_dimensions == 256 and max(map(abs, rows[1].embedding)) == 0
    assert Embedder(batch_size=1000).batch_size == 256
    with pytest.raises(Exception, match="vectors"):
        embedded(spark.createDataFrame([("x",)], "t string"), "t", Embedder(embed=lambda t: [])).collect()


def test_evaluation(spark, tmp_path):
    d = spark.createDataFrame([(1, "So the Quick brown fox jumps over a lazy dog in the sun today ok"), (2, "nothing")], "chunk_id long, content string")
    c = spark.createDataFrame([(1, "quick brown FOX jumps over a lazy dog in the su"), (2, "oth"), (3, "absent"), (4, "")], "case_id long, text string")
    assert sorted((r.case_id, r.chunk_id) for r in passages_in(d, c).collect()) == [(1, 1), (2, 2)]
    r = report(spark.createDataFrame([(1, True), (2, True), (3, False)], "case_id long, asked boolean"), spark.createDataFrame([(1, 2, True), (1, 3, True), (2, 9, True)], "case_id long, rank int, matches boolean"), 5).first()
    assert (r.cases, r.passed, r.pass_rate, r.mrr) == (2, 1, 0.5, 0.25)
    m = spark.range(1).select(matches(F.lit("hay stack"), [F.array(F.lit("no"), F.lit("HAY")), F.lit(None).cast("array<string>")], F.array(F.lit("stack"))).alias("m"))
    assert m.first().m
    (tmp_path / "e.json").write_text('{"name": "n", "cases": [{"id": "a", "query": "q", "limit": 5, "expected": {"terms": ["x"]}}]}')
    case = files.evaluation_cases(spark, str(tmp_path / "e.json")).first()
    assert (case.mode, case.limit, case.max_rank) == ("hybrid", 5, 5)


def test_section_rows_like_the_column(spark):
    import random

    rng = random.Random(8)
    make = lambda: rng.choice(["#" * rng.randrange(1, 8) + " " + rng.choice("ABCDEF"), "text", "", "  ", "```py", "  ```", "#x", "# ", "more text"])
    texts = [rng.choice(["\n", "\r\n", "\u2028"]).join(make() for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\n"]) for _ in range(300)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    want = [(r.i, list(s.path), s.text) for r in d.select("i", C.sections(F.col("t")).alias("ss")).collect() for s in r.ss or []]
    rows = C.section_rows(d, "i", "t").orderBy("i", "section").collect()
    assert [(r.i, list(r.path), r.text) for r in rows] == sorted(want, key=lambda x: x[0]) and len(rows) > 400


def test_passages_of_any_length(spark):
    texts = ["So the quick brown fox jumps over a lazy dog in the sun today ok", "Nothing to see  here\tat all", "x y z", "", None, "the the THE the", "one two three four five six seven eight nine ten eleven", "\u00c9t\u00e9 en \u00e9t\u00e9"]
    asked = ["quick brown FOX jumps over a lazy dog in the su", "oth", "ing to", "o", " ", "  ", "see  here", "see here", "the the", "e t", "o see  h", "wn fox jumps ov", "absent word here", "two three four", "ten", "\t", "\u00c9T", "to see", "z", "ight nine ten el", "the quick absent fox"]
    d = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    c = spark.createDataFrame(list(enumerate(asked)), "case_id long, text string")
    found = passages_in(d, c)
    assert sorted((r.case_id, r.chunk_id) for r in found.collect()) == sorted((i, k) for i, a in enumerate(asked) for k, t in enumerate(texts) if t is not None and a.lower() in t.lower())
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_files_and_stream(spark, tmp_path):
    root = tmp_path / "docs"
    for name, text in {"a.md": "---\nt: 1\n---\n# Guide\n\nBody text", "sub/my-page.html": "<nav>x</nav><main><h2>Hi</h2><p>There <a href='/u'>link</a></p></main>", "node_modules/x.md": "no", "img.png": "no", "blank.txt": " \n", "bad.txt": None}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"caf\xff text" if text is None else text.encode())
    rows = {r.uri.rsplit("/", 1)[1]: r for r in files.documents(spark, str(root), "s").collect()}
    assert set(rows) == {"a.md", "my-page.html", "bad.txt"} and rows["a.md"].title == "Guide" and rows["my-page.html"].title == "My Page"
    assert rows["my-page.html"].content == "## Hi\n\nThere [link](/u)" and rows["bad.txt"].content == "caf� text"
    table = str(tmp_path / "chunks")
    job = ingest(spark, str(root), "s", table, str(tmp_path / "state"))
    job.awaitTermination()
    n = spark.read.parquet(table).count()
    assert n >= 2 and job_events([]) == []
    (root / "new.md").write_text("# New\n\nmore text")
    ingest(spark, str(root), "s", table, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(table).count() == n + 1


def test_web(spark):
    url = "https://h.example/docs/v1/page?x=1"
    assert one(spark, url, lambda c: web.url_passes(c, [], [])) is True
    assert one(spark, url, lambda c: web.url_passes(c, ["*/docs/*"], [])) is True
    assert one(spark, url, lambda c: web.url_passes(c, ["/docs/"], [r"/v[0-9]{1}/"])) is False
    assert one(spark, url, lambda c: web.url_passes(c, ["/nothere/"], [])) is False
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("d", "e")], "url string, link string")
    assert [(r.url, r.depth) for r in web.frontier(links, "a", 2, 10).collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_parent_context_bounds_its_batches(spark):
    """Whole texts go to a worker in few rows at a time, whatever the session allows."""
    from quillspark.operators.chunking import with_parent_context

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows)
    spark.conf.set(rows, "10000")
    d = spark.createDataFrame([(i, f"parent {i}", "parent") for i in range(3)], "id long, p string, c string")
    assert sorted(tuple(r) for r in with_parent_context(d, "p", "c", "x").collect()) == [(i, f"parent {i}") for i in range(3)]
    assert int(spark.conf.get(rows)) <= 1000
    spark.conf.set(rows, usual)


def test_excerpt_looks_into_blocks_that_may_score(spark):
    """Blocks without a wanted term or a sign of code aren't parsed; signs and terms at line ends still count."""
    wanted = F.array(F.lit("oration"), F.lit("of_the"))
    texts = ["no hit here\n\nan Oration here\nnext line\n\nother", "await\nthe rest\n\nnothing", "ora```\nx\n```tion and so on", "preorations only", "# oration\nbody", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [r[0] for r in d.orderBy("i").select(T.excerpt(F.col("t"), wanted)).collect()] == ["an Oration here next line", "await the rest", "oration and so on", "", "# oration body", "", ""]
    assert "exists(" in d.select(T.excerpt(F.col("t"), wanted))._jdf.queryExecution().optimizedPlan().toString()


def test_clean_web_without_a_fold(spark):
    lines = ["# Contents", "- a", "", "* b", "Search", "- c", "text", "- d", "## Search", "- e", "On this page", "- f", "Table of contents", " - g", "# Head ![i](u)", "- h", "", "Copy page", "end"]
    d = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, "- a\n- b")], "i int, t string").select("i", T.clean_web(F.col("t")).alias("c"))
    assert {r.i: r.c for r in d.collect()} == {1: "text\n- e\n# Head\n- h\n\nend", 2: None, 3: "", 4: "- a\n- b"}
    assert "array_append" not in d._jdf.queryExecution().optimizedPlan().toString()
