import pytest
from pyspark.sql import functions as F

from quillspark.operators.chunking import chunked
from quillspark.operators.embedding import Embedder, embedded
from quillspark.sources import files, web
from quillspark.streaming import captures as C


def _run(spark, tmp_path, source, embedder=None):
    C.follow(spark, f"{tmp_path}/captures", source, f"{tmp_path}/store", f"{tmp_path}/state", embedder).awaitTermination()


def test_files_follow_their_folder(spark, tmp_path):
    """Changed files replace their chunks, deleted ones go, a batch that failed is tried again; equal to a batch at each step."""
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("answer = 42\n")
    (root / "a.md").write_text("# One\n\nfirst text\n\n{* ../src/a.py *}\n")
    (root / "sub" / "b.html").write_text("<main><h1>Two</h1><p>second text</p></main>")
    (root / "c.txt").write_text("third text")

    def down(texts):
        raise RuntimeError("down")

    def same():
        d = files.documents(spark, str(root), "s").withColumn("document_id", F.xxhash64("source_id", "uri"))
        want = embedded(chunked(d.select("document_id", "source_id", "uri", "title", "content")).withColumn("_text", F.concat_ws("\n", "title", "content")), "_text")
        rows = lambda d: sorted(tuple(map(str, r)) for r in d.select("uri", "ordinal", "title", "content", "section_path", F.round(F.get("embedding", F.lit(0)), 6)).collect())
        got = rows(C.followed(spark, f"{tmp_path}/store"))
        assert got == rows(want)
        return {r[0].rsplit("/", 1)[1] for r in got}

    C.capture_folder(spark, str(root), f"{tmp_path}/captures")
    with pytest.raises(Exception, match="down"):
        _run(spark, tmp_path, "s", Embedder(embed=down))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        C.followed(spark, f"{tmp_path}/store")
    _run(spark, tmp_path, "s")
    assert same() == {"a.md", "b.html", "c.txt"}
    assert "answer = 42" in C.followed(spark, f"{tmp_path}/store", "documents").filter("uri like '%a.md'").first().content
    (root / "a.md").write_text("# One\n\nfirst text changed\n")
    (root / "c.txt").unlink()
    (root / "new.md").write_text("# Four\n\nfourth text")
    C.capture_folder(spark, str(root), f"{tmp_path}/captures")
    _run(spark, tmp_path, "s")
    assert same() == {"a.md", "b.html", "new.md"}
    n = spark.read.schema(C.CAPTURE).parquet(f"{tmp_path}/captures").count()
    C.capture_folder(spark, str(root), f"{tmp_path}/captures")
    assert spark.read.schema(C.CAPTURE).parquet(f"{tmp_path}/captures").count() == n == 6
    (root / "c.txt").write_text("third text")
    C.capture_folder(spark, str(root), f"{tmp_path}/captures")
    _run(spark, tmp_path, "s")
    assert same() == {"a.md", "b.html", "new.md", "c.txt"}


def test_pages_follow_their_captures(spark, tmp_path):
    """Later and earlier captures, ties, nulls and repeated rows; equal to the newest captures of all at once."""
    page = lambda t: f"<html><body><p>{t}</p></body></html>"
    steps = [
        [(1, "u/a", page("a one")), (2, "u/a", page("a two")), (1, "u/b", page("b one")), (5, "u/c", page("c five")), (1, None, page("none")), (None, "u/z", page("z"))],
        [(1, "u/a", page("late")), (3, "u/b", page("b one")), (6, "u/c", None), (7, "u/d", ""), (2, "u/e", page("e"))],
        [(9, "u/c", page("c nine")), (9, "u/c", page("c nine")), (8, "u/e", None), (8, "u/e", page("e again")), (4, "u/b", page("b four"))],
    ]
    everything = []
    for rows in steps:
        everything += rows
        C.capture_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/captures")
        _run(spark, tmp_path, "w")
        best = {}
        for at, url, html in everything:
            if at is not None and url is not None:
                best[url] = max(best.get(url, (-1, "")), (at, sha(html)))
        texts = {sha(h): h for _, _, h in everything}
        want = sorted((u, web.to_markdown(texts[s])) for u, (_, s) in best.items() if s and web.to_markdown(texts[s]))
        assert sorted((r.uri, r.content) for r in C.followed(spark, f"{tmp_path}/store", "documents").collect()) == want
    told = spark.read.parquet(f"{tmp_path}/store/changes")
    assert told.filter("uri = 'u/b'").count() == 2  # the same text again is no change


def sha(text):
    import hashlib

    return "" if text is None else hashlib.sha256(text.encode()).hexdigest()
