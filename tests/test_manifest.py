import shutil
import threading
import time

import pytest

from quillspark.operators.embedding import Embedder, hashed
from quillspark.plans.engine import Engine


def page(topic):
    return f"# {topic.title()}\n\nThis page is about {topic} and nothing else.\n"


def uris(e, query):
    return sorted(r.uri.rpartition("/")[2] for r in e.search(query, mode="keyword").collect())


def test_search_sees_whole_runs(spark, tmp_path, monkeypatch):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text(page("quokkas"))
    e = Engine(spark, str(tmp_path / "store"))
    s = e.register("local", "Docs", str(root))
    first = e.index_local(s, str(root))
    assert uris(e, "quokkas") == ["a.md"] and e.current().first().run == first

    (root / "a.md").unlink()
    (root / "b.md").write_text(page("wombats"))
    seen, write = [], e._write
    held = e._table("chunks", e.current())  # a search that began before

    def watched(rows, table, run):
        write(rows, table, run)
        if table in ("chunks", "lengths"):
            seen.append((uris(e, "quokkas"), uris(e, "wombats"), e.sources().first().status))

    monkeypatch.setattr(e, "_write", watched)
    second = e.index_local(s, str(root))
    monkeypatch.undo()
    assert seen == [(["a.md"], [], "indexed")] * 2
    assert (uris(e, "quokkas"), uris(e, "wombats")) == ([], ["b.md"]) and [r.uri.rpartition("/")[2] for r in held.collect()] == ["a.md"]
    assert e.stored().first().snapshot.endswith(f"source_id={s}/run={second}")

    # What isn't current goes, and a source whose folder is gone is indexed from its captured files.
    assert e.vacuum() == 5 == e.vacuum(older_than=3600) + 5 and uris(e, "wombats") == ["b.md"]
    shutil.rmtree(root)
    again = Engine(spark, str(tmp_path / "store"), Embedder(model="other", embed=lambda texts: [hashed(t)[:8] for t in texts]))
    with pytest.raises(ValueError, match="was indexed with"):
        again.search("wombats", source_id=s)
    third = again.refresh(s)
    assert uris(again, "wombats") == ["b.md"] and again.current().first().run == third != second
    assert again.delete(s)["name"] == "Docs" and again.jobs().count() == 0 and again.current().count() == 0
    with pytest.raises(KeyError):
        again.refresh(s)
    other = again.register("local", "None", "x")
    with pytest.raises(FileNotFoundError):
        again.refresh(other)


def test_cancel_of_a_running_job(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text(page("quokkas"))
    e = Engine(spark, str(tmp_path / "store"))
    s = e.register("local", "Docs", str(root))
    e.index_local(s, str(root))
    slow, began = str(tmp_path / "slow"), str(tmp_path / "began")

    def embed(texts):
        import os

        open(began, "w").close()
        while os.path.exists(slow):
            time.sleep(0.1)
        return [hashed(t) for t in texts]

    open(slow, "w").close()
    e.embedder = Embedder(embed=embed)
    (root / "b.md").write_text(page("wombats"))
    out = []
    job = threading.Thread(target=lambda: out.append(e.index_local(s, str(root))))
    job.start()
    while not (tmp_path / "began").exists():
        time.sleep(0.1)
    assert e.cancel(s) != []
    job.join(60)
    (tmp_path / "slow").unlink()
    assert not job.is_alive() and [r.status for r in e.job_log(out[0]).collect()] == ["running", "cancelling", "cancelled"]
    row = e.sources().first()
    assert (row.status, row.error, row.document_count) == ("indexed", "cancelled", 1) and uris(e, "quokkas") == ["a.md"] and uris(e, "wombats") == []
