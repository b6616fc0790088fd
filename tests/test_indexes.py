import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import blockmax, cells
from quillspark.operators import search as S


def test_block_max_reads_fewer_postings(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blockmax, "CHUNKS_A_BUCKET", 8)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", *(f"w{i}" for i in range(40))], k=rng.randrange(3, 120))) for _ in range(400)]
    texts += ["alpha beta alpha", "beta gamma", "", None, "gamma gamma alpha"]
    c = spark.createDataFrame([(i, f"s{i % 3}", t) for i, t in enumerate(texts)], "chunk_id long, source_id string, content string")
    index, sizes = S.postings(c), S.lengths(c)
    kept = blockmax.blocked(index, sizes).write(str(tmp_path / "blocks"))
    for query, limit, own in (("alpha beta", 10, None), ("gamma ALPHA", 4, None), ("alpha", 7, ["s1"]), ("absent", 5, None), ("beta", 1000, None), ("?!", 3, None)):
        want = S.allowed(S.bm25(index, sizes, query), own).orderBy("bm25", "chunk_id").limit(limit)
        same = lambda d: [(r.chunk_id, r.source_id, r.bm25) for r in d.collect()]
        assert same(blockmax.top(kept, query, limit, own)) == same(want.select("chunk_id", "source_id", "bm25"))
    _, read, left = blockmax.plan(kept, "gamma alpha", 2)
    assert left.count() > 3 * (read.count() + 2)
    with pytest.raises(ValueError, match="positions"):
        blockmax.top(kept, "web_socket", 3)


def test_cells_read_fewer_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"s{i % 2}", [(i % 20) * 10 + rng.random(), (i % 20) ** 2 + rng.random(), rng.random()]) for i in range(800)]
    rows += [(900, "s0", [1.0]), (901, "s0", None), (902, "s0", []), (903, "s1", rows[5][2]), (904, "s1", rows[5][2]), (905, "s0", [1.0, float("nan"), 2.0])]
    v = spark.createDataFrame(rows, "chunk_id long, source_id string, embedding array<float>")
    kept = cells.celled(v).write(str(tmp_path / "cells"))
    for q, limit, own in (([50.0, 25.0, 0.5], 10, None), ([50.0, 25.0, 0.5], 45, ["s1"]), ([0.0, 0.0, 0.0], 1, None), ([1.5], 5, None), ([10.0, 3.0, 1.0], 900, None)):
        want = S.vector_candidates(v, F.array(*map(F.lit, q)), limit, own).orderBy("vector_rank").collect()
        found = cells.nearest(kept, q, limit, own).orderBy("vector_rank").collect()
        assert [(r.chunk_id, str(r.distance), r.vector_rank) for r in found] == [(r.chunk_id, str(r.distance), r.vector_rank) for r in want]
    assert len(kept.needed([50.0, 25.0, 0.5], 10)) < len(kept.centres) / 4
    near = cells.nearest(kept, [50.0, 25.0, 0.5], 10)
    assert re.search(r"PartitionFilters: \[cell#\d+ IN", near._jdf.queryExecution().toString())
    assert cells.nearest(cells.celled(v.limit(0)), [1.0], 3).count() == 0 == cells.nearest(cells.celled(v.filter("chunk_id > 900 and chunk_id < 903")), [1.0], 3).count()
