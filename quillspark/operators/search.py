"""Keyword, vector and hybrid search as one DataFrame plan each.

The index is a table of postings (chunk_id, source_id, term, field, positions) and one of lengths; a query reads the
postings of its own terms only. Statistics are over all chunks, whatever sources a query asks for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.store import kept

# Fixed values that results depend on.
RRF_K, KEYWORD_WEIGHT, VECTOR_WEIGHT = 60, 1.0, 1.0
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Sums of doubles differ in their last bits with the order of the rows; equal texts are to have equal scores.
DIGITS = 10
OVERFETCH = 6
FIELDS = ("title", "uri", "content")


def postings(chunks: DataFrame, only: list[str] | None = None) -> DataFrame:
    """A row for each chunk, field and term with the term's positions. Write it partitioned or sorted by term.

    only: the terms of a query that has no written index; the others are left out before rows are made of them.
    """

    def one(f: str) -> DataFrame:
        placed = F.transform(T.terms(F.col(f)), lambda t, i: F.struct(i.alias("position"), t.alias("term")))
        wanted = placed if only is None else F.filter(placed, lambda p: p["term"].isin(only))
        return chunks.select("chunk_id", "source_id", F.lit(f).alias("field"), F.explode(wanted).alias("p")).select("chunk_id", "source_id", "field", "p.position", "p.term")

    rows = one(FIELDS[0]).union(one(FIELDS[1])).union(one(FIELDS[2])) if set(FIELDS) <= set(chunks.columns) else one("content")
    return rows.groupBy("chunk_id", "source_id", "field", "term").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, length: the number of terms in all fields."""
    fields = [f for f in FIELDS if f in chunks.columns]
    return chunks.select("chunk_id", sum((F.size(T.terms(F.col(f))) for f in fields), F.lit(0)).cast("long").alias("length"))


def query_tokens(query: str) -> list[str]:
    """Distinct tokens in order of their first place."""
    return list(dict.fromkeys(t.lower() for t in re.findall(T.TOKEN, query)))


def query_terms(query: str) -> list[str]:
    return sorted({t for p in query_phrases(query) for t in p})


def query_phrases(query: str) -> list[list[str]]:
    """The terms of each token: more than one where the token has inner punctuation."""
    fold = str.maketrans(T.ACCENTED[: len(T.PLAIN)], T.PLAIN, T.ACCENTED[len(T.PLAIN) :])
    return [p for t in query_tokens(query) if (p := re.findall(r"[^\W_]+", t.translate(fold)))]


def phrase_hits(index: DataFrame, query: str) -> DataFrame:
    """chunk_id, source_id, phrase, hits: occurrences of each phrase, which never crosses fields."""
    phrases = query_phrases(query)
    spark = index.sparkSession
    rows = [(i, k, t, len(p)) for i, p in enumerate(phrases) for k, t in enumerate(p)]
    wanted = F.broadcast(spark.createDataFrame(rows, "phrase int, shift int, term string, n int"))  # the query's terms
    own = index.filter(F.col("term").isin(sorted({r[2] for r in rows}))) if rows else index.limit(0)
    found = own.join(wanted, "term").select("chunk_id", "source_id", "field", "phrase", "n", "shift", F.explode(F.transform("positions", lambda p: p - F.col("shift"))).alias("at"))
    places = found.groupBy("chunk_id", "source_id", "field", "phrase", "n", "at").agg(F.countDistinct("shift").alias("have")).filter(F.col("have") == F.col("n"))
    return places.groupBy("chunk_id", "source_id", "phrase").agg(F.count(F.lit(1)).alias("hits"))


def bm25(index: DataFrame, sizes: DataFrame, query: str) -> DataFrame:
    """chunk_id, source_id, bm25 (more negative is better) of the chunks that hold any phrase."""
    hits = phrase_hits(index, query)
    stats = F.broadcast(sizes.agg(F.count(F.lit(1)).alias("chunks"), F.avg("length").alias("mean")))  # one row
    spread = F.broadcast(hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")))  # a row a phrase of the query
    j = hits.join(spread, "phrase").join(sizes.select("chunk_id", "length"), "chunk_id").crossJoin(stats)
    idf = F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return j.groupBy("chunk_id", "source_id").agg(F.round(-F.sum(weight), DIGITS).alias("bm25"))


def allowed(frame: DataFrame, source_ids: list[str] | DataFrame | None) -> DataFrame:
    """No filter for None, nothing for an empty list; a frame has a row for each source (source_id)."""
    if isinstance(source_ids, DataFrame):
        return frame.join(source_ids.select("source_id"), "source_id", "left_semi")
    return frame if source_ids is None else frame.filter(F.col("source_id").isin(source_ids))


def keyword_candidates(scores: DataFrame, limit: int, source_ids: list[str] | DataFrame | None = None, monotone: bool = False) -> DataFrame:
    """The best by bm25 with keyword_score and keyword_rank.

    The score falls as the match gets better, 1 - |bm25| / (max + 1), and ranks go by it; monotone turns that round.
    """
    top = allowed(scores, source_ids).orderBy("bm25", "chunk_id").limit(limit)
    most = F.coalesce(F.nullif(F.max(F.abs("bm25")).over(W.partitionBy()), F.lit(0.0)), F.lit(1.0))
    score = F.abs("bm25") / (most + 1)
    top = top.withColumn("keyword_score", score if monotone else 1 - score)
    return top.withColumn("keyword_rank", F.row_number().over(W.orderBy(F.desc("keyword_score"), "bm25", "chunk_id")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, z: s + z))


def cosine(a: Column, b: Column) -> Column:
    """The inner product; 0 for vectors of different lengths or without elements."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.when(F.size(a) == F.size(b), dot).otherwise(F.lit(0.0))


def similarity(distance: Column) -> Column:
    return F.when(distance < 0, F.lit(0.0)).otherwise(1 / (1 + distance))


def vector_candidates(vectors: DataFrame, query: Column | DataFrame, limit: int, source_ids: list[str] | DataFrame | None = None) -> DataFrame:
    """The nearest vectors of the query's length with vector_score and vector_rank; query: a column, or a frame of one row (q)."""
    v = allowed(vectors, source_ids)
    v = v.crossJoin(F.broadcast(query)) if isinstance(query, DataFrame) else v.withColumn("q", query)
    near = v.filter(F.size("embedding") == F.size("q")).withColumn("distance", l2(F.col("embedding"), F.col("q")))
    top = near.drop("q", "embedding").orderBy("distance", "chunk_id").limit(limit).withColumn("vector_score", similarity(F.col("distance")))
    return top.withColumn("vector_rank", F.row_number().over(W.orderBy(F.desc("vector_score"), "distance", "chunk_id")))


def fused(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Both candidate lists by reciprocal rank fusion; a missing score is 0, a missing rank adds nothing."""
    k = keyword.select("chunk_id", "keyword_score", "keyword_rank")
    v = vector.select("chunk_id", "vector_score", "vector_rank")
    j = k.join(v, "chunk_id", "full_outer")
    part = lambda c, w: F.coalesce(w / (RRF_K + F.col(c)), F.lit(0.0))
    return j.select("chunk_id", F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), (part("keyword_rank", KEYWORD_WEIGHT) + part("vector_rank", VECTOR_WEIGHT)).alias("score"))


def diversified(ranked: DataFrame, limit: int) -> DataFrame:
    """The first chunk of each document in rank order, then the others; ranked: score, keyword_score, vector_score, chunk_id, document_id."""
    order = [F.desc("score"), F.desc("keyword_score"), F.desc("vector_score"), F.col("chunk_id")]
    again = F.row_number().over(W.partitionBy("document_id").orderBy(*order)) > 1
    return ranked.withColumn("_again", again).orderBy("_again", *order).limit(limit).drop("_again")


def search(chunks: DataFrame, index: DataFrame, sizes: DataFrame, vectors: DataFrame, query: str, query_vector: Column | DataFrame | None, limit: int = 8, mode: str = "hybrid", source_ids: list[str] | DataFrame | None = None, monotone: bool = False) -> DataFrame:
    """chunk_id, document_id, score, keyword_score, vector_score of the best chunks, in their order.

    mode: keyword, vector or hybrid. A query without tokens finds nothing. Candidates come first, chunks are joined last.
    """
    if mode not in ("keyword", "vector", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    n = limit * OVERFETCH
    none = not query.strip() or isinstance(source_ids, list) and not source_ids or not query_tokens(query)
    kw = None if mode == "vector" else keyword_candidates(bm25(index, sizes, query), 0 if none else n, source_ids, monotone)
    vec = None if mode == "keyword" or query_vector is None else vector_candidates(vectors, query_vector, 0 if none else n, source_ids)
    zero = F.lit(0.0)
    if kw is not None and vec is not None:
        ranked = fused(kw, vec)
    elif kw is not None:
        ranked = kw.select("chunk_id", "keyword_score", zero.alias("vector_score"), F.col("keyword_score").alias("score"))
    else:
        ranked = vec.select("chunk_id", zero.alias("keyword_score"), "vector_score", F.col("vector_score").alias("score"))
    return diversified(ranked.join(chunks.select("chunk_id", "document_id"), "chunk_id"), limit)


# --- many queries in one plan ---

#: Vectors and queries of a block in which all are compared.
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 20_000, 500
#: Phrases of queries up to which they are sent to all tasks, so that what chunks hold stays where the chunk is.
PHRASES_SENT = 100_000


def asked_phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase (its number), key, terms: the phrases of each query's tokens."""
    found = F.filter(F.transform(F.array_distinct(T.tokens(F.col("query"))), T.terms), lambda p: F.size(p) > 0)
    return queries.select("query_id", F.posexplode(found).alias("phrase", "terms")).withColumn("key", F.array_join("terms", " "))


def hits_of(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """key, chunk_id, source_id, hits of distinct phrases (key, terms), which never cross fields.

    A phrase of one term is counted from its postings as they are; only longer ones are matched place by place.
    """
    single = phrases.filter(F.size("terms") == 1).select("key", F.get("terms", F.lit(0)).alias("term"))
    one = index.join(single, "term").groupBy("key", "chunk_id", "source_id").agg(F.sum(F.size("positions")).cast("long").alias("hits"))
    longer = phrases.filter(F.size("terms") > 1).select("key", F.size("terms").alias("n"), F.posexplode("terms").alias("shift", "term"))
    at = index.join(longer, "term").select("key", "n", "chunk_id", "source_id", "field", "shift", F.explode(F.transform("positions", lambda p: p - F.col("shift"))).alias("at"))
    places = at.groupBy("key", "n", "chunk_id", "source_id", "field", "at").agg(F.countDistinct("shift").alias("have")).filter(F.col("have") == F.col("n"))
    return one.union(places.groupBy("key", "chunk_id", "source_id").agg(F.count(F.lit(1)).alias("hits")))


def bm25_many(index: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, source_id, bm25 for queries (query_id, query). A phrase that several queries ask for is looked up once.

    Phrases meet chunks by chunk, and a chunk's sums need no other task: most chunks hold a word of most queries, so these rows are far
    more than the postings. Only where queries have more than PHRASES_SENT phrases do they meet by phrase.
    """
    asked = asked_phrases(queries)
    send = F.broadcast if asked.count() <= PHRASES_SENT else lambda rows: rows
    hits = kept(hits_of(index, send(asked.select("key", "terms").distinct())))
    spread = send(hits.groupBy("key").agg(F.count(F.lit(1)).alias("df")))
    stats = F.broadcast(sizes.agg(F.count(F.lit(1)).alias("chunks"), F.avg("length").alias("mean")))  # one row
    j = hits.join(sizes.select("chunk_id", "length").hint("merge"), "chunk_id").join(spread, "key").crossJoin(stats)
    idf = F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weighed = j.select("key", "chunk_id", "source_id", weight.alias("weight"))
    return weighed.join(send(asked.select("query_id", "key")), "key").groupBy("query_id", "chunk_id", "source_id").agg(F.round(-F.sum("weight"), DIGITS).alias("bm25"))


def _first(rows: DataFrame, limit: int | Column, *order: Column | str, most: int | None = None) -> DataFrame:
    """The first rows of each query. most: the largest of limits that are a column; with a number Spark cuts before it shuffles."""
    out = rows.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("_r") <= limit)
    return (out if most is None else out.filter(F.col("_r") <= most)).drop("_r")


def keyword_candidates_many(scores: DataFrame, limit: int | Column, monotone: bool = False, most: int | None = None) -> DataFrame:
    """Each query's best by bm25 with keyword_score and keyword_rank, as keyword_candidates has them for one. most: the largest limit."""
    top = _first(scores, limit, "bm25", "chunk_id", most=most)
    most = F.coalesce(F.nullif(F.max(F.abs("bm25")).over(W.partitionBy("query_id")), F.lit(0.0)), F.lit(1.0))
    score = F.abs("bm25") / (most + 1)
    top = top.withColumn("keyword_score", score if monotone else 1 - score)
    return top.withColumn("keyword_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("keyword_score"), "bm25", "chunk_id")))


def vector_candidates_many(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """query_id, chunk_id, vector_score, vector_rank: the `most` nearest vectors (chunk_id, source_id, embedding) of each query
    (query_id, q, source_ids: null for all) among those of its length.

    Queries and vectors meet in blocks: a block of queries is copied to all blocks of vectors, a vector to as many as there are
    blocks of queries, one for up to QUERIES_A_BLOCK. A block answers with `most` vectors a query.
    """
    import numpy as np
    import pyarrow as pa

    vs, qs = vectors.count(), queries.count()
    blocks = lambda n, size: max(1, -(-n // size))
    nv, nq = blocks(vs, VECTORS_A_BLOCK), blocks(qs, QUERIES_A_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    v = vectors.select("chunk_id", "source_id", "embedding", own("chunk_id", nv).alias("i")).withColumn("j", every(nq))
    q = queries.select("query_id", "q", "source_ids", own("query_id", nq).alias("j")).withColumn("i", every(nv))
    kinds = {**dict(vectors.dtypes), **dict(queries.dtypes)}

    def near(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "vector": [], "distance": []}
        ids, source = held.column("chunk_id").to_pylist(), np.array(held.column("source_id").to_pylist(), object)
        order = np.argsort(np.argsort(np.array(ids)) if ids else np.zeros(0, np.int64))
        rank = np.argsort(order)
        points = [None if x is None else np.asarray(x, np.float64) for x in held.column("embedding").to_pylist()]
        sizes = np.array([-1 if x is None else len(x) for x in points])
        matrices = {n: np.array([points[k] for k in np.flatnonzero(sizes == n)]) for n in set(sizes.tolist()) - {-1}}
        for k, (at, only) in enumerate(zip(asked.column("q").to_pylist(), asked.column("source_ids").to_pylist(), strict=True)):
            if at is None or len(at) not in matrices:
                continue
            here = np.flatnonzero(sizes == len(at))
            apart = matrices[len(at)] - np.asarray(at, np.float64)
            d = np.sqrt((apart * apart).sum(1)) if len(at) else np.zeros(len(here))
            if only is not None:
                keep = np.isin(source[here], np.array(only, object))
                here, d = here[keep], d[keep]
            for x in np.lexsort((rank[here], d))[:most].tolist():
                out["query"].append(k), out["vector"].append(int(here[x])), out["distance"].append(float(d[x]))
        return pa.table({"query_id": asked.column("query_id").take(pa.array(out["query"], pa.int64())), "chunk_id": held.column("chunk_id").take(pa.array(out["vector"], pa.int64())), "distance": pa.array(out["distance"], pa.float64())})

    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(near, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, distance double")
    top = _first(found, most, "distance", "chunk_id").withColumn("vector_score", similarity(F.col("distance")))
    return top.withColumn("vector_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("vector_score"), "distance", "chunk_id")))


def search_many(chunks: DataFrame, index: DataFrame, sizes: DataFrame, vectors: DataFrame | None, queries: DataFrame, most: int = 50, sources: DataFrame | None = None) -> DataFrame:
    """query_id, rank, chunk_id, document_id, score, keyword_score, vector_score: what search gives for each query, all in one plan.

    queries: query_id, query, q (vector; null for none), mode, limit (at most `most`), source_ids (null for all of sources).
    """
    meant = queries.filter((T.strip(F.coalesce("query", F.lit(""))) != "") & (F.size(T.tokens(F.col("query"))) > 0))
    n = F.col("limit") * OVERFETCH
    words = meant.filter("mode <> 'vector'")
    count, largest = words.agg(F.count(F.lit(1)), F.max("limit")).first()
    own = words.select("query_id", "limit", "source_ids")
    scores = bm25_many(index, sizes, words).join(F.broadcast(own) if count <= PHRASES_SENT else own, "query_id")
    scores = allowed(scores, sources).filter(F.col("source_ids").isNull() | F.array_contains("source_ids", F.col("source_id")))
    found = keyword_candidates_many(scores, n, most=(largest or 0) * OVERFETCH).select("query_id", "chunk_id", "keyword_score", "keyword_rank")
    if vectors is None:
        none = lambda kind: F.lit(None).cast(kind)
        found = found.withColumns({"vector_score": none("double"), "vector_rank": none("int")})
    else:
        near = vector_candidates_many(allowed(vectors, sources), meant.filter("mode <> 'keyword'").select("query_id", "q", "source_ids"), most * OVERFETCH)
        near = near.join(meant.select("query_id", "limit"), "query_id").filter(F.col("vector_rank") <= n)
        found = found.join(near.select("query_id", "chunk_id", "vector_score", "vector_rank"), ["query_id", "chunk_id"], "full_outer")
    part = lambda c, w: F.coalesce(w / (RRF_K + F.col(c)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    found = found.join(meant.select("query_id", "mode", "limit", F.col("q").isNotNull().alias("placed")), "query_id")
    both = part("keyword_rank", KEYWORD_WEIGHT) + part("vector_rank", VECTOR_WEIGHT)
    alone = F.coalesce("keyword_score", "vector_score")
    score = F.when((F.col("mode") == "hybrid") & F.col("placed") & F.lit(vectors is not None), both).otherwise(alone)
    ranked = found.select("query_id", "chunk_id", "limit", zero("keyword_score"), zero("vector_score"), score.alias("score")).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    order = [F.desc("score"), F.desc("keyword_score"), F.desc("vector_score"), F.col("chunk_id")]
    ranked = ranked.withColumn("_again", F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(*order)) > 1)
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_again", *order))).filter(F.col("rank") <= F.col("limit"))
    return ranked.select("query_id", "rank", "chunk_id", "document_id", "score", "keyword_score", "vector_score")


def neighbour_context(chunks: DataFrame, window: int = 1) -> DataFrame:
    """chunk_id, context: the texts of a chunk and its neighbours, equal ones once, blank lines between."""
    near = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(-window, window)
    texts = F.array_distinct(F.filter(F.collect_list(F.col("content")).over(near), lambda x: T.strip(x) != ""))
    return chunks.select("chunk_id", F.array_join(texts, "\n\n").alias("context"))


def context(chunks: DataFrame) -> DataFrame:
    """The parent context where it holds the chunk, else the neighbours, else the chunk itself."""
    own = F.when((T.strip(F.col("parent_context")) != "") & F.contains("parent_context", T.strip(F.col("content"))), T.strip(F.col("parent_context")))
    near = neighbour_context(chunks)
    return chunks.join(near, "chunk_id").select("chunk_id", F.coalesce(own, F.nullif("context", F.lit("")), "content").alias("context"))


def shaped(results: DataFrame, query: str | Column) -> DataFrame:
    """results (content, section_path, title) with summary, excerpt and code for a query, or that of each row."""
    wanted = T.meaningful(query) if isinstance(query, Column) else F.array(*(F.lit(t) for t in query_tokens(query) if t not in T.STOP_TERMS)).cast("array<string>")
    text = T.strip(F.regexp_replace("content", r"\r\n?", "\n"))
    out = results.withColumn("excerpt", T.excerpt(text, wanted))
    out = out.withColumn("summary", T.summary(F.coalesce(F.nullif("excerpt", F.lit("")), text), wanted)).withColumn("code", T.code(text, wanted))
    out = out.withColumn("summary", F.coalesce(F.nullif("summary", F.lit("")), F.nullif(F.array_join("section_path", " / "), F.lit("")), T.strip(F.col("title"))))
    return out.withColumn("excerpt", F.coalesce(F.nullif("excerpt", F.lit("")), "summary"))
