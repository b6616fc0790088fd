"""Retrieval evaluation: does what a case expects stand among the results, and how far up?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 8


def haystack(results: DataFrame) -> Column:
    fields = [c for c in ("title", "uri", "content", "summary", "code") if c in results.columns]
    path = [F.array_join("section_path", "\n")] if "section_path" in results.columns else []
    return F.lower(F.concat_ws("\n", *fields, *path))


def matches(text: Column, any_of: list[Column], all_of: Column | None = None) -> Column:
    """Each array of any_of needs one of its strings in the text, all_of needs all; arrays that are null ask for nothing."""
    holds = lambda p: F.contains(text, F.lower(p))
    out = F.lit(True)
    for wanted in any_of:
        out = out & F.coalesce(F.exists(wanted, holds), F.lit(True))
    return out & F.coalesce(F.forall(all_of, holds), F.lit(True)) if all_of is not None else out


def report(cases: DataFrame, found: DataFrame, max_rank: int) -> DataFrame:
    """One row: cases asked, passed, pass_rate, mrr. cases: case_id, asked; found: case_id, rank, matches."""
    first = found.filter(F.col("matches") & (F.col("rank") <= max_rank)).groupBy("case_id").agg(F.min("rank").alias("rank"))
    j = cases.filter("asked").join(first, "case_id", "left")
    rate = lambda c: F.bround(c, 4)
    n = F.count(F.lit(1))
    return j.agg(n.alias("cases"), F.count("rank").alias("passed"), rate(F.count("rank") / n).alias("pass_rate"), rate(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0)))).alias("mrr"))


#: Letters by which parts of words are looked up.
GRAM = 3


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def _at_rarest_word(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, chunk_id, text: the chunks that hold the rarest of the full words inside a passage (case_id, text, w: three words or more)."""
    inner = cases.select("case_id", "text", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    held = chunks.select("chunk_id", F.explode(F.array_distinct(_words(F.col("content")))).alias("word")).join(inner.select("word").distinct(), "word")
    spread = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # A word that no chunk has is the rarest of all: its passages are nowhere.
    rarest = inner.join(spread, "word", "left").groupBy("case_id", "text").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))["word"].alias("word"))
    return rarest.join(held, "word").select("case_id", "chunk_id", "text")


def _at_part_of_word(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, chunk_id, text: the chunks with a word that holds the longest part of a passage of one or two words (case_id, text, w)."""
    part = F.element_at(F.array_sort(F.transform("w", lambda x: F.struct(F.char_length(x).alias("n"), x.alias("part")))), -1)["part"]
    asked = cases.select("case_id", "text", part.alias("part")).withColumn("gram", F.substring("part", 1, GRAM))
    sizes = [r.n for r in asked.select(F.char_length("gram").alias("n")).distinct().collect()]  # up to GRAM + 1 numbers
    held = chunks.select("chunk_id", F.explode(F.array_distinct(_words(F.col("content")))).alias("word"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("word") - n + 1)), lambda i: F.substring("word", i, F.lit(n)))
    grams = F.array_distinct(F.concat(*(cut(n) for n in sizes))) if sizes else F.array(F.lit(""))
    keyed = held.select("word").distinct().select("word", F.explode(grams).alias("gram"))
    found = keyed.join(asked, "gram").filter(F.contains("word", F.col("part"))).select("case_id", "text", "word")
    return found.join(held, "word").select("case_id", "chunk_id", "text").distinct()


def passages_in(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, chunk_id where the chunk's content holds the case's text, ignoring case.

    Chunks and cases meet at a key, so no case is compared with all chunks: at hashes of SHINGLE consecutive words (the first full words
    inside a passage), shorter passages at the rarest of their full words, those of one or two words at words that hold their longest
    part. The first and last word of a passage may be parts of words in a chunk.
    """
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(SHINGLE)), " ")))
    cases = cases.filter(F.col("text") != "").withColumn("w", _words(F.col("text")))
    long = cases.filter(F.size("w") >= SHINGLE + 2).select("case_id", "text", F.xxhash64(F.array_join(F.slice("w", 2, SHINGLE), " ")).alias("g"))
    short = cases.filter(F.size("w") < SHINGLE + 2).select("case_id", "text", "w")
    w = chunks.withColumn("w", _words(F.col("content")))
    met = w.filter(F.size("w") >= SHINGLE).select("chunk_id", F.explode(F.array_distinct(grams(F.col("w")))).alias("g")).join(long, "g").select("case_id", "chunk_id", "text").distinct()
    for size, place in ((F.size("w") > 2, _at_rarest_word), (F.size("w") <= 2, _at_part_of_word)):
        if not (some := short.filter(size)).isEmpty():
            met = met.union(place(chunks, some))
    holds = F.contains(F.lower("content"), F.lower("text"))
    return met.join(chunks.select("chunk_id", "content"), "chunk_id").filter(holds).select("case_id", "chunk_id")
