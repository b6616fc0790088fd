"""A training corpus from documents: stages that each call one operator of quillspark.llm.

Each stage takes (spark, docs, sf_dir) and returns a frame; what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, langid, linededup, mixing, neardup
from quillspark.llm.common import fresh, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language has half the words, go; a null lang becomes the predicted one."""
    lang, score = fresh(docs.columns, "_lang"), fresh(docs.columns, "_score")
    told = langid.predict(docs, langid.fit(langid.sample(docs)), *docs.columns, names=(lang, score))
    kept = told.filter((F.col(lang) != "und") & (F.col(score) >= langid.MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go, and documents of which nothing is left; n_chars is that of what is left."""
    out = linededup.dedup_lines(docs)
    out = out.filter((F.col("n_removed") == 0) | F.coalesce("text", F.lit("")).rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id."""
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(own := fresh(docs.columns, "_d"))).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each time that the mix takes them.

    Where a source's target ends inside a document, that document stays whole if half of it is taken, and goes if less is; so the
    words of a source are within half a document of its target.
    """
    return mixing.mixed_documents(docs, mixing.ranked_schedule(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, the ids; part and row, by which rows sort in training order."""
    placed = mixing.written_order(docs)
    return bpe.encode_documents(placed, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("part", "row"))


STAGES = [("language ID", language), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", encode)]

#: Language ID, positions and merges are not SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
