"""From raw documents to packed training sequences, one stage after another.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from ledgerforge.llm import language_id, line_dedup, ngram_join, packing, toxicity
from ledgerforge.llm.common import read_table, scratch_uri

#: Documents scored at least this toxic go.
TOXIC = 0.5
#: Documents whose main language holds a smaller share of the letters go.
LEAST_LANGUAGE_SCORE = 0.2
WORD_VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier does not call toxic."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, TOXIC)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters, or without a main language, go."""
    return language_id.keep_known(docs, language_id.learn(docs), LEAST_LANGUAGE_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line up to two edits, fewer in short lines."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest identifier, of each group of near copies."""
    return ngram_join.first_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of 2048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("packing", pack_sequences),
]

#: Learned models and token packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch_uri(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
