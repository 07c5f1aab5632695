"""A training corpus from documents: quality rules, line dedup, near duplicates, mixing, tokens.

Each stage reads the table that the one before it wrote in the shared folder.  The near-duplicate
stage takes shingles of five words and a similarity of 0.8.

Defined cases: rows with a null, empty or blank text are rejected by the quality rules (under 10 words);
very long texts go through whole; of documents with one text one at most stays, and rows that repeat a
doc_id with one text share their fate; null sources and languages are values of their own; an empty table gives an empty
table with the columns of the last stage; all columns of documents are kept, and those with the names
of helpers are safe (n_tokens and token_ids of the input are replaced).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, line_dedup, mixing, ngram_join, quality
from skein.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat, or nearly repeat, earlier ones."""
    return line_dedup.without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target weights."""
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens and token_ids."""
    return bpe.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("ngram_jaccard", near_copies), ("mixing", mixture), ("byte_bpe", tokens)]

#: Near copies and byte-pair merges can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
