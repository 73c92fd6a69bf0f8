"""A corpus pipeline over `documents`: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage reads what the one before wrote and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop, table
from tidemark.llm.line_dedup import drop_frequent_lines
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_good
from tidemark.llm.similar import keep_one_similar
from tidemark.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that ten documents or more share."""
    out = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles at a similarity of 0.8 or more) the document with the smallest id."""
    return keep_one_similar(docs, least=0.8, size=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document holds."""
    out = substring_dedup(docs, window=50)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024, end_id=0)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("substring_dedup", passages), ("packing", packed)]

#: SQL can express neither the robust estimates nor the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, table(stage(spark, docs, sf_dir), name)
        drop(before)  # the input itself is no work table
    return STAGES[-1][1](spark, docs, sf_dir)
