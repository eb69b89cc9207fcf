"""Corpus pipeline: each stage is written as Parquet and read again as the documents of the next one.

Stages work on whole rows of ``documents`` (doc_id, text, lang, source, n_chars);
all but the last return these columns. A clean document passes every stage
unchanged but for lines that an earlier document has too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_decode
from tidemark.llm.decontaminate import leaks
from tidemark.llm.line_runs import without_later_copies
from tidemark.llm.repetition import accepted
from tidemark.llm.setsketch import Near, near_components
from tidemark.session import scratch_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = Near(words=5, percent=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return accepted(docs.select(COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; documents of which nothing is left go."""
    left = without_later_copies(docs.select(COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    gone = near_components(docs, NEAR).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, as count and digests."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe_encoding", token_stage),
]
#: Rolling hashes, likelihood and tokenizers can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
