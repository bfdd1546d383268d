"""Corpus pipeline: stages over ``documents``, each reading what the one before kept.

Documents without a language go, one document of each group of near copies stays, passages that repeat are removed, documents that
hold too much of a benchmark item go, benchmark passages in the documents that stay are removed, and the rest is encoded with the ids beside the text decoded from them.
All stages but the last return the columns of ``documents``; texts change in substring dedup and decontamination only.
"""

from pyspark.sql import DataFrame, SparkSession

from cubemerge.llm import decontaminate, language_id, near_dedup, sentencepiece_backend, substring_dedup
from cubemerge.llm.queries import tokenizer_file
from cubemerge.llm.tables import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Scratch(spark, "language"):
        return language_id.identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Scratch(spark, "near_copies") as scratch:
        return near_dedup.without_near_duplicates(docs, scratch)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Scratch(spark, "passages") as scratch:
        return substring_dedup.without_repeats(docs, scratch)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with Scratch(spark, "benchmark") as scratch:
        return decontaminate.without_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.encoded(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_copies),
    ("substring_dedup", passages),
    ("decontamination", benchmark),
    ("sentencepiece", encoding),
]

# the first and the last stage are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the last stage. Each stage's rows are written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        before = None
        for _, stage in STAGES:
            done = stage(spark, docs, sf_dir)
            docs = scratch.result(done) if stage is STAGES[-1][1] else scratch.table(done)
            if before is not None:
                scratch.drop(before)
            before = docs if stage is not STAGES[-1][1] else None
    return docs
