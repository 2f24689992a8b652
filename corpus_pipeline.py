"""A corpus pipeline: five stages, each applied to all that the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semafold.llm import exact_dedup, minhash_dedup, packing, suffix_dedup, toxicity
from semafold.llm.common import materialise, small_batches


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the lexicon is learned from the labels of documents that are in docs. Null and empty texts, and all
    texts where no labels tell toxic from other ones, stay. Rows that repeat are judged alike; no rows give no rows."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; null texts are equal to empty ones. Rows with a null id stay, and so
    do the other texts of a repeated id. Rows that repeat id and text stay together; no rows give no rows."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id stays. Texts without words, and rows with a null id, stay;
    rows with one id are one document; no rows give no rows."""
    return minhash_dedup.drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has too are cut; n_chars follows the text. No row goes: a text with nothing
    left is empty, a null text and a null id's text stay as they are, rows with one id don't cut each other."""
    return suffix_dedup.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 1024 tokens. Null and empty texts are their end token; repeated rows and null ids have
    pieces like any other; no rows give no pieces."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _stage(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(small_batches(spark), docs, sf_dir)

    return run


STAGES = [(name, _stage(f)) for name, f in [("toxicity", clean), ("exact_dedup", exact), ("minhash_dedup", near), ("suffix_dedup", passages), ("packing", pack)]]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can state neither the classifier nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None
