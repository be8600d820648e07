"""Corpus pipeline: language filter, exact and near deduplication, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from braidwork.llm.common import discard, store, table
from braidwork.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that op5 calls `und`: null, empty or without a letter. The others get the language that op5 finds, by which windows are filled."""
    return language_id.keep_identified(docs.select(*COLUMNS), least=None, relabel=True)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space runs as one space) the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the smallest doc_id stays."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes, one row for each document and pass."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows filled to the mixture's own proportions of each source and language found."""
    queues = docs.withColumn("source", F.to_json(F.struct("source", "lang")))
    return packing.pack(queues, tokenizer_file("word_bpe_49k.json"), remember=400_000)  # workers that other stages used have less room


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_exact),
    ("jaccard_join", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Learned filters, drawn mixtures and a tokenizer have no SQL; the tests compare stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read is not None:  # no later stage reads it
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
