"""The corpus pipeline: stages over `documents`, each working on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontaminate as benchmarks
from kindred.llm import mixing, secrets, toxicity
from kindred.llm.common import durable, table
from kindred.llm.ngram_join import one_of_each_group

#: Documents that score so much or more are toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches TOXIC go; the lexicon is learned from all labels but the held-out fold."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, lexicon).where(f"toxicity < {TOXIC}").select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with these or other numbers and names, go."""
    return benchmarks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the copies of each."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL cannot express the learned and iterative stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
