"""The training-data pipeline: stages over `documents`, each one operator of crawlframe.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of `documents`. Stages work on whatever rows they get:
null and empty texts, repeated rows and empty tables have the results that the
operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlframe.llm import mixing, near_copies, packing, secret_scan, toxicity
from crawlframe.llm.common import query, table
from crawlframe.session import scratch

#: Part of the tokens that the mixture may take; no document is taken twice here.
SHARE, EPOCHS = 0.9, 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the segment model, fitted on the labelled rows among them, does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near copies (0.8 of their five-word shingles), the one with the smallest id."""
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows taken by the hierarchical budgets of domain, language and source."""
    taken = mixing.mix(docs, share=SHARE, epochs=EPOCHS)
    return taken.drop("__domain", "__epoch", "__tokens")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their place in a training sequence."""
    return packing.pack_documents(docs, packing.word_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Model fitting, fingerprints and tokenizers cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
