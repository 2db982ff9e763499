"""Corpus preparation in five stages; each stage's result is a table that the next one reads.

1. Documents predicted toxic go.
2. Of near-duplicates (SimHash components) the document with the least id stays.
3. Documents contaminated by benchmark items go.
4. Live-looking secrets are masked in the texts; widely copied examples stay.
5. What is left is packed into sequences of 2048 tokens.

The first four return the columns of ``documents``.  ``run`` returns one row per
packed piece.  Null texts pass the filters as empty texts do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofmark.llm import common, decontaminate, packing, secrets, simhash, tokens, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.clean(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.path("byte_bpe_50k.json"), end=0, size=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
