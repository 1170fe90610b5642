"""Corpus pipeline: five stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontam, neardup, pieces, secrets, toxicity
from gridloom.session import checkpoint_root, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels predicts to be toxic go (operator 5)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word similarity 0.8 or more, the document of the smallest doc_id stays (operator 2, with an exact way for pairs beyond its radius)."""
    return neardup.keep_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go (operator 3)."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind (operator 1)."""
    return secrets.redact(docs)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids; each batch's words are compared with the library (operator 4)."""
    return pieces.code(docs, docs.columns, check=True, decoded=False, kept=100_000)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("sentencepiece", in_pieces),
]

#: Hashing of shingles, log-odds and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; what each returns is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    top = f"{checkpoint_root(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{top}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
