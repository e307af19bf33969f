"""From raw documents to tokens: the stages of a training-data pipeline over the operators of ``tidewatch.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last return
the columns of documents.  ``run`` writes each stage's rows as a table in the shared folder, reads it for the next one and removes
it once that has written its own; the last table stays, as the result reads it.
Null or empty texts, repeated rows, empty tables and extra columns are handled as the operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from tidewatch.session import shared_dir, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; learned from the labels of documents that reach this stage."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the smallest id."""
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("tokens", encode),
]

ORACLE_SQL = None  # near-duplicates and the tokenizer are beyond SQL; tests hold run() against brute force


def _remove(spark: SparkSession, table: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the stage before wrote is needed no more
            _remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
