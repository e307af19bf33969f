"""Folds and bounded, class-wise samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 10_000  # labelled rows of each class that a model is fitted on


def held_out(doc_id: Column) -> Column:
    """Whether a row must not be learned from: crc32 of the id as text leaves 1 modulo 3 (null ids: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_sample(labels: DataFrame, label: str, bound: int = SAMPLE) -> DataFrame:
    """(id, label, weight): about ``bound`` rows a class outside the held-out fold; ``weight`` undoes the sampling.

    Rows are chosen by a hash of the id.  Rows without id or label, or with a label other than 0 and 1, are left out; of
    contradicting labels of one id the larger counts.  The number of rows is binomial with mean at most ``bound`` per class, so
    the sample is small enough to be sent to all tasks whatever the size of the table.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .filter(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    share = {r["label"]: min(1.0, bound / r["n"]) for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    luck = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.filter(luck < share).withColumn("weight", 1 / share)
