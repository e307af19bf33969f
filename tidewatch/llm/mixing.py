"""Mixing sources to target weights.

Rows of a source are put in random order by a hash key, the words before each row are counted by a prefix sum and the source is
cut exactly at its budget; a budget above the source's size repeats the source in whole epochs first.

Size: number of words (maximal runs of characters other than space and \\x09-\\x0D), null and empty texts 0.  Sources in code
point order, null last, weigh 1, 2, 3 and so on, repeating.  A target is at most ``EPOCHS`` times its source's size; what is
above is shared again by weight.  The document at the cut gives as many of its words as the budget still needs.  A source without
words has target 0.  Repeated rows tie in the order and are interchangeable; null ids are hashed like a text of their own.

The prefix sum is in two steps so that no source meets in one task: key ranges ("chunks") are summed, the sums are accumulated
over the at most ``CHUNKS`` ranges of a source, and rows are accumulated inside their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

EPOCHS = 3
CHUNKS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def random_key(doc_id: Column, seed: str) -> Column:
    """60 random bits from the seed and the id; the same everywhere and on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source.

    Sharing again until no target is above its cap ends where every source gets min(cap, level * weight) with one level for all:
    sources are capped in order of cap / weight until the level of the remaining ones caps none of them.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", ((F.row_number().over(everything) - 1) % weights + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * EPOCHS)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.sum("weight").over(rest))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(all_))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final.level"), F.lit(0.0)) * F.col("weight")).alias("target"))
    )


def mix(docs: DataFrame, seed: str = "mix", weights: int = 3, chunks: int = CHUNKS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, key) per row of ``docs``."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return place(sized.withColumn("key", random_key(F.col("doc_id"), seed)), weights, chunks)


def place(sized: DataFrame, weights: int, chunks: int) -> DataFrame:
    rows = sized.withColumn("chunk", F.floor(F.col("key") / F.lit((1 << 60) // chunks)).cast("long"))
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    targets = source_targets(sums.select("source", F.col("chunk_size").alias("size")), weights).withColumnsRenamed({"source": "of"})
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("before_chunk", F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("of")))
        .select("of", F.col("chunk").alias("of_chunk"), "before_chunk", "source_size", "target")
    )
    inside = Window.partitionBy("source", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return (
        rows.withColumn("before_row", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk")))
        .withColumn("epochs", epochs)
        .withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("before_chunk") - F.col("before_row"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", "left")))
        .select("doc_id", "size", "source_size", "target", "taken", "source", "key")
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", weights: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as the mix takes it.

    A document at a cut, of which the mix takes a part of the words, is in the mix as a whole once more; one without words is in
    it once if its source takes part (has a target above 0, or no words at all).
    """
    times = (
        mix(docs, seed, weights)
        .withColumn("times", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int"))
        .groupBy("doc_id", "source", "size")
        .agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    )
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.col("source").cast("string").alias("from"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    per_row = F.ceil(F.col("times") / F.col("rows")).cast("int")  # repeated rows share what they take, each rounded up
    return packed.join(times.filter("times > 0"), same).select("row", F.explode(F.array_repeat(F.lit(1), per_row))).select("row.*")
