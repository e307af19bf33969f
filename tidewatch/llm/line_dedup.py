"""Removal of repeated runs of lines, in DataFrame functions only.

Lines are what stands between line feeds.  Every line gets an id (64 hash bits); a document is the sequence of its line ids.
Doubling names the runs of ``min_lines`` lines at all places: from the names of w lines, the name of 2w lines is that of the pair (i, i + w),
and the name of a length between is that of two overlapping ones.  Doubling stays inside a document, so only the names are
shuffled, once to find the first place of each in the order of (doc_id, line) and once to mark the others.  A run that is not at the
first place of its name is deleted; longer repeated runs are unions of these, so no suffix array has to be built or ordered for them.

With ``min_words`` a run of fewer lines is deleted as well if it has so many words, down to a single line.  The runs named are
those that are long enough and would not be without their first or without their last line; others are unions of these.  The registered query leaves this off, as its SQL
takes two lines.

Null texts count as empty, an empty text is one empty line; texts of fewer lines than ``min_lines`` lose nothing.  Null ids come last in
the order.  Rows with equal ids do not remove from each other at equal places.  Empty tables give empty results; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.order_minhash import let, places

MIN_LINES = 2
LAST = (1 << 63) - 1  # stands for a null id


def run_names(lines: Column, length: int) -> Column:
    """Names of the runs of ``length`` lines at every place where one starts, by prefix doubling."""

    def combined(names: Column, shift: int) -> Column:
        pairs = lambda n: F.transform(
            F.when(F.size(n) > shift, F.sequence(F.lit(0), F.size(n) - 1 - shift)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.get(n, i), F.get(n, i + shift)),
        )
        return let(names, pairs)

    names, width = F.transform(lines, lambda x: F.xxhash64(x)), 1
    while width * 2 <= length:
        names, width = combined(names, width), width * 2
    return combined(names, length - width) if width < length else names


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))


def long_enough(lines: Column, min_lines: int, min_words: int | None) -> Column:
    """(start, length, name) of the shortest runs that start or end at a place and have ``min_lines`` lines or ``min_words`` words."""
    run = lambda i, n, name: F.struct(i.cast("int").alias("start"), F.lit(n).alias("length"), name.alias("name"))
    if min_words is None:
        return F.transform(run_names(lines, min_lines), lambda name, i: run(i, min_lines, name))
    words = F.transform(lines, lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))

    def of(words: Column) -> Column:
        count = lambda i, n: F.aggregate(F.slice(words, i + 1, n), F.lit(0), lambda a, w: a + w)
        parts = []
        for n in range(1, min_lines + 1):  # functions are applied at once
            enough = (lambda r: F.lit(True)) if n == min_lines else (lambda r: count(r["start"], n) >= min_words)
            shortest = (lambda r: (count(r["start"], n - 1) < min_words) | (count(r["start"] + 1, n - 1) < min_words)) if n > 1 else (lambda r: F.lit(True))
            fits = lambda r: enough(r) & shortest(r)
            parts.append(F.filter(F.transform(run_names(lines, n), lambda name, i: run(i, n, name)), fits))
        return F.concat(*parts)

    return let(words, of)


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """(id, hash, start, length): runs of ``min_lines`` lines (or ``min_words`` words) of documents that also stand earlier."""
    starts = _texts(docs).select("id", "hash", F.inline(long_enough(F.split("text", "\n"), min_lines, min_words)))
    place = F.struct("id", "start")
    intervals = starts.groupBy("name", "length").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("name", "length", "first")
    return starts.join(intervals, ["name", "length"]).filter(place > F.col("first")).select("id", "hash", "start", "length")


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, text) per row of ``docs``: maximal removed runs and the text without them."""
    removed = repeated_runs(docs, min_lines, min_words).groupBy("id", "hash").agg(F.collect_set(F.struct("start", "length")).alias("starts"))
    lines = F.split("text", "\n")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))))
    none = F.array().cast("array<int>")
    rows = _texts(docs).join(removed, ["id", "hash"], "left").select("id", "text", F.when(F.col("starts").isNotNull(), covered).otherwise(none).alias("covered"))
    new_run = lambda c: F.filter(c, lambda x, j: F.when(j == 0, True).otherwise(F.get(c, j - 1) != x - 1))
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(places(x), F.col("covered")), lambda i: F.get(x, i)), "\n"))
    return rows.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size("covered").cast("long").alias("n_removed"),
        F.size(let(F.col("covered"), new_run)).cast("long").alias("n_runs"),
        F.when(F.size("covered") > 0, kept).otherwise(F.col("text")).alias("text"),
    )
