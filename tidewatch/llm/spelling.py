"""Spelling variants of a corpus' words, by a dictionary of pairs of trie nodes.

* Words are counted; those of ``min_length`` code points and ``min_count`` occurrences form the vocabulary.
* The vocabulary is range-sorted forward and reversed.  A sorted scan numbers the nodes of the trie: a word shares the nodes of the
  prefix it has in common with its predecessor and opens new ones for the rest.  Nodes that span two partitions are renumbered
  by the words at the partitions' edges (two per partition).
* A word of length L has the L + 1 pairs (node of the first i, node of the last L - i code points) and the L pairs that skip
  position i.  Words that differ by one replaced code point share the pair that skips it; a word with one more code
  point shares the pair skipping that one with the split pair of the shorter word.  A pair of integers stands for the two strings
  exactly, so the join finds all near words and no others.  Of a run of equal code points only the first is skipped
  against split pairs, so that every two near words meet in one pair.
* At most one word has a pair as a split and at most one per letter of the alphabet by skipping, so groups are bounded by the
  alphabet; members' counts and best partner are taken inside the group, pairs of words are never listed.

A word's form is its near word of largest count (ties: smallest in code point order), if that is at least ``ratio`` times its own
count.  Counts grow along forms, so chains have at most log2(largest count) hops; roots are found by doubling.

Null texts have no words, a null doc_id counts as the text ``null`` in the rule that drops code points, repeated rows count again,
long texts and words need memory in proportion to the longest one.  An empty table has no words.  Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP_EVERY = 97  # one in so many (document, run) loses a code point
HELD = 200_000  # words counted in a task before they are handed on
SHIFT = 40  # a number is the partition above this bit and a count below it


def _counter(min_length: int, drop_every: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                runs = Counter(RUN.findall((text.as_py() or "").encode().lower().decode()))  # bytes: lower-cases A-Z only
                key = doc_id.as_py()
                start = zlib.crc32(b"null:" if key is None else f"{key}:".encode())
                for run, n in runs.items():
                    if len(run) < min_length:
                        continue
                    h = zlib.crc32(run.encode(), start)
                    if h % drop_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_length:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()

    return count


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_counter(min_length, drop_every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _number_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, ...) with ``id`` (in sorted order), ``nodes`` of every prefix, ``fresh`` (code point unlike the one
    before), ``part`` and ``edge`` (first or last row of the partition)."""
    part = TaskContext.get().partitionId()
    base = part << SHIFT
    last, nodes, opened, seen = "", [base], 1, 0
    waiting: list | None = None

    def ready(end: bool) -> pa.RecordBatch:
        batch, ids, paths, fresh = waiting
        edge = [i == base for i in ids]
        if end:
            edge[-1] = True
        added = [pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.bool_())), pa.array([part] * len(ids), pa.int64()), pa.array(edge)]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "id", "nodes", "fresh", "part", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting:
            yield ready(False)
        ids, paths, fresh = [], [], []
        for word in batch.column(0).to_pylist():
            common, most = 0, min(len(last), len(word))
            while common < most and last[common] == word[common]:
                common += 1
            new = len(word) - common
            nodes = nodes[: common + 1] + list(range(base + opened, base + opened + new))
            opened, last = opened + new, word
            ids.append(base + seen)
            seen += 1
            paths.append(nodes)
            fresh.append([k == 0 or word[k] != word[k - 1] for k in range(len(word))])
        waiting = [batch, ids, paths, fresh]
    if waiting:
        yield ready(True)


def _edge_fixes(edges: list) -> list[tuple[int, list[int]]]:
    """Per partition the true numbers of the nodes that its first word shares with words of earlier partitions."""
    parts: dict[int, list] = {}
    for row in sorted(edges, key=lambda r: r["id"]):
        parts.setdefault(row["part"], []).append(row)
    fixes, last, true = [], None, None
    for part in sorted(parts):
        first, end = parts[part][0], parts[part][-1]
        fix: list[int] = []
        if last is not None:
            a, b = last["key"], first["key"]
            common = 0
            while common < min(len(a), len(b)) and a[common] == b[common]:
                common += 1
            fix = true[: common + 1]
            fixes.append((part, fix))
        base = part << SHIFT
        last, true = end, [fix[x - base] if x - base < len(fix) else x for x in end["nodes"]]
    return fixes


def trie_nodes(rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` with the numbers ``nodes`` of all prefixes of ``key`` (the root first), its place ``id`` in sorted order and ``fresh``.

    Equal prefixes have equal numbers and different ones different numbers.  Keys must be distinct.
    """
    spark = rows.sparkSession
    keyed = rows.select(key.alias("key"), *rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    scanned = keyed.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(
        _number_nodes, f"{schema}, id long, nodes array<bigint>, fresh array<boolean>, part long, edge boolean"
    )
    scanned = cut_lineage(scanned)
    fixes = _edge_fixes(scanned.filter("edge").select("key", "id", "part", "nodes").collect())  # two rows per partition
    fixed = spark.createDataFrame(pa.table({"of": pa.array([p for p, _ in fixes], pa.int64()), "fix": pa.array([f for _, f in fixes], pa.list_(pa.int64()))}))
    place = lambda x: (x - F.shiftleft("part", SHIFT)).cast("int")
    true = F.transform("nodes", lambda x: F.coalesce(F.get("fix", place(x)), x))
    return scanned.join(fixed, F.col("part") == F.col("of"), "left").withColumn("nodes", true).drop("key", "part", "edge", "of", "fix")


SPLIT, FRESH, REPEAT = 0, 1, 2  # a pair without a skip; skipping the first of a run of equal code points; skipping another


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``words`` (word, n) as (id, word, n), ids in code point order, and (id, n_near, best (n, back)) of words with near words.

    ``back`` is the negative id of the near word of largest count, the smallest on ties.
    """
    forward = trie_nodes(words.select("word", "n"), F.col("word")).withColumnsRenamed({"nodes": "heads"})
    both = trie_nodes(forward.withColumnsRenamed({"id": "word_id", "fresh": "new"}), F.reverse("word"))
    both = cut_lineage(both.select(F.col("word_id").alias("id"), "word", "n", "heads", F.col("nodes").alias("tails"), "new"))
    size = F.size("new")
    pair = lambda i, tail, kind: F.struct(F.get("heads", i).alias("head"), F.get("tails", tail).alias("tail"), kind.cast("byte").alias("kind"))
    split = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, size - i, F.lit(SPLIT)))
    skip = F.transform("new", lambda f, i: pair(i, size - i - 1, F.when(f, FRESH).otherwise(REPEAT)))
    pairs = both.select("id", "n", F.explode(F.concat(split, skip)).alias("p")).select("p.*", "id", "n")
    met = pairs.groupBy("head", "tail").agg(F.collect_list(F.struct("kind", "id", "n")).alias("m")).filter(F.size("m") > 1)

    def partners(x: Column) -> Column:
        other = lambda y: (y["id"] != x["id"]) & F.when(x["kind"] == SPLIT, y["kind"] == FRESH).otherwise((y["kind"] != SPLIT) | (x["kind"] == FRESH))
        return F.transform(F.filter("m", other), lambda y: F.struct(y["n"].alias("n"), (-y["id"]).alias("back")))

    each = met.select(F.explode(F.transform("m", lambda x: F.struct(x["id"].alias("id"), partners(x).alias("near")))).alias("e"))
    each = each.select("e.id", F.size("e.near").cast("long").alias("n_near"), F.array_max("e.near").alias("best")).filter("n_near > 0")
    return both.select("id", "word", "n"), each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def chain_ends(links: DataFrame) -> DataFrame:
    """(id, root): the last id reached from every id of ``links`` (id, up), by doubling; a chain never returns to its start."""
    far = cut_lineage(links.select("id", "up", F.lit(False).alias("done")))
    ended = None
    while True:
        ahead = far.select(F.col("id").alias("at"), F.col("up").alias("further"))
        if ended is not None:
            ahead = ahead.unionByName(ended.select(F.col("id").alias("at"), F.col("up").alias("further")))
        seen = far.join(ahead, F.col("up") == F.col("at"), "left")
        step = cut_lineage(seen.select("id", F.coalesce("further", "up").alias("up"), F.col("further").isNull().alias("done")))
        finished = step.filter("done")
        ended = finished if ended is None else ended.unionByName(finished)
        far = step.filter("NOT done")
        if far.isEmpty():
            return ended.select("id", F.col("up").alias("root"))


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n)."""
    named, near = near_words(words)
    told = named.join(near, "id", "left").withColumn("up", F.when(F.col("best.n") >= F.col("n") * ratio, -F.col("best.back")))
    told = cut_lineage(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "up", F.when(F.col("up").isNotNull(), F.col("best.n")).alias("form_n")))
    ends = chain_ends(told.filter("up IS NOT NULL").select("id", "up"))
    spelled = lambda name, key: told.select(F.col("id").alias(key), F.col("word").alias(name))
    return (
        told.join(ends, "id", "left").join(spelled("form", "form_id"), F.col("up") == F.col("form_id"), "left")
        .join(spelled("last", "last_id"), F.col("root") == F.col("last_id"), "left")
        .select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
    )


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """Variants of the words of ``docs`` (doc_id, text)."""
    return variant_groups(cut_lineage(word_counts(docs, min_length, min_count)), ratio)
