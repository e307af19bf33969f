"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n long, id long, form string"
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER_TO_LOWER)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    by_cut = {}
    for w in words:
        for cut in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_cut.setdefault(cut, []).append(w)
    partners = {w: set() for w in words}
    for group in by_cut.values():
        for a in group:
            partners[a].update(b for b in group if near(a, b))
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def last(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], last(w), n, len(partners[w]), None if form[w] is None else words[form[w]]) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = rows_of(spelling.spelling_variants(docs))
    assert got == grouped(words)
    assert sum(r[1] is not None for r in got) > 50


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_trie_nodes_are_prefixes(spark, parts):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(300)} | {"a" * k for k in range(30)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), F.col("word")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    named = {}
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for k, node in enumerate(r.nodes):
            assert named.setdefault(node, r.word[:k]) == r.word[:k]
    assert len(named) == len(set(named.values())) == len({w[:k] for w in words for k in range(len(w) + 1)})
    assert [r.word for r in sorted(rows, key=lambda r: r.id)] == words


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_words(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 8))): rng.choice((3, 3, 6, 7, 20, 50, 120)) for _ in range(500)}
    got = rows_of(spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words)


def test_long_chain_of_forms(spark):
    words = {"q" * 5 + "".join("ab"[i < k] for i in range(12)): 3 * 2**k for k in range(13)}
    got = rows_of(spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and len({r[2] for r in got}) == 1


def test_awkward_rows(spark):
    long = "x" * 20_000
    texts = [
        (1, None), (2, ""), (3, " \n "), (None, "Nothing nothing NOTHING nothin nothin nothin"), (4, f"{long} {long} {long} {long}y {long}y {long}y {long}y {long}y {long}y"),
        (5, "repeat repeat repeat"), (5, "repeat repeat repeat"), (6, "Étude étude Étude Étude İstanbul İstanbul İstanbul"), (7, "tiny tiny tiny four four four"),
    ]
    docs = spark.createDataFrame([(d, t, "w", 1, 2, "f") for d, t in texts], SCHEMA).repartition(3)
    assert rows_of(spelling.spelling_variants(docs)) == grouped(counted(texts))
    assert rows_of(spelling.spelling_variants(spark.createDataFrame([], SCHEMA))) == []
