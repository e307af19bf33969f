"""Order MinHash fingerprints, sensitive to edit distance, in DataFrame functions only.

A text becomes the sequence of its tokens (pieces of at most ``PIECE`` characters of what stands between white space), and this the
sequence of k-mers of ``K`` tokens; with fewer tokens all of them are one k-mer.  Every k-mer is numbered by occurrence, so that
repeats differ.  The hashes of numbered k-mers are dealt to ``SLOTS`` slots; a slot selects its ``SELECT`` smallest hashes, puts their
k-mers back into text order and hashes that tuple.  Two fingerprints are as alike as the share of slots with equal tuples among
the slots that either one uses: moving a passage keeps the k-mers but not their order.

The fingerprint is written as hexadecimal digits, eight a slot, "-" for a slot without k-mer; it depends on the text alone.  Null and
empty texts have no k-mer: all slots are "-", and their likeness is 1 to each other and 0 to others.

The edited text of a document is cut at its middle and goes on with the beginning of the next document, in descending order of
ids.  Null ids come last in that order.  Of rows with one id (or without) the least text stands for the document when it is the
next one of others; all of them have the same next document.  Empty tables give empty results, other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window

K, SELECT, SLOTS, PIECE = 3, 2, 64, 16
BOUNDS = 1024  # at most so many bounds of id ranges are taken to the driver
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
LOWEST = -(1 << 63)  # stands for a null id


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(array: Column) -> Column:
    """0 .. size - 1."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def kmer_hashes(text: Column) -> Column:
    """Hashes of the k-mers of a text in text order."""
    tokens = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    whole = lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: F.when(F.size(h) >= K, runs(h)).otherwise(whole(h)))


def numbered(kmers: Column) -> Column:
    """One number per k-mer, sorted: above the hash of the k-mer with its number of occurrence, below its place in the text.

    Plain numbers sort much faster than structs.  A place takes ``PLACE_BITS`` bits (longer texts wrap), the hash the others.
    """
    sorted_ = F.sort_array(F.transform(kmers, lambda h, i: h.bitwiseAND(~PLACE) + i.cast("long").bitwiseAND(PLACE)))  # occurrences together

    def mark(a: Column, starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(a))
        number = lambda e, n: F.xxhash64(e.bitwiseAND(~PLACE), n).bitwiseAND(~PLACE) + e.bitwiseAND(PLACE)
        return F.sort_array(F.flatten(F.transform(starts, lambda s, j: F.transform(F.slice(a, s + 1, end(j) - s), number))))

    differ = lambda a, i: F.shiftright(F.get(a, i), PLACE_BITS) != F.shiftright(F.get(a, i - 1), PLACE_BITS)
    first = lambda a: F.filter(places(a), lambda i: F.when(i == 0, True).otherwise(differ(a, i)))
    return let(sorted_, lambda a: let(first(a), lambda starts: mark(a, starts)))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text."""
    slot = lambda e: F.shiftright(e, 58)  # the leading bits, -32 .. 31, so a slot's hashes stand together

    def codes(b: Column) -> Column:
        firsts = F.filter(places(b), lambda i: F.when(i == 0, True).otherwise(slot(F.get(b, i)) != slot(F.get(b, i - 1))))

        def entry(i: Column) -> Column:
            chosen = F.filter(F.slice(b, i + 1, SELECT), lambda e: slot(e) == slot(F.get(b, i)))
            turned = F.transform(chosen, lambda e: F.shiftleft(e.bitwiseAND(PLACE), 64 - PLACE_BITS - 1) + F.shiftrightunsigned(e, PLACE_BITS + 1))
            in_order = F.transform(F.sort_array(turned), lambda e: e.bitwiseAND((1 << (63 - PLACE_BITS)) - 1))
            code = F.lower(F.substring(F.lpad(F.hex(F.xxhash64(in_order)), 16, "0"), 1, 8))
            return F.struct((slot(F.get(b, i)) + SLOTS // 2).cast("int").alias("slot"), code.alias("code"))

        return F.map_from_entries(F.transform(firsts, entry))

    written = lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.coalesce(m[k], F.lit("-"))), " ")
    return let(let(numbered(kmer_hashes(F.coalesce(text, F.lit("")))), codes), written)


def likeness(one: str, other: str) -> Column:
    """Share of equal slots among those that either fingerprint uses; 1 if none is used."""
    pairs = F.zip_with(F.split(F.col(one), " "), F.split(F.col(other), " "), lambda a, b: F.when((a != "-") | (b != "-"), (a == b).cast("int")))
    used = F.filter(pairs, lambda same: same.isNotNull())
    return let(used, lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.filter(u, lambda same: same == 1)) / F.size(u)))


def id_ranges(docs: DataFrame, ranges: int) -> Column:
    """Number of the range that an id falls into, ascending with the ids; bounds are quantiles of the ids."""
    bounds = docs.select(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("id")))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, fingerprint, next_fingerprint) with the document that follows in descending order of ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    texts = texts.withColumn("range", id_ranges(texts.select("id"), min(BOUNDS, 4 * parts)))
    ranged = texts.withColumn("fingerprint", fingerprint(F.col("text")))
    this = F.struct("id", "text", "fingerprint")
    # the first document of every range follows the last one of the range above; at most BOUNDS rows
    tops = texts.groupBy("range").agg(F.max("id").alias("top")).withColumnRenamed("range", "of")
    heads = (
        texts.join(F.broadcast(tops), (F.col("range") == F.col("of")) & (F.col("id") == F.col("top")))
        .groupBy("of", "id")
        .agg(F.min("text").alias("text"))
        .select("of", F.struct("id", "text", fingerprint(F.col("text")).alias("fingerprint")).alias("head"))
    )
    order = Window.orderBy("of")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = heads.select("of", F.coalesce(F.lag("head").over(order), F.last("head").over(whole)).alias("below"))
    # rows of one id share what follows them; inside a range it is found by order
    down = Window.partitionBy("range").orderBy(F.desc("id"), "text")
    peers = Window.partitionBy("range", "id").orderBy("text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the row after the last one with this id
    following = ranged.withColumn("ahead", F.lead(this).over(down))
    following = following.withColumn("ahead", F.last("ahead").over(peers))
    joined = following.join(F.broadcast(edge), F.col("range") == F.col("of"))
    after = F.coalesce("ahead", "below")
    return joined.select("doc_id", "text", "fingerprint", after["text"].alias("next_text"), after["fingerprint"].alias("next_fingerprint"))


def order_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs``."""
    pairs = edited_pairs(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half)))
    pairs = pairs.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return pairs.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
