"""Near-duplicate documents by HyperMinHash.

1. Every text becomes its set of word shingles (64-bit hashes) and a HyperMinHash sketch: the hash range is dealt to
   ``REGISTERS`` buckets and a bucket keeps, of its smallest hash, the number of leading zeros and ``MANTISSA`` further bits.
2. Texts with equal sets form a class; only one member of a class, the representative, goes on.
3. Bands of compressed registers propose pairs.  For the bands, registers without a hash borrow from others in a fixed random
   order, so that small sets do not meet because of what they lack.  In a band's bucket every member is first compared with the
   bucket's smallest one, so m members give m - 1 pairs; what that links forms groups.
4. Buckets that still hold several groups are gone through again: the members outside of the largest group are compared with all
   of it and with each other, in blocks of at most about ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles, so no link between groups is lost and no pairs are written out.
5. Compared means: the Jaccard estimate from the registers, corrected for accidental equality of registers, is not more than
   ``MARGIN`` standard errors below the threshold, and then the full sets decide.

Null and empty texts (also without a word) have an empty set and are linked with nothing.  Null ids are left out of all links:
such a row is its own component (null).  Rows with the same id are one node when their sets are equal; with different sets each
set is linked for its own and the id joins them.  Bands miss a pair at the threshold with probability (1 - 0.8**6)**40 = 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.components import connected_components
from tidewatch.llm.words import mix, shingle_set, word_hashes
from tidewatch.session import cut_lineage

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = 0xFFFF
MARGIN = 6.0
BLOCK = 1024
BLOCK_SHINGLES = 1 << 22  # long texts make smaller blocks; one text is never cut
_BITS = 52  # hash bits of a register's value; exact in a double
_U = np.uint64


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a set of hashes."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if not len(shingles):
        return out
    h = mix(shingles ^ _U(0x5851F42D4C957F2D))
    bucket = (h >> _U(_BITS)) % _U(REGISTERS)
    key = np.sort((bucket << _U(_BITS)) | (h & _U((1 << _BITS) - 1)))
    bucket = (key >> _U(_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    value = key[first] & _U((1 << _BITS) - 1)
    exponent = np.frexp(value.astype(np.float64))[1]  # 0 for the value 0
    zeros = _BITS - exponent
    rest = (value << zeros.astype(np.uint64)) & _U((1 << (_BITS - 1)) - 1)  # without the leading one
    out[bucket[first]] = (zeros.astype(np.uint16) << MANTISSA) | (rest >> _U(_BITS - 1 - MANTISSA)).astype(np.uint16)
    return out


def _chances(n: np.ndarray) -> np.ndarray:
    """P(the smallest of n / REGISTERS uniform values has z leading zeros), for each n and z."""
    low = 0.5 ** np.arange(1, _BITS + 1)
    load = n[:, None] / REGISTERS
    return np.exp(-load * low) - np.exp(-load * 2 * low)


def estimate(one: np.ndarray, many: np.ndarray, accidental: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of one register row with many, and the numbers of registers they rest on.

    Registers of different minima are equal with probability ``accidental`` = 2**-MANTISSA * sum over zeros of P_a * P_b; that
    many matches are taken off.
    """
    used = ((many != EMPTY) | (one != EMPTY)).sum(axis=1)
    same = ((many == one) & (one != EMPTY)).sum(axis=1)
    return (same - used * accidental) / np.maximum(1, used * (1 - accidental)), used


def densified(regs: np.ndarray) -> np.ndarray:
    """Rows of registers with the empty ones filled from others of the row, tried in the same random order for all rows."""
    out, tries = regs.copy(), 0
    place = np.arange(REGISTERS, dtype=np.uint64)
    row, col = np.nonzero(out == EMPTY)
    while len(row):
        tries += 1
        take = (mix(place + _U(tries << 16)) % _U(REGISTERS)).astype(np.int64)
        value = regs[row, take[col]]
        done = value != EMPTY
        out[row[done], col[done]] = value[done]
        row, col = row[~done], col[~done]
    return out


def _sketcher(size: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, words in zip(batch["doc_id"], word_hashes(batch["text"])):
                s = shingle_set(words, size)
                with np.errstate(over="ignore"):
                    digest = (int(s.sum(dtype=np.uint64)), int(mix(s ^ _U(0xA5A5)).sum(dtype=np.uint64)))
                rows.append((doc_id, len(s), *(np.array(digest, np.uint64).view(np.int64).tolist()), registers(s).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_1", "set_2", "registers"]).astype({"doc_id": "Int64"})

    return sketch


def _band_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        if not len(batch):
            continue
        regs = densified(np.frombuffer(b"".join(batch["registers"]), np.uint16).reshape(-1, REGISTERS)).reshape(-1, BANDS, ROWS)
        keys = np.broadcast_to(salt, regs.shape[:2]).copy()
        for k in range(ROWS):
            keys = mix(keys * _U(0x9E3779B97F4A7C15) + regs[:, :, k].astype(np.uint64))
        rep, n = (np.repeat(batch[c].to_numpy(), BANDS) for c in ("rep", "n_shingles"))
        yield pd.DataFrame({"rep": rep, "n_shingles": n, "band": keys.view(np.int64).ravel()})


def _probable(percent: int, inside: bool):
    """Rows of a block that may be linked with one on the other side; an outer row also with an outer one if ``inside``."""

    def keep(block: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(block["registers"]), np.uint16).reshape(-1, REGISTERS)
        n, outer = block["n_shingles"].to_numpy(float), block["outer"].to_numpy(bool)
        chance, level = _chances(n), percent / 100
        stays = np.zeros(len(block), bool)
        for k in np.flatnonzero(outer):
            guess, used = estimate(regs[k], regs, chance @ chance[k] * 0.5**MANTISSA)
            fit = guess >= level - MARGIN * np.sqrt(level * (1 - level) / np.maximum(1, used))
            fit &= 100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])
            fit &= True if inside else ~outer
            fit[k] = False
            if fit.any():
                stays[k] = True
                stays |= fit
        return block.loc[stays, ["item", "part", "rep", "outer"]]

    return keep


def _sets(size: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(w, size).tobytes() for w in word_hashes(batch["text"])]
            yield pd.DataFrame({"of": batch["doc_id"], "set": sets})

    return build


def _confirm(percent: int, inside: bool):
    """Links of outer rows of a block, by the exact sizes of the sets' intersections."""

    def confirm(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in block["set"]]
        rep, outer = block["rep"].to_numpy(), block["outer"].to_numpy(bool)
        size = np.array([len(x) for x in sets])
        elements, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(place, kind="stable")  # rows that hold each element
        holders, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(elements)))))
        at = np.concatenate(([0], np.cumsum(size)))
        links = []
        for k in np.flatnonzero(outer):
            mine = place[at[k] : at[k + 1]]
            both = np.bincount(np.concatenate([holders[first[e] : first[e + 1]] for e in mine]), minlength=len(sets))
            fit = 100 * both >= percent * (size + size[k] - both)
            fit &= True if inside else ~outer
            fit[k] = False
            links += [(rep[k], rep[j]) for j in np.flatnonzero(fit)[:1]] if not inside else [(rep[k], rep[j]) for j in _needed(fit, outer, k)]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return confirm


def _needed(fit: np.ndarray, outer: np.ndarray, k: int) -> list[int]:
    """The inner rows of a block are one group, so one link to them is as good as all; links between outer rows all count."""
    inner = np.flatnonzero(fit & ~outer)[:1]
    return [*inner, *np.flatnonzero(fit & outer & (np.arange(len(fit)) > k))]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; ``size`` words a shingle, links from ``percent`` on.

    ``component_id`` is the smallest doc_id reachable over links; ``kept`` marks the rows that carry it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = cut_lineage(
        texts.mapInPandas(_sketcher(size), "doc_id long, n_shingles long, set_1 long, set_2 long, registers binary")
    )
    identity = ["n_shingles", "set_1", "set_2"]
    linkable = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy(identity).agg(F.min("doc_id").alias("rep"))
    member = cut_lineage(linkable.select("doc_id", *identity).join(classes, identity).select("doc_id", *identity, "rep"))
    facts = linkable.join(member.filter("doc_id = rep").select("rep", *identity).distinct(), identity).filter("doc_id = rep")
    facts = facts.select("rep", "n_shingles", "registers")

    banded = facts.mapInPandas(_band_keys, "rep long, n_shingles long, band long")
    shared = banded.groupBy("band").agg(F.min(F.struct("rep", "n_shingles")).alias("least"), F.max("rep").alias("most")).filter("least.rep < most")
    crowded = cut_lineage(banded.join(shared, "band").select("band", "rep", "n_shingles", F.col("least.rep").alias("least"), F.col("least.n_shingles").alias("n_least")))

    def linked(rows: DataFrame, inside: bool) -> DataFrame:
        """Links (a, b) among rows (item, rep, n_shingles, outer): of outer rows to the item's inner ones, and among outer ones if ``inside``."""
        sides = {"outer": F.col("outer"), "inner": ~F.col("outer")}
        counted = rows.groupBy("item").agg(
            *[F.count(F.when(side, 1)).alias(f"n_{c}") for c, side in sides.items()],
            *[F.coalesce(F.sum(F.when(side, F.col("n_shingles"))), F.lit(0)).alias(f"shingles_{c}") for c, side in sides.items()],
        )
        blocks = {
            f"{c}s": F.least(f"n_{c}", F.greatest(F.ceil(F.col(f"n_{c}") / BLOCK), F.ceil(F.col(f"shingles_{c}") / BLOCK_SHINGLES))).cast("int") for c in sides
        }
        placed = rows.drop("n_shingles").join(counted, "item").withColumns(blocks)
        luck = F.xxhash64("rep")
        own = F.when(F.col("outer"), F.pmod(luck, "outers")).otherwise(F.pmod(luck, "inners")).cast("int")
        # a work item is a block of outer rows (x) with a block of inner rows (y >= 0) or with itself or another outer block (y < 0)
        meet_inner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        with_inner = F.when(
            F.col("outer"), F.transform(F.sequence(F.lit(0), F.col("inners") - 1), lambda y: meet_inner(F.col("own"), y))
        ).otherwise(F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda x: meet_inner(x, F.col("own"))))
        with_outer = F.transform(
            F.sequence(F.lit(0), F.col("outers") - 1),
            lambda o: meet_inner(F.greatest(F.col("own"), o), -1 - F.least(F.col("own"), o)),
        )
        one = (F.col("outers") == 1) & (F.col("inners") == 1)  # everything fits one work item
        parts = F.when(one, F.array(meet_inner(F.lit(0), F.lit(0))))
        parts = parts.otherwise(F.when(F.col("outer"), F.concat(with_inner, with_outer)).otherwise(with_inner) if inside else with_inner)
        dealt = placed.filter("n_outer > 0").withColumn("own", own).select("item", "rep", "outer", F.explode(parts).alias("part"))
        probable = cut_lineage(
            dealt.join(facts, "rep")
            .groupBy("item", "part")
            .applyInPandas(_probable(percent, inside), "item long, part struct<x:int,y:int>, rep long, outer boolean")
        )
        wanted = probable.select(F.col("rep").alias("wanted")).distinct()
        sets = texts.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi").mapInPandas(_sets(size), "of long, set binary")
        return (
            probable.join(sets, F.col("rep") == F.col("of"))
            .groupBy("item", "part")
            .applyInPandas(_confirm(percent, inside), "a long, b long")
        )

    others = crowded.filter("rep <> least")
    stars = others.select(F.col("least").alias("item"), "rep", "n_shingles", F.lit(True).alias("outer")).distinct()
    centres = others.select(F.col("least").alias("item"), F.col("least").alias("rep"), F.col("n_least").alias("n_shingles"), F.lit(False).alias("outer")).distinct()
    groups = cut_lineage(connected_components(linked(stars.unionByName(centres), inside=False)))

    placed = crowded.select("band", "rep", "n_shingles").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("band", "rep", "n_shingles", F.coalesce("root", "rep").alias("root"))
    weight = groups.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
    weighed = placed.groupBy("band", "root").agg(F.lit(1)).join(weight, "root", "left").select("band", "root", F.coalesce("weight", F.lit(1)).alias("weight"))
    largest = (
        weighed.groupBy("band")
        .agg(F.max(F.struct("weight", (-F.col("root")).alias("root"))).alias("top"), F.count(F.lit(1)).alias("roots"))
        .filter("roots > 1")
        .select("band", (-F.col("top.root")).alias("item"))
    )
    rest = placed.join(largest, "band").select("item", "rep", "n_shingles", (F.col("root") != F.col("item")).alias("outer")).distinct()
    bridges = linked(rest, inside=True)
    tree = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
    same_set = member.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = connected_components(tree.unionByName(bridges).unionByName(same_set))
    return (
        sketches.join(final, sketches["doc_id"] == final["node"], "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose document represents its component, with all their columns."""
    dropped = near_duplicates(docs, size, percent).filter("NOT kept").select(F.col("doc_id").alias("dropped")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return packed.join(dropped, F.col("id") == F.col("dropped"), "left_anti").select("row.*")
