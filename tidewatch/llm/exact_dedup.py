"""Exact deduplication by a compressed fingerprint exchange.

Every input partition sorts the 64-bit fingerprints of its texts, splits them by their leading bits into one block per owner
and sends each block Golomb-Rice coded.  An owner decodes the blocks of its range, finds fingerprints met more than once and
answers every sender with a bitmap over the sender's own sorted list.  Only the texts of marked rows are then shuffled, and
equality is decided on their bytes.

Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the row with the largest doc_id
stays (null ids lose against any id; if all are null one row stays).  Of repeated rows (same id and text) exactly one stays.
An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from tidewatch.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_ROWS = 1_000_000  # rows of a partition that are sent as one sorted list

_SENT = (
    "src long, owner int, n int, rice int, quotients binary, remainders binary, several binary, counts binary, "
    "doc_ids array<bigint>, raws array<bigint>, shas array<binary>"
)


def rice_encode(values: np.ndarray, bits: int) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of sorted distinct values below 2**bits: parameter, unary quotients, packed remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    rice = max(0, int(np.log2(0.69 * 2.0**bits / len(values)))) if len(values) else 0
    quotient = (gaps >> np.uint64(rice)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    shifts = np.arange(rice - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return rice, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def rice_decode(n: int, rice: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """Inverse of ``rice_encode``."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(rice)
    if rice:
        rest = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * rice].reshape(n, rice)
        for k in range(rice):
            gaps |= rest[:, k].astype(np.uint64) << np.uint64(rice - 1 - k)
    return np.cumsum(gaps, dtype=np.uint64)


def _sender(owner_bits: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block = TaskContext.get().partitionId(), 0
        ids: list = []
        raws: list = []
        shas: list[bytes] = []

        def flush() -> pd.DataFrame:
            prints = np.frombuffer(b"".join(s[:8] for s in shas), dtype=">u8").astype(np.uint64)
            order = np.argsort(prints, kind="stable")
            prints = prints[order]
            owners = (prints >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(prints), np.int64)
            rest = prints & np.uint64((1 << (64 - owner_bits)) - 1)
            rows = []
            for owner in np.unique(owners):
                at = np.flatnonzero(owners == owner)
                values, counts = np.unique(rest[at], return_counts=True)
                rice, quotients, remainders = rice_encode(values, 64 - owner_bits)
                mine = order[at]
                rows.append(
                    (
                        (part << 20) + block, int(owner), len(values), rice, quotients, remainders, np.packbits(counts > 1).tobytes(),
                        counts.astype("<u4").tobytes(), [ids[k] for k in mine], [raws[k] for k in mine], [shas[k] for k in mine],
                    )
                )
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _SENT.split(", ")])

        for batch in batches:
            shas += [hashlib.sha256(t.encode().lower() if isinstance(t, str) else b"").digest() for t in batch["text"]]
            ids += [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            raws += [int(k) for k in batch["raw"]]
            if len(shas) >= BLOCK_ROWS:
                yield flush()
                ids, raws, shas, block = [], [], [], block + 1
        if shas:
            yield flush()

    return send


def _answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """Owner's side: mark the fingerprints that more than one row has."""
    lists = [rice_decode(b.n, b.rice, b.quotients, b.remainders) for b in blocks.itertuples()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    met_twice = values[counts > 1]
    marks = []
    for b, mine in zip(blocks.itertuples(), lists):
        several = np.unpackbits(np.frombuffer(b.several, np.uint8))[: b.n].astype(bool)
        marks.append(np.packbits(several | np.isin(mine, met_twice, assume_unique=True)).tobytes())
    return pd.DataFrame({"src": blocks["src"], "owner": blocks["owner"], "marks": marks})


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sender's side: rows with their mark."""
    for batch in batches:
        for b in batch.itertuples():
            marks = np.unpackbits(np.frombuffer(b.marks, np.uint8))[: b.n].astype(bool)
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(b.doc_ids, dtype="Int64"),
                    "raw": b.raws,
                    "text_sha256": [s.hex() for s in b.shas],
                    "suspect": np.repeat(marks, np.frombuffer(b.counts, "<u4")),
                }
            )


def exact_duplicates(docs: DataFrame, owner_bits: int | None = None) -> DataFrame:
    """(doc_id, raw, text_sha256, keep_id, group_size, kept) per row; ``raw`` is xxhash64 of the text as it is.

    ``owner_bits``: 2**owner_bits owners, by default as many as shuffle partitions.
    """
    spark = docs.sparkSession
    if owner_bits is None:
        owner_bits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sent = cut_lineage(texts.withColumn("raw", F.xxhash64("text")).mapInPandas(_sender(owner_bits), _SENT))
    marks = (
        sent.select("src", "owner", "n", "rice", "quotients", "remainders", "several")
        .groupBy("owner")
        .applyInPandas(_answer, "src long, owner int, marks binary")
    )
    rows = cut_lineage(
        sent.select("src", "owner", "n", "counts", "doc_ids", "raws", "shas")
        .join(marks, ["src", "owner"])
        .mapInPandas(_open, "doc_id long, raw long, text_sha256 string, suspect boolean")
    )
    suspects = rows.filter("suspect")
    wanted = suspects.select(F.col("doc_id").alias("wanted")).distinct()
    groups = (
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
        .withColumn("text", F.translate("text", UPPER, LOWER))
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # repeated rows are numbered before the join, so that a large group stays spread by id
    order = Window.partitionBy("doc_id", "text_sha256").orderBy("raw")
    decided = (
        suspects.withColumn("nth", F.row_number().over(order))
        .join(groups, "text_sha256")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))
    )
    columns = ["doc_id", "raw", "text_sha256", "keep_id", "group_size", "kept"]
    alone = rows.filter("NOT suspect").select(
        "doc_id", "raw", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    return decided.select(columns).unionByName(alone.select(columns))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns (whatever they are called)."""
    keys = (
        exact_duplicates(docs)
        .groupBy("doc_id", "raw")
        .agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("rows"))
        .filter("NOT any_kept OR rows > 1")
    )
    keys = cut_lineage(keys)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"),
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("raw"))
    single = packed.join(keys, same, "left_anti")
    repeated = packed.join(keys.filter("any_kept"), same, "left_semi").dropDuplicates(["id", "hash"])
    return single.select("row.*").unionByName(repeated.select("row.*"))
