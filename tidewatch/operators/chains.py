"""Throttles as chains of releases, followed without a loop over jobs.

A row at ``pos`` that is accepted releases its key at ``pos + hold``; the next accepted row is the first one at or after that.  What a
stretch of time does to a key is a step function from the release that enters it to the release that leaves it.  Steps of a
stretch are computed from its rows alone, those of a longer stretch from the steps of its parts, and a last pass per key
runs from the start over the longest stretches.  Down again, every stretch that a chain enters learns its release and
marks its rows.  The number of passes is fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

FAN = 32  # stretches of a level in one of the next
NEVER = np.iinfo(np.int64).min  # release of a key before its first row


def _segments(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], pa.Table]) -> Iterator[pa.RecordBatch]:
    """Call ``work(rows, number of the stretch of each row)`` with whole stretches; ``__ch_first`` marks where one begins."""
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        segment = np.cumsum(rows.column("__ch_first").to_numpy())
        if ((np.diff(rows.column("__ch_pos").to_numpy()) < 0) & (np.diff(segment) == 0)).any():
            raise RuntimeError("rows of a stretch are not in order")
        yield from work(rows, segment).to_batches()

    for batch in batches:
        starts = np.flatnonzero(batch.column("__ch_first").to_numpy(zero_copy_only=False))
        last = int(starts[-1]) if len(starts) else 0
        if len(starts) and (last or held):
            if last:
                held.append(batch.slice(0, last))
            yield from done()
        held.append(batch.slice(last))
    if held:
        yield from done()


def _following(segment: np.ndarray, pos: np.ndarray, release: np.ndarray) -> np.ndarray:
    """Index of the first later row of the same segment at or after each row's release; the number of rows where there is none."""
    n = len(pos)
    where = np.concatenate((segment, segment))
    when = np.concatenate((release, pos))
    is_row = np.repeat(np.array([0, 1], np.int8), n)  # a row at the very release is found
    order = np.lexsort((is_row, when, where))
    before = np.cumsum(is_row[order])
    found = np.empty(2 * n, np.int64)
    found[order] = before
    found = np.maximum(found[:n], np.arange(n) + 1)  # without a hold the next row follows
    return np.where((found < n) & (segment[np.minimum(found, n - 1)] == segment), found, n)


def _steps(max_hold: int):
    """Rows (``__ch_pos``, ``__ch_release``) become the steps of their stretch: entered at or before ``__ch_pos``, left with ``__ch_release``."""

    def work(rows: pa.Table, segment: np.ndarray) -> pa.Table:
        pos, release = rows.column("__ch_pos").to_numpy(), rows.column("__ch_release").to_numpy()
        start = rows.column("__ch_start").to_numpy()
        n = len(pos)
        last = _following(segment, pos, release)
        last = np.where(last == n, np.arange(n), last)
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        out = release[last]
        same = segment[1:] == segment[:-1]
        kept = np.flatnonzero(np.append(~same | (out[1:] != out[:-1]), True))  # of equal neighbours the last stands for all
        # a release that enters lies less than max_hold behind the start, so what follows the first step beyond is never met first
        near = (segment[kept][1:] != segment[kept][:-1]) | (pos[kept][:-1] < start[kept][1:] + max_hold)
        kept = kept[np.insert(near, 0, True)]
        rows = rows.set_column(rows.schema.get_field_index("__ch_release"), "__ch_release", pa.array(out))
        return rows.take(pa.array(kept)).drop_columns(["__ch_first", "__ch_start"])

    return work


def _reached(rows: pa.Table, segment: np.ndarray) -> np.ndarray:
    """Rows on the chain that starts at the first row at or after ``__ch_enter`` of each stretch; none where that is null."""
    pos, release = rows.column("__ch_pos").to_numpy(), rows.column("__ch_release").to_numpy()
    entered = rows.column("__ch_enter")
    n = len(pos)
    open_ = entered.is_valid().to_numpy() & (pos >= entered.fill_null(NEVER).to_numpy())
    before = np.insert((segment[1:] == segment[:-1]) & open_[:-1], 0, False)
    jump = np.append(_following(segment, pos, release), n)
    reached = np.append(open_ & ~before, False)
    while (jump[:n] < n).any():
        reached[jump[np.flatnonzero(reached)]] = True
        reached[n] = False
        jump = jump[jump]
    return reached[:n]


def _entries(rows: pa.Table, segment: np.ndarray) -> pa.Table:
    """The steps that a chain goes through, with the release by which it enters them."""
    hit = np.flatnonzero(_reached(rows, segment))
    release, enter = rows.column("__ch_release").to_numpy(), rows.column("__ch_enter").to_numpy()
    same = np.insert(segment[hit][1:] == segment[hit][:-1], 0, False) if len(hit) else np.zeros(0, bool)
    came = np.where(same, release[np.roll(hit, 1)], enter[hit]) if len(hit) else np.zeros(0, np.int64)
    out = rows.take(pa.array(hit))
    return out.set_column(out.schema.get_field_index("__ch_enter"), "__ch_enter", pa.array(came, pa.int64())).drop_columns(["__ch_first", "__ch_pos", "__ch_release"])


def _marks(rows: pa.Table, segment: np.ndarray) -> pa.Table:
    hit = _reached(rows, segment)
    return rows.append_column("accepted", pa.array(hit)).drop_columns(["__ch_first", "__ch_pos", "__ch_release", "__ch_enter"])


def _in_order(rows: DataFrame, *part: str, alone: Column | None = None) -> DataFrame:
    """``rows`` sorted by stretch and position, with ``__ch_first``; a row that is ``alone`` is a stretch by itself."""
    first = F.row_number().over(Window.partitionBy(*part).orderBy("__ch_pos")) == 1
    return rows.withColumn("__ch_first", first if alone is None else first | alone)


def _enter(rows: DataFrame, entries: DataFrame, *part: str) -> DataFrame:
    """Tell every stretch its release; sorted rows stay sorted, as an outer join streams its left side."""
    told = entries.withColumnsRenamed({p: f"{p}_of" for p in part})
    return rows.join(told, [F.col(p) == F.col(f"{p}_of") for p in part], "left").drop(*[f"{p}_of" for p in part])


def _run(rows: DataFrame, work, schema: str) -> DataFrame:
    return rows.mapInArrow(lambda batches: _segments(batches, work), schema)


def follow_releases(df: DataFrame, keys: Sequence[str], pos: str, hold: str, max_hold: int, width: int) -> DataFrame:
    """``df`` with ``accepted``; see ``temporal.greedy_accept``.

    Rows of a key in one stretch of ``width`` are in memory of one task at a time, by position and release alone; the last pass
    sees of a key only steps within ``max_hold`` of the starts of its longest stretches.
    """
    wide = max(FAN, -(-16 * max_hold // width)) * width
    at = F.col(pos).cast("long")
    # rows without a position are never accepted; they are spread and no stretch holds two of them
    spread = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]), F.lit(1024))
    name = F.to_json(F.struct(F.lit(1).alias("k"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    rows = df.withColumns({
        "__ch_key": F.concat(F.when(at.isNull(), "none").otherwise("at"), name),  # never null: plain equality serves null keys too
        "__ch_n": F.coalesce(F.floor(at / width), spread), "__ch_pos": F.coalesce(at, F.lit(0)), "__ch_release": F.coalesce(at + F.col(hold), F.lit(0)),
    })
    rows = _in_order(rows, "__ch_key", "__ch_n", alone=F.col("__ch_key").startswith("none"))
    step = "`__ch_key` string, `__ch_n` bigint, `__ch_pos` bigint, `__ch_release` bigint"
    # steps take the same exchange as the last pass: both read all columns
    up = rows.withColumn("__ch_start", F.col("__ch_n") * width)
    small = _run(up, lambda part, segment: _steps(max_hold)(part, segment).select(["__ch_key", "__ch_n", "__ch_pos", "__ch_release"]), step)
    small = _in_order(small.filter(F.col("__ch_key").startswith("at")).select("__ch_key", "__ch_n", F.floor(F.col("__ch_pos") / wide).alias("__ch_wide"), "__ch_pos", "__ch_release"), "__ch_key", "__ch_wide")
    large = _run(
        small.select("__ch_key", F.col("__ch_wide").alias("__ch_n"), "__ch_pos", "__ch_release", "__ch_first", (F.col("__ch_wide") * wide).alias("__ch_start")), _steps(max_hold), step
    )
    top = _in_order(large.withColumn("__ch_enter", F.lit(NEVER + 1)), "__ch_key")
    entry = "`__ch_key` string, `__ch_n` bigint, `__ch_enter` bigint"
    groups = _run(top, _entries, entry).withColumnRenamed("__ch_n", "__ch_wide")
    parts = _run(_enter(small, groups, "__ch_key", "__ch_wide").drop("__ch_wide"), _entries, entry)
    told = _enter(rows, parts, "__ch_key", "__ch_n").drop("__ch_key", "__ch_n")
    return _run(told, _marks, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "accepted boolean"]))
