"""Order-dependent building blocks that stay parallel when one key is hot.

A window over a whole key would put every row of that key into one task.  Here a
key's time line is cut into chunks (default one day): rows are ordered inside
(key, chunk) only, and one summary row per (key, chunk) carries the state from
chunk to chunk.  The summary holds at most one row per key and chunk, so its
size is bounded by the calendar, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.operators.chains import follow_releases

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys equal each other; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def _chunk(pos: str, width: int) -> Column:
    return F.floor(F.col(pos) / F.lit(width))


def lag_in_order(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    width: int = DAY_US,
    into: str = "prev",
) -> DataFrame:
    """``values`` of the preceding row of the key as struct ``into`` (null on the first row).

    A null key is a key like any other; rows without a position come first in their key.
    """
    keys = list(keys)
    order = [F.col(c) for c in (pos, *tie)]
    packed = F.struct(*values)
    df = df.withColumn("__chunk", _chunk(pos, width))
    inner = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    last = df.groupBy(*keys, "__chunk").agg(F.max_by(packed, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__chunk")
    carry = last.select(*keys, "__chunk", F.lag("__last").over(across).alias("__carry"))
    return (
        join_same(df.withColumn("__prev", F.lag(packed).over(inner)), carry, [*keys, "__chunk"])
        .withColumn(into, F.coalesce("__prev", "__carry"))
        .drop("__chunk", "__prev", "__carry")
    )


def running_counts(df: DataFrame, keys: Sequence[str], pos: str, tie: Sequence[str], flags: dict[str, Column], width: int = DAY_US) -> DataFrame:
    """Add for every flag the number of rows of the key, up to and with this one by (pos, tie), on which it holds.

    Counted inside (key, chunk) and raised by the sums of earlier chunks; ``__chunk`` stays for steps that need no other partitioning.
    """
    keys = list(keys)
    held = {f"__{name}": F.when(flag, 1) for name, flag in flags.items()}
    df = df.withColumn("__chunk", _chunk(pos, width))
    inner = Window.partitionBy(*keys, "__chunk").orderBy(pos, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__chunk").agg(*[F.count(one).alias(name) for name, one in held.items()])
    carry = totals.select(*keys, "__chunk", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in held])
    counted = join_same(df.withColumns({name: F.count(held[f"__{name}"]).over(inner) for name in flags}), carry, [*keys, "__chunk"])
    return counted.select(*df.columns, *[(F.col(name) + F.col(f"__{name}")).alias(name) for name in flags])


def newest_by_rank(
    rows: DataFrame, probes: DataFrame, keys: Sequence[str], pos: str, tie: str, classes: dict[str, tuple[Column, int]], keep: int, width: int = DAY_US
) -> DataFrame:
    """At every distinct probe (keys, pos) the newest ``keep`` rows of each class at or before it, as arrays ordered by (pos, tie).

    ``classes`` names conditions on ``rows`` and how far back a probe looks, its edge included.  An element holds ``pos``, ``tie``, the
    other columns of ``rows`` and ``rank``, its number inside (key, class).

    An as-of join by rank: a probe knows how many rows of each class lie before it.  Those it wants lie in two neighbouring buckets
    of ``keep`` ranks, and probes between the same bucket edges form a cell, so rows are brought together once per cell and never once
    per probe.  Every row takes part in few cells: a bucket meets two cells of its own class, plus one per bucket of the other
    classes filled meanwhile.  Null keys are keys like any other.
    """
    keys, conds, reaches = list(keys), [c for c, _ in classes.values()], [r for _, r in classes.values()]
    counts, cell, lists = ([f"__{letter}{i}" for i in range(len(conds))] for letter in "nba")
    others = [c for c in rows.columns if c not in (*keys, pos, tie)]
    told = rows.select(*keys, pos, tie, *others, F.coalesce(*[F.when(cond, F.lit(i)) for i, cond in enumerate(conds)]).alias("__class"))
    line = told.filter(F.col(pos).isNotNull() & F.col("__class").isNotNull()).unionByName(probes.select(*keys, pos), allowMissingColumns=True)
    # signals come before probes of the same time
    line = running_counts(line.withColumn("__side", F.col("__class").isNull()), keys, pos, ["__side", tie], {n: F.col("__class") == i for i, n in enumerate(counts)}, width)
    at = line.filter("__side").dropDuplicates([*keys, "__chunk", pos]).select(*keys, pos, *counts, *[F.floor(F.col(n) / keep).alias(b) for n, b in zip(counts, cell)])
    rank = F.coalesce(*[F.when(F.col("__class") == i, F.col(n)) for i, n in enumerate(counts)])
    ranked = line.filter("NOT __side").select(*keys, "__class", F.floor(rank / keep).alias("__bucket"), F.struct(pos, tie, *others, rank.alias("rank")).alias("__row"))
    spot = [*keys, "__class", "__bucket"]
    wanted = F.array(*[F.struct(F.lit(i).alias("__class"), (F.col(b) - back).alias("__bucket")) for i, b in enumerate(cell) for back in (0, 1)])
    met = at.select(*keys, pos, *cell, F.explode(wanted).alias("w")).select(*keys, "w.*", *cell, pos).filter("__bucket >= 0")
    found = met.groupBy(*spot, *cell).agg(F.min(pos).alias("__since"))
    reach = F.coalesce(*[F.when(F.col("__class") == i, F.lit(r)) for i, r in enumerate(reaches)])
    near = join_same(ranked, found, spot).filter(F.col(f"__row.{pos}") >= F.col("__since") - reach)  # of use to the first probe of the cell
    panel = near.groupBy(*keys, *cell).agg(*[F.sort_array(F.collect_list(F.when(F.col("__class") == i, F.col("__row")))).alias(a) for i, a in enumerate(lists)])
    out = join_same(at, panel, [*keys, *cell], "left")

    def newest(a: str, n: str, reach: int) -> Column:
        first = F.col(a)[0]["rank"]  # ranks in an array are consecutive
        last_ones = F.slice(a, F.greatest(F.col(n) - keep + 2 - first, F.lit(1)).cast("int"), F.least(F.col(n) - first + 1, F.lit(keep)).cast("int"))
        near = F.filter(last_ones, lambda r: r[pos] >= F.col(pos) - reach)
        return F.when((F.size(a) > 0) & (F.col(n) >= first), near).otherwise(F.array())

    return out.select(*keys, pos, *[newest(a, n, reach).alias(name) for name, a, n, reach in zip(classes, lists, counts, reaches)])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    values: Sequence[str],
    direction: str = "backward",
    tie: str | None = None,
    width: int | None = DAY_US,
    into: str = "match",
) -> DataFrame:
    """Attach to each left row the nearest right row of its key, at or before (or at or after) it.

    Both sides are unioned and swept once; a right row at the same position matches.
    ``into`` is a struct of ``values`` and null without a match.  ``width=None`` sweeps a
    whole key at once, for inputs with at most one row per key and calendar day.
    Null keys match each other; a row without a position has no match and is none, and every left row stays.
    """
    keys = list(keys)
    forward = direction == "forward"
    tie_col = F.col(tie) if tie else F.lit(0)
    l_cols = left.columns
    ls = left.select(*keys, F.col(left_pos).alias("__pos"), F.lit(1).alias("__side"), F.lit(None).alias("__tie"),
                     F.struct(*l_cols).alias("__row"), F.lit(None).alias("__val"))
    rs = right.select(*keys, F.col(right_pos).alias("__pos"), F.lit(0).alias("__side"), tie_col.alias("__tie"),
                      F.lit(None).alias("__row"), F.struct(*values).alias("__val"))
    both = ls.unionByName(rs.filter("__pos IS NOT NULL")).withColumn("__chunk", _chunk("__pos", width) if width else F.lit(0))

    pos, tied = (F.desc("__pos"), F.desc("__tie")) if forward else (F.asc("__pos"), F.asc("__tie"))
    part = [*keys, "__chunk"] if width else keys
    inner = Window.partitionBy(*part).orderBy(pos, "__side", tied).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = both.withColumn("__hit", F.last("__val", ignorenulls=True).over(inner)).filter("__side = 1")
    placed = F.col("__pos").isNotNull()
    if not width:
        return swept.select("__row.*", F.when(placed, F.col("__hit")).alias(into))

    edge = F.min_by if forward else F.max_by
    rank = F.when(F.col("__side") == 0, F.struct("__pos", "__tie"))
    summary = both.groupBy(*keys, "__chunk").agg(edge("__val", rank).alias("__edge"))
    chunk_order = F.desc("__chunk") if forward else F.asc("__chunk")
    across = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "__chunk", F.last("__edge", ignorenulls=True).over(across).alias("__carry"))
    hit = F.when(placed, F.coalesce("__hit", "__carry"))
    return join_same(swept.select(*keys, "__chunk", "__pos", "__row", "__hit"), carry, [*keys, "__chunk"]).select("__row.*", hit.alias(into))


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; Spark limits each group before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).filter(F.col("__rn") <= k).drop("__rn")


def flag_first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, into: str) -> DataFrame:
    """Keep all rows and flag the first ``k`` of each key.

    Only ``k`` rows per key are ordered; the others compare with the k-th position.
    """
    keys = list(keys)
    position = F.struct(*order)
    head = first_k(df.select(*keys, *[c for c in order if c not in keys]), keys, [F.col(c) for c in order], k)
    bound = head.groupBy(*keys).agg(F.max(position).alias("__bound"))
    return join_same(df, bound, keys).withColumn(into, position <= F.col("__bound")).drop("__bound")


def greedy_accept(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    hold: str,
    max_hold: int,
    width: int = DAY_US,
) -> DataFrame:
    """Rows accepted by a per-key throttle, marked ``accepted``.

    A row is accepted when ``pos >= p + hold`` for the last accepted ``p``.  ``pos`` must be unique per key; a row without a
    position is not accepted, a null key is a key like any other.  No hold is above ``max_hold``.  Chains are followed by
    composing what each stretch of ``width`` does to a release (``chains``): a fixed number of exchanges, whatever the size of a key.
    """
    return follow_releases(df, keys, pos, hold, max_hold, width)


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[dict, tuple], list[tuple]],
    schema: str,
    finish: Callable[[dict], list[tuple]] | None = None,
) -> DataFrame:
    """Sequential fold per key over rows sorted by ``order``.

    For inputs already reduced to one row per key and calendar day.  Rows stream
    through ``step(state, row)``; ``state`` is a dict that starts empty for each key,
    so memory does not grow with the partition.
    """
    keys = list(keys)
    cols = [*keys, *[c for c in df.columns if c not in keys]]
    names = [p.split()[0] for p in schema.split(",")]
    nk = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        current = None
        for pdf in batches:
            out: list[tuple] = []
            for row in zip(*(pdf[c].tolist() for c in cols)):
                row = tuple(None if v != v else v for v in row[:nk]) + row[nk:]  # NaN stands for a null number
                if row[:nk] != current:
                    if current is not None and finish:
                        out.extend(current + r for r in finish(state))
                    current, state = row[:nk], {}
                out.extend(current + r for r in step(state, row[nk:]))
            yield pd.DataFrame(out, columns=names)
        if current is not None and finish:
            yield pd.DataFrame([current + r for r in finish(state)], columns=names)

    ordered = df.select(*cols).repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], eps: float = 0.001) -> DataFrame:
    """Exact linear-interpolation quantiles per group as columns ``q0``, ``q1``, ...

    A mergeable sketch brackets every wanted rank; rows below the bracket are only counted and just the bracket (about
    ``2 * eps`` of the group, equal values merged) is ordered.  Groups under ``4 / eps`` rows are ordered whole, larger ones
    never are.  Groups without a value have no row.
    """
    groups = list(groups)
    grid = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-eps, eps)})
    rows = df.filter(F.col(value).isNotNull())
    sketch = rows.groupBy(*groups).agg(
        F.percentile_approx(value, grid, int(10 / eps)).alias("__grid"), F.count("*").alias("__n"),
        F.min(value).alias("__min"), F.max(value).alias("__max"),
    )
    small = F.col("__n") * eps < 4
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(p).alias("p"),
                (F.col("__min") if p - eps <= 0 else F.when(small, F.col("__min")).otherwise(F.col("__grid")[grid.index(p - eps)])).alias("lo"),
                (F.col("__max") if p + eps >= 1 else F.when(small, F.col("__max")).otherwise(F.col("__grid")[grid.index(p + eps)])).alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    targets = sketch.select(*groups, "__n", F.explode(wanted).alias("t")).select(*groups, "__n", "t.*")
    merged = rows.groupBy(*groups, value).agg(F.count("*").alias("__c"))
    near = join_same(merged, targets, groups).filter(F.col(value) <= F.col("hi"))
    spot = [*groups, "i"]
    below = near.filter(F.col(value) < F.col("lo")).groupBy(*spot).agg(F.sum("__c").alias("__below"))
    inside = join_same(near.filter(F.col(value) >= F.col("lo")), below, spot, "left")
    run = Window.partitionBy(*spot).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.coalesce("__below", F.lit(0)) + F.sum("__c").over(run)
    h = (F.col("__n") - 1) * F.col("p")
    ranked = inside.withColumn("__cum", cum).withColumn("__h", h)
    found = ranked.groupBy(*spot).agg(
        F.min(F.when(F.col("__cum") > F.floor("__h"), F.col(value))).alias("a"),
        F.min(F.when(F.col("__cum") > F.ceil("__h"), F.col(value))).alias("b"),
        F.first("__h").alias("h"),
    )
    q = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    wide = [F.max(F.when(F.col("i") == i, q)).alias(f"q{i}") for i in range(len(probs))]
    return found.groupBy(*groups).agg(*wide)


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, lo: str, hi: str, width: int
) -> DataFrame:
    """Equi-join form of ``lo <= point <= hi``: intervals are spread over buckets of ``width``."""
    keys = list(keys)
    p = points.withColumn("__b", F.floor(F.col(point) / width))
    i = intervals.withColumn(
        "__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    )
    return p.join(i, [*keys, "__b"]).filter(F.col(point).between(F.col(lo), F.col(hi))).drop("__b")
