"""Event study: event selection, baselines, group statistics and comparisons.

Results are long tables (group columns, horizon, measures).  Clusters are found on one
row per symbol and day, which the calendar bounds, whatever the number of trades.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import scoring as S, stats as X
from tidewatch.operators.outcomes import HORIZONS, day_returns, dip_days
from tidewatch.operators.temporal import exact_quantiles, first_k, fold_sorted, interval_join, join_same
from tidewatch.session import cut_lineage, deal_out

WINDOW_DAYS, MIN_INSIDERS = 7, 2
VALUE_THRESHOLDS = (100_000, 500_000, 1_000_000)
# What the hypotheses read of a trade once the rows of a week are one.
STUDY_COLUMNS = ("symbol", "transaction_type", "total_value", "filing_date", "is_plan", "is_csuite", "is_director", "is_healthcare")


def insider_week_dedup(trades: DataFrame) -> DataFrame:
    """Largest trade per symbol, insider, ISO week of the filing and type.

    Rows are dealt out before they are ordered: a scan's task would have to order all it reads, however large its part of a file is.
    """
    keys = ["symbol", "insider_name", "__week", "transaction_type"]
    keyed = trades.withColumn("__week", F.trunc("filing_date", "week"))
    return first_k(deal_out(keyed, *keys), keys, [F.desc("total_value"), F.asc("trade_id")], 1).drop("__week")


FEW_SYMBOLS = 500_000  # up to this many go to every task


def healthcare_flags(trades: DataFrame) -> DataFrame:
    """Per symbol whether some and whether every trade is a healthcare row, stored."""
    flag = F.coalesce("is_healthcare", F.lit(False))
    return cut_lineage(trades.groupBy("symbol").agg(F.bool_or(flag).alias("some"), F.bool_and(flag).alias("every")))


def few(symbols: DataFrame) -> bool:
    return symbols.count() <= FEW_SYMBOLS


def healthcare_scope(trades: DataFrame, told: DataFrame) -> DataFrame:
    """Trades without those of symbols that have no healthcare row at all; ``told`` is ``healthcare_flags``.

    The symbol is a key of every step of the study, so rows of these symbols reach no result on healthcare rows; left out here they are
    not exchanged.  Too many symbols for every task leave the trades as they are.  A null symbol meets no price and leaves too.
    """
    some = told.filter("some").select("symbol")
    return trades.join(F.broadcast(some), "symbol", "left_semi").select(*trades.columns) if few(some) else trades


def study_trades(trades: DataFrame, types: Sequence[str], where: Column | None = None, columns: Sequence[str] = STUDY_COLUMNS) -> DataFrame:
    """``insider_week_dedup`` of the given types, stored as several passes read it; ``where`` tests the rows that are left.

    The type is a key of the deduplication, so other types leave before it.
    """
    kept = insider_week_dedup(trades.filter(F.col("transaction_type").isin(*types)))
    return cut_lineage((kept if where is None else kept.filter(where)).select(*columns))


def healthcare_symbols(trades: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Symbols with a healthcare row among the deduplicated trades of all types, stored.

    Of a symbol whose rows agree nothing has to be deduplicated to know this; the others are.  ``told`` is ``healthcare_flags`` if it has been taken already.
    """
    told = healthcare_flags(trades) if told is None else told
    sure, mixed = told.filter("every").select("symbol"), told.filter("some AND NOT every").select("symbol")
    if not mixed.head(1):
        return sure
    kept = insider_week_dedup(trades.join(F.broadcast(mixed), "symbol", "left_semi")).filter("is_healthcare")
    return cut_lineage(sure.unionByName(kept.select("symbol").distinct()))


def discretionary(trades: DataFrame, *types: str) -> DataFrame:
    """Rows known to be outside a plan (null flags drop out) of the given types."""
    return trades.filter((F.col("is_plan") == F.lit(False)) & F.col("transaction_type").isin(*types))


def prices_of(prices: DataFrame, symbols: DataFrame) -> DataFrame:
    """Prices of the given symbols, which go to every task while they are few."""
    return prices.join(F.broadcast(symbols) if few(symbols) else symbols, "symbol", "left_semi")


# --- clusters ------------------------------------------------------------------------------


def insider_days(trades: DataFrame) -> DataFrame:
    """One row per symbol and filing date: counts, name range (min <> max means two insiders)."""
    return trades.groupBy("symbol", F.unix_date("filing_date").alias("day")).agg(
        F.count("*").alias("n"),
        F.min("insider_name").alias("lo"),
        F.max("insider_name").alias("hi"),
        F.count_if(F.col("transaction_type") == "BUY").alias("buys"),
        F.count_if(F.col("transaction_type") == "SELL").alias("sells"),
        F.bool_or("is_csuite").alias("csuite"),
        F.sum(F.col("total_value").cast("decimal(18,2)")).cast("double").alias("value"),
    )


def greedy_windows(days: DataFrame, mode: str, width: int = WINDOW_DAYS) -> DataFrame:
    """Greedy windows ``[day, day + width]`` per symbol over ``insider_days`` rows.

    ``cluster``: windows with two insiders, dated at their last day; a jump counts the
    window's rows from the current row, so it may reach into later days.
    ``single``: windows with one insider, dated at their first day; every window jumps.
    ``second``: windows with two insiders, dated at the day the second one appears.
    """

    def resolve(state, row_limit):
        queue, out = state["queue"], []
        while queue and (row_limit is None or queue[0][0] + width < row_limit):
            first = queue[0]
            skip = state["skip"]
            if skip >= first[1]:
                state["skip"] = skip - first[1]
                queue.pop(0)
                continue
            win = [r for r in queue if r[0] <= first[0] + width]
            rows = sum(r[1] for r in win)
            low, high, second = win[0][2], win[0][3], None
            for r in win:
                low, high = min(low, r[2]), max(high, r[3])
                if second is None and low != high:
                    second = r[0]
            pair = second is not None
            if pair != (mode == "single"):
                day = first[0] if mode == "single" else second if mode == "second" else win[-1][0]
                out.append(
                    (first[0], day, rows, sum(r[4] for r in win), sum(r[5] for r in win), any(r[6] for r in win),
                     round(float(sum(r[7] for r in win)), 2))
                )
            if pair or mode == "single":
                state["skip"] = skip + rows
            else:
                state["skip"] = 0
                queue.pop(0)
        return out

    def step(state, row):
        if not state:
            state.update(queue=[], skip=0)
        out = resolve(state, row[0])
        state["queue"].append(row)
        return out

    def finish(state):
        return resolve(state, None)

    schema = (
        "symbol string, start_day int, event_day int, n_rows long, buys long, sells long, is_csuite boolean, total_value double"
    )
    found = fold_sorted(days, ["symbol"], ["day"], step, schema, finish)
    return found.withColumn("event_date", F.date_from_unix_date("event_day")).withColumn(
        "dominant_type", F.when(F.col("buys") >= F.col("sells"), "BUY").otherwise("SELL")
    )


def with_insider_count(windows: DataFrame, trades: DataFrame, width: int = WINDOW_DAYS) -> DataFrame:
    """Exact number of distinct insiders of each window."""
    people = trades.select("symbol", F.unix_date("filing_date").alias("__day"), "insider_name").distinct()
    spans = windows.select("symbol", "start_day").withColumn("__end", F.col("start_day") + width)
    n = interval_join(people, spans, ["symbol"], "__day", "start_day", "__end", width + 1).groupBy(
        "symbol", "start_day"
    ).agg(F.count_distinct("insider_name").alias("n_insiders"))
    return windows.join(n, ["symbol", "start_day"])


def cluster_events(trades: DataFrame) -> DataFrame:
    """Clusters of discretionary trades by two or more insiders."""
    return with_insider_count(greedy_windows(insider_days(trades), "cluster"), trades)


def single_buy_events(trades: DataFrame) -> DataFrame:
    buys = trades.filter("transaction_type = 'BUY'")
    return greedy_windows(insider_days(buys), "single")


def cluster_buy_events(buys: DataFrame) -> DataFrame:
    """Buy clusters entered on the day the second insider appears."""
    return with_insider_count(greedy_windows(insider_days(buys), "second"), buys)


def lone_buys(buys: DataFrame, width: int = WINDOW_DAYS) -> DataFrame:
    """Buys without another insider's buy of the symbol within ``width`` days on either side."""
    day = F.unix_date("filing_date")
    days = buys.groupBy("symbol", "filing_date").agg(F.min("insider_name").alias("lo"), F.max("insider_name").alias("hi"))
    w = Window.partitionBy("symbol").orderBy(day).rangeBetween(-width, width)
    alone = days.withColumn("lo", F.min("lo").over(w)).withColumn("hi", F.max("hi").over(w)).filter("lo = hi")
    return buys.join(alone.select("symbol", "filing_date"), ["symbol", "filing_date"], "left_semi")


# --- baselines -----------------------------------------------------------------------------


def _hash_rank(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _long_returns(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = F.explode(
        F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret")) for h in HORIZONS])
    )
    return rows.select(*keys, pairs.alias("p")).select(*keys, "p.horizon", "p.ret").filter("ret IS NOT NULL")


def _row_returns(prices: DataFrame) -> DataFrame:
    """Every price row with its index, the symbol's row count and the returns ahead."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = prices.select(
        "symbol", "date", "close", (F.row_number().over(w) - 1).alias("idx"),
        F.count("*").over(Window.partitionBy("symbol")).alias("n"),
        *[F.lead("close", k).over(w).alias(f"__f{k}") for k in HORIZONS.values()],
    )
    rets = [((F.col(f"__f{k}") - F.col("close")) / F.col("close") * 100).alias(f"ret_{h}") for h, k in HORIZONS.items()]
    return rows.select("symbol", "date", "close", "idx", "n", *rets)


Scope = Callable[[DataFrame], DataFrame]


def _all(rows: DataFrame) -> DataFrame:
    return rows


def symbol_scope(symbols: DataFrame, within: bool = True) -> Scope:
    """Rows of the given symbols (one row each), or those of all others; a null symbol is among the others.

    Told after rows have met by symbol: baselines over parts of one price table then share its exchange.  A semi-join would be moved ahead
    of it, and of an equality the test for nulls.
    """
    told = symbols.filter("symbol IS NOT NULL").select(F.col("symbol").alias("__own"))
    told = F.broadcast(told) if few(symbols) else told
    return lambda rows: rows.join(told, F.col("symbol").eqNullSafe(F.col("__own")), "left").filter(F.col("__own").isNotNull() if within else F.col("__own").isNull()).drop("__own")


def dealt_returns(prices: DataFrame) -> DataFrame:
    """Row returns for several baselines, which then share one exchange of the prices."""
    return _row_returns(deal_out(prices.select("symbol", "date", "close"), "symbol"))


def random_baseline(
    prices: DataFrame, samples: int = 5000, seed: int = 42, name: str = "random", scope: Scope = _all, line: DataFrame | None = None
) -> DataFrame:
    """Returns of reproducibly drawn days of every symbol in scope with more than 30 rows.

    Rows are ordered by a hash of (symbol, index, seed), so the draw does not depend on
    partitioning; it is without replacement.  ``line`` is ``dealt_returns`` of the prices if it has been taken already.
    """
    sizes = scope(prices.groupBy("symbol").agg(F.count("*").alias("__n"))).filter("__n > 30")
    share = sizes.agg(F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(samples), F.count("*")))).alias("__share"))  # one row
    rows = scope(_row_returns(prices) if line is None else line).filter("n > 30")
    max_idx = F.col("n") - max(HORIZONS.values()) - 1
    eligible = rows.filter((max_idx >= 1) & (F.col("idx") < max_idx))
    rank = F.row_number().over(
        Window.partitionBy("symbol").orderBy(_hash_rank(F.col("symbol"), F.col("idx"), F.lit(seed)))
    )
    drawn = eligible.withColumn("__rank", rank).crossJoin(F.broadcast(share))
    drawn = drawn.filter((F.col("__rank") <= F.least("__share", max_idx)) & (F.col("close") > 0))
    return _long_returns(drawn.withColumn("baseline", F.lit(name)), ["baseline", "symbol"])


def dip_baseline(prices: DataFrame, per_symbol: int = 50, seed: int = 45, name: str = "dip", scope: Scope = _all, line: DataFrame | None = None) -> DataFrame:
    """Returns after days of a 2 % drop, at most ``per_symbol`` reproducibly drawn ones; a day has one price, which its symbol names."""
    named = F.count("symbol").over(Window.partitionBy("symbol"))  # of a plain test for nulls the exchange would become another one
    rows = scope(dip_days(_row_returns(prices) if line is None else line)).withColumn("__named", named).filter("__named > 0 AND date IS NOT NULL")
    order = [F.asc(_hash_rank(F.col("symbol"), F.col("idx"), F.lit(seed)))]
    drawn = first_k(rows, ["symbol"], order, per_symbol).filter("close > 0")
    return _long_returns(drawn.withColumn("baseline", F.lit(name)), ["baseline", "symbol"])


# --- statistics ----------------------------------------------------------------------------


RETS = [f"ret_{h}" for h in HORIZONS]


SMALL = 4000  # groups of one symbol below this many events are ordered whole
_CODES: dict[tuple, int] = {}


def _code(group: str | None, direction: str | None, baseline: str) -> Column:
    """Number of a group; rows carry numbers, names are put back on the finished groups."""
    return F.lit(_CODES.setdefault((group, direction, baseline), len(_CODES)))


def _named(rows: DataFrame) -> DataFrame:
    """(sub_group, direction, baseline) of the ``code`` of every row."""
    names = ("sub_group", "direction", "baseline")
    of = {name: F.array(*[F.lit(key[i]).cast("string") for key in _CODES]) for i, name in enumerate(names)}
    return rows.select(*[F.get(of[name], F.col("code")).alias(name) for name in names], *[c for c in rows.columns if c != "code"])


def group_rows(events: DataFrame, groups: Sequence[tuple[str, Column, str, str]]) -> DataFrame:
    """Returns of every event and ``members``, the numbers of the (sub_group, direction, baseline) groups it falls in.

    One narrow row per event, whatever the number of groups; they are taken apart inside the aggregation.
    """
    member = F.array_compact(F.array(*[F.when(cond, _code(g, d, b)) for g, cond, d, b in groups]))
    return events.select(*RETS, member.alias("members")).filter(F.size("members") > 0)


def _baseline_members(baselines: DataFrame) -> DataFrame:
    """Baseline returns in the form of ``group_rows``: a group of its own without a name."""
    rets = [F.when(F.col("horizon") == h, F.col("ret")).alias(f"ret_{h}") for h in HORIZONS]
    known = sorted({b for _, _, b in list(_CODES)})
    code = F.coalesce(*[F.when(F.col("baseline") == b, _code(None, None, b)) for b in known])
    return baselines.select(*rets, F.array(code).alias("members"))


def _hits(direction: Column, ret: Column) -> Column:
    return F.when(direction == "sell", ret < 0).when(direction == "buy", ret > 0).otherwise(F.abs(ret) > 1)


def winsorize(rows: DataFrame, keys: Sequence[str], value: str = "ret", pct: float = 0.01, min_n: int = 10) -> DataFrame:
    """Clip to the exact outer percentiles of each group; groups under ``min_n`` stay as they are."""
    keys = list(keys)
    bounds = exact_quantiles(rows, keys, value, [pct, 1 - pct])
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("__n"))
    clip = F.greatest(F.least(F.col(value), F.col("q1")), F.col("q0"))
    joined = join_same(rows, join_same(bounds, sizes, keys), keys)
    return joined.withColumn("clipped", F.when(F.col("__n") < min_n, F.col(value)).otherwise(clip)).drop("q0", "q1", "__n")


def _plan(median: bool, eps: float) -> tuple[list[float], list[float]]:
    probs = [0.01, 0.99] + ([0.5] if median else [])
    return probs, sorted({round(min(max(p + d, 0.0), 1.0), 9) for p in probs for d in (-eps, eps)})


def _heads(ret: Column, grid: Sequence[float], eps: float) -> dict[str, Column]:
    return {
        "n": F.count(ret), "mean": F.avg(ret), "var": F.var_samp(ret), "std": F.stddev_pop(ret),
        "__min": F.min(ret), "__max": F.max(ret), "__grid": F.percentile_approx(ret, list(grid), int(10 / eps)),
    }


def moments(
    rows: DataFrame, keys: Sequence[str], median: bool = True, extra: dict[str, Column] | None = None, eps: float = 0.001, head: DataFrame | None = None
) -> DataFrame:
    """n, mean, median, variances and winsorised mean/variance per group, plus ``extra`` aggregates; quantiles are exact.

    Two passes over ``rows``.  The first takes the moments and a mergeable sketch whose cells bracket the wanted ranks; the second counts and
    sums what lies between the brackets and keeps single values only inside them (about ``2 * eps`` of a group each).  From
    these cells follow the exact quantiles and the sums of the clipped values.  Groups under ``4 / eps`` rows are one bracket.
    ``head`` is the first pass if it has been taken already; its groups are then few and go to every task.
    """
    keys, c = list(keys), F.col
    probs, grid = _plan(median, eps)
    few = head is not None
    if not few:
        told = _heads(c("ret"), grid, eps) | (extra or {})
        head = rows.groupBy(*keys).agg(*[agg.alias(name) for name, agg in told.items()])
    kept = [x for x in head.columns if x not in (*keys, "__min", "__max", "__grid")]
    small = c("n") * eps < 4
    lows = [F.when(small, c("__min")).otherwise(c("__grid")[grid.index(round(p - eps, 9))]) for p in probs]
    highs = [F.when(small, c("__max")).otherwise(c("__grid")[grid.index(round(p + eps, 9))]) for p in probs]
    edges = head.select(*keys, c("mean").alias("__mean"), *[x.alias(f"__lo{i}") for i, x in enumerate(lows)], *[x.alias(f"__hi{i}") for i, x in enumerate(highs)])
    inside = F.lit(False)
    zone = F.lit(0)
    for i in range(len(probs)):
        inside = inside | c("ret").between(c(f"__lo{i}"), c(f"__hi{i}"))
        zone = zone + (c("ret") > c(f"__hi{i}")).cast("int")
    placed = join_same(rows.filter("ret IS NOT NULL").select(*keys, "ret"), F.broadcast(edges) if few else edges, keys).select(
        *keys, "ret", (c("ret") - c("__mean")).alias("__d"), F.when(inside, c("ret")).alias("__value"), zone.alias("__zone")
    )
    cells = placed.groupBy(*keys, "__zone", "__value").agg(
        F.count("*").alias("__c"), F.min("ret").alias("__at"), F.sum("__d").alias("__s1"), F.sum(c("__d") * c("__d")).alias("__s2")
    )
    cells = join_same(cells, F.broadcast(head) if few else head, keys)
    group = Window.partitionBy(*keys)
    cells = cells.withColumn("__cum", F.sum("__c").over(group.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    quantiles = []
    for i, p in enumerate(probs):
        rank = (c("n") - 1) * p
        a, b = (F.min(F.when(c("__cum") > edge, c("__at"))).over(group) for edge in (F.floor(rank), F.ceil(rank)))
        quantiles.append((a + (b - a) * (rank - F.floor(rank))).alias(f"__q{i}"))
    cells = cells.select(*keys, *kept, "__c", "__at", "__s1", "__s2", *quantiles)
    low, high = c("__q0") - c("mean"), c("__q1") - c("mean")
    clip = lambda power, whole: F.when(c("n") < 10, whole).when(c("__at") < c("__q0"), c("__c") * low**power).when(c("__at") > c("__q1"), c("__c") * high**power).otherwise(whole)
    out = cells.groupBy(*keys).agg(
        *[F.first(x).alias(x) for x in kept], F.sum(clip(1, c("__s1"))).alias("__w1"), F.sum(clip(2, c("__s2"))).alias("__w2"), *([F.first("__q2").alias("median")] if median else [])
    )
    w_mean, w_var = _winsorised(c("n"), c("mean"), c("__w1"), c("__w2"))
    return out.select(*keys, *kept, *(["median"] if median else []), w_mean.alias("w_mean"), w_var.alias("w_var"))


def _winsorised(n: Column, mean: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """Mean and variance from the sums of the clipped values' distances from the plain mean and of their squares."""
    return mean + first / n, F.when(n > 1, F.greatest(second - first * first / n, F.lit(0.0)) / (n - 1))


def _by_horizon(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns ``<name>_<horizon>`` as one row per key and horizon; horizons without a value have none."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{x}_{h}").alias(x) for x in names]) for h in HORIZONS]))
    return wide.select(*keys, each.alias("p")).select(*keys, "p.*").filter("n > 0")


def group_moments(rows: DataFrame, extra: Callable[[Column], dict[str, Column]] = lambda ret: {}, eps: float = 0.001) -> DataFrame:
    """``moments`` of every (code, horizon) of stored ``group_rows``.

    The first pass keeps the horizons side by side, so it has one entry per group; the second meets its result in every task.
    """
    grid = _plan(True, eps)[1]
    each = rows.select(*RETS, F.explode("members").alias("code"))
    told = {h: _heads(F.col(f"ret_{h}"), grid, eps) | extra(F.col(f"ret_{h}")) for h in HORIZONS}
    wide = each.groupBy("code").agg(*[agg.alias(f"{name}_{h}") for h, aggs in told.items() for name, agg in aggs.items()])
    return moments(_long_returns(each, ["code"]), ["code", "horizon"], eps=eps, head=_by_horizon(wide, ["code"], list(told["1d"])))


def symbol_moments(events: DataFrame, extra: Callable[[Column], dict[str, Column]] = lambda ret: {}) -> DataFrame:
    """``moments`` of every (symbol, horizon) of symbols with less than ``SMALL`` events, which are ordered whole."""
    c = F.col
    told = {h: {k: v for k, v in _heads(c(f"ret_{h}"), [0.5], 0.001).items() if not k.startswith("__")} | extra(c(f"ret_{h}")) for h in HORIZONS}
    wide = events.select("symbol", *RETS).repartition("symbol").groupBy("symbol").agg(
        *[agg.alias(f"{name}_{h}") for h, aggs in told.items() for name, agg in aggs.items()], *[F.sort_array(F.collect_list(f"ret_{h}")).alias(f"__v_{h}") for h in HORIZONS]
    )
    rows = _by_horizon(wide, ["symbol"], [*told["1d"], "__v"])
    n = c("n")
    for name, p in (("__q0", 0.01), ("__q1", 0.99), ("median", 0.5)):
        rank = (n - 1) * p
        a, b = (F.get("__v", edge.cast("int")) for edge in (F.floor(rank), F.ceil(rank)))
        rows = rows.withColumn(name, a + (b - a) * (rank - F.floor(rank)))
    clipped = lambda x: F.when(n < 10, x).otherwise(F.greatest(F.least(x, c("__q1")), c("__q0"))) - c("mean")
    sums = F.aggregate(
        "__v", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
        lambda acc, x: F.struct((acc["a"] + clipped(x)).alias("a"), (acc["b"] + clipped(x) * clipped(x)).alias("b")),
    )
    rows = rows.withColumn("__w", sums)
    w_mean, w_var = _winsorised(n, c("mean"), c("__w.a"), c("__w.b"))
    return rows.select("symbol", "horizon", *told["1d"], "median", w_mean.alias("w_mean"), w_var.alias("w_var"))


def _symbol_groups(own: DataFrame, baseline: str, extra: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Moments of every symbol with three of the stored events or more, as groups ``ticker_<symbol>``."""
    sizes = own.groupBy("symbol").agg(F.count("*").alias("__n")).filter("__n >= 3")
    large = sizes.filter(F.col("__n") >= SMALL).select("symbol")
    few = sizes.select("symbol", (F.col("__n") >= SMALL).alias("__large"))
    told = symbol_moments(own.join(F.broadcast(large), "symbol", "left_anti"), extra).join(few.filter("NOT __large").select("symbol"), "symbol", "left_semi")
    if large.head(1):
        rows = _long_returns(own.join(F.broadcast(large), "symbol", "left_semi"), ["symbol"])
        told = told.unionByName(moments(rows, ["symbol", "horizon"], extra=extra(F.col("ret"))))
    names = [F.concat(F.lit("ticker_"), "symbol").alias("sub_group"), F.lit("buy").alias("direction"), F.lit(baseline).alias("baseline")]
    return told.select(*names, *[x for x in told.columns if x != "symbol"])


def horizon_stats(rows: DataFrame, baselines: DataFrame, with_p: bool = True, own: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Statistics of every (sub_group, direction, baseline, horizon) of ``group_rows`` against its baseline.

    Events and baselines are groups of one aggregation; its input is stored once, as two passes read it.  ``own`` holds events that are
    also grouped by their symbol, and the baseline of these groups.
    """
    keys = ["sub_group", "direction", "baseline", "horizon"]
    c = F.col
    hits = lambda ret: {f"hit_{d}": F.avg(_hits(F.lit(d), ret).cast("int")) for d in ("sell", "buy", "any")}
    stored = cut_lineage(rows.unionByName(_baseline_members(baselines)))
    told = _named(group_moments(stored, hits))
    if own:
        told = told.unionByName(_symbol_groups(*own, hits))
    own = F.struct(*[x for x in told.columns if x not in keys])
    told = told.withColumn("b", F.max(F.when(c("sub_group").isNull(), own)).over(Window.partitionBy("baseline", "horizon")))  # one row per group
    j = told.filter("sub_group IS NOT NULL").select("*", *[c(f"b.{x}").alias(f"b_{x}") for x in told.columns if x not in (*keys, "b")])
    by_direction = lambda prefix: F.when(c("direction") == "sell", c(f"{prefix}hit_sell")).when(c("direction") == "buy", c(f"{prefix}hit_buy")).otherwise(c(f"{prefix}hit_any"))
    j, b_hit = j.withColumn("hit", by_direction("")), by_direction("b_")
    enough = c("n") >= 3
    testable = enough & (c("b_n") > 10) & (c("n") > 3)
    t = X.welch_t(c("mean"), c("var"), c("n"), c("b_mean"), c("b_var"), c("b_n"))
    df = X.welch_df(c("var"), c("n"), c("b_var"), c("b_n"))
    d = X.pooled_d(c("w_mean"), c("w_var"), c("n"), c("b_w_mean"), c("b_w_var"), c("b_n"))
    j = j.withColumn("__t", F.when(testable, t)).withColumn("__df", F.when(testable, df))
    out = j.select(
        *keys,
        "n",
        (~enough).alias("insufficient_data"),
        F.when(enough, F.round("mean", 3)).alias("avg_return_pct"),
        F.when(enough, F.round("median", 3)).alias("median_return_pct"),
        F.when(enough, F.round("std", 3)).alias("std_pct"),
        F.when(enough, F.round(c("hit") * 100, 1)).alias("hit_rate_pct"),
        F.when(enough, F.round("b_mean", 3)).alias("baseline_avg_pct"),
        F.when(enough, F.round(F.coalesce(b_hit * 100, F.lit(50.0)), 1)).alias("baseline_hit_rate_pct"),
        F.when(enough, F.round(d, 3)).alias("effect_size_d"),
        F.round("__t", 4).alias("t_stat"),
        "__t", "__df",
    )
    if with_p:
        out = out.withColumn("__p", X.two_sided_p(c("__t"), c("__df")))
        out = out.withColumn("p_value", F.round("__p", 4)).withColumn(
            "significant_005", F.coalesce(c("__p") < 0.05, F.lit(False))
        ).withColumn("significant_001", F.coalesce(c("__p") < 0.01, F.lit(False))).drop("__p")
    return out.drop("__t", "__df")


def direct_compare(rows: DataFrame, left: str, right: str, min_n: int, with_p: bool = True) -> DataFrame:
    """Two groups against each other per horizon: Welch t, winsorised and raw d."""
    m = _named(group_moments(cut_lineage(rows))).drop("direction", "baseline")
    side = lambda name: F.first(F.when(F.col("sub_group") == name, F.struct(*[x for x in m.columns if x not in ("sub_group", "horizon")])), ignorenulls=True)
    both = m.filter(F.col("sub_group").isin(left, right)).groupBy("horizon").agg(side(left).alias("a"), side(right).alias("b"))
    names = [x for x in m.columns if x not in ("sub_group", "horizon")]
    j = both.select("horizon", *[F.col(f"a.{x}").alias(x) for x in names], *[F.col(f"b.{x}").alias(f"b_{x}") for x in names])
    c = F.col
    n1, n2 = F.coalesce("n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    enough = (n1 >= min_n) & (n2 >= min_n)
    t = X.welch_t(c("mean"), c("var"), c("n"), c("b_mean"), c("b_var"), c("b_n"))
    df = X.welch_df(c("var"), c("n"), c("b_var"), c("b_n"))
    out = j.select(
        F.lit(f"{left}_vs_{right}").alias("comparison"),
        "horizon",
        n1.alias("n_left"),
        n2.alias("n_right"),
        (~enough).alias("insufficient_data"),
        F.when(enough, F.round("mean", 3)).alias("mean_left"),
        F.when(enough, F.round("b_mean", 3)).alias("mean_right"),
        F.when(enough, F.round("median", 3)).alias("median_left"),
        F.when(enough, F.round("b_median", 3)).alias("median_right"),
        F.when(enough, F.round(t, 4)).alias("t_stat"),
        F.when(enough, F.round(X.pooled_d(c("w_mean"), c("w_var"), c("n"), c("b_w_mean"), c("b_w_var"), c("b_n")), 3)).alias("d_winsor"),
        F.when(enough, F.round(X.raw_d(c("mean"), c("var"), c("b_mean"), c("b_var")), 3)).alias("d_raw"),
        F.when(enough, t).alias("__t"),
        F.when(enough, df).alias("__df"),
    )
    if with_p:
        out = out.withColumn("p_value", F.round(X.two_sided_p(c("__t"), c("__df")), 6))
    return out.drop("__t", "__df")


def bonferroni(results: DataFrame, p: str = "p_value") -> DataFrame:
    """Correct over all non-null p values of the run."""
    n = F.count(p).over(Window.partitionBy())  # one row per group and horizon
    return results.withColumn("n_tests", F.when(F.col(p).isNotNull(), n)).withColumn(
        "threshold_005", F.round(0.05 / F.col("n_tests"), 6)
    ).withColumn("significant_bonferroni", F.col(p) < 0.05 / F.col("n_tests")).withColumn(
        "significant_bonferroni_strict", F.col(p) < 0.01 / F.col("n_tests")
    )


# --- hypotheses: ``returns`` is ``stored_returns`` of all trades in scope -------------------


def stored_returns(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Returns of every filing day, one row per symbol and day."""
    return day_returns(trades, prices)


def with_returns(events: DataFrame, returns: DataFrame) -> DataFrame:
    return events.join(returns, ["symbol", "filing_date"])


def price_coverage(events: DataFrame, returns: DataFrame, *by: str) -> DataFrame:
    """How many events have returns and how many are dropped for lack of a price."""
    known = returns.select("symbol", "filing_date", F.lit(True).alias("__known"))
    priced = F.count_if(F.col("__known"))
    told = events.join(known, ["symbol", "filing_date"], "left").groupBy(*by)
    return told.agg(F.count("*").alias("n_events"), priced.alias("n_priced"), (F.count("*") - priced).alias("n_dropped"))


def h1_events(trades: DataFrame, returns: DataFrame) -> DataFrame:
    disc = discretionary(trades, "BUY", "SELL")
    clusters = cluster_events(disc).withColumn("filing_date", F.col("event_date"))
    health = trades.select("symbol", "is_healthcare").distinct()
    return with_returns(clusters.join(health, "symbol"), returns)


def _h1_groups(baseline: str) -> list[tuple[str, Column, str, str]]:
    yes, c = F.lit(True), F.col
    return [
        ("all", yes, "any", baseline),
        ("sell_clusters", c("dominant_type") == "SELL", "sell", baseline),
        ("buy_clusters", c("dominant_type") == "BUY", "buy", baseline),
        ("csuite_clusters", c("is_csuite"), "any", baseline),
        ("healthcare_only", c("is_healthcare"), "any", baseline),
    ]


def h1_rows(trades: DataFrame, returns: DataFrame, baseline: str = "random") -> DataFrame:
    """Clusters: all, by dominant type, with C-suite, healthcare."""
    return group_rows(h1_events(trades, returns), _h1_groups(baseline))


def h1_direct_rows(trades: DataFrame, returns: DataFrame) -> DataFrame:
    """Buy clusters and single buys for the direct comparison."""
    disc = discretionary(trades, "BUY", "SELL")
    clusters = h1_events(trades, returns).filter("dominant_type = 'BUY'")
    singles = with_returns(single_buy_events(disc).withColumn("filing_date", F.col("event_date")), returns)
    yes = F.lit(True)
    return group_rows(clusters, [("cluster", yes, "buy", "")]).unionByName(group_rows(singles, [("single", yes, "buy", "")]))


def _where(cond: Column, groups: Sequence[tuple[str, Column, str, str]]) -> list[tuple[str, Column, str, str]]:
    return [(name, cond & member, direction, baseline) for name, member, direction, baseline in groups]


def _unplanned(*types: str) -> Column:
    """Condition of ``discretionary``."""
    return (F.col("is_plan") == F.lit(False)) & F.col("transaction_type").isin(*types)


def _h2_groups(baseline: str) -> list[tuple[str, Column, str, str]]:
    c = F.col
    sell, buy = c("transaction_type") == "SELL", c("transaction_type") == "BUY"
    groups = [("all", F.lit(True), "any", baseline), ("all_sells", sell, "sell", baseline), ("all_buys", buy, "buy", baseline)]
    for v in VALUE_THRESHOLDS:
        groups.append((f"sells_above_{v // 1000}k", sell & (c("total_value") >= v), "sell", baseline))
        groups.append((f"buys_above_{v // 1000}k", buy & (c("total_value") >= v), "buy", baseline))
    return _where(_unplanned("BUY", "SELL") & c("is_csuite"), groups)


def _h3_groups(baseline: str) -> list[tuple[str, Column, str, str]]:
    plan = F.col("is_plan")
    return _where(F.col("transaction_type") == "SELL", [("plan", plan, "sell", baseline), ("discretionary", ~plan, "sell", baseline)])


def _h4_groups(baseline: str) -> list[tuple[str, Column, str, str]]:
    c = F.col
    return _where(_unplanned("SELL"), [
        ("csuite", c("is_csuite"), "sell", baseline),
        ("director", ~c("is_csuite") & c("is_director"), "sell", baseline),
        ("other", ~c("is_csuite") & ~c("is_director"), "sell", baseline),
    ])


def _h5_groups(baseline: str, dip: str) -> list[tuple[str, Column, str, str]]:
    c, yes = F.col, F.lit(True)
    return _where(_unplanned("BUY"), [
        ("all", yes, "buy", baseline),
        ("csuite_buys", c("is_csuite"), "buy", baseline),
        ("director_buys", ~c("is_csuite"), "buy", baseline),
        ("healthcare_buys", c("is_healthcare"), "buy", baseline),
        ("buys_above_100k", c("total_value") >= 100_000, "buy", baseline),
        ("buys_above_500k", c("total_value") >= 500_000, "buy", baseline),
        ("vs_dip_all", yes, "buy", dip),
        ("vs_dip_csuite", c("is_csuite"), "buy", dip),
    ])


def _h6_groups(common: str, own: str, control: str) -> list[tuple[str, Column, str, str]]:
    hc = F.col("is_healthcare")
    return _where(_unplanned("SELL") & F.col("is_csuite"), [
        ("healthcare_vs_common", hc, "sell", common),
        ("control_vs_common", ~hc, "sell", common),
        ("healthcare", hc, "sell", own),
        ("control_group", ~hc, "sell", control),
    ])


def _trade_rows(trades: DataFrame, returns: DataFrame, groups: Sequence[tuple[str, Column, str, str]]) -> DataFrame:
    """``group_rows`` of the trades that fall in any of the groups; only they meet the returns."""
    member = F.lit(False)
    for _, cond, _, _ in groups:
        member = member | cond
    return group_rows(with_returns(trades.filter(member), returns), groups)


def h2_rows(trades: DataFrame, returns: DataFrame, baseline: str = "random") -> DataFrame:
    """Discretionary C-suite trades by type and value threshold."""
    return _trade_rows(trades, returns, _h2_groups(baseline))


def h3_rows(trades: DataFrame, returns: DataFrame, baseline: str = "random") -> DataFrame:
    """Plan against discretionary sales."""
    return _trade_rows(trades, returns, _h3_groups(baseline))


def h4_rows(trades: DataFrame, returns: DataFrame, baseline: str = "random") -> DataFrame:
    """Discretionary sales by seniority."""
    return _trade_rows(trades, returns, _h4_groups(baseline))


def h5_rows(trades: DataFrame, returns: DataFrame, baseline: str = "random", dip: str = "dip") -> DataFrame:
    """Discretionary buys against a random and a dip baseline."""
    return _trade_rows(trades, returns, _h5_groups(baseline, dip))


def h6_rows(trades: DataFrame, returns: DataFrame, common: str, own: str, control: str) -> DataFrame:
    """Sector against control on discretionary C-suite sales, with common and own baselines."""
    return _trade_rows(trades, returns, _h6_groups(common, own, control))


def h7_rows(trades: DataFrame, returns: DataFrame, healthcare_only: bool) -> DataFrame:
    """Buy clusters (entry at the second insider) and lone buys."""
    buys = discretionary(trades, "BUY")
    if healthcare_only:
        buys = buys.filter("is_healthcare")
    clusters = with_returns(cluster_buy_events(buys).withColumn("filing_date", F.col("event_date")), returns)
    singles = with_returns(lone_buys(buys), returns)
    yes = F.lit(True)
    return group_rows(clusters, [("cluster", yes, "buy", "random")]).unionByName(
        group_rows(singles, [("single", yes, "buy", "random")])
    )


def h7_verdict(comparison: DataFrame, horizon: str = "7d") -> DataFrame:
    row = comparison.filter(F.col("horizon") == horizon)
    return row.withColumn("verdict", S.cluster_verdict(F.col("n_left"), F.col("d_winsor"), F.col("p_value")))


def h8_events(trades: DataFrame, returns: DataFrame) -> DataFrame:
    """Discretionary buys with their returns, stored: the groups read them and so do the symbols."""
    return cut_lineage(with_returns(discretionary(trades, "BUY"), returns).select("symbol", *RETS, "is_csuite", "tier", "total_value"))


def h8_rows(events: DataFrame, baseline: str = "random") -> DataFrame:
    """Tiered replication: all, C-suite, tiers and thresholds; ``horizon_stats`` adds every symbol with three events."""
    c, yes = F.col, F.lit(True)
    groups = [
        ("all", yes, "buy", baseline),
        ("csuite", c("is_csuite"), "buy", baseline),
        ("strict", c("tier") == "strict", "buy", baseline),
        ("stretch", c("tier") == "stretch", "buy", baseline),
    ]
    groups += [(f"buys_above_{v // 1000}k", c("total_value") >= v, "buy", baseline) for v in VALUE_THRESHOLDS]
    return group_rows(events, groups)


def tier_gate(results: DataFrame, horizon: str = "7d") -> DataFrame:
    """Go/no-go of the 'all' and 'csuite' groups at the decision horizon."""
    rows = results.filter(F.col("sub_group").isin("all", "csuite") & (F.col("horizon") == horizon))
    return rows.withColumn("decision", S.go_no_go(F.col("effect_size_d"), F.col("p_value")))


def _without_other_buys(trades: DataFrame, told: DataFrame) -> DataFrame:
    """Trades without buys of symbols that have no healthcare row at all: outside healthcare only sells are read.  ``told`` is ``healthcare_flags``."""
    some = told.filter("some").select(F.col("symbol").alias("__own"))
    if not few(some):
        return trades
    known = trades.join(F.broadcast(some), F.col("symbol") == F.col("__own"), "left")
    return known.filter((F.col("transaction_type") != "BUY") | F.col("__own").isNotNull()).select(*trades.columns)


def full_run(trades: DataFrame, prices: DataFrame, samples: int = 10_000) -> DataFrame:
    """All hypotheses in one long table with p values and the Bonferroni correction."""
    told = healthcare_flags(trades)
    control_reads = _unplanned("SELL") & F.col("is_csuite")  # what H6 reads of rows outside healthcare
    clean = study_trades(_without_other_buys(trades, told), ("BUY", "SELL"), F.col("is_healthcare") | control_reads, (*STUDY_COLUMNS, "insider_name"))
    returns = cut_lineage(stored_returns(clean, prices))
    scope = clean.filter("is_healthcare")
    hc_symbols = healthcare_symbols(trades, told)
    healthcare, control, line = symbol_scope(hc_symbols), symbol_scope(hc_symbols, within=False), dealt_returns(prices)
    baselines = (
        random_baseline(prices, samples // 2, 43, "random", healthcare, line)
        .unionByName(random_baseline(prices, samples, 42, "random_all", line=line))
        .unionByName(random_baseline(prices, samples // 2, 44, "random_control", control, line))
        .unionByName(dip_baseline(prices, scope=healthcare, line=line))
    )
    name = lambda label, groups: [(f"{label}/{g}", *rest) for g, *rest in groups]
    of_trades = [
        *_where(F.col("is_healthcare"), name("H2", _h2_groups("random")) + name("H3", _h3_groups("random")) + name("H4", _h4_groups("random")) + name("H5", _h5_groups("random", "dip"))),
        *name("H6", _h6_groups("random_all", "random", "random_control")),
    ]
    rows = group_rows(h1_events(scope, returns), name("H1", _h1_groups("random"))).unionByName(_trade_rows(clean, returns, of_trades))
    return bonferroni(horizon_stats(rows, baselines))
