"""Forward prices of alerts and of event days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.calendar import effective_start, is_open
from tidewatch.operators.temporal import DAY_US, asof_join, micros
from tidewatch.session import deal_out

# Outcome slots in hours after the effective start; benchmarks use the last three.
SLOT_HOURS = {"1h": 1, "4h": 4, "1d": 24, "3d": 72, "7d": 168}
BENCHMARK_SLOTS = ("1d", "3d", "7d")
HOUR_US = 3_600_000_000
BENCHMARK_WIDTH = 5 * 60 * 1_000_000  # benchmark keys receive every alert, so their chunks are short


def fill_price_slots(
    alerts: DataFrame,
    ticks: DataFrame,
    as_of: Column,
    benchmarks: dict[str, str] | None = None,
    timeout_days: int = 11,
) -> DataFrame:
    """Fill empty price slots of open alerts from the first exchange-hours tick at or after each slot.

    ``benchmarks`` maps a column prefix to its tick symbol.  Filled values are never
    overwritten and a rerun changes nothing, so the job can be repeated after failures.
    """
    benchmarks = benchmarks or {}
    quotes = ticks.filter(is_open(F.col("ts")) & (F.col("ts") <= as_of)).select(
        "symbol", micros(F.col("ts")).alias("__t"), "price", "tick_id"
    )
    todo = alerts.filter(F.col("price_at_alert").isNotNull() & ~F.col("price_outcome_done"))
    start = todo.select("id", "symbol", micros(effective_start(F.col("sent_at"))).alias("__start"))

    def lookups(symbol: Column, slots: Sequence[str]) -> DataFrame:
        slot = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(SLOT_HOURS[s] * HOUR_US).alias("d")) for s in slots]))
        rows = start.select("id", symbol.alias("symbol"), "__start", slot.alias("s"))
        return rows.select("id", "symbol", F.col("s.slot").alias("slot"), (F.col("__start") + F.col("s.d")).alias("__at"))

    def matched(rows: DataFrame, width: int) -> DataFrame:
        return asof_join(rows, quotes, ["symbol"], "__at", "__t", ["price"], "forward", "tick_id", width)

    def wide(rows: DataFrame, prefix: str, slots: Sequence[str]) -> DataFrame:
        return rows.groupBy("id").agg(
            *[F.max(F.when(F.col("slot") == s, F.col("match.price"))).alias(f"__{prefix}{s}") for s in slots]
        )

    out = alerts.join(wide(matched(lookups(F.col("symbol"), list(SLOT_HOURS)), DAY_US), "price", list(SLOT_HOURS)), "id", "left")
    targets = [f"price{s}" for s in SLOT_HOURS]
    for prefix, symbol in benchmarks.items():
        found = matched(lookups(F.lit(symbol), BENCHMARK_SLOTS), BENCHMARK_WIDTH)
        out = out.join(wide(found, prefix, BENCHMARK_SLOTS), "id", "left")
        targets += [f"{prefix}{s}" for s in BENCHMARK_SLOTS]
    for c in targets:
        out = out.withColumn(c, F.coalesce(c, f"__{c}")).drop(f"__{c}")
    filled = F.lit(True)
    for s in SLOT_HOURS:
        filled = filled & F.col(f"price{s}").isNotNull()
    expired = F.col("sent_at") + F.make_dt_interval(F.lit(timeout_days)) <= as_of
    done = F.col("price_outcome_done") | (F.col("price_at_alert").isNotNull() & (filled | expired))
    return out.withColumn("price_outcome_done", done)


def alert_snapshot(alerts: DataFrame, ticks: DataFrame, benchmarks: dict[str, str]) -> DataFrame:
    """Latest positive quote of the symbol and of each benchmark at alert time, each on its own."""
    quotes = ticks.filter("price > 0").select("symbol", micros(F.col("ts")).alias("__t"), "price", "tick_id")
    rows = alerts.select("id", "symbol", "sent_at", micros(F.col("sent_at")).alias("__at"))
    out = asof_join(rows, quotes, ["symbol"], "__at", "__t", ["price"], "backward", "tick_id")
    out = out.select("id", "symbol", "sent_at", "__at", F.col("match.price").alias("price_snapshot"))
    for prefix, symbol in benchmarks.items():
        bench = quotes.filter(F.col("symbol") == symbol).withColumnRenamed("symbol", "__bench")
        keyed = out.withColumn("__bench", F.lit(symbol))
        out = asof_join(keyed, bench, ["__bench"], "__at", "__t", ["price"], "backward", "tick_id", BENCHMARK_WIDTH)
        out = out.withColumn(f"{prefix}_snapshot", F.col("match.price")).drop("__bench", "match")
    return out.drop("__at")


def close_expired(alerts: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    """Close alerts that never got an entry price; recent ones stay open."""
    stale = F.col("price_at_alert").isNull() & (F.col("sent_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return alerts.withColumn("price_outcome_done", F.col("price_outcome_done") | stale)


# Horizons in trading rows.
HORIZONS = {"1d": 1, "3d": 3, "7d": 5, "30d": 21}


def forward_closes(prices: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Close and the closes ``k`` trading rows later; one row per symbol and date."""
    w = Window.partitionBy("symbol").orderBy("date")
    return prices.select("symbol", "date", "close", *[F.lead("close", k).over(w).alias(f"close_{k}") for k in offsets])


def entry_prices(days: DataFrame, prices: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """First close on or after each (symbol, date) and the closes ``k`` rows after it.

    ``days`` is reduced to distinct pairs first, so both sides are bounded by the calendar.  They are exchanged once and swept together:
    from a day on, the next price row is its entry, and ``k`` rows on stands the close wanted.
    """
    rows = prices.filter("date IS NOT NULL").select("symbol", "date", "close", F.lit(1).alias("__side"))
    both = days.select("symbol", "date").distinct().withColumn("__side", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    both = deal_out(both, "symbol").withColumn("__price", F.when(F.col("__side") == 1, F.struct("date", "close")))  # days stay null, a price without a close does not
    line = Window.partitionBy("symbol").orderBy("date", "__side")
    ahead = {f"__{k}": F.expr(f"lead(__price, {k + 1}) IGNORE NULLS").over(line) for k in (0, *offsets)}
    out = both.withColumns(ahead).filter("__side = 0")
    at = lambda k, field: F.when(F.col("date").isNotNull(), F.col(f"__{k}.{field}"))
    return out.select(
        "symbol", "date", at(0, "date").alias("entry_date"), at(0, "close").alias("entry_close"), *[at(k, "close").alias(f"close_{k}") for k in offsets]
    )


def day_returns(events: DataFrame, prices: DataFrame, date: str = "filing_date", entry_lag: int = 0) -> DataFrame:
    """Percent returns ``ret_<horizon>`` of every (symbol, date) occurring in ``events``.

    One row per symbol and calendar day, to be joined to any number of events.
    """
    shifted = [k + entry_lag for k in HORIZONS.values()]
    days = events.select("symbol", F.col(date).alias("date"))
    table = entry_prices(days, prices, sorted({*shifted, *([entry_lag] if entry_lag else [])}))
    base = F.col(f"close_{entry_lag}") if entry_lag else F.col("entry_close")
    cols = [
        F.when(F.col(f"close_{k}") > 0, (F.col(f"close_{k}") - base) / base * 100).alias(f"ret_{label}")
        for label, k in zip(HORIZONS, shifted)
    ]
    rets = table.filter(base > 0).select("symbol", F.col("date").alias(date), base.alias("entry_price"), *cols)
    return rets.filter(" OR ".join(f"ret_{h} IS NOT NULL" for h in HORIZONS))


def event_returns(events: DataFrame, prices: DataFrame, date: str = "filing_date", entry_lag: int = 0) -> DataFrame:
    """Events with their returns; events without any return are dropped."""
    return events.join(day_returns(events, prices, date, entry_lag), ["symbol", date])


def dip_days(prices: DataFrame, threshold: float = -2.0, min_rows: int = 30, ahead: int = 21) -> DataFrame:
    """Days with a daily return at or below ``threshold`` and ``ahead`` rows after them."""
    w = Window.partitionBy("symbol").orderBy("date")
    n = F.count("*").over(Window.partitionBy("symbol"))
    prev = F.lag("close").over(w)
    rows = prices.withColumn("daily_return", (F.col("close") - prev) / prev * 100).withColumn(
        "idx", F.row_number().over(w) - 1
    ).withColumn("n", n)
    return rows.filter(
        (F.col("n") >= min_rows) & (F.col("daily_return") <= threshold) & (F.col("idx") + ahead < F.col("n"))
    )
