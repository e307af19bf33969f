"""Option volume: baselines, spikes, per-ticker aggregation and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import scoring as S
from tidewatch.functions.calendar import days_to_expiry
from tidewatch.operators.temporal import asof_join, first_k, fold_sorted, join_same


def screened_contracts(contracts: DataFrame, now: Column) -> DataFrame:
    """Contracts within the expiry and distance limits, with their derived columns."""
    c = F.col
    rows = contracts.withColumn("dte", days_to_expiry(c("expiry"), now)).withColumn(
        "otm_distance", S.otm_distance(c("strike"), c("underlying"))
    ).withColumn("is_otm", S.is_otm(c("option_type"), c("strike"), c("underlying")))
    return rows.filter(S.tradable_contract(c("option_type"), c("strike"), c("underlying"), c("dte")))


def volume_baseline(bars: DataFrame, points_cap: int = 20, min_points: int = 5, cap: float = 5.0) -> DataFrame:
    """Walk each contract's sessions: test the spike against the old baseline, then update it.

    One bar per contract and session enters the fold (zero volumes and repeated sessions
    are dropped before), so a contract has at most one row per trading day of its life.
    """
    daily = first_k(bars.filter("volume > 0"), ["occ", "session"], [F.col("volume")], 1).select("occ", "session", "volume")

    def step(state, row):
        session, volume = row
        avg, points = state.get("avg"), state.get("points", 0)
        if avg is None:
            state.update(avg=float(volume), points=1)
            return [(session, volume, 0.0, None, float(volume), 1)]
        ratio = 0.0 if points < min_points or volume < 100 or avg <= 0 else volume / avg
        limit = cap * avg
        counted = limit if points >= min_points and avg > 0 and volume > limit else float(volume)
        n = min(points, points_cap - 1)
        state.update(avg=(avg * n + counted) / (n + 1), points=min(points + 1, points_cap))
        return [(session, volume, float(ratio), avg, state["avg"], state["points"])]

    schema = "occ string, session date, volume long, spike double, avg_before double, avg_after double, points int"
    return fold_sorted(daily, ["occ"], ["session"], step, schema).withColumn("is_unusual", F.col("spike") >= 3.0)


def cold_start(bars: DataFrame, as_of: Column, days: int = 30, last: int = 20) -> DataFrame:
    """Initial baseline of a contract from its newest bars."""
    recent = bars.filter((F.col("session") > F.date_sub(F.to_date(as_of), days)) & (F.col("session") <= F.to_date(as_of)))
    newest = first_k(recent, ["occ"], [F.desc("session"), F.desc("volume")], last)
    return newest.groupBy("occ").agg(
        F.avg("volume").alias("avg_volume"),
        F.count("*").alias("points"),
        F.max_by("volume", F.struct("session", "volume")).alias("last_volume"),
        F.max("session").alias("last_session"),
    )


def ticker_flow(unusual: DataFrame, keys: list[str]) -> DataFrame:
    """Call and put volume of the unusual contracts with the highest spike as headline (first on ties)."""
    call = F.sum(F.when(F.col("option_type") == "call", F.col("volume")).otherwise(0))
    put = F.sum(F.when(F.col("option_type") == "put", F.col("volume")).otherwise(0))
    head = F.struct("occ", "option_type", "volume", "spike", "otm_distance", "dte")
    out = unusual.groupBy(*keys).agg(
        call.alias("call_volume"), put.alias("put_volume"),
        F.min_by(head, F.struct(-F.col("spike"), F.col("occ"))).alias("h"),
        F.count("*").alias("contracts"),
    )
    total = F.col("call_volume") + F.col("put_volume")
    return out.withColumn("call_ratio", F.when(total > 0, F.col("call_volume") / total).otherwise(0.5))


def catalyst_boost(rows: DataFrame, catalysts: DataFrame, day: str, days: int = 30) -> DataFrame:
    """Flag rows with a decision of the symbol within the next ``days`` (earliest one attached).

    Both sides are reduced to distinct (symbol, day) pairs, bounded by the calendar.
    """
    left = rows.select("symbol", F.col(day).alias("__day")).distinct().withColumn("__p", F.unix_date("__day") + 1)
    right = catalysts.select("symbol", "event_date").distinct().withColumn("__p", F.unix_date("event_date"))
    next_event = asof_join(left, right, ["symbol"], "__p", "__p", ["event_date"], "forward", width=None)
    near = F.col("match.event_date") <= F.date_add("__day", days)
    dim = next_event.select(
        "symbol", F.col("__day").alias(day), F.when(near, F.col("match.event_date")).alias("next_catalyst")
    )
    return join_same(rows, dim, ["symbol", day]).withColumn("boosted", F.col("next_catalyst").isNotNull())


def scored_flows(flows: DataFrame) -> DataFrame:
    """Conviction of single flows; expects spike, volume, otm_distance, dte, option_type, boosted."""
    c = F.col
    return flows.withColumn(
        "conviction",
        S.flow_score(c("spike"), c("volume"), c("otm_distance"), c("dte"), c("option_type"), c("boosted")),
    )


def scored_tickers(agg: DataFrame) -> DataFrame:
    """Conviction and direction of per-ticker aggregates."""
    h = F.col("h")
    return agg.withColumn("direction", S.flow_direction(F.col("call_ratio"))).withColumn(
        "conviction",
        S.flow_score(h["spike"], h["volume"], h["otm_distance"], h["dte"], h["option_type"], F.col("boosted"), F.col("call_ratio")),
    )


def flow_action(conviction: Column, boosted: Column, observation: Column) -> Column:
    """Alert, correlation feed or skip."""
    size = F.abs(conviction)
    return (
        F.when((size >= 0.5) & boosted, F.when(size >= 0.7, "ALERT_CRITICAL").otherwise("ALERT_HIGH"))
        .when((size >= 0.25) & ~observation, "CORRELATION_STORED")
        .when(size >= 0.25, "SKIP_OBSERVATION_TICKER")
        .otherwise("SKIP_LOW_CONVICTION")
    )
