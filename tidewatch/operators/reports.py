"""Listings and aggregates over alerts, logs, tickers and feeds.

Timestamps are UTC wall clock; ``as_of`` is a Column (usually a literal) so that a
run is reproducible.  Aggregates are algebraic (map-side combined), so a hot symbol
or rule costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.scoring import alpha_pct, direction_hit, pct_change
from tidewatch.functions.text import message_conviction
from tidewatch.operators.temporal import first_k, lag_in_order, micros


def as_ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def before(as_of: Column, days: float = 0, hours: float = 0) -> Column:
    return as_of - F.make_dt_interval(F.lit(int(days)), F.lit(int(hours)))


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(float(scale)) if digits else F.floor(x + 0.5)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits))


# --- listings ------------------------------------------------------------------------------


def newest(df: DataFrame, ts: str, limit: int, tie: str) -> DataFrame:
    """Top-k by time; planned as TakeOrderedAndProject."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def beyond(column: str, tie: str, after: tuple, descending: bool = True) -> Column:
    """Whether a row comes after the (value, tie) of another in the order column, tie (ascending), rows without a value last."""
    value, last = after
    c, t = F.col(column), F.col(tie)
    if value is None:
        return c.isNull() & (t > last)
    further = c < F.lit(value) if descending else c > F.lit(value)
    return c.isNull() | further | ((c == F.lit(value)) & (t > last))


def page_after(df: DataFrame, column: str, tie: str, size: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """The next ``size`` rows after the last (value, tie) of the page before; the first page without one.

    Seeks instead of counting: each page is a filter and a top-k, so a late page costs what the first one does.
    """
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    rows = df if after is None else df.filter(beyond(column, tie, after, descending))
    return rows.orderBy(key, tie).limit(size)


def recent_alerts(
    alerts: DataFrame, symbol: str | None = None, limit: int = 50, include_archived: bool = False
) -> DataFrame:
    if symbol:
        alerts = alerts.filter(F.col("symbol") == symbol.upper())
    if not include_archived:
        alerts = alerts.filter(~F.col("archived"))
    return newest(alerts, "sent_at", limit, "id")


def ordered_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("priority", "name")


def active_tickers(tickers: DataFrame, subsector: str | None = None, sector: str | None = None) -> DataFrame:
    out = tickers.filter("is_active")
    if subsector:
        out = out.filter(F.col("subsector") == subsector)
    if sector:
        out = out.filter(F.col("sector") == sector)
    return out


def upcoming_catalysts(catalysts: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Open decisions within ``days``, soonest first, with their one-line context."""
    today = F.to_date(as_of)
    hit = catalysts.filter(F.col("outcome").isNull() & F.col("event_date").between(today, F.date_add(today, days)))
    left = F.date_diff("event_date", today)
    context = F.concat_ws(
        " ", "drug_name", F.concat(F.lit("("), F.coalesce("area", F.lit("n/a")), F.lit(")")),
        F.lit("in"), left.cast("string"), F.lit("days"),
    )
    return hit.withColumn("days_left", left).withColumn("context", context).orderBy("event_date")


def significant_trades(trades: DataFrame, limit: int, min_value: float = 100_000) -> DataFrame:
    hit = trades.filter(F.col("transaction_type").isin("BUY", "SELL") & (F.col("total_value") >= min_value))
    return newest(hit, "transaction_date", limit, "trade_id")


def open_flows(flows: DataFrame, as_of: Column, limit: int, offset: int = 0) -> DataFrame:
    """Page of unexpired option flows; the total comes from one scalar count."""
    live = flows.filter(F.col("expiry") >= F.to_date(as_of))
    total = live.agg(F.count("*")).scalar()
    page = live.orderBy(F.desc("session"), F.desc("volume"), "occ").offset(offset).limit(limit)
    return page.withColumn("total", total)


def flow_notional(flows: DataFrame) -> DataFrame:
    """Each contract with its notional and its (symbol, session) totals."""
    rows = flows.withColumn("notional", F.col("volume") * 100 * F.col("underlying"))
    totals = rows.groupBy("symbol", "session").agg(
        F.count("*").alias("contracts"), F.round(F.sum("notional"), 2).alias("session_notional")
    )
    return rows.join(totals, ["symbol", "session"])


def search_logs(
    logs: DataFrame,
    module: str | None = None,
    status: str | None = None,
    level: str | None = None,
    ticker: str | None = None,
    trace_id: str | None = None,
    since: Column | None = None,
    until: Column | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    for name, value in (
        ("module", module), ("status", status), ("level", level), ("ticker", ticker), ("trace_id", trace_id),
    ):
        if value is not None:
            logs = logs.filter(F.col(name) == value)
    if since is not None:
        logs = logs.filter(F.col("created_at") >= since)
    if until is not None:
        logs = logs.filter(F.col("created_at") <= until)
    total = logs.agg(F.count("*")).scalar()
    page = logs.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return page.withColumn("total", total)


def trace(logs: DataFrame, trace_id: str) -> DataFrame:
    return logs.filter(F.col("trace_id") == trace_id).orderBy("created_at", "id")


def ticker_logs(logs: DataFrame, ticker: str, as_of: Column, hours: int = 24, limit: int = 100) -> DataFrame:
    since = before(as_of, hours=hours)
    return newest(logs.filter((F.col("ticker") == ticker) & (F.col("created_at") >= since)), "created_at", limit, "id")


def system_errors(logs: DataFrame, as_of: Column, ignored: Sequence[str], hours: int = 24) -> DataFrame:
    """Errors of the last hours; rows without a class name stay in."""
    kept = F.col("class_name").isNull() | ~F.col("class_name").isin(*ignored)
    return logs.filter((F.col("level") == "error") & (F.col("created_at") >= before(as_of, hours=hours)) & kept)


# Rules of the two panels.
EDGE_RULES = (
    "Form 4 Insider BUY", "Form 4 Insider Signal", "8-K Material Event GPT", "8-K Earnings Miss",
    "8-K Leadership Change", "8-K Bankruptcy", "Correlated Signal", "Unusual Options Activity",
)


def rule_panel(alerts: DataFrame, rules: Sequence[str] = EDGE_RULES) -> DataFrame:
    return alerts.filter(F.col("rule_name").isin(*rules))


def recent_timeline(alerts: DataFrame, as_of: Column, days: int = 7, limit: int = 30) -> DataFrame:
    hit = alerts.filter(
        F.col("price_at_alert").isNotNull() & ~F.col("archived")
        & (F.col("sent_at") > before(as_of, days=days))
    )
    return newest(hit.withColumn("conviction", message_conviction(F.col("message"))), "sent_at", limit, "id")


def sorted_page(df: DataFrame, column: str, tie: str, page: int, size: int, descending: bool = True) -> DataFrame:
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(key, tie).offset(page * size).limit(size)


# --- hit rates and alert statistics --------------------------------------------------------


def hit_rates(alerts: DataFrame, by: Column, name: str, as_of: Column, days: int = 7) -> DataFrame:
    """Evaluated and correct 1d/3d directions per group of ``by``."""
    rows = alerts.filter(
        F.col("price_at_alert").isNotNull() & (F.col("sent_at") > before(as_of, days=days))
    ).withColumn(name, by)
    aggs = [F.count("*").alias("total")]
    for h in ("1d", "3d"):
        known = F.col("alert_direction").isNotNull() & F.col(f"price{h}").isNotNull()
        hit = known & direction_hit(F.col(f"price{h}") - F.col("price_at_alert"), F.col("alert_direction"))
        aggs += [F.count_if(known).alias(f"evaluated_{h}"), F.count_if(hit).alias(f"correct_{h}")]
    out = rows.groupBy(name).agg(*aggs)
    for h in ("1d", "3d"):
        out = out.withColumn(f"hit_rate_{h}", percent(F.col(f"correct_{h}"), F.col(f"evaluated_{h}")))
    return out


def alert_stats(alerts: DataFrame, as_of: Column, days: int = 7, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return alerts.filter(F.col("sent_at") > before(as_of, days=days)).agg(
        F.count("*").alias("total"),
        F.count_if("delivered").alias("delivered"),
        F.count_if(~F.col("delivered")).alias("silent"),
        distinct(F.col("symbol")).alias("symbols"),
        F.count_if(F.col("sent_at") > before(as_of, hours=24)).alias("last_24h"),
    )


def flow_stats(flows: DataFrame) -> DataFrame:
    return flows.groupBy("symbol").agg(
        F.count("*").alias("flows"),
        F.round(F.avg(F.abs("conviction")), 4).alias("avg_conviction"),
        F.max("spike").alias("max_spike"),
        F.max("session").alias("last_session"),
    )


def decision_counts(logs: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return (
        logs.filter((F.col("created_at") > before(as_of, hours=hours)) & F.col("decision_reason").isNotNull())
        .groupBy("decision_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "decision_reason")
    )


def symbols_with_alerts(alerts: DataFrame, as_of: Column, days: int) -> DataFrame:
    return (
        alerts.filter((F.col("sent_at") > before(as_of, days=days)) & ~F.col("archived"))
        .groupBy("symbol").agg(F.count("*").alias("alert_count"), F.max("sent_at").alias("last_alert"))
        .orderBy(F.desc("alert_count"), "symbol")
    )


def rule_summary(alerts: DataFrame, since: Column, until: Column) -> DataFrame:
    return (
        alerts.filter((F.col("sent_at") >= since) & (F.col("sent_at") < until)).groupBy("rule_name")
        .agg(F.count("*").alias("total"), F.count_if("delivered").alias("delivered"))
    )


# Display labels of suppression reasons.
REASON_LABELS = {
    "observation": "Observation mode",
    "sell_no_edge": "Insider SELL without edge",
    "csuite_sell_no_edge": "C-suite SELL without edge",
    "cluster_sell_no_edge": "SELL cluster without edge",
    "direction_conflict": "Conflicting directions",
    "gpt_missing_data": "Missing data",
    "silent_rule": "Silent rule",
    "silent_hour": "Silent hour",
    "daily_limit": "Daily limit",
    "telegram_failed": "Delivery failed",
    "dispatcher_unavailable": "Dispatcher unavailable",
    "consensus_miss": "Below consensus",
    "consensus_in_line": "In line with consensus",
    "consensus_mixed": "Mixed against consensus",
    "consensus_gap": "Contradicts consensus",
    "bullish_8k_no_edge": "Bullish 8-K without edge",
    "bullish_no_consensus_data": "Bullish 8-K without consensus data",
}


def label_reason(reason: Column, labels: dict[str, str] = REASON_LABELS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(table[reason], reason)


def suppression_breakdown(alerts: DataFrame) -> DataFrame:
    return (
        alerts.filter(~F.col("delivered") & F.col("non_delivery_reason").isNotNull())
        .groupBy("non_delivery_reason").agg(F.count("*").alias("n"))
        .withColumn("label", label_reason(F.col("non_delivery_reason")))
    )


def trade_totals(trades: DataFrame) -> DataFrame:
    return (
        trades.filter(F.col("transaction_type").isin("BUY", "SELL")).groupBy("transaction_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("total_value").cast("decimal(15,2)")).cast("double").alias("total_value"))
    )


def catalyst_status(catalysts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One 'status' row with the totals, then one 'upcoming' row per decision due in ``days``."""
    today = F.to_date(as_of)
    pending = F.col("outcome").isNull()
    totals = catalysts.agg(
        F.count("*").alias("total"),
        F.count_if(~pending).alias("resolved"),
        F.count_if(pending & (F.col("event_date") >= today)).alias("upcoming"),
    )
    soon = catalysts.filter(pending & F.col("event_date").between(today, F.date_add(today, days))).select(
        "event_date", "symbol", "drug_name"
    )
    rows = totals.withColumn("section", F.lit("status")).unionByName(
        soon.withColumn("section", F.lit("upcoming")), allowMissingColumns=True
    )
    return rows.orderBy("section", "event_date", "symbol")


def signed_returns(alerts: DataFrame) -> DataFrame:
    """Direction-signed 3d return and hit share per rule, direction and delivery."""
    move = pct_change(F.col("price_at_alert"), F.col("price3d"))
    signed = F.when(F.col("alert_direction") == "positive", move).otherwise(-move)
    rows = alerts.filter(F.col("alert_direction").isNotNull()).withColumn("signed", signed).filter("signed IS NOT NULL")
    return rows.groupBy("rule_name", "alert_direction", "delivered").agg(
        F.count("*").alias("n"),
        F.round(F.avg("signed"), 4).alias("avg_signed_return"),
        F.round(F.avg((F.col("signed") > 0).cast("int")) * 100, 2).alias("hit_pct"),
    )


def sector_cohort(alerts: DataFrame, tickers: DataFrame) -> DataFrame:
    """Same measures per sector of the alert's ticker."""
    dim = tickers.select("symbol", "sector")
    move = pct_change(F.col("price_at_alert"), F.col("price3d"))
    signed = F.when(F.col("alert_direction") == "positive", move).otherwise(-move)
    rows = alerts.join(dim, "symbol").filter(F.col("alert_direction").isNotNull()).withColumn("signed", signed)
    return rows.filter("signed IS NOT NULL").groupBy("sector", "alert_direction").agg(
        F.count("*").alias("n"),
        F.round(F.avg("signed"), 4).alias("avg_signed_return"),
        F.round(F.avg((F.col("signed") > 0).cast("int")) * 100, 2).alias("hit_pct"),
    )


def outcome_rows(alerts: DataFrame) -> DataFrame:
    """Deltas and direction flags; a missing price falls through both sign tests to null."""
    out = alerts
    for h in ("1h", "1d", "3d"):
        p0, p1 = F.col("price_at_alert"), F.col(f"price{h}")
        up, down = F.col("alert_direction") == "positive", F.col("alert_direction") == "negative"
        flag = (
            F.when(up & (p1 > p0), True).when(down & (p1 < p0), True)
            .when(p1.isNull() | F.col("alert_direction").isNull() | p0.isNull(), None).otherwise(False)
        )
        out = out.withColumn(f"delta_{h}", F.round(F.when(p0 > 0, (p1 / p0 - 1) * 100), 2)).withColumn(
            f"correct_{h}", flag
        )
    return out.filter(F.col("price_at_alert").isNotNull()).select(
        "id", "symbol", "rule_name", "alert_direction", "sent_at",
        *[c for h in ("1h", "1d", "3d") for c in (f"delta_{h}", f"correct_{h}")],
    )


def outcome_mapping(alerts: DataFrame) -> DataFrame:
    """Rounded deltas, sector alphas and both direction checks of each alert."""
    p0 = F.col("price_at_alert")
    cols = {}
    for h in ("1h", "4h", "1d", "3d", "7d"):
        p1 = F.col(f"price{h}")
        cols[f"delta_{h}"] = F.round(F.when(p0 > 0, (p1 - p0) / p0 * 100), 2)
    alphas = {}
    for h in ("1d", "3d", "7d"):
        for b in ("xbi", "ibb"):
            alphas[b, h] = alpha_pct(p0, F.col(f"price{h}"), F.col(f"{b}_at_alert"), F.col(f"{b}{h}"))
            cols[f"{b}_alpha_{h}"] = F.round(alphas[b, h], 2)
    best = F.coalesce(alphas["xbi", "1d"], alphas["ibb", "1d"])
    cols["direction_correct"] = direction_hit(cols["delta_1d"], F.col("alert_direction"))
    cols["direction_correct_alpha"] = direction_hit(best, F.col("alert_direction"))
    return alerts.select("id", "symbol", "alert_direction", *[c.alias(n) for n, c in cols.items()])


def signal_timeline(alerts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Alerts of every symbol with the change since the symbol's previous alert in range."""
    rows = alerts.filter(
        F.col("price_at_alert").isNotNull() & ~F.col("archived") & (F.col("sent_at") > before(as_of, days=days))
    ).withColumn("__us", micros(F.col("sent_at")))
    rows = lag_in_order(rows, ["symbol"], "__us", ["price_at_alert", "__us", "alert_direction"], ["id"])
    prev = F.col("prev")
    p0, p1, direction = F.col("price_at_alert"), F.col("price1d"), F.col("alert_direction")
    delta = F.when(prev["price_at_alert"] > 0, F.round((p0 / prev["price_at_alert"] - 1) * 100, 2))
    gap = (F.col("__us") - prev["__us"]) / F.lit(3_600_000_000)
    correct = F.when(
        p1.isNotNull() & direction.isNotNull(),
        ((direction == "positive") & (p1 > p0)) | ((direction == "negative") & (p1 < p0)),
    )
    return rows.select(
        "id", "symbol", "rule_name", "sent_at", "alert_direction", "price_at_alert",
        message_conviction(F.col("message")).alias("conviction"),
        delta.alias("delta_from_prev_pct"),
        half_up(gap, 1).alias("hours_since_prev"),
        (prev["alert_direction"] == direction).alias("same_direction"),
        correct.alias("correct_1d"),
    )


def timeline_summary(timeline: DataFrame) -> DataFrame:
    """Direction consistency, hit rate and mean gap per symbol."""
    pos, neg = F.count_if(F.col("alert_direction") == "positive"), F.count_if(F.col("alert_direction") == "negative")
    known = F.count("alert_direction")
    good, seen = F.count_if("correct_1d"), F.count("correct_1d")
    return timeline.groupBy("symbol").agg(
        F.count("*").alias("total_alerts"),
        half_up(F.avg("hours_since_prev"), 1).alias("avg_hours_between"),
        F.when(known > 0, half_up(F.greatest(pos, neg) / known * 100)).alias("consistency_pct"),
        F.when(seen > 0, half_up(good / seen * 100)).alias("hit_rate_1d"),
        F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("mixed").alias("dominant"),
    )


def ticker_profile(alerts: DataFrame, as_of: Column, days: int = 90, last: int = 20, minimum: int = 3) -> DataFrame:
    """Per symbol over its last priced alerts: hit rate, mean move, consistency, recent signals."""
    priced = alerts.filter(
        F.col("price_at_alert").isNotNull() & F.col("price1d").isNotNull() & ~F.col("archived")
        & (F.col("sent_at") > before(as_of, days=days))
    )
    rows = _profile_rows(first_k(priced, ["symbol"], [F.desc("sent_at"), F.desc("id")], last))
    pos, neg = F.count_if(F.col("alert_direction") == "positive"), F.count_if(F.col("alert_direction") == "negative")
    known, seen = F.count("alert_direction"), F.count("hit")
    head = rows.groupBy("symbol").agg(
        F.count("*").alias("signals"),
        F.when(seen > 0, half_up(F.count_if("hit") / seen * 100)).alias("hit_rate_1d"),
        half_up(F.avg(F.abs("move")), 1).alias("avg_abs_move_1d"),
        F.when(pos > neg, "bullish").when(neg > pos, "bearish").otherwise("mixed").alias("dominant"),
        F.when(known > 0, half_up(F.greatest(pos, neg) / known, 2)).otherwise(F.lit(0.0)).alias("consistency"),
    ).filter(F.col("signals") >= minimum)
    usable = rows.filter(F.col("alert_direction").isNotNull() & F.col("move").isNotNull())
    age = half_up((micros(as_of) - micros(F.col("sent_at"))) / F.lit(86_400_000_000)).cast("string")
    note = F.concat_ws(":", age, "rule_name", "alert_direction", half_up(F.col("move"), 1).cast("decimal(18,1)").cast("string"))
    recent = (
        first_k(usable, ["symbol"], [F.desc("sent_at"), F.desc("id")], 3)
        .groupBy("symbol")
        .agg(F.array_sort(F.collect_list(F.struct((-micros(F.col("sent_at"))).alias("o"), note.alias("note")))).alias("r"))
        .select("symbol", F.array_join(F.col("r.note"), " | ").alias("recent"))
    )
    return head.join(recent, "symbol", "left")


def _profile_rows(rows: DataFrame) -> DataFrame:
    p0, p1 = F.col("price_at_alert"), F.col("price1d")
    ok = (p0 != 0) & (p1 != 0)
    move = F.when(ok, (p1 - p0) / p0 * 100)
    return rows.withColumn("move", move).withColumn(
        "hit", F.when(ok, direction_hit(p1 - p0, F.col("alert_direction")))
    )


def ticker_rule_profile(alerts: DataFrame, as_of: Column, days: int = 90, last: int = 20, minimum: int = 3) -> DataFrame:
    """Rule breakdown of the same alerts, most frequent rule first within a symbol."""
    priced = alerts.filter(
        F.col("price_at_alert").isNotNull() & F.col("price1d").isNotNull() & ~F.col("archived")
        & (F.col("sent_at") > before(as_of, days=days))
    )
    rows = _profile_rows(first_k(priced, ["symbol"], [F.desc("sent_at"), F.desc("id")], last))
    per_rule = rows.groupBy("symbol", "rule_name").agg(
        F.count("*").alias("n"),
        F.when(F.count("hit") > 0, half_up(F.count_if("hit") / F.count("hit") * 100)).alias("hit_rate_1d"),
        half_up(F.avg(F.when(F.col("alert_direction").isNotNull(), F.col("move"))), 1).alias("avg_move_1d"),
    )
    enough = rows.groupBy("symbol").agg(F.count("*").alias("__n")).filter(F.col("__n") >= minimum)
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "rule_name"))
    return per_rule.join(enough.select("symbol"), "symbol").withColumn("position", rank)


def outcomes_per_ticker(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.max_by("id", F.struct("sent_at", "id")).alias("latest_id"),
        F.count_if("correct_1d").alias("correct"),
        F.count("correct_1d").alias("evaluated"),
    )


def log_status_counts(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("errors")
    )


def collector_health(logs: DataFrame, as_of: Column, last: int = 10) -> DataFrame:
    """Status per collector from its last logs, plus errors of 24 hours."""
    failed = F.col("status").isin("FAILED", "PARTIAL")
    tail = first_k(logs, ["collector"], [F.desc("started_at"), F.desc("id")], last)
    recent = tail.groupBy("collector").agg(
        F.count_if(failed).alias("failed_in_last"),
        F.max_by("status", F.struct("started_at", "id")).alias("last_status"),
    )
    day = logs.groupBy("collector").agg(
        F.count_if(failed & (F.col("started_at") > before(as_of, hours=24))).alias("errors_24h"),
        F.max(F.when(failed, F.col("started_at"))).alias("last_error"),
        F.max(F.when(F.col("status") == "SUCCESS", F.col("started_at"))).alias("last_success"),
    )
    state = F.when(F.col("errors_24h") == 0, "OK").when(F.col("errors_24h") >= 3, "CRITICAL").otherwise("WARNING")
    return recent.join(day, "collector").withColumn("state", state)


def overall_health(collectors: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: CRITICAL if any collector is, HEALTHY only without warnings and system errors."""
    n_errors = errors.agg(F.count("*")).scalar()
    return collectors.agg(
        F.count_if(F.col("state") == "CRITICAL").alias("critical"), F.count_if(F.col("state") == "WARNING").alias("warning")
    ).withColumn("system_errors", n_errors).withColumn(
        "overall",
        F.when(F.col("critical") > 0, "CRITICAL")
        .when((F.col("warning") == 0) & (F.col("system_errors") == 0), "HEALTHY").otherwise("WARNING"),
    )


def next_runs(logs: DataFrame, intervals: DataFrame, as_of: Column) -> DataFrame:
    """Last run per collector and the seconds left to the next one (never negative)."""
    last = logs.groupBy("collector").agg(
        F.max("started_at").alias("last_run"), F.max_by("status", F.struct("started_at", "id")).alias("last_status")
    )
    out = last.join(intervals, "collector")
    next_run = F.col("last_run") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("interval_minutes"))
    left = F.floor((micros(next_run) - micros(as_of)) / F.lit(1_000_000))
    return out.withColumn("next_run", next_run).withColumn("seconds_left", F.greatest(left, F.lit(0)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table in one result."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eight_hour_summary(alerts: DataFrame, hours: int = 8) -> DataFrame:
    """Tumbling summary per rule; the same call serves a stream with a watermark."""
    return (
        alerts.groupBy(F.window("sent_at", f"{hours} hours").alias("w"), "rule_name")
        .agg(F.count("*").alias("total"), F.sum(F.col("delivered").cast("int")).alias("delivered"))
        .select(F.col("w.start").alias("window_start"), "rule_name", "total", "delivered")
    )


def level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("n"))
