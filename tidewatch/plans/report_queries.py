"""Registered queries: listings, statistics, timelines and health reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import reports as R
from tidewatch.plans.registry import query

AS_OF = "2024-01-31 00:00:00"


def now():
    return R.as_ts(AS_OF)


DAY = "1998-06-01 00:00:00"
SQL_NOW = f"TIMESTAMP '{AS_OF}'"
SQL_DAY = "DATE '1998-06-01'"
ALERT_COLS = ["id", "symbol", "rule_name", "priority", "sent_at", "alert_direction", "delivered"]


@query(
    "a1_hit_rate_by_rule", "alerts",
    f"""SELECT rule_name, count(*) AS total,
       count(*) FILTER (alert_direction IS NOT NULL AND price1d IS NOT NULL) AS evaluated_1d,
       count(*) FILTER ((alert_direction = 'positive' AND price1d > price_at_alert) OR (alert_direction = 'negative' AND price1d < price_at_alert)) AS correct_1d,
       count(*) FILTER (alert_direction IS NOT NULL AND price3d IS NOT NULL) AS evaluated_3d,
       count(*) FILTER ((alert_direction = 'positive' AND price3d > price_at_alert) OR (alert_direction = 'negative' AND price3d < price_at_alert)) AS correct_3d,
       CASE WHEN evaluated_1d > 0 THEN round(correct_1d * 100e0 / evaluated_1d, 1) END AS hit_rate_1d,
       CASE WHEN evaluated_3d > 0 THEN round(correct_3d * 100e0 / evaluated_3d, 1) END AS hit_rate_3d
    FROM alerts WHERE price_at_alert IS NOT NULL AND sent_at > {SQL_NOW} - INTERVAL 31 DAY GROUP BY 1""",
)
def a1(t):
    return R.hit_rates(t.alerts, F.col("rule_name"), "rule_name", now(), 31)


@query(
    "a2_hit_rate_by_catalyst", "alerts",
    f"""SELECT coalesce(catalyst_type, 'unknown') AS catalyst_type, count(*) AS total,
       count(*) FILTER (alert_direction IS NOT NULL AND price1d IS NOT NULL) AS evaluated_1d,
       count(*) FILTER ((alert_direction = 'positive' AND price1d > price_at_alert) OR (alert_direction = 'negative' AND price1d < price_at_alert)) AS correct_1d,
       count(*) FILTER (alert_direction IS NOT NULL AND price3d IS NOT NULL) AS evaluated_3d,
       count(*) FILTER ((alert_direction = 'positive' AND price3d > price_at_alert) OR (alert_direction = 'negative' AND price3d < price_at_alert)) AS correct_3d,
       CASE WHEN evaluated_1d > 0 THEN round(correct_1d * 100e0 / evaluated_1d, 1) END AS hit_rate_1d,
       CASE WHEN evaluated_3d > 0 THEN round(correct_3d * 100e0 / evaluated_3d, 1) END AS hit_rate_3d
    FROM alerts WHERE price_at_alert IS NOT NULL AND sent_at > {SQL_NOW} - INTERVAL 31 DAY GROUP BY 1""",
)
def a2(t):
    return R.hit_rates(t.alerts, F.coalesce("catalyst_type", F.lit("unknown")), "catalyst_type", now(), 31)


@query(
    "a3_alert_stats", "alerts",
    f"""SELECT count(*) AS total, count(*) FILTER (delivered) AS delivered, count(*) FILTER (NOT delivered) AS silent,
    count(DISTINCT symbol) AS symbols, count(*) FILTER (sent_at > {SQL_NOW} - INTERVAL 24 HOUR) AS last_24h
    FROM alerts WHERE sent_at > {SQL_NOW} - INTERVAL 31 DAY""",
)
def a3(t):
    return R.alert_stats(t.alerts, now(), 31)


@query(
    "a5_decision_reasons", "system_logs",
    f"SELECT decision_reason, count(*) AS n FROM system_logs WHERE created_at > {SQL_NOW} - INTERVAL 744 HOUR AND decision_reason IS NOT NULL GROUP BY 1",
)
def a5(t):
    return R.decision_counts(t.system_logs, now(), 744)


@query(
    "a6_symbols_with_alerts", "alerts",
    f"SELECT symbol, count(*) AS alert_count, max(sent_at) AS last_alert FROM alerts WHERE sent_at > {SQL_NOW} - INTERVAL 31 DAY AND NOT archived GROUP BY 1",
)
def a6(t):
    return R.symbols_with_alerts(t.alerts, now(), 31)


@query(
    "a7_rule_summary", "alerts",
    "SELECT rule_name, count(*) AS total, count(*) FILTER (delivered) AS delivered FROM alerts WHERE sent_at >= TIMESTAMP '2024-01-01' AND sent_at < TIMESTAMP '2024-02-01' GROUP BY 1",
)
def a7(t):
    return R.rule_summary(t.alerts, R.as_ts("2024-01-01 00:00:00"), R.as_ts("2024-02-01 00:00:00"))


@query(
    "a8_suppression_breakdown", "alerts",
    """SELECT non_delivery_reason, count(*) AS n, CASE non_delivery_reason WHEN 'observation' THEN 'Observation mode'
    WHEN 'sell_no_edge' THEN 'Insider SELL without edge' WHEN 'daily_limit' THEN 'Daily limit' ELSE non_delivery_reason END AS label
    FROM alerts WHERE NOT delivered AND non_delivery_reason IS NOT NULL GROUP BY 1""",
)
def a8(t):
    return R.suppression_breakdown(t.alerts)


@query(
    "a9_trade_totals", "trades",
    """SELECT transaction_type, count(*) AS n, CAST(sum(CAST(total_value AS DECIMAL(15,2))) AS DOUBLE) AS total_value
    FROM trades WHERE transaction_type IN ('BUY', 'SELL') GROUP BY 1""",
)
def a9(t):
    return R.trade_totals(t.trades)


@query(
    "a10_catalyst_status", "catalysts",
    f"""SELECT 'status' AS section, count(*) AS total, count(*) FILTER (outcome IS NOT NULL) AS resolved,
    count(*) FILTER (outcome IS NULL AND event_date >= {SQL_DAY}) AS upcoming, CAST(NULL AS DATE) AS event_date,
    CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS VARCHAR) AS drug_name FROM catalysts
    UNION ALL SELECT 'upcoming', NULL, NULL, NULL, event_date, symbol, drug_name FROM catalysts
    WHERE outcome IS NULL AND event_date BETWEEN {SQL_DAY} AND {SQL_DAY} + 30""",
)
def a10(t):
    return R.catalyst_status(t.catalysts, R.as_ts(DAY), 30)


@query(
    "a11_signed_returns", "alerts",
    """s AS (SELECT *, CASE WHEN alert_direction = 'positive' THEN 1 ELSE -1 END * (price3d - price_at_alert) / price_at_alert * 100 AS signed
      FROM alerts WHERE alert_direction IS NOT NULL AND price_at_alert > 0 AND price3d > 0)
    SELECT rule_name, alert_direction, delivered, count(*) AS n, round(avg(signed), 4) AS avg_signed_return,
    round(avg(CASE WHEN signed > 0 THEN 1e0 ELSE 0e0 END) * 100, 2) AS hit_pct FROM s GROUP BY 1, 2, 3""",
)
def a11(t):
    return R.signed_returns(t.alerts)


@query(
    "j3_sector_cohort", "alerts tickers",
    """s AS (SELECT sector, alert_direction, CASE WHEN alert_direction = 'positive' THEN 1 ELSE -1 END * (price3d - price_at_alert) / price_at_alert * 100 AS signed
      FROM alerts JOIN tickers USING (symbol) WHERE alert_direction IS NOT NULL AND price_at_alert > 0 AND price3d > 0)
    SELECT sector, alert_direction, count(*) AS n, round(avg(signed), 4) AS avg_signed_return,
    round(avg(CASE WHEN signed > 0 THEN 1e0 ELSE 0e0 END) * 100, 2) AS hit_pct FROM s GROUP BY 1, 2""",
)
def j3(t):
    return R.sector_cohort(t.alerts, t.tickers)


_PRICED = f"""base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sent_at DESC, id DESC) AS rn FROM alerts
    WHERE price_at_alert IS NOT NULL AND price1d IS NOT NULL AND NOT archived AND sent_at > {SQL_NOW} - INTERVAL 90 DAY) WHERE rn <= 20),
  p AS (SELECT *, CASE WHEN price_at_alert <> 0 AND price1d <> 0 THEN (price1d - price_at_alert) / price_at_alert * 100 END AS move,
    CASE WHEN price_at_alert <> 0 AND price1d <> 0 THEN CASE alert_direction WHEN 'positive' THEN price1d > price_at_alert WHEN 'negative' THEN price1d < price_at_alert END END AS hit FROM base)"""


@query(
    "a17_ticker_profile", "alerts",
    _PRICED + f""", head AS (SELECT symbol, count(*) AS signals,
      CASE WHEN count(hit) > 0 THEN CAST(floor(count(*) FILTER (hit) * 1e0 / count(hit) * 100 + 0.5) AS BIGINT) END AS hit_rate_1d,
      floor(avg(abs(move)) * 10 + 0.5) / 10 AS avg_abs_move_1d,
      CASE WHEN count(*) FILTER (alert_direction = 'positive') > count(*) FILTER (alert_direction = 'negative') THEN 'bullish'
        WHEN count(*) FILTER (alert_direction = 'positive') < count(*) FILTER (alert_direction = 'negative') THEN 'bearish' ELSE 'mixed' END AS dominant,
      CASE WHEN count(alert_direction) > 0 THEN floor(greatest(count(*) FILTER (alert_direction = 'positive'), count(*) FILTER (alert_direction = 'negative')) * 1e0 / count(alert_direction) * 100 + 0.5) / 100 ELSE 0e0 END AS consistency
      FROM p GROUP BY symbol HAVING count(*) >= 3),
    rec AS (SELECT symbol, string_agg(note, ' | ' ORDER BY sent_at DESC, id DESC) AS recent FROM (
      SELECT symbol, sent_at, id, concat_ws(':', CAST(CAST(floor(epoch({SQL_NOW} - sent_at) / 86400e0 + 0.5) AS BIGINT) AS VARCHAR), rule_name, alert_direction, CAST(CAST(floor(move * 10 + 0.5) / 10 AS DECIMAL(18,1)) AS VARCHAR)) AS note,
        row_number() OVER (PARTITION BY symbol ORDER BY sent_at DESC, id DESC) AS r FROM p WHERE alert_direction IS NOT NULL AND move IS NOT NULL) WHERE r <= 3 GROUP BY symbol)
    SELECT head.*, recent FROM head LEFT JOIN rec USING (symbol)""",
)
def a17(t):
    return R.ticker_profile(t.alerts, now())


@query(
    "a17_ticker_rule_profile", "alerts",
    _PRICED + """, r AS (SELECT symbol, rule_name, count(*) AS n,
      CASE WHEN count(hit) > 0 THEN CAST(floor(count(*) FILTER (hit) * 1e0 / count(hit) * 100 + 0.5) AS BIGINT) END AS hit_rate_1d,
      floor(avg(move) FILTER (alert_direction IS NOT NULL) * 10 + 0.5) / 10 AS avg_move_1d,
      sum(count(*)) OVER (PARTITION BY symbol) AS tot FROM p GROUP BY 1, 2)
    SELECT symbol, rule_name, n, hit_rate_1d, avg_move_1d, CAST(row_number() OVER (PARTITION BY symbol ORDER BY n DESC, rule_name) AS INT) AS position FROM r WHERE tot >= 3""",
)
def a17b(t):
    return R.ticker_rule_profile(t.alerts, now())


_TIMELINE = f"""tl AS (SELECT id, symbol, rule_name, sent_at, alert_direction, price_at_alert,
    CAST(nullif(regexp_extract(replace(replace(message, '\\.', '.'), '\\-', '-'), '(?i)Conviction:\\s*([+-]?\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS conviction,
    CASE WHEN lag(price_at_alert) OVER w > 0 THEN round((price_at_alert / lag(price_at_alert) OVER w - 1) * 100, 2) END AS delta_from_prev_pct,
    floor((epoch_us(sent_at) - lag(epoch_us(sent_at)) OVER w) / 3600000000e0 * 10 + 0.5) / 10 AS hours_since_prev,
    lag(alert_direction) OVER w = alert_direction AS same_direction,
    CASE WHEN price1d IS NOT NULL AND alert_direction IS NOT NULL THEN (alert_direction = 'positive' AND price1d > price_at_alert) OR (alert_direction = 'negative' AND price1d < price_at_alert) END AS correct_1d
    FROM alerts WHERE price_at_alert IS NOT NULL AND NOT archived AND sent_at > {SQL_NOW} - INTERVAL 31 DAY
    WINDOW w AS (PARTITION BY symbol ORDER BY sent_at, id))"""


@query("w1_signal_timeline", "alerts", _TIMELINE + " SELECT * FROM tl")
def w1(t):
    return R.signal_timeline(t.alerts, now(), 31)


@query(
    "a18_timeline_summary", "alerts",
    _TIMELINE + """ SELECT symbol, count(*) AS total_alerts, floor(avg(hours_since_prev) * 10 + 0.5) / 10 AS avg_hours_between,
    CASE WHEN count(alert_direction) > 0 THEN CAST(floor(greatest(count(*) FILTER (alert_direction = 'positive'), count(*) FILTER (alert_direction = 'negative')) * 1e0 / count(alert_direction) * 100 + 0.5) AS BIGINT) END AS consistency_pct,
    CASE WHEN count(correct_1d) > 0 THEN CAST(floor(count(*) FILTER (correct_1d) * 1e0 / count(correct_1d) * 100 + 0.5) AS BIGINT) END AS hit_rate_1d,
    CASE WHEN count(*) FILTER (alert_direction = 'positive') > count(*) FILTER (alert_direction = 'negative') THEN 'positive'
      WHEN count(*) FILTER (alert_direction = 'positive') < count(*) FILTER (alert_direction = 'negative') THEN 'negative' ELSE 'mixed' END AS dominant
    FROM tl GROUP BY symbol""",
)
def a18(t):
    return R.timeline_summary(R.signal_timeline(t.alerts, now(), 31))


_OUTCOME = """oc AS (SELECT id, symbol, rule_name, alert_direction, sent_at, """ + ", ".join(
    f"""round(CASE WHEN price_at_alert > 0 THEN (price{h} / price_at_alert - 1) * 100 END, 2) AS delta_{h},
    CASE WHEN alert_direction = 'positive' AND price{h} > price_at_alert THEN true WHEN alert_direction = 'negative' AND price{h} < price_at_alert THEN true
    WHEN price{h} IS NULL OR alert_direction IS NULL THEN NULL ELSE false END AS correct_{h}"""
    for h in ("1h", "1d", "3d")
) + " FROM alerts WHERE price_at_alert IS NOT NULL)"


@query("w6_outcome_projection", "alerts", _OUTCOME + " SELECT * FROM oc")
def w6(t):
    return R.outcome_rows(t.alerts)


@query(
    "a19_outcomes_per_ticker", "alerts",
    _OUTCOME + " SELECT symbol, count(*) AS n, arg_max(id, (sent_at, id)) AS latest_id, count(*) FILTER (correct_1d) AS correct, count(correct_1d) AS evaluated FROM oc GROUP BY 1",
)
def a19(t):
    return R.outcomes_per_ticker(R.outcome_rows(t.alerts))


def _pct(a, b):
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ({b} - {a}) / {a} * 100 END"


_ALPHA = {
    (b, h): f"({_pct('price_at_alert', 'price' + h)} - {_pct(b + '_at_alert', b + h)})"
    for h in ("1d", "3d", "7d")
    for b in ("xbi", "ibb")
}


@query(
    "m11_outcome_mapping", "alerts",
    "m AS (SELECT id, symbol, alert_direction, "
    + ", ".join(f"round(CASE WHEN price_at_alert > 0 THEN (price{h} - price_at_alert) / price_at_alert * 100 END, 2) AS delta_{h}" for h in ("1h", "4h", "1d", "3d", "7d"))
    + ", " + ", ".join(f"round({e}, 2) AS {b}_alpha_{h}" for (b, h), e in _ALPHA.items())
    + f", coalesce({_ALPHA['xbi', '1d']}, {_ALPHA['ibb', '1d']}) AS best FROM alerts) "
    + """SELECT * EXCLUDE (best), CASE alert_direction WHEN 'positive' THEN delta_1d > 0 WHEN 'negative' THEN delta_1d < 0 END AS direction_correct,
    CASE alert_direction WHEN 'positive' THEN best > 0 WHEN 'negative' THEN best < 0 END AS direction_correct_alpha FROM m""",
)
def m11(t):
    return R.outcome_mapping(t.alerts)


@query("a20_log_status_counts", "system_logs", "SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS errors FROM system_logs")
def a20(t):
    return R.log_status_counts(t.system_logs)


_HEALTH = f"""tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collector ORDER BY started_at DESC, id DESC) AS rn FROM collection_logs) WHERE rn <= 10),
  rec AS (SELECT collector, count(*) FILTER (status IN ('FAILED', 'PARTIAL')) AS failed_in_last, arg_max(status, (started_at, id)) AS last_status FROM tail GROUP BY 1),
  day AS (SELECT collector, count(*) FILTER (status IN ('FAILED', 'PARTIAL') AND started_at > {SQL_NOW} - INTERVAL 24 HOUR) AS errors_24h,
    max(started_at) FILTER (status IN ('FAILED', 'PARTIAL')) AS last_error, max(started_at) FILTER (status = 'SUCCESS') AS last_success FROM collection_logs GROUP BY 1),
  h AS (SELECT *, CASE WHEN errors_24h = 0 THEN 'OK' WHEN errors_24h >= 3 THEN 'CRITICAL' ELSE 'WARNING' END AS state FROM rec JOIN day USING (collector))"""


@query("a30_collector_health", "collection_logs", _HEALTH + " SELECT * FROM h")
def a30(t):
    return R.collector_health(t.collection_logs, now())


@query(
    "a30_overall_health", "collection_logs system_logs",
    _HEALTH + f""", e AS (SELECT count(*) AS n FROM system_logs WHERE level = 'error' AND created_at >= {SQL_NOW} - INTERVAL 24 HOUR AND (class_name IS NULL OR class_name NOT IN ('Service1', 'Service2')))
    SELECT count(*) FILTER (state = 'CRITICAL') AS critical, count(*) FILTER (state = 'WARNING') AS warning, any_value(e.n) AS system_errors,
    CASE WHEN count(*) FILTER (state = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (state = 'WARNING') = 0 AND any_value(e.n) = 0 THEN 'HEALTHY' ELSE 'WARNING' END AS overall FROM h, e""",
)
def a30b(t):
    errors = R.system_errors(t.system_logs, now(), ["Service1", "Service2"])
    return R.overall_health(R.collector_health(t.collection_logs, now()), errors)


@query(
    "p1_recent_alerts", "alerts",
    f"SELECT {', '.join(ALERT_COLS)} FROM alerts WHERE NOT archived ORDER BY sent_at DESC, id DESC LIMIT 200",
)
def p1(t):
    return R.recent_alerts(t.alerts, limit=200).select(*ALERT_COLS)


@query(
    "p2_ordered_rules", "alerts",
    "SELECT rule_name AS name, max(priority) AS priority, count(*) AS alerts FROM alerts GROUP BY 1",
)
def p2(t):
    rules = t.alerts.groupBy(F.col("rule_name").alias("name")).agg(
        F.max("priority").alias("priority"), F.count("*").alias("alerts")
    )
    return R.ordered_rules(rules)


@query("p3_active_tickers", "tickers", "SELECT symbol, name, subsector, sector FROM tickers WHERE is_active AND sector = 'healthcare'")
def p3(t):
    return R.active_tickers(t.tickers, sector="healthcare").select("symbol", "name", "subsector", "sector")


@query("p4_newest_filings", "filings", "SELECT accession, symbol, filing_date, direction FROM filings WHERE analyzed ORDER BY filing_date DESC, accession DESC LIMIT 500")
def p4(t):
    return R.newest(t.filings.filter("analyzed"), "filing_date", 500, "accession").select("accession", "symbol", "filing_date", "direction")


@query("p4_newest_mentions", "mentions", "SELECT external_id, source, published_at FROM mentions ORDER BY published_at DESC, external_id DESC LIMIT 100")
def p4b(t):
    return R.newest(t.mentions, "published_at", 100, "external_id").select("external_id", "source", "published_at")


@query(
    "p5_upcoming_catalysts", "catalysts",
    f"""SELECT symbol, drug_name, event_date, CAST(event_date - {SQL_DAY} AS INT) AS days_left,
    concat(drug_name, ' (', coalesce(area, 'n/a'), ') in ', event_date - {SQL_DAY}, ' days') AS context
    FROM catalysts WHERE outcome IS NULL AND event_date BETWEEN {SQL_DAY} AND {SQL_DAY} + 90""",
)
def p5(t):
    return R.upcoming_catalysts(t.catalysts, R.as_ts(DAY), 90).select("symbol", "drug_name", "event_date", "days_left", "context")


@query(
    "m26_calendar_reminder", "catalysts",
    f"""SELECT symbol, drug_name, event_date, CAST(event_date - {SQL_DAY} AS INT) AS days_left FROM catalysts
    WHERE event_date - {SQL_DAY} BETWEEN -3 AND 7""",
)
def m26(t):
    left = F.date_diff("event_date", F.to_date(R.as_ts(DAY)))
    return (
        t.catalysts.filter(F.col("event_date").between(F.date_sub(F.to_date(R.as_ts(DAY)), 3), F.date_add(F.to_date(R.as_ts(DAY)), 7)))
        .select("symbol", "drug_name", "event_date", left.alias("days_left")).orderBy("days_left", "symbol", "drug_name")
    )


@query(
    "p6_significant_trades", "trades",
    "SELECT trade_id, symbol, transaction_type, total_value, transaction_date FROM trades WHERE transaction_type IN ('BUY', 'SELL') AND total_value >= 100000 ORDER BY transaction_date DESC, trade_id DESC LIMIT 100",
)
def p6(t):
    return R.significant_trades(t.trades, 100).select("trade_id", "symbol", "transaction_type", "total_value", "transaction_date")


@query(
    "p7_open_flows", "bars",
    f"""SELECT occ, symbol, session, volume, expiry, count(*) OVER () AS total FROM bars WHERE expiry >= {SQL_DAY}
    ORDER BY session DESC, volume DESC, occ LIMIT 50 OFFSET 50""",
)
def p7(t):
    return R.open_flows(t.bars, R.as_ts(DAY), 50, 50).select("occ", "symbol", "session", "volume", "expiry", "total")


@query(
    "p8_flow_notional", "bars",
    """SELECT occ, symbol, session, volume, volume * 100 * underlying AS notional, count(*) OVER w AS contracts,
    round(sum(volume * 100 * underlying) OVER w, 2) AS session_notional FROM bars WINDOW w AS (PARTITION BY symbol, session)""",
)
def p8(t):
    return R.flow_notional(t.bars).select("occ", "symbol", "session", "volume", "notional", "contracts", "session_notional")


@query(
    "p9_log_search", "system_logs",
    """SELECT id, created_at, module, status, level, count(*) OVER () AS total FROM system_logs
    WHERE module = 'correlation' AND status = 'success' AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'
    ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 100""",
)
def p9(t):
    return R.search_logs(
        t.system_logs, module="correlation", status="success", since=R.as_ts("2024-01-05 00:00:00"),
        until=R.as_ts("2024-01-25 00:00:00"), limit=200, offset=100,
    ).select("id", "created_at", "module", "status", "level", "total")


@query("p10_trace", "system_logs", "SELECT id, created_at, trace_id, module, status FROM system_logs WHERE trace_id = 't7'")
def p10(t):
    return R.trace(t.system_logs, "t7").select("id", "created_at", "trace_id", "module", "status")


@query(
    "p11_ticker_logs", "system_logs",
    f"SELECT id, created_at, ticker, level FROM system_logs WHERE ticker = 'S7' AND created_at >= {SQL_NOW} - INTERVAL 168 HOUR ORDER BY created_at DESC, id DESC LIMIT 100",
)
def p11(t):
    return R.ticker_logs(t.system_logs, "S7", now(), 168).select("id", "created_at", "ticker", "level")


@query(
    "p12_system_errors", "system_logs",
    f"SELECT id, created_at, class_name FROM system_logs WHERE level = 'error' AND created_at >= {SQL_NOW} - INTERVAL 744 HOUR AND (class_name IS NULL OR class_name NOT IN ('Service1', 'Service2'))",
)
def p12(t):
    return R.system_errors(t.system_logs, now(), ["Service1", "Service2"], 744).select("id", "created_at", "class_name")


@query("p13_rule_panel", "alerts", "SELECT id, rule_name, symbol FROM alerts WHERE rule_name IN ('Correlated Signal')")
def p13(t):
    return R.rule_panel(t.alerts, ["Correlated Signal"]).select("id", "rule_name", "symbol")


@query(
    "p16_page_after", "alerts",
    "SELECT id, symbol, price_at_alert FROM alerts WHERE price_at_alert IS NULL OR price_at_alert < 20 OR price_at_alert = 20 AND id > 100 ORDER BY price_at_alert DESC NULLS LAST, id LIMIT 200",
)
def p16_after(t):
    return R.page_after(t.alerts, "price_at_alert", "id", 200, (20.0, 100)).select("id", "symbol", "price_at_alert")


@query(
    "p14_recent_timeline", "alerts",
    f"""SELECT id, symbol, sent_at, CAST(nullif(regexp_extract(replace(replace(message, '\\.', '.'), '\\-', '-'), '(?i)Conviction:\\s*([+-]?\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS conviction
    FROM alerts WHERE price_at_alert IS NOT NULL AND NOT archived AND sent_at > {SQL_NOW} - INTERVAL 90 DAY ORDER BY sent_at DESC, id DESC LIMIT 100""",
)
def p14(t):
    return R.recent_timeline(t.alerts, now(), 90, 100).select("id", "symbol", "sent_at", "conviction")


@query(
    "p16_sorted_page", "trades",
    "SELECT trade_id, symbol, total_value FROM trades ORDER BY total_value DESC NULLS LAST, trade_id LIMIT 25 OFFSET 50",
)
def p16(t):
    return R.sorted_page(t.trades, "total_value", "trade_id", 2, 25).select("trade_id", "symbol", "total_value")


@query(
    "t10_message_conviction", "alerts",
    "SELECT id, CAST(nullif(regexp_extract(replace(replace(message, '\\.', '.'), '\\-', '-'), '(?i)Conviction:\\s*([+-]?\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS conviction FROM alerts",
)
def t10(t):
    from tidewatch.functions.text import message_conviction

    return t.alerts.select("id", message_conviction(F.col("message")).alias("conviction"))


@query(
    "j1_observation_alerts", "alerts tickers",
    """SELECT id, symbol, sent_at, sector FROM alerts LEFT JOIN (SELECT symbol, sector FROM tickers) USING (symbol)
    WHERE non_delivery_reason = 'observation' AND sent_at >= TIMESTAMP '2024-01-01'""",
)
def j1(t):
    rows = t.alerts.filter(
        (F.col("non_delivery_reason") == "observation") & (F.col("sent_at") >= R.as_ts("2024-01-01 00:00:00"))
    )
    return rows.join(t.tickers.select("symbol", "sector"), "symbol", "left").select("id", "symbol", "sent_at", "sector").orderBy(F.desc("sent_at"))


@query(
    "j2_ticker_funnel", "alerts tickers filings",
    f"""f AS (SELECT cik, count(DISTINCT accession) AS filings, count(DISTINCT accession) FILTER (analyzed) AS analyzed FROM filings WHERE filing_date > {SQL_NOW} - INTERVAL 31 DAY GROUP BY 1),
    a AS (SELECT symbol, count(DISTINCT id) AS alerts, count(DISTINCT id) FILTER (delivered) AS delivered FROM alerts WHERE sent_at > {SQL_NOW} - INTERVAL 31 DAY GROUP BY 1)
    SELECT symbol, coalesce(filings, 0) AS filings, coalesce(analyzed, 0) AS analyzed, coalesce(alerts, 0) AS alerts, coalesce(delivered, 0) AS delivered
    FROM tickers LEFT JOIN f USING (cik) LEFT JOIN a USING (symbol)""",
)
def j2(t):
    from tidewatch.operators.feeds import ticker_funnel

    return ticker_funnel(t.tickers, t.filings, t.alerts, now(), 31)


@query("j13_active_healthcare_filings", "filings tickers", "SELECT accession, symbol, filing_date FROM filings WHERE form_type = '8-K' AND symbol IN (SELECT symbol FROM tickers WHERE sector = 'healthcare' AND is_active)")
def j13(t):
    keep = R.active_tickers(t.tickers, sector="healthcare").select("symbol")
    return t.filings.filter("form_type = '8-K'").join(keep, "symbol", "left_semi").select("accession", "symbol", "filing_date")


@query(
    "j15_next_runs", "collection_logs",
    f"""iv AS (SELECT event_type AS collector, CAST(30 + length(event_type) * 15 AS INT) AS interval_minutes FROM (SELECT DISTINCT event_type FROM events)),
    l AS (SELECT collector, max(started_at) AS last_run, arg_max(status, (started_at, id)) AS last_status FROM collection_logs GROUP BY 1)
    SELECT collector, last_run, last_status, interval_minutes, last_run + interval_minutes * INTERVAL 1 MINUTE AS next_run,
    CAST(greatest(floor((epoch_us(last_run + interval_minutes * INTERVAL 1 MINUTE) - epoch_us(TIMESTAMP '2024-01-30 23:50:00')) / 1000000e0), 0) AS BIGINT) AS seconds_left FROM l JOIN iv USING (collector)""",
)
def j15(t):
    intervals = t.raw("events").select(F.col("event_type").alias("collector")).distinct().withColumn(
        "interval_minutes", F.lit(30) + F.length("collector") * 15
    )
    return R.next_runs(t.collection_logs, intervals, R.as_ts("2024-01-30 23:50:00"))


@query(
    "s13_table_counts", "",
    "SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'supplier', count(*) FROM supplier",
)
def s13(t):
    return R.table_counts({n: t.raw(n) for n in ("events", "lineitem", "orders", "documents", "supplier")})


@query(
    "st8_eight_hour_summary", "alerts",
    """SELECT time_bucket(INTERVAL 8 HOUR, sent_at, TIMESTAMP '2024-01-01') AS window_start, rule_name, count(*) AS total, CAST(sum(CASE WHEN delivered THEN 1 ELSE 0 END) AS BIGINT) AS delivered
    FROM alerts GROUP BY 1, 2""",
)
def st8(t):
    return R.eight_hour_summary(t.alerts)


@query(
    "a12_weekly_report", "alerts catalysts",
    f"""SELECT 'rule' AS section, rule_name AS item, count(*) AS n FROM alerts WHERE price_at_alert IS NOT NULL AND sent_at > {SQL_NOW} - INTERVAL 7 DAY GROUP BY 2
    UNION ALL SELECT 'catalyst', coalesce(catalyst_type, 'unknown'), count(*) FROM alerts WHERE price_at_alert IS NOT NULL AND sent_at > {SQL_NOW} - INTERVAL 7 DAY GROUP BY 2
    UNION ALL SELECT 'delivery', CASE WHEN delivered THEN 'sent' ELSE coalesce(non_delivery_reason, 'unknown') END, count(*) FROM alerts WHERE sent_at > {SQL_NOW} - INTERVAL 7 DAY GROUP BY 2
    UNION ALL SELECT 'decisions', CASE WHEN outcome IS NULL THEN 'open' ELSE 'resolved' END, count(*) FROM catalysts GROUP BY 2""",
)
def a12(t):
    week = t.alerts.filter(F.col("sent_at") > R.before(now(), days=7))
    item = lambda df, section, col: df.groupBy(col.alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit(section))
    priced = week.filter("price_at_alert IS NOT NULL")
    delivery = F.when(F.col("delivered"), "sent").otherwise(F.coalesce("non_delivery_reason", F.lit("unknown")))
    decision = F.when(F.col("outcome").isNull(), "open").otherwise("resolved")
    return (
        item(priced, "rule", F.col("rule_name"))
        .unionByName(item(priced, "catalyst", F.coalesce("catalyst_type", F.lit("unknown"))))
        .unionByName(item(week, "delivery", delivery))
        .unionByName(item(t.catalysts, "decisions", decision))
    )
