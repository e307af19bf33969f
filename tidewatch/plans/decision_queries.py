"""Registered queries: insider decisions, gates, throttles, discovery, joins between feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scoring as S, text as X
from tidewatch.operators import decisions as D, feeds as J
from tidewatch.operators.reports import as_ts
from tidewatch.plans.registry import query

# Analysis columns of a trade (the model output of the live flow), derived from the trade itself.
ANALYSIS = {
    "trade_id": "trade_id",
    "conviction": "(CAST(shares AS INT) % 41 - 20) / 10e0",
    "direction": "CASE CAST(shares AS INT) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END",
    "magnitude": "CASE (CAST(shares AS INT) + idx) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
    "confidence": "(CAST(shares AS INT) % 10) / 10e0",
    "attention": "CAST(shares AS INT) % 17 = 0",
    "catalyst_type": "CASE idx % 3 WHEN 0 THEN 'earnings' WHEN 1 THEN 'leadership' ELSE 'other' END",
}
_AN = "an AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ANALYSIS.items()) + " FROM trades)"


def _analyses(t):
    return t.trades.selectExpr(*[f"{e} AS {c}" for c, e in ANALYSIS.items()])


def _csuite(r: str) -> str:
    bare = f"regexp_replace({r}, '(?i)(vice|senior)\\s+president', '', 'g')"
    return (
        f"coalesce(regexp_matches({r}, '(?i)\\bChief\\s+(Executive|Financial|Operating|Technology|Information|Medical|Scientific|Legal|Accounting)\\s+Officer\\b') "
        f"OR regexp_matches({r}, '(?i)\\b(CEO|CFO|COO|CTO|CIO|CMO|CSO|CLO)\\b') OR regexp_matches({bare}, '(?i)\\bPresident\\b') "
        f"OR regexp_matches({r}, '(?i)\\bChair(man|woman|person)\\b') OR regexp_matches({r}, '(?i)\\b(?:EVP|Executive\\s+Vice\\s+President)[\\s,]+.*?(Finance|Operations?|Product|Strategy)\\b') "
        f"OR regexp_matches({r}, '(?i)\\bPrincipal\\s+(Financial|Accounting)\\s+Officer\\b'), false)"
    )


def _director(r: str) -> str:
    return f"coalesce(regexp_matches({r}, '(?i)\\bDirector\\b'), false)"


_ROLES = f"ro AS (SELECT *, {_csuite('insider_role')} AS cs, {_director('insider_role')} AS di FROM trades)"


@query("m18_role_class", "trades", _ROLES + " SELECT trade_id, insider_role, cs AS is_csuite, di AS is_director, coalesce(regexp_matches(upper(insider_role), 'CEO|CFO|COO|CMO|CTO|CIO|CLO|PRESIDENT|CHAIRMAN|EVP|CHIEF (EXECUTIVE|FINANCIAL|OPERATING|MEDICAL|TECHNOLOGY|LEGAL|COMMERCIAL|SCIENTIFIC)|EXECUTIVE VICE PRESIDENT'), false) AS is_csuite_title FROM ro")
def m18(t):
    r = F.col("insider_role")
    return t.trades.select(
        "trade_id", "insider_role", S.is_csuite(r).alias("is_csuite"), S.is_director(r).alias("is_director"),
        S.is_csuite_title(r.isNotNull(), r).alias("is_csuite_title"),
    )


_M19 = _ROLES + """, e AS (SELECT *, CASE WHEN coalesce(total_value, 0) < 100000 THEN 'SKIP_LOW_VALUE' WHEN transaction_type NOT IN ('BUY', 'SELL') THEN 'SKIP_NOT_ALERTABLE' WHEN coalesce(is_plan, false) THEN 'SKIP_10B51_PLAN'
    WHEN transaction_type = 'SELL' AND di AND NOT cs THEN 'SKIP_DIRECTOR_SELL' WHEN transaction_type = 'SELL' AND NOT cs THEN 'SKIP_NON_ROLE_SELL' END AS early FROM ro),
  l AS (SELECT e.*, row_number() OVER (PARTITION BY symbol, filing_date ORDER BY trade_id) AS rn FROM e WHERE early IS NULL),
  x AS (SELECT trade_id, symbol, CASE WHEN rn > 2 THEN 'SKIP_DAILY_CAP' WHEN coalesce(observation_only, false) AND coalesce(sector, '') NOT IN ('biotech_apls', 'healthcare_discovery') THEN 'SKIP_OBSERVATION_TICKER'
    WHEN sector IN ('biotech_apls', 'healthcare_discovery') AND transaction_type <> 'BUY' THEN CASE sector WHEN 'biotech_apls' THEN 'SKIP_APLS_NON_BUY' ELSE 'SKIP_DISCOVERY_NON_BUY' END
    WHEN sector IN ('biotech_apls', 'healthcare_discovery') AND total_value < 500000 THEN CASE sector WHEN 'biotech_apls' THEN 'SKIP_APLS_BELOW_THRESHOLD' ELSE 'SKIP_DISCOVERY_BELOW_THRESHOLD' END END AS action
    FROM l LEFT JOIN (SELECT symbol, sector, observation_only FROM tickers) USING (symbol))"""


@query("m19_form4_actions", "trades tickers", _M19 + " SELECT trade_id, symbol, early AS action FROM e WHERE early IS NOT NULL UNION ALL SELECT trade_id, symbol, action FROM x")
def m19(t):
    return D.form4_actions(t.trades, t.tickers, daily_cap=2)


_ALIGN = "CASE WHEN (direction = 'negative' AND conviction > 0) OR (direction = 'positive' AND conviction < 0) THEN -conviction ELSE conviction END"
_F4P = """CASE WHEN attention AND abs({c}) >= 0.3 THEN 'CRITICAL' WHEN abs({c}) >= 0.8 AND confidence >= 0.6 THEN 'CRITICAL' WHEN abs({c}) >= 0.4 AND magnitude <> 'low' AND confidence >= 0.5 THEN 'HIGH'
    WHEN magnitude = 'high' AND confidence >= 0.6 THEN 'HIGH' WHEN abs({c}) >= 0.2 AND magnitude = 'medium' THEN 'MEDIUM' END"""


@query("m23_aligned_conviction", "trades", _AN + f" SELECT trade_id, {_ALIGN} AS aligned FROM an")
def m23(t):
    return _analyses(t).select("trade_id", S.aligned_conviction(F.col("conviction"), F.col("direction")).alias("aligned"))


@query(
    "m16_priorities", "trades",
    _AN + f""" SELECT trade_id, {_F4P.format(c='conviction')} AS form4_priority, CASE WHEN attention AND abs(conviction) >= 0.4 THEN CASE WHEN magnitude = 'high' THEN 'CRITICAL' ELSE 'HIGH' END
    WHEN magnitude = 'high' AND confidence >= 0.7 THEN 'CRITICAL' WHEN magnitude = 'medium' AND confidence >= 0.6 THEN 'HIGH' WHEN magnitude = 'high' THEN 'HIGH' END AS form8k_priority FROM an""",
)
def m16(t):
    args = [F.col(c) for c in ("conviction", "magnitude", "confidence", "attention")]
    return _analyses(t).select("trade_id", S.form4_priority(*args).alias("form4_priority"), S.form8k_priority(*args).alias("form8k_priority"))


@query(
    "m17_rule_name", "trades",
    _AN + """ SELECT trade_id, 'Form 4 Insider Signal' AS form4_rule, CASE catalyst_type WHEN 'earnings' THEN '8-K Earnings Miss' WHEN 'leadership' THEN '8-K Leadership Change' ELSE '8-K Material Event GPT' END AS form8k_rule FROM an""",
)
def m17(t):
    c = F.col("catalyst_type")
    return _analyses(t).select("trade_id", S.rule_name(F.lit("Form4"), c).alias("form4_rule"), S.rule_name(F.lit("8-K"), c).alias("form8k_rule"))


_M20 = _ROLES + ", " + _AN + f""", sc AS (SELECT ro.*, an.* EXCLUDE (trade_id), sector, observation_only, ({_ALIGN}) * CASE WHEN transaction_type = 'BUY' THEN CASE WHEN cs THEN 1.3e0 WHEN di THEN 1.15e0 ELSE 1e0 END * CASE WHEN sector IN ('healthcare', 'biotech_apls', 'healthcare_discovery') THEN 1.2e0 ELSE 1e0 END
     * CASE WHEN sector = 'biotech_apls' AND symbol IN ('S2', 'S7', 'S12') THEN 1.1e0 ELSE 1e0 END ELSE 1 END AS fc FROM ro JOIN an USING (trade_id) LEFT JOIN (SELECT symbol, sector, observation_only FROM tickers) USING (symbol)),
  pr AS (SELECT *, {_F4P.format(c='fc')} AS bp FROM sc),
  fl AS (SELECT *, CASE WHEN cs AND (bp IS NULL OR bp = 'MEDIUM') THEN 'HIGH' WHEN bp IS NULL AND transaction_type = 'BUY' AND di AND total_value >= 100000 THEN 'MEDIUM' ELSE bp END AS priority FROM pr)"""


@query(
    "m20_form4_scored", "trades tickers",
    _M20 + """ SELECT trade_id, round(fc, 9) AS final_conviction, bp AS base_priority, priority, CASE WHEN priority IS NOT NULL THEN CASE WHEN transaction_type = 'BUY' THEN 'Form 4 Insider BUY' ELSE 'Form 4 Insider Signal' END END AS rule_name,
    CASE WHEN direction = 'neutral' THEN CASE WHEN fc >= 0 THEN 'positive' ELSE 'negative' END ELSE direction END AS effective_direction FROM fl""",
)
def m20(t):
    out = D.form4_scored(t.trades, t.tickers, _analyses(t), ("S2", "S7", "S12"))
    return out.select("trade_id", F.round("final_conviction", 9).alias("final_conviction"), "base_priority", "priority", "rule_name", "effective_direction")


_F8P = """CASE WHEN attention AND abs(conviction) >= 0.4 THEN CASE WHEN magnitude = 'high' THEN 'CRITICAL' ELSE 'HIGH' END
    WHEN magnitude = 'high' AND confidence >= 0.7 THEN 'CRITICAL' WHEN magnitude = 'medium' AND confidence >= 0.6 THEN 'HIGH' WHEN magnitude = 'high' THEN 'HIGH' END"""


@query(
    "m20_low_priority", "trades tickers",
    _M20 + f" SELECT trade_id, CASE WHEN priority IS NULL THEN 'SKIP_LOW_PRIORITY' END AS form4_action, CASE WHEN {_F8P} IS NULL THEN 'SKIP_LOW_PRIORITY' END AS form8k_action FROM fl",
)
def m20_low(t):
    c = F.col
    out = D.form4_scored(t.trades, t.tickers, _analyses(t), ("S2", "S7", "S12"))
    other = D.low_priority(S.form8k_priority(c("conviction"), c("magnitude"), c("confidence"), c("attention")))
    return out.select("trade_id", c("action").alias("form4_action"), other.alias("form8k_action"))


@query(
    "m24_plain_filings", "filings",
    """e AS (SELECT accession, doc_id, symbol, form_type, CAST(filing_date AS TIMESTAMP) + (doc_id % 24) * INTERVAL 1 HOUR AS seen FROM filings),
    r AS (SELECT symbol, seen, min(doc_id) AS doc_id, row_number() OVER (PARTITION BY symbol ORDER BY seen) AS i FROM e WHERE form_type = '8-K' GROUP BY 1, 2),
    f AS (SELECT *, seen AS sent, true AS ok FROM r WHERE i = 1 UNION ALL SELECT r.*, CASE WHEN r.seen >= f.sent + INTERVAL 2 DAY THEN r.seen ELSE f.sent END, r.seen >= f.sent + INTERVAL 2 DAY FROM f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1),
    a AS (SELECT e.*, CASE WHEN form_type <> '8-K' THEN 'SKIP_NOT_8K' WHEN EXISTS (SELECT 1 FROM f WHERE ok AND f.doc_id = e.doc_id) THEN 'ALERT' ELSE 'THROTTLED' END AS action FROM e)
    SELECT accession, symbol, action, CASE WHEN action = 'ALERT' THEN 0.5e0 END AS conviction, CASE WHEN action = 'ALERT' THEN 'negative' END AS direction FROM a""",
    recursive=True,
)
def m24_plain(t):
    rules = t.spark.sql("SELECT '8-K Material Event' AS name, true AS is_active, 2880 AS throttle_minutes")
    events = t.filings.withColumn("at", F.expr("CAST(filing_date AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(doc_id % 24 AS INT))"))
    return D.plain_filing_alerts(events.drop("direction"), rules, "at", "doc_id").select("accession", "symbol", "action", "conviction", "direction")


@query(
    "m30_actionable", "trades tickers",
    _M20 + " SELECT trade_id, transaction_type = 'BUY' AND NOT coalesce(observation_only, false) AS actionable FROM fl",
)
def m30(t):
    return D.form4_scored(t.trades, t.tickers, _analyses(t)).select("trade_id", "actionable")


@query(
    "m24_form4_signals", "trades tickers",
    _M20 + """ SELECT trade_id, symbol, round(greatest(least(fc / 2, 1e0), -1e0), 9) AS signal FROM fl WHERE transaction_type = 'BUY' AND NOT coalesce(observation_only, false) AND coalesce(sector, '') <> 'healthcare_discovery'""",
)
def m24b(t):
    out = D.form4_scored(t.trades, t.tickers, _analyses(t), ("S2", "S7", "S12")).filter("signal IS NOT NULL")
    return out.select("trade_id", "symbol", F.round("signal", 9).alias("signal"))


@query(
    "m25_effective_direction", "trades",
    _AN + " SELECT trade_id, CASE WHEN direction = 'neutral' THEN CASE WHEN conviction >= 0 THEN 'positive' ELSE 'negative' END ELSE direction END AS effective FROM an",
)
def m25(t):
    return _analyses(t).select("trade_id", S.effective_direction(F.col("direction"), F.col("conviction")).alias("effective"))


# Surprise columns of a trade row for the consensus rules.
CONSENSUS = {
    "trade_id": "trade_id",
    "eps_actual": "CASE WHEN idx = 4 THEN NULL ELSE (CAST(shares AS INT) % 13 - 6) / 10e0 END",
    "eps_estimate": "CASE WHEN idx = 5 THEN NULL ELSE (CAST(shares AS INT) % 11 - 5) / 10e0 END",
    "revenue_actual": "CASE WHEN idx = 6 THEN NULL ELSE total_value * 10 END",
    "revenue_estimate": "CASE WHEN idx = 3 THEN NULL ELSE total_value * (8 + CAST(shares AS INT) % 5) END",
    "conviction": "(CAST(shares AS INT) % 41 - 20) / 20e0",
}
_CO = "co AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in CONSENSUS.items()) + """ FROM trades),
  su AS (SELECT *, CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) * 100 END AS eps, CASE WHEN revenue_estimate <> 0 THEN (revenue_actual - revenue_estimate) / abs(revenue_estimate) * 100 END AS rev FROM co),
  cp AS (SELECT *, CASE WHEN (coalesce(eps < 0, false) OR coalesce(rev < 0, false)) AND abs(conviction) > 0.3 THEN 'consensus_miss' WHEN eps IS NOT NULL AND rev IS NOT NULL AND abs(eps) < 3 AND abs(rev) < 3 AND abs(conviction) > 0.5 THEN 'consensus_in_line'
     WHEN eps IS NOT NULL AND rev IS NOT NULL AND (eps >= 5) <> (rev >= 5) AND abs(conviction) > 0.7 THEN 'consensus_mixed' END AS reason FROM su),
  cq AS (SELECT *, CASE reason WHEN 'consensus_miss' THEN 0.3e0 WHEN 'consensus_in_line' THEN 0.5e0 WHEN 'consensus_mixed' THEN 0.7e0 END AS cap FROM cp)"""


def _consensus(t):
    c = F.col
    rows = t.trades.selectExpr(*[f"{e} AS {k}" for k, e in CONSENSUS.items()])
    return rows.withColumn("eps", S.surprise_pct(c("eps_actual"), c("eps_estimate"))).withColumn(
        "rev", S.surprise_pct(c("revenue_actual"), c("revenue_estimate"))
    ).withColumn("cap", S.consensus_cap(c("eps"), c("rev"), c("conviction")))


@query(
    "m12_surprise", "trades",
    _CO + """ SELECT trade_id, round(eps, 6) AS eps, round(rev, 6) AS rev, CASE WHEN eps IS NULL THEN NULL WHEN eps >= 10 THEN 'STRONG BEAT' WHEN eps >= 3 THEN 'beat' WHEN eps > -3 THEN 'IN-LINE' WHEN eps > -10 THEN 'miss' ELSE 'BIG MISS' END AS verdict FROM su""",
)
def m12(t):
    return _consensus(t).select("trade_id", F.round("eps", 6).alias("eps"), F.round("rev", 6).alias("rev"), S.surprise_verdict(F.col("eps")).alias("verdict"))


@query(
    "m13_consensus_cap", "trades",
    _CO + " SELECT trade_id, cap, reason, CASE WHEN cap IS NULL THEN conviction ELSE sign(conviction) * least(abs(conviction), cap) END AS capped FROM cq",
)
def m13(t):
    return _consensus(t).select("trade_id", "cap.cap", "cap.reason", S.apply_cap(F.col("conviction"), F.col("cap.cap")).alias("capped"))


@query(
    "m14_documented_beat", "trades",
    _CO + " SELECT trade_id, coalesce(eps >= 5 AND rev >= 5, false) AS beat, eps IS NOT NULL AND rev IS NOT NULL AS full_data FROM su",
)
def m14(t):
    c = F.col
    return _consensus(t).select("trade_id", S.documented_beat(c("eps"), c("rev")).alias("beat"), S.full_consensus(c("eps"), c("rev")).alias("full_data"))


@query(
    "m15_shadow_verdict", "trades",
    _CO + """, sh AS (SELECT *, coalesce(eps < -30, false) AND (coalesce(sign(eps_actual) * sign(eps_estimate) < 0, false) OR coalesce(abs(eps_actual - eps_estimate) >= 0.1, false)) AS ext,
      coalesce(abs(eps_actual) > 50, false) OR coalesce(revenue_actual > 0 AND revenue_actual < 1000000, false) AS ano, greatest(CASE WHEN eps < 0 THEN -eps ELSE 0 END, CASE WHEN rev < 0 THEN -rev ELSE 0 END) AS sz FROM cq WHERE cap IS NOT NULL)
    SELECT trade_id, ext AS is_extreme_miss, conviction < 0 AS sign_gate_pass, ano AS anomaly_excluded, reason = 'consensus_miss' AND ext AND conviction < 0 AND NOT ano AS would_uncap,
    CASE WHEN reason <> 'consensus_miss' THEN cap WHEN ext AND conviction < 0 AND NOT ano THEN NULL WHEN sz BETWEEN 10 AND 30 THEN 0.5e0 ELSE 0.3e0 END AS proposed_cap FROM sh""",
)
def m15(t):
    c = F.col
    s = S.shadow_verdict(c("eps"), c("rev"), c("eps_actual"), c("eps_estimate"), c("revenue_actual"), c("conviction"), c("cap.cap"), c("cap.reason"))
    return _consensus(t).select("trade_id", s.alias("s")).filter("s IS NOT NULL").select("trade_id", "s.*")


@query(
    "m22_dispatch", "alerts",
    """r AS (SELECT id, symbol, sent_at, priority = 'CRITICAL' AS bypass, CASE WHEN id % 10 = 0 THEN 'observation' WHEN id % 11 = 0 THEN 'gpt_missing_data' WHEN catalyst_type = 'earnings' AND alert_direction IS NULL THEN 'consensus_miss'
      WHEN rule_name = '8-K Material Event GPT' AND alert_direction = 'positive' THEN 'bullish_8k_no_edge' WHEN id % 13 = 0 THEN 'direction_conflict' WHEN rule_name = 'Form 4 Insider BUY' AND alert_direction = 'negative' THEN 'sell_no_edge'
      WHEN id % 17 = 0 THEN 'csuite_sell_no_edge' WHEN id % 19 = 0 THEN 'cluster_sell_no_edge' WHEN id % 23 = 0 THEN 'silent_rule' END AS reason FROM alerts),
    g AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY symbol, CAST(sent_at AS DATE), reason IS NULL ORDER BY sent_at, id) END AS rn FROM r),
    f AS (SELECT id, symbol, coalesce(reason, CASE WHEN NOT bypass AND rn > 2 THEN 'daily_limit' END) AS reason FROM g)
    SELECT id, symbol, reason, reason IS NULL AS delivered, CASE WHEN reason IS NULL THEN 'ALERT_SENT_TELEGRAM' ELSE concat('ALERT_DB_ONLY_', upper(reason)) END AS action FROM f""",
)
def m22(t):
    c, no = F.col, F.lit(False)
    flag = lambda e: F.coalesce(F.expr(e), no)
    reason = S.suppression_reason(
        flag("id % 10 = 0"), flag("id % 11 = 0"),
        F.when((c("catalyst_type") == "earnings") & c("alert_direction").isNull(), "consensus_miss"),
        F.when((c("rule_name") == "8-K Material Event GPT") & (c("alert_direction") == "positive"), "bullish_8k_no_edge"),
        flag("id % 13 = 0"), flag("rule_name = 'Form 4 Insider BUY' AND alert_direction = 'negative'"),
        flag("id % 17 = 0"), flag("id % 19 = 0"), flag("id % 23 = 0"),
    )
    rows = t.alerts.select("id", "symbol", "sent_at", (c("priority") == "CRITICAL").alias("bypass"), reason.alias("reason"))
    return D.dispatch(rows, per_day=2).select("id", "symbol", "reason", "delivered", "action")


@query(
    "w7_delivery_gate", "alerts",
    """g AS (SELECT id, symbol, sent_at, priority = 'CRITICAL' AS bypass, row_number() OVER (PARTITION BY symbol, CAST(sent_at AS DATE) ORDER BY sent_at, id) AS rn FROM alerts)
    SELECT id, symbol, bypass OR rn <= 3 AS delivered FROM g""",
)
def w7(t):
    rows = t.alerts.select("id", "symbol", "sent_at", (F.col("priority") == "CRITICAL").alias("bypass"), F.lit(None).cast("string").alias("reason"))
    return D.dispatch(rows, per_day=3).select("id", "symbol", "delivered")


@query(
    "w5_call_cap", "alerts",
    "SELECT id, symbol, row_number() OVER (PARTITION BY symbol, CAST(sent_at AS DATE) ORDER BY sent_at, id) <= 4 AS allowed FROM alerts",
)
def w5(t):
    return D.call_cap(t.alerts.select("id", "symbol", "sent_at"), "symbol", "sent_at", "id", 4).select("id", "symbol", "allowed")


@query(
    "w8_registration_cap", "alerts",
    """n AS (SELECT id, sent_at, CAST((sent_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS ny_day FROM alerts)
    SELECT id, ny_day, row_number() OVER (PARTITION BY ny_day ORDER BY sent_at, id) <= 5 AS registered FROM n""",
)
def w8(t):
    return D.registration_cap(t.alerts.select("id", "sent_at"), "sent_at", "id").select("id", "ny_day", "registered")


@query(
    "w10_distinct_on", "alerts",
    "SELECT symbol, message, id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, message ORDER BY sent_at, id) AS rn FROM alerts) WHERE rn = 1",
)
def w10(t):
    return J.distinct_on(t.alerts, ["symbol", "message"], [F.col("sent_at"), F.col("id")]).select("symbol", "message", "id")


_THROTTLE = """a AS (SELECT id, rule_name, symbol, coalesce(catalyst_type, '') AS catalyst, epoch_us(sent_at) AS us, row_number() OVER (PARTITION BY rule_name, symbol, coalesce(catalyst_type, '') ORDER BY sent_at, id) AS i FROM alerts),
  f AS (SELECT *, us AS last_ok, true AS accepted FROM a WHERE i = 1 UNION ALL SELECT a.*, CASE WHEN a.us - f.last_ok >= {h} THEN a.us ELSE f.last_ok END, a.us - f.last_ok >= {h}
    FROM f JOIN a ON a.rule_name = f.rule_name AND a.symbol = f.symbol AND a.catalyst = f.catalyst AND a.i = f.i + 1)
  SELECT id, accepted FROM f"""


@query("q5_throttle", "alerts", _THROTTLE.format(h=2880 * 60_000_000), recursive=True)
def q5(t):
    return D.throttle(t.alerts.withColumnRenamed("catalyst_type", "catalyst"), 2880).select("id", "accepted")


_OPTIONS_THROTTLE = """a AS (SELECT id, rule_name, symbol, delivered, epoch_us(sent_at) AS us, row_number() OVER (PARTITION BY rule_name, symbol ORDER BY sent_at, id) AS i FROM alerts),
  f AS (SELECT *, CASE WHEN delivered THEN us END AS last_ok, true AS allowed FROM a WHERE i = 1
    UNION ALL SELECT a.*, CASE WHEN a.delivered AND (f.last_ok IS NULL OR a.us - f.last_ok >= {h}) THEN a.us ELSE f.last_ok END, f.last_ok IS NULL OR a.us - f.last_ok >= {h}
    FROM f JOIN a ON a.rule_name = f.rule_name AND a.symbol = f.symbol AND a.i = f.i + 1)
  SELECT id, allowed FROM f"""


@query("q5_options_throttle", "alerts", _OPTIONS_THROTTLE.format(h=4320 * 60_000_000), recursive=True)
def q5_options(t):
    return D.options_throttle(t.alerts, 4320).select("id", "allowed")


# --- discovery -------------------------------------------------------------------------------

_PRE = _ROLES + """, pi AS (SELECT accession, insider_name, CAST(sum(CAST(total_value AS DECIMAL(15,2))) AS DOUBLE) AS value, first(insider_role ORDER BY idx, trade_id) AS role, min((idx, trade_id)) AS fst,
    first(cs ORDER BY idx, trade_id) AS cs, first(di ORDER BY idx, trade_id) AS di FROM ro WHERE transaction_type = 'BUY' AND NOT coalesce(is_plan, false) GROUP BY 1, 2),
  be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY value DESC, fst) AS rn FROM pi WHERE cs OR di) WHERE rn = 1),
  pf AS (SELECT a.accession, CASE WHEN NOT EXISTS (SELECT 1 FROM pi WHERE pi.accession = a.accession) THEN 'no_discretionary_buy' WHEN be.accession IS NULL THEN 'no_exec_role_buy' WHEN be.value < 500000 THEN 'below_value_threshold' ELSE 'ok' END AS reason,
    coalesce(be.value, 0) AS buy_value, be.insider_name, be.role AS insider_role FROM (SELECT DISTINCT accession FROM trades) a LEFT JOIN be USING (accession))"""


@query("a29_discovery_prefilter", "trades", _PRE + " SELECT * FROM pf")
def a29(t):
    return D.discovery_prefilter(t.trades)


_SICS = ", ".join(f"'{c}'" for c in D.HEALTHCARE_SIC)
ISSUERS = {
    "cik": "lpad(CAST(c_custkey AS STRING), 10, '0')",
    "sic": "CASE c_custkey % 7 WHEN 0 THEN '2834 ' WHEN 1 THEN '8731' WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN '3841' ELSE '7372' END",
    "ticker": "CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 3 THEN NULL ELSE concat('S', c_custkey) END",
    "exchange": "CASE c_custkey % 5 WHEN 0 THEN 'OTC Markets' WHEN 1 THEN 'Nasdaq' WHEN 2 THEN 'NYSE' WHEN 3 THEN 'Pink Sheets' ELSE NULL END",
    "mcap": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal / 10 END",
    "avg_volume_mln": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey % 10) / 20e0 END",
    "price": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 1 + (c_custkey % 50) / 2e0 END",
}
_IS = "iss AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ISSUERS.items()) + " FROM customer)"
_OF = "ofl AS (SELECT concat('A', o_orderkey) AS accession, lpad(CAST(o_custkey AS STRING), 10, '0') AS cik, o_orderdate AS filed_at FROM orders)"


def _issuers(t):
    return t.raw("customer").selectExpr(*[f"{e} AS {c}" for c, e in ISSUERS.items()])


def _order_filings(t):
    return t.raw("orders").selectExpr("concat('A', o_orderkey) AS accession", "lpad(CAST(o_custkey AS STRING), 10, '0') AS cik", "o_orderdate AS filed_at")


_EL = f"""{_IS}, {_OF}, el AS (SELECT ofl.*, iss.* EXCLUDE (cik), coalesce(trim(sic) IN ({_SICS}), false) AS is_healthcare, coalesce(ticker IS NOT NULL AND NOT regexp_matches(exchange, '(?i)OTC|PINK'), false) AS is_listed FROM ofl LEFT JOIN iss USING (cik))"""


@query("j16_issuer_eligibility", "", _EL + " SELECT accession, cik, is_healthcare, is_listed FROM el")
def j16(t):
    return D.issuer_eligibility(_order_filings(t), _issuers(t)).select("accession", "cik", "is_healthcare", "is_listed")


_STAGE = _PRE + ", " + _EL + """, st AS (SELECT el.accession, filed_at, CASE WHEN length(trim(coalesce(sic, ''))) = 0 AND ticker IS NULL THEN 'retry_owner_row' WHEN NOT is_healthcare THEN 'rejected_sic' WHEN NOT is_listed THEN 'rejected_exchange'
     WHEN k.symbol IS NOT NULL THEN 'rejected_known' WHEN coalesce(reason, 'no_discretionary_buy') <> 'ok' THEN concat('rejected_', coalesce(reason, 'no_discretionary_buy')) WHEN mcap IS NULL THEN 'retry_mcap' WHEN mcap < 250 THEN 'rejected_mcap'
     WHEN avg_volume_mln IS NULL OR price IS NULL THEN 'retry_adv' WHEN avg_volume_mln * 1000000 * price < 1000000 THEN 'rejected_adv' ELSE 'candidate' END AS stage
   FROM el LEFT JOIN pf USING (accession) LEFT JOIN (SELECT symbol FROM tickers WHERE is_active) k ON k.symbol = el.ticker),
  rg AS (SELECT accession, CASE WHEN stage <> 'candidate' THEN stage WHEN row_number() OVER (PARTITION BY CAST((filed_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE), stage ORDER BY filed_at, accession) <= 1 THEN 'registered' ELSE 'deferred_daily_cap' END AS stage FROM st)"""


def _staged(t):
    rows = D.issuer_eligibility(_order_filings(t), _issuers(t)).join(D.discovery_prefilter(t.trades), "accession", "left")
    known = t.tickers.filter("is_active").select(F.col("symbol").alias("ticker"), F.lit(True).alias("is_known"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.lit("no_discretionary_buy"))).join(known, "ticker", "left")
    return D.discovery_stage(rows.withColumn("is_known", F.coalesce("is_known", F.lit(False))))


@query("m28_discovery_stage", "trades tickers", _STAGE + " SELECT accession, stage FROM rg")
def m28(t):
    return D.discovery_registrations(_staged(t), "filed_at", "accession", 1).select("accession", "stage")


@query("m28_discovery_funnel", "trades tickers", _STAGE + " SELECT stage, count(*) AS n FROM rg GROUP BY 1")
def m28b(t):
    return D.discovery_registrations(_staged(t), "filed_at", "accession", 1).groupBy("stage").agg(F.count("*").alias("n"))


_UNI = "uni AS (SELECT ticker AS symbol, trim(sic) AS sic, mcap > 300 AS filed FROM iss WHERE ticker IS NOT NULL), our AS (SELECT symbol FROM tickers UNION SELECT concat('S', user_id) FROM events)"
_SMALL = D.HEALTHCARE_SIC[:15]
_SMALL_SQL = ", ".join(f"'{c}'" for c in _SMALL)


def _universe(t):
    u = _issuers(t).filter("ticker IS NOT NULL").select(F.col("ticker").alias("symbol"), F.trim("sic").alias("sic"), (F.col("mcap") > 300).alias("filed"))
    ours = t.tickers.select("symbol").unionByName(t.raw("events").select(F.concat(F.lit("S"), "user_id").alias("symbol"))).distinct()
    return u, ours


@query(
    "a31_coverage_reasons", "tickers",
    f"""{_IS}, {_UNI} SELECT our.symbol, CASE WHEN uni.symbol IS NULL THEN 'missing_in_list' WHEN NOT coalesce(sic IN ({_SMALL_SQL}), false) THEN concat('SIC=', coalesce(sic, '?')) WHEN NOT coalesce(filed, false) THEN 'no_form4_in_quarter' ELSE 'ok' END AS reason FROM our LEFT JOIN uni USING (symbol)""",
)
def a31(t):
    u, ours = _universe(t)
    return D.coverage(u, ours, _SMALL)


@query(
    "a31_coverage_summary", "tickers",
    f"""{_IS}, {_UNI}, ac AS (SELECT DISTINCT symbol FROM uni WHERE sic IN ({_SMALL_SQL}) AND filed) SELECT count(*) AS universe, count(*) FILTER (symbol IN (SELECT symbol FROM our)) AS covered, round(count(*) FILTER (symbol IN (SELECT symbol FROM our)) * 100e0 / count(*), 1) AS coverage_pct FROM ac""",
)
def a31b(t):
    u, ours = _universe(t)
    return D.coverage_summary(u, ours, _SMALL)


@query("a31_healthcare_names", "", "SELECT doc_id, regexp_matches(lower(text), '" + "|".join(D.HEALTH_NAME_WORDS) + "') AS healthcare FROM documents")
def a31c(t):
    return t.raw("documents").select("doc_id", D.healthcare_name(F.col("text")).alias("healthcare"))


# --- joins and set operations between feeds --------------------------------------------------


@query(
    "a13_filing_groups", "trades",
    """g AS (SELECT accession, insider_name, transaction_type, is_plan, CAST(sum(CAST(total_value AS DECIMAL(15,2))) AS DOUBLE) AS total_value, sum(shares) AS shares, first(trade_id ORDER BY idx, trade_id) AS primary_trade, last(shares_after ORDER BY idx, trade_id) AS shares_after,
      first(price_per_share ORDER BY idx, trade_id) AS fp, count(*) AS n FROM trades GROUP BY 1, 2, 3, 4)
    SELECT * EXCLUDE (fp), CASE WHEN n > 1 AND shares > 0 THEN total_value / shares ELSE fp END AS price FROM g""",
)
def a13(t):
    return J.filing_groups(t.trades)


@query(
    "w11_group_members", "trades",
    "SELECT trade_id, first(trade_id) OVER (PARTITION BY accession, insider_name, transaction_type, is_plan ORDER BY idx, trade_id) AS primary_trade FROM trades",
)
def w11(t):
    return J.filing_group_members(t.trades)


@query("a16_plan_counts", "trades", "SELECT transaction_type, count(*) FILTER (is_plan) AS plan_rows, count(*) AS total FROM trades GROUP BY 1")
def a16(t):
    return J.plan_counts(t.trades)


# Audit look-ups: several per accession, in order; some fail or have no URL.
_FLAGS = "SELECT concat('A', o_orderkey) AS accession, CAST(o_custkey AS INT) AS pos, CASE o_orderpriority WHEN '1-URGENT' THEN 'plan' WHEN '2-HIGH' THEN 'discretionary' WHEN '3-MEDIUM' THEN 'fail' WHEN '5-LOW' THEN 'no_url' END AS flag, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE concat('doc', o_orderkey) END AS url FROM orders"


def _flags(t):
    t.raw("orders").createOrReplaceTempView("tidewatch_orders")
    return t.spark.sql(_FLAGS.replace("FROM orders", "FROM tidewatch_orders"))


_FLAGGED = f"""fl AS ({_FLAGS}), kn AS (SELECT accession, arg_min(flag, pos) AS flag, arg_min(url, pos) FILTER (url <> '') AS url FROM fl WHERE flag IS NOT NULL GROUP BY 1),
  fg AS (SELECT t.*, coalesce(flag, 'missing') AS flag, url FROM trades t LEFT JOIN kn USING (accession))"""


@query("j14_plan_flags", "trades", _FLAGGED + " SELECT trade_id, flag, url FROM fg")
def j14(t):
    return J.plan_flags(t.trades, _flags(t)).select("trade_id", "flag", "url")


@query(
    "a15_plan_audit", "trades",
    _FLAGGED + """ SELECT transaction_type, count(*) AS n, count(*) FILTER (flag = 'plan') AS n_plan, count(*) FILTER (flag = 'discretionary') AS n_discretionary, count(*) FILTER (flag IN ('fail', 'no_url', 'missing')) AS n_fail,
    round(count(*) FILTER (flag = 'plan') * 100e0 / count(*), 1) AS plan_pct, CAST(sum(CAST(total_value AS DECIMAL(15,2))) FILTER (flag = 'plan') AS DOUBLE) AS plan_value FROM fg GROUP BY 1""",
)
def a15(t):
    return J.plan_audit(J.plan_flags(t.trades, _flags(t)))


@query(
    "j4_trade_filing", "trades",
    """fi AS (SELECT concat('A', o_orderkey) AS accession, o_orderpriority AS form_type, o_orderstatus AS filing_status FROM orders WHERE o_orderstatus <> 'P')
    SELECT trade_id, form_type, filing_status FROM trades t LEFT JOIN fi ON fi.accession = regexp_replace(t.accession_number, '_\\d+$', '')""",
)
def j4(t):
    filings = t.raw("orders").filter("o_orderstatus <> 'P'").selectExpr(
        "concat('A', o_orderkey) AS accession", "o_orderpriority AS form_type", "o_orderstatus AS filing_status"
    )
    return J.trades_with_filing(t.trades, filings).select("trade_id", "form_type", "filing_status")


@query("j9_drop_known", "trades tickers", "SELECT trade_id, symbol FROM trades WHERE symbol NOT IN (SELECT symbol FROM tickers WHERE is_active)")
def j9(t):
    return J.drop_known(t.trades, t.tickers.filter("is_active"), ["symbol"]).select("trade_id", "symbol")


@query(
    "j10_rule_lookup", "alerts",
    """ru AS (SELECT rule_name, CAST(count(*) AS INT) AS throttle_minutes, max(price_at_alert) < 400 AS is_active FROM alerts GROUP BY 1)
    SELECT id, a.rule_name, ru.throttle_minutes, CASE WHEN ru.throttle_minutes IS NULL THEN 'SKIP_NO_RULE' ELSE 'FOUND' END AS lookup FROM alerts a LEFT JOIN (SELECT * FROM ru WHERE is_active) ru USING (rule_name)""",
)
def j10(t):
    rules = t.alerts.groupBy(F.col("rule_name").alias("name")).agg(
        F.count("*").cast("int").alias("throttle_minutes"), (F.max("price_at_alert") < 400).alias("is_active")
    )
    return J.rule_lookup(t.alerts, rules).select("id", "rule_name", "throttle_minutes", "lookup")


ESTIMATES = {
    "symbol": "concat('S', o_custkey)",
    "date": "CAST(o_orderdate AS DATE)",
    "eps_estimate": "CASE WHEN o_orderpriority = '5-LOW' THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice / 100000 END",
    "revenue_estimate": "CASE WHEN o_orderpriority = '1-URGENT' THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice END",
    "analysts": "CAST(o_orderkey AS INT)",
}
_EST = "est AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ESTIMATES.items()) + """ FROM orders),
  rep AS (SELECT concat('S', o_custkey) AS symbol, CAST(max(o_orderdate) AS DATE) - CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS period, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(avg(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / 100000 END AS other_estimate FROM orders GROUP BY o_custkey),
  ma AS (SELECT symbol, date AS period, min((date, analysts)) AS k FROM est GROUP BY 1, 2), fw AS (SELECT symbol, min((date, analysts)) AS k FROM est WHERE date >= DATE '2001-03-01' GROUP BY 1),
  pk AS (SELECT rep.*, coalesce(ma.k, fw.k) AS k, CASE WHEN ma.k IS NOT NULL THEN 'matched' WHEN fw.k IS NOT NULL THEN 'forward' END AS source FROM rep LEFT JOIN ma USING (symbol, period) LEFT JOIN fw ON fw.symbol = rep.symbol),
  j11 AS (SELECT pk.symbol, pk.period, pk.other_estimate, CASE WHEN isfinite(eps_estimate) THEN eps_estimate END AS eps_estimate, CASE WHEN isfinite(revenue_estimate) THEN revenue_estimate END AS revenue_estimate, est.analysts, source FROM pk LEFT JOIN est ON est.symbol = pk.symbol AND (est.date, est.analysts) = pk.k)"""


def _estimates(t):
    est = t.raw("orders").selectExpr(*[f"{e} AS {c}" for c, e in ESTIMATES.items()])
    o = t.raw("orders").groupBy("o_custkey").agg(
        F.to_date(F.max("o_orderdate")).alias("d"), F.avg(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("p")
    )
    reports = o.selectExpr(
        "concat('S', o_custkey) AS symbol", "d - CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS period",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE p / 100000 END AS other_estimate",
    )
    return J.select_estimates(reports, est, as_ts("2001-03-01 00:00:00"))


@query("j11_select_estimates", "", _EST + " SELECT symbol, period, eps_estimate, revenue_estimate, analysts, source FROM j11")
def j11(t):
    return _estimates(t).drop("other_estimate")


@query(
    "a27_replay_summary", "",
    _EST + """, df AS (SELECT *, abs(CASE WHEN other_estimate <> 0 THEN (eps_estimate - other_estimate) / abs(other_estimate) * 100 END) AS d FROM j11)
    SELECT count(*) AS total, count(*) FILTER (source = 'matched') AS matched, count(*) FILTER (source = 'forward') AS forward, count(*) FILTER (source IS NULL) AS missing, count(d) AS both_available, round(avg(d), 4) AS mean_abs_diff, round(max(d), 4) AS max_abs_diff FROM df""",
)
def a27(t):
    return J.replay_summary(_estimates(t))


@query(
    "j12_recent_history", "trades",
    """fil AS (SELECT symbol, transaction_date AS day, accession FROM trades GROUP BY 1, 2, 3), dys AS (SELECT DISTINCT symbol, day FROM fil),
    nw AS (SELECT d.symbol, d.day, t.trade_id, t.transaction_date, t.accession, row_number() OVER (PARTITION BY d.symbol, d.day ORDER BY t.transaction_date DESC, t.trade_id DESC) AS rn FROM dys d JOIN trades t ON t.symbol = d.symbol AND t.transaction_date > d.day - 30 AND t.transaction_date <= d.day)
    SELECT fil.symbol, fil.day, fil.accession, CAST(row_number() OVER (PARTITION BY fil.symbol, fil.day, fil.accession ORDER BY rn) - 1 AS INT) AS pos, trade_id AS history_trade_id, transaction_date AS history_date FROM fil JOIN nw ON nw.symbol = fil.symbol AND nw.day = fil.day AND nw.accession <> fil.accession WHERE rn <= 20""",
)
def j12(t):
    return J.recent_history(t.trades)


@query("u1_universe_overlap", "tickers", f"{_IS}, {_UNI} SELECT coalesce(our.symbol, u.symbol) AS symbol, CASE WHEN our.symbol IS NULL THEN 'only_theirs' WHEN u.symbol IS NULL THEN 'only_ours' ELSE 'both' END AS side FROM our FULL JOIN (SELECT DISTINCT symbol FROM uni) u ON u.symbol = our.symbol")
def u1(t):
    u, ours = _universe(t)
    return J.universe_overlap(ours, u)


@query("u1_overlap_summary", "tickers", f"""{_IS}, {_UNI}, x AS (SELECT count(*) FILTER (our.symbol IS NOT NULL AND u.symbol IS NOT NULL) AS "both", count(*) FILTER (u.symbol IS NULL) AS only_ours, count(*) FILTER (our.symbol IS NULL) AS only_theirs FROM our FULL JOIN (SELECT DISTINCT symbol FROM uni) u ON u.symbol = our.symbol)
    SELECT *, round("both" * 100e0 / ("both" + only_ours), 1) AS pct_of_ours, round("both" * 100e0 / ("both" + only_theirs), 1) AS pct_of_theirs FROM x""")
def u1b(t):
    u, ours = _universe(t)
    return J.overlap_summary(J.universe_overlap(ours, u))


@query("u2_new_symbols", "alerts tickers", "SELECT DISTINCT symbol FROM alerts WHERE symbol NOT IN (SELECT symbol FROM tickers)")
def u2(t):
    return J.new_symbols(t.alerts, t.tickers)


@query(
    "a32_observation_diff", "alerts",
    """st AS (SELECT * FROM alerts WHERE sent_at < TIMESTAMP '2024-01-03')
    SELECT max(id) AS max_id, count(*) AS rows, (SELECT max(id) FROM st) AS stored_max_id, (SELECT count(*) FROM (SELECT DISTINCT symbol FROM alerts WHERE symbol NOT IN (SELECT symbol FROM st))) AS new_symbols, max(id) > (SELECT max(id) FROM st) AS advanced FROM alerts""",
)
def a32(t):
    return J.observation_diff(t.alerts, t.alerts.filter(F.col("sent_at") < as_ts("2024-01-03 00:00:00")))


@query(
    "m29_log_meta", "system_logs",
    """SELECT id, CASE WHEN duration_ms > 50 THEN ticker ELSE coalesce(module, ticker) END AS ticker, trace_id, CASE decision_reason WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'NO_PATTERNS' WHEN 'click' THEN 'FETCH_TIMEOUT' ELSE decision_reason END AS decision_reason,
    CASE decision_reason WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' WHEN 'click' THEN 'warn' ELSE 'info' END AS level FROM system_logs""",
)
def m29(t):
    rows = t.system_logs.selectExpr(
        "id", "CASE WHEN duration_ms > 50 THEN ticker END AS result_symbol", "coalesce(module, ticker) AS payload_symbol",
        "CAST(NULL AS STRING) AS result_trace", "trace_id AS payload_trace",
        "CASE decision_reason WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'NO_PATTERNS' WHEN 'click' THEN 'FETCH_TIMEOUT' ELSE decision_reason END AS action",
    )
    return D.log_meta(rows)


# --- filings ---------------------------------------------------------------------------------

FILING_ANALYSIS = {
    "conviction": "(doc_id % 41 - 20) / 10e0",
    "gpt_direction": "CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'positive' ELSE 'neutral' END",
    "magnitude": "CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
    "confidence": "(doc_id % 10) / 10e0",
    "attention": "doc_id % 17 = 0",
    "catalyst_type": "CASE doc_id % 3 WHEN 0 THEN 'earnings' WHEN 1 THEN 'leadership' ELSE 'other' END",
    "eps_surprise": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 61 - 20) / 2e0 END",
    "revenue_surprise": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 47 - 10) / 2e0 END",
}
_GATE = """it AS (SELECT *, regexp_extract_all(text, '(?i)Item\\s+(\\d+\\.\\d+)', 1) AS raw_items FROM filings LEFT JOIN (SELECT symbol, observation_only FROM tickers) USING (symbol)),
  ga AS (SELECT *, list_filter(raw_items, lambda x: x <> '1.03')[1] AS main_item, list_contains(raw_items, '1.03') AS is_bankruptcy FROM it),
  gt AS (SELECT *, CASE WHEN form_type <> '8-K' THEN 'SKIP_NOT_8K' WHEN analyzed THEN 'SKIP_ALREADY_ANALYZED' WHEN coalesce(observation_only, false) THEN 'SKIP_OBSERVATION_TICKER' WHEN length(text) < 100 THEN 'SKIP_SHORT_TEXT' WHEN len(raw_items) = 0 THEN 'SKIP_NO_ITEMS' WHEN main_item IS NULL THEN 'BANKRUPTCY_ONLY' ELSE 'ANALYZE' END AS gate FROM ga)"""


@query("m21_filing_gates", "filings tickers", _GATE + " SELECT accession, main_item, is_bankruptcy, gate FROM gt")
def m21(t):
    return D.filing_gates(t.filings, t.tickers).select("accession", "main_item", "is_bankruptcy", "gate")


@query("m21_bankruptcy", "filings tickers", _GATE + " SELECT accession, symbol, '8-K Bankruptcy' AS rule_name, 'CRITICAL' AS priority, -1e0 AS conviction, 'negative' AS direction, true AS bypass_limit FROM gt WHERE is_bankruptcy AND gate IN ('ANALYZE', 'BANKRUPTCY_ONLY')")
def m21b(t):
    return D.bankruptcy_signals(D.filing_gates(t.filings, t.tickers))


def _rx(name):
    return X.GUIDANCE_PATTERNS[name].replace("'", "''")


def _n(name):
    return f"least(len(regexp_extract_all(text, '{_rx(name)}')), 3)"


_GUIDE = """gs AS (SELECT *, """ + ", ".join(f"{_n(k)} AS n_{k}" for k in X.GUIDANCE_PATTERNS) + " FROM SRC)"
_MISS = "(?i)niedost[eę]pn|brak\\s+(szczeg[oó][lł]owych|danych|liczbowych|konkretnych|informacji)|nie\\s+(podano|ujawniono|wiadomo|sprecyzowano)|\\bunknown\\b|\\binsufficient\\b|not\\s+(disclosed|available|specified|provided)|\\bnie\\s+wiemy\\b"


@query(
    "m21_decisions", "filings tickers",
    _GATE + ", fa AS (SELECT gt.* EXCLUDE (direction), " + ", ".join(f"{e} AS {c}" for c, e in FILING_ANALYSIS.items()) + " FROM gt WHERE gate = 'ANALYZE'), " + _GUIDE.replace("SRC", "fa") + f""",
    d1 AS (SELECT *, CASE WHEN (n_affirm > 0 OR n_affirm_adjusted > 0) AND n_withdraw = 0 AND NOT n_lower > n_lower_gaap AND conviction < -0.3 THEN -0.3e0 ELSE conviction END AS fl, len(list_filter(string_split(text, '. '), lambda x: regexp_matches(x, '{_MISS}'))) > 0 AS missing_data FROM gs),
    d2 AS (SELECT *, CASE WHEN (gpt_direction = 'negative' AND fl > 0) OR (gpt_direction = 'positive' AND fl < 0) THEN -fl ELSE fl END AS al FROM d1),
    d3 AS (SELECT *, CASE WHEN main_item <> '2.02' THEN NULL WHEN (coalesce(eps_surprise < 0, false) OR coalesce(revenue_surprise < 0, false)) AND abs(al) > 0.3 THEN 'consensus_miss' WHEN abs(eps_surprise) < 3 AND abs(revenue_surprise) < 3 AND abs(al) > 0.5 THEN 'consensus_in_line'
      WHEN eps_surprise IS NOT NULL AND revenue_surprise IS NOT NULL AND (eps_surprise >= 5) <> (revenue_surprise >= 5) AND abs(al) > 0.7 THEN 'consensus_mixed' END AS cap_reason FROM d2),
    d4 AS (SELECT *, CASE cap_reason WHEN 'consensus_miss' THEN sign(al) * least(abs(al), 0.3e0) WHEN 'consensus_in_line' THEN sign(al) * least(abs(al), 0.5e0) WHEN 'consensus_mixed' THEN sign(al) * least(abs(al), 0.7e0) ELSE al END AS cc FROM d3),
    d5 AS (SELECT *, CASE WHEN missing_data THEN greatest(least(cc, 0.3e0), -0.3e0) ELSE cc END AS fc FROM d4),
    d6 AS (SELECT *, CASE WHEN gpt_direction = 'neutral' THEN CASE WHEN fc >= 0 THEN 'positive' ELSE 'negative' END ELSE gpt_direction END AS ed FROM d5)
    SELECT accession, main_item, missing_data, cap_reason, round(fc, 9) AS final_conviction, ed AS effective_direction, CASE WHEN ed = 'positive' AND cap_reason IS NULL AND NOT missing_data THEN CASE WHEN main_item <> '2.02' THEN 'bullish_8k_no_edge' WHEN eps_surprise IS NULL OR revenue_surprise IS NULL THEN 'bullish_no_consensus_data' WHEN NOT (eps_surprise >= 5 AND revenue_surprise >= 5) THEN 'bullish_8k_no_edge' END END AS bullish_reason,
    CASE WHEN missing_data THEN 'MEDIUM' WHEN attention AND abs(fc) >= 0.4 THEN CASE WHEN magnitude = 'high' THEN 'CRITICAL' ELSE 'HIGH' END WHEN magnitude = 'high' AND confidence >= 0.7 THEN 'CRITICAL' WHEN magnitude = 'medium' AND confidence >= 0.6 THEN 'HIGH' WHEN magnitude = 'high' THEN 'HIGH' END AS priority FROM d6""",
)
def m21c(t):
    rows = D.filing_gates(t.filings, t.tickers).filter("gate = 'ANALYZE'").drop("direction")
    rows = rows.selectExpr("*", *[f"{e} AS {c}" for c, e in FILING_ANALYSIS.items()]).withColumnRenamed("gpt_direction", "direction")
    rows = rows.withColumn("guidance", X.guidance_status(F.col("text"))).withColumn("key_facts", F.split("text", r"\. "))
    return D.form8k_decisions(rows).select(
        "accession", "main_item", "missing_data", F.col("cap.reason").alias("cap_reason"), F.round("final_conviction", 9).alias("final_conviction"),
        "effective_direction", "bullish_reason", "priority",
    )
