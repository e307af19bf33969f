"""Registered queries: option screening, baselines, aggregation, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scoring as S
from tidewatch.functions.calendar import days_to_expiry
from tidewatch.operators import feeds, options as P
from tidewatch.operators.reports import as_ts, flow_stats
from tidewatch.plans.registry import query

_DERIVED = """o AS (SELECT *, CAST(ceil((epoch_us(CAST(expiry AS TIMESTAMP)) - epoch_us(CAST(session AS TIMESTAMP) + INTERVAL 20 HOUR)) / 86400000000e0) AS INT) AS dte, abs(strike - underlying) / underlying AS otm_distance,
   CASE WHEN option_type = 'call' THEN strike > underlying ELSE strike < underlying END AS is_otm FROM bars),
  scr AS (SELECT * FROM o WHERE dte > 0 AND dte <= 60 AND otm_distance <= 0.30 AND NOT (NOT is_otm AND otm_distance > 0.05))"""


def _now():
    return F.col("session").cast("timestamp_ntz") + F.expr("INTERVAL 20 HOUR")


@query("m5_days_to_expiry", "bars", _DERIVED + " SELECT occ, session, expiry, dte FROM o")
def m5(t):
    return t.bars.select("occ", "session", "expiry", days_to_expiry(F.col("expiry"), _now()).alias("dte"))


@query("m6_otm", "bars", _DERIVED + " SELECT occ, session, is_otm, otm_distance FROM o")
def m6(t):
    c = F.col
    return t.bars.select(
        "occ", "session", S.is_otm(c("option_type"), c("strike"), c("underlying")).alias("is_otm"),
        S.otm_distance(c("strike"), c("underlying")).alias("otm_distance"),
    )


@query("m7_contract_screen", "bars", _DERIVED + " SELECT occ, session, dte, is_otm, otm_distance FROM scr")
def m7(t):
    return P.screened_contracts(t.bars, _now()).select("occ", "session", "dte", "is_otm", "otm_distance")


@query(
    "p15_contract_cap", "bars",
    _DERIVED + " SELECT symbol, occ, session, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY occ, session) AS rn FROM scr) WHERE rn <= 50",
)
def p15(t):
    rows = P.screened_contracts(t.bars, _now()).withColumn("position", F.struct("occ", "session"))
    return feeds.contract_cap(rows, F.lit(True), "position", 50).select("symbol", "occ", "session", "volume")


_FOLD = """s AS (SELECT occ, session, volume, row_number() OVER (PARTITION BY occ ORDER BY session) AS i FROM bars WHERE volume > 0),
  f AS (SELECT occ, i, session, volume, 0e0 AS spike, CAST(NULL AS DOUBLE) AS avg_before, CAST(volume AS DOUBLE) AS avg_after, 1 AS points FROM s WHERE i = 1
   UNION ALL SELECT s.occ, s.i, s.session, s.volume, CASE WHEN f.points < 5 OR s.volume < 100 OR f.avg_after <= 0 THEN 0e0 ELSE s.volume / f.avg_after END, f.avg_after,
    (f.avg_after * least(f.points, 19) + CASE WHEN f.points >= 5 AND f.avg_after > 0 AND s.volume > 5 * f.avg_after THEN 5 * f.avg_after ELSE CAST(s.volume AS DOUBLE) END) / (least(f.points, 19) + 1), least(f.points + 1, 20)
   FROM f JOIN s ON s.occ = f.occ AND s.i = f.i + 1)"""


@query(
    "q1_volume_baseline", "bars",
    _FOLD + " SELECT occ, session, volume, spike, avg_before, avg_after, points, spike >= 3 AS is_unusual FROM f",
    recursive=True,
)
def q1(t):
    out = P.volume_baseline(t.bars)
    return out.select("occ", "session", "volume", "spike", "avg_before", "avg_after", "points", "is_unusual")


@query(
    "m8_spike_ratio", "bars",
    "SELECT occ, session, CASE WHEN volume < 100 OR strike <= 0 THEN 0e0 ELSE volume / strike END AS spike FROM bars",
)
def m8(t):
    return t.bars.select("occ", "session", S.spike_ratio(F.col("volume"), F.col("strike"), F.lit(5)).alias("spike"))


@query(
    "a33_cold_start", "bars",
    """r AS (SELECT *, row_number() OVER (PARTITION BY occ ORDER BY session DESC, volume DESC) AS rn FROM bars WHERE session > DATE '1998-06-01' - 900 AND session <= DATE '1998-06-01')
    SELECT occ, avg(volume) AS avg_volume, count(*) AS points, arg_max(volume, session) AS last_volume, max(session) AS last_session FROM r WHERE rn <= 20 GROUP BY 1""",
)
def a33(t):
    return P.cold_start(t.bars, as_ts("1998-06-01 00:00:00"), 900)


def _unusual(t):
    """Unusual sessions of screened contracts; a spike is measured against the contract's strike here."""
    rows = P.screened_contracts(t.bars, _now())
    return rows.withColumn("spike", S.spike_ratio(F.col("volume"), F.col("strike") / 10, F.lit(9))).filter("spike >= 3")


_UNUSUAL = _DERIVED + """, un AS (SELECT * FROM (SELECT *, CASE WHEN volume < 100 THEN 0e0 ELSE volume / (strike / 10) END AS spike FROM scr) WHERE spike >= 3),
  ag AS (SELECT symbol, session, CAST(sum(CASE WHEN option_type = 'call' THEN volume ELSE 0 END) AS BIGINT) AS call_volume, CAST(sum(CASE WHEN option_type = 'put' THEN volume ELSE 0 END) AS BIGINT) AS put_volume,
    first(occ ORDER BY spike DESC, occ) AS headline, first(spike ORDER BY spike DESC, occ) AS spike, first(volume ORDER BY spike DESC, occ) AS volume, first(otm_distance ORDER BY spike DESC, occ) AS otm, first(dte ORDER BY spike DESC, occ) AS dte, first(option_type ORDER BY spike DESC, occ) AS ot, count(*) AS contracts FROM un GROUP BY 1, 2),
  ar AS (SELECT *, CASE WHEN call_volume + put_volume > 0 THEN call_volume / (call_volume + put_volume) ELSE 0.5e0 END AS call_ratio FROM ag)"""
_BOOST = """, cd AS (SELECT DISTINCT symbol, event_date FROM catalysts)"""


@query("a14_ticker_flow", "bars", _UNUSUAL + " SELECT symbol, session, call_volume, put_volume, call_ratio, contracts, headline, spike AS headline_spike FROM ar")
def a14(t):
    out = P.ticker_flow(_unusual(t), ["symbol", "session"])
    return out.select("symbol", "session", "call_volume", "put_volume", "call_ratio", "contracts", F.col("h.occ").alias("headline"), F.col("h.spike").alias("headline_spike"))


@query(
    "j7_catalyst_boost", "bars catalysts",
    _UNUSUAL + _BOOST + """ SELECT occ, un.session, un.symbol, CASE WHEN cd.event_date <= un.session + 30 THEN cd.event_date END AS next_catalyst, coalesce(cd.event_date <= un.session + 30, false) AS boosted
    FROM un ASOF LEFT JOIN cd ON un.symbol = cd.symbol AND un.session + 1 <= cd.event_date""",
)
def j7(t):
    return P.catalyst_boost(_unusual(t), t.catalysts, "session").select("occ", "session", "symbol", "next_catalyst", "boosted")


def _score(ot, spike, volume, otm, dte, boosted, ratio=""):
    raw = f"0.35e0 * greatest(least({spike} / 10, 1e0), 0e0) + 0.20e0 * greatest(least(log10({volume} / 500e0), 1e0), 0e0) + 0.15e0 * greatest(least({otm} / 0.15e0, 1e0), 0e0) + 0.15e0 * greatest(least(1 - {dte} / 60e0, 1e0), 0e0)"
    sign, pen = f"CASE WHEN {ot} = 'call' THEN 1 ELSE -1 END", "1e0"
    if ratio:
        raw += f" + 0.15e0 * (abs({ratio} - 0.5e0) * 2)"
        sign = f"CASE WHEN {ratio} > 0.65e0 THEN 1 WHEN {ratio} < 0.35e0 THEN -1 ELSE {sign} END"
        pen = f"CASE WHEN {ratio} > 0.65e0 OR {ratio} < 0.35e0 THEN 1e0 ELSE 0.7e0 END"
    return f"greatest(least(({raw}) * ({sign}) * ({pen}) * CASE WHEN {spike} > 1000 THEN 0.5e0 ELSE 1e0 END * CASE WHEN {boosted} THEN 1.3e0 ELSE 1e0 END, 1e0), -1e0)"


_SCORED = _UNUSUAL + _BOOST + f""", b AS (SELECT un.*, coalesce(cd.event_date <= un.session + 30, false) AS boosted FROM un ASOF LEFT JOIN cd ON un.symbol = cd.symbol AND un.session + 1 <= cd.event_date),
  sf AS (SELECT *, {_score('option_type', 'spike', 'volume', 'otm_distance', 'dte', 'boosted')} AS conviction FROM b)"""


@query("m9_flow_score", "bars catalysts", _SCORED + " SELECT occ, session, boosted, round(conviction, 9) AS conviction FROM sf")
def m9(t):
    rows = P.scored_flows(P.catalyst_boost(_unusual(t), t.catalysts, "session"))
    return rows.select("occ", "session", "boosted", F.round("conviction", 9).alias("conviction"))


@query(
    "m9_ticker_score", "bars catalysts",
    _UNUSUAL + _BOOST + f""", b AS (SELECT ar.*, coalesce(cd.event_date <= ar.session + 30, false) AS boosted FROM ar ASOF LEFT JOIN cd ON ar.symbol = cd.symbol AND ar.session + 1 <= cd.event_date)
    SELECT symbol, session, CASE WHEN call_ratio > 0.65e0 THEN 'positive' WHEN call_ratio < 0.35e0 THEN 'negative' ELSE 'mixed' END AS direction, round({_score('ot', 'spike', 'volume', 'otm', 'dte', 'boosted', 'call_ratio')}, 9) AS conviction FROM b""",
)
def m9b(t):
    agg = P.ticker_flow(_unusual(t), ["symbol", "session"])
    rows = P.scored_tickers(P.catalyst_boost(agg, t.catalysts, "session"))
    return rows.select("symbol", "session", "direction", F.round("conviction", 9).alias("conviction"))


@query(
    "a4_flow_stats", "bars catalysts",
    _SCORED + " SELECT symbol, count(*) AS flows, round(avg(abs(conviction)), 4) AS avg_conviction, max(spike) AS max_spike, max(session) AS last_session FROM sf GROUP BY 1",
)
def a4(t):
    return flow_stats(P.scored_flows(P.catalyst_boost(_unusual(t), t.catalysts, "session")))


@query(
    "m24_flow_action", "bars catalysts tickers",
    _SCORED + """ SELECT occ, session, CASE WHEN abs(conviction) >= 0.5 AND boosted THEN CASE WHEN abs(conviction) >= 0.7 THEN 'ALERT_CRITICAL' ELSE 'ALERT_HIGH' END
      WHEN abs(conviction) >= 0.25 AND NOT coalesce(observation_only, false) THEN 'CORRELATION_STORED' WHEN abs(conviction) >= 0.25 THEN 'SKIP_OBSERVATION_TICKER' ELSE 'SKIP_LOW_CONVICTION' END AS action
    FROM sf LEFT JOIN (SELECT symbol, observation_only FROM tickers) USING (symbol)""",
)
def m24(t):
    rows = P.scored_flows(P.catalyst_boost(_unusual(t), t.catalysts, "session"))
    rows = rows.join(t.tickers.select("symbol", "observation_only"), "symbol", "left")
    action = P.flow_action(F.col("conviction"), F.col("boosted"), F.coalesce("observation_only", F.lit(False)))
    return rows.select("occ", "session", action.alias("action"))
