"""Registered queries: signal retention, patterns, pattern alerts and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import correlation as K, feeds
from tidewatch.plans.registry import query

# Signals visible at each evaluation (every signal time of a ticker), newest ``keep`` per class.
_WIN = """st AS (SELECT *, source_category = 'form4' AS ins, epoch_us(ts) AS us FROM signals WHERE abs(conviction) >= 0.05),
  evl AS (SELECT DISTINCT ticker, ts AS now, epoch_us(ts) AS now_us FROM signals),
  ranked AS (SELECT evl.ticker, evl.now, evl.now_us, st.id, st.source_category AS cat, st.conviction, abs(st.conviction) AS a, st.direction, st.catalyst_type, st.us, st.ins, row_number() OVER (PARTITION BY evl.ticker, evl.now, st.ins ORDER BY st.us DESC, st.id DESC) AS rn
    FROM evl JOIN st ON st.ticker = evl.ticker AND st.us <= evl.now_us AND st.us >= evl.now_us - CASE WHEN st.ins THEN 1209600000000 ELSE 432000000000 END),
  w AS (SELECT *, row_number() OVER (PARTITION BY ticker, now ORDER BY ins, us, id) AS pos, count(*) OVER (PARTITION BY ticker, now) AS tot FROM ranked WHERE rn <= {keep})"""
_W50 = _WIN.format(keep=50)
# Conviction and direction of sg(ticker, now, pos, cat, a, direction, id), one pattern candidate per (ticker, now).
_AGG = """n AS (SELECT ticker, now, count(*) AS n, count(*) FILTER (direction = 'positive') AS np, count(*) FILTER (direction = 'negative') AS nn, string_agg(id, ',' ORDER BY id) AS ids FROM sg GROUP BY 1, 2),
  dr AS (SELECT *, CASE WHEN np >= n * 0.66e0 THEN 'positive' WHEN nn >= n * 0.66e0 THEN 'negative' END AS dom FROM n),
  b AS (SELECT ticker, now, cat, max(a) AS mx, first(direction ORDER BY a DESC, pos) AS d, min(pos) AS fp, sum(a * CASE WHEN direction = 'positive' THEN 1 ELSE -1 END) AS net FROM sg GROUP BY 1, 2, 3),
  t AS (SELECT ticker, now, first(mx ORDER BY mx DESC, fp DESC) AS mx, first(d ORDER BY mx DESC, fp DESC) AS d, bool_or(net > 0 AND abs(net) >= 0.05) AND bool_or(net < 0 AND abs(net) >= 0.05) AS conflict FROM b GROUP BY 1, 2),
  cv AS (SELECT t.*, least(1e0, mx * (1 + 0.2e0 * ((SELECT count(*) FROM b WHERE b.ticker = t.ticker AND b.now = t.now AND b.d = t.d) - 1))) * CASE WHEN t.d = 'positive' THEN 1 ELSE -1 END AS conv FROM t)"""
_OUT = " SELECT ticker, now, '{name}' AS pattern, dom AS direction, round(conv, 9) AS conviction, conflict, ids FROM dr JOIN cv USING (ticker, now) WHERE dom IS NOT NULL"


def _evaluations(t):
    return t.signals.select("ticker", F.col("ts").alias("now"))


def _windows(t, keep=K.KEEP):
    return K.signal_windows(t.signals, _evaluations(t), keep)


def _found(t, name):
    out = K.detect_patterns(_windows(t), (name,))
    return out.select("ticker", "now", "pattern", "direction", F.round("conviction", 9).alias("conviction"), "conflict", F.array_join("ids", ",").alias("ids"))


@query(
    "c0_evaluation_windows", "signals",
    _W50 + """ SELECT evl.ticker, evl.now, CAST(count(id) FILTER (NOT ins) AS INT) AS n_short, CAST(count(id) FILTER (ins) AS INT) AS n_insider, CASE WHEN count(id) < 2 THEN 'TOO_FEW_SIGNALS' ELSE 'EVALUATE' END AS action
    FROM evl LEFT JOIN w ON w.ticker = evl.ticker AND w.now = evl.now GROUP BY 1, 2""",
)
def c0(t):
    return K.evaluation_summary(_windows(t))


@query(
    "q8_signal_retention", "signals",
    _WIN.format(keep=4) + """ SELECT evl.ticker, evl.now, CAST(count(id) FILTER (NOT ins) AS INT) AS n_short, CAST(count(id) FILTER (ins) AS INT) AS n_insider, CASE WHEN count(id) < 2 THEN 'TOO_FEW_SIGNALS' ELSE 'EVALUATE' END AS action
    FROM evl LEFT JOIN w ON w.ticker = evl.ticker AND w.now = evl.now GROUP BY 1, 2""",
)
def q8(t):
    return K.evaluation_summary(_windows(t, 4))


def _plus(cat, hours):
    us = hours * 3_600_000_000
    return f""", sg AS (SELECT *, 0 AS o FROM w WHERE tot >= 2 AND cat IN ('form4', '{cat}') AND us > now_us - {us} QUALIFY bool_or(cat = 'form4') OVER (PARTITION BY ticker, now) AND bool_or(cat = '{cat}') OVER (PARTITION BY ticker, now)),
      sg2 AS (SELECT 1)"""


def _plus_sql(name, cat, hours):
    # insiders come first in the pattern, so their positions precede the other class
    body = _plus(cat, hours).replace("SELECT *, 0 AS o FROM w", "SELECT * REPLACE (CASE WHEN ins THEN pos - 1000 ELSE pos END AS pos) FROM w")
    return _W50 + body + ", " + _AGG + _OUT.format(name=name)


@query("c1_insider_plus_8k", "signals", _plus_sql("INSIDER_PLUS_8K", "8k", 24))
def c1(t):
    return _found(t, "INSIDER_PLUS_8K")


@query("c6_insider_plus_options", "signals", _plus_sql("INSIDER_PLUS_OPTIONS", "options", 120))
def c6(t):
    return _found(t, "INSIDER_PLUS_OPTIONS")


@query(
    "c2_filing_confirms_news", "signals",
    _W50 + f""", x AS (SELECT * REPLACE (CASE WHEN cat = '8k' THEN pos + 1000 ELSE pos END AS pos) FROM w WHERE tot >= 2 AND cat IN ('news', 'social', '8k') AND us > now_us - 172800000000),
    ok AS (SELECT ticker, now FROM x GROUP BY 1, 2 HAVING min(us) FILTER (cat <> '8k') < min(us) FILTER (cat = '8k') AND (count(*) FILTER (cat <> '8k' AND catalyst_type <> 'unknown') = 0 OR count(*) FILTER (cat = '8k' AND catalyst_type <> 'unknown') = 0
      OR list_has_any(list(catalyst_type) FILTER (cat <> '8k' AND catalyst_type <> 'unknown'), list(catalyst_type) FILTER (cat = '8k' AND catalyst_type <> 'unknown')))),
    sg AS (SELECT x.* FROM x JOIN ok USING (ticker, now)), {_AGG}""" + _OUT.format(name="FILING_CONFIRMS_NEWS"),
)
def c2(t):
    return _found(t, "FILING_CONFIRMS_NEWS")


@query(
    "c3_multi_source", "signals",
    _W50 + f""", x AS (SELECT * FROM w WHERE tot >= 2 AND us > now_us - 86400000000),
    bst AS (SELECT *, min(pos) OVER (PARTITION BY ticker, now, cat) AS fpos FROM x QUALIFY row_number() OVER (PARTITION BY ticker, now, cat ORDER BY a DESC, pos) = 1),
    dm AS (SELECT ticker, now, CASE WHEN count(*) FILTER (direction = 'positive') >= count(*) * 0.66e0 THEN 'positive' WHEN count(*) FILTER (direction = 'negative') >= count(*) * 0.66e0 THEN 'negative' END AS dd FROM bst GROUP BY 1, 2 HAVING count(*) >= 3),
    sg AS (SELECT bst.* EXCLUDE (pos), fpos AS pos FROM bst JOIN dm USING (ticker, now) WHERE direction = dd QUALIFY count(*) OVER (PARTITION BY ticker, now) >= 3), {_AGG}""" + _OUT.format(name="MULTI_SOURCE_CONVERGENCE"),
)
def c3(t):
    return _found(t, "MULTI_SOURCE_CONVERGENCE")


@query(
    "c4_insider_cluster", "signals",
    _W50 + f""", x AS (SELECT * FROM w WHERE tot >= 2 AND ins AND us > now_us - 604800000000),
    dm AS (SELECT ticker, now FROM x GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (direction = 'negative') >= count(*) * 0.66e0 AND count(*) FILTER (direction = 'positive') < count(*) * 0.66e0),
    sg AS (SELECT x.* FROM x JOIN dm USING (ticker, now) WHERE direction = 'negative' QUALIFY count(*) OVER (PARTITION BY ticker, now) >= 2), {_AGG}""" + _OUT.format(name="INSIDER_CLUSTER"),
)
def c4(t):
    return _found(t, "INSIDER_CLUSTER")


@query(
    "c5_escalating_signal", "signals",
    _W50 + """, x AS (SELECT *, row_number() OVER (PARTITION BY ticker, now ORDER BY us DESC, id DESC) AS back FROM w WHERE tot >= 2 AND us > now_us - 259200000000),
    dm AS (SELECT ticker, now, CASE WHEN count(*) FILTER (direction = 'positive') >= count(*) * 0.66e0 THEN 'positive' WHEN count(*) FILTER (direction = 'negative') >= count(*) * 0.66e0 THEN 'negative' END AS dom FROM x GROUP BY 1, 2 HAVING count(*) >= 3),
    l AS (SELECT ticker, now, dom, max(a) FILTER (back = 1) AS a1, max(a) FILTER (back = 2) AS a2, max(a) FILTER (back = 3) AS a3, max(conviction) FILTER (back = 1) AS c, string_agg(id, ',' ORDER BY id) AS ids, bool_and(direction = dom) AS same,
      cat_conflict FROM (SELECT x.*, dom, false AS cat_conflict FROM x JOIN dm USING (ticker, now) WHERE back <= 3) GROUP BY 1, 2, 3, cat_conflict)
    SELECT ticker, now, 'ESCALATING_SIGNAL' AS pattern, dom AS direction, round(least(greatest(c * 1.3e0, -1e0), 1e0), 9) AS conviction, cat_conflict AS conflict, ids FROM l WHERE dom IS NOT NULL AND a1 > a2 AND a2 > a3 AND a1 >= 0.25 AND same""",
)
def c5(t):
    return _found(t, "ESCALATING_SIGNAL")


@query(
    "c7_dominant_direction", "signals",
    _W50 + """ SELECT ticker, now, CASE WHEN count(*) FILTER (direction = 'positive') >= count(*) * 0.66e0 THEN 'positive' WHEN count(*) FILTER (direction = 'negative') >= count(*) * 0.66e0 THEN 'negative' END AS direction FROM w GROUP BY 1, 2""",
)
def c7(t):
    rows = _windows(t).withColumn("all", F.concat("short", "insider")).filter(F.size("all") > 0)
    return rows.select("ticker", K.from_micros(F.col("now_us")).alias("now"), K.dominant_direction(F.col("all")).alias("direction"))


@query("c8_aggregate_conviction", "signals", _W50 + ", sg AS (SELECT * FROM w), " + _AGG + " SELECT ticker, now, round(conv, 9) AS conviction FROM cv")
def c8(t):
    rows = _windows(t).withColumn("all", F.concat("short", "insider")).filter(F.size("all") > 0)
    rows = K.with_conviction(rows, "all", "conviction")
    return rows.select("ticker", K.from_micros(F.col("now_us")).alias("now"), F.round("conviction", 9).alias("conviction"))


@query("c9_direction_conflict", "signals", _W50 + ", sg AS (SELECT * FROM w), " + _AGG + " SELECT ticker, now, conflict FROM cv")
def c9(t):
    rows = _windows(t).withColumn("all", F.concat("short", "insider")).filter(F.size("all") > 0)
    return rows.select("ticker", K.from_micros(F.col("now_us")).alias("now"), K.direction_conflict(F.col("all")).alias("conflict"))


@query(
    "w9_strongest_per_category", "signals",
    _W50 + " SELECT ticker, now, string_agg(id, ',' ORDER BY fp) AS ids FROM (SELECT ticker, now, cat, first(id ORDER BY a DESC, pos) AS id, min(pos) AS fp FROM w GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def w9(t):
    rows = _windows(t).withColumn("all", F.concat("short", "insider")).filter(F.size("all") > 0)
    ids = F.transform(K.strongest_per_category(F.col("all")), lambda s: s["id"])
    return rows.select("ticker", K.from_micros(F.col("now_us")).alias("now"), F.array_join(ids, ",").alias("ids"))


# The three live patterns in one table for the alert chain.
_LIVE = _W50 + ", pats AS (" + " UNION ALL ".join(
    f"SELECT * FROM ({'WITH ' + body})"
    for body in (
        _plus_sql("INSIDER_PLUS_8K", "8k", 24)[len(_W50) + 2 :],
        (f"""x AS (SELECT * FROM w WHERE tot >= 2 AND ins AND us > now_us - 604800000000),
    dm AS (SELECT ticker, now FROM x GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (direction = 'negative') >= count(*) * 0.66e0 AND count(*) FILTER (direction = 'positive') < count(*) * 0.66e0),
    sg AS (SELECT x.* FROM x JOIN dm USING (ticker, now) WHERE direction = 'negative' QUALIFY count(*) OVER (PARTITION BY ticker, now) >= 2), {_AGG}""" + _OUT.format(name="INSIDER_CLUSTER")),
        _plus_sql("INSIDER_PLUS_OPTIONS", "options", 120)[len(_W50) + 2 :],
    )
) + """), al AS (SELECT p.*, epoch_us(now) AS us, CASE WHEN observation_only THEN 'observation' WHEN conflict THEN 'direction_conflict' WHEN pattern = 'INSIDER_CLUSTER' THEN 'cluster_sell_no_edge' END AS reason,
   CASE WHEN conflict THEN 'HIGH' WHEN abs(conviction) >= 0.6 THEN 'CRITICAL' ELSE 'HIGH' END AS priority, abs(conviction) < 0.2 AS low FROM pats p LEFT JOIN (SELECT symbol AS ticker, observation_only FROM tickers) USING (ticker))"""


def _alerts(t):
    return K.pattern_alerts(K.detect_patterns(_windows(t)), t.tickers)


@query("c10_pattern_alerts", "signals tickers", _LIVE + " SELECT ticker, now, pattern, priority, reason, low AS low_conviction FROM al")
def c10(t):
    return _alerts(t).select("ticker", "now", "pattern", "priority", "reason", "low_conviction")


_CLAIM = _LIVE + """, r AS (SELECT ticker, pattern, us, CASE WHEN reason IS NULL THEN CASE pattern WHEN 'INSIDER_CLUSTER' THEN 86400 ELSE 259200 END ELSE 900 END * CAST(1000000 AS BIGINT) AS hold, reason, row_number() OVER (PARTITION BY ticker, pattern ORDER BY us) AS i FROM al WHERE NOT low),
  f AS (SELECT *, us + hold AS free_at, true AS ok FROM r WHERE i = 1 UNION ALL SELECT r.*, CASE WHEN r.us >= f.free_at THEN r.us + r.hold ELSE f.free_at END, r.us >= f.free_at FROM f JOIN r ON r.ticker = f.ticker AND r.pattern = f.pattern AND r.i = f.i + 1)
  SELECT ticker, pattern, us AS now_us, CASE WHEN NOT ok THEN 'DEDUP_SKIP' WHEN reason IS NULL THEN 'ALERT_SENT_TELEGRAM' ELSE concat('ALERT_DB_ONLY_', upper(reason)) END AS action FROM f
  UNION ALL SELECT ticker, pattern, us, 'SKIP_LOW_CONVICTION' FROM al WHERE low"""


@query("q6_pattern_claims", "signals tickers", _CLAIM, recursive=True)
def q6(t):
    return K.claim_patterns(_alerts(t)).select("ticker", "pattern", "now_us", "action")


_HASH = _LIVE + """, hs AS (SELECT ticker, us, left(sha256(concat('[', string_agg(concat('{"type":"', pattern, '","signalIds":["', replace(ids, ',', '","'), '"]}'), ',' ORDER BY pattern), ']')), 16) AS hash FROM al GROUP BY 1, 2)"""


@query(
    "q7_unchanged_patterns", "signals tickers",
    _HASH + """, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY us) AS i FROM hs),
    f AS (SELECT *, us AS last_us, hash AS last_hash, false AS skipped FROM r WHERE i = 1 UNION ALL SELECT r.*, CASE WHEN r.hash = f.last_hash AND r.us - f.last_us <= 172800000000 THEN f.last_us ELSE r.us END, CASE WHEN r.hash = f.last_hash AND r.us - f.last_us <= 172800000000 THEN f.last_hash ELSE r.hash END,
      r.hash = f.last_hash AND r.us - f.last_us <= 172800000000 FROM f JOIN r ON r.ticker = f.ticker AND r.i = f.i + 1)
    SELECT ticker, us AS now_us, hash, skipped FROM f""",
    recursive=True,
)
def q7(t):
    return K.skip_unchanged(K.pattern_hash(K.detect_patterns(_windows(t))), 172_800_000_000)


@query(
    "st4_debounced_evaluations", "signals",
    """r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY us) AS i FROM (SELECT DISTINCT ticker, epoch_us(ts) AS us FROM signals)),
    f AS (SELECT *, us AS armed, true AS ok FROM r WHERE i = 1 UNION ALL SELECT r.*, CASE WHEN r.us - f.armed >= 43200000000 THEN r.us ELSE f.armed END, r.us - f.armed >= 43200000000 FROM f JOIN r ON r.ticker = f.ticker AND r.i = f.i + 1)
    SELECT ticker, make_timestamp(us + 43200000000) AS now FROM f WHERE ok""",
    recursive=True,
)
def st4(t):
    return K.debounced_evaluations(t.signals, 43_200)


@query(
    "u3_signal_union", "signals catalysts",
    """SELECT ticker, source_category, conviction, direction FROM signals UNION ALL SELECT symbol, '8k', -0.5e0, 'negative' FROM catalysts WHERE outcome IS NOT NULL""",
)
def u3(t):
    plain = t.catalysts.filter("outcome IS NOT NULL").select(
        F.col("symbol").alias("ticker"), F.lit("8k").alias("source_category"), F.lit(-0.5).alias("conviction"), F.lit("negative").alias("direction")
    )
    return feeds.union_signals([t.signals.select("ticker", "source_category", "conviction", "direction"), plain])
