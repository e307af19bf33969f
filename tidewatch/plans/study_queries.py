"""Registered queries: event selection, baselines, hypothesis statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import stats as X
from tidewatch.operators import study as E
from tidewatch.plans.market_queries import _FWD
from tidewatch.plans.registry import query
from tidewatch.plans.tables import daily_closes
from tidewatch.session import cut_lineage

H = ("1d", "3d", "7d", "30d")
# Returns for any (symbol, date) of the filing dates in trades.
_RT = _FWD + """, rt AS (SELECT d.symbol, d.date, CASE WHEN c1 > 0 THEN (c1 - close) / close * 100 END AS r1, CASE WHEN c3 > 0 THEN (c3 - close) / close * 100 END AS r3,
    CASE WHEN c5 > 0 THEN (c5 - close) / close * 100 END AS r5, CASE WHEN c21 > 0 THEN (c21 - close) / close * 100 END AS r21
    FROM (SELECT DISTINCT symbol, filing_date AS date FROM trades) d ASOF JOIN fp ON d.symbol = fp.symbol AND d.date <= fp.date WHERE close > 0)"""
_DEDUP = """dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, insider_name, weekofyear(filing_date), isoyear(filing_date), transaction_type
    ORDER BY total_value DESC, trade_id) AS rn FROM trades) WHERE rn = 1)"""


def _baseline(name: str, prices: str, samples: int, seed: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT symbol, close, idx, n, c1, c3, c5, c21, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws('|', symbol, CAST(idx AS VARCHAR), '{seed}'))) AS rk,
      greatest(1, floor({samples} * 1e0 / (SELECT count(*) FROM (SELECT symbol FROM {prices} GROUP BY 1 HAVING count(*) > 30)))) AS share
      FROM (SELECT symbol, close, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5, lead(close, 21) OVER w AS c21
        FROM {prices} WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE n > 30 AND n - 22 >= 1 AND idx < n - 22) WHERE rk <= least(share, n - 22) AND close > 0)"""


def _dip(name: str, prices: str, seed: int = 45) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws('|', symbol, CAST(idx AS VARCHAR), '{seed}'))) AS rk
      FROM (SELECT symbol, close, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS dr,
        lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5, lead(close, 21) OVER w AS c21 FROM {prices} WINDOW w AS (PARTITION BY symbol ORDER BY date))
      WHERE n >= 30 AND dr <= -2 AND idx + 21 < n) WHERE rk <= 50 AND close > 0)"""


def _unpivot(source: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{h}' AS horizon, (c{k} - close) / close * 100 AS ret FROM {source} WHERE c{k} IS NOT NULL"
        for h, k in zip(H, (1, 3, 5, 21))
    )


def _long(events: str, groups: list[tuple[str, str, str, str]]) -> str:
    """ev(sub_group, direction, baseline, horizon, ret) over rows with r1, r3, r5, r21."""
    parts = []
    for g, cond, d, b in groups:
        for h, k in zip(H, (1, 3, 5, 21)):
            parts.append(
                f"SELECT '{g}' AS sub_group, '{d}' AS direction, '{b}' AS baseline, '{h}' AS horizon, r{k} AS ret FROM {events} WHERE ({cond}) AND r{k} IS NOT NULL"
            )
    return " UNION ALL ".join(parts)


_STATS = """hit AS (SELECT *, CASE direction WHEN 'sell' THEN ret < 0 WHEN 'buy' THEN ret > 0 ELSE abs(ret) > 1 END AS is_hit FROM ev),
  em AS (SELECT sub_group, direction, baseline, horizon, count(*) AS n, avg(ret) AS m, median(ret) AS med, var_samp(ret) AS v, stddev_pop(ret) AS sd, avg(CASE WHEN is_hit THEN 1e0 ELSE 0e0 END) AS hr,
    quantile_cont(ret, 0.01) AS q0, quantile_cont(ret, 0.99) AS q1 FROM hit GROUP BY ALL),
  ew AS (SELECT sub_group, direction, baseline, horizon, avg(c) AS wm, var_samp(c) AS wv FROM (SELECT ev.*, CASE WHEN n < 10 THEN ret ELSE greatest(least(ret, q1), q0) END AS c FROM ev JOIN em USING (sub_group, direction, baseline, horizon)) GROUP BY ALL),
  bm AS (SELECT baseline, horizon, count(*) AS bn, avg(ret) AS bmean, var_samp(ret) AS bv, avg(CASE WHEN ret < 0 THEN 1e0 ELSE 0e0 END) AS bs, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS bb, avg(CASE WHEN abs(ret) > 1 THEN 1e0 ELSE 0e0 END) AS ba,
    quantile_cont(ret, 0.01) AS q0, quantile_cont(ret, 0.99) AS q1 FROM bl GROUP BY ALL),
  bw AS (SELECT baseline, horizon, avg(c) AS bwm, var_samp(c) AS bwv FROM (SELECT bl.*, CASE WHEN bn < 10 THEN ret ELSE greatest(least(ret, q1), q0) END AS c FROM bl JOIN bm USING (baseline, horizon)) GROUP BY ALL)
  SELECT sub_group, direction, baseline, horizon, n, n < 3 AS insufficient_data,
    CASE WHEN n >= 3 THEN round(m, 3) END AS avg_return_pct, CASE WHEN n >= 3 THEN round(med, 3) END AS median_return_pct, CASE WHEN n >= 3 THEN round(sd, 3) END AS std_pct,
    CASE WHEN n >= 3 THEN round(hr * 100, 1) END AS hit_rate_pct, CASE WHEN n >= 3 THEN round(bmean, 3) END AS baseline_avg_pct,
    CASE WHEN n >= 3 THEN round(coalesce(CASE direction WHEN 'sell' THEN bs WHEN 'buy' THEN bb ELSE ba END * 100, 50e0), 1) END AS baseline_hit_rate_pct,
    CASE WHEN n >= 4 AND bn >= 10 AND ((n - 1) * wv + (bn - 1) * bwv) > 0 THEN round((wm - bwm) / sqrt(((n - 1) * wv + (bn - 1) * bwv) / (n + bn - 2)), 3) END AS effect_size_d,
    CASE WHEN n > 3 AND bn > 10 AND v / n + bv / bn > 0 THEN round((m - bmean) / sqrt(v / n + bv / bn), 4) END AS t_stat
  FROM em JOIN ew USING (sub_group, direction, baseline, horizon) LEFT JOIN bm USING (baseline, horizon) LEFT JOIN bw USING (baseline, horizon)"""


def _p_sql(t: str, df: str, points: int = 4000) -> str:
    """Two-sided p of Student's t by Simpson's rule: with t = sqrt(df) * tan(x) the density is cos(x) ** (df - 1) up to a constant."""

    def area(lo: str, hi: str) -> str:
        weight = f"CASE WHEN i = 0 OR i = {points} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
        return f"(({hi}) - ({lo})) * list_sum(list_transform(range({points + 1}), lambda i: ({weight}) * pow(cos(({lo}) + i * (({hi}) - ({lo})) / {points}), {df} - 1)))"

    at, reach = f"atan(abs({t}) / sqrt({df}))", f"14 / sqrt({df})"
    tail, whole = area(at, f"least(pi() / 2, {at} + {reach})"), area("0e0", f"least(pi() / 2, {reach})")
    return f"CASE WHEN {t} IS NOT NULL AND {df} > 0 THEN {tail} / ({whole}) END"


def _df_sql(v1: str, n1: str, v2: str, n2: str) -> str:
    a, b = f"({v1}) / ({n1})", f"({v2}) / ({n2})"
    return f"({a} + {b}) * ({a} + {b}) / ({a} * {a} / ({n1} - 1) + {b} * {b} / ({n2} - 1))"


# _STATS with p values and their corrections: rows of st.
_STATS_P = _STATS.replace("SELECT sub_group, direction, baseline, horizon, n, n < 3", ", st0 AS (SELECT sub_group, direction, baseline, horizon, n, n < 3", 1) \
    .replace(" AS t_stat\n", f" AS t_stat,\n    CASE WHEN n > 3 AND bn > 10 AND v / n + bv / bn > 0 THEN (m - bmean) / sqrt(v / n + bv / bn) END AS t, CASE WHEN v / n + bv / bn > 0 THEN {_df_sql('v', 'n', 'bv', 'bn')} END AS df\n") \
    + f"""), st1 AS (SELECT * EXCLUDE (t, df), {_p_sql('t', 'df')} AS p FROM st0),
  st AS (SELECT * EXCLUDE (p), round(p, 4) AS p_value, coalesce(p < 0.05, false) AS significant_005, coalesce(p < 0.01, false) AS significant_001 FROM st1),
  bf AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN count(p_value) OVER () END AS n_tests FROM st),
  full_stats AS (SELECT *, round(0.05e0 / n_tests, 6) AS threshold_005, p_value < 0.05e0 / n_tests AS significant_bonferroni, p_value < 0.01e0 / n_tests AS significant_bonferroni_strict FROM bf)"""


def _stats_sql(selection: str, groups, baselines: str = "") -> str:
    """Oracle of a hypothesis: ``selection`` defines sel (trade rows) joined to returns."""
    bl = baselines or _unpivot("rb", "'random' AS baseline, symbol")
    return f"""{_RT}, {_DEDUP}, sc AS (SELECT * FROM dd WHERE is_healthcare),
      hp AS (SELECT * FROM prices WHERE symbol IN (SELECT symbol FROM sc)), cp AS (SELECT * FROM prices WHERE symbol NOT IN (SELECT symbol FROM sc)),
      {_baseline('rb', 'hp', 5000, 43)}, {_baseline('ra', 'prices', 10000, 42)}, {_baseline('rc', 'cp', 5000, 44)}, {_dip('db', 'hp')},
      bl AS ({bl}), {selection}, sel AS (SELECT e.*, r1, r3, r5, r21 FROM pick e JOIN rt ON e.symbol = rt.symbol AND e.filing_date = rt.date),
      ev AS ({_long('sel', groups)}), {_STATS}"""


def _once(t, name, make):
    if name not in t.__dict__:
        t.__dict__[name] = make()
    return t.__dict__[name]


def _flags(t):
    return _once(t, "hc_flags", lambda: E.healthcare_flags(t.trades))


def _scope(t):
    """Trades of all types of the symbols a query on healthcare rows can read."""
    return _once(t, "hc_scope", lambda: E.healthcare_scope(t.trades, _flags(t)))


def _clean(t, types: str, where: str, *more, of=None):
    """Deduplicated trades of the types as far as a query reads them."""
    return E.study_trades(t.trades if of is None else of, types.split(), F.expr(where), (*E.STUDY_COLUMNS, *more))


def _scope_prices(t):
    return _once(t, "scope_prices", lambda: cut_lineage(daily_closes(_scope(t))))


def _hc_prices(t):
    return _once(t, "hc_prices", lambda: E.prices_of(_scope_prices(t), E.healthcare_symbols(_scope(t), _flags(t))))


def _random(t):
    return E.random_baseline(_hc_prices(t), 5000, 43, "random")


def _returns(t, trades=None, prices=None):
    """Returns of the filing days of ``trades``, else of all; exercises are no events."""
    rows = t.trades if trades is None else trades
    return E.stored_returns(rows.filter("transaction_type IN ('BUY', 'SELL')"), t.stored_prices if prices is None else prices)


def _buys(t, where: str = "NOT is_plan", of=None):
    """Buys outside a plan and the returns of their days, stored because clusters and lone buys both meet them; prices are read once and are not."""
    trades = t.trades if of is None else of
    buys = _clean(t, "BUY", where, "insider_name", of=trades)
    return buys, cut_lineage(_returns(t, buys, daily_closes(trades)).drop("entry_price"))


def _finish(rows, baselines):
    return E.horizon_stats(rows, baselines, with_p=False)


@query("w2_insider_week_dedup", "trades", _DEDUP + " SELECT trade_id, symbol, insider_name, transaction_type, total_value FROM dd")
def w2(t):
    return E.insider_week_dedup(t.trades).select("trade_id", "symbol", "insider_name", "transaction_type", "total_value")


_B1 = _baseline("rb", "prices", 5000, 42)


@query(
    "b1_random_baseline", "prices",
    f"{_B1}, bl AS ({_unpivot('rb', 'symbol')}) SELECT symbol, horizon, count(*) AS n, round(avg(ret), 4) AS mean_ret, round(min(ret), 6) AS min_ret, round(max(ret), 4) AS max_ret FROM bl GROUP BY 1, 2",
)
def b1(t):
    return E.random_baseline(t.prices).groupBy("symbol", "horizon").agg(
        F.count("*").alias("n"), F.round(F.avg("ret"), 4).alias("mean_ret"),
        F.round(F.min("ret"), 6).alias("min_ret"), F.round(F.max("ret"), 4).alias("max_ret"),
    )


@query(
    "b2_dip_baseline", "prices",
    f"{_dip('db', 'prices')}, bl AS ({_unpivot('db', 'symbol')}) SELECT symbol, horizon, count(*) AS n, round(avg(ret), 4) AS mean_ret FROM bl GROUP BY 1, 2",
)
def b2(t):
    return E.dip_baseline(t.prices).groupBy("symbol", "horizon").agg(
        F.count("*").alias("n"), F.round(F.avg("ret"), 4).alias("mean_ret")
    )


# --- ordered folds: rows are walked one by one in the oracle ---------------------------------


def _walk(source: str, pair_jumps: bool) -> str:
    """Recursive walk over rows numbered per symbol; ``wn``/``nd`` describe the window of a row's date."""
    move = "CASE WHEN nd >= 2 THEN i + wn ELSE i + 1 END" if pair_jumps else "i + wn"
    return f"""{source}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY filing_date, trade_id) AS i FROM b),
      dd0 AS (SELECT DISTINCT symbol, filing_date AS d FROM b),
      win AS (SELECT dd0.symbol, d, count(*) AS wn, count(DISTINCT insider_name) AS nd, max(filing_date) AS last_d, count(*) FILTER (transaction_type = 'BUY') AS buys, count(*) FILTER (transaction_type = 'SELL') AS sells,
        bool_or(is_csuite) AS cs FROM dd0 JOIN b ON b.symbol = dd0.symbol AND b.filing_date BETWEEN d AND d + 7 GROUP BY 1, 2),
      x AS (SELECT r.symbol, i, wn, nd, d, last_d, buys, sells, cs FROM r JOIN win ON r.symbol = win.symbol AND r.filing_date = win.d),
      walk AS (SELECT symbol, CAST(1 AS BIGINT) AS i FROM x WHERE i = 1 UNION ALL SELECT x.symbol, {move} FROM walk JOIN x USING (symbol, i)),
      hit AS (SELECT x.* FROM walk JOIN x USING (symbol, i))"""


_DISC = "b AS (SELECT * FROM trades WHERE is_plan = false AND transaction_type IN ('BUY', 'SELL'))"
_BUYS = "b AS (SELECT * FROM trades WHERE is_plan = false AND transaction_type = 'BUY')"


@query(
    "q2_cluster_events", "trades",
    _walk(_DISC, True) + " SELECT symbol, last_d AS event_date, CASE WHEN buys >= sells THEN 'BUY' ELSE 'SELL' END AS dominant_type, wn AS n_rows, nd AS n_insiders, cs AS is_csuite FROM hit WHERE nd >= 2",
    recursive=True,
)
def q2(t):
    ev = E.cluster_events(E.discretionary(t.trades, "BUY", "SELL"))
    return ev.select("symbol", "event_date", "dominant_type", "n_rows", "n_insiders", "is_csuite")


@query(
    "q3_single_buys", "trades",
    _walk(_BUYS, False) + " SELECT symbol, d AS event_date, wn AS n_rows, cs AS is_csuite FROM hit WHERE nd < 2",
    recursive=True,
)
def q3(t):
    return E.single_buy_events(E.discretionary(t.trades, "BUY")).select("symbol", "event_date", "n_rows", "is_csuite")


_Q4 = _BUYS + """, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY filing_date, trade_id) AS i FROM b),
  win AS (SELECT a.symbol, a.i, count(*) AS wn, count(DISTINCT z.insider_name) AS nd, min(z.filing_date) FILTER (z.insider_name <> a.insider_name) AS second_date, bool_or(z.is_csuite) AS cs,
    CAST(sum(CAST(z.total_value AS DECIMAL(18,2))) AS DOUBLE) AS val FROM r a JOIN r z ON a.symbol = z.symbol AND z.i >= a.i AND z.filing_date <= a.filing_date + 7 GROUP BY 1, 2),
  walk AS (SELECT symbol, CAST(1 AS BIGINT) AS i FROM win WHERE i = 1 UNION ALL SELECT win.symbol, CASE WHEN nd >= 2 THEN i + wn ELSE i + 1 END FROM walk JOIN win USING (symbol, i)),
  cl AS (SELECT win.* FROM walk JOIN win USING (symbol, i) WHERE nd >= 2)"""


@query(
    "q4_cluster_buys", "trades",
    _Q4 + " SELECT symbol, second_date AS event_date, wn AS n_rows, nd AS n_insiders, cs AS is_csuite, val AS total_value FROM cl",
    recursive=True,
)
def q4(t):
    ev = E.cluster_buy_events(E.discretionary(t.trades, "BUY"))
    return ev.select("symbol", "event_date", "n_rows", "n_insiders", "is_csuite", "total_value")


@query(
    "j8_lone_buys", "trades",
    """b AS (SELECT * FROM trades WHERE is_plan = false AND transaction_type = 'BUY')
    SELECT trade_id, symbol, filing_date, insider_name FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.symbol = b.symbol AND o.insider_name <> b.insider_name AND o.filing_date BETWEEN b.filing_date - 7 AND b.filing_date + 7)""",
)
def j8(t):
    return E.lone_buys(E.discretionary(t.trades, "BUY")).select("trade_id", "symbol", "filing_date", "insider_name")


@query(
    "q4_price_coverage", "trades prices",
    f"""{_RT}, {_Q4}
    SELECT count(*) AS n_events, count(*) FILTER (ok) AS n_priced, count(*) FILTER (NOT ok) AS n_dropped
    FROM (SELECT EXISTS (SELECT 1 FROM rt WHERE rt.symbol = cl.symbol AND rt.date = cl.second_date AND coalesce(r1, r3, r5, r21) IS NOT NULL) AS ok FROM cl)""",
    recursive=True,
)
def q4_coverage(t):
    clusters = E.cluster_buy_events(E.discretionary(t.trades, "BUY")).withColumn("filing_date", F.col("event_date"))
    return E.price_coverage(clusters, _returns(t))


# --- statistics ------------------------------------------------------------------------------


@query(
    "a22_winsorize", "trades",
    """r AS (SELECT trade_id, symbol, total_value AS ret FROM trades), q AS (SELECT symbol, count(*) AS n, quantile_cont(ret, 0.01) AS q0, quantile_cont(ret, 0.99) AS q1 FROM r GROUP BY 1)
    SELECT trade_id, symbol, ret, round(CASE WHEN n < 10 THEN ret ELSE greatest(least(ret, q1), q0) END, 6) AS clipped FROM r JOIN q USING (symbol)""",
)
def a22(t):
    rows = t.trades.select("trade_id", "symbol", F.col("total_value").alias("ret"))
    return E.winsorize(rows, ["symbol"]).withColumn("clipped", F.round("clipped", 6))


@query(
    "a24_welch_t", "trades",
    """m AS (SELECT symbol, count(*) FILTER (transaction_type = 'BUY') AS n1, avg(total_value) FILTER (transaction_type = 'BUY') AS m1, var_samp(total_value) FILTER (transaction_type = 'BUY') AS v1,
      count(*) FILTER (transaction_type = 'SELL') AS n2, avg(total_value) FILTER (transaction_type = 'SELL') AS m2, var_samp(total_value) FILTER (transaction_type = 'SELL') AS v2 FROM trades GROUP BY 1)
    SELECT symbol, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_stat,
    round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 4) AS df FROM m""",
)
def a24(t):
    return _welch(t).drop("p_value")


@query(
    "a24_welch_p", "trades",
    """m AS (SELECT symbol, count(*) FILTER (transaction_type = 'BUY') AS n1, avg(total_value) FILTER (transaction_type = 'BUY') AS m1, var_samp(total_value) FILTER (transaction_type = 'BUY') AS v1,
      count(*) FILTER (transaction_type = 'SELL') AS n2, avg(total_value) FILTER (transaction_type = 'SELL') AS m2, var_samp(total_value) FILTER (transaction_type = 'SELL') AS v2 FROM trades GROUP BY 1),
    w AS (SELECT symbol, n1, n2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, """ + _df_sql("v1", "n1", "v2", "n2") + """ AS df FROM m)
    SELECT symbol, n1, n2, round(t, 6) AS t_stat, round(df, 4) AS df, round(""" + _p_sql("t", "df") + """, 9) AS p_value FROM w""",
)
def a24p(t):
    return _welch(t).withColumn("p_value", F.round("p_value", 9))


def _welch(t):
    side = lambda kind: F.when(F.col("transaction_type") == kind, F.col("total_value"))
    m = t.trades.groupBy("symbol").agg(
        *[f(side(k)).alias(f"{a}{i}") for i, k in ((1, "BUY"), (2, "SELL")) for a, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    c = F.col
    m = m.withColumn("t", X.welch_t(c("m1"), c("v1"), c("n1"), c("m2"), c("v2"), c("n2"))).withColumn(
        "f", X.welch_df(c("v1"), c("n1"), c("v2"), c("n2"))
    )
    return m.select("symbol", "n1", "n2", F.round("t", 6).alias("t_stat"), F.round("f", 4).alias("df"), X.two_sided_p(c("t"), c("f")).alias("p_value"))


_H1_SEL = _walk("b AS (SELECT * FROM sc WHERE is_plan = false AND transaction_type IN ('BUY', 'SELL'))", True).replace("hit AS", "chit AS") + \
    ", pick AS (SELECT symbol, last_d AS filing_date, CASE WHEN buys >= sells THEN 'BUY' ELSE 'SELL' END AS dominant_type, cs AS is_csuite FROM chit WHERE nd >= 2)"


@query(
    "h1_insider_clusters", "trades prices",
    _stats_sql(_H1_SEL, [
        ("all", "true", "any", "random"), ("sell_clusters", "dominant_type = 'SELL'", "sell", "random"), ("buy_clusters", "dominant_type = 'BUY'", "buy", "random"),
        ("csuite_clusters", "is_csuite", "any", "random"), ("healthcare_only", "true", "any", "random"),
    ]),
    recursive=True,
)
def h1(t):
    trades = _clean(t, "BUY SELL", "is_healthcare AND NOT is_plan", "insider_name", of=_scope(t))
    return _finish(E.h1_rows(trades, _returns(t, trades, _scope_prices(t))), _random(t))


_THRESH = ((100000, "100k"), (500000, "500k"), (1000000, "1000k"))


@query(
    "h2_csuite_trades", "trades prices",
    _stats_sql(
        "pick AS (SELECT * FROM sc WHERE is_csuite AND is_plan = false AND transaction_type IN ('BUY', 'SELL'))",
        [("all", "true", "any", "random"), ("all_sells", "transaction_type = 'SELL'", "sell", "random"), ("all_buys", "transaction_type = 'BUY'", "buy", "random")]
        + [(f"sells_above_{n}", f"transaction_type = 'SELL' AND total_value >= {v}", "sell", "random") for v, n in _THRESH]
        + [(f"buys_above_{n}", f"transaction_type = 'BUY' AND total_value >= {v}", "buy", "random") for v, n in _THRESH],
    ),
)
def h2(t):
    trades = _clean(t, "BUY SELL", "is_healthcare AND is_csuite AND NOT is_plan", of=_scope(t))
    return _finish(E.h2_rows(trades, _returns(t, trades, _scope_prices(t))), _random(t))


@query(
    "h3_plan_sells", "trades prices",
    _stats_sql(
        "pick AS (SELECT * FROM sc WHERE transaction_type = 'SELL')",
        [("plan", "is_plan = true", "sell", "random"), ("discretionary", "is_plan = false", "sell", "random")],
    ),
)
def h3(t):
    sells = _clean(t, "SELL", "is_healthcare", of=_scope(t))
    return _finish(E.h3_rows(sells, _returns(t, sells, _scope_prices(t))), _random(t))


@query(
    "h4_role_seniority", "trades prices",
    _stats_sql(
        "pick AS (SELECT * FROM sc WHERE transaction_type = 'SELL' AND is_plan = false)",
        [("csuite", "is_csuite", "sell", "random"), ("director", "NOT is_csuite AND is_director", "sell", "random"), ("other", "NOT is_csuite AND NOT is_director", "sell", "random")],
    ),
)
def h4(t):
    sells = _clean(t, "SELL", "is_healthcare AND NOT is_plan", of=_scope(t))
    return _finish(E.h4_rows(sells, _returns(t, sells, _scope_prices(t))), _random(t))


@query(
    "h5_buy_signals", "trades prices",
    _stats_sql(
        "pick AS (SELECT * FROM sc WHERE transaction_type = 'BUY' AND is_plan = false)",
        [
            ("all", "true", "buy", "random"), ("csuite_buys", "is_csuite", "buy", "random"), ("director_buys", "NOT is_csuite", "buy", "random"), ("healthcare_buys", "is_healthcare", "buy", "random"),
            ("buys_above_100k", "total_value >= 100000", "buy", "random"), ("buys_above_500k", "total_value >= 500000", "buy", "random"),
            ("vs_dip_all", "true", "buy", "dip"), ("vs_dip_csuite", "is_csuite", "buy", "dip"),
        ],
        _unpivot("rb", "'random' AS baseline, symbol") + " UNION ALL " + _unpivot("db", "'dip' AS baseline, symbol"),
    ),
)
def h5(t):
    buys = _clean(t, "BUY", "is_healthcare AND NOT is_plan", of=_scope(t))
    return _finish(E.h5_rows(buys, _returns(t, buys, _scope_prices(t))), _random(t).unionByName(E.dip_baseline(_hc_prices(t))))


@query(
    "h6_sector_vs_control", "trades prices",
    _stats_sql(
        "pick AS (SELECT * FROM dd WHERE transaction_type = 'SELL' AND is_plan = false AND is_csuite)",
        [
            ("healthcare_vs_common", "is_healthcare", "sell", "random_all"), ("control_vs_common", "NOT is_healthcare", "sell", "random_all"),
            ("healthcare", "is_healthcare", "sell", "random"), ("control_group", "NOT is_healthcare", "sell", "random_control"),
        ],
        " UNION ALL ".join(_unpivot(s, f"'{n}' AS baseline, symbol") for s, n in (("rb", "random"), ("ra", "random_all"), ("rc", "random_control"))),
    ),
)
def h6(t):
    sells, hc = _clean(t, "SELL", "is_csuite AND NOT is_plan"), E.healthcare_symbols(t.trades)
    in_scope, control = E.prices_of(t.stored_prices, hc), t.stored_prices.join(hc, "symbol", "left_anti")
    baselines = (
        E.random_baseline(in_scope, 5000, 43, "random").unionByName(E.random_baseline(t.stored_prices, 10_000, 42, "random_all"))
        .unionByName(E.random_baseline(control, 5000, 44, "random_control"))
    )
    return _finish(E.h6_rows(sells, _returns(t, sells), "random_all", "random", "random_control"), baselines)


_DIRECT = """em AS (SELECT sub_group, horizon, count(*) AS n, avg(ret) AS m, median(ret) AS med, var_samp(ret) AS v, quantile_cont(ret, 0.01) AS q0, quantile_cont(ret, 0.99) AS q1 FROM ev GROUP BY ALL),
  ew AS (SELECT sub_group, horizon, avg(c) AS wm, var_samp(c) AS wv FROM (SELECT ev.*, CASE WHEN n < 10 THEN ret ELSE greatest(least(ret, q1), q0) END AS c FROM ev JOIN em USING (sub_group, horizon)) GROUP BY ALL),
  s AS (SELECT * FROM em JOIN ew USING (sub_group, horizon)), lft AS (SELECT * FROM s WHERE sub_group = '{left}'), rgt AS (SELECT * FROM s WHERE sub_group = '{right}'),
  j AS (SELECT coalesce(lft.horizon, rgt.horizon) AS horizon, coalesce(lft.n, 0) AS n1, coalesce(rgt.n, 0) AS n2, lft.m AS m1, rgt.m AS m2, lft.med AS d1, rgt.med AS d2, lft.v AS v1, rgt.v AS v2, lft.wm AS w1, rgt.wm AS w2, lft.wv AS x1, rgt.wv AS x2 FROM lft FULL JOIN rgt ON lft.horizon = rgt.horizon)
  SELECT '{left}_vs_{right}' AS comparison, horizon, n1 AS n_left, n2 AS n_right, NOT (n1 >= {k} AND n2 >= {k}) AS insufficient_data,
   CASE WHEN n1 >= {k} AND n2 >= {k} THEN round(m1, 3) END AS mean_left, CASE WHEN n1 >= {k} AND n2 >= {k} THEN round(m2, 3) END AS mean_right,
   CASE WHEN n1 >= {k} AND n2 >= {k} THEN round(d1, 3) END AS median_left, CASE WHEN n1 >= {k} AND n2 >= {k} THEN round(d2, 3) END AS median_right,
   CASE WHEN n1 >= {k} AND n2 >= {k} THEN round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) END AS t_stat,
   CASE WHEN n1 >= greatest(4, {k}) AND n2 >= 10 THEN round((w1 - w2) / sqrt(((n1 - 1) * x1 + (n2 - 1) * x2) / (n1 + n2 - 2)), 3) END AS d_winsor,
   CASE WHEN n1 >= {k} AND n2 >= {k} THEN round((m1 - m2) / sqrt((v1 + v2) / 2), 3) END AS d_raw FROM j"""


@query(
    "h6_direct", "trades prices",
    f"""{_RT}, {_DEDUP}, pick AS (SELECT * FROM dd WHERE transaction_type = 'SELL' AND is_plan = false AND is_csuite),
    sel AS (SELECT e.*, r1, r3, r5, r21 FROM pick e JOIN rt ON e.symbol = rt.symbol AND e.filing_date = rt.date),
    ev AS ({_long('sel', [('healthcare', 'is_healthcare', 'sell', ''), ('control', 'NOT is_healthcare', 'sell', '')])}), {_DIRECT.format(left='healthcare', right='control', k=4)}""",
)
def h6d(t):
    hc = F.col("is_healthcare")
    sells = _clean(t, "SELL", "is_csuite AND NOT is_plan")
    events = E.with_returns(sells, _returns(t, sells))
    rows = E.group_rows(events, [("healthcare", hc, "sell", ""), ("control", ~hc, "sell", "")])
    return E.direct_compare(rows, "healthcare", "control", 4, with_p=False)


@query(
    "a25_cluster_vs_single", "trades prices",
    f"""{_RT}, {_walk(_DISC, True)}, ce AS (SELECT symbol, last_d AS filing_date FROM hit WHERE nd >= 2 AND buys >= sells),
    {_walk(_BUYS, False).replace('b AS (', 'b2 AS (', 1).replace('FROM b)', 'FROM b2)').replace('FROM b ', 'FROM b2 ').replace('JOIN b ON b.symbol', 'JOIN b2 b ON b.symbol').replace('r AS (', 'rr2 AS (').replace('dd0', 'dd2').replace('win AS', 'win2 AS').replace('JOIN win ON', 'JOIN win2 win ON').replace('x AS (', 'x2 AS (').replace('FROM r JOIN', 'FROM rr2 r JOIN').replace('walk AS', 'walk2 AS').replace('FROM x WHERE', 'FROM x2 WHERE').replace('SELECT x.symbol, i + wn FROM walk JOIN x USING', 'SELECT x2.symbol, i + wn FROM walk2 JOIN x2 USING').replace('hit AS (SELECT x.* FROM walk JOIN x USING', 'hit2 AS (SELECT x2.* FROM walk2 JOIN x2 USING')},
    se AS (SELECT symbol, d AS filing_date FROM hit2 WHERE nd < 2),
    pick AS (SELECT 'cluster' AS g, * FROM ce UNION ALL SELECT 'single', * FROM se),
    sel AS (SELECT e.*, r1, r3, r5, r21 FROM pick e JOIN rt ON e.symbol = rt.symbol AND e.filing_date = rt.date),
    ev AS ({_long('sel', [('cluster', "g = 'cluster'", 'buy', ''), ('single', "g = 'single'", 'buy', '')])}), {_DIRECT.format(left='cluster', right='single', k=3)}""",
    recursive=True,
)
def a25(t):
    return E.direct_compare(E.h1_direct_rows(t.trades, _returns(t)), "cluster", "single", 3, with_p=False)


def _h7_sql(cond: str) -> str:
    src = f"b AS (SELECT * FROM dd WHERE is_plan = false AND transaction_type = 'BUY' AND {cond})"
    return f"""{_RT}, {_DEDUP}, {_Q4.replace(_BUYS, src)}, lone AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.symbol = b.symbol AND o.insider_name <> b.insider_name AND o.filing_date BETWEEN b.filing_date - 7 AND b.filing_date + 7)),
    pick AS (SELECT 'cluster' AS g, symbol, second_date AS filing_date FROM cl UNION ALL SELECT 'single', symbol, filing_date FROM lone),
    sel AS (SELECT e.*, r1, r3, r5, r21 FROM pick e JOIN rt ON e.symbol = rt.symbol AND e.filing_date = rt.date),
    ev AS ({_long('sel', [('cluster', "g = 'cluster'", 'buy', 'random'), ('single', "g = 'single'", 'buy', 'random')])}), {_DIRECT.format(left='cluster', right='single', k=3)}"""


@query("h7_cluster_buy_healthcare", "trades prices", _h7_sql("is_healthcare"), recursive=True)
def h7(t):
    return E.direct_compare(E.h7_rows(*_buys(t, "is_healthcare AND NOT is_plan", _scope(t)), True), "cluster", "single", 3, with_p=False)


@query("h7_cluster_buy_full", "trades prices", _h7_sql("true"), recursive=True)
def h7b(t):
    return E.direct_compare(E.h7_rows(*_buys(t), False), "cluster", "single", 3, with_p=False)


# p and verdict of _DIRECT at seven days
_VERDICT = _DIRECT.replace("  SELECT '{left}_vs_{right}'", "  , dc AS (SELECT '{left}_vs_{right}'", 1).replace(" AS d_raw FROM j", " AS d_raw, CASE WHEN n1 >= {k} AND n2 >= {k} THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t, " + _df_sql("v1", "n1", "v2", "n2") + " AS df FROM j)") + f""",
  dp AS (SELECT * EXCLUDE (t, df), round({_p_sql('t', 'df')}, 6) AS p_value FROM dc WHERE horizon = '7d')
  SELECT *, CASE WHEN n_left < 15 THEN 'INSUFFICIENT_N' WHEN p_value < 0.05e0 / 7 AND d_winsor >= 0.3e0 THEN 'PASS' ELSE 'FAIL' END AS verdict, '{{scope}}' AS scope FROM dp"""


def _m27_sql() -> str:
    """Both scopes, each with its own clusters."""
    parts = []
    for scope, cond in (("healthcare", "is_healthcare"), ("full_universe", "true")):
        body = _h7_sql(cond).replace(_DIRECT.format(left="cluster", right="single", k=3), _VERDICT.format(left="cluster", right="single", k=3, scope=scope))
        parts.append(f"SELECT * FROM (WITH RECURSIVE {body})")
    return " UNION ALL ".join(parts)


@query("m27_cluster_verdict", "trades prices", _m27_sql())
def m27(t):
    parts = []
    buys, returns = _buys(t)
    for scope, only in (("healthcare", True), ("full_universe", False)):
        cmp = E.direct_compare(E.h7_rows(buys, returns, only), "cluster", "single", 3)
        parts.append(E.h7_verdict(cmp).withColumn("scope", F.lit(scope)))
    return parts[0].unionByName(parts[1])


def _tiered(t):
    tier = F.when(F.col("shares") >= 25, "strict").otherwise("stretch")
    return _clean(t, "BUY", "NOT is_plan", "shares").withColumn("tier", tier)


def _h8(t, with_p):
    trades = _tiered(t)
    events = E.h8_events(trades, _returns(t, trades))
    return E.horizon_stats(E.h8_rows(events), E.random_baseline(t.stored_prices, 10_000, 42, "random"), with_p, own=(events, "random"))


def _h8_groups():
    return [
        ("all", "true", "buy", "random"), ("csuite", "is_csuite", "buy", "random"), ("strict", "shares >= 25", "buy", "random"), ("stretch", "shares < 25", "buy", "random"),
    ] + [(f"buys_above_{n}", f"total_value >= {v}", "buy", "random") for v, n in _THRESH]


_H8_LONG = _long("sel", _h8_groups()) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT concat('ticker_', symbol) AS sub_group, 'buy' AS direction, 'random' AS baseline, '{h}' AS horizon, r{k} AS ret FROM sel WHERE r{k} IS NOT NULL AND symbol IN (SELECT symbol FROM sel WHERE coalesce(r1, r3, r5, r21) IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)"
    for h, k in zip(H, (1, 3, 5, 21))
)


@query(
    "h8_tiered_replication", "trades prices",
    f"""{_RT}, {_DEDUP}, {_baseline('rb', 'prices', 10000, 42)}, bl AS ({_unpivot('rb', "'random' AS baseline, symbol")}),
    pick AS (SELECT * FROM dd WHERE transaction_type = 'BUY' AND is_plan = false),
    sel AS (SELECT e.*, r1, r3, r5, r21 FROM pick e JOIN rt ON e.symbol = rt.symbol AND e.filing_date = rt.date), ev AS ({_H8_LONG}), {_STATS}""",
)
def h8(t):
    return _h8(t, False)


@query(
    "h8_tier_gate", "trades prices",
    f"""{_RT}, {_DEDUP}, {_baseline('rb', 'prices', 10000, 42)}, bl AS ({_unpivot('rb', "'random' AS baseline, symbol")}),
    pick AS (SELECT * FROM dd WHERE transaction_type = 'BUY' AND is_plan = false),
    sel AS (SELECT e.*, r1, r3, r5, r21 FROM pick e JOIN rt ON e.symbol = rt.symbol AND e.filing_date = rt.date), ev AS ({_H8_LONG}), {_STATS_P}
    SELECT *, CASE WHEN effect_size_d IS NULL OR p_value IS NULL THEN 'INDETERMINATE' WHEN effect_size_d >= 0.5e0 AND p_value < 0.01 THEN 'GO' WHEN effect_size_d >= 0.2e0 THEN 'CONSERVATIVE' ELSE 'DROP' END AS decision
    FROM full_stats WHERE sub_group IN ('all', 'csuite') AND horizon = '7d'""",
)
def h8g(t):
    return E.tier_gate(E.bonferroni(_h8(t, True)))


def _full_run_sql() -> str:
    """All hypotheses: their events side by side, each group under the name of its hypothesis."""
    value = lambda kind, word: [(f"{word}_above_{n}", f"transaction_type = '{kind}' AND total_value >= {v}", word[:-1], "random") for v, n in _THRESH]
    sells, buys = "SELECT * FROM sc WHERE transaction_type = 'SELL'", "SELECT * FROM sc WHERE transaction_type = 'BUY' AND is_plan = false"
    runs = {
        "H1": (None, [
            ("all", "true", "any", "random"), ("sell_clusters", "dominant_type = 'SELL'", "sell", "random"), ("buy_clusters", "dominant_type = 'BUY'", "buy", "random"),
            ("csuite_clusters", "is_csuite", "any", "random"), ("healthcare_only", "true", "any", "random"),
        ]),
        "H2": ("SELECT * FROM sc WHERE is_csuite AND is_plan = false AND transaction_type IN ('BUY', 'SELL')", [
            ("all", "true", "any", "random"), ("all_sells", "transaction_type = 'SELL'", "sell", "random"), ("all_buys", "transaction_type = 'BUY'", "buy", "random"), *value("SELL", "sells"), *value("BUY", "buys"),
        ]),
        "H3": (sells, [("plan", "is_plan = true", "sell", "random"), ("discretionary", "is_plan = false", "sell", "random")]),
        "H4": (sells + " AND is_plan = false", [
            ("csuite", "is_csuite", "sell", "random"), ("director", "NOT is_csuite AND is_director", "sell", "random"), ("other", "NOT is_csuite AND NOT is_director", "sell", "random"),
        ]),
        "H5": (buys, [
            ("all", "true", "buy", "random"), ("csuite_buys", "is_csuite", "buy", "random"), ("director_buys", "NOT is_csuite", "buy", "random"), ("healthcare_buys", "is_healthcare", "buy", "random"),
            ("buys_above_100k", "total_value >= 100000", "buy", "random"), ("buys_above_500k", "total_value >= 500000", "buy", "random"), ("vs_dip_all", "true", "buy", "dip"), ("vs_dip_csuite", "is_csuite", "buy", "dip"),
        ]),
        "H6": ("SELECT * FROM dd WHERE transaction_type = 'SELL' AND is_plan = false AND is_csuite", [
            ("healthcare_vs_common", "is_healthcare", "sell", "random_all"), ("control_vs_common", "NOT is_healthcare", "sell", "random_all"),
            ("healthcare", "is_healthcare", "sell", "random"), ("control_group", "NOT is_healthcare", "sell", "random_control"),
        ]),
    }
    picks, longs = [_H1_SEL], []
    for name, (rows, groups) in runs.items():
        picks.append(f"sel{name} AS (SELECT e.*, r1, r3, r5, r21 FROM {'pick' if rows is None else f'({rows})'} e JOIN rt ON e.symbol = rt.symbol AND e.filing_date = rt.date)")
        longs.append(_long(f"sel{name}", [(f"{name}/{g}", cond, d, b) for g, cond, d, b in groups]))
    baselines = " UNION ALL ".join(_unpivot(source, f"'{n}' AS baseline, symbol") for source, n in (("rb", "random"), ("ra", "random_all"), ("rc", "random_control"), ("db", "dip")))
    head = _stats_sql("", [], baselines).split(", , sel AS")[0]
    return f"{head}, {', '.join(picks)}, ev AS ({' UNION ALL '.join(longs)}), {_STATS_P}"


FULL_RUN = _full_run_sql()


@query("h9_full_run", "trades prices", FULL_RUN + " SELECT * FROM full_stats", recursive=True)
def h9(t):
    return E.full_run(t.trades, t.stored_prices)


@query(
    "a28_data_profile", "trades",
    """SELECT count(*) AS rows, count(*) FILTER (transaction_type = 'BUY') AS buys, count(*) FILTER (transaction_type = 'SELL') AS sells, count(*) FILTER (is_plan) AS plan_rows,
    count(*) FILTER (is_csuite) AS csuite_rows, count(*) FILTER (is_healthcare) AS healthcare_rows, count(DISTINCT symbol) AS symbols FROM trades""",
)
def a28(t):
    from tidewatch.operators.feeds import data_profile

    return data_profile(t.trades)


@query(
    "a26_bonferroni", "trades",
    """p AS (SELECT symbol, CASE WHEN count(*) FILTER (transaction_type = 'BUY') > 0 THEN min(total_value) / max(total_value) / 1000 END AS p_value FROM trades GROUP BY 1), n AS (SELECT count(p_value) AS n FROM p)
    SELECT symbol, p_value, n AS n_tests, round(0.05e0 / n, 6) AS threshold_005, p_value < 0.05e0 / n AS significant_bonferroni, p_value < 0.01e0 / n AS significant_bonferroni_strict FROM p, n""",
)
def a26(t):
    p = F.when(F.count_if(F.col("transaction_type") == "BUY") > 0, F.min("total_value") / F.max("total_value") / 1000)
    return E.bonferroni(t.trades.groupBy("symbol").agg(p.alias("p_value")))


_SIDES = "ev AS (SELECT symbol AS sub_group, transaction_type AS horizon, total_value AS ret FROM trades WHERE transaction_type IN ('BUY', 'SELL'))"


@query(
    "a23_cohens_d", "trades",
    f"""{_SIDES}, em AS (SELECT sub_group, horizon, count(*) AS n, avg(ret) AS m, var_samp(ret) AS v, quantile_cont(ret, 0.01) AS q0, quantile_cont(ret, 0.99) AS q1 FROM ev GROUP BY ALL),
    ew AS (SELECT sub_group, horizon, avg(c) AS wm, var_samp(c) AS wv FROM (SELECT ev.*, CASE WHEN n < 10 THEN ret ELSE greatest(least(ret, q1), q0) END AS c FROM ev JOIN em USING (sub_group, horizon)) GROUP BY ALL),
    s AS (SELECT * FROM em JOIN ew USING (sub_group, horizon)), a AS (SELECT * FROM s WHERE horizon = 'BUY'), z AS (SELECT * FROM s WHERE horizon = 'SELL')
    SELECT a.sub_group AS symbol, a.n AS n_buy, z.n AS n_sell, CASE WHEN a.n >= 4 AND z.n >= 10 THEN round((a.wm - z.wm) / sqrt(((a.n - 1) * a.wv + (z.n - 1) * z.wv) / (a.n + z.n - 2)), 6) END AS d_winsor,
    round((a.m - z.m) / sqrt((a.v + z.v) / 2), 6) AS d_raw FROM a JOIN z USING (sub_group)""",
)
def a23(t):
    rows = t.trades.filter("transaction_type IN ('BUY', 'SELL')").select("symbol", "transaction_type", F.col("total_value").alias("ret"))
    m = E.moments(rows, ["symbol", "transaction_type"], median=False)
    a, z = (m.filter(F.col("transaction_type") == k).drop("transaction_type") for k in ("BUY", "SELL"))
    z = z.select("symbol", *[F.col(c).alias(f"z_{c}") for c in z.columns if c != "symbol"])
    c = F.col
    d = X.pooled_d(c("w_mean"), c("w_var"), c("n"), c("z_w_mean"), c("z_w_var"), c("z_n"))
    return a.join(z, "symbol").select(
        "symbol", c("n").alias("n_buy"), c("z_n").alias("n_sell"), F.round(d, 6).alias("d_winsor"),
        F.round(X.raw_d(c("mean"), c("var"), c("z_mean"), c("z_var")), 6).alias("d_raw"),
    )


@query(
    "a21_horizon_stats", "trades prices",
    f"""{_RT}, {_baseline('rb', 'prices', 5000, 42)}, bl AS ({_unpivot('rb', "'random' AS baseline, symbol")}), pick AS (SELECT * FROM trades WHERE transaction_type IN ('BUY', 'SELL')),
    sel AS (SELECT e.*, r1, r3, r5, r21 FROM pick e JOIN rt ON e.symbol = rt.symbol AND e.filing_date = rt.date),
    ev AS ({_long('sel', [('buys', "transaction_type = 'BUY'", 'buy', 'random'), ('sells', "transaction_type = 'SELL'", 'sell', 'random'), ('rare', "total_value > 1249000", 'any', 'random'), ('no_baseline', "is_csuite", 'any', 'none')])}), {_STATS}""",
)
def a21(t):
    events = E.with_returns(t.trades.filter("transaction_type IN ('BUY', 'SELL')"), _returns(t))
    rows = E.group_rows(events, [
        ("buys", F.col("transaction_type") == "BUY", "buy", "random"), ("sells", F.col("transaction_type") == "SELL", "sell", "random"),
        ("rare", F.col("total_value") > 1_249_000, "any", "random"), ("no_baseline", F.col("is_csuite"), "any", "none"),
    ])
    return _finish(rows, E.random_baseline(t.stored_prices, 5000, 42, "random"))
