"""Registered queries: exchange clock, forward prices, snapshots and event-day returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import calendar as C, scoring as S
from tidewatch.operators import outcomes as O
from tidewatch.operators.reports import as_ts
from tidewatch.plans.registry import query

_CLOSED = ", ".join(f"'{d}'" for d in C.FULL_CLOSURES)
_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def _open(ts: str) -> str:
    local = _LOCAL.replace("ts ", f"{ts} ")
    minute = f"(hour({local}) * 60 + minute({local}))"
    return (
        f"(dayofweek({local}) NOT IN (0, 6) AND strftime({local}, '%Y-%m-%d') NOT IN ({_CLOSED}) AND {minute} >= 570 AND {minute} < 960)"
    )


# Sessions of the data's period and the effective start of every row of "src(id, ts)".
_SESSIONS = f"""sess AS (SELECT CAST(d AS DATE) AS d FROM range(TIMESTAMP '2023-12-20', TIMESTAMP '2024-04-01', INTERVAL 1 DAY) r(d)
    WHERE dayofweek(d) NOT IN (0, 6) AND strftime(d, '%Y-%m-%d') NOT IN ({_CLOSED})),
  loc AS (SELECT id, ts, {_LOCAL} AS lt, {_open('ts')} AS is_open FROM src),
  cand AS (SELECT *, CAST(lt AS DATE) + CASE WHEN hour(lt) * 60 + minute(lt) < 570 THEN 0 ELSE 1 END AS c FROM loc),
  eff AS (SELECT id, ts, is_open, CASE WHEN is_open THEN ts ELSE ((CAST(d AS TIMESTAMP) + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'
      + (ts - date_trunc('minute', ts)) END AS effective_start FROM cand ASOF LEFT JOIN sess ON c <= d)"""


@query("m1_exchange_closure", "ev", f"SELECT event_id, ts, strftime({_LOCAL}, '%Y-%m-%d') IN ({_CLOSED}) AS closed FROM ev")
def m1(t):
    return t.ev.select("event_id", "ts", C.is_closure(F.col("ts")).alias("closed"))


@query("m2_exchange_open", "ev", f"SELECT event_id, ts, {_open('ts')} AS is_open FROM ev")
def m2(t):
    return t.ev.select("event_id", "ts", C.is_open(F.col("ts")).alias("is_open"))


@query("m3_effective_start", "ev", f"src AS (SELECT event_id AS id, ts FROM ev), {_SESSIONS} SELECT id, ts, effective_start FROM eff")
def m3(t):
    return t.ev.select(F.col("event_id").alias("id"), "ts", C.effective_start(F.col("ts")).alias("effective_start"))


@query(
    "m4_last_trading_day", "ev",
    "SELECT event_id, CAST(CAST(ts AS DATE) - CASE dayofweek(ts) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS DATE) AS last_session FROM ev",
)
def m4(t):
    return t.ev.select("event_id", C.last_trading_day(F.to_date("ts")).alias("last_session"))


@query(
    "j6_price_slots", "alerts ticks",
    f"""src AS (SELECT id, sent_at AS ts FROM alerts WHERE price_at_alert IS NOT NULL AND NOT price_outcome_done), {_SESSIONS},
    q AS (SELECT * FROM ticks WHERE {_open('ts')} AND ts <= TIMESTAMP '2024-01-28 12:00:00'),
    slots AS (SELECT e.id, symbol, slot, effective_start + h * INTERVAL 1 HOUR AS at FROM eff e JOIN alerts a ON a.id = e.id,
      (VALUES ('1h', 1), ('4h', 4), ('1d', 24), ('3d', 72), ('7d', 168)) v(slot, h)),
    own AS (SELECT slots.id, slot, price FROM slots ASOF LEFT JOIN q ON slots.symbol = q.symbol AND slots.at <= q.ts),
    xbi AS (SELECT slots.id, slot, price FROM slots ASOF LEFT JOIN (SELECT * FROM q WHERE symbol = 'S0') b ON slots.at <= b.ts),
    ibb AS (SELECT slots.id, slot, price FROM slots ASOF LEFT JOIN (SELECT * FROM q WHERE symbol = 'S1') b ON slots.at <= b.ts),
    o AS (SELECT id, max(price) FILTER (slot = '1h') AS p1h, max(price) FILTER (slot = '4h') AS p4h, max(price) FILTER (slot = '1d') AS p1d, max(price) FILTER (slot = '3d') AS p3d, max(price) FILTER (slot = '7d') AS p7d FROM own GROUP BY 1),
    x AS (SELECT id, max(price) FILTER (slot = '1d') AS x1, max(price) FILTER (slot = '3d') AS x3, max(price) FILTER (slot = '7d') AS x7 FROM xbi GROUP BY 1),
    i AS (SELECT id, max(price) FILTER (slot = '1d') AS i1, max(price) FILTER (slot = '3d') AS i3, max(price) FILTER (slot = '7d') AS i7 FROM ibb GROUP BY 1),
    r AS (SELECT a.id, a.symbol, a.sent_at, a.price_at_alert, a.price_outcome_done AS was_done, coalesce(price1h, p1h) AS price1h, coalesce(price4h, p4h) AS price4h, coalesce(price1d, p1d) AS price1d, coalesce(price3d, p3d) AS price3d, coalesce(price7d, p7d) AS price7d,
      coalesce(xbi1d, x1) AS xbi1d, coalesce(xbi3d, x3) AS xbi3d, coalesce(xbi7d, x7) AS xbi7d, coalesce(ibb1d, i1) AS ibb1d, coalesce(ibb3d, i3) AS ibb3d, coalesce(ibb7d, i7) AS ibb7d
      FROM alerts a LEFT JOIN o USING (id) LEFT JOIN x USING (id) LEFT JOIN i USING (id))
    SELECT * EXCLUDE (was_done, price_at_alert), was_done OR (price_at_alert IS NOT NULL AND ((price1h IS NOT NULL AND price4h IS NOT NULL AND price1d IS NOT NULL AND price3d IS NOT NULL AND price7d IS NOT NULL)
      OR sent_at + INTERVAL 11 DAY <= TIMESTAMP '2024-01-28 12:00:00')) AS price_outcome_done FROM r""",
)
def j6(t):
    out = O.fill_price_slots(t.alerts, t.ticks, as_ts("2024-01-28 12:00:00"), {"xbi": "S0", "ibb": "S1"})
    return out.select(
        "id", "symbol", "sent_at", *[f"price{s}" for s in O.SLOT_HOURS],
        *[f"{b}{s}" for b in ("xbi", "ibb") for s in O.BENCHMARK_SLOTS], "price_outcome_done",
    )


@query(
    "j17_alert_snapshot", "alerts ticks",
    """q AS (SELECT * FROM ticks WHERE price > 0)
    SELECT a.id, a.symbol, a.sent_at, q.price AS price_snapshot, x.price AS xbi_snapshot, i.price AS ibb_snapshot
    FROM alerts a ASOF LEFT JOIN q ON a.symbol = q.symbol AND a.sent_at >= q.ts
    ASOF LEFT JOIN (SELECT * FROM q WHERE symbol = 'S0') x ON a.sent_at >= x.ts
    ASOF LEFT JOIN (SELECT * FROM q WHERE symbol = 'S1') i ON a.sent_at >= i.ts""",
)
def j17(t):
    return O.alert_snapshot(t.alerts, t.ticks, {"xbi": "S0", "ibb": "S1"})


@query(
    "k8_close_expired", "alerts",
    "SELECT id, price_outcome_done OR (price_at_alert IS NULL AND sent_at < TIMESTAMP '2024-01-28' - INTERVAL 72 HOUR) AS price_outcome_done FROM alerts",
)
def k8(t):
    return O.close_expired(t.alerts, as_ts("2024-01-28 00:00:00")).select("id", "price_outcome_done")


_FWD = """fp AS (SELECT symbol, date, close, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5, lead(close, 21) OVER w AS c21
    FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query(
    "j5_entry_prices", "trades prices",
    _FWD + """, d AS (SELECT DISTINCT symbol, filing_date AS date FROM trades)
    SELECT d.symbol, d.date, fp.date AS entry_date, fp.close AS entry_close, c5 AS close_5 FROM d ASOF LEFT JOIN fp ON d.symbol = fp.symbol AND d.date <= fp.date""",
)
def j5(t):
    return O.entry_prices(t.trades.select("symbol", F.col("filing_date").alias("date")), t.prices, [5])


_RETURNS = _FWD + """, rt AS (SELECT d.symbol, d.date, CASE WHEN c1 > 0 THEN (c1 - close) / close * 100 END AS ret_1d, CASE WHEN c3 > 0 THEN (c3 - close) / close * 100 END AS ret_3d,
    CASE WHEN c5 > 0 THEN (c5 - close) / close * 100 END AS ret_7d, CASE WHEN c21 > 0 THEN (c21 - close) / close * 100 END AS ret_30d
    FROM (SELECT DISTINCT symbol, filing_date AS date FROM trades) d ASOF JOIN fp ON d.symbol = fp.symbol AND d.date <= fp.date WHERE close > 0)"""


@query(
    "w3_event_returns", "trades prices",
    _RETURNS + """ SELECT trade_id, t.symbol, filing_date, ret_1d, ret_3d, ret_7d, ret_30d FROM trades t JOIN rt ON t.symbol = rt.symbol AND t.filing_date = rt.date
    WHERE transaction_type = 'BUY' AND coalesce(ret_1d, ret_3d, ret_7d, ret_30d) IS NOT NULL""",
)
def w3(t):
    buys = t.trades.filter("transaction_type = 'BUY'").select("trade_id", "symbol", "filing_date")
    return O.event_returns(buys, t.prices).drop("entry_price")


@query(
    "w4_dip_days", "prices",
    """r AS (SELECT symbol, date, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS daily_return, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n
      FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT symbol, date, daily_return, CAST(idx AS INT) AS idx, n FROM r WHERE n >= 30 AND daily_return <= -2 AND idx + 21 < n""",
)
def w4(t):
    return O.dip_days(t.prices).select("symbol", "date", "daily_return", "idx", "n")


@query(
    "m10_sector_alpha", "alerts",
    """SELECT id, CASE WHEN price_at_alert > 0 AND price7d > 0 THEN (price7d - price_at_alert) / price_at_alert * 100 END
      - 1.2e0 * CASE WHEN xbi_at_alert > 0 AND xbi7d > 0 THEN (xbi7d - xbi_at_alert) / xbi_at_alert * 100 END AS alpha FROM alerts""",
)
def m10(t):
    c = F.col
    return t.alerts.select(
        "id", S.alpha_pct(c("price_at_alert"), c("price7d"), c("xbi_at_alert"), c("xbi7d"), 1.2).alias("alpha")
    )
