"""Domain tables derived from the driver tables.

One expression list per table serves both engines: Spark runs it through
``selectExpr`` and the oracle text embeds it as a CTE, so both sides start from
the same rows.  Operators themselves are written twice, independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.session import cut_lineage, deal_out, pin_utc
from tidewatch.sources.tables import read_table

_RULE = (
    "CASE event_type WHEN 'purchase' THEN 'Form 4 Insider BUY' WHEN 'signup' THEN '8-K Material Event GPT' "
    "WHEN 'click' THEN 'Unusual Options Activity' WHEN 'view' THEN 'Correlated Signal' ELSE '8-K Earnings Miss' END"
)
_DIRECTION = (
    "CASE WHEN (user_id + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'positive' ELSE 'negative' END"
)
_SIGN = _DIRECTION.replace("'positive'", "1").replace("'negative'", "-1")

ALERTS = {
    "id": "event_id",
    "symbol": "concat('S', user_id)",
    "rule_name": _RULE,
    "priority": "CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 20 THEN 'HIGH' ELSE 'MEDIUM' END",
    "catalyst_type": "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 'earnings' WHEN k % 3 = 1 THEN 'leadership' ELSE 'guidance' END",
    "delivered": "event_id % 3 <> 0",
    "non_delivery_reason": "CASE WHEN event_id % 3 <> 0 THEN NULL WHEN event_id % 6 = 0 THEN 'observation' WHEN k % 2 = 0 THEN 'sell_no_edge' ELSE 'daily_limit' END",
    "sent_at": "ts",
    "alert_direction": f"CASE WHEN k % 10 = 9 THEN NULL ELSE {_DIRECTION} END",
    "price_at_alert": "CASE WHEN k % 20 = 0 THEN NULL ELSE value END",
    "price1h": "CASE WHEN k % 10 = 3 THEN NULL ELSE value * (1 + (k % 7 - 3) / 100e0) END",
    "price4h": "CASE WHEN k % 10 = 4 THEN NULL ELSE value * (1 + (k % 11 - 5) / 100e0) END",
    "price1d": "CASE WHEN k % 10 = 5 THEN NULL ELSE value * (1 + (k - 50) / 500e0) END",
    "price3d": "CASE WHEN k % 10 = 6 THEN NULL ELSE value * (1 + ((user_id + k) % 21 - 10) / 100e0) END",
    "price7d": "CASE WHEN k % 10 = 7 THEN NULL ELSE value * (1 + ((event_id + k) % 31 - 15) / 100e0) END",
    "xbi_at_alert": "CASE WHEN k % 9 = 0 THEN NULL ELSE 90 + k / 10e0 END",
    "xbi1d": "CASE WHEN k % 8 = 0 THEN NULL ELSE 90 + (k % 13) / 2e0 END",
    "xbi3d": "90 + (k % 17) / 2e0",
    "xbi7d": "CASE WHEN k % 6 = 0 THEN NULL ELSE 90 + (k % 19) / 2e0 END",
    "ibb_at_alert": "130 + (k % 23) / 4e0",
    "ibb1d": "130 + (k % 29) / 4e0",
    "ibb3d": "CASE WHEN k % 5 = 0 THEN NULL ELSE 130 + (k % 31) / 4e0 END",
    "ibb7d": "130 + (k % 37) / 4e0",
    "price_outcome_done": "k % 4 = 0",
    "archived": "event_id % 50 = 0",
    "message": "concat('Insider activity. Conviction: ', CASE WHEN k % 2 = 0 THEN concat(chr(92), '-') ELSE '+' END, '0', chr(92), '.', lpad(CAST(k AS STRING), 2, '0'))",
}

SIGNALS = {
    "id": "concat('sig-', event_id)",
    "ticker": "concat('S', user_id)",
    "source_category": "CASE event_type WHEN 'purchase' THEN 'form4' WHEN 'signup' THEN '8k' WHEN 'click' THEN 'options' WHEN 'view' THEN 'news' ELSE 'social' END",
    "conviction": f"least(value / 100e0, 1e0) * {_SIGN}",
    "direction": _DIRECTION,
    "catalyst_type": "CASE k % 3 WHEN 0 THEN 'earnings' WHEN 1 THEN 'leadership' ELSE 'unknown' END",
    "ts": "ts",
}

TICKS = {"symbol": "concat('S', user_id)", "ts": "ts", "price": "value", "tick_id": "event_id"}

SYSTEM_LOGS = {
    "id": "event_id",
    "created_at": "ts",
    "module": "CASE event_type WHEN 'purchase' THEN 'sec-filings' WHEN 'click' THEN 'options-flow' ELSE 'correlation' END",
    "class_name": "CASE WHEN k % 11 = 0 THEN NULL ELSE concat('Service', k % 5) END",
    "status": "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END",
    "level": "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' WHEN 'click' THEN NULL WHEN 'signup' THEN 'warn' ELSE 'info' END",
    "duration_ms": "CAST(floor(value) AS INT)",
    "trace_id": "concat('t', user_id)",
    "ticker": "concat('S', user_id)",
    "decision_reason": "event_type",
}

COLLECTION_LOGS = {
    "id": "event_id",
    "collector": "event_type",
    "status": "CASE WHEN value > 300 THEN 'FAILED' WHEN value > 200 THEN 'PARTIAL' ELSE 'SUCCESS' END",
    "items_collected": "k",
    "started_at": "ts",
}

TRADES = {
    "trade_id": "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))",
    "accession": "concat('A', l_orderkey)",
    "idx": "l_linenumber",
    "accession_number": "concat('A', l_orderkey, '_', l_linenumber)",
    "symbol": "concat('S', l_suppkey)",
    "insider_name": "concat('I', l_partkey % 20)",
    "insider_role": "CASE l_linenumber WHEN 1 THEN 'Chief Executive Officer' WHEN 2 THEN 'Director' WHEN 3 THEN 'EVP, Finance' WHEN 4 THEN 'Vice President' WHEN 5 THEN '10% Owner' WHEN 6 THEN NULL ELSE 'Director, President' END",
    "transaction_type": "CASE l_returnflag WHEN 'R' THEN 'SELL' WHEN 'A' THEN 'BUY' ELSE 'EXERCISE' END",
    "shares": "l_quantity",
    "price_per_share": "l_extendedprice / l_quantity",
    "total_value": "l_extendedprice * CASE WHEN l_linenumber % 2 = 0 THEN 12 ELSE 1 END",
    "transaction_date": "CAST(l_shipdate AS DATE)",
    "filing_date": "CAST(l_shipdate AS DATE) + (l_linenumber % 3)",
    "is_plan": "CASE WHEN l_discount >= 0.095e0 THEN NULL ELSE l_tax >= 0.07e0 END",
    "shares_after": "l_partkey + l_quantity",
    "is_csuite": "l_linenumber IN (1, 3, 7)",
    "is_director": "l_linenumber IN (2, 7)",
    "is_healthcare": "l_suppkey % 2 = 0",
}

CATALYSTS = {
    "symbol": "concat('S', o_custkey % 100)",
    "drug_name": "concat('D', o_orderkey % 7)",
    "event_date": "CAST(o_orderdate AS DATE)",
    "area": "o_orderpriority",
    "outcome": "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END",
    "row_id": "o_orderkey",
}

TICKERS = {
    "symbol": "concat('S', s_suppkey)",
    "name": "s_name",
    "cik": "lpad(CAST(s_suppkey AS STRING), 10, '0')",
    "subsector": "n_name",
    "sector": "CASE s_nationkey % 5 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'semi_supply_chain' WHEN 2 THEN 'biotech_apls' WHEN 3 THEN 'healthcare_discovery' ELSE 'technology' END",
    "priority": "CASE WHEN s_acctbal > 6000 THEN 'HIGH' WHEN s_acctbal > 2000 THEN 'MEDIUM' ELSE 'LOW' END",
    "observation_only": "s_suppkey % 7 = 0",
    "is_active": "s_acctbal > 0",
}

# Filing bodies: the whole document text followed by a disclosure paragraph.
FILINGS = {
    "accession": "concat('F', doc_id)",
    "doc_id": "doc_id",
    "symbol": "concat('S', doc_id % 150)",
    "cik": "lpad(CAST(doc_id % 150 AS STRING), 10, '0')",
    "form_type": "CASE WHEN doc_id % 9 = 8 THEN '4' ELSE '8-K' END",
    "filing_date": "DATE '2024-01-01' + CAST(doc_id % 30 AS INT)",
    "analyzed": "doc_id % 5 = 0",
    "direction": "CASE WHEN doc_id % 5 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END END",
    "text": (
        "concat(text, ' ', CASE doc_id % 6 "
        "WHEN 0 THEN concat('Item 2.02 Results of Operations. Total revenue of $1,', lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), '.5 million and net revenues: $2.1 billion. Diluted EPS of $', CAST(doc_id % 9 AS STRING), '.25 for the quarter. The company raises its outlook. Item 9.01 Exhibits. SIGNATURES') "
        "WHEN 1 THEN 'Item 7.01 Regulation FD. The company reaffirms its adjusted earnings guidance for the year. SIGNATURES' "
        "WHEN 2 THEN 'Item 5.02 Departure of Directors. The company lowers GAAP guidance and reaffirms its outlook. Item 5.02 again.' "
        "WHEN 3 THEN 'Item 1.03 Bankruptcy or Receivership. Item 8.01 Other Events. SIGNATURES' "
        "WHEN 4 THEN 'Item 8.01 Other Events. The company withdraws its forecast; amounts were not disclosed.' "
        "ELSE '' END)"
    ),
}

MENTIONS = {
    "external_id": "concat('m', conv_id, '-', turn)",
    "conv_id": "conv_id",
    "turn": "turn",
    "source": "CASE role WHEN 'user' THEN 'reddit' WHEN 'assistant' THEN 'stocktwits' ELSE 'news' END",
    "body": "concat(text, ' $S', conv_id % 150, ' and S', turn, ' again $S', conv_id % 150, ' $ZZZZ')",
    "published_at": "TIMESTAMP '2024-01-01 00:00:00' + (conv_id % 30) * INTERVAL '1' DAY + turn * INTERVAL '1' HOUR",
}

_SOURCE = {
    "alerts": (ALERTS, "ev"),
    "signals": (SIGNALS, "ev"),
    "ticks": (TICKS, "ev"),
    "system_logs": (SYSTEM_LOGS, "ev"),
    "collection_logs": (COLLECTION_LOGS, "ev"),
    "trades": (TRADES, "lineitem"),
    "catalysts": (CATALYSTS, "orders"),
    "tickers": (TICKERS, "sup"),
    "filings": (FILINGS, "documents"),
    "mentions": (MENTIONS, "conversations"),
}


def daily_closes(trades: DataFrame) -> DataFrame:
    """Lowest price of every symbol and day."""
    rows = trades.select("symbol", F.col("transaction_date").alias("date"), "price_per_share")  # dealt out first: few share a day, so a scan's task would hold all it reads
    return deal_out(rows, "symbol", "date").groupBy("symbol", "date").agg(F.min("price_per_share").alias("close"))


class Tables:
    """Lazy access to the driver tables and the domain tables over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        pin_utc(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name == "ev":
            return self.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        if name == "sup":
            return self.raw("supplier").join(
                self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")
            )
        if name == "prices":
            return daily_closes(self.trades)
        if name == "stored_prices":  # read several times by one query, so it is derived once
            self.__dict__[name] = cut_lineage(self.prices)
            return self.__dict__[name]
        if name == "bars":
            part = self.raw("part")
            daily = (
                self.raw("lineitem")
                .groupBy("l_partkey", F.to_date("l_shipdate").alias("session"))
                .agg((F.sum(F.col("l_quantity").cast("bigint")) * 10).alias("volume"))
            )
            return daily.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
                *[f"{e} AS {c}" for c, e in BARS.items()]
            )
        if name in _SOURCE:
            cols, base = _SOURCE[name]
            df = getattr(self, base) if base in ("ev", "sup") else self.raw(base)
            return df.selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])
        raise AttributeError(name)


BARS = {
    "occ": "concat('O:', p_partkey)",
    "symbol": "concat('S', p_partkey % 100)",
    "session": "session",
    "volume": "volume",
    "underlying": "p_retailprice",
    "strike": "p_retailprice * (0.8e0 + (p_size % 9) * 0.05e0)",
    "option_type": "CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END",
    "expiry": "session + p_size",
}


def _select(cols: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {source}"


_CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": ("SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events", ()),
    "sup": ("SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey", ()),
    "prices": (
        "SELECT symbol, transaction_date AS date, min(price_per_share) AS close FROM trades GROUP BY 1, 2",
        ("trades",),
    ),
    "bars": (
        _select(
            BARS,
            "(SELECT l_partkey, CAST(l_shipdate AS DATE) AS session, CAST(sum(CAST(l_quantity AS BIGINT)) * 10 AS BIGINT) AS volume "
            "FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey",
        ),
        (),
    ),
}
for _name, (_cols, _base) in _SOURCE.items():
    _CTE[_name] = (_select(_cols, _base), (_base,) if _base in ("ev", "sup") else ())


def oracle(tables: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs of ``tables`` (and what they need).

    ``body`` either starts with further CTEs (``x AS (...), ... SELECT``) or with SELECT.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _CTE[name][1]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for t in tables.split():
        add(t)
    ctes = [f"{n} AS ({_CTE[n][0]})" for n in ordered]
    body = body.strip()
    glue = "" if body.upper().startswith("SELECT") else ", "
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not ctes:
        return body if not glue else head + body
    return head + ", ".join(ctes) + glue + " " + body
