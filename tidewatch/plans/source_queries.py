"""Registered queries: landed documents (derived from the tables) to rows, and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.reports import as_ts
from tidewatch.plans.registry import query
from tidewatch.plans.study_queries import FULL_RUN
from tidewatch.sources import feeds as S, sinks as W



def _docs(df, value: str, *keep: str):
    return df.selectExpr(*keep, f"{value} AS value")


# --- CSV forms -------------------------------------------------------------------------------

CSV_ROW = {
    "trade_id": "trade_id", "symbol": "symbol",
    "transaction_date": "CASE WHEN idx = 6 THEN concat('0025', substring(CAST(transaction_date AS STRING), 5)) ELSE replace(CAST(transaction_date AS STRING), '199', '201') END",
    "filing_date": "replace(CAST(filing_date AS STRING), '199', '201')",
    "is_10b51_plan": "CASE WHEN is_plan THEN 'True' WHEN is_plan = false THEN '0' ELSE NULL END",
    "is_csuite": "CASE WHEN is_csuite THEN ' 1' ELSE 'no' END",
}


@query(
    "s1_transactions_csv", "trades",
    "c AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in CSV_ROW.items()) + """ FROM trades)
    SELECT trade_id, symbol, CAST(transaction_date AS DATE) AS transaction_date, CAST(filing_date AS DATE) AS filing_date, lower(trim(is_10b51_plan)) IN ('true', '1') AS is_10b51_plan, lower(trim(is_csuite)) IN ('true', '1') AS is_csuite
    FROM c WHERE regexp_matches(transaction_date, '^20[0-9]{2}-') AND regexp_matches(filing_date, '^20[0-9]{2}-')""",
)
def s1(t):
    return S.clean_transactions(t.trades.selectExpr(*[f"{e} AS {k}" for k, e in CSV_ROW.items()]))


@query("s2_prices_csv", "prices", "SELECT symbol, CAST(CAST(date AS TIMESTAMP) + INTERVAL 5 HOUR AS DATE) AS date, close FROM prices")
def s2(t):
    rows = t.prices.selectExpr("symbol", "concat(CAST(date AS STRING), ' 00:00:00-05:00') AS Date", "close AS Close")
    return S.price_rows(rows)


# --- JSON documents --------------------------------------------------------------------------

UNIVERSE = (
    "concat('{\"tickers\":{\"', subsector, '\":{\"companies\":[{\"symbol\":\"', symbol, '\",\"name\":\"', name, '\",\"cik\":\"', cik, '\",\"aliases\":[\"', lower(symbol), '\"]}]}},\"rules\":[{\"name\":\"', symbol, '\",\"priority\":\"', priority, "
    "'\"', CASE WHEN is_active THEN '' ELSE ',\"is_active\":false' END, '}]}')"
)


@query(
    "s3_universe", "tickers",
    "SELECT symbol, name, cik, subsector, CASE subsector WHEN 'NATION_1' THEN 'HIGH' WHEN 'NATION_2' THEN 'LOW' ELSE 'MEDIUM' END AS priority, lower(symbol) AS alias, 'healthcare' AS sector FROM tickers",
)
def s3(t):
    rows = S.universe_rows(_docs(t.tickers, UNIVERSE), {"NATION_1": "HIGH", "NATION_2": "LOW"}, "healthcare")
    return rows.select("symbol", "name", "cik", "subsector", "priority", F.get("aliases", F.lit(0)).alias("alias"), "sector")


@query("s3_universe_rules", "tickers", "SELECT symbol AS name, priority, CAST(15 AS INT) AS throttle_minutes, is_active FROM tickers")
def s3b(t):
    return S.universe_rules(_docs(t.tickers, UNIVERSE))


# One submission document per order: four entries, newest first, the third is old for some.
_D = "CAST(DATE '2024-01-10' - CAST({n} AS INT) AS STRING)"
SUBMISSION = (
    "concat('{\"cik\":\"', lpad(CAST(o_custkey AS STRING), 10, '0'), '\",\"symbol\":\"S', o_custkey, '\",\"filings\":{\"recent\":{\"form\":[\"4\",\"8-K\",\"10-Q\",\"4\"],\"filingDate\":[\"', "
    + _D.format(n="o_orderkey % 3") + ", '\",\"', " + _D.format(n="o_orderkey % 3 + 1") + ", '\",\"', " + _D.format(n="o_orderkey % 9") + ", '\",\"', " + _D.format(n="5")
    + ", '\"],\"accessionNumber\":[\"', o_orderkey, '-24-1\",\"', o_orderkey, '-24-2\",\"', o_orderkey, '-24-3\",\"', o_orderkey, '-24-4\"],\"primaryDocument\":[\"x.xml\",\"', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'main.htm' END, '\",\"q.htm\",\"y.xml\"]},"
    "\"older\":[{\"form\":[\"4\"],\"filingDate\":[\"2020-01-02\"],\"accessionNumber\":[\"', o_orderkey, '-20-9\"],\"primaryDocument\":[\"\"]}]}}')"
)


@query(
    "s4_submission_filings", "",
    """e AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, concat('S', o_custkey) AS symbol, o_orderkey AS k, unnest([0, 1, 2, 3]) AS pos, unnest(['4', '8-K', '10-Q', '4']) AS form_type,
      unnest([o_orderkey % 3, o_orderkey % 3 + 1, o_orderkey % 9, 5]) AS back, unnest(['x.xml', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'main.htm' END, 'q.htm', 'y.xml']) AS doc FROM orders)
    SELECT cik, symbol, CAST(pos AS INT) AS pos, form_type, CAST(DATE '2024-01-10' - CAST(back AS INT) AS DATE) AS filing_date, concat(k, '-24-', pos + 1) AS accession,
    concat('edgar/', CAST(CAST(cik AS BIGINT) AS VARCHAR), '/', k, '24', pos + 1, CASE WHEN form_type = '4' OR doc = '' THEN '' ELSE concat('/', doc) END) AS document_url
    FROM e WHERE form_type IN ('4', '8-K') AND back <= 7 AND (pos < 2 OR k % 9 <= 7)""",
)
def s4(t):
    docs = _docs(t.raw("orders"), SUBMISSION)
    return S.submission_filings(docs, as_ts("2024-01-10 12:00:00"), base="edgar/").drop("batch")


@query("s4_older_batches", "", "SELECT count(*) AS n, count(*) FILTER (true) * 0 + (SELECT count(*) FROM orders) AS older FROM (SELECT unnest([1, 2, 3, 4]) FROM orders)")
def s4b(t):
    rows = S.submission_filings(_docs(t.raw("orders"), SUBMISSION), as_ts("2024-01-10 12:00:00"), limit=None)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("batch") == 1).alias("older"))


# Ownership documents: one per trade row, one non-derivative and one derivative transaction.
def _txn(code: str, shares: str, price: str, date: str, tag: str) -> str:
    return (
        f"'<T><transactionDate><value>', {date}, '</value></transactionDate><transactionCoding><transactionCode>', {code}, '</transactionCode>', {tag}, '</transactionCoding><transactionAmounts><transactionShares><value>', {shares}, "
        f"'</value></transactionShares><transactionPricePerShare><value>', {price}, '</value></transactionPricePerShare></transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>', CAST(CAST(shares_after AS INT) AS STRING), '</value></sharesOwnedFollowingTransaction></postTransactionAmounts></T>'"
    )


FORM4 = (
    "concat('<ownershipDocument><aff10b5One>', CASE WHEN is_plan THEN ' TRUE ' ELSE '0' END, '</aff10b5One><reportingOwner><reportingOwnerId><rptOwnerName>', insider_name, '</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>1</isOfficer><officerTitle>', coalesce(insider_role, ''), '</officerTitle></reportingOwnerRelationship></reportingOwner>', "
    "CASE WHEN idx = 2 THEN '<reportingOwner><reportingOwnerId><rptOwnerName>Fund LP</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isTenPercentOwner>true</isTenPercentOwner></reportingOwnerRelationship></reportingOwner>' ELSE '' END, '<nonDerivativeTable>', "
    + _txn("CASE transaction_type WHEN 'BUY' THEN 'P' WHEN 'SELL' THEN 'S' ELSE 'M' END", "CAST(CAST(shares AS INT) AS STRING)", "CASE WHEN idx = 5 THEN '0' ELSE '12.345' END", "CAST(transaction_date AS STRING)", "''").replace("<T>", "<nonDerivativeTransaction>").replace("</T>", "</nonDerivativeTransaction>")
    + ", '</nonDerivativeTable><derivativeTable>', "
    + _txn("'X'", "CASE WHEN idx = 3 THEN '0' ELSE '-7' END", "'2'", "CASE WHEN idx = 4 THEN '' ELSE CAST(transaction_date AS STRING) END", "CASE WHEN idx = 6 THEN '<Rule10b5-1Transaction>y</Rule10b5-1Transaction>' ELSE '' END").replace("<T>", "<derivativeTransaction>").replace("</T>", "</derivativeTransaction>")
    + ", '</derivativeTable></ownershipDocument>')"
)
_TITLE = "coalesce(insider_role, 'Officer')"


@query(
    "s5_form4_xml", "trades",
    f"""SELECT concat(trade_id, '_0') AS accession_number, CAST(0 AS INT) AS idx, CASE WHEN idx = 2 THEN concat(insider_name, ' (co-filing z Fund LP)') ELSE insider_name END AS insider_name, CASE WHEN idx = 2 THEN 'Director, 10% Owner' ELSE {_TITLE} END AS insider_role,
    transaction_type, CAST(CAST(shares AS INT) AS DOUBLE) AS shares, CASE WHEN idx = 5 THEN NULL ELSE 12.345e0 END AS price_per_share, CASE WHEN idx = 5 THEN 0e0 ELSE round(CAST(shares AS INT) * 12.345e0, 2) END AS total_value, transaction_date, coalesce(is_plan, false) AS is_plan FROM trades
    UNION ALL SELECT concat(trade_id, '_1'), 1, CASE WHEN idx = 2 THEN concat(insider_name, ' (co-filing z Fund LP)') ELSE insider_name END, CASE WHEN idx = 2 THEN 'Director, 10% Owner' ELSE {_TITLE} END, 'OTHER', 7e0, 2e0, 14e0, transaction_date, coalesce(is_plan, false) OR idx = 6 FROM trades WHERE idx NOT IN (3, 4)""",
)
def s5(t):
    docs = _docs(S.spread_documents(t.trades, "trade_id"), FORM4, "trade_id AS accession")  # dealt out while they are narrow rows
    return S.form4_transactions(docs, spread=False).drop("accession", "shares_after")


CALENDAR = (
    "concat('<html><table><thead><tr><td>2020-01-01</td><td>A</td><td>b</td><td>c</td><td>d</td></tr></thead><tbody><tr><td> ', CASE WHEN o_orderpriority = '5-LOW' THEN 'TBD' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END, "
    "' </td><td><b>s', o_custkey, '</b></td><td>', o_orderkey % 7, '</td><td> ind </td><td>', o_orderpriority, '</td></tr><tr><td>2024-01-01</td><td>X</td></tr></tbody></table></html>')"
)


@query(
    "s6_calendar_html", "",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS event_date, concat('S', o_custkey) AS symbol, CAST(o_orderkey % 7 AS VARCHAR) AS drug_name, 'ind' AS indication, o_orderpriority AS area FROM orders WHERE o_orderpriority <> '5-LOW'",
)
def s6(t):
    return S.calendar_rows(_docs(t.raw("orders"), CALENDAR, "o_orderkey"))


ATOM = (
    "concat('<feed><entry><title>4 - ACME ', o_custkey, ' (', lpad(CAST(o_custkey AS STRING), 10, '0'), ') (Issuer)</title><summary>Filed:&lt;/b&gt; ', CAST(CAST(o_orderdate AS DATE) AS STRING), '</summary><id>accession-number=', lpad(CAST(o_orderkey AS STRING), 10, '0'), '-24-000001</id></entry>', "
    "'<entry><title>4 - OTHER (0000000001) (Issuer)</title><id>accession-number=', lpad(CAST(o_orderkey AS STRING), 10, '0'), '-24-000001</id></entry><entry><title>4 - JOHN (0000000002) (Reporting)</title><id>accession-number=1</id></entry></feed>')"
)


@query(
    "s7_atom_feed", "",
    "SELECT o_orderkey, concat(lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), '-24-000001') AS accession, concat('ACME ', o_custkey) AS issuer_name, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderdate AS DATE) AS filed_date FROM orders",
)
def s7(t):
    return S.atom_entries(_docs(t.raw("orders"), ATOM, "o_orderkey"))


INDEX_LINE = (
    "concat(CASE o_orderpriority WHEN '1-URGENT' THEN '4/A ' WHEN '2-HIGH' THEN '424B5 ' ELSE '4  ' END, 'NAME ', o_custkey, '  ', CASE WHEN o_orderstatus = 'O' THEN '' ELSE replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') END, "
    "'  edgar/data/', o_custkey, '/', lpad(CAST(o_orderkey AS STRING), 10, '0'), '-24-000001.txt  ')"
)


@query(
    "s8_daily_index", "",
    """SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, concat(lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), '-24-000001') AS accession, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS filed_date
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""",
)
def s8(t):
    return S.daily_index_rows(_docs(t.raw("orders"), INDEX_LINE, "o_orderkey"))


TWITS = (
    "concat('{\"messages\":[{\"id\":', event_id, ',\"body\":\"b', user_id, '\",\"created_at\":\"2024-01-05T10:00:00Z\",\"entities\":{\"sentiment\":', CASE k % 3 WHEN 0 THEN '{\"basic\":\"Bullish\"}' WHEN 1 THEN '{\"basic\":\"Odd\"}' ELSE 'null' END, '}}]}')"
)


@query(
    "s9_stocktwits", "ev",
    "SELECT concat('st_', event_id) AS external_id, concat('S', user_id) AS symbol, concat('b', user_id) AS body, CASE WHEN k % 3 = 0 THEN 'Bullish' END AS sentiment, TIMESTAMP '2024-01-05 10:00:00' AS published_at FROM ev",
)
def s9(t):
    out = S.stocktwits_mentions(_docs(t.ev, TWITS, "concat('S', user_id) AS symbol"))
    return out.drop("source").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


REDDIT = "concat('{\"data\":{\"children\":[{\"data\":{\"id\":\"', event_id, '\",\"title\":\"t', user_id, '\",\"selftext\":\"', CASE WHEN k % 2 = 0 THEN '' ELSE repeat('x', 2100) END, '\",\"created_utc\":1704448800}}]}}')"


@query(
    "s9_reddit", "ev",
    "SELECT concat('reddit_', event_id) AS external_id, concat('t', user_id, CASE WHEN k % 2 = 0 THEN '' ELSE concat(chr(10), repeat('x', 2000)) END) AS body, TIMESTAMP '2024-01-05 10:00:00' AS published_at FROM ev",
)
def s9b(t):
    return S.reddit_mentions(_docs(t.ev, REDDIT)).select("external_id", "body", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


NEWS = "concat('[{\"headline\":\"h', event_id, '\",\"source\":\"', event_type, '\",\"url\":\"', CASE WHEN k = 7 THEN '' ELSE concat('u', event_id % 500) END, '\",\"category\":\"c\",\"datetime\":1704448800}]')"


@query(
    "s9_news", "ev",
    "SELECT concat('S', user_id) AS symbol, concat('h', event_id) AS headline, event_type AS source, concat('u', event_id % 500) AS url, TIMESTAMP '2024-01-05 10:00:00' AS published_at FROM ev WHERE k <> 7",
)
def s9c(t):
    out = S.news_articles(_docs(t.ev, NEWS, "concat('S', user_id) AS symbol"))
    return out.select("symbol", "headline", "source", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


MSPR = "concat('{\"symbol\":\"S', user_id, '\",\"data\":[{\"year\":2023,\"month\":', k % 12 + 1, ',\"change\":', k - 50, ',\"mspr\":', k - 30, '}]}')"


@query(
    "s9_monthly_sentiment", "ev",
    "SELECT concat('mspr_S', user_id, '_2023_', k % 12 + 1) AS accession_number, concat('S', user_id) AS symbol, CASE WHEN k > 30 THEN 'BUY' ELSE 'SELL' END AS transaction_type, CAST(abs(k - 50) AS DOUBLE) AS shares, make_date(2023, k % 12 + 1, 1) AS transaction_date FROM ev",
)
def s9d(t):
    return S.monthly_sentiment(_docs(t.ev, MSPR))


CONTRACTS = "concat('{\"results\":[{\"ticker\":\"', occ, '\",\"underlying_ticker\":\"', symbol, '\",\"contract_type\":\"', option_type, '\",\"strike_price\":', CAST(volume AS STRING), ',\"expiration_date\":\"', CAST(expiry AS STRING), '\"}]}')"


@query("s10_option_contracts", "bars", "SELECT CAST(0 AS INT) AS position, occ, symbol, option_type, CAST(volume AS DOUBLE) AS strike, expiry FROM bars")
def s10(t):
    return S.option_contracts(_docs(t.bars, CONTRACTS))


OPTION_BARS = "concat('{\"ticker\":\"', occ, '\",\"results\":[{\"v\":', CAST(volume AS STRING), ',\"c\":2.5,\"t\":1704448800000},{\"v\":1,\"c\":3.5,\"t\":1704535200000}]}')"


@query("s10_option_bars", "bars", "SELECT occ, DATE '2024-01-05' AS session, volume, 2.5e0 AS close FROM bars UNION ALL SELECT occ, DATE '2024-01-06', 1, 3.5e0 FROM bars")
def s10b(t):
    return S.option_bars(_docs(t.bars, OPTION_BARS))


EARNINGS = "concat('[{\"actual\":', o_orderkey % 5, ',\"estimate\":1.5,\"period\":\"2023-', lpad(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0'), '-31\"},{\"actual\":null,\"estimate\":2,\"period\":\"2023-06-30\"}]')"


@query(
    "s11_earnings_actuals", "",
    """SELECT concat('K', o_orderkey) AS symbol, CASE WHEN o_orderkey % 12 + 1 >= 6 THEN CAST(o_orderkey % 5 AS DOUBLE) END AS eps_actual, CASE WHEN o_orderkey % 12 + 1 >= 6 THEN 1.5e0 ELSE 2e0 END AS eps_estimate,
    CASE WHEN o_orderkey % 12 + 1 >= 6 THEN concat('2023-', lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0'), '-31') ELSE '2023-06-30' END AS period FROM orders""",
)
def s11(t):
    return S.earnings_actuals(_docs(t.raw("orders"), EARNINGS, "concat('K', o_orderkey) AS symbol"))


ESTIMATES = (
    "concat('{\"symbol\":\"K', o_orderkey, '\",\"estimates\":[{\"date\":\"2024-03-31\",\"horizon\":\"', CASE WHEN o_orderstatus = 'F' THEN 'fiscal year' ELSE 'fiscal quarter' END, '\",\"eps_estimate_average\":\"', CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE '1.25' END, "
    "'\",\"revenue_estimate_average\":\"', CAST(o_custkey AS STRING), '\",\"revenue_estimate_analyst_count\":\"12\"}]}')"
)


@query(
    "s11_analyst_estimates", "",
    "SELECT concat('K', o_orderkey) AS symbol, DATE '2024-03-31' AS date, CASE WHEN o_orderstatus <> 'P' THEN 1.25e0 END AS eps_estimate, CAST(o_custkey AS DOUBLE) AS revenue_estimate, CAST(12 AS INT) AS analysts FROM orders WHERE o_orderstatus <> 'F'",
)
def s11b(t):
    return S.analyst_estimates(_docs(t.raw("orders"), ESTIMATES))


COMPANIES = "concat('{\"fields\":[\"cik\",\"name\",\"ticker\",\"exchange\"],\"data\":[[\"', c_custkey, '\",\"', c_name, '\",\"S', c_custkey, '\",\"', CASE c_custkey % 4 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'CBOE' WHEN 2 THEN 'OTC' ELSE 'Nasdaq' END, '\"]]}')"


@query(
    "s12_company_list", "",
    "SELECT CAST(c_custkey AS VARCHAR) AS cik, c_name AS name, concat('S', c_custkey) AS ticker, CASE c_custkey % 4 WHEN 0 THEN 'NYSE' WHEN 2 THEN 'OTC' ELSE 'Nasdaq' END AS exchange FROM customer WHERE c_custkey % 4 <> 1",
)
def s12(t):
    return S.company_rows(_docs(t.raw("customer"), COMPANIES))


# --- sinks -----------------------------------------------------------------------------------


@query(
    "k1_insert_if_absent", "trades",
    """SELECT accession_number, trade_id, total_value FROM (SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY trade_id) AS rn FROM trades) WHERE rn = 1
    AND accession_number NOT IN (SELECT accession_number FROM trades WHERE transaction_date < DATE '1996-01-01')""",
)
def k1(t):
    seen = t.trades.filter("transaction_date < DATE'1996-01-01'")
    return W.absent_rows(t.trades, seen, ["accession_number"], [F.col("trade_id")]).select("accession_number", "trade_id", "total_value")


@query(
    "k1_touch_present", "catalysts",
    """s AS (SELECT symbol, drug_name, event_date, min(row_id) AS row_id FROM catalysts GROUP BY 1, 2, 3)
    SELECT s.symbol, s.drug_name, s.event_date, CASE WHEN n.symbol IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS scraped_at FROM s
    LEFT JOIN (SELECT DISTINCT symbol, drug_name, event_date FROM catalysts WHERE outcome IS NULL) n ON n.symbol = s.symbol AND n.drug_name = s.drug_name AND n.event_date = s.event_date""",
)
def k1b(t):
    keys = ["symbol", "drug_name", "event_date"]
    stored = t.catalysts.select(*keys).distinct().withColumn("scraped_at", as_ts("2024-01-01 00:00:00"))
    return W.touch_present(stored, t.catalysts.filter("outcome IS NULL"), keys, "scraped_at", as_ts("2024-02-01 00:00:00"))


@query(
    "k2_upsert", "tickers",
    """i AS (SELECT concat('S', c_custkey) AS symbol, c_name AS name, c_mktsegment AS sector FROM customer WHERE c_acctbal > 0)
    SELECT coalesce(t.symbol, i.symbol) AS symbol, coalesce(i.name, t.name) AS name, coalesce(i.sector, t.sector) AS sector, CASE WHEN t.symbol IS NOT NULL THEN t.is_active ELSE true END AS is_active FROM tickers t FULL JOIN i ON i.symbol = t.symbol""",
)
def k2(t):
    incoming = t.raw("customer").filter("c_acctbal > 0").selectExpr("concat('S', c_custkey) AS symbol", "c_name AS name", "c_mktsegment AS sector")
    target = t.tickers.select("symbol", "name", "sector", "is_active")
    return W.upsert(target, incoming, ["symbol"], ["name", "sector"], {"is_active": F.lit(True)})


@query(
    "k3_backfill_plan", "trades",
    """p AS (SELECT DISTINCT concat('A', o_orderkey) AS acc FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT trade_id, CASE WHEN p.acc IS NOT NULL AND is_plan IS DISTINCT FROM true THEN true ELSE is_plan END AS is_plan, p.acc IS NOT NULL AND is_plan IS DISTINCT FROM true AS updated FROM trades LEFT JOIN p ON p.acc = split_part(accession_number, '_', 1)""",
)
def k3(t):
    listed = t.raw("orders").filter("o_orderpriority = '1-URGENT'").selectExpr("concat('A', o_orderkey) AS accession")
    return W.backfill_plan(t.trades, listed).select("trade_id", "is_plan", "updated")


_LOG_NOW = "TIMESTAMP '2024-02-15'"


@query(
    "k4_retained_logs", "system_logs",
    f"SELECT id, level FROM system_logs WHERE NOT coalesce((level = 'debug' AND created_at < {_LOG_NOW} - INTERVAL 20 DAY) OR ((level IS NULL OR level = 'info') AND created_at < {_LOG_NOW} - INTERVAL 25 DAY) OR (level IN ('warn', 'error') AND created_at < {_LOG_NOW} - INTERVAL 30 DAY), false)",
)
def k4(t):
    return W.retained_logs(t.system_logs, as_ts("2024-02-15 00:00:00"), {"debug": 20, "info": 25, "warn_error": 30}).select("id", "level")


@query(
    "k4_expired_counts", "system_logs",
    f"""SELECT CASE WHEN level = 'debug' THEN 'debug' WHEN level IN ('warn', 'error') THEN 'warn_error' ELSE 'info' END AS tier, count(*) AS deleted FROM system_logs
    WHERE (level = 'debug' AND created_at < {_LOG_NOW} - INTERVAL 2 DAY) OR ((level IS NULL OR level = 'info') AND created_at < {_LOG_NOW} - INTERVAL 7 DAY) OR (level IN ('warn', 'error') AND created_at < {_LOG_NOW} - INTERVAL 30 DAY) GROUP BY 1""",
)
def k4b(t):
    return W.expired_counts(t.system_logs, as_ts("2024-02-15 00:00:00"))


def _signed(value: str) -> str:
    """Two digits with a sign, halves away from zero on the decimal digits."""
    return f"CASE WHEN {value} < 0 THEN '-' ELSE '+' END || CAST(CAST(round(abs(CAST({value} AS DECIMAL(18, 3))), 2) AS DECIMAL(18, 2)) AS VARCHAR)"


_CELL = f"""trim(concat_ws(' ', 'N=' || n, {_signed('avg_return_pct')} || '%', 'd=' || {_signed('effect_size_d')}, CASE WHEN significant_bonferroni THEN '✓✓✓' WHEN p_value < 0.01 THEN '✓✓' WHEN p_value < 0.05 THEN '✓' ELSE '' END))"""


@query(
    "k5_report_table", "trades prices",
    FULL_RUN + f""", cells AS (SELECT sub_group, direction, horizon, {_CELL} AS cell FROM full_stats)
    SELECT '| ' || sub_group || ' | ' || concat_ws(' | ', {', '.join(f"coalesce(max(cell) FILTER (horizon = '{h}'), '—')" for h in ('1d', '3d', '7d', '30d'))}) || ' |' AS value FROM cells GROUP BY sub_group, direction""",
    recursive=True,
)
def k5(t):
    from tidewatch.operators import study as E

    return W.markdown_lines(W.report_table(E.full_run(t.trades, t.stored_prices)))


@query("k6_archive_by_age", "alerts", "SELECT id, archived OR sent_at < TIMESTAMP '2024-01-10' AS archived, sent_at < TIMESTAMP '2024-01-10' AND NOT archived AS affected FROM alerts")
def k6(t):
    return W.archive(t.alerts, older_than=as_ts("2024-01-10 00:00:00")).select("id", "archived", "affected")


@query("k6_archive_by_ids", "alerts", "SELECT id, archived OR symbol = 'S3' AS archived, symbol = 'S3' AS affected FROM alerts")
def k6b(t):
    return W.archive(t.alerts, ids=t.alerts.filter("symbol = 'S3'")).select("id", "archived", "affected")


@query("k7_backfill_selection", "filings", "SELECT accession, filing_date FROM filings WHERE form_type = '8-K' AND NOT analyzed ORDER BY filing_date DESC, accession DESC LIMIT 50")
def k7(t):
    return W.backfill_selection(t.filings).select("accession", "filing_date")


@query("k9_reset_analysis", "filings", "SELECT accession, CASE WHEN accession = 'F5' THEN false ELSE analyzed END AS analyzed, CASE WHEN accession <> 'F5' THEN direction END AS direction FROM filings")
def k9(t):
    return W.reset_analysis(t.filings, "F5")[0].select("accession", "analyzed", "direction")


@query(
    "st9_index_reconciliation", "trades",
    """x AS (SELECT DISTINCT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, concat('A', o_orderkey) AS accession FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
    SELECT accession FROM x WHERE accession NOT IN (SELECT accession FROM trades WHERE transaction_type = 'BUY')""",
)
def st9(t):
    """Accessions of the daily index that the live flow has not seen."""
    from tidewatch.operators.feeds import drop_known

    index = S.daily_index_rows(_docs(t.raw("orders"), INDEX_LINE))
    key = F.regexp_extract("accession", r"^0*(\d+?)-", 1)
    indexed = index.select(F.concat(F.lit("A"), key).alias("accession")).distinct()
    return drop_known(indexed, t.trades.filter("transaction_type = 'BUY'").select("accession").distinct(), ["accession"])
