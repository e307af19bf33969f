"""Explicit schemas of the landed feeds; nothing is inferred."""

from __future__ import annotations

TRANSACTIONS_CSV = (
    "symbol string, filing_date string, transaction_date string, insider_name string, insider_role string, officer_title string, "
    "is_officer string, is_director string, is_ten_pct_owner string, transaction_type string, shares double, price_per_share double, "
    "total_value double, shares_owned_after double, is_10b51_plan string, is_csuite string, is_healthcare string, accession_number string"
)
PRICES_CSV = "Date string, Close double"
UNIVERSE_JSON = (
    "tickers map<string, struct<companies: array<struct<symbol: string, name: string, cik: string, subsector: string, priority: string, "
    "aliases: array<string>, keyMetrics: array<string>>>>>, "
    "rules array<struct<name: string, priority: string, throttle_minutes: int, is_active: boolean>>"
)
_BATCH = "form: array<string>, filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>"
SUBMISSIONS_JSON = f"cik string, symbol string, filings struct<recent: struct<{_BATCH}>, older: array<struct<{_BATCH}>>>"
_TXN = (
    "array<struct<transactionDate: struct<value: string>, transactionCoding: struct<transactionCode: string, `Rule10b5-1Transaction`: string, rule10b51Transaction: string>, "
    "transactionAmounts: struct<transactionShares: struct<value: string>, transactionPricePerShare: struct<value: string>>, "
    "postTransactionAmounts: struct<sharesOwnedFollowingTransaction: struct<value: string>>>>"
)
FORM4_XML = (
    "aff10b5One string, reportingOwner array<struct<reportingOwnerId: struct<rptOwnerName: string, rptOwnerCik: string>, "
    "reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, isTenPercentOwner: string, officerTitle: string>>>, "
    f"nonDerivativeTable struct<nonDerivativeTransaction: {_TXN}>, derivativeTable struct<derivativeTransaction: {_TXN}>"
)
STOCKTWITS_JSON = "messages array<struct<id: long, body: string, created_at: string, entities: struct<sentiment: struct<basic: string>>>>"
REDDIT_JSON = "data struct<children: array<struct<data: struct<id: string, title: string, selftext: string, created_utc: double>>>>"
NEWS_JSON = "array<struct<headline: string, source: string, url: string, category: string, datetime: long>>"
MSPR_JSON = "symbol string, data array<struct<year: int, month: int, change: double, mspr: double>>"
CONTRACTS_JSON = "results array<struct<ticker: string, underlying_ticker: string, contract_type: string, strike_price: double, expiration_date: string>>"
BARS_JSON = "ticker string, results array<struct<v: double, o: double, h: double, l: double, c: double, t: long>>"
EARNINGS_JSON = "array<struct<actual: double, estimate: double, period: string>>"
ESTIMATES_JSON = (
    "symbol string, estimates array<struct<date: string, horizon: string, eps_estimate_average: string, revenue_estimate_average: string, "
    "revenue_estimate_analyst_count: string>>"
)
COMPANIES_JSON = "fields array<string>, data array<array<string>>"
EVENTS = {
    "signals": "id string, ticker string, source_category string, conviction double, direction string, catalyst_type string, ts timestamp",
    "alerts": "id long, symbol string, rule_name string, delivered boolean, sent_at timestamp",
    "filings": "accession string, symbol string, form_type string, seen_at timestamp",
    "trades": "accession_number string, symbol string, transaction_type string, total_value double, seen_at timestamp",
    "mentions": "external_id string, source string, body string, published_at timestamp",
    "articles": "url string, headline string, published_at timestamp",
    "catalysts": "symbol string, drug_name string, event_date date, seen_at timestamp",
    "flows": "occ string, session date, volume long, seen_at timestamp",
    "anomalies": "symbol string, kind string, value double, threshold double, seen_at timestamp",
    "analyses": "accession string, symbol string, form_type string, conviction double, direction string, catalyst_type string, seen_at timestamp",
    "correlations": "ticker string, pattern string, direction string, conviction double, signal_ids array<string>, seen_at timestamp",
}
