"""Landed feed documents to rows.

Every parser takes a DataFrame with one document per row, as ``spark.read.text`` with
``wholetext``, ``spark.read.json`` or a stream delivers it, and explodes inside that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch import schemas
from tidewatch.functions import text as X


def _date(c: Column) -> Column:
    """Malformed dates are null, not an error."""
    return c.try_cast("date")


def _truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1")


# --- CSV -----------------------------------------------------------------------------------


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return clean_transactions(spark.read.schema(schemas.TRANSACTIONS_CSV).option("header", True).csv(path))


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Drop rows with dates outside 20xx, coerce the flag strings."""
    dated = raw.filter(F.col("transaction_date").rlike(r"^20\d{2}-") & F.col("filing_date").rlike(r"^20\d{2}-"))
    flags = [c for c in raw.columns if c.startswith("is_")]
    dates = {c: _date(F.col(c)) for c in ("transaction_date", "filing_date")}
    return dated.withColumns({**{c: _truthy(F.col(c)) for c in flags}, **dates})


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """One CSV per symbol to a long table; the symbol is the file name."""
    rows = spark.read.schema(schemas.PRICES_CSV).option("header", True).csv(path)
    return price_rows(rows.withColumn("symbol", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)))


def price_rows(rows: DataFrame) -> DataFrame:
    """Zoned timestamps become their UTC date."""
    return rows.select("symbol", F.to_date(F.col("Date").try_cast("timestamp")).alias("date"), F.col("Close").alias("close")).filter(
        "close IS NOT NULL"
    )


# --- JSON ----------------------------------------------------------------------------------


def universe_rows(docs: DataFrame, priorities: dict[str, str], sector: str, observation_only: bool = False) -> DataFrame:
    """Groups of companies to ticker rows; the priority comes from the group map."""
    table = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv]) if priorities else None
    group = docs.select(F.explode(F.from_json("value", schemas.UNIVERSE_JSON)["tickers"]).alias("grp", "g"))
    rows = group.select("grp", F.explode("g.companies").alias("c"))
    by_group = table[F.col("grp")] if table is not None else F.lit(None).cast("string")
    return rows.select(
        "c.symbol", "c.name", "c.cik", F.coalesce("c.subsector", "grp").alias("subsector"),
        F.coalesce(by_group, F.lit("MEDIUM")).alias("priority"), "c.aliases", "c.keyMetrics",
        F.lit(sector).alias("sector"), F.lit(observation_only).alias("observation_only"),
    )


def universe_rules(docs: DataFrame) -> DataFrame:
    rule = docs.select(F.explode(F.from_json("value", schemas.UNIVERSE_JSON)["rules"]).alias("r"))
    return rule.select(
        "r.name", "r.priority", F.coalesce("r.throttle_minutes", F.lit(15)).alias("throttle_minutes"),
        F.coalesce("r.is_active", F.lit(True)).alias("is_active"),
    )


def submission_filings(
    docs: DataFrame, as_of: Column, forms: Sequence[str] = ("4", "8-K"), days: int = 7, limit: int | None = 100, base: str = ""
) -> DataFrame:
    """Parallel arrays to filing rows: whitelisted forms before the first too-old row.

    Only the first ``limit`` entries of a batch count; ``limit=None`` reads recent and
    older batches whole (the study's variant).
    """
    f = F.col("s.filings")
    docs = docs.select(F.from_json("value", schemas.SUBMISSIONS_JSON).alias("s"))
    batches = F.array(f["recent"])
    if limit is None:
        batches = F.concat(batches, F.coalesce(f["older"], F.array()))
    rows = docs.select("s.cik", "s.symbol", F.posexplode(batches).alias("batch", "b"))
    zipped = F.arrays_zip("b.form", "b.filingDate", "b.accessionNumber", "b.primaryDocument")
    if limit is not None:
        zipped = F.slice(zipped, 1, limit)
        old = F.to_date(as_of) - F.expr(f"INTERVAL {days} DAYS")
        first_old = F.array_position(F.transform(zipped, lambda z: _date(z["filingDate"]) < F.to_date(old)), True)
        zipped = F.when(first_old > 0, F.slice(zipped, 1, first_old.cast("int") - 1)).otherwise(zipped)
    rows = rows.select("cik", "symbol", "batch", F.posexplode(zipped).alias("pos", "z"))
    rows = rows.select("cik", "symbol", "batch", "pos", "z.*").filter(F.col("form").isin(*forms))
    folder = F.concat(F.lit(base), F.regexp_replace("cik", "^0+(?=[0-9])", ""), F.lit("/"), F.replace(F.col("accessionNumber"), F.lit("-"), F.lit("")))
    document = F.coalesce("primaryDocument", F.lit(""))
    url = F.when((F.col("form") == "4") | (document == ""), folder).otherwise(F.concat(folder, F.lit("/"), document))
    return rows.select(
        "cik", "symbol", "batch", "pos", F.col("form").alias("form_type"), _date(F.col("filingDate")).alias("filing_date"),
        F.col("accessionNumber").alias("accession"), url.alias("document_url"),
    )


# Transaction codes.
CODES = {"P": "BUY", "S": "SELL", "A": "GRANT", "M": "EXERCISE", "F": "TAX", "G": "GIFT"}


def spread_documents(docs: DataFrame, key: str = "accession") -> DataFrame:
    """Documents dealt out by their key, so that parsing does not depend on how files were landed."""
    return docs.repartition(key)


def form4_transactions(docs: DataFrame, study: bool = False, spread: bool = True) -> DataFrame:
    """Ownership XML (``accession``, ``value``) to one row per transaction, non-derivative first.

    ``spread`` deals the documents out first; leave it off for feeds landed in many files of like size.  ``study`` keeps prices of zero, knows conversions and does not round the value.
    """
    codes = {**CODES, **({"C": "CONVERSION"} if study else {})}
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    docs = spread_documents(docs) if spread else docs
    d = docs.select("accession", F.from_xml("value", schemas.FORM4_XML).alias("d"))
    none = F.array().cast("array<string>")
    owners = F.coalesce("d.reportingOwner", F.array())
    names = F.transform(
        owners,
        lambda o: F.coalesce(o["reportingOwnerId"]["rptOwnerName"], o["reportingOwnerId"]["rptOwnerCik"], F.lit("Unknown")),
    )
    rel = "reportingOwnerRelationship"
    roles = F.transform(
        owners,
        lambda o: X.owner_role(o[rel]["officerTitle"], o[rel]["isOfficer"], o[rel]["isDirector"], o[rel]["isTenPercentOwner"]),
    )
    single = F.size(owners) == 1
    txns = F.concat(
        F.coalesce("d.nonDerivativeTable.nonDerivativeTransaction", F.array()),
        F.coalesce("d.derivativeTable.derivativeTransaction", F.array()),
    )
    d = d.select(
        "accession",
        F.when(F.size(owners) == 0, "Unknown").otherwise(X.merge_owner_names(F.coalesce(names, none))).alias("insider_name"),
        F.when(single, F.get(roles, F.lit(0))).otherwise(X.merge_owner_roles(roles)).alias("insider_role"),
        F.coalesce(F.lower(F.trim("d.aff10b5One")).isin("1", "true", "y"), F.lit(False)).alias("doc_plan"),
        txns.alias("txns"),
    )

    def fields(t: Column) -> Column:
        coding, amounts = t["transactionCoding"], t["transactionAmounts"]
        tag = F.coalesce(coding["Rule10b5-1Transaction"], coding["rule10b51Transaction"], F.lit(""))
        return F.struct(
            coding["transactionCode"].alias("code"),
            F.upper(tag).isin("1", "Y").alias("tag"),
            F.abs(F.coalesce(amounts["transactionShares"]["value"].try_cast("double"), F.lit(0.0))).alias("shares"),
            amounts["transactionPricePerShare"]["value"].try_cast("double").alias("price"),
            t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"].try_cast("double").alias("after"),
            _date(F.substring(t["transactionDate"]["value"], 1, 10)).alias("day"),
        )

    # the stored index counts the kept transactions of a document, so they are filtered before the explode
    kept = F.filter(F.transform("txns", fields), lambda x: (x["shares"] != 0) & x["day"].isNotNull())
    rows = d.select("accession", "insider_name", "insider_role", "doc_plan", F.posexplode(kept).alias("idx", "t"))
    price = F.col("t.price") if study else F.when(F.col("t.price") != 0, F.col("t.price"))
    value = F.coalesce(F.col("t.shares") * price, F.lit(0.0))
    return rows.select(
        F.concat_ws("_", "accession", F.col("idx").cast("string")).alias("accession_number"),
        "accession",
        "idx",
        "insider_name",
        "insider_role",
        F.coalesce(table[F.col("t.code")], F.lit("OTHER")).alias("transaction_type"),
        F.col("t.shares").alias("shares"),
        price.alias("price_per_share"),
        (value if study else F.round(value, 2)).alias("total_value"),
        F.col("t.day").alias("transaction_date"),
        (F.col("doc_plan") | F.col("t.tag")).alias("is_plan"),
        F.when(F.col("t.after") != 0, F.col("t.after")).alias("shares_after"),
    )


def calendar_rows(pages: DataFrame) -> DataFrame:
    """Decision-calendar HTML to rows: table rows with five cells, a date and a ticker."""
    body = F.regexp_extract_all("value", F.lit(r"(?is)<tbody[^>]*>(.*?)</tbody>"), F.lit(1))
    trs = F.flatten(F.transform(body, lambda b: F.regexp_extract_all(b, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))))
    cell = lambda tr: F.transform(
        F.regexp_extract_all(tr, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)),
        lambda td: F.regexp_replace(F.regexp_replace(td, r"<[^>]+>", ""), r"^\s+|\s+$", ""),
    )
    keep = [c for c in pages.columns if c != "value"]
    rows = pages.select(*keep, F.explode(trs).alias("tr")).select(*keep, cell(F.col("tr")).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    rows = rows.filter((F.size("c") >= 5) & at(0).rlike(r"^\d{4}-\d{2}-\d{2}$") & (at(1) != ""))
    return rows.select(
        *keep, _date(at(0)).alias("event_date"), F.upper(at(1)).alias("symbol"), at(2).alias("drug_name"),
        at(3).alias("indication"), at(4).alias("area"),
    )


def atom_entries(docs: DataFrame) -> DataFrame:
    """Filing feed to issuer rows; the first entry of an accession wins within a document."""
    entries = F.regexp_extract_all("value", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    parsed = F.transform(
        entries,
        lambda e, i: F.struct(
            i.alias("pos"),
            F.regexp_extract(e, r"accession-number=(\d{10}-\d{2}-\d{6})", 1).alias("accession"),
            F.regexp_extract(e, r"<title>4 - (.*?) \((\d{10})\) \(Issuer\)</title>", 1).alias("issuer_name"),
            F.regexp_extract(e, r"<title>4 - (.*?) \((\d{10})\) \(Issuer\)</title>", 2).alias("cik"),
            F.regexp_extract(e, r"Filed:&lt;/b&gt;\s*(\d{4}-\d{2}-\d{2})", 1).alias("filed"),
        ),
    )
    keep = [c for c in docs.columns if c != "value"]
    rows = docs.select(*keep, F.explode(parsed).alias("e")).select(*keep, "e.*").filter("accession <> '' AND cik <> ''")
    first = rows.groupBy(*keep, "accession").agg(F.min_by(F.struct("issuer_name", "cik", "filed"), "pos").alias("f"))
    return first.select(*keep, "accession", "f.issuer_name", "f.cik", _date(F.col("f.filed")).alias("filed_date"))


def daily_index_rows(lines: DataFrame) -> DataFrame:
    """Index lines of form type exactly 4; the date is optional.  Owners and issuers both appear."""
    rx = r"(\d{8})?\s+edgar/data/(\d+)/(\d{10}-\d{2}-\d{6})\.txt\s*$"
    hit = lines.filter(F.col("value").startswith("4 ") & F.col("value").rlike(rx))
    day = F.nullif(F.regexp_extract("value", rx, 1), F.lit(""))
    return hit.select(
        *[c for c in lines.columns if c != "value"],
        F.lpad(F.regexp_extract("value", rx, 2), 10, "0").alias("cik"),
        F.regexp_extract("value", rx, 3).alias("accession"),
        F.to_date(F.try_to_timestamp(day, F.lit("yyyyMMdd"))).alias("filed_date"),
    )


def stocktwits_mentions(docs: DataFrame) -> DataFrame:
    m = docs.select("symbol", F.explode(F.from_json("value", schemas.STOCKTWITS_JSON)["messages"]).alias("m"))
    mood = F.col("m.entities.sentiment.basic")
    return m.select(
        F.concat(F.lit("st_"), "m.id").alias("external_id"), "symbol", F.lit("stocktwits").alias("source"), F.col("m.body").alias("body"),
        F.when(mood.isin("Bullish", "Bearish"), mood).alias("sentiment"), F.col("m.created_at").try_cast("timestamp").alias("published_at"),
    )


def reddit_mentions(docs: DataFrame, text_limit: int = 2000) -> DataFrame:
    """Posts to mentions; the stored body is the title and the first part of the text."""
    p = docs.select(F.explode(F.from_json("value", schemas.REDDIT_JSON)["data"]["children"]).alias("c")).select("c.data.*")
    body = F.concat_ws("\n", "title", F.nullif(F.substring(F.coalesce("selftext", F.lit("")), 1, text_limit), F.lit("")))
    return p.select(
        F.concat(F.lit("reddit_"), "id").alias("external_id"), F.lit("reddit").alias("source"), body.alias("body"),
        F.timestamp_seconds("created_utc").alias("published_at"),
    )


def news_articles(docs: DataFrame) -> DataFrame:
    a = docs.select("symbol", F.explode(F.from_json("value", schemas.NEWS_JSON)).alias("a"))
    return a.select(
        "symbol", "a.headline", "a.source", "a.url", "a.category", F.timestamp_seconds("a.datetime").alias("published_at")
    ).filter("url IS NOT NULL AND url <> ''")


def monthly_sentiment(docs: DataFrame) -> DataFrame:
    """Monthly insider sentiment as pseudo trades."""
    d = docs.select(F.from_json("value", schemas.MSPR_JSON).alias("d")).select("d.symbol", F.explode("d.data").alias("m"))
    return d.select(
        F.concat_ws("_", F.lit("mspr"), "symbol", F.col("m.year").cast("string"), F.col("m.month").cast("string")).alias("accession_number"),
        "symbol", F.when(F.col("m.mspr") > 0, "BUY").otherwise("SELL").alias("transaction_type"), F.abs("m.change").alias("shares"),
        F.make_date("m.year", "m.month", F.lit(1)).alias("transaction_date"),
    )


def option_contracts(docs: DataFrame) -> DataFrame:
    c = docs.select(F.posexplode(F.from_json("value", schemas.CONTRACTS_JSON)["results"]).alias("position", "c"))
    return c.select(
        "position", F.col("c.ticker").alias("occ"), F.col("c.underlying_ticker").alias("symbol"), F.col("c.contract_type").alias("option_type"),
        F.col("c.strike_price").alias("strike"), _date(F.col("c.expiration_date")).alias("expiry"),
    )


def option_bars(docs: DataFrame) -> DataFrame:
    b = docs.select(F.from_json("value", schemas.BARS_JSON).alias("d")).select("d.ticker", F.explode("d.results").alias("b"))
    return b.select(
        F.col("ticker").alias("occ"), F.to_date(F.timestamp_millis("b.t")).alias("session"), F.col("b.v").cast("long").alias("volume"),
        F.col("b.c").alias("close"),
    )


def earnings_actuals(docs: DataFrame) -> DataFrame:
    """Latest reported period per symbol."""
    e = docs.select("symbol", F.explode(F.from_json("value", schemas.EARNINGS_JSON)).alias("e"))
    latest = e.groupBy("symbol").agg(F.max_by("e", F.coalesce("e.period", F.lit(""))).alias("e"))
    return latest.select("symbol", F.col("e.actual").alias("eps_actual"), F.col("e.estimate").alias("eps_estimate"), F.col("e.period").alias("period"))


def analyst_estimates(docs: DataFrame) -> DataFrame:
    d = docs.select(F.from_json("value", schemas.ESTIMATES_JSON).alias("d")).select("d.symbol", F.explode("d.estimates").alias("e"))
    number = lambda c, t: F.expr(f"try_cast(e.{c} AS {t})")
    return d.filter("e.horizon = 'fiscal quarter'").select(
        "symbol", _date(F.col("e.date")).alias("date"), number("eps_estimate_average", "DOUBLE").alias("eps_estimate"),
        number("revenue_estimate_average", "DOUBLE").alias("revenue_estimate"), number("revenue_estimate_analyst_count", "INT").alias("analysts"),
    )


def company_rows(docs: DataFrame, exchanges: Sequence[str] = ("NYSE", "Nasdaq", "NYSE Arca", "OTC")) -> DataFrame:
    """Column-oriented company list; positions come from the field names."""
    d = docs.select(F.from_json("value", schemas.COMPANIES_JSON).alias("d")).select("d.fields", F.explode("d.data").alias("r"))
    col = lambda name: F.get("r", F.array_position("fields", name).cast("int") - 1)
    rows = d.select(col("cik").alias("cik"), col("name").alias("name"), col("ticker").alias("ticker"), col("exchange").alias("exchange"))
    return rows.filter(F.col("exchange").isin(*exchanges))
