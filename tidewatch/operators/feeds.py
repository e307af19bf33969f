"""Joins and set operations between feeds, tickers, filings and trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.text import ascii_words
from tidewatch.operators.reports import before
from tidewatch.operators.temporal import first_k


def ticker_funnel(tickers: DataFrame, filings: DataFrame, alerts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Filings and alerts per ticker; each side is aggregated before the join."""
    f = filings.filter(F.col("filing_date") > before(as_of, days=days)).groupBy("cik").agg(
        F.count_distinct("accession").alias("filings"),
        F.count_distinct(F.when(F.col("analyzed"), F.col("accession"))).alias("analyzed"),
    )
    a = alerts.filter(F.col("sent_at") > before(as_of, days=days)).groupBy("symbol").agg(
        F.count_distinct("id").alias("alerts"),
        F.count_distinct(F.when(F.col("delivered"), F.col("id"))).alias("delivered"),
    )
    joined = tickers.select("symbol", "cik").join(f, "cik", "left").join(a, "symbol", "left")
    return joined.select("symbol", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("filings", "analyzed", "alerts", "delivered")])


def trades_with_filing(trades: DataFrame, filings: DataFrame) -> DataFrame:
    """Trade to filing over the accession without its row suffix."""
    base = F.regexp_replace("accession_number", r"_\d+$", "")
    return trades.withColumn("filing_accession", base).join(
        filings.select(F.col("accession").alias("filing_accession"), "form_type", "filing_status"), "filing_accession", "left"
    )


def drop_known(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(known.select(*keys), list(keys), "left_anti")


def rule_lookup(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Active rule of each alert or the skip reason."""
    active = rules.filter("is_active").select(F.col("name").alias("rule_name"), "throttle_minutes")
    return alerts.join(active, "rule_name", "left").withColumn(
        "lookup", F.when(F.col("throttle_minutes").isNull(), "SKIP_NO_RULE").otherwise("FOUND")
    )


def select_estimates(reports: DataFrame, estimates: DataFrame, as_of: Column) -> DataFrame:
    """Estimate of the reported period, else the earliest one from ``as_of`` on, else null."""

    def finite(name: str) -> Column:
        c = F.col(name)
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)

    est = estimates.select("symbol", "date", finite("eps_estimate"), finite("revenue_estimate"), "analysts")
    payload = F.struct("date", "eps_estimate", "revenue_estimate", "analysts")
    forward = est.filter(F.col("date") >= F.to_date(as_of)).groupBy("symbol").agg(
        F.min_by(payload, F.struct("date", "analysts")).alias("fwd")
    )
    matched = est.groupBy("symbol", F.col("date").alias("period")).agg(
        F.min_by(payload, F.struct("date", "analysts")).alias("same")
    )
    out = reports.join(matched, ["symbol", "period"], "left").join(forward, "symbol", "left")
    pick = F.coalesce("same", "fwd")
    return out.select(
        *reports.columns,
        pick["eps_estimate"].alias("eps_estimate"),
        pick["revenue_estimate"].alias("revenue_estimate"),
        pick["analysts"].alias("analysts"),
        F.when(F.col("same").isNotNull(), "matched").when(F.col("fwd").isNotNull(), "forward").alias("source"),
    )


def replay_summary(rows: DataFrame) -> DataFrame:
    """Source shares and absolute estimate differences of a replay."""
    diff = F.when(F.col("other_estimate") != 0, (F.col("eps_estimate") - F.col("other_estimate")) / F.abs("other_estimate") * 100)
    d = F.abs(diff)
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("source") == "matched").alias("matched"),
        F.count_if(F.col("source") == "forward").alias("forward"),
        F.count_if(F.col("source").isNull()).alias("missing"),
        F.count(d).alias("both_available"),
        F.round(F.avg(d), 4).alias("mean_abs_diff"),
        F.round(F.max(d), 4).alias("max_abs_diff"),
    )


def recent_history(trades: DataFrame, days: int = 30, last: int = 20) -> DataFrame:
    """Newest trades of the same symbol before each filing, without the filing's own rows.

    The limit applies before the filing's rows are dropped.  Per (symbol, date) at most ``last`` rows can matter, so the
    look-back runs over that reduced daily table.  Filings stand in the same line as the days, cut into stretches that begin
    with the days before them, so no history travels to its filings.
    """
    day, width = F.unix_date("transaction_date"), 3 * days
    known = trades.filter("symbol IS NOT NULL AND transaction_date IS NOT NULL").select("symbol", "transaction_date", "trade_id", "accession")
    top = first_k(known, ["symbol", "transaction_date"], [F.desc("trade_id")], last)
    daily = top.groupBy("symbol", "transaction_date").agg(F.collect_list(F.struct("transaction_date", "trade_id", "accession")).alias("rows"))
    daily = daily.withColumn("stretch", F.explode(F.sequence(F.floor(day / width), F.floor((day + days - 1) / width))))
    bundle = F.pmod(F.xxhash64("accession"), F.lit(4))  # a day's filings share few rows, as each row works out its history
    filed = known.repartition("symbol", "transaction_date").groupBy("symbol", "transaction_date", bundle.alias("bundle")).agg(
        F.collect_set(F.struct("accession")).alias("filings")
    ).withColumn("stretch", F.floor(day / width)).drop("bundle")
    span = Window.partitionBy("symbol", "stretch").orderBy(day).rangeBetween(-(days - 1), 0)
    line = daily.unionByName(filed, allowMissingColumns=True).withColumn("seen", F.collect_list("rows").over(span)).filter("filings IS NOT NULL")
    newest = F.slice(F.sort_array(F.flatten("seen"), asc=False), 1, last)
    each = line.select("symbol", F.col("transaction_date").alias("day"), newest.alias("history"), F.explode("filings").alias("f"))
    history = each.select("symbol", "day", "f.accession", F.filter("history", lambda h: h["accession"] != F.col("f.accession")).alias("h"))
    return history.select("symbol", "day", "accession", F.posexplode("h").alias("pos", "h")).select(
        "symbol", "day", "accession", "pos", F.col("h.trade_id").alias("history_trade_id"), F.col("h.transaction_date").alias("history_date")
    )


def plan_flags(trades: DataFrame, flags: DataFrame) -> DataFrame:
    """Audited flag per accession (first known), default 'missing'."""
    known = flags.filter(F.col("flag").isNotNull()).groupBy("accession").agg(
        F.min_by("flag", "pos").alias("flag"), F.min_by("url", F.when(F.col("url") != "", F.col("pos"))).alias("url")
    )
    return trades.join(known, "accession", "left").withColumn("flag", F.coalesce("flag", F.lit("missing")))


def plan_audit(flagged: DataFrame) -> DataFrame:
    """Plan, discretionary and failed look-ups per transaction type with the plan value."""
    plan = F.col("flag") == "plan"
    n_plan = F.count_if(plan)
    return flagged.groupBy("transaction_type").agg(
        F.count("*").alias("n"),
        n_plan.alias("n_plan"),
        F.count_if(F.col("flag") == "discretionary").alias("n_discretionary"),
        F.count_if(F.col("flag").isin("fail", "no_url", "missing")).alias("n_fail"),
        F.round(n_plan * 100.0 / F.count("*"), 1).alias("plan_pct"),
        F.sum(F.when(plan, F.col("total_value").cast("decimal(15,2)"))).cast("double").alias("plan_value"),
    )


def plan_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("transaction_type").agg(F.count_if("is_plan").alias("plan_rows"), F.count("*").alias("total"))


def filing_groups(trades: DataFrame) -> DataFrame:
    """Trades of one filing, insider, type and plan flag as one aggregate event."""
    keys = ["accession", "insider_name", "transaction_type", "is_plan"]
    order = F.struct("idx", "trade_id")
    out = trades.groupBy(*keys).agg(
        F.sum(F.col("total_value").cast("decimal(15,2)")).cast("double").alias("total_value"),
        F.sum("shares").alias("shares"),
        F.min_by("trade_id", order).alias("primary_trade"),
        F.max_by("shares_after", order).alias("shares_after"),
        F.min_by("price_per_share", order).alias("first_price"),
        F.count("*").alias("n"),
    )
    weighted = F.when((F.col("n") > 1) & (F.col("shares") > 0), F.col("total_value") / F.col("shares"))
    return out.withColumn("price", F.coalesce(weighted, "first_price")).drop("first_price")


def filing_group_members(trades: DataFrame) -> DataFrame:
    """Trade to group mapping, kept as rows because a group has no size bound."""
    keys = ["accession", "insider_name", "transaction_type", "is_plan"]
    primary = filing_groups(trades).select(*keys, "primary_trade").withColumnRenamed("is_plan", "__plan")
    rows = trades.select(*keys, "trade_id")
    same = [rows[k] == primary[k] for k in keys[:3]] + [rows["is_plan"].eqNullSafe(primary["__plan"])]
    return rows.join(primary, same).select("trade_id", "primary_trade")


def universe_overlap(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each symbol with the side(s) it occurs on."""
    a, b = ours.select("symbol").distinct(), theirs.select("symbol").distinct()
    return (
        a.intersect(b).withColumn("side", F.lit("both"))
        .unionByName(a.subtract(b).withColumn("side", F.lit("only_ours")))
        .unionByName(b.subtract(a).withColumn("side", F.lit("only_theirs")))
    )


def overlap_summary(overlap: DataFrame) -> DataFrame:
    both, ours, theirs = (F.count_if(F.col("side") == s) for s in ("both", "only_ours", "only_theirs"))
    return overlap.agg(
        both.alias("both"), ours.alias("only_ours"), theirs.alias("only_theirs"),
        F.round(both * 100.0 / (both + ours), 1).alias("pct_of_ours"),
        F.round(both * 100.0 / (both + theirs), 1).alias("pct_of_theirs"),
    )


def new_symbols(current: DataFrame, stored: DataFrame) -> DataFrame:
    return current.select("symbol").distinct().subtract(stored.select("symbol"))


def observation_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """What is new since the stored state: symbols and the highest id."""
    fresh = new_symbols(current, stored).agg(F.count("*")).scalar()
    return current.agg(F.max("id").alias("max_id"), F.count("*").alias("rows")).withColumn(
        "stored_max_id", stored.agg(F.max("id")).scalar()
    ).withColumn("new_symbols", fresh).withColumn("advanced", F.col("max_id") > F.col("stored_max_id"))


def data_profile(trades: DataFrame) -> DataFrame:
    return trades.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("transaction_type") == "BUY").alias("buys"),
        F.count_if(F.col("transaction_type") == "SELL").alias("sells"),
        F.count_if("is_plan").alias("plan_rows"),
        F.count_if("is_csuite").alias("csuite_rows"),
        F.count_if("is_healthcare").alias("healthcare_rows"),
        F.count_distinct("symbol").alias("symbols"),
    )


def mention_symbols(mentions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(mention, symbol) pairs: cashtags plus bare upper-case words that are known symbols.

    Bodies are tokenised once and joined on the symbol; no pattern per symbol.
    """
    words = F.regexp_extract_all("body", F.lit(ascii_words(r"\b[A-Z][A-Z0-9]*\b")), F.lit(0))
    dotted = F.regexp_extract_all("body", F.lit(ascii_words(r"\b[A-Z][A-Z0-9]*(?:[.-][A-Z0-9]+)+\b")), F.lit(0))
    tags = F.transform(
        F.regexp_extract_all("body", F.lit(ascii_words(r"\$[A-Z][A-Z0-9]{0,5}\b")), F.lit(0)),
        lambda w: F.substring(w, 2, 6),
    )
    exploded = mentions.select("external_id", F.explode(F.array_distinct(F.concat(tags, words, dotted))).alias("symbol"))
    return exploded.join(symbols.select("symbol").distinct(), "symbol").select("external_id", "symbol")


def union_signals(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order."""
    return first_k(df, keys, order, 1)


def contract_cap(contracts: DataFrame, keep: Column, position: str, cap: int = 50) -> DataFrame:
    """First ``cap`` contracts per symbol in source order after the filter."""
    return first_k(contracts.filter(keep), ["symbol"], [F.col(position)], cap)
