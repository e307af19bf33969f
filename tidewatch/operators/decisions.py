"""Decision chains over insider trades and filings, throttles and delivery gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import scoring as S, text as X
from tidewatch.functions.calendar import ny_date
from tidewatch.operators.temporal import asof_join, first_k, flag_first_k, greedy_accept, micros

MINUTE_US = 60_000_000


def form4_actions(trades: DataFrame, tickers: DataFrame, day: str = "filing_date", daily_cap: int = 20) -> DataFrame:
    """Action of every trade: cheap skips, then the daily cap, then the observation gates.

    The cap counts only the rows that reach it; null action means the row goes on.
    """
    c = F.col
    rows = trades.withColumn("__csuite", S.is_csuite(c("insider_role"))).withColumn("__director", S.is_director(c("insider_role")))
    rows = rows.withColumn(
        "__early",
        S.form4_early_action(c("total_value"), c("transaction_type"), c("is_plan"), c("__csuite"), c("__director")),
    )
    early = rows.filter("__early IS NOT NULL").select("trade_id", "symbol", c("__early").alias("action"))
    passed = flag_first_k(rows.filter("__early IS NULL"), ["symbol", day], ["trade_id"], daily_cap, "__within")
    dim = tickers.select("symbol", "sector", "observation_only")
    late = passed.join(dim, "symbol", "left").withColumn(
        "action",
        F.when(~c("__within"), "SKIP_DAILY_CAP").otherwise(
            S.form4_sector_action(c("sector"), c("observation_only"), c("transaction_type"), c("total_value"))
        ),
    )
    return early.unionByName(late.select("trade_id", "symbol", "action"))


def discovery_prefilter(trades: DataFrame, min_value: float = 500_000) -> DataFrame:
    """Per filing: largest discretionary BUY sum of an insider with an executive or board role."""
    c = F.col
    order = F.struct("idx", "trade_id")
    buy = (c("transaction_type") == "BUY") & ~F.coalesce("is_plan", F.lit(False))
    per_insider = trades.filter(buy).groupBy("accession", "insider_name").agg(
        F.sum(c("total_value").cast("decimal(15,2)")).cast("double").alias("value"),
        F.min_by("insider_role", order).alias("role"),
        F.min(order).alias("__first"),
    )
    exec_role = S.is_csuite(c("role")) | S.is_director(c("role"))
    best = F.min_by(F.struct("insider_name", "role", "value"), F.when(exec_role, F.struct(-c("value"), c("__first"))))
    groups = per_insider.groupBy("accession").agg(best.alias("best"), F.lit(True).alias("has_buy"))
    out = trades.select("accession").distinct().join(groups, "accession", "left")
    value = c("best.value")
    reason = (
        F.when(c("has_buy").isNull(), "no_discretionary_buy").when(c("best").isNull(), "no_exec_role_buy")
        .when(value < min_value, "below_value_threshold").otherwise("ok")
    )
    return out.select(
        "accession", reason.alias("reason"), F.coalesce(value, F.lit(0.0)).alias("buy_value"),
        c("best.insider_name").alias("insider_name"), c("best.role").alias("insider_role"),
    )


def form4_scored(trades: DataFrame, tickers: DataFrame, analyses: DataFrame, strict_tier: Sequence[str] = ()) -> DataFrame:
    """Aligned and boosted conviction, priority, rule and flags of analysed trades."""
    c = F.col
    rows = trades.join(analyses, "trade_id").join(tickers.select("symbol", "sector", "observation_only"), "symbol", "left")
    is_buy = c("transaction_type") == "BUY"
    rows = rows.withColumn("__cs", S.is_csuite(c("insider_role"))).withColumn("__di", S.is_director(c("insider_role")))
    aligned = S.aligned_conviction(c("conviction"), c("direction"))
    rows = rows.withColumn(
        "final_conviction", S.buy_boost(aligned, is_buy, c("__cs"), c("__di"), c("sector"), c("symbol"), tuple(strict_tier))
    )
    base = S.form4_priority(c("final_conviction"), c("magnitude"), c("confidence"), c("attention"))
    rows = rows.withColumn("base_priority", base).withColumn(
        "priority", S.priority_floor(base, is_buy, c("__cs"), c("__di"), c("total_value"))
    )
    rule = F.when(is_buy, "Form 4 Insider BUY").otherwise(S.rule_name(F.lit("Form4"), c("catalyst_type")))
    observation = F.coalesce("observation_only", F.lit(False))
    return rows.withColumn("rule_name", F.when(c("priority").isNotNull(), rule)).withColumn(
        "effective_direction", S.effective_direction(c("direction"), c("final_conviction"))
    ).withColumn("action", low_priority(c("priority"))).withColumn("actionable", S.actionable(is_buy, rule, c("observation_only"))).withColumn(
        "signal", F.when(is_buy & ~observation & ~F.coalesce(c("sector") == S.DISCOVERY_SECTOR, F.lit(False)), S.normalized_conviction(c("final_conviction")))
    )


def low_priority(priority: Column) -> Column:
    """Action of an analysed document that is worth no alert."""
    return F.when(priority.isNull(), "SKIP_LOW_PRIORITY")


# What a material event counts for before anybody has read it.
PLAIN_RULE, PLAIN_CONVICTION, PLAIN_DIRECTION = "8-K Material Event", 0.5, "negative"


def plain_filing_alerts(filings: DataFrame, rules: DataFrame, ts: str, tie: str, longest: int = 30 * 24 * 60) -> DataFrame:
    """Alert path of a filing without analysis: form, active rule and throttle in this order, then a fixed negative signal.

    ``rules`` (name, is_active, throttle_minutes, none of more than ``longest`` minutes); a filing that is not an 8-K or meets no active rule blocks nothing.
    """
    live = rules.filter("is_active").groupBy(F.col("name").alias("__name")).agg(F.max("throttle_minutes").alias("__minutes"))
    rows = filings.withColumn("__rule", F.when(F.col("form_type") == "8-K", PLAIN_RULE)).join(live, F.col("__rule") == F.col("__name"), "left")
    rows = rows.withColumn("__us", F.when(F.col("__name").isNotNull(), micros(F.col(ts))))
    rows = rows.withColumn("__hold", F.greatest(F.coalesce("__minutes", F.lit(1)), F.lit(1)).cast("long") * MINUTE_US)
    first = rows.filter("__us IS NOT NULL").groupBy("symbol", "__us").agg(F.min(tie).alias("__first"), F.max("__hold").alias("__hold"))
    sent = greedy_accept(first, ["symbol"], "__us", "__hold", longest * MINUTE_US).filter("accepted").select(F.col("__first").alias("__sent"))
    told = rows.join(sent, F.col(tie) == F.col("__sent"), "left")
    action = (
        F.when(~F.coalesce(F.col("form_type") == "8-K", F.lit(False)), "SKIP_NOT_8K").when(F.col("__name").isNull(), "SKIP_NO_RULE")
        .when(F.col("__sent").isNull(), "THROTTLED").otherwise("ALERT")
    )
    alert = F.col("__sent").isNotNull()
    return told.withColumn("action", action).withColumn("conviction", F.when(alert, F.lit(PLAIN_CONVICTION))).withColumn(
        "direction", F.when(alert, F.lit(PLAIN_DIRECTION))
    ).drop("__us", "__hold", "__minutes", "__rule", "__name", "__sent")


def filing_gates(filings: DataFrame, tickers: DataFrame) -> DataFrame:
    """First gate each filing meets: form, analysed, observation, text, items, bankruptcy."""
    c = F.col
    rows = filings.join(tickers.select("symbol", "observation_only"), "symbol", "left").withColumn(
        "items", X.detect_items(c("text"))
    )
    rest = F.filter("items", lambda i: i != "1.03")
    rows = rows.withColumn("main_item", F.get(rest, F.lit(0))).withColumn("is_bankruptcy", F.array_contains("items", "1.03"))
    gate = (
        F.when(c("form_type") != "8-K", "SKIP_NOT_8K")
        .when(c("analyzed"), "SKIP_ALREADY_ANALYZED")
        .when(F.coalesce("observation_only", F.lit(False)), "SKIP_OBSERVATION_TICKER")
        .when(F.length("text") < 100, "SKIP_SHORT_TEXT")
        .when(F.size("items") == 0, "SKIP_NO_ITEMS")
        .when(c("main_item").isNull(), "BANKRUPTCY_ONLY")
        .otherwise("ANALYZE")
    )
    return rows.withColumn("gate", gate)


def bankruptcy_signals(gated: DataFrame) -> DataFrame:
    """CRITICAL alerts of bankruptcy items; they need no analysis and pass every limit."""
    hit = gated.filter(F.col("is_bankruptcy") & F.col("gate").isin("ANALYZE", "BANKRUPTCY_ONLY"))
    return hit.select(
        "accession", "symbol", F.lit("8-K Bankruptcy").alias("rule_name"), F.lit("CRITICAL").alias("priority"),
        F.lit(-1.0).alias("conviction"), F.lit("negative").alias("direction"), F.lit(True).alias("bypass_limit"),
    )


def form8k_decisions(rows: DataFrame) -> DataFrame:
    """Conviction and suppression reasons of analysed 8-K items.

    Expects main_item, conviction, direction, magnitude, confidence, attention, catalyst_type,
    guidance (struct), key_facts, eps/revenue surprise columns (null when unknown).
    """
    c = F.col
    floor = X.guidance_floor(c("guidance")) & (c("conviction") < -0.3)
    rows = rows.withColumn("floored", F.when(floor, -0.3).otherwise(c("conviction")))
    rows = rows.withColumn("aligned", S.aligned_conviction(c("floored"), c("direction")))
    earnings = c("main_item") == "2.02"
    cap = S.consensus_cap(c("eps_surprise"), c("revenue_surprise"), c("aligned"))
    rows = rows.withColumn("cap", F.when(earnings, cap))
    capped = S.apply_cap(c("aligned"), c("cap.cap"))
    missing = c("missing_data")
    rows = rows.withColumn("missing_data", F.size(X.missing_data_facts(c("key_facts"))) > 0).withColumn(
        "final_conviction", F.when(missing, S.clamp(capped, -0.3, 0.3)).otherwise(capped)
    )
    rows = rows.withColumn("effective_direction", S.effective_direction(c("direction"), c("final_conviction")))
    bullish = (c("effective_direction") == "positive") & c("cap.reason").isNull() & ~c("missing_data")
    full = S.full_consensus(c("eps_surprise"), c("revenue_surprise"))
    beat = S.documented_beat(c("eps_surprise"), c("revenue_surprise"))
    gate = F.when(
        bullish,
        F.when(~earnings, "bullish_8k_no_edge").when(~full, "bullish_no_consensus_data").when(~beat, "bullish_8k_no_edge"),
    )
    priority = F.when(missing, "MEDIUM").otherwise(
        S.form8k_priority(c("final_conviction"), c("magnitude"), c("confidence"), c("attention"))
    )
    rows = rows.withColumn("bullish_reason", gate).withColumn("priority", priority).withColumn(
        "rule_name", S.rule_name(F.lit("8-K"), c("catalyst_type"))
    )
    feed = c("cap.reason").isNull() & c("bullish_reason").isNull() & ~c("missing_data") & c("priority").isNotNull()
    return rows.withColumn("signal", F.when(feed, S.normalized_conviction(c("final_conviction"))))


def dispatch(alerts: DataFrame, per_day: int = 5) -> DataFrame:
    """Suppression by precedence, then the per-symbol daily limit in send order.

    Expects ``reason`` (already chosen, null = deliverable) and ``bypass``; bypass rows
    always pass but use up the limit.
    """
    open_rows = alerts.filter("reason IS NULL").withColumn("__day", F.to_date("sent_at"))
    flagged = flag_first_k(open_rows, ["symbol", "__day"], ["sent_at", "id"], per_day, "__within").drop("__day")
    limited = flagged.withColumn("reason", F.when(~F.col("bypass") & ~F.col("__within"), "daily_limit")).drop("__within")
    out = alerts.filter("reason IS NOT NULL").unionByName(limited)
    return out.withColumn("delivered", F.col("reason").isNull()).withColumn("action", S.delivery_action(F.col("reason")))


def call_cap(rows: DataFrame, symbol: str, ts: str, tie: str, cap: int = 20) -> DataFrame:
    """Flag the first ``cap`` rows per symbol and UTC day."""
    keyed = rows.withColumn("__day", F.to_date(ts))
    return flag_first_k(keyed, [symbol, "__day"], [ts, tie], cap, "allowed").drop("__day")


def registration_cap(rows: DataFrame, ts: str, tie: str, cap: int = 5) -> DataFrame:
    """Flag the first ``cap`` registrations per New York day."""
    keyed = rows.withColumn("ny_day", ny_date(F.col(ts)))
    return flag_first_k(keyed, ["ny_day"], [ts, tie], cap, "registered")


def throttle(alerts: DataFrame, minutes: int, keys: Sequence[str] = ("rule_name", "symbol", "catalyst")) -> DataFrame:
    """Accept an alert unless an accepted one of its key is younger than ``max(minutes, 1)``.

    Alerts of one instant are settled by their id before the chain is followed.
    """
    hold = max(minutes, 1) * MINUTE_US
    rows = alerts.withColumn("__us", micros(F.col("sent_at")))
    first = rows.groupBy(*keys, "__us").agg(F.min("id").alias("__id")).withColumn("__hold", F.lit(hold))
    kept = greedy_accept(first, list(keys), "__us", "__hold", hold).filter("accepted").select(F.col("__id").alias("id"))
    return rows.join(kept.withColumn("__ok", F.lit(True)), "id", "left").withColumn(
        "accepted", F.coalesce("__ok", F.lit(False))
    ).drop("__ok", "__us")


def options_throttle(alerts: DataFrame, minutes: int | None = None) -> DataFrame:
    """Mark ``allowed``: no delivered alert of the symbol and rule is younger than ``minutes or 120``.

    Unlike ``throttle``, an alert that is not delivered for another reason (``delivered`` false or null) blocks nothing.  Alerts
    count in the order of (sent_at, id); one without a time is not allowed and blocks nothing.
    """
    keys, hold = ["symbol", "rule_name"], (minutes or 120) * MINUTE_US
    rows = alerts.withColumn("__us", micros(F.col("sent_at")))
    first = rows.filter("delivered").groupBy(*keys, "__us").agg(F.min("id").alias("__id")).withColumn("__hold", F.lit(hold))
    sent = greedy_accept(first, keys, "__us", "__hold", hold).filter("accepted")
    last = asof_join(rows, sent, keys, "__us", "__us", ["__us", "__id"])
    # an alert sent at this very instant blocks only what comes after it; before it the way was free
    earlier = (F.col("__us") > F.col("match.__us")) | (F.col("id") > F.col("match.__id"))
    blocked = F.col("match").isNotNull() & earlier & (F.col("__us") - F.col("match.__us") < hold)
    return last.withColumn("allowed", F.col("__us").isNotNull() & ~F.coalesce(blocked, F.lit(False))).drop("match", "__us")


def log_meta(logs: DataFrame) -> DataFrame:
    """Lift ticker, trace and decision out of payload and result (the result wins)."""
    c = F.col
    return logs.select(
        "id",
        F.coalesce("result_symbol", "payload_symbol").alias("ticker"),
        F.coalesce("result_trace", "payload_trace").alias("trace_id"),
        c("action").alias("decision_reason"),
        S.log_level(F.coalesce("action", F.lit(""))).alias("level"),
    )


# Healthcare SIC codes of the discovery funnel, and the smaller set of the universe check.
HEALTHCARE_SIC = (
    "2833", "2834", "2835", "2836", "3826", "3841", "3842", "3843", "3844", "3845", "3851", "5047", "5122", "6324",
    "8000", "8011", "8049", "8050", "8051", "8060", "8062", "8071", "8082", "8090", "8093", "8099", "8731",
)


def issuer_eligibility(filings: DataFrame, issuers: DataFrame, codes: Sequence[str] = HEALTHCARE_SIC) -> DataFrame:
    """Issuer data by CIK with the SIC and exchange tests."""
    sic = F.coalesce(F.trim("sic").isin(*codes), F.lit(False))
    listed = F.coalesce(F.col("ticker").isNotNull() & ~F.col("exchange").rlike("(?i)OTC|PINK"), F.lit(False))
    return filings.join(issuers, "cik", "left").withColumn("is_healthcare", sic).withColumn("is_listed", listed)


def discovery_stage(rows: DataFrame, min_mcap: float = 250.0, min_adv: float = 1_000_000.0) -> DataFrame:
    """Gate at which each candidate stops; missing market data means retry, not reject."""
    c = F.col
    adv = c("avg_volume_mln") * 1_000_000 * c("price")
    stage = (
        F.when(F.coalesce(F.length(F.trim("sic")), F.lit(0)).eqNullSafe(0) & c("ticker").isNull(), "retry_owner_row")
        .when(~c("is_healthcare"), "rejected_sic")
        .when(~c("is_listed"), "rejected_exchange")
        .when(c("is_known"), "rejected_known")
        .when(c("reason") != "ok", F.concat(F.lit("rejected_"), c("reason")))
        .when(c("mcap").isNull(), "retry_mcap")
        .when(c("mcap") < min_mcap, "rejected_mcap")
        .when(c("avg_volume_mln").isNull() | c("price").isNull(), "retry_adv")
        .when(adv < min_adv, "rejected_adv")
        .otherwise("candidate")
    )
    return rows.withColumn("stage", stage)


def discovery_registrations(staged: DataFrame, ts: str, tie: str, cap: int = 5) -> DataFrame:
    """Candidates within the daily registration cap; the others are deferred."""
    candidates = registration_cap(staged.filter("stage = 'candidate'"), ts, tie, cap)
    done = candidates.withColumn("stage", F.when(F.col("registered"), "registered").otherwise("deferred_daily_cap"))
    return staged.filter("stage <> 'candidate'").unionByName(done.drop("ny_day", "registered"))


def coverage(universe: DataFrame, ours: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Why each of our symbols is or is not part of the active sector universe."""
    meta = universe.groupBy("symbol").agg(F.max("sic").alias("sic"), F.bool_or("filed").alias("filed"))
    rows = ours.select("symbol").distinct().join(meta.withColumn("__known", F.lit(True)), "symbol", "left")
    reason = (
        F.when(F.col("__known").isNull(), "missing_in_list")
        .when(~F.coalesce(F.col("sic").isin(*codes), F.lit(False)), F.concat(F.lit("SIC="), F.coalesce("sic", F.lit("?"))))
        .when(~F.coalesce("filed", F.lit(False)), "no_form4_in_quarter")
        .otherwise("ok")
    )
    return rows.select("symbol", reason.alias("reason"))


# Name keywords of the first universe screen.
HEALTH_NAME_WORDS = (
    "pharma", "bio", "therapeutic", "medical", "health", "care", "drug", "medicine", "clinic", "hospital", "diagnostic", "genom",
    "vaccine", "oncolog", "neuro", "immun", "regen", "cell", "molecul", "labs", "laboratory", "scien", "rx", "med ", "med,", "medic",
)


def healthcare_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(HEALTH_NAME_WORDS))


def coverage_summary(universe: DataFrame, ours: DataFrame, codes: Sequence[str]) -> DataFrame:
    active = universe.filter(F.col("sic").isin(*codes) & F.col("filed")).select("symbol").distinct()
    mine = ours.select("symbol").distinct()
    both = active.join(mine, "symbol", "left_semi").agg(F.count("*")).scalar()
    return active.agg(F.count("*").alias("universe")).withColumn("covered", both).withColumn(
        "coverage_pct", F.round(F.when(F.col("universe") > 0, F.col("covered") * 100.0 / F.col("universe")).otherwise(0.0), 1)
    )


def distinct_texts(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_k(rows, keys, order, 1)
