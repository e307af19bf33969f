"""Scores, gates and classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch.functions.text import ascii_words



def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


# --- options -------------------------------------------------------------------------------


def otm_distance(strike: Column, underlying: Column) -> Column:
    return F.abs(strike - underlying) / underlying


def is_otm(option_type: Column, strike: Column, underlying: Column) -> Column:
    return F.when(option_type == "call", strike > underlying).otherwise(strike < underlying)


def tradable_contract(
    option_type: Column,
    strike: Column,
    underlying: Column,
    dte: Column,
    max_dte: int = 60,
    max_distance: float = 0.30,
    max_itm_distance: float = 0.05,
) -> Column:
    distance = otm_distance(strike, underlying)
    deep_itm = ~is_otm(option_type, strike, underlying) & (distance > max_itm_distance)
    return (dte > 0) & (dte <= max_dte) & (distance <= max_distance) & ~deep_itm


def spike_ratio(volume: Column, avg: Column, points: Column, min_points: int = 5, min_volume: int = 100) -> Column:
    """Volume over its average; 0 while the baseline is too thin."""
    thin = (points < min_points) | (volume < min_volume) | (avg <= 0)
    return F.when(thin, F.lit(0.0)).otherwise(volume / avg)


def flow_score(
    spike: Column,
    volume: Column,
    distance: Column,
    dte: Column,
    option_type: Column,
    boosted: Column,
    call_ratio: Column | None = None,
) -> Column:
    """Signed conviction of an option flow; with ``call_ratio`` the per-ticker form."""
    size = F.when(volume > 0, clamp(F.log10(volume / F.lit(500.0)), 0, 1)).otherwise(0.0)
    raw = (
        0.35 * clamp(spike / 10, 0, 1)
        + 0.20 * size
        + 0.15 * clamp(distance / 0.15, 0, 1)
        + 0.15 * clamp(1 - dte / F.lit(60.0), 0, 1)
    )
    by_type = F.when(option_type == "call", 1).otherwise(-1)
    sign, penalty = by_type, F.lit(1.0)
    if call_ratio is not None:
        raw = raw + 0.15 * (F.abs(call_ratio - 0.5) * 2)
        direction = flow_direction(call_ratio)
        sign = F.when(direction == "positive", 1).when(direction == "negative", -1).otherwise(by_type)
        penalty = F.when(direction == "mixed", 0.7).otherwise(1.0)
    suspicious = F.when(spike > 1000, 0.5).otherwise(1.0)
    boost = F.when(boosted, 1.3).otherwise(1.0)
    return clamp(raw * sign * penalty * suspicious * boost, -1, 1)


def flow_direction(call_ratio: Column) -> Column:
    return F.when(call_ratio > 0.65, "positive").when(call_ratio < 0.35, "negative").otherwise("mixed")


# --- prices --------------------------------------------------------------------------------


def pct_change(start: Column, later: Column) -> Column:
    usable = (start > 0) & (later > 0)
    return F.when(usable, (later - start) / start * 100)


def alpha_pct(start: Column, later: Column, bench_start: Column, bench_later: Column, beta: float = 1.0) -> Column:
    return pct_change(start, later) - beta * pct_change(bench_start, bench_later)


def direction_hit(reference: Column, direction: Column) -> Column:
    return F.when(direction == "positive", reference > 0).when(direction == "negative", reference < 0)


# --- consensus -----------------------------------------------------------------------------


def surprise_pct(actual: Column, estimate: Column) -> Column:
    return F.when(estimate != 0, (actual - estimate) / F.abs(estimate) * 100)


def surprise_verdict(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), None)
        .when(pct >= 10, "STRONG BEAT")
        .when(pct >= 3, "beat")
        .when(pct > -3, "IN-LINE")
        .when(pct > -10, "miss")
        .otherwise("BIG MISS")
    )


def consensus_cap(eps: Column, revenue: Column, conviction: Column) -> Column:
    """Struct(cap, reason): how far the surprise data limit the conviction."""
    size = F.abs(conviction)
    both = eps.isNotNull() & revenue.isNotNull()
    miss = (F.coalesce(eps < 0, F.lit(False)) | F.coalesce(revenue < 0, F.lit(False))) & (size > 0.3)
    in_line = both & (F.abs(eps) < 3) & (F.abs(revenue) < 3) & (size > 0.5)
    mixed = both & ((eps >= 5) != (revenue >= 5)) & (size > 0.7)
    reason = F.when(miss, "consensus_miss").when(in_line, "consensus_in_line").when(mixed, "consensus_mixed")
    cap = F.when(miss, 0.3).when(in_line, 0.5).when(mixed, 0.7)
    return F.struct(cap.alias("cap"), reason.alias("reason"))


def apply_cap(conviction: Column, cap: Column) -> Column:
    return F.when(cap.isNull(), conviction).otherwise(F.signum(conviction) * F.least(F.abs(conviction), cap))


def full_consensus(eps: Column, revenue: Column) -> Column:
    return eps.isNotNull() & revenue.isNotNull()


def documented_beat(eps: Column, revenue: Column) -> Column:
    return F.coalesce((eps >= 5) & (revenue >= 5), F.lit(False))


def shadow_verdict(
    eps: Column,
    revenue: Column,
    eps_actual: Column,
    eps_estimate: Column,
    revenue_actual: Column,
    conviction: Column,
    cap: Column,
    reason: Column,
) -> Column:
    """What a graded cap would have decided; null where no cap was applied."""
    no = F.lit(False)
    anomaly = F.coalesce(F.abs(eps_actual) > 50, no) | F.coalesce(
        (revenue_actual > 0) & (revenue_actual < 1_000_000), no
    )
    flip = F.coalesce(F.signum(eps_actual) * F.signum(eps_estimate) < 0, no)
    wide = F.coalesce(F.abs(eps_actual - eps_estimate) >= 0.1, no)
    extreme = F.coalesce(eps < -30, no) & (flip | wide)
    agrees = conviction < 0
    is_miss = reason == "consensus_miss"
    uncap = is_miss & extreme & agrees & ~anomaly
    size = F.greatest(
        F.when(eps < 0, -eps).otherwise(0.0), F.when(revenue < 0, -revenue).otherwise(0.0)
    )
    graded = F.when(uncap, None).when(size.between(10, 30), 0.5).otherwise(0.3)
    proposed = F.when(is_miss, graded).otherwise(cap)
    return F.when(
        cap.isNotNull() & reason.isNotNull(),
        F.struct(
            extreme.alias("is_extreme_miss"),
            agrees.alias("sign_gate_pass"),
            anomaly.alias("anomaly_excluded"),
            uncap.alias("would_uncap"),
            proposed.alias("proposed_cap"),
        ),
    )


# --- priorities and rules ------------------------------------------------------------------


def form4_priority(conviction: Column, magnitude: Column, confidence: Column, attention: Column) -> Column:
    size = F.abs(conviction)
    return (
        F.when(attention & (size >= 0.3), "CRITICAL")
        .when((size >= 0.8) & (confidence >= 0.6), "CRITICAL")
        .when((size >= 0.4) & (magnitude != "low") & (confidence >= 0.5), "HIGH")
        .when((magnitude == "high") & (confidence >= 0.6), "HIGH")
        .when((size >= 0.2) & (magnitude == "medium"), "MEDIUM")
    )


def form8k_priority(conviction: Column, magnitude: Column, confidence: Column, attention: Column) -> Column:
    high = magnitude == "high"
    return (
        F.when(attention & (F.abs(conviction) >= 0.4), F.when(high, "CRITICAL").otherwise("HIGH"))
        .when(high & (confidence >= 0.7), "CRITICAL")
        .when((magnitude == "medium") & (confidence >= 0.6), "HIGH")
        .when(high, "HIGH")
    )


def rule_name(form: Column, catalyst: Column) -> Column:
    return (
        F.when(form == "Form4", "Form 4 Insider Signal")
        .when(catalyst == "earnings", "8-K Earnings Miss")
        .when(catalyst == "leadership", "8-K Leadership Change")
        .otherwise("8-K Material Event GPT")
    )


# Role patterns of the C-suite test (any match, case-insensitive).
CSUITE_PATTERNS = (
    r"\bChief\s+(Executive|Financial|Operating|Technology|Information|Medical|Scientific|Legal|Accounting)\s+Officer\b",
    r"\b(CEO|CFO|COO|CTO|CIO|CMO|CSO|CLO)\b",
    r"(?<!Vice\s)(?<!Senior\s)\bPresident\b",
    r"\bChair(man|woman|person)\b",
    r"\bVice\s+Chair(man|woman|person)\b",
    r"\b(?:EVP|Executive\s+Vice\s+President)[\s,]+.*?(Finance|Operations?|Product|Strategy)\b",
    r"\bPrincipal\s+(Financial|Accounting)\s+Officer\b",
)
# Officer title words of the event-study variant.
CSUITE_TITLES = (
    "CEO", "CFO", "COO", "CMO", "CTO", "CIO", "CLO", "President", "Chairman", "Vice Chairman", "EVP",
    "Executive Vice President", "Chief Executive", "Chief Financial", "Chief Operating", "Chief Medical",
    "Chief Technology", "Chief Legal", "Chief Commercial", "Chief Scientific",
)


def is_csuite(role: Column, patterns: tuple[str, ...] = CSUITE_PATTERNS) -> Column:
    return F.coalesce(role.rlike(ascii_words("(?i)" + "|".join(f"(?:{p})" for p in patterns))), F.lit(False))


def is_director(role: Column) -> Column:
    return F.coalesce(role.rlike(ascii_words(r"(?i)\bDirector\b")), F.lit(False))


def is_csuite_title(is_officer: Column, title: Column, words: tuple[str, ...] = CSUITE_TITLES) -> Column:
    upper = F.upper(title)
    hit = F.lit(False)
    for w in words:
        hit = hit | upper.contains(w.upper())
    return F.coalesce(is_officer & hit, F.lit(False))


APLS_SECTOR, DISCOVERY_SECTOR = "biotech_apls", "healthcare_discovery"


def form4_early_action(
    value: Column,
    transaction_type: Column,
    is_plan: Column,
    csuite: Column,
    director: Column,
    min_value: float = 100_000,
) -> Column:
    """Skips that cost nothing: value, type, plan and role; null when the row goes on."""
    sell = transaction_type == "SELL"
    return (
        F.when(F.coalesce(value, F.lit(0.0)) < min_value, "SKIP_LOW_VALUE")
        .when(~transaction_type.isin("BUY", "SELL"), "SKIP_NOT_ALERTABLE")
        .when(F.coalesce(is_plan, F.lit(False)), "SKIP_10B51_PLAN")
        .when(sell & director & ~csuite, "SKIP_DIRECTOR_SELL")
        .when(sell & ~csuite, "SKIP_NON_ROLE_SELL")
    )


def form4_sector_action(
    sector: Column,
    observation_only: Column,
    transaction_type: Column,
    value: Column,
    min_buy: float = 500_000,
) -> Column:
    """Observation and observed-vertical gates after the daily cap; null when the row goes on."""
    apls = F.coalesce(sector == APLS_SECTOR, F.lit(False))
    discovery = F.coalesce(sector == DISCOVERY_SECTOR, F.lit(False))
    vertical = apls | discovery
    label = F.when(apls, "APLS").otherwise("DISCOVERY")
    return (
        F.when(F.coalesce(observation_only, F.lit(False)) & ~vertical, "SKIP_OBSERVATION_TICKER")
        .when(vertical & (transaction_type != "BUY"), F.concat(F.lit("SKIP_"), label, F.lit("_NON_BUY")))
        .when(
            vertical & (F.coalesce(value, F.lit(0.0)) < min_buy),
            F.concat(F.lit("SKIP_"), label, F.lit("_BELOW_THRESHOLD")),
        )
    )


def buy_boost(
    conviction: Column,
    is_buy: Column,
    csuite: Column,
    director: Column,
    sector: Column,
    symbol: Column,
    strict_tier: tuple[str, ...] = (),
) -> Column:
    """Conviction multipliers of an insider BUY (role, sector, strict tier)."""
    role = F.when(csuite, 1.3).when(director, 1.15).otherwise(1.0)
    area = F.when(sector.isin("healthcare", APLS_SECTOR, DISCOVERY_SECTOR), 1.2).otherwise(1.0)
    tier = F.lit(1.0)
    if strict_tier:
        tier = F.when((sector == APLS_SECTOR) & symbol.isin(*strict_tier), 1.1).otherwise(1.0)
    return F.when(is_buy, conviction * role * area * tier).otherwise(conviction)


def priority_floor(
    priority: Column, is_buy: Column, csuite: Column, director: Column, value: Column, min_value: float = 100_000
) -> Column:
    raised = F.when(csuite & (priority.isNull() | (priority == "MEDIUM")), "HIGH").otherwise(priority)
    return F.when(raised.isNull() & is_buy & director & (value >= min_value), "MEDIUM").otherwise(raised)


def aligned_conviction(conviction: Column, direction: Column) -> Column:
    """Flip the sign where direction and conviction disagree."""
    wrong = ((direction == "negative") & (conviction > 0)) | ((direction == "positive") & (conviction < 0))
    return F.when(wrong, -conviction).otherwise(conviction)


def effective_direction(direction: Column, conviction: Column) -> Column:
    return F.when(
        direction == "neutral", F.when(conviction >= 0, "positive").otherwise("negative")
    ).otherwise(direction)


def normalized_conviction(conviction: Column) -> Column:
    return clamp(conviction / 2, -1, 1)


def suppression_reason(
    observation: Column,
    missing_data: Column,
    consensus_reason: Column,
    bullish_reason: Column,
    conflict: Column,
    sell_no_edge: Column,
    csuite_sell: Column,
    cluster_sell: Column,
    silent: Column,
) -> Column:
    """First applicable reason to keep an alert in the database only (daily limit comes later)."""
    return (
        F.when(observation, "observation")
        .when(missing_data, "gpt_missing_data")
        .when(consensus_reason.isNotNull(), consensus_reason)
        .when(bullish_reason.isNotNull(), bullish_reason)
        .when(conflict, "direction_conflict")
        .when(sell_no_edge, "sell_no_edge")
        .when(csuite_sell, "csuite_sell_no_edge")
        .when(cluster_sell, "cluster_sell_no_edge")
        .when(silent, "silent_rule")
    )


def delivery_action(reason: Column) -> Column:
    return F.when(reason.isNull(), "ALERT_SENT_TELEGRAM").otherwise(
        F.concat(F.lit("ALERT_DB_ONLY_"), F.upper(reason))
    )


def actionable(is_buy: Column, rule: Column, observation_only: Column) -> Column:
    return is_buy & (rule == "Form 4 Insider BUY") & ~F.coalesce(observation_only, F.lit(False))


def go_no_go(d: Column, p: Column) -> Column:
    return (
        F.when(d.isNull() | p.isNull(), "INDETERMINATE")
        .when((d >= 0.5) & (p < 0.01), "GO")
        .when(d >= 0.2, "CONSERVATIVE")
        .otherwise("DROP")
    )


def cluster_verdict(
    n: Column, d: Column, p: Column, min_n: int = 15, alpha: float = 0.05 / 7, min_d: float = 0.3
) -> Column:
    ok = F.coalesce((p < alpha) & (d >= min_d), F.lit(False))
    return F.when(F.coalesce(n, F.lit(0)) < min_n, "INSUFFICIENT_N").when(ok, "PASS").otherwise("FAIL")


# Log levels by action.
WARN_ACTIONS = ("ALERT_TELEGRAM_FAILED", "REDIS_ERROR", "PARSER_EMPTY", "FETCH_TIMEOUT")
DEBUG_ACTIONS = ("NO_PATTERNS", "TOO_FEW_SIGNALS")


def log_level(action: Column) -> Column:
    return (
        F.when(action.isin(*WARN_ACTIONS), "warn")
        .when(action == "ERROR", "error")
        .when(action.isin(*DEBUG_ACTIONS), "debug")
        .otherwise("info")
    )
