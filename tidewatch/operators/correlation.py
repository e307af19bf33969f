"""Patterns over the recent signals of a ticker.

Every evaluation sees at most ``KEEP`` signals per class, so its arrays are bounded; the
patterns are array expressions on that one row and need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.temporal import DAY_US, from_micros, greedy_accept, lag_in_order, micros, newest_by_rank, running_counts
from tidewatch.session import cut_lineage

HOUR_US = 3_600_000_000
SHORT_US, INSIDER_US = 120 * HOUR_US, 14 * 24 * HOUR_US
KEEP, MIN_CONVICTION, MIN_CORRELATED = 50, 0.05, 0.20
DOMINANCE = 0.66
HASH_WINDOW_US = 15 * 60_000_000

# Seconds a delivered pattern blocks its repetition, and display labels.
PATTERN_THROTTLE = {
    "INSIDER_PLUS_8K": 259_200,
    "FILING_CONFIRMS_NEWS": 14_400,
    "MULTI_SOURCE_CONVERGENCE": 7_200,
    "INSIDER_CLUSTER": 86_400,
    "ESCALATING_SIGNAL": 21_600,
    "INSIDER_PLUS_OPTIONS": 259_200,
}
LIVE_PATTERNS = ("INSIDER_PLUS_8K", "INSIDER_CLUSTER", "INSIDER_PLUS_OPTIONS")


def _tail(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), n)


def signal_windows(signals: DataFrame, evaluations: DataFrame, keep: int = KEEP, width: int = DAY_US) -> DataFrame:
    """Arrays ``short`` and ``insider`` of the retained signals at each (ticker, now) evaluation.

    Weak signals are never stored; each class keeps its newest ``keep``; the look-back of
    120 hours (14 days for insiders) includes its edge.
    """
    rows = signals.filter(F.abs("conviction") >= MIN_CONVICTION).select(
        "ticker", micros(F.col("ts")).alias("us"), "id", "source_category", "conviction", "direction", "catalyst_type"
    )
    insider = F.coalesce(F.col("source_category") == "form4", F.lit(False))
    classes = {"short": (~insider, SHORT_US), "insider": (insider, INSIDER_US)}
    asked = evaluations.select("ticker", micros(F.col("now")).alias("us"))
    return newest_by_rank(rows, asked, ["ticker"], "us", "id", classes, keep, width).withColumnRenamed("us", "now_us")


def _recent(arr: Column, hours: int, *categories: str) -> Column:
    since = F.col("now_us") - hours * HOUR_US
    return F.filter(
        arr, lambda s: (s["us"] > since) & (s["source_category"].isin(*categories) if categories else F.lit(True))
    )


def _count(arr: Column, direction: str) -> Column:
    return F.size(F.filter(arr, lambda s: s["direction"] == direction))


def dominant_direction(arr: Column) -> Column:
    n = F.size(arr)
    return F.when(_count(arr, "positive") >= n * DOMINANCE, "positive").when(
        _count(arr, "negative") >= n * DOMINANCE, "negative"
    )


def strongest_per_category(arr: Column) -> Column:
    """Strongest signal of each category (first on ties), categories by first appearance."""
    categories = F.array_distinct(F.transform(arr, lambda s: s["source_category"]))

    def strongest(cat: Column) -> Column:
        ranked = F.transform(
            arr,
            lambda s, i: F.when(
                s["source_category"] == cat, F.struct(F.abs(s["conviction"]).alias("a"), (-i).alias("i"), s.alias("s"))
            ),
        )
        return F.array_max(ranked)["s"]

    return F.transform(categories, strongest)


def _top(best: Column) -> Column:
    """Strongest of the category signals; the later category wins a tie."""
    return F.array_max(
        F.transform(best, lambda s, i: F.struct(F.abs(s["conviction"]).alias("a"), i.alias("i"), s["direction"].alias("d")))
    )


def with_conviction(df: DataFrame, sigs: str, into: str) -> DataFrame:
    """Aggregate conviction of an array column: the strongest category signal, raised by 20 %
    per agreeing category.  Intermediates are columns, so nothing is evaluated twice."""
    df = df.withColumn("__best", strongest_per_category(F.col(sigs))).withColumn("__top", _top(F.col("__best")))
    agree = F.size(F.filter("__best", lambda s: s["direction"] == F.col("__top.d")))
    size = F.least(F.lit(1.0), F.col("__top.a") * (1 + 0.2 * (agree - 1)))
    value = F.when(F.size(sigs) > 0, size * F.when(F.col("__top.d") == "positive", 1).otherwise(-1)).otherwise(0.0)
    return df.withColumn(into, value).drop("__best", "__top")


def direction_conflict(arr: Column, neutral: float = 0.05) -> Column:
    """True when the net directions of two categories oppose each other."""
    categories = F.array_distinct(F.transform(arr, lambda s: s["source_category"]))

    def net(cat: Column) -> Column:
        return F.aggregate(
            F.filter(arr, lambda s: s["source_category"] == cat),
            F.lit(0.0),
            lambda acc, s: acc + F.abs(s["conviction"]) * F.when(s["direction"] == "positive", 1).otherwise(-1),
        )

    nets = F.filter(F.transform(categories, net), lambda v: F.abs(v) >= neutral)
    return F.exists(nets, lambda v: v > 0) & F.exists(nets, lambda v: v < 0)


def _pattern(df: DataFrame, name: str, ok: Column, sigs: str, direction: str, conviction: Column | None = None) -> DataFrame:
    """Add the struct column ``name`` (null when the pattern is absent)."""
    if conviction is None:
        df = with_conviction(df, sigs, "__conviction")
        conviction = F.col("__conviction")
    hit = F.when(
        ok & F.col(direction).isNotNull(),
        F.struct(
            F.lit(name).alias("pattern"), F.col(direction).alias("direction"), conviction.alias("conviction"),
            direction_conflict(F.col(sigs)).alias("conflict"), F.array_sort(F.transform(sigs, lambda s: s["id"])).alias("ids"),
        ),
    )
    return df.withColumn(name, hit)


def _insider_plus(df: DataFrame, name: str, category: str, hours: int) -> DataFrame:
    df = df.withColumn("__f", _recent(F.col("insider"), hours, "form4")).withColumn("__o", _recent(F.col("short"), hours, category))
    df = df.withColumn("__s", F.concat("__f", "__o")).withColumn("__d", dominant_direction(F.col("__s")))
    return _pattern(df, name, (F.size("__f") > 0) & (F.size("__o") > 0), "__s", "__d")


def _insider_cluster(df: DataFrame, name: str) -> DataFrame:
    """Sales only: clusters of purchases are switched off."""
    df = df.withColumn("__r", _recent(F.col("insider"), 7 * 24, "form4")).withColumn("__d", dominant_direction(F.col("__r")))
    df = df.withColumn("__s", F.filter("__r", lambda s: s["direction"] == "negative"))
    ok = (F.size("__r") >= 2) & (F.col("__d") == "negative") & (F.size("__s") >= 2)
    return _pattern(df, name, ok, "__s", "__d")


def _filing_confirms_news(df: DataFrame, name: str) -> DataFrame:
    df = df.withColumn("__n", _recent(F.col("all"), 48, "news", "social")).withColumn("__f", _recent(F.col("all"), 48, "8k"))
    kinds = lambda c: F.array_distinct(
        F.filter(F.transform(c, lambda s: s["catalyst_type"]), lambda k: k.isNotNull() & ~k.isin("", "unknown"))
    )
    df = df.withColumn("__kn", kinds("__n")).withColumn("__kf", kinds("__f"))
    first = lambda c: F.array_min(F.transform(c, lambda s: s["us"]))
    shared = (F.size("__kn") == 0) | (F.size("__kf") == 0) | F.arrays_overlap("__kn", "__kf")
    ok = (F.size("__n") > 0) & (F.size("__f") > 0) & (first("__n") < first("__f")) & shared
    df = df.withColumn("__s", F.concat("__n", "__f")).withColumn("__d", dominant_direction(F.col("__s")))
    return _pattern(df, name, ok, "__s", "__d")


def _multi_source(df: DataFrame, name: str) -> DataFrame:
    df = df.withColumn("__r", _recent(F.col("all"), 24)).withColumn("__b", strongest_per_category(F.col("__r")))
    df = df.withColumn("__d", dominant_direction(F.col("__b")))
    df = df.withColumn("__s", F.filter("__b", lambda s: s["direction"] == F.col("__d")))
    return _pattern(df, name, (F.size("__b") >= 3) & (F.size("__s") >= 3), "__s", "__d")


def _escalating(df: DataFrame, name: str, min_last: float = 0.25) -> DataFrame:
    df = df.withColumn("__r", F.array_sort(_recent(F.col("all"), 72))).withColumn("__d", dominant_direction(F.col("__r")))
    df = df.withColumn("__s", _tail(F.col("__r"), 3))
    size = lambda i: F.abs(F.get("__s", F.lit(i))["conviction"])
    rising = (size(1) > size(0)) & (size(2) > size(1)) & (size(2) >= min_last)
    same = F.forall("__s", lambda s: s["direction"] == F.col("__d"))
    boosted = F.least(F.greatest(F.get("__s", F.lit(2))["conviction"] * 1.3, F.lit(-1.0)), F.lit(1.0))
    return _pattern(df, name, (F.size("__r") >= 3) & rising & same, "__s", "__d", boosted)


DETECTORS = {
    "INSIDER_PLUS_8K": lambda df, n: _insider_plus(df, n, "8k", 24),
    "FILING_CONFIRMS_NEWS": _filing_confirms_news,
    "MULTI_SOURCE_CONVERGENCE": _multi_source,
    "INSIDER_CLUSTER": _insider_cluster,
    "ESCALATING_SIGNAL": _escalating,
    "INSIDER_PLUS_OPTIONS": lambda df, n: _insider_plus(df, n, "options", 120),
}


def detect_patterns(windows: DataFrame, names: tuple[str, ...] = LIVE_PATTERNS) -> DataFrame:
    """One row per evaluation and detected pattern; every pattern needs two signals or more by itself."""
    rows = windows.withColumn("all", F.concat("short", "insider"))
    for name in names:
        rows = DETECTORS[name](rows, name)
    found = F.array_compact(F.array(*names))
    return rows.select("ticker", "now_us", F.explode(found).alias("p")).select(
        "ticker", from_micros(F.col("now_us")).alias("now"), "now_us", "p.*"
    )


def evaluation_summary(windows: DataFrame) -> DataFrame:
    """Counts per evaluation and whether it is worth checking."""
    n = F.size("short") + F.size("insider")
    return windows.select(
        "ticker", from_micros(F.col("now_us")).alias("now"), F.size("short").alias("n_short"), F.size("insider").alias("n_insider"),
        F.when(n < 2, "TOO_FEW_SIGNALS").otherwise("EVALUATE").alias("action"),
    )


def debounced_evaluations(signals: DataFrame, seconds: int = 10) -> DataFrame:
    """Evaluation times: a signal arms a timer unless one is already armed."""
    hold = seconds * 1_000_000
    rows = signals.select("ticker", micros(F.col("ts")).alias("us")).distinct().withColumn("hold", F.lit(hold))
    armed = greedy_accept(rows, ["ticker"], "us", "hold", hold).filter("accepted")
    return armed.select("ticker", from_micros(F.col("us") + hold).alias("now"))


def pattern_hash(patterns: DataFrame) -> DataFrame:
    """Hash of the pattern set of each evaluation: sorted types with their sorted signal ids."""
    quoted = F.concat(F.lit('["'), F.array_join("ids", '","'), F.lit('"]'))
    entry = F.concat(F.lit('{"type":"'), F.col("pattern"), F.lit('","signalIds":'), quoted, F.lit("}"))
    sets = patterns.groupBy("ticker", "now_us").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    text = F.concat(F.lit("["), F.array_join("entries", ","), F.lit("]"))
    return sets.select("ticker", "now_us", F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def skip_unchanged(hashes: DataFrame, window_us: int = HASH_WINDOW_US) -> DataFrame:
    """Flag evaluations whose pattern set equals the last kept one and is not older than the window.

    A changed hash is always kept, so each run of equal hashes is throttled on its own.
    """
    prev = lag_in_order(cut_lineage(hashes), ["ticker"], "now_us", ["hash"])
    changed = F.col("prev").isNull() | ~F.col("prev.hash").eqNullSafe(F.col("hash"))
    runs = running_counts(prev, ["ticker"], "now_us", [], {"run": changed}).withColumn("hold", F.lit(window_us + 1))
    kept = greedy_accept(runs.select("ticker", "run", "now_us", "hash", "hold"), ["ticker", "run"], "now_us", "hold", window_us + 1)
    return kept.select("ticker", "now_us", "hash", (~F.col("accepted")).alias("skipped"))


def pattern_alerts(patterns: DataFrame, tickers: DataFrame) -> DataFrame:
    """Priority and suppression of each pattern occurrence."""
    obs = tickers.filter("observation_only").select(F.col("symbol").alias("ticker"), F.lit(True).alias("__obs"))
    c = F.col
    size = F.abs("conviction")
    cluster_sell = (c("pattern") == "INSIDER_CLUSTER") & (c("direction") == "negative")
    reason = (
        F.when(F.coalesce("__obs", F.lit(False)), "observation")
        .when(c("conflict"), "direction_conflict").when(cluster_sell, "cluster_sell_no_edge")
    )
    return patterns.join(obs, "ticker", "left").withColumn("reason", reason).drop("__obs").withColumn(
        "priority", F.when(c("conflict"), "HIGH").when(size >= 0.6, "CRITICAL").otherwise("HIGH")
    ).withColumn("low_conviction", size < MIN_CORRELATED)


def claim_patterns(alerts: DataFrame, short_seconds: int = 900) -> DataFrame:
    """Claim per (ticker, pattern): 15 minutes, extended to the pattern throttle when delivered."""
    throttle = F.create_map(*[F.lit(x) for kv in PATTERN_THROTTLE.items() for x in kv])[F.col("pattern")]
    hold = F.when(F.col("reason").isNull(), F.greatest(throttle, F.lit(short_seconds))).otherwise(F.lit(short_seconds))
    # a pattern below the conviction limit takes no part in claims: it has no position in the chain
    rows = cut_lineage(alerts).withColumn("__hold", hold.cast("long") * 1_000_000).withColumn("__at", F.when(~F.col("low_conviction"), F.col("now_us")))
    claimed = greedy_accept(rows, ["ticker", "pattern"], "__at", "__hold", max(PATTERN_THROTTLE.values()) * 1_000_000)
    action = (
        F.when(F.col("low_conviction"), "SKIP_LOW_CONVICTION").when(~F.col("accepted"), "DEDUP_SKIP")
        .when(F.col("reason").isNull(), "ALERT_SENT_TELEGRAM").otherwise(F.concat(F.lit("ALERT_DB_ONLY_"), F.upper("reason")))
    )
    return claimed.withColumn("action", action).drop("accepted", "__hold", "__at")
