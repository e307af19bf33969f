"""Literal cases of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import calendar as C, scoring as S, stats as X, text as N
from tidewatch.operators import correlation as K, options as P, study as E


def one(spark, expr, **cols):
    df = spark.range(1)
    for name, v in cols.items():
        df = df.withColumn(name, F.lit(v) if not isinstance(v, F.col("id").__class__) else v)
    return df.select(expr.alias("x")).first().x


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "sent, want",
    [
        ("2026-06-10 02:43:00", "2026-06-10 13:30:00"),  # evening before, session the same New York night
        ("2026-06-10 15:00:07", "2026-06-10 15:00:07"),  # open
        ("2026-06-10 20:00:05", "2026-06-11 13:30:05"),  # the close itself is closed
        ("2026-11-26 15:00:00", "2026-11-27 14:30:00"),  # Thanksgiving
        ("2026-12-25 12:00:00", "2026-12-28 14:30:00"),  # Christmas before a weekend
        ("2026-03-07 15:00:00", "2026-03-09 13:30:00"),  # clock change on Sunday
    ],
)
def test_effective_start(spark, sent, want):
    assert one(spark, C.effective_start(ts(sent))) == dt.datetime.fromisoformat(want)


@pytest.mark.parametrize("sent, want", [("2026-11-26 15:00:00", False), ("2026-06-10 13:29:59", False), ("2026-06-10 13:30:00", True), ("2026-06-10 20:00:00", False), ("2026-06-13 15:00:00", False)])
def test_open(spark, sent, want):
    assert one(spark, C.is_open(ts(sent))) is want


def test_spike_edges(spark):
    ratio = lambda v, a, n: one(spark, S.spike_ratio(F.lit(v), F.lit(a), F.lit(n)))
    assert ratio(300, 100.0, 5) == 3.0 and ratio(299, 100.0, 20) == pytest.approx(2.99)
    assert ratio(300, 100.0, 4) == 0 and ratio(99, 1.0, 20) == 0 and ratio(300, 0.0, 20) == 0


def test_contract_screen(spark):
    cols = "occ string, option_type string, strike double, underlying double, expiry date"
    day = dt.date(2026, 3, 17)
    rows = [
        ("far", "call", 180.0, 120.0, dt.date(2026, 4, 17)), ("ok", "call", 130.0, 120.0, dt.date(2026, 4, 17)),
        ("deep", "call", 100.0, 120.0, dt.date(2026, 4, 17)), ("near_itm", "put", 122.0, 120.0, dt.date(2026, 4, 17)),
        ("expired", "put", 110.0, 120.0, day), ("late", "put", 110.0, 120.0, dt.date(2026, 7, 1)),
    ]
    out = P.screened_contracts(spark.createDataFrame(rows, cols), F.lit(day).cast("timestamp_ntz"))
    assert sorted(r.occ for r in out.collect()) == ["near_itm", "ok"]


@pytest.mark.parametrize(
    "role, csuite",
    [
        ("Chief Executive Officer", True), ("Vice President", False), ("Senior President", False), ("President", True), ("EVP, Finance", True),
        ("Executive Vice President, Product", True), ("Director", False), ("Chairwoman", True), (None, False), ("Principal Accounting Officer", True),
    ],
)
def test_csuite(spark, role, csuite):
    assert one(spark, S.is_csuite(F.lit(role).cast("string"))) is csuite


def test_consensus(spark):
    cap = lambda e, r, c: tuple(one(spark, S.consensus_cap(F.lit(e).cast("double"), F.lit(r).cast("double"), F.lit(c))))
    assert cap(-1.0, None, 0.5) == (0.3, "consensus_miss") and cap(1.0, 2.0, 0.6) == (0.5, "consensus_in_line")
    assert cap(8.0, 1.0, -0.8) == (0.7, "consensus_mixed") and cap(8.0, 9.0, 1.0) == (None, None) and cap(None, None, 1.0) == (None, None)


def test_missing_data_clamp(spark):
    facts = F.array(F.lit("EPS niedostępny w dokumencie"), F.lit("revenue not disclosed"), F.lit("margin 12 %"))
    assert len(one(spark, N.missing_data_facts(facts))) == 2


def test_text(spark):
    doc = "Item 2.02 Results. Revenues of $1.2 billion; total revenue $3,400.5 million. Diluted EPS of $(0.35). Item 9.01 Exhibits SIGNATURES"
    assert one(spark, N.detect_items(F.lit(doc))) == ["2.02", "9.01"]
    assert one(spark, N.item_section(F.lit(doc), F.lit("2.02"))).endswith("$(0.35).")
    assert one(spark, N.reported_revenue(F.lit(doc))) == 3.4005e9 and one(spark, N.reported_eps(F.lit(doc))) == 0.35
    g = one(spark, N.guidance_status(F.lit("The company lowers GAAP guidance. It reaffirms adjusted earnings guidance.")))
    assert g.lowers_gaap_only and not g.has_lowering and g.affirms_adjusted


def test_dominance_is_66_percent(spark):
    sig = lambda d: F.struct(F.lit(d).alias("direction"))
    assert one(spark, K.dominant_direction(F.array(*[sig(d) for d in ("positive", "positive", "negative")]))) == "positive"
    assert one(spark, K.dominant_direction(F.array(*[sig(d) for d in ("positive", "negative")]))) is None


def test_conflict_case(spark):
    sig = lambda c, v, d: F.struct(F.lit(c).alias("source_category"), F.lit(v).alias("conviction"), F.lit(d).alias("direction"))
    arr = F.array(sig("form4", -0.2, "negative"), *[sig("options", v, "positive") for v in (0.32, 0.4, 0.5, 0.53)])
    assert one(spark, K.direction_conflict(arr)) is True


@pytest.mark.parametrize("t, df, p", [(1.0, 1.0, 0.5), (2.0, 2.0, 0.18350341907227397), (0.0, 10.0, 1.0), (1.959963984540054, 1e7, 0.05), (-12.0, 30.0, 5.3e-13), (2.228138852, 10.0, 0.05)])
def test_welch_p(spark, t, df, p):
    assert one(spark, X.two_sided_p(F.lit(t), F.lit(df))) == pytest.approx(p, rel=2e-2 if p < 1e-9 else 1e-6)


def test_cohens_d_thin_samples(spark):
    d = lambda n1, n2: one(spark, X.pooled_d(F.lit(1.0), F.lit(1.0), F.lit(n1), F.lit(0.0), F.lit(1.0), F.lit(n2)))
    assert d(3, 20) is None and d(4, 9) is None and d(4, 10) == pytest.approx(1.0)


def brute_clusters(rows, second):
    """Row-by-row greedy walk; ``rows`` = (day, insider) sorted by day."""
    out, i = [], 0
    while i < len(rows):
        d = rows[i][0]
        win = [r for r in (rows[i:] if second else rows) if d <= r[0] <= d + 7]
        if len({r[1] for r in win}) >= 2:
            if second:
                seen = set()
                for r in win:
                    seen.add(r[1])
                    if len(seen) == 2:
                        out.append(r[0])
                        break
            else:
                out.append(max(r[0] for r in win))
            i += len(win)
        else:
            i += 1
    return out


@pytest.mark.parametrize("mode", ["cluster", "second"])
def test_clusters_against_walk(spark, mode):
    import random

    rng = random.Random(11)
    data = {f"S{s}": sorted((rng.randrange(0, span), f"I{rng.randrange(k)}") for _ in range(n)) for s, (n, span, k) in enumerate([(300, 900, 4), (40, 30, 2), (25, 400, 1), (60, 60, 3)])}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=d), i, "BUY", False, 1.0) for s, xs in data.items() for d, i in xs]
    df = spark.createDataFrame(rows, "symbol string, filing_date date, insider_name string, transaction_type string, is_csuite boolean, total_value double").repartition(4)
    got = sorted((r.symbol, (r.event_date - dt.date(2020, 1, 1)).days) for r in E.greedy_windows(E.insider_days(df), mode).collect())
    assert got == sorted((s, d) for s, xs in data.items() for d in brute_clusters(xs, mode == "second"))


def test_wide_spaces_count_as_spaces(spark):
    from tidewatch.functions import text as X

    nb = "\u00a0"
    row = spark.createDataFrame(
        [(f"Item{nb}2.02 Results. Total{nb}revenue of ${nb}1,234.5{nb}million. Diluted{nb}EPS of $1.25. The company reaffirms{nb}its{nb}guidance. Item 9.01 Exhibits", f"{nb} <b>x</b>{nb}")],
        "t string, h string",
    ).select(
        X.detect_items(F.col("t")).alias("items"), X.reported_revenue(F.col("t")).alias("revenue"), X.reported_eps(F.col("t")).alias("eps"),
        X.guidance_status(F.col("t"))["has_affirmation"].alias("affirmed"), X.item_section(F.col("t"), F.lit("2.02")).alias("section"), X.strip_html(F.col("h")).alias("h"),
    ).first()
    assert row.items == ["2.02", "9.01"] and row.revenue == 1_234_500_000 and row.eps == 1.25 and row.affirmed
    assert row.section.startswith("Item") and "Exhibits" not in row.section and row.h == "x"


def test_words_and_folders_without_bounds(spark):
    from tidewatch.operators.feeds import mention_symbols

    bodies = spark.createDataFrame([("m", "buy $S1000000 and S1000000 and BRK.B")], "external_id string, body string")
    known = spark.createDataFrame([("S1000000",), ("BRK.B",), ("S100000",)], "symbol string")
    assert {r.symbol for r in mention_symbols(bodies, known).collect()} == {"S1000000", "BRK.B"}


def test_clock_without_a_session_is_null(spark):
    from tidewatch.functions import calendar as C

    days = [str(d.date()) for d in __import__("pandas").date_range("2026-03-01", "2026-05-01")]
    row = spark.sql("SELECT timestamp_ntz'2026-03-02 15:00:00' AS t").select(C.effective_start(F.col("t"), days).alias("none"), C.effective_start(F.col("t")).alias("open")).first()
    assert row.none is None and row.open.hour == 15


def test_plain_filings_by_form_rule_and_throttle(spark):
    from tidewatch.operators.decisions import plain_filing_alerts

    t0 = dt.datetime(2024, 1, 2)
    rows = [(1, "A", "8-K", 0), (2, "A", "8-K", 30), (3, "A", "4", 61), (4, "A", "8-K", 60), (5, "B", "8-K", 1), (6, "B", None, 2), (7, None, "8-K", 3), (8, None, "8-K", 4)]
    filings = spark.createDataFrame([(i, s, f, t0 + dt.timedelta(minutes=m)) for i, s, f, m in rows], "id int, symbol string, form_type string, at timestamp")
    rules = spark.createDataFrame([("8-K Material Event", True, 60), ("8-K Material Event", False, 999), ("other", True, 1)], "name string, is_active boolean, throttle_minutes int")
    got = {r.id: (r.action, r.conviction, r.direction) for r in plain_filing_alerts(filings, rules, "at", "id").collect()}
    sent, none = ("ALERT", 0.5, "negative"), (None, None)
    assert got == {1: sent, 2: ("THROTTLED", *none), 3: ("SKIP_NOT_8K", *none), 4: sent, 5: sent, 6: ("SKIP_NOT_8K", *none), 7: sent, 8: ("THROTTLED", *none)}
    off = plain_filing_alerts(filings, rules.filter("NOT is_active"), "at", "id").collect()
    assert {r.action for r in off} == {"SKIP_NO_RULE", "SKIP_NOT_8K"} and all(r.conviction is None for r in off)


def test_events_without_a_price_are_counted(spark):
    day = dt.date(2024, 1, 2)
    events = spark.createDataFrame([("A", day), ("A", day), ("B", day)], "symbol string, filing_date date")
    known = spark.createDataFrame([("A", day)], "symbol string, filing_date date")
    assert [tuple(r) for r in E.price_coverage(events, known).collect()] == [(3, 2, 1)]
    assert {tuple(r) for r in E.price_coverage(events, known, "symbol").collect()} == {("A", 2, 2, 0), ("B", 1, 0, 1)}


def test_moments_against_numpy(spark):
    """Small and large groups, ties, nulls: quantiles exact, winsorised moments from cells as from rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = {"large": rng.normal(5, 100, 30_000).round(1), "ties": np.repeat([1.0, 2.0, 7.0], [4000, 3000, 3000]), "small": rng.normal(0, 1, 40), "nine": rng.normal(0, 1, 9), "one": np.array([3.0])}
    rows = [(g, float(v)) for g, xs in data.items() for v in xs] + [("small", None)]
    got = {r.g: r for r in E.moments(spark.createDataFrame(rows, "g string, ret double").repartition(5), ["g"]).collect()}
    for g, xs in data.items():
        r, low, high = got[g], np.quantile(xs, 0.01), np.quantile(xs, 0.99)
        w = xs if len(xs) < 10 else np.clip(xs, low, high)
        assert r.n == len(xs) and r.median == pytest.approx(np.median(xs), rel=1e-12) and r["mean"] == pytest.approx(xs.mean(), rel=1e-9, abs=1e-12)
        assert r.w_mean == pytest.approx(w.mean(), rel=1e-9, abs=1e-12)
        assert (r.w_var is None) if len(xs) == 1 else r.w_var == pytest.approx(w.var(ddof=1), rel=1e-9)


@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_seeking_are_the_whole_order(spark, descending):
    from tidewatch.operators.reports import page_after

    rows = [(i, None if i % 7 == 0 else float(i * 37 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(3)
    want = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[0]))
    got, after = [], None
    while page := page_after(df, "v", "id", 13, after, descending).collect():
        got += [tuple(r) for r in page]
        after = (page[-1].v, page[-1].id)
    assert got == want


def test_guidance_is_found_from_its_first_stem_on(spark):
    """Matches agree with the plain patterns, and texts are neither translated nor searched where no stem stands."""
    import re

    texts = [
        "İ filler. The firm REAFFIRMS its adjusted outlook. GAAP basis: it cuts and trims its target.", "no verb but an outlook", "it cut costs", None,
        "continues\n to expect adj. results as forecast", "non-gaap guidance. Reduces guidance range; withdraws forecast, withdraws target", "x" * 300 + " narrows up expectations",
    ]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.guidance_status(F.col("t")).alias("g"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan
    for text, g in zip(texts, [r.g for r in got.collect()]):
        plain = re.sub(f"[{N.WIDE_SPACES}]", " ", text or "")
        n = {k: min(3, len(re.findall(p, plain, re.A))) for k, p in N.GUIDANCE_PATTERNS.items()}
        assert (g.has_affirmation, g.affirms_adjusted, g.has_lowering, g.has_raising, g.has_withdrawal) == (
            n["affirm"] > 0, n["affirm_adjusted"] > 0, n["lower"] > n["lower_gaap"], n["raise"] > 0, n["withdraw"] > 0), text


def test_missing_facts_by_unicode_case(spark):
    facts = ["unknown terms", "inſufficient data", "NİE podano", "noted", "not disclosed", "plain"]
    got = spark.createDataFrame([(facts,)], "f array<string>").select(N.missing_data_facts(F.col("f")).alias("m"))
    assert "translate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().m == ["unknown terms", "inſufficient data", "NİE podano", "not disclosed"]


def test_groups_are_numbers_and_symbols_have_their_own(spark):
    """Group rows carry numbers, symbols of any size agree with numpy, and only those with three events are groups."""
    import numpy as np

    rng = np.random.default_rng(5)
    sizes = {"L": E.SMALL + 50, "M": 25, "N": 9, "T": 3, "W": 2}
    data = {s: rng.normal(1, 30, n).round(2) for s, n in sizes.items()}
    rows = [(s, float(x), None, float(-x), 1.0, True, "strict", 2e5) for s, xs in data.items() for x in xs]
    schema = "symbol string, ret_1d double, ret_3d double, ret_7d double, ret_30d double, is_csuite boolean, tier string, total_value double"
    events = spark.createDataFrame(rows, schema).repartition(4)
    grouped = E.h8_rows(events)
    assert dict(grouped.dtypes)["members"] == "array<int>"
    base = spark.createDataFrame([("random", "X", "1d", float(i)) for i in range(20)], "baseline string, symbol string, horizon string, ret double")
    got = {(r.sub_group, r.horizon): r for r in E.horizon_stats(grouped, base, False, own=(events, "random")).collect()}
    assert {g for g, _ in got if g.startswith("ticker_")} == {"ticker_L", "ticker_M", "ticker_N", "ticker_T"} and not any(h == "3d" for _, h in got)
    b = np.arange(20.0)
    for s in "LMN":
        xs = data[s]
        r, w = got[f"ticker_{s}", "1d"], xs if len(xs) < 10 else np.clip(xs, np.quantile(xs, 0.01), np.quantile(xs, 0.99))
        bw = np.clip(b, np.quantile(b, 0.01), np.quantile(b, 0.99))
        pooled = ((len(xs) - 1) * w.var(ddof=1) + 19 * bw.var(ddof=1)) / (len(xs) + 18)
        assert (r.n, r.baseline, r.direction) == (len(xs), "random", "buy") and r.median_return_pct == pytest.approx(np.median(xs), abs=6e-4)
        assert r.effect_size_d == pytest.approx((w.mean() - bw.mean()) / pooled**0.5, abs=6e-4)
        assert r.avg_return_pct == pytest.approx(xs.mean(), abs=6e-4) and r.hit_rate_pct == pytest.approx((xs > 0).mean() * 100, abs=0.06)
    assert got["all", "1d"].n == sum(sizes.values())


def test_recent_history_against_a_scan(spark):
    """Histories across stretches, days with more rows than the limit, several filings a day; none is joined to its filing."""
    import random

    from tidewatch.operators.feeds import recent_history

    rnd = random.Random(4)
    trades = [(s, dt.date(2024, 1, 1) + dt.timedelta(rnd.choice([0, 5, 29, 30, 59, 60, 89, 90, 91, 119, 200])), f"t{i:04d}", f"a{rnd.randrange(40)}") for i in range(300) for s in ["AB"[i % 2]]]
    trades += [(None, dt.date(2024, 1, 1), "t9", "a1"), ("A", None, "t8", "a1")]
    found = recent_history(spark.createDataFrame(trades, "symbol string, transaction_date date, trade_id string, accession string"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for s, day, acc in {(s, d, a) for s, d, _, a in trades if s and d}:
        near = sorted(((d, t, a) for x, d, t, a in trades if x == s and d and 0 <= (day - d).days < 30), reverse=True)[:20]
        want |= {(s, day, acc, k, t, d) for k, (d, t, _) in enumerate(x for x in near if x[2] != acc)}
    assert {tuple(r) for r in found.collect()} == want


def test_ownership_documents_are_built_after_they_are_dealt_out(spark, tmp_path):
    from tidewatch.plans import QUERIES

    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    day = "TIMESTAMP_NTZ '2024-01-03 00:00:00'"
    rows = spark.sql(f"SELECT 1L, 2L, 3L, 2, 5e0, 100e0, 0e0, 0.08e0, 'A', 'F', {day} UNION ALL SELECT 1L, 2L, 3L, 2, 5e0, 100e0, 0e0, 0.08e0, 'A', 'F', {day} UNION ALL SELECT 9L, 2L, 3L, 6, 1e0, 1e0, 0e0, 0e0, 'R', 'F', NULL")
    rows.toDF(*[n.split()[0] for n in names.split(", ")]).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = QUERIES["s5_form4_xml"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "ownershipDocument" not in plan[plan.index("RepartitionByExpression"):]
    got = sorted((r.idx, r.transaction_type, r.shares, r.insider_name, r.is_plan) for r in out.collect())
    assert got == [(0, "BUY", 5.0, "I2 (co-filing z Fund LP)", True)] * 2 + [(1, "OTHER", 7.0, "I2 (co-filing z Fund LP)", True)] * 2
