"""Study steps: what they exchange and order, and rows that the tables do not have."""

import re
from datetime import date

import pytest

TRADES = "trade_id string, symbol string, insider_name string, transaction_type string, total_value double, filing_date date, is_plan boolean, is_csuite boolean, is_director boolean, is_healthcare boolean"


def trade(i, symbol, insider, kind, value, day, healthcare):
    return (f"t{i}", symbol, insider, kind, value, day, False, True, False, healthcare)


@pytest.fixture()
def trades(spark):
    d = date(2024, 1, 3)
    return spark.createDataFrame(
        [
            trade(1, "A", "x", "SELL", 10.0, d, True), trade(2, "A", "x", "SELL", 20.0, date(2024, 1, 7), True), trade(3, "A", "x", "SELL", 5.0, date(2024, 1, 8), True),
            trade(4, "B", "x", "EXERCISE", 10.0, d, True), trade(5, "B", "x", "EXERCISE", 20.0, d, False),  # the healthcare row is not the week's largest
            trade(6, "C", "x", "EXERCISE", 10.0, d, None), trade(7, "C", "x", "EXERCISE", 20.0, d, True),
            trade(8, "D", "y", "BUY", 10.0, d, False), trade(9, None, None, "BUY", None, None, True), trade(10, None, None, "BUY", 1.0, None, True),
            trade(11, "E", "y", "BUY", 10.0, date(2024, 12, 30), None), trade(12, "E", "y", "BUY", 9.0, date(2025, 1, 2), None),
        ],
        TRADES,
    )


def test_week_dedup_orders_nothing_in_the_scan(spark, trades, tmp_path):
    from tidewatch.operators.study import insider_week_dedup

    trades.write.parquet(str(tmp_path / "trades"))
    rows = insider_week_dedup(spark.read.parquet(str(tmp_path / "trades")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange"):]
    assert sorted(r.trade_id for r in rows.collect()) == ["t10", "t11", "t2", "t3", "t5", "t7", "t8"]


def test_healthcare_symbols_are_those_of_deduplicated_rows(trades):
    from tidewatch.operators.study import healthcare_symbols, insider_week_dedup

    want = {r.symbol for r in insider_week_dedup(trades).filter("is_healthcare").select("symbol").distinct().collect()}
    got = [r.symbol for r in healthcare_symbols(trades).collect()]
    assert set(got) == want == {"A", "C", None} and len(got) == 3


def test_study_trades_of_some_types(trades):
    from tidewatch.operators.study import study_trades

    assert sorted((r.symbol, r.total_value) for r in study_trades(trades, ("SELL",)).collect()) == [("A", 5.0), ("A", 20.0)]


def test_entry_prices_exchange_both_sides_once(spark):
    from tidewatch.operators.outcomes import entry_prices

    day = lambda n: date(2024, 1, n)
    prices = spark.createDataFrame(
        [("A", day(2), 1.0), ("A", day(3), None), ("A", day(5), 3.0), ("A", None, 9.0), (None, day(4), 7.0), ("B", day(1), 5.0)], "symbol string, date date, close double"
    )
    days = spark.createDataFrame([("A", day(1)), ("A", day(1)), ("A", day(2)), ("A", day(3)), ("A", day(4)), ("A", day(6)), ("A", None), (None, day(4)), ("B", day(2))], "symbol string, date date")
    rows = entry_prices(days, prices, [1, 2])
    got = {(r.symbol, r.date and r.date.day): (r.entry_date and r.entry_date.day, r.entry_close, r.close_1, r.close_2) for r in rows.collect()}
    none = (None, None, None, None)
    assert got == {
        ("A", 1): (2, 1.0, None, 3.0), ("A", 2): (2, 1.0, None, 3.0), ("A", 3): (3, None, 3.0, None), ("A", 4): (5, 3.0, None, None), ("A", 6): none, ("A", None): none,
        (None, 4): (4, 7.0, None, None), ("B", 2): none,
    }
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1  # prices are not ordered on their own first


def test_random_baseline_joins_no_symbols(spark):
    from tidewatch.operators.study import random_baseline

    prices = spark.range(80).selectExpr("IF(id < 40, 'A', NULL) AS symbol", "DATE '2024-01-01' + CAST(id AS INT) AS date", "CAST(1 + id AS DOUBLE) AS close")
    rows = random_baseline(prices, samples=10)
    assert "<=>" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.symbol, r.horizon): r["count"] for r in rows.groupBy("symbol", "horizon").count().collect()} == {(s, h): 5 for s in ("A", None) for h in ("1d", "3d", "7d", "30d")}
    assert random_baseline(prices.filter("close < 0")).count() == 0


def test_prices_are_not_grouped_in_the_scan(spark):
    from tidewatch.plans.tables import Tables

    rows = Tables(spark, "/root/testdata/sf0.001").prices
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange"):]
    assert rows.count() == rows.select("symbol", "date").distinct().count()


@pytest.fixture()
def lineitem(spark, tmp_path):
    """Two healthcare symbols (S2, S4) and two others (S1, S3), with all types, on 60 days."""
    spark.range(960).selectExpr(
        "id AS l_orderkey", "id * 7 % 40 AS l_partkey", "id % 4 + 1 AS l_suppkey", "CAST(id DIV 4 % 7 + 1 AS INT) AS l_linenumber", "CAST(1 + id % 5 AS DOUBLE) AS l_quantity",
        "CAST(100 + id * 13 % 97 AS DOUBLE) AS l_extendedprice", "CAST(id % 10 AS DOUBLE) / 100 AS l_discount", "CAST(id % 9 AS DOUBLE) / 100 AS l_tax",
        "element_at(array('R', 'A', 'N'), CAST(id DIV 8 % 3 + 1 AS INT)) AS l_returnflag", "CAST(DATE '2024-01-01' + CAST(id DIV 16 AS INT) AS TIMESTAMP_NTZ) AS l_shipdate",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["h2_csuite_trades", "h4_role_seniority", "h7_cluster_buy_healthcare"])
def test_healthcare_queries_exchange_only_symbols_they_can_read(spark, lineitem, monkeypatch, name):
    from tidewatch.operators import study
    from tidewatch.plans import QUERIES, tables

    dealt, deal_out = [], study.deal_out
    for module in (study, tables):
        monkeypatch.setattr(module, "deal_out", lambda df, *keys: dealt.append(df) or deal_out(df, *keys))
    rows = QUERIES[name](spark, lineitem).collect()
    assert rows and len(dealt) == 2  # trades and prices
    assert [{r.symbol for r in df.select("symbol").distinct().collect()} for df in dealt] == [{"S2", "S4"}] * 2


def test_buys_store_no_prices(spark, lineitem, monkeypatch):
    from tidewatch.plans import QUERIES, tables

    def refused(df):
        raise AssertionError("prices are read once by this query")

    monkeypatch.setattr(tables, "cut_lineage", refused)
    assert {r.horizon for r in QUERIES["h7_cluster_buy_full"](spark, lineitem).collect()} <= {"1d", "3d", "7d", "30d"}


def test_healthcare_scope_keeps_symbols_with_some_healthcare_row(trades, monkeypatch):
    from tidewatch.operators import study

    told = study.healthcare_flags(trades)
    scope = study.healthcare_scope(trades, told)
    assert sorted(r.trade_id for r in scope.collect()) == ["t1", "t2", "t3", "t4", "t5", "t6", "t7"] and scope.columns == trades.columns
    kept = lambda rows: sorted(tuple(r) for r in study.study_trades(rows, ("SELL", "EXERCISE"), study.F.col("is_healthcare")).collect())
    assert kept(scope) == kept(trades) != []  # B's healthcare row stands behind a row of its week and stays out
    assert {r.symbol for r in study.healthcare_symbols(scope, told).collect()} == {"A", "C", None}
    monkeypatch.setattr(study, "FEW_SYMBOLS", 1)
    assert study.healthcare_scope(trades, told).count() == trades.count()
    prices = trades.selectExpr("symbol", "filing_date AS date", "total_value AS close")
    symbols = study.healthcare_symbols(trades, told)
    many = sorted(r.symbol for r in study.prices_of(prices, symbols).collect())
    monkeypatch.setattr(study, "FEW_SYMBOLS", 100)
    assert sorted(r.symbol for r in study.prices_of(prices, symbols).collect()) == many == ["A"] * 3 + ["C"] * 2


@pytest.fixture()
def closes(spark):
    """Prices of healthcare symbols (A, C), others (B, D) and of no symbol, with a day without a date and closes of none and zero."""
    rows = [(s, date.fromordinal(date(2024, 1, 1).toordinal() + k), float((k * 7 + i * 3) % 11 + 1)) for i, s in enumerate(("A", "B", "C", "D", None)) for k in range(70)]
    odd = [("A", None, 5.0), ("B", date(2025, 1, 1), None), ("C", date(2025, 1, 1), 0.0), ("E", date(2025, 1, 1), 3.0)]
    return spark.createDataFrame(rows + odd, "symbol string, date date, close double")


def test_scoped_baselines_are_those_of_the_part(spark, closes):
    from tidewatch.operators import study as E

    own = spark.createDataFrame([("A",), ("C",), (None,), ("Z",)], "symbol string")
    part, rest = closes.join(own, "symbol", "left_semi"), closes.join(own, "symbol", "left_anti")
    rows = lambda df: sorted(map(repr, df.collect()))
    for got, want in (
        (E.random_baseline(closes, 60, 43, "random", E.symbol_scope(own)), E.random_baseline(part, 60, 43, "random")),
        (E.random_baseline(closes, 60, 44, "rest", E.symbol_scope(own, within=False)), E.random_baseline(rest, 60, 44, "rest")),
        (E.dip_baseline(closes, 5, scope=E.symbol_scope(own)), E.dip_baseline(part, 5)),
        (E.dip_baseline(closes, 5, scope=E.symbol_scope(own), line=E.dealt_returns(closes)), E.dip_baseline(part, 5)),
    ):
        assert rows(got) == rows(want) != []
    assert {r.symbol for r in E.random_baseline(rest, 60, 44, "rest").collect()} == {"B", "D", None}
    assert {r.symbol for r in E.dip_baseline(closes, 5).collect()} == {"A", "B", "C", "D"}  # no dip without a symbol


def test_baselines_share_one_exchange_of_prices(spark, closes, tmp_path):
    """Before, every baseline exchanged its part of the prices, and dips met their rows in a join by symbol and date."""
    from tidewatch.operators import study as E

    closes.write.parquet(str(tmp_path / "closes"))
    prices, own = spark.read.parquet(str(tmp_path / "closes")), spark.createDataFrame([("A",), ("C",)], "symbol string")
    inside, outside, line = E.symbol_scope(own), E.symbol_scope(own, within=False), E.dealt_returns(prices)
    drawn = [
        E.random_baseline(prices, 60, 43, "a", inside, line), E.random_baseline(prices, 60, 42, "b", line=line), E.random_baseline(prices, 60, 44, "c", outside, line),
        E.dip_baseline(prices, 5, scope=inside, line=line),
    ]
    rows = drawn[0].unionByName(drawn[1]).unionByName(drawn[2]).unionByName(drawn[3])
    rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    dealt = [line for line in final if "Exchange hashpartitioning(symbol" in line and "REPARTITION_BY_NUM" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == 1 and len(dealt) == 4
    assert not any(re.search(r"hashpartitioning\(symbol#\d+, date", line) for line in final)


def test_buys_outside_healthcare_leave_before_the_exchange(trades, spark):
    from tidewatch.operators import study as E

    told = E.healthcare_flags(trades)
    rows = E._without_other_buys(trades, told)
    assert rows.columns == trades.columns
    assert {r.trade_id for r in trades.collect()} - {r.trade_id for r in rows.collect()} == {"t8", "t9", "t10", "t11", "t12"}  # D, E and no symbol


def test_full_run_stores_only_trades_it_reads(spark, trades, closes, monkeypatch):
    from tidewatch.operators import study as E

    d, stored = date(2024, 1, 3), []
    more = spark.createDataFrame(
        [
            trade(20, "B", "z", "SELL", 7.0, d, False), trade(21, "B", "w", "SELL", 7.0, d, False)[:7] + (False, False, False), trade(22, "D", "z", "BUY", 7.0, d, False),
            trade(23, "A", "z", "BUY", 7.0, d, True), trade(24, "A", "z", "BUY", 6.0, d, True),
        ],
        TRADES,
    )
    monkeypatch.setattr(E, "study_trades", lambda *a, f=E.study_trades, **k: stored.append(f(*a, **k)) or stored[-1])
    got = {(r.sub_group, r.horizon): r.n for r in E.full_run(trades.unionByName(more), closes).collect()}
    assert sorted((r.symbol, r.transaction_type, r.total_value) for r in stored[0].collect()) == [("A", "BUY", 7.0), ("A", "SELL", 5.0), ("A", "SELL", 20.0), ("B", "SELL", 7.0)]
    assert got["H5/all", "1d"] == 1 and got["H6/control_group", "1d"] == 1 and got["H6/healthcare", "1d"] == 2 and got["H2/all", "1d"] == 3


def test_report_table_deals_prices_once_for_its_baselines(spark, lineitem, monkeypatch):
    from tidewatch.operators import study
    from tidewatch.plans import QUERIES

    dealt = []
    monkeypatch.setattr(study, "dealt_returns", lambda prices, f=study.dealt_returns: dealt.append(prices) or f(prices))
    assert QUERIES["k5_report_table"](spark, lineitem).columns == ["value"] and len(dealt) == 1
