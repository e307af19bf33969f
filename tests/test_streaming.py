"""Streams driven to completion over small files, compared with their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.options import volume_baseline
from tidewatch.streaming import jobs


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    jobs.use_rocksdb(spark)


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    if q.exception():
        raise q.exception()
    return q


def test_baseline_stream_equals_batch(spark, tmp_path):
    rows = [(f"O:{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 3), 100 + (i * 37) % 900 if i % 17 else 9000) for i in range(90)]
    bars = spark.createDataFrame(rows, "occ string, session date, volume long").withColumn("seen_at", F.col("session").cast("timestamp"))
    for part in range(3):
        lo, hi = dt.date(2024, 1, 1 + part * 10), dt.date(2024, 1, 11 + part * 10) if part < 2 else dt.date(2024, 3, 1)
        bars.filter((F.col("session") >= lo) & (F.col("session") < hi)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = jobs.read_events(spark, "flows", str(tmp_path / "in"), files_per_batch=1)
    drain(jobs.baseline_stream(stream), "baseline")
    got = {(r.occ, r.session): (r.volume, round(r.spike, 9), round(r.avg_after, 9), r.points) for r in spark.table("baseline").collect()}
    want = {(r.occ, r.session): (r.volume, round(r.spike, 9), round(r.avg_after, 9), r.points) for r in volume_baseline(bars).collect()}
    assert got == want and len(got) == 90


def test_correlation_stream_fires_once_and_skips_unchanged(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 10, 12)
    sig = lambda i, ticker, cat, c, d, s: (i, ticker, cat, c, d, "unknown", t0 + dt.timedelta(seconds=s))
    first = [
        sig("a", "AAA", "form4", 0.6, "positive", 0), sig("b", "AAA", "8k", 0.4, "positive", 5),
        sig("c", "BBB", "form4", -0.2, "negative", 0), sig("d", "CCC", "form4", 0.01, "positive", 0), sig("e", "CCC", "8k", 0.9, "positive", 1),
    ]
    close = [sig("z", "ZZZ", "news", 0.5, "positive", 5 * 86_400)]
    for rows in (first, close):
        spark.createDataFrame(
            rows, "id string, ticker string, source_category string, conviction double, direction string, catalyst_type string, ts timestamp"
        ).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = jobs.read_events(spark, "signals", str(tmp_path / "in"), files_per_batch=1)
    drain(jobs.correlation_stream(stream), "correlated")
    got = [(r.ticker, r.pattern, r.direction, round(r.conviction, 6), r.action) for r in spark.table("correlated").collect()]
    assert got == [("AAA", "INSIDER_PLUS_8K", "positive", 0.72, "ALERT_SENT_TELEGRAM")]


def test_dedup_and_sink_are_idempotent(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1)
    rows = [(f"acc{i % 5}", "S1", "4", ts + dt.timedelta(minutes=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "accession string, symbol string, form_type string, seen_at timestamp")
    df.write.json(str(tmp_path / "in"))
    stream = jobs.read_events(spark, "filings", str(tmp_path / "in"))
    jobs.sink_absent(jobs.first_seen(stream, "accession", "seen_at"), str(tmp_path / "out"), ["accession"], "seen_at", str(tmp_path / "ck")).awaitTermination(120)
    again = jobs.read_events(spark, "filings", str(tmp_path / "in"))
    jobs.sink_absent(again, str(tmp_path / "out"), ["accession"], "seen_at", str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_daily_counter_and_summary(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1)
    rows = [(i, f"S{i % 2}", "r", True, ts + dt.timedelta(hours=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, symbol string, rule_name string, delivered boolean, sent_at timestamp")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = jobs.read_events(spark, "alerts", str(tmp_path / "in"))
    drain(jobs.daily_counter(stream, ["symbol"], "sent_at", 5), "capped")
    got = spark.table("capped")
    assert got.count() == 30
    per_day = {(r.symbol, r.d): r.n for r in got.filter("allowed").groupBy("symbol", F.to_date("sent_at").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert per_day == {("S0", dt.date(2024, 1, 1)): 5, ("S1", dt.date(2024, 1, 1)): 5, ("S0", dt.date(2024, 1, 2)): 3, ("S1", dt.date(2024, 1, 2)): 3}
    drain(jobs.summary_stream(jobs.read_events(spark, "alerts", str(tmp_path / "in"))), "summary", "complete")
    assert spark.table("summary").agg(F.sum("total")).first()[0] == 30


def test_outcome_versions(spark, tmp_path):
    cols = "id long, symbol string, sent_at timestamp_ntz, price_at_alert double, price_outcome_done boolean, " + ", ".join(
        f"{c} double" for c in ("price1h", "price4h", "price1d", "price3d", "price7d")
    )
    at = dt.datetime(2024, 1, 9, 16)
    spark.createDataFrame([(1, "S1", at, 10.0, False, None, None, None, None, 99.0)], cols).write.parquet(str(tmp_path / "alerts"))
    ticks = [("S1", at + dt.timedelta(hours=1), 11.0, 1), ("S1", at + dt.timedelta(hours=23), 12.0, 2), ("S1", at + dt.timedelta(hours=25), 13.0, 3)]
    spark.createDataFrame(ticks, "symbol string, ts timestamp, price double, tick_id long").coalesce(1).write.json(str(tmp_path / "ticks"))
    stream = spark.readStream.schema("symbol string, ts timestamp, price double, tick_id long").json(str(tmp_path / "ticks"))
    jobs.outcome_stream(stream, str(tmp_path / "alerts"), lambda b: str(tmp_path / f"v{b}"), {}, str(tmp_path / "ck")).awaitTermination(120)
    r = spark.read.parquet(str(tmp_path / "v0")).first()
    assert (r.price1h, r.price4h, r.price1d, r.price3d, r.price7d, r.price_outcome_done) == (11.0, 12.0, 13.0, None, 99.0, False)
