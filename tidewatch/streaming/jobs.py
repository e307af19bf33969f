"""Structured Streaming forms of the feeds and of the stateful operators.

State is keyed (ticker, contract, symbol and day), bounded by time to live and by the
number of rows the rules keep; sinks are idempotent, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch import schemas
from tidewatch.operators.correlation import PATTERN_THROTTLE
from tidewatch.sources.sinks import insert_if_absent

LATENESS = "1 day"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def read_events(spark: SparkSession, kind: str, path: str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """One event type from its landing folder, with its fixed schema."""
    reader = spark.readStream.schema(schemas.EVENTS[kind])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def first_seen(events: DataFrame, key: str, ts: str, ttl: str = "7 days") -> DataFrame:
    """Drop repeated keys within ``ttl``; older state is discarded by the watermark."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def summary_stream(alerts: DataFrame, hours: int = 8) -> DataFrame:
    """Tumbling alert summary per rule, emitted when the window closes.

    Windows are aligned to the epoch instead of the start of a process.
    """
    return (
        alerts.withWatermark("sent_at", LATENESS)
        .groupBy(F.window("sent_at", f"{hours} hours").alias("w"), "rule_name")
        .agg(F.count("*").alias("total"), F.sum(F.col("delivered").cast("int")).alias("delivered"))
        .select(F.col("w.start").alias("window_start"), "rule_name", "total", "delivered")
    )


def sink_absent(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Insert-if-absent per micro batch; a replayed batch finds its keys present."""

    def write(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch, path, keys, [F.col(order)])

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def daily_counter(rows: DataFrame, keys: list[str], ts: str, cap: int, day: Column | None = None) -> DataFrame:
    """Flag rows within the first ``cap`` of their key and day (arrival order).

    The state is one counter per key and day; it is dropped when the watermark is a day past the end of that day.
    """
    day = F.to_date(ts) if day is None else day
    keyed = rows.withWatermark(ts, LATENESS).withColumn("__day", day.cast("string"))
    names = [*keys, "__day"]

    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.count = handle.getValueState("count", "n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            n = self.count.get()[0] if self.count.exists() else 0
            for pdf in rows:
                pdf = pdf.sort_values(ts, kind="stable")
                for name, value in zip(names, key):
                    pdf[name] = value
                pdf["allowed"] = [n + i < cap for i in range(len(pdf))]
                n = min(n + len(pdf), cap)
                yield pdf
            self.count.update((n,))
            if not list(self.handle.listTimers()) and key[-1] is not None:
                self.handle.registerTimer(int(pd.Timestamp(key[-1]).timestamp() + 2 * 86_400) * 1000)
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            import pandas as pd

            self.count.clear()
            yield pd.DataFrame()

        def close(self) -> None:
            pass

    out = T.StructType([*keyed.schema.fields, T.StructField("allowed", T.BooleanType())])
    return keyed.groupBy(*names).transformWithStateInPandas(Counter(), out, "Append", "EventTime").drop("__day")


def baseline_stream(bars: DataFrame, points_cap: int = 20, min_points: int = 5, cap: float = 5.0) -> DataFrame:
    """Volume baseline of each contract as keyed state (same rules as the batch fold)."""
    schema = "occ string, session date, volume long, spike double, avg_after double, points int"

    class Baseline(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("baseline", "avg double, points int, last date")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            avg, points, last = self.state.get() if self.state.exists() else (None, 0, None)
            out = []
            bars_in = pd.concat(list(rows)).sort_values(["session", "volume"], kind="stable")
            for session, volume in zip(bars_in["session"].tolist(), bars_in["volume"].tolist()):
                if volume <= 0 or session == last:
                    continue
                if avg is None:
                    avg, points, ratio = float(volume), 1, 0.0
                else:
                    ratio = 0.0 if points < min_points or volume < 100 or avg <= 0 else volume / avg
                    counted = cap * avg if points >= min_points and avg > 0 and volume > cap * avg else float(volume)
                    n = min(points, points_cap - 1)
                    avg, points = (avg * n + counted) / (n + 1), min(points + 1, points_cap)
                last = session
                out.append((key[0], session, volume, float(ratio), avg, points))
            if avg is not None:
                self.state.update((avg, points, last))
            yield pd.DataFrame(out, columns=["occ", "session", "volume", "spike", "avg_after", "points"])

        def close(self) -> None:
            pass

    return bars.select("occ", "session", "volume").groupBy("occ").transformWithStateInPandas(Baseline(), schema, "Append", "None")


def correlation_stream(signals: DataFrame, debounce_ms: int = 10_000, keep: int = 50) -> DataFrame:
    """Stateful correlation per ticker: retention, debounced evaluation, live patterns, unchanged-set skip, claims.

    The first signal arms an event-time timer; when the watermark passes it, every signal
    of the ticker up to the timer is evaluated.  State per ticker: at most ``keep`` signals
    per class, the last pattern hash and one claim per pattern.  A claim here takes the
    delivered hold for patterns that no suppression rule of the pattern itself stops.
    """
    throttle = dict(PATTERN_THROTTLE)
    schema = "ticker string, now timestamp, pattern string, direction string, conviction double, conflict boolean, action string"
    columns = [c.split()[0] for c in schema.split(", ")]

    class Correlate(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.signals = handle.getListState("signals", "id string, cat string, conviction double, direction string, ts long")
            self.memo = handle.getValueState("memo", "hash string, ts long, armed long")
            self.claims = handle.getMapState("claims", "pattern string", "free_at long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            held = list(self.signals.get())
            first = None
            for pdf in rows:
                for r in pdf.itertuples(index=False):
                    ms = int(r.ts.timestamp() * 1000)
                    first = ms if first is None else min(first, ms)
                    if abs(r.conviction) >= 0.05:
                        held.append((r.id, r.source_category, float(r.conviction), r.direction, ms))
            memo = self.memo.get() if self.memo.exists() else ("", 0, -1)
            armed = memo[2]
            if armed < 0 and first is not None:
                armed = first + debounce_ms
                self.memo.update((memo[0], memo[1], armed))
                self.handle.registerTimer(armed)
            if held:
                self.signals.put(self.retained(held, armed))
            yield pd.DataFrame()

        def retained(self, held, now):
            """What the evaluation at ``now`` may use, and everything later for the evaluations after it."""
            order = lambda s: (s[4], s[0])
            short = sorted((s for s in held if s[1] != "form4" and now - 432_000_000 <= s[4] <= now), key=order)
            insider = sorted((s for s in held if s[1] == "form4" and now - 1_209_600_000 <= s[4] <= now), key=order)
            return short[-keep:] + insider[-keep:] + [s for s in held if s[4] > now]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            import hashlib
            import json

            import pandas as pd

            now = expiredTimerInfo.getExpiryTimeInMs()
            memo = self.memo.get() if self.memo.exists() else ("", 0, -1)
            held = self.retained([tuple(s) for s in self.signals.get()], now)
            if now != memo[2]:  # the ticker has been silent for the longest retention
                if not held and memo[2] < 0:
                    self.signals.clear()
                    self.memo.clear()
                    self.claims.clear()
                yield pd.DataFrame(columns=columns)
                return
            self.handle.registerTimer(now + 1_209_600_001)
            if held:
                self.signals.put(held)
            live = [s for s in held if s[4] <= now]
            later = [s[4] for s in held if s[4] > now]
            armed = min(later) + debounce_ms if later else -1
            if armed >= 0:
                self.handle.registerTimer(armed)
            found = self.patterns(live, now) if len(live) >= 2 else []
            digest, stamp = memo[0], memo[1]
            out = []
            if found:
                sets = sorted([{"type": p[0], "signalIds": sorted(s[0] for s in p[1])} for p in found], key=lambda d: d["type"])
                new = hashlib.sha256(json.dumps(sets, separators=(",", ":")).encode()).hexdigest()[:16]
                if not (digest == new and now - stamp <= 900_000):
                    digest, stamp = new, now
                    out = [self.claim(key[0], now, p) for p in found]
            self.memo.update((digest, stamp, armed))
            frame = pd.DataFrame(out, columns=columns)
            frame["now"] = pd.to_datetime(frame["now"], unit="ms")
            yield frame

        def claim(self, ticker, now, pattern):
            name, sigs, direction = pattern
            conviction = self.conviction(sigs)
            net = {}
            for s in sigs:
                net[s[1]] = net.get(s[1], 0.0) + abs(s[2]) * (1 if s[3] == "positive" else -1)
            signs = {v > 0 for v in net.values() if abs(v) >= 0.05}
            conflict = len(net) >= 2 and len(signs) == 2
            if abs(conviction) < 0.20:
                return (ticker, now, name, direction, conviction, conflict, "SKIP_LOW_CONVICTION")
            if self.claims.containsKey((name,)) and now < self.claims.getValue((name,))[0]:
                return (ticker, now, name, direction, conviction, conflict, "DEDUP_SKIP")
            quiet = conflict or (name == "INSIDER_CLUSTER" and direction == "negative")
            seconds = 900 if quiet else throttle[name]
            self.claims.updateValue((name,), (now + seconds * 1000,))
            reason = "DIRECTION_CONFLICT" if conflict else "CLUSTER_SELL_NO_EDGE"
            action = f"ALERT_DB_ONLY_{reason}" if quiet else "ALERT_SENT_TELEGRAM"
            return (ticker, now, name, direction, conviction, conflict, action)

        def patterns(self, live, now):
            hour = 3_600_000
            short = [s for s in live if s[1] != "form4" and s[4] >= now - 120 * hour]
            insider = [s for s in live if s[1] == "form4" and s[4] >= now - 14 * 24 * hour]

            def within(rows, hours, cat):
                return [s for s in rows if s[1] == cat and s[4] > now - hours * hour]

            def dominant(rows):
                n = len(rows)
                for d in ("positive", "negative"):
                    if sum(s[3] == d for s in rows) >= n * 0.66:
                        return d
                return None

            out = []
            for name, cat, hours in (("INSIDER_PLUS_8K", "8k", 24), ("INSIDER_PLUS_OPTIONS", "options", 120)):
                a, b = within(insider, hours, "form4"), within(short, hours, cat)
                if a and b and dominant(a + b):
                    out.append((name, a + b, dominant(a + b)))
            recent = within(insider, 7 * 24, "form4")
            sells = [s for s in recent if s[3] == "negative"]
            if len(recent) >= 2 and dominant(recent) == "negative" and len(sells) >= 2:
                out.append(("INSIDER_CLUSTER", sells, "negative"))
            return out

        def conviction(self, sigs):
            best = {}
            for s in sigs:
                if s[1] not in best or abs(s[2]) > abs(best[s[1]][2]):
                    best[s[1]] = s
            top = None
            for s in best.values():
                if top is None or abs(s[2]) >= abs(top[2]):
                    top = s
            agree = sum(s[3] == top[3] for s in best.values())
            return min(1.0, abs(top[2]) * (1 + 0.2 * (agree - 1))) * (1 if top[3] == "positive" else -1)

        def close(self) -> None:
            pass

    rows = signals.withWatermark("ts", LATENESS).select("id", "ticker", "source_category", "conviction", "direction", "ts")
    return rows.groupBy("ticker").transformWithStateInPandas(Correlate(), schema, "Append", "EventTime")


def outcome_stream(ticks: DataFrame, alerts_path: str, version_path, benchmarks: dict[str, str], checkpoint: str) -> StreamingQuery:
    """Scheduled slot fill: each batch of ticks writes the next version of the open alerts.

    ``version_path(batch_id)`` names the folder of a version; filled slots are never
    overwritten, so replaying a batch writes the same rows again.
    """
    from tidewatch.operators.outcomes import fill_price_slots

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        source = alerts_path if batch_id == 0 else version_path(batch_id - 1)
        if batch.isEmpty():  # nothing to fill in; the next batch still finds its version
            spark.read.parquet(source).write.mode("overwrite").parquet(version_path(batch_id))
            return
        now = batch.agg(F.max("ts").cast("timestamp_ntz")).scalar()
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        fill_price_slots(spark.read.parquet(source), rows, now, benchmarks).write.mode("overwrite").parquet(version_path(batch_id))

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
