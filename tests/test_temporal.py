"""Order-dependent operators against brute force, with a hot key and small chunks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import temporal as T


@pytest.fixture(scope="module")
def points():
    rng = random.Random(7)
    out = []
    for key, n in (("hot", 400), ("warm", 60), ("cold", 3)):
        for i, p in enumerate(sorted(rng.sample(range(20_000), n))):
            out.append((key, p, f"{key}{i}", rng.random()))
    rng.shuffle(out)
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "k string, pos long, id string, v double").repartition(parts)


def test_lag_crosses_chunks(spark, points):
    got = {(r.k, r.pos): r.prev.id if r.prev else None for r in T.lag_in_order(frame(spark, points), ["k"], "pos", ["id"], ["id"], width=97).collect()}
    want, last = {}, {}
    for k, p, i, _ in sorted(points):
        want[k, p], last[k] = last.get(k), i
    assert got == want


@pytest.mark.parametrize("width", [50, 1_000, None])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof(spark, points, direction, width):
    left = [(k, p + (i % 3) - 1, f"L{i}", 0.0) for i, (k, p, _, _) in enumerate(points)]
    out = T.asof_join(frame(spark, left), frame(spark, points), ["k"], "pos", "pos", ["id"], direction, width=width)
    got = {r.id: r.match.id if r.match else None for r in out.collect()}
    by = defaultdict(list)
    for k, p, i, _ in points:
        by[k].append((p, i))
    for k, p, i, _ in left:
        if direction == "backward":
            best = max((x for x in by[k] if x[0] <= p), default=None)
        else:
            best = min((x for x in by[k] if x[0] >= p), default=None)
        assert got[i] == (best[1] if best else None)


@pytest.mark.parametrize("parts", [1, 5])
def test_greedy_accept(spark, points, parts):
    """Both ways (walked islands, followed chains) equal the sequential throttle."""
    hold = lambda p: 40 if p % 3 else 300
    rows = frame(spark, points, parts).withColumn("hold", F.when(F.col("pos") % 3 == 0, 300).otherwise(40))
    got = {(r.k, r.pos) for r in T.greedy_accept(rows, ["k"], "pos", "hold", 300, 500).filter("accepted").collect()}
    want, free = set(), {}
    for k, p, _, _ in sorted(points):
        if p >= free.get(k, -1):
            want.add((k, p))
            free[k] = p + hold(p)
    assert got == want


def test_flag_first_k(spark, points):
    out = T.flag_first_k(frame(spark, points), ["k"], ["v", "id"], 5, "top").filter("top").collect()
    by = defaultdict(list)
    for k, _, i, v in points:
        by[k].append((v, i))
    assert {r.id for r in out} == {i for rows in by.values() for _, i in sorted(rows)[:5]}


def test_exact_quantiles(spark):
    rng = random.Random(3)
    rows = [("hot", 0, "", rng.gauss(0, 1) if i % 4 else 0.25) for i in range(30_000)] + [("small", 0, "", float(v)) for v in (1, 2, 3, 10)]
    df = frame(spark, rows)
    got = {r.k: (r.q0, r.q1, r.q2) for r in T.exact_quantiles(df, ["k"], "v", [0.01, 0.5, 0.99]).collect()}
    want = {r.k: tuple(r.q) for r in df.groupBy("k").agg(F.percentile("v", [0.01, 0.5, 0.99]).alias("q")).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)
    assert got["small"][0] == pytest.approx(1.03)


def test_interval_join(spark, points):
    spans = spark.createDataFrame([("hot", 100, 900), ("warm", 0, 20_000)], "k string, lo long, hi long")
    out = T.interval_join(frame(spark, points), spans, ["k"], "pos", "lo", "hi", 128)
    want = {i for k, p, i, _ in points if (k == "hot" and 100 <= p <= 900) or k == "warm"}
    assert sorted(r.id for r in out.collect()) == sorted(want)


def test_null_keys_and_positions_keep_their_rows(spark):
    rows = spark.createDataFrame(
        [("a", 1, "r1"), (None, 5, "r2"), (None, 900, "r3"), ("a", None, "r4"), (None, None, "r5"), ("a", 2000, "r6")], "k string, pos long, id string"
    )
    lagged = {r.id: r.prev and r.prev.id for r in T.lag_in_order(rows, ["k"], "pos", ["id"], ["id"], width=100).collect()}
    assert lagged == {"r4": None, "r1": "r4", "r6": "r1", "r5": None, "r2": "r5", "r3": "r2"}
    right = spark.createDataFrame([("a", 0, 1), (None, 4, 2), (None, None, 3)], "k string, at long, v int")
    for width in (100, None):
        hits = {r.id: r.match and r.match.v for r in T.asof_join(rows, right, ["k"], "pos", "at", ["v"], width=width).collect()}
        assert hits == {"r1": 1, "r2": 2, "r3": 2, "r4": None, "r5": None, "r6": 1}
    flags = {r.id: r.top for r in T.flag_first_k(rows, ["k"], ["pos", "id"], 2, "top").collect()}
    assert flags == {"r4": True, "r1": True, "r6": False, "r5": True, "r2": True, "r3": False}
    held = rows.withColumn("hold", F.lit(1000))
    taken = {r.id for r in T.greedy_accept(held, ["k"], "pos", "hold", 1000, 100).filter("accepted").collect()}
    assert taken == {"r1", "r6", "r2"} and T.greedy_accept(held, ["k"], "pos", "hold", 1000, 100).count() == 6


@pytest.mark.parametrize("keep, width", [(3, 97), (50, 1_000), (1, 20_000)])
def test_newest_by_rank(spark, points, keep, width):
    """Against a scan, with a hot key, ties, null keys, rows without a position and a class that is rare."""
    rng = random.Random(keep)
    rows = [(k, p - p % 5, i, v) for k, p, i, v in points] + [(None, p, f"n{p}", 0.5) for p in range(0, 900, 30)] + [("hot", None, "lost", 0.1)]
    asked = [(k, rng.randrange(-50, 21_000)) for k in ("hot", "warm", "cold", None, "nothing here") for _ in range(60)] + [("hot", None)] * 2
    asked += [(k, p) for k, p, _, _ in rows[:80] if p is not None]
    classes = {"many": (F.col("v") >= 0.1, 4_000), "few": (F.col("v") < 0.05, 9_000)}
    probes = spark.createDataFrame(asked, "k string, pos long").repartition(3)
    got = T.newest_by_rank(frame(spark, rows), probes, ["k"], "pos", "id", classes, keep, width).collect()
    want = {}
    for k, at in asked:
        for name, test, reach in (("many", lambda v: v >= 0.1, 4_000), ("few", lambda v: v < 0.05, 9_000)):
            seen = sorted((p, i) for key, p, i, v in rows if key == k and p is not None and at is not None and p <= at and test(v))
            want[k, at, name] = [x for x in seen[-keep:] if x[0] >= at - reach]
    assert len(got) == len(set(asked))
    for r in got:
        for name in ("many", "few"):
            assert [(x.pos, x.id) for x in r[name]] == want[r.k, r.pos, name]


def test_running_counts(spark, points):
    got = {r.id: (r.a, r.b) for r in T.running_counts(frame(spark, points), ["k"], "pos", ["id"], {"a": F.lit(True), "b": F.col("v") < 0.3}, 97).collect()}
    seen = defaultdict(lambda: [0, 0])
    for k, _, i, v in sorted(points):
        seen[k][0] += 1
        seen[k][1] += v < 0.3
        assert got[i] == tuple(seen[k])


def test_a_million_links_in_one_key(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.col("id") * 10).alias("pos"), F.when(F.col("id") % 5 == 0, 25).otherwise(10).alias("hold"))
    got = T.greedy_accept(rows, ["k"], "pos", "hold", 25, 100_000).filter("accepted")
    # of every five rows the first is taken, the next two lie within its hold and the others follow one by one
    assert got.count() == 600_000 and got.filter("(pos / 10) % 5 IN (1, 2)").isEmpty()


@pytest.mark.parametrize("width, most", [(7, 60), (40, 900), (10_000, 50)])
def test_stretches_shorter_and_longer_than_holds(spark, width, most):
    rng = random.Random(width)
    rows = [(k, p, rng.choice((0, 1, most // 3, most))) for k in ("a", "b", None) for p in sorted(rng.sample(range(-3_000, 9_000), 700))]
    df = spark.createDataFrame(rows, "k string, pos long, hold long").repartition(5)
    want, free = set(), {}
    for k, p, hold in sorted(rows, key=lambda r: r[1]):
        if p >= free.get(k, -10_000):
            want.add((k, p))
            free[k] = p + hold
    assert {(r.k, r.pos) for r in T.greedy_accept(df, ["k"], "pos", "hold", most, width).filter("accepted").collect()} == want
