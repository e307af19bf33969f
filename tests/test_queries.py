"""Registered queries against their oracle SQL on the smallest data set.

TIDEWATCH_ALL=1 runs every query; the default covers each area once.
"""

import os

import pytest

from compare import compare, duck

SF = "/root/testdata/sf0.001"
CORE = (
    "a1_hit_rate_by_rule a13_filing_groups a17_ticker_profile a21_horizon_stats a29_discovery_prefilter c1_insider_plus_8k h7_cluster_buy_full "
    "j6_price_slots j8_lone_buys j12_recent_history k2_upsert m3_effective_start m19_form4_actions m21_decisions m22_dispatch q1_volume_baseline "
    "q2_cluster_events q5_throttle s5_form4_xml t4_guidance_status t9_mention_symbols w1_signal_timeline w7_delivery_gate"
).split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def names():
    from tidewatch.plans import ORACLES

    return sorted(ORACLES) if os.environ.get("TIDEWATCH_ALL") else CORE


@pytest.mark.parametrize("name", names())
def test_oracle(spark, con, name):
    from tidewatch.plans import ORACLES, QUERIES

    got = QUERIES[name](spark, SF).toArrow()
    assert compare(got, con.execute(ORACLES[name]).to_arrow_table()) is None


def test_result_does_not_depend_on_partitions(spark):
    from tidewatch.plans import QUERIES

    seen = set()
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(str, QUERIES["w1_signal_timeline"](spark, SF).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_registry_contract():
    from tidewatch.plans import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 200
