"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "a1_hit_rate_by_rule", "a17_ticker_profile", "w1_signal_timeline", "j6_price_slots", "j17_alert_snapshot", "w3_event_returns",
    "w2_insider_week_dedup", "q1_volume_baseline", "m9_flow_score", "m19_form4_actions", "a13_filing_groups", "j12_recent_history",
    "q5_throttle", "c1_insider_plus_8k", "c10_pattern_alerts", "t4_guidance_status", "t9_mention_symbols", "s5_form4_xml",
    "h3_plan_sells", "h7_cluster_buy_full",
)


def main() -> None:
    from tidewatch.plans import QUERIES
    from tidewatch.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidewatch-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
