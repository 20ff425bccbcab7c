"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line (median of the warm runs, one by default)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans import load_plans  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = (
    "tier2_ranking", "tier1_eligibility", "universe_rotation", "percentile_rank", "macd_trend", "candle_mechanics", "asof_backward", "scaffold_densify", "market_breadth", "fund_overlap",
    "chain_snapshot", "black_scholes", "ternary_labels", "threshold_sweep", "expected_calibration_error", "signal_pnl", "novelty", "token_chunks", "article_dedupe", "tumbling_window", "ks_drift", "page_hinkley",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = os.environ.get("BENCH_ONLY")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="barloom-bench")
    plans = load_plans()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only.split(","):
            continue
        taken = []
        for _ in range(runs + 1):  # the first run warms up code generation and file listings
            start = time.perf_counter()
            plans[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
