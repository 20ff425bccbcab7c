"""Registered queries against their SQL. All of them with BARLOOM_ALL=1, otherwise a spread over every module."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, duck  # noqa: E402

from barloom.plans import load_plans  # noqa: E402

PLANS = load_plans()
SPREAD = [
    "macd_trend", "adx", "candle_mechanics", "earnings_seasonality", "cross_asset_family", "regime_probabilities", "dividend_features", "earnings_reports", "split_features", "holiday_features",
    "regime_smoothing", "tier2_ranking", "peer_snapshot", "tier1_eligibility", "satellite_selection", "threshold_sweep", "walkforward_threshold", "conformal_quantile", "evaluation_gates", "basic_caps", "signal_pnl",
    "walk_forward_windows", "date_folds", "family_quality_gate", "chain_snapshot", "black_scholes", "fund_leverage", "session_of_day", "insider_features", "fund_overlap", "panel_assembly", "session_arithmetic",
    "incremental_upsert", "token_chunks", "transcript_segments", "novelty", "stratified_sample", "quantile_calibration", "calibration_monitor", "page_hinkley", "ks_drift", "session_window",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(PLANS) if os.environ.get("BARLOOM_ALL") else SPREAD)
def test_matches_sql(spark, con, sf_dir, name):
    _, _, _, status = compare(PLANS[name], spark, con, sf_dir)
    assert status.startswith("ok") or status == "rows-only", status


def test_contract():
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert entry.FLAGSHIP in queries and set(oracle) <= set(queries)
    for name, plan in PLANS.items():
        assert plan.sql is not None or plan.why_no_sql, name


def test_every_inventory_row_is_covered():
    covered = {row for p in PLANS.values() for row in p.rows}
    assert len(covered) >= 442 and {9, 10} <= covered
