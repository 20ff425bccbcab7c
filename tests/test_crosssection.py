"""Panels are ranked date by date where their rows are: exact, and without making the bars again."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.orderstats import group_zscore, with_ranks
from barloom.operators import crosssection as op
from barloom.plans import load_plans


def odd_rows(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("abc"), rnd.choice([None, 0.0, -0.0, float("nan"), float("inf"), 1.5, rnd.gauss(0, 1)])) for _ in range(500)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, ("flat", 2.0), ("empty", None), (None, 1.0), (None, 1.0)])], "i int, k string, x double")


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_in_place_are_those_of_any_group(spark, descending):
    df, out = odd_rows(spark), {"avg": "avg", "pct": "pct", "lo": "min", "d": "dense", "n": "total"}
    got, want = (with_ranks(df, ["k"], "x", out, descending, whole=w).select("i", *out).toPandas().sort_values("i", ignore_index=True) for w in (True, False))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_zscores_in_place_are_those_of_any_group(spark):
    df = odd_rows(spark).where("x is null or abs(x) < 100")
    got, want = (group_zscore(df, ["k"], {"z": "x"}, 3.0, whole=w).select("i", "z").toPandas().sort_values("i", ignore_index=True) for w in (True, False))
    pd.testing.assert_frame_equal(got, want, rtol=1e-12)


def test_peers_of_repeated_and_missing_keys(spark):
    rows = [(s, d, "A" if i % 2 else "B", f"I{i % 3}", float(i)) for i, s in enumerate("uvwxyz") for d in ("d1", None)]
    df = spark.createDataFrame([*rows, rows[0], ("n", "d1", None, "I0", 1.0), ("m", "d1", "A", "I0", None)], "symbol string, date string, sector string, industry string, pe double")
    got = op.peer_percentiles(df, ["pe"], 0, 0, neutral=0.0, fallback=False)
    p = df.toPandas()
    want = p.assign(s=p.groupby(["date", "sector"])["pe"].rank(pct=True).fillna(0.0), i=p.groupby(["date", "industry"])["pe"].rank(pct=True).fillna(0.0))
    have = sorted(map(tuple, got.select("symbol", F.coalesce("date", F.lit("-")), "sector_pe_pct", "industry_pe_pct").collect()))
    assert have == sorted(zip(want["symbol"], want["date"].fillna("-"), want["s"], want["i"], strict=True))
    counts = op.peer_counts(got, "pe")
    assert counts.count() == 8 and {r["symbol"]: r["sector_peer_count"] for r in counts.collect()} == {"u": 4, "w": 4, "y": 4, "v": 3, "x": 3, "z": 3, "m": 3}


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("tier2_ranking", 2, 5), ("tier2_top10", 2, 6), ("peer_snapshot", 1, 4), ("peer_percentiles", 1, 4)])
def test_bars_are_made_once(spark, sf_dir, name, scans, exchanges):
    query = load_plans()[name].run(spark, sf_dir)._jdf.queryExecution()
    assert query.optimizedPlan().toString().count("Relation [l_orderkey") == scans  # bars, and the calendar
    assert query.executedPlan().toString().count("Exchange hashpartitioning") + query.executedPlan().toString().count("Exchange rangepartitioning") <= exchanges
