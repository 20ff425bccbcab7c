"""Isotonic fits against the min-max formula, over several ranges and levels."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import isotonic as iso


def min_max(rows):
    """Most over starts of the least over ends of the means between, by distinct value."""
    xs = sorted({x for x, y in rows if x is not None and y is not None})
    w = [sum(a == x and b is not None for a, b in rows) for x in xs]
    s = [sum(b for a, b in rows if a == x and b is not None) for x in xs]
    out = {}
    for i, x in enumerate(xs):
        best = None
        for j in range(i + 1):
            least = min(sum(s[j : k + 1]) / sum(w[j : k + 1]) for k in range(i, len(xs)))
            best = least if best is None else max(best, least)
        out[x] = best
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_min_max_formula(spark, monkeypatch, seed):
    monkeypatch.setattr(iso, "FAN", 2)
    rnd = random.Random(seed)
    rows = [(round(rnd.random(), 2), rnd.choice([0, 1]) if seed else 1 - i % 7) for i in range(250)]
    rows += [(0.5, 1)] * 60 + [(None, 1), (0.3, None)]
    df = spark.createDataFrame(rows, "p double, y int").withColumn("lo", F.lit("x")).withColumn("range", F.lit(1))
    want = min_max(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = iso.isotonic(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    assert all(r.calibrated is None if r.p is None else r.calibrated == pytest.approx(want[r.p], abs=1e-12) for r in got)


def test_odd_tables(spark):
    rows = [(0.1, 1.0), (0.9, 0.0), (0.05, None), (0.95, None), (float("nan"), 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y double")
    got = {str(r.p): r.calibrated for r in iso.isotonic(df).collect()}
    assert got == {"0.1": 0.5, "0.9": 0.5, "0.05": 0.5, "0.95": 0.5, "nan": None, "0.5": 0.5}
    assert iso.isotonic(df.limit(0)).count() == 0
    assert [r.calibrated for r in iso.isotonic(df.where("y IS NULL")).collect()] == [None] * 3
