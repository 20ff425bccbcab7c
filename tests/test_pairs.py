"""Sums of pairs by blocks against plain ones."""

import datetime as dt
import itertools

import numpy as np
import pytest

from barloom.operators import pairs
from barloom.operators.derived import series_correlations
from barloom.operators.portfolio import ewma_covariance

DAY = dt.date(2020, 1, 1)


def panel(n_series=9, n_days=1300, seed=2):
    """Values of about a million with gaps, over three parts of the calendar."""
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((n_days, n_series)) + 0.5 * rnd.standard_normal((n_days, 1)) + 1e6
    return [(f"s{j}", DAY + dt.timedelta(days=i), float(base[i, j])) for i in range(n_days) for j in range(n_series) if rnd.random() < 0.8 and (j, i // 512) != (3, 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date date, x double").repartition(5)


def common(rows, a, b):
    x, y = ({d: v for s, d, v in rows if s == name} for name in (a, b))
    days = sorted(set(x) & set(y))
    return np.array([[x[d] for d in days], [y[d] for d in days]])


@pytest.mark.parametrize("block", [1, 3, 64])
def test_moments_of_every_pair(spark, block):
    rows = panel()
    odd = [(None, DAY, 1.0), ("s1", None, 1.0), ("s1", DAY + dt.timedelta(days=5000), None), ("s1", DAY + dt.timedelta(days=5001), float("nan")), ("s2", DAY, float("inf"))]
    rows = [r for r in rows if r[:2] != ("s2", DAY)]
    got = {(r["a"], r["b"]): r for r in pairs.moments(frame(spark, rows + odd), "symbol", "x", block).collect()}
    names = sorted({r[0] for r in rows})
    assert set(got) == set(itertools.combinations_with_replacement(names, 2))
    for (a, b), r in got.items():
        m = common(rows, a, b)
        d = m - m.mean(axis=1, keepdims=True)
        assert r["n"] == m.shape[1]
        assert (r["mean_a"], r["mean_b"]) == pytest.approx(m.mean(axis=1), rel=1e-12)
        assert (r["m2_a"], r["m2_b"], r["c"]) == pytest.approx(((d[0] ** 2).sum(), (d[1] ** 2).sum(), (d[0] * d[1]).sum()), rel=1e-7, abs=1e-5)


def test_products_do_not_depend_on_the_deal(spark):
    rows = panel(7, 200)
    df = frame(spark, rows)
    one = {(r["a"], r["b"]): r["product"] for r in pairs.products(df, "symbol", "x", 1).collect()}
    for (a, b), value in one.items():
        m = common(rows, a, b)
        assert value == pytest.approx(m[0] @ m[1], rel=1e-12)
    assert {(r["a"], r["b"]): r["product"] for r in pairs.products(df, "symbol", "x").collect()} == pytest.approx(one, rel=1e-12)


def test_pairs_without_a_date_in_common_are_not_there(spark):
    rows = [("a", DAY, 1.0), ("b", DAY + dt.timedelta(days=1), 2.0), ("c", DAY, 3.0)]
    got = {(r["a"], r["b"]): r["product"] for r in pairs.products(frame(spark, rows), "symbol", "x").collect()}
    assert got == {("a", "a"): 1.0, ("a", "c"): 3.0, ("b", "b"): 4.0, ("c", "c"): 9.0}


def test_repeated_rows_pair_with_each(spark):
    rows = [("a", DAY, 1.0), ("a", DAY, 2.0), ("b", DAY, 5.0)]
    got = {(r["a"], r["b"]): (r["n"], r["mean_a"], r["c"]) for r in pairs.moments(frame(spark, rows), "symbol", "x").collect()}
    assert got["a", "b"] == (2, 1.5, 0.0) and got["a", "a"][0] == 4


def test_series_of_numbers_and_empty_tables(spark):
    df = spark.createDataFrame([(7, DAY, 2.0), (10, DAY, 3.0)], "symbol long, date date, x double")
    assert {(r["a"], r["b"]): r["product"] for r in pairs.products(df, "symbol", "x").collect()} == {(7, 7): 4.0, (7, 10): 6.0, (10, 10): 9.0}
    assert pairs.moments(df.limit(0), "symbol", "x").count() == 0


def test_flat_series_have_no_correlation(spark):
    rows = [(s, DAY + dt.timedelta(days=i), v) for i in range(5) for s, v in (("a", float(i)), ("b", 3.0), ("c", -2.0 * i))]
    got = {(r["a"], r["b"]): r["corr"] for r in series_correlations(frame(spark, rows), x="x").collect()}
    assert got["a", "b"] is None and got["a", "c"] == pytest.approx(-1.0)


def test_covariance_of_all_pairs(spark):
    rows = [(f"s{j}", DAY + dt.timedelta(days=i), 0.01 * ((i * j) % 5 - 2)) for i in range(20) for j in range(40)]
    got = {(r["symbol_i"], r["symbol_j"]): r["cov"] for r in ewma_covariance(frame(spark, rows).withColumnRenamed("x", "ret"), lam=0.9).collect()}
    assert len(got) == 40 * 41 // 2
    m, w = common(rows, "s3", "s4"), 0.1 * 0.9 ** np.arange(19, -1, -1)
    assert got["s3", "s4"] == pytest.approx((w * m[0] * m[1]).sum(), rel=1e-9)
