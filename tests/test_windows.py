"""Window helpers against pandas and hand-made edge cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import clip, norm_cdf, ratio, row_mean
from barloom.functions.ordered import Level, Rank, scan
from barloom.functions.windows import SYM, Roll


def series(spark, values, symbol="A"):
    rows = [(symbol, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, x double")


def column(df, c):
    return [r[c] for r in df.orderBy("date").select(c).collect()]


def close(got, want):
    for g, w in zip(got, want, strict=True):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None
        else:
            assert g == pytest.approx(w, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("alpha,adjust", [(2 / 13, False), (2 / 253, True), (1 / 14, False), (0.5, False), (0.9, True)])
def test_ewm_equals_recurrence(spark, alpha, adjust):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 20, 700)
    got = column(SYM.ewm(series(spark, [float(v) for v in x]), {"e": ("x", alpha)}, adjust=adjust), "e")
    close(got, pd.Series(x).ewm(alpha=alpha, adjust=adjust).mean().tolist())


def test_ewm_starts_at_first_value(spark):
    got = column(SYM.ewm(series(spark, [None, None, 4.0, 8.0]), {"e": ("x", 0.5)}), "e")
    close(got, [None, None, 4.0, 6.0])


def test_minimum_rows_count_values_not_rows(spark):
    df = series(spark, [1.0, None, 3.0, 5.0]).withColumn("m", SYM.mean("x", 3, 2))
    close(column(df, "m"), [None, None, 2.0, 4.0])


def test_shifted_frame_excludes_today(spark):
    df = series(spark, [1.0, 2.0, 3.0, 100.0]).withColumn("m", SYM.mean("x", 3, shift=1))
    close(column(df, "m"), [None, None, None, 2.0])


@pytest.mark.parametrize("kind", ["skew", "kurt"])
def test_bias_corrected_moments(spark, kind):
    x = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0]
    df = series(spark, x).withColumn("m", getattr(SYM, kind)("x", 5))
    close(column(df, "m"), getattr(pd.Series(x).rolling(5), kind)().tolist())


def test_flat_window_gives_null(spark):
    df = series(spark, [2.0] * 6).withColumns({"z": SYM.z("x", 4), "c": SYM.corr("x", "x", 4), "s": SYM.skew("x", 4), "b": SYM.beta("x", "x", 4)})
    for c in "zcsb":
        assert column(df, c) == [None] * 6


def test_percent_rank_ties_and_nulls(spark):
    x = [3.0, 1.0, None, 3.0, 2.0]
    df = SYM.ordered(series(spark, x), {"p": Rank("x", 5, 1)})
    close(column(df, "p"), pd.Series(x).rolling(5, min_periods=1).rank(pct=True).tolist())


def test_rolling_quantile(spark):
    x = [5.0, 1.0, 4.0, 2.0, 9.0]
    df = SYM.ordered(series(spark, x), {"q": Level("x", 0.3, 3)})
    close(column(df, "q"), pd.Series(x).rolling(3).quantile(0.3).tolist())


def test_corr_uses_complete_pairs(spark):
    rows = [("A", dt.date(2024, 1, i + 1), a, b) for i, (a, b) in enumerate([(1.0, 2.0), (2.0, None), (3.0, 1.0), (4.0, 5.0), (5.0, 3.0)])]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, y double").withColumn("c", SYM.corr("x", "y", 5, 3))
    p = pd.DataFrame(rows, columns=["s", "d", "x", "y"])
    close(column(df, "c"), p["x"].rolling(5, min_periods=3).corr(p["y"]).tolist())


def test_days_since_and_to(spark):
    df = SYM.numbered(series(spark, [0.0, 1.0, 0.0, 0.0, 1.0, 0.0]))
    df = df.withColumns({"a": SYM.days_since(F.col("x") == 1, 9999), "b": SYM.days_to(F.col("x") == 1, 9999)})
    assert column(df, "a") == [9999.0, 0.0, 1.0, 2.0, 0.0, 1.0]
    assert column(df, "b") == [1.0, 0.0, 2.0, 1.0, 0.0, 9999.0]


def test_normal_distribution_function(spark):
    x = [-9.0, -6.0, -3.0, -1.0, -0.2, 0.0, 0.3, 1.0, 2.5, 5.0, 8.0]
    got = column(series(spark, x).withColumn("p", norm_cdf("x")), "p")
    for g, v in zip(got, x):
        assert g == pytest.approx(0.5 * math.erfc(-v / math.sqrt(2)), rel=1e-12, abs=1e-15)


def test_scalar_guards(spark):
    df = series(spark, [0.0, None, -4.0]).withColumns({"r": ratio(F.lit(1.0), "x"), "c": clip("x", -1, 1), "m": row_mean(["x", F.lit(2.0)])})
    assert column(df, "r") == [None, None, -0.25]
    assert column(df, "c") == [0.0, None, -1.0]
    assert column(df, "m") == [1.0, 2.0, -1.0]


@pytest.mark.parametrize("alpha,adjust", [(0.5, False), (2 / 13, False), (2 / 13, True)])
def test_ewm_keeps_what_an_early_giant_leaves(spark, alpha, adjust):
    x = [1e20, *[1.0] * 40, -3e200, *[float(i % 7) for i in range(2500)]]
    got = column(SYM.ewm(series(spark, x), {"e": ("x", alpha)}, adjust=adjust), "e")
    want = pd.Series(x).ewm(alpha=alpha, adjust=adjust).mean().tolist()
    assert got == pytest.approx(want, rel=1e-9)
    assert abs(want[300]) > 10  # the giant still shows hundreds of rows later


def test_ewm_of_the_row_alone(spark):
    assert column(SYM.ewm(series(spark, [1.0, 5.0]), {"e": ("x", 1.0)}), "e") == [1.0, 5.0]


@pytest.mark.parametrize("n,shift,mp", [(5, 0, 1), (7, 2, 3), (None, 0, 4), (None, 1, 1)])
def test_levels_and_ranks_of_frames_equal_sorted_copies(n, shift, mp):
    rng = np.random.default_rng(5)
    x = [None if v > 8 else float("nan") if v == 8 else -0.0 if v == 7 else float(v) for v in rng.integers(0, 10, 200)]
    level, rank = Level("x", 0.3, n, mp, shift), Rank("x", n, mp, "max", shift)
    got = scan(x, n, shift, [level, rank])
    for i in range(len(x)):
        end = i + 1 - shift
        frame = sorted((v for v in x[max(0, end - n) if n else 0 : max(0, end)] if v is not None), key=lambda v: (v != v, v))
        if len(frame) < mp:
            assert got[0][i] is None and got[1][i] is None
            continue
        pos = (len(frame) - 1) * 0.3
        a, b = frame[math.floor(pos)], frame[math.ceil(pos)]
        assert got[0][i] == pytest.approx(a + (b - a) * (pos - math.floor(pos)), nan_ok=True)
        if x[i] is not None:
            upto = len(frame) if x[i] != x[i] else sum(v <= x[i] for v in frame)
            assert got[1][i] == upto / len(frame)


def test_ordered_windows_of_several_keys_and_descending_order(spark):
    rows = [(k, i, float((i * 7 + len(k)) % 11)) for k in ("a", "bb") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(6)
    got = {(r["k"], r["i"]): r["q"] for r in Roll("k", [F.desc("i")]).ordered(df, {"q": Level("x", 1.0, 3, 1)}).collect()}
    for k in ("a", "bb"):
        for i in range(30):
            assert got[k, i] == max(v for g, j, v in rows if g == k and i <= j < i + 3)


def test_ordered_windows_of_an_empty_table(spark):
    got = SYM.ordered(series(spark, []), {"p": Rank("x", 5), "q": Level("x", 0.5)})
    assert got.columns == ["symbol", "date", "x", "p", "q"] and got.count() == 0
