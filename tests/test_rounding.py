"""Buckets at half steps, as the language's own rounding takes them."""

import random

from pyspark.sql import functions as F

from barloom.operators.options import implied_move_statistics, round_tenth


def test_tenths_and_months_round_like_the_binary_value(spark):
    rnd = random.Random(3)
    xs = [k / 20 for k in range(0, 80)] + [strike / spot for strike in range(800, 1200, 5) for spot in (950, 960, 1000, 1040)] + [rnd.random() * 3 for _ in range(2000)] + [0.25, 0.75, 1.25, 0.0]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_tenth(F.col("x")).alias("t"), F.bround(F.col("x") * 10).alias("m")).collect()
    assert all(r.t == round(r.x, 1) for r in out)
    assert all(r.m == round(r.x * 10) for r in out)


def test_implied_moves(spark):
    df = spark.createDataFrame([(100.0, 0.2, 60 / 365), (50.0, None, 0.1)], "spot double, iv double, tte double")
    first, empty = implied_move_statistics(df).collect()
    one = 100 * (0.2 * (2**0.5)) * (60 / 365) ** 0.5
    assert abs(first.one_sigma_move - one) < 1e-9 and first.two_sigma_move == 2 * first.one_sigma_move and abs(first.expected_move - 0.8 * one) < 1e-9
    assert first.low_95 == -first.high_95 == -first.two_sigma_move and first.one_sigma_pct == first.one_sigma_move / 100
    assert empty.one_sigma_move is None
    once = implied_move_statistics(df, base_days=None).first()
    assert once.adjusted_iv == 0.2
