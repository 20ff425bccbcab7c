"""What registered plans return: the operators' own values."""

import math
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import same  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from barloom.plans import load_plans  # noqa: E402
from barloom.plans.registry import shape, shape_sql  # noqa: E402
from barloom.sources.tables import Tables  # noqa: E402


def test_sensitivities_are_the_operator_s_own(spark, sf_dir):
    plan = load_plans()["black_scholes"]
    key, values = ["symbol", "quote_date", "expiry", "strike", "type"], ["price", "delta", "gamma", "vega", "theta", "rho"]
    own = plan.build(Tables(spark, sf_dir)).select(*[F.col(c).cast("string") if c in ("quote_date", "expiry") else F.col(c) for c in key], *values)
    got = sorted(map(tuple, plan.run(spark, sf_dir).select(*key, *values).collect()), key=str)
    assert got == sorted(map(tuple, own.collect()), key=str)
    assert any(0 < r[len(key) + 2] < 1e-3 for r in got)


def test_floats_pass_unchanged(spark):
    import duckdb

    values = [1 / 3, 1e-12, -2.5e-10, 1e15 / 7, 0.0, None]
    out = shape(spark.createDataFrame([(v,) for v in [*values, math.nan]], "x double"), "x").collect()
    assert [r.x for r in out] == [*values, None]
    sql = "SELECT x FROM (VALUES " + ", ".join(f"({'NULL' if v is None else repr(v)}::DOUBLE)" for v in values) + ", ('nan'::DOUBLE)) AS t(x)"
    assert [r[0] for r in duckdb.sql(shape_sql(sql, "x")).fetchall()] == [*values, None]


def test_tolerance_is_relative():
    assert same(1e-4, 1e-4 * (1 + 9e-9)) and not same(1e-4, 1e-4 * (1 + 2e-8)) and not same(5e-6, 0.0)
    assert same(1e-10, 0.0) and same(math.inf, math.inf) and not same(math.inf, 1.0) and same(None, None) and not same(None, 0.0)
