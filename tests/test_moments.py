"""Mergeable moments, regressions per fold and principal components against plain fits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from barloom.operators import moments as mo

DAY = dt.date(2024, 1, 1)


def table(spark, n=600):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 3]]) + [1e2, -2, 0]
    y = x @ [0.3, -1, 0.2] + rnd.standard_normal(n)
    rows = [(DAY + dt.timedelta(days=i % 60), *map(float, v), 7.0, float(t)) for i, (v, t) in enumerate(zip(x, y))]
    rows += [(DAY, None, 1.0, 1.0, 7.0, 1.0), (DAY, float("nan"), 1.0, 1.0, 7.0, 1.0), (None, 1.0, 1.0, 1.0, 7.0, 1.0)]
    return spark.createDataFrame(rows, "date date, a double, b double, c double, k double, y double").repartition(5)


def test_states_merge_to_those_of_all_rows():
    x = np.random.default_rng(1).standard_normal((100, 4)) + 1e6
    parts = [mo.state_of(p) for p in np.split(x, [1, 40, 41])]
    total = parts[0]
    for p in parts[1:]:
        total = mo.merge(total, p)
    assert total[0] == 100 and np.allclose(total[1], x.mean(0), rtol=1e-14) and np.allclose(total[2] / 100, np.cov(x.T, ddof=0), rtol=1e-9)
    empty = mo.state_of(np.zeros((0, 4)))
    assert mo.merge(empty, empty)[0] == 0 and np.allclose(mo.merge(empty, total)[2], total[2])


def test_folds_equal_separate_fits_from_one_scan(spark):
    df = table(spark)
    folds = spark.createDataFrame([(i, DAY + dt.timedelta(days=d)) for i, d in enumerate((10, 30, 30, 59))], "fold int, train_last date")
    got = mo.fold_ridge(df, ["a", "b", "c", "k"], "y", folds, 1e-2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 2  # one in the plan and one in its adaptive copy
    beta = {(r.fold, r.column): r.beta for r in got.collect()}
    assert all(r.residual < 1e-9 for r in got.collect()) and len(beta) == 16
    for fold, end in enumerate((10, 30, 30, 59)):
        train = df.where(F.col("date") <= F.lit(DAY + dt.timedelta(days=end))).where("a IS NOT NULL AND NOT isnan(a)")
        v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(train)
        m = LinearRegression(featuresCol="f", labelCol="y", regParam=1e-2).fit(v)
        assert [beta[fold, c] for c in "abc"] == pytest.approx(list(m.coefficients), rel=1e-6) and beta[fold, "k"] == 0
    assert mo.fold_ridge(df, ["a"], "y", folds.limit(0)).count() == 0


def test_principal_components(spark):
    df = table(spark).where("a IS NOT NULL AND NOT isnan(a)")
    out, shares, axes = mo.principal_components(df, ["a", "b", "c", "k"], 2)
    rows = np.array(df.select("a", "b", "c").collect())
    z = (rows - rows.mean(0)) / rows.std(0, ddof=1)
    values = np.linalg.eigvalsh(np.corrcoef(z.T))[::-1]
    assert shares[:3] == pytest.approx(list(values / 3), abs=1e-9) and shares[3] == pytest.approx(0, abs=1e-12)
    assert np.allclose(axes @ axes.T, np.eye(4), atol=1e-9) and all(a[np.abs(a).argmax()] > 0 for a in axes[:3])
    got = np.array(sorted(map(tuple, out.select("pc1", "pc2").collect())))
    assert np.allclose(got, np.array(sorted(map(tuple, z @ axes[:2, :3].T))), atol=1e-8)
    none, shares, _ = mo.principal_components(df.limit(0), ["a", "b"], 2)
    assert none.count() == 0 and shares == []
