"""Platt calibration: the balance that a fitted logistic regression has, and labels that no finite fit reaches."""

import numpy as np
import pytest

from barloom.operators.evaluation import platt


def test_errors_balance(spark):
    rnd = np.random.default_rng(4)
    p = rnd.random(500)
    p[:2] = 0.0, 1.0
    y = (rnd.random(500) < 0.2 + 0.5 * p).astype(int)
    found = platt(spark.createDataFrame([(float(a), int(b), 1) for a, b in zip(p, y)], "p double, y int, other int")).toPandas()
    assert list(found.columns) == ["p", "y", "other", "calibrated"]
    q = np.clip(found.p, 1e-6, 1 - 1e-6)
    error = found.calibrated - found.y
    assert abs(error.sum()) < 1e-8 and abs((error * np.log(q / (1 - q))).sum()) < 1e-8


@pytest.mark.parametrize("labels", [[1] * 5, [0] * 5, [0, 0, 1, 1, 1]])
def test_labels_that_a_cut_separates(spark, labels):
    df = spark.createDataFrame(list(zip([0.0, 0.2, 0.5, 0.7, 1.0], labels)), "p double, y int")
    assert [r["calibrated"] for r in platt(df).orderBy("p").collect()] == pytest.approx(labels, abs=1e-5)
