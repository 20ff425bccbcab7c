"""Scalar column helpers shared by all operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero or either side is missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio_eps(a, b, eps: float = 1e-12) -> Column:
    """a / b, NULL where |b| <= eps."""
    return F.when(F.abs(col(b)) > eps, col(a) / col(b))


def clip(x, lo: float, hi: float) -> Column:
    """Clamp a value; NULL stays NULL (greatest/least would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def flag(cond) -> Column:
    """Boolean condition as 1.0 / 0.0, unknown as 0.0."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def signed_log(x) -> Column:
    x = col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def safe_log(x) -> Column:
    x = col(x)
    return F.when(x > 0, F.ln(x))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def row_mean(cols) -> Column:
    """Mean over the non-null values of several columns of one row."""
    cols = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, count.cast("double"))


def row_std(cols, ddof: int = 0) -> Column:
    """Standard deviation over the non-null values of several columns of one row."""
    cols = [col(c) for c in cols]
    mean = row_mean(cols)
    squares = reduce(lambda a, b: a + b, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.sqrt(F.when(count > ddof, squares / (count - ddof)))


def array_mean(arr) -> Column:
    """Mean of an array of doubles without NULLs."""
    arr = col(arr)
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr))


def array_quantile(sorted_arr, p: float) -> Column:
    """Linear interpolated quantile of an ascending array."""
    arr = col(sorted_arr)
    pos = (F.size(arr) - 1) * F.lit(p)
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    a, b = F.get(arr, lo), F.get(arr, hi)
    return a + (b - a) * (pos - lo)


def dot(a, b) -> Column:
    """Dot product of two numeric arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b); 1.0 where either vector has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), F.lit(1.0) - dot(a, b) / (na * nb)).otherwise(F.lit(1.0))


# Coefficients of Cody's rational approximations to erf and erfc (W. J. Cody, 1969).
ERF_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERFC_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
          1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERFC_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
          4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
TAIL_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4,
          1.63153871373020978e-2)
TAIL_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _rational(y: Column, p, q) -> Column:
    num, den = F.lit(p[-1]) * y, y
    for a, b in zip(p[: len(q) - 1], q[:-1]):
        num, den = (num + a) * y, (den + b) * y
    return (num + p[len(q) - 1]) / (den + q[-1])


def norm_cdf(x) -> Column:
    """Standard normal distribution function, accurate to double precision, inside codegen."""
    z = col(x) / F.lit(math.sqrt(2.0))
    a = F.abs(z)
    centre = z * _rational(z * z, ERF_P, ERF_Q)
    middle = F.exp(-a * a) * _rational(a, ERFC_P, ERFC_Q)
    inv = F.lit(1.0) / (a * a)
    far = F.exp(-a * a) * (F.lit(1.0 / math.sqrt(math.pi)) - inv * _rational(inv, TAIL_P, TAIL_Q)) / a
    tail = F.when(a <= 4.0, middle).otherwise(far)
    upper = F.when(z > 0, F.lit(1.0) - tail / 2).otherwise(tail / 2)
    return F.when(a <= 0.46875, F.lit(0.5) + centre / 2).when(a > 0.46875, upper)


def norm_pdf(x) -> Column:
    x = col(x)
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))


def wilson_interval(successes, n, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    n = col(n).cast("double")
    p = F.try_divide(col(successes).cast("double"), n)
    denom = F.lit(1.0) + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return F.greatest(F.lit(0.0), (centre - half) / denom), F.least(F.lit(1.0), (centre + half) / denom)
