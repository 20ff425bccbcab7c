"""Rolling, expanding and shifted-window expressions with minimum-observation rules.

`Roll` builds plain Column expressions, so Catalyst sees every expression of one partition spec together and plans one
sort for all of them. A partition never exceeds the number of sessions in the calendar: all callers window over
daily (or minute) bars that were pre-aggregated with map-side combine, never over raw ticks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import col, ratio
from barloom.functions.ordered import Level, Rank, answers

#: how far the weights of an exponential mean fall over a block, and after how many blocks no double is left of any value
FALL, BLOCKS_BACK = 1e130, 5


def let(value: Column, use) -> Column:
    """Bind a value once: Spark plans every textual copy of a window aggregate again, a lambda argument is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Roll:
    def __init__(self, keys=("symbol",), order=("date",)):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)

    @property
    def base(self):  # built on use: plans are imported before any session exists
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def frame(self, n: int | None, shift: int = 0):
        """Last n rows ending `shift` rows ago; n=None means everything up to there."""
        start = Window.unboundedPreceding if n is None else -(n - 1) - shift
        return self.base.rowsBetween(start, -shift)

    def ahead(self, n: int | None, start: int = 0):
        return self.base.rowsBetween(start, Window.unboundedFollowing if n is None else start + n - 1)

    def _need(self, value: Column, x: Column, n, mp, w) -> Column:
        mp = (1 if n is None else n) if mp is None else mp
        if mp <= 1 and n is None:
            return value
        return F.when(F.count(x).over(w) >= mp, value)

    def apply(self, fn, x, n=None, mp=None, shift=0) -> Column:
        x, w = col(x), self.frame(n, shift)
        return self._need(fn(x).over(w), x, n, mp, w)

    def mean(self, x, n=None, mp=None, shift=0):
        return self.apply(F.avg, x, n, mp, shift)

    def sum(self, x, n=None, mp=None, shift=0):
        return self.apply(F.sum, x, n, mp, shift)

    def min(self, x, n=None, mp=None, shift=0):
        return self.apply(F.min, x, n, mp, shift)

    def max(self, x, n=None, mp=None, shift=0):
        return self.apply(F.max, x, n, mp, shift)

    def std(self, x, n=None, mp=None, shift=0):
        return self.apply(F.stddev_samp, x, n, mp, shift)

    def std0(self, x, n=None, mp=None, shift=0):
        return self.apply(F.stddev_pop, x, n, mp, shift)

    def var(self, x, n=None, mp=None, shift=0):
        return self.apply(F.var_samp, x, n, mp, shift)

    def count(self, x, n=None, shift=0):
        return F.count(col(x)).over(self.frame(n, shift))

    def prod(self, x, n=None, mp=None, shift=0):
        return self.apply(F.product, x, n, mp, shift)

    def skew(self, x, n, mp=None, shift=0):
        """Bias-corrected sample skewness (G1)."""
        x, w, need = col(x), self.frame(n, shift), max(3, n if mp is None else mp)
        parts = F.struct(F.count(x).over(w).cast("double").alias("c"), F.stddev_pop(x).over(w).alias("s"), F.skewness(x).over(w).alias("g"))
        return let(parts, lambda v: F.when((v.c >= need) & (v.s > 1e-12), v.g * F.sqrt(v.c * (v.c - 1)) / (v.c - 2)))

    def kurt(self, x, n, mp=None, shift=0):
        """Bias-corrected sample excess kurtosis (G2)."""
        x, w, need = col(x), self.frame(n, shift), max(4, n if mp is None else mp)
        parts = F.struct(F.count(x).over(w).cast("double").alias("c"), F.stddev_pop(x).over(w).alias("s"), F.kurtosis(x).over(w).alias("g"))
        return let(
            parts, lambda v: F.when((v.c >= need) & (v.s > 1e-12), (v.c - 1) / ((v.c - 2) * (v.c - 3)) * ((v.c + 1) * v.g + 6))
        )

    def lag(self, x, k=1):
        return F.lag(col(x), k).over(self.base)

    def lead(self, x, k=1):
        return F.lead(col(x), k).over(self.base)

    def diff(self, x, k=1):
        return col(x) - self.lag(x, k)

    def pct(self, x, k=1):
        """Simple k-row return; NULL where the earlier value is zero."""
        return ratio(x, self.lag(x, k)) - 1

    def logret(self, x, k=1):
        x = col(x)
        r = ratio(x, self.lag(x, k))
        return F.when(r > 0, F.ln(r))

    def ffill(self, x, limit: int | None = None):
        return F.last(col(x), ignorenulls=True).over(self.frame(None if limit is None else limit + 1))

    def bfill(self, x, limit: int | None = None):
        return F.first(col(x), ignorenulls=True).over(self.ahead(None if limit is None else limit + 1))

    def row(self):
        return F.row_number().over(self.base)

    def z(self, x, n=None, mp=None, shift=0, ddof=1, eps=1e-12, shift_x=0):
        """(x - mean) / std of the frame; NULL where the frame is flat."""
        parts = F.struct(self.mean(x, n, mp, shift).alias("m"), (self.std if ddof else self.std0)(x, n, mp, shift).alias("s"), col(x).alias("x"))
        return let(parts, lambda v: F.when(v.s > eps, (v.x - v.m) / v.s))

    def cov(self, x, y, n, mp=None, shift=0):
        x, y, both, w = *self._pair(x, y), self.frame(n, shift)
        return self._need(F.covar_samp(x, y).over(w), both, n, mp, w)

    @staticmethod
    def _pair(x, y):
        x, y = col(x), col(y)
        ok = x.isNotNull() & y.isNotNull()
        return F.when(ok, x), F.when(ok, y), F.when(ok, F.lit(1))

    def corr(self, x, y, n, mp=None, shift=0, eps=1e-12):
        """Pearson correlation of pairwise complete rows; NULL where a side is flat."""
        x, y, both, w = *self._pair(x, y), self.frame(n, shift)
        parts = F.struct(
            F.count(both).over(w).alias("n"), F.stddev_samp(x).over(w).alias("a"), F.stddev_samp(y).over(w).alias("b"), F.covar_samp(x, y).over(w).alias("c")
        )
        need = n if mp is None else mp
        return let(parts, lambda v: F.when((v.n >= need) & (v.a > eps) & (v.b > eps), v.c / (v.a * v.b)))

    def beta(self, y, x, n, mp=None, shift=0, eps=1e-18):
        """cov(y, x) / var(x) of pairwise complete rows."""
        y, x, both, w = *self._pair(y, x), self.frame(n, shift)
        parts = F.struct(F.count(both).over(w).alias("n"), F.var_samp(x).over(w).alias("a"), F.covar_samp(y, x).over(w).alias("c"))
        need = n if mp is None else mp
        return let(parts, lambda v: F.when((v.n >= need) & (v.a > eps), v.c / v.a))

    def slope(self, y, n, mp=None, shift=0):
        """Least-squares slope against the row number."""
        y, w = col(y), self.frame(n, shift)
        return self._need(F.regr_slope(y, F.col("__rn").cast("double")).over(w), y, n, mp, w)

    def ordered(self, df: DataFrame, outputs: dict[str, Rank | Level]) -> DataFrame:
        """Add rolling ranks and quantiles: `outputs` maps a new column to a `Rank` or a `Level`."""
        return answers([col(k) for k in self.keys], self.row(), df, outputs)

    def days_since(self, event, sentinel: float | None = None):
        """Rows since the last row where `event` holds (0 on the event row)."""
        rn = self.row()
        last = F.last(F.when(event, F.col("__rn")), ignorenulls=True).over(self.frame(None))
        out = (F.col("__rn") - last).cast("double")
        return out if sentinel is None else F.coalesce(out, F.lit(float(sentinel)))

    def days_to(self, event, sentinel: float | None = None):
        nxt = F.first(F.when(event, F.col("__rn")), ignorenulls=True).over(self.ahead(None))
        out = (nxt - F.col("__rn")).cast("double")
        return out if sentinel is None else F.coalesce(out, F.lit(float(sentinel)))

    def numbered(self, df: DataFrame) -> DataFrame:
        """Add the per-key row number `__rn` that slopes and event distances refer to."""
        return df.withColumn("__rn", self.row())

    def ewm(self, df: DataFrame, outputs: dict[str, tuple], adjust: bool = False) -> DataFrame:
        """Exponentially weighted means as native windows: `outputs` maps a new column to (source column, alpha).

        The recurrence y = (1-a) y' + a x is cut into blocks of rows over which the weight falls by FALL. Inside a block the
        weights are taken from its end, so that the running sum is never above the values themselves; a block's total is the
        affine map that it applies to what came before, and BLOCKS_BACK of them in a row take the greatest double below the
        least one, so that no earlier row can show. Sources must be free of NULLs after their first value.
        """
        plain = [c for c in df.columns]
        for name, (source, alpha) in outputs.items():
            q = 1.0 - alpha
            if q <= 0:  # nothing of the past
                df = df.withColumn(name, col(source).cast("double"))
                plain.append(name)
                continue
            width = max(2, math.ceil(math.log(FALL) / -math.log(q)))
            x = col(source)
            live = self.base.rowsBetween(Window.unboundedPreceding, 0)
            df = df.withColumn("__i", F.count(x).over(live) - 1)
            df = df.withColumn("__b", F.floor(F.col("__i") / width)).withColumn("__left", (width - 1 - F.col("__i") + F.col("__b") * width).cast("double"))
            weight = F.lit(1.0) if adjust else F.when(F.col("__i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
            term = x * weight * F.pow(F.lit(q), F.col("__left"))
            in_block = Window.partitionBy(*self.keys, "__b").orderBy(*self.order)
            df = df.withColumn("__t", F.when(x.isNotNull(), term))
            df = df.withColumn("__p", F.sum("__t").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
            df = df.withColumn("__s", F.sum("__t").over(Window.partitionBy(*self.keys, "__b")))
            before = F.lit(0.0)
            for back in range(BLOCKS_BACK, 0, -1):
                before = before * F.lit(q**width) + F.coalesce(F.lag("__s", back * width).over(self.base), F.lit(0.0))
            value = F.col("__p") * F.pow(F.lit(q), -F.col("__left")) + before * F.pow(F.lit(q), width - F.col("__left"))
            if adjust:
                value = value * F.lit(alpha) / (F.lit(1.0) - F.pow(F.lit(q), F.col("__i") + 1))
            df = df.withColumn(name, F.when(F.col("__i") >= 0, value)).select(*plain, name)
            plain.append(name)
        return df


SYM = Roll("symbol", "date")
