"""Isotonic regression over tables of any size: pool-adjacent-violators as mergeable block summaries.

Values are reduced to distinct ones with weight and sum, dealt into ordered ranges, and pooled inside each range. What remains of a
range is a list of blocks (first and last value, weight, sum) with rising means. Lists of neighbouring ranges, one after the
other, pool to the same blocks as their values would, so that ranges are joined FAN at a time, level by level. Noise pools
early: of 0/1 labels at most about the two-thirds power of their number can stand as blocks of their own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.caches import shared_folder

#: lists joined at a time
FAN = 16
BLOCKS = "range long, lo double, hi double, w double, s double"


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
    """Blocks with strictly rising means from ordered ones: the newest is joined to the one before while it does not exceed it."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist(), strict=True):
        a, b, n, t = block
        # means are compared as products: sums of whole numbers stay exact
        while out and out[-1][3] * n >= t * out[-1][2]:
            a, _, m, u = out.pop()
            n, t = n + m, t + u
        out.append([a, b, n, t])
    return list(np.array(out, float).reshape(-1, 4).T)


def _pooled(group: pa.Table) -> pa.Table:
    group = group.sort_by("lo")
    made = pool(*(group[c].to_numpy() for c in ("lo", "hi", "w", "s")))
    return pa.table([pa.array(np.full(len(made[0]), group["range"][0].as_py()), pa.int64()), *[pa.array(c) for c in made]], names=["range", "lo", "hi", "w", "s"])


def isotonic(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """`df` with `calibrated`: the rising step function of `p` that is nearest to `y` in squares, every row weighing the same.

    Rows without `p` or `y` take no part in the fit; rows without `p` get none. A row whose `p` has no `y` anywhere gets the value of
    the last block that begins at or below it, the lowest one below all. The distinct values are written to the shared folder
    once, with their ranges; a range holds about as many of them as a shuffle partition.
    """
    spark = df.sparkSession
    x = F.col(p).cast("double")
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x)).groupBy(x.alias("lo")).agg(F.count("*").cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("s"))
    path = f"{shared_folder(spark)}/isotonic-{uuid.uuid4().hex}"
    known.repartitionByRange("lo").withColumn("range", F.spark_partition_id().cast("long")).write.parquet(path)
    values = spark.read.schema("lo double, w double, s double, range long").parquet(path)
    blocks = values.select("range", "lo", F.col("lo").alias("hi"), "w", "s").groupBy("range").applyInArrow(_pooled, BLOCKS)
    # one first value a range
    firsts = sorted((r[1], r[0]) for r in values.groupBy("range").agg(F.min("lo")).collect())
    last = max((r for _, r in firsts), default=0)
    while last:
        last //= FAN
        blocks = blocks.withColumn("range", F.floor(F.col("range") / FAN).cast("long")).groupBy("range").applyInArrow(_pooled, BLOCKS)
    starts, names = np.array([a for a, _ in firsts]), np.array([r for _, r in firsts] or [0], np.int64)

    @F.pandas_udf("long")
    def range_of(v):
        import pandas as pd

        # below the first value counts to the first range
        return pd.Series(names[np.maximum(np.searchsorted(starts, v.to_numpy(), side="right") - 1, 0)])

    @F.pandas_udf("array<long>")
    def ranges(lo, hi):
        import pandas as pd

        at = lambda v, side: np.maximum(np.searchsorted(starts, v.to_numpy(), side=side) - 1, 0)
        return pd.Series([names[i : j + 1] for i, j in zip(at(lo, "right"), at(hi, "right"), strict=True)])

    # a block stands in every range that it reaches into; values between two blocks follow the one below
    spread = blocks.select(F.explode(ranges("lo", "hi")).alias("range"), "lo", (F.col("s") / F.col("w")).alias("mean"))
    asked = df.where(F.col(p).isNotNull() & ~F.isnan(x)).select(x.alias("v")).distinct().withColumn("range", range_of("v"))

    def look_up(group: pa.Table, steps: pa.Table) -> pa.Table:
        steps = steps.sort_by("lo")
        at = np.searchsorted(steps["lo"].to_numpy(), group["v"].to_numpy(), side="right") - 1
        means = steps["mean"].to_numpy()
        found = means[np.maximum(at, 0)] if len(means) else np.full(len(at), np.nan)
        return pa.table([group["v"], pa.array(found, pa.float64(), mask=np.isnan(found))], names=["v", "calibrated"])

    fitted = asked.groupBy("range").cogroup(spread.groupBy("range")).applyInArrow(look_up, "v double, calibrated double")
    return df.join(fitted, x.eqNullSafe(F.col("v")), "left").drop("v")
