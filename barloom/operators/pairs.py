"""Joint sums of all pairs of series, from products of blocks.

Series are dealt into blocks of about BLOCK and dates into parts of DAYS. A row goes once to every block that its own is paired
with, so what is shuffled grows with the blocks and not with pairs times dates. A group holds two blocks over one part: a matrix
of dates by series, whose product with itself gives the sums of all its pairs. Only those, one row for a pair and part, go on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: series of a block, and dates of a part
BLOCK, DAYS = 64, 512
EPOCH = dt.date(1970, 1, 1)

Sums = Callable[[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]], dict[str, np.ndarray]]


def _by_blocks(df: DataFrame, series: str, x: str, block: int, sums: Sums, columns: list[str]) -> DataFrame:
    """One row for each part and pair (a <= b) of series with a date in common: part, a, b and what `sums` makes of the rows'
    values, dates, series and (dates, series), as matrices of series by series; `n` (rows in common) tells which pairs there are."""
    rows = df.select(F.col(series).alias("s"), F.to_date("date").alias("date"), F.col(x).cast("double").alias("x")).dropna()
    rows = rows.where(F.abs("x") < float("inf"))  # one would spoil the products of its whole date
    deal = rows.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("s") / block)).cast("int").alias("blocks"))  # one row
    rows = rows.join(F.broadcast(deal)).withColumn("own", F.pmod(F.xxhash64("s"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.floor(F.datediff("date", F.lit(EPOCH)) / DAYS).alias("part")
    rows = rows.select(part, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "s", "date", "x")
    kind = rows.schema["s"].dataType
    schema = StructType([StructField("part", LongType()), StructField("a", kind), StructField("b", kind), *(StructField(c, DoubleType()) for c in columns)])

    def of_blocks(key: tuple, table: pa.Table) -> pa.Table:
        part, low, high = (k.as_py() for k in key)
        day, days = pd.factorize(table["date"].to_pandas())
        at, names = pd.factorize(table["s"].to_pandas(), sort=True)
        home = np.zeros(len(names), dtype=np.int64)
        home[at] = table["own"].to_numpy()
        made = sums(table["x"].to_numpy(), day, at, (len(days), len(names)))
        here = (made["n"] > 0) & np.triu(np.ones(made["n"].shape, dtype=bool))
        if low != high:  # pairs inside a block have a group of their own
            here &= home[:, None] != home[None, :]
        i, j = np.nonzero(here)
        label = pa.array(names, table.schema.field("s").type)
        out = {"part": pa.array(np.full(len(i), part), pa.int64()), "a": label.take(pa.array(i)), "b": label.take(pa.array(j))}
        return pa.table(out | {c: pa.array(made[c][i, j].astype(float)) for c in columns})

    return rows.groupBy("part", "low", "high").applyInArrow(of_blocks, schema)


def _grid(value: np.ndarray, day: np.ndarray, at: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    np.add.at(out, (day, at), value)
    return out


def _products(x, day, at, shape) -> dict[str, np.ndarray]:
    here, v = _grid(np.ones(len(x)), day, at, shape), _grid(x, day, at, shape)
    return {"n": here.T @ here, "product": v.T @ v}


def _moments(x, day, at, shape) -> dict[str, np.ndarray]:
    """Means and sums of squares and products of deviations over the dates in common, about each series' own mean first."""
    centre = np.bincount(at, weights=x, minlength=shape[1]) / np.bincount(at, minlength=shape[1])
    d = x - centre[at]
    here, v, v2 = _grid(np.ones(len(x)), day, at, shape), _grid(d, day, at, shape), _grid(d * d, day, at, shape)
    n = here.T @ here
    least = np.maximum(n, 1.0)
    sa, sb = v.T @ here, here.T @ v
    return {
        "n": n,
        "mean_a": centre[:, None] + sa / least,
        "mean_b": centre[None, :] + sb / least,
        "m2_a": np.maximum(v2.T @ here - sa * sa / least, 0.0),
        "m2_b": np.maximum(here.T @ v2 - sb * sb / least, 0.0),
        "c": v.T @ v - sa * sb / least,
    }


def products(df: DataFrame, series: str, x: str, block: int = BLOCK) -> DataFrame:
    """a, b (a <= b), product: the sum of the products of two series' values over their dates in common."""
    return _by_blocks(df, series, x, block, _products, ["n", "product"]).groupBy("a", "b").agg(F.sum("product").alias("product"))


def moments(df: DataFrame, series: str, x: str, block: int = BLOCK) -> DataFrame:
    """a, b (a <= b), n, mean_a, mean_b, m2_a, m2_b, c: rows in common, means, and sums of squares and products of deviations.

    Rows without a series, date or finite value take no part; repeated rows of a series and date pair with each of the other's. The
    parts of a pair, bounded by the calendar, are merged in their order as their rows would be.
    """
    columns = ["n", "mean_a", "mean_b", "m2_a", "m2_b", "c"]
    parts = _by_blocks(df, series, x, block, _moments, columns)
    found = parts.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("part", *columns))).alias("parts"))

    def merge(t, s):
        n = t.n + s.n
        da, db, share = s.mean_a - t.mean_a, s.mean_b - t.mean_b, t.n * s.n / n
        return F.struct(
            s.part.alias("part"), n.alias("n"), (t.mean_a + da * s.n / n).alias("mean_a"), (t.mean_b + db * s.n / n).alias("mean_b"),
            (t.m2_a + s.m2_a + da * da * share).alias("m2_a"), (t.m2_b + s.m2_b + db * db * share).alias("m2_b"), (t.c + s.c + da * db * share).alias("c"),
        )

    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), merge)
    found = found.select("a", "b", whole.alias("t"))
    return found.select("a", "b", F.col("t.n").cast("long").alias("n"), *[F.col(f"t.{c}").alias(c) for c in columns[1:]])
