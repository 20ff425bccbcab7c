"""Exact ranks and quantiles of groups of any size.

A plain ranking window puts a whole group on one task. Here the group is first reduced to distinct values with counts
(map-side combined, so a value shared by a third of the rows is one row), then cut into ordered buckets by a
deterministic hash sample of its own values; ranks inside a bucket and the counts of the buckets below add up exactly.
Split points depend only on the data, never on task order, so a recomputed partition gets the same bucket.

That reads the rows several times and joins ranks back to them. Where many groups share the rows and each is bounded by a
dimension, as a date of a panel is by its symbols, `whole` ranks the rows where they are: one exchange, one sort a ranking.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import col


#: split points of a group: one value from each hash slot, looked up in two steps of STRIDE
SLOTS, STRIDE = 128, 16


def ranked_values(df: DataFrame, keys, x: str, buckets: int = 64) -> DataFrame:
    """One row per (keys, value): cnt, below (rows with a smaller value), total, dense (1-based), distinct."""
    keys = list(keys)
    d = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("cnt"))
    # the value of the least hash in each slot: a sample of the group's own values that any order of tasks finds
    slots = d.groupBy(*keys, F.pmod(F.xxhash64(x), F.lit(SLOTS)).alias("__slot")).agg(F.count("*").alias("__d"), F.sum("cnt").alias("__t"), F.min_by(x, F.xxhash64(F.col(x), F.lit(1))).alias("__v"))
    sizes = slots.groupBy(*keys).agg(F.sum("__d").alias("distinct"), F.sum("__t").alias("total"), F.sort_array(F.collect_list("__v")).alias("__cut"))
    sizes = sizes.withColumn("__cut", F.when(F.col("distinct") > 4 * buckets, F.col("__cut")))
    sizes = sizes.withColumn("__coarse", F.filter("__cut", lambda _, i: i % STRIDE == STRIDE - 1))
    d = d.join(sizes, keys) if keys else d.join(F.broadcast(sizes))  # without keys the sizes are one row
    coarse = F.size(F.filter("__coarse", lambda v: v < F.col(x)))
    fine = F.size(F.filter(F.slice("__cut", coarse * STRIDE + 1, F.lit(STRIDE)), lambda v: v < F.col(x)))
    d = d.withColumn("__b", F.when(F.col("__cut").isNull(), 0).otherwise(coarse * STRIDE + fine)).drop("__cut", "__coarse")
    order = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*keys, "__b").agg(F.sum("cnt").alias("__bc"), F.count("*").alias("__bd"))
    base = base.select(*keys, "__b", F.coalesce(F.sum("__bc").over(order), F.lit(0)).alias("__base"), F.coalesce(F.sum("__bd").over(order), F.lit(0)).alias("__dbase"))
    inside = Window.partitionBy(*keys, "__b").orderBy(x)
    d = d.withColumns(
        {"__in": F.coalesce(F.sum("cnt").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__pos": F.row_number().over(inside)}
    )
    d = d.join(base, [*keys, "__b"])
    return d.select(
        *keys, x, "cnt", (F.col("__base") + F.col("__in")).alias("below"), "total", (F.col("__dbase") + F.col("__pos")).alias("dense"), "distinct"
    )


def _whole_ranks(df: DataFrame, keys: list[str], x: str, out: dict[str, str], descending: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(x) if descending else F.asc_nulls_last(x))
    below, upto = F.rank().over(w) - 1, F.count(x).over(w)
    total = F.count(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    avg = (below + upto + 1) / 2
    make: dict[str, Column] = {"avg": avg, "pct": avg / total, "min": (below + 1).cast("long"), "dense": F.dense_rank().over(w).cast("long"), "total": total}
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, x)])
    return df.withColumns({name: F.when(known, make[kind]) for name, kind in out.items()})


def with_ranks(
    df: DataFrame, keys, x: str, out: dict[str, str], descending: bool = False, source: DataFrame | None = None, whole: bool = False
) -> DataFrame:
    """Join ranks back to the rows. `out` maps a new column to one of avg, pct, min, dense, total. A row without a key or the value
    has none.

    Several rankings of one table should all name it as `source`, so that their plans stay side by side instead of nesting.
    `whole`: a task can sort a group, and there are many groups.
    """
    keys = list(keys)
    if whole:
        return _whole_ranks(df, keys, x, out, descending)
    r = ranked_values((df if source is None else source).select(*keys, x), keys, x)
    below = F.col("total") - F.col("below") - F.col("cnt") if descending else F.col("below")
    dense = F.col("distinct") - F.col("dense") + 1 if descending else F.col("dense")
    avg = below + (F.col("cnt") + 1) / 2
    make: dict[str, Column] = {"avg": avg, "pct": avg / F.col("total"), "min": below + 1, "dense": dense, "total": F.col("total")}
    ranks = r.select(*keys, x, *[make[kind].alias(name) for name, kind in out.items()])
    return df.join(ranks, [*keys, x], "left")


def rank_table(df: DataFrame, by: str, scopes: list[str], metrics: list[str]) -> DataFrame:
    """Percentile ranks (average of equals) of several metrics within several groupings of each `by`, next to the rows:
    `pct_<scope>_<metric>` and `total_<scope>_<metric>`. A row without `by`, the group or the value has neither.

    All rankings share one exchange by `by`, so a task can sort the rows of one value of `by`.
    """
    df = df.repartition(by)
    for s in scopes:
        for m in metrics:
            df = with_ranks(df.withColumn("__x", F.col(m).cast("double")), [by, s], "__x", {f"pct_{s}_{m}": "pct", f"total_{s}_{m}": "total"}, whole=True)
    return df.drop("__x")


def quantiles(df: DataFrame, keys, x: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group: one row per group, one column per named probability."""
    keys = list(keys)
    r = ranked_values(df, keys, x)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("cnt")), F.col(x)))

    aggs = []
    for i, p in enumerate(probs.values()):
        pos = (F.col("total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"__lo{i}"), at(F.ceil(pos)).alias(f"__hi{i}"), F.max(pos - F.floor(pos)).alias(f"__f{i}")]
    g = r.groupBy(*keys).agg(*aggs)
    pick = [(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(name) for i, name in enumerate(probs)]
    return g.select(*keys, *pick)


def group_zscore(df: DataFrame, keys, columns: dict[str, str], cap: float | None = None, eps: float = 1e-12, whole: bool = False) -> DataFrame:
    """Population z-score per group via partial aggregation and a join, or where the rows are if a task can hold a group (`whole`);
    flat groups and missing values give 0. Rows without a key are left out."""
    keys = list(keys)
    if whole:
        w = Window.partitionBy(*keys)
        df = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
        df = df.withColumns({f"__m_{z}": F.avg(x).over(w) for z, x in columns.items()} | {f"__s_{z}": F.stddev_pop(x).over(w) for z, x in columns.items()})
    else:
        stats = df.groupBy(*keys).agg(
            *[F.avg(x).alias(f"__m_{z}") for z, x in columns.items()], *[F.stddev_pop(x).alias(f"__s_{z}") for z, x in columns.items()]
        )
        df = df.join(stats, keys)
    out = {}
    for z, x in columns.items():
        v = F.when(F.col(f"__s_{z}") > eps, (col(x) - F.col(f"__m_{z}")) / F.col(f"__s_{z}"))
        v = F.coalesce(v, F.lit(0.0))
        out[z] = F.greatest(F.lit(-float(cap)), F.least(F.lit(float(cap)), v)) if cap else v
    return df.withColumns(out).drop(*[f"__m_{z}" for z in columns], *[f"__s_{z}" for z in columns])
