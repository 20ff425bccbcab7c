"""Joint moments of many columns as mergeable states: rows, means, and the sum of products of deviations.

A state comes from each batch by one matrix product, and states merge exactly as their rows would, so that tasks, groups of
tasks and segments of time are merged in that order. Segments cut at the ends of all training windows give every fold its state
by merging the segments before its end: one scan, however many folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: groups of tasks whose states are merged before those of a segment
GROUPS = 64
STATE = "segment long, n double, mean array<double>, m2 array<double>"
State = tuple[float, np.ndarray, np.ndarray]


def state_of(x: np.ndarray) -> State:
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    d = x - mean
    return float(len(x)), mean, d.T @ d


def merge(a: State, b: State) -> State:
    """The state of the rows of both."""
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _states(table: pa.Table, width: int) -> Iterator[tuple[int, State]]:
    for seg, n, mean, m2 in zip(*(table[c].to_pylist() for c in ("segment", "n", "mean", "m2")), strict=True):
        yield seg, (n, np.array(mean), np.array(m2).reshape(width, width))


def _rows(found: dict[int, State], **more) -> dict:
    return {**more, "segment": pa.array(list(found), pa.int64()), "n": pa.array([s[0] for s in found.values()], pa.float64()), "mean": pa.array([s[1] for s in found.values()], pa.list_(pa.float64())), "m2": pa.array([s[2].ravel() for s in found.values()], pa.list_(pa.float64()))}


def moments(df: DataFrame, columns: list[str], segment=None) -> DataFrame:
    """One state for each segment (an integer column; all rows are segment 0 without one). Rows with a null or non-finite value
    in any of the columns, or without a segment, take no part."""
    width = len(columns)
    values = F.array(*[F.col(c).cast("double") for c in columns])
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    slim = df.select((F.lit(0) if segment is None else segment).cast("long").alias("segment"), values.alias("x")).where(fine & F.col("segment").isNotNull())

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, State] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            at = batch.column("segment").to_numpy()
            for seg in np.unique(at).tolist():
                own = state_of(x[at == seg])
                found[seg] = merge(found[seg], own) if seg in found else own
        group = pa.array([TaskContext.get().partitionId() % GROUPS] * len(found), pa.int32())
        yield pa.RecordBatch.from_pydict(_rows(found, part=group))

    def merged(group: pa.Table) -> pa.Table:
        total: State | None = None
        seg = group["segment"][0].as_py()
        # in one order whatever came first: sums of doubles depend on it
        for _, state in sorted(_states(group, width), key=lambda s: (s[1][0], s[1][1].tolist())):
            total = state if total is None else merge(total, state)
        return pa.table(_rows({seg: total}))

    parts = slim.mapInArrow(of_task, f"part int, {STATE}")
    by_group = parts.groupBy("segment", "part").applyInArrow(merged, STATE)
    return by_group.groupBy("segment").applyInArrow(merged, STATE)


def ridge(state: State, strength: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients of the last column on the others, how far the normal equations are from holding, and what they make the
    columns' correlations with the last one.

    All columns are standardised first (population deviation), the penalty is on the standardised coefficients, relative to the
    target's deviation; a constant column gets 0.
    """
    n, _, m2 = state
    k = len(m2) - 1
    sd = np.sqrt(np.diag(m2) / max(n, 1.0))
    used = np.flatnonzero(sd[:k] > 1e-12)
    if not len(used) or sd[k] <= 1e-12:
        return np.zeros(k), 0.0, np.zeros(k)
    c = m2 / n / np.maximum(np.outer(sd, sd), 1e-300)
    a = c[np.ix_(used, used)] + strength / sd[k] * np.eye(len(used))
    b = np.linalg.solve(a, c[used, k])
    out = np.zeros(k)
    out[used] = b * sd[k] / sd[used]
    made = np.zeros(k)
    made[used] = a @ b
    return out, float(np.abs(made[used] - c[used, k]).max()), made


def fold_ridge(df: DataFrame, columns: list[str], y: str, folds: DataFrame, strength: float = 1e-3, date: str = "date") -> DataFrame:
    """fold, n, column, beta, residual and correlation (with the target, as the fitted coefficients make it) for every fold (fold,
    train_last): ridge regression on the rows up to its end."""
    ends = sorted((r["train_last"], int(r["fold"])) for r in folds.select("fold", "train_last").collect())  # a handful of boundaries
    schema = "fold int, n long, column string, beta double, residual double, correlation double"
    if not ends:
        return df.sparkSession.createDataFrame([], schema)
    cuts = sorted({end for end, _ in ends})
    earlier = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(date)))
    states = moments(df.where(F.col(date) <= F.lit(cuts[-1])), [*columns, y], earlier)
    width = len(columns) + 1

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        held = dict(_states(pa.Table.from_pandas(rows[["segment", "n", "mean", "m2"]], preserve_index=False), width))
        total, upto = (0.0, np.zeros(width), np.zeros((width, width))), {}
        for i, cut in enumerate(cuts):
            total = merge(total, held[i]) if i in held else total
            upto[cut] = total
        out = []
        for end, fold in ends:
            beta, residual, made = ridge(upto[end], strength)
            out += [(fold, int(upto[end][0]), c, float(b), residual, float(r)) for c, b, r in zip(columns, beta, made, strict=True)]
        return pd.DataFrame(out, columns=["fold", "n", "column", "beta", "residual", "correlation"])

    # one row for each end of a fold
    return states.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(solve, schema)


def principal_components(df: DataFrame, columns: list[str], k: int, out: str = "pc") -> tuple[DataFrame, list[float], np.ndarray]:
    """The standardised columns' projections on the k leading axes, all variance shares, and the axes as rows.

    Deviations are those of a sample. An axis points where its largest loading is positive, the first one of equals. A constant
    column counts as 0. Rows with a missing value are left out.
    """
    found = moments(df, columns).collect()  # one row
    if not found:
        empty = [F.lit(None).cast("double").alias(f"{out}{i + 1}") for i in range(k)]
        return df.limit(0).select(*df.columns, *empty), [], np.zeros((k, len(columns)))
    n, mean, m2 = found[0]["n"], np.array(found[0]["mean"]), np.array(found[0]["m2"]).reshape(len(columns), -1)
    sd = np.sqrt(np.diag(m2) / max(n - 1, 1.0))
    unit = np.where(sd > 1e-12, sd, np.inf)
    values, vectors = np.linalg.eigh(m2 / max(n - 1, 1.0) / np.outer(unit, unit))
    axes = vectors.T[::-1]
    lead = np.abs(axes).round(12).argmax(axis=1)
    axes = axes * np.where(axes[np.arange(len(axes)), lead] < 0, -1.0, 1.0)[:, None]
    values = np.maximum(values[::-1], 0.0)
    shares = (values / values.sum()).tolist() if values.sum() > 0 else [0.0] * len(values)
    made = {}
    for i in range(k):
        terms = [F.lit(float(a / u)) * (F.col(c).cast("double") - F.lit(float(m))) for a, u, c, m in zip(axes[i], unit, columns, mean, strict=True) if np.isfinite(u)]
        made[f"{out}{i + 1}"] = sum(terms, F.lit(0.0))
    return df.dropna(subset=columns).withColumns(made), shares, axes
