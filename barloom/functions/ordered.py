"""Ranks and quantiles of rolling frames from one ordered window per key.

The values of a frame stay in order while it moves: the entering one is put in its place, the leaving one taken out, so a row
costs a binary search for each question and not a copy of its frame. Questions on the same column and frame share the window.
The rows of a key are bounded by the calendar, as in every window over daily bars.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions.columns import col


@dataclass(frozen=True)
class Rank:
    """Rank of the row's own value within its last n rows, in (0, 1]; ties: average, max or min."""

    x: str
    n: int
    mp: int | None = None
    ties: str = "average"
    shift: int = 0

    def of(self, live: list[float], nans: int, x: float | None) -> float | None:
        if x is None:
            return None
        total = len(live) + nans
        below, upto = (len(live), total) if x != x else (bisect_left(live, x), bisect_right(live, x))
        return (upto if self.ties == "max" else below + 1 if self.ties == "min" else (below + upto + 1) / 2) / total


@dataclass(frozen=True)
class Level:
    """Linear-interpolated quantile p of the n rows that end `shift` rows ago; n=None: of all rows up to there."""

    x: str
    p: float
    n: int | None = None
    mp: int | None = None
    shift: int = 0

    def of(self, live: list[float], nans: int, x: float | None) -> float | None:
        at = lambda k: live[k] if k < len(live) else math.nan
        place = (len(live) + nans - 1) * self.p
        low, high = at(math.floor(place)), at(math.ceil(place))
        return low + (high - low) * (place - math.floor(place))


def scan(values: list[float | None], n: int | None, shift: int, asked: list[Rank | Level]) -> list[list[float | None]]:
    """Answers for every row. Nulls are not in the frame, NaN is above every number; fewer values than asked for give None."""
    live: list[float] = []
    nans = 0
    least = [max(1, q.mp if q.mp is not None else n or 1) for q in asked]
    found: list[list[float | None]] = [[] for _ in asked]
    for i, own in enumerate(values):
        new = values[i - shift] if i >= shift else None
        if new is not None:
            if new != new:
                nans += 1
            else:
                insort(live, new)
        old = values[i - shift - n] if n is not None and i >= shift + n else None
        if old is not None:
            if old != old:
                nans -= 1
            else:
                del live[bisect_left(live, old)]
        for out, q, mp in zip(found, asked, least, strict=True):
            out.append(q.of(live, nans, own) if len(live) + nans >= mp else None)
    return found


def answers(keys: list[Column], row: Column, df: DataFrame, outputs: dict[str, Rank | Level]) -> DataFrame:
    """`df` with a column for each output; `row` numbers the rows of a key in their order."""
    frames: dict[tuple, dict[str, Rank | Level]] = {}
    for name, q in outputs.items():
        frames.setdefault((q.x, q.n, q.shift), {})[name] = q
    source = {x: f"__x{i}" for i, x in enumerate(dict.fromkeys(x for x, _, _ in frames))}
    group = {f"__g{i}": k for i, k in enumerate(keys)}
    kept = [c for c in df.columns if c not in outputs]
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(name, DoubleType()) for name in outputs)])

    def of_key(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__row")
        values = {x: rows[c].to_pylist() for x, c in source.items()}
        found = {}
        for (x, n, shift), asked in frames.items():
            found.update(zip(asked, scan(values[x], n, shift, list(asked.values())), strict=True))
        rows = rows.select(kept)
        for name in outputs:
            rows = rows.append_column(name, pa.array(found[name], pa.float64()))
        return rows

    work = df.withColumns(group | {"__row": row} | {c: col(x).cast("double") for x, c in source.items()})
    apply: Callable = work.groupBy(*group).applyInArrow
    return apply(of_key, schema)
