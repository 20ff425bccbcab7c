"""Sequential detectors as small state steps, folded per key in batch or kept as streaming state.

A detector reads one bounded series per key (hourly or daily diagnostics, reduced from raw events by map-side combined
aggregation), so a fold never holds more rows than there are hours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, float], tuple[tuple, tuple]]


def page_hinkley(alpha=0.99, threshold=1.0, min_detections=3) -> tuple[tuple, Step]:
    """Two-sided Page-Hinkley with an exponentially weighted mean; sums reset on detection.

    Output: (signal, statistic) with signal +1 upward, -1 downward, 0 none.
    """

    def step(s, x):
        mean, up, dn, n_up, n_dn, seen = s
        mean = alpha * mean + (1 - alpha) * x if seen else x
        dev = x - mean
        if dev > 0:
            up, n_up = max(0.0, up + dev), n_up + 1
        else:
            dn, n_dn = max(0.0, dn - dev), n_dn + 1
        if up > threshold and n_up >= min_detections:
            return (mean, 0.0, dn, 0.0, n_dn, 1.0), (1.0, up)
        if dn > threshold and n_dn >= min_detections:
            return (mean, up, 0.0, n_up, 0.0, 1.0), (-1.0, dn)
        return (mean, up, dn, n_up, n_dn, 1.0), (0.0, max(up, dn))

    return (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), step


def page_hinkley_range(alpha=0.9999, threshold=5.0) -> tuple[tuple, Step]:
    """Variant on the range of the cumulative sums; the mean survives a reset. Output: (detected, strength)."""

    def step(s, x):
        mean, up, dn, lo, hi = s
        mean = alpha * mean + (1 - alpha) * x
        up, dn = max(0.0, up + x - mean), min(0.0, dn + x - mean)
        lo, hi = min(lo, up), max(hi, dn)
        stat = max(up - lo, hi - dn)
        if stat > threshold:
            return (mean, 0.0, 0.0, 0.0, 0.0), (1.0, 1.0)
        return (mean, up, dn, lo, hi), (0.0, min(1.0, stat / threshold))

    return (0.0, 0.0, 0.0, 0.0, 0.0), step


def ddm(warn=2.0, drift=3.0, warmup=30) -> tuple[tuple, Step]:
    """Drift detection on a 0/1 error series: warning and drift levels above the best error rate seen since the reset.

    Output: (level, error_rate) with level 0 none, 1 warning, 2 drift.
    """
    start = (0.0, 0.0, math.inf, math.inf)

    def step(s, x):
        n, e, best, best_sd = s
        n, e = n + 1, e + x
        p = e / n
        sd = math.sqrt(p * (1 - p) / n) if n > 1 else 0.0
        if p + sd < best + best_sd:
            best, best_sd = p, sd
        if n > warmup:
            if p + sd > best + drift * best_sd:
                return start, (2.0, p)
            if p + sd > best + warn * best_sd:
                return (n, e, best, best_sd), (1.0, p)
        return (n, e, best, best_sd), (0.0, p)

    return start, step


class Window:
    """The last values of a series with prefix sums of values, squares and index-weighted values, so that mean, spread and slope of
    both sides of any cut come from a few differences. A new value adds one entry; dropped values move the window's start."""

    def __init__(self, most: int):
        self.most, self.lo, self.hi = most, 0, 0
        self.x = np.zeros(2 * most + 2)
        #: sums of the values before place i: of x - origin, of its square, and of i * (x - origin)
        self.sums = np.zeros((3, 2 * most + 3))
        self.origin = 0.0

    def __len__(self) -> int:
        return self.hi - self.lo

    def of(self, values) -> Window:
        """A window of its own with these values."""
        out = Window(self.most)
        out._set(np.asarray(values, float))
        return out

    def values(self) -> list[float]:
        return self.x[self.lo : self.hi].tolist()

    def _set(self, values: np.ndarray) -> None:
        n = len(values)
        self.lo, self.hi, self.x[:n] = 0, n, values
        # about their own level the values' squares keep their digits
        self.origin = float(values.mean()) if n else 0.0
        y = values - self.origin
        for row, part in zip(self.sums, (y, y * y, np.arange(n) * y), strict=True):
            row[0] = 0.0
            np.cumsum(part, out=row[1 : n + 1])

    def push(self, value: float) -> None:
        if self.hi == len(self.x):
            self._set(self.x[self.lo : self.hi].copy())
        if self.lo == self.hi:
            self.origin = value
        i, y = self.hi, value - self.origin
        self.x[i] = value
        self.sums[:, i + 1] = self.sums[:, i] + (y, y * y, i * y)
        self.hi += 1
        self.lo = max(self.lo, self.hi - self.most)

    def cut(self, size: int) -> None:
        """Keep the last `size` values."""
        self._set(self.x[self.hi - size : self.hi].copy())

    def sides(self, left: np.ndarray):
        """(mean, spread, slope) of the first `left` values, for several cuts at once, and the same of the rest."""
        edge, cut = self.lo, self.lo + left
        for a, b in ((edge, cut), (cut, self.hi)):
            n = b - a
            s, q, w = (row[b] - row[a] for row in self.sums)
            mean = s / n
            spread = np.sqrt(np.maximum(0.0, q / n - mean * mean))
            # the weights count from the side's own start
            around = w - a * s - (n - 1) / 2 * s
            yield mean + self.origin, spread, around / np.maximum(n * (n * n - 1.0) / 12, 1e-300) * (n > 1)


def adwin(delta=0.002, min_size=30, max_size=1000, financial=True) -> tuple[Window, Step]:
    """Adaptive window: the first cut whose half means differ by more than the bound; the window keeps the newer side.

    Both sides hold `min_size` values, the newer one more than that. With `financial` the cut must also come with another
    volatility or trend. The window holds at most `max_size` values. All cuts are judged at once, from prefix sums.
    Output: (cut, window size); cut -1 when there is none.
    """

    def step(window: Window, x: float):
        if not len(window):
            window = Window(max_size)
        window.push(x)
        n = len(window)
        left = np.arange(min_size, n - min_size)
        if len(left):
            (m0, s0, t0), (m1, s1, t1) = window.sides(left)
            bound = np.sqrt(2 * (1 / left + 1 / (n - left)) * math.log(2 * n / delta))
            found = np.abs(m0 - m1) > bound
            if financial and found.any():
                found &= (np.maximum(s0, s1) / (np.minimum(s0, s1) + 1e-8) > 2) | (np.abs(t0 - t1) > 0.1)
            if found.any():
                i = int(left[found.argmax()])
                window.cut(n - i)
                return window, (float(i), float(n - i))
        return window, (-1.0, float(n))

    return Window(max_size), step


def adwin_half(delta=0.002, max_size=500) -> tuple[Window, Step]:
    """Simplified variant: compares the two halves of the window with a variance bound. Output: (detected, strength)."""

    def step(window: Window, x: float):
        if not len(window):
            window = Window(max_size)
        window.push(x)
        n = len(window)
        if n > 2:
            h = n // 2
            (m0, s0, _), (m1, s1, _) = window.sides(np.array([h]))
            mean = (h * m0[0] + (n - h) * m1[0]) / n
            # the variance of all from those of both halves
            var = (h * (s0[0] ** 2 + (m0[0] - mean) ** 2) + (n - h) * (s1[0] ** 2 + (m1[0] - mean) ** 2)) / n
            if var > 0:
                log = math.log(2 / delta)
                eps = math.sqrt(2 * var * log / n) + 2 * log / (3 * n)
                diff = float(abs(m0[0] - m1[0]))
                if diff > eps:
                    window.cut(n - h)
                    return window, (1.0, min(1.0, diff / eps))
        return window, (0.0, 0.0)

    return Window(max_size), step


def online_scaler(alpha=0.05) -> tuple[tuple, Step]:
    """Exponentially weighted mean and variance of single observations. Output: (mean, scaled value)."""

    def step(s, x):
        mean, var, seen = s
        mean, var = ((1 - alpha) * mean + alpha * x, (1 - alpha) * var + alpha * (x - mean) ** 2) if seen else (x, 0.0)
        return (mean, var, 1.0), (mean, (x - mean) / math.sqrt(var) if var > 1e-12 else 0.0)

    return (0.0, 0.0, 0.0), step


def adaptive_conformal(alpha=0.1, rate=0.05) -> tuple[tuple, Step]:
    """Running conformal quantile nudged by coverage errors. Output: (quantile, missed)."""

    def step(s, x):
        q, seen = s
        if not seen:
            return (x, 1.0), (x, 0.0)
        miss = 1.0 if x > q else 0.0
        q = max(0.0, q + rate * (miss - alpha))
        return (q, 1.0), (q, miss)

    return (0.0, 0.0), step


def fold(df: DataFrame, detector: tuple[tuple, Step], key: str, order: str, x: str, names=("signal", "statistic")) -> DataFrame:
    """Run a detector over every key's ordered series (batch)."""
    start, step = detector

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, out = start, []
        for v in pdf[x].to_numpy():
            state, o = step(state, float(v))
            out.append(o)
        res = pdf[[key, order]].copy()
        res[names[0]], res[names[1]] = [o[0] for o in out], [o[1] for o in out]
        return res

    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, {names[0]} double, {names[1]} double"
    return df.select(key, order, x).where(df[x].isNotNull()).groupBy(key).applyInPandas(run, schema)


def stream_fold(df: DataFrame, detector: tuple[tuple, Step], key: str, order: str, x: str, names=("signal", "statistic")) -> DataFrame:
    """The same detector as stateful streaming: state per key survives batches and restarts.

    Rows of one batch are folded in time order; the source must deliver batches in time order per key.
    """
    start, step = detector

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = start
        if state.exists:
            s = start.of(state.get[0]) if isinstance(start, Window) else tuple(state.get[0])
        pdf = pd.concat(list(frames)).sort_values(order)
        out = []
        for v in pdf[x].to_numpy():
            s, o = step(s, float(v))
            out.append(o)
        state.update((s.values() if isinstance(s, Window) else list(s),))
        yield pd.DataFrame({key: keys[0], order: pdf[order].to_numpy(), names[0]: [o[0] for o in out], names[1]: [o[1] for o in out]})

    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, {names[0]} double, {names[1]} double"
    return df.select(key, order, x).groupBy(key).applyInPandasWithState(run, schema, "s array<double>", "append", GroupStateTimeout.NoTimeout)


def watch(df: DataFrame, key: str, order: str, alerts: tuple[str, ...], retune_hours: float, persist_hours: float, retrain_hours: float) -> DataFrame:
    """Decisions per key from alert columns (0/1), taken in the order given: `retune` when an alert comes and the last retune is
    `retune_hours` ago; `retrain` when alerts have gone on for `persist_hours` since the first one (or since the last retrain) and
    the last retrain is `retrain_hours` ago. `alerts` counts those so far. A true recurrence: folded over each key's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        retuned = first = retrained = None
        seen, out = 0, []
        for at, *flags in pdf[[order, *alerts]].itertuples(index=False):
            retune = retrain = 0
            for on in flags:
                if not on:
                    continue
                seen += 1
                if retuned is None or (at - retuned).total_seconds() >= 3600 * retune_hours:
                    retune, retuned = 1, at
                if first is None:
                    first = at
                elif retrained is not None and (at - retrained).total_seconds() < 3600 * retrain_hours:
                    continue
                elif (at - first).total_seconds() >= 3600 * persist_hours:
                    retrain, retrained, first = 1, at, at
            out.append((seen, retune, retrain))
        res = pdf[[key, order]].copy()
        for i, name in enumerate(("alerts", "retune", "retrain")):
            res[name] = [o[i] for o in out]
        return res

    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, alerts long, retune long, retrain long"
    return df.select(key, order, *alerts).groupBy(key).applyInPandas(run, schema)
