"""Recurrences over a key's rows in event-time order, as one fold in batch and as a stateful stream with the same result.

The stream keeps rows waiting until the watermark has passed them, as an event-time timer tells, and then takes them in order: rows
of a batch, and batches, may come in any order within the watermark's delay. State is what the recurrence keeps, the rows that
wait, and the time up to which rows were taken; all of it is in the state store, so a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.streaming.detectors import Step, Window


@dataclass(frozen=True)
class Recurrence:
    """step(state, time in microseconds, values) -> (state, outputs), with the schema of what a state is stored as."""

    start: Any
    step: Callable[[Any, int, tuple], tuple[Any, tuple]]
    outputs: str
    stored: str = "s array<double>"
    pack: Callable[[Any], tuple] = field(default=lambda state: (list(state),))
    unpack: Callable[[tuple], Any] = field(default=lambda row: tuple(row[0]))


def of_detector(detector: tuple[tuple, Step], outputs: str = "signal double, statistic double") -> Recurrence:
    """A detector of one value a row."""
    start, step = detector
    if isinstance(start, Window):
        return Recurrence(start, lambda s, _, v: step(s, v[0]), outputs, pack=lambda s: (s.values(),), unpack=lambda row: start.of(row[0]))
    return Recurrence(start, lambda s, _, v: step(s, v[0]), outputs)


def hysteresis(confirmations: int = 3) -> Recurrence:
    """The active label: a row of that label resets the counter, any other raises it, and at `confirmations` the row's label
    becomes active. A null label counts as a label of its own."""

    def step(state, _, values):
        (met, active, count), new = state, values[0]
        count = 0 if not met or active == new else count + 1
        if count == 0 or count >= confirmations:
            active, count = new, 0
        return (True, active, count), (active,)

    return Recurrence((False, None, 0), step, "active string", "met boolean, active string, n int", pack=tuple, unpack=tuple)


def watcher(retune_hours: float, persist_hours: float, retrain_hours: float) -> Recurrence:
    """Decisions from alert flags (0/1), taken in the order given: `retune` when an alert comes and the last retune is
    `retune_hours` ago; `retrain` when alerts have gone on for `persist_hours` since the first one (or since the last retrain) and
    the last retrain is `retrain_hours` ago. `alerts` counts those so far."""
    hour = 3_600_000_000

    def step(state, at, flags):
        seen, retuned, first, retrained = state
        retune = retrain = 0
        for on in flags:
            if not on:
                continue
            seen += 1
            if retuned is None or at - retuned >= hour * retune_hours:
                retune, retuned = 1, at
            if first is None:
                first = at
            elif retrained is not None and at - retrained < hour * retrain_hours:
                continue
            elif at - first >= hour * persist_hours:
                retrain, retrained, first = 1, at, at
        return (seen, retuned, first, retrained), (seen, retune, retrain)

    return Recurrence((0, None, None, None), step, "alerts long, retune long, retrain long", "seen long, retuned long, first long, retrained long", pack=tuple, unpack=tuple)


def _value(x):
    return None if x is None or x != x else x.item() if hasattr(x, "item") else x


def _micros(times: pd.Series) -> list[int]:
    return [t.value // 1000 for t in pd.to_datetime(times)]


def _sort_key(row: tuple):
    """By time, then by values; nulls last."""
    return row[0], [(v is None, v if v is not None else 0) for v in row[1]]


def _take(rule: Recurrence, state, last: int | None, rows: list[tuple[int, tuple]], forget: int | None):
    out = []
    for at, values in sorted(rows, key=_sort_key):
        if forget is not None and last is not None and at - last > forget:
            state = rule.start
        state, found = rule.step(state, at, values)
        last = at
        out.append((at, found))
    return state, last, out


def _schema(df: DataFrame, key: str, order: str, rule: Recurrence) -> T.StructType:
    return T.StructType([df.schema[key], df.schema[order], *T.StructType.fromDDL(rule.outputs).fields])


def _frame(schema: T.StructType, key, found: list[tuple[int, tuple]]) -> pd.DataFrame:
    names = schema.names
    times = pd.to_datetime([at for at, _ in found], unit="us")
    return pd.DataFrame({names[0]: [key] * len(found), names[1]: times, **{n: pd.Series([o[i] for _, o in found], dtype=object) for i, n in enumerate(names[2:])}})


def fold(df: DataFrame, rule: Recurrence, key: str, order: str, columns: tuple[str, ...], forget_hours: float | None = None) -> DataFrame:
    """Batch: key, order and the outputs for each row with a time. Rows of equal time are taken by their values. With
    `forget_hours` a key starts anew after a longer gap. A key's rows are one group: reduce them first, as to hours."""
    schema, forget = _schema(df, key, order, rule), None if forget_hours is None else int(3_600_000_000 * forget_hours)

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        given = [(at, tuple(_value(v) for v in values)) for at, *values in zip(_micros(rows[order]), *(rows[c] for c in columns), strict=True)]
        return _frame(schema, keys[0], _take(rule, rule.start, None, given, forget)[2])

    return df.where(F.col(order).isNotNull()).select(key, order, *columns).groupBy(key).applyInPandas(run, schema)


class InOrder(StatefulProcessor):
    """Rows wait in a map until a timer says that the watermark has passed them."""

    def __init__(self, rule: Recurrence, schema: T.StructType, order: str, columns: tuple[str, ...], types: T.StructType, forget: int | None):
        self.rule, self.schema, self.order, self.columns, self.types, self.forget = rule, schema, order, columns, types, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.rule.stored)
        self.reached = handle.getValueState("reached", "at long, turn long")
        self.waiting = handle.getMapState("waiting", "at long, turn long", self.types)

    def _reached(self) -> tuple[int | None, int]:
        return tuple(self.reached.get()) if self.reached.exists() else (None, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, turn = self._reached()
        times = set()
        for frame in rows:
            for at, *values in zip(_micros(frame[self.order]), *(frame[c] for c in self.columns), strict=True):
                if last is not None and at <= last:
                    continue  # its place in the order has been passed
                self.waiting.updateValue((at, turn), tuple(_value(v) for v in values))
                turn += 1
                times.add(at // 1000 + 1)
        self.reached.update((last, turn))
        for at in times:
            self.handle.registerTimer(at)
        yield pd.DataFrame(columns=self.schema.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready = [(k, v) for k, v in self.waiting.iterator() if k[0] < now]
        last, turn = self._reached()
        state = self.rule.unpack(tuple(self.kept.get())) if self.kept.exists() else self.rule.start
        state, last, found = _take(self.rule, state, last, [(k[0], tuple(v)) for k, v in ready], self.forget)
        if found:
            for k, _ in ready:
                self.waiting.removeKey(k)
            self.kept.update(self.rule.pack(state))
            self.reached.update((last, turn))
            if self.forget is not None:
                self.handle.registerTimer((last + self.forget) // 1000 + 1)
        elif self.forget is not None and last is not None and last + self.forget < now and not any(True for _ in self.waiting.keys()):
            # nothing waits, and whatever still comes starts anew: the key leaves the store
            self.kept.clear()
            self.reached.clear()
        yield _frame(self.schema, key[0], found) if found else pd.DataFrame(columns=self.schema.names)

    def close(self) -> None:
        pass


def stream(df: DataFrame, rule: Recurrence, key: str, order: str, columns: tuple[str, ...], delay: str, forget_hours: float | None = None) -> DataFrame:
    """Streaming: the rows of `fold` in append mode, each once the watermark, `delay` behind the latest time, has passed it.

    Rows that come later than that are dropped, as the engine's own windows drop them. Needs the RocksDB state store (set in
    `barloom.session.SETTINGS`). With `forget_hours` a key without rows for so long leaves the store.
    """
    schema, forget = _schema(df, key, order, rule), None if forget_hours is None else int(3_600_000_000 * forget_hours)
    types = T.StructType([df.schema[c] for c in columns])
    timed = df.where(F.col(order).isNotNull()).select(key, order, *columns).withWatermark(order, delay)
    return timed.groupBy(key).transformWithStateInPandas(InOrder(rule, schema, order, columns, types, forget), schema, "Append", "EventTime")
