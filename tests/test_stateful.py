"""Recurrences as streams: rows in any order, restarts and late rows, against the batch fold."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import regimes
from barloom.streaming import detectors as dtc
from barloom.streaming import stateful as st

START = dt.datetime(2024, 1, 1)


def rows_of(seed=1, keys=3, hours=150):
    rnd = random.Random(seed)
    out = []
    for k in range(keys):
        for h in range(hours):
            if rnd.random() < 0.9:
                value = rnd.random() * (0.2 if h < 70 else 3.0) + (0.0 if h < 70 else 2.0)
                out.append((f"k{k}", START + dt.timedelta(hours=h), value, rnd.choice(["low", "mid", "high", "high", None]), int(rnd.random() < 0.3), int(rnd.random() < 0.1)))
    return out


SCHEMA = "key string, at timestamp, value double, label string, a int, b int"


def write(spark, rows, folder, batches, disorder, seed=0):
    """Files of rows whose times are `disorder` hours out of order at most, within files and between them."""
    rnd = random.Random(seed)
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rnd.random() * disorder))
    size = -(-len(late) // batches)
    for i in range(batches):
        part = late[i * size : (i + 1) * size]
        rnd.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, name, rule, columns, delay, ckpt, forget=None):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = st.stream(source, rule, "key", "at", columns, delay, forget)
    path = f"{ckpt}-out"
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    query.stop()
    assert query.exception() is None
    return path


def table(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


RULES = {
    "page_hinkley": (st.of_detector(dtc.page_hinkley(0.99, 1.0, 3)), ("value",)),
    "ddm": (st.of_detector(dtc.ddm()), ("a",)),
    "adwin": (st.of_detector(dtc.adwin(0.002, 10, 60), "cut double, size double"), ("value",)),
    "adwin_half": (st.of_detector(dtc.adwin_half(0.3, 50), "detected double, strength double"), ("value",)),
    "conformal": (st.of_detector(dtc.adaptive_conformal(), "q double, missed double"), ("value",)),
    "hysteresis": (st.hysteresis(2), ("label",)),
    "watcher": (st.watcher(5, 20, 30), ("a", "b")),
}


@pytest.mark.parametrize("name", RULES)
def test_stream_in_any_order_and_restarted_equals_batch(spark, tmp_path, name):
    rule, columns = RULES[name]
    rows = rows_of()
    folder, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    # a last row of every key's far future moves the watermark past all others; itself it waits
    end = [(k, START + dt.timedelta(hours=1000), 0.0, "end", 0, 0) for k in ("k0", "k1", "k2")]
    half = len(rows) // 2
    by_time = sorted(rows, key=lambda r: r[1])
    write(spark, by_time[:half], folder, 2, disorder=5)
    run(spark, folder, name, rule, columns, "6 hours", ckpt)
    write(spark, by_time[half:], folder, 2, disorder=5, seed=2)
    run(spark, folder, name, rule, columns, "6 hours", ckpt)
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    path = run(spark, folder, name, rule, columns, "6 hours", ckpt)
    want = table(st.fold(spark.createDataFrame(rows, SCHEMA), rule, "key", "at", columns))
    assert table(spark.read.parquet(path)) == want and len(want) == len(rows)


def test_rows_behind_the_watermark_are_dropped_and_silent_keys_forgotten(spark, tmp_path):
    rule = st.of_detector(dtc.page_hinkley(0.9, 1.0, 2))
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [("k", at(h), float(h % 7), None, 0, 0) for h in (*range(20), *range(60, 80))]
    folder, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    for part in (rows[:20], [("x", at(40), 1.0, None, 0, 0)], [("k", at(3), 99.0, None, 0, 0)], rows[20:], [("x", at(500), 1.0, None, 0, 0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        path = run(spark, folder, "late", rule, ("value",), "2 hours", ckpt, forget=24)
    got = table(spark.read.parquet(path).where("key = 'k'"))
    assert got == table(st.fold(spark.createDataFrame(rows, SCHEMA), rule, "key", "at", ("value",), 24))
    assert got != table(st.fold(spark.createDataFrame(rows, SCHEMA), rule, "key", "at", ("value",)))


def test_batch_forms_agree_with_the_older_operators(spark):
    df = spark.createDataFrame(rows_of(4), SCHEMA)
    watched = dtc.watch(df, "key", "at", ("a", "b"), 5, 20, 30)
    assert table(st.fold(df, st.watcher(5, 20, 30), "key", "at", ("a", "b"))) == table(watched)
    labelled = df.where("label IS NOT NULL").select(F.col("key").alias("symbol"), F.col("at").alias("date"), "label")
    active = regimes.hysteresis(labelled, "label", 2).select(F.col("symbol").alias("key"), F.col("date").alias("at"), "active")
    assert table(st.fold(labelled, st.hysteresis(2), "symbol", "date", ("label",)).toDF("key", "at", "active")) == table(active)
    empty = st.fold(df.limit(0), st.watcher(5, 20, 30), "key", "at", ("a", "b"))
    assert empty.count() == 0 and empty.columns == ["key", "at", "alerts", "retune", "retrain"]


def test_window_moments_are_those_of_the_values():
    rnd = np.random.default_rng(2)
    window, kept = dtc.Window(50), []
    for i, x in enumerate(1e6 + rnd.standard_normal(400).cumsum()):
        window.push(x)
        kept = [*kept, x][-50:]
        if i % 90 == 80:
            window.cut(20)
            kept = kept[-20:]
        assert window.values() == kept
        for left in {1, len(kept) // 2, len(kept) - 1} - {0, len(kept)}:
            for (m, s, t), side in zip(window.sides(np.array([left])), (kept[:left], kept[left:]), strict=True):
                assert m[0] == pytest.approx(np.mean(side), rel=1e-12) and s[0] == pytest.approx(np.std(side), abs=1e-6)
                assert t[0] == pytest.approx(np.polyfit(np.arange(len(side)), np.array(side) - 1e6, 1)[0] if len(side) > 1 else 0.0, abs=1e-6)
    assert window.of(kept).values() == kept
