"""Detectors against direct restatements, and streaming state against the batch fold."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.indicators import parabolic_sar
from barloom.streaming import detectors as dtc
from barloom.streaming import pipelines as pp


def walk(detector, xs):
    state, step = detector
    out = []
    for x in xs:
        state, o = step(state, x)
        out.append(o)
    return out


@pytest.fixture(scope="module")
def jump():
    random.seed(1)
    return [random.random() * 0.2 for _ in range(120)] + [0.8 + random.random() * 0.2 for _ in range(120)]


@pytest.mark.parametrize("financial", [False, True])
def test_adwin_first_cut_matches_a_scan_of_all_cuts(jump, financial):
    window, want = [], []
    jump = jump + [0.9 + 3 * (x - 0.9) for x in jump[-100:]]

    def other(a, b):
        spread, trend = [float(np.std(v)) for v in (a, b)], [float(np.polyfit(range(len(v)), v, 1)[0]) for v in (a, b)]
        return max(spread) / (min(spread) + 1e-8) > 2 or abs(trend[0] - trend[1]) > 0.1
    for x in jump:
        window = (window + [x])[-200:]
        n, cut = len(window), None
        for i in range(20, n - 20):
            a, b = window[:i], window[i:]
            if abs(sum(a) / len(a) - sum(b) / len(b)) > math.sqrt(2 * (1 / len(a) + 1 / len(b)) * math.log(2 * n / 0.002)) and (not financial or other(a, b)):
                cut = i
                break
        want.append(float(cut) if cut else -1.0)
        if cut:
            window = window[cut:]
    got = [o[0] for o in walk(dtc.adwin(0.002, 20, 200, financial), jump)]
    assert got == want


def test_watch_keeps_its_cool_downs(spark):
    hours = [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=10 * i) for i in range(12)]
    df = spark.createDataFrame(pd.DataFrame({"key": "k", "hour": hours, "a": [int(i not in (1, 2)) for i in range(12)], "b": 0}))
    out = dtc.watch(df, "key", "hour", ("a", "b"), 24, 48, 40).orderBy("hour").toPandas()
    # alerts at 0, 30, 40, ... hours; the cool-down runs from the last retune
    assert [10 * i for i in range(12) if out.retune[i]] == [0, 30, 60, 90]
    assert [10 * i for i in range(12) if out.retrain[i]] == [50, 100]
    assert out.alerts.tolist()[-1] == 10


def test_hysteresis_counts_rows_unlike_the_active_label(spark):
    from barloom.operators.regimes import hysteresis

    days = [pd.Timestamp("2024-01-01") + pd.Timedelta(days=i) for i in range(9)]
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "date": days, "l": list("abcbacbbb")}))
    assert "".join(r.active for r in hysteresis(df, "l", 3).orderBy("date").collect()) == "aaabbbbbb"


def test_adwin_half_detects_the_jump(jump):
    hits = [i for i, o in enumerate(walk(dtc.adwin_half(0.002), jump)) if o[0]]
    assert hits and 120 <= hits[0] < 200


def test_page_hinkley_signals_direction(jump):
    up = walk(dtc.page_hinkley(0.99, 1.0, 3), jump)
    down = walk(dtc.page_hinkley(0.99, 1.0, 3), [1 - x for x in jump])
    assert next(o[0] for o in up if o[0]) == 1.0 and next(o[0] for o in down if o[0]) == -1.0


def test_ddm_warns_then_drifts_and_restarts():
    xs = [1.0, 0.0, 0.0, 0.0] * 20 + [1.0] * 40
    out = walk(dtc.ddm(), xs)
    levels = [o[0] for o in out]
    assert levels[:30] == [0.0] * 30
    drift = levels.index(2.0)
    assert drift > 80 and 1.0 in levels[80:drift]
    assert levels[drift + 1 :] == [0.0] * (len(xs) - drift - 1) and out[drift + 1][1] == 1.0


def test_adaptive_conformal_moves_towards_coverage():
    random.seed(3)
    out = walk(dtc.adaptive_conformal(0.1, 0.05), [random.random() for _ in range(4000)])
    assert sum(o[1] for o in out[1000:]) / 3000 == pytest.approx(0.1, abs=0.02)


def test_parabolic_sar_follows_trend(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + p + 0.5, 10.0 + p - 0.5) for i, p in enumerate([*range(15), *range(14, -10, -1)])]
    got = [r["psar"] for r in parabolic_sar(spark.createDataFrame(rows, "symbol string, date date, high double, low double")).orderBy("date").collect()]
    assert all(s < r[3] for s, r in zip(got[1:15], rows[1:15])) and all(s > r[2] for s, r in zip(got[25:], rows[25:]))


def write_batches(spark, sf_dir, folder, parts=4):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / parts
    for i in range(parts):
        a, b = lo + step * i, lo + step * (i + 1) + (dt.timedelta(seconds=1) if i == parts - 1 else dt.timedelta())
        e.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).coalesce(1).write.mode("append").parquet(folder)
    return e


def run_stream(df, name, mode, ckpt):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    query.awaitTermination(300)
    query.stop()


def table(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*cols).collect())


def test_streaming_windows_equal_batch(spark, sf_dir, tmp_path):
    e = write_batches(spark, sf_dir, str(tmp_path / "in"))
    run_stream(pp.tumbling(pp.read_events(spark, str(tmp_path / "in"))), "tumbled", "complete", str(tmp_path / "c"))
    assert table(spark.table("tumbled")) == table(pp.tumbling(e, watermark=None))


def test_streaming_detector_equals_batch_fold(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    d = pp.hourly_diagnostics(e).select("key", "hour", "value").cache()
    cut = d.agg(F.percentile_approx(F.col("hour").cast("long"), 0.5)).first()[0]
    folder = str(tmp_path / "in")
    d.where(F.col("hour").cast("long") <= cut).coalesce(1).write.mode("append").parquet(folder)
    d.where(F.col("hour").cast("long") > cut).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    det = dtc.page_hinkley(0.99, 1.0, 3)
    run_stream(dtc.stream_fold(stream, det, "key", "hour", "value"), "folded", "append", str(tmp_path / "c"))
    assert table(spark.table("folded")) == table(dtc.fold(d, det, "key", "hour", "value"))


def test_upsert_sink_survives_a_replayed_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    write = pp.upsert_sink(path)
    a = spark.createDataFrame([("x", 1, 10.0), ("y", 1, 20.0)], "event_type string, start int, v double")
    b = spark.createDataFrame([("x", 1, 11.0), ("z", 2, 5.0)], "event_type string, start int, v double")
    for batch, i in ((a, 0), (b, 1), (b, 1)):
        write(batch, i)
    got = {(r["event_type"], r["start"]): r["v"] for r in pp.read_upserts(spark, path).collect()}
    assert got == {("x", 1): 11.0, ("y", 1): 20.0, ("z", 2): 5.0}
