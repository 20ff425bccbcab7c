"""Structured Streaming forms of the event operators: filters, event-time windows, late rows, upsert sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import flag
from barloom.functions.orderstats import ranked_values
from barloom.functions.windows import Roll

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def market_hours(ts="ts", tz="America/New_York") -> Column:
    """Weekday and 9 <= hour < 16 in the market's zone."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    return (F.weekday(local) < 5) & F.hour(local).between(9, 15)


def read_events(spark, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet folder as a stream with a fixed schema."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling(df: DataFrame, size="1 hour", watermark: str | None = "2 hours", keys=("event_type",)) -> DataFrame:
    """Count, sum, mean and error share per key and event-time window; works on batch and streaming input."""
    return windowed(df, F.window("ts", size), watermark, keys)


def sliding(df: DataFrame, size="6 hours", slide="1 hour", watermark: str | None = "2 hours", keys=("event_type",)) -> DataFrame:
    return windowed(df, F.window("ts", size, slide), watermark, keys)


def sessions(df: DataFrame, gap="30 minutes", watermark: str | None = "2 hours", keys=("user_id",)) -> DataFrame:
    return windowed(df, F.session_window("ts", gap), watermark, keys)


def windowed(df: DataFrame, window: Column, watermark: str | None, keys) -> DataFrame:
    if watermark:
        df = df.withWatermark("ts", watermark)
    g = df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.avg(flag(F.col("event_type") == "error")).alias("error_rate"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean", "error_rate")


def deduplicated(df: DataFrame, keys=("event_id",), watermark="2 hours") -> DataFrame:
    return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def route_late(df: DataFrame, now: Column, allowed: str = "2 hours") -> tuple[DataFrame, DataFrame]:
    """(on time, late) by the distance of the event time from a reference time."""
    late = F.col("ts") < now - F.expr(f"INTERVAL {allowed}")
    return df.where(~late), df.where(late)


def upsert_sink(path: str, keys=("event_type", "start")):
    """foreachBatch writer: each batch is one folder named by its id, so a replayed batch overwrites itself.

    `read_upserts` returns the newest row per key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    return write


def read_upserts(spark, path: str, keys=("event_type", "start")) -> DataFrame:
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*keys, "batch_id", "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__r")).select(*keys, "__r.*")


def hourly_diagnostics(events: DataFrame, key="event_type") -> DataFrame:
    """Bounded per-key series for the detectors: mean value and low-value share per hour."""
    return events.groupBy(F.col(key).alias("key"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        (F.avg("value") / 100).alias("value"), F.avg(flag(F.col("value") < 10)).alias("low_share"), F.count("*").alias("n")
    )


# ---- windowed monitors ----------------------------------------------------------------------------------------------
def distribution_drift(df: DataFrame, x: str, n: int = 24, r: Roll | None = None, threshold: float = 0.3) -> DataFrame:
    """Mean, log-std and skew change of the trailing n rows against the first n rows of the key (needs n rows)."""
    r = r or Roll("key", "hour")
    d = df.withColumns({"__i": r.row(), "__m": r.mean(x, n), "__s": r.std0(x, n), "__k": F.when(r.count(x, n) >= n, F.skewness(x).over(r.frame(n)))})
    base = d.where(F.col("__i") == n).select(*r.keys, F.col("__m").alias("__bm"), F.col("__s").alias("__bs"), F.col("__k").alias("__bk"))
    d = d.join(base, r.keys)
    d = d.withColumns(
        {
            "mean_shift": F.abs(F.col("__m") - F.col("__bm")) / (F.col("__bs") + 1e-8),
            "log_std_ratio": F.abs(F.ln(F.col("__s") / (F.col("__bs") + 1e-8) + 1e-12)),
            "skew_change": F.abs(F.col("__k") - F.col("__bk")),
        }
    )
    top = F.greatest("mean_shift", "log_std_ratio", "skew_change")
    sev = F.when(top.isNull(), None).when(~((F.col("mean_shift") > threshold) | (F.col("log_std_ratio") > threshold) | (F.col("skew_change") > 0.5)), "none")
    return d.withColumn("severity", sev.when(top > 1, "major").when(top > 0.5, "moderate").otherwise("minor")).drop("__i", "__m", "__s", "__k", "__bm", "__bs", "__bk")


def ks_drift(a: DataFrame, b: DataFrame, x: str, keys) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per key, for groups of any size.

    Both samples are ranked together once; a second rank table over sample b gives, joined on the value, how many of b lie
    at or below it, and the rest of the joint count belongs to a. Values only in a take b's count from the joint rank:
    joint count minus a's own count.
    """
    keys = list(keys)
    both = a.select(*keys, x).unionByName(b.select(*keys, x))
    upto = lambda name, n: [(F.col("below") + F.col("cnt")).alias(name), F.col("total").alias(n)]
    u = ranked_values(both, keys, x).select(*keys, x, *upto("__u", "__n"))
    ra = ranked_values(a.select(*keys, x), keys, x).select(*keys, x, *upto("__ua", "__na"))
    rb = ranked_values(b.select(*keys, x), keys, x).select(*keys, x, *upto("__ub", "__nb"))
    n = ra.groupBy(*keys).agg(F.max("__na").alias("n_a")).join(rb.groupBy(*keys).agg(F.max("__nb").alias("n_b")), keys)
    # every joint value occurs in a or in b, so one of the two counts is known and the other is the difference
    j = u.join(ra.drop("__na"), [*keys, x], "left").join(rb.drop("__nb"), [*keys, x], "left").join(n, keys)
    fa = F.coalesce(F.col("__ua"), F.col("__u") - F.col("__ub"))
    fb = F.coalesce(F.col("__ub"), F.col("__u") - F.col("__ua"))
    g = j.groupBy(*keys).agg(F.max(F.abs(fa / F.col("n_a") - fb / F.col("n_b"))).alias("ks"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks")
    # asymptotic tail probability, six alternating terms
    p = 2 * sum(((-1) ** (k - 1) * F.exp(-2 * k * k * lam * lam) for k in range(1, 7)), F.lit(0.0))
    return g.withColumn("drift_score", 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def residual_drift(df: DataFrame, e: str, n: int, r: Roll, accuracy=0.2, bias=0.1) -> DataFrame:
    """MSE ratio and bias change of the trailing n residuals against the key's first n."""
    d = df.withColumns({"__i": r.row(), "mse": r.mean(F.col(e) * F.col(e), n), "bias": r.mean(e, n)})
    base = d.where(F.col("__i") == n).select(*r.keys, F.col("mse").alias("__bm"), F.col("bias").alias("__bb"))
    d = d.join(base, r.keys).withColumns({"mse_ratio": F.col("mse") / (F.col("__bm") + 1e-8), "bias_change": F.abs(F.col("bias") - F.col("__bb"))})
    kind = F.when(F.col("mse_ratio") > 1 + accuracy, "accuracy_degradation").when(F.col("bias_change") > bias, "systematic_bias").otherwise("none")
    return d.withColumn("drift_type", F.when(F.col("mse_ratio").isNotNull(), kind)).drop("__i", "__bm", "__bb")


def recency_weights(df: DataFrame, decay: float, window: int, floor: float, r: Roll) -> DataFrame:
    """decay^age with a floor over the last `window` rows of a key, normalised to one."""
    size = F.count("*").over(Window.partitionBy(*r.keys))
    d = df.withColumn("age", size - r.row()).where(F.col("age") < window)
    d = d.withColumn("__w", F.greatest(F.pow(F.lit(decay), "age"), F.lit(floor)))
    return d.withColumn("weight", F.col("__w") / F.sum("__w").over(Window.partitionBy(*r.keys))).drop("__w")


def control_limits(df: DataFrame, x: str, r: Roll, k: float = 3.0, warn: float = 2.0, mp: int = 20) -> DataFrame:
    """Limits from all earlier rows (at least 20) and the class of the current value."""
    m, s = r.mean(x, None, mp, shift=1), r.std(x, None, mp, shift=1)
    d = df.withColumns({"__m": m, "__s": s})
    dev = F.col(x) - F.col("__m")
    state = F.when(F.col("__s").isNull(), "warming_up").when(F.abs(dev) > k * F.col("__s"), "control_violation").when(F.abs(dev) > warn * F.col("__s"), "warning_zone").otherwise("ok")
    return d.withColumns({"upper": F.col("__m") + k * F.col("__s"), "lower": F.col("__m") - k * F.col("__s"), "state": state}).drop("__m", "__s")


def monotone_trend(df: DataFrame, x: str, k: int, r: Roll) -> DataFrame:
    """deteriorating / improving when the last k values never fall / never rise."""
    d = df.withColumn("__d", r.diff(x))
    full = r.row() >= k
    w = r.frame(k - 1)
    up, dn = F.min("__d").over(w) >= 0, F.max("__d").over(w) <= 0
    return d.withColumn("trend", F.when(full & up, "deteriorating").when(full & dn, "improving").otherwise("none")).drop("__d")
