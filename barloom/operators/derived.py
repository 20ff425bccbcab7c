"""Derived families: row summaries, block scores, forecast quality, trust and drift features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import array_quantile, clip, col, finite, flag, row_mean, row_std
from barloom.functions.ordered import Level
from barloom.functions.windows import SYM, Roll, let
from barloom.operators.pairs import moments


def row_summary(df: DataFrame, columns: list[str], r: Roll = SYM) -> DataFrame:
    """Mean, std, median, 95-5 spread and third moment across columns, and the change of the level."""
    arr = F.sort_array(F.filter(F.array(*[F.col(c) for c in columns]), lambda v: v.isNotNull()))
    d = df.withColumns({"mean": row_mean(columns), "std": row_std(columns), "__a": arr})
    cube = F.aggregate(F.transform("__a", lambda v: F.pow(v - F.col("mean"), 3)), F.lit(0.0), lambda s, v: s + v) / F.size("__a")
    return d.withColumns(
        {
            "median": array_quantile("__a", 0.5), "spread_95_5": array_quantile("__a", 0.95) - array_quantile("__a", 0.05),
            "third_moment": cube / F.pow(F.greatest("std", F.lit(1e-9)), 3), "level_diff": r.diff("mean"),
        }
    ).drop("__a")


def block_score(df: DataFrame, columns: list[str], out: str, n=60, mp=20, r: Roll = SYM) -> DataFrame:
    """Row mean of a block as a rolling z; confidence is |z| over its rolling maximum."""
    d = df.withColumn("__m", row_mean([finite(c) for c in columns]))
    d = d.withColumn(f"{out}_score", r.z("__m", n, mp))
    top = r.max(F.abs(f"{out}_score"), n, 1)
    return d.withColumn(f"{out}_conf", clip(F.abs(f"{out}_score") / (top + 1e-9), 0, 1)).drop("__m")


def keyword_block(df: DataFrame, keywords: list[str], keep=("symbol", "date")) -> list[str]:
    """Numeric columns of a family that a block reads, chosen by name."""
    return [c for c in df.columns if c not in keep and any(k in c.lower() for k in keywords)]


# fixed values: name fragments that select the inputs of each block
BLOCKS = {
    "forecast": ["ret", "mom", "trend", "quantile"],
    "volatility": ["vol", "atr", "range", "garch"],
    "macro": ["vix", "ust", "dollar", "credit", "macro"],
    "fundamental": ["ratio", "margin", "growth", "debt"],
    "news": ["sentiment", "news", "score", "tone"],
}


def merge_blocks(frames: list[DataFrame], top: int, fit: str = "expanding", r: Roll = SYM) -> DataFrame:
    """Outer join of family blocks and standardisation; keeps the `top` columns by variance.

    The variance ranking is a schema-sized result collected once; the default standardisation uses past rows only.
    """
    d = reduce(lambda a, b: a.join(b, ["symbol", "date"], "full"), frames)
    cols = [c for c in d.columns if c not in ("symbol", "date")]
    v = d.agg(*[F.var_samp(finite(c)).alias(c) for c in cols]).first().asDict()  # one row, one number per column
    keep = sorted((c for c in cols if v[c] is not None and v[c] > 0), key=lambda c: (-v[c], c))[:top]
    w = Window.partitionBy(*r.keys) if fit == "full" else r.frame(None)
    z = {c: let(F.struct(F.avg(c).over(w).alias("m"), F.stddev_samp(c).over(w).alias("s"), F.col(c).alias("x")), lambda b: F.when(b.s > 1e-12, (b.x - b.m) / b.s)) for c in keep}
    return d.select("symbol", "date", *[F.coalesce(z[c], F.lit(0.0)).alias(c) for c in keep])


def aggregate_blocks(frames: list[DataFrame], scores: list[str], min_blocks: int, lags=(1, 3, 5), r: Roll = SYM) -> DataFrame:
    """Outer join of block scores; the composite needs a minimum of blocks; lags of every score."""
    d = reduce(lambda a, b: a.join(b, ["symbol", "date"], "full"), frames)
    n = sum((F.col(s).isNotNull().cast("int") for s in scores), F.lit(0))
    d = d.withColumns({"n_blocks": n, "composite": F.when(n >= min_blocks, row_mean(scores))})
    return d.withColumns({f"{s}_lag{k}": r.lag(s, k) for s in scores for k in lags})


def sliding_windows(df: DataFrame, columns: list[str], n: int, r: Roll = SYM) -> DataFrame:
    """The last n rows as an array of rows, present once n rows exist."""
    d = df.withColumn("window", F.collect_list(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])).over(r.frame(n)))
    return d.where(F.size("window") == n)


def quantile_summary(df: DataFrame, q10="q10", q50="q50", q90="q90", conf="conf") -> DataFrame:
    """Location, spread, volatility and skew proxies of a quantile forecast, plain and confidence-weighted."""
    a, m, b = F.col(q10), F.col(q50), F.col(q90)
    spread = b - a
    c = clip(F.coalesce(F.col(conf), F.lit(1.0)), 0, 1)
    return df.withColumns(
        {"loc": m, "spread": spread, "vol_proxy": spread / 2.563, "skew_proxy": (b + a - 2 * m) / (F.abs(spread) + 1e-9), "loc_weighted": m * c, "spread_weighted": spread * (1 - c)}
    )


def pattern_summary(df: DataFrame, means: dict[str, list[str]], maxima: dict[str, list[str]]) -> DataFrame:
    """Row means and maxima over column groups."""
    out = {k: row_mean(cs) for k, cs in means.items()}
    out |= {k: F.greatest(*[F.col(c) for c in cs]) if len(cs) > 1 else F.col(cs[0]) for k, cs in maxima.items()}
    return df.withColumns(out)


def forecast_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({"forecast_mean": row_mean(columns), "forecast_sign": F.signum(row_mean(columns)), "forecast_dispersion": row_std(columns)})


def pit_value(y, levels: dict[str, float]) -> Column:
    """Probability integral transform by linear interpolation between quantiles; the outer levels beyond them."""
    names = list(levels)
    y = col(y)
    out = F.when(y <= F.col(names[0]), F.lit(levels[names[0]]))
    for lo, hi in zip(names[:-1], names[1:]):
        a, b = F.col(lo), F.col(hi)
        frac = F.when(b - a > 1e-12, (y - a) / (b - a)).otherwise(0.0)
        out = out.when(y <= b, levels[lo] + (levels[hi] - levels[lo]) * frac)
    return out.otherwise(levels[names[-1]])


def quantile_calibration(df: DataFrame, levels: dict[str, float], y="y_true", keys=("symbol",)) -> DataFrame:
    """Coverage error per level summarised, widths, pinball, PIT statistics and entropy, violations, reliability line.

    Everything is one pass per key: levels are columns, the reliability line uses the closed form over the levels.
    """
    names = list(levels)
    pit = pit_value(y, levels)
    d = df.withColumn("__pit", pit)
    below = {c: F.avg(flag(F.col(y) <= F.col(c))) for c in names}
    pin = {c: F.greatest(p * (F.col(y) - F.col(c)), (p - 1) * (F.col(y) - F.col(c))) for c, p in levels.items()}
    mean_pin = row_mean(list(pin.values()))
    buckets = [F.avg(flag((F.least(F.floor(F.col("__pit") * 5 + 1e-9), F.lit(4)) == i))).alias(f"pit_bucket_{i}") for i in range(5)]
    g = d.groupBy(*keys).agg(
        *[b.alias(f"__b_{c}") for c, b in below.items()], F.avg(F.col(names[-1]) - F.col(names[0])).alias("width_outer"), F.avg(mean_pin).alias("pinball_mean"), F.stddev_pop(mean_pin).alias("pinball_std"),
        F.avg("__pit").alias("pit_mean"), F.stddev_pop("__pit").alias("pit_std"), *buckets,
        F.avg(flag((F.col(y) < F.col(names[0])) | (F.col(y) > F.col(names[-1])))).alias("violation_rate"), F.count("*").alias("n"),
    )
    errs = [F.abs(F.col(f"__b_{c}") - p) for c, p in levels.items()]
    n, mx = len(names), sum(levels.values()) / len(names)
    sxx = sum((p - mx) ** 2 for p in levels.values())
    my = sum((F.col(f"__b_{c}") for c in names), F.lit(0.0)) / n
    slope = sum(((p - mx) * F.col(f"__b_{c}") for c, p in levels.items()), F.lit(0.0)) / sxx
    ent = sum((F.when(F.col(f"pit_bucket_{i}") > 0, -F.col(f"pit_bucket_{i}") * F.ln(f"pit_bucket_{i}")).otherwise(0.0) for i in range(5)), F.lit(0.0))
    return g.withColumns(
        {
            "coverage_error_mean": sum(errs, F.lit(0.0)) / n, "coverage_error_max": F.greatest(*errs), "pit_entropy": ent,
            "reliability_slope": slope, "reliability_bias": my - slope * mx, **{f"coverage_error_{c}": F.col(f"__b_{c}") - p for c, p in levels.items()},
        }
    ).drop(*[f"__b_{c}" for c in names])


def calibration_daily(df: DataFrame, levels: dict[str, float], y="y_true", n=60, mp=20, r: Roll = SYM) -> DataFrame:
    """Calibration features per date over the rows before it: coverage error, width, pinball, PIT and their drift."""
    names = list(levels)
    errs = [F.abs(r.mean(flag(F.col(y) <= F.col(c)), n, mp, shift=1) - p) for c, p in levels.items()]
    pin = [F.greatest(p * (F.col(y) - F.col(c)), (p - 1) * (F.col(y) - F.col(c))) for c, p in levels.items()]
    d = df.withColumns({"coverage_error": sum(errs, F.lit(0.0)) / len(names), "__pin": row_mean(pin), "__pit": pit_value(y, levels), "__w": F.col(names[-1]) - F.col(names[0])})
    d = d.withColumns({"width": r.mean("__w", n, mp, shift=1), "pinball": r.mean("__pin", n, mp, shift=1), "pit_mean": r.mean("__pit", n, mp, shift=1), "pit_std": r.std0("__pit", n, mp, shift=1)})
    return d.withColumns({"coverage_drift_5": r.diff("coverage_error", 5), "coverage_drift_20": r.diff("coverage_error", 20)}).drop("__pin", "__pit", "__w")


def trust_features(df: DataFrame, y="y_true", q10="q10", q50="q50", q90="q90", r: Roll = SYM, shift: int = 0) -> DataFrame:
    """Trust score, spread shock, regime flags, quantile drift, width compression, asymmetric error rates.

    shift=1 leaves the current row out of the error statistics (the per-date family).
    """
    w, err = F.col(q90) - F.col(q10), F.col(y) - F.col(q50)
    d = df.withColumns({"__w": w, "__e": err, "__in": flag(F.col(y).between(F.col(q10), F.col(q90)))})
    d = d.withColumns({"__vol": r.std0(y, 20, 5, shift=shift), "__cov": r.mean("__in", 50, 10, shift=shift)})
    d = r.ordered(d, {"__med": Level("__w", 0.5, 20, 5), "__calm": Level("__vol", 0.75, 60, 10)})
    d = d.withColumns(
        {
            "trust_score": clip(1 - F.abs(F.col("__cov") - 0.8) / 0.8, 0, 1), "spread_shock": F.col("__w") / (F.col("__med") + 1e-9) - 1, "quantile_drift": r.diff(q50),
            "width_sigma": F.col("__w") / (F.col("__vol") + 1e-9), "upper_error_rate": r.mean(flag(F.col(y) > F.col(q90)), 50, 10, shift=shift), "lower_error_rate": r.mean(flag(F.col(y) < F.col(q10)), 50, 10, shift=shift),
            "trend_regime": F.signum(r.mean(y, 20, 5, shift=shift)), "vol_regime": flag(F.col("__vol") > F.col("__calm") + 1e-9),
        }
    )
    return d.withColumn("error_asymmetry", F.col("upper_error_rate") - F.col("lower_error_rate")).drop("__w", "__e", "__in", "__med", "__vol", "__cov", "__calm")


def drift_family(df: DataFrame, columns: list[str], n=60, recent=10, mp=20, r: Roll = SYM) -> DataFrame:
    """Change of mean, std and pairwise correlation between the last rows and the window before them.

    The pairs are of columns (schema-sized) and use rolling correlations of the row's own window.
    """
    out, shifts, stds, corrs = {}, [], [], []
    for c in columns:
        base_m, base_s = r.mean(c, n, mp, shift=recent), r.std0(c, n, mp, shift=recent)
        shifts.append(F.abs(r.mean(c, recent, recent) - base_m) / (base_s + 1e-9))
        stds.append(F.abs(r.std0(c, recent, recent) / (base_s + 1e-9) - 1))
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            corrs.append(F.abs(r.corr(a, b, recent, recent) - r.corr(a, b, n, mp, shift=recent)))
    out = {"mean_shift": row_mean(shifts), "std_shift": row_mean(stds), "corr_shift": row_mean(corrs)}
    d = df.withColumns(out)
    return d.withColumn("drift_score", row_mean(["mean_shift", "std_shift", "corr_shift"]))


def directional_accuracy(df: DataFrame, position="position", y="y_true", keys=("symbol",)) -> DataFrame:
    """Share of correct directions among traded rows; one half without trades."""
    on = F.col(position) != 0
    g = df.groupBy(*keys).agg(F.avg(F.when(on, flag(F.signum(position) == F.signum(y)))).alias("__a"), F.sum(flag(on)).alias("n_traded"))
    return g.withColumn("directional_accuracy", F.coalesce("__a", F.lit(0.5))).drop("__a")


def normalised_calibration_error(df: DataFrame, y="y_true", f="score", keys=("symbol",)) -> DataFrame:
    e = F.col(y) - F.col(f)
    g = df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("__e"), F.stddev_pop(y).alias("__s"))
    return g.withColumn("calibration_error", F.when(F.col("__s") > 1e-12, F.least(F.lit(1.0), F.col("__e") / F.col("__s"))).otherwise(1.0)).drop("__e", "__s")


def longest_monotone_streak(df: DataFrame, x: str, keys, order) -> DataFrame:
    """Longest run of rows moving the same way (count of rows in the run, at least 1)."""
    r = Roll(list(keys), order)
    d = df.withColumn("__dir", F.coalesce(F.signum(r.diff(x)), F.lit(0.0)))
    d = d.withColumn("__new", flag((F.col("__dir") == 0) | (F.col("__dir") != F.coalesce(r.lag("__dir"), F.lit(0.0)))))
    d = d.withColumn("__run", r.sum("__new"))
    g = d.groupBy(*keys, "__run").agg((F.sum(flag(F.col("__dir") != 0)) + 1).alias("__len"))
    return g.groupBy(*keys).agg(F.max("__len").cast("int").alias("longest_streak"))


def forecast_sanity(df: DataFrame, x: str, last: str, keys, order, bound=0.5, min_std=1e-6, max_streak=15) -> DataFrame:
    """Per forecast path: missing values, bound, variance band, monotone streak, price range; first failing check."""
    keys = list(keys)
    g = df.groupBy(*keys).agg(
        F.sum(flag(finite(x).isNull())).alias("n_bad"), F.max(F.abs(F.col(x) / F.col(last) - 1)).alias("max_move"), F.stddev_pop(F.col(x) / F.col(last)).alias("spread"), F.min(x).alias("lowest")
    )
    g = g.join(longest_monotone_streak(df, x, keys, order), keys)
    reason = (
        F.when(F.col("n_bad") > 0, "non_finite").when(F.col("lowest") <= 0, "price_range").when(F.col("max_move") > bound, "bounds")
        .when(F.coalesce("spread", F.lit(0.0)) < min_std, "variance").when(F.col("longest_streak") > max_streak, "monotone").otherwise("ok")
    )
    return g.withColumn("reason", reason)


def quantile_order_ok(df: DataFrame, names: list[str]) -> DataFrame:
    """1 where the quantiles of a row do not cross."""
    steps = [F.col(b) >= F.col(a) for a, b in zip(names[:-1], names[1:])]
    return df.withColumn("ordered", flag(reduce(lambda x, y: x & y, steps)))


def series_correlations(df: DataFrame, series="symbol", x="ret", names: DataFrame | None = None, strong=0.7) -> DataFrame:
    """Correlation of every pair of series over common dates, of those in the table `names` or of all; the pairs are the result."""
    if names is not None:
        df = df.join(names.select(series), series, "left_semi")
    g = moments(df, series, x).where(F.col("a") < F.col("b"))
    sa, sb = F.sqrt(F.col("m2_a") / F.col("n")), F.sqrt(F.col("m2_b") / F.col("n"))
    g = g.select("a", "b", "n", F.when((sa > 1e-12) & (sb > 1e-12), F.col("c") / F.col("n") / (sa * sb)).alias("corr"))
    return g.withColumn("strong", flag(F.abs("corr") >= strong))


def calibration_monitor(df: DataFrame, n: int, keys=("horizon",), order=("date", "symbol")) -> DataFrame:
    """ECE (right-closed bins), Brier and count over the last n rows per key.

    Rows are thinned by date counts first, so only the dates that can hold the last n rows reach the ranking.
    """
    from barloom.operators.evaluation import expected_calibration_error

    keys = list(keys)
    tail = last_rows(df, n, keys, list(order))
    e = expected_calibration_error(tail, keys, closed="right").select(*keys, "ece")
    b = tail.groupBy(*keys).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.count("*").alias("n"))
    return b.join(e, keys)


def last_rows(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Exactly the last n rows per key by a total order, without ranking a whole key in one task.

    Counts per (key, first order column) give the earliest value that can belong to the tail; only later rows are ranked.
    """
    head = order[0]
    c = df.groupBy(*keys, head).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy(F.desc(head)).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__later", F.coalesce(F.sum("__c").over(w), F.lit(0))).where(F.col("__later") < n).select(*keys, head)
    d = df.join(c, [*keys, head], "left_semi")
    rank = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return d.withColumn("__k", F.row_number().over(rank)).where(F.col("__k") <= n).drop("__k")


def coverage_by_horizon(df: DataFrame, lo="q10", hi="q90", y="y_true", target=0.8, tolerance=0.05, keys=("horizon",)) -> DataFrame:
    g = df.groupBy(*keys).agg(F.avg(flag(F.col(y).between(F.col(lo), F.col(hi)))).alias("coverage"), F.avg(F.col(hi) - F.col(lo)).alias("width"), F.count("*").alias("n"))
    return g.withColumn("violation", flag(F.abs(F.col("coverage") - target) > tolerance))


def regime_change_events(df: DataFrame, x: str, n=20, high=1.5, low=0.67, r: Roll = SYM) -> DataFrame:
    """Rows where the volatility regime (recent against long-run) changes."""
    d = df.withColumns({"__s": r.std(x, n, 5), "__l": r.std(x, n * 5, n)})
    ratio_ = F.col("__s") / (F.col("__l") + 1e-12)
    d = d.withColumns({"vol_ratio": ratio_, "vol_regime": F.when(ratio_ > high, "high").when(ratio_ < low, "low").when(ratio_.isNotNull(), "normal")})
    d = d.withColumn("__p", r.lag("vol_regime"))
    return d.where(F.col("__p").isNotNull() & (F.col("vol_regime") != F.col("__p"))).withColumnRenamed("__p", "previous_regime").drop("__s", "__l")


def business_cycle(df: DataFrame, columns: list[str], r: Roll) -> DataFrame:
    """Mean z of indicators as a score, its direction and the phase of the cycle."""
    d = df.withColumns({f"__z_{c}": r.z(c, 24, 12) for c in columns})
    d = d.withColumn("cycle_score", row_mean([f"__z_{c}" for c in columns]))
    d = d.withColumn("__d", r.diff("cycle_score"))
    s, up = F.col("cycle_score"), F.col("__d") > 0
    phase = F.when(s.isNull() | F.col("__d").isNull(), "unknown").when((s > 0) & up, "expansion").when(s > 0, "peak").when(up, "recovery").otherwise("contraction")
    return d.withColumn("cycle_phase", phase).drop("__d", *[f"__z_{c}" for c in columns])


def neutral_fill(scaffold: DataFrame, sentiment: DataFrame, columns: list[str], limit: int, r: Roll = SYM) -> DataFrame:
    """Sentiment known the day before, carried at most `limit` rows, neutral (0) after that."""
    d = scaffold.join(sentiment, ["symbol", "date"], "left")
    d = d.withColumns({c: r.lag(c) for c in columns})
    return d.withColumns({c: F.coalesce(r.ffill(c, limit), F.lit(0.0)) for c in columns})


def changed_correlations(before: DataFrame, after: DataFrame, names: DataFrame | None = None, series="symbol", x="ret", k: int = 5) -> DataFrame:
    """The k pairs of series whose correlation moved most between two periods."""
    a = series_correlations(before, series, x, names).select("a", "b", F.col("corr").alias("corr_before"))
    b = series_correlations(after, series, x, names).select("a", "b", F.col("corr").alias("corr_after"))
    j = a.join(b, ["a", "b"]).withColumn("change", F.abs(F.col("corr_after") - F.col("corr_before"))).where(F.col("change").isNotNull())
    return j.orderBy(F.desc(F.round("change", 9)), "a", "b").limit(k)
