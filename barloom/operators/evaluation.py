"""Benchmark analytics, threshold research, forecast and calibration metrics."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import array_quantile, clip, col, flag, ratio
from barloom.functions.orderstats import quantiles, ranked_values
from barloom.functions.windows import SYM, Roll

ANNUAL = math.sqrt(252)


# ---- benchmark analytics --------------------------------------------------------------------------------------------
def daily_risk_free(annual, days: int = 252) -> Column:
    a = col(annual)
    return F.when(a <= -1, 0.0).otherwise(F.pow(1 + a, 1.0 / days) - 1)


def rolling_sortino(x: str, n: int, r: Roll = SYM) -> Column:
    """Mean over the RMS of negative values, annualised; needs two negatives and max(5, n/5) rows."""
    w, v = r.frame(n), F.col(x)
    neg = F.when(v < 0, v * v)
    rms = F.sqrt(F.avg(neg).over(w))
    ok = (F.count(v).over(w) >= max(5, n // 5)) & (F.count(neg).over(w) >= 2) & (rms > 0)
    return F.when(ok, F.avg(v).over(w) / (rms + 1e-12) * ANNUAL)


def rolling_cvar(df: DataFrame, x: str, out: str, n: int, alpha: float = 0.05, r: Roll = SYM) -> DataFrame:
    """Mean of the frame's values at or below its alpha quantile (at least max(10, n/5) values).

    The frame is collected once (n values) and sorted; its tail is a slice of that array.
    """
    w = r.frame(n)
    df = df.withColumns({"__v": F.sort_array(F.collect_list(F.col(x)).over(w)), "__ok": F.count(x).over(w) >= max(10, n // 5)})
    df = df.withColumn("__q", array_quantile("__v", alpha))
    df = df.withColumn("__t", F.filter("__v", lambda e: e <= F.col("__q")))
    value = F.when(F.col("__ok"), F.aggregate("__t", F.lit(0.0), lambda a, e: a + e) / F.size("__t"))
    return df.withColumn(out, value).drop("__v", "__ok", "__q", "__t")


def rolling_capture(p: str, b: str, n: int, up: bool, r: Roll = SYM) -> Column:
    """Compounded portfolio return over compounded benchmark return on up (down) days of a full window."""
    w = r.frame(n)
    on = F.col(b) > 0 if up else F.col(b) < 0
    pc = F.product(F.when(on, 1 + F.col(p))).over(w) - 1
    bc = F.product(F.when(on, 1 + F.col(b))).over(w) - 1
    ok = (F.count(b).over(w) >= n) & (F.count(F.when(on, 1)).over(w) >= max(10, n // 5)) & (F.abs(bc) >= 1e-12)
    return F.when(ok, pc / bc)


def align_returns(portfolio: DataFrame, bench: DataFrame, keys=("symbol",)) -> DataFrame:
    """Inner alignment on common dates, missing values dropped."""
    return portfolio.join(bench, "date").dropna(subset=["rp", "rb"])


def benchmark_timeseries(df: DataFrame, windows=(20, 63), risk_free: float = 0.0, target_vol: float | None = None, r: Roll = SYM) -> DataFrame:
    """Rolling beta, alpha, information ratio, tracking error, Sharpe, Sortino, capture, CVaR, volatility, drawdown."""
    rf = (1 + risk_free) ** (1 / 252) - 1 if risk_free > -1 else 0.0
    df = df.withColumns({"active": F.col("rp") - F.col("rb"), "excess_p": F.col("rp") - rf, "excess_b": F.col("rb") - rf})
    df = df.withColumns({f"beta_{n}": r.beta("rp", "rb", n, max(5, n // 5)) for n in windows})
    df = df.withColumns({f"alpha_{n}": F.col("rp") - F.col(f"beta_{n}") * F.col("rb") for n in windows})
    out = {}
    for n in windows:
        mp, a = max(5, n // 5), f"alpha_{n}"
        out[f"alpha_roll_{n}"] = r.mean(a, n, mp)
        out[f"alpha_cum_{n}"] = r.prod(1 + F.coalesce(F.col(a), F.lit(0.0))) - 1
        out[f"ir_{n}"] = r.mean(a, n, mp) / (r.std(a, n, mp) + 1e-12) * ANNUAL
        out[f"te_{n}"] = r.std("active", n, mp) * ANNUAL
        out[f"sharpe_{n}"] = r.mean("excess_p", n, mp) / (r.std("excess_p", n, mp) + 1e-12) * ANNUAL
        out[f"sortino_{n}"] = rolling_sortino("excess_p", n, r)
        out[f"up_capture_{n}"] = rolling_capture("rp", "rb", n, True, r)
        out[f"down_capture_{n}"] = rolling_capture("rp", "rb", n, False, r)
        out[f"realized_vol_{n}"] = r.std("rp", n, mp) * ANNUAL
        if target_vol is not None:
            out[f"vol_target_error_{n}"] = out[f"realized_vol_{n}"] - target_vol
    df = df.withColumns({**out, "__eq": r.prod(1 + F.col("rp"))})
    for n in windows:
        df = rolling_cvar(df, "excess_p", f"cvar_{n}", n, 0.05, r)
    return df.withColumn("drawdown", ratio("__eq", r.max("__eq")) - 1).drop("__eq")


def benchmark_summary(ts: DataFrame, columns: list[str], keys=("symbol",)) -> DataFrame:
    """Last and mean value per rolling column, worst drawdown, total returns."""
    aggs = []
    for c in columns:
        aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"{c}_last"), F.avg(c).alias(f"{c}_mean")]
    return ts.groupBy(*keys).agg(
        *aggs, F.min("drawdown").alias("max_drawdown"), F.count("*").alias("n"), (F.product(1 + F.col("rp")) - 1).alias("total_return"), (F.product(1 + F.col("rb")) - 1).alias("benchmark_return")
    )


# ---- fold returns and thresholds ------------------------------------------------------------------------------------
def fold_last(tape: DataFrame, keys=("symbol",)) -> DataFrame:
    """The last row of every fold."""
    keys = list(keys)
    rest = [c for c in tape.columns if c not in (*keys, "fold_id")]
    g = tape.groupBy(*keys, "fold_id").agg(F.max_by(F.struct(*rest), "date").alias("__l"))
    return g.select(*keys, "fold_id", "__l.*")


def sequence_metrics(df: DataFrame, keys, order, ret: str = "ret", position: str | None = "position", ppy: float = 4.0) -> DataFrame:
    """Sharpe, worst drawdown, hit rate, turnover, annual return, Calmar per key of an ordered return series."""
    r = Roll(list(keys), order)
    d = df.where(F.col(ret).isNotNull()).withColumn("__eq", r.prod(1 + F.col(ret)))
    d = d.withColumn("__dd", F.col("__eq") / r.max("__eq") - 1)
    d = d.withColumn("__ch", F.abs(r.diff(position)) if position else F.lit(None).cast("double"))
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(ret).alias("__m"), F.stddev_samp(ret).alias("__s"), F.min("__dd").alias("maxdd"),
        F.avg(F.when(F.col(ret) != 0, flag(F.col(ret) > 0))).alias("__h"), F.avg("__ch").alias("__t"),
    )
    sharpe = F.when((F.col("n") >= 2) & (F.col("__s") > 1e-15), F.col("__m") / F.col("__s") * math.sqrt(ppy)).otherwise(0.0)
    g = g.withColumns({"sharpe": sharpe, "hitrate": F.coalesce("__h", F.lit(0.0)), "turnover": F.coalesce("__t", F.lit(0.0)), "ann_return": F.col("__m") * ppy})
    return g.withColumn("calmar", F.when(F.col("maxdd") != 0, F.col("ann_return") / F.abs("maxdd")).otherwise(0.0)).drop("__m", "__s", "__h", "__t")


def threshold_grid(lo=0.02, hi=0.50, step=0.02) -> list[float]:
    return [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step)) + 1)]


def apply_threshold(df: DataFrame, t) -> DataFrame:
    pos = F.when(F.col("score") >= col(t), 1.0).when(F.col("score") <= -col(t), -1.0).otherwise(0.0)
    df = df.withColumn("position", pos)
    return df.withColumn("ret", F.col("position") * F.col("y_true"))


def threshold_sweep(tape: DataFrame, grid: list[float], ppy: float = 4.0, alpha: float = 0.3, keys=("symbol",)) -> DataFrame:
    """Metrics of every threshold on the last row of each fold; the grid is a literal array exploded per row."""
    d = fold_last(tape, keys).withColumn("T", F.explode(F.array(*[F.lit(x) for x in grid])))
    d = apply_threshold(d, "T")
    m = sequence_metrics(d, [*keys, "T"], "fold_id", ppy=ppy)
    c = d.groupBy(*keys, "T").agg(
        F.avg(flag(F.col("position") != 0)).alias("coverage"), F.sum(flag(F.col("position") > 0)).alias("n_long"), F.sum(flag(F.col("position") < 0)).alias("n_short"), F.sum(flag(F.col("position") == 0)).alias("n_flat")
    )
    m = m.join(c, [*keys, "T"])
    return m.withColumn("objective", F.when(F.col("coverage") > 0, F.col("sharpe") * F.pow("coverage", alpha)).otherwise(0.0))


def best_threshold(sweep: DataFrame, min_coverage=0.10, max_dd=-0.50, keys=("symbol",)) -> DataFrame:
    """Best feasible objective, else best overall; the lowest threshold wins ties."""
    ok = (F.col("coverage") >= min_coverage) & (F.col("maxdd") >= max_dd)
    rank = F.struct(ok.cast("int").alias("f"), F.round("objective", 12).alias("o"), (-F.col("T")).alias("t"))
    return sweep.groupBy(*keys).agg(F.max_by(F.struct("T", "objective", "coverage", "sharpe", "maxdd"), rank).alias("b")).select(*keys, "b.*")


def walkforward_threshold(tape: DataFrame, grid: list[float], min_folds: int = 5, default: float = 0.10, ppy: float = 4.0, alpha: float = 0.3, keys=("symbol",)) -> DataFrame:
    """Threshold per fold chosen on earlier folds only, then applied to the fold's last row.

    Expanding windows over folds replace the loop: objective statistics of folds < k are running aggregates per T.
    """
    keys = list(keys)
    last = fold_last(tape, keys)
    d = apply_threshold(last.withColumn("T", F.explode(F.array(*[F.lit(x) for x in grid]))), "T")
    r = Roll([*keys, "T"], "fold_id")
    m, s = r.mean("ret", shift=1), r.std("ret", mp=2, shift=1)
    cov = r.mean(flag(F.col("position") != 0), shift=1)
    sharpe = F.when(s > 1e-15, m / s * math.sqrt(ppy)).otherwise(0.0)
    d = d.withColumn("objective", F.round(F.when(cov > 0, sharpe * F.pow(cov, alpha)).otherwise(0.0), 12))
    pick = d.groupBy(*keys, "fold_id").agg(F.max_by("T", F.struct(F.col("objective"), (-F.col("T")).alias("t"))).alias("__best"))
    order = Roll(keys, "fold_id").row()
    pick = pick.withColumn("threshold", F.when(order <= min_folds, F.lit(default)).otherwise(F.col("__best"))).drop("__best")
    return apply_threshold(last.join(pick, [*keys, "fold_id"]), "threshold")


def probability_threshold(df: DataFrame, min_precision=0.70, min_coverage=0.35, keys=("symbol",)) -> DataFrame:
    """Best of 46 probability cut-offs: widest coverage that meets the floors, else best precision.

    One partial aggregation per (key, cut-off) over an exploded literal grid.
    """
    grid = [round(0.50 + 0.01 * i, 2) for i in range(46)]
    d = df.where(F.col("y").isNotNull() & F.col("p").isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in grid])))
    up = F.col("p") >= F.col("threshold")
    on = up | (F.col("p") <= 1 - F.col("threshold"))
    hit = up == (F.col("y") > 0.5)
    g = d.groupBy(*keys, "threshold").agg(F.count("*").alias("sample_count"), F.sum(on.cast("int")).alias("trade_count"), F.avg(F.when(on, hit.cast("double"))).alias("__p"))
    g = g.withColumns({"coverage": F.col("trade_count") / F.col("sample_count"), "precision": F.coalesce("__p", F.lit(0.0))}).drop("__p")
    meets = (F.col("precision") >= min_precision) & (F.col("coverage") >= min_coverage)
    g = g.withColumns({"meets_constraints": flag(meets), "coverage_shortfall": F.greatest(F.lit(0.0), min_coverage - F.col("coverage"))})
    first = F.struct(
        F.col("meets_constraints").alias("a"), F.when(meets, F.col("coverage")).otherwise(F.col("precision")).alias("b"),
        F.when(meets, -F.col("threshold")).otherwise(F.col("coverage")).alias("c"), (-F.col("threshold")).alias("d"),
    )
    keep = ["threshold", "precision", "coverage", "trade_count", "sample_count", "meets_constraints", "coverage_shortfall"]
    return g.groupBy(*keys).agg(F.max_by(F.struct(*keep), first).alias("b")).select(*keys, "b.*")


def position_from_probability(p="p", buy=0.52, sell=0.48) -> Column:
    """1 at or above buy, -1 at or below sell, else 0."""
    b, s = col(buy), col(sell)
    return F.when(col(p) <= s, -1).when(col(p) >= b, 1).otherwise(0)


def threshold_overrides(df: DataFrame, overrides: DataFrame, default=(0.52, 0.48)) -> DataFrame:
    """Per (symbol, horizon) buy/sell cut-offs with defaults; the override table is configuration-sized."""
    d = df.join(overrides, ["symbol", "horizon"], "left")
    d = d.withColumns({"buy": F.coalesce("buy", F.lit(default[0])), "sell": F.coalesce("sell", F.lit(default[1]))})
    return d.withColumn("position", position_from_probability("p", F.col("buy"), F.col("sell")))


def horizon_sharpe(df: DataFrame, h: int, ret="ret", cap=5.0, r: Roll = SYM) -> DataFrame:
    """Sharpe of every h-th row, capped."""
    d = df.withColumn("__i", r.row() - 1).where(F.pmod(F.col("__i"), F.lit(h)) == 0)
    g = d.groupBy(*r.keys).agg(F.count(ret).alias("n"), F.avg(ret).alias("__m"), F.stddev_samp(ret).alias("__s"))
    s = F.when((F.col("n") >= 2) & (F.col("__s") > 0), clip(F.col("__m") / (F.col("__s") + 1e-9) * math.sqrt(max(1, 252 // h)), -cap, cap)).otherwise(0.0)
    return g.withColumn("sharpe", s).drop("__m", "__s")


def strategy_metrics(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """Bundle per key: Sharpe, Sortino, hit rate, turnover, return-weighted accuracy, ECE, Brier, stability, drawdown, drift split.

    Input: net_return, weight, actual_return, p, y, drift_flag.
    """
    keys = r.keys
    d = df.withColumn("__eq", r.prod(1 + F.col("net_return")))
    d = d.withColumns({"__dd": F.col("__eq") / r.max("__eq") - 1, "__tw": F.coalesce(F.abs(r.diff("weight")), F.abs("weight")), "__sw": F.signum("weight")})
    d = d.withColumn("__flip", flag(F.col("__sw") != r.lag("__sw")))
    ar, nr = F.col("actual_return"), F.col("net_return")
    g = d.groupBy(*keys).agg(
        F.avg(nr).alias("__m"), F.stddev_samp(nr).alias("__s"), F.sqrt(F.avg(F.when(nr < 0, nr * nr))).alias("__dn"), F.avg(flag(nr > 0)).alias("hit_rate"),
        F.avg("__tw").alias("turnover"), F.sum(F.when(F.signum(ar) == F.col("__sw"), F.abs(ar)).otherwise(0.0)).alias("__ok"), F.sum(F.abs(ar)).alias("__all"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), (1 - F.avg("__flip")).alias("stability"), F.min("__dd").alias("max_drawdown"),
        F.avg(F.when(F.col("drift_flag") == 1, nr)).alias("drift_on"), F.avg(F.when(F.col("drift_flag") == 0, nr)).alias("drift_off"), F.avg(flag(ar.isNotNull())).alias("coverage"), F.count(nr).alias("sample_size"),
    )
    g = g.join(expected_calibration_error(df, list(keys)).select(*keys, "ece"), list(keys), "left")
    g = g.withColumns(
        {
            "sharpe": F.when(F.col("__s") > 0, F.col("__m") / F.col("__s") * ANNUAL).otherwise(0.0),
            "sortino": F.coalesce(F.when(F.col("__dn") > 0, F.col("__m") / F.col("__dn") * ANNUAL), F.lit(0.0)),
            "rwa": F.coalesce(F.when(F.col("__all") > 0, F.col("__ok") / F.col("__all")), F.lit(0.0)),
        }
    )
    comp = 0.6 * F.col("sharpe") + 0.15 * F.col("rwa") + 0.15 * (1 - F.col("ece")) + 0.1 * F.col("stability")
    return g.withColumn("composite", comp).drop("__m", "__s", "__dn", "__ok", "__all")


# ---- forecast metrics -----------------------------------------------------------------------------------------------
def forecast_metrics(df: DataFrame, keys, y="y_true", f="score", order="date") -> DataFrame:
    """MAE, RMSE, MAPE, direction accuracy, hit rate, precision/recall/F1, Sharpe, Sortino, drawdown, Calmar, error size."""
    keys = list(keys)
    a, p = F.col(y), F.col(f)
    spread = df.groupBy(*keys).agg((F.stddev_pop(y) * 0.5).alias("__tol"))
    r = Roll(keys, order)
    d = df.join(spread, keys).withColumn("__sr", a * F.signum(p))
    d = d.withColumn("__eq", r.prod(1 + F.col("__sr")))
    d = d.withColumn("__dd", F.col("__eq") / r.max("__eq") - 1)
    err = F.abs(a - p)
    tp, fp, fn = F.sum(flag((p > 0) & (a > 0))), F.sum(flag((p > 0) & ~(a > 0))), F.sum(flag(~(p > 0) & (a > 0)))
    s = F.col("__sr")
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs((a - p) / F.when(F.abs(a) > 1e-8, a).otherwise(1e-8))) * 100).alias("mape"),
        F.avg(flag(F.signum(a) == F.signum(p))).alias("direction_accuracy"), F.avg(flag(err <= F.col("__tol"))).alias("hit_rate"),
        tp.alias("__tp"), fp.alias("__fp"), fn.alias("__fn"), F.max(err).alias("max_error"), F.stddev_pop(a - p).alias("error_volatility"),
        F.avg(s).alias("__m"), F.stddev_pop(s).alias("__s"), F.sqrt(F.avg(F.when(s < 0, s * s))).alias("__dn"), F.min("__dd").alias("max_drawdown"),
    )
    pr, rc = F.col("__tp") / (F.col("__tp") + F.col("__fp") + 1e-8), F.col("__tp") / (F.col("__tp") + F.col("__fn") + 1e-8)
    g = g.withColumns({"precision": pr, "recall": rc, "f1_score": 2 * pr * rc / (pr + rc + 1e-8)})
    return g.withColumns(
        {
            "sharpe_ratio": F.when(F.col("__s") > 1e-12, F.col("__m") / F.col("__s") * ANNUAL).otherwise(0.0),
            "sortino_ratio": F.coalesce(F.when(F.col("__dn") > 1e-12, F.col("__m") / F.col("__dn") * ANNUAL), F.lit(0.0)),
            "calmar_ratio": F.when(F.col("max_drawdown") < 0, F.col("__m") * 252 / F.abs("max_drawdown")).otherwise(0.0),
        }
    ).drop("__tp", "__fp", "__fn", "__m", "__s", "__dn")


def unpivot_quantiles(df: DataFrame, levels: dict[str, float], keep: list[str]) -> DataFrame:
    """One row per (row, quantile level): columns level, q."""
    pairs = F.array(*[F.struct(F.lit(p).alias("level"), F.col(c).cast("double").alias("q")) for c, p in levels.items()])
    return df.select(*keep, F.explode(pairs).alias("__x")).select(*keep, "__x.*")


def pinball(df: DataFrame, levels: dict[str, float], y="y_true", keys=("symbol",)) -> DataFrame:
    d = unpivot_quantiles(df, levels, [*keys, y])
    e = F.col(y) - F.col("q")
    return d.groupBy(*keys, "level").agg(F.avg(F.greatest(F.col("level") * e, (F.col("level") - 1) * e)).alias("pinball"), F.avg(flag(F.col(y) <= F.col("q"))).alias("below_share"))


def crps_quantile(df: DataFrame, levels: dict[str, float], y="y_true", keys=("symbol",)) -> DataFrame:
    """Trapezoid over the mean pinball losses along the levels."""
    r = Roll(list(keys), "level")
    p = pinball(df, levels, y, keys)
    p = p.withColumn("__a", (F.col("pinball") + r.lag("pinball")) / 2 * (F.col("level") - r.lag("level")))
    return p.groupBy(*keys).agg(F.sum("__a").alias("crps"))


def sample_scores(df: DataFrame, samples: str, y: str, keys=("symbol",)) -> DataFrame:
    """Mean |sample - y| and the proper CRPS with the spread term, from an array of samples per row."""
    n = F.size(samples)
    mad = F.aggregate(F.transform(samples, lambda v: F.abs(v - F.col(y))), F.lit(0.0), lambda a, v: a + v) / n
    # E|X - X'| of sorted samples: sum (2i - n + 1) x_i * 2 / n^2
    spread = F.aggregate(F.transform(F.sort_array(samples), lambda v, i: (2 * i - n + 1) * v), F.lit(0.0), lambda a, v: a + v) * 2 / (n * n)
    return df.groupBy(*keys).agg(F.avg(mad).alias("mean_abs_score"), F.avg(mad - spread / 2).alias("crps"))


def interval_coverage(df: DataFrame, intervals: dict[str, tuple[str, str]], y="y_true", keys=("symbol",)) -> DataFrame:
    aggs = [F.avg(flag(F.col(y).between(F.col(lo), F.col(hi)))).alias(f"coverage_{k}") for k, (lo, hi) in intervals.items()]
    aggs += [F.avg(F.col(hi) - F.col(lo)).alias(f"width_{k}") for k, (lo, hi) in intervals.items()]
    return df.groupBy(*keys).agg(*aggs)


# ---- calibration ----------------------------------------------------------------------------------------------------
def left_bin(p, bins=10) -> Column:
    """Left-closed bins with the last bin closed at one. The small offset keeps exact edges in the upper bin."""
    return F.least(F.floor(col(p) * bins + 1e-9), F.lit(bins - 1)).cast("int")


def right_bin(p, bins=10) -> Column:
    """Right-closed bins; zero belongs to no bin (NULL)."""
    return F.when(col(p) > 0, F.greatest(F.ceil(col(p) * bins - 1e-9), F.lit(1)).cast("int") - 1)


def bin_table(df: DataFrame, keys, bins=10, closed="left", p="p", y="y") -> DataFrame:
    """Count, mean confidence and accuracy per probability bin (the reliability diagram)."""
    b = left_bin(p, bins) if closed == "left" else right_bin(p, bins)
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", b)
    return d.where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, keys, bins=10, closed="left", p="p", y="y") -> DataFrame:
    """ECE and the largest bin gap."""
    t = bin_table(df, keys, bins, closed, p, y)
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return t.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.sum("n").alias("n"))


def brier(df: DataFrame, keys, p="p", y="y") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count("*").alias("n"))


def brier_decomposition(df: DataFrame, keys, bins=10, p="p", y="y") -> DataFrame:
    """Reliability, resolution and uncertainty with right-closed bins; shares refer to all rows."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("__b"), F.count("*").alias("__n"))
    t = bin_table(df, keys, bins, "right", p, y).join(base, keys)
    share = F.col("n") / F.col("__n")
    return t.groupBy(*keys).agg(
        F.sum(share * F.pow(F.col("confidence") - F.col("accuracy"), 2)).alias("reliability"),
        F.sum(share * F.pow(F.col("accuracy") - F.col("__b"), 2)).alias("resolution"),
        F.first(F.col("__b") * (1 - F.col("__b"))).alias("uncertainty"),
    )


def mutual_information(df: DataFrame, keys, bins=10, p="p", y="y") -> DataFrame:
    """Mutual information (bits) between the probability bin and the outcome from joint counts."""
    keys = list(keys)
    j = df.groupBy(*keys, left_bin(p, bins).alias("bin"), F.col(y).cast("int").alias("o")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*keys))  # at most 2 x bins rows per key
    pb, po = F.sum("c").over(Window.partitionBy(*keys, "bin")), F.sum("c").over(Window.partitionBy(*keys, "o"))
    j = j.withColumns({"__j": F.col("c") / total, "__e": F.col("c") * total / (pb * po)})
    return j.groupBy(*keys).agg(F.sum(F.col("__j") * F.log2("__e")).alias("mutual_information"))


def confidence_metrics(df: DataFrame, keys, p="p", y="y") -> DataFrame:
    """Entropy of predictions, confidence-accuracy correlation, over- and under-confidence shares."""
    q = clip(p, 1e-15, 1 - 1e-15)
    ok = flag((F.col(p) >= 0.5) == (F.col(y) == 1))
    d = df.withColumns({"__h": -(q * F.log2(q) + (1 - q) * F.log2(1 - q)), "__c": F.abs(F.col(p) - 0.5), "__ok": ok, "__cf": F.greatest(F.col(p), 1 - F.col(p))})
    g = d.groupBy(*keys).agg(
        F.avg("__h").alias("prediction_entropy"), F.covar_pop("__c", "__ok").alias("__cov"), F.stddev_pop("__c").alias("__sc"), F.stddev_pop("__ok").alias("__so"),
        F.avg(flag((F.col("__cf") > 0.8) & (F.col("__ok") == 0))).alias("overconfidence"), F.avg(flag((F.col("__cf") < 0.6) & (F.col("__ok") == 1))).alias("underconfidence"),
    )
    corr = F.when((F.col("__sc") > 1e-12) & (F.col("__so") > 1e-12), F.col("__cov") / (F.col("__sc") * F.col("__so"))).otherwise(0.0)
    return g.withColumn("confidence_accuracy_corr", corr).drop("__cov", "__sc", "__so")


def temporal_coverage(df: DataFrame, y, lo, hi, n=50, r: Roll = SYM) -> DataFrame:
    """Coverage and width over the trailing n rows (full windows only), stamped with the window's middle row."""
    inside = flag(F.col(y).between(F.col(lo), F.col(hi)))
    d = df.withColumns({"coverage": r.mean(inside, n), "width": r.mean(F.col(hi) - F.col(lo), n), "mid_date": r.lag("date", n - 1 - n // 2)})
    return d.where(F.col("coverage").isNotNull())


def conditional_calibration(df: DataFrame, feature: str, keys=(), n_bins=3, min_rows=10, p="p", y="y") -> DataFrame:
    """ECE and Brier inside feature quantile bins (left-closed; the maximum falls outside), more than `min_rows` rows.

    Quantile edges are one small row per key and are joined back; the bin is a comparison, not a ranking window.
    """
    keys = list(keys)
    edges = quantiles(df, keys, feature, {f"__q{i}": i / n_bins for i in range(n_bins + 1)})
    d = df.join(edges, keys) if keys else df.join(F.broadcast(edges))
    b = F.lit(None).cast("int")
    for i in range(n_bins):
        b = F.when((F.col(feature) >= F.col(f"__q{i}")) & (F.col(feature) < F.col(f"__q{i + 1}")), i).otherwise(b)
    d = d.withColumn("feature_bin", b).where(F.col("feature_bin").isNotNull())
    g = [*keys, "feature_bin"]
    size = d.groupBy(*g).agg(F.count("*").alias("n_samples"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    return size.join(expected_calibration_error(d, g, closed="right", p=p, y=y).select(*g, "ece"), g).where(F.col("n_samples") > min_rows)


def histogram_overlap(a: DataFrame, b: DataFrame, x: str, bins: int = 100) -> DataFrame:
    """Overlap of two empirical densities on common equal-width bins."""
    both = a.select(F.col(x).alias("x"), F.lit(0).alias("s")).unionByName(b.select(F.col(x).alias("x"), F.lit(1).alias("s"))).where(F.col("x").isNotNull())
    span = both.agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"), F.sum(1 - F.col("s")).alias("__n0"), F.sum("s").alias("__n1"))
    d = both.join(F.broadcast(span))  # one row
    k = F.least(F.floor((F.col("x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1))
    h = d.groupBy(k.alias("bin")).agg((F.sum(1 - F.col("s")) / F.first("__n0")).alias("__p"), (F.sum("s") / F.first("__n1")).alias("__q"))
    return h.agg(F.sum(F.least("__p", "__q")).alias("overlap"))


def bhattacharyya(df: DataFrame, keys, x1: str, x2: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2"))
    v1, v2 = F.col("v1"), F.col("v2")
    t = 0.25 * F.ln(0.25 * (v1 / v2 + v2 / v1 + 2)) + 0.25 * (F.pow(F.col("m1") - F.col("m2"), 2) / (v1 + v2))
    return g.withColumn("distance", F.when((v1 > 0) & (v2 > 0), t)).drop("v1", "v2", "m1", "m2")


def pit(df: DataFrame, cdf: str, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(cdf).alias("pit_mean"), F.stddev_pop(cdf).alias("pit_std"))


def conformal_quantile(df: DataFrame, score: str, alpha: float, keys) -> DataFrame:
    """Linear-interpolated quantile of scores at min(1, (1 - alpha)(n + 1) / n) per key."""
    keys = list(keys)
    rv = ranked_values(df, keys, score)
    pos = (F.col("total") - 1) * F.least(F.lit(1.0), (1 - alpha) * (F.col("total") + 1) / F.col("total"))
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("cnt")), F.col(score)))
    g = rv.groupBy(*keys).agg(at(F.floor(pos)).alias("__lo"), at(F.ceil(pos)).alias("__hi"), F.max(pos - F.floor(pos)).alias("__f"), F.max("total").alias("n"))
    return g.select(*keys, "n", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("q"))


def conformal_interval(df: DataFrame, q: DataFrame, f: str, keys) -> DataFrame:
    d = df.join(q, list(keys))
    return d.withColumns({"lower": F.col(f) - F.col("q"), "upper": F.col(f) + F.col("q")})


def platt(df: DataFrame, p="p", y="y", eps=1e-6) -> DataFrame:
    """Logistic regression on the logit of the probability, by reweighted least squares to the last digits."""
    q = clip(p, eps, 1 - eps)
    v = VectorAssembler(inputCols=["__lg"], outputCol="__f").transform(df.withColumns({"__lg": F.ln(q / (1 - q)), "__y": F.col(y).cast("double")}))
    m = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="__f", labelCol="__y", predictionCol="calibrated", maxIter=50, tol=1e-13).fit(v)
    return m.transform(v).drop("__f", "__y", "__lg")


def trading_metrics(df: DataFrame, cost: float = 0.001, r: Roll = SYM, position="position", ret="ret_next") -> DataFrame:
    """Net of costs per key: total and annual return, volatility, Sharpe, drawdown, win rate, profit factor, trades."""
    d = df.withColumn("__tr", F.abs(F.col(position) - F.coalesce(r.lag(position), F.lit(0.0))))
    d = d.withColumn("__n", F.col(position) * F.coalesce(F.col(ret), F.lit(0.0)) - cost * F.col("__tr"))
    d = d.withColumn("__eq", r.prod(1 + F.col("__n")))
    d = d.withColumn("__dd", F.col("__eq") / r.max("__eq") - 1)
    n = F.col("__n")
    g = d.groupBy(*r.keys).agg(
        F.max_by("__eq", "date").alias("__last"), F.avg(n).alias("__m"), F.stddev_samp(n).alias("__s"), F.min("__dd").alias("max_drawdown"), F.avg(F.when(F.col(position) != 0, flag(n > 0))).alias("win_rate"),
        F.sum(F.when(n > 0, n)).alias("__w"), F.sum(F.when(n < 0, -n)).alias("__l"), F.sum(flag(F.col("__tr") > 0)).alias("n_trades"),
    )
    return g.withColumns(
        {
            "total_return": F.col("__last") - 1, "annual_return": F.col("__m") * 252, "volatility": F.col("__s") * ANNUAL,
            "sharpe": F.when(F.col("__s") > 1e-12, F.col("__m") / F.col("__s") * ANNUAL), "profit_factor": ratio("__w", "__l"),
        }
    ).drop("__last", "__m", "__s", "__w", "__l")


def evaluation_gates(df: DataFrame, min_precision=0.55, min_coverage=0.3, min_sharpe=0.0, buy=0.6, sell=0.4, min_rows=20) -> DataFrame:
    """Per symbol and overall (symbol NULL): precision, coverage, accuracy, Sharpe and the ordered list of failures.

    Both levels come from one grouping-sets aggregation. Input: symbol, p, y, ret.
    """
    pos = position_from_probability("p", buy, sell)
    d = df.withColumns({"__pos": pos, "__sr": pos * F.col("ret")})
    on = F.col("__pos") != 0
    hit = flag(((F.col("__pos") > 0) & (F.col("y") == 1)) | ((F.col("__pos") < 0) & (F.col("y") == 0)))
    g = d.rollup("symbol").agg(
        F.count("*").alias("total"), F.sum(flag(on)).alias("confident"), F.avg(F.when(on, hit)).alias("__p"), F.avg(flag((F.col("p") >= 0.5) == (F.col("y") == 1))).alias("accuracy"),
        F.avg("__sr").alias("__m"), F.stddev_samp("__sr").alias("__s"),
    )
    g = g.withColumns({"precision": F.coalesce("__p", F.lit(0.0)), "coverage": F.col("confident") / F.col("total"), "sharpe": F.when(F.col("__s") > 1e-12, F.col("__m") / F.col("__s") * ANNUAL).otherwise(0.0)})
    fails = F.concat_ws(
        ",", F.when(F.col("total") < min_rows, "insufficient_data"), F.when(F.col("precision") < min_precision, "precision"),
        F.when(F.col("coverage") < min_coverage, "coverage"), F.when(F.col("sharpe") < min_sharpe, "sharpe"),
    )
    return g.withColumns({"failures": fails, "passed": flag(fails == "")}).drop("__p", "__m", "__s")


def var_cvar(df: DataFrame, ret: str, level: float, keys) -> DataFrame:
    """Historical VaR (loss positive) and the mean loss at or beyond it."""
    keys = list(keys)
    q = quantiles(df, keys, ret, {"__q": 1 - level})
    g = df.join(q, keys).groupBy(*keys).agg(F.first("__q").alias("__q"), F.avg(F.when(F.col(ret) <= F.col("__q"), F.col(ret))).alias("__t"))
    return g.select(*keys, (-F.col("__q")).alias("var"), (-F.coalesce("__t", "__q")).alias("cvar"))


def information_coefficient(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    from barloom.operators.crosssection import rank_correlation

    return rank_correlation(df, keys, x, y).withColumnRenamed("spearman", "ic")
