"""Portfolio cross-sections: constraints, risk scaling, signals to P&L.

Weights tables are (symbol, date, w, ...). Per-date totals come from a partial aggregation joined back on date, so a date
with very many symbols never sits in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, col, finite, flag
from barloom.functions.orderstats import quantiles
from barloom.functions.windows import SYM, Roll
from barloom.operators.pairs import products


def with_totals(df: DataFrame, keys, **sums: Column) -> DataFrame:
    """Join per-group sums back to the rows."""
    keys = list(keys)
    return df.join(df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), keys)


def normalise_weights(df: DataFrame, w="w", keys=("date",)) -> DataFrame:
    """w / sum|w| per date, equal weights when there is no mass."""
    df = with_totals(df, keys, __g=F.abs(F.coalesce(F.col(w), F.lit(0.0))), __n=F.lit(1))
    return df.withColumn(w, F.when(F.col("__g") > 0, F.coalesce(F.col(w), F.lit(0.0)) / F.col("__g")).otherwise(1 / F.col("__n"))).drop("__g", "__n")


def basic_caps(df: DataFrame, max_name=None, max_gross=None, max_net=None, w="w", keys=("date",)) -> DataFrame:
    """Name clip, then gross scaling, then net scaling. One aggregation: scaling by gross also scales the net."""
    x = F.coalesce(finite(w), F.lit(0.0))
    df = df.withColumn(w, clip(x, -max_name, max_name) if max_name else x)
    df = with_totals(df, keys, __g=F.abs(F.col(w)), __s=F.col(w))
    scale = F.when(F.col("__g") > max_gross, max_gross / F.col("__g")).otherwise(1.0) if max_gross else F.lit(1.0)
    net = F.abs(F.col("__s") * scale)
    second = F.when(net > max_net, max_net / net).otherwise(1.0) if max_net else F.lit(1.0)
    return df.withColumn(w, F.col(w) * scale * second).drop("__g", "__s")


def group_caps(df: DataFrame, group: str, max_gross=None, max_net=None, w="w", keys=("date",)) -> DataFrame:
    """Gross and net caps inside each group; rows without a group are untouched."""
    capped = basic_caps(df.where(F.col(group).isNotNull()), None, max_gross, max_net, w, [*keys, group])
    return capped.select(*df.columns).unionByName(df.where(F.col(group).isNull()))


def turnover_projection(df: DataFrame, cap: float, prev="prev_w", w="w", keys=("date",)) -> DataFrame:
    """Shrink the step from previous weights so that its L1 size is at most the cap."""
    df = with_totals(df, keys, __t=F.abs(F.col(w) - F.col(prev)))
    step = F.when(F.col("__t") > cap, cap / F.col("__t")).otherwise(1.0)
    return df.withColumn(w, F.when(F.col("__t") > cap, F.col(prev) + (F.col(w) - F.col(prev)) * step).otherwise(F.col(w))).drop("__t")


def rolling_market_beta(df: DataFrame, market: DataFrame, n: int, ret="ret", mkt="mkt", r: Roll = SYM, eps=1e-12) -> DataFrame:
    """Population beta to the equal-weight market over the last n rows (0 below five rows or a flat market)."""
    df = df.join(market, "date", "left").withColumns({"__r": F.coalesce(F.col(ret), F.lit(0.0)), "__m": F.coalesce(F.col(mkt), F.lit(0.0))})
    w = r.frame(n)
    v = F.var_pop("__m").over(w)
    ok = (F.count("*").over(w) >= 5) & (v > eps)
    return df.withColumn("beta", F.when(ok, F.covar_pop("__r", "__m").over(w) / (v + eps)).otherwise(0.0)).drop("__r", "__m")


def beta_neutralise(df: DataFrame, w="w", beta="beta", keys=("date",)) -> DataFrame:
    df = with_totals(df, keys, __bw=F.col(beta) * F.col(w), __bb=F.col(beta) * F.col(beta))
    return df.withColumn(w, F.when(F.col("__bb") > 1e-12, F.col(w) - F.col(beta) * F.col("__bw") / F.col("__bb")).otherwise(F.col(w))).drop("__bw", "__bb")


def adv_cap(df: DataFrame, share: float, capital: float, w="w", adv="adv") -> DataFrame:
    limit = clip(F.lit(float(share)) * F.coalesce(F.col(adv), F.lit(0.0)) / capital, 0, 10)
    return df.withColumn(w, F.greatest(-limit, F.least(limit, F.col(w))))


def vol_target(weights: DataFrame, returns: DataFrame, target: float, max_scale=5.0, trading_days=252) -> DataFrame:
    """Scale one date's weights to a target volatility.

    w'Cw is the population variance of the portfolio's own return series over the window, so no covariance pairs are
    formed: `returns` (symbol, date, ret) is joined once on symbol and summed by date.
    """
    path = returns.join(weights.select("symbol", "w"), "symbol").groupBy("date").agg(F.sum(F.col("w") * F.coalesce(F.col("ret"), F.lit(0.0))).alias("__p"))
    vol = path.agg((F.stddev_pop("__p") * math.sqrt(trading_days)).alias("portfolio_vol"))
    df = weights.join(F.broadcast(vol))  # one row
    scale = F.when(F.col("portfolio_vol") > 0, clip(target / F.col("portfolio_vol"), 0, max_scale)).otherwise(1.0)
    return df.withColumns({"scale": scale, "w_scaled": F.col("w") * scale})


def vol_target_covariance(weights: DataFrame, cov: DataFrame, target: float, max_scale=5.0, trading_days=252) -> DataFrame:
    """Scale one date's weights to a target volatility under a given covariance (symbol_i <= symbol_j, cov), such as an EWMA or
    a shrunk one; weights stay as they are where the variance is not a positive number."""
    w = weights.select("symbol", "w")
    i, j = w.select(F.col("symbol").alias("symbol_i"), F.col("w").alias("__wi")), w.select(F.col("symbol").alias("symbol_j"), F.col("w").alias("__wj"))
    twice = F.when(F.col("symbol_i") == F.col("symbol_j"), 1.0).otherwise(2.0)
    var = cov.join(i, "symbol_i").join(j, "symbol_j").agg(F.sum(twice * F.col("cov") * F.col("__wi") * F.col("__wj")).alias("__v"))
    df = weights.join(F.broadcast(var))  # one row
    df = df.withColumn("portfolio_vol", F.when(F.col("__v") > 0, F.sqrt("__v") * math.sqrt(trading_days)))
    scale = F.coalesce(clip(target / F.col("portfolio_vol"), 0, max_scale), F.lit(1.0)) if target > 0 else F.lit(1.0)
    return df.withColumn("scale", scale).withColumn("w_scaled", F.col("w") * F.col("scale")).drop("__v")


def ewma_covariance(returns: DataFrame, universe: DataFrame | None = None, lam: float = 0.94) -> DataFrame:
    """EWMA covariance as (symbol_i, symbol_j, cov), weights (1-λ)λ^age by date order; of the symbols in the table `universe`, or
    of all. Pairs are the result itself; their sums come from products of blocks. Infinite
    returns take no part.
    """
    if universe is not None:
        returns = returns.join(universe.select("symbol"), "symbol", "left_semi")
    d = returns.select("symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    cal = d.select("date").distinct()
    cal = cal.withColumn("__age", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))) - 1)  # one row per session
    d = d.join(cal, "date")
    d = d.withColumn("__w", F.col("ret") * F.sqrt((1 - lam) * F.pow(F.lit(lam), "__age")))
    return products(d, "symbol", "__w").select(F.col("a").alias("symbol_i"), F.col("b").alias("symbol_j"), F.col("product").alias("cov"))


def shrink_covariance(cov: DataFrame, alpha: float) -> DataFrame:
    keep = F.when(F.col("symbol_i") == F.col("symbol_j"), 1.0).otherwise(1.0 - min(max(alpha, 0.0), 1.0))
    return cov.withColumn("cov", F.coalesce(finite("cov"), F.lit(0.0)) * keep)


def transaction_cost(turnover, k_spread: float, k_impact: float) -> Column:
    t = col(turnover)
    return k_spread * t + k_impact * F.pow(t, 1.5)


def regime_threshold(regime, base: float, bull=0.8, bear=1.5, crisis=3.0) -> Column:
    g = col(regime)
    return F.lit(float(base)) * F.when(g == 2, crisis).when(g == 1, bear).otherwise(bull)


def regime_positions(df: DataFrame, score: str, regime: str, threshold: float, long_mult=(0.8, 1.5, 3.0), short_mult=None, conf=None, conf_floor=None, vol_ratio=None, vol_power=None) -> DataFrame:
    """Long/short/flat by regime-scaled thresholds, with confidence gate and volatility normalisation."""
    s = F.col(score)
    if vol_power is not None and vol_ratio is not None:
        s = s / F.pow(F.greatest(F.coalesce(F.col(vol_ratio), F.lit(1.0)), F.lit(1e-6)), vol_power)
    g = F.coalesce(F.col(regime), F.lit(0))
    up = regime_threshold(g, threshold, *long_mult)
    dn = regime_threshold(g, threshold, *(short_mult or long_mult))
    pos = F.when(s > up, 1.0).when(s < -dn, -1.0).otherwise(0.0)
    if conf is not None and conf_floor is not None:
        pos = F.when(clip(conf, 0, 1) < conf_floor, 0.0).otherwise(pos)
    return df.withColumns({"threshold_long": up, "threshold_short": dn, "position": pos})


def signal_zscore(mu, sigma, k=1.0) -> Column:
    return F.tanh(k * col(mu) / col(sigma))


def signal_probability(p_up, k=1.0) -> Column:
    return F.tanh(k * (2 * col(p_up) - 1))


def signal_hybrid(mu, sigma, p_up, rho, k=1.0) -> Column:
    """Mean of z-score and probability signals scaled by confidence."""
    return 0.5 * (signal_zscore(mu, sigma, k) + signal_probability(p_up, k)) * col(rho)


# name -> Column builder over (mu, sigma, p_up, rho)
SIGNAL_RULES = {
    "zscore": lambda k: signal_zscore("mu", "sigma", k),
    "probability": lambda k: signal_probability("p_up", k),
    "hybrid": lambda k: signal_hybrid("mu", "sigma", "p_up", "rho", k),
}


def signals(df: DataFrame, rule: str, k: float = 1.0, r: Roll = SYM) -> DataFrame:
    """Apply a registered rule. A zero or missing sigma is replaced by the symbol's median sigma."""
    med = quantiles(df.withColumn("__as", F.abs("sigma")), r.keys, "__as", {"__med": 0.5})
    s = F.abs(F.col("sigma"))
    df = df.join(med, r.keys, "left").withColumn("sigma", F.when(s > 0, s).otherwise(F.coalesce(F.when(F.col("__med") > 0, F.col("__med")), F.lit(0.02)))).drop("__med")
    return df.withColumn("signal", SIGNAL_RULES[rule](k))


def signal_pnl(df: DataFrame, signal="signal", ret="ret", holding=5, leverage=1.0, max_exposure=1.0, fee=0.0, slippage=0.0, r: Roll = SYM) -> DataFrame:
    """Weights, overlap-averaged exposure, turnover, costs, net return, equity and cumulative P&L per symbol."""
    df = df.withColumn("target_weight", F.coalesce(clip(F.col(signal) * leverage, -max_exposure, max_exposure), F.lit(0.0)))
    t = F.coalesce(F.abs(r.diff("target_weight")), F.abs("target_weight"))
    df = df.withColumns({"turnover": t, "avg_weight": F.avg("target_weight").over(r.frame(holding)), "daily_return": F.coalesce(F.col(ret), F.lit(0.0))})
    cost = fee * flag(F.col("turnover") > 0) + slippage * F.col("turnover")
    df = df.withColumns({"gross_return": F.col("avg_weight") * F.col("daily_return"), "costs": cost})
    df = df.withColumn("net_return", F.col("gross_return") - F.col("costs"))
    df = df.withColumns({"equity_curve": r.prod(1 + F.col("net_return")), "cum_pnl": r.sum("net_return")})
    return df.withColumn("drawdown", F.col("equity_curve") / r.max("equity_curve") - 1)


def interpolate(df: DataFrame, x: str, out: str, r: Roll) -> DataFrame:
    """Linear interpolation over row positions; 0 before the first value, the last value after it."""
    df = df.withColumn("__i", r.row())
    known = F.when(F.col(x).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(x).alias("v")))
    df = df.withColumns({"__p": F.last(known, ignorenulls=True).over(r.frame(None)), "__n": F.first(known, ignorenulls=True).over(r.ahead(None))})
    pi, pv, ni, nv = F.col("__p.i"), F.col("__p.v"), F.col("__n.i"), F.col("__n.v")
    mid = pv + (nv - pv) * (F.col("__i") - pi) / (ni - pi)
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.col(x)).when(pv.isNull(), 0.0).when(nv.isNull(), pv).otherwise(mid)).drop("__i", "__p", "__n")


def meta_score(signals_long: DataFrame, weights: DataFrame, keys=("symbol",)) -> DataFrame:
    """Sum of score * conf * weight over modules per date; gaps are interpolated per module.

    `signals_long` (symbol, date, module, score, conf) on a common calendar; `weights` (module, weight) is a small table.
    """
    r = Roll([*keys, "module"], "date")
    d = interpolate(signals_long, "score", "__s", r)
    d = interpolate(d, "conf", "__c", r).join(weights, "module")
    return d.groupBy(*keys, "date").agg(F.sum(F.col("__s") * F.col("__c") * F.col("weight")).alias("meta_score"))


def weighted_tracks(panel: DataFrame, tracks: dict[str, tuple[list[str], float]]) -> DataFrame:
    """Concatenate weighted blocks: every column of a track times its weight, missing or infinite as 0."""
    out = {f"{name}_{c}": F.coalesce(finite(c), F.lit(0.0)) * float(w) for name, (cols, w) in tracks.items() for c in cols}
    return panel.select("symbol", "date", *[v.alias(k) for k, v in out.items()])


def shrink_clip_renorm(df: DataFrame, raw="raw", shrink=0.1, lo=0.0, hi=1.0, keys=()) -> DataFrame:
    """Family weights: positive part, normalise, shrink to uniform, clip, normalise again."""
    v = F.greatest(F.coalesce(finite(raw), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("__v", v)
    w = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per family
    n, s = F.count("*").over(w), F.sum("__v").over(w)
    df = df.withColumn("__v", F.when(s > 0, F.col("__v") / s).otherwise(1 / n))
    df = df.withColumn("__v", clip((1 - shrink) * F.col("__v") + shrink / n, lo, hi))
    total = F.sum("__v").over(w)
    return df.withColumn("weight", F.when(total > 0, F.col("__v") / total).otherwise(1 / n)).drop("__v")


def policy_state(df: DataFrame, r: Roll = SYM, n=20, sharpe_n=63) -> DataFrame:
    """State features known the row before: volatility, drawdown, Sharpe, turnover, costs, hit rate, regime.

    Input: net_return, turnover, costs, score, fwd_return, regime.
    """
    eq = r.prod(1 + F.col("net_return"))
    df = df.withColumn("__eq", eq).withColumn("__hit", F.when(F.col("score").isNotNull() & F.col("fwd_return").isNotNull(), flag(F.signum("score") == F.signum("fwd_return"))))
    peak = r.max("__eq", n, 1)
    df = df.withColumn("__dd", 1 - F.col("__eq") / peak)
    m, s = r.mean("net_return", sharpe_n, 5, shift=1), r.std("net_return", sharpe_n, 5, shift=1)
    nz = lambda x: F.coalesce(x, F.lit(0.0))
    return df.withColumns(
        {
            "state_vol": clip(nz(r.std0("net_return", n, 2, shift=1) * math.sqrt(252)), 0, 1),
            "state_drawdown": clip(nz(r.lag("__dd")), 0, 1),
            "state_sharpe": clip(nz(F.when(s > 1e-12, m / s * math.sqrt(252))) / 3, -1, 1),
            "state_turnover": clip(nz(r.mean("turnover", n, 1, shift=1)), 0, 1),
            "state_cost": clip(nz(r.mean("costs", n, 1, shift=1)), 0, 1),
            "state_accuracy": clip(nz(r.mean("__hit", sharpe_n, 1, shift=1)), 0, 1),
            "state_regime": clip(nz(r.lag("regime")) / 2, 0, 1),
        }
    ).drop("__eq", "__hit", "__dd")


def policy_report(df: DataFrame, max_drawdown: float, min_ir: float, beta_max: float, keys=("symbol",)) -> DataFrame:
    """Breach report per key from a benchmark table with active, drawdown, beta and ir columns."""
    g = df.groupBy(*keys).agg(
        F.min("drawdown").alias("max_drawdown"), F.max_by("beta", F.when(F.col("beta").isNotNull(), F.col("date"))).alias("beta_last"),
        F.max_by("ir", F.when(F.col("ir").isNotNull(), F.col("date"))).alias("ir_last"), F.avg("active").alias("__m"), F.stddev_samp("active").alias("__s"), F.count("active").alias("__n"),
    )
    enough = F.col("__n") > 5
    g = g.withColumns({"tracking_error": F.when(enough, F.col("__s") * math.sqrt(252)), "ir_full": F.when(enough, F.col("__m") / (F.col("__s") + 1e-12) * math.sqrt(252))})
    ok = {
        "ok_drawdown": F.coalesce(F.col("max_drawdown") >= -abs(max_drawdown), F.lit(False)),
        "ok_beta": F.coalesce(F.abs("beta_last") <= abs(beta_max), F.lit(False)),
        "ok_ir_full": F.coalesce(F.col("ir_full") >= min_ir, F.lit(False)),
        "ok_ir_last": F.coalesce(F.col("ir_last") >= min_ir, F.lit(False)),
    }
    g = g.withColumns({k: flag(v) for k, v in ok.items()})
    return g.withColumn("ok", F.least(*ok)).drop("__m", "__s", "__n")


def kelly(p, win_loss, fraction=0.5, lo=0.0, hi=0.25) -> Column:
    return clip((col(p) - (1 - col(p)) / col(win_loss)) * fraction, lo, hi)


def pooled_backtest(df: DataFrame, scheme: str = "equal", ret="net_return") -> DataFrame:
    """Portfolio return per date over symbols: equal weights, or inverse volatility of each symbol's series."""
    d = df.where(F.col(ret).isNotNull())
    if scheme == "inverse_vol":
        v = d.groupBy("symbol").agg(F.stddev_samp(ret).alias("__v")).withColumn("__w", F.when(F.col("__v") > 1e-12, 1 / F.col("__v")))
        d = d.join(v, "symbol").where(F.col("__w").isNotNull())
    else:
        d = d.withColumn("__w", F.lit(1.0))
    return d.groupBy("date").agg((F.sum(F.col("__w") * F.col(ret)) / F.sum("__w")).alias("portfolio_return"), F.count("*").alias("n_symbols"))


