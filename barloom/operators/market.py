"""Cross-asset, volatility-ladder, price-anchor, regime and event-window families on daily bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, col, flag, ratio, sigmoid
from barloom.functions.ordered import Level, Rank
from barloom.functions.windows import SYM, Roll

ANNUAL = math.sqrt(252)


def soft_z(r: Roll, x, n, mp, eps=1e-9, centre=None) -> Column:
    """(x - mean) / (std + eps) with a minimum count."""
    return (col(x) - (r.mean(x, n, mp) if centre is None else centre)) / (r.std(x, n, mp) + eps)


def correlation_family(df: DataFrame, benchmarks: DataFrame, r: Roll = SYM) -> DataFrame:
    """Correlations of `ret` with benchmark returns (date, spy, qqq, vxx, sector) and their dynamics."""
    df = df.join(benchmarks, "date", "left")
    df = df.withColumns(
        {
            "__range": ratio(F.col("high") - F.col("low"), "close"),
            "__abs": F.abs("ret"),
            "__v10": r.std("ret", 10, 5),
            "__v20": r.std("ret", 20, 10),
            **{f"__{b}{k}": r.lag(b, k) for b, k in (("spy", 1), ("spy", 5), ("vxx", 1), ("vxx", 2), ("ret", 1), ("ret", 5))},
        }
    )
    df = df.withColumns({"__abs1": r.lag("__abs"), "__v101": r.lag("__v10")})
    cap = lambda x: clip(x, -0.95, 0.95)
    df = df.withColumns(
        {
            "corr_20_spy": r.corr("ret", "spy", 20, 6),
            "corr_60_spy": r.corr("ret", "spy", 60, 20),
            "corr_20_qqq": r.corr("ret", "qqq", 20, 6),
            "corr_20_vxx": r.corr("ret", "vxx", 20, 6),
            "corr_20_sector": r.corr("ret", "sector", 20, 6),
            **{f"lag_corr_{k}_{b}": cap(r.corr("ret", f"__{b}{k}", 20, 10)) for b, k in (("spy", 1), ("spy", 5), ("vxx", 1), ("vxx", 2))},
            **{f"corr_{n}_vix_lag{k}": cap(r.corr("ret", f"__vxx{k}", n, max(5, n // 3))) for k in (1, 2) for n in (20, 60)},
            "corr_return_vol_20": r.corr("ret", "volume", 20, 10),
            "corr_return_range_10": r.corr("ret", "__range", 10, 5),
            "corr_vol_volatility_20": r.corr("volume", "__v20", 20, 10),
            **{f"acf_ret_{k}": cap(r.corr("ret", f"__ret{k}", 20, 10)) for k in (1, 5)},
            "acf_absret_1": cap(r.corr("__abs", "__abs1", 20, 10)),
            "acf_vol_1": cap(r.corr("__v10", "__v101", 20, 10)),
        }
    )
    df = r.numbered(df)
    return df.withColumns(
        {
            "corr_decoupling_z": soft_z(r, "corr_20_spy", 252, 60),
            "corr_spread_20_60_spy": F.col("corr_20_spy") - F.col("corr_60_spy"),
            # five points against 0..4: the sum of cross products over the variance is five times the slope
            **{f"corr_20_{b}_trend": 5 * r.slope(f"corr_20_{b}", 5) for b in ("spy", "qqq", "vxx")},
            **{f"corr_20_{b}_vol": r.std(f"corr_20_{b}", 20, 10) for b in ("spy", "vxx")},
        }
    ).drop(*[c for c in df.columns if c.startswith("__")])


def cross_asset_family(df: DataFrame, assets: DataFrame, r: Roll = SYM) -> DataFrame:
    """Links of a symbol to index, rates, credit and dollar levels.

    `assets` carries (date, spy_ret, qqq_ret, vix, tnx, irx, hyg, lqd, uup).
    """
    df = df.join(assets, "date", "left")
    levels = ("vix", "tnx", "irx", "hyg", "uup")
    df = df.withColumns(
        {
            **{f"__{x}": r.pct(x) for x in levels},
            "__rv": r.std("ret", 20) * ANNUAL,
            "__srv": r.std("spy_ret", 20) * ANNUAL,
            "__spy1": r.lag("spy_ret"),
            "__ret1": r.lag("ret"),
            "__credit": F.col("hyg") / (F.col("lqd") + 1e-9),
            "beta_20d": r.cov("ret", "spy_ret", 20) / (r.var("spy_ret", 20) + 1e-9),
        }
    )
    base = r.mean("__credit", 252, 126)
    df = df.withColumns(
        {
            "spy_corr_20d": r.corr("ret", "spy_ret", 20),
            "qqq_corr_20d": r.corr("ret", "qqq_ret", 20),
            "vix_corr_20d": r.corr("ret", "__vix", 20),
            "tnx_corr_20d": r.corr("ret", "__tnx", 20),
            "irx_corr_20d": r.corr("ret", "__irx", 20),
            "asset_corr_hyg_60": r.corr("ret", "__hyg", 60, 30),
            "asset_corr_uup_60": r.corr("ret", "__uup", 60, 30),
            "vix_spread_indicator": F.col("vix") / (F.col("__rv") + 1e-9),
            "realized_vol_vs_spy_corr": r.corr("__rv", "__srv", 20, 10),
            "spy_leads_stock_5d": r.corr("ret", "__spy1", 20),
            "stock_leads_spy_5d": r.corr("spy_ret", "__ret1", 20),
            "credit_spread_level": (F.col("__credit") - base) / (base + 1e-9),
            "__bchg": r.pct("beta_20d", 5),
            "beta_volatility_20d": r.std("beta_20d", 20, 10),
            "beta_sign_flip_flag": flag(F.signum("beta_20d") != r.lag(F.signum("beta_20d"))),
        }
    )
    nz = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumn(
        "risk_onoff_factor", nz("spy_corr_20d") * 0.5 + nz("qqq_corr_20d") * 0.3 - nz("asset_corr_uup_60") * 0.2 - nz("vix_corr_20d") * 0.2
    )
    out = {
        "beta_change_rate": clip(F.abs(soft_z(r, "__bchg", 252, 60)), 0, 3),
        "beta_volatility_change": clip(F.abs(r.pct("beta_volatility_20d", 5)), 0, 5),
        "tnx_corr_change_5d": clip(F.abs(r.diff("tnx_corr_20d", 5)), 0, 1),
        "irx_corr_change_5d": clip(F.abs(r.diff("irx_corr_20d", 5)), 0, 1),
        "cross_asset_coupling_change": clip(F.abs(r.diff("risk_onoff_factor", 5)), 0, 1),
        "risk_offness": clip((0.5 - F.col("risk_onoff_factor")) / 0.5, 0, 1),
    }
    return df.withColumns(out).drop(*[c for c in df.columns if c.startswith("__")])


def vix_term_structure(df: DataFrame, r: Roll, n: int = 252, mp: int = 60) -> DataFrame:
    """Term-structure features of tenors vix9d, vix, vix3m, vix6m (one row per date), plus realised vol `rv` if present."""
    a, b, c, d = (F.col(x) for x in ("vix9d", "vix", "vix3m", "vix6m"))
    raw = {"__s1": a - b, "__s2": b - c, "__s3": b - d, "__cv": (d - b) - (b - a), "__fb": a - c, "__pp": a / (b + 1e-9)}
    if "rv" in df.columns:
        raw |= {"__vrp": b - F.col("rv"), "__vrpp": (b - F.col("rv")) / (F.col("rv") + 1e-9)}
    df = df.withColumns(raw)
    z = lambda x: soft_z(r, x, n, mp)
    out = {
        "vxst_vix_term_slope": clip(z("__s1"), -3, 3),
        "vix_vxv_term_slope": clip(z("__s2"), -3, 3),
        "vix_vxmt_term_slope": clip(z("__s3"), -3, 3),
        "normalized_term_slope": (d - b) / (d + b + 1e-9),
        "vix_term_curvature": z("__cv"),
        "front_back_spread": z("__fb"),
        "panic_premium": z("__pp"),
        "vix_roll_yield": (c - b) / (b + 1e-9),
        "vix_ratio_term": c / (b + 1e-9),
        "vix_contango_strength": (c - b) / (b + 1e-9),
    }
    if "rv" in df.columns:
        out |= {"vol_risk_premium": clip(z("__vrp"), -3, 3), "vol_risk_premium_pct": clip(z("__vrpp"), -3, 3)}
    df = df.withColumns(out)
    return df.withColumns(
        {
            "vix_term_slope_change_1d": r.diff("vix_vxv_term_slope"),
            "vix_term_slope_change_5d": r.diff("vix_vxv_term_slope", 5),
            "vix_curvature_change": r.diff("vix_term_curvature"),
            "panic_premium_change": r.diff("panic_premium"),
        }
    ).drop(*raw)


def asset_block(df: DataFrame, days_per_year: int = 252, r: Roll = SYM) -> DataFrame:
    """Return sums, annualised volatility, gain/loss strength and range position of commodity, FX or crypto series."""
    scale = math.sqrt(days_per_year)
    df = df.withColumn("__r", r.pct("close"))
    up, dn = F.when(F.col("__r").isNotNull(), F.greatest(F.col("__r"), F.lit(0.0))), F.when(F.col("__r").isNotNull(), -F.least(F.col("__r"), F.lit(0.0)))
    lo, hi = r.min("close", 60), r.max("close", 60)
    return df.withColumns(
        {
            **{f"return_{n}d": r.sum("__r", n) for n in (5, 20, 60)},
            **{f"vol_{n}d": r.std("__r", n) * scale for n in (20, 60)},
            "strength_14d": r.mean(up, 14) / (r.mean(dn, 14) + 1e-8),
            "pct_range_60d": (F.col("close") - lo) / (hi - lo + 1e-8),
        }
    ).drop("__r")


def equal_weight_basket(df: DataFrame, basket: str, n: int = 20) -> DataFrame:
    """Mean price of the member series per date, then n-row return sum and volatility of the basket."""
    b = df.groupBy(F.lit(basket).alias("symbol"), "date").agg(F.avg("close").alias("level"))
    b = b.withColumn("__r", SYM.pct("level"))
    return b.withColumns({"return_20d": SYM.sum("__r", n), "vol_20d": SYM.std("__r", n) * ANNUAL}).drop("__r")


def dollar_index(df: DataFrame, base_first, r: Roll = SYM) -> DataFrame:
    """Signed mean of pair returns per date (+ where the dollar is the base currency), 5/20-row sums."""
    legs = df.withColumn("__r", r.pct("close"))
    d = legs.groupBy("date").agg(F.sum(F.when(base_first, F.col("__r")).otherwise(-F.col("__r"))).alias("__s"), F.count("*").alias("__n"))
    d = d.withColumns({"symbol": F.lit("USD_INDEX"), "usd_strength": F.col("__s") / F.col("__n")})
    return d.withColumns({"change_5d": SYM.sum("usd_strength", 5), "change_20d": SYM.sum("usd_strength", 20)}).drop("__s", "__n")


def volatility_ladder(df: DataFrame, r: Roll = SYM, alpha=0.05, beta=0.90) -> DataFrame:
    """Short/mid/long realised volatility, slopes, conditional variance from the previous row, shocks, regimes."""
    df = df.withColumn("__r", r.pct("close")).withColumn("last_shock", F.col("__r") * F.col("__r"))
    df = df.withColumns({"__vs": r.mean("last_shock", 15, 5), "__vm": r.mean("last_shock", 60, 10), "__vl": r.mean("last_shock", 30, 10)})
    df = df.withColumns(
        {
            "short_vol": F.sqrt("__vs") * ANNUAL,
            "mid_vol_60": F.sqrt("__vm") * ANNUAL,
            "long_vol": F.sqrt("__vl") * ANNUAL,
            "garch_cond_var": F.coalesce(F.col("__vl") * (1 - alpha - beta) + alpha * r.lag("last_shock") + beta * r.lag("__vs"), F.col("__vs")),
        }
    )
    s, m, lo, ret, sigma = F.col("short_vol"), F.col("mid_vol_60"), F.col("long_vol"), F.col("__r"), F.sqrt("__vs")
    neg, pos = F.least(ret, F.lit(0.0)) / (sigma + 1e-9), F.greatest(ret, F.lit(0.0)) / (sigma + 1e-9)
    df = df.withColumns(
        {
            "vol_ratio": s / (lo + 1e-6) - 1,
            "vol_slope_short_mid": (s - m) / (m + 1e-6),
            "vol_slope_mid_long": (m - lo) / (lo + 1e-6),
            "vol_of_vol_20": r.std("short_vol", 20, 5),
            "garch_persistence": F.lit(alpha + beta),
            "garch_half_life": F.lit(min(max(math.log(0.5) / math.log(alpha + beta), 1), 250)),
            "garch_long_run_var": F.col("__vl") * (1 - alpha - beta) / (1 - alpha - beta + 1e-9),
            "garch_std_resid_sq": F.pow(ret / (F.sqrt("garch_cond_var") + 1e-9), 2),
            "neg_shock_dummy": flag((ret < 0) & (F.abs(ret) > sigma)),
            "__asym": F.when(ret.isNotNull() & sigma.isNotNull(), neg - pos),
            "short_vol_z_252": soft_z(r, "short_vol", 252, 60),
            "long_vol_z_252": soft_z(r, "long_vol", 252, 60),
        }
    )
    z = F.col("short_vol_z_252")
    df = r.ordered(df, {"__hi": Level("last_shock", 0.95, 252, 60), "__lo": Level("last_shock", 0.1, 20, 5)})
    return df.withColumns(
        {
            "vol_of_vol_ratio": F.col("vol_of_vol_20") / (lo + 1e-6),
            "shock_asymmetry_20": r.mean("__asym", 20, 5),
            "vol_low_regime": flag(z < -0.5),
            "vol_high_regime": flag(z > 0.5),
            "vol_spike_flag": flag((z > 2) & (F.col("last_shock") > F.col("__hi"))),
            "vol_crush_flag": flag((z < -2) & (F.col("last_shock") < F.col("__lo"))),
        }
    ).drop("__r", "__vs", "__vm", "__vl", "__asym", "__hi", "__lo")


def vol_difference_and_skew(df: DataFrame, short=20, long=60, r: Roll = SYM) -> DataFrame:
    """Short minus long realised volatility; downside minus upside volatility."""
    df = df.withColumn("__r", r.pct("close"))
    up, dn = F.when(F.col("__r").isNotNull(), F.greatest(F.col("__r"), F.lit(0.0))), F.when(F.col("__r").isNotNull(), -F.least(F.col("__r"), F.lit(0.0)))
    return df.withColumns(
        {
            "vol_diff": (r.std("__r", short) - r.std("__r", long)) * ANNUAL,
            "skew_proxy": (r.std(dn, long) - r.std(up, long)) * ANNUAL,
        }
    ).drop("__r")


def price_anchors(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """Price against its averages, momentum, vol-adjusted momentum, z-scores and scenario bands; filled forward then 0."""
    p = F.col("close")
    df = r.ewm(df, {"__e252": ("close", 2 / 253), "__e63": ("close", 2 / 64)}, adjust=True)
    rn = r.row()
    df = df.withColumns(
        {
            "__e252": F.when(rn >= 100, F.col("__e252")),
            "__e63": F.when(rn >= 20, F.col("__e63")),
            "__r": r.pct("close"),
            "__m1": r.pct("close", 21),
            "__m3": r.pct("close", 63),
            "__s21": r.std("close", 21, 10),
            "__s63": r.std("close", 63, 20),
            "__band": 1.5 * r.std("close", 252, 100),
            "__slope": r.diff("close", 21) / 21,
        }
    )
    dn = F.when(F.col("__r").isNotNull(), F.least(F.col("__r"), F.lit(0.0)))
    rv, dv, v63 = r.std("__r", 21, 10) * ANNUAL, r.std(dn, 21, 10) * ANNUAL, r.std("__r", 63, 20) * ANNUAL
    e252, e63, band = F.col("__e252"), F.col("__e63"), F.col("__band")
    ma20, ma63 = r.mean("close", 20, 10), r.mean("close", 63, 20)
    up, down = (e252 + band - p) / (p + 1e-9), (p - e252 + band) / (p + 1e-9)
    skew = (up - down) / (up + down + 1e-9)
    log1y = F.ln(p / (e252 + 1e-9))
    out = {
        "price_to_fairvalue_1y": p / (e252 + 1e-9),
        "price_to_fairvalue_3m": p / (e63 + 1e-9),
        "price_regime": p / (ma20 + 1e-9),
        "log_p2fv_1y": log1y,
        "log_p2fv_3m": F.ln(p / (e63 + 1e-9)),
        "log_price_regime": F.ln(p / (ma20 + 1e-9)),
        "overextension": clip(log1y, 0, 1),
        "undervaluation": clip(log1y, -1, 0),
        **{f"mom_{k}": p / (r.lag("close", n) + 1e-9) for k, n in (("1m", 21), ("3m", 63), ("12m", 252))},
        "mom_vol_adjusted": clip(F.col("__m1") / (rv + 1e-9), -10, 10),
        "mom_sharped": clip(F.col("__m1") / (dv + 1e-9), -10, 10),
        "zscore_1m": (p - r.mean("close", 21, 10)) / (F.col("__s21") + 1e-9),
        "zscore_3m": (p - ma63) / (F.col("__s63") + 1e-9),
        "trend_slope_1m": F.col("__slope") / (p + 1e-9),
        "trend_stability": F.abs("__slope") / (F.col("__s21") + 1e-9),
        "vol_adjusted_value": p / (ma63 + 1e-9) / (v63 + 1e-9),
        "value_momentum_ratio": F.col("__m3") / (v63 + 1e-9),
        "scenario_spread": 2 * band / (e252 + 1e-9),
        "scenario_skew": skew,
        "downside_skew_stress": clip(-skew, 0, 1),
        "scenario_position": (p - e252 + band) / (2 * band + 1e-9),
        "terminal_value_pct": r.mean("close", 252, 100) / (ma63 + 1e-9),
    }
    df = df.withColumns(out)
    return df.withColumns({k: F.coalesce(r.ffill(k), F.lit(0.0)) for k in out}).drop(*[c for c in df.columns if c.startswith("__")])


def benchmark_exposures(df: DataFrame, benchmarks: DataFrame, names, n=120, r: Roll = SYM) -> DataFrame:
    """Correlation and beta of `ret` to each benchmark over common dates, and the mean spread to the first."""
    df = df.join(benchmarks, "date").dropna(subset=["ret", *names])
    out = {"spread_20": r.mean(F.col("ret") - F.col(names[0]), 20)}
    for b in names:
        out[f"corr_{b}_{n}"] = r.corr("ret", b, n)
        out[f"beta_{b}_{n}"] = r.cov("ret", b, n) / (r.var(b, n) + 1e-6)
    return df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()})


def temporal_patterns(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """Trend strength, volatility regime, weekday effect of the last 126 rows, seasonality and stability."""
    nz = lambda x, d=0.0: F.coalesce(x, F.lit(d))
    p = F.col("close")
    df = df.withColumns({"__r": nz(r.pct("close")), "__ms": r.mean("close", 10, 5), "__ml": r.mean("close", 30, 15), "__rn": r.row()})
    ret = F.col("__r")
    day = Roll(["symbol", "__wd"], "__rn")
    w126 = day.base.rangeBetween(-126, -1)
    season = F.sin((F.col("__rn") - 1) * (math.pi / 10))
    df = df.withColumns(
        {
            "__wd": F.weekday("date"),
            "__dl": r.diff("__ml", 10),
            "vol_short": nz(r.std("__r", 10, 5)),
            "vol_long": nz(r.std("__r", 30, 15)),
            "__sa": F.abs(season * ret),
        }
    )
    df = r.ordered(df, {"__vmed": Level("vol_long", 0.5, 252, 60)})
    df = df.withColumns(
        {
            "trend_short_strength": nz(r.diff("__ms", 5) / p),
            "trend_long_strength": nz(F.col("__dl") / p),
            "trend_consistency": nz(r.mean(flag(ret > 0), 20, 10), 0.5),
            "trend_signal_to_noise": nz(F.abs("__dl") / (r.std("__r", 20, 10) * p + 1e-8)),
            "vol_regime_zscore": nz(soft_z(r, "vol_long", 252, 60, 1e-8, F.col("__vmed"))),
            "vol_trend": nz(r.diff("vol_long", 10)),
            "weekday_effect": nz(F.when(F.col("__rn") > 126, F.avg("__r").over(w126))),
            "month_phase": clip((F.dayofmonth("date") - 15) / 15.0, -1, 1),
            "seasonality_importance": nz(r.mean("__sa", 20, 10)),
            "stability_short": nz(1 / (1 + r.mean(F.abs(ret), 10, 5))),
            "stability_long": nz(1 / (1 + r.mean(F.abs(ret), 30, 15))),
        }
    )
    squash = lambda x: sigmoid(clip(x, -10, 10))
    stable = r.mean(F.abs(ret), 30, 15)
    conf = 0.3 + 0.4 * squash(-F.abs("vol_regime_zscore")) + 0.3 * squash(F.col("trend_signal_to_noise") - 0.5) / (1 + stable)
    conf = nz(clip(conf, 0, 1), 0.5)
    return df.withColumns(
        {
            "trend_importance": (F.abs("trend_short_strength") + F.abs("trend_long_strength")) / 2,
            "confidence": F.when(F.col("__rn") <= 30, conf * 0.5).otherwise(conf),
        }
    ).drop(*[c for c in df.columns if c.startswith("__")])


def spells(df: DataFrame, label: str, r: Roll = SYM) -> DataFrame:
    """Gaps and islands: `spell` numbers runs of equal labels, `spell_pos` the zero-based row within the run."""
    changed = F.coalesce((~F.col(label).eqNullSafe(r.lag(label))).cast("int"), F.lit(1))
    df = df.withColumn("__chg", F.when(r.row() == 1, 1).otherwise(changed))
    df = df.withColumn("spell", r.sum("__chg")).drop("__chg")
    return df.withColumn("spell_pos", Roll([*r.keys, "spell"], r.order).row() - 1)


def regime_probabilities(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """Logistic bull/bear/neutral probabilities, label, spell length, recent-change flag, trend-ratio z.

    The slope enters relative to price, so that the logistic argument does not depend on the quote currency.
    """
    nz = lambda x: F.coalesce(x, F.lit(0.0))
    df = df.withColumns({"__f": r.mean("close", 20), "__s": r.mean("close", 60), "__r": nz(r.pct("close")), "__m60": nz(r.pct("close", 60))})
    df = df.withColumns({"__df": ratio(r.diff("__f"), "__f"), "regime_trend_ratio": (F.col("__f") - F.col("__s")) / (F.col("__s") + 1e-6)})
    df = df.withColumn("__act", 4 * F.col("regime_trend_ratio") + 2 * nz(r.mean("__df", 5)) + F.col("__m60"))
    bull, bear = sigmoid("__act"), sigmoid(-F.col("__act"))
    df = df.withColumns(
        {
            "regime_bull_probability": bull,
            "regime_bear_probability": bear,
            "regime_neutral_probability": clip(1 - clip(bull + bear, 0, 1), 0, 1),
            "regime_volatility_20d": r.std("__r", 20) * ANNUAL,
            "regime_trend_ratio_zscore": soft_z(r, "regime_trend_ratio", 252, 60, 1e-6),
        }
    )
    b, e, n = (F.col(f"regime_{k}_probability") for k in ("bull", "bear", "neutral"))
    df = df.withColumn("regime_label", F.when((e >= n) & (e >= b), 0).when((n >= b) & (n > e), 1).when(b.isNotNull(), 2))
    df = spells(df, "regime_label", r)
    recent = F.max(flag(F.col("spell_pos") == 0)).over(r.frame(6))
    unknown = F.max(flag(F.col("regime_label").isNull())).over(r.frame(6))
    out = {
        "regime_duration": F.when(F.col("regime_label").isNull(), 0).otherwise(F.least(F.col("spell_pos"), F.lit(250))),
        "regime_change_flag": F.greatest(recent, unknown),  # a missing label counts as a change, as in a NaN comparison
    }
    df = df.withColumns(out)
    names = [c for c in df.columns if c.startswith("regime_")]
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}).drop(*[c for c in df.columns if c.startswith("__")], "spell", "spell_pos")


def forecast_inputs(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """Input features of a quantile forecast: log returns, volatilities, shape, average gaps, volume z, regime flags."""
    c = F.col("close")
    df = df.withColumns({f"r{k}": r.logret("close", k) for k in (1, 5, 10, 20)} | {"high_low_range_pct": ratio(F.col("high") - F.col("low"), "close")})
    df = df.withColumns({f"realized_vol_{n}": r.std("r1", n, max(3, n // 2)) for n in (5, 10, 20)})
    df = df.withColumns({f"close_vs_sma{n}": c / r.mean("close", n, n // 2) - 1 for n in (10, 20, 50)})
    rv = F.col("realized_vol_20")
    df = r.ordered(df, {"__lo": Level("realized_vol_20", 0.2, 252, 60), "__hi": Level("realized_vol_20", 0.8, 252, 60)})
    return df.withColumns(
        {
            "intraday_range": r.mean("high_low_range_pct", 10, 5),
            "rolling_mean_5": r.mean("r1", 5, 3),
            "rolling_skew_20": r.skew("r1", 20, 10),
            "rolling_kurt_20": r.kurt("r1", 20, 10),
            "volume_zscore": (F.col("volume") - r.mean("volume", 20, 10)) / (r.std("volume", 20, 10) + 1e-8),
            "volume_change_pct": r.pct("volume"),
            "low_vol_flag": flag(rv < F.col("__lo")),
            "high_vol_flag": flag(rv > F.col("__hi")),
            "breakout_flag": flag(F.col("close_vs_sma20") > 0.02),
        }
    ).drop("__lo", "__hi")


def residual_diagnostics(df: DataFrame, actual: str, forecast: str, r: Roll = SYM, n=20, mp=10) -> DataFrame:
    """Residual, its size, z-score, variance and sign of the forecast, for a forecast that is already a column."""
    df = df.withColumn("residual", F.col(actual) - F.col(forecast))
    return df.withColumns(
        {
            "abs_residual": F.abs("residual"),
            "residual_zscore": soft_z(r, "residual", n, mp, 1e-8),
            "uncertainty_proxy": r.var("residual", n, mp),
            "momentum_indicator": F.signum(forecast),
        }
    )


def market_cap_history(bars: DataFrame, points: DataFrame, limit: int = 10, r: Roll = SYM) -> DataFrame:
    """Market cap from sparse points carried at most `limit` sessions: log level, changes, volatility, float turnover z.

    `points` has (symbol, date, market_cap, shares_float) already shifted to the session they are known on.
    """
    df = bars.join(points, ["symbol", "date"], "left")
    nz = lambda x: F.coalesce(x, F.lit(0.0))
    df = df.withColumns({"mcap": F.greatest(nz(r.ffill("market_cap", limit)), F.lit(0.0)), "__sf": nz(r.ffill("shares_float", limit))})
    df = df.withColumn("log_mcap", F.when(F.col("mcap") > 0, F.ln("mcap")).otherwise(0.0))
    df = df.withColumns({"__d1": nz(r.diff("log_mcap")), "float_turnover": nz(F.when(F.col("__sf") != 0, F.col("volume") / F.col("__sf")))})
    m, s = r.mean("float_turnover", 252, 60), r.std0("float_turnover", 252, 60)
    return df.withColumns(
        {
            "has_data": flag(F.col("mcap") > 0),
            **{f"mcap_chg_{k}d": nz(r.diff("log_mcap", k)) for k in (20, 63, 252)},
            "mcap_vol_63d": nz(r.std0("__d1", 63, 20)),
            "turnover_z_252d": nz(F.when(s > 1e-12, (F.col("float_turnover") - m) / s)),
        }
    ).drop("__sf", "__d1")


def dividend_features(bars: DataFrame, dividends: DataFrame, r: Roll = SYM) -> DataFrame:
    """Trailing yield, frequency, signed days to the nearest ex-date rule, window strength and event intensity.

    `dividends` has (symbol, date, value) on session dates. Large payments are capped at the symbol's 99th percentile.
    """
    cap = dividends.groupBy("symbol").agg(F.percentile("value", F.lit(0.99)).alias("__cap"))
    div = dividends.join(cap, "symbol").select("symbol", "date", F.least("value", "__cap").alias("__amt"))
    df = bars.join(div, ["symbol", "date"], "left")
    df = df.withColumns({"dividend_amount": F.coalesce("__amt", F.lit(0.0)), "__ex": F.when(F.col("__amt").isNotNull(), F.col("date"))})
    nxt = F.first("__ex", ignorenulls=True).over(r.ahead(None))
    last = F.last("__ex", ignorenulls=True).over(r.frame(None, 1))
    days = F.coalesce(F.datediff(nxt, "date"), -F.datediff("date", last), F.lit(999)).cast("double")
    df = df.withColumns(
        {
            "days_to_ex_dividend": clip(days, -30, 30),
            "dividend_yield_est": r.sum("dividend_amount", 252, 1),
            "dividend_frequency": r.sum(flag(F.col("dividend_amount") > 0), 252, 1),
        }
    )
    df = df.withColumn("ex_dividend_window_strength", F.exp(-F.abs("days_to_ex_dividend") / 2.5))
    unit = F.col("dividend_amount") / (F.col("close") + 1e-9)
    return df.withColumns(
        {
            "dividend_event_intensity": unit * F.col("ex_dividend_window_strength"),
            "dividend_event_stress": F.col("ex_dividend_window_strength") * F.least(F.abs(unit), F.lit(0.1)) * 10,
            "dividend_yield_zscore": clip(soft_z(r, "dividend_yield_est", 252, 20), -3, 3),
        }
    ).drop("__amt", "__ex")


def options_anchor(daily: DataFrame, r: Roll = SYM, half_life: float = 5.0) -> DataFrame:
    """Anchoring features of daily option snapshots carried forward: IV z and percentiles, skew z, staleness decay.

    `daily` has one row per session with atm_iv, iv_skew, put_call (NULL between snapshots).
    """
    df = r.numbered(daily)
    df = df.withColumn("days_since_update", r.days_since(F.col("atm_iv").isNotNull()))
    df = df.withColumns({c: r.ffill(c) for c in ("atm_iv", "iv_skew", "put_call")})
    # the smoothing starts at the first snapshot; before it there is nothing to smooth
    df = r.ewm(df, {"put_call_ewm": ("put_call", 2 / 11)})
    df = r.ordered(df, {"iv_percentile_30d": Rank("atm_iv", 30, 10), "iv_percentile_1y": Rank("atm_iv", 252, 60)})
    z = lambda x, n, mp: F.when(r.std(x, n, mp) > 1e-9, (F.col(x) - r.mean(x, n, mp)) / r.std(x, n, mp))
    return df.withColumns(
        {
            "iv_anchor_z20": z("atm_iv", 20, 5),
            "skew_z30": z("iv_skew", 30, 10),
            "staleness_decay": F.pow(F.lit(2.0), -F.col("days_since_update") / half_life),
        }
    ).drop("__rn")
