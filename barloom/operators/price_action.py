"""Daily bar shape, microstructure, anomaly and downside features per symbol.

Missing history yields NULL inside the library; `filled=True` applies the zero fill the feature panel expects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, col, flag, ratio
from barloom.functions.ordered import Rank
from barloom.functions.windows import SYM, Roll
from barloom.operators.indicators import true_range

EPS = 1e-12
PERCENT_PER_YEAR = math.sqrt(252) * 100


def _zero(out: dict[str, Column]) -> dict[str, Column]:
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}


def candle_mechanics(df: DataFrame, r: Roll = SYM, seasonality: bool = True) -> DataFrame:
    """Shape of each bar scaled by the previous day's ATR, z-scores against the prior 20 days, bar patterns."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    lr = F.coalesce(r.logret("close"), F.lit(0.0))
    df = df.withColumns({"__tr": true_range(r), "__pc": r.lag("close"), "__rng": F.abs(h - lo), "__body": c - o, "logret_1d": lr})
    df = df.withColumns({"__a14": r.mean("__tr", 14, 1), "__a60": r.mean("__tr", 60, 1)})
    df = df.withColumns({"__p14": F.coalesce(r.lag("__a14"), "__a14"), "__p60": F.coalesce(r.lag("__a60"), "__a60")})
    rng, body, pc = F.col("__rng"), F.col("__body"), F.col("__pc")
    up, dn = h - F.greatest(o, c), F.least(o, c) - lo

    def by_range(x):
        return x / (rng + EPS)

    def by_atr(x, cap):
        return clip(x / (F.col("__p14") + EPS), -cap, cap)

    def z20(x):
        m, s = r.mean(x, 20, 1, shift=1), r.std0(x, 20, 1, shift=1)
        return clip(F.when(s > EPS, (col(x) - m) / (s + EPS)), -8, 8)

    out = {
        "has_data": flag(o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull()),
        "close_pos": clip(by_range(c - lo), 0, 1) * 2 - 1,
        "body_pct_range": clip(by_range(body), -5, 5),
        "upper_wick_pct_range": clip(by_range(up), 0, 5),
        "lower_wick_pct_range": clip(by_range(dn), 0, 5),
        "wick_imbalance": clip(by_range(up - dn), -5, 5),
        "body_atr14": by_atr(body, 10),
        "range_atr14": by_atr(rng, 20),
        "gap_atr14": by_atr(o - pc, 10),
        "close_vs_prev_close_atr14": by_atr(c - pc, 10),
        "high_vs_prev_close_atr14": by_atr(h - pc, 10),
        "low_vs_prev_close_atr14": by_atr(lo - pc, 10),
        "ret_1d": r.pct("close"),
        "ret_5d": r.pct("close", 5),
        "rv_5": r.std0("logret_1d", 5, 1),
        "rv_20": r.std0("logret_1d", 20, 1),
        "trend_3": r.sum("logret_1d", 3, 1),
        "trend_5": r.sum("logret_1d", 5, 1),
        "sign_sum_3": r.sum(F.signum("logret_1d"), 3, 1),
        "sign_sum_5": r.sum(F.signum("logret_1d"), 5, 1),
        "dist_to_high_20_atr14": by_atr(c - r.max("high", 20, 1, shift=1), 20),
        "dist_to_low_20_atr14": by_atr(c - r.min("low", 20, 1, shift=1), 20),
        "dist_to_mean_20_atr14": by_atr(c - r.mean("close", 20, 1, shift=1), 20),
        "rng_z_20": z20("__rng"),
        "body_z_20": z20("__body"),
        "inside_bar": flag((h <= r.lag("high")) & (lo >= r.lag("low"))),
        "outside_bar": flag((h >= r.lag("high")) & (lo <= r.lag("low"))),
        "dir_change": flag(F.signum(body) != F.coalesce(F.signum(r.lag("close") - r.lag("open")), F.lit(0.0))),
        "vol_log_chg": clip(F.ln(v + 1) - F.ln(r.lag("volume") + 1), -10, 10),
    }
    df = df.withColumns(_zero(out))
    one = {
        "atr_ratio_14_60": clip(F.col("__p14") / (F.col("__p60") + EPS), 0, 5),
        "vol_ratio_20": clip(v / (r.mean("volume", 20, 1, shift=1) + EPS), 0, 20),
    }
    df = df.withColumns({k: F.coalesce(x, F.lit(1.0)) for k, x in one.items()})
    if seasonality:
        dow, moy = F.weekday("date") * (2 * math.pi / 7), (F.month("date") - 1) * (2 * math.pi / 12)
        df = df.withColumns({"dow_sin": F.sin(dow), "dow_cos": F.cos(dow), "moy_sin": F.sin(moy), "moy_cos": F.cos(moy)})
    return df.drop("__tr", "__pc", "__rng", "__body", "__a14", "__a60", "__p14", "__p60")


def microstructure_daily(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """Range, wick, volume, order-flow, impact, staleness and overnight proxies from daily bars."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    df = df.withColumns({"__tr": true_range(r), "__hl": h - lo, "__ret": r.pct("close"), "__pc": r.lag("close")})
    df = df.withColumns({"__vol5": r.std("__ret", 5, 2), "__gap": o - F.col("__pc")})
    hl, ret, gap, body = F.col("__hl"), F.col("__ret"), F.col("__gap"), F.abs(c - o)
    atr = r.mean("__tr", 14, 5)
    top, bottom = h - F.greatest(o, c), F.least(o, c) - lo
    vm, vs = r.mean("volume", 20, 5), r.std("volume", 20, 5)
    dsr = (c - lo) / (h - c + 1e-9)
    out = {
        "true_range": F.col("__tr"),
        "atr_ratio": ratio(atr, c),
        "range_pct": ratio(hl, c),
        "body_pct": ratio(body, c),
        "wick_top": ratio(top, c),
        "wick_bottom": ratio(bottom, c),
        "shadow_ratio": (top + bottom) / (body + 1e-9),
        "range_scaled": hl / (atr + 1e-9),
        "volume_zscore": (v - vm) / (vs + 1e-9),
        "volume_surge": v / (vm + 1e-9),
        "volume_liquidity": v * hl,
        "turnover": v * c,
        "amihud": F.abs(ret) / (v + 1e-9) * 1e6,
        "hl_volume_corr": r.corr("__hl", "volume", 20, 5),
        "ofi_proxy": F.signum(c - o) * v,
        "signed_volume": v * ret,
        "pressure_proxy": (c - o) / (hl + 1e-9),
        "demand_supply_ratio": dsr,
        "liquidity_imbalance": dsr - 0.5,
        "impact_ratio": hl / (v + 1e-9) * 1e9,
        "impact_volatility": F.col("__vol5") / (v + 1e-9) * 1e9,
        "spread_proxy": hl / (v + 1e-9) * 1e11,
        "vol_of_vol": r.std("__vol5", 5, 2),
        "intraday_vol_proxy": hl / (o + 1e-9),
        "stale_tick": flag(h == lo),
        "zero_range_flag": flag(h == lo),
        "low_liquidity_flag": flag(v < vm * 0.3),
        "overnight_gap": gap,
        "overnight_vol": F.abs(gap) / (F.col("__pc") + 1e-9),
        "intraday_vs_overnight_vol": hl / (F.abs(gap) + 1e-9),
        "gap_direction": F.signum(gap),
    }
    df = df.withColumns(out)
    return df.withColumns({k: F.coalesce(r.ffill(k), F.lit(0.0)) for k in out}).drop("__tr", "__hl", "__ret", "__pc", "__vol5", "__gap")


def _z_or_unscaled(r: Roll, x, n: int) -> Column:
    """z over n full rows; a flat frame keeps the raw deviation (its std is replaced by one)."""
    s = r.std(x, n)
    return (col(x) - r.mean(x, n)) / F.when(s == 0, F.lit(1.0)).otherwise(s)


def price_anomalies(df: DataFrame, r: Roll = SYM) -> DataFrame:
    gap = ratio(F.col("open") - r.lag("close"), r.lag("close")) * 100
    df = df.withColumns({"overnight_return": gap, "__ret": r.pct("close"), "__hl2": F.pow(F.ln(ratio("high", "low")), 2)})
    df = df.withColumn("__sd", (r.mean("__ret", 3) - r.mean("__ret", 10)) * 100)
    return df.withColumns(
        {
            "gap_up_pct": F.when(F.col("overnight_return").isNotNull(), F.greatest(F.col("overnight_return"), F.lit(0.0))),
            "gap_down_pct": F.when(F.col("overnight_return").isNotNull(), F.abs(F.least(F.col("overnight_return"), F.lit(0.0)))),
            "intraday_range_pct": ratio(F.col("high") - F.col("low"), "close") * 100,
            "high_low_volatility_ratio": r.mean("__hl2", 20) * math.sqrt(252 / (4 * math.log(2))) * 100,
            "trend_acceleration": _z_or_unscaled(r, "__sd", 60),
            "mean_reversion_signal": clip(_z_or_unscaled(r, "close", 20), -3, 3),
        }
    ).drop("__ret", "__hl2", "__sd")


def volume_anomalies(df: DataFrame, r: Roll = SYM) -> DataFrame:
    df = r.numbered(df).withColumns({"__pr": r.pct("close"), "__vr": r.pct("volume"), "__sp": ratio(F.col("high") - F.col("low"), "close") * 100})
    pr, vr = F.col("__pr"), F.col("__vr")
    df = r.ordered(df, {"__pct": Rank("__sp", 20)})
    return df.withColumns(
        {
            "volume_z_20d": r.z("volume", 20),
            "relative_volume_20d": ratio("volume", r.mean("volume", 20)),
            "volume_trend_10d": r.slope("volume", 10),
            "volume_price_divergence": F.when((vr > 0) & (pr < 0), vr * F.abs(pr)).when((vr < 0) & (pr > 0), -vr * F.abs(pr)).otherwise(0.0),
            "buy_volume_proxy": F.signum(F.col("close") - F.col("open")) * F.col("volume"),
            "liquidity_stress_pct": F.col("__pct") * 100,
        }
    ).drop("__rn", "__pr", "__vr", "__sp", "__pct")


def realized_volatility(df: DataFrame, r: Roll = SYM) -> DataFrame:
    df = df.withColumns({"__ret": r.pct("close"), "__oc": ratio(F.col("close") - F.col("open"), "open")})
    out = {f"rv_{n}d": r.std("__ret", n) * PERCENT_PER_YEAR for n in (5, 10, 20)}
    out["rv_ratio_5_20"] = ratio(r.std("__ret", 5), r.std("__ret", 20))
    out["close_to_close_volatility"] = r.std("__ret", 20) * PERCENT_PER_YEAR
    out["open_to_close_volatility"] = r.std("__oc", 20) * PERCENT_PER_YEAR
    return df.withColumns(out).drop("__ret", "__oc")


def macro_interactions(df: DataFrame, macro: DataFrame, r: Roll = SYM) -> DataFrame:
    """Gap and beta scaled by a volatility index (date-level table with `vix` and `mkt`), clipped to ±5."""
    gap = ratio(F.col("open") - r.lag("close"), r.lag("close")) * 100
    df = df.withColumns({"__on": gap, "__rg": ratio(F.col("high") - F.col("low"), "close") * 100, "__ret": r.pct("close")}).join(macro, "date", "left")
    df = df.withColumns({"__vix": r.ffill("vix"), "__mk": F.col("mkt")})
    df = df.withColumn("__dv", r.pct("__vix", 5))
    v = r.var("__mk", 20)
    beta = r.cov("__ret", "__mk", 20) / F.when(v == 0, F.lit(1.0)).otherwise(v)
    out = {
        "gap_vs_vix_interaction": F.abs(F.col("__on")) * clip((F.col("__vix") - 10) / 70, 0, 1),
        "overnight_return_z": _z_or_unscaled(r, "__on", 60),
        "intraday_range_z": _z_or_unscaled(r, "__rg", 60),
        "beta_vix_interaction": beta * F.col("__dv"),
    }
    return df.withColumns({k: clip(F.coalesce(x, F.lit(0.0)), -5, 5) for k, x in out.items()}).drop("__on", "__rg", "__ret", "__vix", "__mk", "__dv")


def rolling_corr_beta(df: DataFrame, bench: DataFrame, n: int = 20, x="ret", y="mkt", r: Roll = SYM) -> DataFrame:
    """Correlation and beta to a benchmark over the last n common dates."""
    j = df.join(bench, "date").where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return j.withColumns({"corr": r.corr(x, y, n), "beta": r.beta(x, y, n)})


def earnings_seasonality(df: DataFrame, earnings: DataFrame, r: Roll = SYM) -> DataFrame:
    """Turn-of-month flag, volatility z, calendar days to/since earnings, 10-row run-up and 5-day drift.

    `earnings` has (symbol, earnings_date). Announcements between sessions are placed by a union of both time axes.
    """
    month = F.trunc("date", "month")
    rm = Roll(["symbol", "__month"], "date")
    df = df.withColumns({"__month": month, "__ret": r.pct("close")})
    whole = Window.partitionBy("symbol")
    df = df.withColumns(
        {
            "__first": rm.row(),
            "__size": F.count("*").over(Window.partitionBy("symbol", "__month")),
            "__open_end": F.col("__month") == F.trunc(F.max("date").over(whole), "month"),
        }
    )
    opening, closing = F.col("__first") <= 3, (F.col("__first") > F.col("__size") - 3) & ~F.col("__open_end")
    df = df.withColumns({"turn_of_month_flag": flag(opening | closing), "__vol": r.std("__ret", 20) * PERCENT_PER_YEAR})
    df = df.withColumn("rv_z_20", _z_or_unscaled(r, "__vol", 60))
    axis = Roll("symbol", ["__d", "__kind"])
    ev = earnings.select("symbol", F.col("earnings_date").alias("__d"), F.lit(0).alias("__kind"), F.col("earnings_date").alias("__ev")).distinct()
    bars = df.withColumns({"__d": F.col("date"), "__kind": F.lit(1), "__ev": F.lit(None).cast("date")})
    both = bars.unionByName(ev, allowMissingColumns=True)
    both = both.withColumns(
        {
            "__last": F.last("__ev", ignorenulls=True).over(axis.frame(None)),
            "__next": F.first("__ev", ignorenulls=True).over(axis.ahead(None, 1)),
        }
    )
    df = both.where(F.col("__kind") == 1)
    df = df.withColumns({"days_to_next_earnings": F.date_diff("__next", "date"), "days_since_last_earnings": F.date_diff("date", "__last")})
    # nearest session to the announcement: the first session on or after it unless the one before is strictly closer
    df = df.withColumn("__since", F.datediff("date", "__last")).withColumn("__prev", r.lag("date"))
    spell = Roll(["symbol", "__last"], "date")
    df = df.withColumns({"__k": spell.row(), "__anchor_after": F.first("date").over(spell.frame(None)), "__close_after": F.first("close").over(spell.frame(None)),
                         "__date_before": F.first("__prev").over(spell.frame(None)), "__pclose": r.lag("close")})
    df = df.withColumn("__close_before", F.first("__pclose").over(spell.frame(None)))
    before_is_closer = F.date_diff("__last", "__date_before") < F.date_diff("__anchor_after", "__last")
    anchor_close = F.when(before_is_closer, F.col("__close_before")).otherwise(F.col("__close_after"))
    moved = before_is_closer | (F.col("__k") > 1)
    start = F.coalesce(r.lag("close", 10), F.first("close").over(r.frame(None)))
    return df.withColumns(
        {
            "earnings_runup_10d": F.when(F.col("days_to_next_earnings").between(0, 10) & (r.row() > 1), (ratio("close", start) - 1) * 100),
            "post_earnings_drift_5d": F.when(F.col("__since").between(0, 5) & moved, (ratio("close", anchor_close) - 1) * 100),
        }
    ).drop(*[c for c in df.columns if c.startswith("__")])


def _range_position(r: Roll, x, n=252, mp=20) -> Column:
    """Position of the current value between the window's low and high."""
    lo, hi = r.min(x, n, mp), r.max(x, n, mp)
    return (col(x) - lo) / (hi - lo + 1e-8)


def momentum_breakdown(df: DataFrame, r: Roll = SYM) -> DataFrame:
    df = df.withColumns({"dist_52w_low": ratio(F.col("close") - r.min("close", 252, 20), "close"), "__roc": r.pct("close", 10)})
    df = df.withColumn("roc_accel", r.diff("__roc", 5)).drop("__roc")
    return df.withColumn("momentum_breakdown", flag((F.col("dist_52w_low") < 0.05) & (F.col("roc_accel") < -0.01)))


def volatility_state(df: DataFrame, n=14, r: Roll = SYM) -> DataFrame:
    df = df.withColumn("__tr", true_range(r)).withColumn("atr", r.mean("__tr", n))
    df = df.withColumn("atr_pct", _range_position(r, "atr")).drop("__tr")
    p = F.col("atr_pct")
    return df.withColumn("vol_regime", F.when((p > 0) & (p <= 0.33), 0.0).when((p > 0.33) & (p <= 0.66), 1.0).when((p > 0.66) & (p <= 1), 2.0))


def gap_features(df: DataFrame, n=20, r: Roll = SYM) -> DataFrame:
    df = df.withColumn("gap_pct", ratio(F.col("open") - r.lag("close"), r.lag("close")))
    neg = F.when(F.col("gap_pct") < 0, F.col("gap_pct"))
    full = r.count("gap_pct", n) >= n
    return df.withColumns(
        {
            "gap_down_freq": r.mean(flag(F.col("gap_pct") < 0), n),
            "gap_down_severity": F.when(full, F.coalesce(F.avg(neg).over(r.frame(n)), F.lit(0.0))),
        }
    )


def vix_term(df: DataFrame, macro: DataFrame) -> DataFrame:
    m = macro.select("date", (F.col("vix") - F.col("vix3m")).alias("vix_term_slope"))
    df = df.join(m, "date", "left").fillna({"vix_term_slope": 0.0})
    return df.withColumn("vix_term_inverted", flag(F.col("vix_term_slope") > 0))


def credit_spread(macro: DataFrame, r: Roll) -> DataFrame:
    """Long-bond minus high-yield spread: level, 5-row widening, position in the year's range."""
    df = macro.withColumn("credit_spread", F.col("tlt") - F.col("hyg"))
    return df.withColumns(
        {
            "credit_spread_widening": flag(r.diff("credit_spread", 5) > 0),
            "credit_spread_pct": F.coalesce(_range_position(r, "credit_spread"), F.lit(0.5)),
        }
    )


def relative_weakness(df: DataFrame, sector: DataFrame, bench: DataFrame, r: Roll = SYM) -> DataFrame:
    """20-row return against sector and benchmark series (date, *_return_20, benchmark_return_daily), beta and its drift."""
    df = df.withColumns({"__r20": r.pct("close", 20), "__r1": r.pct("close")})
    df = df.join(sector, "date", "left").join(bench, "date", "left").fillna(0.0, ["sector_return_20", "benchmark_return_20", "benchmark_return_daily"])
    df = df.withColumns(
        {
            "rel_perf_sector": F.col("__r20") - F.col("sector_return_20"),
            "rel_perf_benchmark": F.col("__r20") - F.col("benchmark_return_20"),
            "beta_20": r.beta("__r1", "benchmark_return_daily", 20),
        }
    )
    return df.withColumn("beta_drift", r.diff("beta_20", 5)).drop("__r20", "__r1")


def euphoria_index(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """0-100 blend of distance above the 200-row mean, RSI above 50 and low volatility."""
    d = r.diff("close")
    df = df.withColumns({"__g": F.when(d > 0, d).otherwise(0.0), "__l": F.when(d < 0, -d).otherwise(0.0), "__ret": r.pct("close")})
    ma, loss = r.mean("close", 200), r.mean("__l", 14)
    rs = r.mean("__g", 14) / F.when(loss == 0, F.lit(1e-9)).otherwise(loss)
    df = df.withColumns({"__v": r.std("__ret", 20), "__rsi": 100 - 100 / (1 + rs)})
    df = r.ordered(df, {"__pct": Rank("__v", 252)})
    price = clip(F.coalesce((F.col("close") - ma) / ma, F.lit(0.0)) * 500, 0, 100)
    rsi = F.coalesce(clip((F.col("__rsi") - 50) / 20 * 100, 0, 100), F.lit(0.0))
    calm = (1 - F.coalesce("__pct", F.lit(0.5))) * 100
    return df.withColumn("euphoria_index", 0.4 * price + 0.4 * rsi + 0.2 * calm).drop("__g", "__l", "__ret", "__v", "__rsi", "__pct")


def tail_risk(df: DataFrame, macro: DataFrame, r: Roll = SYM) -> DataFrame:
    """0-100 blend of volatility-index level and jump, rising realised volatility and drawdown proximity."""
    df = df.withColumn("__ret", r.pct("close")).join(macro.select("date", "vix"), "date", "left")
    df = df.withColumns({"__vix": r.ffill("vix"), "__v": r.std("__ret", 20)})
    df = df.withColumns({"__dv": r.diff("__vix"), "__up": flag(r.diff("__v") > 0)})
    level = F.coalesce(clip((F.col("__vix") - 15) / 15 * 100, 0, 100), F.lit(0.0))
    jump = F.coalesce(clip(clip("__dv", -10, 10) / 10 * 50, 0, 50), F.lit(0.0))
    rising = F.coalesce(r.sum("__up", 10) / 10 * 100, F.lit(0.0))
    top = r.max("high", 252)
    near = clip((-F.coalesce((F.col("close") - top) / top, F.lit(0.0)) - 0.05) / 0.15 * 100, 0, 100)
    return df.withColumn("tail_risk", 0.4 * (level + jump) + 0.3 * rising + 0.3 * near).drop("__ret", "__vix", "__v", "__dv", "__up", "vix")
