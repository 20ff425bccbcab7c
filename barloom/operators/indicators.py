"""Price and volume indicators per symbol on daily bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import clip, col, ratio, safe_log
from barloom.functions.ordered import Level
from barloom.functions.windows import SYM, Roll


def true_range(r: Roll = SYM) -> Column:
    """Largest of high-low and the two distances to the previous close; the first row uses high-low."""
    pc = r.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def close_to_close(df: DataFrame, price="close", r: Roll = SYM) -> DataFrame:
    return df.withColumn("ret", F.coalesce(r.pct(price), F.lit(0.0)))


def simple_and_log_returns(df: DataFrame, price="close", r: Roll = SYM) -> DataFrame:
    return df.withColumns({"simple_ret_1d": r.pct(price), "log_ret_1d": r.logret(price)})


def rolling_stats(df: DataFrame, windows=(5, 10, 20, 50), price="close", r: Roll = SYM) -> DataFrame:
    """Mean, std, skew and kurtosis known the day before, and today's drawdown from the window high."""
    out = {}
    for n in windows:
        out[f"roll_mean_{n}d"] = r.mean(price, n, shift=1)
        out[f"roll_std_{n}d"] = r.std(price, n, shift=1)
        out[f"roll_skew_{n}d"] = r.skew(price, n, shift=1)
        out[f"roll_kurt_{n}d"] = r.kurt(price, n, shift=1)
        peak = r.max(price, n)
        out[f"roll_drawdown_{n}d"] = (col(price) - peak) / peak
    return df.withColumns(out)


def _after(r: Roll, n: int, x) -> Column:
    """NULL until n rows of history exist (indicator warm-up)."""
    return F.when(r.row() >= n, x)


def macd(df: DataFrame, price="close", r: Roll = SYM, shift: int = 1) -> DataFrame:
    """EMA 12/26, MACD line, 9-period signal and their difference."""
    df = r.ewm(df, {"__e12": (price, 2 / 13), "__e26": (price, 2 / 27)})
    df = df.withColumn("__macd", _after(r, 26, F.col("__e12") - F.col("__e26")))
    df = r.ewm(df, {"__sig": ("__macd", 2 / 10)})
    df = df.withColumn("__sig", _after(r, 34, F.col("__sig"))).withColumn("__e12", _after(r, 12, F.col("__e12")))
    df = df.withColumn("__e26", _after(r, 26, F.col("__e26"))).withColumn("__dif", F.col("__macd") - F.col("__sig"))
    names = {"ema_12": "__e12", "ema_26": "__e26", "macd": "__macd", "macd_signal": "__sig", "macd_dif": "__dif"}
    return df.withColumns({k: r.lag(v, shift) if shift else F.col(v) for k, v in names.items()}).drop(*names.values())


def rsi_wilder(df: DataFrame, out="rsi", n=14, price="close", r: Roll = SYM) -> DataFrame:
    d = r.diff(price)
    df = df.withColumns({"__up": F.when(d > 0, d).otherwise(0.0), "__dn": F.when(d < 0, -d).otherwise(0.0)})
    df = r.ewm(df, {"__au": ("__up", 1 / n), "__ad": ("__dn", 1 / n)})
    value = F.when(F.col("__ad") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("__au"), F.col("__ad"))))
    return df.withColumn(out, _after(r, n, value)).drop("__up", "__dn", "__au", "__ad")


def stoch_rsi(df: DataFrame, rsi="rsi", n=14, smooth=3, r: Roll = SYM) -> DataFrame:
    lo, hi = r.min(rsi, n), r.max(rsi, n)
    df = df.withColumn("stoch_rsi", ratio(F.col(rsi) - lo, hi - lo))
    df = df.withColumn("stoch_rsi_k", r.mean("stoch_rsi", smooth))
    return df.withColumn("stoch_rsi_d", r.mean("stoch_rsi_k", smooth))


def momentum(df: DataFrame, r: Roll = SYM) -> DataFrame:
    df = stoch_rsi(rsi_wilder(df, "rsi", 14, r=r), "rsi", r=r)
    return df.withColumns(
        {
            "rsi_14": r.lag("rsi"),
            "stoch_rsi": r.lag("stoch_rsi"),
            "stoch_rsi_k": r.lag("stoch_rsi_k"),
            "stoch_rsi_d": r.lag("stoch_rsi_d"),
        }
    ).drop("rsi")


def wilder(df: DataFrame, out: str, source: str, n: int, r: Roll = SYM) -> DataFrame:
    """Wilder smoothing: the first value is the plain mean of n rows, then y = (y'(n-1) + x) / n."""
    rn = r.row()
    df = df.withColumn("__seeded", F.when(rn == n, r.mean(source, n)).when(rn > n, F.col(source)))
    return r.ewm(df, {out: ("__seeded", 1 / n)}).drop("__seeded")


def atr(df: DataFrame, out="atr_14", n=14, r: Roll = SYM) -> DataFrame:
    return wilder(df.withColumn("__tr", true_range(r)), out, "__tr", n, r).drop("__tr")


def bollinger_atr(df: DataFrame, n=20, k=2.0, r: Roll = SYM) -> DataFrame:
    df = atr(df, "__atr", 14, r)
    m, s = r.mean("close", n), r.std0("close", n)
    df = df.withColumns({"__m": m, "__h": m + k * s, "__l": m - k * s})
    df = df.withColumns({"bb_high": r.lag("__h"), "bb_low": r.lag("__l"), "bb_mid": r.lag("__m"), "atr_14": r.lag("__atr")})
    df = df.withColumn("__wd", (F.col("bb_high") - F.col("bb_low")) / F.col("bb_mid"))
    return df.withColumn("bb_width", r.lag("__wd")).drop("__m", "__h", "__l", "__atr", "__wd")


def obv_mfi(df: DataFrame, n=14, r: Roll = SYM) -> DataFrame:
    pc = r.lag("close")
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumns({"__sv": F.when(F.col("close") < pc, -F.col("volume")).otherwise(F.col("volume")), "__tp": tp})
    ptp = r.lag("__tp")
    flow = F.col("__tp") * F.col("volume")
    df = df.withColumns({"__pf": F.when(F.col("__tp") > ptp, flow).otherwise(0.0), "__nf": F.when(F.col("__tp") < ptp, flow).otherwise(0.0)})
    df = df.withColumn("__mfi", 100 - F.try_divide(F.lit(100.0), 1 + ratio(r.sum("__pf", n), r.sum("__nf", n))))
    df = df.withColumn("__obv", r.sum("__sv"))
    return df.withColumns({"obv": r.lag("__obv"), "mfi_14": r.lag("__mfi")}).drop("__sv", "__tp", "__pf", "__nf", "__mfi", "__obv")


def channels(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """SMA, stochastic, CCI, Williams %R, Donchian, Keltner, VWAP and accumulation/distribution."""
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    tp = (h + lo + c) / 3
    df = df.withColumns({"__tp": tp, "__clv": F.coalesce(ratio((c - lo) - (h - c), h - lo), F.lit(0.0)) * v})
    hi14, lo14 = r.max("high", 14), r.min("low", 14)
    dh, dl = r.max("high", 20), r.min("low", 20)
    tpm = r.mean("__tp", 20)
    w20 = r.frame(20)
    mad = F.aggregate(
        F.transform(F.collect_list("__tp").over(w20), lambda x: F.abs(x - tpm)), F.lit(0.0), lambda a, x: a + x
    ) / 20
    km = r.mean("__tp", 10)
    ktr = r.mean(h - lo, 10)
    df = df.withColumns(
        {
            "sma_20": r.mean("close", 20),
            "sma_50": r.mean("close", 50),
            "stoch_k": 100 * ratio(c - lo14, hi14 - lo14),
            "williams_r": -100 * ratio(hi14 - c, hi14 - lo14),
            "cci": F.when(mad > 1e-9, (F.col("__tp") - tpm) / (0.015 * mad)),
            "dc_high": dh,
            "dc_low": dl,
            "dc_mid": (dh + dl) / 2,
            "kc_mid": km,
            "kc_high": km + ktr,
            "kc_low": km - ktr,
            "vwap": ratio(r.sum(F.col("__tp") * v, 14), r.sum("volume", 14)),
            "acc_dist": r.sum("__clv"),
        }
    )
    return df.withColumn("stoch_d", r.mean("stoch_k", 3)).drop("__tp", "__clv")


def adx(df: DataFrame, n=14, r: Roll = SYM) -> DataFrame:
    """Directional movement: Wilder-smoothed +DI, -DI and ADX."""
    up, dn = F.col("high") - r.lag("high"), r.lag("low") - F.col("low")
    df = df.withColumns(
        {
            "__tr": true_range(r),
            "__pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0),
            "__ndm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
        }
    )
    for name in ("tr", "pdm", "ndm"):
        df = wilder(df, f"__s{name}", f"__{name}", n, r)
    df = df.withColumns({"adx_pos": 100 * ratio("__spdm", "__str"), "adx_neg": 100 * ratio("__sndm", "__str")})
    dx = 100 * ratio(F.abs(F.col("adx_pos") - F.col("adx_neg")), F.col("adx_pos") + F.col("adx_neg"))
    df = df.withColumn("__dx", F.when(r.row() >= n, F.coalesce(dx, F.lit(0.0))))
    rn = r.row()
    df = df.withColumn("__sd", F.when(rn == 2 * n - 1, r.mean("__dx", n)).when(rn > 2 * n - 1, F.col("__dx")))
    return r.ewm(df, {"adx": ("__sd", 1 / n)}).drop("__tr", "__pdm", "__ndm", "__str", "__spdm", "__sndm", "__dx", "__sd")


def parabolic_sar(df: DataFrame, step=0.02, max_step=0.2, keys=("symbol",)) -> DataFrame:
    """Parabolic stop-and-reverse: a true recurrence, folded once over each symbol's daily bars."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        sar = np.empty(len(pdf))
        rising, accel, extreme, stop = True, step, high[0], low[0]
        for i in range(len(pdf)):
            if i:
                stop = stop + accel * (extreme - stop)
                bound = slice(max(0, i - 2), i)
                stop = min(stop, low[bound].min()) if rising else max(stop, high[bound].max())
                if (low[i] < stop) if rising else (high[i] > stop):
                    rising, stop, accel = not rising, extreme, step
                    extreme = high[i] if rising else low[i]
                elif (high[i] > extreme) if rising else (low[i] < extreme):
                    extreme, accel = (high[i] if rising else low[i]), min(accel + step, max_step)
            sar[i] = stop
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "date": pdf["date"], "psar": sar})

    return df.select(*keys, "date", "high", "low").groupBy(*keys).applyInPandas(fold, "symbol string, date date, psar double")


def monthly_bars(df: DataFrame) -> DataFrame:
    """Daily bars to calendar months: first open, highest, lowest, last close, total volume."""
    return df.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
    )


def long_term(monthly: DataFrame) -> DataFrame:
    """Momentum, averages and expanding drawdown statistics on monthly bars."""
    r = Roll("symbol", "month")
    out = {f"momentum_{k}m": r.pct("close", k) for k in (3, 6, 12)}
    out |= {f"sma_{k}m": r.mean("close", k) for k in (3, 6, 12)}
    peak = r.max("close")
    df = monthly.withColumns({**out, "__dd": (F.col("close") - peak) / peak})
    return df.withColumns(
        {"max_drawdown": r.min("__dd"), "avg_drawdown": r.mean("__dd"), "drawdown_std": r.std("__dd", mp=2)}
    ).drop("__dd")


def price_features(df: DataFrame, r: Roll = SYM) -> DataFrame:
    out = {f"return_{k}d": r.pct("close", k) for k in (1, 5, 10, 20)}
    out |= {f"log_return_{k}d": r.logret("close", k) for k in (1, 5)}
    out |= {f"price_ratio_{n}d": ratio("close", r.mean("close", n)) for n in (5, 10, 20, 50)}
    for n in (10, 20, 50):
        lo, hi = r.min("close", n), r.max("close", n)
        out[f"price_position_{n}d"] = ratio(F.col("close") - lo, hi - lo)
    return df.withColumns(out)


def technical_features(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """Moving-average gaps, EMA gaps, MACD, centred RSI, Bollinger position and volume ratios."""
    c, v = F.col("close"), F.col("volume")
    out = {}
    for n in (5, 10, 20, 50, 200):
        out[f"ma_{n}"] = r.mean("close", n)
        out[f"price_vs_ma_{n}"] = c / r.mean("close", n) - 1
    df = r.ewm(df, {f"ema_{s}": ("close", 2 / (s + 1)) for s in (12, 26, 50)}, adjust=True)
    out |= {f"price_vs_ema_{s}": c / F.col(f"ema_{s}") - 1 for s in (12, 26, 50)}
    d = r.diff("close")
    df = df.withColumns({"macd": F.col("ema_12") - F.col("ema_26"), "__g": F.when(d > 0, d).otherwise(0.0), "__d": F.when(d < 0, -d).otherwise(0.0)})
    df = r.ewm(df, {"macd_signal": ("macd", 0.2)}, adjust=True)
    g, lo = r.mean("__g", 14), r.mean("__d", 14)
    out["rsi"] = (F.when(lo == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(g, lo))) - 50) / 50
    for n in (20, 50):
        m, s = r.mean("close", n), r.std("close", n)
        out[f"bb_upper_{n}"], out[f"bb_lower_{n}"] = m + 2 * s, m - 2 * s
        out[f"bb_width_{n}"] = 4 * s / m
        out[f"bb_position_{n}"] = ratio(c - (m - 2 * s), 4 * s)
    for n in (5, 20, 50):
        out[f"volume_ma_{n}"] = r.mean("volume", n)
        out[f"volume_ratio_{n}"] = ratio("volume", r.mean("volume", n))
    out["price_volume"] = c * v
    out["volume_weighted_price"] = ratio(r.sum(c * v, 20), r.sum("volume", 20))
    return df.withColumns(out).drop("__g", "__d")


def statistical_features(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """Volatility, shape, price percentiles and autocorrelation of returns."""
    df = df.withColumn("ret", r.pct("close"))
    df = df.withColumns({"__l1": r.lag("ret", 1), "__l5": r.lag("ret", 5)})
    levels = {f"percentile_{p}_{n}d": Level("close", p / 100, n) for n in (20, 50) for p in (10, 25, 75, 90)}
    df = r.ordered(df, levels)
    out = {}
    for n in (5, 10, 20, 50):
        out[f"volatility_{n}d"] = r.std("ret", n)
        out[f"volatility_annualized_{n}d"] = r.std("ret", n) * 252**0.5
    for n in (20, 50):
        out[f"skewness_{n}d"], out[f"kurtosis_{n}d"] = r.skew("ret", n), r.kurt("ret", n)
    # the lagged partner must also lie inside the 50-row window, so 50-k pairs enter
    full = r.count("ret", 50) >= 50
    for k in (1, 5):
        out[f"autocorr_lag_{k}"] = F.when(full, r.corr("ret", f"__l{k}", 50 - k))
    return df.withColumns(out).drop("__l1", "__l5")


def winsorised_z(df: DataFrame, x: str, out: str, r: Roll = SYM, lo=0.01, hi=0.99, cap=5.0) -> DataFrame:
    """Clip to the symbol's 1/99% quantiles, z-score, clip, forward fill (one daily series per symbol)."""
    q = df.groupBy(*r.keys).agg(F.percentile(x, F.lit(lo)).alias("__lo"), F.percentile(x, F.lit(hi)).alias("__hi"))
    df = df.join(q, r.keys)
    df = df.withColumn("__w", F.when(F.col(x).isNotNull(), F.greatest("__lo", F.least("__hi", x))))
    s = df.groupBy(*r.keys).agg(F.avg("__w").alias("__m"), F.stddev_samp("__w").alias("__s"))
    df = df.join(s, r.keys)
    value = F.when(F.col("__s") > 0, (F.col("__w") - F.col("__m")) / F.col("__s")).otherwise(F.col("__w"))
    return df.withColumn(out, r.ffill(clip(value, -cap, cap))).drop("__lo", "__hi", "__w", "__m", "__s")


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "day_of_week": F.weekday("date"),
            "month": F.month("date"),
            "quarter": F.quarter("date"),
            "log_close": safe_log("close"),
        }
    )
