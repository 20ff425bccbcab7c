"""Plans: cross-asset, volatility, price-anchor, regime and event-window families."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.windows import SYM, Roll
from barloom.operators import market as op
from barloom.plans import duck as q
from barloom.plans.registry import plan


def names(d):
    return "symbol date " + " ".join(d)


def softz(x, n, mp, eps="1e-9", centre=None):
    return f"(({x} - {centre or q.mean(x, n, mp)}) / ({q.std(x, n, mp)} + {eps}))"


def select_with(exprs, src):
    """All source columns plus the expressions."""
    return "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in exprs.items()) + f" FROM {src}"


# ---- benchmark series --------------------------------------------------------------------------------------------
q.cte("macro_ret", "SELECT *, dollar / lag(dollar) OVER (ORDER BY date) - 1 AS qqq, vix / lag(vix) OVER (ORDER BY date) - 1 AS vxx, tlt / lag(tlt) OVER (ORDER BY date) - 1 AS sector FROM macro")
q.cte("benches", "SELECT date, mkt AS spy, qqq, vxx, sector FROM macro_ret LEFT JOIN market USING (date)")


def benches(t):
    r = Roll("symbol", "date")
    m = t.macro_series().select("date", r.pct("dollar").alias("qqq"), r.pct("vix").alias("vxx"), r.pct("tlt").alias("sector"))
    return m.join(t.market().withColumnRenamed("mkt", "spy"), "date", "left")


cap = lambda x: q.clip(x, -0.95, 0.95)
_lags = [("spy", 1), ("spy", 5), ("vxx", 1), ("vxx", 2), ("ret", 1), ("ret", 5)]
_c1 = {"rng": q.div("high - low", "close"), "ar": "abs(ret)", "v10": q.std("ret", 10, 5), "v20": q.std("ret", 20, 10)}
_c1 |= {f"{b}_l{k}": q.lag(b, k) for b, k in _lags}
q.cte("cf1", select_with(_c1, "rets LEFT JOIN benches USING (date)"))
q.cte("cf2", f"SELECT *, {q.lag('ar')} AS ar1, {q.lag('v10')} AS v101 FROM cf1")
_cf = {
    "corr_20_spy": q.corr("ret", "spy", 20, 6),
    "corr_60_spy": q.corr("ret", "spy", 60, 20),
    "corr_20_qqq": q.corr("ret", "qqq", 20, 6),
    "corr_20_vxx": q.corr("ret", "vxx", 20, 6),
    "corr_20_sector": q.corr("ret", "sector", 20, 6),
    **{f"lag_corr_{k}_{b}": cap(q.corr("ret", f"{b}_l{k}", 20, 10)) for b, k in _lags[:4]},
    **{f"corr_{n}_vix_lag{k}": cap(q.corr("ret", f"vxx_l{k}", n, max(5, n // 3))) for k in (1, 2) for n in (20, 60)},
    "corr_return_vol_20": q.corr("ret", "volume", 20, 10),
    "corr_return_range_10": q.corr("ret", "rng", 10, 5),
    "corr_vol_volatility_20": q.corr("volume", "v20", 20, 10),
    **{f"acf_ret_{k}": cap(q.corr("ret", f"ret_l{k}", 20, 10)) for k in (1, 5)},
    "acf_absret_1": cap(q.corr("ar", "ar1", 20, 10)),
    "acf_vol_1": cap(q.corr("v10", "v101", 20, 10)),
}
q.cte("cf3", select_with(_cf, "cf2 JOIN (SELECT symbol, date, rn FROM numbered) USING (symbol, date)"))
_cg = {
    "corr_decoupling_z": softz("corr_20_spy", 252, 60),
    "corr_spread_20_60_spy": "corr_20_spy - corr_60_spy",
    **{f"corr_20_{b}_trend": f"5 * {q.slope(f'corr_20_{b}', 'rn', 5)}" for b in ("spy", "qqq", "vxx")},
    **{f"corr_20_{b}_vol": q.std(f"corr_20_{b}", 20, 10) for b in ("spy", "vxx")},
}


@plan("correlation_family", 156, names([*_cf, *_cg]), select_with(_cg, "cf3"))
def _(t):
    return op.correlation_family(t.rets(), benches(t))


q.cte(
    "assets",
    "SELECT date, mkt AS spy_ret, dollar / lag(dollar) OVER (ORDER BY date) - 1 AS qqq_ret, vix, ust10y AS tnx, ust2y AS irx, hyg, tlt AS lqd, dollar AS uup FROM macro LEFT JOIN market USING (date)",
)
_a1 = {f"p_{x}": q.pct(x) for x in ("vix", "tnx", "irx", "hyg", "uup")}
_a1 |= {
    "rv": f"{q.std('ret', 20)} * sqrt(252)",
    "srv": f"{q.std('spy_ret', 20)} * sqrt(252)",
    "spy1": q.lag("spy_ret"),
    "ret1": q.lag("ret"),
    "credit": "hyg / (lqd + 1e-9)",
    "beta_20d": f"{q.cov('ret', 'spy_ret', 20)} / ({q.agg('var_samp', 'spy_ret', 20)} + 1e-9)",
}
q.cte("ca1", select_with(_a1, "rets LEFT JOIN assets USING (date)"))
_base = q.mean("credit", 252, 126)
_a2 = {
    "spy_corr_20d": q.corr("ret", "spy_ret", 20),
    "qqq_corr_20d": q.corr("ret", "qqq_ret", 20),
    "vix_corr_20d": q.corr("ret", "p_vix", 20),
    "tnx_corr_20d": q.corr("ret", "p_tnx", 20),
    "irx_corr_20d": q.corr("ret", "p_irx", 20),
    "asset_corr_hyg_60": q.corr("ret", "p_hyg", 60, 30),
    "asset_corr_uup_60": q.corr("ret", "p_uup", 60, 30),
    "vix_spread_indicator": "vix / (rv + 1e-9)",
    "realized_vol_vs_spy_corr": q.corr("rv", "srv", 20, 10),
    "spy_leads_stock_5d": q.corr("ret", "spy1", 20),
    "stock_leads_spy_5d": q.corr("spy_ret", "ret1", 20),
    "credit_spread_level": f"(credit - {_base}) / ({_base} + 1e-9)",
    "beta_volatility_20d": q.std("beta_20d", 20, 10),
    "beta_sign_flip_flag": q.flag(f"sign(beta_20d) <> {q.lag('sign(beta_20d)')}"),
    "bchg": q.pct("beta_20d", 5),
}
q.cte("ca2", select_with(_a2, "ca1"))
q.cte("ca3", "SELECT *, coalesce(spy_corr_20d, 0) * 0.5 + coalesce(qqq_corr_20d, 0) * 0.3 - coalesce(asset_corr_uup_60, 0) * 0.2 - coalesce(vix_corr_20d, 0) * 0.2 AS risk_onoff_factor FROM ca2")
_a3 = {
    "beta_change_rate": q.clip(f"abs({softz('bchg', 252, 60)})", 0, 3),
    "beta_volatility_change": q.clip(f"abs({q.pct('beta_volatility_20d', 5)})", 0, 5),
    "tnx_corr_change_5d": q.clip(f"abs(tnx_corr_20d - {q.lag('tnx_corr_20d', 5)})", 0, 1),
    "irx_corr_change_5d": q.clip(f"abs(irx_corr_20d - {q.lag('irx_corr_20d', 5)})", 0, 1),
    "cross_asset_coupling_change": q.clip(f"abs(risk_onoff_factor - {q.lag('risk_onoff_factor', 5)})", 0, 1),
    "risk_offness": q.clip("(0.5 - risk_onoff_factor) / 0.5", 0, 1),
}


@plan("cross_asset_family", 157, names([k for k in _a2 if k != "bchg"] + ["beta_20d", "risk_onoff_factor", *_a3]), select_with(_a3, "ca3"))
def _(t):
    r = SYM
    m = t.macro_series().select("date", r.pct("dollar").alias("qqq_ret"), "vix", F.col("ust10y").alias("tnx"), F.col("ust2y").alias("irx"), "hyg", F.col("tlt").alias("lqd"), F.col("dollar").alias("uup"))
    return op.cross_asset_family(t.rets(), m.join(t.market().withColumnRenamed("mkt", "spy_ret"), "date", "left"))


q.cte("tenors", "SELECT 'VIX' AS symbol, date, 0.9 * vix + 0.1 * dollar AS vix9d, vix, vix3m, (vix + vix3m) / 2 + 0.2 * dollar AS vix6m, dollar AS rv FROM macro")
q.cte("vt1", "SELECT *, vix9d - vix AS s1, vix - vix3m AS s2, vix - vix6m AS s3, (vix6m - vix) - (vix - vix9d) AS cv, vix9d - vix3m AS fb, vix9d / (vix + 1e-9) AS pp, vix - rv AS vrp, (vix - rv) / (rv + 1e-9) AS vrpp FROM tenors")
_vt = {
    "vxst_vix_term_slope": q.clip(softz("s1", 252, 60), -3, 3),
    "vix_vxv_term_slope": q.clip(softz("s2", 252, 60), -3, 3),
    "vix_vxmt_term_slope": q.clip(softz("s3", 252, 60), -3, 3),
    "normalized_term_slope": "(vix6m - vix) / (vix6m + vix + 1e-9)",
    "vix_term_curvature": softz("cv", 252, 60),
    "front_back_spread": softz("fb", 252, 60),
    "panic_premium": softz("pp", 252, 60),
    "vix_roll_yield": "(vix3m - vix) / (vix + 1e-9)",
    "vix_ratio_term": "vix3m / (vix + 1e-9)",
    "vix_contango_strength": "(vix3m - vix) / (vix + 1e-9)",
    "vol_risk_premium": q.clip(softz("vrp", 252, 60), -3, 3),
    "vol_risk_premium_pct": q.clip(softz("vrpp", 252, 60), -3, 3),
}
q.cte("vt2", select_with(_vt, "vt1"))
_vt2 = {
    "vix_term_slope_change_1d": f"vix_vxv_term_slope - {q.lag('vix_vxv_term_slope')}",
    "vix_term_slope_change_5d": f"vix_vxv_term_slope - {q.lag('vix_vxv_term_slope', 5)}",
    "vix_curvature_change": f"vix_term_curvature - {q.lag('vix_term_curvature')}",
    "panic_premium_change": f"panic_premium - {q.lag('panic_premium')}",
}


@plan("vix_term_structure", 158, names([*_vt, *_vt2]), select_with(_vt2, "vt2"))
def _(t):
    m = t.macro().select(
        F.lit("VIX").alias("symbol"), "date", (0.9 * F.col("vix") + 0.1 * F.col("dollar")).alias("vix9d"), "vix", "vix3m",
        ((F.col("vix") + F.col("vix3m")) / 2 + 0.2 * F.col("dollar")).alias("vix6m"), F.col("dollar").alias("rv"),
    )
    return op.vix_term_structure(m, SYM)


q.cte("ab1", f"SELECT *, {q.pct('close')} AS r1 FROM bars")


def _block(days):
    up, dn = "(CASE WHEN r1 IS NOT NULL THEN greatest(r1, 0) END)", "(CASE WHEN r1 IS NOT NULL THEN -least(r1, 0) END)"
    out = {f"return_{n}d": q.rsum("r1", n) for n in (5, 20, 60)} | {f"vol_{n}d": f"{q.std('r1', n)} * sqrt({days})" for n in (20, 60)}
    out["strength_14d"] = f"{q.mean(up, 14)} / ({q.mean(dn, 14)} + 1e-8)"
    out["pct_range_60d"] = f"(close - {q.rmin('close', 60)}) / ({q.rmax('close', 60)} - {q.rmin('close', 60)} + 1e-8)"
    return out


_b252, _b365 = _block(252), _block(365)


@plan("commodity_block", 159, names(_b252), q.select(_b252, "ab1"))
def _(t):
    return op.asset_block(t.bars())


@plan("crypto_block", 161, names(_b365), q.select(_b365, "ab1"))
def _(t):
    return op.asset_block(t.bars(), days_per_year=365)


q.cte("basket", f"SELECT 'METALS' AS symbol, date, avg(close) AS level FROM bars GROUP BY date")
q.cte("basket_r", f"SELECT *, {q.pct('level')} AS r1 FROM basket")
_bk = {"level": "level", "return_20d": q.rsum("r1", 20), "vol_20d": f"{q.std('r1', 20)} * sqrt(252)"}


@plan("commodity_basket", 159, names(_bk), q.select(_bk, "basket_r"))
def _(t):
    return op.equal_weight_basket(t.bars(), "METALS")


q.cte("usd", "SELECT 'USD_INDEX' AS symbol, date, sum(CASE WHEN symbol < 'Brand#2' THEN r1 ELSE -r1 END) / count(*) AS usd_strength FROM ab1 GROUP BY date")
_us = {"usd_strength": "usd_strength", "change_5d": q.rsum("usd_strength", 5), "change_20d": q.rsum("usd_strength", 20)}


@plan("fx_block", 160, names(_b252), q.select(_b252, "ab1"))
def _(t):
    return op.asset_block(t.bars())


@plan("fx_dollar_index", 160, names(_us), q.select(_us, "usd"))
def _(t):
    return op.dollar_index(t.bars(), F.col("symbol") < "Brand#2")


q.cte("vl1", f"SELECT *, r1 * r1 AS last_shock FROM ab1")
q.cte("vl2", f"SELECT *, {q.mean('last_shock', 15, 5)} AS vs, {q.mean('last_shock', 60, 10)} AS vm, {q.mean('last_shock', 30, 10)} AS vl FROM vl1")
q.cte(
    "vl3",
    f"SELECT *, sqrt(vs) * sqrt(252) AS short_vol, sqrt(vm) * sqrt(252) AS mid_vol_60, sqrt(vl) * sqrt(252) AS long_vol, "
    f"coalesce(vl * 0.05 + 0.05 * {q.lag('last_shock')} + 0.9 * {q.lag('vs')}, vs) AS garch_cond_var FROM vl2",
)
_v3 = {
    "vol_ratio": "short_vol / (long_vol + 1e-6) - 1",
    "vol_slope_short_mid": "(short_vol - mid_vol_60) / (mid_vol_60 + 1e-6)",
    "vol_slope_mid_long": "(mid_vol_60 - long_vol) / (long_vol + 1e-6)",
    "vol_of_vol_20": q.std("short_vol", 20, 5),
    "garch_persistence": "0.95",
    "garch_half_life": f"{math.log(0.5) / math.log(0.95)!r}",
    "garch_long_run_var": "vl * 0.05 / (0.05 + 1e-9)",
    "garch_std_resid_sq": "pow(r1 / (sqrt(garch_cond_var) + 1e-9), 2)",
    "neg_shock_dummy": q.flag("r1 < 0 AND abs(r1) > sqrt(vs)"),
    "asym": "CASE WHEN r1 IS NOT NULL AND vs IS NOT NULL THEN least(r1, 0) / (sqrt(vs) + 1e-9) - greatest(r1, 0) / (sqrt(vs) + 1e-9) END",
    "short_vol_z_252": softz("short_vol", 252, 60),
    "long_vol_z_252": softz("long_vol", 252, 60),
}
q.cte("vl4", select_with(_v3, "vl3"))
_v4 = {
    "vol_of_vol_ratio": "vol_of_vol_20 / (long_vol + 1e-6)",
    "shock_asymmetry_20": q.mean("asym", 20, 5),
    "vol_low_regime": q.flag("short_vol_z_252 < -0.5"),
    "vol_high_regime": q.flag("short_vol_z_252 > 0.5"),
    "vol_spike_flag": q.flag(f"short_vol_z_252 > 2 AND last_shock > {q.quant('last_shock', 0.95, 252, 60)}"),
    "vol_crush_flag": q.flag(f"short_vol_z_252 < -2 AND last_shock < {q.quant('last_shock', 0.1, 20, 5)}"),
}


@plan("volatility_ladder", 162, names(["short_vol", "mid_vol_60", "long_vol", "last_shock", "garch_cond_var", *[k for k in _v3 if k != "asym"], *_v4]), select_with(_v4, "vl4"))
def _(t):
    return op.volatility_ladder(t.bars())


_up, _dn = "(CASE WHEN r1 IS NOT NULL THEN greatest(r1, 0) END)", "(CASE WHEN r1 IS NOT NULL THEN -least(r1, 0) END)"
_vd = {"vol_diff": f"({q.std('r1', 20)} - {q.std('r1', 60)}) * sqrt(252)", "skew_proxy": f"({q.std(_dn, 60)} - {q.std(_up, 60)}) * sqrt(252)"}


@plan("vol_difference_skew", (163, 164), names(_vd), q.select(_vd, "ab1"))
def _(t):
    return op.vol_difference_and_skew(t.bars())


q.cte("an0", f"SELECT *, {q.ewm_adj('close', 2 / 253, '(rn-1)')} AS e252r, {q.ewm_adj('close', 2 / 64, '(rn-1)')} AS e63r FROM numbered")
q.cte(
    "an1",
    f"""SELECT symbol, date, close AS p, CASE WHEN rn >= 100 THEN e252r END AS e252, CASE WHEN rn >= 20 THEN e63r END AS e63, {q.pct('close')} AS r1,
    {q.pct('close', 21)} AS m1, {q.pct('close', 63)} AS m3, {q.std('close', 21, 10)} AS s21, {q.std('close', 63, 20)} AS s63, 1.5 * {q.std('close', 252, 100)} AS band,
    (close - {q.lag('close', 21)}) / 21 AS sl, {q.mean('close', 20, 10)} AS ma20, {q.mean('close', 63, 20)} AS ma63 FROM an0""",
)
_rv, _dv, _v63 = f"({q.std('r1', 21, 10)} * sqrt(252))", f"({q.std('(CASE WHEN r1 IS NOT NULL THEN least(r1, 0) END)', 21, 10)} * sqrt(252))", f"({q.std('r1', 63, 20)} * sqrt(252))"
_u, _d = "((e252 + band - p) / (p + 1e-9))", "((p - e252 + band) / (p + 1e-9))"
_skew = f"(({_u} - {_d}) / ({_u} + {_d} + 1e-9))"
_an = {
    "price_to_fairvalue_1y": "p / (e252 + 1e-9)",
    "price_to_fairvalue_3m": "p / (e63 + 1e-9)",
    "price_regime": "p / (ma20 + 1e-9)",
    "log_p2fv_1y": "ln(p / (e252 + 1e-9))",
    "log_p2fv_3m": "ln(p / (e63 + 1e-9))",
    "log_price_regime": "ln(p / (ma20 + 1e-9))",
    "overextension": q.clip("ln(p / (e252 + 1e-9))", 0, 1),
    "undervaluation": q.clip("ln(p / (e252 + 1e-9))", -1, 0),
    "mom_1m": f"p / ({q.lag('p', 21)} + 1e-9)",
    "mom_3m": f"p / ({q.lag('p', 63)} + 1e-9)",
    "mom_12m": f"p / ({q.lag('p', 252)} + 1e-9)",
    "mom_vol_adjusted": q.clip(f"m1 / ({_rv} + 1e-9)", -10, 10),
    "mom_sharped": q.clip(f"m1 / ({_dv} + 1e-9)", -10, 10),
    "zscore_1m": f"(p - {q.mean('p', 21, 10)}) / (s21 + 1e-9)",
    "zscore_3m": "(p - ma63) / (s63 + 1e-9)",
    "trend_slope_1m": "sl / (p + 1e-9)",
    "trend_stability": "abs(sl) / (s21 + 1e-9)",
    "vol_adjusted_value": f"p / (ma63 + 1e-9) / ({_v63} + 1e-9)",
    "value_momentum_ratio": f"m3 / ({_v63} + 1e-9)",
    "scenario_spread": "2 * band / (e252 + 1e-9)",
    "scenario_skew": _skew,
    "downside_skew_stress": q.clip(f"-{_skew}", 0, 1),
    "scenario_position": "(p - e252 + band) / (2 * band + 1e-9)",
    "terminal_value_pct": f"{q.mean('p', 252, 100)} / (ma63 + 1e-9)",
}
q.cte("an2", q.select(_an, "an1"))


@plan("price_anchors", 165, names(_an), q.select({k: q.nz(q.ffill(k)) for k in _an}, "an2"))
def _(t):
    return op.price_anchors(t.bars())


_be = {"spread_20": q.nz(q.mean("(ret - spy)", 20))}
for _b in ("spy", "qqq", "vxx", "sector"):
    _be[f"corr_{_b}_120"] = q.nz(q.corr("ret", _b, 120))
    _be[f"beta_{_b}_120"] = q.nz(f"{q.cov('ret', _b, 120)} / ({q.agg('var_samp', _b, 120)} + 1e-6)")


@plan(
    "benchmark_exposures",
    166,
    names(_be),
    q.select(_be, "(SELECT * FROM rets JOIN benches USING (date) WHERE ret IS NOT NULL AND spy IS NOT NULL AND qqq IS NOT NULL AND vxx IS NOT NULL AND sector IS NOT NULL)"),
)
def _(t):
    return op.benchmark_exposures(t.rets(), benches(t), ["spy", "qqq", "vxx", "sector"])


q.cte("tp1", f"SELECT *, coalesce({q.pct('close')}, 0) AS r1, {q.mean('close', 10, 5)} AS ms, {q.mean('close', 30, 15)} AS ml FROM numbered")
q.cte(
    "tp2",
    f"SELECT *, ml - {q.lag('ml', 10)} AS dl, coalesce({q.std('r1', 10, 5)}, 0) AS vol_short, coalesce({q.std('r1', 30, 15)}, 0) AS vol_long, abs(sin((rn - 1) * (pi() / 10)) * r1) AS sa FROM tp1",
)
_tp = {
    "vol_short": "vol_short",
    "vol_long": "vol_long",
    "trend_short_strength": f"coalesce((ms - {q.lag('ms', 5)}) / close, 0)",
    "trend_long_strength": "coalesce(dl / close, 0)",
    "trend_consistency": q.nz(q.mean(q.flag("r1 > 0"), 20, 10), 0.5),
    "trend_signal_to_noise": f"coalesce(abs(dl) / ({q.std('r1', 20, 10)} * close + 1e-8), 0)",
    "vol_regime_zscore": q.nz(softz("vol_long", 252, 60, "1e-8", q.quant("vol_long", 0.5, 252, 60))),
    "vol_trend": f"coalesce(vol_long - {q.lag('vol_long', 10)}, 0)",
    "weekday_effect": "coalesce(CASE WHEN rn > 126 THEN avg(r1) OVER (PARTITION BY symbol, isodow(date) ORDER BY rn RANGE BETWEEN 126 PRECEDING AND 1 PRECEDING) END, 0)",
    "month_phase": q.clip("(day(date) - 15) / 15.0", -1, 1),
    "seasonality_importance": q.nz(q.mean("sa", 20, 10)),
    "stability_short": f"coalesce(1 / (1 + {q.mean('abs(r1)', 10, 5)}), 0)",
    "stability_long": f"coalesce(1 / (1 + {q.mean('abs(r1)', 30, 15)}), 0)",
    "sl_raw": f"1 / (1 + {q.mean('abs(r1)', 30, 15)})",
    "rn": "rn",
}
q.cte("tp3", q.select(_tp, "tp2"))
_sg = lambda x: f"(1 / (1 + exp(-{q.clip(x, -10, 10)})))"
_conf = f"coalesce({q.clip(f'0.3 + 0.4 * {_sg("-abs(vol_regime_zscore)")} + 0.3 * {_sg("trend_signal_to_noise - 0.5")} * sl_raw', 0, 1)}, 0.5)"


@plan(
    "temporal_patterns",
    167,
    names([k for k in _tp if k not in ("sl_raw", "rn")] + ["trend_importance", "confidence"]),
    f"SELECT *, (abs(trend_short_strength) + abs(trend_long_strength)) / 2 AS trend_importance, {_conf} * (CASE WHEN rn <= 30 THEN 0.5 ELSE 1 END) AS confidence FROM tp3",
)
def _(t):
    return op.temporal_patterns(t.bars())


q.cte("rg1", f"SELECT *, {q.mean('close', 20)} AS f, {q.mean('close', 60)} AS s, coalesce({q.pct('close')}, 0) AS r1, coalesce({q.pct('close', 60)}, 0) AS m60 FROM numbered")
q.cte("rg2", f"SELECT *, (f - {q.lag('f')}) / nullif(f, 0) AS df, (f - s) / (s + 1e-6) AS tr FROM rg1")
q.cte("rg3", f"SELECT *, 4 * tr + 2 * coalesce({q.mean('df', 5)}, 0) + m60 AS act, {q.std('r1', 20)} * sqrt(252) AS v20, {softz('tr', 252, 60, '1e-6')} AS trz FROM rg2")
q.cte("rg4", "SELECT *, 1 / (1 + exp(-act)) AS bull, 1 / (1 + exp(act)) AS bear FROM rg3")
q.cte("rg5", f"SELECT *, {q.clip('1 - ' + q.clip('bull + bear', 0, 1), 0, 1)} AS neu FROM rg4")
q.cte("rg6", "SELECT *, CASE WHEN bear >= neu AND bear >= bull THEN 0 WHEN neu >= bull AND neu > bear THEN 1 WHEN bull IS NOT NULL THEN 2 END AS lab FROM rg5")
q.cte("rg7", f"SELECT *, CASE WHEN rn = 1 OR lab IS DISTINCT FROM {q.lag('lab')} THEN 1 ELSE 0 END AS chg FROM rg6")
q.cte("rg8", f"SELECT *, sum(chg) OVER {q.over()} AS spell FROM rg7")
q.cte("rg9", "SELECT *, row_number() OVER (PARTITION BY symbol, spell ORDER BY date) - 1 AS pos FROM rg8")


@plan(
    "regime_probabilities",
    168,
    "symbol date regime_bull_probability regime_bear_probability regime_neutral_probability regime_label regime_duration regime_change_flag regime_trend_ratio regime_trend_ratio_zscore regime_volatility_20d",
    f"""SELECT symbol, date, coalesce(bull, 0) AS regime_bull_probability, coalesce(bear, 0) AS regime_bear_probability, coalesce(neu, 0) AS regime_neutral_probability,
    coalesce(lab, 0) AS regime_label, CASE WHEN lab IS NULL THEN 0 ELSE least(pos, 250) END AS regime_duration,
    max(CASE WHEN chg = 1 OR lab IS NULL THEN 1 ELSE 0 END) OVER {q.over(6)} AS regime_change_flag, coalesce(tr, 0) AS regime_trend_ratio,
    coalesce(trz, 0) AS regime_trend_ratio_zscore, coalesce(v20, 0) AS regime_volatility_20d FROM rg9""",
)
def _(t):
    return op.regime_probabilities(t.bars())


_f1 = {f"r{k}": q.logret("close", k) for k in (1, 5, 10, 20)} | {"high_low_range_pct": q.div("high - low", "close")}
q.cte("fi1", select_with(_f1, "bars"))
_f2 = {f"realized_vol_{n}": q.std("r1", n, max(3, n // 2)) for n in (5, 10, 20)} | {f"close_vs_sma{n}": f"close / {q.mean('close', n, n // 2)} - 1" for n in (10, 20, 50)}
q.cte("fi2", select_with(_f2, "fi1"))
_f3 = {
    "intraday_range": q.mean("high_low_range_pct", 10, 5),
    "rolling_mean_5": q.mean("r1", 5, 3),
    "rolling_skew_20": q.skew("r1", 20, 10),
    "rolling_kurt_20": q.kurt("r1", 20, 10),
    "volume_zscore": f"(volume - {q.mean('volume', 20, 10)}) / ({q.std('volume', 20, 10)} + 1e-8)",
    "volume_change_pct": q.pct("volume"),
    "low_vol_flag": q.flag(f"realized_vol_20 < {q.quant('realized_vol_20', 0.2, 252, 60)}"),
    "high_vol_flag": q.flag(f"realized_vol_20 > {q.quant('realized_vol_20', 0.8, 252, 60)}"),
    "breakout_flag": q.flag("close_vs_sma20 > 0.02"),
}


@plan("forecast_inputs", 169, names([*_f1, *_f2, *_f3]), select_with(_f3, "fi2"))
def _(t):
    return op.forecast_inputs(t.bars())


q.cte("rd1", f"SELECT symbol, date, ret, {q.mean('ret', 10, 5, 1)} AS fc FROM rets")
q.cte("rd2", "SELECT *, ret - fc AS residual FROM rd1")
_rd = {
    "residual": "residual",
    "abs_residual": "abs(residual)",
    "residual_zscore": softz("residual", 20, 10, "1e-8"),
    "uncertainty_proxy": q.agg("var_samp", "residual", 20, 10),
    "momentum_indicator": "sign(fc)",
}


@plan("residual_diagnostics", 170, names(_rd), q.select(_rd, "rd2"))
def _(t):
    return op.residual_diagnostics(t.rets().withColumn("fc", SYM.mean("ret", 10, 5, shift=1)), "ret", "fc")


q.cte("mcap_points", "SELECT symbol, date, close * 1000 AS market_cap, volume * 50 AS shares_float FROM numbered WHERE rn % 5 = 1 AND rn % 200 < 150")
q.cte("mh1", f"SELECT b.*, market_cap, shares_float FROM bars b LEFT JOIN mcap_points USING (symbol, date)")
q.cte("mh2", f"SELECT *, greatest(coalesce({q.ffill('market_cap', 10)}, 0), 0) AS mcap, coalesce({q.ffill('shares_float', 10)}, 0) AS sf FROM mh1")
q.cte("mh3", "SELECT *, CASE WHEN mcap > 0 THEN ln(mcap) ELSE 0 END AS log_mcap, coalesce(volume / nullif(sf, 0), 0) AS float_turnover FROM mh2")
q.cte("mh4", f"SELECT *, coalesce(log_mcap - {q.lag('log_mcap')}, 0) AS d1 FROM mh3")
_mh = {
    "has_data": q.flag("mcap > 0"),
    "mcap": "mcap",
    "log_mcap": "log_mcap",
    "float_turnover": "float_turnover",
    **{f"mcap_chg_{k}d": f"coalesce(log_mcap - {q.lag('log_mcap', k)}, 0)" for k in (20, 63, 252)},
    "mcap_vol_63d": q.nz(q.std0("d1", 63, 20)),
    "turnover_z_252d": q.nz(q.z("float_turnover", 252, 60, ddof=0)),
}


@plan("market_cap_history", (48, 171), names(_mh), q.select(_mh, "mh4"))
def _(t):
    bars = t.bars()
    rn = SYM.row()
    pts = bars.withColumn("rn", rn).where((F.col("rn") % 5 == 1) & (F.col("rn") % 200 < 150))
    return op.market_cap_history(bars, pts.select("symbol", "date", (F.col("close") * 1000).alias("market_cap"), (F.col("volume") * 50).alias("shares_float")))


q.cte("dividends", "SELECT symbol, date, close * 0.01 AS value FROM numbered WHERE rn % 63 = 10")
q.cte("dv0", "SELECT symbol, quantile_cont(value, 0.99) AS cap FROM dividends GROUP BY symbol")
q.cte("dv1", "SELECT b.*, CASE WHEN value IS NOT NULL THEN least(value, cap) END AS amt, CASE WHEN value IS NOT NULL THEN date END AS ex FROM bars b LEFT JOIN dividends USING (symbol, date) LEFT JOIN dv0 USING (symbol)")
q.cte("dv2", f"SELECT *, coalesce(amt, 0) AS dividend_amount, {q.bfill('ex')} AS nx, last_value(ex IGNORE NULLS) OVER {q.over(None, 1)} AS lx FROM dv1")
q.cte(
    "dv3",
    f"SELECT *, {q.clip("coalesce(date_diff('day', date, nx), -date_diff('day', lx, date), 999)", -30, 30)} AS days_to_ex_dividend, {q.rsum('dividend_amount', 252, 1)} AS dividend_yield_est, "
    f"{q.rsum(q.flag('dividend_amount > 0'), 252, 1)} AS dividend_frequency FROM dv2",
)
_dv2 = {
    "dividend_amount": "dividend_amount",
    "dividend_yield_est": "dividend_yield_est",
    "dividend_frequency": "dividend_frequency",
    "days_to_ex_dividend": "days_to_ex_dividend",
    "ex_dividend_window_strength": "exp(-abs(days_to_ex_dividend) / 2.5)",
    "dividend_event_intensity": "dividend_amount / (close + 1e-9) * exp(-abs(days_to_ex_dividend) / 2.5)",
    "dividend_event_stress": "exp(-abs(days_to_ex_dividend) / 2.5) * least(abs(dividend_amount / (close + 1e-9)), 0.1) * 10",
    "dividend_yield_zscore": q.clip(softz("dividend_yield_est", 252, 20), -3, 3),
}


@plan("dividend_features", (54, 172), names(_dv2), q.select(_dv2, "dv3"))
def _(t):
    bars = t.bars()
    div = bars.withColumn("rn", SYM.row()).where(F.col("rn") % 63 == 10).select("symbol", "date", (F.col("close") * 0.01).alias("value"))
    return op.dividend_features(bars, div)


q.cte(
    "oa1",
    f"SELECT symbol, date, rn, CASE WHEN rn % 5 = 1 THEN 0.2 + 0.01 * volume / 50 END AS atm_iv, CASE WHEN rn % 5 = 1 THEN (high - low) / close END AS iv_skew, CASE WHEN rn % 5 = 1 THEN open / close END AS put_call FROM numbered",
)
q.cte(
    "oa2",
    f"SELECT symbol, date, rn, rn - last_value(CASE WHEN atm_iv IS NOT NULL THEN rn END IGNORE NULLS) OVER {q.over()} AS dsu, {q.ffill('atm_iv')} AS atm_iv, {q.ffill('iv_skew')} AS iv_skew, {q.ffill('put_call')} AS put_call FROM oa1",
)


def _zz(x, n, mp):
    return f"(CASE WHEN {q.std(x, n, mp)} > 1e-9 THEN ({x} - {q.mean(x, n, mp)}) / {q.std(x, n, mp)} END)"


_oa = {
    "atm_iv": "atm_iv",
    "days_since_update": "dsu",
    "put_call_ewm": q.ewm("put_call", 2 / 11, "(rn-1)"),
    "iv_anchor_z20": _zz("atm_iv", 20, 5),
    "iv_percentile_30d": q.pct_rank("atm_iv", 30, 10),
    "iv_percentile_1y": q.pct_rank("atm_iv", 252, 60),
    "skew_z30": _zz("iv_skew", 30, 10),
    "staleness_decay": "pow(2.0, -dsu / 5.0)",
}


@plan("options_anchor", 173, names(_oa), q.select(_oa, "oa2"))
def _(t):
    b = t.bars().withColumn("rn", SYM.row())
    on = F.col("rn") % 5 == 1
    daily = b.select(
        "symbol", "date",
        F.when(on, 0.2 + 0.01 * F.col("volume") / 50).alias("atm_iv"),
        F.when(on, ratio(F.col("high") - F.col("low"), "close")).alias("iv_skew"),
        F.when(on, ratio("open", "close")).alias("put_call"),
    )
    return op.options_anchor(daily)
