"""Plans: bar shape, microstructure, anomalies and downside features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.windows import SYM, Roll
from barloom.operators import indicators as ind
from barloom.operators import price_action as op
from barloom.plans import duck as q
from barloom.plans.indicators import TR
from barloom.plans.registry import plan


def names(d):
    return "symbol date " + " ".join(d)


@plan("true_range", 139, "symbol date tr", f"SELECT symbol, date, {TR} AS tr FROM bars")
def _(t):
    return t.bars().withColumn("tr", ind.true_range())


LR = f"coalesce({q.logret('close')}, 0)"
q.cte("cm1", f"SELECT *, {TR} AS tr, {q.lag('close')} AS pc, abs(high - low) AS rng, close - open AS body, {LR} AS logret_1d FROM bars")
q.cte("cm2", f"SELECT *, {q.mean('tr', 14, 1)} AS a14, {q.mean('tr', 60, 1)} AS a60 FROM cm1")
q.cte("cm3", f"SELECT *, coalesce({q.lag('a14')}, a14) AS p14, coalesce({q.lag('a60')}, a60) AS p60 FROM cm2")


def _atr(x, cap):
    return q.nz(q.clip(f"({x}) / (p14 + 1e-12)", -cap, cap))


def _rng(x, lo, hi):
    return q.nz(q.clip(f"({x}) / (rng + 1e-12)", lo, hi))


def _z20(x):
    m, s = q.mean(x, 20, 1, 1), q.std0(x, 20, 1, 1)
    return q.nz(q.clip(f"CASE WHEN {s} > 1e-12 THEN ({x} - {m}) / ({s} + 1e-12) END", -8, 8))


_candle = {
    "has_data": "1.0",
    "close_pos": q.nz(q.clip("(close - low) / (rng + 1e-12)", 0, 1) + " * 2 - 1"),
    "body_pct_range": _rng("body", -5, 5),
    "upper_wick_pct_range": _rng("high - greatest(open, close)", 0, 5),
    "lower_wick_pct_range": _rng("least(open, close) - low", 0, 5),
    "wick_imbalance": _rng("high - greatest(open, close) - least(open, close) + low", -5, 5),
    "body_atr14": _atr("body", 10),
    "range_atr14": _atr("rng", 20),
    "gap_atr14": _atr("open - pc", 10),
    "close_vs_prev_close_atr14": _atr("close - pc", 10),
    "high_vs_prev_close_atr14": _atr("high - pc", 10),
    "low_vs_prev_close_atr14": _atr("low - pc", 10),
    "logret_1d": "logret_1d",
    "ret_1d": q.nz(q.pct("close")),
    "ret_5d": q.nz(q.pct("close", 5)),
    "rv_5": q.std0("logret_1d", 5, 1),
    "rv_20": q.std0("logret_1d", 20, 1),
    "trend_3": q.rsum("logret_1d", 3, 1),
    "trend_5": q.rsum("logret_1d", 5, 1),
    "sign_sum_3": q.rsum("sign(logret_1d)", 3, 1),
    "sign_sum_5": q.rsum("sign(logret_1d)", 5, 1),
    "dist_to_high_20_atr14": _atr(f"close - {q.rmax('high', 20, 1, 1)}", 20),
    "dist_to_low_20_atr14": _atr(f"close - {q.rmin('low', 20, 1, 1)}", 20),
    "dist_to_mean_20_atr14": _atr(f"close - {q.mean('close', 20, 1, 1)}", 20),
    "rng_z_20": _z20("rng"),
    "body_z_20": _z20("body"),
    "inside_bar": q.flag(f"high <= {q.lag('high')} AND low >= {q.lag('low')}"),
    "outside_bar": q.flag(f"high >= {q.lag('high')} AND low <= {q.lag('low')}"),
    "dir_change": q.flag(f"sign(body) <> coalesce(sign({q.lag('close')} - {q.lag('open')}), 0)"),
    "vol_log_chg": q.nz(q.clip(f"ln(volume + 1) - ln({q.lag('volume')} + 1)", -10, 10)),
    "atr_ratio_14_60": q.nz(q.clip("p14 / (p60 + 1e-12)", 0, 5), 1),
    "vol_ratio_20": q.nz(q.clip(f"volume / ({q.mean('volume', 20, 1, 1)} + 1e-12)", 0, 20), 1),
    "dow_sin": "sin((isodow(date) - 1) * (2 * pi() / 7))",
    "dow_cos": "cos((isodow(date) - 1) * (2 * pi() / 7))",
    "moy_sin": "sin((month(date) - 1) * (2 * pi() / 12))",
    "moy_cos": "cos((month(date) - 1) * (2 * pi() / 12))",
}


@plan("candle_mechanics", (138, 388), names(_candle), q.select(_candle, "cm3"))
def _(t):
    return op.candle_mechanics(t.bars())


q.cte("ms1", f"SELECT *, {TR} AS tr, high - low AS hl, {q.pct('close')} AS r1, {q.lag('close')} AS pc FROM bars")
q.cte("ms2", f"SELECT *, {q.std('r1', 5, 2)} AS vol5, open - pc AS gap FROM ms1")
_vm = q.mean("volume", 20, 5)
_dsr = "(close - low) / (high - close + 1e-9)"
_micro = {
    "true_range": "tr",
    "atr_ratio": q.div(q.mean("tr", 14, 5), "close"),
    "range_pct": q.div("hl", "close"),
    "body_pct": q.div("abs(close - open)", "close"),
    "wick_top": q.div("high - greatest(open, close)", "close"),
    "wick_bottom": q.div("least(open, close) - low", "close"),
    "shadow_ratio": "(high - greatest(open, close) + least(open, close) - low) / (abs(close - open) + 1e-9)",
    "range_scaled": f"hl / ({q.mean('tr', 14, 5)} + 1e-9)",
    "volume_zscore": f"(volume - {_vm}) / ({q.std('volume', 20, 5)} + 1e-9)",
    "volume_surge": f"volume / ({_vm} + 1e-9)",
    "volume_liquidity": "volume * hl",
    "turnover": "volume * close",
    "amihud": "abs(r1) / (volume + 1e-9) * 1e6",
    "hl_volume_corr": q.corr("hl", "volume", 20, 5),
    "ofi_proxy": "sign(close - open) * volume",
    "signed_volume": "volume * r1",
    "pressure_proxy": "(close - open) / (hl + 1e-9)",
    "demand_supply_ratio": _dsr,
    "liquidity_imbalance": _dsr + " - 0.5",
    "impact_ratio": "hl / (volume + 1e-9) * 1e9",
    "impact_volatility": "vol5 / (volume + 1e-9) * 1e9",
    "spread_proxy": "hl / (volume + 1e-9) * 1e11",
    "vol_of_vol": q.std("vol5", 5, 2),
    "intraday_vol_proxy": "hl / (open + 1e-9)",
    "stale_tick": q.flag("high = low"),
    "zero_range_flag": q.flag("high = low"),
    "low_liquidity_flag": q.flag(f"volume < {_vm} * 0.3"),
    "overnight_gap": "gap",
    "overnight_vol": "abs(gap) / (pc + 1e-9)",
    "intraday_vs_overnight_vol": "hl / (abs(gap) + 1e-9)",
    "gap_direction": "sign(gap)",
}
q.cte("ms3", q.select(_micro, "ms2"))


@plan("microstructure_daily", 140, names(_micro), q.select({k: q.nz(q.ffill(k)) for k in _micro}, "ms3"))
def _(t):
    return op.microstructure_daily(t.bars())


def _zu(x, n):
    return f"(({x} - {q.mean(x, n)}) / (CASE WHEN {q.std(x, n)} = 0 THEN 1 ELSE {q.std(x, n)} END))"


q.cte("pa1", f"SELECT *, {q.div(f'open - {q.lag('close')}', q.lag('close'))} * 100 AS onr, {q.pct('close')} AS r1, pow(ln(high / nullif(low, 0)), 2) AS hl2 FROM bars")
q.cte("pa2", f"SELECT *, ({q.mean('r1', 3)} - {q.mean('r1', 10)}) * 100 AS sd FROM pa1")
_pa = {
    "overnight_return": "onr",
    "gap_up_pct": "CASE WHEN onr IS NOT NULL THEN greatest(onr, 0) END",
    "gap_down_pct": "CASE WHEN onr IS NOT NULL THEN abs(least(onr, 0)) END",
    "intraday_range_pct": q.div("high - low", "close") + " * 100",
    "high_low_volatility_ratio": f"{q.mean('hl2', 20)} * sqrt(252 / (4 * ln(2))) * 100",
    "trend_acceleration": _zu("sd", 60),
    "mean_reversion_signal": q.clip(_zu("close", 20), -3, 3),
}


@plan("price_anomalies", 141, names(_pa), q.select(_pa, "pa2"))
def _(t):
    return op.price_anomalies(t.bars())


q.cte("va1", f"SELECT *, {q.pct('close')} AS pr, {q.pct('volume')} AS vr, {q.div('high - low', 'close')} * 100 AS sp FROM numbered")
_va = {
    "volume_z_20d": q.z("volume", 20),
    "relative_volume_20d": q.div("volume", q.mean("volume", 20)),
    "volume_trend_10d": q.slope("volume", "rn", 10),
    "volume_price_divergence": "CASE WHEN vr > 0 AND pr < 0 THEN vr * abs(pr) WHEN vr < 0 AND pr > 0 THEN -vr * abs(pr) ELSE 0 END",
    "buy_volume_proxy": "sign(close - open) * volume",
    "liquidity_stress_pct": f"{q.pct_rank('sp', 20)} * 100",
}


@plan("volume_anomalies", 142, names(_va), q.select(_va, "va1"))
def _(t):
    return op.volume_anomalies(t.bars())


q.cte("rv1", f"SELECT *, {q.pct('close')} AS r1, {q.div('close - open', 'open')} AS oc FROM bars")
_rv = {f"rv_{n}d": f"{q.std('r1', n)} * sqrt(252) * 100" for n in (5, 10, 20)}
_rv["rv_ratio_5_20"] = q.div(q.std("r1", 5), q.std("r1", 20))
_rv["close_to_close_volatility"] = f"{q.std('r1', 20)} * sqrt(252) * 100"
_rv["open_to_close_volatility"] = f"{q.std('oc', 20)} * sqrt(252) * 100"


@plan("realized_volatility", 143, names(_rv), q.select(_rv, "rv1"))
def _(t):
    return op.realized_volatility(t.bars())


q.cte("macro_mkt", "SELECT * FROM macro LEFT JOIN market USING (date)")
q.cte(
    "mi1",
    f"SELECT symbol, date, {q.div(f'open - {q.lag('close')}', q.lag('close'))} * 100 AS onr, {q.div('high - low', 'close')} * 100 AS rg, {q.pct('close')} AS r1, "
    "vix, mkt FROM bars LEFT JOIN macro_mkt USING (date)",
)
q.cte("mi2", f"SELECT *, {q.ffill('vix')} AS vx FROM mi1")
q.cte("mi3", f"SELECT *, {q.pct('vx', 5)} AS dv, (CASE WHEN {q.beta('r1', 'mkt', 20)} IS NOT NULL THEN {q.beta('r1', 'mkt', 20)} END) AS b FROM mi2")
_mi = {
    "gap_vs_vix_interaction": f"abs(onr) * {q.clip('(vx - 10) / 70', 0, 1)}",
    "overnight_return_z": _zu("onr", 60),
    "intraday_range_z": _zu("rg", 60),
    "beta_vix_interaction": "b * dv",
}
_mi = {k: q.clip(q.nz(v), -5, 5) for k, v in _mi.items()}


@plan("macro_interactions", 144, names(_mi), q.select(_mi, "mi3"))
def _(t):
    return op.macro_interactions(t.bars(), t.macro().join(t.market(), "date", "left"))


_cb = {"corr": q.corr("ret", "mkt", 20), "beta": q.beta("ret", "mkt", 20)}


@plan("rolling_corr_beta", (145, 146), names(_cb), q.select(_cb, "(SELECT * FROM rets JOIN market USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL)"))
def _(t):
    return op.rolling_corr_beta(t.rets(), t.market())


q.cte(
    "es1",
    f"""SELECT *, {q.pct('close')} AS r1, row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) AS mrn,
    count(*) OVER (PARTITION BY symbol, date_trunc('month', date)) AS mcnt,
    date_trunc('month', date) = date_trunc('month', max(date) OVER (PARTITION BY symbol)) AS open_end FROM numbered""",
)
q.cte("es2", f"SELECT *, {q.std('r1', 20)} * sqrt(252) * 100 AS vol FROM es1")
q.cte(
    "es3",
    """SELECT b.*, (SELECT min(event_date) FROM urgent u WHERE u.symbol = b.symbol AND u.event_date > b.date) AS nxt,
    (SELECT max(event_date) FROM urgent u WHERE u.symbol = b.symbol AND u.event_date <= b.date) AS lst FROM es2 b""",
)
# the session nearest to each event, later one on ties
q.cte(
    "es4",
    """SELECT symbol, event_date AS lst, arg_min(rn, (abs(date_diff('day', date, event_date)), -rn)) AS arn,
    arg_min(close, (abs(date_diff('day', date, event_date)), -rn)) AS aclose FROM urgent JOIN numbered USING (symbol)
    WHERE abs(date_diff('day', date, event_date)) <= 400 GROUP BY 1, 2""",
)
_es = {
    "turn_of_month_flag": q.flag("mrn <= 3 OR (mrn > mcnt - 3 AND NOT open_end)"),
    "rv_z_20": _zu("vol", 60),
    "days_to_next_earnings": "date_diff('day', date, nxt)",
    "days_since_last_earnings": "date_diff('day', lst, date)",
    "earnings_runup_10d": f"CASE WHEN date_diff('day', date, nxt) BETWEEN 0 AND 10 AND rn > 1 THEN (close / coalesce({q.lag('close', 10)}, first_value(close) OVER (PARTITION BY symbol ORDER BY date)) - 1) * 100 END",
    "post_earnings_drift_5d": "CASE WHEN date_diff('day', lst, date) BETWEEN 0 AND 5 AND arn < rn THEN (close / aclose - 1) * 100 END",
}


@plan("earnings_seasonality", 147, names(_es), q.select(_es, "(SELECT * FROM es3 LEFT JOIN es4 USING (symbol, lst))"))
def _(t):
    return op.earnings_seasonality(t.bars(), t.urgent().select("symbol", F.col("event_date").alias("earnings_date")))


q.cte("mb1", f"SELECT *, {q.div('close - ' + q.rmin('close', 252, 20), 'close')} AS dist_52w_low, {q.pct('close', 10)} AS roc FROM bars")
q.cte("mb2", f"SELECT *, roc - {q.lag('roc', 5)} AS roc_accel FROM mb1")


@plan(
    "momentum_breakdown",
    148,
    "symbol date dist_52w_low roc_accel momentum_breakdown",
    f"SELECT *, {q.flag('dist_52w_low < 0.05 AND roc_accel < -0.01')} AS momentum_breakdown FROM mb2",
)
def _(t):
    return op.momentum_breakdown(t.bars())


def _pos(x, mp=20):
    return f"(({x} - {q.rmin(x, 252, mp)}) / ({q.rmax(x, 252, mp)} - {q.rmin(x, 252, mp)} + 1e-8))"


q.cte("vs1", f"SELECT *, {q.mean('tr', 14)} AS atr FROM tr_bars")
q.cte("vs2", f"SELECT *, {_pos('atr')} AS atr_pct FROM vs1")


@plan(
    "volatility_state",
    149,
    "symbol date atr atr_pct vol_regime",
    "SELECT *, CASE WHEN atr_pct > 0 AND atr_pct <= 0.33 THEN 0 WHEN atr_pct > 0.33 AND atr_pct <= 0.66 THEN 1 WHEN atr_pct > 0.66 AND atr_pct <= 1 THEN 2 END AS vol_regime FROM vs2",
)
def _(t):
    return op.volatility_state(t.bars())


q.cte("gp1", f"SELECT *, {q.div(f'open - {q.lag('close')}', q.lag('close'))} AS gap_pct FROM bars")
_gp = {
    "gap_pct": "gap_pct",
    "gap_down_freq": q.mean(q.flag("gap_pct < 0"), 20),
    "gap_down_severity": f"CASE WHEN count(gap_pct) OVER {q.over(20)} >= 20 THEN coalesce(avg(CASE WHEN gap_pct < 0 THEN gap_pct END) OVER {q.over(20)}, 0) END",
}


@plan("gap_features", 150, names(_gp), q.select(_gp, "gp1"))
def _(t):
    return op.gap_features(t.bars())


@plan(
    "vix_term_slope",
    151,
    "symbol date vix_term_slope vix_term_inverted",
    f"SELECT symbol, date, coalesce(vix - vix3m, 0) AS vix_term_slope, {q.flag('vix > vix3m')} AS vix_term_inverted FROM bars LEFT JOIN macro USING (date)",
)
def _(t):
    return op.vix_term(t.bars(), t.macro())


q.cte("cs1", "SELECT symbol, date, tlt - hyg AS credit_spread FROM macro_series")
_cs = {
    "credit_spread": "credit_spread",
    "credit_spread_widening": q.flag(f"credit_spread - {q.lag('credit_spread', 5)} > 0"),
    "credit_spread_pct": q.nz(_pos("credit_spread"), 0.5),
}


@plan("credit_spread", 152, names(_cs), q.select(_cs, "cs1"))
def _(t):
    return op.credit_spread(t.macro_series(), SYM)


q.cte("mkt20", f"SELECT date, mkt, 'M' AS symbol, sum(ln(1 + mkt)) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20 FROM market WHERE mkt IS NOT NULL")
q.cte("sec20", f"SELECT date, dollar / lag(dollar, 20) OVER (ORDER BY date) - 1 AS s20 FROM macro")
q.cte(
    "rw1",
    f"""SELECT symbol, date, {q.pct('close', 20)} AS r20, {q.pct('close')} AS r1, coalesce(s20, 0) AS s20, coalesce(m20, 0) AS m20, coalesce(mkt, 0) AS mk
    FROM bars LEFT JOIN sec20 USING (date) LEFT JOIN (SELECT date, mkt, m20 FROM mkt20) USING (date)""",
)
q.cte("rw2", f"SELECT *, r20 - s20 AS rel_perf_sector, r20 - m20 AS rel_perf_benchmark, {q.beta('r1', 'mk', 20)} AS beta_20 FROM rw1")


@plan(
    "relative_weakness",
    153,
    "symbol date rel_perf_sector rel_perf_benchmark beta_20 beta_drift",
    f"SELECT *, beta_20 - {q.lag('beta_20', 5)} AS beta_drift FROM rw2",
)
def _(t):
    series = Roll("k", "date")
    m = t.market().where("mkt IS NOT NULL").withColumn("k", F.lit(0))
    bench = m.select("date", F.sum(F.ln(1 + F.col("mkt"))).over(series.frame(20)).alias("benchmark_return_20"), F.col("mkt").alias("benchmark_return_daily"))
    sector = t.macro().withColumn("k", F.lit(0)).select("date", (ratio("dollar", series.lag("dollar", 20)) - 1).alias("sector_return_20"))
    return op.relative_weakness(t.bars(), sector, bench)


q.cte("eu1", f"SELECT *, {q.pct('close')} AS r1 FROM numbered JOIN updown USING (symbol, date, rn)")
q.cte(
    "eu2",
    f"SELECT *, {q.std('r1', 20)} AS v, 100 - 100 / (1 + {q.mean('up', 14)} / (CASE WHEN {q.mean('dn', 14)} = 0 THEN 1e-9 ELSE {q.mean('dn', 14)} END)) AS rsi, {q.mean('close', 200)} AS ma FROM eu1",
)


@plan(
    "euphoria_index",
    154,
    "symbol date euphoria_index",
    f"""SELECT symbol, date, 0.4 * {q.clip('coalesce((close - ma) / ma, 0) * 500', 0, 100)} + 0.4 * coalesce({q.clip('(rsi - 50) / 20 * 100', 0, 100)}, 0)
    + 0.2 * (1 - coalesce({q.pct_rank('v', 252)}, 0.5)) * 100 AS euphoria_index FROM eu2""",
)
def _(t):
    return op.euphoria_index(t.bars())


q.cte("tk1", f"SELECT b.*, {q.pct('close')} AS r1, vix FROM bars b LEFT JOIN macro USING (date)")
q.cte("tk2", f"SELECT *, {q.ffill('vix')} AS vx, {q.std('r1', 20)} AS v FROM tk1")
q.cte("tk3", f"SELECT *, vx - {q.lag('vx')} AS dv, {q.flag(f'v - {q.lag('v')} > 0')} AS up FROM tk2")


@plan(
    "tail_risk",
    155,
    "symbol date tail_risk",
    f"""SELECT symbol, date, 0.4 * (coalesce({q.clip('(vx - 15) / 15 * 100', 0, 100)}, 0) + coalesce({q.clip(q.clip('dv', -10, 10) + ' / 10 * 50', 0, 50)}, 0))
    + 0.3 * coalesce({q.rsum('up', 10)} / 10 * 100, 0) + 0.3 * {q.clip(f'(-coalesce(close / {q.rmax('high', 252)} - 1, 0) - 0.05) / 0.15 * 100', 0, 100)} AS tail_risk FROM tk3""",
)
def _(t):
    return op.tail_risk(t.bars(), t.macro())
