"""Plans over daily bars: returns and technical indicators."""

from __future__ import annotations

from barloom.operators import indicators as op
from barloom.plans import duck as q
from barloom.plans.registry import plan

TR = f"greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')}))"
q.cte("numbered", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars")


def wilder_sql(src: str, x: str, n: int, first: int | None = None) -> str:
    """Seeded Wilder smoothing of column x of src (which has rn): seed row `first` holds the plain mean."""
    first = n if first is None else first
    i = f"(rn - {first})"
    a, qv = repr(1 / n), f"{1 - 1 / n!r}::DOUBLE"
    seeded = f"(CASE WHEN rn = {first} THEN {q.mean(x, n)} WHEN rn > {first} THEN {x} END)"
    return (
        f"SELECT *, CASE WHEN rn >= {first} THEN pow({qv}, {i}) * sum(sd * (CASE WHEN rn = {first} THEN 1.0::DOUBLE ELSE {a}::DOUBLE END) * pow({qv}, -{i})) "
        f"OVER {q.over()} END AS sm_{x} FROM (SELECT *, {seeded} AS sd FROM {src})"
    )


@plan("close_to_close_returns", 125, "symbol date ret", f"SELECT symbol, date, coalesce({q.pct('close')}, 0) AS ret FROM bars")
def _(t):
    return op.close_to_close(t.bars())


@plan(
    "simple_log_returns",
    126,
    "symbol date simple_ret_1d log_ret_1d",
    f"SELECT symbol, date, {q.pct('close')} AS simple_ret_1d, {q.logret('close')} AS log_ret_1d FROM bars",
)
def _(t):
    return op.simple_and_log_returns(t.bars())


_stats = {}
for _n in (5, 10, 20, 50):
    _stats[f"roll_mean_{_n}d"] = q.mean("close", _n, shift=1)
    _stats[f"roll_std_{_n}d"] = q.std("close", _n, shift=1)
    _stats[f"roll_skew_{_n}d"] = q.skew("close", _n, shift=1)
    _stats[f"roll_kurt_{_n}d"] = q.kurt("close", _n, shift=1)
    _stats[f"roll_drawdown_{_n}d"] = f"close / {q.rmax('close', _n)} - 1"


def select(exprs: dict[str, str], src: str, keys="symbol, date") -> str:
    return f"SELECT {keys}, " + ", ".join(f"{v} AS {k}" for k, v in exprs.items()) + f" FROM {src}"


@plan("rolling_stats", 127, "symbol date " + " ".join(_stats), select(_stats, "bars"))
def _(t):
    return op.rolling_stats(t.bars())


q.cte(
    "macd_raw",
    "SELECT symbol, date, rn, " + f"{q.ewm('close', 2 / 13, '(rn-1)')} AS e12, {q.ewm('close', 2 / 27, '(rn-1)')} AS e26 FROM numbered",
)
q.cte("macd_line", "SELECT *, CASE WHEN rn >= 26 THEN e12 - e26 END AS m FROM macd_raw")
q.cte(
    "macd_signal_line",
    "SELECT symbol, date, rn, (pow(0.8::DOUBLE, rn-26) * sum(m * (CASE WHEN rn = 26 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END) * pow(0.8::DOUBLE, 26-rn)) "
    f"OVER {q.over()}) AS s FROM macd_line WHERE rn >= 26",
)


@plan(
    "macd_trend",
    128,
    "symbol date ema_12 ema_26 macd macd_signal macd_dif",
    f"""SELECT symbol, date, {q.lag('CASE WHEN rn >= 12 THEN e12 END')} AS ema_12, {q.lag('CASE WHEN rn >= 26 THEN e26 END')} AS ema_26,
    {q.lag('m')} AS macd, {q.lag('CASE WHEN rn >= 34 THEN s END')} AS macd_signal, {q.lag('CASE WHEN rn >= 34 THEN m - s END')} AS macd_dif
    FROM macd_line LEFT JOIN macd_signal_line USING (symbol, date, rn)""",
)
def _(t):
    return op.macd(t.bars())


q.cte("updown", f"SELECT symbol, date, rn, greatest(coalesce(close - {q.lag('close')}, 0), 0) AS up, greatest(coalesce({q.lag('close')} - close, 0), 0) AS dn FROM numbered")
q.cte("rsi_avg", f"SELECT symbol, date, rn, {q.ewm('up', 1 / 14, '(rn-1)')} AS au, {q.ewm('dn', 1 / 14, '(rn-1)')} AS ad FROM updown")
q.cte("rsi14", "SELECT symbol, date, rn, CASE WHEN rn >= 14 THEN CASE WHEN ad = 0 THEN 100 ELSE 100 - 100 / (1 + au / ad) END END AS rsi FROM rsi_avg")
q.cte("srsi", f"SELECT *, {q.div('rsi - ' + q.rmin('rsi', 14), q.rmax('rsi', 14) + ' - ' + q.rmin('rsi', 14))} AS sr FROM rsi14")
q.cte("srsi_k", f"SELECT *, {q.mean('sr', 3)} AS k FROM srsi")
q.cte("srsi_d", f"SELECT *, {q.mean('k', 3)} AS d FROM srsi_k")


@plan(
    "momentum_indicators",
    129,
    "symbol date rsi_14 stoch_rsi stoch_rsi_k stoch_rsi_d",
    f"SELECT symbol, date, {q.lag('rsi')} AS rsi_14, {q.lag('sr')} AS stoch_rsi, {q.lag('k')} AS stoch_rsi_k, {q.lag('d')} AS stoch_rsi_d FROM srsi_d",
)
def _(t):
    return op.momentum(t.bars())


q.cte("tr_bars", f"SELECT *, {TR} AS tr FROM numbered")
q.cte("atr_bars", wilder_sql("tr_bars", "tr", 14))
q.cte("bb_raw", f"SELECT *, {q.mean('close', 20)} AS m, {q.std0('close', 20)} AS sdv FROM atr_bars")
q.cte(
    "bb_lag",
    f"SELECT symbol, date, {q.lag('m + 2 * sdv')} AS bb_high, {q.lag('m - 2 * sdv')} AS bb_low, {q.lag('m')} AS bb_mid, {q.lag('sm_tr')} AS atr_14 FROM bb_raw",
)


@plan(
    "bollinger_atr",
    130,
    "symbol date bb_high bb_low bb_mid bb_width atr_14",
    f"SELECT *, {q.lag('(bb_high - bb_low) / bb_mid')} AS bb_width FROM bb_lag",
)
def _(t):
    return op.bollinger_atr(t.bars())


q.cte("tp_bars", f"SELECT *, (high + low + close) / 3 AS tp, CASE WHEN close < {q.lag('close')} THEN -volume ELSE volume END AS sv FROM bars")
q.cte(
    "flow_bars",
    f"SELECT *, CASE WHEN tp > {q.lag('tp')} THEN tp * volume ELSE 0 END AS pf, CASE WHEN tp < {q.lag('tp')} THEN tp * volume ELSE 0 END AS nf FROM tp_bars",
)
q.cte("obv_raw", f"SELECT symbol, date, {q.rsum('sv')} AS o, 100 - 100 / (1 + {q.div(q.rsum('pf', 14), q.rsum('nf', 14))}) AS f FROM flow_bars")


@plan("obv_mfi", 131, "symbol date obv mfi_14", f"SELECT symbol, date, {q.lag('o')} AS obv, {q.lag('f')} AS mfi_14 FROM obv_raw")
def _(t):
    return op.obv_mfi(t.bars())


_ch = {
    "sma_20": q.mean("close", 20),
    "sma_50": q.mean("close", 50),
    "stoch_k": "100 * " + q.div("close - " + q.rmin("low", 14), q.rmax("high", 14) + " - " + q.rmin("low", 14)),
    "williams_r": "-100 * " + q.div(q.rmax("high", 14) + " - close", q.rmax("high", 14) + " - " + q.rmin("low", 14)),
    "dc_high": q.rmax("high", 20),
    "dc_low": q.rmin("low", 20),
    "kc_mid": q.mean("tp", 10),
    "ktr": q.mean("high - low", 10),
    "tpm": q.mean("tp", 20),
    "tps": f"list(tp) OVER {q.over(20)}",
    "tp": "tp",
    "vwap": q.div(q.rsum("tp * volume", 14), q.rsum("volume", 14)),
    "acc_dist": q.rsum("coalesce(" + q.div("(close - low) - (high - close)", "high - low") + ", 0) * volume"),
}
q.cte("chan_raw", select(_ch, "tp_bars"))


@plan(
    "channel_indicators",
    132,
    "symbol date sma_20 sma_50 stoch_k stoch_d williams_r cci dc_high dc_low dc_mid kc_mid kc_high kc_low vwap acc_dist",
    f"""SELECT *, {q.mean('stoch_k', 3)} AS stoch_d, (dc_high + dc_low) / 2 AS dc_mid, kc_mid + ktr AS kc_high, kc_mid - ktr AS kc_low,
    CASE WHEN list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 20 > 1e-9
      THEN (tp - tpm) / (0.015 * list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 20) END AS cci FROM chan_raw""",
)
def _(t):
    return op.channels(t.bars())


q.cte(
    "dm_bars",
    f"""SELECT *, CASE WHEN high - {q.lag('high')} > {q.lag('low')} - low AND high - {q.lag('high')} > 0 THEN high - {q.lag('high')} ELSE 0 END AS pdm,
    CASE WHEN {q.lag('low')} - low > high - {q.lag('high')} AND {q.lag('low')} - low > 0 THEN {q.lag('low')} - low ELSE 0 END AS ndm FROM tr_bars""",
)
q.cte("dm1", wilder_sql("dm_bars", "tr", 14))
q.cte("dm2", wilder_sql("(SELECT * EXCLUDE (sd) FROM dm1)", "pdm", 14))
q.cte("dm3", wilder_sql("(SELECT * EXCLUDE (sd) FROM dm2)", "ndm", 14))
q.cte(
    "dm4",
    "SELECT symbol, date, rn, 100 * sm_pdm / nullif(sm_tr, 0) AS adx_pos, 100 * sm_ndm / nullif(sm_tr, 0) AS adx_neg, "
    "CASE WHEN rn >= 14 THEN coalesce(100 * abs(sm_pdm / nullif(sm_tr, 0) - sm_ndm / nullif(sm_tr, 0)) / nullif(sm_pdm / nullif(sm_tr, 0) + sm_ndm / nullif(sm_tr, 0), 0), 0) END AS dx FROM dm3",
)


@plan("adx", 132, "symbol date adx adx_pos adx_neg", f"SELECT *, sm_dx AS adx FROM ({wilder_sql('dm4', 'dx', 14, 27)})")
def _(t):
    return op.adx(t.bars())


q.cte("sar0", "SELECT symbol, date, high, low, row_number() OVER w AS rn, least(lag(low, 1, 'inf'::DOUBLE) OVER w, lag(low, 2, 'inf'::DOUBLE) OVER w) AS low2, greatest(lag(high, 1, '-inf'::DOUBLE) OVER w, lag(high, 2, '-inf'::DOUBLE) OVER w) AS high2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)")
q.cte(
    "sar",
    """SELECT symbol, rn, true AS up, 0.02::DOUBLE AS af, high::DOUBLE AS ep, low::DOUBLE AS stop FROM sar0 WHERE rn = 1
    UNION ALL SELECT symbol, rn, CASE WHEN turn THEN NOT up ELSE up END, CASE WHEN turn THEN 0.02 WHEN further THEN least(af + 0.02::DOUBLE, 0.2) ELSE af END,
    CASE WHEN turn THEN CASE WHEN up THEN low ELSE high END WHEN further THEN CASE WHEN up THEN high ELSE low END ELSE ep END, CASE WHEN turn THEN ep ELSE stop END FROM (
    SELECT *, CASE WHEN up THEN low < stop ELSE high > stop END AS turn, CASE WHEN up THEN high > ep ELSE low < ep END AS further FROM (
    SELECT d.symbol, d.rn, d.high, d.low, p.up, p.af, p.ep, CASE WHEN p.up THEN least(p.stop + p.af * (p.ep - p.stop), d.low2) ELSE greatest(p.stop + p.af * (p.ep - p.stop), d.high2) END AS stop
    FROM sar p JOIN sar0 d ON d.symbol = p.symbol AND d.rn = p.rn + 1))""",
)


@plan("parabolic_sar", 132, "symbol date psar", "SELECT symbol, date, stop AS psar FROM sar JOIN sar0 USING (symbol, rn)")
def _(t):
    return op.parabolic_sar(t.bars())


q.cte(
    "monthly",
    "SELECT symbol, date_trunc('month', date)::DATE AS month, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, "
    "arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2",
)


@plan("monthly_resample", 74, "symbol month:d open high low close volume", "SELECT * FROM monthly")
def _(t):
    return op.monthly_bars(t.bars())


_M = dict(order="month")
q.cte("monthly_dd", f"SELECT *, close / {q.rmax('close', **_M)} - 1 AS dd FROM monthly")
_lt = {f"momentum_{k}m": q.pct("close", k, **_M) for k in (3, 6, 12)} | {f"sma_{k}m": q.mean("close", k, **_M) for k in (3, 6, 12)}
_lt |= {"max_drawdown": q.rmin("dd", **_M), "avg_drawdown": q.mean("dd", **_M), "drawdown_std": q.std("dd", mp=2, **_M)}


@plan("long_term_features", 133, "symbol month:d " + " ".join(_lt), select(_lt, "monthly_dd", "symbol, month"))
def _(t):
    return op.long_term(op.monthly_bars(t.bars()))


_pf = {f"return_{k}d": q.pct("close", k) for k in (1, 5, 10, 20)} | {f"log_return_{k}d": q.logret("close", k) for k in (1, 5)}
_pf |= {f"price_ratio_{n}d": q.div("close", q.mean("close", n)) for n in (5, 10, 20, 50)}
_pf |= {f"price_position_{n}d": q.div("close - " + q.rmin("close", n), q.rmax("close", n) + " - " + q.rmin("close", n)) for n in (10, 20, 50)}


@plan("price_features", 135, "symbol date " + " ".join(_pf), select(_pf, "bars"))
def _(t):
    return op.price_features(t.bars())


q.cte(
    "tech_ema",
    "SELECT *, " + ", ".join(f"{q.ewm_adj('close', 2 / (s + 1), '(rn-1)')} AS ema_{s}" for s in (12, 26, 50)) + " FROM numbered JOIN updown USING (symbol, date, rn)",
)
_tf = {}
for _n in (5, 10, 20, 50, 200):
    _tf[f"ma_{_n}"] = q.mean("close", _n)
    _tf[f"price_vs_ma_{_n}"] = f"close / {q.mean('close', _n)} - 1"
for _n in (12, 26, 50):
    _tf[f"ema_{_n}"] = f"ema_{_n}"
    _tf[f"price_vs_ema_{_n}"] = f"close / ema_{_n} - 1"
_tf["macd"] = "ema_12 - ema_26"
_tf["macd_signal"] = q.ewm_adj("(ema_12 - ema_26)", 0.2, "(rn-1)")
_tf["rsi"] = f"((CASE WHEN {q.mean('dn', 14)} = 0 THEN 100 ELSE 100 - 100 / (1 + {q.mean('up', 14)} / {q.mean('dn', 14)}) END) - 50) / 50"
for _n in (20, 50):
    _m, _s = q.mean("close", _n), q.std("close", _n)
    _tf |= {f"bb_upper_{_n}": f"{_m} + 2 * {_s}", f"bb_lower_{_n}": f"{_m} - 2 * {_s}", f"bb_width_{_n}": f"4 * {_s} / {_m}"}
    _tf[f"bb_position_{_n}"] = q.div(f"close - ({_m} - 2 * {_s})", f"4 * {_s}")
for _n in (5, 20, 50):
    _tf |= {f"volume_ma_{_n}": q.mean("volume", _n), f"volume_ratio_{_n}": q.div("volume", q.mean("volume", _n))}
_tf |= {"price_volume": "close * volume", "volume_weighted_price": q.div(q.rsum("close * volume", 20), q.rsum("volume", 20))}


@plan("technical_features", 134, "symbol date " + " ".join(_tf), select(_tf, "tech_ema"))
def _(t):
    return op.technical_features(t.bars())


q.cte("ret_lags", f"SELECT *, {q.lag('ret', 1)} AS l1, {q.lag('ret', 5)} AS l5 FROM rets")
_sf = {}
for _n in (5, 10, 20, 50):
    _sf |= {f"volatility_{_n}d": q.std("ret", _n), f"volatility_annualized_{_n}d": f"{q.std('ret', _n)} * sqrt(252)"}
for _n in (20, 50):
    _sf |= {f"skewness_{_n}d": q.skew("ret", _n), f"kurtosis_{_n}d": q.kurt("ret", _n)}
    _sf |= {f"percentile_{p}_{_n}d": q.quant("close", p / 100, _n) for p in (10, 25, 75, 90)}
for _k in (1, 5):
    _sf[f"autocorr_lag_{_k}"] = f"(CASE WHEN count(ret) OVER {q.over(50)} >= 50 THEN {q.corr('ret', f'l{_k}', 50 - _k)} END)"


@plan("statistical_features", 136, "symbol date " + " ".join(_sf), select(_sf, "ret_lags"))
def _(t):
    return op.statistical_features(t.bars())


@plan(
    "winsorised_z",
    137,
    "symbol date z",
    f"""SELECT symbol, date, {q.ffill(q.clip('CASE WHEN s > 0 THEN (w - m) / s ELSE w END', -5, 5))} AS z FROM (
      SELECT *, avg(w) OVER (PARTITION BY symbol) AS m, stddev_samp(w) OVER (PARTITION BY symbol) AS s FROM (
        SELECT r.symbol, r.date, CASE WHEN ret IS NOT NULL THEN greatest(lo, least(hi, ret)) END AS w FROM rets r JOIN (
          SELECT symbol, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM rets GROUP BY symbol) USING (symbol)))""",
)
def _(t):
    return op.winsorised_z(t.rets(), "ret", "z")
