"""Plans: series, event and regime operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.windows import SYM, Roll
from barloom.operators import events as ev
from barloom.operators import regimes as rg
from barloom.operators import series as op
from barloom.plans import duck as q
from barloom.plans.market import select_with, softz
from barloom.plans.registry import plan

MONTH = Roll("symbol", "month")
MO = dict(order="month")


def names(d, keys="symbol date"):
    return keys + " " + " ".join(d)


# ---- short interest -----------------------------------------------------------------------------------------------
q.cte(
    "shorts",
    "SELECT symbol, month, volume AS short_interest, volume / 40.0 AS days_to_cover, (volume % 97) / 250.0 AS short_ratio, "
    "(volume % 25) / 100.0 AS borrow_rate, (volume % 100) / 100.0 AS utilization FROM monthly",
)


def shorts(t):
    from barloom.operators.indicators import monthly_bars

    v = F.col("volume")
    return monthly_bars(t.bars()).select(
        "symbol", "month", v.alias("short_interest"), (v / 40).alias("days_to_cover"), (v % 97 / 250).alias("short_ratio"),
        (v % 25 / 100).alias("borrow_rate"), (v % 100 / 100).alias("utilization"),
    )


_sr = "short_ratio"
_si = {
    "short_interest_percent": "short_ratio * 100",
    "change_1m": q.nz(q.pct("short_interest", 1, **MO)),
    "change_3m": q.nz(q.pct("short_interest", 3, **MO)),
    "zscore_1y": f"coalesce(CASE WHEN {q.std0(_sr, 12, **MO)} > 1e-6 THEN (short_ratio - {q.mean(_sr, 12, **MO)}) / {q.std0(_sr, 12, **MO)} "
    f"WHEN {q.std0(_sr, mp=2, **MO)} > 1e-6 THEN (short_ratio - {q.mean(_sr, mp=2, **MO)}) / {q.std0(_sr, mp=2, **MO)} END, 0)",
    "zscore_3y": f"coalesce(CASE WHEN {q.std0(_sr, 36, **MO)} > 1e-6 THEN (short_ratio - {q.mean(_sr, 36, **MO)}) / {q.std0(_sr, 36, **MO)} END, 0)",
    "squeeze_risk_flag": q.flag("days_to_cover > 5 AND short_ratio > 0.1"),
    "squeeze_risk_score": "least(days_to_cover / 10 * 50, 50) + least(short_ratio / 0.2 * 50, 50)",
    "shares_on_loan_pct": "120 * short_ratio",
    "borrow_rate": "CASE WHEN short_ratio > 0.3 THEN 15 + (short_ratio - 0.3) * 100 WHEN short_ratio > 0.2 THEN 5 + (short_ratio - 0.2) * 100 "
    "WHEN short_ratio > 0.1 THEN 1 + (short_ratio - 0.1) * 40 ELSE 0.1 + short_ratio * 9 END",
}
q.cte("si1", q.select(_si, "shorts", "symbol, month"))


@plan("short_interest", 174, names([*_si, "momentum", "borrow_rate_zscore_3y"], "symbol month:d"), "SELECT *, change_1m - change_3m / 3 AS momentum, 0.8 * zscore_3y AS borrow_rate_zscore_3y FROM si1")
def _(t):
    return op.short_interest(shorts(t).drop("borrow_rate"), MONTH)


_sq = " + ".join(
    f"CASE WHEN {c} >= {hi} THEN {a} WHEN {c} >= {lo} THEN {b} ELSE 0 END"
    for c, hi, lo, a, b in (("short_ratio", 0.3, 0.2, 0.4, 0.25), ("days_to_cover", 10, 5, 0.3, 0.2), ("borrow_rate", 0.15, 0.05, 0.2, 0.1), ("utilization", 0.95, 0.8, 0.1, 0.05))
)


@plan("squeeze_probability", 175, "symbol month:d squeeze_probability", f"SELECT symbol, month, least({_sq}, 1.0) AS squeeze_probability FROM shorts")
def _(t):
    return shorts(t).withColumn("squeeze_probability", op.squeeze_probability())


# ---- macro engineering on monthly proxies ---------------------------------------------------------------------------
q.cte(
    "macro_monthly",
    "SELECT 'MACRO' AS symbol, date_trunc('month', CAST(l_shipdate AS DATE))::DATE AS month, avg(l_extendedprice) / 100 AS cpi, 100 * avg(l_discount) AS unrate, "
    "avg(l_quantity) AS indpro, 100 * avg(l_tax) AS fedfunds, 110 * avg(l_tax) AS dgs10, 70 * avg(l_discount) AS dgs2, 90 * avg(l_tax) AS dgs5, 50 * avg(l_discount) AS t5yifr, "
    "avg(l_quantity) AS dollar FROM lineitem GROUP BY 2",
)


def macro_monthly(t):
    li = t.raw("lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    return li.groupBy(F.lit("MACRO").alias("symbol"), "month").agg(
        (F.avg("l_extendedprice") / 100).alias("cpi"), (100 * F.avg("l_discount")).alias("unrate"), F.avg("l_quantity").alias("indpro"), (100 * F.avg("l_tax")).alias("fedfunds"),
        (110 * F.avg("l_tax")).alias("dgs10"), (70 * F.avg("l_discount")).alias("dgs2"), (90 * F.avg("l_tax")).alias("dgs5"), (50 * F.avg("l_discount")).alias("t5yifr"), F.avg("l_quantity").alias("dollar"),
    )


def macro_plan(name, row, exprs, fn):
    @plan(name, row, names(exprs, "month:d"), q.select(exprs, "macro_monthly", "month"))
    def _(t):
        return fn(macro_monthly(t))


macro_plan(
    "macro_yield_curve",
    176,
    {
        "yield_curve_slope": "dgs10 - dgs2",
        "yield_curve_inverted": q.flag("dgs10 < dgs2"),
        "yield_curve_steepening": f"(dgs10 - dgs2) - {q.lag('dgs10 - dgs2', 19, **MO)}",
        "monetary_policy_spread": "dgs10 - fedfunds",
        "real_5y_rate": "dgs5 - t5yifr",
    },
    lambda d: op.yield_curve(d, MONTH),
)
q.cte("infl", f"SELECT *, {q.pct('cpi', 1, **MO)} * 100 AS mom FROM macro_monthly")


@plan(
    "macro_inflation",
    177,
    "month:d inflation_rate_yoy inflation_acceleration inflation_volatility",
    f"""SELECT month, {q.pct('cpi', 11, **MO)} * 100 AS inflation_rate_yoy, {q.std('mom', 12, **MO)} AS inflation_volatility,
    CASE WHEN row_number() OVER (ORDER BY month) >= 12 THEN {q.pct('cpi', 2, **MO)} * 400 - ({q.lag('cpi', 2, **MO)} / {q.lag('cpi', 5, **MO)} - 1) * 200 END AS inflation_acceleration FROM infl""",
)
def _(t):
    return op.inflation(macro_monthly(t), MONTH)


q.cte("empl", f"SELECT *, {q.mean('unrate', 3, **MO)} AS m3 FROM macro_monthly")


@plan(
    "macro_employment",
    178,
    "month:d unrate unemployment_change_yoy unemployment_trend unemployment_vs_trend",
    f"SELECT month, unrate, unrate - {q.lag('unrate', 11, **MO)} AS unemployment_change_yoy, m3 - {q.lag('m3', 2, **MO)} AS unemployment_trend, unrate - {q.quant('unrate', 0.5, 60, **MO)} AS unemployment_vs_trend FROM empl",
)
def _(t):
    return op.employment(macro_monthly(t), MONTH)


macro_plan(
    "macro_growth",
    179,
    {"industrial_production_growth": f"{q.pct('indpro', 11, **MO)} * 100", "industrial_production_momentum": f"{q.pct('indpro', 2, **MO)} * 400"},
    lambda d: op.growth(d, MONTH),
)
_ch = f"(fedfunds - {q.lag('fedfunds', 11, **MO)})"
macro_plan(
    "macro_policy",
    180,
    {
        "fedfunds": "fedfunds",
        "fed_funds_change_yoy": _ch,
        "monetary_policy_stance": f"CASE WHEN {_ch} > 0.5 THEN 1 WHEN {_ch} < -0.5 THEN -1 WHEN {_ch} IS NOT NULL THEN 0 END",
        "fed_funds_percentile": q.pct_rank("fedfunds", 60, **MO) + " * 100",
    },
    lambda d: op.policy(d, MONTH, n=60),
)
q.cte("usd20", "SELECT *, lag(dollar, 20) OVER (ORDER BY month) AS d20 FROM macro_monthly")


@plan(
    "macro_sector_proxies",
    181,
    "month:d real_yield_slope usd_pressure",
    "SELECT month, lag(dgs10 - t5yifr) OVER (ORDER BY month) AS real_yield_slope, lag(dollar / d20 - 1) OVER (ORDER BY month) AS usd_pressure FROM usd20",
)
def _(t):
    return op.sector_proxies(macro_monthly(t), MONTH)


@plan("publication_lag", 182, "symbol date close volume", f"SELECT symbol, date, {q.lag('close', 2)} AS close, {q.lag('volume', 2)} AS volume FROM bars")
def _(t):
    return op.publication_lag(t.bars(), ["close", "volume"], 2)


_lag_cols = {"close_lag1": q.lag("close", 1), "close_lag5": q.lag("close", 5), "volume_lag3": q.lag("volume", 3), "open": "open", "close": "close", "volume": "volume"}


@plan("lag_expansion", (183, 184), names(_lag_cols), q.select(_lag_cols, "bars"))
def _(t):
    return op.expand_lags(t.bars(), [(["close"], [1, 5]), (["clo", "volu"], [1]), (["volume"], [3])])


def _gauss(x, n):
    import math

    s = max(1.0, n / 6.0)
    w = [math.exp(-0.5 * ((i - (n - 1) / 2) / s) ** 2) for i in range(n)]
    num = " + ".join(f"coalesce({q.lag(x, i) if i else x} * {w[n - 1 - i]!r}, 0)" for i in range(n))
    den = " + ".join(f"CASE WHEN {q.lag(x, i) if i else x} IS NOT NULL THEN {w[n - 1 - i]!r} ELSE 0 END" for i in range(n))
    return f"(({num}) / ({den}))"


_sm = {"close_sma": q.mean("close", 10, 1), "close_ema": q.ewm("close", 2 / 11, "(rn-1)"), "close_gaussian": _gauss("close", 7)}


@plan("smoothing", 185, names(_sm), q.select(_sm, "numbered"))
def _(t):
    df = op.smooth(t.bars(), ["close"], "sma", 10)
    df = op.smooth(df, ["close"], "ema", 10)
    return op.smooth(df, ["close"], "gaussian", 7)


def _zl(c):
    f = c
    return q.clip(f"coalesce(({f} - {q.mean(f, 252, 60)}) / ({q.std0(f, 252, 60)} + 1e-9), 0)", -3, 3)


q.cte("es_in", f"SELECT symbol, date, volume, ret, {q.z('volume', 20)} AS volume_z, {q.z('ret', 60)} AS overnight_z, coalesce(ret, 0) AS r0, (high - low) / close AS rng FROM rets")
q.cte("es_z", f"SELECT *, {_zl('rng')} AS rng_z, {_zl('volume')} AS vol_of_vol_z, {_zl('r0')} AS vol_z FROM es_in")


@plan("rolling_z_ladder", 186, "symbol date rng_z volume_z", f"SELECT symbol, date, {_zl('rng')} AS rng_z, {_zl('volume')} AS volume_z FROM es_in")
def _(t):
    df = t.rets().withColumn("rng", ratio(F.col("high") - F.col("low"), "close"))
    return op.rolling_z_ladder(df, ["rng", "volume"])


_up = lambda x: q.clip(x, 0, 3)


@plan(
    "event_score",
    186,
    "symbol date event_score",
    f"""SELECT symbol, date, greatest(0, 0.7 * {_up(f'0.5 * {_up("abs(coalesce(volume_z, 0))")} + 0.3 * {_up("abs(coalesce(overnight_z, 0))")}')}
      + 0.7 * {_up('greatest(vol_z, 0) + 0.4 * abs(vol_of_vol_z)')} + 0.6 * {_up('0.6 * greatest(rng_z, 0)')}) AS event_score FROM es_z""",
)
def _(t):
    df = t.rets().withColumns({"rng": ratio(F.col("high") - F.col("low"), "close"), "r0": F.coalesce("ret", F.lit(0.0))})
    df = op.rolling_z_ladder(df, ["rng", "volume", "r0"])
    df = df.withColumns(
        {"vol_of_vol_z": F.col("volume_z"), "vol_z": F.col("r0_z"), "atm_iv_z": F.col("rng_z"), "overnight_z": SYM.z("ret", 60), "volume_z": SYM.z("volume", 20)}
    )
    return op.event_score(df)


_ms, _mm = q.std("r0", 252, 50, 1), q.mean("r0", 252, 50, 1)


@plan(
    "standardise_signal",
    187,
    "symbol date score_std conf",
    f"SELECT symbol, date, {q.clip(f'(r0 - coalesce({_mm}, 0)) / coalesce(CASE WHEN {_ms} = 0 THEN 1 ELSE {_ms} END, 1)', -3, 3)} / 3 AS score_std, {q.clip('coalesce(rng, 1)', 0, 1)} AS conf FROM es_in",
)
def _(t):
    df = t.rets().withColumns({"r0": F.coalesce("ret", F.lit(0.0)), "rng": ratio(F.col("high") - F.col("low"), "close")})
    return op.standardise_signal(df, "r0", "rng")


@plan("adv_usd", 188, "symbol date adv_usd", f"SELECT symbol, date, {q.mean('close * volume', 20, 1)} AS adv_usd FROM bars")
def _(t):
    return op.adv_usd(t.bars())


@plan("realised_vol_tail", 189, "symbol date realised_vol", f"SELECT symbol, date, coalesce({q.std('ret', 20, 3)} * sqrt(252), 0) AS realised_vol FROM rets")
def _(t):
    return op.realised_vol_tail(t.rets())


# ---- events ---------------------------------------------------------------------------------------------------------
def _since(cond, never):
    return f"coalesce(rn - max(CASE WHEN {cond} THEN rn END) OVER {q.over()}, {never})"


def _until(cond, never):
    return f"coalesce(min(CASE WHEN {cond} THEN rn END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - rn, {never})"


q.cte("ret_n", "SELECT r.*, rn FROM rets r JOIN (SELECT symbol, date, rn FROM numbered) USING (symbol, date)")


@plan("days_since_event", (53, 200), "symbol date days_since", f"SELECT symbol, date, {_since('ret > 5', 9999)} AS days_since FROM ret_n")
def _(t):
    return ev.days_since_pulse(t.rets(), F.col("ret") > 5, "days_since")


@plan("days_to_event", 52, "symbol date days_to", f"SELECT symbol, date, {_until('ret > 5', 9999)} AS days_to FROM ret_n")
def _(t):
    return ev.days_to_pulse(t.rets(), F.col("ret") > 5, "days_to")


@plan("capped_days_since", 202, "symbol date days_since", f"SELECT symbol, date, least(999, {_since('ret > 20', 999)}) AS days_since FROM ret_n")
def _(t):
    return ev.capped_days_since(t.rets(), F.col("ret") > 20, "days_since")


@plan("bounded_recency", 203, "symbol date recency", f"SELECT symbol, date, exp(-greatest(0, least(252, {_since('ret > 5', 9999)})) / 10.0) AS recency FROM ret_n")
def _(t):
    df = ev.days_since_pulse(t.rets(), F.col("ret") > 5, "d")
    return df.withColumn("recency", ev.bounded_recency("d"))


q.cte("splits", "SELECT symbol, date, 2.0 AS ratio FROM numbered WHERE rn % 300 = 50 UNION ALL SELECT symbol, date, 1.5 FROM numbered WHERE rn % 600 = 50")
q.cte("sp1", "SELECT n.*, split_ratio FROM numbered n LEFT JOIN (SELECT symbol, date, product(ratio) AS split_ratio FROM splits GROUP BY 1, 2) USING (symbol, date)")
q.cte("sp2", f"SELECT *, {_since('split_ratio > 0', 9999)} AS dsx FROM sp1")
_sp = {
    "split_flag": q.flag("split_ratio > 0"),
    "split_log_ratio": "coalesce(ln(split_ratio), 0)",
    "split_days_since": "dsx",
    "split_count_5y": f"sum({q.flag('split_ratio > 0')}) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 1824 DAYS PRECEDING AND CURRENT ROW)",
    "split_post_5d": q.flag("dsx <= 5"),
    "split_post_20d": q.flag("dsx <= 20"),
    "split_recency": "CASE WHEN dsx < 9999 THEN exp(-dsx / 20.0) ELSE 0 END",
}


@plan("split_features", (76, 201), names(_sp), q.select(_sp, "sp2"))
def _(t):
    bars = t.bars()
    n = bars.withColumn("rn", SYM.row())
    s = n.where(F.col("rn") % 300 == 50).select("symbol", "date", F.lit(2.0).alias("ratio"))
    s = s.unionByName(n.where(F.col("rn") % 600 == 50).select("symbol", "date", F.lit(1.5).alias("ratio")))
    return ev.split_features(bars, s)


_cw = "(PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)"


@plan(
    "calendar_zscore",
    204,
    "symbol date z",
    f"SELECT symbol, date, coalesce(CASE WHEN count(volume) OVER {_cw} >= 3 AND stddev_pop(volume) OVER {_cw} > 1e-12 THEN (volume - avg(volume) OVER {_cw}) / stddev_pop(volume) OVER {_cw} END, 0) AS z FROM bars",
)
def _(t):
    return ev.calendar_zscore(t.bars(), "volume", "z", 365)


q.cte(
    "reports",
    "SELECT symbol, date_trunc('quarter', date)::DATE AS period, avg(close) / 1000 AS eps_actual, avg(open) / 1000 AS eps_estimate, (avg(close) - avg(open)) / avg(open) * 100 AS surprise_pct, "
    "sum(volume * close) AS revenue FROM bars GROUP BY 1, 2",
)
Q = Roll("symbol", "period")
QO = dict(order="period")


def reports(t):
    return t.bars().groupBy("symbol", F.trunc("date", "quarter").alias("period")).agg(
        (F.avg("close") / 1000).alias("eps_actual"), (F.avg("open") / 1000).alias("eps_estimate"),
        ((F.avg("close") - F.avg("open")) / F.avg("open") * 100).alias("surprise_pct"), F.sum(F.col("volume") * F.col("close")).alias("revenue"),
    )


q.cte(
    "er1",
    f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period) AS rn, sum(CASE WHEN surprise_pct > 0 THEN 0 ELSE 1 END) OVER {q.over(**QO)} AS bb, "
    f"sum(CASE WHEN surprise_pct < 0 THEN 0 ELSE 1 END) OVER {q.over(**QO)} AS mb, CASE WHEN {q.lag('eps_estimate', 1, **QO)} > eps_estimate THEN 1 ELSE 0 END AS fell FROM reports",
)
_g = lambda x, k: q.clip(f"coalesce({q.pct(x, k, **QO)} * 100, 0)", -500, 500)
_p4 = q.mean("revenue", 4, 4, 1, **QO)
_sd8 = q.std0("surprise_pct", 8, 4, **QO)
_ma8 = q.mean("abs(surprise_pct)", 8, 4, **QO)
_er = {
    "beat_streak": "sum(CASE WHEN surprise_pct > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, bb ORDER BY period)",
    "miss_streak": "sum(CASE WHEN surprise_pct < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, mb ORDER BY period)",
    "eps_surprise_pct": "coalesce((eps_actual - eps_estimate) / nullif(abs(eps_estimate), 0) * 100, 0)",
    "eps_growth_qoq": _g("eps_actual", 1),
    "eps_growth_yoy": _g("eps_actual", 4),
    "revenue_growth_qoq": _g("revenue", 1),
    "revenue_growth_yoy": _g("revenue", 4),
    "revenue_surprise_pct": f"coalesce((revenue - {_p4}) / nullif({_p4}, 0) * 100, 0)",
    "beat_rate_3y": q.mean(q.flag("surprise_pct > 0"), 12, 1, **QO) + " * 100",
    "surprise_volatility": q.nz(_sd8),
    "revision_breadth": f"CASE WHEN rn > 1 THEN sum(fell) OVER {q.over(3, **QO)} / least(rn - 1, 3)::DOUBLE * 200 - 100 ELSE 0 END",
    "estimate_dispersion": f"coalesce(CASE WHEN {_ma8} > 0 THEN {_sd8} / {_ma8} * 100 END, 0)",
}
q.cte("er2", q.select(_er, "er1", "symbol, period"))


@plan("earnings_reports", 205, names(_er, "symbol period:d"), "SELECT * FROM er2")
def _(t):
    return ev.earnings_reports(reports(t), Q)


q.cte("known_reports", "SELECT *, CAST(period + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS known_at FROM reports")
q.cte("dd1", "SELECT symbol, date, (SELECT max(known_at) FROM known_reports k WHERE k.symbol = b.symbol AND known_at <= date) AS lst, (SELECT min(known_at) FROM known_reports k WHERE k.symbol = b.symbol AND known_at > date) AS nxt FROM bars b")


@plan(
    "daily_event_decay",
    (47, 205),
    "symbol date surprise_pct days_since_report event_decay days_to_next_report pre_event_stress post_event_stress",
    """SELECT d.symbol, d.date, surprise_pct, date_diff('day', lst, date) AS days_since_report, exp(-date_diff('day', lst, date) / 20.0) AS event_decay,
    least(120, coalesce(date_diff('day', date, nxt), 0)) AS days_to_next_report, exp(-least(120, coalesce(date_diff('day', date, nxt), 0)) / 7.0) AS pre_event_stress,
    exp(-date_diff('day', lst, date) / 5.0) AS post_event_stress FROM dd1 d LEFT JOIN known_reports k ON k.symbol = d.symbol AND k.known_at = d.lst""",
)
def _(t):
    rep = reports(t).withColumn("known_at", F.date_add(F.add_months("period", 3), 44))
    return ev.daily_event_decay(t.bars(), rep, ["surprise_pct"])


q.cte("stale_in", "SELECT symbol, date, CASE WHEN rn > cnt - 30 AND symbol < 'Brand#2' THEN 10 ELSE close END AS close, CASE WHEN rn > cnt - 30 AND symbol < 'Brand#2' AND rn % 10 > 0 THEN 0 ELSE volume END AS volume FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS cnt FROM numbered)")
q.cte("stale1", "SELECT *, last_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM stale_in")
q.cte("stale2", "SELECT *, max(CASE WHEN close <> lc THEN date END) OVER (PARTITION BY symbol) AS mv FROM stale1")


@plan(
    "stale_tail",
    206,
    "symbol tail_rows:i bad_share last_reliable_date:d",
    "SELECT symbol, count(*) AS tail_rows, avg(CASE WHEN volume IS NULL OR volume <= 0 THEN 1.0 ELSE 0.0 END) AS bad_share, CASE WHEN count(*) >= 25 AND avg(CASE WHEN volume IS NULL OR volume <= 0 THEN 1.0 ELSE 0.0 END) >= 0.8 THEN any_value(mv) END AS last_reliable_date FROM stale2 WHERE date > mv GROUP BY symbol",
)
def _(t):
    from pyspark.sql import Window

    d = t.bars().withColumns({"rn": SYM.row(), "cnt": F.count("*").over(Window.partitionBy("symbol"))})
    frozen = (F.col("rn") > F.col("cnt") - 30) & (F.col("symbol") < "Brand#2")
    d = d.withColumns({"close": F.when(frozen, 10.0).otherwise(F.col("close")), "volume": F.when(frozen & (F.col("rn") % 10 > 0), 0.0).otherwise(F.col("volume"))})
    return ev.stale_tail(d)


q.cte("tr1", f"SELECT *, CASE WHEN (volume >= 20) IS DISTINCT FROM {q.lag('volume >= 20')} THEN 1 ELSE 0 END AS chg FROM bars")
q.cte("tr2", f"SELECT *, sum(chg) OVER {q.over()} AS sp FROM tr1")


@plan(
    "threshold_runs",
    207,
    "symbol start_date:d end_date:d days:i avg_quantity severity:s",
    "SELECT symbol, min(date) AS start_date, max(date) AS end_date, count(*) AS days, avg(volume) AS avg_quantity, CASE WHEN count(*) >= 20 THEN 'high' ELSE 'medium' END AS severity FROM tr2 WHERE volume >= 20 GROUP BY symbol, sp HAVING count(*) >= 8",
)
def _(t):
    return ev.threshold_runs(t.bars(), "volume", 20, 8, 20)


q.cte("rt1", "SELECT symbol, volume, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars QUALIFY back <= 10")
q.cte("rt2", "SELECT symbol, volume, back, count(*) OVER (PARTITION BY symbol) - back AS i FROM rt1")


@plan(
    "recent_trend",
    208,
    "symbol n:i direction:s volatility persistence:i recent_acceleration",
    """SELECT symbol, count(*) AS n, CASE WHEN corr(i, volume) > 0.3 THEN 'increasing' WHEN corr(i, volume) < -0.3 THEN 'decreasing' ELSE 'stable' END AS direction,
    stddev_samp(volume) / avg(volume) AS volatility, coalesce(min(CASE WHEN volume <= 0 THEN i END), count(*)) AS persistence,
    CASE WHEN avg(CASE WHEN back <= 5 THEN volume END) > 1.5 * avg(CASE WHEN i < 5 THEN volume END) THEN 1 ELSE 0 END AS recent_acceleration FROM rt2 GROUP BY symbol""",
)
def _(t):
    return ev.recent_trend(t.bars(), "volume")


# ---- regimes --------------------------------------------------------------------------------------------------------
q.cte("vr1", f"SELECT *, {q.std('ret', 20)} / nullif({q.std('ret', 60)}, 0) AS vr, {q.mean('ret', 20)} * 252 AS m FROM rets")
q.cte(
    "vr2",
    "SELECT *, coalesce(vr > 1.3, false) AS hi, coalesce(vr < 0.8, false) AS lo, coalesce(m > 0.05, false) AND NOT coalesce(vr > 1.3, false) AS bull, coalesce(m < -0.05, false) OR coalesce(vr > 1.3, false) AS bear FROM vr1",
)
q.cte("vr3", "SELECT *, CASE WHEN lo AND NOT bull THEN 3 WHEN hi AND NOT bear THEN 2 WHEN bear THEN 1 WHEN bull THEN 0 END AS lab FROM vr2")
q.cte("vr4", f"SELECT symbol, date, ret, coalesce({q.ffill('lab')}, 0) AS regime FROM vr3")


@plan("volatility_ratio_regimes", 210, "symbol date regime:i", "SELECT * FROM vr4")
def _(t):
    return rg.volatility_ratio_regimes(t.rets())


q.cte("sg1", f"SELECT *, CASE WHEN regime IS DISTINCT FROM {q.lag('regime')} THEN 1 ELSE 0 END AS chg FROM vr4")
q.cte("sg2", f"SELECT *, greatest(1, sum(chg) OVER {q.over()}) AS sp FROM sg1")
q.cte("sg3", "SELECT *, count(*) OVER (PARTITION BY symbol, sp) AS len, row_number() OVER (PARTITION BY symbol, sp ORDER BY date) AS pos FROM sg2")


@plan("regime_smoothing", 209, "symbol date regime:i smoothed:i", f"SELECT symbol, date, regime, {q.ffill('CASE WHEN len >= 5 OR sp = 1 THEN regime END')} AS smoothed FROM sg3")
def _(t):
    return rg.smooth_regimes(rg.volatility_ratio_regimes(t.rets()), "regime", 5)


q.cte("hyl", "SELECT symbol, date, regime, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM vr4")
q.cte(
    "hyr",
    """SELECT symbol, date, regime, i, regime AS active, 0 AS k FROM hyl WHERE i = 1
    UNION ALL SELECT symbol, date, regime, i, CASE WHEN same OR p + 1 >= 3 THEN regime ELSE a END, CASE WHEN same OR p + 1 >= 3 THEN 0 ELSE p + 1 END
    FROM (SELECT l.*, r.active AS a, r.k AS p, r.active IS NULL OR coalesce(r.active = l.regime, false) AS same FROM hyr r JOIN hyl l ON l.symbol = r.symbol AND l.i = r.i + 1)""",
)


@plan("regime_hysteresis", 214, "symbol date regime:i active:i", "SELECT symbol, date, regime, active FROM hyr")
def _(t):
    return rg.hysteresis(rg.volatility_ratio_regimes(t.rets()), "regime", 3)


q.cte("bc1", f"SELECT *, {q.mean('ret', 20, 1)} AS m, {q.std('ret', 20, 2)} AS v FROM rets")
q.cte("bc2", "SELECT symbol, quantile_cont(v, 0.85) AS q, quantile_cont(v, 0.5) AS med FROM bc1 GROUP BY symbol")
q.cte("bcc", "SELECT symbol, date, ret, CASE WHEN coalesce(v, med) > q THEN 2 WHEN coalesce(m, 0) < 0 THEN 1 ELSE 0 END AS regime FROM bc1 JOIN bc2 USING (symbol)")


@plan("bull_bear_crisis", 211, "symbol date regime:i", "SELECT * FROM bcc")
def _(t):
    return rg.bull_bear_crisis(t.rets())


@plan(
    "bull_bear_crisis_expanding",
    211,
    "symbol date regime:i",
    f"SELECT symbol, date, CASE WHEN coalesce(v, {q.quant('v', 0.5)}) > {q.quant('v', 0.85)} THEN 2 WHEN coalesce(m, 0) < 0 THEN 1 ELSE 0 END AS regime FROM bc1",
)
def _(t):
    return rg.bull_bear_crisis(t.rets(), fit="expanding")


q.cte("cl1", f"SELECT *, {q.std('ret', 21)} * sqrt(252) AS volatility FROM rets")
_cl = {
    "return_short_21d": q.pct("close", 21),
    "return_medium_63d": q.pct("close", 63),
    "return_long_126d": q.pct("close", 126),
    "volatility": "volatility",
    "volatility_zscore": softz("volatility", 252, 252, "1e-8"),
    "drawdown": f"close / {q.rmax('close', 252)} - 1",
    "trend_strength": q.mean(q.flag("ret > 0"), 21),
}
q.cte("cl2", q.select(_cl, "cl1"))


@plan("regime_classifier_features", 212, names(_cl), "SELECT * FROM cl2")
def _(t):
    return rg.classifier_features(t.bars())


@plan(
    "regime_classifier",
    213,
    "symbol date regime:s",
    """SELECT symbol, date, CASE WHEN return_medium_63d IS NULL OR volatility_zscore IS NULL THEN 'sideways' WHEN drawdown < -0.15 THEN 'bear'
    WHEN return_medium_63d < -0.05 AND volatility_zscore > 0.5 THEN 'bear' WHEN return_long_126d < -0.1 THEN 'bear'
    WHEN return_medium_63d > 0.05 AND volatility_zscore < 1 AND trend_strength > 0.55 THEN 'bull' WHEN return_long_126d > 0.1 AND volatility_zscore < 1 THEN 'bull' ELSE 'sideways' END AS regime FROM cl2""",
)
def _(t):
    return rg.classify(rg.classifier_features(t.bars()))


q.cte("ro1", f"SELECT symbol, date, rn, {q.std('ret', 21, 10)} AS v, {q.pct('close', 63)} AS t63, {q.pct('close', 42)} AS t42, {q.pct('close', 21)} AS t21 FROM ret_n")
q.cte(
    "ro2",
    f"""SELECT *, CASE WHEN avg(v) OVER {q.over(5)} > 1.2 * avg(v) OVER {q.over()} THEN 'high' ELSE 'low' END AS vl,
    CASE WHEN rn >= 252 THEN avg(t63) OVER {q.over(5)} WHEN rn >= 126 THEN avg(t42) OVER {q.over(5)} ELSE avg(t21) OVER {q.over(5)} END AS tr,
    CASE WHEN rn >= 252 THEN 0.03 WHEN rn >= 126 THEN 0.025 ELSE 0.015 END AS cut FROM ro1""",
)


@plan(
    "regime_router",
    214,
    "symbol date router:s",
    "SELECT symbol, date, CASE WHEN rn < 20 THEN 'low_bull' ELSE vl || '_' || CASE WHEN tr > cut THEN 'bull' WHEN tr < -cut THEN 'bear' ELSE 'sideways' END END AS router FROM ro2",
)
def _(t):
    return rg.router_label(t.bars())


q.cte("vp1", f"SELECT symbol, date, {q.pct_rank('vix', 252, 63)} * 100 AS vix_percentile FROM macro_series")
q.cte("vp2", "SELECT *, CASE WHEN vix_percentile <= 25 THEN 'low_vol' WHEN vix_percentile <= 50 THEN 'normal' WHEN vix_percentile <= 75 THEN 'elevated' WHEN vix_percentile IS NOT NULL THEN 'crisis' END AS vix_regime FROM vp1")


@plan(
    "vix_percentile_regime",
    215,
    "date vix_percentile vix_regime:s vix_low_vol vix_normal vix_elevated vix_crisis vix_regime_change",
    "SELECT *, " + ", ".join(f"{q.flag(f'vix_regime = {k!r}')} AS vix_{k}" for k in ("low_vol", "normal", "elevated", "crisis"))
    + f", {q.flag(f'vix_regime IS NULL OR {q.lag("vix_regime")} IS NULL OR vix_regime <> {q.lag("vix_regime")}')} AS vix_regime_change FROM vp2",
)
def _(t):
    return rg.vix_percentile_regime(t.macro_series())


q.cte("mr1", f"SELECT *, {q.mean('close', 126)} AS ma FROM bars")
q.cte("mr2", f"SELECT *, (ma - {q.lag('ma', 20)}) / ma AS sl FROM mr1")


@plan(
    "moving_average_regime",
    216,
    "symbol date market_regime:s regime_strength",
    f"SELECT symbol, date, CASE WHEN close > ma AND sl > 0.001 THEN 'bull' WHEN NOT coalesce(close > ma, false) AND sl < -0.001 THEN 'bear' ELSE 'sideways' END AS market_regime, {q.clip('abs(sl)', 0, 0.05)} / 0.05 AS regime_strength FROM mr2",
)
def _(t):
    return rg.moving_average_regime(t.bars())


_tr, _mo = f"coalesce(close > {q.mean('close', 200)}, false)", f"coalesce({q.mean('ret', 20)} > 0, false)"


@plan(
    "economic_cycle",
    217,
    "symbol date econ_cycle:s",
    f"SELECT symbol, date, CASE WHEN {_tr} AND {_mo} THEN 'expansion' WHEN {_tr} THEN 'slowdown' WHEN NOT {_mo} THEN 'recession' ELSE 'recovery' END AS econ_cycle FROM rets",
)
def _(t):
    return rg.economic_cycle(t.bars())


@plan(
    "cyclical_time",
    218,
    "date month_sin month_cos quarter_sin quarter_cos day_of_week:i days_since_year_start",
    "SELECT date, sin(month(date) * 2 * pi() / 12) AS month_sin, cos(month(date) * 2 * pi() / 12) AS month_cos, sin(quarter(date) * 2 * pi() / 4) AS quarter_sin, cos(quarter(date) * 2 * pi() / 4) AS quarter_cos, "
    "isodow(date) - 1 AS day_of_week, dayofyear(date) / 365.25 AS days_since_year_start FROM macro",
)
def _(t):
    return rg.cyclical_time(t.macro())


q.cte("ed0", "SELECT r.symbol, r.date, ret, rn, vix FROM ret_n r LEFT JOIN macro USING (date)")
q.cte("ed1", f"SELECT *, {q.quant('vix', 0.9, 252)} AS vq FROM ed0")


@plan(
    "event_distance",
    219,
    "symbol date days_since_drawdown days_since_vol_spike recent_volatility_flag",
    f"SELECT symbol, date, least(999, {_since('ret < -0.05', 999)}) AS days_since_drawdown, least(999, {_since('vix > vq', 999)}) AS days_since_vol_spike, {q.flag(f'{_since("ret < -0.05", 999)} <= 30')} AS recent_volatility_flag FROM ed1",
)
def _(t):
    return rg.event_distance(t.bars().join(t.macro().select("date", "vix"), "date", "left"))


q.cte("ri0", f"SELECT b.symbol, b.date, close, {q.logret('close')} AS lr, vix, ust10y AS dgs10, ust2y AS dgs2 FROM bars b LEFT JOIN macro USING (date)")
_ri = {**{f"ret_{k}": q.pct("close", k) for k in (5, 21, 63)}, "vol_20": f"{q.std('lr', 20)} * sqrt(252)", "vol_63": f"{q.std('lr', 63)} * sqrt(252)", "vix": "vix", "vix_slope": f"vix - {q.lag('vix', 5)}", "yield_curve": "dgs10 - dgs2"}
q.cte("ri1", q.select(_ri, "ri0"))


def _inputs(t):
    m = t.macro().select("date", "vix", F.col("ust10y").alias("dgs10"), F.col("ust2y").alias("dgs2"))
    return rg.regime_inputs(t.bars(), m)


@plan("regime_inputs", 221, names(_ri), "SELECT * FROM ri1 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _ri))
def _(t):
    return _inputs(t)


@plan("kmeans_regimes", 220, "symbol date cluster:i", why_no_sql="iterative clustering; kmeans_invariants has SQL")
def _(t):
    return rg.kmeans_regimes(_inputs(t), list(_ri))


@plan("kmeans_invariants", 220, "n:i clusters:i nearest:i", "SELECT count(*) AS n, 4 AS clusters, count(*) AS nearest FROM ri1 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _ri))
def _(t):
    """What settled clusters are: as many as asked for, and every row nearest to the mean of its own, in deviations of each column."""
    columns = list(_ri)
    d = rg.kmeans_regimes(_inputs(t), columns, iterations=200, tol=0.0)
    means = d.groupBy("cluster").agg(*[F.avg(c).alias(f"m_{c}") for c in columns]).withColumnRenamed("cluster", "other")  # four rows
    spread = d.agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in columns])  # one row
    away = sum((F.pow((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 2) for c in columns), F.lit(0.0))
    far = d.join(F.broadcast(means)).join(F.broadcast(spread)).groupBy("symbol", "date", "cluster").agg(F.min(away).alias("least"), F.max(F.when(F.col("other") == F.col("cluster"), away)).alias("own"))
    return far.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.sum((F.col("own") <= F.col("least") + 1e-9).cast("int")).alias("nearest"))


_roles = {"ret0": "predictive", "volume": "risk", "corr_x": "risk", "close": "regime"}
q.cte("nr0", "SELECT symbol, date, coalesce(ret, 0) AS ret0, volume, sin(volume) * 1.5 AS corr_x, close FROM rets")
q.cte("nr1", "SELECT *, CASE WHEN volume >= 0 THEN ln(1 + volume) ELSE abs(volume) END AS tv FROM nr0")
_nr = {
    "ret0": q.clip(f"coalesce((ret0 - {q.mean('ret0', 252, 20)}) / ({q.std0('ret0', 252, 20)} + 1e-6), 0)", -8, 8),
    "volume": q.clip(f"coalesce((tv - {q.quant('tv', 0.05, 252, 20)}) / (abs({q.quant('tv', 0.95, 252, 20)} - {q.quant('tv', 0.05, 252, 20)}) + 1e-6), 0)", 0, 1),
    "corr_x": f"({q.clip('corr_x', -1, 1)} + 1) / 2",
    "close": q.clip(f"coalesce(CASE WHEN {q.rmax('close')} - {q.rmin('close')} >= 1e-6 THEN (close - {q.rmin('close')}) / ({q.rmax('close')} - {q.rmin('close')}) END, 0)", 0, 1),
}


@plan("normalise_by_role", 222, names(_nr), q.select(_nr, "nr1"))
def _(t):
    df = t.rets().select("symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("ret0"), "volume", (F.sin("volume") * 1.5).alias("corr_x"), "close")
    return rg.normalise_by_role(df, _roles)


q.cte("tm0", "SELECT symbol, date, rn, close / 1000 AS value_q, CASE WHEN rn % 5 = 1 THEN volume / 10 END AS event_x FROM numbered")
q.cte("tm1", f"SELECT *, {q.ffill('event_x')} AS ef, {q.lag('value_q')} AS vq FROM tm0")
q.cte("tm2", f"SELECT *, {q.lag('ef')} AS es FROM tm1")
q.cte("tm3", f"SELECT *, coalesce(es - {q.lag('es')}, 0) AS imp FROM tm2")
_A = lambda h: 1 - 0.5 ** (1 / h)


@plan(
    "timing_rules",
    223,
    "symbol date value_q event_x",
    f"""SELECT * EXCLUDE (value_q, event_x), coalesce({q.ewm('imp', _A(3.0), '(rn-1)')} * 0.7 + 0.3 * {q.ewm('imp', _A(20.0), '(rn-1)')}, 0) AS event_x,
    coalesce(CASE WHEN rn >= 2 THEN pow({1 - _A(30.0)!r}::DOUBLE, rn - 2) * sum(vq * (CASE WHEN rn = 2 THEN 1.0::DOUBLE ELSE {_A(30.0)!r}::DOUBLE END) * pow({1 - _A(30.0)!r}::DOUBLE, 2 - rn)) OVER {q.over()} END, 0) AS value_q FROM tm3""",
)
def _(t):
    n = t.bars().withColumn("rn", SYM.row())
    df = n.select("symbol", "date", (F.col("close") / 1000).alias("value_q"), F.when(F.col("rn") % 5 == 1, F.col("volume") / 10).alias("event_x"))
    return rg.timing_rules(df, {"value_q": {"cadence": "quarterly", "decay": "slow"}, "event_x": {"cadence": "event", "decay": "two_phase"}})


q.cte("hol", "SELECT date FROM macro WHERE day(date) = 15")
q.cte("ses", "SELECT date FROM macro WHERE day(date) <> 15")
q.cte("hd", "SELECT date, (SELECT min(h.date) FROM hol h WHERE h.date >= s.date) AS nx, (SELECT max(h.date) FROM hol h WHERE h.date <= s.date) AS pv FROM ses s")
q.cte("hd2", "SELECT date, coalesce(date_diff('day', date, nx), 9999)::DOUBLE AS dto, coalesce(date_diff('day', pv, date), 9999)::DOUBLE AS dsi FROM hd")
_prox = lambda c: f"exp(-least(60, {c}) / 3.0)"


@plan(
    "holiday_features",
    224,
    "date days_to_holiday days_since_holiday is_holiday_adjacent is_half_day holiday_prox holiday_recency liquidity_stress",
    f"""SELECT date, dto AS days_to_holiday, dsi AS days_since_holiday, {q.flag('dto = 1 OR dsi = 1')} AS is_holiday_adjacent, {q.flag('dto = 1')} AS is_half_day,
    {_prox('dto')} AS holiday_prox, {_prox('dsi')} AS holiday_recency, {q.clip(f"{q.flag('dto = 1 OR dsi = 1')} + 0.5 * {_prox('dto')} + 0.3 * {_prox('dsi')}", 0, 1)} AS liquidity_stress FROM hd2""",
)
def _(t):
    m = t.macro().select("date")
    return ev.holiday_features(m.where(F.dayofmonth("date") != 15), m.where(F.dayofmonth("date") == 15), SYM)


q.cte(
    "idx_events",
    "SELECT symbol, 'GSPC' AS index_name, max(CASE WHEN rn = 100 THEN date END) AS add_date, max(CASE WHEN rn = 400 THEN date END) AS remove_date FROM numbered GROUP BY symbol "
    "UNION ALL SELECT symbol, 'DJI', max(CASE WHEN rn = 300 THEN date END), NULL FROM numbered GROUP BY symbol",
)
q.cte("im1", f"SELECT symbol, date, {q.lag('date')} AS pd FROM bars")
q.cte(
    "im2",
    """SELECT i.symbol, i.date, count(DISTINCT CASE WHEN date > add_date AND (remove_date IS NULL OR date <= remove_date) THEN index_name END) AS num_indices,
    sum(CASE WHEN date > add_date AND pd <= add_date THEN 1 ELSE 0 END) AS added, sum(CASE WHEN date > remove_date AND pd <= remove_date THEN 1 ELSE 0 END) AS removed
    FROM im1 i LEFT JOIN idx_events USING (symbol) GROUP BY 1, 2""",
)
q.cte("im3", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM im2")
_im = {
    "num_indices": "num_indices",
    "member": q.flag("num_indices > 0"),
    "added": "added",
    "removed": "removed",
    "days_since_add": _since("added > 0", 9999),
    "days_since_remove": _since("removed > 0", 9999),
    **{f"add_flow_{n}d": q.rsum("added", n, 1) for n in (5, 20)},
    **{f"remove_flow_{n}d": q.rsum("removed", n, 1) for n in (5, 20)},
}


@plan("index_membership", (61, 225), names(_im), q.select(_im, "im3"))
def _(t):
    bars = t.bars()
    n = bars.withColumn("rn", SYM.row())
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("date")))
    g = n.groupBy("symbol").agg(F.lit("GSPC").alias("index_name"), at(100).alias("add_date"), at(400).alias("remove_date"))
    d = n.groupBy("symbol").agg(F.lit("DJI").alias("index_name"), at(300).alias("add_date"), F.lit(None).cast("date").alias("remove_date"))
    return ev.index_membership(bars, g.unionByName(d))


# ---- regime statistics --------------------------------------------------------------------------------------------
q.cte("rs1", "SELECT *, product(1 + ret) OVER (PARTITION BY symbol, regime ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM bcc WHERE ret IS NOT NULL")
q.cte("rs2", "SELECT *, eq / max(eq) OVER (PARTITION BY symbol, regime ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM rs1")


@plan(
    "regime_statistics",
    114,
    "symbol regime:i n:i mean_return volatility sharpe skew kurtosis max_drawdown frequency",
    """SELECT symbol, regime, count(*) AS n, avg(ret) * 252 AS mean_return, stddev_samp(ret) * sqrt(252) AS volatility, CASE WHEN stddev_samp(ret) * sqrt(252) > 1e-12 THEN avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) END AS sharpe,
    skewness(ret) AS skew, kurtosis(ret) AS kurtosis, min(dd) AS max_drawdown, count(*) / (sum(count(*)) OVER (PARTITION BY symbol))::DOUBLE AS frequency FROM rs2 GROUP BY symbol, regime""",
)
def _(t):
    return rg.regime_statistics(rg.bull_bear_crisis(t.rets()))


@plan("regime_average_spell", 115, "symbol regime:i avg_duration n_spells:i", "SELECT symbol, regime, avg(len) AS avg_duration, count(*) AS n_spells FROM (SELECT DISTINCT symbol, regime, sp, len FROM sg3) GROUP BY 1, 2")
def _(t):
    return rg.average_spell(rg.volatility_ratio_regimes(t.rets()))


@plan(
    "regime_transition_matrix",
    116,
    "from_regime:i to_regime:i n:i share",
    f"SELECT regime AS from_regime, nx AS to_regime, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY regime))::DOUBLE AS share FROM (SELECT regime, {q.lead('regime')} AS nx FROM vr4) WHERE nx IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    return rg.transition_matrix(rg.volatility_ratio_regimes(t.rets()))


@plan(
    "regime_sample_weights",
    117,
    "symbol date regime:i sample_weight",
    "SELECT symbol, date, regime, count(*) OVER () / ((SELECT count(DISTINCT regime) FROM vr4) * count(*) OVER (PARTITION BY regime))::DOUBLE AS sample_weight FROM vr4",
)
def _(t):
    return rg.regime_weights(rg.volatility_ratio_regimes(t.rets()))


@plan(
    "dominant_regime",
    118,
    "symbol period:d dominant:i share n:i",
    "SELECT symbol, period, arg_max(regime, (c, -regime)) AS dominant, max(c) / sum(c)::DOUBLE AS share, sum(c) AS n FROM (SELECT symbol, date_trunc('quarter', date)::DATE AS period, regime, count(*) AS c FROM vr4 GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def _(t):
    return rg.dominant_regime(rg.volatility_ratio_regimes(t.rets()), F.trunc("date", "quarter"))


q.cte("nn_right", "SELECT symbol, date, close AS v FROM numbered WHERE rn % 40 = 7")
q.cte(
    "nn1",
    "SELECT b.symbol, b.date, n.v, n.date AS nd, row_number() OVER (PARTITION BY b.symbol, b.date ORDER BY abs(date_diff('day', n.date, b.date)), n.date) AS k FROM bars b JOIN nn_right n ON n.symbol = b.symbol",
)


@plan("nearest_by_date", 67, "symbol date nearest_v gap_days:i", "SELECT symbol, date, v AS nearest_v, abs(date_diff('day', nd, date)) AS gap_days FROM nn1 WHERE k = 1")
def _(t):
    bars = t.bars()
    right = bars.withColumn("rn", SYM.row()).where(F.col("rn") % 40 == 7).select("symbol", "date", F.col("close").alias("v"))
    return rg.nearest_by_date(bars.select("symbol", "date"), right, "v")
