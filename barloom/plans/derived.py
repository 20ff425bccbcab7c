"""Plans: derived families, forecast quality, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import SYM
from barloom.operators import derived as op
from barloom.operators import series as sr
from barloom.plans import duck as q
from barloom.plans.evaluation import LEVELS
from barloom.plans.registry import plan
from barloom.plans.series import MONTH, macro_monthly

NAMES = list(LEVELS)


def _pit():
    out = "CASE WHEN y_true <= q05 THEN 0.05"
    for (a, pa), (b, pb) in zip(list(LEVELS.items())[:-1], list(LEVELS.items())[1:]):
        out += f" WHEN y_true <= {b} THEN {pa}::DOUBLE + {pb - pa!r}::DOUBLE * (CASE WHEN {b} - {a} > 1e-12 THEN (y_true - {a}) / ({b} - {a}) ELSE 0 END)"
    return out + " ELSE 0.95 END"


_pins = [f"greatest({p} * (y_true - {c}), ({p} - 1) * (y_true - {c}))" for c, p in LEVELS.items()]
q.cte("qc0", f"SELECT *, {_pit()} AS pit, ({' + '.join(_pins)}) / 7 AS pin FROM qtape")
_b = {c: f"avg((y_true <= {c})::INT)" for c in NAMES}
q.cte(
    "qc1",
    "SELECT symbol, count(*) AS n, " + ", ".join(f"{v} AS b_{c}" for c, v in _b.items()) + ", avg(q95 - q05) AS width_outer, avg(pin) AS pinball_mean, stddev_pop(pin) AS pinball_std, avg(pit) AS pit_mean, stddev_pop(pit) AS pit_std, "
    + ", ".join(f"avg((least(floor(pit * 5 + 1e-9), 4) = {i})::INT) AS pit_bucket_{i}" for i in range(5)) + ", avg((y_true < q05 OR y_true > q95)::INT) AS violation_rate FROM qc0 GROUP BY symbol",
)
_mx = sum(LEVELS.values()) / 7
_sxx = sum((p - _mx) ** 2 for p in LEVELS.values())
_slope = "(" + " + ".join(f"({p - _mx!r}::DOUBLE) * b_{c}" for c, p in LEVELS.items()) + f") / {_sxx!r}::DOUBLE"
_my = "(" + " + ".join(f"b_{c}" for c in NAMES) + ") / 7"
_errs = [f"abs(b_{c} - {p})" for c, p in LEVELS.items()]
_ent = " + ".join(f"(CASE WHEN pit_bucket_{i} > 0 THEN -pit_bucket_{i} * ln(pit_bucket_{i}) ELSE 0 END)" for i in range(5))


@plan(
    "quantile_calibration",
    420,
    "symbol n:i width_outer pinball_mean pinball_std pit_mean pit_std " + " ".join(f"pit_bucket_{i}" for i in range(5)) + " violation_rate coverage_error_mean coverage_error_max pit_entropy reliability_slope reliability_bias",
    f"SELECT *, ({' + '.join(_errs)}) / 7 AS coverage_error_mean, greatest({', '.join(_errs)}) AS coverage_error_max, {_ent} AS pit_entropy, {_slope} AS reliability_slope, {_my} - {_slope} * {_mx!r}::DOUBLE AS reliability_bias FROM qc1",
)
def _(t):
    return op.quantile_calibration(t.quantile_tape(), LEVELS)


_ce = " + ".join(f"abs({q.mean(f'(y_true <= {c})::INT', 60, 20, 1)} - {p})" for c, p in LEVELS.items())
q.cte("qd0", f"SELECT symbol, date, pit, pin, q95 - q05 AS w, ({_ce}) / 7 AS coverage_error FROM qc0")
_cd = {
    "coverage_error": "coverage_error", "width": q.mean("w", 60, 20, 1), "pinball": q.mean("pin", 60, 20, 1), "pit_mean": q.mean("pit", 60, 20, 1), "pit_std": q.std0("pit", 60, 20, 1),
    "coverage_drift_5": f"coverage_error - {q.lag('coverage_error', 5)}", "coverage_drift_20": f"coverage_error - {q.lag('coverage_error', 20)}",
}


@plan("calibration_daily", 421, "symbol date " + " ".join(_cd), q.select(_cd, "qd0"))
def _(t):
    return op.calibration_daily(t.quantile_tape(), LEVELS)


def _trust(shift):
    a = f"SELECT *, q90 - q10 AS w, (y_true BETWEEN q10 AND q90)::INT AS inn FROM qtape"
    b = f"SELECT *, {q.quant('w', 0.5, 20, 5)} AS med, {q.std0('y_true', 20, 5, shift)} AS vol, {q.mean('inn', 50, 10, shift)} AS cov FROM ({a})"
    e = {
        "trust_score": q.clip("1 - abs(cov - 0.8) / 0.8", 0, 1), "spread_shock": "w / (med + 1e-9) - 1", "quantile_drift": f"q50 - {q.lag('q50')}", "width_sigma": "w / (vol + 1e-9)",
        "upper_error_rate": q.mean("(y_true > q90)::INT", 50, 10, shift), "lower_error_rate": q.mean("(y_true < q10)::INT", 50, 10, shift), "trend_regime": f"sign({q.mean('y_true', 20, 5, shift)})",
        "vol_regime": q.flag(f"vol > {q.quant('vol', 0.75, 60, 10)} + 1e-9"),
    }
    return e, f"SELECT *, upper_error_rate - lower_error_rate AS error_asymmetry FROM ({q.select(e, f'({b})')})"


_te, _ts0 = _trust(0)
_, _ts1 = _trust(1)
_tcols = "symbol date " + " ".join(_te) + " error_asymmetry"


@plan("trust_features", 422, _tcols, _ts0)
def _(t):
    return op.trust_features(t.quantile_tape())


@plan("online_learning_family", 423, _tcols, _ts1)
def _(t):
    return op.trust_features(t.quantile_tape(), shift=1)


_dc = ["volume", "rng", "r0"]
q.cte("df_in", "SELECT symbol, date, volume, (high - low) / close AS rng, least(5, coalesce(ret, 0)) AS r0 FROM rets")
_ms = [f"abs({q.mean(c, 10)} - {q.mean(c, 60, 20, 10)}) / ({q.std0(c, 60, 20, 10)} + 1e-9)" for c in _dc]
_ss = [f"abs({q.std0(c, 10)} / ({q.std0(c, 60, 20, 10)} + 1e-9) - 1)" for c in _dc]
_cc = [f"abs({q.corr(a, b, 10)} - {q.corr(a, b, 60, 20, 10)})" for i, a in enumerate(_dc) for b in _dc[i + 1 :]]


def _rm(xs):
    return "((" + " + ".join(f"coalesce({x}, 0)" for x in xs) + ") / nullif(" + " + ".join(f"({x} IS NOT NULL)::INT" for x in xs) + ", 0))"


q.cte("df1", f"SELECT symbol, date, {_rm(_ms)} AS mean_shift, {_rm(_ss)} AS std_shift, {_rm(_cc)} AS corr_shift FROM df_in")


def dfin(t):
    from barloom.functions.columns import ratio

    return t.rets().select("symbol", "date", "volume", ratio(F.col("high") - F.col("low"), "close").alias("rng"), F.least(F.lit(5.0), F.coalesce("ret", F.lit(0.0))).alias("r0"))


@plan("drift_monitor_family", 424, "symbol date mean_shift std_shift corr_shift drift_score", f"SELECT *, {_rm(['mean_shift', 'std_shift', 'corr_shift'])} AS drift_score FROM df1")
def _(t):
    return op.drift_family(dfin(t), _dc)


q.cte("bl0", f"SELECT *, {_rm(['volume', 'rng'])} AS m FROM df_in")
q.cte("bl1", f"SELECT symbol, date, {q.z('m', 60, 20)} AS blk_score FROM bl0")
_bconf = q.clip(f"abs(blk_score) / ({q.rmax('abs(blk_score)', 60, 1)} + 1e-9)", 0, 1)


@plan("baseline_block_score", 425, "symbol date blk_score blk_conf", f"SELECT *, {_bconf} AS blk_conf FROM bl1")
def _(t):
    return op.block_score(dfin(t), ["volume", "rng"], "blk")


_exp = lambda c: f"coalesce(CASE WHEN stddev_samp({c}) OVER {q.over()} > 1e-12 THEN ({c} - avg({c}) OVER {q.over()}) / stddev_samp({c}) OVER {q.over()} END, 0)"


@plan("block_merge", 426, "symbol date close volume", f"SELECT symbol, date, {_exp('close')} AS close, {_exp('volume')} AS volume FROM (SELECT symbol, date, close, volume FROM bars)")
def _(t):
    b = t.bars()
    return op.merge_blocks([b.select("symbol", "date", "close"), b.select("symbol", "date", "volume", F.lit(1.0).alias("flat"))], 2)


@plan("sliding_feature_windows", 427, "symbol date first_close sum_volume n:i", f"SELECT * FROM (SELECT symbol, date, {q.lag('close', 7)} AS first_close, {q.rsum('volume', 8)} AS sum_volume, 8 AS n FROM bars) WHERE sum_volume IS NOT NULL")
def _(t):
    d = op.sliding_windows(t.bars(), ["close", "volume"], 8)
    return d.select("symbol", "date", F.col("window")[0][0].alias("first_close"), F.aggregate("window", F.lit(0.0), lambda a, v: a + v[1]).alias("sum_volume"), F.size("window").alias("n"))


def block(name, row, cte, columns, build):
    keep = [c for c in columns if any(k in c.lower() for k in op.BLOCKS[name])]
    m = _rm(keep)
    s = q.z("m", 60, 20)

    @plan(f"{name}_block", row, f"symbol date {name}_score {name}_conf", f"SELECT *, {q.clip(f'abs({name}_score) / ({q.rmax(f"abs({name}_score)", 60, 1)} + 1e-9)', 0, 1)} AS {name}_conf FROM (SELECT symbol, date, {s} AS {name}_score FROM (SELECT *, {m} AS m FROM {cte}))")
    def _(t):
        d = build(t)
        return op.block_score(d, op.keyword_block(d, op.BLOCKS[name]), name)


q.cte("blk_px", f"SELECT symbol, date, ret, {q.pct('close', 5)} AS mom_5, {q.std('ret', 20, 10)} AS vol_20, (high - low) / close AS range_pct FROM rets")


def blk_px(t):
    from barloom.functions.columns import ratio

    return t.rets().select("symbol", "date", "ret", SYM.pct("close", 5).alias("mom_5"), SYM.std("ret", 20, 10).alias("vol_20"), ratio(F.col("high") - F.col("low"), "close").alias("range_pct"))


block("forecast", 428, "blk_px", ["ret", "mom_5", "vol_20", "range_pct"], blk_px)
block("volatility", 429, "blk_px", ["ret", "mom_5", "vol_20", "range_pct"], blk_px)
block("macro", 430, "macro_series", ["vix", "vix3m", "ust10y", "ust2y", "dollar", "tlt", "hyg"], lambda t: t.macro_series().select("symbol", "date", "vix", "vix3m", "ust10y", "ust2y", "dollar", "tlt", "hyg"))
q.cte("blk_fd", "SELECT symbol, period AS date, gross_profit / revenue AS gross_margin, total_debt / equity AS debt_ratio, shares FROM fundamentals")
block("fundamental", 431, "blk_fd", ["gross_margin", "debt_ratio", "shares"], lambda t: t.fundamentals().select("symbol", F.col("period").alias("date"), (F.col("gross_profit") / F.col("revenue")).alias("gross_margin"), (F.col("total_debt") / F.col("equity")).alias("debt_ratio"), "shares"))
q.cte("blk_nw", "SELECT symbol, date, score, conf AS news_tone, volume FROM tape")
block("news", 432, "blk_nw", ["score", "news_tone", "volume"], lambda t: t.tape().select("symbol", "date", "score", F.col("conf").alias("news_tone"), "volume"))

q.cte("agg_a", "SELECT symbol, date, score AS a FROM tape WHERE volume > 15")
q.cte("agg_b", "SELECT symbol, date, conf AS b FROM tape WHERE volume < 60")
q.cte("agg_j", "SELECT symbol, date, a, b, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n_blocks FROM agg_a FULL JOIN agg_b USING (symbol, date)")
_ab = {"n_blocks": "n_blocks", "composite": "CASE WHEN n_blocks >= 2 THEN (a + b) / 2 END", **{f"{s}_lag{k}": q.lag(s, k) for s in "ab" for k in (1, 3, 5)}}


@plan("block_aggregation", 433, "symbol date " + " ".join(_ab), q.select(_ab, "agg_j"))
def _(t):
    tp = t.tape()
    return op.aggregate_blocks([tp.where(F.col("volume") > 15).select("symbol", "date", F.col("score").alias("a")), tp.where(F.col("volume") < 60).select("symbol", "date", F.col("conf").alias("b"))], ["a", "b"], 2)


_qs = {"loc": "q50", "spread": "q90 - q10", "vol_proxy": "(q90 - q10) / 2.563", "skew_proxy": "(q90 + q10 - 2 * q50) / (abs(q90 - q10) + 1e-9)", "loc_weighted": "q50 * conf", "spread_weighted": "(q90 - q10) * (1 - conf)"}


@plan("quantile_block_summary", 434, "symbol date " + " ".join(_qs), q.select(_qs, "qtape"))
def _(t):
    return op.quantile_summary(t.quantile_tape())


@plan("pattern_block_summaries", (435, 436), "symbol date mean_q max_q", "SELECT symbol, date, (q05 + q50 + q95) / 3 AS mean_q, greatest(q10, conf) AS max_q FROM qtape")
def _(t):
    return op.pattern_summary(t.quantile_tape(), {"mean_q": ["q05", "q50", "q95"]}, {"max_q": ["q10", "conf"]})


@plan(
    "forecast_block_summary",
    (437, 438),
    "symbol date forecast_mean forecast_sign forecast_dispersion",
    "SELECT symbol, date, m AS forecast_mean, sign(m) AS forecast_sign, sqrt((pow(q25 - m, 2) + pow(q50 - m, 2) + pow(q75 - m, 2)) / 3) AS forecast_dispersion FROM (SELECT *, (q25 + q50 + q75) / 3 AS m FROM qtape)",
)
def _(t):
    return op.forecast_summary(t.quantile_tape(), ["q25", "q50", "q75"])


_pos = "CASE WHEN p <= 0.4 THEN -1 WHEN p >= 0.6 THEN 1 ELSE 0 END"


@plan("threshold_directional_accuracy", 439, "symbol n_traded directional_accuracy", f"SELECT symbol, sum((pos <> 0)::INT) AS n_traded, coalesce(avg(CASE WHEN pos <> 0 THEN (sign(pos) = sign(y_true))::INT END), 0.5) AS directional_accuracy FROM (SELECT *, {_pos} AS pos FROM tape) GROUP BY symbol")
def _(t):
    return op.directional_accuracy(t.tape().withColumn("position", F.when(F.col("p") <= 0.4, -1).when(F.col("p") >= 0.6, 1).otherwise(0)))


@plan("normalised_calibration_error", 440, "symbol calibration_error", "SELECT symbol, least(1, avg(abs(y_true - 0.02 * score)) / stddev_pop(y_true)) AS calibration_error FROM tape GROUP BY symbol")
def _(t):
    return op.normalised_calibration_error(t.tape().withColumn("f", 0.02 * F.col("score")), f="f")


q.cte("st0", "SELECT symbol, date_trunc('quarter', date)::DATE AS period, date, close, open, sign(close - lag(close) OVER w) AS dir FROM bars WINDOW w AS (PARTITION BY symbol, date_trunc('quarter', date) ORDER BY date)")
q.cte("st1", "SELECT *, coalesce(dir, 0) = 0 OR coalesce(dir, 0) <> coalesce(lag(dir) OVER (PARTITION BY symbol, period ORDER BY date), 0) AS nw FROM st0")
q.cte("st2", "SELECT *, sum(nw::INT) OVER (PARTITION BY symbol, period ORDER BY date) AS run FROM st1")
q.cte("streaks", "SELECT symbol, period, max(len) AS longest_streak FROM (SELECT symbol, period, run, sum((coalesce(dir, 0) <> 0)::INT) + 1 AS len FROM st2 GROUP BY 1, 2, 3) GROUP BY 1, 2")


def paths(t):
    return t.bars().withColumn("period", F.trunc("date", "quarter"))


@plan("longest_monotone_streak", 443, "symbol period:d longest_streak:i", "SELECT * FROM streaks")
def _(t):
    return op.longest_monotone_streak(paths(t), "close", ["symbol", "period"], "date")


q.cte("sn0", "SELECT symbol, period, max(abs(close / open - 1)) AS max_move, stddev_pop(close / open) AS spread, min(close) AS lowest FROM st0 GROUP BY 1, 2")


@plan(
    "forecast_sanity",
    441,
    "symbol period:d max_move spread lowest longest_streak:i reason:s",
    "SELECT *, CASE WHEN lowest <= 0 THEN 'price_range' WHEN max_move > 3 THEN 'bounds' WHEN coalesce(spread, 0) < 0.3 THEN 'variance' WHEN longest_streak > 4 THEN 'monotone' ELSE 'ok' END AS reason FROM sn0 JOIN streaks USING (symbol, period)",
)
def _(t):
    return op.forecast_sanity(paths(t), "close", "open", ["symbol", "period"], "date", 3, 0.3, 4)


@plan("quantile_ordering", 442, "symbol date ordered", "SELECT symbol, date, (q10 <= q50 + 0.005 * sin(rn) AND q50 + 0.005 * sin(rn) <= q90)::INT AS ordered FROM qtape")
def _(t):
    d = t.quantile_tape().withColumn("m", F.col("q50") + 0.005 * F.sin("rn"))
    return op.quantile_order_ok(d, ["q10", "m", "q90"])


q.cte("sc_m", "SELECT symbol, date_trunc('month', date)::DATE AS date, sum(volume) AS v FROM bars GROUP BY 1, 2")


@plan("series_correlations", 449, "a:s b:s n:i corr strong", "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.v, y.v) AS corr, (abs(corr(x.v, y.v)) >= 0.2)::INT AS strong FROM sc_m x JOIN sc_m y USING (date) WHERE x.symbol < y.symbol GROUP BY 1, 2")
def _(t):
    m = t.bars().groupBy("symbol", F.trunc("date", "month").alias("date")).agg(F.sum("volume").alias("v"))
    return op.series_correlations(m, x="v", strong=0.2)


q.cte("cmon", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY date DESC, symbol DESC) AS k FROM tape) WHERE k <= 500")
q.cte("cmon_b", "SELECT horizon, greatest(ceil(p * 10 - 1e-9), 1) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS g FROM cmon GROUP BY 1, 2")


@plan("calibration_monitor", 450, "horizon:i brier n:i ece", "SELECT horizon, brier, n, ece FROM (SELECT horizon, avg((p - y) * (p - y)) AS brier, count(*) AS n FROM cmon GROUP BY 1) JOIN (SELECT horizon, sum(n * g) / sum(n) AS ece FROM cmon_b GROUP BY 1) USING (horizon)")
def _(t):
    return op.calibration_monitor(t.tape(), 500)


@plan("coverage_by_horizon", (412, 451), "horizon:i coverage width n:i violation", "SELECT horizon, avg((y_true BETWEEN q10 AND q90)::INT) AS coverage, avg(q90 - q10) AS width, count(*) AS n, (abs(avg((y_true BETWEEN q10 AND q90)::INT) - 0.8) > 0.05)::INT AS violation FROM qtape GROUP BY 1")
def _(t):
    return op.coverage_by_horizon(t.quantile_tape())


@plan("rolling_performance", 452, "symbol n:i mean_return volatility hit_rate", "SELECT symbol, count(*) AS n, avg(y_true) AS mean_return, stddev_pop(y_true) AS volatility, avg((score * y_true > 0)::INT) AS hit_rate FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM tape) WHERE k <= 60 GROUP BY symbol")
def _(t):
    d = op.last_rows(t.tape(), 60, ["symbol"], ["date"])
    return d.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("y_true").alias("mean_return"), F.stddev_pop("y_true").alias("volatility"), F.avg((F.col("score") * F.col("y_true") > 0).cast("int")).alias("hit_rate"))


q.cte("rc0", f"SELECT symbol, date, {q.std('y_true', 20, 5)} / ({q.std('y_true', 100, 20)} + 1e-12) AS vol_ratio FROM tape")
q.cte("rc1", "SELECT *, CASE WHEN vol_ratio > 1.1 THEN 'high' WHEN vol_ratio < 0.9 THEN 'low' WHEN vol_ratio IS NOT NULL THEN 'normal' END AS vol_regime FROM rc0")
q.cte("rc2", f"SELECT *, {q.lag('vol_regime')} AS previous_regime FROM rc1")


@plan("regime_change_events", 453, "symbol date vol_ratio vol_regime:s previous_regime:s", "SELECT * FROM rc2 WHERE previous_regime IS NOT NULL AND vol_regime <> previous_regime")
def _(t):
    return op.regime_change_events(t.tape(), "y_true", high=1.1, low=0.9)


@plan("market_stress_level", 454, "date stress", "SELECT date, CASE WHEN vix > 40 THEN 1 WHEN vix > 30 THEN 0.75 WHEN vix > 20 THEN 0.5 WHEN vix > 15 THEN 0.25 ELSE 0 END AS stress FROM (SELECT date, vix * dollar / 25.31 AS vix FROM macro)")
def _(t):
    return t.macro().withColumn("v", F.col("vix") * F.col("dollar") / 25.31).withColumn("stress", sr.market_stress("v"))


_MO = dict(order="month")
_zs = [q.z(c, 24, 12, **_MO) for c in ("indpro", "unrate", "cpi")]
q.cte("bc0", f"SELECT month, symbol, {_rm(_zs)} AS cycle_score FROM macro_monthly")
q.cte("bcy", "SELECT *, cycle_score - lag(cycle_score) OVER (ORDER BY month) AS d FROM bc0")


@plan("business_cycle", 455, "month:d cycle_score cycle_phase:s", "SELECT *, CASE WHEN cycle_score IS NULL OR d IS NULL THEN 'unknown' WHEN cycle_score > 0 AND d > 0 THEN 'expansion' WHEN cycle_score > 0 THEN 'peak' WHEN d > 0 THEN 'recovery' ELSE 'contraction' END AS cycle_phase FROM bcy")
def _(t):
    return op.business_cycle(macro_monthly(t), ["indpro", "unrate", "cpi"], MONTH)


q.cte("nf0", "SELECT symbol, date, CASE WHEN volume % 7 < 1 THEN sin(volume) END AS tone FROM bars")
q.cte("nf1", f"SELECT symbol, date, {q.lag('tone')} AS tone FROM nf0")


@plan("neutral_fill", 456, "symbol date tone", f"SELECT symbol, date, coalesce({q.ffill('tone', 3)}, 0) AS tone FROM nf1")
def _(t):
    b = t.bars()
    s = b.where(F.col("volume") % 7 < 1).select("symbol", "date", F.sin("volume").alias("tone"))
    return op.neutral_fill(b.select("symbol", "date"), s, ["tone"], 3)




q.cte("cc_a", "SELECT x.symbol AS a, y.symbol AS b, corr(x.v, y.v) FILTER (WHERE x.date < DATE '1998-01-01') AS corr_before, corr(x.v, y.v) FILTER (WHERE x.date >= DATE '1998-01-01') AS corr_after FROM sc_m x JOIN sc_m y USING (date) WHERE x.symbol < y.symbol GROUP BY 1, 2")


@plan("top_changed_correlations", 342, "a:s b:s corr_before corr_after change", "SELECT *, abs(corr_after - corr_before) AS change FROM cc_a ORDER BY round(abs(corr_after - corr_before), 9) DESC, a, b LIMIT 5")
def _(t):
    m = t.bars().groupBy("symbol", F.trunc("date", "month").alias("date")).agg(F.sum("volume").alias("v"))
    cut = F.lit("1998-01-01").cast("date")
    return op.changed_correlations(m.where(F.col("date") < cut), m.where(F.col("date") >= cut), x="v")
