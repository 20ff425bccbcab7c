"""Plans: benchmark analytics, thresholds, forecast and calibration metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import clip, wilson_interval
from barloom.operators import evaluation as op
from barloom.operators.isotonic import isotonic
from barloom.plans import duck as q
from barloom.plans.market import select_with
from barloom.plans.registry import plan

K = ["symbol"]


# ---- benchmark ------------------------------------------------------------------------------------------------------
q.cte("bm0", "SELECT r.symbol, r.date, greatest(-0.05::DOUBLE, least(0.05::DOUBLE, ret / 20)) / 5 AS rp, greatest(-0.05::DOUBLE, least(0.05::DOUBLE, (mkt - 2) / 50)) / 5 AS rb FROM rets r JOIN market USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL")
_RF = repr(1.02 ** (1 / 252) - 1)
q.cte("bm1", f"SELECT *, rp - rb AS active, rp - {_RF}::DOUBLE AS excess_p, rb - {_RF}::DOUBLE AS excess_b, {q.beta('rp', 'rb', 20, 5)} AS beta_20, {q.beta('rp', 'rb', 63, 12)} AS beta_63 FROM bm0")
q.cte("bm2", "SELECT *, rp - beta_20 * rb AS alpha_20, rp - beta_63 * rb AS alpha_63 FROM bm1")


def _sortino(x, n):
    w, neg = q.over(n), f"(CASE WHEN {x} < 0 THEN {x} * {x} END)"
    return f"(CASE WHEN count({x}) OVER {w} >= {max(5, n // 5)} AND count({neg}) OVER {w} >= 2 THEN avg({x}) OVER {w} / (sqrt(avg({neg}) OVER {w}) + 1e-12) * sqrt(252) END)"


def _cvar(x, n):
    qq = q.quant(x, 0.05, n, max(10, n // 5))
    return f"(CASE WHEN {qq} IS NOT NULL THEN list_avg(list_filter(list({x}) OVER {q.over(n)}, lambda e__: e__ <= {qq})) END)"


def _capture(n, sign):
    w, on = q.over(n), f"rb {sign} 0"
    pc, bc = (f"(product(CASE WHEN {on} THEN 1 + {c} END) OVER {w} - 1)" for c in ("rp", "rb"))
    return f"(CASE WHEN count(rb) OVER {w} >= {n} AND count(CASE WHEN {on} THEN 1 END) OVER {w} >= {max(10, n // 5)} AND abs({bc}) >= 1e-12 THEN {pc} / {bc} END)"


_bm = {}
for _n in (20, 63):
    _mp, _a = max(5, _n // 5), f"alpha_{_n}"
    _bm |= {
        f"alpha_roll_{_n}": q.mean(_a, _n, _mp),
        f"alpha_cum_{_n}": q.prod(f"(1 + coalesce({_a}, 0))") + " - 1",
        f"ir_{_n}": f"{q.mean(_a, _n, _mp)} / ({q.std(_a, _n, _mp)} + 1e-12) * sqrt(252)",
        f"te_{_n}": f"{q.std('active', _n, _mp)} * sqrt(252)",
        f"sharpe_{_n}": f"{q.mean('excess_p', _n, _mp)} / ({q.std('excess_p', _n, _mp)} + 1e-12) * sqrt(252)",
        f"sortino_{_n}": _sortino("excess_p", _n),
        f"up_capture_{_n}": _capture(_n, ">"),
        f"down_capture_{_n}": _capture(_n, "<"),
        f"cvar_{_n}": _cvar("excess_p", _n),
        f"realized_vol_{_n}": f"{q.std('rp', _n, _mp)} * sqrt(252)",
        f"vol_target_error_{_n}": f"{q.std('rp', _n, _mp)} * sqrt(252) - 0.1",
    }
q.cte("bm3", select_with({**_bm, "eq": q.prod("(1 + rp)")}, "bm2"))
q.cte("bm4", f"SELECT *, eq / nullif({q.rmax('eq')}, 0) - 1 AS drawdown FROM bm3")


def _bench(t, target=0.1):
    p = t.rets().select("symbol", "date", (clip(F.col("ret") / 20, -0.05, 0.05) / 5).alias("rp"))
    b = t.market().select("date", (clip((F.col("mkt") - 2) / 50, -0.05, 0.05) / 5).alias("rb"))
    return op.benchmark_timeseries(op.align_returns(p, b), (20, 63), 0.02, target)


_bmc = ["active", "excess_p", "excess_b", "beta_20", "beta_63", "alpha_20", "alpha_63", *_bm, "drawdown"]


@plan("benchmark_timeseries", (55, 283, 284, 285, 286, 287, 417), "symbol date " + " ".join(_bmc), "SELECT * FROM bm4")
def _(t):
    return _bench(t)


_sum = ["beta_20", "ir_63", "sharpe_63"]


@plan(
    "benchmark_summary",
    113,
    "symbol " + " ".join(f"{c}_last {c}_mean" for c in _sum) + " max_drawdown n:i total_return benchmark_return",
    "SELECT symbol, " + ", ".join(f"arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}_last, avg({c}) AS {c}_mean" for c in _sum)
    + ", min(drawdown) AS max_drawdown, count(*) AS n, product(1 + rp) - 1 AS total_return, product(1 + rb) - 1 AS benchmark_return FROM bm4 GROUP BY symbol",
)
def _(t):
    return op.benchmark_summary(_bench(t), _sum)


@plan("daily_risk_free", 287, "date rf", "SELECT date, pow(1 + ust10y / 100, 1.0 / 252) - 1 AS rf FROM macro")
def _(t):
    return t.macro().withColumn("rf", op.daily_risk_free(F.col("ust10y") / 100))


@plan("equal_weight_benchmark", 111, "date mkt", "SELECT date, mkt FROM market")
def _(t):
    return t.market()


@plan(
    "horizon_comparison",
    112,
    "horizon:i n:i total_return mean_score last_score",
    "SELECT horizon, count(*) AS n, sum(y_true) AS total_return, avg(score) AS mean_score, arg_max(score, (date, symbol)) AS last_score FROM tape GROUP BY horizon",
)
def _(t):
    return t.tape().groupBy("horizon").agg(
        F.count("*").alias("n"), F.sum("y_true").alias("total_return"), F.avg("score").alias("mean_score"), F.max_by("score", F.struct("date", "symbol")).alias("last_score")
    )


# ---- thresholds -----------------------------------------------------------------------------------------------------
q.cte("flast", "SELECT symbol, fold_id, arg_max(y_true, date) AS y_true, arg_max(score, date) AS score, max(date) AS date FROM tape GROUP BY 1, 2")


@plan("fold_last_rows", (57, 105), "symbol fold_id:i date score y_true", "SELECT * FROM flast")
def _(t):
    return op.fold_last(t.tape()).select("symbol", "fold_id", "date", "score", "y_true")


_grid = op.threshold_grid()
q.cte("grid", "SELECT unnest([" + ", ".join(f"{g}::DOUBLE" for g in _grid) + "]) AS T")
q.cte("sw0", "SELECT *, CASE WHEN score >= T THEN 1 WHEN score <= -T THEN -1 ELSE 0 END AS position FROM flast, grid")
q.cte("sw1", "SELECT *, position * y_true AS ret, abs(position - lag(position) OVER (PARTITION BY symbol, T ORDER BY fold_id)) AS ch FROM sw0")
q.cte("sw2", "SELECT *, product(1 + ret) OVER (PARTITION BY symbol, T ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM sw1")
q.cte("sw3", "SELECT *, eq / max(eq) OVER (PARTITION BY symbol, T ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM sw2")
q.cte(
    "sw4",
    """SELECT symbol, T, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_samp(ret) > 1e-15 THEN avg(ret) / stddev_samp(ret) * 2 ELSE 0 END AS sharpe, min(dd) AS maxdd,
    coalesce(avg(CASE WHEN ret <> 0 THEN (ret > 0)::INT END), 0) AS hitrate, coalesce(avg(ch), 0) AS turnover, avg(ret) * 4 AS ann_return, avg((position <> 0)::INT) AS coverage,
    sum((position > 0)::INT) AS n_long, sum((position < 0)::INT) AS n_short, sum((position = 0)::INT) AS n_flat FROM sw3 GROUP BY 1, 2""",
)
q.cte("sw5", "SELECT *, CASE WHEN maxdd <> 0 THEN ann_return / abs(maxdd) ELSE 0 END AS calmar, CASE WHEN coverage > 0 THEN sharpe * pow(coverage, 0.3) ELSE 0 END AS objective FROM sw4")


@plan("threshold_sweep", (288, 291), "symbol T n:i sharpe maxdd hitrate turnover ann_return calmar coverage n_long n_short n_flat objective", "SELECT * FROM sw5")
def _(t):
    return op.threshold_sweep(t.tape(), _grid)


@plan(
    "best_threshold",
    291,
    "symbol T objective coverage sharpe maxdd",
    "SELECT * FROM sw5 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY (coverage >= 0.1 AND maxdd >= -0.5) DESC, round(objective, 12) DESC, T) = 1",
)
def _(t):
    return op.best_threshold(op.threshold_sweep(t.tape(), _grid))


_w1 = "(PARTITION BY symbol, T ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
q.cte("wf1", f"SELECT *, avg(ret) OVER {_w1} AS m, CASE WHEN count(ret) OVER {_w1} >= 2 THEN stddev_samp(ret) OVER {_w1} END AS s, avg((position <> 0)::INT) OVER {_w1} AS cov FROM sw1")
q.cte("wf2", "SELECT *, round(CASE WHEN cov > 0 THEN (CASE WHEN s > 1e-15 THEN m / s * 2 ELSE 0 END) * pow(cov, 0.3) ELSE 0 END, 12) AS obj FROM wf1")
q.cte("wf3", "SELECT symbol, fold_id, coalesce(arg_max(T, (obj, -T)) FILTER (WHERE obj IS NOT NULL), min(T)) AS best, row_number() OVER (PARTITION BY symbol ORDER BY fold_id) AS k FROM wf2 GROUP BY 1, 2")
q.cte("wf4", "SELECT symbol, fold_id, CASE WHEN k <= 5 THEN 0.1 ELSE best END AS threshold FROM wf3")


@plan(
    "walkforward_threshold",
    292,
    "symbol fold_id:i threshold position ret",
    "SELECT symbol, fold_id, threshold, CASE WHEN score >= threshold THEN 1 WHEN score <= -threshold THEN -1 ELSE 0 END AS position, (CASE WHEN score >= threshold THEN 1 WHEN score <= -threshold THEN -1 ELSE 0 END) * y_true AS ret FROM flast JOIN wf4 USING (symbol, fold_id)",
)
def _(t):
    return op.walkforward_threshold(t.tape(), _grid)


q.cte("pt0", "SELECT symbol, p, y, th FROM tape, (SELECT unnest([" + ", ".join(f"{0.50 + 0.01 * i:.2f}::DOUBLE" for i in range(46)) + "]) AS th)")
q.cte(
    "pt1",
    "SELECT symbol, th AS threshold, count(*) AS sample_count, sum((p >= th OR p <= 1 - th)::INT) AS trade_count, coalesce(avg(CASE WHEN p >= th OR p <= 1 - th THEN ((p >= th) = (y > 0.5))::INT END), 0) AS precision, "
    "sum((p >= th OR p <= 1 - th)::INT) / count(*)::DOUBLE AS coverage FROM pt0 GROUP BY 1, 2",
)
q.cte("pt2", "SELECT *, (precision >= 0.5 AND coverage >= 0.35)::INT AS meets_constraints, greatest(0, 0.35 - coverage) AS coverage_shortfall FROM pt1")


@plan(
    "probability_threshold",
    293,
    "symbol threshold precision coverage trade_count:i sample_count:i meets_constraints coverage_shortfall",
    """SELECT * FROM pt2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY meets_constraints DESC, CASE WHEN meets_constraints = 1 THEN coverage ELSE precision END DESC,
    CASE WHEN meets_constraints = 1 THEN -threshold ELSE coverage END DESC, threshold) = 1""",
)
def _(t):
    return op.probability_threshold(t.tape(), 0.5, 0.35)


@plan("position_from_probability", 294, "symbol date position:i", "SELECT symbol, date, CASE WHEN p <= 0.48 THEN -1 WHEN p >= 0.52 THEN 1 ELSE 0 END AS position FROM tape")
def _(t):
    return t.tape().withColumn("position", op.position_from_probability())


q.cte("ovr", "SELECT DISTINCT symbol, 5 AS horizon, 0.6 AS buy, 0.3 AS sell FROM tape WHERE symbol < 'Brand#2'")


@plan(
    "threshold_overrides",
    295,
    "symbol date buy sell position:i",
    "SELECT t.symbol, t.date, coalesce(buy, 0.52) AS buy, coalesce(sell, 0.48) AS sell, CASE WHEN p <= coalesce(sell, 0.48) THEN -1 WHEN p >= coalesce(buy, 0.52) THEN 1 ELSE 0 END AS position FROM tape t LEFT JOIN ovr USING (symbol, horizon)",
)
def _(t):
    o = t.tape().where(F.col("symbol") < "Brand#2").select("symbol").distinct().select("symbol", F.lit(5).alias("horizon"), F.lit(0.6).alias("buy"), F.lit(0.3).alias("sell"))
    return op.threshold_overrides(t.tape(), o)


@plan(
    "horizon_sharpe",
    289,
    "symbol n:i sharpe",
    "SELECT symbol, count(y_true) AS n, greatest(-5, least(5, avg(y_true) / (stddev_samp(y_true) + 1e-9) * sqrt(50))) AS sharpe FROM tape WHERE (rn - 1) % 5 = 0 GROUP BY symbol",
)
def _(t):
    return op.horizon_sharpe(t.tape(), 5, "y_true")


q.cte("sm0", "SELECT symbol, date, score * y_true AS net_return, score AS weight, y_true AS actual_return, p, y, (rn % 4 = 0)::INT AS drift_flag FROM tape")
q.cte("sm1", f"SELECT *, {q.prod('(1 + net_return)')} AS eq, coalesce(abs(weight - {q.lag('weight')}), abs(weight)) AS tw, (coalesce(sign(weight) <> {q.lag('sign(weight)')}, false))::INT AS flip FROM sm0")
q.cte("sm2", f"SELECT *, eq / {q.rmax('eq')} - 1 AS dd FROM sm1")
q.cte("bins_l", "SELECT symbol, least(floor(p * 10 + 1e-9), 9) AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM tape GROUP BY 1, 2")
q.cte("bins_r", "SELECT symbol, greatest(ceil(p * 10 - 1e-9), 1) - 1 AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM tape WHERE p > 0 GROUP BY 1, 2")
q.cte("ece_l", "SELECT symbol, sum(n * abs(confidence - accuracy)) / sum(n) AS ece, max(abs(confidence - accuracy)) AS mce, sum(n) AS n FROM bins_l GROUP BY 1")
q.cte("ece_r", "SELECT symbol, sum(n * abs(confidence - accuracy)) / sum(n) AS ece, max(abs(confidence - accuracy)) AS mce, sum(n) AS n FROM bins_r GROUP BY 1")
q.cte(
    "sm3",
    """SELECT symbol, avg(net_return) / stddev_samp(net_return) * sqrt(252) AS sharpe, avg(net_return) / sqrt(avg(CASE WHEN net_return < 0 THEN net_return * net_return END)) * sqrt(252) AS sortino, avg((net_return > 0)::INT) AS hit_rate,
    avg(tw) AS turnover, sum(CASE WHEN sign(actual_return) = sign(weight) THEN abs(actual_return) ELSE 0 END) / sum(abs(actual_return)) AS rwa, avg((p - y) * (p - y)) AS brier, 1 - avg(flip) AS stability, min(dd) AS max_drawdown,
    avg(CASE WHEN drift_flag = 1 THEN net_return END) AS drift_on, avg(CASE WHEN drift_flag = 0 THEN net_return END) AS drift_off, 1.0 AS coverage, count(*) AS sample_size FROM sm2 GROUP BY symbol""",
)


@plan(
    "strategy_metrics",
    290,
    "symbol sharpe sortino hit_rate turnover rwa brier stability max_drawdown drift_on drift_off coverage sample_size ece composite",
    "SELECT *, 0.6 * sharpe + 0.15 * rwa + 0.15 * (1 - ece) + 0.1 * stability AS composite FROM sm3 JOIN ece_l USING (symbol)",
)
def _(t):
    d = t.tape().select("symbol", "date", (F.col("score") * F.col("y_true")).alias("net_return"), F.col("score").alias("weight"), F.col("y_true").alias("actual_return"), "p", "y", (F.col("rn") % 4 == 0).cast("int").alias("drift_flag"))
    return op.strategy_metrics(d)


# ---- forecast metrics -------------------------------------------------------------------------------------------------
q.cte("fm0", "SELECT symbol, date, y_true AS a, score AS f, y_true * sign(score) AS sr, 0.5 * stddev_pop(y_true) OVER (PARTITION BY symbol) AS tol FROM tape")
q.cte("fm1", f"SELECT *, {q.prod('(1 + sr)')} AS eq FROM fm0")
q.cte("fm2", f"SELECT *, eq / {q.rmax('eq')} - 1 AS dd FROM fm1")
q.cte(
    "fm3",
    """SELECT symbol, count(*) AS n, avg(abs(a - f)) AS mae, sqrt(avg((a - f) * (a - f))) AS rmse, avg(abs((a - f) / CASE WHEN abs(a) > 1e-8 THEN a ELSE 1e-8 END)) * 100 AS mape, avg((sign(a) = sign(f))::INT) AS direction_accuracy,
    avg((abs(a - f) <= tol)::INT) AS hit_rate, sum((f > 0 AND a > 0)::INT) AS tp, sum((f > 0 AND NOT a > 0)::INT) AS fp, sum((NOT f > 0 AND a > 0)::INT) AS fn, max(abs(a - f)) AS max_error, stddev_pop(a - f) AS error_volatility,
    avg(sr) / stddev_pop(sr) * sqrt(252) AS sharpe_ratio, avg(sr) / sqrt(avg(CASE WHEN sr < 0 THEN sr * sr END)) * sqrt(252) AS sortino_ratio, min(dd) AS max_drawdown, avg(sr) * 252 / abs(min(dd)) AS calmar_ratio FROM fm2 GROUP BY symbol""",
)
q.cte("fm4", "SELECT *, tp / (tp + fp + 1e-8::DOUBLE) AS precision, tp / (tp + fn + 1e-8::DOUBLE) AS recall FROM fm3")


@plan(
    "forecast_metrics",
    296,
    "symbol n:i mae rmse mape direction_accuracy hit_rate precision recall f1_score max_error error_volatility sharpe_ratio sortino_ratio max_drawdown calmar_ratio",
    "SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1_score FROM fm4",
)
def _(t):
    return op.forecast_metrics(t.tape(), K)


LEVELS = {"q05": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95}
q.cte("pin0", " UNION ALL ".join(f"SELECT symbol, {p}::DOUBLE AS level, y_true, {c} AS q FROM qtape" for c, p in LEVELS.items()))
q.cte("pin1", "SELECT symbol, level, avg(greatest(level * (y_true - q), (level - 1) * (y_true - q))) AS pinball, avg((y_true <= q)::INT) AS below_share FROM pin0 GROUP BY 1, 2")


@plan("pinball_loss", 297, "symbol level pinball below_share", "SELECT * FROM pin1")
def _(t):
    return op.pinball(t.quantile_tape(), LEVELS)


@plan(
    "crps_quantile",
    299,
    "symbol crps",
    "SELECT symbol, sum(a) AS crps FROM (SELECT symbol, (pinball + lag(pinball) OVER w) / 2 * (level - lag(level) OVER w) AS a FROM pin1 WINDOW w AS (PARTITION BY symbol ORDER BY level)) GROUP BY symbol",
)
def _(t):
    return op.crps_quantile(t.quantile_tape(), LEVELS)


_smp = list(LEVELS)
_n = len(_smp)


@plan(
    "sample_scores",
    300,
    "symbol mean_abs_score crps",
    "SELECT symbol, avg(mad) AS mean_abs_score, avg(mad - sp / 2) AS crps FROM (SELECT symbol, (" + " + ".join(f"abs({c} - y_true)" for c in _smp) + f") / {_n} AS mad, ("
    + " + ".join(f"({2 * i - _n + 1}) * {c}" for i, c in enumerate(_smp)) + f") * 2 / {_n * _n} AS sp FROM qtape) GROUP BY symbol",
)
def _(t):
    return op.sample_scores(t.quantile_tape().withColumn("s", F.array(*_smp)), "s", "y_true")


_iv = {"90": ("q05", "q95"), "80": ("q10", "q90"), "50": ("q25", "q75")}


@plan(
    "interval_coverage",
    (298, 302),
    "symbol " + " ".join(f"coverage_{k} width_{k}" for k in _iv),
    "SELECT symbol, " + ", ".join(f"avg((y_true BETWEEN {lo} AND {hi})::INT) AS coverage_{k}, avg({hi} - {lo}) AS width_{k}" for k, (lo, hi) in _iv.items()) + " FROM qtape GROUP BY symbol",
)
def _(t):
    return op.interval_coverage(t.quantile_tape(), _iv)


# ---- calibration ------------------------------------------------------------------------------------------------------
@plan("brier_score", 301, "symbol brier n:i", "SELECT symbol, avg((p - y) * (p - y)) AS brier, count(*) AS n FROM tape GROUP BY symbol")
def _(t):
    return op.brier(t.tape(), K)


@plan("expected_calibration_error", 303, "symbol ece mce n:i", "SELECT * FROM ece_l")
def _(t):
    return op.expected_calibration_error(t.tape(), K)


@plan("maximum_calibration_error", 304, "symbol ece mce n:i", "SELECT * FROM ece_r")
def _(t):
    return op.expected_calibration_error(t.tape(), K, closed="right")


@plan(
    "brier_decomposition",
    305,
    "symbol reliability resolution uncertainty",
    """SELECT symbol, sum(n / tot * pow(confidence - accuracy, 2)) AS reliability, sum(n / tot * pow(accuracy - b, 2)) AS resolution, any_value(b * (1 - b)) AS uncertainty
    FROM bins_r JOIN (SELECT symbol, avg(y) AS b, count(*)::DOUBLE AS tot FROM tape GROUP BY 1) USING (symbol) GROUP BY symbol""",
)
def _(t):
    return op.brier_decomposition(t.tape(), K)


q.cte("mi_j", "SELECT symbol, least(floor(p * 10 + 1e-9), 9) AS b, y AS o, count(*)::DOUBLE AS c FROM tape GROUP BY 1, 2, 3")


@plan(
    "mutual_information",
    306,
    "symbol mutual_information",
    "SELECT symbol, sum(c / t * log2(c * t / (pb * po))) AS mutual_information FROM (SELECT *, sum(c) OVER (PARTITION BY symbol) AS t, sum(c) OVER (PARTITION BY symbol, b) AS pb, sum(c) OVER (PARTITION BY symbol, o) AS po FROM mi_j) GROUP BY symbol",
)
def _(t):
    return op.mutual_information(t.tape(), K)


q.cte("cm0", "SELECT symbol, greatest(1e-15, least(1 - 1e-15::DOUBLE, p)) AS pc, abs(p - 0.5) AS c, ((p >= 0.5) = (y = 1))::INT AS ok, greatest(p, 1 - p) AS cf FROM tape")


@plan(
    "confidence_metrics",
    (307, 308, 309),
    "symbol prediction_entropy confidence_accuracy_corr overconfidence underconfidence",
    "SELECT symbol, avg(-(pc * log2(pc) + (1 - pc) * log2(1 - pc))) AS prediction_entropy, corr(c, ok) AS confidence_accuracy_corr, avg((cf > 0.8 AND ok = 0)::INT) AS overconfidence, avg((cf < 0.6 AND ok = 1)::INT) AS underconfidence FROM cm0 GROUP BY symbol",
)
def _(t):
    return op.confidence_metrics(t.tape(), K)


@plan(
    "temporal_coverage",
    310,
    "symbol date coverage width mid_date:d",
    f"SELECT * FROM (SELECT symbol, date, {q.mean('(y_true BETWEEN q10 AND q90)::INT', 50)} AS coverage, {q.mean('(q90 - q10)', 50)} AS width, {q.lag('date', 24)} AS mid_date FROM qtape) WHERE coverage IS NOT NULL",
)
def _(t):
    return op.temporal_coverage(t.quantile_tape(), "y_true", "q10", "q90")


q.cte("cc0", "SELECT symbol, quantile_cont(sigma, 0) AS q0, quantile_cont(sigma, 1/3.0::DOUBLE) AS q1, quantile_cont(sigma, 2/3.0::DOUBLE) AS q2, quantile_cont(sigma, 1) AS q3 FROM tape GROUP BY symbol")
q.cte("cc1", "SELECT t.*, CASE WHEN sigma < q1 THEN 0 WHEN sigma < q2 THEN 1 ELSE 2 END AS fb, greatest(ceil(p * 10 - 1e-9), 1) - 1 AS bin FROM tape t JOIN cc0 USING (symbol) WHERE sigma < q3")
q.cte("cc2", "SELECT symbol, fb, bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM cc1 GROUP BY 1, 2, 3")


@plan(
    "conditional_calibration",
    311,
    "symbol feature_bin:i n_samples:i brier ece",
    "SELECT symbol, fb AS feature_bin, n_samples, brier, ece FROM (SELECT symbol, fb, count(*) AS n_samples, avg((p - y) * (p - y)) AS brier FROM cc1 GROUP BY 1, 2) JOIN (SELECT symbol, fb, sum(n * gap) / sum(n) AS ece FROM cc2 GROUP BY 1, 2) USING (symbol, fb) WHERE n_samples > 10",
)
def _(t):
    return op.conditional_calibration(t.tape(), "sigma", K)


@plan("reliability_diagram", 312, "symbol bin:i n:i confidence accuracy", "SELECT * FROM bins_r")
def _(t):
    return op.bin_table(t.tape(), K, closed="right")


q.cte("ov0", "SELECT score AS x, 0 AS s FROM tape UNION ALL SELECT y_true * 10, 1 FROM tape")
q.cte("ov1", "SELECT *, min(x) OVER () AS lo, max(x) OVER () AS hi FROM ov0")
q.cte("ov2", "SELECT least(floor((x - lo) / (hi - lo) * 100), 99) AS b, sum(1 - s) / (SELECT count(*) FROM tape)::DOUBLE AS pp, sum(s) / (SELECT count(*) FROM tape)::DOUBLE AS qq FROM ov1 GROUP BY 1")


@plan("histogram_overlap", 313, "overlap", "SELECT sum(least(pp, qq)) AS overlap FROM ov2")
def _(t):
    return op.histogram_overlap(t.tape().select(F.col("score").alias("x")), t.tape().select((F.col("y_true") * 10).alias("x")), "x")


@plan(
    "bhattacharyya_distance",
    314,
    "symbol distance",
    "SELECT symbol, 0.25 * ln(0.25 * (var_pop(score) / var_pop(y_true) + var_pop(y_true) / var_pop(score) + 2)) + 0.25 * (pow(avg(score) - avg(y_true), 2) / (var_pop(score) + var_pop(y_true))) AS distance FROM tape GROUP BY symbol",
)
def _(t):
    return op.bhattacharyya(t.tape(), K, "score", "y_true")


@plan("pit_statistics", 315, "symbol pit_mean pit_std", "SELECT symbol, avg(p) AS pit_mean, stddev_pop(p) AS pit_std FROM tape GROUP BY symbol")
def _(t):
    return op.pit(t.tape(), "p", K)


q.cte("cq0", "SELECT symbol, horizon, abs(y_true - 0.02 * score) AS s FROM tape")
q.cte("cq1", "SELECT symbol, horizon, list_sort(list(s)) AS l, count(*) AS n, (count(*) - 1) * least(1, 0.9 * (count(*) + 1) / count(*)) AS pos FROM cq0 GROUP BY 1, 2")
q.cte("cq", "SELECT symbol, horizon, n, l[floor(pos)::INT + 1] + (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) AS q FROM cq1")


def _cq(t):
    d = t.tape().withColumn("s", F.abs(F.col("y_true") - 0.02 * F.col("score")))
    return d, op.conformal_quantile(d, "s", 0.1, ["symbol", "horizon"])


@plan("conformal_quantile", 316, "symbol horizon:i n:i q", "SELECT * FROM cq")
def _(t):
    return _cq(t)[1]


@plan("conformal_interval", 317, "symbol date lower upper", "SELECT t.symbol, t.date, score - q AS lower, score + q AS upper FROM tape t JOIN cq USING (symbol, horizon)")
def _(t):
    d, cq = _cq(t)
    return op.conformal_interval(d, cq, "score", ["symbol", "horizon"])


q.cte("iso0", "SELECT floor(p * 1000) / 1000 AS bin, count(*) AS w, sum(y)::BIGINT AS s FROM tape GROUP BY 1")
q.cte("iso1", "SELECT bin, row_number() OVER o AS i, sum(w) OVER o AS w, sum(s) OVER o AS s FROM iso0 WINDOW o AS (ORDER BY bin)")
# the value at i is the most over starts j <= i of the least over ends k >= i of the mean of j..k
q.cte("iso2", "SELECT a.i AS j, b.i AS k, (b.s - coalesce(c.s, 0))::DOUBLE / (b.w - coalesce(c.w, 0)) AS m FROM iso1 a JOIN iso1 b ON b.i >= a.i LEFT JOIN iso1 c ON c.i = a.i - 1")
q.cte("iso3", "SELECT k AS i, max(least_mean) AS calibrated FROM (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS least_mean FROM iso2) GROUP BY k")


@plan("isotonic_calibration", 318, "symbol date p calibrated", "SELECT symbol, date, p, calibrated FROM tape JOIN iso1 ON bin = floor(p * 1000) / 1000 JOIN iso3 USING (i)")
def _(t):
    return isotonic(t.tape().withColumn("bin", F.floor(F.col("p") * 1000) / 1000), "bin", "y")


q.cte("platt0", f"SELECT symbol, date, p, y, ln(c / (1 - c)) AS x FROM (SELECT *, {q.clip('p', 1e-6, 1 - 1e-6)} AS c FROM tape)")
# Newton's steps on intercept and slope
_sums = "SELECT i, a, b, sum(y - m) AS ga, sum((y - m) * x) AS gb, sum(m * (1 - m)) AS haa, sum(m * (1 - m) * x) AS hab, sum(m * (1 - m) * x * x) AS hbb"
_fit = f"{_sums} FROM (SELECT i, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS m FROM it, platt0 WHERE i < 20) GROUP BY i, a, b"
_step = f"SELECT i + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM ({_fit})"
q.cte("platt1", f"WITH RECURSIVE it(i, a, b) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL {_step}) SELECT a, b FROM it WHERE i = 20")


@plan("platt_calibration", 319, "symbol date p calibrated", "SELECT symbol, date, p, 1 / (1 + exp(-(a + b * x))) AS calibrated FROM platt0, platt1")
def _(t):
    return op.platt(t.tape())


q.cte("tg0", f"SELECT symbol, date, sign(score) AS position, y_true, abs(sign(score) - coalesce({q.lag('sign(score)')}, 0)) AS tr FROM tape")
q.cte("tg1", f"SELECT *, position * y_true - 0.001 * tr AS n FROM tg0")
q.cte("tg2", f"SELECT *, {q.prod('(1 + n)')} AS eq FROM tg1")
q.cte("tg3", f"SELECT *, eq / {q.rmax('eq')} - 1 AS dd FROM tg2")


@plan(
    "trading_metrics",
    321,
    "symbol total_return annual_return volatility sharpe max_drawdown win_rate profit_factor n_trades",
    "SELECT symbol, arg_max(eq, date) - 1 AS total_return, avg(n) * 252 AS annual_return, stddev_samp(n) * sqrt(252) AS volatility, avg(n) / stddev_samp(n) * sqrt(252) AS sharpe, min(dd) AS max_drawdown, avg(CASE WHEN position <> 0 THEN (n > 0)::INT END) AS win_rate, "
    "sum(CASE WHEN n > 0 THEN n END) / sum(CASE WHEN n < 0 THEN -n END) AS profit_factor, sum((tr > 0)::INT) AS n_trades FROM tg3 GROUP BY symbol",
)
def _(t):
    return op.trading_metrics(t.tape().withColumn("position", F.signum("score")), ret="y_true")


q.cte("eg0", "SELECT symbol, p, y, CASE WHEN p <= 0.4 THEN -1 WHEN p >= 0.6 THEN 1 ELSE 0 END AS pos, y_true FROM tape")
q.cte(
    "eg1",
    "SELECT symbol, count(*) AS total, sum((pos <> 0)::INT) AS confident, coalesce(avg(CASE WHEN pos <> 0 THEN ((pos > 0) = (y = 1))::INT END), 0) AS precision, avg(((p >= 0.5) = (y = 1))::INT) AS accuracy, avg(pos * y_true) / stddev_samp(pos * y_true) * sqrt(252) AS sharpe FROM eg0 GROUP BY ROLLUP (symbol)",
)


@plan(
    "evaluation_gates",
    322,
    "symbol total:i confident:i precision coverage accuracy sharpe failures:s passed",
    """SELECT *, confident / total AS coverage, concat_ws(',', CASE WHEN total < 20 THEN 'insufficient_data' END, CASE WHEN precision < 0.5 THEN 'precision' END, CASE WHEN confident / total < 0.3 THEN 'coverage' END, CASE WHEN sharpe < 0 THEN 'sharpe' END) AS failures,
    (precision >= 0.5 AND confident / total >= 0.3 AND sharpe >= 0 AND total >= 20)::INT AS passed FROM eg1""",
)
def _(t):
    return op.evaluation_gates(t.tape().withColumn("ret", F.col("y_true")), min_precision=0.5)


q.cte("vc0", "SELECT symbol, quantile_cont(y_true, 0.05) AS q FROM tape GROUP BY symbol")


@plan("var_cvar", 323, "symbol var cvar", "SELECT symbol, -any_value(q) AS var, -avg(CASE WHEN y_true <= q THEN y_true END) AS cvar FROM tape JOIN vc0 USING (symbol) GROUP BY symbol")
def _(t):
    return op.var_cvar(t.tape(), "y_true", 0.95, K)


_rk = lambda x: f"rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0"
q.cte("ic0", f"SELECT symbol, {_rk('score')} AS a, {_rk('y_true')} AS b FROM tape")


@plan("information_coefficient", 320, "symbol n:i ic", "SELECT symbol, count(*) AS n, corr(a, b) AS ic FROM ic0 GROUP BY symbol")
def _(t):
    return op.information_coefficient(t.tape(), K, "score", "y_true")


# ---- accuracy tracking -------------------------------------------------------------------------------------------------
_acc = """count(*) AS n, avg((sign(score) = sign(y_true))::INT) AS directional_accuracy, avg((abs(y_true - score) <= 0.3)::INT) AS hit_rate, sqrt(avg(pow(y_true - score, 2))) AS rmse, avg(abs(y_true - score)) AS mae,
avg((score * y_true > 0)::INT) AS win_rate"""
q.cte("acc0", f"SELECT symbol, model, {_acc} FROM tape GROUP BY GROUPING SETS ((), (symbol), (model))")
_wl = "(directional_accuracy + 3.8416 / (2 * n) {s} 1.96 * sqrt(directional_accuracy * (1 - directional_accuracy) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"


@plan(
    "accuracy_windows",
    (99, 100),
    "symbol model:s n:i directional_accuracy hit_rate rmse mae win_rate ci_low ci_high",
    f"SELECT *, greatest(0, {_wl.format(s='-')}) AS ci_low, least(1, {_wl.format(s='+')}) AS ci_high FROM acc0",
)
def _(t):
    a, f = F.col("y_true"), F.col("score")
    aggs = [
        F.count("*").alias("n"), F.avg((F.signum(f) == F.signum(a)).cast("int")).alias("directional_accuracy"), F.avg((F.abs(a - f) <= 0.3).cast("int")).alias("hit_rate"),
        F.sqrt(F.avg(F.pow(a - f, 2))).alias("rmse"), F.avg(F.abs(a - f)).alias("mae"), F.avg((f * a > 0).cast("int")).alias("win_rate"), F.sum((F.signum(f) == F.signum(a)).cast("int")).alias("wins"),
    ]
    d = t.tape().groupingSets([[], ["symbol"], ["model"]], "symbol", "model").agg(*aggs)
    lo, hi = wilson_interval("wins", "n")
    return d.withColumns({"ci_low": lo, "ci_high": hi})


@plan(
    "window_result_aggregation",
    106,
    "symbol n:i mean_ret std_ret mean_score std_score",
    "SELECT symbol, count(*) AS n, avg(y_true) AS mean_ret, stddev_samp(y_true) AS std_ret, avg(score) AS mean_score, stddev_samp(score) AS std_score FROM flast GROUP BY symbol",
)
def _(t):
    return op.fold_last(t.tape()).groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg("y_true").alias("mean_ret"), F.stddev_samp("y_true").alias("std_ret"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score")
    )
