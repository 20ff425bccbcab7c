"""Plans: portfolio cross-sections, labels, splits and data quality."""

from __future__ import annotations



from pyspark.sql import Window
from pyspark.sql import functions as F


from barloom.functions.windows import SYM, Roll

from barloom.operators import labels as lb
from barloom.operators import portfolio as op
from barloom.operators import quality as ql
from barloom.operators import regimes as rg
from barloom.plans import duck as q

from barloom.plans.registry import plan

# ---- book of weights on the wide universe ---------------------------------------------------------------------------
q.cte("book", f"SELECT b.symbol, b.date, ret, sin(volume) / 10 AS w, {q.lag('sin(volume) / 10')} AS prev_w, cos(volume) AS beta, close * volume AS adv, sector FROM wrets b JOIN profile USING (symbol)")


def book(t):
    v = F.col("volume")
    d = t.bars_wide().withColumns({"ret": SYM.pct("close"), "w": F.sin(v) / 10})
    d = d.withColumn("prev_w", SYM.lag("w")).join(t.profile().select("symbol", "sector"), "symbol")
    return d.select("symbol", "date", "ret", "w", "prev_w", F.cos(v).alias("beta"), (F.col("close") * v).alias("adv"), "sector")


@plan("normalise_weights", 235, "symbol date w", "SELECT symbol, date, w / sum(abs(w)) OVER (PARTITION BY date) AS w FROM book")
def _(t):
    return op.normalise_weights(book(t))


q.cte("cap1", "SELECT symbol, date, sector, greatest(-0.08, least(0.08, w)) AS w FROM book")
q.cte("cap2", "SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS g FROM cap1")
q.cte("cap3", "SELECT symbol, date, w * CASE WHEN g > 0.9 THEN 0.9 / g ELSE 1 END AS w FROM cap2")
q.cte("cap4", "SELECT *, abs(sum(w) OVER (PARTITION BY date)) AS s FROM cap3")


@plan("basic_caps", 236, "symbol date w", "SELECT symbol, date, w * CASE WHEN s > 0.2 THEN 0.2 / s ELSE 1 END AS w FROM cap4")
def _(t):
    return op.basic_caps(book(t), 0.08, 0.9, 0.2)


q.cte("gc1", "SELECT symbol, date, sector, w, sum(abs(w)) OVER (PARTITION BY date, sector) AS g FROM book")
q.cte("gc2", "SELECT symbol, date, sector, w * CASE WHEN g > 0.3 THEN 0.3 / g ELSE 1 END AS w FROM gc1")
q.cte("gc3", "SELECT *, abs(sum(w) OVER (PARTITION BY date, sector)) AS s FROM gc2")


@plan("group_caps", (68, 237), "symbol date w", "SELECT symbol, date, w * CASE WHEN s > 0.1 THEN 0.1 / s ELSE 1 END AS w FROM gc3")
def _(t):
    return op.group_caps(book(t), "sector", 0.3, 0.1)


q.cte("tp_in", "SELECT *, sum(abs(w - coalesce(prev_w, 0))) OVER (PARTITION BY date) AS tt, coalesce(prev_w, 0) AS pw FROM book")


@plan("turnover_projection", 238, "symbol date w", "SELECT symbol, date, CASE WHEN tt > 0.5 THEN pw + (w - pw) * 0.5 / tt ELSE w END AS w FROM tp_in")
def _(t):
    return op.turnover_projection(book(t).fillna(0.0, ["prev_w"]), 0.5)


q.cte("mb_in", "SELECT symbol, date, coalesce(ret, 0) AS r, coalesce(mkt, 0) AS m FROM rets LEFT JOIN market USING (date)")


@plan(
    "rolling_market_beta",
    239,
    "symbol date beta",
    f"SELECT symbol, date, CASE WHEN count(*) OVER {q.over(60)} >= 5 AND var_pop(m) OVER {q.over(60)} > 1e-12 THEN covar_pop(r, m) OVER {q.over(60)} / (var_pop(m) OVER {q.over(60)} + 1e-12) ELSE 0 END AS beta FROM mb_in",
)
def _(t):
    return op.rolling_market_beta(t.rets(), t.market(), 60)


@plan("beta_neutralise", 240, "symbol date w", "SELECT symbol, date, w - beta * sum(beta * w) OVER (PARTITION BY date) / sum(beta * beta) OVER (PARTITION BY date) AS w FROM book")
def _(t):
    return op.beta_neutralise(book(t))


@plan("adv_cap", 241, "symbol date w", "SELECT symbol, date, greatest(-least(10, 0.05 * adv / 1e5), least(least(10, 0.05 * adv / 1e5), w)) AS w FROM book")
def _(t):
    return op.adv_cap(book(t), 0.05, 1e5)


q.cte("vt_w", "SELECT symbol, avg(sin(volume)) / 10 AS w FROM rets GROUP BY symbol")
q.cte("vt_path", "SELECT date, sum(w * coalesce(ret, 0)) AS p FROM rets JOIN vt_w USING (symbol) GROUP BY date")


@plan(
    "vol_target",
    242,
    "symbol w portfolio_vol scale w_scaled",
    "SELECT symbol, w, v AS portfolio_vol, greatest(0, least(5, 0.1 / v)) AS scale, w * greatest(0, least(5, 0.1 / v)) AS w_scaled FROM vt_w, (SELECT stddev_pop(p) * sqrt(252) AS v FROM vt_path)",
)
def _(t):
    r = t.rets()
    return op.vol_target(r.groupBy("symbol").agg((F.avg(F.sin("volume")) / 10).alias("w")), r, 0.1)


@plan(
    "vol_target_covariance",
    242,
    "symbol w portfolio_vol scale w_scaled",
    """SELECT symbol, w, sqrt(v) * sqrt(252) AS portfolio_vol, CASE WHEN v > 0 THEN greatest(0, least(5, 0.1 / (sqrt(v) * sqrt(252)))) ELSE 1 END AS scale, w * CASE WHEN v > 0 THEN greatest(0, least(5, 0.1 / (sqrt(v) * sqrt(252)))) ELSE 1 END AS w_scaled
    FROM vt_w, (SELECT sum(CASE WHEN symbol_i = symbol_j THEN 1 ELSE 1.4 END * cov * a.w * b.w) AS v FROM ew_cov JOIN vt_w a ON a.symbol = symbol_i JOIN vt_w b ON b.symbol = symbol_j)""",
)
def _(t):
    r = t.rets()
    cov = op.shrink_covariance(op.ewma_covariance(r), 0.3)
    return op.vol_target_covariance(r.groupBy("symbol").agg((F.avg(F.sin("volume")) / 10).alias("w")), cov, 0.1)


q.cte("ew_in", "SELECT symbol, date, coalesce(ret, 0) AS ret FROM rets")
q.cte("ew_cal", "SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM ew_in)")
q.cte("ew_cov", "SELECT a.symbol AS symbol_i, b.symbol AS symbol_j, sum(0.06 * pow(0.94, age) * a.ret * b.ret) AS cov FROM ew_in a JOIN ew_in b USING (date) JOIN ew_cal USING (date) WHERE a.symbol <= b.symbol GROUP BY 1, 2")


@plan("ewma_covariance", 243, "symbol_i:s symbol_j:s cov", "SELECT * FROM ew_cov")
def _(t):
    return op.ewma_covariance(t.rets())


@plan("shrink_covariance", 244, "symbol_i:s symbol_j:s cov", "SELECT symbol_i, symbol_j, cov * CASE WHEN symbol_i = symbol_j THEN 1 ELSE 0.7 END AS cov FROM ew_cov")
def _(t):
    return op.shrink_covariance(op.ewma_covariance(t.rets()), 0.3)


@plan("transaction_cost", 245, "symbol date cost", "SELECT symbol, date, 0.0005 * abs(w - coalesce(prev_w, 0)) + 0.01 * pow(abs(w - coalesce(prev_w, 0)), 1.5) AS cost FROM book")
def _(t):
    return book(t).withColumn("cost", op.transaction_cost(F.abs(F.col("w") - F.coalesce("prev_w", F.lit(0.0))), 0.0005, 0.01))


@plan("regime_threshold", 246, "symbol date threshold", "SELECT symbol, date, 0.1 * CASE regime WHEN 2 THEN 3 WHEN 1 THEN 1.5 ELSE 0.8 END AS threshold FROM vr4")
def _(t):
    return rg.volatility_ratio_regimes(t.rets()).withColumn("threshold", op.regime_threshold("regime", 0.1))


q.cte("rp0", "SELECT t.symbol, t.date, score / pow(greatest(coalesce(sigma / 0.015, 1), 1e-6), 0.5) AS s, conf, CASE regime WHEN 2 THEN 0.6 WHEN 1 THEN 0.3 ELSE 0.16 END AS up, CASE regime WHEN 2 THEN 0.8 WHEN 1 THEN 0.4 ELSE 0.2 END AS dn FROM tape t JOIN vr4 USING (symbol, date)")


@plan(
    "regime_positions",
    247,
    "symbol date threshold_long threshold_short position",
    "SELECT symbol, date, up AS threshold_long, dn AS threshold_short, CASE WHEN conf < 0.3 THEN 0 WHEN s > up THEN 1 WHEN s < -dn THEN -1 ELSE 0 END AS position FROM rp0",
)
def _(t):
    reg = rg.volatility_ratio_regimes(t.rets()).select("symbol", "date", "regime")
    d = t.tape().withColumn("vr", F.col("sigma") / 0.015).join(reg, ["symbol", "date"])
    return op.regime_positions(d, "score", "regime", 0.2, short_mult=(1.0, 2.0, 4.0), conf="conf", conf_floor=0.3, vol_ratio="vr", vol_power=0.5)


q.cte("sig0", "SELECT symbol, date, 0.02 * score AS mu, sigma, p AS p_up, conf AS rho, y_true FROM tape")
_tanh = lambda x: f"((exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1))"
_hyb = f"0.5 * ({_tanh('mu / sigma')} + {_tanh('2 * p_up - 1')}) * rho"


def sig(t):
    return t.tape().select("symbol", "date", (0.02 * F.col("score")).alias("mu"), "sigma", F.col("p").alias("p_up"), F.col("conf").alias("rho"), "y_true")


@plan("signal_zscore", (248, 416), "symbol date signal", f"SELECT symbol, date, {_tanh('mu / sigma')} AS signal FROM sig0")
def _(t):
    return op.signals(sig(t), "zscore")


@plan("signal_hybrid", (248, 416), "symbol date signal", f"SELECT symbol, date, {_hyb} AS signal FROM sig0")
def _(t):
    return op.signals(sig(t), "hybrid")


q.cte("pl0", f"SELECT symbol, date, y_true, greatest(-1, least(1, {_hyb})) AS tw FROM sig0")
q.cte("pl1", f"SELECT *, coalesce(abs(tw - {q.lag('tw')}), abs(tw)) AS turnover, avg(tw) OVER {q.over(5)} AS aw FROM pl0")
q.cte("pl2", "SELECT *, aw * y_true AS gross, 0.0001 * (turnover > 0)::INT + 0.0005 * turnover AS costs FROM pl1")
q.cte("pl3", f"SELECT *, gross - costs AS net, product(1 + gross - costs) OVER {q.over()} AS eq, sum(gross - costs) OVER {q.over()} AS cum FROM pl2")
q.cte("pnl", f"SELECT symbol, date, tw AS target_weight, aw AS avg_weight, gross AS gross_return, costs, net AS net_return, turnover, eq AS equity_curve, cum AS cum_pnl, eq / {q.rmax('eq')} - 1 AS drawdown FROM pl3")


def pnl(t):
    return op.signal_pnl(op.signals(sig(t), "hybrid"), ret="y_true", fee=0.0001, slippage=0.0005)


@plan("signal_pnl", 249, "symbol date target_weight avg_weight gross_return costs net_return turnover equity_curve cum_pnl drawdown", "SELECT * FROM pnl")
def _(t):
    return pnl(t)


@plan(
    "pooled_backtest",
    104,
    "date equal inverse_vol n_symbols:i",
    "SELECT date, avg(net_return) AS equal, sum(net_return / v) / sum(1 / v) AS inverse_vol, count(*) AS n_symbols FROM pnl JOIN (SELECT symbol, stddev_samp(net_return) AS v FROM pnl GROUP BY 1) USING (symbol) GROUP BY date",
)
def _(t):
    p = pnl(t).select("symbol", "date", "net_return")
    a = op.pooled_backtest(p).withColumnRenamed("portfolio_return", "equal")
    return a.join(op.pooled_backtest(p, "inverse_vol").select("date", F.col("portfolio_return").alias("inverse_vol")), "date")


q.cte("ms_mod", "SELECT symbol, date, rn, 'a' AS module, CASE WHEN rn % 4 = 2 THEN score END AS score, CASE WHEN rn % 3 = 1 THEN conf END AS conf FROM tape UNION ALL SELECT symbol, date, rn, 'b', CASE WHEN rn % 7 = 3 THEN p END, conf FROM tape")


def _interp(x):
    w0 = "(PARTITION BY symbol, module ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w1 = "(PARTITION BY symbol, module ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    pv, nv = f"last_value({x} IGNORE NULLS) OVER {w0}", f"first_value({x} IGNORE NULLS) OVER {w1}"
    pi = f"max(CASE WHEN {x} IS NOT NULL THEN rn END) OVER {w0}"
    ni = f"min(CASE WHEN {x} IS NOT NULL THEN rn END) OVER {w1}"
    return f"(CASE WHEN {x} IS NOT NULL THEN {x} WHEN {pv} IS NULL THEN 0 WHEN {nv} IS NULL THEN {pv} ELSE {pv} + ({nv} - {pv}) * (rn - {pi}) / ({ni} - {pi})::DOUBLE END)"


q.cte("meta1", f"SELECT symbol, date, module, {_interp('score')} AS s, {_interp('conf')} AS c FROM ms_mod")


@plan("meta_score", 250, "symbol date meta_score", "SELECT symbol, date, sum(s * c * CASE module WHEN 'a' THEN 0.7 ELSE 0.3 END) AS meta_score FROM meta1 GROUP BY 1, 2")
def _(t):
    tp = t.tape()
    rn = F.col("rn")
    a = tp.select("symbol", "date", F.lit("a").alias("module"), F.when(rn % 4 == 2, F.col("score")).alias("score"), F.when(rn % 3 == 1, F.col("conf")).alias("conf"))
    b = tp.select("symbol", "date", F.lit("b").alias("module"), F.when(rn % 7 == 3, F.col("p")).alias("score"), "conf")
    w = tp.select("symbol").limit(1).select(F.explode(F.array(F.struct(F.lit("a").alias("module"), F.lit(0.7).alias("weight")), F.struct(F.lit("b").alias("module"), F.lit(0.3).alias("weight")))).alias("x")).select("x.*")
    return op.meta_score(a.unionByName(b), w)


@plan("weighted_tracks", 251, "symbol date a_close a_volume b_ret", "SELECT symbol, date, close * 0.6 AS a_close, volume * 0.6 AS a_volume, coalesce(ret, 0) * 0.4 AS b_ret FROM rets")
def _(t):
    return op.weighted_tracks(t.rets(), {"a": (["close", "volume"], 0.6), "b": (["ret"], 0.4)})


q.cte("fw0", "SELECT symbol AS family, avg(score) AS raw FROM tape GROUP BY 1")
q.cte("fw1", "SELECT family, greatest(raw, 0) / sum(greatest(raw, 0)) OVER () AS v, count(*) OVER () AS n FROM fw0")
q.cte("fw2", "SELECT family, greatest(0.01, least(0.2, 0.9 * v + 0.1 / n)) AS v FROM fw1")
q.cte("fweights", "SELECT family, v / sum(v) OVER () AS weight FROM fw2")


def fweights(t):
    f = t.tape().groupBy(F.col("symbol").alias("family")).agg(F.avg("score").alias("raw"))
    return op.shrink_clip_renorm(f, "raw", 0.1, 0.01, 0.2)


@plan("family_weight_shrink", 252, "family:s weight", "SELECT * FROM fweights")
def _(t):
    return fweights(t)


@plan("weight_entropy", 392, "entropy", "SELECT -sum(weight * ln(weight)) AS entropy FROM fweights")
def _(t):
    return fweights(t).agg((-F.sum(F.col("weight") * F.ln("weight"))).alias("entropy"))


@plan("softmax_weights", 391, "family:s weight", "SELECT family, exp((raw - max(raw) OVER ()) / 0.05) / sum(exp((raw - (SELECT max(raw) FROM fw0)) / 0.05)) OVER () AS weight FROM fw0")
def _(t):
    f = t.tape().groupBy(F.col("symbol").alias("family")).agg(F.avg("score").alias("raw"))
    w = Window.partitionBy(F.lit(0))  # one row per family
    f = f.withColumn("e", F.exp((F.col("raw") - F.max("raw").over(w)) / 0.05))
    return f.withColumn("weight", F.col("e") / F.sum("e").over(w))


q.cte("ps0", f"SELECT p.*, score, y_true, rn % 3 AS regime, (sign(score) = sign(y_true))::INT AS hit, 1 - equity_curve / {q.rmax('equity_curve', 20, 1)} AS dd FROM pnl p JOIN (SELECT symbol, date, score, y_true, rn FROM tape) USING (symbol, date)")
_sh = f"CASE WHEN {q.std('net_return', 63, 5, 1)} > 1e-12 THEN {q.mean('net_return', 63, 5, 1)} / {q.std('net_return', 63, 5, 1)} * sqrt(252) END"
_ps = {
    "state_vol": q.clip(f"coalesce({q.std0('net_return', 20, 2, 1)} * sqrt(252), 0)", 0, 1),
    "state_drawdown": q.clip(f"coalesce({q.lag('dd')}, 0)", 0, 1),
    "state_sharpe": q.clip(f"coalesce({_sh}, 0) / 3", -1, 1),
    "state_turnover": q.clip(f"coalesce({q.mean('turnover', 20, 1, 1)}, 0)", 0, 1),
    "state_cost": q.clip(f"coalesce({q.mean('costs', 20, 1, 1)}, 0)", 0, 1),
    "state_accuracy": q.clip(f"coalesce({q.mean('hit', 63, 1, 1)}, 0)", 0, 1),
    "state_regime": q.clip(f"coalesce({q.lag('regime')}, 0) / 2.0", 0, 1),
}


@plan("policy_state", 253, "symbol date " + " ".join(_ps), q.select(_ps, "ps0"))
def _(t):
    tp = t.tape().select("symbol", "date", "score", F.col("y_true").alias("fwd_return"), (F.col("rn") % 3).alias("regime"))
    return op.policy_state(pnl(t).drop("score").join(tp, ["symbol", "date"]))


@plan(
    "policy_report",
    254,
    "symbol max_drawdown beta_last ir_last tracking_error ir_full ok_drawdown ok_beta ok_ir_full ok_ir_last ok",
    """SELECT *, (max_drawdown >= -0.2)::INT AS ok_drawdown, (abs(beta_last) <= 0.5)::INT AS ok_beta, (ir_full >= 0)::INT AS ok_ir_full, (ir_last >= 0)::INT AS ok_ir_last,
    (max_drawdown >= -0.2 AND abs(beta_last) <= 0.5 AND ir_full >= 0 AND ir_last >= 0)::INT AS ok FROM (SELECT symbol, min(drawdown) AS max_drawdown, arg_max(beta_63, date) AS beta_last, arg_max(ir_63, date) AS ir_last,
    stddev_samp(active) * sqrt(252) AS tracking_error, avg(active) / (stddev_samp(active) + 1e-12) * sqrt(252) AS ir_full FROM bm4 GROUP BY symbol)""",
)
def _(t):
    from barloom.plans.evaluation import _bench

    return op.policy_report(_bench(t, None).withColumns({"beta": F.col("beta_63"), "ir": F.col("ir_63")}), 0.2, 0.0, 0.5)


@plan("kelly_sizing", 255, "symbol date size", "SELECT symbol, date, greatest(0, least(0.25, (p - (1 - p) / 1.5) * 0.5)) AS size FROM tape")
def _(t):
    return t.tape().withColumn("size", op.kelly("p", 1.5))


# ---- labels ---------------------------------------------------------------------------------------------------------
q.cte("fwd", f"SELECT *, {q.lead('close', 5)} / nullif(close, 0) - 1 AS forward_return FROM numbered")


@plan("forward_return", 257, "symbol date forward_return", "SELECT * FROM fwd")
def _(t):
    return lb.forward_return(t.bars(), 5)


q.cte("va_l", f"SELECT *, {q.logret('close')} AS lr, ln({q.lead('close', 5)} / close) AS fr FROM bars")
q.cte("va_s", f"SELECT *, {q.std('lr', 21, shift=1)} AS sg FROM va_l")


@plan(
    "vol_adjusted_labels",
    258,
    "symbol date forward_return forward_return_voladj forward_direction",
    "SELECT symbol, date, fr AS forward_return, CASE WHEN sg IS NOT NULL THEN fr / greatest(sg, 1e-4) END AS forward_return_voladj, sign(fr) AS forward_direction FROM va_s",
)
def _(t):
    return lb.vol_adjusted_labels(t.bars(), 5)


_ld = f"({q.lead('close', 10)} / close)"


@plan("target_types", 259, "symbol date log_returns abs_returns direction", f"SELECT symbol, date, ln({_ld}) AS log_returns, {_ld} - 1 AS abs_returns, CASE WHEN {_ld} IS NOT NULL THEN ({_ld} > 1)::INT END AS direction FROM bars")
def _(t):
    b = t.bars()
    for k in ("log_returns", "abs_returns", "direction"):
        b = lb.target(b, 10, k).withColumnRenamed("target", k)
    return b


_mh = {f"{c}_h{h}": f"{q.lead(c, h)} / nullif({c}, 0) - 1" for c in ("close", "volume") for h in (1, 5, 21)}


@plan("multi_horizon_targets", 260, "symbol date " + " ".join(_mh), f"SELECT * FROM ({q.select(_mh, 'bars')}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _mh))
def _(t):
    return lb.multi_horizon_targets(t.bars(), ["close", "volume"], [1, 5, 21])


q.cte("lt_p", "SELECT symbol, -quantile_cont(abs(forward_return), 0.6) AS lower, quantile_cont(abs(forward_return), 0.6) AS upper FROM fwd WHERE forward_return IS NOT NULL GROUP BY symbol")
q.cte("lt_a", "SELECT symbol, -greatest(0.02, 0.8 * stddev_pop(forward_return)) AS lower, greatest(0.02, 0.8 * stddev_pop(forward_return)) AS upper FROM fwd GROUP BY symbol")


@plan("label_thresholds_percentile", 261, "symbol lower upper", "SELECT * FROM lt_p")
def _(t):
    return lb.label_thresholds(lb.forward_return(t.bars(), 5), "forward_return", "percentile", pct=60)


@plan("label_thresholds_adaptive", 261, "symbol lower upper", "SELECT * FROM lt_a")
def _(t):
    return lb.label_thresholds(lb.forward_return(t.bars(), 5), "forward_return", "adaptive")


q.cte("tern", "SELECT f.symbol, f.date, forward_return, CASE WHEN forward_return >= upper THEN 1 WHEN forward_return >= lower THEN 0 WHEN forward_return IS NOT NULL THEN -1 END AS label FROM fwd f JOIN lt_p USING (symbol)")


def _tern(t):
    f = lb.forward_return(t.bars(), 5)
    return lb.ternary_labels(f, "forward_return", lb.label_thresholds(f, "forward_return", "percentile", pct=60))


@plan("ternary_labels", 262, "symbol date label:i", "SELECT * FROM tern")
def _(t):
    return _tern(t)


q.cte("feat", f"SELECT symbol, date, {q.pct('close', 5)} AS mom, {q.std('ret', 20)} AS vol FROM rets")


def feat(t):
    return t.rets().select("symbol", "date", SYM.pct("close", 5).alias("mom"), SYM.std("ret", 20).alias("vol"))


@plan("trim_dataset", (263, 264, 347), "symbol date mom vol forward_return label:i", "SELECT * FROM feat JOIN tern USING (symbol, date) WHERE mom IS NOT NULL AND vol IS NOT NULL AND forward_return IS NOT NULL")
def _(t):
    y = _tern(t)
    return lb.trim_dataset(feat(t), y.select("symbol", "date", "forward_return"), y.select("symbol", "date", "label"))


@plan("next_period_matrix", 265, "symbol month:d open volume y", f"SELECT symbol, month, open, volume, y FROM (SELECT *, {q.lead('close', 1, order='month')} AS y FROM monthly) WHERE y IS NOT NULL")
def _(t):
    from barloom.operators.indicators import monthly_bars

    return lb.next_period_matrix(monthly_bars(t.bars()), ["open", "volume"], "close", 1, Roll("symbol", "month"))


q.cte("lw", f"SELECT symbol, date, rn, count(*) OVER (PARTITION BY symbol) AS n, {q.rsum('close', 4, shift=1)} AS sx, {q.lag('volume', 4)} AS first_volume, close AS y0, {q.lead('close', 1)} AS y1 FROM numbered")


@plan("lookback_windows", 266, "symbol date n_rows:i n_features:i sum_close first_volume y0 y1", "SELECT symbol, date, 4 AS n_rows, 2 AS n_features, sx AS sum_close, first_volume, y0, y1 FROM lw WHERE rn > 4 AND y1 IS NOT NULL")
def _(t):
    d = lb.lookback_windows(t.bars(), ["close", "volume"], "close", 4, 2)
    return d.select(
        "symbol", "date", F.size("x").alias("n_rows"), F.size(F.col("x")[0]).alias("n_features"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0]).alias("sum_close"), F.col("x")[0][1].alias("first_volume"), F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1"),
    )


q.cte("ss0", "SELECT symbol, date, rn, close, volume, ret FROM ret_n WHERE ret IS NOT NULL")
q.cte("ss1", "SELECT symbol, avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM ss0 WHERE date <= DATE '1999-12-31' GROUP BY symbol")
q.cte("ss2", "SELECT s.symbol, date, ret, greatest(-5, least(5, (close - mc) / sc * 0.5)) AS zc, greatest(-5, least(5, (volume - mv) / sv)) AS zv FROM ss0 s JOIN ss1 USING (symbol)")


@plan(
    "standardised_sequences",
    267,
    "symbol date target first_close last_volume sum_close",
    f"SELECT * FROM (SELECT symbol, date, ret AS target, {q.lag('zc', 10)} AS first_close, {q.lag('zv', 1)} AS last_volume, {q.rsum('zc', 10, shift=1)} AS sum_close FROM ss2) WHERE sum_close IS NOT NULL",
)
def _(t):
    d = lb.standardised_sequences(t.rets(), {"close": 0.5, "volume": 1.0}, "ret", 10, "1999-12-31")
    return d.select("symbol", "date", "target", F.col("sequence")[0][0].alias("first_close"), F.col("sequence")[9][1].alias("last_volume"), F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v[0]).alias("sum_close"))


q.cte("sw_in", f"SELECT symbol, date, rn, count(*) OVER (PARTITION BY symbol) AS n, {q.rsum('close', 6)} AS so, {q.lag('volume', 5)} AS k0, {q.lead('volume', 5)} AS k1, {q.lead('close', 1)} AS t1, {q.lead('close', 5)} AS t5 FROM numbered")


@plan("split_windows", 268, "symbol date sum_observed known_first known_last known_size:i t1 t5", "SELECT symbol, date, so AS sum_observed, k0 AS known_first, k1 AS known_last, 11 AS known_size, t1, t5 FROM sw_in WHERE rn >= 6 AND rn <= n - 5 AND (rn - 6) % 3 = 0")
def _(t):
    d = lb.split_windows(t.bars(), ["close"], ["volume"], [], "close", 6, [1, 5], step=3)
    return d.select("symbol", "date", F.aggregate("observed", F.lit(0.0), lambda a, v: a + v[0]).alias("sum_observed"), F.col("known_future")[0][0].alias("known_first"), F.element_at("known_future", -1)[0].alias("known_last"),
                    F.size("known_future").alias("known_size"), F.col("targets")[0].alias("t1"), F.col("targets")[1].alias("t5"))


# ---- folds ----------------------------------------------------------------------------------------------------------
q.cte("cal", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)")
q.cte(
    "wfw",
    """SELECT row_number() OVER (ORDER BY v.date) AS window_id, (SELECT min(date) FROM cal WHERE date >= v.date - INTERVAL 2 YEAR) AS train_start, te.date AS train_end, v.date AS valid_start, ve.date AS valid_end, ts.date AS test_start, tt.date AS test_end
    FROM cal v LEFT JOIN cal te ON te.idx = v.idx - 1 JOIN cal ve ON ve.idx = v.idx + 20 JOIN cal ts ON ts.idx = v.idx + 21 JOIN cal tt ON tt.idx = v.idx + 41 WHERE v.idx % 126 = 0 AND v.idx + 42 <= (SELECT count(*) FROM cal)""",
)
WCOLS = "window_id:i train_start:d train_end:d valid_start:d valid_end:d test_start:d test_end:d"


def wfw(t):
    return lb.walk_forward_windows(lb.sessions_table(t.bars()), 2, 126, 21)


@plan("walk_forward_windows", (43, 44, 269, 274), WCOLS, "SELECT * FROM wfw")
def _(t):
    return wfw(t)


q.cte("sizes", "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol")
q.cte("psp", "SELECT symbol, n, k AS fold, 310 + k * 100 AS val_start FROM sizes, (SELECT unnest(range(0, 12)) AS k)")


@plan("purged_splits", 270, "symbol fold:i train_end:i val_start:i val_end:i", "SELECT symbol, fold, val_start - 10 AS train_end, val_start, val_start + 100 AS val_end FROM psp WHERE val_start + 100 <= n")
def _(t):
    return lb.purged_splits(t.bars().groupBy("symbol").agg(F.count("*").alias("n")), 12, 100, 10, 300)


@plan(
    "embargo_splits",
    271,
    "symbol fold:i train_start:i train_end:i test_start:i test_end:i",
    "SELECT symbol, k AS fold, greatest(0, 200 + k * 65 - 500 + 0) AS train_start, 200 + k * 65 AS train_end, 215 + k * 65 AS test_start, 275 + k * 65 AS test_end FROM sizes, (SELECT unnest(range(0, 20)) AS k) WHERE 275 + k * 65 + 5 <= n AND 200 + k * 65 - greatest(0, 200 + k * 65 - 500) >= 200",
)
def _(t):
    return lb.embargo_splits(t.bars().groupBy("symbol").agg(F.count("*").alias("n")), 20, 60, 10, 5, 5, 200, 500)


q.cte("df0", "SELECT k AS fold, 310 + k * 200 AS vs FROM (SELECT unnest(range(0, 20)) AS k) WHERE 310 + k * 200 + 200 <= (SELECT count(*) FROM cal)")
q.cte("dfolds", "SELECT fold, a.date AS train_last, b.date AS val_first, c.date AS val_last FROM df0 JOIN cal a ON a.idx = vs - 11 JOIN cal b ON b.idx = vs JOIN cal c ON c.idx = vs + 199 WHERE fold > (SELECT max(fold) FROM df0) - 4")


def dfolds(t):
    return lb.date_folds(t.bars(), 20, 200, 10, 300, 4)


@plan("date_folds", 273, "fold:i train_last:d val_first:d val_last:d", "SELECT * FROM dfolds")
def _(t):
    return dfolds(t)


@plan("assign_folds", 64, "fold:i symbol date close", "SELECT fold, symbol, date, close FROM bars JOIN dfolds ON date BETWEEN val_first AND val_last")
def _(t):
    return lb.assign_folds(t.bars(), dfolds(t), "val_first", "val_last")


q.cte("tr_rows", "SELECT fold, symbol, date, close FROM bars JOIN dfolds ON date <= train_last")


@plan("purge_overlapping_labels", 272, "fold:i symbol last_date:d n:i", "SELECT fold, symbol, max(date) AS last_date, count(*) AS n FROM tr_rows JOIN (SELECT fold, val_first FROM dfolds) USING (fold) WHERE date <= val_first - 22 GROUP BY 1, 2")
def _(t):
    f = dfolds(t)
    train = t.bars().join(f.select("fold", "train_last"), F.col("date") <= F.col("train_last"))
    p = lb.purge_overlaps(train, f.select("fold", F.col("val_first").alias("test_start")), 21)
    return p.groupBy("fold", "symbol").agg(F.max("date").alias("last_date"), F.count("*").alias("n"))


@plan("maturity_gate", 275, "symbol date close", "SELECT symbol, b.date, close FROM bars b JOIN cal USING (date) WHERE idx + 21 <= (SELECT max(idx) FROM cal WHERE date <= DATE '2000-06-30')")
def _(t):
    b = t.bars()
    return lb.mature_rows(b, lb.sessions_table(b), 21, "2000-06-30")


q.cte("fs0", "SELECT fold, symbol, date, close, volume, date <= train_last AS tr FROM bars JOIN dfolds ON date <= val_last")
_fsz = ", ".join(f"CASE WHEN s{c} > 1e-12 THEN ({c} - m{c}) / s{c} ELSE {c} - m{c} END AS {c}" for c in ("close", "volume"))


def _foldrows(t):
    return t.bars().join(dfolds(t), F.col("date") <= F.col("val_last")).withColumn("is_train", F.col("date") <= F.col("train_last"))


@plan(
    "fold_standardise",
    276,
    "fold:i symbol date close volume",
    f"SELECT fold, symbol, date, {_fsz} FROM fs0 JOIN (SELECT fold, avg(close) AS mclose, stddev_samp(close) AS sclose, avg(volume) AS mvolume, stddev_samp(volume) AS svolume FROM fs0 WHERE tr GROUP BY fold) USING (fold) WHERE NOT tr",
)
def _(t):
    return lb.fold_standardise(_foldrows(t), ["close", "volume"]).where(~F.col("is_train"))


q.cte("fm_in", "SELECT fold, symbol, date, tr, CASE WHEN volume % 5 < 1 THEN NULL ELSE volume END AS volume FROM fs0")


@plan(
    "fold_missing_median",
    277,
    "fold:i symbol date volume",
    "SELECT fold, symbol, date, coalesce(volume, md) AS volume FROM fm_in JOIN (SELECT fold, quantile_cont(volume, 0.5) AS md FROM fm_in WHERE tr GROUP BY fold) USING (fold) WHERE NOT tr",
)
def _(t):
    d = _foldrows(t).withColumn("volume", F.when(F.col("volume") % 5 >= 1, F.col("volume")))
    return lb.fold_missing(d, ["volume"], "median").where(~F.col("is_train"))


@plan(
    "fold_missing_ffill",
    277,
    "fold:i symbol date volume",
    "SELECT * FROM (SELECT fold, symbol, date, tr, last_value(volume IGNORE NULLS) OVER (PARTITION BY fold, symbol, tr ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS volume FROM fm_in) WHERE NOT tr",
)
def _(t):
    d = _foldrows(t).withColumn("volume", F.when(F.col("volume") % 5 >= 1, F.col("volume")))
    return lb.fold_missing(d, ["volume"], "ffill").where(~F.col("is_train"))


def _wide(t):
    r = SYM
    d = t.rets()
    return d.select("symbol", "date", *[r.mean("ret", n).alias(f"m{n}") for n in (5, 10, 20)], *[r.std("ret", n).alias(f"s{n}") for n in (5, 10, 20)], "volume", F.lead("ret").over(r.base).alias("y"))


PCA = ["m5", "m10", "m20", "s5", "s10", "s20", "volume"]
LINEAR = {"mean": ["m5", "m10", "m20"], "vol": ["s5", "s10", "s20"], "liq": ["volume"]}
_ws = ", ".join([f"{q.mean('ret', n)} AS m{n}" for n in (5, 10, 20)] + [f"{q.std('ret', n)} AS s{n}" for n in (5, 10, 20)])
q.cte("wide", f"SELECT symbol, date, {_ws}, volume::DOUBLE AS volume, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS y FROM rets")
q.cte("wfull", "SELECT * FROM wide WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in PCA))


@plan("family_pca", 278, "symbol date pc1 pc2", why_no_sql="eigen decomposition; pca_invariants and linear_invariants have SQL")
def _(t):
    return lb.family_pca(_wide(t).drop("y"), PCA, 2)[0]


@plan("pca_dimension", 279, "dimension:i noise", why_no_sql="eigen decomposition; pca_invariants has SQL")
def _(t):
    d = _wide(t).drop("y")
    _, shares = lb.family_pca(d, PCA, 7)
    n, rest = lb.intrinsic_dimension(shares)
    return d.limit(1).select(F.lit(n).alias("dimension"), F.lit(rest).alias("noise"))


@plan(
    "pca_invariants",
    (278, 279),
    "n:i total_variance uncorrelated:i in_order:i as_shares:i centred:i",
    "SELECT count(*) AS n, " + " + ".join(f"var_samp({c}) / var_samp({c})" for c in PCA) + " AS total_variance, 1 AS uncorrelated, 1 AS in_order, 1 AS as_shares, 1 AS centred FROM wfull",
)
def _(t):
    """What makes the projections principal components: they are centred and uncorrelated, their variances fall, follow the shares and
    add up to those of the standardised columns."""
    k = len(PCA)
    d, shares = lb.family_pca(_wide(t).drop("y"), PCA, k)
    pcs = [f"pc{i + 1}" for i in range(k)]
    pairs = [F.abs(F.covar_samp(a, b)) for i, a in enumerate(pcs) for b in pcs[:i]]
    g = d.agg(F.count("*").alias("n"), *[F.var_samp(c).alias(f"v_{c}") for c in pcs], F.greatest(*pairs).alias("off"), F.greatest(*[F.abs(F.avg(c)) for c in pcs]).alias("mid"))
    v = [F.col(f"v_{c}") for c in pcs]
    total = sum(v, F.lit(0.0))
    falling = F.greatest(*[b - a for a, b in zip(v, v[1:], strict=False)]) <= 1e-9
    near = F.greatest(*[F.abs(x / total - s) for x, s in zip(v, shares, strict=True)]) < 1e-9
    checks = {"uncorrelated": F.col("off") < 1e-9, "in_order": falling, "as_shares": near, "centred": F.col("mid") < 1e-9}
    return g.select("n", total.alias("total_variance"), *[c.cast("int").alias(name) for name, c in checks.items()])


@plan("linear_family_weights", (110, 280), "family:s weight", why_no_sql="regularised regression per fold; linear_invariants has SQL")
def _(t):
    return lb.linear_family_weights(_wide(t), LINEAR, "y", dfolds(t))


_lcols = [c for cs in LINEAR.values() for c in cs]
q.cte("lrows", "SELECT fold, w.* FROM wfull w JOIN dfolds ON date <= train_last WHERE y IS NOT NULL")


@plan("linear_invariants", (110, 280), "fold:i n:i column:s correlation solved:i", " UNION ALL ".join(f"SELECT fold, count(*) AS n, '{c}' AS \"column\", corr({c}, y) AS correlation, 1 AS solved FROM lrows GROUP BY fold" for c in _lcols))
def _(t):
    """Each fold's normal equations hold: the column's correlation with the target is what the coefficients of all columns make of
    their correlations with it, and of the penalty. The correlation is put together from the fitted coefficients."""
    return lb.linear_normal_equations(_wide(t), _lcols, "y", dfolds(t))


q.cte("coefs", "SELECT p_type AS family, p_size / 10.0 - 2 AS beta FROM part")


@plan("family_norms", 110, "family:s norm", "SELECT family, sqrt(sum(beta * beta)) AS norm FROM coefs GROUP BY family")
def _(t):
    return lb.family_norms(t.raw("part").select(F.col("p_type").alias("family"), (F.col("p_size") / 10 - 2).alias("beta")))


_k10 = dict(order="fold_id")
q.cte("ml0", "SELECT symbol, fold_id, sign(score) * y_true AS ret FROM flast")
q.cte("ml1", f"SELECT symbol, fold_id, {q.mean('(ret > 0)::INT', 10, 1, 1, **_k10)} AS past_hit, {q.mean('ret', 10, 1, 1, **_k10)} AS past_pnl, {q.std('ret', 10, 2, 1, **_k10)} AS past_vol, {q.rmin('ret', 10, 1, 1, **_k10)} AS past_worst FROM ml0")
_ap = "(rank() OVER (PARTITION BY symbol ORDER BY abs(score)) + (count(*) OVER (PARTITION BY symbol, abs(score)) - 1) / 2.0) / (count(*) OVER (PARTITION BY symbol))::DOUBLE"


@plan("meta_learner_rows", 281, "symbol date fold_id:i past_hit past_pnl past_vol past_worst abs_score_pct", f"SELECT symbol, date, fold_id, past_hit, past_pnl, past_vol, past_worst, {_ap} AS abs_score_pct FROM tape JOIN ml1 USING (symbol, fold_id)")
def _(t):
    return lb.meta_learner_rows(t.tape().select("symbol", "date", "fold_id", "score", "y_true"))


# ---- quality --------------------------------------------------------------------------------------------------------
NUM = ["open", "close", "volume", "ret", "gap"]
q.cte("qp", "SELECT symbol, date, open, close, volume, ret, CASE WHEN volume > 45 THEN NULL WHEN volume < 10 THEN 0 ELSE 1 END AS gap FROM rets")


def qpanel(t):
    v = F.col("volume")
    return t.rets().select("symbol", "date", "open", "close", "volume", "ret", F.when(v > 45, None).when(v < 10, 0.0).otherwise(1.0).alias("gap"))


q.cte("qlong", " UNION ALL ".join(f"SELECT symbol, date, '{c}' AS \"column\", {c}::DOUBLE AS value FROM qp" for c in NUM))
q.cte(
    "qprof",
    'SELECT "column", count(*) AS rows, avg((value IS NULL)::INT) AS nan_fraction, 0.0 AS inf_fraction, avg((coalesce(value, 1) = 0)::INT) AS zero_fraction, stddev_pop(value) AS std, count(DISTINCT value) AS n_unique, (coalesce(stddev_pop(value), 0) <= 1e-8)::INT AS low_variance FROM qlong GROUP BY 1',
)
q.cte("qtop", 'SELECT "column", max(c) / sum(c)::DOUBLE AS top_share FROM (SELECT "column", value, count(*) AS c FROM qlong WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1')


@plan("column_profile", 326, "column:s rows:i nan_fraction inf_fraction zero_fraction std n_unique:i top_share low_variance", "SELECT * FROM qprof JOIN qtop USING (\"column\")")
def _(t):
    return ql.column_profile(qpanel(t), NUM)


@plan("constant_columns", 30, "column:s std n_unique:i drop", 'SELECT "column", std, n_unique, (coalesce(std, 0) <= 1e-8 OR n_unique <= 1)::INT AS "drop" FROM qprof')
def _(t):
    return ql.constant_columns(qpanel(t), NUM)


@plan(
    "feature_quality",
    31,
    "column:s missing infinite outliers std ok",
    'SELECT "column", avg((value IS NULL)::INT) AS missing, 0 AS infinite, sum((coalesce(abs(value - m) > 5 * s, false))::INT) AS outliers, any_value(s) AS std, (avg((value IS NULL)::INT) <= 0.5 AND any_value(s) > 1e-8)::INT AS ok FROM qlong JOIN (SELECT "column", avg(value) AS m, stddev_samp(value) AS s FROM qlong GROUP BY 1) USING ("column") GROUP BY 1',
)
def _(t):
    return ql.feature_quality(qpanel(t), NUM)


q.cte("mono", 'SELECT "column", coalesce(max((d < 0)::INT), 0) = 0 AS up, coalesce(max((d > 0)::INT), 0) = 0 AS dn FROM (SELECT "column", value - lag(value) OVER (PARTITION BY symbol, "column" ORDER BY date) AS d FROM qlong) GROUP BY 1')
q.cte(
    "bat0",
    """SELECT "column", CASE WHEN "column" IN ('open', 'close', 'ret') THEN 'price' ELSE 'flow' END AS family, nan_fraction, std * std AS variance, CASE WHEN nan_fraction > 0.15 THEN 'nan_ratio' WHEN coalesce(std * std, 0) <= 1e-10 THEN 'variance' WHEN n_unique < 3 THEN 'nunique'
    WHEN top_share >= 0.995 THEN 'top_value' WHEN up OR dn THEN 'monotone' END AS reason FROM qprof JOIN qtop USING ("column") JOIN mono USING ("column")""",
)
q.cte("bat1", """SELECT * EXCLUDE (reason), CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY family, reason IS NULL ORDER BY variance DESC, "column") > 2 THEN 'family_cap' ELSE reason END AS reason FROM bat0""")


@plan(
    "column_filter_battery",
    29,
    "column:s family:s reason:s family_coverage kept",
    'SELECT "column", family, reason, avg(1 - nan_fraction) OVER (PARTITION BY family) AS family_coverage, (reason IS NULL)::INT AS kept FROM bat1',
)
def _(t):
    return ql.column_filter_battery(qpanel(t), {"price": ["open", "close", "ret"], "flow": ["volume", "gap"]}, max_nan=0.15, cap=2)


q.cte("lk0", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM qp")


@plan(
    "leakage_nan_pattern",
    32,
    "symbol column:s nulls tail_nulls suspicious",
    " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS \"column\", sum(({c} IS NULL)::INT) AS nulls, sum(({c} IS NULL AND i > n - floor(n * 0.1))::INT) AS tail_nulls, (sum(({c} IS NULL)::INT) > 0 AND sum(({c} IS NULL AND i > n - floor(n * 0.1))::INT) < 0.5 * sum(({c} IS NULL)::INT))::INT AS suspicious FROM lk0 GROUP BY symbol"
        for c in ("ret", "gap")
    ),
)
def _(t):
    return ql.leakage_nan_pattern(qpanel(t), ["ret", "gap"])


_pairs = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]


@plan(
    "correlated_pairs",
    33,
    "a:s b:s corr",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM qp WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _pairs) + ") WHERE abs(corr) >= 0.05",
)
def _(t):
    return ql.correlated_pairs(qpanel(t), NUM, 0.05)


_cs = " + ".join(f"coalesce({q.std(c, 20, 1)}, 0)" for c in ("close", "volume", "ret"))
_cn = " + ".join(f"({q.std(c, 20, 1)} IS NOT NULL)::INT" for c in ("close", "volume", "ret"))


@plan("confidence_column", 27, "symbol date confidence", f"SELECT symbol, date, 1 / (1 + coalesce(({_cs}) / nullif({_cn}, 0), 0)) AS confidence FROM qp")
def _(t):
    return ql.confidence_column(qpanel(t), ["close", "volume", "ret"])


@plan("sanitise", 34, "symbol date ret gap", f"SELECT symbol, date, coalesce({q.ffill('ret')}, 0) AS ret, coalesce({q.ffill('gap')}, 0) AS gap FROM qp")
def _(t):
    return ql.sanitise(qpanel(t), ["ret", "gap"])


q.cte("san", f"SELECT symbol, date, " + ", ".join(f"coalesce({q.ffill(c)}, 0) AS {c}" for c in NUM) + " FROM qp")


@plan(
    "family_block_topk",
    28,
    "column:s variance rank:i",
    "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY variance DESC, \"column\") AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance FROM san" for c in NUM) + ")) WHERE rank <= 3",
)
def _(t):
    return ql.drop_low_information(qpanel(t), NUM, 3)


@plan("keyword_projection", 26, "symbol date close", "SELECT symbol, date, close FROM bars")
def _(t):
    return ql.keyword_columns(t.bars(), ["clos"])


@plan("column_namespacing", 25, "symbol date px_open px_close", "SELECT symbol, date, open AS px_open, close AS px_close FROM bars")
def _(t):
    return ql.namespaced(t.bars().select("symbol", "date", F.col("open").alias("PX Open"), F.col("close").alias("px_close")), "px")


@plan("first_non_finite", 36, "column:s symbol date n_bad:i", 'SELECT "column", arg_min(symbol, (symbol, date)) AS symbol, arg_min(date, (symbol, date)) AS date, count(*) AS n_bad FROM qlong WHERE value IS NULL GROUP BY 1')
def _(t):
    return ql.first_non_finite(qpanel(t), NUM, ["symbol", "date"])


q.cte("vr_in", "SELECT symbol, date, price, qty, CASE WHEN l_linenumber = 7 THEN NULL ELSE qty END AS q2, l_orderkey * 10 + l_linenumber AS tie FROM trades")
q.cte(
    "vr_r",
    "SELECT *, CASE WHEN q2 IS NULL THEN 'missing:q2' WHEN date < DATE '1995-06-01' OR date > DATE '2001-06-01' THEN 'date_range' WHEN price < 500 THEN 'min:price' WHEN price > 4000 THEN 'max:price' WHEN qty > 45 THEN 'max:qty' END AS r FROM vr_in",
)
q.cte("vr_b", "SELECT symbol, date, max(tie) AS best FROM vr_r WHERE r IS NULL GROUP BY 1, 2")


@plan("row_validation", 38, "reason:s n:i", "SELECT coalesce(CASE WHEN r IS NULL AND tie < best THEN 'duplicate' ELSE r END, 'accepted') AS reason, count(*) AS n FROM vr_r LEFT JOIN vr_b USING (symbol, date) GROUP BY 1")
def _(t):
    d = t.trades().withColumn("q2", F.when(F.col("l_linenumber") != 7, F.col("qty")))
    v = ql.validate_rows(d, ["q2"], {"price": (500, 4000), "qty": (None, 45)}, ("1995-06-01", "2001-06-01"), ["symbol", "date"], F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ql.rejection_counts(v)


q.cte("fg0", "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, close, volume, ret, CASE WHEN volume > 20 THEN 1 ELSE 0 END AS hd_a, CASE WHEN volume > 49 THEN 1 ELSE 0 END AS hd_b, 0.0 AS dead, CASE WHEN volume > 15 THEN 1 ELSE 0 END AS px FROM rets")
q.cte(
    "fgate",
    """SELECT symbol, 'a' AS family, 2 AS n_real, CASE WHEN avg(CASE WHEN back <= 20 THEN hd_a END) < 0.2 AND sum(CASE WHEN back <= 20 THEN hd_a END) < 3 THEN 'stub' ELSE 'ok' END AS reason FROM fg0 GROUP BY symbol
    UNION ALL SELECT symbol, 'b', 1, CASE WHEN avg(CASE WHEN back <= 20 THEN hd_b END) < 0.2 AND sum(CASE WHEN back <= 20 THEN hd_b END) < 3 THEN 'stub' ELSE 'ok' END FROM fg0 GROUP BY symbol
    UNION ALL SELECT symbol, 'c', 1, 'zero_variance' FROM fg0 GROUP BY symbol
    UNION ALL SELECT symbol, 'd', 1, CASE WHEN avg(px) > 0.5 THEN 'proxy' ELSE 'ok' END FROM fg0 GROUP BY symbol""",
)


def fgate(t):
    v = F.col("volume")
    d = t.rets().withColumns({"hd_a": F.when(v > 20, 1.0).otherwise(0.0), "hd_b": F.when(v > 49, 1.0).otherwise(0.0), "dead": F.lit(0.0), "px": F.when(v > 15, 1.0).otherwise(0.0), "v2": v})
    return ql.family_gate(d, {"a": ["close", "volume"], "b": ["ret"], "c": ["dead"], "d": ["v2"]}, {"a": "hd_a", "b": "hd_b"}, {"d": "px"})


@plan("family_quality_gate", 324, "symbol family:s n_real reason:s passed", "SELECT *, (reason IN ('ok', 'allowed_dormant'))::INT AS passed FROM fgate")
def _(t):
    return fgate(t)


@plan(
    "panel_gate",
    325,
    "symbol passed n_families:i failed:s",
    "SELECT symbol, min((reason = 'ok')::INT) AS passed, count(*) AS n_families, coalesce(string_agg(CASE WHEN reason <> 'ok' THEN family END, ',' ORDER BY family), '') AS failed FROM fgate GROUP BY symbol",
)
def _(t):
    return ql.panel_gate(fgate(t), ["symbol"])


@plan(
    "family_statistics",
    327,
    "family:s n_columns:i mean_nan mean_zero n_low_variance worst_nan",
    """SELECT CASE WHEN "column" IN ('open', 'close', 'ret') THEN 'price' ELSE 'flow' END AS family, count(*) AS n_columns, avg(nan_fraction) AS mean_nan, avg(zero_fraction) AS mean_zero, sum(low_variance) AS n_low_variance, max(nan_fraction) AS worst_nan FROM qprof GROUP BY 1""",
)
def _(t):
    return ql.family_statistics(ql.column_profile(qpanel(t), NUM), {"open": "price", "close": "price", "ret": "price", "volume": "flow", "gap": "flow"})


@plan("worst_nan_columns", 328, "symbol column:s nan_fraction rank:i", 'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY nan_fraction DESC, "column") AS rank FROM (SELECT symbol, "column", avg((value IS NULL)::INT) AS nan_fraction FROM qlong GROUP BY 1, 2)) WHERE rank <= 2')
def _(t):
    return ql.worst_nan_columns(qpanel(t), NUM, 2, ["symbol"])


q.cte("symcol", "SELECT DISTINCT 'S' || l_suppkey AS symbol, l_returnflag || l_linestatus || (l_quantity::INT) AS \"column\" FROM lineitem")


@plan(
    "schema_differences",
    (65, 329, 330),
    "symbol column:s n_symbols:i status:s",
    """SELECT s.symbol, c."column", n_symbols, 'missing' AS status FROM (SELECT DISTINCT symbol FROM symcol) s, (SELECT "column", count(DISTINCT symbol) AS n_symbols FROM symcol GROUP BY 1) c WHERE NOT EXISTS (SELECT 1 FROM symcol x WHERE x.symbol = s.symbol AND x."column" = c."column")""",
)
def _(t):
    c = t.raw("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("column"))
    return ql.schema_differences(c.distinct())


q.cte("present", "SELECT DISTINCT window_id, CASE WHEN volume > 48 THEN 'a' WHEN volume > 30 AND window_id % 2 = 0 THEN 'b' WHEN volume < 3 AND window_id % 3 = 0 THEN 'c' END AS family FROM bars JOIN wfw ON date BETWEEN valid_start AND valid_end")


def present(t):
    v, w = F.col("volume"), F.col("window_id")
    d = t.bars().join(wfw(t), F.col("date").between(F.col("valid_start"), F.col("valid_end")))
    return d.select("window_id", F.when(v > 48, "a").when((v > 30) & (w % 2 == 0), "b").when((v < 3) & (w % 3 == 0), "c").alias("family")).distinct()


@plan(
    "completeness_manifest",
    (331, 349),
    "window_id:i expected:i missing:i missing_families:s checksum:s",
    """SELECT window_id, 3 AS expected, count(m) AS missing, coalesce(string_agg(m, ',' ORDER BY m), '') AS missing_families, sha256(coalesce(string_agg(m, ',' ORDER BY m), '')) AS checksum FROM (SELECT w.window_id, CASE WHEN p.family IS NULL THEN f END AS m FROM wfw w CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS f) LEFT JOIN present p ON p.window_id = w.window_id AND p.family = f) GROUP BY 1""",
)
def _(t):
    return ql.completeness(["a", "b", "c"], wfw(t), present(t))


_ch = lambda c: f"length({c}) || ':' || {c}"
_fx = lambda c: f"lpad(lower(hex(floor({c} * 1048576 + 0.5)::BIGINT)), 16, '0')"
q.cte("chash", f"SELECT md5({_ch('symbol')} || {_ch('CAST(date AS DATE)::VARCHAR')} || {_ch(_fx('close'))} || {_ch(_fx('volume'))}) AS h FROM bars")


@plan("content_hash", 332, "n:i content_hash:s", "SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) % 2305843009213693951 AS content_hash FROM chash")
def _(t):
    return ql.content_hash(t.bars(), ["symbol", "date", "close", "volume"])


@plan(
    "fold_boundary_check",
    333,
    "fold:i gap_days:i overlap ok",
    "SELECT fold, date_diff('day', train_last, val_first) AS gap_days, coalesce((lag(val_last) OVER (ORDER BY val_first) >= val_first)::INT, 0) AS overlap, (date_diff('day', train_last, val_first) > 5 AND NOT coalesce(lag(val_last) OVER (ORDER BY val_first) >= val_first, false))::INT AS ok FROM dfolds",
)
def _(t):
    return ql.fold_boundaries_ok(dfolds(t).withColumn("k", F.lit(0)), 5, ["k"])


@plan(
    "tape_validation",
    21,
    "symbol n_rows:i null_y null_score duplicates:i n_folds:i valid",
    "SELECT symbol, count(*) AS n_rows, 0 AS null_y, 0 AS null_score, count(*) - count(DISTINCT date) AS duplicates, count(DISTINCT fold_id) AS n_folds, 1 AS valid FROM tape GROUP BY symbol",
)
def _(t):
    return ql.tape_validation(t.tape())


@plan(
    "tape_summary",
    22,
    "symbol n_rows:i date_start:d date_end:d score_mean score_std score_min score_max y_mean y_std n_long n_short",
    "SELECT symbol, count(*) AS n_rows, min(date) AS date_start, max(date) AS date_end, avg(score) AS score_mean, stddev_samp(score) AS score_std, min(score) AS score_min, max(score) AS score_max, avg(y_true) AS y_mean, stddev_samp(y_true) AS y_std, sum((score > 0)::INT) AS n_long, sum((score < 0)::INT) AS n_short FROM tape GROUP BY symbol",
)
def _(t):
    return ql.tape_summary(t.tape())


@plan(
    "implied_move_check",
    334,
    "symbol date move_ratio severity:s",
    "SELECT symbol, date, abs(score) / (0.3 * conf) AS move_ratio, CASE WHEN abs(score) / (0.3 * conf) > 2.5 THEN 'critical' WHEN abs(score) / (0.3 * conf) > 1.5 THEN 'warning' ELSE 'ok' END AS severity FROM tape",
)
def _(t):
    tp = t.tape()
    return ql.implied_move_check(tp.select("symbol", "date", F.col("score").alias("predicted_move")), tp.select("symbol", "date", (0.3 * F.col("conf")).alias("implied_move")))


@plan(
    "violation_summary",
    335,
    "type:s severity:s n:i last_seen:s",
    "SELECT event_type AS type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS severity, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2",
)
def _(t):
    v = t.raw("events").select(F.col("event_type").alias("type"), F.when(F.col("value") > 50, "high").otherwise("low").alias("severity"), F.col("ts").cast("timestamp").alias("ts"))
    return ql.violation_summary(v, F.to_timestamp(F.lit("2024-01-20 00:00:00")), 48).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))
