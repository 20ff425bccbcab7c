"""Plans: option-chain analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import Roll
from barloom.operators import options as op
from barloom.plans import duck as q
from barloom.plans.registry import plan

SK = "symbol quote_date:d"


@plan("quote_validation", 447, f"{SK} expiry:d strike type:s bid ask", "SELECT * FROM chain WHERE bid > 0 AND ask >= bid AND strike > 0 AND (ask - bid) / ((ask + bid) / 2) <= 0.5")
def _(t):
    return op.quote_checks(t.chain())


q.cte("near5", "SELECT symbol, quote_date, avg(iv) AS atm_iv FROM (SELECT *, row_number() OVER (PARTITION BY symbol, quote_date ORDER BY abs(strike - spot), strike, type, expiry) AS k FROM chain) WHERE k <= 5 GROUP BY 1, 2")
q.cte(
    "snapc",
    """SELECT symbol, quote_date, avg(iv) FILTER (WHERE type = 'call') AS call_iv_avg, avg(iv) FILTER (WHERE type = 'put') AS put_iv_avg, coalesce(sum(volume) FILTER (WHERE type = 'call'), 0) AS call_volume,
    coalesce(sum(volume) FILTER (WHERE type = 'put'), 0) AS put_volume, coalesce(sum(oi) FILTER (WHERE type = 'call'), 0) AS call_oi, coalesce(sum(oi) FILTER (WHERE type = 'put'), 0) AS put_oi, avg(bid) FILTER (WHERE type = 'call') AS call_bid_avg,
    avg(ask) FILTER (WHERE type = 'call') AS call_ask_avg, avg(bid) FILTER (WHERE type = 'put') AS put_bid_avg, avg(ask) FILTER (WHERE type = 'put') AS put_ask_avg, avg(CASE WHEN bid > 0 AND ask > 0 THEN (ask - bid) / ((ask + bid) / 2) * 100 END) AS bid_ask_spread_pct,
    count(DISTINCT strike) AS strikes_available, count(DISTINCT expiry) AS expiries_available, date_diff('day', quote_date, min(expiry)) AS nearest_expiry_days, avg((strike > spot)::INT) FILTER (WHERE type = 'call') * 100 AS otm_call_pct,
    avg((strike < spot)::INT) FILTER (WHERE type = 'put') * 100 AS otm_put_pct FROM chain GROUP BY symbol, quote_date""",
)
_sc = "atm_iv call_iv_avg put_iv_avg iv_spread call_volume put_volume put_call_volume_ratio call_oi put_oi put_call_oi_ratio call_bid_avg call_ask_avg put_bid_avg put_ask_avg bid_ask_spread_pct strikes_available:i expiries_available:i nearest_expiry_days:i otm_call_pct otm_put_pct"


@plan(
    "chain_snapshot",
    85,
    f"{SK} {_sc}",
    "SELECT *, put_iv_avg - call_iv_avg AS iv_spread, put_volume / nullif(call_volume, 0) AS put_call_volume_ratio, put_oi / nullif(call_oi, 0) AS put_call_oi_ratio FROM snapc JOIN near5 USING (symbol, quote_date)",
)
def _(t):
    return op.chain_snapshot(t.chain())


@plan(
    "volatility_surface",
    86,
    f"{SK} atm_volatility volatility_skew avg_iv vol_of_vol min_iv max_iv iv_range",
    """SELECT symbol, quote_date, avg(iv) FILTER (WHERE type = 'call' AND abs(strike / spot - 1) < 0.05) AS atm_volatility, avg(iv) FILTER (WHERE type = 'put' AND strike / spot < 0.95) - avg(iv) FILTER (WHERE type = 'call' AND strike / spot > 1.05) AS volatility_skew,
    avg(iv) AS avg_iv, stddev_pop(iv) AS vol_of_vol, min(iv) AS min_iv, max(iv) AS max_iv, max(iv) - min(iv) AS iv_range FROM chain GROUP BY 1, 2""",
)
def _(t):
    return op.volatility_surface(t.chain())


# the ratio's own binary value decides: twenty times it as a sum and what rounding the sum left out
q.cte("smi0", "SELECT *, a + b AS s, (a - ((a + b) - ((a + b) - a))) + (b - ((a + b) - a)) AS e, floor((a + b) / 2) AS n FROM (SELECT *, strike / spot * 16 AS a, strike / spot * 4 AS b FROM chain)")
q.cte("smi", "SELECT *, (n + (s - 2 * n - 1 > 0 OR s - 2 * n - 1 = 0 AND (e > 0 OR e = 0 AND n::BIGINT % 2 = 1))::INT) / 10 AS smile, round_even(tte * 12, 0)::INT AS months FROM smi0")


@plan("smile_and_term", 86, f"{SK} smile months:i iv n:i", "SELECT symbol, quote_date, smile, months, avg(iv) AS iv, count(*) AS n FROM smi GROUP BY GROUPING SETS ((symbol, quote_date, smile), (symbol, quote_date, months))")
def _(t):
    return op.smile_and_term(t.chain())


q.cte("bs0", "SELECT *, (ln(spot / strike) + (0.05 + iv * iv / 2) * tte) / (iv * sqrt(tte)) AS d1 FROM chain")
q.cte("bs1", "SELECT *, d1 - iv * sqrt(tte) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf, strike * exp(-0.05 * tte) AS disc FROM bs0")


def _ncdf(x):
    # all-positive series: 1/2 + pdf(x) * sum of x^(2k+1) / (1 3 5 ... (2k+1)); beyond eight standard deviations 0 or 1
    a = f"greatest(abs({x}), 1e-300)"
    t = f"list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln({a}) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    return f"(CASE WHEN abs({x}) < 8 THEN 0.5 + sign({x}) * {t} * exp(-{x} * {x} / 2) / sqrt(2 * pi()) WHEN {x} > 0 THEN 1 ELSE 0 END)"


q.cte("bs2", f"SELECT *, {_ncdf('d1')} AS n1, {_ncdf('d2')} AS n2 FROM bs1")
q.cte(
    "greeks",
    """SELECT *, CASE type WHEN 'call' THEN spot * n1 - disc * n2 ELSE spot * n1 - disc * n2 - spot + disc END AS price, CASE type WHEN 'call' THEN n1 ELSE n1 - 1 END AS delta, pdf / (spot * iv * sqrt(tte)) AS gamma, spot * pdf * sqrt(tte) / 100 AS vega,
    (-spot * pdf * iv / (2 * sqrt(tte)) + CASE type WHEN 'call' THEN -0.05 * disc * n2 ELSE 0.05 * disc * (1 - n2) END) / 365 AS theta, CASE type WHEN 'call' THEN disc * tte * n2 ELSE -disc * tte * (1 - n2) END / 100 AS rho FROM bs2""",
)


def greeks(t):
    return op.black_scholes(t.chain())


@plan("black_scholes", 366, f"{SK} expiry:d strike type:s price delta gamma vega theta rho", "SELECT * FROM greeks")
def _(t):
    return greeks(t)


q.cte("flow0", "SELECT symbol, quote_date, sum(volume * iv) / nullif(sum(volume), 0) AS volume_weighted_iv, sum(volume * delta) AS delta_weighted_flow, sum(volume * gamma) AS gamma_exposure, sum(volume * vega) AS vega_exposure FROM greeks GROUP BY 1, 2")


@plan(
    "options_flow",
    87,
    f"{SK} volume_weighted_iv delta_weighted_flow gamma_exposure vega_exposure flow_direction:s",
    "SELECT *, CASE WHEN delta_weighted_flow > 1000 THEN 'bullish' WHEN delta_weighted_flow < -1000 THEN 'bearish' ELSE 'neutral' END AS flow_direction FROM flow0",
)
def _(t):
    return op.options_flow(greeks(t))


q.cte("pg0", "SELECT symbol, quote_date, " + ", ".join(f"sum(volume * {g}) AS total_{g}" for g in ("delta", "gamma", "theta", "vega", "rho")) + " FROM greeks GROUP BY 1, 2")
_risk = "(abs(total_delta) / 10000 + abs(total_gamma) / 1000 + abs(total_vega) / 10000) / 3"


@plan(
    "portfolio_greeks",
    88,
    f"{SK} total_delta total_gamma total_theta total_vega total_rho risk_assessment:s",
    f"SELECT *, CASE WHEN {_risk} > 2 THEN 'high' WHEN {_risk} > 1 THEN 'moderate' ELSE 'low' END AS risk_assessment FROM pg0",
)
def _(t):
    return op.portfolio_greeks(greeks(t))


q.cte("se0", "SELECT symbol, quote_date, call_volume AS c, put_volume AS p, iv, coalesce(put_volume / nullif(call_volume, 0), 1) AS pc FROM snapc JOIN (SELECT symbol, quote_date, avg(iv) AS iv FROM chain GROUP BY 1, 2) USING (symbol, quote_date)")
q.cte(
    "se1",
    """SELECT *, CASE WHEN pc > 1.2 THEN 'bearish' WHEN pc < 0.8 THEN 'bullish' ELSE 'neutral' END AS put_call_sentiment, CASE WHEN iv > 0.35 THEN 'fearful' WHEN iv < 0.2 THEN 'complacent' ELSE 'neutral' END AS volatility_sentiment,
    CASE WHEN c > 1.5 * p THEN 'bullish' WHEN p > 1.5 * c THEN 'bearish' ELSE 'neutral' END AS flow_sentiment FROM se0""",
)
_pts = lambda c: f"(CASE {c} WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 WHEN 'fearful' THEN -0.5 WHEN 'complacent' THEN 0.5 ELSE 0 END)"
q.cte("se2", f"SELECT *, ({_pts('put_call_sentiment')} + {_pts('volatility_sentiment')} + {_pts('flow_sentiment')}) / 3.0 AS sentiment_score, greatest(0, least(100, 50 + 20 * {_pts('put_call_sentiment')} + 30 * {_pts('volatility_sentiment')})) AS fear_greed_index FROM se1")


@plan(
    "options_sentiment",
    89,
    f"{SK} put_call_sentiment:s volatility_sentiment:s flow_sentiment:s sentiment_score fear_greed_index overall_sentiment:s",
    "SELECT *, CASE WHEN sentiment_score > 0.3 THEN 'bullish' WHEN sentiment_score < -0.3 THEN 'bearish' ELSE 'neutral' END AS overall_sentiment FROM se2",
)
def _(t):
    return op.sentiment(t.chain())


@plan(
    "unusual_activity",
    337,
    f"{SK} expiry:d strike type:s volume factor label:s rank:i",
    """SELECT * FROM (SELECT c.*, volume / greatest(m, 1) AS factor, CASE WHEN strike / spot < 0.8 OR strike / spot > 1.2 THEN 'otm_activity' WHEN volume > 2 * oi THEN 'volume_spike' ELSE 'high_volume' END AS label,
    row_number() OVER (PARTITION BY c.symbol, c.quote_date ORDER BY volume / greatest(m, 1) DESC, expiry, strike, type) AS rank
    FROM odd_chain c JOIN (SELECT symbol, quote_date, quantile_cont(volume, 0.99) AS qq, avg(volume) AS m FROM odd_chain WHERE volume > 0 GROUP BY 1, 2) USING (symbol, quote_date) WHERE volume > qq) WHERE rank <= 10""",
)
def _(t):
    # some options with little open interest, some without volume
    key = F.col("strike").cast("int")
    return op.unusual_activity(t.chain().withColumns({"oi": F.when(key % 3 == 0, F.col("oi") / 9).otherwise(F.col("oi")), "volume": F.when(key % 7 == 0, 0.0).otherwise(F.col("volume"))}))


q.cte("odd_chain", "SELECT * REPLACE (CASE WHEN strike::INT % 3 = 0 THEN oi / 9 ELSE oi END AS oi, CASE WHEN strike::INT % 7 = 0 THEN 0 ELSE volume END AS volume) FROM chain")
q.cte(
    "strad",
    """SELECT * FROM (SELECT c.symbol, c.quote_date, c.expiry, c.strike, c.spot, c.tte, (c.bid + c.ask) / 2 AS call_mid, (p.bid + p.ask) / 2 AS put_mid, c.iv AS call_iv, p.iv AS put_iv,
    row_number() OVER (PARTITION BY c.symbol, c.quote_date, c.expiry ORDER BY abs(c.strike - c.spot), c.strike) AS k FROM chain c JOIN chain p ON p.symbol = c.symbol AND p.quote_date = c.quote_date AND p.expiry = c.expiry AND p.strike = c.strike WHERE c.type = 'call' AND p.type = 'put') WHERE k = 1""",
)


@plan("atm_straddle", 444, f"{SK} expiry:d strike spot call_mid put_mid", "SELECT * FROM strad")
def _(t):
    return op.atm_straddle(t.chain())


@plan(
    "implied_moves",
    (445, 446),
    f"{SK} expiry:d premium move_premium_pct move_iv_pct move_iv",
    "SELECT symbol, quote_date, expiry, call_mid + put_mid AS premium, (call_mid + put_mid) / spot AS move_premium_pct, (call_iv + put_iv) / 2 * sqrt(tte) AS move_iv_pct, spot * (call_iv + put_iv) / 2 * sqrt(tte) AS move_iv FROM strad",
)
def _(t):
    return op.implied_moves(op.atm_straddle(t.chain()))


@plan(
    "option_implied_move",
    369,
    f"{SK} expiry:d strike type:s implied_move adjusted_iv one_sigma_move two_sigma_move expected_move one_sigma_pct two_sigma_pct low_68 high_68 low_95 high_95",
    """SELECT *, two_sigma_move / spot AS two_sigma_pct, -one_sigma_move AS low_68, one_sigma_move AS high_68, -two_sigma_move AS low_95, two_sigma_move AS high_95 FROM (
    SELECT *, one_sigma_move * 2 AS two_sigma_move, one_sigma_move * 0.8::DOUBLE AS expected_move, one_sigma_move / spot AS one_sigma_pct FROM (
    SELECT *, spot * adjusted_iv * sqrt(tte) AS one_sigma_move FROM (
    SELECT *, spot * iv * sqrt(tte) AS implied_move, iv * sqrt(tte / (30::DOUBLE / 365)) AS adjusted_iv FROM chain)))""",
)
def _(t):
    return op.implied_move_statistics(t.chain().withColumn("implied_move", op.option_implied_move()))


_w = dict(order="quote_date")
q.cte("ivx", f"SELECT symbol, quote_date, {q.pct_rank('atm_iv', 60, 12, ties='max', **_w)} * 100 AS iv_percentile, {q.z('atm_iv', 60, 12, ddof=0, **_w)} AS iv_z FROM (SELECT symbol, quote_date, round(atm_iv, 10) AS atm_iv FROM near5)")


@plan(
    "iv_extremeness",
    448,
    f"{SK} iv_percentile iv_z iv_regime:s",
    "SELECT *, CASE WHEN iv_percentile IS NULL THEN 'unknown' WHEN iv_percentile >= 90 THEN 'extreme_high' WHEN iv_percentile >= 75 THEN 'high' WHEN iv_percentile <= 10 THEN 'extreme_low' WHEN iv_percentile <= 25 THEN 'low' ELSE 'normal' END AS iv_regime FROM ivx",
)
def _(t):
    return op.iv_extremeness(op.nearest_iv(t.chain()).withColumn("atm_iv", F.round("atm_iv", 10)), "atm_iv", 60, 12, Roll("symbol", "quote_date"))


q.cte("tf", "SELECT DISTINCT date_trunc('month', date)::DATE AS month FROM macro")


@plan("third_friday", 386, "month:d expiry:d", "SELECT month, month + ((5 - isodow(month) + 7) % 7 + 14)::INT AS expiry FROM tf")
def _(t):
    return t.macro().select(F.trunc("date", "month").alias("month")).distinct().withColumn("expiry", op.third_friday("month"))
