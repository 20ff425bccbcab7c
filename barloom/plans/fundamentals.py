"""Plans: fundamentals, valuation and scalar finance."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import fundamentals as op
from barloom.plans import duck as q
from barloom.plans.market import select_with
from barloom.plans.registry import plan
from barloom.sources import io

PO = dict(order="period")
FK = "symbol period:d"
q.cte("fq", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period) AS rn FROM fundamentals")

_lq = {"current_ratio": q.div("current_assets", "current_liabilities"), "quick_ratio": q.div("current_assets - inventory", "current_liabilities"), "cash_ratio": q.div("cash", "current_liabilities")}
q.cte("liq1", select_with(_lq, "fq"))
_tr = lambda x: f"(CASE WHEN count({x}) OVER {q.over(12, **PO)} >= 4 THEN regr_slope({x}, rn) OVER {q.over(12, **PO)} END)"
_zf = lambda x: f"(CASE WHEN {q.std(x, 20, 4, **PO)} > 1e-6 THEN ({x} - {q.mean(x, 20, 4, **PO)}) / {q.std(x, 20, 4, **PO)} END)"
_lq2 = {
    "liquidity_trend_3y": _tr("current_ratio"),
    "liquidity_zscore_5y": _zf("current_ratio"),
    "liquidity_stress": q.clip("1 / greatest(current_ratio, 0.1)", 0, 2),
    "quick_stress": q.clip("1 / greatest(quick_ratio, 0.1)", 0, 2),
    "cash_stress": q.clip("1 / greatest(cash_ratio, 0.05)", 0, 4),
    "liquidity_trend_stress": q.clip(f"-coalesce({_tr('current_ratio')}, 0)", 0, 1),
}


@plan("fund_liquidity", 353, f"{FK} " + " ".join([*_lq, *_lq2]), select_with(_lq2, "liq1"))
def _(t):
    return op.liquidity(t.fundamentals())


_net, _fcf = "(total_debt - cash)", "(operating_cf - abs(capex))"
_lv = {
    "debt_to_equity": q.div("total_debt", "equity"),
    "debt_to_assets": q.div("total_debt", "total_assets"),
    "net_debt_to_ebitda": f"CASE WHEN {_net} > 0 AND ebit > 0 THEN {_net} / ebit END",
    "net_debt_to_fcf": f"CASE WHEN {_net} > 0 AND {_fcf} > 0 THEN {_net} / {_fcf} END",
    "interest_burden": "CASE WHEN ebit > 0 THEN interest / ebit END",
    "interest_coverage": "CASE WHEN interest > 0 THEN ebit / interest END",
    "equity_multiplier": q.div("total_assets", "equity"),
}
q.cte("lev1", select_with(_lv, "fq"))
_slog = lambda x: f"sign(coalesce({x}, 0)) * ln(1 + abs(coalesce({x}, 0)))"
_lv2 = {
    "leverage_trend_3y": _tr("debt_to_equity"),
    "leverage_zscore_5y": _zf("debt_to_equity"),
    "interest_coverage_stress": q.clip("1 / (1 + greatest(coalesce(interest_coverage, 0), 0))", 0, 1),
    "debt_to_equity_robust": _slog("debt_to_equity"),
    "net_debt_to_ebitda_robust": _slog("net_debt_to_ebitda"),
}


@plan("fund_leverage", 354, f"{FK} " + " ".join([*_lv, *_lv2]), select_with(_lv2, "lev1"))
def _(t):
    return op.leverage(t.fundamentals())


_ef = {"asset_turnover": q.div("revenue", "total_assets"), "inventory_turnover": q.div("cogs", "inventory"), "receivables_turnover": q.div("revenue", "receivables"), "payables_turnover": q.div("cogs", "payables")}
q.cte("eff1", select_with(_ef, "fq"))
_ef2 = {"dsos": "365.0 / nullif(receivables_turnover, 0)", "dios": "365.0 / nullif(inventory_turnover, 0)", "dpos": "365.0 / nullif(payables_turnover, 0)"}
q.cte("eff2", select_with(_ef2, "eff1"))
q.cte("eff3", f"SELECT *, coalesce(dsos, 0) + coalesce(dios, 0) - coalesce(dpos, 0) AS ccc, {q.std('asset_turnover', 12, 2, **PO)} AS turnover_volatility_3y FROM eff2")


@plan("fund_efficiency", 355, f"{FK} " + " ".join([*_ef, *_ef2]) + " ccc turnover_volatility_3y ccc_stress", "SELECT *, 1 / (1 + exp(-(ccc - 60) / 30)) AS ccc_stress FROM eff3")
def _(t):
    return op.efficiency(t.fundamentals())


_cq = {
    "free_cash_flow": _fcf,
    "fcf_margin": q.div(_fcf, "revenue"),
    "fcf_to_net_income": q.div(_fcf, "net_income"),
    "capex_to_revenue": q.div("abs(capex)", "revenue"),
    "accruals_ratio": q.div("net_income - operating_cf", "total_assets"),
    "cfo_to_net_income": q.div("operating_cf", "net_income"),
}


@plan("fund_cash_quality", 356, f"{FK} " + " ".join(_cq), q.select(_cq, "fq", "symbol, period"))
def _(t):
    return op.cash_quality(t.fundamentals())


q.cte("gr1", "SELECT *, net_income / shares AS eps, net_income / revenue AS mg FROM fq")
_cagr = lambda c: f"CASE WHEN {q.lag(c, 12, **PO)} > 0 THEN pow(greatest({c} / {q.lag(c, 12, **PO)}, 0), 1 / 3.0::DOUBLE) - 1 END"
_gr = {
    "revenue_growth_yoy": q.pct("revenue", 4, **PO),
    "ebitda_growth_yoy": q.pct("ebit", 4, **PO),
    "eps_growth_yoy": q.pct("eps", 4, **PO),
    "cf_growth_yoy": q.pct("operating_cf", 4, **PO),
    "margin_expansion": f"mg - {q.lag('mg', 4, **PO)}",
    "revenue_cagr_3y": _cagr("revenue"),
    "eps_cagr_3y": _cagr("eps"),
}
q.cte("gr2", q.select(_gr, "gr1", "symbol, period"))
_gr2 = {"growth_volatility_3y": q.std("revenue_growth_yoy", 12, 4, **PO), "eps_growth_volatility_3y": q.std("eps_growth_yoy", 12, 4, **PO)}


@plan("fund_growth", 357, f"{FK} " + " ".join([*_gr, *_gr2]), select_with(_gr2, "gr2"))
def _(t):
    return op.growth(t.fundamentals())


q.cte("val1", f"SELECT symbol, known_at, {q.rsum('net_income / shares', 4, **PO)} AS ttm_eps, {q.rsum('revenue / shares', 4, **PO)} AS ttm_rps, equity / shares AS bvps FROM fq")
q.cte("val2", "SELECT b.symbol, b.date, close / (ttm_eps + 1e-9) AS pe_ratio, close / (bvps + 1e-9) AS pb_ratio, close / (ttm_rps + 1e-9) AS ps_ratio FROM bars b ASOF LEFT JOIN val1 v ON v.symbol = b.symbol AND b.date >= v.known_at")
_zz = lambda c: f"({c} - {q.mean(c, 1260, 252)}) / ({q.std(c, 1260, 252)} + 1e-9)"


@plan("fund_valuation_daily", (46, 358), "symbol date pe_ratio pb_ratio ps_ratio pe_ratio_zscore_5y pb_ratio_zscore_5y", f"SELECT *, {_zz('pe_ratio')} AS pe_ratio_zscore_5y, {_zz('pb_ratio')} AS pb_ratio_zscore_5y FROM val2")
def _(t):
    return op.valuation_daily(t.fundamentals(), t.bars())


q.cte("shy1", "SELECT *, CASE WHEN net_income > 0 THEN abs(dividends_paid) / net_income END AS payout_ratio FROM fq")
_sy = {
    "payout_ratio": "payout_ratio",
    "dividend_policy_stability": q.std0("payout_ratio", 12, **PO),
    "buyback_consistency": q.mean("(abs(buybacks) > 0)::INT", 12, 4, **PO),
    "share_dilution_3y": q.pct("shares", 11, **PO),
    "yield_zscore_5y": f"(payout_ratio - {q.mean('payout_ratio', 20, 8, **PO)}) / ({q.std('payout_ratio', 20, 8, **PO)} + 1e-9)",
}


@plan("fund_shareholder_yield", 359, f"{FK} " + " ".join(_sy), q.select(_sy, "shy1", "symbol, period"))
def _(t):
    return op.shareholder_yield(t.fundamentals())


_ox = {"rd_intensity": q.div("rnd", "opex") + " * 100", "complexity_score": "ln(1 + opex)"}
_ox |= {f"{n}_{k}_growth": f"{q.pct(c, lag, **PO)} * 100" for n, c in (("rd", "rnd"), ("opex", "opex")) for k, lag in (("qoq", 1), ("yoy", 4))}


@plan("fund_opex_intensity", 360, f"{FK} " + " ".join(_ox), q.select(_ox, "fq", "symbol, period"))
def _(t):
    return op.opex_intensity(t.fundamentals())


q.cte("lp", "SELECT symbol, arg_max(close, date) AS close FROM bars GROUP BY symbol")
q.cte("lm", "SELECT f.*, close * shares AS mc, close * shares + total_debt - cash AS ev FROM (SELECT * FROM fq QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period DESC) = 1) f JOIN lp USING (symbol)")


@plan("price_multiples", 361, "symbol market_cap ev ev_revenue ev_ebit pe pb", "SELECT symbol, mc AS market_cap, ev, ev / revenue AS ev_revenue, ev / ebit AS ev_ebit, mc / net_income AS pe, mc / equity AS pb FROM lm")
def _(t):
    return op.last_period_multiples(t.fundamentals(), t.bars().groupBy("symbol").agg(F.max_by("close", "date").alias("close")))


q.cte("wc", "SELECT symbol, period, equity / (equity + total_debt) * 0.09 + total_debt / (equity + total_debt) * 0.05 * (1 - 0.21) AS wacc, operating_cf - abs(capex) AS fcf FROM fq")


def _wacc(t):
    return t.fundamentals().select("symbol", "period", op.wacc(F.lit(0.09), F.lit(0.05), "equity", "total_debt", F.lit(0.21)).alias("wacc"), (F.col("operating_cf") - F.abs("capex")).alias("fcf"))


@plan("wacc", 362, f"{FK} wacc", "SELECT * FROM wc")
def _(t):
    return _wacc(t)


@plan("gordon_terminal_value", 363, f"{FK} terminal_value", "SELECT symbol, period, fcf * 1.02 / (wacc - 0.02) AS terminal_value FROM wc")
def _(t):
    return _wacc(t).withColumn("terminal_value", op.gordon_terminal("fcf", "wacc", F.lit(0.02)))


@plan("npv", 364, "symbol npv", "SELECT symbol, sum(fcf / pow(1.08, rn)) AS npv FROM wc JOIN (SELECT symbol, period, rn FROM fq) USING (symbol, period) GROUP BY symbol")
def _(t):
    w = _wacc(t).withColumn("t", op.Q.row())
    return op.npv(w, ["symbol"], "fcf", "t", F.lit(0.08))


@plan(
    "sensitivity_grid",
    365,
    f"{FK} r g terminal_value",
    "SELECT symbol, period, wacc + dr AS r, 0.02 + dg AS g, CASE WHEN wacc + dr > 0.02 + dg THEN fcf * (1 + 0.02 + dg) / (wacc + dr - 0.02 - dg) END AS terminal_value FROM wc, (SELECT unnest([-0.01, 0.0, 0.01]) AS dr), (SELECT unnest([-0.005, 0.0, 0.005]) AS dg)",
)
def _(t):
    return op.sensitivity_grid(_wacc(t).withColumn("g0", F.lit(0.02)), "wacc", "g0", "fcf")


q.cte("curve", "SELECT date, unnest([0.25, 2.0, 10.0, 30.0])::DOUBLE AS tenor, unnest([vix3m / 10, ust2y, ust10y, dollar / 8]) AS rate FROM macro")


@plan("forward_rates", 367, "date tenor rate forward_rate", "SELECT *, (pow(pow(1 + rate / 100, tenor) / pow(1 + lag(rate) OVER w / 100, lag(tenor) OVER w), 1 / (tenor - lag(tenor) OVER w)) - 1) * 100 AS forward_rate FROM curve WINDOW w AS (PARTITION BY date ORDER BY tenor)")
def _(t):
    m = t.macro()
    pairs = F.array(*[F.struct(F.lit(n).alias("tenor"), x.alias("rate")) for n, x in ((0.25, F.col("vix3m") / 10), (2.0, F.col("ust2y")), (10.0, F.col("ust10y")), (30.0, F.col("dollar") / 8))])
    return op.forward_rates(m.select("date", F.explode(pairs).alias("x")).select("date", "x.*"), ["date"])


q.cte("shape0", "SELECT date, vix3m / 10 AS m3, ust2y AS y2, ust10y AS y10, dollar / 8 AS y30 FROM macro")


@plan(
    "curve_shape",
    368,
    "date level slope curvature spread_10y_2y spread_30y_10y curve_type:s inversions:s",
    """SELECT date, (m3 + y2 + y10 + y30) / 4 AS level, y10 - m3 AS slope, 2 * y2 - m3 - y10 AS curvature, y10 - y2 AS spread_10y_2y, y30 - y10 AS spread_30y_10y, CASE WHEN y10 - m3 > 0.5 THEN 'steep_normal' WHEN y10 - m3 > 0 THEN 'normal' WHEN y10 - m3 > -0.5 THEN 'flat' ELSE 'inverted' END AS curve_type,
    concat_ws(',', CASE WHEN m3 > y2 THEN '3_month_vs_2_year' END, CASE WHEN y2 > y10 THEN '2_year_vs_10_year' END, CASE WHEN y10 > y30 THEN '10_year_vs_30_year' END) AS inversions FROM shape0""",
)
def _(t):
    return op.curve_shape(t.macro().select("date", (F.col("vix3m") / 10).alias("m3"), F.col("ust2y").alias("y2"), F.col("ust10y").alias("y10"), (F.col("dollar") / 8).alias("y30")))


@plan(
    "driver_inference",
    457,
    "symbol coverage:i revenue_cagr ebit_margin capex_share nwc_share tax_rate",
    "SELECT symbol, count(*) AS coverage, pow(arg_max(revenue, period) / arg_min(revenue, period), 1 / (date_diff('month', min(period), max(period)) / 12.0::DOUBLE)) - 1 AS revenue_cagr, sum(ebit) / sum(revenue) AS ebit_margin, sum(capex) / sum(revenue) AS capex_share, "
    "sum(current_assets - current_liabilities) / sum(revenue) AS nwc_share, greatest(0, least(0.5, sum(tax) / sum(ebit))) AS tax_rate FROM fq GROUP BY symbol",
)
def _(t):
    return op.driver_inference(t.fundamentals())


q.cte("geo", "SELECT p_brand AS symbol, n_name AS jurisdiction, sum(l_extendedprice) AS a FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2")


def _geo(t):
    li = t.raw("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    p = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    s = t.raw("supplier").join(F.broadcast(t.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    s = s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("jurisdiction"))
    return op.exposure(li.join(p, "l_partkey").join(s, "l_suppkey"), "symbol", "jurisdiction", "l_extendedprice")


@plan("geographic_exposure", 96, "symbol jurisdiction:s share", "SELECT symbol, jurisdiction, a / sum(a) OVER (PARTITION BY symbol) AS share FROM geo")
def _(t):
    return _geo(t)


q.cte("seg", "SELECT p_brand AS symbol, p_type AS segment, sum(p_retailprice) AS a FROM part GROUP BY 1, 2")


@plan("segment_exposure", 97, "symbol segment:s share", "SELECT symbol, segment, a / sum(a) OVER (PARTITION BY symbol) AS share FROM seg")
def _(t):
    return op.exposure(t.raw("part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("segment"), "p_retailprice"), "symbol", "segment", "p_retailprice")


@plan("concentration_premium", 98, "symbol hhi premium", "SELECT symbol, sum(s * s) AS hhi, greatest(0, (sum(s * s) - 0.2) * 0.125) AS premium FROM (SELECT symbol, a / sum(a) OVER (PARTITION BY symbol) AS s FROM seg) GROUP BY symbol")
def _(t):
    e = op.exposure(t.raw("part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("segment"), "p_retailprice"), "symbol", "segment", "p_retailprice")
    return op.concentration_premium(e, "symbol")


# ---- statements ---------------------------------------------------------------------------------------------------------
@plan(
    "statement_normalisation",
    17,
    f"{FK} total_revenue operating_income total_debt",
    "SELECT symbol, period, revenue AS total_revenue, ebit AS operating_income, coalesce(receivables, 0) + coalesce(payables, 0) AS total_debt FROM fq",
)
def _(t):
    raw = t.fundamentals().select("symbol", "period", F.col("revenue").cast("string").alias("Revenue"), F.lit("n/a").alias("Total Revenue"), F.col("ebit").alias("EBIT"), F.col("receivables").alias("shortTermDebt"), F.col("payables").alias("longTermDebt"))
    names = {"total_revenue": ["Total Revenue", "Revenue"], "operating_income": ["operatingIncome", "EBIT"], "short_term_debt": ["shortTermDebt"], "long_term_debt": ["longTermDebt"]}
    return io.normalise_statement(raw, names, ["symbol", "period"])


@plan(
    "statement_alignment",
    18,
    f"{FK} gross_margin ebit_margin capex_to_rev nwc_to_rev rev_growth",
    f"SELECT symbol, period, gross_profit / revenue AS gross_margin, ebit / revenue AS ebit_margin, abs(capex) / revenue AS capex_to_rev, (current_assets - current_liabilities) / revenue AS nwc_to_rev, {q.pct('revenue', 1, **PO)} AS rev_growth FROM fq",
)
def _(t):
    f = t.fundamentals()
    k = ["symbol", "period"]
    return io.align_statements(f.select(*k, "revenue", "gross_profit", "ebit"), f.select(*k, "current_assets", "current_liabilities"), f.select(*k, "capex"))


@plan("numeric_coercion", 35, f"{FK} revenue n_text", "SELECT symbol, period, revenue, NULL AS n_text FROM fq")
def _(t):
    return io.numeric_panel(t.fundamentals().select("symbol", "period", F.col("revenue").cast("string").alias("revenue"), F.lit("abc").alias("n_text")), ["symbol", "period"])
