"""Quarterly fundamentals: ratios, growth, valuation. Windows run over quarters per symbol; daily values come as-of `known_at`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import clip, col, flag, ratio, sigmoid, signed_log
from barloom.functions.windows import Roll
from barloom.operators.alignment import asof_join

Q = Roll("symbol", "period")


def _trend(df: DataFrame, x: str, r: Roll, n: int = 12) -> Column:
    return r.slope(x, n, 4)


def liquidity(df: DataFrame, r: Roll = Q, trend_n=12, z_n=20) -> DataFrame:
    """Current, quick and cash ratio, three-year slope, five-year z, capped stress transforms."""
    df = r.numbered(df).withColumns(
        {
            "current_ratio": ratio("current_assets", "current_liabilities"),
            "quick_ratio": ratio(F.col("current_assets") - F.col("inventory"), "current_liabilities"),
            "cash_ratio": ratio("cash", "current_liabilities"),
        }
    )
    s = r.std("current_ratio", z_n, 4)
    df = df.withColumns(
        {
            "liquidity_trend_3y": _trend(df, "current_ratio", r, trend_n),
            "liquidity_zscore_5y": F.when(s > 1e-6, (F.col("current_ratio") - r.mean("current_ratio", z_n, 4)) / s),
            "liquidity_stress": clip(1 / F.greatest(F.col("current_ratio"), F.lit(0.1)), 0, 2),
            "quick_stress": clip(1 / F.greatest(F.col("quick_ratio"), F.lit(0.1)), 0, 2),
            "cash_stress": clip(1 / F.greatest(F.col("cash_ratio"), F.lit(0.05)), 0, 4),
        }
    )
    return df.withColumn("liquidity_trend_stress", clip(-F.coalesce("liquidity_trend_3y", F.lit(0.0)), 0, 1)).drop("__rn")


def leverage(df: DataFrame, r: Roll = Q) -> DataFrame:
    """Debt ratios, coverage, equity multiplier, trend, z and signed-log forms."""
    net, fcf = F.col("total_debt") - F.col("cash"), F.col("operating_cf") - F.abs("capex")
    df = r.numbered(df).withColumns(
        {
            "debt_to_equity": ratio("total_debt", "equity"),
            "debt_to_assets": ratio("total_debt", "total_assets"),
            "net_debt_to_ebitda": F.when((net > 0) & (F.col("ebit") > 0), net / F.col("ebit")),
            "net_debt_to_fcf": F.when((net > 0) & (fcf > 0), net / fcf),
            "interest_burden": F.when(F.col("ebit") > 0, F.col("interest") / F.col("ebit")),
            "interest_coverage": F.when(F.col("interest") > 0, F.col("ebit") / F.col("interest")),
            "equity_multiplier": ratio("total_assets", "equity"),
        }
    )
    s = r.std("debt_to_equity", 20, 4)
    nz = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumns(
        {
            "leverage_trend_3y": _trend(df, "debt_to_equity", r),
            "leverage_zscore_5y": F.when(s > 1e-6, (F.col("debt_to_equity") - r.mean("debt_to_equity", 20, 4)) / s),
            "interest_coverage_stress": clip(1 / (1 + F.greatest(nz("interest_coverage"), F.lit(0.0))), 0, 1),
            "debt_to_equity_robust": signed_log(nz("debt_to_equity")),
            "net_debt_to_ebitda_robust": signed_log(nz("net_debt_to_ebitda")),
        }
    ).drop("__rn")


def efficiency(df: DataFrame, r: Roll = Q) -> DataFrame:
    """Turnovers, days outstanding, cash-conversion cycle and its logistic stress."""
    df = df.withColumns(
        {
            "asset_turnover": ratio("revenue", "total_assets"), "inventory_turnover": ratio("cogs", "inventory"),
            "receivables_turnover": ratio("revenue", "receivables"), "payables_turnover": ratio("cogs", "payables"),
        }
    )
    days = lambda c: F.when(F.col(c) > 0, 365.0 / F.col(c))
    df = df.withColumns({"dsos": days("receivables_turnover"), "dios": days("inventory_turnover"), "dpos": days("payables_turnover")})
    nz = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumns({"ccc": nz("dsos") + nz("dios") - nz("dpos"), "turnover_volatility_3y": r.std("asset_turnover", 12, 2)})
    return df.withColumn("ccc_stress", sigmoid((F.col("ccc") - 60) / 30))


def cash_quality(df: DataFrame) -> DataFrame:
    fcf = F.col("operating_cf") - F.abs("capex")
    return df.withColumns(
        {
            "free_cash_flow": fcf, "fcf_margin": ratio(fcf, "revenue"), "fcf_to_net_income": ratio(fcf, "net_income"), "capex_to_revenue": ratio(F.abs("capex"), "revenue"),
            "accruals_ratio": ratio(F.col("net_income") - F.col("operating_cf"), "total_assets"), "cfo_to_net_income": ratio("operating_cf", "net_income"),
        }
    )


def growth(df: DataFrame, r: Roll = Q) -> DataFrame:
    """Year-on-year growth (four quarters), three-year CAGR, margin expansion, growth volatility."""
    df = df.withColumns({"eps": ratio("net_income", "shares"), "__m": ratio("net_income", "revenue")})
    cagr = lambda c: F.when(r.lag(c, 12) > 0, F.pow(F.greatest(F.col(c) / r.lag(c, 12), F.lit(0.0)), 1 / 3) - 1)
    df = df.withColumns(
        {
            "revenue_growth_yoy": r.pct("revenue", 4), "ebitda_growth_yoy": r.pct("ebit", 4), "eps_growth_yoy": r.pct("eps", 4), "cf_growth_yoy": r.pct("operating_cf", 4),
            "margin_expansion": r.diff("__m", 4), "revenue_cagr_3y": cagr("revenue"), "eps_cagr_3y": cagr("eps"),
        }
    )
    return df.withColumns({"growth_volatility_3y": r.std("revenue_growth_yoy", 12, 4), "eps_growth_volatility_3y": r.std("eps_growth_yoy", 12, 4)}).drop("__m")


def valuation_daily(quarters: DataFrame, bars: DataFrame, r: Roll = Q, daily: Roll | None = None, z_n=1260, z_mp=252) -> DataFrame:
    """Trailing-four-quarter sums carried as-of to sessions, price multiples and their five-year z."""
    d = Roll("symbol", "date") if daily is None else daily
    q = quarters.withColumns({"__e": ratio("net_income", "shares"), "__r": ratio("revenue", "shares"), "bvps": ratio("equity", "shares")})
    q = q.withColumns({"ttm_eps": r.sum("__e", 4), "ttm_rps": r.sum("__r", 4), "ttm_ebitda": r.sum("ebit", 4)})
    x = asof_join(bars, q.select("symbol", "known_at", "ttm_eps", "ttm_rps", "bvps"), ["ttm_eps", "ttm_rps", "bvps"])
    p = F.col("close")
    x = x.withColumns({"pe_ratio": p / (F.col("ttm_eps") + 1e-9), "pb_ratio": p / (F.col("bvps") + 1e-9), "ps_ratio": p / (F.col("ttm_rps") + 1e-9)})
    return x.withColumns({f"{c}_zscore_5y": (F.col(c) - d.mean(c, z_n, z_mp)) / (d.std(c, z_n, z_mp) + 1e-9) for c in ("pe_ratio", "pb_ratio")})


def shareholder_yield(df: DataFrame, r: Roll = Q) -> DataFrame:
    """Payout, policy stability, buyback consistency, three-year dilution and payout z."""
    df = df.withColumn("payout_ratio", F.when(F.col("net_income") > 0, F.abs("dividends_paid") / F.col("net_income")))
    s = r.std("payout_ratio", 20, 8)
    return df.withColumns(
        {
            "dividend_policy_stability": r.std0("payout_ratio", 12),
            "buyback_consistency": r.mean(flag(F.abs("buybacks") > 0), 12, 4),
            "share_dilution_3y": r.pct("shares", 11),
            "yield_zscore_5y": (F.col("payout_ratio") - r.mean("payout_ratio", 20, 8)) / (s + 1e-9),
        }
    )


def opex_intensity(df: DataFrame, r: Roll = Q) -> DataFrame:
    return df.withColumns(
        {
            "rd_intensity": ratio("rnd", "opex") * 100, "complexity_score": F.log1p("opex"),
            **{f"{n}_{k}_growth": r.pct(c, lag) * 100 for n, c in (("rd", "rnd"), ("opex", "opex")) for k, lag in (("qoq", 1), ("yoy", 4))},
        }
    )


def last_period_multiples(quarters: DataFrame, last_price: DataFrame) -> DataFrame:
    """EV and price multiples from each symbol's last period: max over (period, row) structs."""
    cols = ["revenue", "ebit", "net_income", "equity", "total_debt", "cash", "shares"]
    q = quarters.groupBy("symbol").agg(F.max_by(F.struct(*cols), "period").alias("__q")).select("symbol", "__q.*")
    j = q.join(last_price, "symbol")
    mc = F.col("close") * F.col("shares")
    ev = mc + F.col("total_debt") - F.col("cash")
    return j.withColumns({"market_cap": mc, "ev": ev, "ev_revenue": ratio(ev, "revenue"), "ev_ebit": ratio(ev, "ebit"), "pe": ratio(mc, "net_income"), "pb": ratio(mc, "equity")})


def wacc(coe, cod, equity, debt, tax) -> Column:
    e, d = F.coalesce(col(equity), F.lit(0.0)), F.coalesce(col(debt), F.lit(0.0))
    total = e + d
    return F.when(total > 0, e / total * col(coe) + d / total * col(cod) * (1 - col(tax)))


def gordon_terminal(cash_flow, rate, g) -> Column:
    return F.when(col(rate) > col(g), col(cash_flow) * (1 + col(g)) / (col(rate) - col(g)))


def npv(df: DataFrame, keys, cash_flow: str, t: str, rate) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(cash_flow) / F.pow(1 + col(rate), F.col(t))).alias("npv"))


def sensitivity_grid(df: DataFrame, rate: str, g: str, cash_flow: str, steps=(0.01, 0.005)) -> DataFrame:
    """Terminal value on a 3x3 grid around (rate, growth): literal arrays exploded per row."""
    around = lambda c, s: F.explode(F.array(F.col(c) - s, F.col(c), F.col(c) + s))
    d = df.withColumn("r", around(rate, steps[0])).withColumn("g", around(g, steps[1]))
    return d.withColumn("terminal_value", gordon_terminal(cash_flow, "r", "g"))


def forward_rates(curve: DataFrame, keys) -> DataFrame:
    """Forward rate between neighbouring maturities of a spot curve (tenor in years, rate in percent)."""
    r = Roll(list(keys), "tenor")
    t0, r0, s, z = r.lag("tenor"), r.lag("rate") / 100, F.col("tenor"), F.col("rate") / 100
    fwd = (F.pow(F.pow(1 + z, s) / F.pow(1 + r0, t0), 1 / (s - t0)) - 1) * 100
    return curve.withColumn("forward_rate", F.when(s > t0, fwd))


def curve_shape(df: DataFrame) -> DataFrame:
    """Level, slope, curvature, steepness and class from m3, y2, y10, y30."""
    a, b, c, d = (F.col(x) for x in ("m3", "y2", "y10", "y30"))
    slope = c - a
    kind = F.when(slope > 0.5, "steep_normal").when(slope > 0, "normal").when(slope > -0.5, "flat").otherwise("inverted")
    inv = F.concat_ws(",", F.when(a > b, "3_month_vs_2_year"), F.when(b > c, "2_year_vs_10_year"), F.when(c > d, "10_year_vs_30_year"))
    return df.withColumns({"level": (a + b + c + d) / 4, "slope": slope, "curvature": 2 * b - a - c, "spread_10y_2y": c - b, "spread_30y_10y": d - c, "curve_type": kind, "inversions": inv})


def driver_inference(quarters: DataFrame) -> DataFrame:
    """Five-year drivers per symbol: revenue CAGR, margins as ratios of sums, working-capital share, tax rate."""
    years = F.months_between(F.max("period"), F.min("period")) / 12
    g = quarters.groupBy("symbol").agg(
        F.min_by("revenue", "period").alias("__a"), F.max_by("revenue", "period").alias("__b"), years.alias("__y"), F.sum("revenue").alias("__r"), F.sum("ebit").alias("__e"),
        F.sum("capex").alias("__c"), F.sum(F.col("current_assets") - F.col("current_liabilities")).alias("__w"), F.sum("tax").alias("__t"), F.count("*").alias("coverage"),
    )
    return g.select(
        "symbol", "coverage", F.when((F.col("__a") > 0) & (F.col("__y") > 0), F.pow(F.col("__b") / F.col("__a"), 1 / F.col("__y")) - 1).alias("revenue_cagr"),
        ratio("__e", "__r").alias("ebit_margin"), ratio("__c", "__r").alias("capex_share"), ratio("__w", "__r").alias("nwc_share"), clip(ratio("__t", "__e"), 0, 0.5).alias("tax_rate"),
    )


# ---- exposure by entity -----------------------------------------------------------------------------------------------
def exposure(df: DataFrame, owner: str, bucket: str, amount: str) -> DataFrame:
    """Share of each owner's amount by bucket; equal shares when an owner has no amount at all."""
    g = df.groupBy(owner, bucket).agg(F.sum(F.coalesce(F.col(amount), F.lit(0.0))).alias("__a"))
    t = g.groupBy(owner).agg(F.sum("__a").alias("__t"), F.count("*").alias("__n"))
    return g.join(t, owner).withColumn("share", F.when(F.col("__t") > 0, F.col("__a") / F.col("__t")).otherwise(1 / F.col("__n"))).drop("__a", "__t", "__n")


def concentration_premium(shares: DataFrame, owner: str) -> DataFrame:
    g = shares.groupBy(owner).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))
    return g.withColumn("premium", F.greatest(F.lit(0.0), (F.col("hhi") - 0.2) * 0.125))
