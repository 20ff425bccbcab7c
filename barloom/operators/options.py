"""Option-chain analytics. A chain row is (symbol, quote_date, expiry, strike, type, volume, oi, iv, bid, ask, spot, tte)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, col, flag, norm_cdf, norm_pdf, ratio
from barloom.functions.ordered import Rank
from barloom.functions.orderstats import quantiles
from barloom.functions.windows import SYM, Roll

KEY = ["symbol", "quote_date"]


def _call():
    return F.col("type") == "call"


def _put():
    return F.col("type") == "put"


def moneyness() -> Column:
    return F.col("strike") / F.col("spot")


def quote_checks(df: DataFrame, max_spread: float = 0.5) -> DataFrame:
    """Keep quotes with positive sides, ordered bid and ask, positive strike and a bounded relative spread."""
    mid = (F.col("bid") + F.col("ask")) / 2
    ok = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("strike") > 0) & ((F.col("ask") - F.col("bid")) / mid <= max_spread)
    return df.where(ok)


def nearest_iv(df: DataFrame, k: int = 5) -> DataFrame:
    """Mean IV of the k strikes nearest to spot: a bounded top-k per quote (ties by strike, type, expiry)."""
    w = Window.partitionBy(*KEY).orderBy(F.abs(F.col("strike") - F.col("spot")), "strike", "type", "expiry")
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).groupBy(*KEY).agg(F.avg("iv").alias("atm_iv"))


def chain_snapshot(df: DataFrame) -> DataFrame:
    """IV means, volumes, open interest, ratios, quotes, spreads, breadth and OTM shares per (symbol, quote date)."""
    c, p = _call(), _put()
    two = (F.col("bid") > 0) & (F.col("ask") > 0)
    spread = (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 100
    pick = lambda cond, x: F.when(cond, F.col(x))
    g = df.groupBy(*KEY).agg(
        F.avg(pick(c, "iv")).alias("call_iv_avg"), F.avg(pick(p, "iv")).alias("put_iv_avg"),
        F.sum(F.when(c, F.col("volume")).otherwise(0.0)).alias("call_volume"), F.sum(F.when(p, F.col("volume")).otherwise(0.0)).alias("put_volume"),
        F.sum(F.when(c, F.col("oi")).otherwise(0.0)).alias("call_oi"), F.sum(F.when(p, F.col("oi")).otherwise(0.0)).alias("put_oi"),
        F.avg(pick(c, "bid")).alias("call_bid_avg"), F.avg(pick(c, "ask")).alias("call_ask_avg"), F.avg(pick(p, "bid")).alias("put_bid_avg"), F.avg(pick(p, "ask")).alias("put_ask_avg"),
        F.avg(F.when(two, spread)).alias("bid_ask_spread_pct"), F.countDistinct("strike").alias("strikes_available"), F.countDistinct("expiry").alias("expiries_available"),
        F.datediff(F.min("expiry"), F.first("quote_date")).alias("nearest_expiry_days"),
        (F.avg(F.when(c, flag(F.col("strike") > F.col("spot")))) * 100).alias("otm_call_pct"), (F.avg(F.when(p, flag(F.col("strike") < F.col("spot")))) * 100).alias("otm_put_pct"),
    )
    g = g.withColumns({"iv_spread": F.col("put_iv_avg") - F.col("call_iv_avg"), "put_call_volume_ratio": ratio("put_volume", "call_volume"), "put_call_oi_ratio": ratio("put_oi", "call_oi")})
    return g.join(nearest_iv(df), KEY)


def volatility_surface(df: DataFrame) -> DataFrame:
    """ATM level, skew and dispersion of implied volatility per quote."""
    m = moneyness()
    g = df.groupBy(*KEY).agg(
        F.avg(F.when(_call() & (F.abs(m - 1) < 0.05), F.col("iv"))).alias("atm_volatility"),
        F.avg(F.when(_put() & (m < 0.95), F.col("iv"))).alias("__p"), F.avg(F.when(_call() & (m > 1.05), F.col("iv"))).alias("__c"),
        F.avg("iv").alias("avg_iv"), F.stddev_pop("iv").alias("vol_of_vol"), F.min("iv").alias("min_iv"), F.max("iv").alias("max_iv"),
    )
    return g.withColumns({"volatility_skew": F.col("__p") - F.col("__c"), "iv_range": F.col("max_iv") - F.col("min_iv")}).drop("__p", "__c")


def round_tenth(x: Column) -> Column:
    """The nearest tenth of the number's own binary value, halves to the even one: 0.95, which is a little less, gives 0.9.

    Twenty times x is kept exactly, as a sum and what its rounding left out.
    """
    a, b = x * 16, x * 4
    s = a + b
    around = s - a
    left = (a - (s - around)) + (b - around)
    n = F.floor(s / 2)
    off = s - 2 * n - 1
    up = (off > 0) | ((off == 0) & ((left > 0) | ((left == 0) & (n % 2 != 0))))
    return (n + F.when(up, 1).otherwise(0)) / 10


def smile_and_term(df: DataFrame) -> DataFrame:
    """Mean IV by moneyness bucket and by month to expiry, both from one grouping-sets pass."""
    d = df.withColumns({"smile": round_tenth(moneyness()), "months": F.bround(F.col("tte") * 12).cast("int")})
    g = d.groupingSets([[F.col("symbol"), F.col("quote_date"), F.col("smile")], [F.col("symbol"), F.col("quote_date"), F.col("months")]], "symbol", "quote_date", "smile", "months")
    return g.agg(F.avg("iv").alias("iv"), F.count("*").alias("n"))


def black_scholes(df: DataFrame, rate: float = 0.05) -> DataFrame:
    """Price and Greeks of every chain row, evaluated inside codegen."""
    s, k, t, v = F.col("spot"), F.col("strike"), F.col("tte"), F.col("iv")
    root = F.sqrt(t)
    df = df.withColumn("__d1", (F.ln(s / k) + (rate + v * v / 2) * t) / (v * root))
    df = df.withColumn("__d2", F.col("__d1") - v * root)
    df = df.withColumns({"__n1": norm_cdf("__d1"), "__n2": norm_cdf("__d2"), "__pdf": norm_pdf("__d1"), "__disc": k * F.exp(-rate * t)})
    n1, n2, pdf, disc = (F.col(x) for x in ("__n1", "__n2", "__pdf", "__disc"))
    call = s * n1 - disc * n2
    decay = -s * pdf * v / (2 * root)
    c = _call()
    return df.withColumns(
        {
            "price": F.when(c, call).otherwise(call - s + disc),
            "delta": F.when(c, n1).otherwise(n1 - 1),
            "gamma": pdf / (s * v * root),
            "vega": s * pdf * root / 100,
            "theta": F.when(c, decay - rate * disc * n2).otherwise(decay + rate * disc * (1 - n2)) / 365,
            "rho": F.when(c, disc * t * n2).otherwise(-disc * t * (1 - n2)) / 100,
        }
    ).drop("__d1", "__d2", "__n1", "__n2", "__pdf", "__disc")


def options_flow(df: DataFrame) -> DataFrame:
    """Volume-weighted IV, delta/gamma/vega flow and its direction (needs Greeks)."""
    v = F.col("volume")
    g = df.groupBy(*KEY).agg(
        ratio(F.sum(v * F.col("iv")), F.sum(v)).alias("volume_weighted_iv"), F.sum(v * F.col("delta")).alias("delta_weighted_flow"),
        F.sum(v * F.col("gamma")).alias("gamma_exposure"), F.sum(v * F.col("vega")).alias("vega_exposure"),
    )
    d = F.col("delta_weighted_flow")
    return g.withColumn("flow_direction", F.when(d > 1000, "bullish").when(d < -1000, "bearish").otherwise("neutral"))


def portfolio_greeks(df: DataFrame) -> DataFrame:
    """Volume-weighted Greek totals and a risk class from their scaled magnitudes."""
    g = df.groupBy(*KEY).agg(*[F.sum(F.col("volume") * F.col(x)).alias(f"total_{x}") for x in ("delta", "gamma", "theta", "vega", "rho")])
    risk = (F.abs("total_delta") / 10000 + F.abs("total_gamma") / 1000 + F.abs("total_vega") / 10000) / 3
    return g.withColumn("risk_assessment", F.when(risk > 2, "high").when(risk > 1, "moderate").otherwise("low"))


def sentiment(df: DataFrame) -> DataFrame:
    """Put/call, volatility and flow sentiment, their mean score and a 0-100 index."""
    g = df.groupBy(*KEY).agg(F.sum(F.when(_call(), F.col("volume")).otherwise(0.0)).alias("__c"), F.sum(F.when(_put(), F.col("volume")).otherwise(0.0)).alias("__p"), F.avg("iv").alias("__iv"))
    g = g.withColumn("__pc", F.coalesce(ratio("__p", "__c"), F.lit(1.0)))
    pc = F.when(F.col("__pc") > 1.2, "bearish").when(F.col("__pc") < 0.8, "bullish").otherwise("neutral")
    vol = F.when(F.col("__iv") > 0.35, "fearful").when(F.col("__iv") < 0.2, "complacent").otherwise("neutral")
    flow = F.when(F.col("__c") > 1.5 * F.col("__p"), "bullish").when(F.col("__p") > 1.5 * F.col("__c"), "bearish").otherwise("neutral")
    g = g.withColumns({"put_call_sentiment": pc, "volatility_sentiment": vol, "flow_sentiment": flow})

    def points(c):
        x = F.col(c)
        return F.when(x == "bullish", 1.0).when(x == "bearish", -1.0).when(x == "fearful", -0.5).when(x == "complacent", 0.5).otherwise(0.0)

    score = (points("put_call_sentiment") + points("volatility_sentiment") + points("flow_sentiment")) / 3
    fear = 50 + 20 * points("put_call_sentiment") + 30 * points("volatility_sentiment")
    g = g.withColumns({"sentiment_score": score, "fear_greed_index": clip(fear, 0, 100)})
    overall = F.when(F.col("sentiment_score") > 0.3, "bullish").when(F.col("sentiment_score") < -0.3, "bearish").otherwise("neutral")
    return g.withColumn("overall_sentiment", overall).drop("__c", "__p", "__iv", "__pc")


def unusual_activity(df: DataFrame, k: int = 10) -> DataFrame:
    """Options above the 99th percentile of the positive volumes of their chain (symbol, quote date): factor against the mean
    of these volumes (one at least), kind of activity, the k largest factors of a chain."""
    traded = df.where(F.col("volume") > 0)
    q = quantiles(traded, KEY, "volume", {"__q": 0.99}).join(traded.groupBy(*KEY).agg(F.avg("volume").alias("__m")), KEY)
    d = df.join(q, KEY).where(F.col("volume") > F.col("__q")).withColumn("factor", F.col("volume") / F.greatest("__m", F.lit(1.0)))
    ratio_ = F.col("strike") / F.col("spot")
    label = F.when((ratio_ < 0.8) | (ratio_ > 1.2), "otm_activity").when(F.col("volume") > 2 * F.col("oi"), "volume_spike").otherwise("high_volume")
    # at most one percent of a chain reaches the ranking
    w = Window.partitionBy(*KEY).orderBy(F.desc("factor"), "expiry", "strike", "type")
    return d.withColumns({"label": label, "rank": F.row_number().over(w)}).where(F.col("rank") <= k).drop("__q", "__m")


def atm_straddle(df: DataFrame) -> DataFrame:
    """Call and put of the strike closest to spot per (symbol, quote date, expiry): min over a struct, no sort."""
    call = df.where(_call()).select(*KEY, "expiry", "strike", "spot", "tte", ((F.col("bid") + F.col("ask")) / 2).alias("call_mid"), F.col("iv").alias("call_iv"))
    put = df.where(_put()).select(*KEY, "expiry", "strike", ((F.col("bid") + F.col("ask")) / 2).alias("put_mid"), F.col("iv").alias("put_iv"))
    j = call.join(put, [*KEY, "expiry", "strike"])
    best = F.min_by(F.struct("strike", "spot", "tte", "call_mid", "put_mid", "call_iv", "put_iv"), F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike")))
    return j.groupBy(*KEY, "expiry").agg(best.alias("b")).select(*KEY, "expiry", "b.*")


def implied_moves(straddle: DataFrame) -> DataFrame:
    """Expected move from the straddle premium and from its mean IV, absolute and relative."""
    prem, iv = F.col("call_mid") + F.col("put_mid"), (F.col("call_iv") + F.col("put_iv")) / 2
    return straddle.withColumns(
        {"premium": prem, "move_premium_pct": prem / F.col("spot"), "move_iv_pct": iv * F.sqrt("tte"), "move_iv": F.col("spot") * iv * F.sqrt("tte")}
    )


def option_implied_move(spot="spot", iv="iv", tte="tte") -> Column:
    return col(spot) * col(iv) * F.sqrt(col(tte))


def implied_move_statistics(df: DataFrame, base_days: float | None = 30, spot="spot", iv="iv", tte="tte") -> DataFrame:
    """Moves that the options imply over the time to expiry: adjusted_iv, one_sigma_move, two_sigma_move, expected_move (0.8 of one
    sigma), both as shares of spot, and the 68 % and 95 % bands around no change.

    The volatility is first taken from a horizon of `base_days` to the time to expiry; with None it is used as it is, so that
    time counts once.
    """
    base = None if base_days is None else base_days / 365
    df = df.withColumn("adjusted_iv", F.col(iv) if base is None else F.col(iv) * F.sqrt(F.col(tte) / base))
    df = df.withColumn("one_sigma_move", option_implied_move(spot, "adjusted_iv", tte))
    one, two = F.col("one_sigma_move"), F.col("one_sigma_move") * 2
    found = {"two_sigma_move": two, "expected_move": one * 0.8, "one_sigma_pct": one / F.col(spot), "two_sigma_pct": two / F.col(spot)}
    return df.withColumns({**found, "low_68": -one, "high_68": one, "low_95": -two, "high_95": two})


def iv_extremeness(df: DataFrame, iv: str = "iv", n: int = 252, mp: int = 30, r: Roll = SYM) -> DataFrame:
    """Percentile of score and population z of today's IV against its trailing history; regime class."""
    d = r.ordered(df, {"__pct": Rank(iv, n, mp, ties="max")})
    d = d.withColumns({"iv_percentile": F.col("__pct") * 100, "iv_z": r.z(iv, n, mp, ddof=0)}).drop("__pct")
    p = F.col("iv_percentile")
    reg = F.when(p.isNull(), "unknown").when(p >= 90, "extreme_high").when(p >= 75, "high").when(p <= 10, "extreme_low").when(p <= 25, "low").otherwise("normal")
    return d.withColumn("iv_regime", reg)


def third_friday(month) -> Column:
    """Third Friday of the month of a date."""
    first = F.trunc(col(month), "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 14)


def monthly_expiries(df: DataFrame, date: str, ahead: int = 3) -> DataFrame:
    """The next `ahead` third-Friday expiries after each date (an array of four candidates, the passed ones filtered)."""
    cand = F.array(*[third_friday(F.add_months(date, i)) for i in range(ahead + 1)])
    return df.withColumn("expiries", F.slice(F.filter(cand, lambda e: e > F.col(date)), 1, ahead))


