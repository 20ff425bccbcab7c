"""Plans: intraday, filings, sentiment, breadth, funds, experiments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.functions.windows import SYM
from barloom.operators import aggregates as op
from barloom.operators import alignment as al
from barloom.operators import labels as lb
from barloom.plans import duck as q
from barloom.plans.registry import plan

MIN = dict(order="minute")

q.cte("id0", f"SELECT *, {q.pct('close', 1, **MIN)} AS r, coalesce(sign(close - {q.lag('close', 1, **MIN)}), 0) AS tick, coalesce(CASE WHEN volume <> 0 THEN volume END, 0) AS v FROM minute_bars")


@plan("tick_flags", 71, "symbol minute:s tick", "SELECT symbol, strftime(minute, '%Y-%m-%d %H:%M') AS minute, tick FROM id0")
def _(t):
    d = t.minute_bars().withColumn("tick", op.tick_flag("close", op.MINUTE))
    return d.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@plan(
    "intraday_to_daily",
    70,
    "symbol date ofi_proxy updown_imbalance micro_liq_slope stalled_prints_ratio",
    """SELECT symbol, minute::DATE AS date, sum(coalesce(sign(r), 0) * v) AS ofi_proxy, (sum(CASE WHEN tick > 0 THEN v ELSE 0 END) - sum(CASE WHEN tick < 0 THEN v ELSE 0 END)) / (sum(v) + 1e-9) AS updown_imbalance,
    CASE WHEN sum(v) > 0 THEN stddev_samp(r) / sqrt(sum(v)) END AS micro_liq_slope, avg((v = 0)::INT) AS stalled_prints_ratio FROM id0 GROUP BY 1, 2""",
)
def _(t):
    return op.intraday_to_daily(t.minute_bars())


_open = "((hour(minute) = 9 AND minute(minute) >= 30) OR (hour(minute) = 10 AND minute(minute) = 0))"
_close = "(hour(minute) >= 14 AND hour(minute) < 16)"
q.cte(
    "sod0",
    f"""SELECT symbol, minute::DATE AS date, arg_min(open, minute) FILTER (WHERE {_open}) AS oo, arg_max(close, minute) FILTER (WHERE {_open}) AS oc, arg_min(open, minute) FILTER (WHERE {_close}) AS co, arg_max(close, minute) FILTER (WHERE {_close}) AS cc,
    sum(volume) FILTER (WHERE {_open}) AS ov, sum({_open}::INT) AS onn, sum(volume) AS v, count(*) AS n, max(high) AS h, min(low) AS l, arg_min(open, minute) AS op, arg_max(close, minute) AS cl FROM minute_bars GROUP BY 1, 2""",
)
q.cte("sod1", f"SELECT *, {q.lag('cl')} AS pc FROM sod0")
q.cte("sod2", "SELECT *, abs((op - pc) / nullif(pc, 0)) AS gap FROM sod1")


@plan(
    "session_of_day",
    72,
    "symbol date opening_reversal closing_ramp opening_volume_surge intraday_volatility_ratio",
    """SELECT symbol, date, coalesce((oc - oo) / nullif(oo, 0), 0) AS opening_reversal, coalesce((cc - co) / nullif(co, 0), 0) AS closing_ramp, coalesce(CASE WHEN v / n * onn > 0 THEN ov / (v / n * onn) - 1 END, 0) AS opening_volume_surge,
    coalesce(CASE WHEN gap > 0 THEN (h - l) / nullif(l, 0) / gap END, 1) AS intraday_volatility_ratio FROM sod2""",
)
def _(t):
    return op.session_of_day(t.minute_bars())


_pc = q.lag("close")


@plan(
    "ohlc_session_proxies",
    73,
    "symbol date opening_reversal closing_ramp opening_volume_surge intraday_volatility_ratio",
    f"""SELECT symbol, date, coalesce((high - open) / nullif(high - low, 0), 0) AS opening_reversal, coalesce((close - low) / nullif(high - low, 0), 0) AS closing_ramp,
    coalesce(CASE WHEN {q.std('volume', 20, 1)} > 1e-12 THEN (volume - {q.mean('volume', 20, 1)}) / {q.std('volume', 20, 1)} END, 0) AS opening_volume_surge,
    coalesce(((high - low) / nullif(low, 0)) / nullif(abs((open - {_pc}) / nullif({_pc}, 0)), 0), 1) AS intraday_volatility_ratio FROM bars""",
)
def _(t):
    return op.ohlc_session_proxies(t.bars())


# ---- insider ------------------------------------------------------------------------------------------------------------
q.cte(
    "ins_daily",
    """SELECT symbol, filing_date, count(*) AS num_trades, sum((code = 'P')::INT) AS num_buy_trades, sum((code = 'S')::INT) AS num_sell_trades, sum(CASE WHEN code = 'P' THEN shares ELSE 0 END) AS buy_shares, sum(CASE WHEN code = 'S' THEN shares ELSE 0 END) AS sell_shares,
    sum(CASE WHEN code = 'P' THEN value ELSE 0 END) AS buy_value, sum(CASE WHEN code = 'S' THEN value ELSE 0 END) AS sell_value, sum(CASE WHEN code = 'P' AND ln IN (1, 3, 4) THEN value ELSE 0 END) AS exec_buy_value, sum(CASE WHEN code = 'S' AND ln IN (1, 3, 4) THEN value ELSE 0 END) AS exec_sell_value,
    count(DISTINCT name) AS unique_insiders, count(DISTINCT CASE WHEN code = 'P' THEN name END) AS unique_buy_insiders, count(DISTINCT CASE WHEN code = 'S' THEN name END) AS unique_sell_insiders FROM insider GROUP BY 1, 2""",
)
_ins = "num_trades num_buy_trades num_sell_trades buy_shares sell_shares buy_value sell_value exec_buy_value exec_sell_value unique_insiders unique_buy_insiders unique_sell_insiders"


@plan("insider_daily", (75, 373), f"symbol filing_date:d {_ins}", "SELECT * FROM ins_daily")
def _(t):
    return op.insider_daily(t.insider())


_IN = _ins.split()
q.cte("ins_eff", "SELECT symbol, s.date, " + ", ".join(f"sum({c}) AS {c}" for c in _IN) + " FROM ins_daily i JOIN LATERAL (SELECT min(date) AS date FROM cal WHERE date > i.filing_date) s ON true WHERE s.date IS NOT NULL GROUP BY 1, 2")
q.cte("ins1", "SELECT n.symbol, n.date, rn, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _IN) + " FROM numbered n LEFT JOIN ins_eff USING (symbol, date)")
q.cte("ins2", "SELECT *, buy_value - sell_value AS net_value_1d FROM ins1")
_dsin = lambda c: f"coalesce(rn - max(CASE WHEN {c} > 0 THEN rn END) OVER {q.over()}, 9999)"
_if = {
    "net_value_1d": "net_value_1d",
    "exec_net_value_1d": "exec_buy_value - exec_sell_value",
    "cluster_buy_1d": q.flag("buy_value > 0 AND (unique_buy_insiders >= 3 OR num_buy_trades >= 3)"),
    "days_since_buy": _dsin("buy_value"),
    "days_since_sell": _dsin("sell_value"),
    **{f"net_value_{n}d": q.rsum("net_value_1d", n, 1) for n in (5, 20, 63)},
    **{f"num_trades_{n}d": q.rsum("num_trades", n, 1) for n in (5, 20, 63)},
}
q.cte("ins3", q.select(_if, "ins2"))
_nz20 = f"coalesce(CASE WHEN {q.std0('net_value_20d', 252, 20)} > 1e-6 THEN (net_value_20d - {q.mean('net_value_20d', 252, 20)}) / {q.std0('net_value_20d', 252, 20)} END, 0)"


@plan("insider_features", (75, 384), "symbol date " + " ".join(_if) + " net_value_20d_z252", f"SELECT *, {_nz20} AS net_value_20d_z252 FROM ins3")
def _(t):
    bars = t.bars()
    daily = al.effective_session(op.insider_daily(t.insider()), "filing_date", lb.sessions_table(bars))
    return op.insider_features(daily, bars)


# ---- releases -----------------------------------------------------------------------------------------------------------
_names = ["Core CPI m/m", "CPI y/y", "Nonfarm Payrolls", "Interest Rate Decision", "GDP q/q", "Housing Starts", "Core Consumer Price Index", "Core PCE Price Index", "Jobless Rate", "Manufacturing PMI", "Retail Sales m/m", "Prism Survey", "Core Retail Sales", "Producer Price Index"]
_imp = ["High", "2", "low", "9", "n/a"]
_impw = [3, 2, 1, 3, 1]
_case = lambda vals, x, n: "CASE " + " ".join(f"WHEN {x} % {n} = {i} THEN {('NULL' if v is None else repr(v))}" for i, v in enumerate(vals)) + " END"
# the SQL classifies each name by itself, by position of the fragments
_fragments = (("cpi", "consumer price index|cpi"), ("core_cpi", "core consumer price index|core cpi"), ("pce", "pce|personal consumption expenditures"), ("nfp", "nonfarm payroll|non-farm payroll|nfp"), ("unemployment", "unemployment rate|jobless rate"),
    ("gdp", "gross domestic product|gdp"), ("fomc", "fomc|fed|federal open market committee|interest rate decision"), ("retail_sales", "retail sales"), ("ism", "ism|pmi"))
_name_sql = "lower(" + _case(_names, "o_custkey", len(_names)) + ")"
_classified = (
    f"CASE WHEN regexp_matches({_name_sql}, 'core.*cpi|cpi.*core|core consumer price index') THEN 'core_cpi' "
    + " ".join(f"WHEN regexp_matches({_name_sql}, '{f}')" + (f" AND NOT regexp_matches({_name_sql}, 'core')" if k == "cpi" else "") + f" THEN '{k}'" for k, f in _fragments)
    + " END"
)
q.cte(
    "rel",
    f"""SELECT {_classified} AS type, {_case(_impw, 'o_custkey', 5)} AS weight, CASE WHEN isodow(o_orderdate::DATE) = 6 THEN o_orderdate::DATE + 2 WHEN isodow(o_orderdate::DATE) = 7 THEN o_orderdate::DATE + 1 ELSE o_orderdate::DATE END AS session,
    o_totalprice / 1000 AS actual, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 250.0 END AS forecast FROM orders""",
)


def releases(t):
    from barloom.sources.tables import roll_to_weekday

    pick = lambda vals, n: F.element_at(F.array(*[F.lit(v) for v in vals]), (F.col("o_custkey") % n + 1).cast("int"))
    o = t.raw("orders").select(
        pick(_names, len(_names)).alias("name"), pick(_imp, 5).alias("importance"), roll_to_weekday(F.col("o_orderdate").cast("date")).alias("session"),
        (F.col("o_totalprice") / 1000).alias("actual"), F.when(F.col("o_orderstatus") != "F", 250.0).alias("forecast"), "o_orderkey",
    )
    return o.withColumns({"type": op.event_type("name"), "weight": op.importance_weight("importance")})


@plan("release_classification", (371, 372), "type:s weight n:i", "SELECT type, weight, count(*) AS n FROM rel GROUP BY 1, 2")
def _(t):
    return releases(t).groupBy("type", "weight").agg(F.count("*").alias("n"))


@plan(
    "releases_per_session",
    77,
    "type:s session:d surprise weighted_surprise has_forecast n:i",
    "SELECT type, session, sum(coalesce(actual - forecast, 0)) AS surprise, sum(coalesce(actual - forecast, 0) * weight) AS weighted_surprise, max((forecast IS NOT NULL)::INT) AS has_forecast, count(*) AS n FROM rel WHERE type IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    return op.releases_per_session(releases(t).where(F.col("type").isNotNull()))


# ---- sentiment ------------------------------------------------------------------------------------------------------------
q.cte("evs", "SELECT event_type AS symbol, ts, value / 100 AS p, event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS lt FROM events")
q.cte("evs2", "SELECT *, CASE WHEN hour(lt) >= 16 THEN lt::DATE + 1 ELSE lt::DATE END AS session FROM evs")


def ticks(t):
    e = t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), (F.col("value") / 100).alias("p"), "user_id")
    return e.withColumn("session", al.market_session("ts"))


@plan("market_session_cutoff", 45, "symbol session:d n:i first_id:i last_id:i", "SELECT symbol, session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM evs2 GROUP BY 1, 2")
def _(t):
    return ticks(t).groupBy("symbol", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@plan(
    "daily_sentiment",
    79,
    "symbol session:d score conf n:i",
    "SELECT symbol, session, greatest(-1, least(1, 2 * avg(p) - 1)) AS score, greatest(0, least(1, greatest(0, least(1, abs(avg(p) - 0.5) * 2)) * greatest(0.2, least(1, ln(1 + count(p)) / ln(10))))) AS conf, count(p) AS n FROM evs2 GROUP BY 1, 2",
)
def _(t):
    return op.daily_sentiment(ticks(t))


_w = "greatest(0.1, exp(-0.693 * greatest(0, epoch_us(TIMESTAMP '2024-01-31' - INTERVAL 0 DAY) - epoch_us(ts)) / 3.6e9 / 48))"


@plan(
    "decayed_sentiment",
    80,
    "symbol sentiment n:i",
    f"SELECT symbol, sum(p * {_w} * (0.5 + p / 2)) / sum({_w} * (0.5 + p / 2)) AS sentiment, count(*) AS n FROM evs WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY 1",
)
def _(t):
    d = ticks(t).withColumns({"score": F.col("p"), "confidence": 0.5 + F.col("p") / 2})
    return op.decayed_sentiment(d, F.to_timestamp(F.lit("2024-01-31 00:00:00")), half_life_hours=48)


_K, _CK = [0.5, 0.3, 0.2], [1.0, 0.8, 0.6]
q.cte("sos0", "SELECT symbol, session AS d, p AS score, 0.5 + p / 2 AS conf, unnest([0, 1, 2]) AS i, unnest([0.5, 0.3, 0.2])::DOUBLE AS w, unnest([1.0, 0.8, 0.6])::DOUBLE AS ck FROM evs2")
q.cte("sos1", "SELECT *, CASE WHEN i = 0 THEN d ELSE d + (((CASE WHEN isodow(d) > 5 THEN 5 ELSE isodow(d) - 1 END) + i) // 5 * 7 + ((CASE WHEN isodow(d) > 5 THEN 5 ELSE isodow(d) - 1 END) + i) % 5 - (isodow(d) - 1))::INT END AS day FROM sos0")


@plan("spread_over_sessions", (81, 418), "symbol session:d score conf n:i", "SELECT symbol, day AS session, sum(score * w) / sum(w) AS score, greatest(0, least(1, sum(conf * w * ck) / sum(w))) AS conf, count(*) AS n FROM sos1 GROUP BY 1, 2")
def _(t):
    d = ticks(t).withColumns({"score": F.col("p"), "conf": 0.5 + F.col("p") / 2})
    return op.spread_over_sessions(d, ["score"], _K, _CK, "session")


# ---- market-wide ------------------------------------------------------------------------------------------------------------
q.cte("br0", f"SELECT symbol, date, close, {q.mean('close', 50)} AS sma, {q.rmin('close', 252, 20)} AS lo, ret FROM wrets")
q.cte(
    "br1",
    "SELECT date, avg((coalesce(close > sma, false))::INT) AS pct_above_50dma, sum((coalesce(close <= lo * 1.01, false))::INT) AS new_lows_count, sum((coalesce(ret > 0, false))::INT) AS advancing, sum((coalesce(ret < 0, false))::INT) AS declining FROM br0 GROUP BY date",
)
q.cte("br2", "SELECT *, advancing / (declining + 1)::DOUBLE AS advance_decline_ratio, sum(advancing - declining) OVER (ORDER BY date) AS ad_line FROM br1")


@plan("market_breadth", (56, 82), "date pct_above_50dma new_lows_count advancing declining advance_decline_ratio ad_line ad_line_slope", "SELECT *, (ad_line - lag(ad_line, 20) OVER (ORDER BY date)) / 20.0 AS ad_line_slope FROM br2")
def _(t):
    return op.breadth(t.bars_wide())


@plan(
    "pooled_statistics",
    84,
    "column:s mean std n:i",
    """SELECT 'close' AS "column", avg(close) AS mean, stddev_pop(close) AS std, count(*) AS n FROM tape0 WHERE nxt IS NOT NULL UNION ALL SELECT 'ret', avg(coalesce(ret, 0)), stddev_pop(coalesce(ret, 0)), count(*) FROM tape0 WHERE nxt IS NOT NULL""",
)
def _(t):
    return op.pooled_statistics(t.rets().withColumn("nxt", SYM.lead("ret")), ["close", "ret"], "nxt")


@plan("ftd_summary", 90, "symbol total_failed max_daily avg_daily reporting_days:i start:d end:d", "SELECT symbol, sum(volume) AS total_failed, max(volume) AS max_daily, avg(volume) AS avg_daily, count(*) AS reporting_days, min(date) AS start, max(date) AS \"end\" FROM bars GROUP BY symbol")
def _(t):
    return op.ftd_summary(t.bars(), "volume")


q.cte("lm0", "SELECT symbol, volume, rn, count(*) OVER (PARTITION BY symbol) AS n FROM numbered")
q.cte("lm1", "SELECT symbol, avg(volume) AS average_daily_volume, stddev_samp(volume) / avg(volume) AS volume_volatility, avg(CASE WHEN rn <= 10 THEN volume END) AS e, avg(CASE WHEN rn > n - 10 THEN volume END) AS r FROM lm0 GROUP BY symbol")
q.cte("lm2", "SELECT *, least(average_daily_volume / 1e6, 1) * 0.7 + greatest(0, 1 - volume_volatility) * 0.3 AS liquidity_score FROM lm1")


@plan(
    "liquidity_metrics",
    91,
    "symbol average_daily_volume volume_volatility volume_trend:s liquidity_score depth:s",
    "SELECT *, CASE WHEN r > e * 1.2 THEN 'increasing' WHEN r < e * 0.8 THEN 'decreasing' ELSE 'stable' END AS volume_trend, CASE WHEN liquidity_score > 0.7 THEN 'deep' WHEN liquidity_score > 0.4 THEN 'moderate' ELSE 'shallow' END AS depth FROM lm2",
)
def _(t):
    return op.liquidity_metrics(t.bars())


q.cte("vs0", "SELECT b.symbol, date, volume, volume / m AS multiple, n FROM bars b JOIN (SELECT symbol, avg(volume) AS m, stddev_samp(volume) AS s, count(*) AS n FROM bars GROUP BY 1) USING (symbol) WHERE volume > m + 2 * s")


@plan(
    "volume_spikes",
    92,
    "symbol date volume multiple spike_frequency pattern:s anomaly_score",
    "SELECT *, CASE WHEN spike_frequency > 0.1 THEN 'highly_volatile' WHEN spike_frequency > 0.05 THEN 'moderately_volatile' ELSE 'normal' END AS pattern, least(spike_frequency * 10, 1) AS anomaly_score FROM (SELECT *, count(*) OVER (PARTITION BY symbol) / n::DOUBLE AS spike_frequency FROM vs0)",
)
def _(t):
    return op.volume_spikes(t.bars())


# ---- funds: brand = fund, supplier = security ---------------------------------------------------------------------------
q.cte("hold", "SELECT p_brand AS fund, l_suppkey AS security, sum(l_extendedprice) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")


def holdings(t):
    li = t.raw("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    p = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("fund"))
    return li.join(p, "l_partkey").groupBy("fund", F.col("l_suppkey").alias("security")).agg(F.sum("l_extendedprice").alias("value"))


q.cte("fc0", "SELECT *, value / sum(value) OVER (PARTITION BY fund) AS weight, row_number() OVER (PARTITION BY fund ORDER BY value DESC, security) AS k FROM hold")


@plan(
    "fund_composition",
    93,
    "fund:s n_holdings:i total_value hhi top_weight largest_weight",
    "SELECT fund, count(*) AS n_holdings, sum(value) AS total_value, sum(weight * weight) AS hhi, sum(CASE WHEN k <= 10 THEN weight END) AS top_weight, max(weight) AS largest_weight FROM fc0 GROUP BY fund",
)
def _(t):
    return op.fund_composition(holdings(t))


q.cte("fo_size", "SELECT fund, count(*) AS n FROM hold GROUP BY fund")
q.cte("fo_pair", "SELECT a.fund AS fund_a, b.fund AS fund_b, count(*) AS shared FROM hold a JOIN hold b USING (security) WHERE a.fund <= b.fund GROUP BY 1, 2")


@plan(
    "fund_overlap",
    63,
    "fund_a:s fund_b:s shared:i overlap_pct common_to_all:i",
    """SELECT x.fund AS fund_a, y.fund AS fund_b, coalesce(shared, 0) AS shared, CASE WHEN x.fund = y.fund THEN 100.0 ELSE 100.0 * coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)) END AS overlap_pct,
    (SELECT count(*) FROM (SELECT security FROM hold GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM fo_size))) AS common_to_all FROM fo_size x JOIN fo_size y ON x.fund <= y.fund LEFT JOIN fo_pair p ON p.fund_a = x.fund AND p.fund_b = y.fund""",
)
def _(t):
    return al.fund_overlap(holdings(t))


# ---- experiments ------------------------------------------------------------------------------------------------------------
q.cte("abx0", "SELECT date, avg(y_true * sign(score)) AS ret, 'champion' AS arm FROM tape WHERE horizon = 5 GROUP BY date UNION ALL SELECT date, avg(y_true * sign(score)), 'challenger' FROM tape WHERE horizon = 21 GROUP BY date")
q.cte("abx1", "SELECT *, sum(ret) OVER (PARTITION BY arm ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM abx0")
q.cte("abx2", "SELECT *, eq - max(eq) OVER (PARTITION BY arm ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd FROM abx1")
q.cte("abx3", "SELECT arm, count(*) AS n, avg(ret) AS m, stddev_pop(ret) AS s, avg((ret > 0)::INT) AS w, min(dd) AS dd FROM abx2 GROUP BY arm")
q.cte("abx4", "SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.s AS s1, b.s AS s2, a.w AS w1, b.w AS w2, a.dd AS d1, b.dd AS d2 FROM abx3 a, abx3 b WHERE a.arm = 'champion' AND b.arm = 'challenger'")


@plan(
    "ab_test",
    101,
    "m_champion m_challenger s_champion s_challenger w_champion w_challenger dd_champion dd_challenger t_stat effect_size ci_lower ci_upper sample_ratio_mismatch",
    """SELECT m1 AS m_champion, m2 AS m_challenger, s1 AS s_champion, s2 AS s_challenger, w1 AS w_champion, w2 AS w_challenger, d1 AS dd_champion, d2 AS dd_challenger, (m2 - m1) / sqrt((n1 * s1 * s1 + n2 * s2 * s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t_stat,
    (m2 - m1) / sqrt(((n2 - 1) * s2 * s2 + (n1 - 1) * s1 * s1) / (n1 + n2 - 2)) AS effect_size, m2 - m1 - 1.96 * sqrt(s2 * s2 / n2 + s1 * s1 / n1) AS ci_lower, m2 - m1 + 1.96 * sqrt(s2 * s2 / n2 + s1 * s1 / n1) AS ci_upper, abs(n1 / n2::DOUBLE - 1) AS sample_ratio_mismatch FROM abx4""",
)
def _(t):
    d = t.tape().withColumn("arm", F.when(F.col("horizon") == 5, "champion").otherwise("challenger"))
    d = d.groupBy("arm", "date").agg(F.avg(F.col("y_true") * F.signum("score")).alias("ret"))
    return op.ab_test(d)


_need = math.ceil(((op.Z[0.975] + op.Z[0.8]) / 0.1) ** 2 * 2)


@plan("sample_size", 102, "symbol std available:i needed_champion:i needed_challenger:i detectable_difference enough", f"SELECT symbol, stddev_samp(y_true) AS std, count(*) AS available, {_need} AS needed_champion, {_need} AS needed_challenger, 0.1 * stddev_samp(y_true) AS detectable_difference, (count(*) >= {2 * _need})::INT AS enough FROM tape GROUP BY symbol")
def _(t):
    return op.sample_size(t.tape(), "y_true", 0.1, ["symbol"])


q.cte("sa0", "SELECT c_custkey, c_mktsegment || '|' || CASE WHEN c_acctbal >= 0 THEN 'high' ELSE 'low' END AS stratum FROM customer")


@plan(
    "stratified_allocation",
    103,
    "stratum:s arm:i n:i",
    "SELECT stratum, ('0x' || substr(md5(c_custkey || '|' || stratum || '|exp'), 1, 8))::BIGINT % 2 AS arm, count(*) AS n FROM sa0 GROUP BY 1, 2",
)
def _(t):
    return op.stratified_allocation(t.raw("customer"), "c_custkey", "c_mktsegment", "c_acctbal").groupBy("stratum", "arm").agg(F.count("*").alias("n"))
