"""Plans: universe ranking, eligibility, peer context, rotation and portfolio cross-sections' inputs.

They run on the wide supplier universe, whose symbol count grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.orderstats import quantiles, with_ranks
from barloom.functions.windows import SYM
from barloom.operators import crosssection as op
from barloom.plans import duck as q
from barloom.plans.registry import plan

FAMILIES = {"mom": ["mom_5", "mom_20"], "vol": ["vol_std", "vol_range"], "liq": ["liq_rel"]}
WEIGHTS = {"mom": 0.5, "vol": -0.3, "liq": 0.2}


def panel(t):
    """Wide-universe feature panel: momentum, volatility and liquidity families."""
    r = SYM
    df = t.bars_wide().withColumn("ret", r.pct("close"))
    return df.select(
        "symbol", "date", "close", "volume", "ret",
        r.pct("close", 5).alias("mom_5"), r.pct("close", 20).alias("mom_20"), r.std("ret", 20, 10).alias("vol_std"),
        ratio(F.col("high") - F.col("low"), "close").alias("vol_range"), ratio("volume", r.mean("volume", 20, 5)).alias("liq_rel"),
    )


q.cte("wrets", f"SELECT *, {q.pct('close')} AS ret FROM bars_wide")
q.cte(
    "panel",
    f"SELECT symbol, date, close, volume, ret, {q.pct('close', 5)} AS mom_5, {q.pct('close', 20)} AS mom_20, {q.std('ret', 20, 10)} AS vol_std, (high - low) / close AS vol_range, volume / {q.mean('volume', 20, 5)} AS liq_rel FROM wrets",
)
q.cte("wcal", "SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM panel)")
_mean2 = lambda a, b: f"(coalesce({a}, 0) + coalesce({b}, 0)) / nullif(({a} IS NOT NULL)::INT + ({b} IS NOT NULL)::INT, 0)"
q.cte("snap0", f"SELECT symbol, date, {_mean2('mom_5', 'mom_20')} AS snap_mom, {_mean2('vol_std', 'vol_range')} AS snap_vol, liq_rel AS snap_liq FROM panel")
q.cte("snap", "SELECT symbol, t.date, s.date AS effective_date, snap_mom, snap_vol, snap_liq FROM snap0 s JOIN wcal c ON c.date = s.date JOIN wcal t ON t.session = c.session + 1")


def _z(c):
    return f"greatest(-3, least(3, coalesce(CASE WHEN stddev_pop({c}) OVER (PARTITION BY date) > 1e-12 THEN ({c} - avg({c}) OVER (PARTITION BY date)) / stddev_pop({c}) OVER (PARTITION BY date) END, 0)))"


def _score(src, where=""):
    zs = ", ".join(f"{_z(f'snap_{f}')} AS z_{f}" for f in FAMILIES)
    n = " + ".join(f"(snap_{f} IS NOT NULL)::INT" for f in FAMILIES)
    score = " + ".join(f"{w} * z_{f}" for f, w in WEIGHTS.items())
    return f"SELECT *, CASE WHEN non_nan_families >= 2 THEN round({score}, 12) END AS score FROM (SELECT *, {zs} FROM (SELECT *, {n} AS non_nan_families FROM {src}) {where})"


q.cte("tier2", _score("snap"))
RANKED = "symbol date effective_date:d score rank:i non_nan_families:i z_mom z_vol z_liq"


@plan("tier2_ranking", (191, 192, 193, 343, 51), RANKED, "SELECT *, CASE WHEN score IS NOT NULL THEN dense_rank() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST) END AS rank FROM tier2")
def _(t):
    return op.weighted_rank(op.family_snapshot(panel(t), FAMILIES, sessions=t.sessions()), WEIGHTS, min_families=2)


@plan("zscore_cross_section", 191, "symbol date z_mom z_vol z_liq", "SELECT * FROM tier2")
def _(t):
    from barloom.functions.orderstats import group_zscore

    return group_zscore(op.family_snapshot(panel(t), FAMILIES, sessions=t.sessions()), ["date"], {f"z_{f}": f"snap_{f}" for f in FAMILIES}, 3.0, whole=True)


@plan("family_snapshot", 192, "symbol date effective_date:d snap_mom snap_vol snap_liq", "SELECT * FROM snap")
def _(t):
    return op.family_snapshot(panel(t), FAMILIES, sessions=t.sessions())


ASOF = "1999-06-30"
q.cte("asof0", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY symbol) AS cnt FROM snap0 WHERE date <= DATE '{ASOF}'")
q.cte("asof1", f"SELECT symbol, DATE '{ASOF}' AS date, date AS effective_date, snap_mom, snap_vol, snap_liq FROM asof0 WHERE back = least(2, cnt)")
q.cte("asof2", _score("asof1", "WHERE non_nan_families >= 2"))


@plan("tier2_rank_asof", (51, 193), RANKED, "SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY score DESC) AS rank FROM asof2")
def _(t):
    return op.weighted_rank(op.asof_snapshot(panel(t), FAMILIES, ASOF, 1), WEIGHTS, min_families=2, mask="before")


@plan(
    "tier2_top10",
    (193, 343),
    "symbol date score rank:i",
    "SELECT * FROM (SELECT symbol, date, score, dense_rank() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST) AS rank FROM tier2 WHERE score IS NOT NULL) WHERE rank <= 10",
)
def _(t):
    df = op.weighted_rank(op.family_snapshot(panel(t), FAMILIES, sessions=t.sessions()), WEIGHTS, min_families=2)
    return df.where(F.col("rank") <= 10).orderBy("date", "rank", F.asc_nulls_last("symbol"))


def _pct(x, part):
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, ({x} IS NULL) ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / (count({x}) OVER (PARTITION BY {part}))::DOUBLE END"


@plan("percentile_rank", 194, "symbol date pct cheap_pct", f"SELECT symbol, date, {_pct('volume', 'date')} AS pct, 1 - {_pct('volume', 'date')} AS cheap_pct FROM bars_wide")
def _(t):
    df = op.percentile_rank(t.bars_wide(), ["date"], "volume", "pct")
    return df.withColumn("cheap_pct", 1 - F.col("pct"))


q.cte("peers", "SELECT p.symbol, p.date, sector, industry, mom_5 AS pe, volume AS pb, mcap FROM panel p JOIN profile USING (symbol)")


def peers(t):
    return panel(t).join(t.profile(), "symbol").select("symbol", "date", "sector", "industry", F.col("mom_5").alias("pe"), F.col("volume").alias("pb"), "mcap")


def _peer(m, gate, neutral, fallback):
    s = f"(CASE WHEN count({m}) OVER (PARTITION BY date, sector) >= {gate} THEN {_pct(m, 'date, sector')} END)"
    i = f"(CASE WHEN count({m}) OVER (PARTITION BY date, industry) >= {gate} THEN {_pct(m, 'date, industry')} END)"
    chain = f"{i}, {s}, {neutral}" if fallback else f"{i}, {neutral}"
    cheap = f"1 - {i}, 1 - {s}, {neutral}" if fallback else f"1 - {i}, {neutral}"
    return {
        f"sector_{m}_pct": f"coalesce({s}, {neutral})",
        f"sector_{m}_cheap_pct": f"coalesce(1 - {s}, {neutral})",
        f"industry_{m}_pct": f"coalesce({chain})",
        f"industry_{m}_cheap_pct": f"coalesce({cheap})",
    }


_pp = {**_peer("pe", 3, 0.5, True), **_peer("pb", 3, 0.5, True)}
_ps = {**_peer("pe", 0, 0.0, False), "sector_peer_count": "count(pe) OVER (PARTITION BY date, sector)", "industry_peer_count": "count(pe) OVER (PARTITION BY date, industry)",
       "has_data": q.flag("count(pe) OVER (PARTITION BY date, sector) >= 3")}


@plan("peer_percentiles", 195, "symbol date " + " ".join(_pp), q.select(_pp, "peers"))
def _(t):
    return op.peer_percentiles(peers(t), ["pe", "pb"])


@plan("peer_snapshot", (196, 62), "symbol date " + " ".join(_ps), q.select(_ps, "peers"))
def _(t):
    return op.peer_counts(op.peer_percentiles(peers(t), ["pe"], 0, 0, neutral=0.0, fallback=False), "pe")


q.cte("uni1", "SELECT symbol, date, ln(close) AS x FROM bars_wide")
q.cte("uni2", "SELECT *, avg(x) OVER (PARTITION BY date) AS mean, stddev_pop(x) OVER (PARTITION BY date) AS std, count(x) OVER (PARTITION BY date) AS peer_count FROM uni1")
q.cte("uni3", "SELECT *, greatest(3, least(10, (SELECT max(peer_count) FROM uni2))) AS min_peers, greatest(-8, least(8, (x - mean) / (abs(std) + 1e-6))) AS z0 FROM uni2")
# normal distribution function by its everywhere convergent series (|z| <= 8 is far inside double range for |z| < 4)
_series = "list_sum(list_transform(range(0, 120), lambda k: pow(-1, k) * pow(abs(z0) / sqrt(2), 2 * k + 1) / (exp(lgamma(k + 1)) * (2 * k + 1))))"
_cdf = f"(CASE WHEN abs(z0) < 5 THEN 0.5 + sign(z0) * {_series} / sqrt(pi()) WHEN z0 > 0 THEN 1 ELSE 0 END)"


@plan(
    "universe_context",
    (83, 197, 198, 199),
    "symbol date mean std peer_count:i min_peers:i z pct",
    f"SELECT *, z0 * {q.flag('peer_count >= min_peers')} AS z, {_cdf} * {q.flag('peer_count >= min_peers')} AS pct FROM uni3",
)
def _(t):
    return op.universe_context(t.bars_wide().withColumn("x", F.ln("close")), "x")


@plan("universe_stats", 83, "date mean std peer_count:i", "SELECT date, avg(x) AS mean, stddev_pop(x) AS std, count(x) AS peer_count FROM uni1 GROUP BY date")
def _(t):
    x = F.ln("close")
    return t.bars_wide().groupBy("date").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("peer_count"))


# ---- rotation, entropy, bets -------------------------------------------------------------------------------------
q.cte("wts", "SELECT symbol, date, ret, CASE WHEN volume % 3 < 1 THEN 0 ELSE sin(volume) / 10 END AS weight, abs(sin(volume)) * 0.5 AS sigma, cos(volume) AS mu FROM wrets")


def weights(t):
    v = F.col("volume")
    return t.bars_wide().withColumn("ret", SYM.pct("close")).select(
        "symbol", "date", "ret", F.when(v % 3 < 1, 0.0).otherwise(F.sin(v) / 10).alias("weight"), (F.abs(F.sin(v)) * 0.5).alias("sigma"), F.cos(v).alias("mu")
    )


q.cte("wmkt", "SELECT date, avg(ret) AS mkt FROM wrets GROUP BY date")
q.cte("rot1", f"SELECT *, coalesce({q.lag('weight')}, 0) AS w, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM wts")
q.cte("rot2", f"SELECT r.symbol, r.date, rn, w, coalesce({q.lag('w')}, 0) AS pw, coalesce(ret, 0) AS r, coalesce(mkt, 0) AS rb FROM rot1 r LEFT JOIN wmkt USING (date)")
q.cte(
    "rot3",
    """SELECT date, sum((abs(w) > 1e-4)::INT) AS active_count, sum((abs(w) > 1e-4 AND abs(pw) <= 1e-4)::INT) AS entrants, sum((abs(w) <= 1e-4 AND abs(pw) > 1e-4)::INT) AS exits,
    0.5 * sum(abs(w - pw)) AS turnover_proxy, sum(CASE WHEN abs(w) > 1e-4 AND abs(pw) <= 1e-4 THEN w * r ELSE 0 END) AS entrants_pnl, sum(CASE WHEN abs(w) > 1e-4 AND abs(pw) > 1e-4 THEN w * r ELSE 0 END) AS incumbents_pnl,
    sum(CASE WHEN abs(w) > 1e-4 AND abs(pw) <= 1e-4 THEN w * (r - rb) ELSE 0 END) AS entrants_active_pnl, sum(CASE WHEN abs(w) > 1e-4 AND abs(pw) > 1e-4 THEN w * (r - rb) ELSE 0 END) AS incumbents_active_pnl FROM rot2 GROUP BY date""",
)
_avgrank = lambda x: f"rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"
q.cte("rot4", f"SELECT date, {_avgrank('pw')} AS a, {_avgrank('w')} AS b FROM rot2 WHERE rn > 1")
q.cte("rot5", "SELECT date, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(a) > 1e-12 AND stddev_pop(b) > 1e-12 THEN corr(a, b) END AS rank_stability FROM rot4 GROUP BY date")


@plan(
    "universe_rotation",
    226,
    "date active_count entrants exits turnover_proxy entrants_pnl incumbents_pnl entrants_active_pnl incumbents_active_pnl churn_rate rank_stability",
    "SELECT *, (entrants + exits) / nullif(active_count, 0)::DOUBLE AS churn_rate FROM rot3 LEFT JOIN rot5 USING (date)",
)
def _(t):
    w = weights(t)
    return op.universe_rotation(w, w.groupBy("date").agg(F.avg("ret").alias("mkt")))


q.cte("spr", f"SELECT date, {_avgrank('ret')} AS a, {_avgrank('mu')} AS b FROM wts WHERE ret IS NOT NULL AND mu IS NOT NULL")


@plan(
    "spearman_by_date",
    (227, 320),
    "date n:i spearman",
    "SELECT date, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(a) > 1e-12 AND stddev_pop(b) > 1e-12 THEN corr(a, b) END AS spearman FROM spr GROUP BY date",
)
def _(t):
    return op.rank_correlation(weights(t), ["date"], "ret", "mu")


@plan(
    "score_entropy",
    228,
    "date n:i entropy",
    "SELECT date, count(mu) AS n, CASE WHEN count(mu) >= 3 THEN (ln(sum(abs(mu))) - sum(abs(mu) * ln(abs(mu))) / sum(abs(mu))) / ln(count(mu)) END AS entropy FROM wts GROUP BY date",
)
def _(t):
    return op.entropy_of_scores(weights(t), ["date"], "mu")


@plan("effective_bets", 229, "date gross effective_n", "SELECT date, sum(abs(weight)) AS gross, CASE WHEN sum(abs(weight)) > 1e-12 THEN pow(sum(abs(weight)), 2) / sum(weight * weight) ELSE 0 END AS effective_n FROM wts GROUP BY date")
def _(t):
    return op.effective_bets(weights(t), ["date"], "weight")


@plan(
    "sigma_health",
    230,
    "date sigma_median sigma_p90 sigma_p99 collapse_pct corr_abs_mu_sigma",
    "SELECT date, quantile_cont(sigma, 0.5) AS sigma_median, quantile_cont(sigma, 0.9) AS sigma_p90, quantile_cont(sigma, 0.99) AS sigma_p99, avg((sigma <= 0.1)::INT) AS collapse_pct, "
    "CASE WHEN stddev_pop(abs(mu)) > 1e-12 AND stddev_pop(sigma) > 1e-12 THEN corr(abs(mu), sigma) END AS corr_abs_mu_sigma FROM wts GROUP BY date",
)
def _(t):
    return op.sigma_health(weights(t), ["date"], "mu", "sigma", eps=0.1)


# ---- eligibility, selection, roles ------------------------------------------------------------------------------
q.cte("elig0", f"SELECT symbol, date, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars_wide WHERE date <= DATE '{ASOF}'")
q.cte("elig1", "SELECT symbol, max(CASE WHEN back = 1 THEN close END) AS close, avg(CASE WHEN back <= 20 THEN volume END) AS adv20, count(*) AS n_rows FROM elig0 GROUP BY symbol")
q.cte(
    "elig2",
    """SELECT e.*, mcap AS market_cap, sector, industry AS country, CASE WHEN substr(symbol, 2)::BIGINT % 17 = 0 THEN 'yes' ELSE '0' END AS is_etf, CASE WHEN substr(symbol, 2)::BIGINT % 19 = 0 THEN 'TRUE ' ELSE 'no' END AS is_adr,
    '' AS is_fund, CASE WHEN substr(symbol, 2)::BIGINT % 23 = 0 THEN '1.0' ELSE '0.0' END AS suspended FROM elig1 e JOIN profile USING (symbol)""",
)
_el = [
    ("IS_ETF", "is_etf <> 'yes'"),
    ("IS_ADR", "is_adr <> 'TRUE '"),
    ("SECTOR", "sector <> 'ASIA'"),
    ("MARKET_CAP", "coalesce(market_cap >= 500, false)"),
    ("AVG_VOLUME", "coalesce(adv20 >= 26, false)"),
    ("PRICE", "coalesce(close >= 700, false)"),
    ("SUSPENDED", "suspended <> '1.0'"),
]
_reason = "CASE " + " ".join(f"WHEN NOT ({c}) THEN '{n}'" for n, c in _el) + " END"


def _asof_rows(t):
    from pyspark.sql import Window

    known = t.bars_wide().where(F.col("date") <= F.lit(ASOF).cast("date"))
    k = known.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    return k.groupBy("symbol").agg(
        F.max(F.when(F.col("back") == 1, F.col("close"))).alias("close"), F.avg(F.when(F.col("back") <= 20, F.col("volume"))).alias("adv20"), F.count("*").alias("n_rows")
    )


def _candidates(t):
    k = F.substring("symbol", 2, 20).cast("bigint")
    return _asof_rows(t).join(t.profile(), "symbol").select(
        "symbol", "close", "adv20", "n_rows", F.col("mcap").alias("market_cap"), "sector", F.col("industry").alias("country"), F.lit("US").alias("exchange"),
        F.when(k % 17 == 0, "yes").otherwise("0").alias("is_etf"), F.when(k % 19 == 0, "TRUE ").otherwise("no").alias("is_adr"), F.lit("").alias("is_fund"),
        F.when(k % 23 == 0, "1.0").otherwise("0.0").alias("suspended"), F.lit(None).cast("string").alias("delisted"),
    )


@plan(
    "tier1_eligibility",
    (37, 232, 383),
    "symbol exclusion_reason:s instrument_type:s eligible flag_market_cap_ok flag_avg_volume_ok flag_price_ok flag_sector_ok",
    f"""SELECT symbol, {_reason} AS exclusion_reason, CASE WHEN is_etf = 'yes' THEN 'ETF' WHEN is_adr = 'TRUE ' THEN 'ADR' ELSE 'COMMON_STOCK' END AS instrument_type, CASE WHEN {_reason} IS NULL THEN 1 ELSE 0 END AS eligible,
    (coalesce(market_cap >= 500, false))::INT AS flag_market_cap_ok, (coalesce(adv20 >= 26, false))::INT AS flag_avg_volume_ok, (close >= 700)::INT AS flag_price_ok, (sector <> 'ASIA')::INT AS flag_sector_ok FROM elig2""",
)
def _(t):
    c = _candidates(t).withColumn("symbol", F.upper(F.trim("symbol")))
    return op.eligibility(c, min_price=700, min_volume=26, min_mcap=500, blocked_sectors=["ASIA"])


@plan(
    "eligible_ranked",
    58,
    "symbol date score eligible",
    f"SELECT a.symbol, a.date, score, 1 AS eligible FROM asof2 a JOIN (SELECT symbol FROM elig2 WHERE {_reason} IS NULL) USING (symbol)",
)
def _(t):
    flags = op.eligibility(_candidates(t), min_price=700, min_volume=26, min_mcap=500, blocked_sectors=["ASIA"]).select("symbol", "eligible")
    ranked = op.weighted_rank(op.asof_snapshot(panel(t), FAMILIES, ASOF, 1), WEIGHTS, min_families=2, mask="before")
    return ranked.join(flags, "symbol", "left").where(F.col("eligible") == 1)


q.cte("sat_score", f"SELECT symbol, avg(abs(mom_5)) AS score FROM (SELECT symbol, mom_5, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM panel WHERE date <= DATE '{ASOF}') WHERE k <= 5 GROUP BY symbol")
q.cte("sat_core", "SELECT symbol FROM profile WHERE substr(symbol, 2)::BIGINT % 10 = 0")
q.cte("sat_pool", "SELECT symbol, score FROM sat_score JOIN elig1 USING (symbol) WHERE adv20 >= 24 AND n_rows >= 5 AND symbol NOT IN (SELECT symbol FROM sat_core)")
q.cte("sat_held", "SELECT symbol, substr(symbol, 2)::BIGINT AS age, 2.0 + substr(symbol, 2)::BIGINT % 5 AS peak FROM profile WHERE substr(symbol, 2)::BIGINT % 4 = 1")
q.cte("sat_kept", "SELECT h.symbol, coalesce(score, 0) AS score, 'kept' AS origin FROM sat_held h LEFT JOIN sat_pool USING (symbol) WHERE age < 10 OR coalesce(score, 0) > greatest(0.5, greatest(peak, coalesce(score, 0)) * 0.5)")
q.cte("sat_new", "SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS k FROM sat_pool WHERE symbol NOT IN (SELECT symbol FROM sat_kept)")
q.cte("sat_all", "SELECT symbol, score, origin FROM sat_kept UNION ALL SELECT symbol, score, 'added' FROM sat_new WHERE k <= 15 - (SELECT count(*) FROM sat_kept)")


def _satellites(t):
    from pyspark.sql import Window

    k = F.substring("symbol", 2, 20).cast("bigint")
    last = panel(t).where(F.col("date") <= F.lit(ASOF).cast("date")).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("k") <= 5)
    score = last.groupBy("symbol").agg(F.avg(F.abs("mom_5")).alias("score"))
    floors = _asof_rows(t).select("symbol", F.col("adv20").alias("adv"), "n_rows")
    held = t.profile().where(k % 4 == 1).select("symbol", k.alias("age"), (2.0 + k % 5).alias("peak"))
    core = t.profile().where(k % 10 == 0).select("symbol")
    return op.satellite_selection(score, floors, held, core, size=15, min_adv=24, min_history=5, min_stay=10, abs_floor=0.5, decay_fraction=0.5), core


@plan("satellite_selection", 231, "symbol score origin:s", "SELECT * FROM sat_all")
def _(t):
    return _satellites(t)[0]


@plan(
    "core_plus_satellites",
    345,
    "symbol block:i",
    "SELECT symbol, min(block) AS block FROM (SELECT symbol, 0 AS block FROM sat_core UNION ALL SELECT symbol, 1 FROM sat_all) GROUP BY symbol",
)
def _(t):
    sat, core = _satellites(t)
    return op.core_plus_satellites(core.withColumn("pos", F.col("symbol")), sat.select("symbol", F.col("symbol").alias("pos")))


q.cte(
    "role_in",
    "SELECT symbol, date, volume % 50 AS x_days_since_update, CASE WHEN volume % 7 < 1 THEN 0 ELSE 1 END AS x_has_data, liq_rel / 4 AS risk_a, vol_range AS risk_b, CASE WHEN mom_5 IS NOT NULL THEN least(1, abs(mom_5)) END AS regime_a, mom_20 AS mu, vol_std AS sigma, "
    "CASE WHEN volume > 60 THEN 1 ELSE 0 END AS split_flag, exp(-volume / 20) AS split_recency, ln(2) AS split_log_ratio FROM panel",
)
_ok = "(x_days_since_update <= 30 AND x_has_data >= 0.5)"
_u = lambda c: f"(CASE WHEN {c} IS NOT NULL THEN greatest(0, least(1, {c})) END)"


@plan(
    "role_context",
    233,
    "symbol date hygiene_ok risk_scale regime_multiplier quantile_z split_stress",
    f"""SELECT symbol, date, {_ok}::INT AS hygiene_ok, CASE WHEN {_ok} THEN 1 / (1 + coalesce({_mean2(_u('risk_a'), _u('risk_b'))}, 0)) ELSE 0 END AS risk_scale, CASE WHEN {_ok} THEN coalesce(1 - {_u('regime_a')}, 1) ELSE 0 END AS regime_multiplier,
    CASE WHEN {_ok} THEN coalesce(CASE WHEN sigma > 1e-9 THEN mu / sigma END, 0) ELSE 0 END AS quantile_z, CASE WHEN {_ok} THEN greatest(0, split_flag, split_recency) * abs(split_log_ratio) ELSE 0 END AS split_stress FROM role_in""",
)
def _(t):
    v = F.col("volume")
    df = panel(t).withColumns(
        {
            "x_days_since_update": v % 50, "x_has_data": F.when(v % 7 < 1, 0.0).otherwise(1.0), "risk_a": F.col("liq_rel") / 4, "risk_b": F.col("vol_range"),
            "regime_a": F.when(F.col("mom_5").isNotNull(), F.least(F.lit(1.0), F.abs("mom_5"))), "mu": F.col("mom_20"), "sigma": F.col("vol_std"),
            "split_flag": F.when(v > 60, 1.0).otherwise(0.0), "split_recency": F.exp(-v / 20), "split_log_ratio": F.ln(F.lit(2.0)),
        }
    )
    return op.role_context(df, {"x_days_since_update": 30, "x_has_data": 0.5}, ["risk_a", "risk_b"], ["regime_a"], "mu", "sigma", ["split_flag", "split_recency"], "split_log_ratio")
