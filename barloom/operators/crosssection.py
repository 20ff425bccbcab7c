"""Universe operators across symbols on one date: normalisation, ranking, eligibility, rotation diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, col, finite, flag, norm_cdf, row_mean
from barloom.functions.orderstats import group_zscore, quantiles, rank_table, with_ranks
from barloom.functions.windows import SYM, Roll


def session_index(df: DataFrame, date="date") -> DataFrame:
    """Distinct dates numbered 1..n (one row per session, bounded by the calendar)."""
    return df.select(date).distinct().withColumn("session", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)))


def family_snapshot(panel: DataFrame, families: dict[str, list[str]], shift: int = 1, sessions: DataFrame | None = None) -> DataFrame:
    """Row mean of each family's columns, moved `shift` sessions ahead on the calendar shared by all symbols. `sessions` are the
    panel's dates (repeats allowed) from where they are had without its features."""
    snap = panel.select("symbol", "date", *[row_mean([finite(c) for c in cols]).alias(f"snap_{f}") for f, cols in families.items()])
    if not shift:
        return snap.withColumn("effective_date", F.col("date"))
    # bounded by the calendar
    days = (panel if sessions is None else sessions).select("date").distinct()
    move = days.select("date", F.lead("date", shift).over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("__to"))
    return snap.join(F.broadcast(move.where(F.col("__to").isNotNull())), "date").withColumnRenamed("date", "effective_date").withColumnRenamed("__to", "date")


def asof_snapshot(panel: DataFrame, families: dict[str, list[str]], asof: str, shift: int = 1) -> DataFrame:
    """Per symbol the row `shift` sessions before its last one on or before `asof` (the first row when history is short).

    A max over (date, row) structs keeps at most shift+1 rows per symbol during the partial aggregation.
    """
    r = Roll("symbol", "date")
    known = panel.where(F.col("date") <= F.lit(asof).cast("date"))
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    known = known.withColumns({"__back": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy("symbol"))})
    pick = known.where(F.col("__back") == F.least(F.lit(shift + 1), F.col("__n")))
    return pick.select(
        # the date asked for, as no constant: joins on it keep their key
        "symbol", F.date_add("date", F.datediff(F.lit(asof).cast("date"), F.col("date"))).alias("date"), F.col("date").alias("effective_date"),
        *[row_mean([finite(c) for c in cols]).alias(f"snap_{f}") for f, cols in families.items()],
    )


def weighted_rank(snap: DataFrame, weights: dict[str, float], cap: float = 3.0, min_families: int = 1, mask: str = "after") -> DataFrame:
    """z per date and family, weighted score, dense rank (best first).

    mask="before" drops symbols with too few families before the z-scores (single-date ranking); mask="after" keeps them
    in the statistics and withholds their score (panel scoring). A date of a panel has a row per symbol and is scored where its
    rows are; the one date of a single-date ranking is all rows, which many tasks share.
    """
    snaps = {f: f"snap_{f}" for f in weights}
    count = sum((F.col(c).isNotNull().cast("int") for c in snaps.values()), F.lit(0))
    snap = snap.withColumn("non_nan_families", count)
    if mask == "before":
        snap = snap.where(F.col("non_nan_families") >= min_families)
    panel = mask != "before"
    z = group_zscore(snap, ["date"], {f"z_{f}": c for f, c in snaps.items()}, cap, whole=panel)
    score = sum((F.col(f"z_{f}") * F.lit(float(w)) for f, w in weights.items()), F.lit(0.0))
    z = z.withColumn("score", F.when(F.col("non_nan_families") >= min_families, F.round(score, 12)))
    return with_ranks(z, ["date"], "score", {"rank": "dense"}, descending=True, whole=panel)


def percentile_rank(df: DataFrame, keys, x: str, out: str, higher_is_better: bool = True) -> DataFrame:
    """rank(pct=True) with average ties; NULLs stay NULL and are not counted."""
    df = with_ranks(df, keys, x, {out: "pct"})
    return df if higher_is_better else df.withColumn(out, 1 - F.col(out))


def peer_percentiles(df: DataFrame, metrics: list[str], min_sector: int = 3, min_industry: int = 3, neutral: float = 0.5, fallback: bool = True) -> DataFrame:
    """Sector and industry percentiles with minimum-peer gates; industry falls back to sector, then to `neutral`. One row per symbol
    and date; all metrics and both groupings share one exchange by date."""
    scopes = {"sector": min_sector, "industry": min_industry}
    df = rank_table(df, "date", list(scopes), metrics)
    for m in metrics:
        p = {k: F.when(F.col(f"total_{k}_{m}") >= gate, F.col(f"pct_{k}_{m}")) if gate else F.col(f"pct_{k}_{m}") for k, gate in scopes.items()}
        for name, cheap in (("pct", False), ("cheap_pct", True)):
            s, i = (1 - p[k] if cheap else p[k] for k in ("sector", "industry"))
            df = df.withColumns(
                {
                    f"sector_{m}_{name}": clip(F.coalesce(s, F.lit(neutral)), 0, 1),
                    f"industry_{m}_{name}": clip(F.coalesce(i, s, F.lit(neutral)) if fallback else F.coalesce(i, F.lit(neutral)), 0, 1),
                }
            )
        df = df.drop(*[f"{n}_{k}_{m}" for n in ("pct", "total") for k in scopes])
    return df


def peer_counts(df: DataFrame, x: str) -> DataFrame:
    """Non-null members per (date, sector) and (date, industry) and the has_data flag, next to the rows; rows without one of the
    three are left out."""
    df = df.withColumns({f"{scope}_peer_count": F.count(x).over(Window.partitionBy("date", scope)) for scope in ("sector", "industry")})
    df = df.where(F.col("date").isNotNull() & F.col("sector").isNotNull() & F.col("industry").isNotNull())
    return df.withColumn("has_data", flag(F.col("sector_peer_count") >= 3))


def safe_z(x, mean, std, eps: float = 1e-6, cap: float = 8.0) -> Column:
    z = (col(x) - F.coalesce(col(mean), F.lit(0.0))) / (F.abs(F.coalesce(col(std), F.lit(0.0))) + eps)
    return clip(F.coalesce(finite(z), F.lit(0.0)), -cap, cap)


def universe_context(df: DataFrame, x: str, min_peers: int = 10) -> DataFrame:
    """Universe mean/std/count per date, z, normal percentile, both gated by the effective minimum of peers."""
    stats = df.groupBy("date").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("peer_count"))
    top = stats.agg(F.max("peer_count").alias("__mx"))
    stats = stats.join(F.broadcast(top))  # one row
    eff = F.greatest(F.lit(3), F.least(F.lit(max(3, min_peers)), F.greatest(F.lit(3), F.col("__mx"))))
    df = df.join(stats.withColumn("min_peers", eff).drop("__mx"), "date")
    gate = flag(F.col("peer_count") >= F.col("min_peers"))
    z = safe_z(x, "mean", "std")
    return df.withColumns({"z": z * gate, "pct": F.coalesce(norm_cdf(z), F.lit(0.5)) * gate})


def truthy(x) -> Column:
    """Provider flags as booleans: non-zero numbers and any text that is not a spelling of false."""
    t = F.lower(F.trim(col(x).cast("string")))
    number = t.try_cast("double")
    # fixed values: accepted spellings of false
    false = t.isin("0", "false", "f", "no", "n", "off", "", "none", "nan")
    return F.coalesce(F.when(false, False).when(number.isNotNull(), number != 0).otherwise(t.isNotNull()), F.lit(False))


def eligibility(
    df: DataFrame, *, min_price=None, min_volume=None, min_mcap=None, countries=None, sectors=None, blocked_sectors=None, exchange=None,
    exclude_etf=True, exclude_adr=True, exclude_fund=True,
) -> DataFrame:
    """Tier-1 gates on one as-of row per symbol and a single reason code by priority.

    Input: symbol, close, adv20, market_cap, country, sector, exchange, is_etf, is_adr, is_fund, suspended, delisted (raw
    provider flags). The exclude_* switches decide eligibility and reason alike.
    """
    on = lambda use, c: truthy(c) if use else F.lit(False)
    floor = lambda c, m: F.lit(True) if m is None else F.coalesce(F.col(c) >= float(m), F.lit(False))
    sector_ok = F.lit(True) if sectors is None else F.col("sector").isin(*sectors)
    if blocked_sectors:
        sector_ok = sector_ok & ~F.col("sector").isin(*blocked_sectors)
    ok = {
        "IS_ETF": ~on(exclude_etf, "is_etf"),
        "IS_ADR": ~on(exclude_adr, "is_adr"),
        "IS_FUND": ~on(exclude_fund, "is_fund"),
        "EXCHANGE": F.lit(True) if exchange is None else F.upper(F.col("exchange")).contains(exchange.upper()),
        "COUNTRY": F.lit(True) if countries is None else F.col("country").isin(*countries),
        "SECTOR": sector_ok,
        "MARKET_CAP": floor("market_cap", min_mcap),
        "AVG_VOLUME": floor("adv20", min_volume),
        "PRICE": floor("close", min_price),
        "SUSPENDED": ~truthy("suspended"),
        "DELISTED": ~truthy("delisted"),
    }
    reason = F.lit(None).cast("string")
    for name, cond in reversed(ok.items()):
        reason = F.when(F.coalesce(cond, F.lit(False)), reason).otherwise(F.lit(name))
    kind = F.when(truthy("is_etf"), "ETF").when(truthy("is_adr"), "ADR").when(truthy("is_fund"), "FUND").otherwise("COMMON_STOCK")
    df = df.withColumns({"exclusion_reason": reason, "instrument_type": kind})
    flags = {f"flag_{k.lower()}_ok": flag(F.coalesce(c, F.lit(False))) for k, c in ok.items() if not k.startswith("IS_")}
    return df.withColumns({**flags, "eligible": flag(F.col("exclusion_reason").isNull())})


def rank_correlation(df: DataFrame, keys, x: str, y: str, min_rows: int = 5) -> DataFrame:
    """Spearman correlation per group: average ranks of the rows where both sides are present, guarded Pearson."""
    keys = list(keys)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_ranks(both, keys, x, {"__rx": "avg"}, source=both)
    ranked = with_ranks(ranked, keys, y, {"__ry": "avg"}, source=both)
    g = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.covar_pop("__rx", "__ry").alias("__c"), F.stddev_pop("__rx").alias("__sx"), F.stddev_pop("__ry").alias("__sy")
    )
    ok = (F.col("n") >= min_rows) & (F.col("__sx") > 1e-12) & (F.col("__sy") > 1e-12)
    return g.withColumn("spearman", F.when(ok, F.col("__c") / (F.col("__sx") * F.col("__sy")))).drop("__c", "__sx", "__sy")


def entropy_of_scores(df: DataFrame, keys, x: str, eps: float = 1e-12) -> DataFrame:
    """Normalised entropy of |score| shares per group, NULL below three rows or zero mass.

    sum p ln p is split into sums of |s| and |s| ln|s|, so one partial aggregation is enough.
    """
    s = F.abs(F.col(x))
    g = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(s).alias("__z"), F.sum(F.when(s > 0, s * F.ln(s)).otherwise(0.0)).alias("__sl")
    )
    h = F.ln("__z") - F.col("__sl") / F.col("__z")
    return g.withColumn("entropy", F.when((F.col("n") >= 3) & (F.col("__z") > 0), h / F.ln(F.col("n")))).drop("__z", "__sl")


def effective_bets(df: DataFrame, keys, w: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.sum(F.abs(F.col(w))).alias("gross"), F.sum(F.col(w) * F.col(w)).alias("__sq"))
    ok = (F.col("gross") > 1e-12) & (F.col("__sq") > 1e-18)
    return g.withColumn("effective_n", F.when(ok, F.col("gross") * F.col("gross") / F.col("__sq")).otherwise(0.0)).drop("__sq")


def sigma_health(df: DataFrame, keys, mu: str, sigma: str, eps: float = 1e-3) -> DataFrame:
    """Median, p90, p99 of sigma, share at the floor, correlation of |mu| with sigma, per group."""
    keys = list(keys)
    d = df.where(F.col(mu).isNotNull() & F.col(sigma).isNotNull()).withColumn("__am", F.abs(F.col(mu)))
    qs = quantiles(d, keys, sigma, {"sigma_median": 0.5, "sigma_p90": 0.9, "sigma_p99": 0.99})
    g = d.groupBy(*keys).agg(
        F.avg(flag(F.col(sigma) <= eps)).alias("collapse_pct"), F.covar_pop("__am", sigma).alias("__c"), F.stddev_pop("__am").alias("__a"), F.stddev_pop(sigma).alias("__b")
    )
    g = g.withColumn("corr_abs_mu_sigma", F.when((F.col("__a") > 1e-12) & (F.col("__b") > 1e-12), F.col("__c") / (F.col("__a") * F.col("__b"))))
    return qs.join(g.drop("__a", "__b", "__c"), keys)


def universe_rotation(df: DataFrame, bench: DataFrame, threshold: float = 1e-4, r: Roll = SYM) -> DataFrame:
    """Daily entrants, exits, churn, turnover and P&L of entrants and incumbents from executed (lagged) weights.

    `df` holds (symbol, date, weight, ret) on a common calendar; `bench` (date, mkt).
    """
    df = df.withColumn("__w", F.coalesce(r.lag(F.coalesce(F.col("weight"), F.lit(0.0))), F.lit(0.0)))
    df = df.withColumns({"__pw": F.coalesce(r.lag("__w"), F.lit(0.0)), "__first": r.row() == 1})
    df = df.join(bench, "date", "left").withColumns({"__r": F.coalesce("ret", F.lit(0.0)), "__rb": F.coalesce("mkt", F.lit(0.0))})
    on, was = F.abs("__w") > threshold, F.abs("__pw") > threshold
    enter, leave, stay = on & ~was, ~on & was, on & was
    pnl, active = F.col("__w") * F.col("__r"), F.col("__w") * (F.col("__r") - F.col("__rb"))
    g = df.groupBy("date").agg(
        F.sum(flag(on)).alias("active_count"),
        F.sum(flag(enter)).alias("entrants"),
        F.sum(flag(leave)).alias("exits"),
        (0.5 * F.sum(F.abs(F.col("__w") - F.col("__pw")))).alias("turnover_proxy"),
        F.sum(F.when(enter, pnl).otherwise(0.0)).alias("entrants_pnl"),
        F.sum(F.when(stay, pnl).otherwise(0.0)).alias("incumbents_pnl"),
        F.sum(F.when(enter, active).otherwise(0.0)).alias("entrants_active_pnl"),
        F.sum(F.when(stay, active).otherwise(0.0)).alias("incumbents_active_pnl"),
    )
    rank = rank_correlation(df.where(~F.col("__first")), ["date"], "__pw", "__w").select("date", F.col("spearman").alias("rank_stability"))
    churn = F.when(F.col("active_count") > 0, (F.col("entrants") + F.col("exits")) / F.col("active_count"))
    return g.withColumn("churn_rate", churn).join(rank, "date", "left")


def satellite_selection(scores: DataFrame, floors: DataFrame, held: DataFrame, core: DataFrame, *, size: int, min_adv: float, min_history: int,
                        min_stay: int, abs_floor: float, decay_fraction: float) -> DataFrame:
    """Satellites at one rebalance: keep held names inside their minimum stay or above their decay gate, then top up.

    `scores` (symbol, score), `floors` (symbol, adv, n_rows), `held` (symbol, age, peak), `core` (symbol). The gate of a
    held name is max(abs_floor, peak * decay_fraction); free places go to the best scores, ties by symbol.
    """
    pool = scores.join(floors, "symbol").where((F.col("adv") >= min_adv) & (F.col("n_rows") >= min_history)).select("symbol", "score")
    pool = pool.join(core.select("symbol"), "symbol", "left_anti")
    h = held.join(pool, "symbol", "left").fillna(0.0, ["score"]).withColumn("peak", F.greatest("peak", "score"))
    gate = F.greatest(F.lit(float(abs_floor)), F.col("peak") * decay_fraction)
    kept = h.where((F.col("age") < min_stay) | (F.col("score") > gate)).select("symbol", "score", F.lit("kept").alias("origin"))
    room = kept.agg((F.lit(size) - F.count("*")).alias("__room"))
    fresh = pool.join(kept.select("symbol"), "symbol", "left_anti")
    # the sort keeps `size` rows per task before the final merge; the number of places is a single row
    fresh = fresh.orderBy(F.desc("score"), "symbol").limit(size)
    fresh = fresh.withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "symbol")))
    fresh = fresh.join(F.broadcast(room), F.col("__k") <= F.col("__room"))
    return kept.unionByName(fresh.select("symbol", "score", F.lit("added").alias("origin")))


def core_plus_satellites(core: DataFrame, satellites: DataFrame) -> DataFrame:
    """Order-preserving union: core positions first, then satellites, first occurrence wins."""
    both = core.select("symbol", F.lit(0).alias("block"), "pos").unionByName(satellites.select("symbol", F.lit(1).alias("block"), "pos"))
    return both.groupBy("symbol").agg(F.min(F.struct("block", "pos")).alias("__o")).select("symbol", "__o.block", "__o.pos")


def role_context(df: DataFrame, hygiene: dict[str, float], risk: list[str], regime: list[str], mu: str, sigma: str, split_strength: list[str], split_log_ratio: str) -> DataFrame:
    """Per (date, symbol): hygiene veto, risk scale 1/(1+mean), regime multiplier 1-mean, forecast z, split stress.

    `hygiene` maps a column to its limit: staleness columns must not exceed it, `*has_data` columns must reach it. Risk and
    regime columns are already scaled to [0, 1]. A vetoed row scales everything to zero.
    """
    ok = F.lit(True)
    for c, limit in hygiene.items():
        ok = ok & F.coalesce((F.col(c) <= limit) if "days_since_update" in c else (F.col(c) >= limit), F.lit(False))
    unit = lambda c: F.when(F.col(c).isNotNull(), clip(c, 0, 1))
    strength = F.greatest(F.lit(0.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in split_strength])
    out = {
        "risk_scale": 1 / (1 + F.coalesce(row_mean([unit(c) for c in risk]), F.lit(0.0))),
        "regime_multiplier": F.coalesce(1 - row_mean([unit(c) for c in regime]), F.lit(1.0)),
        "quantile_z": F.coalesce(F.when(F.col(sigma) > 1e-9, F.col(mu) / F.col(sigma)), F.lit(0.0)),
        "split_stress": strength * F.abs(F.coalesce(F.col(split_log_ratio), F.lit(0.0))),
    }
    return df.withColumns({"hygiene_ok": flag(ok), **{k: F.when(ok, v).otherwise(0.0) for k, v in out.items()}})
