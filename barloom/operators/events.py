"""Event-distance, streak and run operators (gaps and islands) on sparse events and daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, col, flag, ratio
from barloom.functions.windows import SYM, Roll
from barloom.operators.market import spells


def days_since_pulse(df: DataFrame, event, out: str, never: float = 9999.0, r: Roll = SYM) -> DataFrame:
    """Rows since the last event (0 on it), `never` before the first."""
    return r.numbered(df).withColumn(out, r.days_since(col(event), never)).drop("__rn")


def days_to_pulse(df: DataFrame, event, out: str, never: float = 9999.0, r: Roll = SYM) -> DataFrame:
    return r.numbered(df).withColumn(out, r.days_to(col(event), never)).drop("__rn")


def capped_days_since(df: DataFrame, event, out: str, cap: int = 999, r: Roll = SYM) -> DataFrame:
    """Rows since the last event, never above the cap, which also stands for 'no event yet'."""
    df = r.numbered(df).withColumn(out, F.least(F.lit(float(cap)), r.days_since(col(event), cap)))
    return df.drop("__rn")


def bounded_recency(days, cap: float = 252.0, tau: float = 10.0) -> Column:
    d = F.coalesce(clip(days, 0, cap), F.lit(float(cap)))
    return F.exp(-d / tau)


def split_features(bars: DataFrame, splits: DataFrame, r: Roll = SYM, never: float = 9999.0) -> DataFrame:
    """Product of split ratios per session, days since, post-5/20 flags, recency and 5-year calendar count.

    `splits` has (symbol, date, ratio), possibly several per session.
    """
    day = splits.groupBy("symbol", "date").agg(F.product("ratio").alias("split_ratio"))
    df = r.numbered(bars.join(day, ["symbol", "date"], "left"))
    on = F.col("split_ratio").isNotNull() & (F.col("split_ratio") > 0)
    seconds = F.unix_timestamp(F.col("date").cast("timestamp"))
    five_years = Window.partitionBy(*r.keys).orderBy("__sec").rangeBetween(-1825 * 86400 + 1, 0)
    df = df.withColumns({"split_flag": flag(on), "split_log_ratio": F.coalesce(F.when(on, F.ln("split_ratio")), F.lit(0.0)), "__sec": seconds})
    df = df.withColumns({"split_days_since": r.days_since(F.col("split_flag") == 1, never), "split_count_5y": F.sum("split_flag").over(five_years)})
    d = F.col("split_days_since")
    return df.withColumns({"split_post_5d": flag(d <= 5), "split_post_20d": flag(d <= 20), "split_recency": F.when(d < never, F.exp(-d / 20)).otherwise(0.0)}).drop("__rn", "__sec")


def calendar_zscore(df: DataFrame, x: str, out: str, days: int, mp: int = 3, r: Roll = SYM) -> DataFrame:
    """Population z over the last `days` calendar days (window open on the left); flat or short windows give 0."""
    df = df.withColumn("__day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(*r.keys).orderBy("__day").rangeBetween(-days + 1, 0)
    s = F.stddev_pop(x).over(w)
    ok = (F.count(x).over(w) >= mp) & (s > 1e-12)
    return df.withColumn(out, F.coalesce(F.when(ok, (F.col(x) - F.avg(x).over(w)) / s), F.lit(0.0))).drop("__day")


def streak(df: DataFrame, cond, out: str, r: Roll = SYM) -> DataFrame:
    """Length of the current run of rows where the condition holds (0 when it does not)."""
    df = df.withColumn("__on", F.coalesce(cond.cast("int"), F.lit(0)))
    df = df.withColumn("__blk", r.sum(1 - F.col("__on")))
    run = F.sum("__on").over(Window.partitionBy(*r.keys, "__blk").orderBy(*r.order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, run.cast("double")).drop("__on", "__blk")


def earnings_reports(df: DataFrame, r: Roll, cap: float = 500.0) -> DataFrame:
    """Per report: surprises, streaks, growth, beat rate, surprise volatility, estimate breadth and dispersion.

    Input per (symbol, period): eps_actual, eps_estimate, surprise_pct, revenue.
    """
    act, est, sp = F.col("eps_actual"), F.col("eps_estimate"), F.col("surprise_pct")
    df = streak(df, sp > 0, "beat_streak", r)
    df = streak(df, sp < 0, "miss_streak", r)
    nz = lambda x: F.coalesce(x, F.lit(0.0))

    def grow(x, k, base_abs):
        prev = r.lag(x, k)
        return clip(nz(ratio(F.col(x) - prev, F.abs(prev) if base_abs else prev) * 100), -cap, cap)

    past4 = r.mean("revenue", 4, 4, shift=1)
    fell = flag(r.lag("eps_estimate") > est)
    steps = F.least(r.row() - 1, F.lit(3))
    drops = F.sum(F.when(r.row() > 1, fell).otherwise(0.0)).over(r.frame(3))
    mean_abs = r.mean(F.abs(sp), 8, 4)
    return df.withColumns(
        {
            "eps_surprise_pct": nz(ratio(act - est, F.abs(est)) * 100),
            "eps_growth_qoq": grow("eps_actual", 1, True),
            "eps_growth_yoy": grow("eps_actual", 4, True),
            "revenue_growth_qoq": grow("revenue", 1, False),
            "revenue_growth_yoy": grow("revenue", 4, False),
            "revenue_surprise_pct": nz(ratio(F.col("revenue") - past4, past4) * 100),
            "beat_rate_3y": r.mean(flag(sp > 0), 12, 1) * 100,
            "surprise_volatility": nz(r.std0(sp, 8, 4)),
            "revision_breadth": F.when(steps >= 1, drops / steps * 200 - 100).otherwise(0.0),
            "estimate_dispersion": nz(F.when(mean_abs > 0, r.std0(sp, 8, 4) / mean_abs * 100)),
        }
    )


def daily_event_decay(bars: DataFrame, reports: DataFrame, columns: list[str], r: Roll = SYM, tau: float = 20.0) -> DataFrame:
    """Carry report values to sessions and decay them with calendar days since the report; distance to the next one.

    `reports` has (symbol, known_at, ...). Reports between sessions are kept by ordering both axes together.
    """
    axis = Roll("symbol", ["__d", "__kind"])
    ev = reports.select("symbol", F.col("known_at").alias("__d"), F.lit(0).alias("__kind"), F.col("known_at").alias("__ev"), *columns)
    both = bars.withColumns({"__d": F.col("date"), "__kind": F.lit(1)}).unionByName(ev, allowMissingColumns=True)
    both = both.withColumns(
        {
            **{c: F.last(c, ignorenulls=True).over(axis.frame(None)) for c in columns},
            "__last": F.last("__ev", ignorenulls=True).over(axis.frame(None)),
            "__next": F.first("__ev", ignorenulls=True).over(axis.ahead(None, 1)),
        }
    )
    df = both.where(F.col("__kind") == 1)
    since = F.datediff("date", "__last").cast("double")
    ahead = clip(F.coalesce(F.datediff("__next", "date"), F.lit(0)).cast("double"), 0, 120)
    return df.withColumns(
        {
            "days_since_report": since,
            "event_decay": F.exp(-since / tau),
            "days_to_next_report": ahead,
            "pre_event_stress": F.exp(-ahead / 7),
            "post_event_stress": F.exp(-since / 5),
        }
    ).drop(*[c for c in df.columns if c.startswith("__")])


def stale_tail(df: DataFrame, min_rows: int = 25, bad_share: float = 0.8) -> DataFrame:
    """Last reliable date per symbol when the series ends in a long constant, volume-less run; NULL otherwise.

    Three partial aggregations, no ordering: the last close, the last date with another close, the tail's counts.
    """
    last = df.groupBy("symbol").agg(F.max_by("close", "date").alias("__lc"), F.min("date").alias("__first"))
    d = df.join(last, "symbol")
    moved = d.groupBy("symbol").agg(F.max(F.when(F.col("close") != F.col("__lc"), F.col("date"))).alias("__moved"))
    d = d.join(moved, "symbol").where(F.col("__moved").isNull() | (F.col("date") > F.col("__moved")))
    t = d.groupBy("symbol").agg(
        F.count("*").alias("tail_rows"), F.avg(flag(F.col("volume").isNull() | (F.col("volume") <= 0))).alias("bad_share"),
        F.first("__moved").alias("__moved"), F.first("__first").alias("__first"),
    )
    stale = (F.col("tail_rows") >= min_rows) & (F.col("bad_share") >= bad_share)
    return t.withColumn("last_reliable_date", F.when(stale, F.coalesce("__moved", "__first"))).drop("__moved", "__first")


def threshold_runs(df: DataFrame, x: str, level: float, min_days: int, severe: int, r: Roll = SYM) -> DataFrame:
    """Runs of at least `min_days` consecutive rows with x >= level: start, end, length, average, severity."""
    df = df.withColumn("__hit", F.col(x) >= level)
    df = spells(df, "__hit", r).where("__hit")
    g = df.groupBy(*r.keys, "spell").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("days"), F.avg(x).alias("avg_quantity"))
    g = g.where(F.col("days") >= min_days)
    return g.withColumn("severity", F.when(F.col("days") >= severe, "high").otherwise("medium"))


def recent_trend(df: DataFrame, x: str, n: int = 10, r: Roll = SYM) -> DataFrame:
    """Direction, variation, leading persistence and acceleration of the last n rows per key (bounded by n)."""
    w = Window.partitionBy(*r.keys).orderBy(F.desc(r.order[0]))
    d = df.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= n)
    d = d.withColumn("__n", F.count("*").over(Window.partitionBy(*r.keys)))
    d = d.withColumns({"__i": F.col("__n") - F.col("__back"), "__v": F.col(x).cast("double")})
    first_zero = F.min(F.when(F.col("__v") <= 0, F.col("__i")))
    g = d.groupBy(*r.keys).agg(
        F.count("*").alias("n"), F.covar_pop("__i", "__v").alias("__c"), F.stddev_pop("__i").alias("__si"), F.stddev_pop("__v").alias("__sv"),
        ratio(F.stddev_samp("__v"), F.avg("__v")).alias("volatility"), F.coalesce(first_zero, F.count("*")).alias("persistence"),
        F.avg(F.when(F.col("__i") < 5, F.col("__v"))).alias("__early"), F.avg(F.when(F.col("__back") <= 5, F.col("__v"))).alias("__late"),
    )
    corr = F.when((F.col("__si") > 0) & (F.col("__sv") > 0), F.col("__c") / (F.col("__si") * F.col("__sv")))
    return g.withColumns(
        {
            "direction": F.when(F.col("n") < 5, "unknown").when(corr > 0.3, "increasing").when(corr < -0.3, "decreasing").otherwise("stable"),
            "recent_acceleration": flag((F.col("n") >= 6) & (F.col("__late") > F.col("__early") * 1.5)),
        }
    ).drop("__c", "__si", "__sv", "__early", "__late")


def holiday_features(sessions: DataFrame, holidays: DataFrame, r: Roll, never: float = 9999.0) -> DataFrame:
    """Adjacency, distance both ways, proximity, recency and liquidity stress around holidays (both tables are calendars)."""
    h = holidays.select(F.col("date").alias("__h")).distinct()
    hol = holidays.select("date", F.lit(0).alias("__kind"), F.col("date").alias("__h")).distinct()
    both = sessions.withColumn("__kind", F.lit(1)).unionByName(hol, allowMissingColumns=True)
    axis = Roll([], ["date", "__kind"])
    base = Window.partitionBy(F.lit(0)).orderBy("date", "__kind")
    both = both.withColumns(
        {
            "__prev": F.last("__h", ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0)),
            "__next": F.first("__h", ignorenulls=True).over(base.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    df = both.where(F.col("__kind") == 1)
    nxt = F.when(F.col("__prev") == F.col("date"), F.col("date")).otherwise(F.col("__next"))
    df = df.withColumns({"__to": F.datediff(nxt, "date").cast("double"), "__since": F.datediff("date", "__prev").cast("double")})
    # a holiday on the next calendar day or the one before touches the session
    adj = (F.col("__since") == 1) | (F.col("__to") == 1)
    df = df.withColumns(
        {
            "days_to_holiday": F.coalesce("__to", F.lit(never)),
            "days_since_holiday": F.coalesce("__since", F.lit(never)),
            "is_holiday_adjacent": flag(adj),
            "is_half_day": flag(F.col("__to") == 1),
        }
    )
    df = df.withColumns({"holiday_prox": bounded_recency("days_to_holiday", 60, 3), "holiday_recency": bounded_recency("days_since_holiday", 60, 3)})
    stress = F.greatest("is_half_day", "is_holiday_adjacent") + 0.5 * F.col("holiday_prox") + 0.3 * F.col("holiday_recency")
    return df.withColumn("liquidity_stress", clip(stress, 0, 1)).drop("__kind", "__h", "__prev", "__next", "__to", "__since")


def index_membership(bars: DataFrame, events: DataFrame, r: Roll = SYM) -> DataFrame:
    """Membership intervals from add/remove events, effective the next session, with pulses and flow sums.

    `events` has (symbol, index_name, add_date, remove_date); the interval join is an equi-join on symbol with few events
    per symbol.
    """
    cal = bars.select("symbol", "date").withColumn("__prev", r.lag("date"))
    d = cal.join(events, "symbol", "left")
    # a change is visible from the first session after its date
    member = (F.col("date") > F.col("add_date")) & (F.col("remove_date").isNull() | (F.col("date") <= F.col("remove_date")))
    first = lambda c: (F.col("date") > F.col(c)) & (F.col("__prev").isNull() | (F.col("__prev") <= F.col(c))) & F.col("__prev").isNotNull()
    g = d.groupBy("symbol", "date").agg(
        F.countDistinct(F.when(member, F.col("index_name"))).cast("double").alias("num_indices"),
        F.sum(flag(first("add_date"))).alias("added"),
        F.sum(flag(first("remove_date"))).alias("removed"),
    )
    g = r.numbered(g)
    return g.withColumns(
        {
            "member": flag(F.col("num_indices") > 0),
            "days_since_add": r.days_since(F.col("added") > 0, 9999),
            "days_since_remove": r.days_since(F.col("removed") > 0, 9999),
            **{f"add_flow_{n}d": r.sum("added", n, 1) for n in (5, 20)},
            **{f"remove_flow_{n}d": r.sum("removed", n, 1) for n in (5, 20)},
        }
    ).drop("__rn")
