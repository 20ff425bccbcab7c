"""Calendars, as-of and interval joins, scaffolds and upserts.

The standard as-of form unions both time axes and carries the last value forward in one window per symbol; it needs one
shuffle, no range join, and never pairs rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import col, finite
from barloom.functions.windows import Roll


# ---- calendar -------------------------------------------------------------------------------------------------------
def session_calendar(spark, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays between two dates minus holidays, numbered from 0."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    if holidays is not None:
        d = d.join(holidays.select("date"), "date", "left_anti")
    return d.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)  # one row per session


def session_on(df: DataFrame, date: str, sessions: DataFrame, out: str, direction: str = "after", strict: bool = False) -> DataFrame:
    """Nearest session on or after (or before) each date; NULL outside the calendar.

    The calendar is turned into one row per calendar day (a few thousand rows), so the lookup is an equi-join.
    """
    span = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence(F.date_sub("a", 10), F.date_add("b", 10))).alias("__day")).join(sessions.select(F.col("date").alias("__day"), F.col("date").alias("__s")), "__day", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("__day")
    off = 1 if strict else 0
    pick = F.first("__s", ignorenulls=True).over(w.rowsBetween(off, Window.unboundedFollowing)) if direction == "after" else F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -off))
    return df.join(days.select(F.col("__day").alias(date), pick.alias(out)), date, "left")


def add_sessions(df: DataFrame, session: str, n: int, sessions: DataFrame, out: str) -> DataFrame:
    """Session n places later (earlier when negative) by equi-joins on the session position."""
    here = sessions.select(F.col("date").alias(session), F.col("idx").alias("__i"))
    there = sessions.select((F.col("idx") - n).alias("__i"), F.col("date").alias(out))
    return df.join(here, session, "left").join(there, "__i", "left").drop("__i")


def market_session(ts, cutoff_seconds: int = 16 * 3600, tz: str = "America/New_York") -> Column:
    """Calendar date in the market's zone; at or after the cut-off the next day. Naive timestamps are UTC."""
    local = F.from_utc_timestamp(col(ts).cast("timestamp"), tz)
    secs = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    d = F.to_date(local)
    return F.when(secs >= cutoff_seconds, F.date_add(d, 1)).otherwise(d)


def effective_session(df: DataFrame, filing: str, sessions: DataFrame, out: str = "effective_session") -> DataFrame:
    """A filing becomes usable on the first session strictly after its date."""
    return session_on(df, filing, sessions, out, "after", strict=True)


# ---- scaffolds ------------------------------------------------------------------------------------------------------
def densify(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Every weekday between a symbol's first and last date, values carried forward (at most `limit` rows).

    The scaffold is generated per symbol from its own range, then left-joined.
    """
    span = df.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    scaffold = span.select("symbol", F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    r = Roll("symbol", "date")
    d = scaffold.join(df.select("symbol", "date", *columns, F.lit(1).alias("__real")), ["symbol", "date"], "left")
    d = d.withColumn("is_real", F.coalesce("__real", F.lit(0))).drop("__real")
    return d.withColumns({c: r.ffill(c, limit) for c in columns})


def panel_join(frames: list[DataFrame], keys=("symbol", "date"), fill: float | None = 0.0, keep_null: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of family frames; the first frame keeps overlapping columns; infinities and gaps are filled."""
    keys = list(keys)
    seen: set[str] = set(keys)
    parts = []
    for f in frames:
        cols = [c for c in f.columns if c not in seen]
        seen |= set(cols)
        parts.append(f.select(*keys, *cols))
    out = reduce(lambda a, b: a.join(b, keys, "full"), parts)
    if fill is None:
        return out
    return out.select(*keys, *[F.col(c) if c.startswith(tuple(keep_null) or ("\0",)) else F.coalesce(finite(c), F.lit(fill)).alias(c) for c in out.columns if c not in keys])


def coalesce_frames(first: DataFrame, second: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """Union of keys, the first frame's value wins where present."""
    keys = list(keys)
    cols = [c for c in first.columns if c not in keys] + [c for c in second.columns if c not in keys and c not in first.columns]
    a = first.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in first.columns if c not in keys])
    b = second.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in second.columns if c not in keys])
    j = a.join(b, keys, "full")
    pick = lambda c: [F.col(f"__{s}_{c}") for s in "ab" if f"__{s}_{c}" in j.columns]
    return j.select(*keys, *[F.coalesce(*pick(c)).alias(c) for c in cols])


# ---- as-of ----------------------------------------------------------------------------------------------------------
def asof_join(left: DataFrame, right: DataFrame, columns: list[str], keys=("symbol",), left_time="date", right_time="known_at", direction="backward", max_age_days: int | None = None) -> DataFrame:
    """Latest right row at or before (forward: at or after) each left row, per key; exact ties use the right row.

    Right rows with the same key and time must be unique (reduce them first).
    """
    keys = list(keys)
    axis = Roll(keys, ["__t", "__k"])
    side = 0 if direction == "backward" else 1
    hit = F.struct(F.col(right_time).alias("__at"), *[F.col(c) for c in columns])
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(side).alias("__k"), hit.alias("__h"))
    both = left.withColumns({"__t": F.col(left_time), "__k": F.lit(1 - side)}).unionByName(r, allowMissingColumns=True)
    w = axis.frame(None) if direction == "backward" else axis.ahead(None)
    pick = (F.last if direction == "backward" else F.first)("__h", ignorenulls=True).over(w)
    d = both.withColumn("__h", pick).where(F.col("__k") == 1 - side)
    gap = F.datediff(left_time, F.col("__h.__at")) if direction == "backward" else F.datediff(F.col("__h.__at"), left_time)
    ok = F.lit(True) if max_age_days is None else gap <= max_age_days
    return d.withColumns({**{c: F.when(ok, F.col(f"__h.{c}")) for c in columns}, "asof_time": F.when(ok, F.col("__h.__at"))}).drop("__t", "__k", "__h")


def schedule_lookup(df: DataFrame, schedule: DataFrame, date: str = "date") -> DataFrame:
    """Weights in force on each date: last schedule entry with asof <= date, one row per (row, family).

    `schedule` (asof, family, weight) is configuration; validity intervals make it a plain range filter per family.
    """
    w = Window.partitionBy("family").orderBy("asof")
    s = schedule.withColumn("__end", F.lead("asof").over(w))
    # no hint: the planner broadcasts the schedule where its size allows
    return df.join(s, (F.col(date) >= F.col("asof")) & (F.col("__end").isNull() | (F.col(date) < F.col("__end")))).drop("__end")


def valid_on(df: DataFrame, registry: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose symbol is still valid on their date: date <= stop_date (open when NULL). Equi-join plus filter."""
    j = df.join(registry.select("symbol", "stop_date"), "symbol")
    return j.where(F.col("stop_date").isNull() | (F.col(date) <= F.col("stop_date"))).drop("stop_date")


def missing_keys(requested: DataFrame, loaded: DataFrame, key="symbol") -> DataFrame:
    return requested.select(key).distinct().join(loaded.select(key), key, "left_anti")


def fund_overlap(holdings: DataFrame, funds: DataFrame | None = None) -> DataFrame:
    """Jaccard overlap (percent) of every pair of funds, of those in the table `funds` or of all, and the number of holdings common
    to all of them.

    Holdings are first reduced to the set of funds per security and equal sets to one row, so a security costs no more
    however often it is held.
    """
    if funds is not None:
        holdings = holdings.join(funds.select("fund"), "fund", "left_semi")
    h = holdings.groupBy("security").agg(F.sort_array(F.collect_set("fund")).alias("fs"))
    masks = h.groupBy("fs").agg(F.count("*").alias("n"))  # distinct membership patterns
    size = masks.select(F.explode("fs").alias("fund"), "n").groupBy("fund").agg(F.sum("n").alias("size"))
    pair = masks.select(F.explode("fs").alias("fund_a"), "fs", "n").select("fund_a", F.explode("fs").alias("fund_b"), "n").where(F.col("fund_a") <= F.col("fund_b"))
    inter = pair.groupBy("fund_a", "fund_b").agg(F.sum("n").alias("shared"))
    a, b = size.select(F.col("fund").alias("fund_a"), F.col("size").alias("__sa")), size.select(F.col("fund").alias("fund_b"), F.col("size").alias("__sb"))
    # every pair of funds is a row of the result
    grid = a.join(b, F.col("fund_a") <= F.col("fund_b"))
    out = inter.join(grid, ["fund_a", "fund_b"], "right").fillna(0, ["shared"])
    widest = masks.groupBy(F.size("fs").alias("__k")).agg(F.sum("n").alias("__n"))
    all_ = size.agg(F.count("*").cast("int").alias("__k"))
    common = F.broadcast(all_.join(widest, "__k", "left").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("common_to_all")))  # one row
    pct = F.when(F.col("fund_a") == F.col("fund_b"), 100.0).otherwise(100.0 * F.col("shared") / (F.col("__sa") + F.col("__sb") - F.col("shared")))
    return out.join(common).withColumn("overlap_pct", pct).drop("__sa", "__sb")


def upsert(existing: DataFrame, new: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """Newest row per key wins; columns are the union of both sides. A max over (version, row) combines map-side."""
    keys = list(keys)
    both = existing.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "__v"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__v").alias("__r")).select(*keys, "__r.*")


def validate_predictions(pred: DataFrame, prices: DataFrame) -> DataFrame:
    """Predictions joined to the price at timestamp + horizon; unmatched rows stay pending."""
    d = pred.withColumn("__due", F.date_add("date", F.col("horizon")))
    p = prices.select("symbol", F.col("date").alias("__due"), F.col("close").alias("actual_price"))
    d = d.join(p, ["symbol", "__due"], "left")
    return d.withColumns(
        {
            "status": F.when(F.col("actual_price").isNull(), "pending").otherwise("validated"),
            "actual_return": F.try_divide(F.col("actual_price"), F.col("close")) - 1,
        }
    ).withColumn("hit", F.when(F.col("actual_return").isNotNull(), (F.signum("actual_return") == F.signum("score")).cast("int"))).drop("__due")


def first_by(df: DataFrame, keys, order: Column) -> DataFrame:
    """First row per key by a total order, combined map-side (no window, no sort)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
