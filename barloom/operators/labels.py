"""Labels, walk-forward and purged splits, supervised data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip, finite, ratio
from barloom.functions.orderstats import quantiles
from barloom.functions.windows import SYM, Roll
from barloom.operators.moments import fold_ridge, principal_components


def forward_return(df: DataFrame, h: int, price="close", out="forward_return", r: Roll = SYM) -> DataFrame:
    """Simple return h rows ahead; NULL where the horizon runs past the history."""
    return df.withColumn(out, ratio(r.lead(price, h), price) - 1)


def vol_adjusted_labels(df: DataFrame, h: int, n: int = 21, floor: float = 1e-4, r: Roll = SYM) -> DataFrame:
    """Forward log return, the same over yesterday's realised volatility, and its sign."""
    df = df.withColumns({"__l": r.logret("close"), "forward_return": F.ln(ratio(r.lead("close", h), "close"))})
    sigma = F.greatest(r.std("__l", n, shift=1), F.lit(floor))
    sigma = F.when(r.std("__l", n, shift=1).isNotNull(), sigma)
    return df.withColumns({"forward_return_voladj": F.col("forward_return") / sigma, "forward_direction": F.signum("forward_return")}).drop("__l")


def target(df: DataFrame, h: int, kind: str, r: Roll = SYM) -> DataFrame:
    rel = ratio(r.lead("close", h), "close")
    make = {"log_returns": F.ln(rel), "abs_returns": rel - 1, "direction": F.when(rel.isNotNull(), (rel > 1).cast("double"))}
    return df.withColumn("target", make[kind])


def multi_horizon_targets(df: DataFrame, columns: list[str], horizons: list[int], method="returns", r: Roll = SYM) -> DataFrame:
    out = {}
    for c in columns:
        for h in horizons:
            ahead = r.lead(c, h)
            out[f"{c}_h{h}"] = ratio(ahead, c) - 1 if method == "returns" else ahead if method == "levels" else ahead - F.col(c)
    return df.withColumns(out).dropna(subset=list(out))


def label_thresholds(df: DataFrame, x: str, mode: str, keys=("symbol",), lower=-0.02, upper=0.02, pct=60.0, fallback=0.02, long_q=0.6, short_q=0.4) -> DataFrame:
    """(lower, upper) per key: fixed; percentile of |x|; long/short quantiles; or max(fallback, 0.8 std)."""
    keys = list(keys)
    if mode == "fixed":
        return df.select(*keys).distinct().withColumns({"lower": F.lit(float(lower)), "upper": F.lit(float(upper))})
    if mode == "percentile":
        q = quantiles(df.withColumn("__a", F.abs(x)), keys, "__a", {"upper": pct / 100})
        return q.withColumn("lower", -F.col("upper")).select(*keys, "lower", "upper")
    if mode == "two_sided":
        q = quantiles(df, keys, x, {"__lo": short_q, "__hi": long_q})
        lo = F.when(F.col("__lo") >= 0, -F.abs("__hi")).otherwise(F.col("__lo"))
        return q.select(*keys, lo.alias("lower"), F.when(F.col("__hi") <= 0, F.abs(lo)).otherwise(F.col("__hi")).alias("upper"))
    if mode == "adaptive":
        g = df.groupBy(*keys).agg(F.stddev_pop(x).alias("__s"))
        up = F.greatest(F.lit(float(fallback)), F.coalesce(0.8 * F.col("__s"), F.lit(float(fallback))))
        return g.select(*keys, (-up).alias("lower"), up.alias("upper"))
    raise ValueError(mode)


def ternary_labels(df: DataFrame, x: str, cuts: DataFrame, keys=("symbol",)) -> DataFrame:
    """1 at or above the upper cut, 0 between, -1 below the lower cut (the lower cut itself is 0)."""
    df = df.join(cuts, list(keys))
    v = F.col(x)
    return df.withColumn("label", F.when(v >= F.col("upper"), 1).when(v >= F.col("lower"), 0).when(v.isNotNull(), -1))


def trim_dataset(features: DataFrame, returns: DataFrame, labels: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """Inner join on the key, rows with any missing feature or non-finite return dropped."""
    keys = list(keys)
    feats = [c for c in features.columns if c not in keys]
    d = features.join(returns, keys).join(labels, keys)
    ret = [c for c in returns.columns if c not in keys][0]
    return d.withColumns({c: finite(c) for c in [*feats, ret]}).dropna(subset=[*feats, ret])


def next_period_matrix(df: DataFrame, features: list[str], y: str, h: int, r: Roll) -> DataFrame:
    return df.withColumn("y", r.lead(y, h)).dropna(subset=[*features, "y"]).select(*r.keys, *r.order, *features, "y")


def lookback_windows(df: DataFrame, features: list[str], y: str, n: int, h: int, r: Roll = SYM) -> DataFrame:
    """x = the n rows before the row as an array of feature arrays; y = the next h targets starting at the row."""
    row = F.array(*[F.col(c).cast("double") for c in features])
    d = df.withColumns({"x": F.collect_list(row).over(r.frame(n, 1)), "y": F.collect_list(F.col(y).cast("double")).over(r.ahead(h))})
    return d.where((F.size("x") == n) & (F.size("y") == h)).select(*r.keys, *r.order, "x", "y")


def split_windows(df: DataFrame, observed: list[str], known: list[str], static: list[str], y: str, n: int, horizons: list[int], gap: int = 0, step: int = 1, r: Roll = SYM) -> DataFrame:
    """Windows ending at the row: observed past, known past and future, static values, targets per horizon."""
    top = max(horizons)
    arr = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    size = F.count("*").over(Window.partitionBy(*r.keys))
    d = df.withColumns(
        {
            "__i": r.row(), "__n": size,
            "observed": F.collect_list(arr(observed)).over(r.frame(n)),
            "known_future": F.collect_list(arr(known)).over(r.base.rowsBetween(-(n - 1), top)),
            "targets": F.array(*[F.coalesce(r.lead(y, gap + h), F.lit(None).cast("double")) for h in horizons]),
        }
    )
    ok = (F.col("__i") >= n) & (F.col("__i") <= F.col("__n") - top - gap) & (F.pmod(F.col("__i") - n, F.lit(step)) == 0)
    return d.where(ok).select(*r.keys, *r.order, "observed", "known_future", *static, "targets")


def standardised_sequences(df: DataFrame, features: dict[str, float], y: str, n: int, train_until: str, r: Roll = SYM) -> DataFrame:
    """Feature rows standardised with training statistics (one tiny row per key), weighted, clipped ±5, in n-row windows."""
    d = df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in features}).where(F.col(y).isNotNull())
    train = d.where(F.col("date") <= F.lit(train_until).cast("date"))
    stats = train.groupBy(*r.keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in features], *[F.stddev_pop(c).alias(f"__s_{c}") for c in features])
    d = d.join(stats, r.keys)
    out = []
    for c, w in features.items():
        s = F.when(F.col(f"__s_{c}") < 1e-8, 1.0).otherwise(F.col(f"__s_{c}"))
        out.append(F.coalesce(clip((F.col(c) - F.col(f"__m_{c}")) / s * float(w), -5, 5), F.lit(0.0)))
    d = d.withColumn("sequence", F.collect_list(F.array(*out)).over(r.frame(n, 1)))
    return d.where(F.size("sequence") == n).select(*r.keys, "date", "sequence", F.col(y).alias("target"))


# ---- folds ----------------------------------------------------------------------------------------------------------
def sessions_table(df: DataFrame) -> DataFrame:
    """Distinct session dates with their zero-based position: bounded by the calendar."""
    return df.select("date").distinct().withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)


def walk_forward_windows(sessions: DataFrame, train_years: int, step: int, h: int) -> DataFrame:
    """Rolling train / valid / test windows on the session calendar, stepping `step` sessions.

    Sessions are turned into boundaries by equi-joins on the session position; the calendar is one row per day.
    """
    n = sessions.agg((F.max("idx") + 1).alias("__n"))
    starts = sessions.join(F.broadcast(n)).where((F.col("idx") % step == 0) & (F.col("idx") + 2 * h <= F.col("__n")))
    at = lambda name, off: sessions.select((F.col("idx") - off).alias("idx"), F.col("date").alias(name))
    w = starts.select("idx", F.col("date").alias("valid_start"))
    w = w.join(at("train_end", -1), "idx", "left").join(at("valid_end", h - 1), "idx").join(at("test_start", h), "idx").join(at("test_end", 2 * h - 1), "idx")
    w = w.withColumn("__want", F.add_months("valid_start", -12 * train_years))
    # first session on or after the wanted start: the calendar joined by its own as-of order
    axis = Window.partitionBy(F.lit(0)).orderBy("__d", F.desc("__k"))
    u = w.select(F.col("__want").alias("__d"), F.lit(1).alias("__k"), F.lit(None).cast("date").alias("__s")).distinct().unionByName(sessions.select(F.col("date").alias("__d"), F.lit(0).alias("__k"), F.col("date").alias("__s")))
    u = u.withColumn("train_start", F.first("__s", ignorenulls=True).over(axis.rowsBetween(0, Window.unboundedFollowing))).where(F.col("__k") == 1).select(F.col("__d").alias("__want"), "train_start")
    w = w.join(u, "__want")
    wid = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("valid_start"))
    return w.select(wid.alias("window_id"), "train_start", "train_end", "valid_start", "valid_end", "test_start", "test_end")


def purged_splits(sizes: DataFrame, n_splits: int, val_size: int, gap: int, min_train: int, keys=("symbol",)) -> DataFrame:
    """Expanding splits by position per key: train [0, train_end), gap, validation [val_start, val_end). `sizes` has n."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    f = sizes.select(*keys, "n", k).withColumn("val_start", F.lit(min_train + gap) + F.col("fold") * val_size)
    f = f.withColumns({"val_end": F.col("val_start") + val_size, "train_end": F.col("val_start") - gap})
    return f.where(F.col("val_end") <= F.col("n")).select(*keys, "fold", "train_end", "val_start", "val_end")


def embargo_splits(sizes: DataFrame, n_splits: int, test_size: int, gap: int, purge: int, embargo: int, min_train: int, max_train: int | None = None, keys=("symbol",)) -> DataFrame:
    """Fixed test blocks separated by an embargo; training ends gap + purge rows before each block."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    f = sizes.select(*keys, "n", k).withColumn("test_start", F.lit(min_train + gap + purge) + F.col("fold") * (test_size + embargo))
    f = f.withColumns({"test_end": F.col("test_start") + test_size, "train_end": F.col("test_start") - gap - purge})
    f = f.withColumn("train_start", F.greatest(F.lit(0), F.col("train_end") - max_train) if max_train else F.lit(0))
    return f.where((F.col("test_end") + embargo <= F.col("n")) & (F.col("train_end") - F.col("train_start") >= min_train)).drop("n")


def date_folds(df: DataFrame, n_splits: int, val_dates: int, gap: int, min_train: int, max_splits: int) -> DataFrame:
    """Folds over distinct dates (not rows): expanding train, the last `max_splits` kept, as date boundaries."""
    s = sessions_table(df)
    n = s.agg((F.max("idx") + 1).alias("n"))
    f = purged_splits(n.withColumn("__k", F.lit(0)), n_splits, val_dates, gap, min_train, keys=("__k",)).drop("__k")
    last = f.agg(F.max("fold").alias("__mx"))
    f = f.join(F.broadcast(last)).where(F.col("fold") > F.col("__mx") - max_splits).drop("__mx")
    at = lambda c, name, off: s.select((F.col("idx") + off).alias(c), F.col("date").alias(name))
    f = f.join(at("train_end", "train_last", 1), "train_end").join(at("val_start", "val_first", 0), "val_start").join(at("val_end", "val_last", 1), "val_end")
    return f.select("fold", "train_last", "val_first", "val_last")


def assign_folds(df: DataFrame, folds: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of every fold whose [start, end] holds their date. Folds are few rows; AQE broadcasts them by size."""
    return df.join(folds, F.col("date").between(F.col(start), F.col(end)))


def purge_overlaps(train: DataFrame, folds: DataFrame, h: int) -> DataFrame:
    """Training rows of a fold whose label window ends before its test start: date <= test_start - (h+1) days."""
    t = train.join(folds.select("fold", F.col("test_start").alias("__ts")), "fold")
    return t.where(F.col("date") <= F.date_sub("__ts", h + 1) if h > 1 else F.lit(True)).drop("__ts")


def mature_rows(df: DataFrame, sessions: DataFrame, h: int, now: str) -> DataFrame:
    """Rows whose label is known at `now`: sample session + h <= last session on or before now."""
    cut = sessions.where(F.col("date") <= F.lit(now).cast("date")).agg(F.max("idx").alias("__now"))
    d = df.join(sessions, "date").join(F.broadcast(cut))
    return d.where(F.col("idx") + h <= F.col("__now")).drop("idx", "__now")


def fold_standardise(df: DataFrame, columns: list[str], is_train: str = "is_train", fold="fold") -> DataFrame:
    """z-scores per fold with statistics of its training rows only."""
    stats = df.where(F.col(is_train)).groupBy(fold).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    d = df.join(stats, fold)
    out = {c: F.when(F.col(f"__s_{c}") > 1e-12, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.col(c) - F.col(f"__m_{c}")) for c in columns}
    return d.withColumns(out).drop(*[f"__m_{c}" for c in columns], *[f"__s_{c}" for c in columns])


def fold_missing(df: DataFrame, columns: list[str], how: str, is_train="is_train", fold="fold", r: Roll = SYM) -> DataFrame:
    """drop rows, fill with the fold's training median, or carry forward inside each side of the split."""
    if how == "drop":
        return df.dropna(subset=columns)
    if how == "median":
        train = df.where(F.col(is_train))
        for c in columns:
            df = df.join(quantiles(train, [fold], c, {f"__md_{c}": 0.5}), fold, "left").withColumn(c, F.coalesce(c, f"__md_{c}")).drop(f"__md_{c}")
        return df
    side = Roll([*r.keys, fold, is_train], r.order)
    return df.withColumns({c: side.ffill(c) for c in columns})


def family_pca(df: DataFrame, columns: list[str], k: int, out="pc") -> tuple[DataFrame, list[float]]:
    """Standardise and project a wide family; also returns the explained variance shares (k numbers)."""
    projected, shares, _ = principal_components(df, columns, k, out)
    return projected, shares[:k]


def intrinsic_dimension(shares: list[float], level: float = 0.9) -> tuple[int, float]:
    """Number of components that reach `level` of variance, and the share left over."""
    total, run = sum(shares), 0.0
    for i, s in enumerate(shares):
        run += s
        if run >= level - 1e-12:
            return i + 1, max(0.0, total - run)
    return len(shares), max(0.0, 1 - run)


def linear_family_weights(df: DataFrame, families: dict[str, list[str]], y: str, folds: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """Ridge regression per purged fold, all from one scan; a family's weight is the norm of its coefficients, averaged over folds."""
    cols = [c for cs in families.values() for c in cs]
    coef = fold_ridge(df, cols, y, folds, ridge)
    owner = F.create_map(*[F.lit(x) for fam, cs in families.items() for c in cs for x in (c, fam)])
    return family_norms(coef.withColumn("family", owner[F.col("column")]), ["fold"]).groupBy("family").agg(F.avg("norm").alias("weight"))


def linear_normal_equations(df: DataFrame, columns: list[str], y: str, folds: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """Per fold and column the correlation with the target that the fitted coefficients imply, and whether it holds to 1e-9."""
    found = fold_ridge(df, columns, y, folds, ridge)
    return found.select("fold", "n", "column", "correlation", (F.col("residual") < 1e-9).cast("int").alias("solved"))


def family_norms(coef: DataFrame, keys=()) -> DataFrame:
    return coef.groupBy(*keys, "family").agg(F.sqrt(F.sum(F.col("beta") * F.col("beta"))).alias("norm"))


def meta_learner_rows(tape: DataFrame, keys=("symbol",), n: int = 10) -> DataFrame:
    """Tape rows with the previous folds' hit rate, P&L, volatility and drawdown and the percentile of |score|.

    A fold's outcome is its last row; statistics use earlier folds only.
    """
    keys = list(keys)
    r = Roll(keys, "fold_id")
    last = tape.groupBy(*keys, "fold_id").agg(F.max_by(F.struct("y_true", "score"), "date").alias("__l"))
    last = last.withColumn("__ret", F.signum(F.col("__l.score")) * F.col("__l.y_true"))
    last = last.withColumns(
        {
            "past_hit": r.mean((F.col("__ret") > 0).cast("double"), n, 1, shift=1),
            "past_pnl": r.mean("__ret", n, 1, shift=1),
            "past_vol": r.std("__ret", n, 2, shift=1),
            "past_worst": r.min("__ret", n, 1, shift=1),
        }
    ).drop("__l", "__ret")
    d = tape.join(last, [*keys, "fold_id"])
    from barloom.functions.orderstats import with_ranks

    return with_ranks(d.withColumn("abs_score", F.abs("score")), keys, "abs_score", {"abs_score_pct": "pct"})
