"""Data-quality gates, audits and hygiene filters. Every check is one partial aggregation over (column, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite, flag, row_mean
from barloom.functions.orderstats import quantiles
from barloom.functions.windows import SYM, Roll


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., column, value): one row per cell of the chosen numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("__x")).select(*keep, "__x.*")


def column_profile(df: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    """NaN/zero/infinite shares, std, variance, distinct values and low-variance flag per column.

    Distinct counts come from a groupBy on (column, value), so a dominating value is combined map-side.
    """
    d = long_form(df, columns, keys)
    v = finite("value")
    g = d.groupBy(*keys, "column").agg(
        F.count("*").alias("rows"), F.avg(flag(F.col("value").isNull() | F.isnan("value"))).alias("nan_fraction"),
        F.avg(flag(F.abs("value") == float("inf"))).alias("inf_fraction"), F.avg(flag(F.col("value") == 0)).alias("zero_fraction"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    u = d.where(v.isNotNull()).groupBy(*keys, "column", "value").agg(F.count("*").alias("__c"))
    u = u.groupBy(*keys, "column").agg(F.count("*").alias("n_unique"), F.max("__c").alias("top_count"), F.sum("__c").alias("__n"))
    g = g.join(u, [*keys, "column"], "left")
    return g.withColumns(
        {"n_unique": F.coalesce("n_unique", F.lit(0)), "top_share": F.col("top_count") / F.col("__n"), "low_variance": flag(F.coalesce("std", F.lit(0.0)) <= 1e-8)}
    ).drop("__n", "top_count")


def constant_columns(df: DataFrame, columns: list[str], threshold: float = 1e-8) -> DataFrame:
    p = column_profile(df, columns)
    return p.withColumn("drop", flag((F.coalesce("std", F.lit(0.0)) <= threshold) | (F.col("n_unique") <= 1)))


def feature_quality(df: DataFrame, columns: list[str], max_missing=0.5, z=5.0) -> DataFrame:
    """Missing, infinite, low-variance and outlier checks per column."""
    d = long_form(df, columns, [])
    stats = d.groupBy("column").agg(F.avg(finite("value")).alias("__m"), F.stddev_samp(finite("value")).alias("__s"))
    j = d.join(F.broadcast(stats), "column")  # one row per column
    far = F.abs(finite("value") - F.col("__m")) > z * F.col("__s")
    g = j.groupBy("column").agg(F.avg(flag(F.col("value").isNull())).alias("missing"), F.sum(flag(F.abs("value") == float("inf"))).alias("infinite"), F.sum(flag(far)).alias("outliers"), F.first("__s").alias("std"))
    return g.withColumn("ok", flag((F.col("missing") <= max_missing) & (F.col("infinite") == 0) & (F.coalesce("std", F.lit(0.0)) > 1e-8)))


def column_filter_battery(df: DataFrame, families: dict[str, list[str]], max_nan=0.5, min_var=1e-10, min_unique=3, max_top=0.995, cap=50, min_coverage=0.05, r: Roll = SYM) -> DataFrame:
    """Reject reason per column (counter name, NaN ratio, variance, distinct values, top share, monotone), family cap and coverage."""
    owner = {c: f for f, cs in families.items() for c in cs}
    cols = list(owner)
    p = column_profile(df, cols)
    steps = df.select(*[r.diff(c).alias(c) for c in cols])
    mono = long_form(steps, cols, []).groupBy("column").agg((F.max(flag(F.col("value") < 0)) == 0).alias("__up"), (F.max(flag(F.col("value") > 0)) == 0).alias("__dn"))
    p = p.join(mono, "column")
    fam = F.element_at(F.create_map(*[x for c, f in owner.items() for x in (F.lit(c), F.lit(f))]), F.col("column"))
    p = p.withColumns({"family": fam, "variance": F.col("std") * F.col("std")})
    reason = (
        F.when(F.lower("column").rlike("(^|_)(count|counter|index|row|id)(_|$)"), "counter_name")
        .when(F.col("nan_fraction") > max_nan, "nan_ratio")
        .when(F.coalesce("variance", F.lit(0.0)) <= min_var, "variance")
        .when(F.col("n_unique") < min_unique, "nunique")
        .when(F.col("top_share") >= max_top, "top_value")
        .when(F.col("__up") | F.col("__dn"), "monotone")
    )
    p = p.withColumn("reason", reason)
    w = Window.partitionBy("family", F.col("reason").isNull()).orderBy(F.desc("variance"), "column")  # one row per column
    p = p.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(w) > cap), "family_cap").otherwise(F.col("reason")))
    kept = F.sum(flag(F.col("reason").isNull())).over(Window.partitionBy("family"))
    cover = F.avg(1 - F.col("nan_fraction")).over(Window.partitionBy("family"))
    return p.withColumns({"family_coverage": cover, "kept": flag(F.col("reason").isNull() & (kept > 0) & (cover >= min_coverage))}).drop("__up", "__dn")


def leakage_nan_pattern(df: DataFrame, columns: list[str], r: Roll = SYM, tail: float = 0.1) -> DataFrame:
    """Columns with missing values of which fewer than half lie in the last 10% of rows, per key."""
    size = F.count("*").over(Window.partitionBy(*r.keys))
    d = df.withColumns({"__i": r.row(), "__n": size})
    d = d.withColumn("__tail", F.col("__i") > F.col("__n") - F.floor(F.col("__n") * tail))
    x = long_form(d, columns, [*r.keys, "__tail"])
    g = x.groupBy(*r.keys, "column").agg(F.sum(flag(F.col("value").isNull())).alias("nulls"), F.sum(flag(F.col("value").isNull() & F.col("__tail"))).alias("tail_nulls"))
    return g.withColumn("suspicious", flag((F.col("nulls") > 0) & (F.col("tail_nulls") < 0.5 * F.col("nulls"))))


def correlated_pairs(df: DataFrame, columns: list[str], threshold: float = 0.95, keys: list[str] = []) -> DataFrame:
    """Pairs of columns whose absolute correlation reaches the threshold.

    The pairs are of columns (schema-sized), each a running aggregate of one pass; rows are never paired.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        ok = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(ok, F.col(a)), F.when(ok, F.col(b))
        aggs += [F.covar_samp(x, y).alias(f"c{k}"), F.stddev_samp(x).alias(f"s{k}"), F.stddev_samp(y).alias(f"t{k}")]
    g = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when((F.col(f"s{k}") > 1e-12) & (F.col(f"t{k}") > 1e-12), F.col(f"c{k}") / (F.col(f"s{k}") * F.col(f"t{k}"))).alias("corr"))
        for k, (a, b) in enumerate(pairs)
    ])
    out = g.select(*keys, F.explode(rows).alias("p")).select(*keys, "p.*")
    return out.where(F.abs("corr") >= threshold)


def confidence_column(df: DataFrame, columns: list[str], n: int = 20, r: Roll = SYM) -> DataFrame:
    """1 / (1 + mean over columns of the rolling std)."""
    std = [r.std(c, n, 1) for c in columns]
    return df.withColumn("confidence", 1 / (1 + F.coalesce(row_mean(std), F.lit(0.0))))


def sanitise(df: DataFrame, columns: list[str], backfill: bool = False, r: Roll = SYM) -> DataFrame:
    """Infinities to NULL, forward fill, optional backward fill (look-ahead, off by default), zero."""
    df = df.withColumns({c: finite(c) for c in columns})
    fill = lambda c: F.coalesce(r.ffill(c), r.bfill(c), F.lit(0.0)) if backfill else F.coalesce(r.ffill(c), F.lit(0.0))
    return df.withColumns({c: fill(c) for c in columns})


def keyword_columns(df: DataFrame, keywords: list[str], keep=("symbol", "date")) -> DataFrame:
    return df.select(*[c for c in df.columns if c in keep or any(k.lower() in c.lower() for k in keywords)])


def namespaced(df: DataFrame, family: str, keep=("symbol", "date")) -> DataFrame:
    """Lower-case slug names, a doubled family prefix removed, `family_` added once."""
    import re

    def name(c: str) -> str:
        if c in keep:
            return c
        slug = re.sub(r"[^0-9a-z]+", "_", c.lower()).strip("_")
        while slug.startswith(f"{family}_"):
            slug = slug[len(family) + 1 :]
        return f"{family}_{slug}"

    return df.toDF(*[name(c) for c in df.columns])


def first_non_finite(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Location of the first missing or non-finite cell per column: min over (keys), no sort of the table."""
    x = long_form(df, columns, keep).where(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))
    return x.groupBy("column").agg(F.min(F.struct(*keep)).alias("__f"), F.count("*").alias("n_bad")).select("column", *[F.col(f"__f.{k}").alias(k) for k in keep], "n_bad")


def validate_rows(df: DataFrame, required: list[str], bounds: dict[str, tuple[float | None, float | None]], date_range: tuple[str, str], keys: list[str], tie: Column) -> DataFrame:
    """Reject reason per row: missing, bad date, out of range, duplicate key (the largest tie value is kept)."""
    reason = F.lit(None).cast("string")
    for c, (lo, hi) in reversed(bounds.items()):
        if hi is not None:
            reason = F.when(F.col(c) > hi, F.lit(f"max:{c}")).otherwise(reason)
        if lo is not None:
            reason = F.when(F.col(c) < lo, F.lit(f"min:{c}")).otherwise(reason)
    d = F.col("date")
    reason = F.when((d < F.lit(date_range[0]).cast("date")) | (d > F.lit(date_range[1]).cast("date")), "date_range").otherwise(reason)
    for c in reversed(required):
        reason = F.when(F.col(c).isNull(), F.lit(f"missing:{c}")).otherwise(reason)
    df = df.withColumns({"reject_reason": reason, "__tie": tie})
    best = df.where(F.col("reject_reason").isNull()).groupBy(*keys).agg(F.max("__tie").alias("__best"))
    j = df.join(best, keys, "left")
    dup = F.col("reject_reason").isNull() & (F.col("__tie") < F.col("__best"))
    return j.withColumn("reject_reason", F.when(dup, "duplicate").otherwise(F.col("reject_reason"))).drop("__tie", "__best")


def rejection_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def family_gate(df: DataFrame, families: dict[str, list[str]], has_data: dict[str, str], proxy: dict[str, str] = {}, tail_rows=20, min_mean=0.2, min_nonzero=3, max_proxy=0.5, min_variance=1e-12, max_zero=0.98, max_null=0.9, dormant: set[str] = frozenset(), r: Roll = SYM) -> DataFrame:
    """Pass/fail and the first reason per family: has_data coverage in the tail, proxy share, variance, zeros, nulls.

    One unpivot and one aggregation cover all families; `r.keys` is the panel (symbol) whose last rows form the tail.
    """
    w = Window.partitionBy(*r.keys).orderBy(F.desc(r.order[0]))
    d = df.withColumn("__back", F.row_number().over(w))
    owner = [(c, f, "real") for f, cs in families.items() for c in cs] + [(c, f, "has_data") for f, c in has_data.items()] + [(c, f, "proxy") for f, c in proxy.items()]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(f).alias("family"), F.lit(k).alias("kind"), finite(c).alias("value")) for c, f, k in owner])
    x = d.select(*r.keys, "__back", F.explode(cells).alias("x")).select(*r.keys, "__back", "x.*")
    v = F.col("value")
    g = x.groupBy(*r.keys, "family", "kind", "column").agg(
        F.var_pop(v).alias("var"), F.avg(flag(v == 0)).alias("zeros"), F.avg(flag(v.isNull())).alias("nulls"), F.avg(F.coalesce(v, F.lit(0.0))).alias("mean"),
        F.avg(F.when(F.col("__back") <= tail_rows, F.coalesce(v, F.lit(0.0)))).alias("tail_mean"), F.sum(F.when(F.col("__back") <= tail_rows, flag(v > 0))).alias("tail_nonzero"),
    )
    real, hd, px = (F.col("kind") == k for k in ("real", "has_data", "proxy"))
    f = g.groupBy(*r.keys, "family").agg(
        F.sum(flag(real)).alias("n_real"), F.sum(flag(real & (F.col("var") > min_variance))).alias("with_variance"),
        F.sum(flag(real & (F.col("zeros") > max_zero))).alias("high_zero"), F.sum(flag(real & (F.col("nulls") > max_null))).alias("high_null"),
        F.max(flag(hd & (F.col("tail_mean") < min_mean) & (F.col("tail_nonzero") < min_nonzero))).alias("stub"), F.max(flag(px & (F.col("mean") > max_proxy))).alias("proxied"),
    )
    asleep = F.col("family").isin(*dormant) if dormant else F.lit(False)
    reason = (
        F.when((F.col("n_real") == 0) & asleep, "allowed_dormant")
        .when(F.col("n_real") == 0, "only_flags")
        .when((F.col("stub") == 1) & asleep, "allowed_dormant")
        .when(F.col("stub") == 1, "stub")
        .when(F.col("proxied") == 1, "proxy")
        .when(F.col("with_variance") == 0, "zero_variance")
        .when(F.col("high_zero") == F.col("n_real"), "all_zero")
        .when(F.col("high_null") == F.col("n_real"), "all_null")
        .otherwise("ok")
    )
    f = f.withColumn("reason", reason)
    return f.withColumn("passed", flag(F.col("reason").isin("ok", "allowed_dormant")))


def panel_gate(families: DataFrame, keys: list[str]) -> DataFrame:
    """A panel passes when all its families do; failing families are listed in name order."""
    bad = F.array_join(F.sort_array(F.collect_set(F.when(F.col("passed") == 0, F.col("family")))), ",")  # family names: schema-sized
    return families.groupBy(*keys).agg(F.min("passed").alias("passed"), F.count("*").alias("n_families"), bad.alias("failed"))


def family_statistics(profile: DataFrame, owner: dict[str, str], keys: list[str] = []) -> DataFrame:
    fam = F.element_at(F.create_map(*[x for c, f in owner.items() for x in (F.lit(c), F.lit(f))]), F.col("column"))
    return profile.withColumn("family", fam).groupBy(*keys, "family").agg(
        F.count("*").alias("n_columns"), F.avg("nan_fraction").alias("mean_nan"), F.avg("zero_fraction").alias("mean_zero"), F.sum("low_variance").alias("n_low_variance"), F.max("nan_fraction").alias("worst_nan")
    )


def worst_nan_columns(df: DataFrame, columns: list[str], k: int = 10, keys: list[str] = []) -> DataFrame:
    p = long_form(df, columns, keys).groupBy(*keys, "column").agg(F.avg(flag(F.col("value").isNull())).alias("nan_fraction"), F.count("*").alias("rows"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("nan_fraction"), "column")  # one row per column
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def schema_differences(columns: DataFrame) -> DataFrame:
    """(symbol, column) pairs missing relative to the union of columns of all symbols.

    Presence is counted per column; symbols below full presence are found by subtracting arrays per symbol, whose size is
    the schema's.
    """
    total = columns.select("column").distinct().agg(F.collect_set("column").alias("__all"))  # schema-sized
    mine = columns.groupBy("symbol").agg(F.collect_set("column").alias("__have"))
    d = mine.join(F.broadcast(total)).select("symbol", F.explode(F.array_except("__all", "__have")).alias("column"))
    share = columns.groupBy("column").agg(F.countDistinct("symbol").alias("n_symbols"))
    return d.join(F.broadcast(share), "column").withColumn("status", F.lit("missing"))


def completeness(expected_families: list[str], windows: DataFrame, present: DataFrame) -> DataFrame:
    """Expected (window, family) pairs minus present ones, with a checksum of what is missing per window."""
    want = windows.select("window_id", F.explode(F.array(*[F.lit(f) for f in expected_families])).alias("family"))
    miss = want.join(present.select("window_id", "family").distinct(), ["window_id", "family"], "left_anti").withColumn("__m", F.lit(1))
    g = want.join(miss, ["window_id", "family"], "left").groupBy("window_id").agg(
        F.count("*").alias("expected"), F.count("__m").alias("missing"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("__m") == 1, F.col("family")))), ",").alias("missing_families")
    )
    return g.withColumn("checksum", F.sha2("missing_families", 256))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Hash of a table as a multiset of rows, the same in any engine: the number of rows, and the sum of 60-bit parts of the md5 of
    each row, modulo 2 ** 61 - 1. Partial sums merge in any order; repeated rows count.

    A row is the text of its columns, in the order given, each as its length, a colon and the value, a null as a dash; numbers with
    a fraction count as the sixteen hex digits of the nearest multiple of 2 ** -20, dates and times as their ISO text.
    """
    parts = []
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        x = F.col(c)
        if kind in ("double", "float"):
            x = F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > 2.0**42), x.cast("string")).otherwise(F.lower(F.lpad(F.hex(F.floor(x.cast("double") * 1048576 + 0.5)), 16, "0")))
        parts.append(F.coalesce(F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")))
    part = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("decimal(38,0)")
    summed = F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")) % F.lit(2**61 - 1).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), summed.cast("long").cast("string").alias("content_hash"))


def fold_boundaries_ok(folds: DataFrame, embargo_days: int, keys: list[str]) -> DataFrame:
    """Each fold must train before it validates, by at least the embargo, and not overlap the previous validation."""
    r = Roll(keys, "val_first")
    d = folds.withColumns({"gap_days": F.datediff("val_first", "train_last"), "overlap": flag(r.lag("val_last") >= F.col("val_first"))})
    return d.withColumn("ok", flag((F.col("gap_days") > embargo_days) & (F.col("overlap") == 0)))


def tape_validation(tape: DataFrame) -> DataFrame:
    """Row, fold, NULL and duplicate counts of a prediction tape and the verdict."""
    dup = tape.groupBy("symbol", "fold_id", "date").agg(F.count("*").alias("__c")).groupBy("symbol", "fold_id").agg(F.sum(F.col("__c") - 1).alias("__d"))
    dup = dup.groupBy("symbol").agg(F.sum("__d").alias("duplicates"), F.count("*").alias("n_folds"))
    g = tape.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.sum(flag(F.col("y_true").isNull())).alias("null_y"), F.sum(flag(F.col("score").isNull())).alias("null_score"))
    return g.join(dup, "symbol").withColumn("valid", flag((F.col("null_y") == 0) & (F.col("null_score") == 0)))


def tape_summary(tape: DataFrame) -> DataFrame:
    g = tape.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("date_start"), F.max("date").alias("date_end"),
        F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.avg("y_true").alias("y_mean"), F.stddev_samp("y_true").alias("y_std"),
        F.sum(flag(F.col("score") > 0)).alias("n_long"), F.sum(flag(F.col("score") < 0)).alias("n_short"),
    )
    return g


def drop_low_information(df: DataFrame, columns: list[str], top_k: int, r: Roll = SYM) -> DataFrame:
    """Variance ranking of the cleaned columns (the k kept ones): a schema-sized table the caller selects by."""
    p = long_form(sanitise(df, columns, r=r), columns, []).groupBy("column").agg(F.var_samp("value").alias("variance"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("variance"), "column")
    return p.where(F.col("variance") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def spread_quantiles(df: DataFrame, x: str, keys) -> DataFrame:
    return quantiles(df, keys, x, {"q05": 0.05, "q50": 0.5, "q95": 0.95})


def implied_move_check(pred: DataFrame, implied: DataFrame, warn=1.5, fail=2.5) -> DataFrame:
    """Predicted absolute move against the option-implied move: ratio and severity."""
    d = pred.join(implied, ["symbol", "date"])
    x = F.when(F.col("implied_move") > 1e-12, F.abs("predicted_move") / F.col("implied_move"))
    sev = F.when(F.col("move_ratio").isNull(), "unknown").when(F.col("move_ratio") > fail, "critical").when(F.col("move_ratio") > warn, "warning").otherwise("ok")
    return d.withColumn("move_ratio", x).withColumn("severity", sev)


def violation_summary(violations: DataFrame, now, hours: int) -> DataFrame:
    """Counts by type and severity in the last n hours."""
    ts = F.col("ts")
    d = violations.where((ts > now - F.make_interval(hours=F.lit(hours))) & (ts <= now))
    return d.groupBy("type", "severity").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
