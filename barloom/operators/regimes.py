"""Regime labels, smoothing and statistics."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import clip, flag, ratio
from barloom.functions.ordered import Level, Rank
from barloom.functions.orderstats import quantiles
from barloom.functions.windows import SYM, Roll
from barloom.operators.events import capped_days_since
from barloom.operators.market import soft_z, spells

ANNUAL = math.sqrt(252)


def volatility_ratio_regimes(df: DataFrame, ret="ret", short=20, long=60, high=0.3, low=0.2, r: Roll = SYM) -> DataFrame:
    """0 bull, 1 bear, 2 high volatility, 3 low volatility from volatility ratio and mean return; gaps carry forward."""
    vr = ratio(r.std(ret, short), r.std(ret, long))
    df = df.withColumns({"__vr": vr, "__m": r.mean(ret, short) * 252})
    hi, lo = F.coalesce(F.col("__vr") > 1 + high, F.lit(False)), F.coalesce(F.col("__vr") < 1 - low, F.lit(False))
    bull = F.coalesce(F.col("__m") > 0.05, F.lit(False)) & ~hi
    bear = F.coalesce(F.col("__m") < -0.05, F.lit(False)) | hi
    # later rules win
    label = F.when(lo & ~bull, 3).when(hi & ~bear, 2).when(bear, 1).when(bull, 0)
    df = df.withColumn("__lab", label)
    return df.withColumn("regime", F.coalesce(r.ffill("__lab"), F.lit(0))).drop("__vr", "__m", "__lab")


def smooth_regimes(df: DataFrame, label: str, min_rows: int, keys=("symbol",)) -> DataFrame:
    """A spell shorter than `min_rows` takes the regime before it, which may itself have been replaced.

    Left-to-right replacement equals carrying forward the last spell that is long enough (the first spell always counts).
    """
    r = Roll(list(keys), "date")
    df = spells(df, label, r)
    size = F.count("*").over(Window.partitionBy(*keys, "spell"))
    df = df.withColumn("__keep", F.when((size >= min_rows) | (F.col("spell") == 1), F.col(label)))
    return df.withColumn("smoothed", r.ffill("__keep")).drop("__keep", "spell", "spell_pos")


def bull_bear_crisis(df: DataFrame, ret="ret", n=20, q=0.85, fit="full", r: Roll = SYM) -> DataFrame:
    """2 above the volatility quantile, else 1 for a negative mean, else 0. fit: full-sample or expanding quantile."""
    df = df.withColumns({"__m": r.mean(ret, n, 1), "__v": r.std(ret, n, 2)})
    if fit == "full":
        cut = quantiles(df, r.keys, "__v", {"__q": q, "__med": 0.5})
        df = df.join(cut, r.keys, "left")
    else:
        df = r.ordered(df, {"__q": Level("__v", q), "__med": Level("__v", 0.5)})
    v = F.coalesce("__v", "__med")
    return df.withColumn("regime", F.when(v > F.col("__q"), 2).when(F.coalesce(F.col("__m"), F.lit(0.0)) < 0, 1).otherwise(0)).drop("__m", "__v", "__q", "__med")


def classifier_features(df: DataFrame, r: Roll = SYM) -> DataFrame:
    df = df.withColumn("__r", r.pct("close"))
    df = df.withColumns({f"return_{k}": r.pct("close", n) for k, n in (("short_21d", 21), ("medium_63d", 63), ("long_126d", 126))})
    df = df.withColumn("volatility", r.std("__r", 21) * ANNUAL)
    top = r.max("close", 252)
    return df.withColumns(
        {
            "volatility_zscore": soft_z(r, "volatility", 252, 252, 1e-8),
            "drawdown": (F.col("close") - top) / top,
            "trend_strength": r.mean(flag(F.col("__r") > 0), 21),
        }
    ).drop("__r")


def classify(df: DataFrame, bull=0.05, bear=-0.05, vol_bull_max=1.0, vol_bear_min=0.5, drawdown_bear=-0.15) -> DataFrame:
    """bull / bear / sideways by ordered rules; unknown inputs make a row sideways."""
    med, lng, z, dd, ts = (F.col(c) for c in ("return_medium_63d", "return_long_126d", "volatility_zscore", "drawdown", "trend_strength"))
    label = (
        F.when(med.isNull() | z.isNull(), "sideways")
        .when(dd < drawdown_bear, "bear")
        .when((med < bear) & (z > vol_bear_min), "bear")
        .when(lng < bear * 2, "bear")
        .when((med > bull) & (z < vol_bull_max) & (ts > 0.55), "bull")
        .when((lng > bull * 2) & (z < vol_bull_max), "bull")
        .otherwise("sideways")
    )
    return df.withColumn("regime", label)


def router_label(df: DataFrame, r: Roll = SYM) -> DataFrame:
    """<low|high>_<bull|bear|sideways> at every row, using only rows up to it."""
    df = df.withColumns({"__r": r.pct("close"), "__n": r.row()})
    df = df.withColumn("__v", r.std("__r", 21, 10))
    for k in (63, 42, 21):
        df = df.withColumn(f"__t{k}", r.pct("close", k))
    recent, base = F.avg("__v").over(r.frame(5)), F.avg("__v").over(r.frame(None))
    vol = F.when(recent > base * 1.2, "high").otherwise("low")
    n = F.col("__n")
    tr = {k: F.avg(f"__t{k}").over(r.frame(5)) for k in (63, 42, 21)}
    # history shorter than 26 rows shrinks the trend period to n - 5; the few such rows use the 21-row trend once it exists
    trend = F.when(n >= 252, tr[63]).when(n >= 126, tr[42]).otherwise(tr[21])
    cut = F.when(n >= 252, 0.03).when(n >= 126, 0.025).otherwise(0.015)
    way = F.when(trend > cut, "bull").when(trend < -cut, "bear").otherwise("sideways")
    label = F.when(n < 20, "low_bull").otherwise(F.concat_ws("_", vol, way))
    return df.withColumn("router", label).drop("__r", "__n", "__v", "__t63", "__t42", "__t21")


def hysteresis(df: DataFrame, label: str, confirmations: int = 3, keys=("symbol",)) -> DataFrame:
    """The active regime under a counter: a row of the active label resets it, any other raises it, and at `confirmations` the
    row's label becomes active. Labels that differ among themselves count alike, so this is a true recurrence: a fold over
    each key's rows, which the calendar bounds."""
    schema = T.StructType([*df.schema.fields, T.StructField("active", df.schema[label].dataType)])

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        state, count, out = None, 0, []
        for new in rows[label].to_pylist():
            count = 0 if state is None or state == new else count + 1
            if count == 0 or count >= confirmations:
                state, count = new, 0
            out.append(state)
        return rows.append_column("active", pa.array(out, rows.schema.field(label).type))

    return df.groupBy(*keys).applyInArrow(fold, schema)


def vix_percentile_regime(df: DataFrame, vix="vix", n=252, mp=63, r: Roll = SYM) -> DataFrame:
    df = df.withColumn("__f", r.ffill(vix))
    df = r.ordered(df, {"vix_percentile": Rank("__f", n, mp)})
    df = df.withColumn("vix_percentile", F.col("vix_percentile") * 100)
    p = F.col("vix_percentile")
    df = df.withColumn("vix_regime", F.when(p <= 25, "low_vol").when(p <= 50, "normal").when(p <= 75, "elevated").when(p.isNotNull(), "crisis"))
    change = F.col("vix_regime").isNull() | r.lag("vix_regime").isNull() | (F.col("vix_regime") != r.lag("vix_regime"))
    out = {f"vix_{k}": flag(F.col("vix_regime") == k) for k in ("low_vol", "normal", "elevated", "crisis")}
    return df.withColumns({**out, "vix_regime_change": flag(change)}).drop("__f")


def moving_average_regime(df: DataFrame, n=126, r: Roll = SYM) -> DataFrame:
    df = df.withColumn("__ma", r.mean("close", n))
    df = df.withColumn("__sl", r.diff("__ma", 20) / F.col("__ma"))
    above = F.coalesce(F.col("close") > F.col("__ma"), F.lit(False))
    label = F.when(above & (F.col("__sl") > 0.001), "bull").when(~above & (F.col("__sl") < -0.001), "bear").otherwise("sideways")
    return df.withColumns({"market_regime": label, "regime_strength": clip(F.abs("__sl"), 0, 0.05) / 0.05}).drop("__ma", "__sl")


def economic_cycle(df: DataFrame, r: Roll = SYM) -> DataFrame:
    df = df.withColumn("__r", r.pct("close"))
    momentum = F.coalesce(r.mean("__r", 20) > 0, F.lit(False))
    trend = F.coalesce(F.col("close") > r.mean("close", 200), F.lit(False))
    label = F.when(trend & momentum, "expansion").when(trend, "slowdown").when(~momentum, "recession").otherwise("recovery")
    return df.withColumn("econ_cycle", label).drop("__r")


def cyclical_time(df: DataFrame, date="date") -> DataFrame:
    m, q = F.month(date) * (2 * math.pi / 12), F.quarter(date) * (2 * math.pi / 4)
    return df.withColumns(
        {
            "month_sin": F.sin(m), "month_cos": F.cos(m), "quarter_sin": F.sin(q), "quarter_cos": F.cos(q),
            "day_of_week": F.weekday(date), "days_since_year_start": F.dayofyear(date) / 365.25,
        }
    )


def event_distance(df: DataFrame, vix="vix", r: Roll = SYM) -> DataFrame:
    df = df.withColumns({"__r": r.pct("close"), "__f": r.ffill(vix)})
    df = r.ordered(df, {"__q": Level("__f", 0.9, 252)})
    df = capped_days_since(df, F.col("__r") < -0.05, "days_since_drawdown", r=r)
    df = capped_days_since(df, F.col("__f") > F.col("__q"), "days_since_vol_spike", r=r)
    return df.withColumn("recent_volatility_flag", flag(F.col("days_since_drawdown") <= 30)).drop("__r", "__f", "__q")


def regime_inputs(df: DataFrame, macro: DataFrame, r: Roll = SYM) -> DataFrame:
    """Return and volatility inputs joined with forward-filled macro levels; rows with gaps are dropped."""
    df = df.withColumn("__l", r.logret("close")).join(macro, "date", "left")
    df = df.withColumns({c: r.ffill(c) for c in ("vix", "dgs10", "dgs2")})
    df = df.withColumns(
        {
            **{f"ret_{k}": r.pct("close", k) for k in (5, 21, 63)},
            "vol_20": r.std("__l", 20) * ANNUAL,
            "vol_63": r.std("__l", 63) * ANNUAL,
            "vix_slope": r.diff("vix", 5),
            "yield_curve": F.col("dgs10") - F.col("dgs2"),
        }
    )
    return df.dropna(subset=["ret_5", "ret_21", "ret_63", "vol_20", "vol_63", "vix", "vix_slope", "yield_curve"]).drop("__l")


def kmeans_regimes(df: DataFrame, columns: list[str], k: int = 4, seed: int = 42, iterations: int = 20, tol: float = 1e-4) -> DataFrame:
    """Standardised k-means labels."""
    vec = VectorAssembler(inputCols=columns, outputCol="__v").transform(df)
    vec = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True).fit(vec).transform(vec)
    model = KMeans(featuresCol="__z", predictionCol="cluster", k=k, seed=seed, maxIter=iterations, tol=tol).fit(vec)
    return model.transform(vec).drop("__v", "__z")


def normalise_by_role(df: DataFrame, roles: dict[str, str], fit: str = "expanding", n=252, mp=20, r: Roll = SYM) -> DataFrame:
    """Predictive -> rolling z (±8); risk -> rolling 5-95% scale or (x+1)/2 for correlations; regime -> min-max."""
    out, pre, levels = {}, {}, {}
    nz = lambda x: F.coalesce(x, F.lit(0.0))
    for c, role in roles.items():
        if role == "predictive":
            out[c] = clip(nz((F.col(c) - r.mean(c, n, mp)) / (r.std0(c, n, mp) + 1e-6)), -8, 8)
        elif role == "risk" and any(tok in c.lower() for tok in ("corr", "beta")):
            out[c] = nz((clip(c, -1, 1) + 1) / 2)
        elif role == "risk":
            pre[f"__t_{c}"] = F.when(F.col(c) >= 0, F.log1p(c)).otherwise(F.abs(c))
            levels |= {f"__lo_{c}": Level(f"__t_{c}", 0.05, n, mp), f"__hi_{c}": Level(f"__t_{c}", 0.95, n, mp)}
            lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
            out[c] = clip(nz((F.col(f"__t_{c}") - lo) / (F.abs(hi - lo) + 1e-6)), 0, 1)
        elif role == "regime":
            w = Window.partitionBy(*r.keys) if fit == "full" else r.frame(None)
            mn, mx = F.min(c).over(w), F.max(c).over(w)
            out[c] = clip(nz(F.when(mx - mn >= 1e-6, (F.col(c) - mn) / (mx - mn))), 0, 1)
    return r.ordered(df.withColumns(pre), levels).withColumns(out).drop(*pre, *levels) if pre else df.withColumns(out)


# fixed values: half-lives in days of the decay profiles
HALF_LIFE = {"fast": 3.0, "medium": 10.0, "slow": 30.0, "two_phase": 6.0}
SPARSE = {"weekly", "monthly", "quarterly", "irregular", "event", "snapshot"}


def timing_rules(df: DataFrame, meta: dict[str, dict], shift_days: int = 1, r: Roll = SYM) -> DataFrame:
    """Forward fill, publication shift and half-life decay per column from its metadata.

    meta[column] = {role, cadence, decay, latency, point_in_time}.
    """
    alpha = lambda h: 1 - 0.5 ** (1 / h)
    for c, m in meta.items():
        role, cadence = m.get("role", "predictive"), m.get("cadence", "unknown")
        gate = any(t in c for t in ("has_data", "days_since_update")) or c.endswith(("_conf", "_confidence", "_conf_raw", "_confidence_raw"))
        if role in ("hygiene", "regime") or cadence in SPARSE:
            df = df.withColumn(c, r.ffill(c))
        late = cadence in SPARSE or m.get("point_in_time") or m.get("latency") in ("t_plus_1", "t_plus_2_plus", "delayed")
        if role != "hygiene" and late and not gate and shift_days > 0:
            df = df.withColumn(c, r.lag(c, shift_days))
        half = m.get("half_life") or HALF_LIFE.get(m.get("decay"), 0.0)
        if half and (cadence in SPARSE):
            impulse = cadence in ("event", "irregular") and not gate
            df = df.withColumn("__x", F.coalesce(r.diff(c), F.lit(0.0)) if impulse else F.col(c))
            if m.get("decay") == "two_phase":
                df = r.ewm(df, {"__fast": ("__x", alpha(3.0)), "__slow": ("__x", alpha(20.0))})
                df = df.withColumn(c, 0.7 * F.col("__fast") + 0.3 * F.col("__slow")).drop("__fast", "__slow", "__x")
            else:
                df = r.ewm(df, {"__e": ("__x", alpha(half))}).withColumn(c, F.col("__e")).drop("__e", "__x")
        df = df.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return df


def regime_statistics(df: DataFrame, ret="ret", regime="regime", keys=("symbol",)) -> DataFrame:
    """Per regime: annualised mean, volatility, Sharpe, shape, worst drawdown of its compounded returns, frequency."""
    r = Roll([*keys, regime], "date")
    df = df.where(F.col(ret).isNotNull() & F.col(regime).isNotNull())
    df = df.withColumn("__eq", r.prod(1 + F.col(ret)))
    df = df.withColumn("__dd", F.col("__eq") / r.max("__eq") - 1)
    g = df.groupBy(*keys, regime).agg(
        F.count("*").alias("n"), (F.avg(ret) * 252).alias("mean_return"), (F.stddev_samp(ret) * ANNUAL).alias("volatility"),
        F.skewness(ret).alias("__g1"), F.kurtosis(ret).alias("__g2"), F.min("__dd").alias("max_drawdown"),
    )
    n = F.col("n").cast("double")
    total = F.sum("n").over(Window.partitionBy(*keys))
    return g.withColumns(
        {
            "sharpe": F.when(F.col("volatility") > 1e-12, F.col("mean_return") / F.col("volatility")),
            "skew": F.when(n > 2, F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__g2") + 6)),
            "frequency": n / total,
        }
    ).drop("__g1", "__g2")


def average_spell(df: DataFrame, regime="regime", r: Roll = SYM) -> DataFrame:
    s = spells(df, regime, r).groupBy(*r.keys, "spell", regime).agg(F.count("*").alias("__len"))
    return s.groupBy(*r.keys, regime).agg(F.avg("__len").alias("avg_duration"), F.count("*").alias("n_spells"))


def transition_matrix(df: DataFrame, regime="regime", r: Roll = SYM) -> DataFrame:
    """Row-normalised transition shares in long form (from, to, n, share)."""
    t = df.withColumn("to_regime", r.lead(regime)).where(F.col("to_regime").isNotNull())
    g = t.groupBy(F.col(regime).alias("from_regime"), "to_regime").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_regime")))


def regime_weights(df: DataFrame, regime="regime") -> DataFrame:
    """Inverse-frequency sample weights: total / (classes * class count)."""
    c = df.groupBy(regime).agg(F.count("*").alias("__c"))
    one = c.agg(F.sum("__c").alias("__t"), F.count("*").alias("__k"))
    w = c.join(F.broadcast(one)).select(regime, (F.col("__t") / (F.col("__k") * F.col("__c"))).alias("sample_weight"))
    return df.join(w, regime)


def dominant_regime(df: DataFrame, period, regime="regime", keys=("symbol",)) -> DataFrame:
    """Most frequent regime per key and period (smallest label on ties) with its share."""
    c = df.groupBy(*keys, period.alias("period"), regime).agg(F.count("*").alias("__c"))
    g = c.groupBy(*keys, "period").agg(F.max_by(regime, F.struct(F.col("__c"), -F.col(regime))).alias("dominant"), F.max("__c").alias("__m"), F.sum("__c").alias("n"))
    return g.withColumn("share", F.col("__m") / F.col("n")).drop("__m")


def nearest_by_date(left: DataFrame, right: DataFrame, value: str, keys=("symbol",)) -> DataFrame:
    """Value of the right row with the closest date (earlier one on ties), for every left row."""
    keys = list(keys)
    axis = Roll(keys, ["__d", "__kind"])
    ev = right.select(*keys, F.col("date").alias("__d"), F.lit(0).alias("__kind"), F.struct(F.col("date").alias("d"), F.col(value).alias("v")).alias("__hit"))
    both = left.withColumns({"__d": F.col("date"), "__kind": F.lit(1)}).unionByName(ev, allowMissingColumns=True)
    both = both.withColumns(
        {"__b": F.last("__hit", ignorenulls=True).over(axis.frame(None)), "__a": F.first("__hit", ignorenulls=True).over(axis.ahead(None, 1))}
    )
    df = both.where(F.col("__kind") == 1)
    before, after = F.datediff("date", F.col("__b.d")), F.datediff(F.col("__a.d"), "date")
    pick = F.when(F.col("__b").isNull(), F.col("__a")).when(F.col("__a").isNull() | (before <= after), F.col("__b")).otherwise(F.col("__a"))
    return df.withColumn("__p", pick).withColumns({f"nearest_{value}": F.col("__p.v"), "gap_days": F.least(F.coalesce(before, after), F.coalesce(after, before))}).drop(
        "__d", "__kind", "__hit", "__a", "__b", "__p"
    )
