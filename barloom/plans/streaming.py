"""Plans: streaming operators on the event table. Batch and streaming share the same operator; tests compare the two."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import Roll
from barloom.plans import duck as q
from barloom.plans.registry import plan
from barloom.streaming import detectors as dt
from barloom.streaming import pipelines as op

H = Roll("key", "hour")
HO = dict(part="key", order="hour")


def events(t):
    return t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


def stamp(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in cols})


q.cte("diag", "SELECT event_type AS key, date_trunc('hour', ts) AS hour, avg(value) / 100 AS value, avg((value < 10)::INT) AS low_share, count(*) AS n FROM events GROUP BY 1, 2")
q.cte("diag_n", "SELECT *, row_number() OVER (PARTITION BY key ORDER BY hour) AS rn FROM diag")


def diag(t):
    return op.hourly_diagnostics(events(t))


@plan("market_hours_filter", 396, "event_type:s n:i total", "SELECT event_type, count(*) AS n, sum(value) AS total FROM (SELECT *, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS lt FROM events) WHERE isodow(lt) < 6 AND hour(lt) BETWEEN 9 AND 15 GROUP BY 1")
def _(t):
    return events(t).where(op.market_hours()).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_agg = "count(*) AS n, sum(value) AS total, avg(value) AS mean, avg((event_type = 'error')::INT) AS error_rate"


@plan("tumbling_window", 397, "start:s event_type:s n:i total mean error_rate", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, {_agg} FROM events GROUP BY 1, 2")
def _(t):
    return stamp(op.tumbling(events(t)), "start")


@plan("sliding_window", 398, "start:s event_type:s n:i total mean error_rate", f"SELECT strftime(date_trunc('hour', ts) - i * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS start, event_type, {_agg} FROM events, (SELECT unnest(range(0, 6)) AS i) GROUP BY 1, 2")
def _(t):
    return stamp(op.sliding(events(t)), "start")


q.cte("sess0", "SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS nw FROM events")
q.cte("sess1", "SELECT *, sum(nw::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM sess0")


@plan("session_window", 398, "user_id:i start:s n:i total", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, sum(value) AS total FROM sess1 GROUP BY user_id, s")
def _(t):
    return stamp(op.sessions(events(t)), "start")


@plan("late_row_routing", 397, "late:i n:i", "SELECT (ts < TIMESTAMP '2024-01-15' - INTERVAL 2 HOUR)::INT AS late, count(*) AS n FROM events GROUP BY 1")
def _(t):
    on, late = op.route_late(events(t), F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    return on.select(F.lit(0).alias("late")).unionByName(late.select(F.lit(1).alias("late"))).groupBy("late").agg(F.count("*").alias("n"))


@plan("hourly_diagnostics", 397, "key:s hour:s value low_share n:i", "SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, value, low_share, n FROM diag")
def _(t):
    return stamp(diag(t), "hour")


# ---- detectors: the recursive queries replay the same state step ------------------------------------------------------
q.cte(
    "ph",
    """SELECT key, 1::BIGINT AS rn, value::DOUBLE AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS nu, 1 AS nd, 0.0::DOUBLE AS signal, 0.0::DOUBLE AS statistic FROM diag_n WHERE rn = 1
    UNION ALL SELECT key, rn, mean, CASE WHEN hu THEN 0 ELSE up END, CASE WHEN hd THEN 0 ELSE dn END, CASE WHEN hu THEN 0 ELSE nu END, CASE WHEN hd THEN 0 ELSE nd END, CASE WHEN hu THEN 1.0 WHEN hd THEN -1.0 ELSE 0.0 END::DOUBLE,
    CASE WHEN hu THEN up WHEN hd THEN dn ELSE greatest(up, dn) END FROM (SELECT *, up > 1 AND nu >= 3 AS hu, NOT (up > 1 AND nu >= 3) AND dn > 1 AND nd >= 3 AS hd FROM (
    SELECT key, rn, mean, CASE WHEN v - mean > 0 THEN greatest(0, up + v - mean) ELSE up END AS up, CASE WHEN v - mean > 0 THEN dn ELSE greatest(0, dn - (v - mean)) END AS dn, nu + (v - mean > 0)::INT AS nu, nd + (NOT v - mean > 0)::INT AS nd FROM (
    SELECT d.key, d.rn, d.value AS v, 0.99::DOUBLE * p.mean + (1 - 0.99::DOUBLE) * d.value AS mean, up, dn, nu, nd FROM ph p JOIN diag_n d ON d.key = p.key AND d.rn = p.rn + 1)))""",
)


@plan("page_hinkley", 400, "key:s hour:s signal statistic", "SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, signal, statistic FROM ph JOIN diag_n USING (key, rn)")
def _(t):
    return stamp(dt.fold(diag(t), dt.page_hinkley(0.99, 1.0, 3), "key", "hour", "value"), "hour")


q.cte(
    "phr",
    """SELECT key, 0::BIGINT AS rn, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS signal, 0.0::DOUBLE AS statistic FROM diag_n WHERE rn = 1
    UNION ALL SELECT key, rn, mean, CASE WHEN st > 2 THEN 0 ELSE up END, CASE WHEN st > 2 THEN 0 ELSE dn END, CASE WHEN st > 2 THEN 0 ELSE lo END, CASE WHEN st > 2 THEN 0 ELSE hi END, (st > 2)::INT::DOUBLE, CASE WHEN st > 2 THEN 1 ELSE least(1, st / 2) END FROM (
    SELECT *, greatest(up - lo, hi - dn) AS st FROM (SELECT key, rn, mean, up, dn, least(lo, up) AS lo, greatest(hi, dn) AS hi FROM (SELECT key, rn, mean, greatest(0, up + v - mean) AS up, least(0, dn + v - mean) AS dn, lo, hi FROM (
    SELECT d.key, d.rn, d.value AS v, 0.95::DOUBLE * p.mean + (1 - 0.95::DOUBLE) * d.value AS mean, up, dn, lo, hi FROM phr p JOIN diag_n d ON d.key = p.key AND d.rn = p.rn + 1))))""",
)


@plan("page_hinkley_range", 401, "key:s hour:s signal statistic", "SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, signal, statistic FROM phr JOIN diag_n USING (key, rn)")
def _(t):
    return stamp(dt.fold(diag(t), dt.page_hinkley_range(0.95, 2.0), "key", "hour", "value"), "hour")


q.cte(
    "ddm",
    """SELECT key, 0::BIGINT AS rn, 0.0::DOUBLE AS n, 0.0::DOUBLE AS e, 1e9::DOUBLE AS b, 1e9::DOUBLE AS bs, 0.0::DOUBLE AS signal, 0.0::DOUBLE AS statistic FROM diag_n WHERE rn = 1
    UNION ALL SELECT key, rn, CASE WHEN lv = 2 THEN 0 ELSE n END, CASE WHEN lv = 2 THEN 0 ELSE e END, CASE WHEN lv = 2 THEN 1e9 ELSE b END, CASE WHEN lv = 2 THEN 1e9 ELSE bs END, lv::DOUBLE, p FROM (
    SELECT *, CASE WHEN n <= 30 THEN 0 WHEN p + sd > b + 2.0 * bs THEN 2 WHEN p + sd > b + 1.5 * bs THEN 1 ELSE 0 END AS lv FROM (
    SELECT key, rn, n, e, p, sd, CASE WHEN p + sd < b + bs THEN p ELSE b END AS b, CASE WHEN p + sd < b + bs THEN sd ELSE bs END AS bs FROM (
    SELECT key, rn, n, e, b, bs, e / n AS p, CASE WHEN n > 1 THEN sqrt(e / n * (1 - e / n) / n) ELSE 0 END AS sd FROM (
    SELECT d.key, d.rn, s.n + 1 AS n, s.e + (d.value > 0.22)::INT AS e, b, bs FROM ddm s JOIN diag_n d ON d.key = s.key AND d.rn = s.rn + 1))))""",
)


@plan("ddm", 403, "key:s hour:s signal statistic", "SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, signal, statistic FROM ddm JOIN diag_n USING (key, rn)")
def _(t):
    d = diag(t).withColumn("err", (F.col("value") > 0.22).cast("double"))
    return stamp(dt.fold(d, dt.ddm(1.5, 2.0, 30), "key", "hour", "err"), "hour")


q.cte(
    "osc",
    """SELECT key, rn, value::DOUBLE AS mean, 0.0::DOUBLE AS var, value::DOUBLE AS v FROM diag_n WHERE rn = 1
    UNION ALL SELECT d.key, d.rn, 0.95::DOUBLE * p.mean + 0.05::DOUBLE * d.value, 0.95::DOUBLE * p.var + 0.05::DOUBLE * pow(d.value - p.mean, 2), d.value FROM osc p JOIN diag_n d ON d.key = p.key AND d.rn = p.rn + 1""",
)


@plan("online_scaler", 407, "key:s hour:s mean scaled", "SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, mean, CASE WHEN var > 1e-12 THEN (v - mean) / sqrt(var) ELSE 0 END AS scaled FROM osc JOIN diag_n USING (key, rn)")
def _(t):
    return stamp(dt.fold(diag(t), dt.online_scaler(0.05), "key", "hour", "value", ("mean", "scaled")), "hour")


q.cte(
    "acq",
    """SELECT key, rn, value::DOUBLE AS q, 0.0::DOUBLE AS miss FROM diag_n WHERE rn = 1
    UNION ALL SELECT d.key, d.rn, greatest(0, p.q + 0.05::DOUBLE * ((d.value > p.q)::INT - 0.1::DOUBLE)), (d.value > p.q)::INT::DOUBLE FROM acq p JOIN diag_n d ON d.key = p.key AND d.rn = p.rn + 1""",
)


@plan("adaptive_conformal", 413, "key:s hour:s q miss", "SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, q, miss FROM acq JOIN diag_n USING (key, rn)")
def _(t):
    return stamp(dt.fold(diag(t), dt.adaptive_conformal(0.1, 0.05), "key", "hour", "value", ("q", "miss")), "hour")


def shifted(t):
    """The hourly series with a jump in level and spread half-way, which an adaptive window must find."""
    late = F.col("hour") >= F.to_timestamp(F.lit("2024-01-16 00:00:00"))
    return diag(t).withColumn("value", F.when(late, 1.5 + 5 * F.col("value")).otherwise(F.col("value")))


q.cte("shf", "SELECT key, hour, rn, CASE WHEN hour >= TIMESTAMP '2024-01-16' THEN 1.5 + 5 * value ELSE value END::DOUBLE AS value FROM diag_n")


def _adwin_sql(name: str, most: int) -> str:
    """The window as a list; every cut is judged from the values on both sides. The cut of a row is the first one found."""
    mean, spread = "list_avg({0})", "list_stddev_pop({0})"
    slope = "coalesce(list_sum([({0})[j] * (j - 1) for j in range(1, len({0}) + 1)]) - (len({0}) - 1) / 2.0 * list_sum({0}), 0) / nullif(len({0}) * (pow(len({0}), 2) - 1) / 12, 0)"
    a, b = "w[1:i]", "w[i + 1:]"
    both = lambda f: (f.format(a), f.format(b))
    m, s, t = both(mean), both(spread), both(slope)
    apart = f"abs({m[0]} - {m[1]}) > sqrt(2 * (1.0 / i + 1.0 / (len(w) - i)) * ln(2 * len(w) / 0.002))"
    other = f"(greatest({s[0]}, {s[1]}) / (least({s[0]}, {s[1]}) + 1e-8) > 2 OR abs({t[0]} - {t[1]}) > 0.1)"
    return f"""SELECT key, rn, [value] AS w, -1.0::DOUBLE AS cut, 1.0::DOUBLE AS size FROM shf WHERE rn = 1
    UNION ALL SELECT key, rn, CASE WHEN i IS NULL THEN w ELSE w[i + 1:] END, coalesce(i, -1)::DOUBLE, (len(w) - coalesce(i, 0))::DOUBLE FROM (
    SELECT key, rn, w, list_filter(list_filter(range(30, len(w) - 30), lambda i: {apart}), lambda i: {other})[1] AS i FROM (
    SELECT d.key, d.rn, list_append(p.w, d.value)[-{most}:] AS w FROM {name} p JOIN shf d ON d.key = p.key AND d.rn = p.rn + 1))"""


q.cte("adw", _adwin_sql("adw", 200))


@plan("adwin", 399, "key:s hour:s cut size", "SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, cut, size FROM adw JOIN diag_n USING (key, rn)")
def _(t):
    return stamp(dt.fold(shifted(t), dt.adwin(0.002, 30, 200), "key", "hour", "value", ("cut", "size")), "hour")


q.cte(
    "adh",
    """SELECT key, rn, [value::DOUBLE] AS w, 0.0::DOUBLE AS detected, 0.0::DOUBLE AS strength FROM diag_n WHERE rn = 1
    UNION ALL SELECT key, rn, CASE WHEN hit THEN w[len(w) // 2 + 1:] ELSE w END, hit::INT::DOUBLE, CASE WHEN hit THEN least(1, diff / eps) ELSE 0 END FROM (
    SELECT *, coalesce(len(w) > 2 AND var > 0 AND diff > eps, false) AS hit FROM (
    SELECT *, list_var_pop(w) AS var, sqrt(2 * list_var_pop(w) * ln(2 / 0.3) / len(w)) + 2 * ln(2 / 0.3) / (3 * len(w)) AS eps, abs(list_avg(w[1:len(w) // 2]) - list_avg(w[len(w) // 2 + 1:])) AS diff FROM (
    SELECT d.key, d.rn, list_append(p.w, d.value::DOUBLE)[-500:] AS w FROM adh p JOIN diag_n d ON d.key = p.key AND d.rn = p.rn + 1)))""",
)


@plan("adwin_half", 402, "key:s hour:s detected strength", "SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, detected, strength FROM adh JOIN diag_n USING (key, rn)")
def _(t):
    return stamp(dt.fold(diag(t), dt.adwin_half(0.3, 500), "key", "hour", "value", ("detected", "strength")), "hour")


_h = "strftime(hour, '%Y-%m-%d %H:%M') AS hour"
q.cte("dd0", f"SELECT *, {q.mean('value', 24, **HO)} AS m, {q.std0('value', 24, **HO)} AS s, {q.skew('value', 24, **HO)} * (24 - 2) / sqrt(24.0 * 23) AS k FROM diag_n")
q.cte("dd2", "SELECT d.key, d.hour, abs(d.m - b.m) / (b.s + 1e-8) AS mean_shift, abs(ln(d.s / (b.s + 1e-8) + 1e-12)) AS log_std_ratio, abs(d.k - b.k) AS skew_change FROM dd0 d JOIN (SELECT key, m, s, k FROM dd0 WHERE rn = 24) b USING (key)")


@plan(
    "distribution_drift",
    404,
    "key:s hour:s mean_shift log_std_ratio skew_change severity:s",
    f"SELECT key, {_h}, mean_shift, log_std_ratio, skew_change, CASE WHEN mean_shift IS NULL THEN NULL WHEN NOT (mean_shift > 0.3 OR log_std_ratio > 0.3 OR skew_change > 0.5) THEN 'none' WHEN greatest(mean_shift, log_std_ratio, skew_change) > 1 THEN 'major' WHEN greatest(mean_shift, log_std_ratio, skew_change) > 0.5 THEN 'moderate' ELSE 'minor' END AS severity FROM dd2",
)
def _(t):
    return stamp(op.distribution_drift(diag(t), "value"), "hour")


q.cte("ks_a", "SELECT event_type, value AS x, 0 AS s FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT event_type, value, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
q.cte("ks_b", "SELECT event_type, x, sum(sum(1 - s)) OVER w / sum(sum(1 - s)) OVER (PARTITION BY event_type)::DOUBLE AS fa, sum(sum(s)) OVER w / sum(sum(s)) OVER (PARTITION BY event_type)::DOUBLE AS fb FROM ks_a GROUP BY 1, 2 WINDOW w AS (PARTITION BY event_type ORDER BY x)")


@plan("ks_drift", 405, "event_type:s ks n_a:i n_b:i", "SELECT event_type, max(abs(fa - fb)) AS ks, n_a, n_b FROM ks_b JOIN (SELECT event_type, sum(1 - s) AS n_a, sum(s) AS n_b FROM ks_a GROUP BY 1) USING (event_type) GROUP BY 1, 3, 4")
def _(t):
    e, cut = events(t), F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    return op.ks_drift(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "value", ["event_type"])


q.cte("rsd0", f"SELECT key, hour, rn, value - 0.5 AS e FROM diag_n")
q.cte("rsd1", f"SELECT *, {q.mean('e * e', 24, **HO)} AS mse, {q.mean('e', 24, **HO)} AS bias FROM rsd0")
q.cte("rsd2", "SELECT d.key, d.hour, d.mse, d.bias, d.mse / (b.mse + 1e-8) AS mse_ratio, abs(d.bias - b.bias) AS bias_change FROM rsd1 d JOIN (SELECT key, mse, bias FROM rsd1 WHERE rn = 24) b USING (key)")


@plan(
    "residual_drift",
    406,
    "key:s hour:s mse bias mse_ratio bias_change drift_type:s",
    f"SELECT * EXCLUDE (hour), {_h}, CASE WHEN mse_ratio IS NULL THEN NULL WHEN mse_ratio > 1.2 THEN 'accuracy_degradation' WHEN bias_change > 0.1 THEN 'systematic_bias' ELSE 'none' END AS drift_type FROM rsd2",
)
def _(t):
    return stamp(op.residual_drift(diag(t).withColumn("e", F.col("value") - 0.5), "e", 24, H), "hour")


q.cte("rw0", "SELECT key, hour, count(*) OVER (PARTITION BY key) - rn AS age FROM diag_n")
q.cte("rww", "SELECT key, hour, age, greatest(pow(0.99, age), 0.2) AS w FROM rw0 WHERE age < 200")


@plan("recency_weights", 408, "key:s hour:s age:i weight", f"SELECT key, {_h}, age, w / sum(w) OVER (PARTITION BY key) AS weight FROM rww")
def _(t):
    return stamp(op.recency_weights(diag(t), 0.99, 200, 0.2, H), "hour")


_cm, _cs = q.mean("value", None, 20, 1, **HO), q.std("value", None, 20, 1, **HO)
q.cte("cl0", f"SELECT key, hour, value, {_cm} AS m, {_cs} AS s FROM diag_n")


@plan(
    "control_limits",
    410,
    "key:s hour:s upper lower state:s",
    f"SELECT key, {_h}, m + 3 * s AS upper, m - 3 * s AS lower, CASE WHEN s IS NULL THEN 'warming_up' WHEN abs(value - m) > 3 * s THEN 'control_violation' WHEN abs(value - m) > 2 * s THEN 'warning_zone' ELSE 'ok' END AS state FROM cl0",
)
def _(t):
    return stamp(op.control_limits(diag(t), "value", H), "hour")


q.cte("mt0", "SELECT *, value - lag(value) OVER (PARTITION BY key ORDER BY hour) AS d FROM diag_n")


@plan(
    "monotone_trend",
    411,
    "key:s hour:s trend:s",
    f"SELECT key, {_h}, CASE WHEN rn >= 4 AND min(d) OVER w >= 0 THEN 'deteriorating' WHEN rn >= 4 AND max(d) OVER w <= 0 THEN 'improving' ELSE 'none' END AS trend FROM mt0 WINDOW w AS (PARTITION BY key ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
)
def _(t):
    return stamp(op.monotone_trend(diag(t), "value", 4, H), "hour")


q.cte("dwx", "SELECT key, hour, rn, (signal <> 0)::INT AS hit FROM ph JOIN diag_n USING (key, rn)")
q.cte(
    "dwr",
    """SELECT key, hour, rn, hit AS alerts, hit AS retune, 0 AS retrain, CASE WHEN hit = 1 THEN hour END AS last, CASE WHEN hit = 1 THEN hour END AS first, NULL::TIMESTAMPTZ AS done FROM (SELECT key, hour::TIMESTAMPTZ AS hour, rn, hit FROM dwx) WHERE rn = 1
    UNION ALL SELECT key, hour, rn, alerts + hit, due, fit, CASE WHEN due = 1 THEN hour ELSE last END, CASE WHEN fit = 1 THEN hour WHEN hit = 1 THEN coalesce(first, hour) ELSE first END, CASE WHEN fit = 1 THEN hour ELSE done END FROM (
    SELECT d.key, d.hour::TIMESTAMPTZ AS hour, d.rn, d.hit, p.alerts, p.last, p.first, p.done, (d.hit = 1 AND (p.last IS NULL OR date_diff('hour', p.last, d.hour::TIMESTAMPTZ) >= 24))::INT AS due,
    (d.hit = 1 AND p.first IS NOT NULL AND (p.done IS NULL OR date_diff('hour', p.done, d.hour::TIMESTAMPTZ) >= 120) AND date_diff('hour', p.first, d.hour::TIMESTAMPTZ) >= 72)::INT AS fit FROM dwr p JOIN dwx d ON d.key = p.key AND d.rn = p.rn + 1)""",
)


@plan("drift_watcher", 409, "key:s hour:s alerts:i retune:i retrain:i", f"SELECT key, {_h}, alerts, retune, retrain FROM dwr")
def _(t):
    s = dt.fold(diag(t), dt.page_hinkley(0.99, 1.0, 3), "key", "hour", "value")
    return stamp(dt.watch(s.withColumn("hit", (F.col("signal") != 0).cast("int")), "key", "hour", ("hit",), 24, 72, 120), "hour")


q.cte("adl", _adwin_sql("adl", 500))
q.cte(
    "pha",
    """SELECT key, rn, value AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS nu, 0 AS nd, 0 AS hit FROM (SELECT key, rn, value FROM shf WHERE rn = 1)
    UNION ALL SELECT key, rn, mean, CASE WHEN u THEN 0 ELSE up END, CASE WHEN v AND NOT u THEN 0 ELSE dn END, CASE WHEN u THEN 0 ELSE nu END, CASE WHEN v AND NOT u THEN 0 ELSE nd END, (u OR v)::INT FROM (
    SELECT *, up > 40 AND nu >= 5 AS u, dn > 40 AND nd >= 5 AS v FROM (
    SELECT key, rn, mean, CASE WHEN dev > 0 THEN greatest(0, up + dev) ELSE up END AS up, CASE WHEN dev > 0 THEN dn ELSE greatest(0, dn - dev) END AS dn, nu + (dev > 0)::INT AS nu, nd + (dev <= 0)::INT AS nd FROM (
    SELECT d.key, d.rn, 0.998::DOUBLE * p.mean + 0.002::DOUBLE * d.value AS mean, d.value - (0.998::DOUBLE * p.mean + 0.002::DOUBLE * d.value) AS dev, up, dn, nu, nd FROM pha p JOIN shf d ON d.key = p.key AND d.rn = p.rn + 1)))""",
)
#: two alerts a row, the adaptive window's first: what the first one decides is known to the second
q.cte("dwa", "SELECT s.key, s.hour::TIMESTAMPTZ AS hour, 2 * s.rn + k - 2 AS rn, CASE WHEN k = 0 THEN (a.cut > 0)::INT ELSE p.hit END AS hit FROM shf s JOIN adl a USING (key, rn) JOIN pha p USING (key, rn), (SELECT unnest([0, 1]) AS k)")
q.cte(
    "dwb",
    """SELECT key, hour, rn, hit AS alerts, hit AS retune, 0 AS retrain, CASE WHEN hit = 1 THEN hour END AS last, CASE WHEN hit = 1 THEN hour END AS first, NULL::TIMESTAMPTZ AS done FROM dwa WHERE rn = 0
    UNION ALL SELECT key, hour, rn, alerts + hit, due, fit, CASE WHEN due = 1 THEN hour ELSE last END, CASE WHEN fit = 1 THEN hour WHEN hit = 1 THEN coalesce(first, hour) ELSE first END, CASE WHEN fit = 1 THEN hour ELSE done END FROM (
    SELECT d.key, d.hour, d.rn, d.hit, p.alerts, p.last, p.first, p.done, (d.hit = 1 AND (p.last IS NULL OR date_diff('hour', p.last, d.hour) >= 168))::INT AS due,
    (d.hit = 1 AND p.first IS NOT NULL AND (p.done IS NULL OR date_diff('hour', p.done, d.hour) >= 2160) AND date_diff('hour', p.first, d.hour) >= 1440)::INT AS fit FROM dwb p JOIN dwa d ON d.key = p.key AND d.rn = p.rn + 1)""",
)


@plan("drift_watcher_all", 409, "key:s hour:s alerts:i retune:i retrain:i", f"SELECT key, {_h}, max(alerts) AS alerts, max(retune) AS retune, max(retrain) AS retrain FROM dwb GROUP BY key, hour")
def _(t):
    d = shifted(t)
    a = dt.fold(d, dt.adwin(0.002, 30, 500), "key", "hour", "value", ("cut", "size")).select("key", "hour", (F.col("cut") > 0).cast("int").alias("by_adwin"))
    p = dt.fold(d, dt.page_hinkley(0.998, 40.0, 5), "key", "hour", "value").select("key", "hour", (F.col("signal") != 0).cast("int").alias("by_page"))
    return stamp(dt.watch(a.join(p, ["key", "hour"]), "key", "hour", ("by_adwin", "by_page"), 24 * 7, 24 * 60, 24 * 90), "hour")


q.cte("hy0", "SELECT key, hour, rn, CASE WHEN value > 0.25 THEN 'high' WHEN value < 0.18 THEN 'low' ELSE 'mid' END AS st FROM diag_n")


q.cte(
    "hyq",
    """SELECT key, hour, rn, st AS active, 0 AS k FROM hy0 WHERE rn = 1
    UNION ALL SELECT key, hour, rn, CASE WHEN a = st OR p + 1 >= 2 THEN st ELSE a END, CASE WHEN a = st OR p + 1 >= 2 THEN 0 ELSE p + 1 END
    FROM (SELECT l.key, l.hour, l.rn, l.st, r.active AS a, r.k AS p FROM hyq r JOIN hy0 l ON l.key = r.key AND l.rn = r.rn + 1)""",
)


@plan("hysteresis_state", 414, "key:s hour:s active:s", f"SELECT key, {_h}, active FROM hyq")
def _(t):
    from barloom.operators.regimes import hysteresis

    d = diag(t).select("key", F.col("hour").alias("date"), F.when(F.col("value") > 0.25, "high").when(F.col("value") < 0.18, "low").otherwise("mid").alias("st"))
    return stamp(hysteresis(d, "st", 2, keys=("key",)).withColumnRenamed("date", "hour"), "hour")
