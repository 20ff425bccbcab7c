"""Plans: sources, sinks, calendars, as-of joins, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import alignment as al
from barloom.plans import duck as q
from barloom.plans.registry import plan
from barloom.sources import caches, io


@plan("merged_scan", (2, 24), "symbol date close volume", "SELECT symbol, date, close, volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def _(t):
    return io.date_range(t.bars(), "1996-01-01", "1998-12-31")


@plan("projected_scan", 4, "l_orderkey:i l_quantity l_shipdate:d", "SELECT l_orderkey, l_quantity, l_shipdate::DATE AS l_shipdate FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-02-01'")
def _(t):
    li = t.raw("lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    return li.where((F.col("l_shipdate") >= F.lit("1998-01-01")) & (F.col("l_shipdate") < F.lit("1998-02-01"))).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@plan("date_coverage", 5, "symbol start:d end:d n:i", 'SELECT symbol, min(date) AS start, max(date) AS "end", count(*) AS n FROM bars GROUP BY symbol')
def _(t):
    return io.coverage(t.bars())


q.cte("halves_a", "SELECT symbol, date, CASE WHEN volume % 3 < 1 THEN NULL ELSE close END AS close, open FROM bars WHERE date < DATE '1999-01-01'")
q.cte("halves_b", "SELECT symbol, date, close + 1 AS close, volume FROM bars WHERE date >= DATE '1998-01-01'")


def halves(t):
    b = t.bars()
    a = b.where(F.col("date") < F.lit("1999-01-01").cast("date")).select("symbol", "date", F.when(F.col("volume") % 3 >= 1, F.col("close")).alias("close"), "open")
    return a, b.where(F.col("date") >= F.lit("1998-01-01").cast("date")).select("symbol", "date", (F.col("close") + 1).alias("close"), "volume")


@plan("coalesce_splits", 3, "symbol date close open volume", "SELECT symbol, date, coalesce(a.close, b.close) AS close, open, volume FROM halves_a a FULL JOIN halves_b b USING (symbol, date)")
def _(t):
    return al.coalesce_frames(*halves(t))


@plan("index_sidecar", 6, "row_id:i date volume flag", "SELECT o_orderkey AS row_id, o_orderdate::DATE AS date, o_totalprice AS volume, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag FROM orders")
def _(t):
    o = t.raw("orders").withColumnRenamed("o_orderkey", "row_id")
    index = o.select("row_id", F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd").cast("int").alias("date"))
    return io.with_index(o.select("row_id", F.col("o_totalprice").alias("volume"), (F.col("o_orderstatus") == "F").alias("flag"), F.col("o_orderpriority").alias("name")), index)


@plan("incremental_upsert", 7, "symbol date close open volume", "SELECT symbol, date, b.close, NULL::DOUBLE AS open, volume FROM halves_b b UNION ALL SELECT symbol, date, close, open, NULL::DOUBLE FROM halves_a a WHERE NOT EXISTS (SELECT 1 FROM halves_b b WHERE b.symbol = a.symbol AND b.date = a.date)")
def _(t):
    return al.upsert(*halves(t))


@plan("stable_shape", 8, "symbol date close extra px_has_data", "SELECT symbol, date, close, NULL AS extra, 1 AS px_has_data FROM bars")
def _(t):
    return io.stable_shape(t.bars(), ["close", "extra"], "px")


q.cte("store", "SELECT symbol, date, 'close' AS feature_name, close AS feature_value, 1 AS data_version FROM bars UNION ALL SELECT symbol, date, 'volume', volume, 1 FROM bars UNION ALL SELECT symbol, date, 'close', close + 2, 2 FROM bars UNION ALL SELECT symbol, date, 'volume', volume + 2, 2 FROM bars")


def store(t):
    b = t.bars()
    v2 = b.withColumns({"close": F.col("close") + 2, "volume": F.col("volume") + 2})
    return io.to_long(b, ["close", "volume"]).unionByName(io.to_long(v2, ["close", "volume"], 2))


@plan("feature_store_long", 12, "symbol date feature_name:s feature_value data_version:i", "SELECT * FROM store")
def _(t):
    return store(t)


@plan("feature_store_wide", 13, "symbol date close volume", "SELECT symbol, date, avg(feature_value) FILTER (WHERE feature_name = 'close') AS close, avg(feature_value) FILTER (WHERE feature_name = 'volume') AS volume FROM store GROUP BY 1, 2")
def _(t):
    return io.to_wide(store(t), ["close", "volume"])


@plan("latest_features", 14, "symbol feature_name:s feature_value date", "SELECT symbol, feature_name, arg_max(feature_value, (date, data_version)) AS feature_value, max(date) AS date FROM store GROUP BY 1, 2")
def _(t):
    return io.latest_features(store(t))


@plan(
    "json_flatten",
    15,
    "event_id:i path:s value",
    "SELECT event_id, 'a_k' AS path, (props->>'k')::DOUBLE AS value FROM events UNION ALL SELECT event_id, 'x_' || (i - 1), (event_id % 10 + i)::DOUBLE FROM events, (SELECT unnest([1, 2]) AS i) UNION ALL SELECT event_id, 'v_w', value FROM events",
)
def _(t):
    e = t.raw("events").select(
        "event_id",
        F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"x":['), (F.col("event_id") % 10 + 1).cast("string"), F.lit(","), (F.col("event_id") % 10 + 2).cast("string"), F.lit('],"long":[1,2,3,4,5,6,7],"t":"abc","v-w":'), F.col("value").cast("string"), F.lit("}")).alias("payload"),
    )
    return io.flatten_numeric(e, "payload", ["event_id"])


@plan("indexed_dict_rows", 16, "event_id:i pos:i k:i", "SELECT event_id, 0 AS pos, (props->>'k')::BIGINT AS k FROM events UNION ALL SELECT event_id, 10, (props->>'k')::BIGINT FROM events")
def _(t):
    e = t.raw("events").select("event_id", F.concat(F.lit('{"0":'), F.col("props"), F.lit(',"10":'), F.col("props"), F.lit(',"x":{"k":5}}')).alias("payload"))
    return io.indexed_rows(e, "payload", ["event_id"], "struct<k:bigint>")


@plan("symbol_group_map", 19, "symbol group:s", "SELECT 'S' || s_suppkey AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN 'N' || s_nationkey ELSE s_name END AS \"group\" FROM supplier")
def _(t):
    s = t.raw("supplier")
    payload = F.when(F.col("s_suppkey") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("N"), F.col("s_nationkey")).alias("GicSector"), F.col("s_name").alias("Sector")))).otherwise(F.to_json(F.struct(F.lit(" ").alias("GicSector"), F.col("s_name").alias("Sector"))))
    return io.group_map(s.select(F.concat(F.lit(" s"), F.col("s_suppkey")).alias("symbol"), payload.alias("payload"), F.col("s_suppkey").alias("payload_id")), "payload", ["GicSector", "Sector"])


@plan("tape_union", 20, "symbol fold_id:i n:i mean_score", "SELECT symbol, fold_id, count(*) AS n, avg(score) AS mean_score FROM tape GROUP BY 1, 2")
def _(t):
    tp = t.tape()
    u = io.union_tapes([tp.where(F.col("fold_id") < 5), tp.where((F.col("fold_id") >= 5) & (F.col("fold_id") < 10)), tp.where(F.col("fold_id") >= 10)])
    return u.groupBy("symbol", "fold_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@plan("instrument_filter", 39, "symbol close n:i", "SELECT symbol, avg(close) AS close, count(*) AS n FROM bars_wide WHERE symbol NOT IN (SELECT symbol FROM profile WHERE mcap < 0) GROUP BY symbol")
def _(t):
    etf = t.profile().where(F.col("mcap") < 0).select("symbol")
    return t.bars_wide().join(etf, "symbol", "left_anti").groupBy("symbol").agg(F.avg("close").alias("close"), F.count("*").alias("n"))


# ---- joins ------------------------------------------------------------------------------------------------------------
q.cte("pj_a", "SELECT symbol, date, close AS a_close, volume AS a_volume FROM bars WHERE volume > 10")
q.cte("pj_b", "SELECT symbol, date, open AS b_open, close * 2 AS a_close FROM bars WHERE volume < 60")
q.cte("pj_c", "SELECT symbol, date, CASE WHEN volume > 30 THEN high END AS finbert_x FROM bars WHERE volume < 80")


@plan(
    "panel_assembly",
    41,
    "symbol date a_close a_volume b_open finbert_x",
    "SELECT symbol, date, coalesce(a_close, 0) AS a_close, coalesce(a_volume, 0) AS a_volume, coalesce(b_open, 0) AS b_open, finbert_x FROM (SELECT symbol, date, a.a_close, a_volume, b_open FROM pj_a a FULL JOIN pj_b b USING (symbol, date)) FULL JOIN pj_c USING (symbol, date)",
)
def _(t):
    b, v = t.bars(), F.col("volume")
    a = b.where(v > 10).select("symbol", "date", F.col("close").alias("a_close"), v.alias("a_volume"))
    c = b.where(v < 60).select("symbol", "date", F.col("open").alias("b_open"), (F.col("close") * 2).alias("a_close"))
    d = b.where(v < 80).select("symbol", "date", F.when(v > 30, F.col("high")).alias("finbert_x"))
    return al.panel_join([a, c, d], keep_null=("finbert_",))


q.cte("sc0", "SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM bars GROUP BY symbol")
q.cte("sc1", "SELECT s.symbol, s.date, close, volume, b.symbol IS NOT NULL AS real FROM (SELECT * FROM sc0 WHERE isodow(date) < 6) s LEFT JOIN bars b USING (symbol, date)")


@plan("scaffold_densify", 42, "symbol date close volume is_real:i", f"SELECT symbol, date, {q.ffill('close')} AS close, {q.ffill('volume')} AS volume, real::INT AS is_real FROM sc1")
def _(t):
    return al.densify(t.bars(), ["close", "volume"])


@plan("bounded_forward_fill", 48, "symbol date close", f"SELECT symbol, date, {q.ffill('close', 2)} AS close FROM sc1")
def _(t):
    return al.densify(t.bars(), ["close"], 2)


q.cte("scal", "SELECT date FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS date) WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM hol)")


def calendar(t):
    h = t.macro().select("date").where(F.dayofmonth("date") == 15)
    return al.session_calendar(t.spark, "1995-01-01", "2001-12-31", h)


@plan("session_calendar", 43, "date idx:i", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM scal")
def _(t):
    return calendar(t)


q.cte("od", "SELECT DISTINCT o_orderdate::DATE AS d FROM orders")


@plan(
    "session_arithmetic",
    44,
    "d:d on_after:d on_before:d strictly_after:d plus5:d",
    """SELECT d, (SELECT min(date) FROM scal WHERE date >= d) AS on_after, (SELECT max(date) FROM scal WHERE date <= d) AS on_before, (SELECT min(date) FROM scal WHERE date > d) AS strictly_after,
    (SELECT date FROM scal WHERE date >= d ORDER BY date OFFSET 5 LIMIT 1) AS plus5 FROM od""",
)
def _(t):
    cal = calendar(t)
    d = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    d = al.session_on(d, "d", cal, "on_after")
    d = al.session_on(d, "d", cal, "on_before", "before")
    d = al.session_on(d, "d", cal, "strictly_after", strict=True)
    return al.add_sessions(d, "on_after", 5, cal, "plus5")


@plan("effective_session", 384, "d:d effective_session:d", "SELECT d, (SELECT min(date) FROM scal WHERE date > d) AS effective_session FROM od")
def _(t):
    d = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return al.effective_session(d, "d", calendar(t))


q.cte("ao", "SELECT symbol, event_date AS known_at, n_events FROM urgent")


def urgent(t):
    return t.urgent().withColumnRenamed("event_date", "known_at")


@plan("asof_backward", (46, 47), "symbol date n_events:i asof_time:d", "SELECT b.symbol, b.date, n_events, known_at AS asof_time FROM bars b ASOF LEFT JOIN ao ON ao.symbol = b.symbol AND b.date >= ao.known_at")
def _(t):
    return al.asof_join(t.bars().select("symbol", "date"), urgent(t), ["n_events"])


@plan("asof_forward", 52, "symbol date n_events:i asof_time:d", "SELECT b.symbol, b.date, n_events, known_at AS asof_time FROM bars b ASOF LEFT JOIN ao ON ao.symbol = b.symbol AND b.date <= ao.known_at")
def _(t):
    return al.asof_join(t.bars().select("symbol", "date"), urgent(t), ["n_events"], direction="forward")


@plan(
    "asof_bounded",
    48,
    "symbol date n_events:i",
    "SELECT symbol, date, CASE WHEN date_diff('day', known_at, date) <= 2 THEN n_events END AS n_events FROM (SELECT b.symbol, b.date, n_events, known_at FROM bars b ASOF LEFT JOIN ao ON ao.symbol = b.symbol AND b.date >= ao.known_at)",
)
def _(t):
    return al.asof_join(t.bars().select("symbol", "date"), urgent(t), ["n_events"], max_age_days=2)


q.cte("sched", "SELECT date_trunc('year', date)::DATE AS asof, 'f' || (volume % 3)::INT AS family, avg(close) / 1000 AS weight FROM bars GROUP BY 1, 2")


def schedule(t):
    return t.bars().groupBy(F.trunc("date", "year").alias("asof"), F.concat(F.lit("f"), (F.col("volume") % 3).cast("int")).alias("family")).agg((F.avg("close") / 1000).alias("weight"))


@plan("weights_schedule", (49, 50), "date family:s weight", "SELECT d.date, f.family, weight FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT family FROM sched) f JOIN sched s ON s.family = f.family AND s.asof = date_trunc('year', d.date)")
def _(t):
    return al.schedule_lookup(t.bars().select("date").distinct(), schedule(t))


q.cte("registry", "SELECT symbol, CASE WHEN mcap < 5000 THEN DATE '1998-06-30' END AS stop_date FROM profile")


@plan("registry_validity", 60, "symbol date close", "SELECT symbol, date, close FROM bars_wide JOIN registry USING (symbol) WHERE stop_date IS NULL OR date <= stop_date")
def _(t):
    reg = t.profile().select("symbol", F.when(F.col("mcap") < 5000, F.lit("1998-06-30").cast("date")).alias("stop_date"))
    return al.valid_on(t.bars_wide(), reg)


@plan("missing_symbols", 59, "symbol", "SELECT DISTINCT 'S' || c_custkey AS symbol FROM customer WHERE 'S' || c_custkey NOT IN (SELECT symbol FROM profile)")
def _(t):
    return al.missing_keys(t.raw("customer").select(F.concat(F.lit("S"), F.col("c_custkey")).alias("symbol")), t.profile())


@plan("profile_lookup", 62, "symbol sector:s industry:s n:i", "SELECT symbol, sector, industry, count(*) AS n FROM bars_wide JOIN profile USING (symbol) GROUP BY 1, 2, 3")
def _(t):
    return t.bars_wide().groupBy("symbol").agg(F.count("*").alias("n")).join(t.profile(), "symbol")


q.cte("vp_in", "SELECT symbol, date, close, sin(volume) AS score, 1 + (volume % 7)::INT AS horizon FROM bars")


@plan(
    "prediction_validation",
    66,
    "symbol date status:s actual_return hit:i",
    "SELECT v.symbol, v.date, CASE WHEN p.close IS NULL THEN 'pending' ELSE 'validated' END AS status, p.close / v.close - 1 AS actual_return, (sign(p.close / v.close - 1) = sign(score))::INT AS hit FROM vp_in v LEFT JOIN bars p ON p.symbol = v.symbol AND p.date = v.date + horizon",
)
def _(t):
    b = t.bars()
    pred = b.select("symbol", "date", "close", F.sin("volume").alias("score"), (1 + (F.col("volume") % 7).cast("int")).alias("horizon"))
    return al.validate_predictions(pred, b)


q.cte("pit_e", "SELECT symbol, date, CASE WHEN volume % 2 < 1 THEN 'valid' ELSE 'train' END AS split FROM bars UNION ALL SELECT symbol, date, 'train' FROM bars")


@plan(
    "point_in_time_retrieval",
    11,
    "symbol date split:s n_events:i",
    "SELECT symbol, date, split, n_events FROM (SELECT e.*, n_events FROM (SELECT symbol, date, max(split) AS split FROM pit_e GROUP BY 1, 2) e ASOF LEFT JOIN ao ON ao.symbol = e.symbol AND e.date >= ao.known_at)",
)
def _(t):
    b = t.bars()
    e = b.select("symbol", "date", F.when(F.col("volume") % 2 < 1, "valid").otherwise("train").alias("split")).unionByName(b.select("symbol", "date", F.lit("train").alias("split")))
    return io.point_in_time(e, {"u": t.urgent().withColumnRenamed("event_date", "date")})


# ---- sets and order ---------------------------------------------------------------------------------------------------
@plan("date_axis_union", 346, "date", "SELECT DISTINCT date FROM bars UNION SELECT DISTINCT date FROM bars_wide")
def _(t):
    return t.bars().select("date").union(t.bars_wide().select("date")).distinct()


@plan("index_intersection", 347, "date n:i", "SELECT date, count(*) AS n FROM bars WHERE date IN (SELECT o_orderdate::DATE FROM orders) GROUP BY date")
def _(t):
    o = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return t.bars().join(o, "date", "left_semi").groupBy("date").agg(F.count("*").alias("n"))


@plan("ordered_column_union", 348, "symbol date close open volume", "SELECT symbol, date, close, open, NULL::DOUBLE AS volume FROM halves_a UNION ALL SELECT symbol, date, close, NULL::DOUBLE, volume FROM halves_b")
def _(t):
    a, b = halves(t)
    return a.unionByName(b, allowMissingColumns=True)


@plan("event_dedupe", 351, "user_id:i event_type:s day:d first_id:i", "SELECT user_id, event_type, ts::DATE AS day, min(event_id) AS first_id FROM events GROUP BY 1, 2, 3")
def _(t):
    e = t.raw("events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "event_id")
    return al.first_by(e, ["user_id", "event_type", "day"], F.col("event_id")).withColumnRenamed("event_id", "first_id")


q.cte("fsel", "SELECT symbol AS family, avg(abs(score)) AS weight, stddev_samp(score) AS stability, avg((conf > 0.3)::INT) AS coverage FROM tape GROUP BY symbol")


@plan(
    "family_selection",
    340,
    "family:s weight forced:i",
    "SELECT family, weight, (family = 'Brand#1')::INT AS forced FROM fsel WHERE family = 'Brand#1' OR (weight * exp(-0.5 * stability) >= 0.31 AND coverage >= 0.7) OR (weight = (SELECT max(weight) FROM fsel) AND NOT EXISTS (SELECT 1 FROM fsel WHERE weight * exp(-0.5 * stability) >= 0.31 AND coverage >= 0.7))",
)
def _(t):
    f = t.tape().groupBy(F.col("symbol").alias("family")).agg(F.avg(F.abs("score")).alias("weight"), F.stddev_samp("score").alias("stability"), F.avg((F.col("conf") > 0.3).cast("int")).alias("coverage"))
    one = Window.partitionBy(F.lit(0))  # one row per family
    ok = (F.col("weight") * F.exp(-0.5 * F.col("stability")) >= 0.31) & (F.col("coverage") >= 0.7)
    f = f.withColumns({"ok": ok, "forced": (F.col("family") == "Brand#1").cast("int")})
    f = f.withColumns({"any_ok": F.max("ok").over(one), "top": F.col("weight") == F.max("weight").over(one)})
    return f.where(F.col("ok") | (F.col("forced") == 1) | (~F.col("any_ok") & F.col("top")))


q.cte("tfeat", "SELECT symbol AS family, model || horizon AS feature, avg(abs(score)) AS score FROM tape GROUP BY 1, 2")


@plan(
    "top_features_per_family",
    (339, 341),
    "family:s feature:s norm_score rank:i",
    "SELECT * FROM (SELECT family, feature, score / max(score) OVER (PARTITION BY family) AS norm_score, row_number() OVER (PARTITION BY family ORDER BY score DESC, feature) AS rank FROM tfeat) WHERE rank <= 3",
)
def _(t):
    f = t.tape().groupBy(F.col("symbol").alias("family"), F.concat("model", "horizon").alias("feature")).agg(F.avg(F.abs("score")).alias("score"))
    w = Window.partitionBy("family")
    f = f.withColumns({"norm_score": F.col("score") / F.max("score").over(w), "rank": F.row_number().over(w.orderBy(F.desc("score"), "feature"))})
    return f.where(F.col("rank") <= 3)


@plan("yyyymmdd_dates", 387, "symbol date_int:i date", "SELECT symbol, strftime(date, '%Y%m%d')::BIGINT AS date_int, date FROM bars")
def _(t):
    d = t.bars().select("symbol", F.date_format("date", "yyyyMMdd").cast("int").alias("date_int"))
    return d.withColumn("date", F.to_date(F.col("date_int").cast("string"), "yyyyMMdd"))


@plan("family_row_summary", (107, 108, 109), "symbol date mean std median spread_95_5 third_moment level_diff", f"""SELECT symbol, date, m AS mean, s AS std, l[3] * 0.5 + l[2] * 0.5 AS median, (l[3] + (l[4] - l[3]) * 0.85) - (l[1] + (l[2] - l[1]) * 0.15) AS spread_95_5,
    (pow(open - m, 3) + pow(high - m, 3) + pow(low - m, 3) + pow(close - m, 3)) / 4 / pow(greatest(s, 1e-9), 3) AS third_moment, m - lag(m) OVER (PARTITION BY symbol ORDER BY date) AS level_diff FROM (
    SELECT *, (open + high + low + close) / 4 AS m, sqrt((pow(open - (open + high + low + close) / 4, 2) + pow(high - (open + high + low + close) / 4, 2) + pow(low - (open + high + low + close) / 4, 2) + pow(close - (open + high + low + close) / 4, 2)) / 4) AS s,
    list_sort([open, high, low, close]) AS l FROM bars)""")
def _(t):
    from barloom.operators.derived import row_summary

    return row_summary(t.bars(), ["open", "high", "low", "close"])


@plan("precision_helpers", (389, 390), "symbol date safe_log safe_ratio safe_power sig", "SELECT symbol, date, CASE WHEN close > 0 THEN ln(close) END AS safe_log, close / nullif(volume - 10, 0) AS safe_ratio, CASE WHEN close > 0 THEN pow(close, 0.25) END AS safe_power, 1 / (1 + exp(-(volume - 30) / 10)) AS sig FROM bars")
def _(t):
    from barloom.functions.columns import ratio, safe_log, sigmoid

    return t.bars().withColumns({"safe_log": safe_log("close"), "safe_ratio": ratio("close", F.col("volume") - 10), "safe_power": F.when(F.col("close") > 0, F.pow("close", 0.25)), "sig": sigmoid((F.col("volume") - 30) / 10)})


@plan("dashboard_rollup", 123, "horizon:i n:i mean_score mean_return hit_rate", "SELECT horizon, count(*) AS n, avg(score) AS mean_score, avg(y_true) AS mean_return, avg((score * y_true > 0)::INT) AS hit_rate FROM tape GROUP BY horizon")
def _(t):
    return t.tape().groupBy("horizon").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("y_true").alias("mean_return"), F.avg((F.col("score") * F.col("y_true") > 0).cast("int")).alias("hit_rate"))




q.cte("cached", "SELECT symbol, 21 AS horizon, 'price_g1' AS family, CASE WHEN date < DATE '1997-01-01' THEN 'train' ELSE 'valid' END AS split, date, close, volume FROM bars")


@plan("export_offline", 10, "symbol horizon:i family:s split:s date close volume", "SELECT upper(symbol) AS symbol, horizon, family, split, date, close, volume FROM cached WHERE split = 'valid'")
def _(t):
    """All bars written as caches, one file per symbol and split, and the validation caches read back as one long table."""
    path = f"{caches.shared_folder(t.spark)}/caches-{uuid.uuid4().hex}"
    split = F.when(F.col("date") < F.lit("1997-01-01").cast("date"), "train").otherwise("valid")
    named = {"horizon": F.lit(21), "family": F.lit("price_g1"), "split": split}
    caches.write_caches(t.bars().select("symbol", "date", "close", "volume").withColumns(named), path)
    return caches.read_caches(t.spark, path).where("split = 'valid'")


@plan("snapshot_write", 9, "symbol date close volume horizon:i", "SELECT symbol, date, close, volume, 21 AS horizon FROM bars")
def _(t):
    """A snapshot by date with its metadata, written once; what a second writer offers is left aside."""
    path = f"{caches.shared_folder(t.spark)}/snapshot-{uuid.uuid4().hex}"
    by_month = t.bars().select("symbol", F.trunc("date", "month").alias("date"), F.col("date").alias("day"), "close", "volume")
    io.write_snapshot(by_month, path, {"horizon": "21"})
    io.write_snapshot(by_month.limit(0), path, {"horizon": "5"})
    meta = t.spark.read.json(f"{path}/meta").where("key = 'horizon'").select(F.col("value").cast("int").alias("horizon"))
    return t.spark.read.parquet(f"{path}/data").select("symbol", F.col("day").alias("date"), "close", "volume").join(F.broadcast(meta))
