"""Sources and sinks: merged panels, family caches, feature stores, snapshots, nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite
from barloom.operators.alignment import asof_join, upsert


def read_panel(spark: SparkSession, root: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Partitioned panel scan: symbol and date filters reach the partitions and row groups, columns the reader."""
    df = spark.read.parquet(root)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(sorted({x for s in symbols for x in (s, s.upper())})))
    df = date_range(df, start, end)
    return df if columns is None else df.select("symbol", "date", *columns)


def date_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def coverage(df: DataFrame, keys=("symbol",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"))


def with_index(features: DataFrame, index: DataFrame) -> DataFrame:
    """Features joined to their (row_id, YYYYMMDD) index by key; numeric columns only, missing as 0."""
    nums = [f.name for f in features.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "boolean") and f.name != "row_id"]
    j = features.join(index.select("row_id", F.to_date(F.col("date").cast("string"), "yyyyMMdd").alias("date")), "row_id")
    return j.select("row_id", "date", *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in nums])


def stable_shape(df: DataFrame, allowed: list[str], family: str, keys=("symbol", "date")) -> DataFrame:
    """Exactly the keys and the allowed columns, missing ones as NULL, has_data injected as 1 when absent."""
    flag = f"{family}_has_data"
    if flag not in df.columns:
        df = df.withColumn(flag, F.lit(1.0))
    return df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in [*allowed, flag] if c not in keys])


def write_snapshot(df: DataFrame, path: str, meta: dict[str, str], overwrite: bool = False) -> bool:
    """Snapshot partitioned by date with its metadata beside it; a finished snapshot is left alone. The metadata is written last
    and its commit marker says that the snapshot is whole, so what a job that died has left is written again."""
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker) and not overwrite:
        return False
    df.write.mode("overwrite").partitionBy("date").parquet(f"{path}/data")
    spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return True


def upsert_path(spark: SparkSession, path: str, new: DataFrame, target: str, keys=("symbol", "date")) -> None:
    """Merge new rows into a stored table and write the result to a new folder (the input is never overwritten)."""
    upsert(spark.read.parquet(path), new, keys).write.mode("errorifexists").parquet(target)


def export_offline(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Many per-symbol cache files as one long table: symbol, horizon, family and split come from the file name."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet", 1)
    pat = r"^([^_]+)_h(\d+)_(.+)_(train|valid)_features$"
    df = spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("__n", name)
    parts = {"symbol": (1, "string"), "horizon": (2, "int"), "family": (3, "string"), "split": (4, "string")}
    df = df.withColumns({k: F.regexp_extract("__n", pat, i).cast(t) for k, (i, t) in parts.items()}).drop("__n")
    return df.withColumn("symbol", F.upper("symbol"))


def point_in_time(entities: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    """Entity rows (symbol, split, date) joined as-of to every family; on equal dates `valid` beats `train`."""
    out = entities
    for name, f in families.items():
        cols = [c for c in f.columns if c not in ("symbol", "date")]
        out = asof_join(out, f.withColumnRenamed("date", "known_at"), cols).drop("asof_time")
    rank = F.when(F.col("split") == "valid", 1).otherwise(0)
    rest = [c for c in out.columns if c not in ("symbol", "date")]
    return out.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), rank).alias("__r")).select("symbol", "date", "__r.*")


def to_long(df: DataFrame, columns: list[str], version: int = 1, feature_type: str = "raw") -> DataFrame:
    """Wide rows to the (date, symbol, feature, value, type, version) store."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature_name"), finite(c).alias("feature_value")) for c in columns])
    d = df.select("symbol", "date", F.explode(pairs).alias("x")).select("symbol", "date", "x.*")
    return d.withColumns({"feature_type": F.lit(feature_type), "data_version": F.lit(version)})


def to_wide(store: DataFrame, names: list[str]) -> DataFrame:
    """Feature store back to wide rows; several versions of a value are averaged."""
    return store.groupBy("symbol", "date").pivot("feature_name", names).agg(F.avg("feature_value"))


def latest_features(store: DataFrame) -> DataFrame:
    """Value of each (symbol, feature) on its last date, highest version first."""
    at = F.struct("date", "data_version")
    return store.groupBy("symbol", "feature_name").agg(F.max_by("feature_value", at).alias("feature_value"), F.max("date").alias("date"))


def flatten_numeric(df: DataFrame, payload: str, keep: list[str], max_list: int = 5) -> DataFrame:
    """JSON objects to (keep..., path, value) for numeric leaves two levels deep; longer lists are skipped."""
    j = F.parse_json(F.col(payload))
    d = df.select(*keep, F.explode(F.from_json(payload, "map<string,string>")).alias("key", "raw")).where(j.isNotNull())
    num = d.where(F.expr("try_cast(raw AS double)").isNotNull()).select(*keep, F.col("key").alias("path"), F.expr("try_cast(raw AS double)").alias("value"))
    lists = d.withColumn("arr", F.from_json("raw", "array<string>")).where(F.col("raw").startswith("[") & F.col("arr").isNotNull() & (F.size("arr") <= max_list))
    lists = lists.select(*keep, "key", F.posexplode("arr").alias("i", "v")).select(*keep, F.concat_ws("_", "key", "i").alias("path"), F.expr("try_cast(v AS double)").alias("value"))
    maps = d.where(F.col("raw").startswith("{")).select(*keep, "key", F.explode(F.from_json("raw", "map<string,string>")).alias("k", "v"))
    maps = maps.select(*keep, F.concat_ws("_", "key", "k").alias("path"), F.expr("try_cast(v AS double)").alias("value"))
    out = num.unionByName(lists).unionByName(maps).where(F.col("value").isNotNull())
    return out.withColumn("path", F.regexp_replace("path", "[ -]", "_"))


def indexed_rows(df: DataFrame, payload: str, keep: list[str], schema: str) -> DataFrame:
    """Objects keyed by numeric strings to rows in numeric key order."""
    m = F.from_json(payload, f"map<string,{schema}>")
    d = df.select(*keep, F.explode(m).alias("key", "item")).where(F.col("key").rlike("^[0-9]+$"))
    return d.select(*keep, F.col("key").cast("int").alias("pos"), "item.*")


def normalise_statement(df: DataFrame, aliases: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """First present alias per canonical column, cast to double; total debt from its two parts when absent."""
    out = {}
    for name, options in aliases.items():
        have = [F.expr(f"try_cast(`{o}` AS double)") for o in options if o in df.columns]
        if have:
            out[name] = F.coalesce(*have)
    d = df.select(*keep, *[v.alias(k) for k, v in out.items()])
    if "total_debt" not in d.columns and {"short_term_debt", "long_term_debt"} <= set(d.columns):
        d = d.withColumn("total_debt", F.coalesce("short_term_debt", F.lit(0.0)) + F.coalesce("long_term_debt", F.lit(0.0)))
    return d


def align_statements(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Three statements on the income statement's periods, with margins and revenue growth."""
    d = income.join(balance, ["symbol", "period"], "left").join(cash, ["symbol", "period"], "left")
    per = lambda a: F.try_divide(a, F.col("revenue"))
    prev = F.lag("revenue").over(Window.partitionBy("symbol").orderBy("period"))
    return d.withColumns(
        {
            "gross_margin": per(F.col("gross_profit")), "ebit_margin": per(F.col("ebit")), "capex_to_rev": per(F.abs("capex")),
            "nwc_to_rev": per(F.col("current_assets") - F.col("current_liabilities")), "rev_growth": F.try_divide(F.col("revenue"), prev) - 1,
        }
    )


def group_map(df: DataFrame, payload: str, preference: list[str]) -> DataFrame:
    """symbol -> group from JSON payloads, first key of the preference list that is present, smallest payload id wins."""
    m = F.from_json(payload, "map<string,string>")
    pick = F.coalesce(*[F.nullif(F.trim(F.element_at(m, k)), F.lit("")) for k in preference])
    d = df.select(F.upper(F.trim("symbol")).alias("symbol"), pick.alias("group"), "payload_id").where(F.col("group").isNotNull())
    return d.groupBy("symbol").agg(F.min_by("group", "payload_id").alias("group"))


def union_tapes(folds: list[DataFrame]) -> DataFrame:
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def numeric_panel(df: DataFrame, keep: list[str]) -> DataFrame:
    """Every other column coerced to double; what does not parse becomes NULL."""
    return df.select(*keep, *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in df.columns if c not in keep])
