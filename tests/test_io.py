"""Sources and sinks."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.operators import quality
from barloom.operators.alignment import upsert
from barloom.sources import io
from barloom.sources.tables import Tables


def test_snapshot_is_written_once_and_pruned_by_date(spark, sf_dir, tmp_path):
    df = Tables(spark, sf_dir).bars().where(F.col("date") < F.lit("1995-03-01"))
    path = str(tmp_path / "snap")
    assert io.write_snapshot(df, path, {"horizon": "21"})
    assert not io.write_snapshot(df.limit(0), path, {"horizon": "5"})
    back = io.read_panel(spark, f"{path}/data", ["Brand#1"], "1995-01-10", "1995-01-31", ["close"])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "ReadSchema: struct<symbol:string,close:double>" in plan
    want = df.where((F.col("symbol") == "Brand#1") & F.col("date").between("1995-01-10", "1995-01-31")).count()
    assert back.count() == want > 0
    assert spark.read.json(f"{path}/meta").first()["value"] == "21"


def test_offline_export_reads_names(spark, tmp_path):
    d = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "date date, x double").toPandas()
    paths = []
    for name in ("aapl_h21_fin_g1_train_features", "msft_h21_fin_g1_valid_features"):
        p = str(tmp_path / f"{name}.parquet")
        d.to_parquet(p)
        paths.append(p)
    got = sorted((r["symbol"], r["horizon"], r["family"], r["split"]) for r in io.export_offline(spark, paths).collect())
    assert got == [("AAPL", 21, "fin_g1", "train"), ("MSFT", 21, "fin_g1", "valid")]


def test_upsert_path_keeps_the_old_table(spark, tmp_path):
    a = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 2), 2.0)], "symbol string, date date, x double")
    b = spark.createDataFrame([("A", dt.date(2024, 1, 2), 5.0, 9.0)], "symbol string, date date, x double, y double")
    a.write.parquet(str(tmp_path / "old"))
    io.upsert_path(spark, str(tmp_path / "old"), b, str(tmp_path / "new"))
    got = sorted((r["date"].day, r["x"], r["y"]) for r in spark.read.parquet(str(tmp_path / "new")).collect())
    assert got == [(1, 1.0, None), (2, 5.0, 9.0)] and spark.read.parquet(str(tmp_path / "old")).count() == 2
    assert upsert(a, b).count() == 2


def test_content_hash_ignores_order_and_sees_changes(spark, sf_dir):
    b = Tables(spark, sf_dir).bars()
    cols = ["symbol", "date", "close"]
    h = lambda d: quality.content_hash(d, cols).first()["content_hash"]
    assert h(b) == h(b.orderBy(F.rand(1)))
    assert h(b) != h(b.withColumn("close", F.col("close") + 1e-9))


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = Tables(spark, sf_dir).bars_wide()._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_partkey" not in plan and "l_discount" not in plan
