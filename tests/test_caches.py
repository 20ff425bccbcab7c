"""The cache data source: names as columns, files opened by filters, commits and aborts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barloom.sources import caches


def rows(spark):
    data = [(s, h, f, split, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for s in ("AAPL", "MSFT") for h in (21, 63) for f in ("fin_g1", "tech") for split in ("train", "valid") for i in range(5)]
    return spark.createDataFrame(data, "symbol string, horizon int, family string, split string, date date, x double").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.select("symbol", "horizon", "family", "split", "date", "x").collect())


def test_round_trip_and_appends(spark, tmp_path):
    path, df = str(tmp_path / "c"), rows(spark)
    caches.write_caches(df, path)
    assert found(caches.read_caches(spark, path)) == found(df)
    more = df.where("symbol = 'AAPL'").withColumn("symbol", F.lit("IBM")).withColumn("y", F.lit(1))
    caches.write_caches(more, path)
    both = caches.read_caches(spark, path)
    assert both.count() == df.count() + more.count() and both.where("symbol <> 'IBM' AND y IS NOT NULL").count() == 0
    caches.write_caches(more, path, "overwrite")
    assert found(caches.read_caches(spark, path)) == found(more)


def test_filters_on_names_decide_which_files_are_opened(spark, tmp_path):
    path, df = str(tmp_path / "c"), rows(spark)
    caches.write_caches(df, path)
    for file in caches._files(path):  # files that no name asks for cannot even be read
        if "MSFT" in file or "_h63_" in file:
            with open(file, "wb") as out:
                out.write(b"no parquet")
    schema = "symbol string, horizon int, family string, split string, date date, x double"
    caches.register(spark)
    some = spark.read.format("family_caches").schema(schema).load(path).where("symbol IN ('AAPL', 'IBM') AND horizon = 21 AND x > 2")
    assert found(some) == found(df.where("symbol = 'AAPL' AND horizon = 21 AND x > 2"))
    assert spark.read.format("family_caches").schema(schema).load(path).where("symbol = 'none'").count() == 0


def test_an_aborted_write_leaves_nothing_readable(spark, tmp_path):
    path, df = str(tmp_path / "c"), rows(spark)
    caches.write_caches(df, path)
    spoiled = df.withColumn("split", F.when((F.col("symbol") == "MSFT") & (F.col("x") > 3), "other").otherwise(F.col("split")))
    with pytest.raises(Exception, match="not a cache's name"):
        caches.write_caches(spoiled, path)
    assert found(caches.read_caches(spark, path)) == found(df)
    assert len(os.listdir(f"{path}/_runs")) == 1
    with pytest.raises(Exception, match="missing"):
        caches.write_caches(df.drop("split"), path)
    # a run whose job died before its commit
    os.makedirs(f"{path}/_runs/dead")
    caches_file = caches._files(path)[0]
    os.link(caches_file, f"{path}/_runs/dead/{os.path.basename(caches_file)}")
    assert found(caches.read_caches(spark, path)) == found(df)


def test_folders_written_by_others(spark, tmp_path):
    plain = rows(spark).where("symbol = 'AAPL' AND horizon = 21 AND family = 'tech'").select("split", "date", "x").toPandas()
    for split, own in plain.groupby("split"):
        own[["date", "x"]].to_parquet(str(tmp_path / f"aapl_h21_tech_{split}_features.parquet"))
    (tmp_path / "notes.parquet").write_bytes(b"")
    got = caches.read_caches(spark, str(tmp_path))
    assert found(got) == found(rows(spark).where("symbol = 'AAPL' AND horizon = 21 AND family = 'tech'"))
