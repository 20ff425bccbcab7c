"""Tables that cut lineage: written as Parquet to the folder that every executor and the driver share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: paths of the tables that `cut` has written in this process and `drop` has not deleted
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. Where it is unset a temporary one is set on a single machine, as in tests; on
    several machines there is none that all of them see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def _rows_of_text(spark: SparkSession):
    """Arrow batches of fewer rows while a table is written: the usual 10,000 hold tens of MB of text, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(1000, int(before)) if int(before) > 0 else 1000))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """`df` written once and read back: a lost executor re-reads the files, and both readers of a result see the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _rows_of_text(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barloom_path = path
    WRITTEN.append(path)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files behind frames made by `cut` once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_barloom_path", None)
        if path:
            drop_paths(df.sparkSession, [path])


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def input_partitions(df: DataFrame) -> int:
    """Tasks that a scan of `df` takes; grows with the table."""
    return max(1, df.rdd.getNumPartitions())
