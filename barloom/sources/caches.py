"""Feature caches, one file per symbol, horizon, family and split, as a data source with partitions, pushed filters and commits.

A folder of caches is read as one long table; what a file's name tells becomes columns, and filters on those columns decide which
files are opened at all. A write puts its files into a run of its own; the run counts once its manifest stands, which is the
last thing that a commit writes. A run without a manifest, aborted or abandoned, is never read.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: columns that the names of files hold
NAMED = ("symbol", "horizon", "family", "split")
PATTERN = re.compile(r"^([^_/]+)_h(\d+)_(.+)_(train|valid)_features(?:\.[0-9a-f]+)?\.parquet$")
RUNS, MANIFESTS = "_runs", "_committed"


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one on a single machine, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def named(file: str) -> dict | None:
    """What the name of a cache file tells; symbols in upper case."""
    found = PATTERN.match(os.path.basename(file))
    return found and {"symbol": found[1].upper(), "horizon": int(found[2]), "family": found[3], "split": found[4]}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return fs, at.rstrip("/")


def _files(path: str) -> list[str]:
    """Files of the committed runs; of a folder without any run, all caches in it."""
    fs, root = _open(path)
    manifests = fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    runs = fs.get_file_info(f"{root}/{RUNS}").type == pafs.FileType.Directory
    if not manifests and not runs:
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file]
    else:
        found = []
        for m in manifests:
            if m.path.endswith(".json"):
                with fs.open_input_stream(m.path) as held:
                    found += [f"{root}/{RUNS}/{f}" for f in json.loads(held.read())]
    return sorted(f for f in found if named(f))


@dataclass
class CacheFile(InputPartition):
    path: str


class CacheReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality on what the names tell is settled by the names; all else is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute[0] in NAMED and f.value is not None:
                self.wanted.append((f.attribute[0], {f.value}))
            elif isinstance(f, In) and f.attribute[0] in NAMED:
                self.wanted.append((f.attribute[0], set(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [CacheFile(f) for f in _files(self.path) if all(named(f)[c] in values for c, values in self.wanted)] or [CacheFile("")]

    def read(self, partition: CacheFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        target, told = to_arrow_schema(self.schema), named(partition.path)
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as opened:
            file = pq.ParquetFile(opened)
            own = [f.name for f in file.schema_arrow if f.name in target.names and f.name not in NAMED]
            for batch in file.iter_batches(columns=own):
                made = []
                for f in target:
                    if f.name in NAMED:
                        made.append(pa.array([told[f.name]] * batch.num_rows, f.type))
                    elif f.name in own:
                        made.append(batch.column(f.name).cast(f.type))
                    else:  # families differ in their columns
                        made.append(pa.nulls(batch.num_rows, f.type))
                yield pa.RecordBatch.from_arrays(made, schema=target)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class CacheWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file for each symbol, horizon, family and split that the task meets; batches are written as they come."""
        fs, root = _open(self.path)
        token, writers, files = uuid.uuid4().hex[:12], {}, []
        fs.create_dir(f"{root}/{RUNS}/{self.run}", recursive=True)
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            keys = table.select(NAMED).group_by(list(NAMED)).aggregate([]).to_pylist()
            for key in keys:
                if None in key.values() or key["split"] not in ("train", "valid"):
                    raise ValueError(f"not a cache's name: {key}")
                mask = None
                for c, v in key.items():
                    own = pc.equal(table[c], pa.scalar(v, table[c].type))
                    mask = own if mask is None else pc.and_(mask, own)
                rows = table.filter(mask).drop_columns(list(NAMED))
                name = "{symbol}_h{horizon}_{family}_{split}_features".format(**key) + f".{token}.parquet"
                if named(name) != key | {"symbol": key["symbol"].upper()}:
                    raise ValueError(f"not a cache's name: {key}")
                if name not in writers:
                    writers[name] = pq.ParquetWriter(fs.open_output_stream(f"{root}/{RUNS}/{self.run}/{name}"), rows.schema)
                    files.append(f"{self.run}/{name}")
                writers[name].write_table(rows)
        for w in writers.values():
            w.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        before = [m.path for m in fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}")) if m.path.endswith(".json")]
        with fs.open_output_stream(f"{root}/{MANIFESTS}/{self.run}.tmp") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        fs.move(f"{root}/{MANIFESTS}/{self.run}.tmp", f"{root}/{MANIFESTS}/{self.run}.json")
        if self.overwrite:
            for old in before:
                fs.delete_file(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/{RUNS}/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{RUNS}/{self.run}")


class FamilyCaches(DataSource):
    """`spark.read.format("family_caches").load(folder)` and `df.write.format("family_caches").mode(...).save(folder)`.

    Columns are the names' (symbol, horizon, family, split) and then those of all files; a file without a column gives nulls.
    The store must be one that Arrow opens (local or network folders, object stores).
    """

    @classmethod
    def name(cls) -> str:
        return "family_caches"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_type

        path, met = self.options["path"], {}
        fs, _ = _open(path)
        for f in _files(path):
            with fs.open_input_file(f) as opened:
                for field in pq.read_schema(opened):
                    if field.name not in NAMED:
                        met.setdefault(field.name, from_arrow_type(field.type))
        return StructType([StructField(c, IntegerType() if c == "horizon" else StringType()) for c in NAMED] + [StructField(c, t) for c, t in met.items()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return CacheReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = [c for c in NAMED if c not in schema.names]
        if missing:
            raise ValueError(f"columns that name a cache are missing: {missing}")
        return CacheWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FamilyCaches)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_caches(df: DataFrame, path: str, mode: str = "append") -> None:
    register(df.sparkSession)
    df.write.format("family_caches").mode(mode).save(path)


def read_caches(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("family_caches").load(path)
