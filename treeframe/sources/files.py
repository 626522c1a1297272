"""Records out of files."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.extract import batches, extract, prepared, record_fields, typed
from ..plans.program import Program
from ..plans.spec import Record
from .split import PIECE, records

FORMAT = "treeframe"


def read_files(spark: SparkSession, path: str, spec: Record | type, **how) -> DataFrame:
    """extract() over whole files, through Spark's own reader, with `path` kept. For files that fit a task's memory, however many."""
    files = spark.read.format("binaryFile").load(path)
    return extract(files, spec, "content", keep=["path"], **how)


def read_large(spark: SparkSession, path: str, spec: Record | type, ignore_namespace: bool = False, mode: str = "FAILFAST", position: str | None = None) -> DataFrame:
    """Like read_files(), for files of any size: they are parsed as they are read, and a task holds one record at a time.

    One file is one task, as markup cannot be entered in its middle. Files are opened with Arrow's file systems: local
    paths, or URIs (s3, gs, hdfs, file) that Arrow knows.
    """
    spec, prog = prepared(spark, spec, ignore_namespace, mode, ["path", *([position] if position else [])])
    spark.dataSource.register(RecordSource)
    raw = spark.read.format(FORMAT).option("program", base64.b64encode(cloudpickle.dumps(prog)).decode()).load(path)
    return typed(raw, spec, prog, mode, {"path": F.col("path")} | ({position: F.col("pos")} if position else {}))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class RecordSource(DataSource):
    """Raw records: (path, pos, bad, rec)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    @property
    def program(self) -> Program:
        return cloudpickle.loads(base64.b64decode(self.options["program"]))

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), *record_fields(self.program)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.program)


class _Reader(DataSourceReader):
    def __init__(self, path: str, program: Program) -> None:
        self.path, self.program = path, program

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(scheme + f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_stream(path) as stream:
            found = ((None, p, r) for p, r in enumerate(records(iter(lambda: stream.read(PIECE), b""), self.program), 1))
            for tags, columns in batches(found, self.program):
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(tags)), *columns], names=["path", "pos", "bad", "rec"])
