"""Records out of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.extract import extract
from ..plans.spec import Record

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, spec: Record | type, max_files: int | None = None, **how) -> DataFrame:
    """A stream of the records in files that arrive under path, with `path` kept.

    Extraction keeps no state, so watermarks, windows and sinks are the caller's and Spark's. max_files bounds a batch.
    """
    source = spark.readStream.format("binaryFile").schema(_BINARY)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    return extract(source.load(path), spec, "content", keep=["path"], **how)
