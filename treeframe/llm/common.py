"""Helpers that the operators share: written tables and who deletes them, let-bindings, numbering, and the word rule."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"

#: A side of a join with so many rows at most, each with so few bytes, is broadcast once it has been counted (16 MB).
FEW_ROWS, FEW_BYTES = 1 << 17, 128
#: Else rows of one key are dealt to so many tasks.
SALTS = 64

_local_root: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one stands in where none is set, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_root:
        _local_root.append("file://" + tempfile.mkdtemp(prefix="treeframe-"))
    return _local_root[0]


class Scratch:
    """Tables that one piece of work writes, in a database of its own in the shared folder. close() drops them all."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.name, self.count, self.open, self.inside = spark, f"treeframe_{uuid.uuid4().hex}", 0, False, []

    def write(self, df: DataFrame, buckets: int | None = None, by: str | None = None) -> Stored:
        if not self.open:
            self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_folder(self.spark)}/{self.name}'")
            self.open = True
        self.count += 1
        name = f"{self.name}.t{self.count}"
        out = df.write.format("parquet")
        (out.bucketBy(buckets, by) if buckets else out).saveAsTable(name)
        return Stored(name, self.spark.table(name))

    def close(self) -> None:
        for s in self.inside:
            s.close()
        if self.open:
            self.open = False
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")


@dataclass
class Stored:
    """A written table; whoever wrote it drops it once nothing reads it any more, or leaves that to its Scratch."""

    name: str
    df: DataFrame

    def drop(self) -> None:
        self.df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


_current: ContextVar[Scratch | None] = ContextVar("scratch", default=None)
_unowned: dict[SparkSession, Scratch] = {}


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[Scratch]:
    """Operators called inside write their tables to one Scratch, which is closed at the end.

    Results are lazy and may read these tables: write or collect them before the block ends. Tables of calls outside of
    any block stay until the Python process ends. One to keep stays open until its owner or the block around closes it.
    """
    own = Scratch(spark)
    if keep:
        _around(spark).inside.append(own)
    token = _current.set(own)
    try:
        yield own
    finally:
        _current.reset(token)
        if not keep:
            own.close()


def _around(spark: SparkSession) -> Scratch:
    own = _current.get()
    return _unowned.setdefault(spark, Scratch(spark)) if own is None else own


@atexit.register
def _close_unowned() -> None:
    for s in _unowned.values():
        with contextlib.suppress(Exception):  # the session may have ended before
            s.close()


def stored(df: DataFrame, buckets: int | None = None, by: str | None = None) -> Stored:
    """df written as a table of the current Scratch: the lineage ends there.

    Lost executors cost no recomputation beyond their own tasks, and later readers see the same rows even where df is not
    deterministic (row numbers, shuffle order).
    """
    return _around(df.sparkSession).write(df, buckets, by)


def table(df: DataFrame) -> DataFrame:
    """As stored(), for tables that stay as long as their Scratch."""
    return stored(df).df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def row(docs: DataFrame) -> Column:
    """All columns of docs as one struct named row: helper columns beside it can't clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def free(docs: DataFrame, *names: str) -> None:
    """Raises ValueError if docs has a column named like one of a result's: it would be replaced."""
    have = {c.lower() for c in docs.columns}
    if clash := [c for c in names if c.lower() in have]:
        raise ValueError(f"the input already has columns named like results: {', '.join(clash)}; rename them first")


def unpacked(docs: DataFrame, changed: dict[str, Column] | None = None, **added: Column) -> list[Column]:
    """The columns of docs out of a row struct, in their order, with some changed, and others added after them.

    An added column never replaces one of docs: if docs has one of that name, ValueError says so.
    """
    changed = changed or {}
    free(docs, *added)
    own = [(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns]
    return own + [v.alias(k) for k, v in added.items()]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digests(columns: list[Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes over the values of columns, nulls and their places included."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *marked)


def hashable(docs: DataFrame) -> list[Column]:
    """The columns of docs, those with maps inside as JSON, so that each can be hashed."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.NullType, T.VariantType))]


def numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows, each with its number 0, 1, ... among the rows of its key, in no particular order.

    Only rows whose key stands twice or more are dealt out, by key and by the input partition that a row is in: one key may
    hold a third of all rows and still no task counts more than a partition's. Keys are not null, and rows must be the same
    when read twice, in whatever partitions.
    """
    rows = rows.withColumn("_pid", F.spark_partition_id())
    more = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    if more.df.isEmpty():
        more.drop()
        return rows.drop("_pid").withColumn(name, F.lit(0).cast("long"))
    # Written once: a second reading of the input could be cut into other partitions.
    local = F.row_number().over(Window.partitionBy(*key, "_pid").orderBy(F.lit(0)))
    again = table(rows.join(more.df, key, "left_semi").withColumn("_local", local))
    counts = again.groupBy(*key, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    base = table(counts.select(*key, "_pid", (F.sum("_n").over(by) - F.col("_n")).alias("_base")))
    again = again.join(base, [*key, "_pid"]).withColumn(name, F.col("_base") + F.col("_local") - 1)
    once = rows.join(more.df, key, "left_anti").withColumn(name, F.lit(0).cast("long"))
    columns = [*(c for c in rows.columns if c != "_pid"), name]
    return once.select(*columns).union(again.select(*columns))


def met(rows: DataFrame, few: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with few, a written table with one row for each key, by one column that both have.

    Up to FEW_ROWS rows of few are broadcast, which moves no row of rows. Beyond that, rows are dealt by key and by one of
    SALTS numbers from their own hash, and few is repeated for each: a key that holds a third of all rows is no single task.
    """
    if few.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return rows.join(F.broadcast(few), key, how)
    salt = F.pmod(F.xxhash64(*hashable(rows)), F.lit(SALTS)).cast("int")
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(spread, [key, "_salt"], how).drop("_salt")
