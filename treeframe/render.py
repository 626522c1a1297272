"""Documents made from the driver's tables, for the queries, tests and the bench: the engine then reads the rows back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of an order's lines; (l_orderkey, l_linenumber) is not unique.
LINE_ORDER = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml(template: str, values: Mapping[str, Column] | None = None) -> Column:
    """The template with {column}s filled in; {column:e} is escaped first. A null column is the empty text."""
    parts = []
    for i, x in enumerate(re.split(r"(\{\w+(?::e)?\})", template)):
        if i % 2 == 0:
            parts += [F.lit(x)] if x else []
            continue
        name, _, how = x[1:-1].partition(":")
        value = F.coalesce((values or {}).get(name, F.col(name)).cast("string"), F.lit(""))
        parts.append(escaped(value) if how else value)
    return F.concat(*parts)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(parts: Column) -> Column:
    """The texts of an array of (place, text), in order, as one."""
    return F.array_join(F.transform(F.array_sort(parts), lambda e: e["x"]), "")


def order_docs(spark: SparkSession, sf_dir: str, doc: str, values: Mapping[str, Column] | None = None, **bodies: str | tuple[str, Column]) -> DataFrame:
    """(doc_id, content): a document for each order, with the columns of orders and, under its own name, each body:

    a template for every line of the order (or for those that meet a condition), in the lines' order. Orders and lines are
    dealt by order together, once: sorted, an order's lines come right after it, and are put into it where they are.
    """
    orders = read(spark, sf_dir, "orders").withColumn("o_day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    if not bodies:
        return orders.select(F.col("o_orderkey").alias("doc_id"), xml(doc, values).alias("content"))
    around = re.split("|".join(rf"\{{({n})\}}" for n in bodies), doc)
    around = [x for x in around if x is not None]  # templates of orders, with the name of a body between any two
    texts = {n: how if isinstance(how, tuple) else (how, F.lit(True)) for n, how in bodies.items()}
    key = orders.schema["o_orderkey"]
    lines = read(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").withColumn("l_orderkey", F.col("l_orderkey").cast(key.dataType)).withColumn("_line", F.lit(True))
    heads = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(False).alias("_line"), *[(xml(x, values) if x else F.lit("")).alias(f"_p{k}") for k, x in enumerate(around[::2])])
    # The window sorts; ord goes with the rows, as a window that nothing reads would be left out, and the sort with it.
    order = Window.partitionBy("l_orderkey", "_line").orderBy(*LINE_ORDER)
    both = heads.unionByName(lines, allowMissingColumns=True).repartition("l_orderkey").withColumn("ord", F.row_number().over(order))
    parts = both.select("l_orderkey", "_line", "ord", *[c for c in heads.columns if c.startswith("_p")], *[F.when(F.col("_line") & when, xml(x, values)).alias(f"_b_{n}") for n, (x, when) in texts.items()])
    return parts.mapInArrow(lambda batches: _assembled(batches, around[1::2]), T.StructType([T.StructField("doc_id", key.dataType), T.StructField("content", T.StringType())]))


def _runs(keys: pa.Array) -> np.ndarray:
    """Where a row's key is another than that of the row before."""
    k, null = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero((k[1:] != k[:-1]) | (null[1:] != null[:-1])) + 1


def _assembled(batches: Iterator[pa.RecordBatch], bodies: list[str]) -> Iterator[pa.RecordBatch]:
    """Documents from rows by key, those of orders before those of lines: bodies name what stands between the orders' parts."""
    open_: list[pa.RecordBatch] = []  # rows of the last key, which may go on in the next batch
    for b in batches:
        if not b.num_rows:
            continue
        begins = _runs(b.column(0))
        if open_ and b.column(0)[0] != open_[-1].column(0)[0]:
            yield _documents(open_, bodies)
            open_ = []
        if len(begins):
            yield _documents([*open_, b.slice(0, begins[-1])], bodies)
            open_, b = [], b.slice(begins[-1])
        open_.append(b)
    if open_:
        yield _documents(open_, bodies)


def _documents(rows: list[pa.RecordBatch], bodies: list[str]) -> pa.RecordBatch:
    b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    begins = _runs(b.column(0))
    run = np.zeros(b.num_rows, np.int64)
    run[begins] = 1
    run = run.cumsum()
    line, ord_ = b.column("_line").to_numpy(zero_copy_only=False), b.column("ord").to_numpy()
    first = np.append(True, (run[1:] != run[:-1]) | (line[1:] != line[:-1]))
    if (np.where(first, 0, np.append(0, ord_[:-1])) + 1 != ord_).any():
        raise ValueError("rows are not in the order of their numbers")
    lines, heads = b.filter(pa.array(line)), b.filter(pa.array(~line))
    ends = pa.array(np.searchsorted(run[line], np.arange(len(begins) + 2)), pa.int32())
    of = pa.array(run[~line])
    whole = {n: pc.binary_join(pa.ListArray.from_arrays(ends, lines.column(f"_b_{n}").fill_null("")), "").take(of) for n in dict.fromkeys(bodies)}
    content = [heads.column("_p0")]
    for k, n in enumerate(bodies, 1):
        content += [whole[n], heads.column(f"_p{k}")]
    return pa.RecordBatch.from_arrays([heads.column(0), pc.binary_join_element_wise(*content, "")], names=["doc_id", "content"])


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; on a local master, where none may be set, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="treeframe-")
    return f"{root}/treeframe-{uuid.uuid4().hex}"
