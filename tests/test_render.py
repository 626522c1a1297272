"""Documents of orders: the same texts however rows are dealt, and no table of bodies sent to every task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeframe.render import LINE_ORDER, _assembled, order_docs


def test_keys_over_batches():
    """Runs of a key end anywhere; orders without lines, lines without an order, repeated and null keys."""
    rows = [(None, 0, "n"), (None, 0, "m"), (0, 0, "a"), (1, 0, "b"), (1, 1, "1"), (1, 1, "2"), (2, 1, "x"), (3, 0, "c"), (3, 0, "d"), (3, 1, "3"), (3, 1, None), (3, 1, "4"), (4, 0, "e")]
    want = [(None, "n[]"), (None, "m[]"), (0, "a[]"), (1, "b[12]"), (3, "c[34]"), (3, "d[34]"), (4, "e[]")]
    for size in range(1, len(rows) + 1):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        numbers = [1, 2, 1, 1, 1, 2, 1, 1, 2, 1, 2, 3, 1]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in p], pa.int64()), pa.array([bool(x) for _, x, _ in p]), pa.array(numbers[i * size : i * size + len(p)], pa.int32()), pa.array([None if x else t + "[" for _, x, t in p], pa.string()), pa.array([None if x else "]" for _, x, _ in p], pa.string()), pa.array([t if x else None for _, x, t in p], pa.string())], names=["l_orderkey", "_line", "ord", "_p0", "_p1", "_b_body"]) for i, p in enumerate(parts)]
        assert [(r["doc_id"], r["content"]) for b in _assembled(iter(batches), ["body"]) for r in b.to_pylist()] == want


@pytest.fixture
def tables(spark, tmp_path):
    orders = [(k, k, "O", 1.5 * k) for k in range(1, 40)] + [(7, 7, "F", 2.0), (None, 1, "P", 3.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").withColumn("o_orderdate", F.lit("2020-01-02").cast("timestamp_ntz")).withColumn("o_orderpriority", F.lit("1")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(300).select((F.col("id") % 45).alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), *[F.col("id").alias(c) for c in LINE_ORDER[1:3]], *[F.col("id").cast("double").alias(c) for c in LINE_ORDER[3:7]], F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit("2020-01-02").cast("timestamp_ntz").alias("l_shipdate"))
    lines.union(lines.limit(3).withColumn("l_orderkey", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_documents(spark, tables):
    out = order_docs(spark, tables, "<{o_orderkey}>{odd}|{body}{body}</>", body="{ord}:{l_partkey},", odd=("{l_partkey},", F.col("l_partkey") % 2 == 1))
    want = []
    rows = [(i % 7, i, i % 45) for i in range(300)]
    for k in [*range(1, 40), 7, None]:
        mine = [i for _, i, o in sorted(rows) if o == k]
        body = "".join(f"{n}:{i}," for n, i in enumerate(mine, 1))
        want.append((k, f"<{'' if k is None else k}>{''.join(f'{i},' for i in mine if i % 2)}|{body}{body}</>"))
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))


def test_lines_without_numbers(spark, tables):
    """Rows are sorted also where no template has {ord}."""
    rows = sorted((i % 7, i, i % 45) for i in range(300))
    want = {k: "".join(f"{i}," for _, i, o in rows if o == k) for k in range(1, 40)}
    assert {r.doc_id: r.content for r in order_docs(spark, tables, "{body}", body="{l_partkey},").filter("doc_id IS NOT NULL").collect()} == want


def test_bodies_are_not_broadcast(spark, tables):
    """Their size was judged by the file's, and up to 10 MB of that all orders' texts went through the driver, and orders were one task a file."""
    plan = order_docs(spark, tables, "<o>{body}</o>", body="{ord}")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 1
