"""Exact top-k by inner product with vector-approximation files.

Vectors equal in all components are one entry, with the smallest ids of its rows: no more of them can be among the best k.
Every entry is kept twice: exact, and as cells of one byte for each component, which are its components divided by a width that all
vectors of one length share. For a query q and an entry in cells c of width w the score lies between w q.c + (w - 1) min-part(q)
and w q.c + (w - 1) max-part(q), so one product with the cells bounds it from both sides.

The scan reads cells only, in blocks: a block of cells and a block of queries give, for each query, the entries whose
upper bound reaches the k-th highest lower bound of the block. Of these, what reaches the k-th highest lower bound of all
blocks is left. Exact vectors are then read in the order of the bounds: first those of the best k, and, once these have shown
the k-th score, those whose bound still reaches it. What is not read has a score that is certain to be too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, table

#: Components are multiplied by this and rounded down to integers.
SCALE = 1024
#: Entries and queries of a block.
BLOCK = 4096
QUERIES = 512
#: Pairs of blocks are dealt to so many tasks at most.
MOST_TASKS = 20_000
#: Cells on each side of zero: a cell is one byte.
CELLS = 128


def quantise(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(uid, id, ask, dim, v): integer vectors. Rows without an id, and vectors null, empty or with a component that is no finite number, are left out."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("ask"), v.alias("x")).filter("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    finite = F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return rows.filter(finite).select(F.monotonically_increasing_id().alias("uid"), "id", "ask", F.size("x").alias("dim"), F.transform("x", lambda y: F.floor(y * scale).cast("long")).alias("v"))


def _pack(size: int):
    """Rows (dim, part, entry, bytes), sorted by dim and part, as blocks of at most `size` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, cells = None, [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([b"".join(cells)])], ["dim", "part", "entries", "bytes"])
            ids.clear()
            cells.clear()
            return out

        for b in batches:
            for dim, part, entry, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (key != (dim, part) or len(ids) >= size):
                    yield flush()
                key = (dim, part)
                ids.append(entry)
                cells.append(raw)
        if ids:
            yield flush()

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, entry, width, v) as (dim, entry, cells, exact): bytes of int8 and of int64."""
    for b in batches:
        v = [np.asarray(x, np.int64) for x in b.column(3).to_pylist()]
        w = b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([np.floor_divide(x, y).astype(np.int8).tobytes() for x, y in zip(v, w, strict=True)], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())], ["dim", "entry", "cells", "exact"]
        )


def blocks(rows: DataFrame, content: str, size: int, n: int) -> DataFrame:
    """(dim, block, entries, bytes): rows(dim, entry, content) scattered into blocks of some `size` rows of one length.

    n is the number of rows, from which that of parts follows; blocks have numbers of their own.
    """
    parts = max(1, -(-n // size))
    dealt = rows.select("dim", F.pmod(F.xxhash64("entry"), F.lit(parts)).alias("part"), "entry", F.col(content).alias("bytes"))
    packed = dealt.repartition(parts, "dim", "part").sortWithinPartitions("dim", "part").mapInArrow(_pack(size), "dim int, part long, entries binary, bytes binary")
    return table(packed.select("dim", F.monotonically_increasing_id().alias("block"), "entries", "bytes"))


def bounds(q: np.ndarray, cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(mid, slack): the score of query i and entry j is within slack[i] of mid[i, j].

    With v = w c + r and 0 <= r <= w - 1, q.v is w q.c plus at least (w - 1) times q's negative parts and at most its positive
    ones: half of (w - 1) times the sum of q is the middle, half of (w - 1) times that of its absolute values the slack, to
    which comes what sums of 32-bit floats can be off.
    """
    scan = q.astype(np.float32) @ cells.astype(np.float32).T
    size = np.abs(q).sum(axis=1).astype(np.float64)
    off = (cells.shape[1] + 4) * 2.0**-23 * CELLS * size
    return width * scan.astype(np.float64) + (width - 1) / 2 * q.sum(axis=1)[:, None], (width - 1) / 2 * size + width * off + 1


def _scan(k: int):
    """A block of queries against a block of cells: the entries whose upper bound reaches the k-th lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                asked, entries = np.frombuffer(r["asked"], np.int64), np.frombuffer(r["entries"], np.int64)
                q = np.frombuffer(r["queries"], np.int64).reshape(-1, r["dim"])
                mid, slack = bounds(q, np.frombuffer(r["bytes"], np.int8).reshape(-1, r["dim"]), r["width"])
                n = min(k, len(entries))
                kth = np.partition(mid, len(entries) - n, axis=1)[:, len(entries) - n]
                i, j = np.nonzero(mid >= (kth - 2 * slack)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(entries[j]), pa.array(mid[i, j] - slack[i]), pa.array(mid[i, j] + slack[i])], ["query", "entry", "lo", "hi"])

    return run


def _highest(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows(query, entry, ...) of each query that are highest in a column; each task sends on k rows of a query at most."""
    order = Window.partitionBy("query").orderBy(F.col(by).desc(), "entry")
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def top_k(vectors: DataFrame, asks: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors that asks, the k best of all other rows, or all if there are fewer.

    asks is a condition on vectors. Components become floor(scale * x); the score is the inner product of integers and ties go to
    the smaller id. A row is no candidate for itself; a repeated row is a query and a candidate of its own. Vectors of another
    length than the query's don't meet it. Vectors that are null, empty, or hold null or non-finite components, and rows
    without an id, take no part. Scores must fit 63 bits. Other columns play no part.
    """
    base = table(quantise(vectors, asks, vec_id, vector, scale))
    # One more than k of each entry's rows: one of them may be the query itself.
    first = F.row_number().over(Window.partitionBy("v").orderBy("id", "uid"))
    rows = base.select("uid", "id", "dim", "v", first.alias("r")).filter(F.col("r") <= k + 1)
    groups = rows.groupBy("v").agg(F.min("uid").alias("entry"), F.min("dim").alias("dim"), F.collect_list(F.struct("id", "uid")).alias("members"))
    groups = table(groups)
    most = groups.groupBy("dim").agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most"))
    widths = table(most.select("dim", F.ceil((F.col("most") + 1) / CELLS).cast("long").alias("width")))
    asking = table(base.filter("ask").select("uid", "id", "v").join(groups.select("v", "entry"), "v").select("uid", "id", "entry"))
    file = groups.join(widths, "dim").select("dim", "entry", "width", "v").mapInArrow(_cells, "dim int, entry long, cells binary, exact binary")
    queries = file.join(asking.select("entry").distinct(), "entry", "left_semi")
    cells = blocks(file, "cells", block, groups.count())
    asked = blocks(queries, "exact", query_block, max(1, queries.count()))
    # Every block of cells meets every block of queries of its length: the query set against all rows, in blocks. Pairs of
    # numbers are made first, a row of the numbers of query blocks for each length; each then fetches its two blocks.
    numbers = asked.groupBy("dim").agg(F.collect_list("block").alias("asked_block"))
    pairs = cells.select("dim", "block").join(numbers, "dim").select("dim", "block", F.explode("asked_block").alias("asked_block"))
    tasks = max(1, min(cells.count() * asked.count(), MOST_TASKS))
    pairs = pairs.repartition(tasks, "asked_block", "block").join(asked.select(F.col("block").alias("asked_block"), F.col("entries").alias("asked"), F.col("bytes").alias("queries")), "asked_block")
    met = pairs.join(cells.drop("dim"), "block").join(widths, "dim").select("dim", "width", "asked", "queries", "entries", "bytes")
    # An entry more than k: the query's own may be among them with no other row.
    # A query that very many entries may reach is no single task: only its best k + 1 rows are ranked, the others are joined with the k-th.
    found = table(met.mapInArrow(_scan(k + 1), "query long, entry long, lo double, hi double"))
    near = found.join(table(_highest(found, "lo", k + 1).groupBy("query").agg(F.min("lo").alias("least"))), "query").filter("hi >= least").select("query", "entry", "hi")
    near = table(near)
    exact = groups.select("entry", "v")

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(exact, "entry").join(exact.select(F.col("entry").alias("query"), F.col("v").alias("q")), "query")
        return both.select("query", "entry", F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x).alias("score"))

    head = table(scored(_highest(near, "hi", k + 1).select("query", "entry")))
    rest = near.join(head.groupBy("query").agg(F.min("score").alias("kth")), "query").filter("hi >= kth").join(head.select("query", "entry"), ["query", "entry"], "left_anti")
    scores = head.union(scored(rest.select("query", "entry")))
    best = scores.join(groups.select("entry", "members"), "entry").select("query", "score", F.explode("members").alias("m"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "m.id", "m.uid")
    best = table(best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy(F.col("query").alias("entry")).agg(F.sort_array(F.collect_list(F.struct("r", "score", "m"))).alias("best")))
    mine = F.slice(F.filter("best", lambda x: x["m"]["uid"] != F.col("uid")), 1, k)
    answers = asking.join(best, "entry").select(F.col("id").alias("query_id"), F.posexplode(mine).alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.m.id").alias("vec_id"), F.col("x.score").alias("score"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k() with k = 10 for the rows whose vec_id is divisible by 100, against all rows."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT u, vec_id, len(v) AS dim, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.u AS qu, q.vec_id AS query_id, e.u, e.vec_id, sum(q.x * e.x)::BIGINT AS score FROM e q JOIN e ON q.i = e.i AND q.dim = e.dim AND q.u <> e.u WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qu ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
