"""Sharding: an external shuffle in two passes.

The first pass scatters the rows, whole, into memory-sized buckets by a seeded hash. The second shuffles each bucket in
memory (Fisher-Yates) and writes it. Bucket after bucket, the shuffled rows are one random order of the table; rank r
of that order goes to shard r mod n, slot r div n, so shards differ by at most one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digests, free, hashable, numbered, read, row, table, unpacked

#: There are so many buckets or fewer as long as none need hold more than BUCKET_BYTES of text; none is made smaller than LEAST_BYTES.
BUCKETS, LEAST_BYTES, BUCKET_BYTES = 4096, 8 << 20, 512 << 20
#: A bucket holds at most so many rows on average, however short they are.
BUCKET_ROWS = 1 << 20
#: Rows handed on at a time after a bucket's shuffle.
BATCH = 4096


def n_buckets(rows: int, size: int) -> int:
    """How many buckets a table of so many rows and bytes is scattered into. Nothing else decides it, so reruns agree on any cluster."""
    each = min(max(size // BUCKETS, LEAST_BYTES), BUCKET_BYTES)
    return max(math.ceil(size / each), math.ceil(rows / BUCKET_ROWS), 1)


def _shuffle(seed: int, bucket: str = "_bucket", order: tuple[str, ...] = ("_h", "_h2")):
    """Rows come sorted by bucket; each bucket leaves in a random order of its own, with its places 0, 1, ... in _place."""

    def shuffled(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        b = t.column(bucket)[0].as_py()
        # Rows arrive as the network brings them: first in the order of their hashes, so reruns agree.
        start = np.lexsort([t.column(c).to_numpy() for c in reversed(order)])
        place = np.random.Generator(np.random.PCG64([seed, b])).permutation(t.num_rows)
        for at in range(0, t.num_rows, BATCH):
            part = t.take(pa.array(start[place[at : at + BATCH]])).append_column("_place", pa.array(np.arange(at, min(at + BATCH, t.num_rows))))
            yield from part.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            ids = b.column(b.schema.get_field_index(bucket)).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))).tolist() if len(ids) else []
            for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if held and held[-1].column(b.schema.get_field_index(bucket))[0].as_py() != ids[i]:
                    yield from shuffled(held)
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from shuffled(held)

    return run


def shuffle_shards(docs: DataFrame, n_shards: int = 16, text: str = "text", seed: int = 7) -> DataFrame:
    """docs with _shard (0 to n_shards - 1) and _slot (0, 1, ... in each shard, without gaps), in the order of a random shuffle.

    Counts of shards differ by one row at most. A row's bucket comes from a hash of all its columns, and of its number among the
    rows that are equal in all of them: whatever many rows share, they are spread over the buckets. Such equal rows are
    interchangeable, so reruns give the same shards and slots, however the rows are dealt to partitions. Nulls hash like
    values. An empty table gives an empty one. Columns of docs stay as they are; one named _shard or _slot is an error.
    docs must give the same rows when read twice, as a table does.
    """
    free(docs, "_shard", "_slot")
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    buckets = n_buckets(n, size or 0)
    a, b = digests(hashable(docs))
    rows = numbered(docs.select(row(docs), a.alias("_a"), b.alias("_b")), ["_a", "_b"], "_copy")
    h = F.xxhash64(F.lit(seed), "_a", "_copy")
    rows = rows.select("row", h.alias("_h"), F.xxhash64("_b", "_copy").alias("_h2"), F.pmod(h, F.lit(buckets)).cast("int").alias("_bucket"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # a row for each bucket
    offsets = table(counts.select(F.col("_bucket").alias("_b"), (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset")))
    schema = T.StructType([*rows.schema.fields, T.StructField("_place", T.LongType())])
    # A partition for each bucket: dealt by a hash of its number, several buckets would fall to one task.
    out = rows.repartitionById(buckets, F.col("_bucket")).sortWithinPartitions("_bucket").mapInArrow(_shuffle(seed), schema)
    offsets = F.broadcast(offsets) if buckets <= 1 << 18 else offsets  # 4 MB at most, else a join
    out = out.join(offsets, out["_bucket"] == offsets["_b"]).withColumn("_rank", F.col("_offset") + F.col("_place"))
    return out.select(*unpacked(docs, _shard=F.pmod("_rank", F.lit(n_shards)).cast("int"), _slot=F.floor(F.col("_rank") / n_shards)))


def write_shards(docs: DataFrame, path: str, **how) -> DataFrame:
    """Writes the shards as Parquet, a folder for each; within a file the rows are in the order of their slots."""
    shuffle_shards(docs, **how).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op7_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shuffle_shards() of all documents into 16 shards, under the law `rows`."""
    out = shuffle_shards(read(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
