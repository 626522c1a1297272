"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, stored

#: So many links at most (2 MB) are joined by one task, in one step; more of them in rounds over all tasks.
FEW_LINKS = 1 << 17


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable from node, a long, for each node of links(a, b).

    Few links are joined by one task: rounds would take a hundred jobs, which cost time and the driver's memory. Else:
    large-star and small-star rounds (Kiveris et al., 2014) with minima and joins instead of lists of neighbours: no task
    holds a node's links. Minima are written before they are joined, so the join of a node with very many links is one that
    Spark can split. The number of rounds grows with the logarithm of the longest path. Every round is written to the
    shared folder, and dropped once the next one is.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if edges.df.count() <= FEW_LINKS:
        out = stored(edges.df.coalesce(1).mapInArrow(_joined, "node long, root long"))
        edges.drop()
        return out.df
    while True:
        large = _large_star(edges.df)
        small = _small_star(large.df)
        large.drop()
        changed = small.df.join(edges.df, ["u", "v"], "left_anti").limit(1).count() or edges.df.join(small.df, ["u", "v"], "left_anti").limit(1).count()
        edges.drop()
        edges = small
        if not changed:
            break
    return edges.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.df.select(F.col("v"), F.col("v")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (u, v): the two roots of a link take the smaller of them, until no link has two."""
    held = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for b in batches if b.num_rows]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def _large_star(edges: DataFrame) -> Stored:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = stored(both.filter("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
    least.drop()
    return out


def _small_star(edges: DataFrame) -> Stored:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    out = stored(edges.join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.df.select("u", F.col("m").alias("v"))).distinct())
    least.drop()
    return out
