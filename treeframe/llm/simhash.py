"""SimHash near-duplicates: fingerprints, an anchor-point covering, and components of their links.

Two fingerprints with 3 or fewer differing bits differ in at most one bit in one of their two halves of 32 bits.
The anchors of a half are the words whose first 31 bits are a codeword of the Hamming code of length 31 (any last
bit): a perfect code, so each half is within 1 bit of one anchor, its home. A fingerprint is replicated to every
anchor within 1 + 1 = 2 bits, at most 17 for a half. Two halves that differ in one bit therefore meet at the home of
either, and only fingerprints that meet a fingerprint at home there are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alike import alike
from .common import read, row, table, unpacked
from .components import components

MAX_BITS = 3
#: Words of a text that are hashed at a time.
CHUNK = 1 << 16
#: Fingerprints at home in one anchor beyond which its comparisons are dealt to several tasks.
HOT_HOMES = 4096
#: Comparisons made at a time.
CELLS = 1 << 22

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = np.uint32(1) << np.arange(31, dtype=np.uint32)
_CHECKS = [np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)) for j in range(5)]


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, many at a time; bytes.split() has the same white space as the contract."""
    if len(text) < 8 * CHUNK:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = min(len(text), at + 8 * CHUNK)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's 3-word shingles, as an unsigned number."""
    hashes = xxhash.xxh64_intdigest
    ones, n, last = np.zeros(64, np.int64), 0, []
    for more in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        last += more
        if len(last) < 3:
            continue
        joined = b" ".join(last)
        ends = np.cumsum(np.fromiter(map(len, last), np.int64, len(last)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        h = np.fromiter([hashes(joined[i:j], 42) for i, j in zip(begins[:-2].tolist(), ends[2:].tolist(), strict=True)], np.uint64, len(last) - 2)
        by = h.view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(by[:, k], minlength=256) @ _BITS for k in range(8)])
        n += len(h)
        last = last[-2:]
    if not n:
        return hashes(b" ".join(last), 42) if last else 0
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)) * (2 * ones > n).astype(np.uint64)).sum())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def homes_and_probes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, at home): a row for each anchor near each half of each fingerprint."""
    index, anchors, home = [], [], []
    i = np.arange(len(fp))
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)).astype(np.uint32)
        word, spare = x & np.uint32(0x7FFFFFFF), x & np.uint32(0x80000000)
        s = sum(((np.bitwise_count(word & c) & 1).astype(np.int64) << j for j, c in enumerate(_CHECKS)), np.zeros(len(fp), np.int64))
        own = np.where(s > 0, word ^ _PLACE[np.maximum(s, 1) - 1], word).astype(np.uint32)
        name = lambda w, top, h=half: (w | top).astype(np.int64) | np.int64(h) << 32
        index += [i, i]
        anchors += [name(own, spare), name(own, spare ^ np.uint32(0x80000000))]
        home += [np.ones(len(fp), bool), np.zeros(len(fp), bool)]
        for p in range(1, 32):  # pairs of places whose numbers give the syndrome, each once
            q = s ^ p
            ok = (s > 0) & (q > p)
            index.append(i[ok])
            anchors.append(name(word[ok] ^ _PLACE[p - 1] ^ _PLACE[q[ok] - 1], spare[ok]))
            home.append(np.zeros(int(ok.sum()), bool))
    return np.concatenate(index), np.concatenate(anchors), np.concatenate(home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1 << 14):
            fp = b.column(0).slice(at, 1 << 14).to_numpy(zero_copy_only=False).view(np.uint64)
            i, anchor, home = homes_and_probes(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(fp[i].view(np.int64))], ["anchor", "home", "fp"])


def forest(fp: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Links (rows of two fingerprints) that join what the comparisons of one anchor join, without repeats.

    Each fingerprint at home is compared with all. Of the links found, a spanning forest is kept: in number at most
    the fingerprints, though in a group of near copies nearly all pairs are links.
    """
    h = fp[home]
    parent = np.arange(len(h))
    links = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    step = max(1, CELLS // max(1, len(h)))
    for at in range(0, len(fp), step):
        part = fp[at : at + step]
        near = np.bitwise_count(h[:, None] ^ part[None, :]) <= MAX_BITS
        first = near.argmax(axis=0)
        some = near.any(axis=0)
        links.append(np.stack([part[some], h[first[some]]], axis=1))
        rows, cols = np.nonzero(near)
        for pair in np.unique(first[cols] * len(h) + rows).tolist():
            a, b = root(pair // len(h)), root(pair % len(h))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append(np.array([[h[a], h[b]]], np.uint64))
    out = np.concatenate(links) if links else np.empty((0, 2), np.uint64)
    return out[out[:, 0] != out[:, 1]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, part, home, fp) come sorted by (anchor, part); a group may go on over many batches, and is put together once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None

    def links() -> Iterator[pa.RecordBatch]:
        home, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if len(fp) > 1 and home.any() and len(x := np.unique(forest(fp, home), axis=0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    for b in batches:
        anchor, part, home, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        home, fp = home.astype(bool), fp.view(np.uint64)
        cuts = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))).tolist() if len(fp) else []
        for i, j in zip(cuts, [*cuts[1:], len(fp)], strict=True):
            if held and last != (anchor[i], part[i]):
                yield from links()
            last = (anchor[i], part[i])
            held.append((home[i:j], fp[i:j]))
    if held:
        yield from links()


def near_links(fps: DataFrame, hot_homes: int = HOT_HOMES) -> DataFrame:
    """(a, b): links between different fingerprints of fps(fp) that connect all those with MAX_BITS or fewer differing bits.

    The fingerprints of an anchor with very many at home are dealt to n parts: each of n * n tasks compares one part, as those at
    home, with another, as those near. No task holds more than two parts.
    """
    fps = fps.select("fp").distinct()
    rows = fps.mapInArrow(_replicate, "anchor long, home boolean, fp long")
    hot = rows.filter("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_homes)
    hot = table(hot.select("anchor", F.ceil(F.col("n") / hot_homes).cast("int").alias("n")))
    if hot.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("n").cast("long"))
        every = F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)
        near = F.transform(every, lambda i: F.struct((i * F.col("n") + own).alias("part"), F.lit(False).alias("home")))
        at_home = F.transform(every, lambda j: F.struct((own * F.col("n") + j).alias("part"), F.lit(True).alias("home")))
        alone = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.col("home").alias("home")))
        dealt = F.when(F.col("n").isNull(), alone).when(F.col("home"), F.concat(near, at_home)).otherwise(near)
        rows = rows.join(hot, "anchor", "left").select("anchor", "fp", F.explode(dealt).alias("x")).select("anchor", "x.part", "x.home", "fp")
    rows = rows.select("anchor", "part", "home", "fp").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return rows.mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Documents are linked if their fingerprints differ in 3 or fewer bits; component_id is the smallest doc_id that
    links reach. Null and empty texts have the fingerprint zero and are linked like any others. Equal texts are one
    fingerprint: they are never paired. A row with a null doc_id gets its component's id (null if none has one).
    Repeated rows each give a row. Other columns of docs play no part, whatever their names.

    With a similarity, texts of that Jaccard similarity of 5-word shingles or more are linked too, see alike(); doc_id is
    then a long that no two rows share.
    """
    rows = table(fingerprints(docs, doc_id, text))
    links = near_links(rows)
    if similarity is not None:
        more = alike(docs.select(F.col(doc_id).alias("uid"), F.col(text).alias("text")), similarity)
        for end in ("a", "b"):
            more = more.join(rows.select(F.col("doc_id").alias(end), F.col("fp").alias(f"fp_{end}")), end)
        links = links.union(more.filter("fp_a <> fp_b").select("fp_a", "fp_b"))
    roots = components(links)
    # What is joined is written before: then a fingerprint of very many rows, or a component of very many fingerprints, is split.
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = table(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = table(least.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = table(least.join(ids, "root").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents, by their fingerprints alone."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def dedup_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (nulls last), of equal ids the first row. Columns as they were.

    Components are those of near_duplicates(), with its similarity.
    """
    rows = table(docs.select(row(docs), F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("uid")))
    found = near_duplicates(rows.select("uid", F.col("row")[text].alias("text")), "uid", "text", similarity).select(F.col("doc_id").alias("uid"), "component_id")
    order = F.struct(F.col("id").isNull(), "id", "uid")
    kept = rows.select("uid", "id").join(found, "uid").groupBy("component_id").agg(F.min_by("uid", order).alias("uid")).select("uid")
    return rows.join(kept, "uid", "left_semi").select(*unpacked(docs))
