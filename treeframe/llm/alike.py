"""Links between texts by the Jaccard similarity of their sets of word shingles: all that are needed to connect what is similar.

Of two sets of similarity t or more, put in one order, the first n - ceil(t n) + 1 shingles of either (n: its size) have one in
common. Only texts that share such a shingle are compared, so none is missed whatever the order is; an order with the frequent
shingles last keeps the groups that share one small. At the first of the shingles that two sets share, all that they share is still
to come: they are compared there only if what is left of either (its room) is enough. Most frequent shingles stand so late that
their sets aren't compared there at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .components import components

SHINGLE = 5
#: Shingles are ordered by how many of some SAMPLE rows have them, the MOST most frequent by their counts and all others first: this moves work, not results.
SAMPLE, MOST = 1 << 15, 1 << 20
#: Bits of a set's marks.
MARKS = 1024
#: Texts that share a shingle beyond which their comparisons are dealt to several tasks.
HOT_ROWS = 4096
#: Comparisons made at a time.
CELLS = 1 << 18
#: Pairs that a text puts forward for one shingle before the nearest of them are looked at and joined.
FEW = 8

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's different shingles, with words as in the fingerprint; none if it has fewer words than a shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter([digest(x) for x in words], np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = _mix(h * _STEP + w[k : k + n])
    return np.unique(h)


def marks(h: np.ndarray, bits: int = MARKS) -> bytes:
    """So many bits, each the parity of the number of shingles that fall on it: two sets differ in as many shingles, or more, as their marks in bits."""
    return np.packbits(np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def possible(n: np.ndarray, m: np.ndarray, bits: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles whose marks differ in these bits can have the similarity; a little too often, never too seldom."""
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) * (1 - 1e-9)) & (bits * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6 * (n + m))


def first(h: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set of which one is in each set of that similarity: its first ones, by their counts (0 unless frequent), then hashes."""
    n = len(h) - int(np.ceil(similarity * len(h) * (1 - 1e-9))) + 1
    if not len(frequent):
        return h[:n]
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return h[np.argsort(np.where(frequent[at] == h, counts[at], 0), kind="stable")[:n]]


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the most frequent shingles of SAMPLE rows, or some more, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                h = np.concatenate([shingles(x.as_py()) for x in b.column(0).slice(at, 64)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["key"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0).select("text").mapInArrow(run, "key long")
    seen = some.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1").orderBy(F.desc("n")).limit(MOST).toArrow()
    key, n = (seen.column(k).to_numpy() for k in ("key", "n"))
    key = key.view(np.uint64)
    order = np.argsort(key)
    return key[order], n[order]


def _signatures(similarity: float, frequent: np.ndarray, counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, digests, sizes, bits, wide, keys = [], [], [], [], [], []
            for uid, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if len(h := shingles(x.as_py())):
                    uids.append(uid)
                    digests.append(np.bitwise_xor.reduce(_mix(h + _STEP)))
                    sizes.append(len(h))
                    bits.append(marks(h))
                    wide.append(marks(h, 1 << (len(h) - 1).bit_length()) if len(h) > MARKS else None)
                    keys.append(first(h, similarity, frequent, counts).view(np.int64))
            columns = [pa.array(uids, pa.int64()), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "digest", "n", "marks", "wide", "keys"])

    return run


def enough(n: np.ndarray, m: np.ndarray, room: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles of which both have so many in common, or fewer, can have the similarity."""
    return room * (1 + similarity) >= similarity * (n + m) * (1 - 1e-9)


def _shared(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (key, id, n, room) sorted by key and n, those whose key another row has whose n and room let the two be similar; of some
    others too. room: how many of the n shingles are the key's or come after it; n where there is no such column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = np.empty((4, 0), np.int64), np.empty(0, bool)  # the last row and the last before it that leads; whether each has been dealt with
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2, min(3, b.num_columns - 1))]
            rows = np.concatenate([held, np.stack(columns)], axis=1)
            key, _, n, room = rows
            # Of two rows the first leads: it has room for a set as large as its own, or larger.
            lead = enough(n, n, room, similarity)
            leader = np.concatenate(([-1], np.maximum.accumulate(np.where(lead, np.arange(len(n)), -1))[:-1]))
            led = (leader >= 0) & (key[leader] == key) & (n[leader] >= similarity * n * (1 - 1e-9))
            leads = lead[:-1] & (key[1:] == key[:-1]) & enough(n[:-1], n[1:], room[:-1], similarity)
            keep = led | np.concatenate((leads, [False]))
            keep[: len(out)] &= ~out
            yield pa.RecordBatch.from_arrays([pa.array(rows[k, keep]) for k in (0, 1, 3)[: b.num_columns - 1]], ["key", "id", "room"][: b.num_columns - 1])
            before = leader[-1:][(leader[-1:] >= 0) & (key[leader[-1:]] == key[-1])]
            held, out = rows[:, [*before, len(n) - 1]], np.array([*np.ones(len(before), bool), led[-1]])

    return run


def _bits(column: pa.Array) -> np.ndarray:
    """Marks as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, MARKS // 64)


def _near(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (a, b, n, m, marks of a, marks of b), the pairs that can have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            ok = possible(n, m, np.bitwise_count(_bits(b.column(4)) ^ _bits(b.column(5))).sum(axis=1, dtype=np.int64), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], ["a", "b"])

    return run


def _compare(similarity: float, few: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, part, home, id, root, n, room, marks) come sorted by (key, part). Of each such group, the pairs of one at home with any of another root
    that can have the similarity if the key is their first; of one with more than a few (None: any number), those of nearest marks, with the key of which there are more."""

    def pairs(key: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        home, ids, root, n, room, bits = (np.concatenate(x) for x in zip(*held, strict=True))
        if home.all():  # of two roots one is not the largest
            names, sizes = np.unique(root, return_counts=True)
            home = root != names[sizes.argmax()]
        at_home = np.flatnonzero(home)
        step = max(1, CELLS // len(ids))
        for at in range(0, len(at_home), step):
            i = at_home[at : at + step]
            differ = sum(np.bitwise_count(bits[i, None, k] ^ bits[None, :, k]).astype(np.int64) for k in range(bits.shape[1]))
            ok = (root[i, None] != root[None, :]) & possible(n[i, None], n[None, :], differ, similarity)
            ok &= enough(n[i, None], n[None, :], np.minimum(room[i, None], room[None, :]), similarity)
            over = ok.sum(axis=1) > (len(ids) if few is None else few)
            if over.any():
                nearest = np.argpartition(np.where(ok[over], differ[over], MARKS + 1), few - 1, axis=1)[:, :few]
                ok[over] = False
                ok[np.flatnonzero(over)[:, None], nearest] = True
            x, y = np.nonzero(ok)
            a, b = ids[i[x]], ids[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(x), key, np.int64), mask=~over[x])], ["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None
        for b in batches:
            key, part, home, ids, root, n, room = (b.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            bits = _bits(b.column(7))
            cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))).tolist() if len(key) else []
            for i, j in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if held and last != (key[i], part[i]):
                    yield from pairs(last[0], held)
                    held = []
                last = (key[i], part[i])
                held.append((home[i:j].astype(bool), ids[i:j], root[i:j], n[i:j].astype(np.int64), room[i:j], bits[i:j]))
        if held:
            yield from pairs(last[0], held)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py()).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))], ["id", "set"])


def _wide(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (a, b, n, m, wide marks of a, of b), the pairs that can have the similarity; those without wide marks on either side stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if x is not None and y is not None:
                    x, y = (np.frombuffer(z, np.uint64) for z in (x, y))
                    least = min(len(x), len(y))
                    # The remainder by half as many bits is that of the remainder: marks fold.
                    differ = np.bitwise_xor.reduce(x.reshape(-1, least)) ^ np.bitwise_xor.reduce(y.reshape(-1, least))
                    ok[k] = possible(b.column(2)[k].as_py(), b.column(3)[k].as_py(), int(np.bitwise_count(differ).sum()), similarity)
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


def _similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), a written table, whose sets have the similarity; those of long texts are told apart by wide marks first."""
    long = rows.filter("wide IS NOT NULL").select("uid", "n", "wide")
    pairs = pairs.join(long.toDF("a", "n", "x"), "a", "left").join(long.toDF("b", "m", "y"), "b", "left").select("a", "b", "n", "m", "x", "y")
    pairs = table(pairs.mapInArrow(_wide(similarity), "a long, b long"))
    ids = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    sets = table(docs.join(ids, "uid", "left_semi").select("uid", "text").mapInArrow(_sets, "id long, set array<long>"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return table(both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"))


def _dealt(rows: DataFrame, hot_rows: int) -> DataFrame:
    """rows(key, rows, ...) with part and home for _compare: those of a key with very many are dealt to n parts, and each of n * n tasks compares one with another."""
    n = F.ceil(F.col("rows") / hot_rows).cast("long")
    own = F.pmod(F.xxhash64("id"), n)
    every = F.sequence(F.lit(0).cast("long"), n - 1)
    # Part i at home meets part j in task i * n + j, for i up to j.
    cell = lambda i: F.struct((F.least(own, i) * n + F.greatest(own, i)).alias("part"), (own <= i).alias("home"))
    return rows.select("*", F.explode(F.transform(every, cell)).alias("_cell")).select("key", "_cell.part", "_cell.home", "id", "root", "n", "room", "marks")


def alike(docs: DataFrame, similarity: float, hot_rows: int = HOT_ROWS, few: int = FEW) -> DataFrame:
    """(a, b): links between rows of docs(uid, text), of different uid, that connect all whose sets of shingles have that similarity or more.

    No link is wrong, each is decided on the two sets, and none that connects is missed. Equal sets are linked to the smallest uid that has
    them, and one of them goes on. Those that share one of their first shingles are compared with two of them at first, which joins
    most of a group of near copies. Then all of them that are not yet connected are compared: by sizes and marks, which rule out nearly
    all that are not similar, and what is left by the sets. Where a text has more than a few left, the nearest come first and what they
    join is no longer apart, so a large group isn't compared pair by pair; once they join nothing, all that are left are compared.
    """
    rows = table(docs.mapInArrow(_signatures(similarity, *_frequent(docs)), "uid long, digest long, n int, marks binary, wide binary, keys array<long>"))
    one = table(rows.groupBy("digest", "n").agg(F.min("uid").alias("id")))
    same = table(rows.select("uid", "digest", "n").join(one, ["digest", "n"]).filter("uid <> id").select(F.col("uid").alias("a"), F.col("id").alias("b")))
    keys = rows.join(same.select(F.col("a").alias("uid")), "uid", "left_anti").select(F.posexplode("keys").alias("at", "key"), F.col("uid").alias("id"), "n")
    keys = keys.select("key", "id", "n", (F.col("n") - F.col("at")).alias("room"))
    keys = table(keys.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_shared(similarity), "key long, id long, room long"))
    known = rows.select(F.col("uid").alias("id"), "n", "marks")

    place = F.struct(F.xxhash64("id").alias("h"), "id")
    # Written before it is joined: then a shingle that very many texts share is split among tasks.
    ends = table(keys.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi")))
    meets = F.expr("filter(array(lo.id, hi.id), x -> x <> id AND lo.id <> id)")  # each pair once: the first is met by all, the last by those between
    pairs = keys.join(ends, "key").select("id", F.explode(meets).alias("end"))
    pairs = table(pairs.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct())
    pairs = pairs.join(known.toDF("a", "n", "x"), "a").join(known.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    tried = table(pairs.mapInArrow(_near(similarity), "a long, b long"))
    links = _similar(tried, rows, docs, similarity)

    while True:
        rooted = table(keys.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
        apart = table(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi AND rows > 3").select("key", "rows"))
        cells = _dealt(rooted.join(apart, "key").join(known, "id"), hot_rows).repartition("key", "part").sortWithinPartitions("key", "part")
        found = table(cells.mapInArrow(_compare(similarity, few), "a long, b long, more long"))
        pairs = table(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        joined = _similar(pairs, rows, docs, similarity)
        links, tried = links.union(joined), tried.union(pairs)
        left = table(found.filter("more IS NOT NULL").select(F.col("more").alias("key")).distinct())
        if left.isEmpty():
            return links.union(same)
        keys = table(keys.join(left, "key", "left_semi"))
        if joined.isEmpty():
            few = None
