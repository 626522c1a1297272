"""Exact substring dedup: windows of words that start more than once are found level by level and removed.

Levels are lengths, each about twice the one before (9, 18 and 35 words for windows of 35). A window can only repeat
if the shorter runs of words in it repeat, so a level looks only at windows that the levels before have left. Within a
window a level looks at one run alone, the one with the least hash: equal windows choose equal runs. Runs chosen in
any document are counted; windows whose run stands once in all documents are no candidates any more. At the last
level the run is the whole window, and two 64-bit hashes tell windows apart.

Texts are packed into blocks, which are written once, in buckets: what a level finds goes to them, and they are not shuffled
again. A run is sent once for each block that chooses it, so one that very many texts share is no single task. A block
numbers its windows in the order of their hashes, and learns by these numbers which of them repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored, table

WINDOW = 35
SHORTEST = 9
#: A block ends with the text that brings it to so many bytes; each text counts as so many more than it has.
BLOCK_BYTES, TEXT_BYTES = 4 << 20, 64
#: Spark's own limit (spark.sql.sources.bucketing.maxBuckets).
MOST_BUCKETS = 100_000

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def levels(window: int) -> list[int]:
    """The lengths of the levels, the last the window's own."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def second(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same words: runs that meet in one hash have no reason to meet in that made of these."""
    x = (h ^ (h >> np.uint64(31))) * _P3
    return (x ^ (x >> np.uint64(27))) * _P2 + _P1


def grams(h: np.ndarray, length: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """A hash for each run of `length` words, from those of its two halves (which may share a word)."""
    known.setdefault(1, h)
    if length not in known:
        half = (length + 1) // 2
        part = grams(h, half, known)
        n = max(0, len(h) - length + 1)
        a, b = part[:n], part[length - half : length - half + n]
        x = (a * _P1) ^ (b * _P2 + (a >> np.uint64(29)))
        x ^= x >> np.uint64(32)
        x *= _P3
        known[length] = x ^ (x >> np.uint64(29))
    return known[length]


def sliding(a: np.ndarray, m: int, best: np.ufunc) -> np.ndarray:
    """The least (np.minimum) or most (np.maximum) of each m neighbours."""
    span, n = 1, len(a) - m + 1
    while span * 2 <= m:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[:n], a[m - span : m - span + n])


def held(a: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of a are among the others."""
    if not len(among):
        return np.zeros(len(a), bool)
    among = np.sort(among)
    return among[np.minimum(np.searchsorted(among, a), len(among) - 1)] == a


def candidates(window: int, left: list[np.ndarray], known: dict[int, np.ndarray], text: np.ndarray | None = None) -> np.ndarray:
    """Where windows begin that lie in one text and have, at each level done so far, a run that `left` (an array for each level) holds."""
    n = len(known[1]) - window + 1
    at = np.arange(n) if text is None else np.flatnonzero(text[:n] == text[window - 1 :])
    for length, hashes in zip(levels(window), left, strict=False):
        at = at[held(sliding(grams(known[1], length, known), window - length + 1, np.minimum)[at], hashes)]
    return at


def chosen(
    words: list[bytes], window: int, left: list[np.ndarray], text: np.ndarray | None = None, copies: np.ndarray | None = None, known: dict[int, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that the candidates choose at the next level, each once, as (hash, second hash, how often it is chosen, 2 for more).

    The words are those of one text, or of several: then text has for each word the number of its text, and copies how often
    each text stands. Second hashes are zero but at the last level. Only places where a candidate chooses a run are counted:
    two equal windows choose at two places. known keeps the hashes of runs by their lengths.
    """
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    known = {} if known is None else known
    known.setdefault(1, word_hashes(words))
    length = levels(window)[len(left)]
    runs = grams(known[1], length, known)
    at = candidates(window, left, known, text)
    if length == window:
        h, h2 = runs[at], grams(second(known[1]), length, {})[at]
        order = np.lexsort((h2, h))
    else:
        # A run is chosen if it is the least of any candidate that covers it.
        m = window - length + 1
        least = np.zeros(len(runs) + m - 1, np.uint64)
        least[at + m - 1] = sliding(runs, m, np.minimum)[at]
        at = np.flatnonzero(runs == sliding(least, m, np.maximum))
        h, h2 = runs[at], np.zeros(len(at), np.uint64)
        order = np.argsort(h)
    if not len(at):
        return h, h2, np.empty(0, np.int64)
    n = np.ones(len(at), np.int64) if copies is None else np.minimum(2, copies)[text[at[order]]]
    h, h2 = h[order], h2[order]
    begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))))
    return h[begin], h2[begin], np.minimum(2, np.add.reduceat(n, begin))


def removed(words: list[bytes], window: int, left: list[np.ndarray], others: np.ndarray, text: np.ndarray | None = None, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Which words stand in a window that repeats; left has the hashes of all levels, others the second ones of the last."""
    gone = np.zeros(len(words) + 1, np.int64)
    if len(words) >= window:
        known = {} if known is None else known
        known.setdefault(1, word_hashes(words))
        at = candidates(window, left, known, text)
        at = at[held(grams(second(known[1]), window, {})[at], others)]
        gone[at] += 1
        gone[at + window] -= 1
    return np.cumsum(gone)[:-1] > 0


def _numbers(x: pa.Scalar, kind: type = np.uint64) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).view(kind) if x.is_valid else np.empty(0, kind)


_BLOCK = "keys array<binary>, sizes array<long>, copies array<long>, z binary"
_ROWS = "h long, h2 long, g long, k int, n int"


def _zip(raw: bytes) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _unzip(z: bytes, size: int) -> bytes:
    return pa.decompress(z, size, "zstd", asbytes=True) if size else b""


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [x.as_py().encode("utf-8", "surrogatepass") for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_zip, raw), pa.binary()), pa.array(map(len, raw), pa.int64())], ["key", "z", "size"])


def _blocks(limit: int):
    """Rows are (key, z, size, copies) of texts; each block is a row of their lists and of all texts, one after the other."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        keys, raw, sizes, copies = zip(*rows, strict=True)
        lists = [pa.array([x], pa.list_(t)) for x, t in ((keys, pa.binary()), (sizes, pa.int64()), (copies, pa.int64()))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([_zip(b"".join(raw))], pa.binary())], ["keys", "sizes", "copies", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for b in batches:
            for key, z, size, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append((key, _unzip(z, size), size, copies))
                total += size + TEXT_BYTES
                if total >= limit:
                    yield block(rows)
                    rows, total = [], 0
        if rows:
            yield block(rows)

    return run


def _words(sizes: np.ndarray, z: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a block's texts, and how many each text has."""
    raw, words, n, end = _unzip(z, int(sizes.sum())), [], [], 0
    for size in sizes.tolist():
        own = raw[end : end + size].split()
        words += own
        n.append(len(own))
        end += size
    return words, np.array(n, np.int64)


def _level(window: int):
    """Rows are (g, sizes, copies, z, hashes of the levels before) of blocks: the runs that each block chooses next, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, sizes, copies, z, *left in zip(*b.columns, strict=True):
                words, many = _words(_numbers(sizes, np.int64), z.as_py())
                text = np.repeat(np.arange(len(many)), many)
                h, h2, n = chosen(words, window, [_numbers(x) for x in left], text, _numbers(copies, np.int64))
                columns = [h.view(np.int64), h2.view(np.int64), np.full(len(h), g.as_py(), np.int64), np.arange(len(h), dtype=np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "h2", "g", "k", "n"])

    return run


def _result(window: int):
    """Rows are (keys, sizes, z, hashes of the levels but the last, numbers of windows that repeat) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, sizes, z, *left, again in zip(*b.columns, strict=True):
                words, many = _words(_numbers(sizes, np.int64), z.as_py())
                gone = np.zeros(len(words), bool)
                if again.is_valid:
                    text, known, before, k = np.repeat(np.arange(len(many)), many), {}, [_numbers(x) for x in left], _numbers(again, np.int32)
                    h, h2, _ = chosen(words, window, before, text, known=known)
                    gone = removed(words, window, [*before, h[k]], h2[k], text, known)
                kept, n_gone, end = [], [], 0
                for n in many.tolist():
                    stay = ~gone[end : end + n]
                    kept.append(b" ".join(compress(words[end : end + n], stay.tolist())))
                    n_gone.append(n - int(stay.sum()))
                    end += n
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(many), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_words", "n_removed", "kept_text"])

    return run


def _left(rows: DataFrame, what: str, name: str, buckets: int) -> DataFrame:
    """(g, name): what of the runs of each block that start more than once in all texts."""
    # A run has a row for each block at most, so no task gets much of one.
    more = rows.withColumn("n", F.sum("n").over(Window.partitionBy("h", "h2"))).filter("n > 1")
    return stored(more.groupBy("g").agg(F.collect_list(what).alias(name)), buckets, "g").df


def search(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of each row of docs, and (key, n_words, n_removed, kept_text) of each different text; the key is its MD5."""
    value = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.md5(value))
    # One row for each text: copies meet in the map-side part of the aggregate.
    packed = docs.select(key.alias("key"), value.alias("text")).mapInArrow(_pack, "key binary, z binary, size long")
    texts = packed.groupBy("key").agg(F.first("z").alias("z"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    # With as many buckets as a shuffle has partitions, joins by g move neither the blocks nor what the levels found.
    buckets = min(MOST_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(texts.mapInArrow(_blocks(BLOCK_BYTES), _BLOCK).withColumn("g", F.monotonically_increasing_id()), buckets, "g").df
    found: list[DataFrame] = []
    names: list[str] = []
    for i, length in enumerate(levels(window)):
        asked = blocks
        for x in found:
            asked = asked.join(x, "g")
        rows = asked.select("g", "sizes", "copies", "z", *names).mapInArrow(_level(window), _ROWS)
        names.append(f"s{i}")
        found.append(_left(rows, "k" if length == window else "h", names[-1], buckets))
    judged = blocks
    for x in found:
        judged = judged.join(x, "g", "left")
    judged = judged.select("keys", "sizes", "z", *names)
    return docs.select(F.col(doc_id).alias("doc_id"), key.alias("key")), judged.mapInArrow(_result(window), "key binary, n_words long, n_removed long, kept_text binary")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs.

    Removed is each word in a window (so many words of one text) whose sequence of words also starts anywhere else, in the
    same text or another; kept_text has the others, joined by one space. Windows are judged on the input.

    Null and empty texts have no words. Texts of fewer words than a window keep all. Equal texts of a window or more lose all
    their words; they are one text in the search, so copies cost nothing. Repeated rows are copies and each give a row.
    Texts are told apart by their MD5, windows by two 64-bit hashes. Other columns of docs play no part, whatever their names.
    """
    ids, out = search(docs, doc_id, text, window)
    return ids.join(out, "key").select("doc_id", "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() of all documents with its defaults; kept_sha256 is that of the words that stay."""
    ids, out = search(read(spark, sf_dir, "documents"))
    # Written first: then a text that very many rows share is split among tasks.
    out = table(out.select("key", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))
    return ids.join(out, "key").drop("key")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT u, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT u, i, md5(list_aggregate(w[i:i + 34], 'string_agg', ' ')) AS g FROM (SELECT u, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
m AS (SELECT x.u, x.i, x.x, coalesce(max(r.i) OVER (PARTITION BY x.u ORDER BY x.i) > x.i - 35, false) AS gone FROM x LEFT JOIN r ON x.u = r.u AND x.i = r.i)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT u, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS k FROM m GROUP BY u) USING (u)
"""
