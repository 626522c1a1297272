"""Mixing sources to target weights: DataFrame functions only.

Every source is a tape of words: its documents in a seeded order, one after another. Blocks of equally many
words are cut from the tapes until each source has given its target, going round a tape again where the target
is above its size. A schedule says in which order blocks follow each other: golden-ratio points are mapped through
the sources' cumulative weights, slots are ranked within their source, and slot k of a source takes its block k.
The result names the slot of every stretch, and mix_documents() writes in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, digests, hashable, numbered, read, row, table, unpacked

#: The golden ratio's fraction in units of 2^-62, odd: multiples of it, modulo 2^62, are the schedule's points.
GOLDEN = 2850178704830799621
#: Points and the sources' stretches of the cumulative weights are compared in units of 2^-31.
UNITS = 1 << 31


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_rank, source_size, target, quota) for each source of sized(source, size).

    Sources in the order of their code points, null last, have the weights in turn and share `share` times all
    sizes. A source stops at `most` times its size and the others share the rest by weight. With sources ordered by
    limit to weight, the level at which none is above its limit is the highest of
    (total - limits before) / (weights from here on), so one pass finds what repeated resharing would.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))  # one row for each source from here on
    src = src.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int")).cast("long"))
    src = src.withColumn("limit", most * F.col("source_size")).withColumn("_one", F.lit(1))
    by = Window.partitionBy("_one").orderBy(F.col("limit") / F.col("w"), "source_rank")
    total = F.sum("source_size").over(Window.partitionBy("_one"))
    before = F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    src = src.withColumn("level", (share * total - before) / after)
    target = F.least(F.col("limit"), F.col("w") * F.max("level").over(Window.partitionBy("_one")))
    return src.select("source", "source_rank", "source_size", target.alias("target"), F.floor(target).alias("quota"))


def tape(sized: DataFrame) -> DataFrame:
    """sized(source_rank, key, tie, copy, size) with `at`: the words of its source that stand before each document.

    The order is that of the key, a digest; of equal keys that of the tie, another. Rows with both equal are copies: they are one
    entry of the tape, and each stands `copy` lengths into it. The first three digits of the key split every source into
    4,096 parts, so a window holds one part: sums of parts first, then places within a part. Neither a source nor a document
    with a third of all rows is a hot task.
    """
    back = Window.unboundedPreceding
    entries = sized.groupBy("source_rank", "key", "tie").agg(F.min("size").alias("each"), F.count(F.lit(1)).alias("n")).withColumn("part", F.substring("key", 1, 3))
    entries = entries.withColumn("long", F.col("each") * F.col("n"))
    parts = entries.groupBy("source_rank", "part").agg(F.sum("long").alias("n"))
    parts = parts.select("source_rank", "part", (F.sum("n").over(Window.partitionBy("source_rank").orderBy("part").rowsBetween(back, 0)) - F.col("n")).alias("part_at"))
    inside = F.sum("long").over(Window.partitionBy("source_rank", "part").orderBy("key", "tie").rowsBetween(back, 0)) - F.col("long")
    entries = table(entries.withColumn("in_part", inside).join(parts, ["source_rank", "part"]).select("source_rank", "key", "tie", (F.col("part_at") + F.col("in_part")).alias("begins")))
    return sized.join(entries, ["source_rank", "key", "tie"]).withColumn("at", F.col("begins") + F.col("copy") * F.col("size")).drop("begins")


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot, in UNITS: the first 31 of 62 bits of slot * GOLDEN, in whole numbers that don't overflow."""
    high, low = F.shiftright(slot, 31), slot.bitwiseAND(UNITS - 1)
    c, d = GOLDEN >> 31, GOLDEN & (UNITS - 1)
    return F.pmod(F.shiftright(low * d, 31) + low * c % UNITS + high * d % UNITS, F.lit(UNITS))


def schedule(spark: SparkSession, blocks: DataFrame, chunk: int = 4096) -> DataFrame:
    """(source_rank, k, slot): which slot holds block k of which source.

    blocks: (source_rank, n_blocks). The point of a slot falls into one source's stretch of the cumulative weights, which are
    the numbers of blocks. The stretches are cut at a grid, so points meet them by an equal grid cell. Ranks come from counts of
    chunks of slots and places within a chunk. Points of a source's stretch can be fewer than its blocks, by the discrepancy:
    the blocks left come last, source by source. Those too many are left out.
    """
    stretch = blocks.withColumn("hi", F.sum("n_blocks").over(Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)))
    n, sources = stretch.agg(F.coalesce(F.max("hi"), F.lit(0)), F.count(F.lit(1))).first()
    scaled = lambda x: F.expr(f"({x}) * {UNITS}L div {max(n, 1)}L")
    edges = stretch.select("source_rank", scaled("hi - n_blocks").alias("lo"), scaled("hi").alias("hi")).filter("hi > lo")
    cell = max(1, UNITS // max(4096, sources))
    cells = edges.select("source_rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") / cell))
    slots = slots.join(cells, "cell").filter("point >= lo AND point < hi").select("slot", "source_rank", F.floor(F.col("slot") / chunk).alias("chunk"))
    slots = table(slots)
    counts = slots.groupBy("source_rank", "chunk").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source_rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    counts = table(counts.select("source_rank", "chunk", "n", (F.sum("n").over(by) - F.col("n")).alias("before")))
    inside = F.row_number().over(Window.partitionBy("source_rank", "chunk").orderBy("slot"))
    dealt = slots.withColumn("i", inside).join(counts, ["source_rank", "chunk"]).select("source_rank", (F.col("before") + F.col("i") - 1).alias("k"), "slot")
    have = blocks.join(counts.groupBy("source_rank").agg(F.sum("n").alias("have")), "source_rank", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    left = have.filter("n_blocks > have").withColumn("first", F.sum(F.col("n_blocks") - F.col("have")).over(Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)) - (F.col("n_blocks") - F.col("have")))
    last = left.select("source_rank", F.explode(F.sequence(F.col("have"), F.col("n_blocks") - 1)).alias("k"), (F.lit(n) + F.col("first") + F.col("k") - F.col("have")).alias("slot"))
    return dealt.join(blocks, "source_rank").filter("k < n_blocks").select("source_rank", "k", "slot").union(last)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 4096, seed: int = 17, uid: str | None = None, tie: str | None = None, **shares) -> DataFrame:
    """The mix: one row for each stretch of words that it takes, and one without a stretch for each document not taken.

    Columns: uid (of the row of docs: a column of that name if docs has one to give, else a number made here), doc_id, source, size, source_size, target, pass, at (what the source gives before the document in that pass), begin and words (the stretch within
    the document), k (block of the source), slot (the block's place in the mix; null where nothing is taken).

    The order of a source comes from the seed, id, text and source of its rows, of equal ones from all other columns (or from the
    column `tie`): rows that are equal in all are interchangeable, so reruns agree however the rows are dealt to partitions.
    A null text has no words; a null source is a source of its own; repeated rows are documents of their own. Sources
    without words have the target 0. No document is taken more than the allowed multiple of its size.
    """
    spark = docs.sparkSession
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, text, source)]
    base = table(
        docs.select(
            (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), said[0], F.lit(":"), F.md5(said[1]), F.lit(":"), said[2])).alias("key"), (F.col(tie) if tie else digests(hashable(docs))[0]).alias("tie"),
        )
    )
    src = table(targets(base.select("source", "size"), **shares))
    base = base.join(src, base["source"].eqNullSafe(src["source"])).select(base["*"], "source_rank", "source_size", "target", "quota")
    laid = tape(numbered(base, ["source_rank", "key", "tie"], "copy"))
    # Passes over the tape: pass p of a document covers [p * source_size + at, ... + size) of what the source gives.
    passes = laid.withColumn(
        "p", F.explode_outer(F.when((F.col("size") > 0) & (F.col("quota") > F.col("at")), F.sequence(F.lit(0), F.floor((F.col("quota") - F.col("at") - 1) / F.greatest(F.col("source_size"), F.lit(1))).cast("int"))))
    )
    lo = F.col("p") * F.col("source_size") + F.col("at")
    spans = passes.withColumn("lo", lo).withColumn("hi", F.least(lo + F.col("size"), F.col("quota")))
    spans = spans.withColumn("k", F.explode_outer(F.when(F.col("hi") > F.col("lo"), F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)))))
    begin = F.greatest(F.col("lo"), F.col("k") * block)
    end = F.least(F.col("hi"), (F.col("k") + 1) * block)
    spans = spans.select(
        "uid", "doc_id", "source", "size", "source_size", "target", "source_rank", F.col("p").alias("pass"), F.col("lo").alias("at"), "k", (begin - F.col("lo")).alias("begin"), F.coalesce(end - begin, F.lit(0)).alias("words")
    )
    blocks = table(src.filter("quota > 0").select("source_rank", F.ceil(F.col("quota") / block).alias("n_blocks")))
    slots = table(schedule(spark, blocks))
    return spans.join(slots, ["source_rank", "k"], "left").drop("source_rank")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents with its defaults, summed up by document; first_slot is the place of its first words in the mix."""
    taken = mix(read(spark, sf_dir, "documents"))
    return taken.groupBy("uid", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).drop("uid")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs as the mix takes them: a row for each pass over a document, with the words taken in that pass; columns as they were.

    Rows are in the order of the schedule: by the slot of the block in which a pass over the document begins, then by its place in the
    block. A document that a pass takes whole keeps its text as it is; of one that the end of a quota cuts, the words before the
    cut stay. Documents without words are not taken.
    """
    rows = table(docs.select(row(docs), F.monotonically_increasing_id().alias("uid"), digests(hashable(docs))[0].alias("tie")))
    taken = mix(rows.select("uid", "tie", *[F.col("row")[c].alias(k) for k, c in (("doc_id", doc_id), ("text", text), ("source", source))]), uid="uid", tie="tie", **how)
    first = F.min(F.struct("begin", "slot", "k"))
    taken = taken.filter("words > 0").groupBy("uid", "pass", "size").agg(F.sum("words").alias("n"), first["slot"].alias("slot"), F.max("at").alias("at"))
    taken = taken.select("uid", "slot", "at", F.when(F.col("n") < F.col("size"), F.col("n")).cast("int").alias("cut"))
    words = F.regexp_extract_all(F.col("row")[text], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("cut")), "")
    return rows.join(taken, "uid").orderBy("slot", "at").select(*unpacked(docs, {text: F.when(F.col("cut").isNull(), F.col("row")[text]).otherwise(head)}))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || coalesce(source, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2.0 * source_size::DOUBLE AS lim FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER (ORDER BY lim / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM w),
t AS (SELECT source, rk, source_size, least(lim, w * max(lv) OVER ()) AS target, floor(least(lim, w * max(lv) OVER ()))::BIGINT AS quota FROM l),
a AS (SELECT d.*, rk, source_size, target, quota, (sum(size) OVER (PARTITION BY d.source ORDER BY key, u ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS p
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT rk, (quota + 4095) // 4096 AS n, sum((quota + 4095) // 4096) OVER (ORDER BY rk) AS hi, sum((quota + 4095) // 4096) OVER () AS all_n FROM t WHERE quota > 0),
e AS (SELECT rk, n, all_n, floor((hi - n)::HUGEINT * 2147483648 // all_n) AS lo, floor(hi::HUGEINT * 2147483648 // all_n) AS hi FROM b),
z AS (SELECT i, (i::HUGEINT * 2850178704830799621 % 4611686018427387904) // 2147483648 AS x FROM range((SELECT coalesce(max(all_n), 0)::BIGINT FROM b)) AS g(i)),
q AS (SELECT i AS slot, rk, n, row_number() OVER (PARTITION BY rk ORDER BY i) - 1 AS k FROM z JOIN e ON x >= lo AND x < hi),
m AS (SELECT e.rk, e.n, all_n, count(q.slot) AS have FROM e LEFT JOIN q ON e.rk = q.rk GROUP BY e.rk, e.n, all_n),
v AS (SELECT rk, k, slot FROM q WHERE k < n UNION ALL
      SELECT rk, have + j, all_n + before + j FROM (SELECT *, sum(greatest(n - have, 0)) OVER (ORDER BY rk) - greatest(n - have, 0) AS before, unnest(range(greatest(n - have, 0)::BIGINT)) AS j FROM m)),
c AS (SELECT a.u, min(slot) AS first_slot FROM a, range(2) AS g(pass), v WHERE a.size > 0 AND v.rk = a.rk AND pass * source_size + p < quota
        AND v.k BETWEEN (pass * source_size + p) // 4096 AND (least(pass * source_size + p + size, quota) - 1) // 4096 GROUP BY a.u)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + greatest(0, least(p + size, quota % source_size) - p) END)::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM a LEFT JOIN c USING (u)
"""
