"""Line dedup: repeated runs of lines lose their later copies, found by prefix doubling over the corpus's line sequences.

Places are lines with a word, numbered so that an earlier place of the corpus has a smaller number. Round k of the
doubling puts the places that share their first 2^k lines into one interval, named by its first place: those are the
intervals of the suffix array whose longest common prefix is 2^k or more, without an order between them, which no run
needs. An interval of one place is dropped at once, since nothing longer in it can repeat, and rounds go on until none is left.

Then the length of the longest run at each place that also starts earlier is found from the longest rounds down: the
places of an interval are parted by the names of the 2^j lines that follow, for smaller and smaller j, until common
prefixes are exact. These runs, where none holds the next, are the maximal ones; the lines in them go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW_ROWS, WORD, Stored, digests, free, let, numbered, read, row, stored, table, unpacked


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def places(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(p, k1, k2, i, a, b, n): line i (of those with a word) of the document k1, k2 has the digest a, b and n words.

    p grows with the document's place in the corpus and with i; neighbours in a document have neighbouring numbers, and
    one number after each document's last is left free, so that no run reaches over a document's end.
    """
    k1, k2 = digests([F.col(doc_id), F.col(text)])
    rows = docs.select(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text")).filter("text IS NOT NULL")
    rows = numbered(rows, ["k1", "k2"], "copy").filter("copy = 0")
    found = F.concat(F.filter(split_lines(F.col("text")), lambda x: x.rlike(WORD)), F.array(F.lit(None).cast("string")))
    lines = rows.select("none", "doc_id", "k1", "k2", F.posexplode(found).alias("i", "x"))
    lines = lines.select("none", "doc_id", "k1", "k2", "i", F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(1), "x")).alias("a"), F.xxhash64(F.lit(2), "x").alias("b"), F.regexp_count("x", F.lit(WORD)).alias("n"))
    lines = lines.repartitionByRange("none", "doc_id", "k1", "k2").sortWithinPartitions("none", "doc_id", "k1", "k2", "i")
    return lines.select(F.monotonically_increasing_id().alias("p"), "k1", "k2", "i", "a", "b", "n").filter("a IS NOT NULL")


def _shared(rows: DataFrame, few: bool) -> Stored:
    """(p, c): the places of rows(p, a, b) that share (a, b) with another, and the first of those that do.

    Names of few rows, counted before, are broadcast. Else they are written before they are joined: then a name that very many
    places share is split among tasks.
    """
    names = rows.groupBy("a", "b").agg(F.min("p").alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    if few:
        return stored(rows.join(F.broadcast(names), ["a", "b"]).select("p", "c"))
    names = stored(names)
    out = stored(rows.join(names.df, ["a", "b"]).select("p", "c"))
    names.drop()
    return out


def doubled(lines: DataFrame) -> list[tuple[Stored, int]]:
    """For k = 0, 1, ...: (p, c) for the places whose first 2^k lines stand elsewhere too, and how many these are; c is the first place of the interval."""
    out: list[tuple[Stored, int]] = []
    more = _shared(lines.select("p", "a", "b"), False)
    while n := more.df.count():
        out.append((more, n))
        x, span = more.df, 1 << len(out) - 1
        pairs = x.select("p", F.col("c").alias("a")).join(x.select((F.col("p") - span).alias("p"), F.col("c").alias("b")), "p")
        more = _shared(pairs, n <= FEW_ROWS)
    more.drop()
    return out


def _parted(state: DataFrame, names: DataFrame, span: int, few: bool) -> Stored:
    """state(node, len, p, s) after the next `span` lines: node is the first place of those that share len lines with p.

    s says that p's own run is sought here; others stand in a node only because they may be the first of a part of it. A
    place leaves for a part of its node if it isn't the part's first; the part's first stands in both from then on.
    """
    ends = names.select(F.col("p").alias("q"), F.col("c").alias("then"))
    t = state.withColumn("q", F.col("p") + F.col("len")).join(ends, "q", "left").drop("q")
    kept = None if few else stored(t)
    t = t if few else kept.df
    parts = t.filter("then IS NOT NULL").groupBy("node", "len", "then").agg(F.min("p").alias("first"), F.max(F.when(F.col("s"), F.col("p"))).alias("last"))
    parts = parts.filter("last > first").drop("last")
    written = None if few else stored(parts)
    parts = F.broadcast(parts) if few else written.df
    both = F.array(
        F.when(F.col("first").isNull() | (F.col("p") == F.col("first")), F.struct("node", "len", "p", "s")),
        F.when(F.col("first").isNotNull(), F.struct(F.col("first").alias("node"), (F.col("len") + span).alias("len"), "p", (F.col("s") & (F.col("p") != F.col("first"))).alias("s"))),
    )
    out = stored(t.join(parts, ["node", "len", "then"], "left").select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("x.*"))
    for x in filter(None, (kept, written)):
        x.drop()
    return out


def earlier_runs(lines: DataFrame) -> DataFrame:
    """(p, m): m lines from place p on, and no more, also start at an earlier place; for each place of lines(p, a, b) with m > 0."""
    levels = doubled(lines)
    state, n = None, 0
    for k in reversed(range(len(levels))):
        own = levels[k][0].df
        if k + 1 < len(levels):  # places known to repeat over twice the length are sought there
            own = own.join(levels[k + 1][0].df.filter("p <> c").select("p"), "p", "left_anti")
        own = own.select(F.col("c").alias("node"), F.lit(1 << k).cast("long").alias("len"), "p", (F.col("p") != F.col("c")).alias("s"))
        rows = own if state is None else own.union(state.df)
        if not k:
            out = table(rows.filter("s").select("p", F.col("len").cast("int").alias("m")))
            for x in [*(x for x, _ in levels), *([state] if state else [])]:
                x.drop()
            return out
        more = _parted(rows, levels[k - 1][0].df, 1 << k - 1, levels[k][1] + n <= FEW_ROWS)
        if state is not None:
            state.drop()
        state, n = more, more.df.count()
    return lines.select("p", F.lit(0).alias("m")).filter("false")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """docs with the later copies of repeated runs of lines removed from the text, and _n_lines (lines with words), _n_removed
    (of these), _n_runs (maximal runs that went) and _longest (lines of the longest).

    A line goes if it is in a run of lines of its document, of min_words words or more in all, that also starts at an
    earlier place: in a smaller doc_id (null ids last; of equal ids the smaller hash of id and text), or further up. Lines are
    equal if all their characters are, by two 64-bit hashes. Lines without words are not looked at; they follow the line before them.

    Null texts stay null and have no lines. Rows that are equal in doc_id and text are one document: they get the same
    text. Every row of docs gives a row; other columns stay as they are, and one named like a result is an error. docs
    must give the same rows when read twice, as a table does.
    """
    free(docs, "_n_lines", "_n_removed", "_n_runs", "_longest")
    lines = stored(places(docs, doc_id, text))
    runs = earlier_runs(lines.df)
    if min_words > 1:
        begin, end = lines.df.select("p", "k1", "k2", "i"), lines.df.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), F.col("i").alias("j"), "n")
        inside = runs.join(begin, "p").join(end, (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")) & (F.col("j") >= F.col("i")) & (F.col("j") < F.col("i") + F.col("m")))
        runs = inside.groupBy("p", "m").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_words).select("p", "m")
    gone = runs.join(lines.df.select("p", "k1", "k2", "i"), "p").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("runs"))
    gone = stored(gone.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), "runs")).df
    lines.drop()
    k1, k2 = digests([F.col(doc_id), F.col(text)])
    out = docs.select(row(docs), k1.alias("k1"), k2.alias("k2"))
    out = out.join(gone, (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")), "left")
    # A run that begins one line later and ends together with the one before is part of it.
    maximal = F.filter("runs", lambda x, k: ~F.coalesce((F.get("runs", k - 1)["i"] == x["i"] - 1) & (F.get("runs", k - 1)["m"] == x["m"] + 1), F.lit(False)))
    out = out.select("row", maximal.alias("runs")).select("row", "runs", without(F.col("row")[text], F.col("runs")).alias("cut"))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    with_words = F.size(F.filter(split_lines(F.col("row")[text]), lambda x: x.rlike(WORD)))
    return out.select(
        *unpacked(
            docs, {text: F.coalesce("cut.text", F.col("row")[text])}, _n_lines=count(F.when(F.col("row")[text].isNotNull(), with_words)), _n_removed=count(F.col("cut.n")),
            _n_runs=count(F.when(F.col("runs").isNotNull(), F.size("runs"))), _longest=count(F.array_max(F.transform("runs", lambda x: x["m"]))),
        )
    )


def without(text: Column, runs: Column) -> Column:
    """(text, n): the text without the lines of its runs (i, m), and how many of these have words; null where runs is.

    i counts lines with a word; a line without words goes or stays with the line before it.
    """
    lines = split_lines(text)

    def cut(x: Column) -> Column:
        with_words = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda j: F.get(x, j).rlike(WORD))

        def kept(w: Column) -> Column:
            begin, end = lambda r: F.get(w, r["i"]), lambda r: F.coalesce(F.get(w, r["i"] + r["m"]), F.size(x))
            gone = F.flatten(F.transform(runs, lambda r: F.sequence(begin(r), end(r) - 1)))
            lost = F.size(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["i"], r["i"] + r["m"] - 1)))))
            return F.struct(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda j: F.get(x, j)), "\n").alias("text"), lost.alias("n"))

        return let(with_words, kept)

    return F.when(runs.isNotNull(), let(lines, cut))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() of all documents with its defaults; kept_sha256 is that of the text that stays."""
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_runs").alias("n_runs"), F.col("_longest").alias("longest_run"), F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH r AS (SELECT row_number() OVER () AS u, doc_id, text FROM documents WHERE text IS NOT NULL),
s AS (SELECT u, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM r),
a AS (SELECT u, doc_id, x, j, w, count(*) FILTER (w) OVER (PARTITION BY u ORDER BY j) AS i FROM (SELECT *, regexp_matches(x, '[^\x20\x09-\x0D]') AS w FROM s)),
l AS (SELECT u, doc_id, i, x FROM a WHERE w),
e AS (SELECT p.u, p.i, q.u AS v, p.i - q.i AS d, p.i - row_number() OVER (PARTITION BY p.u, q.u, p.i - q.i ORDER BY p.i) AS island
      FROM l p JOIN l q ON p.x = q.x AND (q.doc_id < p.doc_id OR q.doc_id IS NOT NULL AND p.doc_id IS NULL OR q.u = p.u AND q.i < p.i)),
m AS (SELECT u, i, max(z - i + 1) AS m FROM (SELECT u, i, max(i) OVER (PARTITION BY u, v, d, island) AS z FROM e) GROUP BY u, i),
n AS (SELECT u, i, m, lag(i) OVER o = i - 1 AND lag(m) OVER o = m + 1 AS part FROM m WINDOW o AS (PARTITION BY u ORDER BY i)),
t AS (SELECT a.u, string_agg(a.x, chr(10) ORDER BY a.j) FILTER (n.i IS NULL) AS kept, count(*) FILTER (w) AS nl, count(*) FILTER (w AND n.i IS NOT NULL) AS nr,
        count(*) FILTER (w AND n.i IS NOT NULL AND part IS NOT TRUE) AS runs, max(n.m) AS longest
      FROM a LEFT JOIN n ON a.u = n.u AND a.i = n.i GROUP BY a.u)
SELECT d.doc_id, coalesce(nl, 0)::BIGINT AS n_lines, coalesce(nr, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_runs, coalesce(longest, 0)::BIGINT AS longest_run,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id AS k, text AS x, any_value(u) AS u FROM r GROUP BY ALL) f ON d.doc_id IS NOT DISTINCT FROM f.k AND d.text = f.x LEFT JOIN t USING (u)
"""
