"""Quality rules with host verdicts: DataFrame functions only.

Each document is judged by its own words (the base rules). Failures are then counted by host, each
host's failure rate is shrunk towards a beta prior fitted to all hosts, and documents of hosts whose
shrunken rate is above a limit are rejected too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, met, read, row, table, unpacked, words

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(w: Column) -> Column:
    """How many words stand in a 3-word window that the array holds twice or more.

    Windows are compared by a 64-bit hash within one text. Sorted (hash, place) pairs put equal windows
    side by side, so the cost is n log n for a text of n words.
    """
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            hit = F.transform(p, lambda x, j: F.when((x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]), x["i"]))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

        def total(q: Column) -> Column:
            steps = F.transform(q, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(q, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(ordered, places), total)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def metrics(text: Column) -> Column:
    """A struct of the five counts of METRICS (long). A null text counts as an empty one."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def host_verdicts(judged: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """(host, n, n_failed, rate, host_ok) for each host of judged(host, base_failed).

    The prior is Beta(k m, k (1 - m)): m is the failure rate of all documents, k is found by the method of
    moments from the spread of the hosts' rates beyond what chance explains. A null host is none: it gets no row.
    """
    hosts = judged.filter("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    hosts = table(hosts)  # a row for each host
    sums = hosts.agg(
        F.sum("n").alias("all_n"),
        (F.sum("n_failed") / F.sum("n")).alias("m"),
        F.count(F.lit(1)).alias("h"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n")).alias("sq"),
    ).select(
        "m",
        F.greatest(F.col("sq") / F.col("all_n") - F.col("m") * F.col("m") - F.col("m") * (1 - F.col("m")) * (F.col("h") - 1) / F.col("all_n"), F.lit(1e-9)).alias("v"),
    )
    # One row of two numbers, which the driver hands on as constants.
    m, k = sums.select("m", F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).first()
    rate = (F.col("n_failed") + F.lit(k) * F.lit(m)) / (F.col("n") + F.lit(k)) if m is not None else F.lit(None).cast("double")
    return hosts.withColumn("rate", rate).select("host", "n", "n_failed", "rate", (F.col("rate") <= max_host_rate).alias("host_ok"))


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 50, max_repeat: float = 0.5, max_host_rate: float = 0.5, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row for each row of docs: keep, METRICS, base_failed, host_rate, kept.

    Null and empty texts have no words and fail. Documents without a host are judged alone. Repeated rows are
    judged each. Other columns of docs play no part, whatever their names. An empty table gives an empty result.
    """
    m = docs.select(*[F.col(c) for c in keep], F.col(host).alias("_host"), metrics(F.col(text)).alias("_m"))
    failed = (F.col("_m.n_words") < min_words) | (100 * F.col("_m.n_repeat_words") > round(100 * max_repeat) * F.col("_m.n_words"))
    m = table(m.withColumn("base_failed", failed))  # a few numbers for each document, read twice
    hosts = host_verdicts(m.select(F.col("_host").alias("host"), "base_failed"), max_host_rate).select(F.col("host").alias("_host"), "host_ok", F.col("rate").alias("host_rate"))
    return met(m, hosts, "_host").select(
        *keep, *[F.col(f"_m.{c}").alias(c) for c in METRICS], "base_failed", "host_rate", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept")
    )


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 50, max_repeat: float = 0.5, max_host_rate: float = 0.5) -> DataFrame:
    """docs without the rows that the rules or their hosts reject; columns as they were, whatever their names.

    Texts are not dealt out by host: the hosts rejected are brought to the rows instead.
    """
    m = docs.select(row(docs), F.col(host).alias("host"), metrics(F.col(text)).alias("m"))
    bad = (F.col("m.n_words") < min_words) | (100 * F.col("m.n_repeat_words") > round(100 * max_repeat) * F.col("m.n_words"))
    judged = table(m.select("row", "host", bad.alias("base_failed")))
    hosts = table(host_verdicts(judged.select("host", "base_failed"), max_host_rate).filter("NOT host_ok").select("host", F.lit(True).alias("out")))
    return met(judged.filter("NOT base_failed"), hosts, "host").filter("out IS NULL").select(*unpacked(docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all documents with its defaults."""
    return judge(read(spark, sf_dir, "documents")).drop("host_rate")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT u, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT u, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT u, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY u ORDER BY i)),
r AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
rw AS (SELECT u, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS t(k) GROUP BY u),
l AS (SELECT u, count(*) - count(DISTINCT l) AS n FROM (SELECT u, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY u),
m AS (SELECT d.u, doc_id, source, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (u) LEFT JOIN rw USING (u) LEFT JOIN l USING (u)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(n) AS an, sum(f) / sum(n) AS mu, count(*) AS h, sum(f * f / n) AS sq FROM h),
k AS (SELECT mu, greatest(1.0, least(1e6, mu * (1 - mu) / greatest(sq / an - mu * mu - mu * (1 - mu) * (h - 1) / an, 1e-9) - 1)) AS k FROM p)
SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce((h.f + k.k * k.mu) / (h.n + k.k) <= 0.5, true) AS kept
FROM b LEFT JOIN h ON b.source = h.host LEFT JOIN k ON true
"""
