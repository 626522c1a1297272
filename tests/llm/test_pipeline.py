"""The pipeline against its stages done by brute force, and every query with SQL against it."""

import math
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from treeframe.llm import linededup, pieces, queries, simhash, substrings
from treeframe.llm.common import WORD, scratch

from .test_dedup import brute_alike, brute_lines, without
from .test_others import brute_metrics, brute_targets

DATA = Path("/root/testdata/sf0.001")
KIND = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def corpus():
    r = random.Random(11)
    line = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    shared = line(20)
    out = [(i, "\n".join([line(r.randint(30, 60)), *([shared] if r.random() < 0.3 else []), line(r.randint(20, 50))]), r.choice(["a", "a", "b", "c", None])) for i in range(80)]
    out += [(100 + i, out[i][1].replace("w1", "w2", 1), out[i][2]) for i in range(10)]
    out += [(200, None, "a"), (201, "", "b"), (202, "too short", "c"), (203, "again and again " * 40, "a"), (204, out[0][1], "b"), (205, out[0][1], None)]
    out += [(300 + i, "few words", "junk") for i in range(40)] + [(400, line(120), "junk")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in out]


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, KIND).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # 8: the base rules, and the one host that fails as a whole.
    good = [x for x in rows if (m := brute_metrics(x[1]))[0] >= 50 and 2 * m[4] <= m[0] and x[3] != "junk"]
    # 5
    gone = brute_lines([(i, t, None) for i, t, *_ in good])
    good = [(i, without(t, gone[i, t]), lang, s) for i, t, lang, s, _ in good]
    # 2: the smallest id of each component.
    roots = brute_alike([(i, t, None) for i, t, *_ in good], 0.8)
    least = {c: min(x[0] for x, d in zip(good, roots, strict=True) if d == c) for c in roots}
    good = {x[0]: x for x in good if x[0] in least.values()}
    # 10: all words that a source owes, none more than twice; 1: each row's ids decode to words of its document.
    model = pieces.load()
    assert {r["doc_id"] for r in got} <= {i for i, x in good.items() if re.search(WORD, x[1])}
    words, per_source = {}, {}
    for r in got:
        text = model.decode(r["ids"])
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"]) == len(model.fold("")) + len(r["ids"])
        assert good[r["doc_id"]][1].startswith(text) and r["source"] == good[r["doc_id"]][3]
        n = len(re.findall(WORD, text))
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + n
        per_source[r["source"]] = per_source.get(r["source"], 0) + n
    size = {i: len(re.findall(WORD, x[1])) for i, x in good.items()}
    assert all(n <= 2 * size[i] for i, n in words.items())
    sources = sorted({x[3] for x in good.values()}, key=lambda s: (s is None, s or ""))
    targets = brute_targets([sum(size[i] for i, x in good.items() if x[3] == s) for s in sources])
    assert all(abs(per_source.get(s, 0) - t) <= 1 for s, t in zip(sources, targets, strict=True))


def test_short_lines_go_too(spark):
    """Repeated runs count from one line with a word on: the stage has no smallest number of words."""
    r = random.Random(7)
    line = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    pool = ["All rights reserved.", "end", line(6), line(9)]
    rows = [(i, "\n".join([line(12), r.choice(pool), "", line(3), r.choice(pool)])) for i in range(40)]
    gone = brute_lines([(i, t, None) for i, t in rows])
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], KIND).repartition(4), "")
    assert {x.doc_id: x.text for x in out.collect()} == {i: without(t, gone[i, t]) for i, t in rows}


def test_stages_return_documents(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS), name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mix sources", "sentencepiece"]


def test_nothing_stays_in_the_shared_folder(spark, tmp_path):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    have = lambda: {p.name for p in root.iterdir()} if root.exists() else set()
    rows = corpus()
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    before = have()
    with scratch(spark):
        built = [q(spark, str(tmp_path)) for q in (simhash.op2_simhash_dedup, linededup.op5_line_dedup, substrings.op9_substring_dedup)]
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
        assert [x.count() for x in built] == [len(rows)] * 3
    assert have() == before


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    out = queries.QUERIES[name](spark, str(DATA))
    assert sorted(out.columns) == sorted(columns)
    value = lambda x: f"{x:.12g}" if isinstance(x, float) and not math.isnan(x) else x if x is None else str(x)
    rows = lambda data, names: sorted((tuple(value(r[names.index(c)]) for c in sorted(columns)) for r in data), key=repr)
    assert rows([tuple(r) for r in out.collect()], out.columns) == rows(want.fetchall(), columns)
