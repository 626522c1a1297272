"""SentencePiece, HTML, licences, top-k, sharding, quality rules and mixing."""

import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeframe.llm import common, html, licences, mixing, pieces, quality, sharding, topk
from treeframe.llm.common import WORD

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
ODD = [None, "", " ", "  two  spaces ", "tab\tand\nline\n\n", "a", "Ünïcödé 漢字 🙂 ▁x", "x" * 700, "\x00\x01", "﻿bom", "a b", "aa aaa aaaa " * 300]


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, sources[i] if sources else "s") for i, t in enumerate(texts)], KIND)


# --- SentencePiece -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def texts(seed=1, n=80):
    r = random.Random(seed)
    words = ["the", "of", "and", "Straße", "naïve", "running", "encoding", "数据", "12345", "http://x.y/z?q=1", "don't", "🙂🙂", "e.g.", "ab" * 30, "Zürich-Oerlikon"]
    return [r.choice([" ", "  ", "\n"]).join("".join(r.choices("abcdefghijklmnopqrstuvwxyzäß ", k=r.randint(1, 9))) if r.random() < 0.3 else r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)] + ODD


@pytest.mark.parametrize("hot", [0, 10, 1 << 19])
def test_encoding_equals_the_library(spark, model, hot):
    """Whether words come from the relation or are folded in place."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    t = texts()
    out = pieces.encode(docs(spark, t).withColumn("word", F.lit(1)).withColumn("ids", F.lit(2)), model, hot=hot)
    assert out.columns == ["doc_id", "text", "source", "word", "ids", "_ids", "_n_tokens", "_decoded_ok"]
    for r in out.collect():
        assert r._ids == library.encode(t[r.doc_id] or ""), repr(t[r.doc_id])
        assert r._n_tokens == len(r._ids)
        assert r._decoded_ok == (model.decode(r._ids) == (t[r.doc_id] or ""))
        if "▁" not in (t[r.doc_id] or ""):
            assert r._decoded_ok, repr(t[r.doc_id])  # an exact round trip


def test_lattice_equals_the_fold(spark, model):
    words = sorted({w for t in texts(2) if t for w in model.chunks(t) if len(w) <= 32})
    got = {r.word: r.ids for r in pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    assert got == {w: model.fold(w) for w in words}
    assert all(pieces.fold_long(model, w) == model.fold(w) for w in words)


def test_unigram_lattice(spark):
    """Viterbi against all ways to cut a word."""
    r = random.Random(3)
    entries = {"".join(r.choices("abc", k=k)): -r.uniform(1, 9) for k in (1, 2, 2, 3, 3, 4) for _ in range(4)}
    model = pieces.Pieces.of(list(entries.items()), pieces.UNIGRAM)
    worst = min(entries.values()) - 10
    words = sorted({"".join(r.choices("abcd", k=r.randint(1, 8))) for _ in range(60)})

    def cuts(w):
        if not w:
            yield 0.0, []
        for k in range(1, len(w) + 1):
            if w[:k] in entries or k == 1:
                for s, p in cuts(w[k:]):
                    yield entries.get(w[:k], worst) + s, [w[:k], *p]

    got = {x.word: x.ids for x in pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    for w in words:
        score = lambda ids: sum(model.scores[i] if model.kinds[i] == 1 else worst for i in ids)
        best = max(s for s, _ in cuts(w))
        assert abs(score(got[w]) - best) < 1e-9 and abs(score(model.fold(w)) - best) < 1e-9
        assert model.decode(got[w]) == w


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
def test_pieces_of_any_length(spark, kind):
    """Edges longer than 64 characters, beside their shorter parts."""
    entries = [("a" * n, -float(n == 1) - 1 / n) for n in (1, 2, 4, 8, 16, 32, 64, 70, 128)]
    model = pieces.Pieces.of(entries, kind)
    words = ["a" * n for n in (1, 63, 64, 65, 70, 128, 140, 200)]
    got = {r.word: r.ids for r in pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    assert got == {w: model.fold(w) for w in words}
    assert len(got["a" * 128]) == 1 and (kind == pieces.BPE or len(got["a" * 70]) == 1)


def test_words_dropped_from_the_cache(spark, model, monkeypatch):
    """What a worker remembers is bounded; what it forgets is folded again."""
    monkeypatch.setattr(pieces._Known, "CACHED", 3)
    coder = pieces.Coder(model, pa.table({"word": ["▁the", "x"], "ids": pa.array([model.fold("▁the"), model.fold("x")], pa.list_(pa.int32()))}))
    for _ in range(2):
        for w in ["of", "and", "the", "Zürich", "of", "xyz", "and", "the", "q"]:
            assert np.frombuffer(coder.spaced[w], np.int32).tolist() == model.fold("▁" + w)
            assert np.frombuffer(coder.plain[w], np.int32).tolist() == model.fold(w)
            assert len(coder.spaced) <= 1 + 3 and len(coder.plain) <= 1 + 3


def test_counting_forgets_the_words_of_a_call_before(spark, model, monkeypatch):
    """A worker that counts words holds no coder of a call before, and counts them all."""
    seen = []

    class Docs:
        select = lambda self, *_: self

        def mapInArrow(self, run, _):  # noqa: N802
            seen.append(run)
            raise InterruptedError

    with pytest.raises(InterruptedError):
        pieces.hot_words(Docs(), "text", model, 10)
    monkeypatch.setitem(pieces._known, "before", "a coder")
    out = list(seen[0](iter([pa.RecordBatch.from_pylist([{"text": "a b b\nb"}, {"text": None}, {"text": "x" * 32}])])))
    assert not pieces._known
    assert {(r["word"], r["n"]) for b in out for r in b.to_pylist()} == {("▁a", 1), ("▁b", 2), ("\n", 1), ("b", 1)}


def test_forgotten_words_that_decode_to_others(monkeypatch):
    """Whether a text comes back is known also where its odd word is dropped from the cache before the text ends."""
    monkeypatch.setattr(pieces._Known, "CACHED", 3)
    unigram = pieces.Pieces.of([(c, -1.0) for c in "▁abcdefg"], pieces.UNIGRAM, byte_fallback=False)
    coder = pieces.Coder(unigram, pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))}))
    assert [coder.encode(t)[1] for t in ("a b c", "Ω a b c d e f g", "a b", "g f e d c b a")] == [True, False, True, True]


def test_runs_are_the_chunks(model):
    """Cutting lines at single spaces gives the chunks of the whole text."""
    r = random.Random(12)
    for t in [x for x in texts(7) if x] + ["".join(r.choices("ab ▁\n\t", k=r.randint(1, 30))) for _ in range(300)]:
        assert ["▁" + w if after else w for ws, after in model.runs(t) for w in ws] == model.chunks(t)


def test_names_like_results_are_an_error(spark, model):
    df = docs(spark, ["a b"])
    for name, call in (("_ids", lambda d: pieces.encode(d, model)), ("_Shard", sharding.shuffle_shards)):
        with pytest.raises(ValueError, match=f"(?i){name}"):
            call(df.withColumn(name, F.lit(1)))


def test_no_texts(spark, model):
    assert pieces.encode(docs(spark, []), model).collect() == []
    assert [r._ids for r in pieces.encode(docs(spark, [None, ""]), model).collect()] == [[], []]


# --- HTML --------------------------------------------------------------------------------------------------------------


def test_extraction_of_a_page(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
    <header class="site-header"><h1>Site</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav></header>
    <div id="main"><article><h1>A &amp; B: the   title</h1><p>First paragraph with <b>bold</b> words,
      and &lt;entities&gt; &#233;, long enough to be the text of an article that people read.</p>
    <div class="advert">Buy now, cheap!</div><p>Second paragraph, which also has a good number of words and a full stop.</p></article>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>Great post, thanks for it!</p></div></section></div>
    <aside class="sidebar"><h3>More</h3><a href="/1">Link one</a></aside><footer><p>&copy; 2020 Site. All rights reserved.</p></footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (2, None, ""), (3, "u", "just text"), (4, "u", "<p>open <b>tags <i>everywhere"), (5, "u", "<<<>>> &nope; <p"), (None, "u", "<div>" * 3000 + "deep" + "</div>" * 10)], "page_id long, url string, html string")
    out = html.main_text(df.withColumn("text", F.lit(1)))
    got = [(r.page_id, r.text) for r in out.collect()]
    assert dict(got)[1] == "A & B: the title\nFirst paragraph with bold words, and <entities> é, long enough to be the text of an article that people read.\nSecond paragraph, which also has a good number of words and a full stop."
    assert [t for i, t in got if i == 2] == ["", ""] and len(got) == 7
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert html.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [3, 250])
def test_share_of_siblings_at_any_size(n):
    """The share of siblings with a node's tag is exact however many they are."""
    nodes, blocks = html.parse("<body><section>" + "<p>Some words.</p>" * n + "<div>Buy now</div></section></body>")
    rows = html.features(nodes, blocks)
    share = {x.tag: rows[x.index, 13] for x in nodes if x.tag in ("p", "div")}
    assert share == {"p": np.float32(n / (n + 1)), "div": np.float32(1 / (n + 1))}


def test_held_out_accuracy():
    """Trained on made-up pages of one seed, tested on those of another."""
    model = html.trained()
    right = total = 0
    for page in html.sample_pages(120, seed=99):
        nodes, blocks, y = html.labelled(page)
        if len(nodes) == len(y):
            kept = html.decode(nodes, html.log_odds(model, html.features(nodes, blocks, model["weights"])))
            right += int((kept == (y > 0.5)).sum())
            total += len(y)
    assert total > 3000 and right / total > 0.97


def test_tokens_are_learnt():
    """A class that the training pages drop weighs more than one that they keep, and one like it has its first letters' weight."""
    w = html.trained()["weights"]
    assert w["sponsored"] > 1 > -1 > w["highlight"] and "advertorial" not in w and w["adve-"] > 1
    kept, gone = ('<article><h1>A title of some words</h1>' + f'<p>A paragraph with <span class="{c}">some words</span> in it, long enough to be read, and with a stop.</p>' * 3 + "</article>" for c in ("highlight", "sponsored"))
    model = html.trained()
    a, b = html.extract([kept, gone], model)
    assert a.count("some words in it") == 3 and "some words in it" not in b and b.count("A paragraph with in it, long") == 3
    flat = model | {"weights": {}}
    assert html.extract([gone], flat) != [b]  # the weights decide it


REAL = Path("/root/testdata/sf0.01/pages.parquet")


@pytest.mark.skipif(not REAL.exists(), reason="the driver's tables are not here")
def test_pages_of_another_generator(spark, tmp_path):
    """The driver's pages against a reading that knows how these are built: all blocks of their article element."""
    import html as entities

    def article(page):
        blocks = re.split(r"</?(?:p|h1|h2|li|ul|div|article)[^>]*>", re.search(r"<article>(.*)</article>", page, re.S)[1])
        texts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
        return "\n".join(filter(None, texts))

    pages = spark.read.parquet(str(REAL)).limit(120)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    want = {(r.page_id, r.url): article(r.html) for r in pages.collect()}
    out = html.op3_html_extract(spark, str(tmp_path)).collect()
    assert len(out) == len(want) and all(r.text == want[r.page_id, r.url] and r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("page", ["<a " * 250_000, "<b>" * 60_000 + "<p>x</p>" * 60_000, "<b>" * 150_000 + "</i>" * 150_000, "<p><table><td>" + "<b>" * 50_000 + "<div>x</div>" * 50_000, '<a x=">' * 80_001, "<li>" * 60_000, "<" * 400_000], ids=lambda p: p[:12])
def test_broken_pages_take_linear_time(page):
    """Half a megabyte of unclosed or crossed tags; anything quadratic takes many minutes here."""
    began = time.process_time()
    html.parse(page)
    assert time.process_time() - began < 30


def test_decoding_contradicts_no_ancestor():
    r = np.random.default_rng(1)
    for page in html.sample_pages(20, seed=5):
        nodes, _ = html.parse(page)
        kept = html.decode(nodes, r.normal(0, 4, len(nodes)))
        assert all(kept[n.parent.index] or not kept[n.index] for n in nodes[1:])


def test_decoding_is_the_best(spark):
    """Against all labellings of small trees."""
    r = np.random.default_rng(2)
    for page in ("<div><p>a</p><p>b</p></div><ul><li>c</li></ul>", "<div><section><p>x</p></section></div><p>y</p>"):
        nodes, _ = html.parse(page)
        for _ in range(30):
            odds = r.normal(0, 3, len(nodes))
            score = lambda k: sum(-np.logaddexp(0, -o) if x else -np.logaddexp(0, o) for x, o in zip(k, odds, strict=True))  # noqa: B023, E731
            legal = [k for k in np.ndindex(*[2] * len(nodes)) if k[0] and all(k[n.parent.index] or not k[n.index] for n in nodes[1:])]
            assert abs(score(html.decode(nodes, odds)) - max(map(score, legal))) < 1e-9


# --- licences ----------------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = licences._MIT
    t = [
        mit, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper(), mit.replace(",", " ,").replace("License", "Licence"), mit + " extra", "Some text\nLicensed under CC BY 4.0.\nmore\nSPDX-License-Identifier: MIT",
        None, "", "mit", "the licence of this is none", "released under the mit license", "MIT" + "\n" * 50,
    ]
    got = {r.doc_id: (r.license, r.line_licenses, r.n_lines) for r in licences.scan(docs(spark, t).withColumn("license", F.lit("x")).withColumn("digest", F.lit("x"))).collect()}
    assert [got[i][0] for i in range(11)] == ["MIT", "MIT", "MIT", None, None, None, None, "MIT", None, "MIT", "MIT"]
    assert got[4][1] == "CC-BY-4.0,MIT" and got[5] == (None, "", 0) and got[6] == (None, "", 0) and got[9][1] == "MIT" and got[10][2] == 1
    assert licences.scan(docs(spark, [])).collect() == []
    assert licences.scan(docs(spark, ["MIT", "MIT"])).count() == 2


def test_known_digests(spark):
    digests = licences.known_digests(spark)
    assert digests.count() == digests.select("digest").distinct().count() > 200
    assert {k for k, _ in licences.DIGESTS} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts here")
def test_whole_texts_of_long_licences(spark):
    t = [Path(f"/usr/share/common-licenses/{n}").read_text() for n in ("GPL-3", "Apache-2.0", "MPL-2.0", "LGPL-2.1")]
    t += [t[0].replace("\n", "\r\n").replace("License", "LICENCE"), "x " + t[0], t[1].split("APPENDIX")[0]]
    got = {r.doc_id: r.license for r in licences.scan(docs(spark, t)).collect()}
    assert [got[i] for i in range(7)] == ["GPL-3.0", "Apache-2.0", "MPL-2.0", "LGPL-2.1", "GPL-3.0", None, "Apache-2.0"]


def test_known_licences_can_be_given(spark):
    known = [("Own-1.0", "You may do as you please."), ("Own-2.0", "All of it\nor none"), ("None", "  ")]
    got = {r.doc_id: (r.license, r.line_licenses) for r in licences.scan(docs(spark, ["you MAY do as you please!", "x\nYou may do, as you please\ny", "MIT", "All of it or none", "", None]), known=known).collect()}
    assert got == {0: ("Own-1.0", "Own-1.0"), 1: (None, "Own-1.0"), 2: (None, ""), 3: ("Own-2.0", "Own-2.0"), 4: (None, ""), 5: (None, "")}
    assert licences.scan(docs(spark, ["MIT"]), known=[]).first().license is None


def test_other_spellings_of_names(spark):
    """The canonical form takes all but letters and digits for a space, _ too: lines are looked up by that form and nothing else."""
    lines = ["_MIT_", "__ISC__", "_Apache-2.0_", "_CC0-1.0_", "a_mit_b", "_permit_", "some text\nGPL_3.0\nend", "CC_BY_4.0", "MPL_2.0", "AGPL_3.0", "__Apache_2.0__", "«MIT»", "Licenced under the GPL-3.0"]
    got = {r.doc_id: r.line_licenses for r in licences.scan(docs(spark, lines)).collect()}
    assert [got[i] for i in range(13)] == ["MIT", "ISC", "Apache-2.0", "CC0-1.0", "", "", "GPL-3.0", "CC-BY-4.0", "MPL-2.0", "AGPL-3.0", "Apache-2.0", "MIT", "GPL-3.0"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(13), "text": lines}))
    assert {i: x for i, _, _, _, x in con.execute(licences.OP4_SQL).fetchall()} == got


# --- top-k -------------------------------------------------------------------------------------------------------------


def brute_top(vectors, asks, k):
    """Every row that asks against every other row, equal ones too."""
    rows = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(rows):
        if asks(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "query_block"), [(4096, 512), (16, 3)])
def test_top_k(spark, block, query_block):
    r = random.Random(4)
    vectors = [(i, [r.gauss(0, 1) * 10 ** r.randint(-2, 2) for _ in range(8)]) for i in range(150)]
    vectors += [(i, [1.0] * 8) for i in range(200, 230)]  # ties
    vectors += [(300, None), (301, []), (302, [None] * 8), (303, [float("nan")] + [0.0] * 7), (304, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (305, [1.0, 2.0]), (310, [2.0, 1.0]), (320, [1.0] * 3)]
    vectors += [(0, vectors[0][1]), (10, [0.5] * 8), (7, vectors[7][1]), (210, [1.0] * 8), (350, [0.0] * 8)]  # repeated rows, and ids with two vectors
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("dim", F.lit(2)).withColumn("v", F.lit(3))
    for n in (5, 3):
        got = topk.top_k(df.repartition(n), F.col("vec_id") % 10 == 0, 10, block=block, query_block=query_block)
        assert sorted(tuple(x) for x in got.collect()) == brute_top(vectors, lambda i: i % 10 == 0, 10)
    assert topk.top_k(df.limit(0), F.lit(True), 3).collect() == [] and topk.top_k(df, F.lit(False), 3).collect() == []
    assert topk.top_k(df, F.lit(None).cast("boolean"), 3).collect() == []


def test_bounds_hold():
    """The exact score is within the slack of the middle, for vectors of every size."""
    r = np.random.default_rng(5)
    for scale in (1, 50, 4000, 10**6):
        v, q = r.integers(-scale, scale + 1, (300, 24)), r.integers(-scale, scale + 1, (7, 24))
        width = -(-(int(np.abs(v).max()) + 1) // topk.CELLS)
        mid, slack = topk.bounds(q, np.floor_divide(v, width).astype(np.int8), width)
        assert (np.abs(mid - q @ v.T) <= slack[:, None]).all()
        assert (slack < 0.2 * np.abs(q).sum(axis=1) * scale + 2).all()  # and they bound something


def test_one_very_common_vector(spark):
    """No row of a copy beyond k + 1 is scored, and all copies ask."""
    vectors = [(i, [1.0, 2.0]) for i in range(400)] + [(i, [float(i % 7), 1.0]) for i in range(400, 440)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(6)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5)
    assert sorted(tuple(x) for x in got.collect()) == brute_top(vectors, lambda i: i % 20 == 0, 5)


# --- sharding ----------------------------------------------------------------------------------------------------------


def test_shards(spark, tmp_path):
    t = [f"text {i % 7}" for i in range(300)] + ["same"] * 200 + [None] * 20 + [""] * 20 + ["long " * 50_000]
    df = docs(spark, t).withColumn("_n", F.lit(1)).withColumn("_bucket", F.lit(2)).repartition(7)
    runs = [sorted((r.doc_id, r._shard, r._slot) for r in sharding.shuffle_shards(df, 16).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and [i for i, _, _ in runs[0]] == list(range(len(t)))
    slots = {}
    for _, s, k in runs[0]:
        slots.setdefault(s, []).append(k)
    assert sorted(slots) == list(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({s for i, s, _ in runs[0] if 300 <= i < 500}) == 16  # copies are spread
    again = [(r.doc_id, r._shard, r._slot) for r in sharding.shuffle_shards(df.repartition(3), 16).collect()]
    assert sorted(again) == runs[0]  # however the rows come
    order = [i for i, s, k in sorted(runs[0], key=lambda x: (x[2], x[1]))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.2
    back = sharding.write_shards(df, str(tmp_path / "out"), n_shards=4)
    assert back.count() == len(t) and back.select("_shard").distinct().count() == 4


@pytest.mark.parametrize("parts", [3, 7])
def test_reruns_agree(spark, parts):
    """Rows that differ in one column only, or in none, over other partitions and another number of shuffle partitions."""
    rows = [(None, "", f"s{i % 5}") for i in range(40)] + [(1, "same", f"u{i}") for i in range(200)] + [(2, "copy", "c")] * 300 + [(None, None, None)] * 50
    df = spark.createDataFrame(rows, KIND)
    shards = lambda d: sorted(((r.doc_id, r.text, r.source, r._shard, r._slot) for r in sharding.shuffle_shards(d, 16).collect()), key=repr)
    mixed = lambda d: sorted(((x["doc_id"], x["source"], x["size"], x["k"], x["begin"], x["words"], x["slot"]) for x in mixing.mix(d, block=8).collect()), key=repr)
    want = shards(df), mixed(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    try:
        again = df.orderBy(F.rand(parts)).repartition(parts)
        again = spark.createDataFrame(again.collect(), KIND).repartition(parts)
        assert (shards(again), mixed(again)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({s for i, _, _, s, _ in want[0] if i == 2}) == 16  # a row that is repeated is spread


def test_numbers_of_equal_rows(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 2 + [(f"c{i}",) for i in range(20)], "k string").repartition(5)
    got = Counter((r.k, r.n) for r in common.numbered(df, ["k"], "n").collect())
    assert got == Counter([("a", i) for i in range(90)] + [("b", 0), ("b", 1)] + [(f"c{i}", 0) for i in range(20)])
    assert {r.n for r in common.numbered(df.filter("k > 'c'"), ["k"], "n").collect()} == {0}


def test_buckets_hang_on_the_data_alone():
    assert sharding.n_buckets(0, 0) == 1 and sharding.n_buckets(10, 10**9) == 120 and sharding.n_buckets(10**10, 10**14) == -(-(10**14) // (512 << 20))


def test_shard_query(spark, tmp_path):
    t = ["ä", None, "", "x"]
    docs(spark, t).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in sharding.op7_shard_shuffle(spark, str(tmp_path)).collect()}
    assert got == {i: (len((x or "").encode()) + 1, zlib.crc32((x or "").encode()), "rows", None) for i, x in enumerate(t)}
    assert sharding.shuffle_shards(docs(spark, [])).collect() == []
    nulls = spark.createDataFrame([(None, None, None)] * 40, KIND)
    assert sorted(Counter(r._shard for r in sharding.shuffle_shards(nulls, 16).collect()).values()) == [2] * 8 + [3] * 8


# --- quality rules -----------------------------------------------------------------------------------------------------


def brute_metrics(t):
    t = t or ""
    w = re.findall(WORD, t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def brute_rates(judged):
    """Failures of each host, shrunk to the beta prior that fits the hosts' rates by their moments."""
    hosts = {h: [f for x, f in judged if x == h] for h, _ in judged if h is not None}
    n = sum(map(len, hosts.values()))
    m = sum(map(sum, hosts.values())) / n
    spread = sum(len(f) * (sum(f) / len(f) - m) ** 2 for f in hosts.values()) / n - m * (1 - m) * (len(hosts) - 1) / n
    k = min(max(m * (1 - m) / max(spread, 1e-9) - 1, 1.0), 1e6)
    return {h: (sum(f) + k * m) / (len(f) + k) for h, f in hosts.items()}


def test_quality_rules(spark):
    r = random.Random(6)
    say = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    t = [say(r.randint(1, 200), r.choice([3, 50, 5000])) for _ in range(150)] + [*ODD, "a\na\nb\n\n \na", "# * $ | < >", "one two three one two three", say(30_000, 9)]
    hosts = [r.choice(["good", "good", "bad", None]) for _ in t]
    hosts += ["good"] * 150
    t += [say(80, 9999) for _ in range(150)]
    t = [say(10, 5) if h == "bad" and r.random() < 0.9 else x for x, h in zip(t, hosts, strict=True)]
    df = docs(spark, t, hosts).withColumn("_m", F.lit(1)).withColumn("base_failed", F.lit("x"))
    got = {x.doc_id: x for x in quality.judge(df).collect()}
    assert len(got) == len(t)
    rates = brute_rates([(h, (m := brute_metrics(x))[0] < 50 or 2 * m[4] > m[0]) for h, x in zip(hosts, t, strict=True)])
    assert rates["good"] <= 0.5 < rates["bad"]
    for i, x in enumerate(t):
        m = brute_metrics(x)
        assert tuple(got[i][c] for c in quality.METRICS) == m, repr(x)
        assert got[i].base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        rate = rates.get(hosts[i])
        assert got[i].host_rate == (rate if rate is None else pytest.approx(rate))
        assert got[i].kept == (not got[i].base_failed and (rate is None or rate <= 0.5))
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i in got if got[i].kept)
    assert quality.judge(docs(spark, [])).collect() == [] and quality.filter_documents(docs(spark, [])).collect() == []


def test_many_hosts(spark, monkeypatch):
    """Hosts that are too many to broadcast meet their rows by host and salt; the verdicts are the same."""
    r = random.Random(3)
    df = docs(spark, [" ".join(f"w{r.randrange(900)}" for _ in range(r.choice([10, 90]))) for _ in range(300)], [r.choice(["big", "big", None, *(f"h{k}" for k in range(30))]) for _ in range(300)])

    def verdicts():
        judged = quality.judge(df).select("doc_id", "kept", F.round("host_rate", 9)).collect()
        return sorted(map(tuple, judged)), sorted(x.doc_id for x in quality.filter_documents(df).collect())

    want = verdicts()
    monkeypatch.setattr(common, "FEW_ROWS", 2)
    assert verdicts() == want


def test_rates_shrink(spark):
    """A host with one failure is not judged by it alone."""
    rows = [("small", True)] + [(f"h{i % 20}", i % 10 == 0) for i in range(2000)] + [("rotten", True)] * 300
    got = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert not got["rotten"].host_ok and got["small"].rate < 0.9 < got["rotten"].rate and got["h1"].host_ok


# --- mixing ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, most=2.0):
    """Resharing until no source is above its limit. sizes in the order of the sources."""
    w = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    left, fixed = share * sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        total = left - sum(fixed.values())
        over = [k for k in free if w[k] * total / sum(w[j] for j in free) > most * sizes[k] + 1e-9]
        if not over:
            return [fixed.get(k, w[k] * total / sum(w[j] for j in free) if k in free else 0) for k in range(len(sizes))]
        fixed |= {k: most * sizes[k] for k in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 10, 1000, 10**6]) * r.randint(1, 9) for _ in range(r.randint(1, 8))]
    rows = [(f"s{k}" if k < len(sizes) - 1 or seed % 2 else None, x) for k, x in enumerate(sizes)]
    got = mixing.targets(spark.createDataFrame(rows, "source string, size long")).orderBy("source_rank").collect()
    assert [x.source for x in got] == [s for s, _ in rows]
    assert [x.target for x in got] == pytest.approx(brute_targets(sizes))


def test_mix(spark, tmp_path):
    r = random.Random(8)
    sources = [r.choice(["a", "a", "a", "b", "c", "é", None]) for _ in range(300)]
    t = [" ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 80, 400]))) for _ in sources]
    t[5], t[6], t[7] = None, " \n", "one " * 30_000
    df = docs(spark, t, sources).withColumn("size", F.lit(1)).withColumn("slot", F.lit(2))
    spans = [x.asDict() for x in mixing.mix(df, block=64).collect()]
    again = [x.asDict() for x in mixing.mix(df.repartition(5), block=64).collect()]
    key = lambda x: (x["doc_id"], x["k"], x["begin"], x["words"], x["slot"], x["pass"])
    assert sorted(map(key, spans), key=repr) == sorted(map(key, again), key=repr)  # reruns agree
    taken = Counter()
    for x in spans:
        taken[x["doc_id"]] += x["words"]
    size = [len(re.findall(WORD, x or "")) for x in t]
    assert set(taken) == set(range(len(t))) and all(taken[i] <= 2 * size[i] for i in taken)
    for s in set(sources):
        got, target = sum(taken[i] for i in taken if sources[i] == s), next(x["target"] for x in spans if x["source"] == s)
        assert abs(got - target) <= 1, s
    # Slots hold one block each, blocks of the last rank may be short, and every prefix of the schedule keeps the weights.
    blocks = {}
    for x in spans:
        if x["slot"] is not None:
            assert blocks.setdefault(x["slot"], (x["source"], x["k"])) == (x["source"], x["k"])
    places = sorted(blocks)
    assert len(places) == len({(x["source"], x["k"]) for x in spans if x["words"]}) and all(x["slot"] is not None for x in spans if x["words"])  # every block has its slot
    share = Counter(blocks[p][0] for p in places)
    for n in (len(places) // 4, len(places) // 2):
        head = Counter(blocks[p][0] for p in places[:n])
        assert all(abs(head[s] / n - share[s] / len(places)) < 0.06 for s in share)
    out = mixing.mix_documents(df, block=64)
    assert out.columns == df.columns
    # Rows come in the order of the slots in which the passes begin, and differ from that of a schedule of another kind.
    begins = sorted((x["slot"], x["at"], x["doc_id"]) for x in spans if x["words"] and x["begin"] == 0)
    assert [x.doc_id for x in out.collect()] == [i for _, _, i in begins]
    words = Counter()
    for x in out.collect():
        words[x.doc_id] += len(re.findall(WORD, x.text or ""))
    whole = Counter()
    for x in mixing.mix(df).collect():
        whole[x["doc_id"]] += x["words"]
    assert words == +whole
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op10_mix_sources(spark, str(tmp_path)).count() == len(t)


def brute_slots(n_blocks):
    """Golden-ratio points through the cumulative numbers of blocks, in whole numbers; what has no point comes last."""
    n, edges, hi = sum(n_blocks), [], 0
    for b in n_blocks:
        edges.append((hi * mixing.UNITS // n, (hi + b) * mixing.UNITS // n))
        hi += b
    out, have = {}, [0] * len(n_blocks)
    for slot in range(n):
        x = (slot * mixing.GOLDEN % (1 << 62)) >> 31
        (s,) = [s for s, (a, b) in enumerate(edges) if a <= x < b]
        if have[s] < n_blocks[s]:
            out[s, have[s]] = slot
        have[s] += 1
    for s, b in enumerate(n_blocks):
        for k in range(have[s], b):
            out[s, k] = n + sum(max(0, b - h) for b, h in zip(n_blocks[:s], have[:s], strict=True)) + k - have[s]
    return out


@pytest.mark.parametrize("n_blocks", [[1], [3, 1, 1], [500, 200, 100, 7, 1], [40] * 30])
def test_schedule(spark, n_blocks):
    got = mixing.schedule(spark, spark.createDataFrame(list(enumerate(n_blocks)), "source_rank int, n_blocks long"), chunk=16)
    assert {(r.source_rank, r.k): r.slot for r in got.collect()} == brute_slots(n_blocks)


def test_points_of_large_slots(spark):
    slots = [0, 1, 2**31 - 1, 2**31, 2**40 + 12345, 2**52 - 1]
    got = spark.createDataFrame([(x,) for x in slots], "x long").select(mixing.point(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == [(x * mixing.GOLDEN % 2**62) >> 31 for x in slots]


def test_mix_of_little(spark):
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.mix_documents(docs(spark, [])).collect() == []
    (x,) = mixing.mix(docs(spark, [None])).collect()
    assert (x.words, x.target) == (0, 0.0)
    rows = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], KIND)
    assert sum(x.words for x in mixing.mix(rows).collect()) in (7, 8)  # 150 % of 5
