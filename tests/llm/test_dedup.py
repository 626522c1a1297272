"""SimHash, lines and substrings, against brute force over small tables that hold the awkward cases."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeframe.llm import alike, common, components, linededup, simhash, substrings
from treeframe.llm.common import WORD

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1):
    """Copies, near copies, nulls, empty and long texts, equal ids, repeated rows, odd white space."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choices(WORDS, k=n))
    out = [(i, say(r.randint(1, 200))) for i in range(60)]
    base = say(300)
    for i in range(60, 75):
        w = base.split()
        w[r.randrange(300)] = f"x{i}"
        out.append((i, " ".join(w)))
    passage = say(60)
    out += [(80 + i, f"{say(20)}\n{passage}\n{say(20)}") for i in range(4)]
    out += [(90, None), (91, ""), (92, None), (93, "  \n\t "), (94, "one"), (95, "one two"), (96, "ONE two"), (97, "a b c\x0bd"), (98, say(20_000)), (99, out[3][1]), (99, out[3][1]), (3, out[3][1]), (3, "other text of the same id")]
    out += [(None, say(40)), (None, None), (100, "\n".join([say(12)] * 4)), (101, "z " * 50), (102, "Ünï " * 40)]
    return [(i, t, "s" if n % 3 else None) for n, (i, t) in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5)


# --- SimHash -----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(WORD, text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root(i) != root(j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _, _), c in zip(rows, roots, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, _, _), f, c in zip(rows, fps, roots, strict=True)), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == want
    kept = simhash.dedup_documents(frame(spark, rows).withColumn("uid", F.lit(1)).withColumn("fp", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "source", "uid", "fp"] and kept.count() == len(set(roots))
    ids = {least.get(c) for c in roots}
    assert {r.doc_id for r in kept.collect()} == ids


def brute_alike(rows, similarity):
    """Roots of the rows, linked by fingerprints or by the Jaccard similarity of 5-word shingles."""
    words = [re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, _ in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    roots = brute_components([brute_fingerprint(t) for _, t, _ in rows])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and len(x & y) >= similarity * len(x | y):
                roots = [roots[j] if c == roots[i] else c for c in roots]
    return roots


def test_near_copies_beyond_three_bits(spark):
    """Copies with a few words changed are one document for the pipeline's stage, also where their fingerprints are far apart."""
    r = random.Random(9)
    rows = corpus()
    for i in range(200, 240):
        w = r.choices(WORDS, k=r.randint(60, 250))
        rows.append((i, " ".join(w), "s"))
        for k in r.sample(range(len(w)), r.randint(1, len(w) // 30)):
            w[k] = f"x{i}"
        rows.append((i + 100, " ".join(w), None))
    strict, want = brute_components([brute_fingerprint(t) for _, t, _ in rows]), brute_alike(rows, 0.8)
    assert len(set(want)) < len(set(strict)) - 10
    least = {}
    for (i, _, _), c in zip(rows, want, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    kept = simhash.dedup_documents(frame(spark, rows), similarity=0.8).collect()
    assert len(kept) == len(set(want)) and {x.doc_id for x in kept} == {least.get(c) for c in want}
    assert simhash.dedup_documents(frame(spark, []), similarity=0.8).collect() == []


def groups(seed=13):
    """Texts that are alike only in a centre that nothing tells from the others, also in two groups of one passage, and equal ones."""
    r = random.Random(seed)
    fresh = iter(range(10**6))
    out = []
    passage = r.choices(WORDS, k=40)
    for base in (r.choices(WORDS, k=60), passage + r.choices(WORDS, k=20), passage + r.choices(WORDS, k=24)):
        group = [base]
        for _ in range(60):
            w = list(base)
            w[r.randrange(5, len(w) - 5)] = f"new{next(fresh)}"
            if r.random() < 0.3:
                w.append(f"new{next(fresh)}")
            group.append(w)
        out += group + [group[7], [x.upper() for x in group[9]]]
    out += [r.choices(WORDS, k=n) for n in (4, 5, 6, 50)] + [passage, []]
    r.shuffle(out)
    return [(i, " ".join(w), None) for i, w in enumerate(out)]


@pytest.mark.parametrize("how", [{}, {"hot_rows": 7}, {"few": 1}, {"hot_rows": 20, "few": 2}])
def test_alike_leaves_no_link_out(spark, how):
    """Links connect exactly what the sets connect, though in a group of 60 that share shingles most are alike with one only."""
    rows = groups()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").lower().split() for _, t, _ in rows)]
    want, got = list(range(len(rows))), list(range(len(rows)))
    wrong = 0

    def join(roots, i, j):
        return [roots[j] if c == roots[i] else c for c in roots] if roots[i] != roots[j] else roots

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and len(x & y) >= 0.8 * len(x | y):
                want = join(want, i, j)
    for a, b in alike.alike(frame(spark, rows).selectExpr("doc_id AS uid", "text"), 0.8, **how).collect():
        got = join(got, a, b)
        wrong += len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    assert not wrong
    classes = lambda roots: {frozenset(i for i, c in enumerate(roots) if c == d) for d in roots}
    assert classes(got) == classes(want)


def test_no_alike_sets_are_ruled_out():
    """Sets of the similarity share a first shingle in any order and differ in no more marks than in shingles."""
    r = np.random.default_rng(3)
    near = 0
    for _ in range(3000):
        both = r.integers(0, 1 << 63, int(r.integers(1, 80)), np.uint64)
        x, y = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, int(r.integers(0, 2 + len(both) // 6)), np.uint64)])) for _ in range(2))
        common = len(np.intersect1d(x, y))
        differ = sum((a ^ b).bit_count() for a, b in zip(alike.marks(x), alike.marks(y), strict=True))
        assert differ <= len(x) + len(y) - 2 * common
        if common >= 0.8 * (len(x) + len(y) - common):
            near += 1
            frequent = np.sort(r.choice(np.union1d(x, y), len(x) // 2, replace=False))
            counts = r.integers(2, 9, len(frequent))
            assert len(np.intersect1d(alike.first(x, 0.8, frequent, counts), alike.first(y, 0.8, frequent, counts)))
            assert alike.possible(np.array(len(x)), np.array(len(y)), np.array(differ), 0.8)
    assert near > 500


def test_wide_marks_tell_long_texts_apart():
    """Also where one side's marks are twice as wide; what is similar stays, and what has no wide marks."""
    r = np.random.default_rng(4)
    rows, similar = [], []
    for k in range(200):
        both = r.integers(0, 1 << 63, int(r.integers(1500, 9000)), np.uint64)
        x, y = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, len(both) // int(r.integers(2, 40)), np.uint64)])) for _ in range(2))
        common = len(both) if k % 2 else 0
        y = y if k % 2 else r.integers(0, 1 << 63, len(x), np.uint64)
        rows.append((k, -k, len(x), len(y), *(alike.marks(z, 1 << (len(z) - 1).bit_length()) for z in (x, y))))
        if common >= 0.8 * (len(x) + len(y) - common):
            similar.append(k)
    rows.append((200, -200, 9, None, None, rows[0][5]))
    batch = pa.RecordBatch.from_pylist([dict(zip("abnmxy", x, strict=True)) for x in rows])
    got = {x for b in alike._wide(0.8)(iter([batch, batch.slice(0, 0)])) for x in b.column(0).to_pylist()}
    assert len(similar) > 30 and {*similar, 200} <= got and not {k for k in got if k % 2 == 0 and k < 200}


@pytest.mark.parametrize("step", [1, 2, 3, 100])
def test_shared_keys_over_batches(step):
    rows = [(1, 5), (2, 8), (2, 10), (3, 9), (4, 7), (4, 7), (4, 8), (4, 20), (4, 30), (4, 31), (5, 1), (6, 10), (6, 13), (7, 2), (7, 2)]
    batches = [pa.RecordBatch.from_pylist([{"key": k, "id": i + j, "n": n} for j, (k, n) in enumerate(rows[i : i + step])]) for i in range(0, len(rows), step)]
    batches.insert(1, batches[0].slice(0, 0))
    got = [x for b in alike._shared(0.8)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    near = lambda n, m: min(n, m) >= 0.8 * max(n, m)
    assert sorted(got) == [(k, i) for i, (k, n) in enumerate(rows) if any(k == l and i != j and near(n, m) for j, (l, m) in enumerate(rows))]


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_no_comparison_without_room(step):
    """Rows whose key stands too late in their sets for any other go; none goes that has one to be compared with."""
    r = random.Random(2)
    rows = sorted((k, n := r.randint(20, 60), r.randint(n - n // 5 - 1, n)) for k in range(60) for _ in range(r.randint(1, 7)))
    rows += [(99, 100, 81)] * 4
    batches = [pa.RecordBatch.from_pylist([{"key": k, "id": i + j, "n": n, "room": room} for j, (k, n, room) in enumerate(rows[i : i + step])]) for i in range(0, len(rows), step)]
    got = [x for b in alike._shared(0.8)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    meets = lambda x, y: x[0] == y[0] and 1.8 * min(x[2], y[2]) >= 0.8 * (x[1] + y[1]) and min(x[1], y[1]) >= 0.8 * max(x[1], y[1])
    want = {(x[0], i, x[2]) for i, x in enumerate(rows) if any(i != j and meets(x, y) for j, y in enumerate(rows))}
    assert len(got) == len(set(got)) and want <= set(got) and len(got) < 0.8 * len(rows) and not any(k == 99 for k, *_ in got)


@pytest.mark.parametrize("hot", [1, 5, 4096])
def test_links_join_all_that_are_near(spark, hot):
    """Fingerprints around a few centres, with every number of differing bits; also where all anchors count as hot."""
    r = random.Random(5)
    fps = set()
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(25):
            fps.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))))
    fps = sorted(fps)
    roots = brute_components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot_homes=hot)
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in links.collect()]
    of = dict(zip(fps, roots, strict=True))
    assert all(a != b and of[a] == of[b] for a, b in pairs)  # none between what should be apart
    found = {r.node % (1 << 64): r.root for r in components.components(links).collect()}
    groups = {}
    for x, c in zip(fps, roots, strict=True):
        groups.setdefault(c, set()).add(x)
    for g in groups.values():
        assert len({found.get(x, ("alone", x)) for x in g}) == 1
    assert len({found[x] for x in fps if x in found}) == sum(len(g) > 1 for g in groups.values())


def test_components_of_long_paths(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(500, 501), (7, 7), (501, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n + 1), 0) | {500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_few_links_take_no_rounds(spark, monkeypatch, few):
    """Two tables are written for few links, and the components are those of the rounds."""
    monkeypatch.setattr(components, "FEW_LINKS", few)
    written, store = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df: written.append(1) or store(df))
    r = random.Random(4)
    edges = [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(50)]
    roots = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((roots[a], roots[b]))
        roots = {x: low if c == high else c for x, c in roots.items()}
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: roots[x] for x in linked}
    assert len(written) > 6 if few == 0 else len(written) == 2


# --- lines -------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=1):
    """Every repeated run of lines with words that has `least` words, longest or not: later copies go."""
    docs = sorted({(i is None, i or 0, t) for i, t, _ in rows if t is not None})
    lines = [[(x, len(re.findall(WORD, x))) for x in t.split("\n") if re.search(WORD, x)] for _, _, t in docs]
    seen, gone = set(), [set() for _ in docs]
    for d, ls in enumerate(lines):
        for b in range(len(ls)):
            for e in range(b + 1, len(ls) + 1):
                if sum(n for _, n in ls[b:e]) >= least:
                    run = tuple(x for x, _ in ls[b:e])
                    if run in seen:
                        gone[d].update(range(b, e))
                    seen.add(run)
    return {(None if none else i, t): g for (none, i, t), g in zip(docs, gone, strict=True)}


def line_corpus(seed=2):
    r = random.Random(seed)
    line = lambda: " ".join(r.choices(WORDS, k=r.randint(1, 8)))
    pool = [line() for _ in range(12)]
    out = []
    for i in range(60):
        out.append((i, "\n".join(r.choice([line(), "", "  ", *pool, *pool]) for _ in range(r.randint(1, 14)))))
    out += [(60, None), (61, ""), (62, "\n\n"), (63, out[5][1]), (64, out[5][1]), (64, out[5][1]), (65, "only line of ten words here a b c d e f"), (66, "only line of ten words here a b c d e f"), (None, out[7][1]), (67, "\n".join([pool[0] + " one two three four five six seven eight nine"] * 40))]
    return [(i, t, None) for i, t in out]


def brute_runs(rows):
    """For each document the maximal runs (first line, lines) that also start earlier, by comparing every two places."""
    docs = sorted({(i is None, i or 0, t) for i, t, _ in rows if t is not None})
    lines = [[x for x in t.split("\n") if re.search(WORD, x)] for _, _, t in docs]
    out = {}
    for d, (none, i, t) in enumerate(docs):
        longest = []
        for b in range(len(lines[d])):
            m = 0
            for e in range(d + 1):
                for c in range(b if e == d else len(lines[e])):
                    n = 0
                    while b + n < len(lines[d]) and c + n < len(lines[e]) and lines[d][b + n] == lines[e][c + n]:
                        n += 1
                    m = max(m, n)
            longest.append(m)
        out[None if none else i, t] = [(b, m) for b, m in enumerate(longest) if m and not (b and longest[b - 1] == m + 1)]
    return out


def without(text, gone):
    """The text without the lines of those numbers; a line without words goes or stays with the line before it."""
    out, i, drop = [], -1, False
    for x in text.split("\n"):
        if re.search(WORD, x):
            i += 1
            drop = i in gone
        if not drop:
            out.append(x)
    return "\n".join(out)


@pytest.mark.parametrize(("least", "few"), [(1, 1 << 17), (10, 1 << 17), (1, 0)])
def test_line_dedup(spark, monkeypatch, least, few):
    """By broadcast of few names, and by joins with written ones."""
    monkeypatch.setattr(linededup, "FEW_ROWS", few)
    rows = line_corpus()
    # Equal ids with different texts are told apart by a hash, which brute force doesn't know: ids here are unique but for equal rows.
    gone, runs = brute_lines(rows, least), brute_runs(rows)
    want = []
    for i, t, _ in rows:
        g, r = gone.get((i, t), set()), runs.get((i, t), [])
        kept = None if t is None else without(t, g)
        want.append((i, kept, 0 if t is None else sum(bool(re.search(WORD, x)) for x in t.split("\n")), len(g), *((len(r), max([m for _, m in r], default=0)) if least == 1 else ())))
    out = linededup.dedup_lines(frame(spark, rows).withColumn("i", F.lit(1)).withColumn("t", F.lit(2)), min_words=least)
    assert out.columns == ["doc_id", "text", "source", "i", "t", "_n_lines", "_n_removed", "_n_runs", "_longest"]
    got = [(r.doc_id, r.text, r._n_lines, r._n_removed, *((r._n_runs, r._longest) if least == 1 else ())) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(g for g in gone.values()) and any(m > 4 for r in runs.values() for _, m in r)


@pytest.mark.parametrize("seed", range(3))
def test_longest_runs(spark, seed):
    """Lines of few kinds, so that runs of all lengths overlap and repeat, also within one document."""
    r = random.Random(seed)
    rows = [(i, "\n".join(r.choice("abc" if seed else "ab") for _ in range(r.randint(1, 40))), None) for i in range(25)]
    rows += [(30, "\n".join("a" * 37), None), (31, rows[3][1] + "\n" + rows[3][1], None)]
    lines = linededup.places(frame(spark, rows), "doc_id", "text")
    lines = lines.sparkSession.createDataFrame(lines.collect(), lines.schema)
    found = {}
    docs = sorted((i, t) for i, t, _ in rows)
    where = {(x.k1, x.k2): None for x in lines.orderBy("p").collect()}
    order = dict(zip(where, docs, strict=True))
    at = {x.p: (order[x.k1, x.k2], x.i) for x in lines.collect()}
    for x in linededup.earlier_runs(lines).collect():
        key, i = at[x.p]
        found.setdefault(key, {})[i] = x.m
    for key, want in brute_runs(rows).items():
        mine = found.get(key, {})
        assert [(b, m) for b, m in sorted(mine.items()) if mine.get(b - 1) != m + 1] == want


def test_removing_lines(spark):
    def cut(text, *runs):
        df = spark.createDataFrame([(text, [(b, m) for b, m in runs])], "t string, runs array<struct<i:int,m:int>>")
        return df.select(linededup.without(F.col("t"), F.col("runs")).alias("c")).first().c.asDict()

    text = "a b\n\nc\n \nd"
    assert cut(text, (1, 1)) == {"text": "a b\n\nd", "n": 1}  # a line without words goes with the line before it
    assert cut(text, (0, 3)) == {"text": "", "n": 3} and cut("\n\n" + text, (0, 2), (1, 2)) == {"text": "\n", "n": 3}
    assert cut("a\nb", (1, 1)) == {"text": "a", "n": 1}


# --- substrings --------------------------------------------------------------------------------------------------------


def brute_substrings(rows, window):
    words = [re.findall(WORD, t or "") for _, t, _ in rows]
    places = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return [(i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (i, _, _), w, g in zip(rows, words, gone, strict=True)]


@pytest.mark.parametrize("window", [35, 10, 9])
def test_substring_dedup(spark, window):
    rows = corpus(3)
    got = [tuple(r) for r in substrings.remove_repeats(frame(spark, rows).withColumn("key", F.lit(1)).withColumn("z", F.lit(2)), window=window).collect()]
    assert sorted(got, key=repr) == sorted(brute_substrings(rows, window), key=repr)


def test_levels():
    assert substrings.levels(35) == [9, 18, 35] and substrings.levels(9) == [9] and substrings.levels(3) == [3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.dedup_documents(empty).collect() == []
    assert linededup.dedup_lines(empty).collect() == [] and substrings.remove_repeats(empty).collect() == []
    nulls = spark.createDataFrame([(None, None, None), (None, None, None)], KIND)
    assert {(r.fingerprint, r.component_id) for r in simhash.near_duplicates(nulls).collect()} == {("0" * 16, None)}
    assert [tuple(r) for r in substrings.remove_repeats(nulls).collect()] == [(None, 0, 0, "")] * 2
    assert [(r.text, r._n_lines) for r in linededup.dedup_lines(nulls).collect()] == [(None, 0)] * 2


def test_queries_agree_with_their_operators(spark, tmp_path):
    frame(spark, corpus(4)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op9_substring_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_substrings(rows, 35)), key=repr)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    roots, least = brute_components(fps), {}
    for (i, _, _), c in zip(rows, roots, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[c]) for (i, _, _), f, c in zip(rows, fps, roots, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op2_simhash_dedup(spark, str(tmp_path)).collect()), key=repr) == want


def test_windows_are_told_apart_by_both_hashes():
    """A window whose first hash repeats but whose second does not stays."""
    words = [b"w%d" % i for i in range(20)]
    h, h2, n = substrings.chosen(words, 9, [])
    assert len(h) == len(set(zip(h.tolist(), h2.tolist(), strict=True))) == 12 and (n == 1).all()
    assert substrings.removed(words, 9, [h], h2).all()
    assert not substrings.removed(words, 9, [h], h2[:0]).any() and substrings.removed(words, 9, [h], h2[:1]).sum() == 9


@pytest.fixture
def unbroadcast(spark):
    """As on large tables, no side of a join is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_op9_moves_texts_once(spark, tmp_path, unbroadcast):
    """Texts are shuffled to meet their copies, and by no level after that."""

    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    r = random.Random(7)
    say = lambda n: " ".join(f"{r.getrandbits(64):x}" for _ in range(n))
    passages = [say(50) for _ in range(100)]
    rows = [(i, f"{say(300)} {passages[i % 100]} {say(300)}", None) for i in range(200)]
    packed = sum(len(pa.compress(t.encode(), "zstd", asbytes=True)) for _, t, _ in rows)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    before = moved()
    got = [(x.doc_id, x.n_words, x.n_removed) for x in substrings.op9_substring_dedup(spark, str(tmp_path)).collect()]
    assert (moved() - before) / packed < 2
    assert sorted(got) == [(i, 650, 50) for i in range(200)]


@pytest.mark.parametrize("limit", [1, 3000])
def test_substring_dedup_over_blocks(spark, unbroadcast, monkeypatch, limit):
    """Windows meet across blocks and inside one; none reaches from a text into the next of its block."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", limit)
    say = " ".join
    rows = corpus(8) + [(200, say(WORDS[:20]), None), (201, say(WORDS[20:40]), None), (202, say(WORDS[:40]), None), (203, say(WORDS[:40] + ["x"]), None)]
    got = [tuple(x) for x in substrings.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute_substrings(rows, 35), key=repr)


def test_windows_of_several_texts():
    """Runs of several texts are counted together, those of copies twice, and none reaches over the end of a text."""
    a, b = [b"a%d" % i for i in range(9)], [b"b%d" % i for i in range(9)]
    text, once = np.repeat(np.arange(3), 9), np.ones(3, np.int64)
    h, _, n = substrings.chosen([*a, *b, *a], 9, [], text, once)
    assert len(h) == 2 and sorted(n.tolist()) == [1, 2]
    assert substrings.chosen([*a, *b, *a], 9, [], text, np.array([1, 2, 1]))[2].tolist() == [2, 2]
    both, h2, _ = substrings.chosen(a, 9, [])
    assert substrings.removed([*a, *b, *a], 9, [both], h2, text).tolist() == [True] * 9 + [False] * 9 + [True] * 9


def test_tables_are_dropped_by_their_owners(spark, tmp_path):
    """Results that were built before another piece of work ended can still be read, and nothing stays once all have ended."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    have = lambda: {p.name for p in root.iterdir()} if root.exists() else set()
    frame(spark, corpus(5)).write.parquet(f"{tmp_path}/documents.parquet")
    before = have()
    with common.scratch(spark):
        built = [q(spark, str(tmp_path)) for q in (simhash.op2_simhash_dedup, linededup.op5_line_dedup, substrings.op9_substring_dedup)]
        with common.scratch(spark):
            linededup.dedup_lines(frame(spark, corpus(6))).count()
        assert [x.count() for x in built] == [len(corpus(5))] * 3 and have() > before
    assert have() == before


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Cluster)
