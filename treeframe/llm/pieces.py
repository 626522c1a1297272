"""SentencePiece encoding and decoding over a relational lattice.

A corpus repeats its words, so the vocabulary is encoded, not the text. Words that stand often are encoded in one relation:
substrings of bounded length are exploded, joined with the piece table by equality, the edges are grouped by word and
folded by a Spark higher-order aggregate. For a unigram model the fold is Viterbi's; for a BPE model (the kind of the
public 32k vocabulary) Viterbi would give other pieces than the model's own rule, so the fold there merges the
neighbours whose joint edge scores best, until no edge joins two neighbours.

The encoded words are a table of at most HOT_WORDS rows, sent to the tasks that encode texts; the words beyond it
are folded where they stand, by the same rule. No text is shuffled. The README has figures on what share of words and of
tokens goes through the relation, and on what all words would cost.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, read, row, stored, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: So many words, the most frequent, are encoded in the relation and broadcast (some 20 MB as Arrow; HOT_CHARS bounds each).
HOT_WORDS = 1 << 19
#: Longer words are never broadcast.
HOT_CHARS = 32
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n\t]+|{SPACE}+|[\n\t]")


class Pieces:
    """What a model file says: pieces, scores, kinds, and how texts are prepared. Read without any library."""

    def __init__(self, blob: bytes) -> None:
        self.blob = blob
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.byte_fallback, self.dummy_prefix, self.extra_spaces, self.escape, self.normalizer, self.unknown = UNIGRAM, False, True, True, True, "", 0
        for field, value in _fields(blob):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, 1))
            elif field == 2:
                p = dict(_fields(value))
                self.model_type, self.byte_fallback, self.unknown = p.get(3, UNIGRAM), bool(p.get(35, 0)), p.get(40, 0)
            elif field == 3:
                p = dict(_fields(value))
                self.normalizer, self.dummy_prefix, self.extra_spaces, self.escape = p.get(1, b"").decode(), bool(p.get(3, 1)), bool(p.get(4, 1)), bool(p.get(5, 1))
        if self.model_type not in (UNIGRAM, BPE) or self.normalizer not in ("identity", "") or self.extra_spaces or not self.escape:
            raise ValueError("only unigram and BPE models that leave the text as it is, spaces escaped, are read here")
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, self.kinds, strict=True) if k == 1):
            raise ValueError("pieces that reach over a space are not read here")
        self._index()

    def _index(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, 4)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.longest = max(map(len, self.ids), default=1)
        #: An edge of the lattice is keyed by its begin times this plus its length.
        self.stride = self.longest + 1
        #: Places of the scores, the best first; equal scores share a place.
        places = {x: k for k, x in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank, self.unranked = {p: places[self.scores[i]] for p, i in self.ids.items()}, len(places)
        #: What an id adds to a text; None for bytes, which need their neighbours.
        self.plain = [None if k == 6 else "" if k == 3 else " ⁇ " if k == 2 else p for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.apart = [p for p in self.ids if len(p) > 1 and any(c in p for c in "\n\t")]
        if self.apart:
            raise ValueError("pieces with line ends or tabs are not read here")

    @classmethod
    def of(cls, entries: list[tuple[str, float]], model_type: int, byte_fallback: bool = True) -> Pieces:
        """A model of (piece, score) pairs, for tests: <unk> is 0, then the bytes, then the pieces."""
        self = cls.__new__(cls)
        self.blob = b""
        self.pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *(p for p, _ in entries)]
        self.scores = [0.0] * 257 + [s for _, s in entries]
        self.kinds = [2] + [6] * 256 + [1] * len(entries)
        self.model_type, self.byte_fallback, self.dummy_prefix, self.unknown = model_type, byte_fallback, True, 0
        self._index()
        return self

    def chunks(self, text: str) -> list[str]:
        """The parts of a text that pieces don't reach over, with spaces escaped."""
        if not text:
            return []
        return _CHUNK.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))

    def runs(self, text: str) -> Iterator[tuple[list[str], bool]]:
        """The chunks of a text in order, in lists; True: each is meant with one space before it.

        Most lines have single spaces alone, and str.split() cuts these; the others go through chunks().
        """
        for k, line in enumerate(text.split("\n")):
            if k:
                yield ["\n"], False
            begins = self.dummy_prefix and not k
            if line and "  " not in line and "\t" not in line and SPACE not in line and line[0] != " " and line[-1] != " ":
                own = line.split(" ")
                if begins:
                    yield own, True
                else:
                    yield own[:1], False
                    yield own[1:], True
            else:
                for c in _CHUNK.findall((SPACE if begins else "") + line.replace(" ", SPACE)):
                    alone = c[:1] == SPACE and c[1:2] not in ("", SPACE)
                    yield [c[1:] if alone else c], alone

    def fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.byte_fallback else [self.unknown]

    def fold(self, word: str) -> list[int]:
        """The ids of a word, as the relation's fold finds them."""
        parts = self._merge(word) if self.model_type == BPE else self._viterbi(word)
        out = [self.ids.get(p) for p in parts]
        if None in out:
            return [x for p, i in zip(parts, out, strict=True) for x in ([i] if i is not None else [x for c in p for x in self.fallback(c)])]
        return out

    def _merge(self, word: str) -> list[str]:
        """The edge that joins two neighbours is looked up once, and again only where a neighbour has changed."""
        s, rank, none = list(word), self.rank.get, self.unranked
        edges = [rank(a + b, none) for a, b in zip(s, s[1:])]  # noqa: B905
        while edges:
            best = min(edges)
            if best == none:
                break
            i = edges.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del edges[i]
            if i < len(edges):
                edges[i] = rank(s[i] + s[i + 1], none)
            if i:
                edges[i - 1] = rank(s[i - 1] + s[i], none)
        return s

    def _viterbi(self, word: str) -> list[str]:
        worst = min(self.scores[i] for i in self.ids.values()) - 10.0
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            top = None
            for i in range(max(0, j - self.longest), j):
                k = self.ids.get(word[i:j])
                score = self.scores[k] if k is not None else worst if j == i + 1 else None
                if score is not None and (top is None or best[i][0] + score > top[0]):
                    top = (best[i][0] + score, i)
            best.append(top)
        out, j = [], len(word)
        while j:
            out.append(word[best[j][1] : j])
            j = best[j][1]
        return out[::-1]

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score): as many rows as the model has pieces."""
        return spark.createDataFrame([(p, i, float(self.scores[i])) for p, i in self.ids.items()], "piece string, id int, score double")

    def spelled(self, ids: list[int]) -> str:
        """The pieces of the ids one after another, runs of bytes read as UTF-8; spaces are still escaped."""
        parts = [self.plain[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out, raw = [], bytearray()
        for i, p in zip(ids, parts, strict=True):
            if p is None:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(p)
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def unescaped(self, spelled: str) -> str:
        text = spelled.replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        return self.unescaped(self.spelled(ids))


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(blob):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, blob[at : at + n]
            at += n


def load(path: str = MODEL) -> Pieces:
    """The model in a file; read by the driver and sent to the executors with the task, so only the driver needs the file."""
    with open(path, "rb") as f:
        return Pieces(f.read())


def lattice(words: DataFrame, model: Pieces) -> DataFrame:
    """words(word) with ids: each word's edges joined with the piece table and folded.

    Words are different and not empty. They are dealt by word once; exploding, the broadcast join (a table of the model's
    size) and the grouping keep that, so nothing else is shuffled.
    """
    pieces = F.broadcast(model.table(words.sparkSession))
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // 8192))
    words = words.select("word", F.char_length("word").alias("n")).repartition(tasks, "word")
    begins = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    subs = begins.select("word", "n", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("i") + 1))).alias("m"))
    edges = subs.withColumn("piece", F.substring(F.col("word"), F.col("i"), F.col("m"))).join(pieces, "piece", "left").filter("id IS NOT NULL OR m = 1")
    grouped = edges.groupBy("word", "n").agg(F.collect_list(F.struct("i", "m", "id", "score")).alias("e"))
    by_place = F.map_from_entries(F.transform("e", lambda e: F.struct((e["i"] * model.stride + e["m"]).alias("k"), F.struct(e["id"].alias("id"), e["score"].alias("score")).alias("v"))))
    grouped = grouped.withColumn("edges", by_place)
    fold = _fold_bpe if model.model_type == BPE else _fold_viterbi
    worst = min((model.scores[i] for i in model.ids.values()), default=0.0) - 10.0
    spans = grouped.select("word", "edges", fold(F.col("n"), F.col("edges"), worst, model).alias("spans"))
    # A span without a piece is one character: its bytes.
    first = min(model.bytes.values(), default=0)
    utf8 = lambda c: F.filter(F.split(F.regexp_replace(F.hex(c.cast("binary")), "(..)", "$1,"), ","), lambda x: x != "")
    as_bytes = lambda c: F.transform(utf8(c), lambda x: F.conv(x, 16, 10).cast("int") + first) if model.byte_fallback else F.array(F.lit(model.unknown))
    ids = F.flatten(
        F.transform(
            "spans",
            lambda s: let(
                F.try_element_at("edges", s["i"] * model.stride + s["m"])["id"],
                lambda k: F.when(k.isNotNull(), F.array(k)).otherwise(as_bytes(F.substring(F.col("word"), s["i"], s["m"]))),
            ),
        )
    )
    return spans.select("word", ids.alias("ids"))


def _fold_bpe(n: Column, edges: Column, worst: float, model: Pieces) -> Column:
    """Symbols (i, m) in order; each of n - 1 rounds joins the neighbours of the best edge, the leftmost of equal ones."""
    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.lit(1).alias("m")))

    def merge(s: Column, _: Column) -> Column:
        def edge(x: Column, k: Column) -> Column:
            whole = x["m"] + F.get(s, k + 1)["m"]
            return F.struct(F.try_element_at(edges, x["i"] * model.stride + F.when(whole <= model.longest, whole))["score"].alias("score"), (-k).alias("k"))

        best = F.array_max(F.filter(F.transform(s, edge), lambda e: e["score"].isNotNull()))

        def joined(b: Column) -> Column:
            k = -b["k"]
            both = F.array(F.struct(F.get(s, k)["i"].alias("i"), (F.get(s, k)["m"] + F.get(s, k + 1)["m"]).alias("m")))
            return F.when(b.isNull(), s).otherwise(F.concat(F.slice(s, F.lit(1), k), both, F.slice(s, k + 3, F.greatest(F.size(s) - k - 2, F.lit(0)))))

        return let(best, joined)

    rounds = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, merge)


def _fold_viterbi(n: Column, edges: Column, worst: float, model: Pieces) -> Column:
    """best[j]: the score of the best path to place j, and the length of its last edge; then the path read backwards."""
    none = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("m")))

    def step(best: Column, j: Column) -> Column:
        def into(m: Column) -> Column:
            i = j - m + 1
            score = F.coalesce(F.try_element_at(edges, i * model.stride + m)["score"], F.when(m == 1, F.lit(worst)))
            return F.struct((F.get(best, j - m)["score"] + score).alias("score"), m.alias("m"))

        # array_max takes the longer of equal edges last, as the reference rule does: the earlier begin wins.
        top = F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.least(j, F.lit(model.longest))), into), lambda e: e["score"].isNotNull()))
        return F.concat(best, F.array(top))

    def path(best: Column) -> Column:
        empty = F.array().cast("array<struct<i:int,m:int>>")
        back = F.aggregate(
            F.sequence(F.lit(1), n),
            F.struct(n.alias("at"), empty.alias("p")),
            lambda a, _: F.when(a["at"] == 0, a).otherwise(
                let(F.get(best, a["at"])["m"], lambda m: F.struct((a["at"] - m).alias("at"), F.concat(F.array(F.struct((a["at"] - m + 1).alias("i"), m.alias("m"))), a["p"]).alias("p")))
            ),
        )
        return back["p"]

    return let(F.aggregate(F.sequence(F.lit(1), n), none, step), path)


def hot_words(docs: DataFrame, text: str, model: Pieces, limit: int) -> DataFrame:
    """(word): the most frequent chunks of all texts, at most `limit`, counted over all of them.

    Words longer than HOT_CHARS are left out. The words are not ranked: counts fall into classes, 16 for each doubling, and the highest classes that hold no more than
    `limit` words together are taken. The driver sees a row for each class, some hundreds however large the corpus is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treeframe.llm import pieces as own

        own._known.clear()  # some 150 MB, of a call before: else a worker would hold them beside what it counts
        plain: Counter[str] = Counter()
        spaced: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for prefix, counts in (("", plain), (SPACE, spaced)):
                most = HOT_CHARS - len(prefix)
                words, n = pa.array([prefix + x for x in counts if len(x) <= most], pa.string()), pa.array([n for x, n in counts.items() if len(x) <= most], pa.int64())
                counts.clear()
                yield pa.RecordBatch.from_arrays([words, n], ["word", "n"])

        for b in batches:
            for x in b.column(0):
                x = x.as_py()
                for words, after_space in model.runs(x) if x else ():
                    (spaced if after_space else plain).update(words)
                if len(plain) + len(spaced) > 1 << 18:
                    yield from flush()
        yield from flush()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = stored(counted.select("word", F.floor(16 * F.log2("n")).cast("int").alias("class"))).df
    least, have = math.inf, 0
    for r in sorted(counted.groupBy("class").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["class"]):
        have += r.words
        if have > limit:
            break
        least = r["class"]
    return counted.filter(F.col("class") >= F.lit(least)).select("word")


class _Known(dict):
    """Words, without the space before them if prefix is one, with their ids as bytes of int32. A word that is not there is folded.

    The hot words stay; others are dropped together when there are CACHED of them. Bytes are nothing that Python's cyclic
    garbage collector would look through again and again, as it would through lists. odd: the words whose ids decode to another text.
    """

    CACHED = 1 << 17

    def __init__(self, model: Pieces, prefix: str = "") -> None:
        self.model, self.prefix = model, prefix
        self.later: list[str] = []
        self.forgot = 0  # times
        self.odd: set[str] = set()

    def __missing__(self, word: str) -> bytes:
        if len(self.later) >= self.CACHED:
            for w in self.later:
                del self[w]
            self.odd.difference_update(self.later)
            self.later.clear()
            self.forgot += 1
        whole = self.prefix + word
        ids = self.model.fold(whole) if len(whole) <= 256 else fold_long(self.model, whole)
        self.later.append(word)
        if self.model.spelled(ids) != whole:
            self.odd.add(word)
        self[word] = out = array("i", ids).tobytes()
        return out


class Coder:
    """Encodes texts, with what it knows of words."""

    def __init__(self, model: Pieces, words: pa.Table) -> None:
        self.model, self.plain, self.spaced = model, _Known(model), _Known(model, SPACE)
        for b in words.to_batches():
            own, at, values = b.column(0).to_pylist(), b.column(1).offsets.to_pylist(), b.column(1).values
            raw, ids = values.to_numpy().astype(np.int32).tobytes(), values.to_pylist()
            for word, i, j in zip(own, at, at[1:]):  # noqa: B905
                alone = word[:1] == SPACE and word[1:2] not in ("", SPACE)
                known, key = (self.spaced, word[1:]) if alone else (self.plain, word)
                known[key] = raw[4 * i : 4 * j]
                if model.spelled(ids[i:j]) != word:
                    known.odd.add(key)

    def encode(self, text: str) -> tuple[bytes, bool]:
        """The ids as bytes of int32, and whether they decode to the text."""
        plain, spaced, parts, odd = self.plain, self.spaced, [], False
        forgot = plain.forgot + spaced.forgot
        for words, after_space in self.model.runs(text) if text else ():
            known = spaced if after_space else plain
            parts += map(known.__getitem__, words)
            odd = odd or bool(known.odd) and not known.odd.isdisjoint(words)
        ids = b"".join(parts)
        # Where every word decodes to itself, the words one after another are the text, unless it has escaped spaces of its own. What was odd
        # may be forgotten by the end of the text.
        if odd or SPACE in text or forgot != plain.forgot + spaced.forgot:
            return ids, self.model.decode(np.frombuffer(ids, np.int32).tolist()) == text
        return ids, True


#: What a Python worker knows from the tasks before, by the call that it belongs to.
_known: dict[str, Coder] = {}


def encode(docs: DataFrame, model: Pieces, text: str = "text", hot: int = HOT_WORDS) -> DataFrame:
    """docs with _ids (the text's piece ids), _n_tokens and _decoded_ok (decoding the ids gives the text back).

    Null and empty texts have no ids. Texts are encoded whole, however long. Characters that no piece has become their bytes. Every
    row of docs gives a row, and its other columns stay as they are; one named like a result is an error. A text is decoded word by
    word, as it is encoded: no piece and no character's bytes reach over the end of a word.
    """
    result = unpacked(docs, _ids=F.col("ids"), _n_tokens=F.col("n_tokens"), _decoded_ok=F.col("ok"))
    vocabulary = lattice(hot_words(docs, text, model, hot), model).select("word", "ids").toArrow()  # at most `hot` rows of short words
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, vocabulary.schema) as out:
        out.write_table(vocabulary, max_chunksize=1 << 16)
    packed, call = sink.getvalue().to_pybytes(), uuid.uuid4().hex  # Spark sends what a function holds once to each executor
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treeframe.llm import pieces as own

        if call not in own._known:
            own._known.clear()
            own._known[call] = own.Coder(model, pa.ipc.open_stream(packed).read_all())
        coder = own._known[call]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [coder.encode(x.as_py() or "") for x in part.column(0).field(place)]
                ids, ok = [np.frombuffer(x, np.int32) for x, _ in found], [y for _, y in found]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(ok)], names=["row", "ids", "n_tokens", "ok"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ok", T.BooleanType())])
    return docs.select(row(docs)).mapInArrow(run, schema).select(*result)


def fold_long(model: Pieces, word: str) -> list[int]:
    """fold() for a very long word in n log n: neighbours wait in a heap, the best first, of equal ones the leftmost."""
    if model.model_type != BPE:
        return model.fold(word)
    import heapq

    s, nxt, prv = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[float, int, str, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and nxt[i] < len(s):
            k = model.ids.get(s[i] + s[nxt[i]])
            if k is not None:
                heapq.heappush(heap, (-model.scores[k], i, s[i], s[nxt[i]]))

    for i in range(len(s) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if s[i] != a or j >= len(s) or s[j] != b:
            continue
        s[i], s[j], nxt[i] = a + b, "", nxt[j]
        if nxt[i] < len(s):
            prv[nxt[i]] = i
        offer(i)
        offer(prv[i])
    out: list[int] = []
    for p in filter(None, s):
        k = model.ids.get(p)
        out += [k] if k is not None else [x for c in p for x in model.fallback(c)]
    return out


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode() of all documents with the public model; ids_sha256 is that of the ids in decimal, joined by spaces."""
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), load())
    ids = F.array_join(F.transform("_ids", lambda x: x.cast("string")), " ")
    return out.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.col("_decoded_ok").alias("round_trip"))
