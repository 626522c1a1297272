"""Documents as a table of elements, and paths as joins over it: for queries that no record fits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.paths import ANY, Bracket, Name, Term, parse
from ..sources.split import pieces

_FIELDS = "pre long, last long, parent long, level int, ns string, local string, attrs map<string,string>, own_text string, text string, line int"
_BATCH = 4096


def _elements(content: str | bytes, with_text: bool) -> Iterator[tuple]:
    """The elements of a document as they end."""
    done, stack, count = [], [], 0
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal count
        count += 1
        stack.append((count, name, {f"{{{k}" if "}" in k else k: v for k, v in attrs.items()}, p.CurrentLineNumber, [], []))

    def end(_: str) -> None:
        pre, name, attrs, line, own, whole = stack.pop()
        ns, _, local = name.rpartition("}")
        text = "".join(whole) if with_text else None
        if stack and with_text:
            stack[-1][5].append(text)
        done.append((pre, count, stack[-1][0] if stack else 0, len(stack), ns or None, local, list(attrs.items()), "".join(own), text, line))

    def data(s: str) -> None:
        stack[-1][4].append(s)
        if with_text:
            stack[-1][5].append(s)

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, data
    for piece in pieces(content):
        p.Parse(piece, False)
        yield from done
        done.clear()
    p.Parse(b"", True)
    yield from done


def nodes(df: DataFrame, content: str = "content", keep: Sequence[str] = (), text: bool = True) -> DataFrame:
    """A row for each element of each document: the kept columns, then

    pre (its number, in the order of start tags, from 1), last (the number of the last element inside it, or its own), parent
    (0 for the root), level, ns (null for none), local, attrs (by name, {uri}name in a namespace), own_text, text (with that
    of the elements inside) and line. text repeats what is inside at every level; without it (text=False) the column is null. A table
that several paths are looked up in is better written once: each find() on an unwritten one parses the documents again. A null document has no elements; one that is not well formed fails the job.
    """
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row")
    source = df.select(row, F.col(f"`{content}`").alias("content"))
    own = T._parse_datatype_string(_FIELDS)
    kinds = [to_arrow_type(f.dataType) for f in own.fields]

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in incoming:
            at, rows = [], []

            def flush() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *columns], names=["row", *own.names])  # noqa: B023
                at.clear()  # noqa: B023
                rows.clear()  # noqa: B023
                return out

            for i, x in enumerate(b.column(1)):
                for r in _elements(x.as_py(), text) if x.is_valid else ():
                    at.append(i)
                    rows.append(r)
                    if len(rows) >= _BATCH:
                        yield flush()
            if rows:
                yield flush()

    out = source.mapInArrow(run, T.StructType([source.schema["row"], *own.fields]))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *own.names)


def _named(name: Name) -> Column:
    tests = [F.lit(True)] + ([] if name.local == ANY else [F.col("local") == name.local]) + ([] if name.ns == ANY else [F.col("ns").eqNullSafe(F.lit(name.ns).cast("string"))])
    return reduce(Column.__and__, tests)


def _attribute(name: Name) -> Column:
    return F.try_element_at("attrs", F.lit(f"{{{name.ns}}}{name.local}" if name.ns else name.local))


def _test(t: Term) -> Column:
    same = _attribute(t.name).eqNullSafe(F.lit(t.value))
    return same if t.equal else ~same


def _holds(bracket: Bracket, tests: Mapping[Term, Column]) -> Column:
    """The bracket as a condition; _n is the place among the siblings that reach it."""
    term = lambda t: F.col("_n") == t.position if t.name is None else tests[t]
    return reduce(Column.__or__, [reduce(Column.__and__, map(term, a)) for a in bracket.alternatives])


def find(table: DataFrame, path: str, doc: str, ns: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of a table of nodes() that a record path matches, at any depth; doc is the column that tells documents apart.

    A child step is a join on the parent, a descendant step one on the interval of numbers, a position a row number
    among siblings. Deal the table by doc once and the joins of one path share that. What a step wants of the attributes is read
    before its rows are dealt and sorted: unless the result's attrs are asked for, no map goes through a join.
    """
    p, out = parse(path, ns), None
    columns = table.columns
    for k, step in enumerate(p.steps):
        terms = dict.fromkeys(t for b in step.brackets for a in b.alternatives for t in a if t.name is not None)
        leaf = [_attribute(p.leaf).alias("_leaf")] if p.leaf is not None and k == len(p.steps) - 1 else []
        here = table.filter(_named(step.name))
        if out is None and not step.descendant:
            here = here.filter("parent = 0")
        here = here.select(*columns, *[_test(t).alias(f"_t{i}") for i, t in enumerate(terms)], *leaf)
        if out is not None:
            above = out.select(F.col(doc).alias("_doc"), F.col("pre").alias("_pre"), F.col("last").alias("_last"))
            if step.descendant:
                on = (F.col(doc) == F.col("_doc")) & (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_last"))
            else:
                on = (F.col(doc) == F.col("_doc")) & (F.col("parent") == F.col("_pre"))
            here = here.join(above, on, "left_semi")
        tests = {t: F.col(f"_t{i}") for i, t in enumerate(terms)}
        for b in step.brackets:
            if b.positional:
                here = here.withColumn("_n", F.row_number().over(Window.partitionBy(doc, "parent").orderBy("pre")))
            here = here.filter(_holds(b, tests))
        out = here.select(*columns, *(["_leaf"] if leaf else []))
    return out.withColumn("value", F.col("_leaf")).drop("_leaf") if p.leaf is not None else out
