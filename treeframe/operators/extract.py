"""Records out of a column of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.compile import AT, ERROR, no_errors, nullable, raw_type, typed_record, wrong_converters
from ..plans.program import Program, program
from ..plans.spec import Record
from ..plans.validate import SpecError, check
from ..sources.quick import QuickRecords
from ..sources.split import Malformed, Reader, pieces, records

MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")
#: Records handed to Spark at a time.
BATCH = 1000

BAD = T.StructType([T.StructField("message", T.StringType()), *AT.fields])


def record_fields(prog: Program) -> list[T.StructField]:
    """What is known of a record before its values have types: its number in the document, what is wrong, and raw values."""
    return [T.StructField("pos", T.LongType()), T.StructField("bad", BAD), T.StructField("rec", raw_type(prog.body))]


def batches(found: Iterable[tuple[Any, int, dict | tuple | Malformed]], prog: Program, quick: T.StructType | None = None) -> Iterator[tuple[list, list[pa.Array]]]:
    """(tags, columns) for (tag, position, record) triples, many records at a time: the columns of record_fields, and with quick,
    which is the type of typed records, a column of these. A record is either raw, typed (a tuple) or malformed."""
    kinds = [to_arrow_type(f.dataType) for f in record_fields(prog)]
    fields = list(to_arrow_type(quick)) if quick else []
    tags, pos, bad, rec, val = [], [], [], [], []

    def flush() -> tuple[list, list[pa.Array]]:
        n = len(tags)
        out = tags.copy(), [pa.array(x, t) if any(v is not None for v in x) else pa.nulls(n, t) for x, t in zip((pos, bad, rec), kinds, strict=True)]
        if quick:
            rows = val if None not in val else [(None,) * len(fields) if v is None else v for v in val]
            values = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
            out[1].append(pa.StructArray.from_arrays(values, fields=fields, mask=pa.array([v is None for v in val])))
        for x in (tags, pos, bad, rec, val):
            x.clear()
        return out

    for tag, p, r in found:
        tags.append(tag)
        pos.append(p)
        wrong, done = isinstance(r, Malformed), isinstance(r, tuple)
        bad.append({"message": r.message, "line": r.line, "col": r.col, "path": r.path} if wrong else None)
        rec.append(None if wrong or done else r)
        val.append(r if done else None)
        if len(tags) >= BATCH:
            yield flush()
    if tags:
        yield flush()


def split(df: DataFrame, prog: Program, content: str, keep: Sequence[str] = (), quick: T.StructType | None = None) -> DataFrame:
    """(row, pos, bad, rec): a row for each record of each document; row has the kept columns. With quick, the type of typed
    records, also val: records of that type, null where rec or bad says what there is."""
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row")
    source = df.select(row, F.col(f"`{content}`").alias("content"))
    schema = T.StructType([source.schema["row"], *record_fields(prog), *([T.StructField("val", quick)] if quick else [])])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(prog.body, prog.ignore_ns)  # one for all documents of a task
        typed_records = QuickRecords(prog) if quick else lambda _: None

        def of(x: str | bytes) -> Iterable[dict | tuple | Malformed]:
            got = typed_records(x)
            return records(pieces(x), prog, reader) if got is None else got

        for b in incoming:
            found = ((i, p, r) for i, x in enumerate(b.column(1)) if x.is_valid for p, r in enumerate(of(x.as_py()), 1))
            for at, columns in batches(found, prog, quick):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def typed(raw: DataFrame, spec: Record, prog: Program, mode: str, kept: dict[str, Column]) -> DataFrame:
    """The kept columns and the record's fields, from (pos, bad, rec), val if there are typed records, and whatever kept reads."""
    values, errors = typed_record(spec, prog.body, F.col("rec"))
    done = F.col("val").isNotNull() if "val" in raw.columns else None
    if done is not None:
        values = {k: F.when(done, F.col("val")[k]).otherwise(v) for k, v in values.items()}
    bad = F.col("bad")
    where = F.concat(bad["message"], F.lit(" at "), bad["path"], F.lit(" (line "), bad["line"].cast("string"), F.lit(", col "), bad["col"].cast("string"), F.lit(")"))
    none = F.lit(None).cast("string")
    malformed = F.struct(
        F.lit("Malformed").alias("kind"), none.alias("field"), none.alias("raw"), none.alias("type"), bad["line"].alias("line"), bad["col"].alias("col"), bad["path"].alias("path"), where.alias("message")
    )
    found = F.when(bad.isNotNull(), F.array(malformed).cast(f"array<{ERROR}>")).otherwise((F.concat(*errors) if len(errors) > 1 else errors[0]) if errors else no_errors())
    if done is not None:
        found = F.when(done, no_errors()).otherwise(found)
    columns = [c.alias(k) for k, c in kept.items()] + [v.alias(k) for k, v in values.items()]
    if mode == "PERMISSIVE":
        return raw.select(*columns, found.alias("_errors"))
    if mode == "DROPMALFORMED":
        return raw.filter(F.size(found) == 0).select(*columns)
    fail = F.raise_error(F.element_at(found, 1)["message"]).cast("boolean")
    fine = F.when(F.size(found) == 0, F.lit(True)).otherwise(fail)
    return raw.filter(fine if done is None else F.when(done, F.lit(True)).otherwise(fine)).select(*columns)


def prepared(spark: SparkSession, spec: Record | type, ignore_namespace: bool, mode: str, kept: Iterable[str]) -> tuple[Record, Program]:
    """The checked record and its program."""
    spec = getattr(spec, "spec", spec)
    check(spec)
    if problems := wrong_converters(spark, spec):
        raise SpecError(problems)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if clash := sorted(set(kept) & {*spec.fields, *(["_errors"] if mode == "PERMISSIVE" else [])}):
        raise ValueError(f"kept columns have the names of fields: {', '.join(clash)}")
    return spec, program(spec, ignore_namespace)


def extract(
    df: DataFrame, spec: Record | type, content: str = "content", keep: Sequence[str] = (), ignore_namespace: bool = False, mode: str = "FAILFAST", position: str | None = None
) -> DataFrame:
    """A row for each record in each document of df[content] (strings or binary): the kept columns and the record's fields.

    position names a column for the record's number in its document, from 1: rows have no order otherwise. No data is
    shuffled, and nothing is kept from one document to the next, so df may be a stream.

    mode says what happens where a required value is missing, a text has not its type or a document is not well formed.
    FAILFAST ends the job with the first error's message. PERMISSIVE gives every record, with nulls for what is wrong and
    the errors in _errors; a malformed document gives the records before the fault and then a row with only the error.
    DROPMALFORMED leaves out what has errors. A null document has no records; an empty one is malformed.
    """
    spec, prog = prepared(df.sparkSession, spec, ignore_namespace, mode, [*keep, *([position] if position else [])])
    kept = {c: F.col("row")[c] for c in keep} | ({position: F.col("pos")} if position else {})
    return typed(split(df, prog, content, keep, nullable(spec.schema) if prog.body.plain else None), spec, prog, mode, kept)
