"""Extraction from SQL: a Python table function that gives a record's rows for one document.

extract() leaves types to Spark's expressions; a table function has to give typed values itself, so this module reads
texts by the same patterns in Python. extract() is the faster way wherever DataFrames are at hand.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.coerce import _DATE, _DECIMAL, _FLOAT, _INSTANT, _INTEGER, _LOCAL
from ..plans.compile import nullable, value_type
from ..plans.program import Body, inner, part, program
from ..plans.spec import Attr, Beyond, Child, MapOf, Part, Poly, Record, Text, shown
from ..plans.validate import SpecError, check
from ..sources.split import Malformed, Reader, pieces, records

_SPACES = "".join(map(chr, range(33)))


def scalar_reader(kind: T.DataType) -> Callable[[str], Any]:
    """From a text to a value of that kind; None if it is none."""
    if isinstance(kind, T.StringType):
        return lambda x: x
    if isinstance(kind, (T.IntegerType, T.LongType)):
        most = 1 << (31 if isinstance(kind, T.IntegerType) else 63)
        return lambda x: int(x) if re.search(_INTEGER, x) and not x.endswith("\n") and -most <= int(x) < most else None
    if isinstance(kind, T.DoubleType):
        return lambda x: float(re.sub(r"(?<=[0-9.])[fFdD]$", "", t)) if re.search(_FLOAT, t := x.strip(_SPACES)) else None
    if isinstance(kind, T.BooleanType):
        return lambda x: {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(x.strip(" \t\n\v\f\r").lower())
    if isinstance(kind, T.DecimalType):
        return lambda x: _decimal(x, kind)
    pattern, read = (_DATE, dt.date.fromisoformat) if isinstance(kind, T.DateType) else (_LOCAL if isinstance(kind, T.TimestampNTZType) else _INSTANT, dt.datetime.fromisoformat)

    def moment(x: str) -> Any:
        try:
            return read(x) if re.search(pattern, x) and not x.endswith("\n") else None
        except ValueError:
            return None

    return moment


def _decimal(x: str, kind: T.DecimalType) -> Decimal | None:
    if not re.search(_DECIMAL, x) or x.endswith("\n"):
        return None
    try:
        d = Decimal(x).quantize(Decimal(1).scaleb(-kind.scale), ROUND_HALF_UP)
    except InvalidOperation:
        return None
    return d if len(d.as_tuple().digits) <= kind.precision else None


def _fail(kind: str, field: str, at: dict, raw: str = "", type_name: str = "") -> ValueError:
    where = f"{at['path']} (line {at['line']}, col {at['col']})"
    return ValueError(f"Missing required field '{field}' at {where}" if kind == "Missing" else f"Cannot coerce '{raw}' to {type_name} for '{field}' at {where}")


def row_reader(record: Record, body: Body) -> Callable[[dict], tuple]:
    """From a raw record, as the splitter gives it, to its row; ValueError says what is wrong."""
    fields = [_field(record, name, how, slot) for (name, how), slot in zip(record.fields.items(), body.slots, strict=True)]
    return lambda raw: tuple([f(raw[slot.name], raw["_at"]) for f, slot in zip(fields, body.slots, strict=True) if f is not None or _never(raw[slot.name], slot.name, raw["_at"])])


def _never(value: Any, name: str, at: dict) -> bool:
    """A Beyond has no column."""
    if value is not None:
        raise ValueError(f"'{name}' goes on below the levels of its Self, at {at['path']} (line {at['line']}, col {at['col']})")
    return False


def _field(record: Record, name: str, how: Attr | Child | Text | MapOf | Part, slot) -> Callable[[Any, dict], Any] | None:
    if isinstance(getattr(how, "type", None), Beyond):
        return None
    if isinstance(how, MapOf):
        return _map(record, name, how, slot)
    if slot.poly:
        one = _union(how.type, slot)
    elif slot.nested:
        read = row_reader(inner(record, how), slot.nested)
        one = lambda x, at: read(x)
    else:
        kind = value_type(record, how.type)
        text = scalar_reader(kind)

        def one(x: Any, at: dict) -> Any:
            if slot.located:
                x, at = x["v"], {"path": at["path"] + (slot.suffix or ""), **x}
            v = text(x)
            if v is None:
                raise _fail("Coercion", name, at, x, shown(kind))
            return v

    if slot.many:
        return lambda raw, at: [one(x, at) for x in raw]

    def single(raw: Any, at: dict) -> Any:
        if raw is not None:
            return one(raw, at)
        if how.required and not isinstance(how, Text):
            raise _fail("Missing", name, at)
        return None

    return single


def _union(poly: Poly, slot) -> Callable[[dict, dict], tuple]:
    bodies = {label: b for label, b in slot.poly.kinds.values()}
    readers = {k: row_reader(getattr(r, "spec", r), bodies[k]) for k, r in poly.kinds.items()}
    return lambda x, at: (x["_type"], *(readers[k](x[k]) if k == x["_type"] else None for k in readers))


def _map(record: Record, name: str, how: MapOf, slot) -> Callable[[list, dict], Any]:
    parts = (part(how.key), part(how.value))
    key, value = (_field(record, f"{name}.{label}", p, s) for label, p, s in zip(("key", "value"), parts, slot.nested.slots, strict=True))

    def read(raw: list, at: dict) -> Any:
        out: dict[Any, Any] = {}
        for x in raw:
            k, v = key(x["key"], x["_at"]), value(x["value"], x["_at"])
            same = tuple(k) if isinstance(k, list) else k
            out[same] = out[same] + v if same in out and parts[1].many else v
        if not raw and not how.required:
            return None
        return out if how.as_map else [(list(k) if parts[0].many else k, v) for k, v in out.items()]

    return read


def register(spark: SparkSession, name: str, spec: Record | type, ignore_namespace: bool = False) -> None:
    """Makes name(document) a table function in SQL: SELECT d.id, r.* FROM docs d, LATERAL name(d.content) r

    A row for each record of the document (a string or binary), with the record's schema. What is wrong ends the query, as
    extract() does in FAILFAST mode. A null document has no rows. fmt and converter are Spark expressions, which a Python function
    can't run: a spec with either is refused.
    """
    spec = getattr(spec, "spec", spec)
    check(spec)
    if problems := [f"{n!r}: a table function can't run a fmt or converter; use extract()" for n in _with_expressions(spec)]:
        raise SpecError(problems)
    prog = program(spec, ignore_namespace)

    class Extract:
        def __init__(self) -> None:
            self.reader, self.row = Reader(prog.body, prog.ignore_ns), row_reader(spec, prog.body)

        def eval(self, content: Any) -> Iterator[tuple]:
            if content is None:
                return
            for r in records(pieces(bytes(content) if isinstance(content, bytearray) else content), prog, self.reader):
                if isinstance(r, Malformed):
                    raise ValueError(f"{r.message} at {r.path} (line {r.line}, col {r.col})")
                yield self.row(r)

    spark.udtf.register(name, udtf(Extract, returnType=nullable(spec.schema)))


def _with_expressions(record: Record, inside: tuple[int, ...] = ()) -> Iterator[str]:
    for name, how in record.fields.items():
        if getattr(how, "fmt", None) is not None or getattr(how, "converter", None) is not None:
            yield name
        for kind in [part(how.key).type, part(how.value).type] if isinstance(how, MapOf) else [how.type]:
            kind = getattr(kind, "spec", kind)
            for r in kind.kinds.values() if isinstance(kind, Poly) else [kind] if isinstance(kind, Record) else []:
                r = getattr(r, "spec", r)
                if id(r) not in inside:
                    yield from _with_expressions(r, (*inside, id(r)))
