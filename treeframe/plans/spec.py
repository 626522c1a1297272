"""What a record looks like: declared once, checked, and turned into a Spark schema before any data is read."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

Kind = Any  # a Spark type, its name, a Record, a Poly or a Self
#: From the text to a value of the field's type, null where the text is none: errors that it raises itself end the job in any mode.
Converter = Callable[[Column], Column]

#: Names of the scalar types that fields may have, and how messages call them.
SCALARS = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "decimal": T.DecimalType(38, 18),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "timestamp": T.TimestampType(),
}
SHOWN = {"string": "String", "int": "Int", "bigint": "Long", "double": "Double", "boolean": "Boolean", "date": "LocalDate", "timestamp_ntz": "LocalDateTime", "timestamp": "Instant"}
TEMPORAL = (T.DateType, T.TimestampNTZType, T.TimestampType, T.DecimalType)


@dataclass(frozen=True, eq=False)
class Attr:
    """An attribute of the element; its name is the field's if none is given."""

    type: Kind = "string"
    name: str | None = None
    required: bool = True
    fmt: str | None = None
    converter: Converter | None = None


@dataclass(frozen=True, eq=False)
class Child:
    """Text or record at a path below the element (the field's name if none is given); many: all of them, in order."""

    type: Kind = "string"
    path: str | None = None
    required: bool = True
    many: bool = False
    preserve_whitespace: bool = False
    fmt: str | None = None
    converter: Converter | None = None


@dataclass(frozen=True, eq=False)
class Text:
    """The element's own text, without that of its children. Never missing: an empty element has the empty text."""

    type: Kind = "string"
    required: bool = True
    preserve_whitespace: bool = False
    fmt: str | None = None
    converter: Converter | None = None


@dataclass(frozen=True, eq=False)
class Part:
    """The key or value of a map's entry: a path from the entry, or "." for the entry itself."""

    path: str
    type: Kind = "string"
    required: bool = True
    many: bool = False


@dataclass(frozen=True, eq=False)
class MapOf:
    """Entries by key. An entry with a key seen before replaces the value, or adds to it where values are many.

    The result is an array of (key, value) in the order of first keys, as keys may be null or lists; as_map makes it a
    Spark map, which null keys fail.
    """

    entry: str
    key: Part | str
    value: Part | str
    required: bool = True
    as_map: bool = False


@dataclass(frozen=True, eq=False)
class Poly:
    """One of several records, told apart by the element's name, or by an attribute of it (by="@type").

    The result is a struct with _type and a field for each kind, of which the one that _type names is not null.
    """

    kinds: Mapping[str, Record]
    by: str | None = None


@dataclass(frozen=True, eq=False)
class Self:
    """The record that holds the field, so many levels deep. Spark schemas cannot recur: a document that goes deeper has an error.

    of: the depth that was asked for, in the levels below the first.
    """

    depth: int = 3
    of: int | None = None


@dataclass(frozen=True, eq=False)
class Beyond:
    """What would be one level more than a Self has room for: no column, but an error where a document has it."""

    depth: int


@dataclass(frozen=True, eq=False)
class Record:
    """Fields by name, in the order of the result. path selects the elements; records inside others need none."""

    fields: Mapping[str, Attr | Child | Text | MapOf]
    path: str | None = None
    ns: Mapping[str, str] = field(default_factory=dict)
    name: str = "record"

    @property
    def schema(self) -> T.StructType:
        from .compile import schema_of

        return schema_of(self)

    def select(self, *names: str) -> Record:
        """The record with some of its fields: the others are not read at all."""
        return dataclasses.replace(self, fields={n: self.fields[n] for n in names})


def scalar(kind: Kind) -> T.DataType | None:
    """The Spark type of a scalar kind, else None."""
    if isinstance(kind, str):
        if kind in SCALARS:
            return SCALARS[kind]
        try:
            kind = T._parse_datatype_string(kind) if not kind.startswith("decimal(") else T.DecimalType(*map(int, kind[8:-1].split(",")))
        except Exception:
            return None
    return kind if isinstance(kind, (T.StringType, T.IntegerType, T.LongType, T.DoubleType, T.BooleanType, *TEMPORAL)) else None


def shown(kind: T.DataType) -> str:
    """A type's name in messages."""
    return "BigDecimal" if isinstance(kind, T.DecimalType) else SHOWN.get(kind.simpleString(), kind.simpleString())


_PYTHON = {str: "string", int: "long", float: "double", bool: "boolean"}


def record(path: str | None = None, ns: Mapping[str, str] | None = None) -> Callable[[type], type]:
    """Makes the annotated fields of a class a Record, kept as cls.spec.

    Annotations are Annotated[type, Attr(...)] and so on, or plain types: a plain field is a child of its own name.
    `T | None` makes a field optional and list[T] makes it many. A class with a spec stands for its record.
    """

    def read(cls: type) -> type:
        fields: dict[str, Any] = {}
        for name, hint in typing.get_type_hints(cls, include_extras=True).items():
            how, kind = Child(), hint
            if typing.get_origin(hint) is typing.Annotated:
                kind, how = hint.__origin__, hint.__metadata__[0]
            if isinstance(how, MapOf):
                fields[name] = how
                continue
            change: dict[str, Any] = {}
            if type(None) in (args := typing.get_args(kind)):
                change["required"] = False
                kind = next(a for a in args if a is not type(None))
            if typing.get_origin(kind) is list:
                change["many"] = True
                kind = typing.get_args(kind)[0]
            if isinstance(how.type, str) and how.type == "string":
                change["type"] = _PYTHON.get(kind) or getattr(kind, "spec", None) or {"date": "date", "datetime": "timestamp", "Decimal": "decimal"}.get(kind.__name__, kind)
            fields[name] = dataclasses.replace(how, **change)
        cls.spec = Record(fields, path, ns or {}, cls.__name__)
        return cls

    return read
