"""Raw records to typed columns: every type, check and message is a Spark expression.

A field's values and its errors are built side by side. An error is a struct of ERROR; a record's errors are an array
in the order of its fields, those of records inside it at the place of their field.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import by_key
from ..functions.coerce import coerce
from .program import Body, Slot, inner, part
from .spec import Attr, Beyond, Child, Kind, MapOf, Part, Poly, Record, Text, scalar, shown

AT = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("path", T.StringType())])
ERROR = "struct<kind:string,field:string,raw:string,type:string,line:int,col:int,path:string,message:string>"
Field = Attr | Child | Text | MapOf


# --- types -------------------------------------------------------------------------------------------------------------


def raw_type(body: Body) -> T.StructType:
    """What the splitter gives for a body: strings, and where the element stands."""
    return T.StructType([*(T.StructField(s.name, _raw_slot(s)) for s in body.slots), T.StructField("_at", AT)])


def _raw_slot(s: Slot) -> T.DataType:
    if s.poly:
        one: T.DataType = T.StructType([T.StructField("_type", T.StringType()), *(T.StructField(label, raw_type(b)) for label, b in s.poly.kinds.values())])
    elif s.nested:
        one = raw_type(s.nested)
    elif s.located:
        one = T.StructType([T.StructField("v", T.StringType()), *(f for f in AT.fields if f.name != "path" or s.suffix is None)])
    else:
        one = T.StringType()
    return T.ArrayType(one) if s.many else one


def value_type(record: Record, kind: Kind) -> T.DataType:
    """The type of a field's single value."""
    if isinstance(kind, Poly):
        return T.StructType([T.StructField("_type", T.StringType(), False), *(T.StructField(k, schema_of(getattr(r, "spec", r))) for k, r in kind.kinds.items())])
    if nested := inner(record, Part("", kind)):
        return schema_of(nested)
    return scalar(kind) or (kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind))


def schema_of(record: Record) -> T.StructType:
    """The schema of the record's rows; required fields and lists are never null."""
    fields = []
    for name, how in record.fields.items():
        if isinstance(getattr(how, "type", None), Beyond):
            continue
        if isinstance(how, MapOf):
            k, v = part(how.key), part(how.value)
            kt, vt = (T.ArrayType(t, False) if p.many else t for p, t in ((p, value_type(record, p.type)) for p in (k, v)))
            entries = T.StructType([T.StructField("key", kt, not k.required), T.StructField("value", vt, not v.required)])
            fields.append(T.StructField(name, T.MapType(kt, vt, not v.required) if how.as_map else T.ArrayType(entries, False), not how.required))
            continue
        kind, many = value_type(record, how.type), getattr(how, "many", False)
        fields.append(T.StructField(name, T.ArrayType(kind, False) if many else kind, not (how.required or many)))
    return T.StructType(fields)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


# --- values and errors -------------------------------------------------------------------------------------------------


def _error(kind: str, field: str, raw: Column, type_name: str | None, at: Column, path: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    path = at["path"] if path is None else path
    where = F.concat(path, F.lit(" (line "), at["line"].cast("string"), F.lit(", col "), at["col"].cast("string"), F.lit(")"))
    said = F.concat(F.lit(f"Missing required field '{field}' at "), where) if kind == "Missing" else F.concat(F.lit("Cannot coerce '"), raw, F.lit(f"' to {type_name} for '{field}' at "), where)
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(field).alias("field"), (none if kind == "Missing" else raw).alias("raw"), F.lit(type_name).cast("string").alias("type"),
        at["line"].alias("line"), at["col"].alias("col"), path.alias("path"), said.alias("message"),
    )


def _too_deep(field: str, depth: int, raw: Column, at: Column, slot: Slot) -> Column:
    none, path = F.lit(None).cast("string"), raw["path"] if slot.suffix is None else F.concat(at["path"], F.lit(slot.suffix))
    said = F.concat(F.lit(f"'{field}' goes on below the {depth} levels of its Self({depth}), at "), path, F.lit(" (line "), raw["line"].cast("string"), F.lit(", col "), raw["col"].cast("string"), F.lit(")"))
    return F.struct(
        F.lit("Depth").alias("kind"), F.lit(field).alias("field"), none.alias("raw"), none.alias("type"), raw["line"].alias("line"), raw["col"].alias("col"), path.alias("path"), said.alias("message"),
    )


def _some(errors: list[Column]) -> Column:
    """Arrays of errors, one after another."""
    return F.concat(*errors) if len(errors) > 1 else errors[0] if errors else no_errors()


def no_errors() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _if(condition: Column, error: Column) -> Column:
    return F.when(condition, F.array(error)).otherwise(no_errors())


def _converted(record: Record, how: Attr | Child | Text | Part, text: Column) -> tuple[Column, str, bool]:
    """The value, the type's name in messages, and whether a text can fail to be one."""
    kind = value_type(record, how.type)
    if getattr(how, "converter", None) is not None:
        return how.converter(text), shown(kind), True  # wrong_converters() has compared the types
    return coerce(text, kind, getattr(how, "fmt", None)), shown(kind), not isinstance(kind, T.StringType)


def typed_record(record: Record, body: Body, raw: Column) -> tuple[dict[str, Column], list[Column]]:
    """The fields of a raw record, and arrays of errors."""
    values, errors = {}, []
    for (name, how), slot in zip(record.fields.items(), body.slots, strict=True):
        if isinstance(getattr(how, "type", None), Beyond):
            errors.append(_if(raw[slot.name].isNotNull(), _too_deep(name, how.type.depth, raw[slot.name], raw["_at"], slot)))
            continue
        values[name], more = _field(record, name, how, slot, raw[slot.name], raw["_at"])
        errors += more
    return values, errors


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _field(record: Record, name: str, how: Field, slot: Slot, raw: Column, at: Column) -> tuple[Column, list[Column]]:
    if isinstance(how, MapOf):
        return _map(record, name, how, slot, raw)
    if slot.poly:
        one = lambda x: _union(how.type, slot, x)
    elif slot.nested:
        one = lambda x: _inside(inner(record, how), slot.nested, x)
    else:
        return _scalar(record, name, how, slot, raw, at)
    if slot.many:
        errors = [F.flatten(F.transform(raw, lambda x: _some(one(x)[1])))] if _can_fail(one, raw) else []
        return F.transform(raw, lambda x: one(x)[0]), errors
    value, inside = one(raw)
    errors = [F.when(raw.isNotNull(), _some(inside)).otherwise(no_errors())] if inside else []
    return value, ([_if(raw.isNull(), _error("Missing", name, raw, None, at))] if how.required else []) + errors


def _can_fail(one, raw: Column) -> bool:
    return bool(one(F.get(raw, F.lit(0)))[1])


def _inside(record: Record, body: Body, raw: Column) -> tuple[Column, list[Column]]:
    values, errors = typed_record(record, body, raw)
    return F.when(raw.isNotNull(), _struct(values)), errors


def _union(poly: Poly, slot: Slot, raw: Column) -> tuple[Column, list[Column]]:
    values, errors = {"_type": raw["_type"]}, []
    bodies = {label: b for label, b in slot.poly.kinds.values()}
    for label, record in poly.kinds.items():
        values[label], inside = _inside(getattr(record, "spec", record), bodies[label], raw[label])
        if inside:
            errors.append(F.when(raw[label].isNotNull(), _some(inside)).otherwise(no_errors()))
    return F.when(raw.isNotNull(), _struct(values)), errors


def _scalar(record: Record, name: str, how: Attr | Child | Text | Part, slot: Slot, raw: Column, at: Column) -> tuple[Column, list[Column]]:
    if slot.many:
        _, kind, fails = _converted(record, how, F.get(raw, F.lit(0)))
        if not fails:
            return raw, []
        value = F.transform(raw, lambda x: _converted(record, how, x)[0])
        # Texts are coerced again only where the list has a null, that is, an error.
        bad = lambda x: _error("Coercion", name, x, kind, at)
        wrong = F.transform(F.filter(raw, lambda x: _converted(record, how, x)[0].isNull()), bad)
        return value, [F.when(F.exists(value, lambda x: x.isNull()), wrong).otherwise(no_errors())]
    text = raw["v"] if slot.located else raw
    value, kind, fails = _converted(record, how, text)
    errors = []
    if how.required and not isinstance(how, Text):
        errors.append(_if(text.isNull(), _error("Missing", name, text, None, at)))
    if fails:
        place, path = (raw, F.concat(at["path"], F.lit(slot.suffix)) if slot.suffix is not None else raw["path"]) if slot.located else (at, None)
        errors.append(_if(text.isNotNull() & value.isNull(), _error("Coercion", name, text, kind, place, path)))
    return value, errors


def wrong_converters(spark: SparkSession, record: Record, inside: tuple[int, ...] = ()) -> list[str]:
    """What converters give that is not of their field's type, as Spark's analyser sees them; it needs no data."""
    out: list[str] = []
    for name, how in record.fields.items():
        kinds = [part(how.key).type, part(how.value).type] if isinstance(how, MapOf) else [how.type]
        for kind in kinds:
            kind = getattr(kind, "spec", kind)
            for r in kind.kinds.values() if isinstance(kind, Poly) else [kind] if isinstance(kind, Record) else []:
                r = getattr(r, "spec", r)
                if id(r) not in inside:
                    out += wrong_converters(spark, r, (*inside, id(r)))
        if getattr(how, "converter", None) is not None:
            want = value_type(record, how.type)
            try:
                got = spark.createDataFrame([], "x string").select(how.converter(F.col("x")).alias("v")).schema["v"].dataType
            except AnalysisException as e:
                out.append(f"{name!r}: its converter can't be used on a text: {e.getCondition() or e}")
                continue
            if got.simpleString() != want.simpleString():
                out.append(f"{name!r}: its converter gives {got.simpleString()}, but the field says {want.simpleString()}; make the two agree")
    return out


def _map(record: Record, name: str, how: MapOf, slot: Slot, raw: Column) -> tuple[Column, list[Column]]:
    parts = {"key": part(how.key), "value": part(how.value)}

    def entry(x: Column) -> tuple[Column, list[Column]]:
        values, errors = {}, []
        for (label, p), s in zip(parts.items(), slot.nested.slots, strict=True):
            values[label], more = _field(record, f"{name}.{label}", p, s, x[label], x["_at"])
            errors += more
        return _struct(values), errors

    entries = by_key(F.transform(raw, lambda x: entry(x)[0]), parts["value"].many)
    value = F.map_from_entries(entries) if how.as_map else entries
    errors = [F.flatten(F.transform(raw, lambda x: _some(entry(x)[1])))] if _can_fail(entry, raw) else []
    return (value if how.required else F.when(F.size(raw) > 0, value)), errors

