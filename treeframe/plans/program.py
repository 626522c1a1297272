"""What the splitter does for a record, as plain data: it is sent to the workers and knows nothing of Spark.

A body lists the values that an element gives. Steps of child paths are shared: fields with the same step at the same
place are one branch, so an element is looked at once however many fields read it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from .paths import Name, Path, Step, parse, parse_child
from .spec import Attr, Beyond, Child, MapOf, Part, Poly, Record, Self, Text, scalar


@dataclass
class Slot:
    """One raw value. located: it travels with its line and column, and with its path if suffix is None. kind is the name of a
    scalar type that sources.quick reads; required: a null is an error; map: its entries meet by key."""

    name: str
    many: bool = False
    nested: Body | None = None
    poly: PolyPlan | None = None
    preserve: bool = False
    located: bool = False
    suffix: str | None = ""
    kind: str | None = None
    required: bool = False
    map: MapRules | None = None

    @property
    def plain(self) -> bool:
        """Whether sources.quick can read it."""
        if self.map:
            key = self.nested.slots[0]
            keys = key.nested.slots if key.nested else [key]
            return self.nested.plain and all(s.kind in ("string", "int", "bigint") and (s is key or not s.many) for s in keys)
        return all(b.plain for _, b in self.poly.kinds.values()) if self.poly else self.nested.plain if self.nested else self.kind is not None


@dataclass
class MapRules:
    required: bool
    as_map: bool


@dataclass
class Branch:
    """A step and what is read where it leads."""

    step: Step
    leaves: list[tuple[str, int]] = field(default_factory=list)
    bodies: list[int] = field(default_factory=list)
    below: list[Branch] = field(default_factory=list)

    @property
    def consumes(self) -> bool:
        return bool(self.bodies or self.below)


@dataclass
class MapPlan:
    """Entries are bodies of two slots, key and value."""

    step: Step
    slot: int


@dataclass
class PolyPlan:
    """kinds: what tells a kind (an element's key or an attribute's value), its label and its body."""

    by: str | None
    element: Name | None
    kinds: dict[str, tuple[str, Body]]


@dataclass
class Body:
    slots: list[Slot] = field(default_factory=list)
    attrs: list[tuple[str, int]] = field(default_factory=list)
    texts: list[int] = field(default_factory=list)
    selfs: list[int] = field(default_factory=list)
    direct: list[Branch] = field(default_factory=list)
    maps: list[MapPlan] = field(default_factory=list)
    polys: list[int] = field(default_factory=list)
    heads: list[Branch] = field(default_factory=list)

    @property
    def reads_children(self) -> bool:
        return bool(self.texts or self.selfs or self.direct or self.maps or self.polys or self.heads)

    @property
    def plain(self) -> bool:
        return all(s.plain for s in self.slots)


@dataclass
class Program:
    path: Path
    body: Body
    ignore_ns: bool


#: Types whose plain texts Python reads as Spark does.
PLAIN = ("string", "int", "bigint", "double")


def plain(how: Attr | Child | Text | Part) -> str | None:
    """The name of the field's type if it is one of PLAIN, read by no pattern and no converter."""
    kind = scalar(how.type)
    known = kind is not None and kind.simpleString() in PLAIN and getattr(how, "fmt", None) is None and getattr(how, "converter", None) is None
    return kind.simpleString() if known else None


def needs_location(how: Attr | Child | Text) -> bool:
    return how.converter is not None or scalar(how.type) is None or scalar(how.type).simpleString() != "string"


def inner(record: Record, how: Attr | Child | Text | Part) -> Record | None:
    """The record that a field holds, if it holds one; Self is that of the field's owner, one level less deep."""
    kind = how.type
    if isinstance(kind, Self):
        return unrolled(record, kind.depth, kind.of or kind.depth)
    kind = getattr(kind, "spec", kind)
    return kind if isinstance(kind, Record) else None


def unrolled(record: Record, depth: int, whole: int) -> Record:
    """The record with fields of its own kind one level less deep; at the last level these only look whether there is more."""
    fields = {}
    for name, how in record.fields.items():
        if isinstance(how, Child) and isinstance(how.type, Self):
            how = Child(Self(depth - 1, whole), how.path or name, how.required, how.many) if depth > 1 else Child(Beyond(whole), how.path or name, required=False)
        fields[name] = how
    return Record(fields, record.path, record.ns, record.name)


def program(record: Record, ignore_ns: bool = False) -> Program:
    return Program(parse(record.path or "", record.ns), body_of(record, record.ns, ignore_ns), ignore_ns)


def body_of(record: Record, ns: Mapping[str, str], ignore_ns: bool) -> Body:
    """ns: the bindings around the record, to which it adds its own."""
    ns = {**ns, **record.ns}
    out = Body()
    for name, how in record.fields.items():
        k = len(out.slots)
        if isinstance(how, Attr):
            out.slots.append(Slot(name, kind=plain(how), required=how.required))
            out.attrs.append((attribute(how.name or name, ns).key(ignore_ns), k))
        elif isinstance(how, Text):
            out.slots.append(Slot(name, preserve=how.preserve_whitespace, kind=plain(how)))
            out.texts.append(k)
        elif isinstance(how, MapOf):
            key, value = part(how.key), part(how.value)
            entry = Body()
            for label, p in (("key", key), ("value", value)):
                _place(entry, Slot(label, p.many, _nested(record, p, ns, ignore_ns), kind=plain(p), required=p.required), p.path, ns, ignore_ns)
            out.slots.append(Slot(name, True, entry, map=MapRules(how.required, how.as_map)))
            out.maps.append(MapPlan(parse_child(how.entry, ns).steps[0], k))
        elif isinstance(how.type, Poly):
            out.slots.append(Slot(name, how.many, poly=poly_of(how, ns, ignore_ns), required=how.required))
            out.polys.append(k)
        else:
            nested = _nested(record, how, ns, ignore_ns)
            _place(out, Slot(name, how.many, nested, preserve=how.preserve_whitespace, located=not how.many and nested is None and needs_location(how), kind=plain(how), required=how.required), how.path or name, ns, ignore_ns)
    return out


def part(p: Part | str) -> Part:
    return Part(p) if isinstance(p, str) else p


def attribute(text: str, ns: Mapping[str, str]) -> Name:
    return parse("@" + text.removeprefix("@"), ns).leaf


def poly_of(how: Child, ns: Mapping[str, str], ignore_ns: bool) -> PolyPlan:
    kinds = {}
    for label, record in how.type.kinds.items():
        record = getattr(record, "spec", record)
        told_by = label if how.type.by else parse_child(label, ns).steps[0].name.key(ignore_ns)
        kinds[told_by] = (label, body_of(record, ns, ignore_ns))
    by = attribute(how.type.by, ns).key(ignore_ns) if how.type.by else None
    return PolyPlan(by, parse_child(how.path, ns).steps[0].name if how.type.by else None, kinds)


def _nested(record: Record, how: Child | Part, ns: Mapping[str, str], ignore_ns: bool) -> Body | None:
    nested = inner(record, how)
    return body_of(nested, ns, ignore_ns) if nested else None


def _place(body: Body, slot: Slot, path: str, ns: Mapping[str, str], ignore_ns: bool) -> None:
    """Adds a slot to a body, and its path to the branches."""
    k = len(body.slots)
    body.slots.append(slot)
    if path in ("", "."):
        body.selfs.append(k)
        return
    p = parse_child(path, ns)
    if p.leaf is not None:
        slot.located = False
    if not p.steps:
        body.attrs.append((p.leaf.key(ignore_ns), k))
        return
    deep = p.steps[0].descendant
    slot.suffix = None if deep else "".join(f"/{s.name.local}" for s in p.steps)
    level, branch = (body.heads if deep else body.direct), None
    for step in p.steps:
        branch = next((b for b in level if b.step == step), None)
        if branch is None:
            branch = Branch(step)
            level.append(branch)
        level = branch.below
    if p.leaf is not None:
        branch.leaves.append((p.leaf.key(ignore_ns), k))
    else:
        branch.bodies.append(k)
