"""Splits documents into records: one pass over the markup that keeps no more than the record at hand.

A document is fed in pieces. Elements outside records only move the path's matcher; inside a record, children that no
field asks for are skipped without being kept. When a record ends, its body is read off the tree of its elements as raw
strings, and the tree is dropped. Spark gives the strings their types.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any
from xml.parsers import expat

from ..plans.paths import Matcher
from ..plans.program import Body, Branch, MapPlan, PolyPlan, Program, Slot

#: Bytes or characters of a document that are parsed at a time.
PIECE = 1 << 20


class Element:
    __slots__ = ("tag", "attrib", "items", "line", "col", "above", "path")

    def __init__(self, tag: str, attrs: dict[str, str], line: int, col: int, above: Element | None, path: str | None = None) -> None:
        self.tag, self.attrib, self.line, self.col, self.above, self.path = tag, attrs, line, col, above, path
        self.items: list[str | Element] = []

    def own_text(self) -> str:
        return "".join([x for x in self.items if type(x) is str])

    def text(self) -> str:
        """All text inside, in the order of the document."""
        if all(type(x) is str for x in self.items):
            return "".join(self.items)
        out, todo = [], self.items[::-1]
        while todo:
            x = todo.pop()
            if type(x) is str:
                out.append(x)
            else:
                todo.extend(reversed(x.items))
        return "".join(out)

    def kids(self) -> list[Element]:
        return [x for x in self.items if type(x) is not str]

    def __iter__(self) -> Iterator[Element]:
        return iter(self.kids())

    def where(self) -> str:
        names, x = [], self
        while x.path is None:
            names.append(x.tag.rpartition("}")[2])
            x = x.above
        return "/".join([x.path, *reversed(names)])


class Malformed(Exception):
    def __init__(self, message: str, line: int, col: int, path: str) -> None:
        super().__init__(message)
        self.message, self.line, self.col, self.path = message, line, col, path


class Reader:
    """Reads the values of a body off an element."""

    def __init__(self, body: Body, ignore_ns: bool) -> None:
        self.body, self.ignore_ns = body, ignore_ns
        own = type(self)
        self.nested = {id(s): own(s.nested, ignore_ns) for s in body.slots if s.nested}
        self.kinds = {id(s): {k: (label, own(b, ignore_ns)) for k, (label, b) in s.poly.kinds.items()} for s in body.slots if s.poly}
        self.direct = self.by_name(body.direct)
        self.heads = self.by_name(body.heads)
        self.maps: dict[str, list[MapPlan]] = {}
        for m in body.maps:
            self.maps.setdefault(m.step.name.key(ignore_ns), []).append(m)
        self.polys: dict[str, int] = {}
        for k in body.polys:
            plan = body.slots[k].poly
            for key in [plan.element.key(ignore_ns)] if plan.by else plan.kinds:
                self.polys.setdefault(key, k)
        self.below = {id(b): self.by_name(b.below) for b in self._branches([*body.direct, *body.heads])}
        self.blank = [[] if s.many else None for s in body.slots]
        self.names = [s.name for s in body.slots]
        self.keys = self.wanted()

    def _branches(self, level: list[Branch]) -> Iterator[Branch]:
        for b in level:
            yield b
            yield from self._branches(b.below)

    def by_name(self, level: list[Branch]) -> dict[str, list[Branch]]:
        """Branches by the key of their name. Where namespaces are ignored, the first name declared with a local name has it."""
        out: dict[str, list[Branch]] = {}
        for b in level:
            have = out.setdefault(b.step.name.key(self.ignore_ns), [])
            if not have or have[0].step.name == b.step.name:
                have.append(b)
        return out

    def wanted(self) -> set[str] | None:
        """The keys of children that are read; None if any may be."""
        if self.body.heads or self.body.selfs:
            return None
        return {*self.direct, *self.maps, *self.polys}

    def read(self, at: Element) -> dict[str, Any]:
        got = dict(zip(self.names, self.values(at), strict=True))
        got["_at"] = {"line": at.line, "col": at.col, "path": at.where()}
        return got

    def own_text(self, x: Element) -> str:
        return x.own_text()

    def values(self, at: Element) -> list:
        """What each slot gathers."""
        body, out = self.body, [list(x) if x is not None else None for x in self.blank]
        for key, k in body.attrs:
            self.leaf(at, key, k, out)
        for k in body.texts:
            t = self.own_text(at)
            out[k] = t if body.slots[k].preserve else t.strip()
        for k in body.selfs:
            self.put(at, k, out)
        if self.direct or self.maps or self.polys or self.heads:
            counters: dict[int, list[int]] = {}
            for x in at:
                if x.tag in self.direct:
                    self.step(x, self.direct[x.tag], counters, out)
                elif x.tag in self.maps:
                    for m in self.maps[x.tag]:
                        if self.passes(x, m.step, m, counters):
                            out[m.slot].append(self.nested[id(body.slots[m.slot])].read(x))
                elif x.tag in self.polys:
                    self.union(x, self.polys[x.tag], out)
                elif self.heads:
                    self.search(x, out)
        return out

    def passes(self, x: Element, step: Any, owner: Any, counters: dict[int, list[int]]) -> bool:
        return not step.brackets or step.passes(x.attrib, counters.setdefault(id(owner), [0] * len(step.brackets)), self.ignore_ns)

    def step(self, x: Element, level: list[Branch], counters: dict[int, list[int]], out: list) -> None:
        """Attributes are read by every branch whose tests hold; what is inside by the first of them that asks for it."""
        taken = False
        for b in level:
            if self.passes(x, b.step, b, counters):
                for key, k in b.leaves:
                    self.leaf(x, key, k, out)
                if b.consumes and not taken:
                    taken = True
                    self.inside(x, b, out)

    def inside(self, x: Element, b: Branch, out: list) -> None:
        for k in b.bodies:
            self.put(x, k, out)
        if b.below:
            level, counters = self.below[id(b)], {}
            for y in x:
                if y.tag in level:
                    self.step(y, level[y.tag], counters, out)

    def search(self, top: Element, out: list) -> None:
        """Elements at any depth that a head names; nothing is looked for inside one that was found."""
        todo = [top]
        while todo:
            x = todo.pop()
            found = False
            for b in self.heads.get(x.tag, ()):
                if self.passes(x, b.step, b, {}):
                    found = True
                    for key, k in b.leaves:
                        self.leaf(x, key, k, out)
                    self.inside(x, b, out)
            if not found:
                todo.extend(reversed(list(x)))

    def leaf(self, x: Element, key: str, k: int, out: list) -> None:
        v = x.attrib.get(key)
        if v is not None:
            if self.body.slots[k].many:
                out[k].append(v)
            else:
                out[k] = v

    def put(self, x: Element, k: int, out: list) -> None:
        slot: Slot = self.body.slots[k]
        if slot.nested:
            v: Any = self.nested[id(slot)].read(x)
        else:
            v = x.text()
            v = v if slot.preserve else v.strip()
            if slot.located:
                v = {"v": v, "line": x.line, "col": x.col}
                if slot.suffix is None:
                    v["path"] = x.where()
        if slot.many:
            out[k].append(v)
        else:
            out[k] = v

    def union(self, x: Element, k: int, out: list) -> None:
        slot = self.body.slots[k]
        plan: PolyPlan = slot.poly
        kind = self.kinds[id(slot)].get(x.attrib.get(plan.by) if plan.by else x.tag)
        if kind is None:
            return
        v = {"_type": kind[0], kind[0]: kind[1].read(x)}
        if slot.many:
            out[k].append(v)
        else:
            out[k] = v


class Splitter:
    """Feed it a document; it returns the records that have ended."""

    def __init__(self, program: Program, reader: Reader | None = None) -> None:
        self.reader = reader or Reader(program.body, program.ignore_ns)
        self.keep_body = program.body.reads_children
        self.wanted = self.reader.keys
        self.ignore_ns = program.ignore_ns
        self.matcher = Matcher(program.path, program.ignore_ns)
        self.stack: list[str] = []
        self.at: Element | None = None
        self.skipping = 0
        self.done: list[dict[str, Any]] = []
        self.names: dict[str, tuple[str | None, str, str]] = {}
        self.parser = p = expat.ParserCreate(namespace_separator="}")
        p.ordered_attributes = True
        p.buffer_text = True
        p.buffer_size = 1 << 16
        p.StartElementHandler, p.EndElementHandler = self._start, self._end
        if self.keep_body:
            p.CharacterDataHandler = self._text

    def _name(self, name: str) -> tuple[str | None, str, str]:
        """(namespace, local name, key)"""
        got = self.names.get(name)
        if got is None:
            ns, _, local = name.rpartition("}")
            got = self.names[name] = (ns or None, local, local if self.ignore_ns else name)
        return got

    def _attrs(self, flat: list[str]) -> dict[str, str]:
        if not flat:
            return {}
        if self.ignore_ns:
            return {k.rpartition("}")[2]: v for k, v in zip(flat[::2], flat[1::2], strict=True)}
        return dict(zip(flat[::2], flat[1::2], strict=True))

    def _start(self, name: str, flat: list[str]) -> None:
        if self.skipping:
            self.skipping += 1
            return
        ns, local, key = self._name(name)
        p = self.parser
        if (above := self.at) is not None:
            if above.above is None and self.wanted is not None and key not in self.wanted:
                self.skipping = 1
                return
            self.at = x = Element(key, self._attrs(flat), p.CurrentLineNumber, p.CurrentColumnNumber + 1, above)
            above.items.append(x)
            return
        attrs = self._attrs(flat)
        self.stack.append(local)
        if self.matcher.push(ns, local, attrs):
            x = Element(key, attrs, p.CurrentLineNumber, p.CurrentColumnNumber + 1, None, "/" + "/".join(self.stack))
            if self.keep_body:
                self.at = x
            else:
                self.done.append(self.reader.read(x))

    def _end(self, name: str) -> None:
        if self.skipping:
            self.skipping -= 1
            return
        x = self.at
        if x is not None:
            self.at = x.above
            if x.above is not None:
                return
            self.done.append(self.reader.read(x))
        self.stack.pop()
        self.matcher.pop()

    def _text(self, data: str) -> None:
        if self.at is not None and not self.skipping:
            self.at.items.append(data)

    def feed(self, data: str | bytes, last: bool = False) -> list[dict[str, Any]]:
        try:
            self.parser.Parse(data, last)
        except expat.ExpatError as e:
            where = self.at.where() if self.at is not None else "/" + "/".join(self.stack)
            raise Malformed(expat.ErrorString(e.code) or str(e), e.lineno, e.offset + 1, where) from None
        done, self.done = self.done, []
        return done

    def rest(self) -> list[dict[str, Any]]:
        """Records that ended before the document turned out malformed."""
        done, self.done = self.done, []
        return done


def records(pieces: Iterable[str | bytes], program: Program, reader: Reader | None = None) -> Iterator[dict[str, Any] | Malformed]:
    """The records of one document in order; where it is malformed, what is wrong comes last. A reader of the program's serves many documents."""
    s = Splitter(program, reader)
    try:
        for piece in pieces:
            yield from s.feed(piece)
        yield from s.feed(b"", True)
    except Malformed as e:
        yield from s.rest()
        yield e


def pieces(content: str | bytes) -> Iterator[str | bytes]:
    """A document in pieces. A byte order mark is no part of a string's text."""
    if isinstance(content, str):
        content = content.removeprefix("﻿")
    for at in range(0, len(content), PIECE):
        yield content[at : at + PIECE]
