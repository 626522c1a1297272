"""Typed records of small documents in which nothing is unusual.

Most documents are small and well formed, and their texts are plainly of the types that fields ask for. Such a document is
parsed into a tree by one call, and its records are read into typed values: no places are noted, no raw strings handed on,
and entries of a map meet in a dictionary. Whatever is unusual (a markup error, a document type, a missing value, a
text that is not plainly of its type) is no error here: the document has no quick records, and is split anew with raw strings and
places, so that Spark gives types and errors. Where quick records are given, Spark would give the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any
from xml.etree.ElementTree import Element, ParseError, XMLParser

from ..plans.paths import Bracket, Step
from ..plans.program import Body, Branch, Program, Slot
from .split import PIECE, Reader


class Unusual(Exception):
    """Not for the quick reader."""


_INT, _LONG = (re.compile(rf"[+-]?[0-9]{{1,{n}}}").fullmatch for n in (9, 18))
_DOUBLE = re.compile(r"[+-]?[0-9]{1,17}(?:\.[0-9]{0,17})?(?:[eE][+-]?[0-9]{1,2})?").fullmatch


def _int(x: str) -> int:
    if _INT(x):
        return int(x)
    raise Unusual


def _long(x: str) -> int:
    if _LONG(x):
        return int(x)
    raise Unusual


def _double(x: str) -> float:
    if _DOUBLE(x):
        return float(x)
    raise Unusual


_READERS: dict[str, Callable[[str], Any]] = {"int": _int, "bigint": _long, "double": _double}


def _there(x: Any) -> Any:
    if x is None:
        raise Unusual
    return x


def _last(slot: Slot) -> Callable[[Any], Any] | None:
    """From what a slot has gathered to its value; None if that is the value."""
    if slot.map:
        return _grouped(slot)
    read = _READERS.get(slot.kind)
    if slot.many:
        return (lambda xs: [read(x) for x in xs]) if read else None
    if not read:
        return _there if slot.required else None
    if slot.required:
        return lambda x: read(_there(x))
    return lambda x: None if x is None else read(x)


def _grouped(slot: Slot) -> Callable[[list[tuple]], Any]:
    how, (key, value) = slot.map, slot.nested.slots

    def group(entries: list[tuple]) -> Any:
        if not entries and not how.required:
            return None
        out: dict[Any, Any] = {}
        for k, v in entries:
            k = tuple(k) if key.many else k
            if value.many and k in out:
                out[k] += v  # the first entry's own list
            else:
                out[k] = v
        if how.as_map and None in out:
            raise Unusual
        return list(out.items())

    return group


def _holds(bracket: Bracket, ignore_ns: bool) -> Callable[[dict, int], bool]:
    """Bracket.holds, with the names' keys known."""

    def term(t) -> Callable[[dict, int], bool]:
        if t.name is None:
            return lambda attrs, count: count == t.position
        key, value = t.name.key(ignore_ns), t.value
        return (lambda attrs, count: attrs.get(key) == value) if t.equal else (lambda attrs, count: attrs.get(key) != value)

    either = [[term(t) for t in a] for a in bracket.alternatives]
    if len(either) == 1 and len(either[0]) == 1:
        return either[0][0]

    def holds(attrs: dict, count: int) -> bool:
        for a in either:
            for t in a:
                if not t(attrs, count):
                    break
            else:
                return True
        return False

    return holds


def passing(step: Step, ignore_ns: bool) -> Callable[[dict, list[int]], bool]:
    """Step.passes."""
    tests = [(k, _holds(b, ignore_ns)) for k, b in enumerate(step.brackets)]

    def passes(attrs: dict, counts: list[int]) -> bool:
        for k, holds in tests:
            counts[k] += 1
            if not holds(attrs, counts[k]):
                return False
        return True

    return passes


Action = Callable[[Element, list, dict], None]


class Quick(Reader):
    """Reads records off trees as tuples, in the order of a body's slots."""

    def __init__(self, body: Body, ignore_ns: bool) -> None:
        super().__init__(body, ignore_ns)
        self.tests: dict[int, tuple[Callable, int]] = {}
        self.reads_children = bool(self.direct or self.maps or self.polys or self.heads)
        self.actions: dict[str, Action] = {key: self.to_union(k) for key, k in self.polys.items()}
        self.actions |= {key: self.to_maps(key) for key in self.maps} | {key: self.to_step(level) for key, level in self.direct.items()}
        #: Heads that no test can refuse.
        self.certain = {key: self.to_step(level) for key, level in self.heads.items() if len(level) == 1 and not level[0].step.brackets}
        self.lists = [k for k, x in enumerate(self.blank) if x is not None]
        self.last = [(k, f) for k, f in enumerate(map(_last, body.slots)) if f]
        self.labels = {id(s): [label for label, _ in s.poly.kinds.values()] for s in body.slots if s.poly}

    def read(self, at: Element) -> tuple:
        out = self.values(at)
        for k, f in self.last:
            out[k] = f(out[k])
        return tuple(out)

    def values(self, at: Element) -> list:
        body, out = self.body, [None] * len(self.blank)
        for k in self.lists:
            out[k] = []
        for key, k in body.attrs:
            self.leaf(at, key, k, out)
        for k in body.texts:
            t = self.own_text(at)
            out[k] = t if body.slots[k].preserve else t.strip()
        for k in body.selfs:
            self.put(at, k, out)
        if self.reads_children:
            actions, heads = self.actions, self.heads
            counters: dict[int, list[int]] = {}
            for x in at:
                act = actions.get(x.tag)
                if act:
                    act(x, out, counters)
                elif heads:
                    self.search(x, out)
        return out

    def passes(self, x: Element, step: Step, owner: Any, counters: dict[int, list[int]]) -> bool:
        if not step.brackets:
            return True
        if id(owner) not in self.tests:
            self.tests[id(owner)] = passing(step, self.ignore_ns), len(step.brackets)
        test, n = self.tests[id(owner)]
        counts = counters.get(id(owner))
        if counts is None:
            counts = counters[id(owner)] = [0] * n
        return test(x.attrib, counts)

    def to_union(self, k: int) -> Action:
        return lambda x, out, counters: self.union(x, k, out)

    def to_maps(self, key: str) -> Action:
        plans = [(m, self.nested[id(self.body.slots[m.slot])].read) for m in self.maps[key]]

        def act(x: Element, out: list, counters: dict) -> None:
            for m, read in plans:
                if not m.step.brackets or self.passes(x, m.step, m, counters):
                    out[m.slot].append(read(x))

        return act

    def to_put(self, k: int) -> Callable[[Element, list], None]:
        """put(), with the slot known."""
        slot = self.body.slots[k]
        if slot.nested:
            return lambda x, out: self.put(x, k, out)
        many, preserve = slot.many, slot.preserve

        def put(x: Element, out: list) -> None:
            v = "".join(x.itertext()) if len(x) else x.text or ""
            if not preserve:
                v = v.strip()
            if many:
                out[k].append(v)
            else:
                out[k] = v

        return put

    def to_step(self, level: list[Branch]) -> Action:
        """step(), with the branches known."""
        if len(level) > 1:
            return lambda x, out, counters: self.step(x, level, counters, out)
        b, puts = level[0], [self.to_put(k) for k in level[0].bodies]
        below = {key: self.to_step(branches) for key, branches in self.below[id(b)].items()}
        if len(puts) == 1 and not (b.step.brackets or b.leaves or below):
            put = puts[0]
            return lambda x, out, counters: put(x, out)

        def act(x: Element, out: list, counters: dict) -> None:
            if b.step.brackets and not self.passes(x, b.step, b, counters):
                return
            for key, k in b.leaves:
                self.leaf(x, key, k, out)
            for put in puts:
                put(x, out)
            if below:
                inside: dict[int, list[int]] = {}
                for y in x:
                    to = below.get(y.tag)
                    if to:
                        to(y, out, inside)

        return act

    def search(self, top: Element, out: list) -> None:
        heads, certain, todo = self.heads, self.certain, [top]
        while todo:
            x = todo.pop()
            act = certain.get(x.tag)
            if act:
                act(x, out, {})
                continue
            found = False
            for b in heads.get(x.tag, ()):
                if self.passes(x, b.step, b, {}):
                    found = True
                    for key, k in b.leaves:
                        self.leaf(x, key, k, out)
                    self.inside(x, b, out)
            if not found and len(x):
                todo.extend(x[::-1])

    def own_text(self, x: Element) -> str:
        return "".join([x.text or "", *[y.tail or "" for y in x]])

    def put(self, x: Element, k: int, out: list) -> None:
        slot = self.body.slots[k]
        if slot.nested:
            v: Any = self.nested[id(slot)].read(x)
        else:
            v = "".join(x.itertext()) if len(x) else x.text or ""
            v = v if slot.preserve else v.strip()
        if slot.many:
            out[k].append(v)
        else:
            out[k] = v

    def union(self, x: Element, k: int, out: list) -> None:
        slot = self.body.slots[k]
        kind = self.kinds[id(slot)].get(x.attrib.get(slot.poly.by) if slot.poly.by else x.tag)
        if kind is None:
            return
        v = (kind[0], *[kind[1].read(x) if label == kind[0] else None for label in self.labels[id(slot)]])
        if slot.many:
            out[k].append(v)
        else:
            out[k] = v


class State:
    """The steps of a path that an element's children may take; moves has what a child's tag leads to."""

    __slots__ = ("active", "hit", "live", "moves")

    def __init__(self, active: frozenset[int], n: int) -> None:
        self.active, self.hit, self.live = active, n in active, any(i < n for i in active)
        self.moves: dict[str, State | Choice] = {}


class Choice:
    """A move that tests decide: sure holds the steps taken in any case, ends the states by the tests that hold."""

    __slots__ = ("sure", "tests", "ends")

    def __init__(self, sure: set[int], tests: list[tuple[int, Callable, int]]) -> None:
        self.sure, self.tests = sure, tests
        self.ends: dict[tuple[bool, ...], State] = {}


class Finder:
    """The elements of a tree that a record path matches, as plans.paths.Matcher has it, with moves kept by tag."""

    def __init__(self, program: Program) -> None:
        self.steps, self.ignore_ns, self.outermost = program.path.steps, program.ignore_ns, program.body.reads_children
        self.tests = [passing(s, program.ignore_ns) for s in self.steps]
        self.states: dict[frozenset[int], State] = {}
        self.start = self.state(frozenset((0,)))

    def state(self, active: frozenset[int]) -> State:
        if active not in self.states:
            self.states[active] = State(active, len(self.steps))
        return self.states[active]

    def move(self, at: State, tag: str) -> State | Choice:
        ns, _, local = tag.rpartition("}")
        sure, tests = set(), []
        for i in at.active:
            if i == len(self.steps):
                continue
            step = self.steps[i]
            if step.descendant:
                sure.add(i)
            if step.name.fits(ns or None, local, self.ignore_ns):
                if step.brackets:
                    tests.append((i, self.tests[i], len(step.brackets)))
                else:
                    sure.add(i + 1)
        return Choice(sure, tests) if tests else self.state(frozenset(sure))

    def chosen(self, choice: Choice, attrs: dict[str, str], counters: dict[int, list[int]]) -> State:
        held = []
        for i, passes, n in choice.tests:
            counts = counters.get(i)
            if counts is None:
                counts = counters[i] = [0] * n
            held.append(passes(attrs, counts))
        key = tuple(held)
        to = choice.ends.get(key)
        if to is None:
            to = choice.ends[key] = self.state(frozenset(choice.sure | {i + 1 for (i, _, _), h in zip(choice.tests, held, strict=True) if h}))
        return to

    def find(self, root: Element) -> list[Element]:
        out: list[Element] = []
        todo = [(iter((root,)), self.start, {})]
        while todo:
            kids, at, counters = todo[-1]
            moves = at.moves
            for x in kids:
                to = moves.get(x.tag)
                if to is None:
                    to = moves[x.tag] = self.move(at, x.tag)
                if type(to) is Choice:
                    to = self.chosen(to, x.attrib, counters)
                if to.hit:
                    out.append(x)
                    if self.outermost:
                        continue
                if to.live and len(x):
                    todo.append((iter(x), to, {}))
                    break
            else:
                todo.pop()
        return out


class QuickRecords:
    """Of a program whose body is plain: the typed records of a document, or None if it is not for the quick reader."""

    def __init__(self, program: Program) -> None:
        self.ignore_ns = program.ignore_ns
        self.finder, self.reader = Finder(program), Quick(program.body, program.ignore_ns)

    def __call__(self, content: str | bytes) -> list[tuple] | None:
        if type(content) is not str or len(content) > PIECE or "<!DOCTYPE" in content:
            return None
        try:
            p = XMLParser()
            p.feed(content.removeprefix("﻿"))
            root = p.close()
            if "xmlns" in content or "xml:" in content:
                self.rename(root)
            read = self.reader.read
            return [read(x) for x in self.finder.find(root)]
        except (ParseError, Unusual):
            return None

    def rename(self, root: Element) -> None:
        """Names as keys of plans.paths.Name."""
        key = (lambda k: k.rpartition("}")[2]) if self.ignore_ns else (lambda k: k.removeprefix("{"))
        for x in root.iter():
            x.tag = key(x.tag)
            if any("}" in k for k in x.attrib):
                attrs = {key(k): v for k, v in x.attrib.items()}
                x.attrib.clear()
                x.attrib.update(attrs)
