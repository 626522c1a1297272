"""The path language: which elements are records, and where in a record a field is found.

    path    := ('//' | '/')? step (('/' | '//') step)* ('/@' name)?
    step    := name bracket*
    name    := ('{' uri '}' | '{*}' | prefix ':')? local | '*'
    bracket := '[' term (('and' | 'or') term)* ']'
    term    := '@' name ('=' | '!=') quoted | integer

`and` binds tighter than `or`; there are no parentheses. A name without a prefix is in the default namespace if the
map binds "", else in none; for attributes the default never counts. `@a!='v'` also holds where the attribute is absent.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

XML_NS = "http://www.w3.org/XML/1998/namespace"
ANY = "*"


class PathError(ValueError):
    """A path that cannot be read; `at` counts characters from 0."""

    def __init__(self, message: str, path: str, at: int) -> None:
        super().__init__(f"{message} at {at} in {path!r}")
        self.at = at


@dataclass(frozen=True)
class Name:
    """ns None: no namespace; ANY: any. local may be ANY."""

    ns: str | None
    local: str

    def fits(self, ns: str | None, local: str, ignore_ns: bool = False) -> bool:
        return self.local in (ANY, local) and (ignore_ns or self.ns in (ANY, ns))

    def key(self, ignore_ns: bool = False) -> str:
        """The name as the parser reports it: uri}local, or local alone where there is no namespace."""
        return f"{self.ns}}}{self.local}" if self.ns and not ignore_ns else self.local

    def __str__(self) -> str:
        return f"{{{self.ns}}}{self.local}" if self.ns else self.local


@dataclass(frozen=True)
class Term:
    """An attribute test (name, equal, value) or, if name is None, a position."""

    name: Name | None = None
    equal: bool = True
    value: str = ""
    position: int = 0

    def holds(self, attrs: Mapping[str, str], count: int, ignore_ns: bool = False) -> bool:
        """attrs by key() of their names."""
        if self.name is None:
            return count == self.position
        return (attrs.get(self.name.key(ignore_ns)) == self.value) is self.equal


@dataclass(frozen=True)
class Bracket:
    """Terms in alternatives: one alternative must hold in all its terms."""

    alternatives: tuple[tuple[Term, ...], ...]

    @property
    def positional(self) -> bool:
        return any(t.name is None for a in self.alternatives for t in a)

    def holds(self, attrs: Mapping, count: int, ignore_ns: bool = False) -> bool:
        return any(all(t.holds(attrs, count, ignore_ns) for t in a) for a in self.alternatives)


@dataclass(frozen=True)
class Step:
    name: Name
    descendant: bool = False
    brackets: tuple[Bracket, ...] = ()

    def passes(self, attrs: Mapping, counts: list[int], ignore_ns: bool = False) -> bool:
        """Tests the brackets in order. counts, one for each, go up for the siblings that reach the bracket."""
        for k, b in enumerate(self.brackets):
            counts[k] += 1
            if not b.holds(attrs, counts[k], ignore_ns):
                return False
        return True


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]
    leaf: Name | None = None
    absolute: bool = False
    text: str = ""


class _Reader:
    def __init__(self, path: str, ns: Mapping[str, str]) -> None:
        self.path, self.ns, self.at = path, {"xml": XML_NS, **ns}, 0

    def error(self, message: str, at: int | None = None) -> PathError:
        return PathError(message, self.path, self.at if at is None else at)

    def take(self, token: str) -> bool:
        if self.path.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def word(self, pattern: str) -> str:
        m = re.compile(pattern).match(self.path, self.at)
        if not m:
            return ""
        self.at = m.end()
        return m[0]

    def name(self, attribute: bool = False) -> Name:
        start = self.at
        if self.take("{"):
            end = self.path.find("}", self.at)
            if end < 0:
                raise self.error("brace is not closed", start)
            uri, self.at = self.path[self.at : end], end + 1
            local = self.local()
            return Name(ANY if uri == ANY else uri or None, local)
        if not attribute and self.take(ANY):
            return Name(ANY, ANY)
        local = self.local()
        if self.take(":"):
            if local not in self.ns:
                raise self.error(f"prefix {local!r} is not bound", start)
            return Name(self.ns[local] or None, self.local())
        return Name(None if attribute else self.ns.get("") or None, local)

    def local(self) -> str:
        got = self.word(r"[^\W\d][\w.\-]*")
        if not got:
            raise self.error("a name is missing")
        return got

    def term(self) -> Term:
        self.word(r"\s*")
        if self.take("@"):
            name = self.name(attribute=True)
            self.word(r"\s*")
            equal = not self.take("!")
            if not self.take("="):
                raise self.error("= is missing")
            self.word(r"\s*")
            start = self.at
            if not self.take("'"):
                raise self.error("a value in single quotes is missing")
            end = self.path.find("'", self.at)
            if end < 0:
                raise self.error("quote is not closed", start)
            value, self.at = self.path[self.at : end], end + 1
            return Term(name, equal, value)
        number = self.word(r"\d+")
        if not number:
            raise self.error("a test or a position is missing")
        if int(number) < 1:
            raise self.error("positions begin at 1")
        return Term(position=int(number))

    def bracket(self) -> Bracket:
        out, start = [[self.term()]], self.at
        while True:
            self.word(r"\s*")
            if self.take("]"):
                return Bracket(tuple(map(tuple, out)))
            if self.word(r"and\b"):
                out[-1].append(self.term())
            elif self.word(r"or\b"):
                out.append([self.term()])
            else:
                raise self.error("bracket is not closed" if self.at >= len(self.path) else "] is missing", start)

    def read(self) -> Path:
        if not self.path.strip():
            raise self.error("path is empty")
        absolute, descendant = False, False
        if self.take("//"):
            descendant = True
        elif self.take("/"):
            absolute = True
        else:
            descendant = True
        steps: list[Step] = []
        while True:
            if self.take("@"):
                leaf = self.name(attribute=True)
                if self.at < len(self.path):
                    raise self.error("an attribute can only stand at the end")
                return Path(tuple(steps), leaf, absolute, self.path)
            name, brackets = self.name(), []
            while self.take("["):
                brackets.append(self.bracket())
            steps.append(Step(name, descendant, tuple(brackets)))
            if self.at >= len(self.path):
                return Path(tuple(steps), None, absolute, self.path)
            if self.take("//"):
                descendant = True
            elif self.take("/"):
                descendant = False
            else:
                raise self.error(f"unexpected {self.path[self.at]!r}")


def parse(path: str, ns: Mapping[str, str] | None = None) -> Path:
    """A record path. Relative paths match at any depth, as if // stood before them."""
    return _Reader(path, ns or {}).read()


def parse_child(path: str, ns: Mapping[str, str] | None = None) -> Path:
    """A path inside a record: its first step is a child unless // stands before it."""
    p = parse(path, ns)
    if p.steps and not path.startswith("/"):
        p = Path((Step(p.steps[0].name, False, p.steps[0].brackets), *p.steps[1:]), p.leaf, False, p.text)
    return p


class Matcher:
    """Follows a document's start and end tags and says which elements a record path matches."""

    def __init__(self, path: Path, ignore_ns: bool = False) -> None:
        self.steps, self.ignore_ns = path.steps, ignore_ns
        self.frames: list[tuple[frozenset[int], dict[int, list[int]]]] = [(frozenset((0,)), {})]

    def push(self, ns: str | None, local: str, attrs: Mapping) -> bool:
        active, counters = self.frames[-1]
        now = set()
        for i in active:
            if i == len(self.steps):
                continue
            step = self.steps[i]
            if step.descendant:
                now.add(i)
            if step.name.fits(ns, local, self.ignore_ns):
                counts = counters.setdefault(i, [0] * len(step.brackets))
                if step.passes(attrs, counts, self.ignore_ns):
                    now.add(i + 1)
        self.frames.append((frozenset(now), {}))
        return len(self.steps) in now

    def pop(self) -> None:
        self.frames.pop()
