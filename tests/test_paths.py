"""The path language: reading it, and following documents with it."""

import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeframe.plans.paths import ANY, Matcher, Name, PathError, parse, parse_child
from treeframe.plans.program import program
from treeframe.plans.spec import Attr, Record
from treeframe.sources.split import records


def matched(path, xml, ns=None, ignore_ns=False):
    """The ids of the elements that match."""
    spec = Record({"id": Attr("string", "id", required=False)}, path, ns or {})
    return [r["id"] for r in records([xml], program(spec, ignore_ns))]


def test_steps_and_axes():
    p = parse("/a/b//c")
    assert p.absolute and [s.descendant for s in p.steps] == [False, False, True]
    assert not parse("a/b").absolute and parse("a/b").steps[0].descendant
    assert not parse_child("a/b").steps[0].descendant and parse_child("//a").steps[0].descendant


def test_names():
    ns = {"": "urn:d", "p": "urn:p"}
    assert parse("//a", ns).steps[0].name == Name("urn:d", "a")
    assert parse("//p:a", ns).steps[0].name == Name("urn:p", "a")
    assert parse("//{}a", ns).steps[0].name == Name(None, "a")
    assert parse("//{urn:x/y}a").steps[0].name == Name("urn:x/y", "a")
    assert parse("//{*}a").steps[0].name == Name(ANY, "a")
    assert parse("//*").steps[0].name == Name(ANY, ANY)
    assert parse("//a/@b", ns).leaf == Name(None, "b")  # the default is not for attributes
    assert parse("//a/@p:b", ns).leaf == Name("urn:p", "b")


@pytest.mark.parametrize("path", ["", "  ", "//a[", "//a[]", "//a[@b='x]", "//a[@b]", "//a[@b 'x']", "//a[[1]]", "//{urn:a", "//q:a", "//a/@b/c", "//a[0]", "//a]", "a//", "/", "//a[@b=\"x\"]"])
def test_what_is_no_path(path):
    with pytest.raises(PathError):
        parse(path)


XML = '<r><g><i id="1" k="p"/><i id="2" k="q"/><i id="3" k="p"/></g><g><i id="4" k="q"/><i id="5" k="p"/><i id="6" k="p"/></g><i id="7"/></r>'


@pytest.mark.parametrize(
    ("path", "ids"),
    [
        ("//i", "1234567"), ("/r/i", "7"), ("g/i", "123456"), ("/i", ""), ("/r//i", "1234567"), ("/r/*/i", "123456"),
        ("//i[2]", "25"), ("//i[@k='p'][2]", "36"), ("//i[2][@k='p']", "5"), ("//i[2 and @k='p']", "5"), ("//i[1 or @k='p']", "134567"),
        ("//i[@k!='p']", "247"), ("//i[@k='p' and @id='1' or @k='q']", "124"), ("//g[2]/i[1]", "4"), ("//i[@k='p'][@id='3']", "3"), ("//i[@k='p'][1]", "15"),
    ],
)
def test_matches(path, ids):
    assert "".join(matched(path, XML)) == ids


def test_namespaces():
    xml = '<x:r xmlns:x="urn:x"><x:i id="1" x:k="a"/><i id="2" k="a"/><i xmlns="urn:x" id="3"/></x:r>'
    assert matched("//p:i", xml, {"p": "urn:x"}) == ["1", "3"]
    assert matched("//i", xml) == ["2"]
    assert matched("//{*}i", xml) == ["1", "2", "3"]
    assert matched("//{urn:x}i[@p:k='a']", xml, {"p": "urn:x"}) == ["1"]
    assert matched("//{urn:x}i[@k='a']", xml) == []
    assert matched("//i", xml, ignore_ns=True) == ["1", "2", "3"]
    assert matched("//i[@k='a']", xml, ignore_ns=True) == ["1", "2"]


NAMES, VALUES = "ab", "xy"
trees = st.recursive(
    st.tuples(st.sampled_from(NAMES), st.sampled_from(["", *VALUES]), st.just([])),
    lambda kids: st.tuples(st.sampled_from(NAMES), st.sampled_from(["", *VALUES]), st.lists(kids, max_size=4)),
    max_leaves=25,
)
terms = st.one_of(st.integers(1, 3).map(str), st.builds("@k{}'{}'".format, st.sampled_from(["=", "!="]), st.sampled_from(VALUES)))
brackets = st.lists(terms, min_size=1, max_size=3).flatmap(lambda t: st.lists(st.sampled_from([" and ", " or "]), min_size=len(t) - 1, max_size=len(t) - 1).map(lambda ops: "[" + "".join(a + b for a, b in zip(t, [*ops, ""], strict=True)) + "]"))
steps = st.tuples(st.sampled_from(["/", "//"]), st.sampled_from([*NAMES, "*"]), st.lists(brackets, max_size=2).map("".join)).map("".join)
paths = st.lists(steps, min_size=1, max_size=3).map("".join)


def markup(tree):
    name, k, kids = tree
    return f"<{name}{f' k="{k}"' if k else ''}>{''.join(map(markup, kids))}</{name}>"


def selected(root, path):
    """By the words of the definition: all contexts at once, step by step, siblings counted for each parent."""
    above = {c: p for p in root.iter() for c in p}
    order = {e: i for i, e in enumerate(root.iter())}
    contexts = [None]
    for step in parse(path).steps:
        found = set()
        for c in contexts:
            found |= set(root.iter()) - {c} if c is None and step.descendant else {root} if c is None else set(c.iter()) - {c} if step.descendant else set(c)
        found = [e for e in found if step.name.local in (ANY, e.tag)]
        kept = []
        for parent in {above.get(e) for e in found}:
            left = sorted((e for e in found if above.get(e) is parent), key=order.get)
            for b in step.brackets:
                left = [e for n, e in enumerate(left, 1) if any(all(n == t.position if t.name is None else (e.get("k") == t.value) == t.equal for t in a) for a in b.alternatives)]
            kept += left
        contexts = kept
    return sorted(order[e] for e in contexts)


@settings(max_examples=300, deadline=None)
@given(trees, paths)
def test_matcher_against_the_definition(tree, path):
    root = ET.fromstring(markup(tree))
    m, found = Matcher(parse(path)), []
    order = {e: i for i, e in enumerate(root.iter())}

    def walk(e):
        if m.push(None, e.tag, e.attrib):
            found.append(order[e])
        for c in e:
            walk(c)
        m.pop()

    walk(root)
    assert found == selected(root, path)
