"""Raw records off documents, without Spark."""

import os
from pathlib import Path

import pytest

from treeframe.plans.program import program
from treeframe.plans.spec import Attr, Child, MapOf, Part, Poly, Record, Self, Text
from treeframe.sources.split import Malformed, records


def raw(xml, fields, path="//r", ns=None, ignore_ns=False):
    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if k != "_at"}
        return [bare(v) for v in x] if isinstance(x, list) else x

    return [x if isinstance(x, Malformed) else bare(x) for x in records([xml], program(Record(fields, path, ns or {}), ignore_ns))]


def one(xml, field, **how):
    (r,) = raw(xml, {"f": field}, **how)
    return r["f"]


def test_default_names():
    assert raw('<r a="1"><b> x </b></r>', {"a": Attr(), "b": Child()}) == [{"a": "1", "b": "x"}]


def test_attributes_are_not_trimmed_and_texts_are():
    (r,) = raw('<r a=" 1 ">\n own <b> x<i> y </i></b> more </r>', {"a": Attr(), "b": Child(), "t": Text()})
    assert r == {"a": " 1 ", "b": "x y", "t": "own  more"}
    (r,) = raw("<r> o<b> x </b></r>", {"b": Child(preserve_whitespace=True), "t": Text(preserve_whitespace=True)})
    assert r == {"b": " x ", "t": " o"}


def test_empty_is_there_and_missing_is_not():
    assert raw("<r><b/></r>", {"b": Child(), "c": Child(required=False), "t": Text(), "l": Child(many=True, path="x")}) == [{"b": "", "c": None, "t": "", "l": []}]


def test_cdata_and_references():
    assert one("<r><b>a<![CDATA[<&]]>&lt;&#65;</b></r>", Child(path="b")) == "a<&<A"


def test_paths():
    xml = '<r><a><b k="1">x</b><b>y</b></a><a><b k="2">z</b></a></r>'
    assert one(xml, Child(path="a/b", many=True)) == ["x", "y", "z"]
    assert one(xml, Child(path="a/b/@k", many=True)) == ["1", "2"]
    assert one(xml, Child(path="a/b")) == "z"  # the last
    assert one(xml.replace(' k="2"', ""), Child(path="a/b/@k")) == "1"  # the last that has it
    assert one(xml, Child(path="a[2]/b")) == "z"
    assert one(xml, Child(path="a/b[2]", many=True)) == ["y"]
    assert one(xml, Child(path="a/b[@k='1']")) == "x"
    assert one(xml, Child(path="a/b[@k!='1']", many=True)) == ["y", "z"]


def test_descendants():
    xml = '<r><x><h k="1">a<h>b</h></h></x><h>c</h><y><z><h><t q="5">d</t></h></z></y></r>'
    assert one(xml, Child(path="//h", many=True)) == ["ab", "c", "d"]
    assert one(xml, Child(path="//h/t/@q")) == "5"
    assert one(xml, Child(path="//h[@k='1']")) == "ab"
    assert raw(xml, {"t": Child(path="//h/t"), "q": Child(path="//h/t/@q"), "k": Child(path="//h/@k")}) == [{"t": "d", "q": "5", "k": "1"}]


def test_descendants_are_not_looked_for_in_claimed_children():
    xml = "<r><c><h>1</h></c><x><h>2</h></x><m k='1'><h>3</h></m><p><h>4</h></p></r>"
    fields = {"h": Child(path="//h", many=True), "c": Child(path="c/none", required=False), "m": MapOf("m", "@k", "h"), "p": Child(Poly({"p": Record({})}), required=False)}
    assert raw(xml, fields)[0]["h"] == ["2"]
    assert raw(xml, fields | {"c": Child(path="c[@no='1']/none", required=False)})[0]["h"] == ["2"]


def test_a_found_head_hides_what_is_inside_it():
    xml = "<r><x><a><b>1</b></a><b>2<a>3</a></b></x></r>"
    assert raw(xml, {"a": Child(path="//a/@k", many=True), "b": Child(path="//b", many=True)}) == [{"a": [], "b": ["23"]}]
    assert raw(xml, {"a": Child(path="//a[@k='1']/@k", many=True), "b": Child(path="//b", many=True)}) == [{"a": [], "b": ["1", "23"]}]  # no match, nothing hidden


def test_each_descendant_field_keeps_its_own_test():
    xml = "<r><w><x a='b'><y>1</y><z>2</z></x><x><y>3</y><z>4</z></x></w></r>"
    assert raw(xml, {"y": Child(path="//x[@a='b']/y", many=True), "z": Child(path="//x/z", many=True)}) == [{"y": ["1"], "z": ["2", "4"]}]


def test_fields_on_one_child():
    xml = "<r><l t='a' h='1'><q>x</q></l><l t='b' h='2'><q>y</q></l></r>"
    fields = {"a": Child(path="l[@t='a']/q", many=True), "all": Child(path="l/q", many=True), "h": Child(path="l[@t='a']/@h", many=True), "hs": Child(path="l/@h", many=True)}
    assert raw(xml, fields) == [{"a": ["x"], "all": ["y"], "h": ["1"], "hs": ["1", "2"]}]
    assert raw(xml, {"one": Child(path="l/q"), "all": Child(path="l/q", many=True)}) == [{"one": "y", "all": ["x", "y"]}]


def test_outermost_records():
    xml = "<d><r k='1'><r k='2'/></r><r k='3'/></d>"
    assert raw(xml, {"k": Attr()}) == [{"k": "1"}, {"k": "2"}, {"k": "3"}]
    assert [r["k"] for r in raw(xml, {"k": Attr(), "t": Text()})] == ["1", "3"]


def test_records_inside():
    inner = Record({"k": Attr(), "n": Child(required=False)})
    xml = "<r><a k='1'><n>x</n></a><a k='2'/><b><c k='3'/></b></r>"
    assert raw(xml, {"a": Child(inner, "a", many=True), "c": Child(inner, "b/c"), "none": Child(inner, required=False)}) == [
        {"a": [{"k": "1", "n": "x"}, {"k": "2", "n": None}], "c": {"k": "3", "n": None}, "none": None}
    ]


def test_self():
    spec = {"k": Attr(), "kids": Child(Self(2), "r", many=True)}
    assert raw("<r k='1'><r k='2'><r k='3'/></r></r>", spec) == [{"k": "1", "kids": [{"k": "2", "kids": [{"k": "3", "kids": None}]}]}]
    (deeper,) = raw("<r><r><r><r/></r></r></r>", spec)
    assert deeper["kids"][0]["kids"][0]["kids"] is not None  # one level more is seen, not read


def test_maps():
    xml = "<r><e k='a'><v>1</v></e><e><v>2</v><w><v>3</v></w></e></r>"
    assert one(xml, MapOf("e", Part("@k", required=False), Part("//v", many=True))) == [{"key": "a", "value": ["1"]}, {"key": None, "value": ["2", "3"]}]
    assert one(xml, MapOf("e", "v", ".")) == [{"key": "1", "value": "1"}, {"key": "2", "value": "23"}]


def test_unions():
    kinds = {"c": Record({"r": Attr()}), "s": Record({"x": Attr()})}
    xml = "<r><c r='1'/><o/><s x='2'/></r>"
    assert one(xml, Child(Poly(kinds), many=True)) == [{"_type": "c", "c": {"r": "1"}}, {"_type": "s", "s": {"x": "2"}}]
    assert one(xml, Child(Poly(kinds))) == {"_type": "s", "s": {"x": "2"}}
    xml = "<r><e t='s' x='1'/><e t='z'/><e/></r>"
    assert one(xml, Child(Poly(kinds, "@t"), "e", many=True)) == [{"_type": "s", "s": {"x": "1"}}]


def test_namespaces():
    xml = "<r xmlns:p='urn:p' p:a='1' a='2'><p:b>x</p:b><b>y</b></r>"
    fields = {"pa": Attr(name="q:a"), "a": Attr(), "pb": Child(path="q:b"), "b": Child()}
    assert raw(xml, fields, ns={"q": "urn:p"}) == [{"pa": "1", "a": "2", "pb": "x", "b": "y"}]
    assert one("<r xml:lang='en'/>", Attr(name="xml:lang")) == "en"
    assert raw(xml, {"b": Child(many=True)}, ignore_ns=True) == [{"b": ["x", "y"]}]


def test_malformed_after_records():
    a, bad = raw("<d><r k='1'/>\n<r k='2'>", {"k": Attr(), "t": Text()})
    assert a["k"] == "1" and bad.line == 2 and bad.path == "/d/r" and bad.col > 0
    assert isinstance(raw("", {"k": Attr()})[0], Malformed)
    assert isinstance(raw("<r>&undefined;</r>", {"t": Text()})[-1], Malformed)


def test_where_records_stand():
    (r,) = records(["<a>\n <b><r>\n<x><y>1</y></x></r></b></a>"], program(Record({"y": Child("int", "//y"), "z": Child("int", required=False)}, "//r")))
    assert r["_at"] == {"line": 2, "col": 5, "path": "/a/b/r"}
    assert r["y"] == {"v": "1", "line": 3, "col": 4, "path": "/a/b/r/x/y"}


@pytest.mark.parametrize("size", [1, 3, 7])
def test_pieces_of_any_size(size):
    xml = "<d><r k='ä'><b>x&amp;y ü</b><c>1</c></r><r k='2'><b><![CDATA[z]]></b></r></d>".encode()
    prog = program(Record({"k": Attr(), "b": Child()}, "//r"))
    whole = list(records([xml], prog))
    assert [r["b"] for r in whole] == ["x&y ü", "z"]
    assert list(records([xml[i : i + size] for i in range(0, len(xml), size)], prog)) == whole


def test_encodings_and_depth():
    prog = program(Record({"b": Child()}, "//r"))
    assert next(records(["<?xml version='1.0' encoding='ISO-8859-1'?><r><b>ä</b></r>".encode("latin-1")], prog))["b"] == "ä"
    assert next(records(["<?xml version='1.0' encoding='ISO-8859-1'?><r><b>ä€</b></r>"], prog))["b"] == "ä€"
    deep = "<x>" * 5000 + "t" + "</x>" * 5000
    assert next(records([f"<r><b>{deep}</b></r>"], prog))["b"] == "t"
    assert next(records([f"<r>{deep}<q>1</q></r>"], program(Record({"q": Child(path="//q")}, "//r"))))["q"] == "1"


def test_what_no_field_reads_is_not_kept():
    from treeframe.sources.split import Splitter

    s = Splitter(program(Record({"b": Child()}, "//r")))
    s.feed("<r><skipped><b>no</b></skipped><b>y")
    assert [x.tag for x in s.at.above.kids()] == ["b"]
    assert s.feed("</b></r>", True)[0]["b"] == "y"


def test_a_limit_stops_the_parse():
    """Records are handed on as they end: who wants three reads no more of the document than holds them."""
    prog = program(Record({"k": Attr("int")}, "//r"))
    read = []

    def document():
        yield "<d>"
        for i in range(10_000):
            read.append(i)
            yield f"<r k='{i}'/>"

    found = records(document(), prog)
    assert [next(found)["k"] for _ in range(3)] == ["0", "1", "2"] and len(read) <= 4
    found.close()
    found.close()  # closing again does nothing
    assert len(read) <= 4 and list(found) == []


def test_files_are_closed(tmp_path):
    """When a reader of a file stops early, and when it is closed twice."""
    from treeframe.sources.files import _File, _Reader

    (tmp_path / "x.xml").write_text("<d>" + "<r k='1'/>" * 50_000 + "</d>")
    found = _Reader(str(tmp_path), program(Record({"k": Attr("int")}, "//r"))).read(_File(str(tmp_path / "x.xml")))
    assert next(found).num_rows > 0
    found.close()
    found.close()
    assert not [f for f in map(os.path.realpath, Path("/proc/self/fd").iterdir()) if f.endswith("x.xml")]
