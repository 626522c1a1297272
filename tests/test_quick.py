"""The quick reader of typed records against the splitter, whose raw records are read by the types of table functions; and what it saves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from treeframe import Attr, Child, MapOf, Part, Poly, Record, Text, extract, find, nodes
from treeframe.functions.arrays import by_key
from treeframe.operators.udtf import row_reader
from treeframe.plans.program import program
from treeframe.sources.quick import QuickRecords
from treeframe.sources.split import Malformed, pieces, records

IN = Record({"k": Attr("int"), "b": Child("double", required=False)})
SPECS = {
    "flat": Record({"k": Attr("int"), "b": Child("double"), "t": Text()}, "//r"),
    "attributes": Record({"k": Attr("long", required=False)}, "//a"),
    "tests": Record({"k": Attr(required=False), "b": Child(path="b[2]", required=False)}, "//a[@k='1' or 2]"),
    "chain": Record({"b": Child("int", "b", many=True)}, "/d/r[@k!='2'][2]"),
    "middle": Record({"t": Text(preserve_whitespace=True)}, "d//a/b"),
    "any": Record({"k": Attr("int", required=False)}, "/*/r"),
    "overlap": Record({"x": Child(path="a[@k='1']/b", many=True), "y": Child(path="a/b", many=True), "z": Child("int", "a/@k", many=True), "w": Child("int", "a[2]/@k", required=False)}, "//r"),
    "heads": Record({"b": Child("double", "//b", many=True), "k": Child("int", "//a[@k='2']/@k", many=True), "c": Child("string", "c", required=False)}, "//r"),
    "tail": Record({"b": Child(path="//a/b", many=True), "k": Child(path="//a/b/@k", many=True)}, "r"),
    "inside": Record({"a": Child(IN, "a", many=True), "c": Child(IN, "c", required=False)}, "//r"),
    "map": Record({"m": MapOf("a", "@k", Part("b", "double", required=False))}, "//r"),
    "map of lists": Record({"m": MapOf("a", Part("b", many=True), Part("//c", "int", many=True), required=False)}, "//r"),
    "map of records": Record({"m": MapOf("a", Part(".", Record({"k": Attr(required=False)})), Part(".", IN, many=True))}, "//r"),
    "spark's map": Record({"m": MapOf("a", Part("@k", required=False), Part("b"), as_map=True)}, "//r"),
    "kinds": Record({"p": Child(Poly({"a": IN, "c": Record({"t": Text()})}), many=True)}, "//r"),
    "kinds by attribute": Record({"p": Child(Poly({"1": IN, "2": Record({"t": Text()})}, "@k"), "a", required=False)}, "//r"),
    "namespaces": Record({"k": Attr(name="n:k", required=False), "b": Child(path="n:b", many=True)}, "//n:a", {"n": "urn:n"}),
}


def element(rng, depth):
    name, attrs = rng.choice("rabc"), "".join(rng.choice(["", f' {k}="{rng.choice(["1", "2", "7", "x" if rng.random() < 0.1 else "3"])}"']) for k in ("k", "n:k"))
    inside = "".join(element(rng, depth - 1) for _ in range(rng.randrange(4))) if depth else ""
    text = rng.choice([" 1.5", "2", "7 ", "-3e2", "<!-- c -->4", "<![CDATA[5]]>", "&#54;", "", "?" if rng.random() < 0.2 else "8", "<?p i?>9"])
    name = f"n:{name}" if rng.random() < 0.1 else name
    return f"<{name}{attrs}>{text}{inside}{rng.choice(['', ' ', '1'])}</{name}>"


def slow(content, spec, prog):
    """The records' rows, or None where something is wrong."""
    read, out = row_reader(spec, prog.body), []
    for r in records(pieces(content), prog):
        if isinstance(r, Malformed):
            return None
        try:
            out.append(read(r))
        except ValueError:
            return None
    return out


@pytest.mark.parametrize("ignore_ns", [False, True])
@pytest.mark.parametrize("name", SPECS)
def test_same_records(name, ignore_ns):
    spec, rng, given = SPECS[name], random.Random(name), 0
    prog = program(spec, ignore_ns)
    assert prog.body.plain
    quick = QuickRecords(prog)
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else x
    for n in range(600):
        content = f'<d xmlns:n="urn:n">{"".join(element(rng, n % 3 + 1) for _ in range(n % 4 + 1))}</d>'
        content = content if n % 20 else content[:-3]
        got = quick(content)
        if got is None:
            continue
        want = slow(content, spec, prog)
        if name == "spark's map" and want:
            want = [(list(m.items()),) for (m,) in want]
        assert want is not None and plain(got) == plain(want), content
        given += len(got) > 0
    assert given > 3


@pytest.mark.parametrize("content", ["<d><r k='1'><b>1</b></r>", "", "<!DOCTYPE d [<!ENTITY e '1'>]><d><r k='&e;'><b>1</b></r></d>", "<d><r k='1'/></d>", "<d><r k='x'><b>1</b></r></d>", "<d><r k='1'><b>1f</b></r></d>", "<d><r k='12345678901'><b>1</b></r></d>", b"<d/>"])
def test_what_is_unusual_is_left_to_spark(content):
    assert QuickRecords(program(SPECS["flat"]))(content) is None


def test_which_bodies_are_plain():
    for how in (Child("date"), Child("double", fmt="0.0"), Child("string", converter=lambda x: x), MapOf("a", Part("@k", "double"), "b"), MapOf("a", Part(".", Record({"b": Child(many=True)})), "b")):
        assert not program(Record({"x": how}, "//r")).body.plain


def test_rows_of_both_ways(spark):
    """Documents that are plain and others, in one batch."""
    rows = [(i, f"<d><r k='{i}'><b>{'1.5' if i % 3 else '1.5d'}</b>t</r></d>" if i % 7 else None) for i in range(50)]
    out = extract(spark.createDataFrame(rows, "i int, content string"), SPECS["flat"], keep=["i"]).collect()
    assert sorted(map(tuple, out)) == [(i, i, 1.5, "t") for i in range(50) if i % 7]
    bad = extract(spark.createDataFrame([(1, "<d><r k='1'><b>2</b></r><r k='y'><b>2</b></r></d>"), (2, "<d><r k='2'><b>3</b></r></d>")], "i int, content string"), SPECS["flat"], keep=["i"], mode="PERMISSIVE")
    got = sorted((r.i, r.k, r.b, [e.message for e in r._errors]) for r in bad.collect() if r.k)
    assert got == [(1, 1, 2.0, []), (2, 2, 3.0, [])] and bad.filter("k IS NULL").first()._errors[0].message == "Cannot coerce 'y' to Int for 'k' at /d/r (line 1, col 25)"


def test_entries_are_made_once(spark):
    """by_key() names its entries in every group: made anew each time, they cost the square of their number."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: (i % 30).cast("string")).alias("x"))
    entries = F.transform("x", lambda e: F.struct(F.regexp_replace(e, "^0+", "").alias("key"), F.array(e).alias("value")))
    assert [str(by_key(entries, append)).count("regexp_replace") for append in (True, False)] == [1, 1]
    assert df.select(F.size(by_key(entries, True)).alias("n"), F.size(by_key(entries, False)).alias("m")).first() == (30, 30)


def test_no_map_goes_through_a_join(spark):
    """nodes_sql: attributes that a path tests or reads were dealt and sorted as maps, most of a task's memory."""
    table = nodes(spark.createDataFrame([(1, "<o><l k='R' n='1'/><l k='R' n='2'/><l k='A' n='3'/></o>"), (2, "<o><l k='R' n='4'/><l n='5'/></o>")], "doc int, content string"), keep=["doc"])
    found = find(table, "//o/l[2][@k='R']/@n", "doc").select("doc", "value")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    dealt = re.findall(r"^\(\d+\) (?:Exchange|Sort|Window|\w+Join|BroadcastExchange)\b.*\n(?:Input.*|Left keys.*)", plan, re.M)
    assert dealt and not [x for x in dealt if "attrs#" in x]
    assert [tuple(r) for r in found.collect()] == [(1, "2")]
    whole = find(table, "//o/l[@k!='R' or 2]/@n", "doc")
    assert whole.columns == [*table.columns, "value"] and sorted((r.doc, r.value, r.attrs.get("k")) for r in whole.collect()) == [(1, "2", "R"), (1, "3", "A"), (2, "5", None)]
