"""Typed rows, errors and sources, with Spark."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from treeframe import Attr, Child, MapOf, Part, Poly, Record, Self, SpecError, Text, extract, find, nodes, read_files, read_large, register, stream_files
from treeframe.functions.arrays import by_key
from treeframe.functions.coerce import coerce
from treeframe.operators.udtf import scalar_reader
from treeframe.plans.spec import scalar


def docs(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, content string")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


VALUES = {
    "int": ({"42": 42, "-7": -7, "+7": 7, "2147483647": 2147483647}, ["", " 42", "42 ", "4.2", "2147483648", "0x1", "abc"]),
    "long": ({"9223372036854775807": 9223372036854775807, "-1": -1}, ["", "9223372036854775808", "1L", "1 "]),
    "double": ({"4.25": 4.25, " 4.25 ": 4.25, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "2d": 2.0, "-Infinity": float("-inf")}, ["", "x", "1,5", "infinity", "1e", "0.5 5"]),
    "boolean": ({"true": True, " YES ": True, "1": True, "False": False, "no": False, "0": False}, ["", "t", "y", "2", "on"]),
    "decimal(20,4)": ({"1234.50": Decimal("1234.5000"), "-1": Decimal("-1.0000"), "1e2": Decimal("100.0000")}, ["", "x", " 1", "1,000", "1" * 30]),
    "date": ({"2026-02-28": dt.date(2026, 2, 28)}, ["", "2026-2-28", "2026-02-30", "28.02.2026", "2026-02-28T00:00:00", " 2026-02-28"]),
    "timestamp_ntz": ({"2026-02-28T10:20:30": dt.datetime(2026, 2, 28, 10, 20, 30), "2026-02-28T10:20": dt.datetime(2026, 2, 28, 10, 20), "2026-02-28T10:20:30.123456789": dt.datetime(2026, 2, 28, 10, 20, 30, 123456)}, ["", "2026-02-28", "2026-02-28 10:20:30", "2026-02-28T10:20:30Z", "2026-02-28T25:00:00"]),
}


@pytest.mark.parametrize("kind", VALUES)
def test_coercion(spark, kind):
    good, bad = VALUES[kind]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
    got = {r.x: r.v for r in df.select("x", coerce(F.col("x"), scalar(kind)).alias("v")).collect()}
    assert got == good | dict.fromkeys(bad)


@pytest.mark.parametrize(
    ("kind", "fmt", "good", "bad"),
    [
        ("date", "dd.MM.yyyy", {"28.02.2026": "2026-02-28"}, ["2026-02-28", "30.02.2026", ""]),
        ("timestamp_ntz", "dd/MM/yyyy HH:mm", {"28/02/2026 10:20": "2026-02-28 10:20:00"}, ["28/02/2026", "x"]),
        ("timestamp", "", {"2026-02-28T10:20:30Z": "2026-02-28 10:20:30", "2026-02-28T10:20:30+02:00": "2026-02-28 08:20:30"}, ["2026-02-28T10:20:30", "2026-02-28"]),
        ("timestamp", "yyyy-MM-dd HH:mm XXX", {"2026-02-28 10:20 +01:00": "2026-02-28 09:20:00"}, ["2026-02-28 10:20"]),
        ("timestamp", "yyyy-MM-dd HH:mm", {}, ["2026-02-28 10:20"]),
        ("decimal(18,2)", "#,##0.00", {"1,234.50": "1234.50", "1234.5": "1234.50", "-7": "-7.00"}, ["1.234,50", "1,234.50x", "x1"]),
        ("decimal(18,2)", "'EUR' 0.00", {"EUR 5.25": "5.25"}, ["5.25", "EUR 1,000"]),
        ("decimal(18,4)", "0.##%", {"12.5%": "0.1250"}, ["12.5"]),
    ],
)
def test_patterns(spark, kind, fmt, good, bad):
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
    got = {r.x: r.v for r in df.select("x", coerce(F.col("x"), scalar(kind), fmt or None).cast("string").alias("v")).collect()}
    assert got == good | dict.fromkeys(bad)


def test_local_patterns_do_not_depend_on_the_time_zone(spark):
    df = spark.createDataFrame([("2026-03-29 02:30",)], "x string")  # a time that Berlin's clocks leave out
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(coerce(F.col("x"), scalar("timestamp_ntz"), "yyyy-MM-dd HH:mm").cast("string")).first()[0] == "2026-03-29 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


BOOK = Record({
    "id": Attr("int"), "title": Child(), "price": Child("struct<currency:string,amount:double>", converter=lambda x: F.when(x.rlike("^[A-Z]{3} [0-9.]+$"), F.struct(F.substring(x, 1, 3).alias("currency"), F.substring(x, 5, 99).cast("double").alias("amount")))),
    "ratings": Child("int", "r", many=True), "day": Child("date", required=False), "m": MapOf("e", Part("@k", "int"), Part("v", "int")), "f": Child(Poly({"p": Record({"n": Attr("int")}), "q": Record({"x": Child("double")})}), required=False), "t": Text(),
}, "//book")


def test_types(spark):
    xml = "<b><book id='1'> own <title> T </title><price>EUR 5.5</price><r>1</r><r>2</r><e k='01'><v>5</v></e><e k='2'><v>6</v></e><e k='1'><v>7</v></e><q><x>1.5</x></q></book></b>"
    out = extract(docs(spark, xml), BOOK, keep=["id"][:0])
    assert out.schema.simpleString() == BOOK.schema.simpleString()
    assert rows(out) == [
        {"id": 1, "title": "T", "price": {"currency": "EUR", "amount": 5.5}, "ratings": [1, 2], "day": None, "m": [{"key": 1, "value": 7}, {"key": 2, "value": 6}], "f": {"_type": "q", "p": None, "q": {"x": 1.5}}, "t": "own"}
    ]


def test_errors_say_where(spark):
    xml = "<b>\n<book id='x'>\n<title>T</title>\n<price>EURO</price>\n<r>1</r><r>z</r>\n<day>soon</day>\n<e><v>1</v></e>\n<p n='q'/></book></b>"
    (r,) = rows(extract(docs(spark, xml), BOOK, mode="PERMISSIVE"))
    found = [(e["kind"], e["field"], e["raw"], e["type"], e["line"], e["path"]) for e in r["_errors"]]
    assert found == [
        ("Coercion", "id", "x", "Int", 2, "/b/book"), ("Coercion", "price", "EURO", "struct<currency:string,amount:double>", 4, "/b/book/price"), ("Coercion", "ratings", "z", "Int", 2, "/b/book"),
        ("Coercion", "day", "soon", "LocalDate", 6, "/b/book/day"), ("Missing", "m.key", None, None, 7, "/b/book/e"), ("Coercion", "n", "q", "Int", 8, "/b/book/p"),
    ]
    assert r["_errors"][0]["message"] == "Cannot coerce 'x' to Int for 'id' at /b/book (line 2, col 1)"
    assert r["_errors"][4]["message"].startswith("Missing required field 'm.key' at /b/book/e (line 7, col ")
    with pytest.raises(Exception, match="Cannot coerce 'x' to Int for 'id'"):
        extract(docs(spark, xml), BOOK).select("title").collect()  # also where the bad column is not asked for
    assert extract(docs(spark, xml), BOOK, mode="DROPMALFORMED").count() == 0


def test_missing(spark):
    spec = Record({"a": Attr(), "b": Child(), "c": Child(Record({"d": Child()}), many=True)}, "r")
    (r,) = rows(extract(docs(spark, "<r><c/><c><d/></c></r>"), spec, mode="PERMISSIVE"))
    assert [(e["field"], e["path"]) for e in r["_errors"]] == [("a", "/r"), ("b", "/r"), ("d", "/r/c")]
    assert r["c"] == [{"d": None}, {"d": ""}]


def test_documents_that_are_null_empty_or_broken(spark):
    spec = Record({"k": Attr("int"), "t": Text()}, "//r")
    df = docs(spark, None, "", "<d><r k='1'/><r k='2'>", "<d/>", "<d><r k='3'/></d>")
    got = [(r["id"], r["pos"], r["k"], [e["kind"] for e in r["_errors"]]) for r in rows(extract(df, spec, keep=["id"], mode="PERMISSIVE", position="pos"))]
    assert sorted(got) == [(1, 1, None, ["Malformed"]), (2, 1, 1, []), (2, 2, None, ["Malformed"]), (4, 1, 3, [])]
    assert sorted(r["k"] for r in rows(extract(df, spec, mode="DROPMALFORMED"))) == [1, 3]
    with pytest.raises(Exception, match="no element found|unclosed"):
        extract(df, spec).collect()
    assert extract(df.limit(0), spec).collect() == []


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "<r k='1'/>", [1.5])], "`a.b` int, content string, row array<double>")
    spec = Record({"k": Attr("int")}, "r")
    assert rows(extract(df, spec, keep=["a.b", "row", "content"])) == [{"a.b": 1, "row": [1.5], "content": "<r k='1'/>", "k": 1}]
    with pytest.raises(ValueError, match="names of fields"):
        extract(df.withColumn("k", F.lit(1)), spec, keep=["k"])
    with pytest.raises(ValueError, match="mode"):
        extract(df, spec, mode="IGNORE")


def test_maps_by_key(spark):
    df = spark.createDataFrame([([("b", [1]), (None, [2]), ("a", [3]), ("b", [4, 5]), (None, [])],), ([],), (None,)], "e array<struct<key:string,value:array<int>>>")
    last, added = zip(*[(r.l, r.a) for r in df.select(by_key(F.col("e"), False).alias("l"), by_key(F.col("e"), True).alias("a")).collect()], strict=True)
    assert [[tuple(x) for x in e] for e in last[:2]] == [[("b", [4, 5]), (None, []), ("a", [3])], []]
    assert [[tuple(x) for x in e] for e in added[:2]] == [[("b", [1, 4, 5]), (None, [2]), ("a", [3])], []]
    assert not last[2] and not added[2]


def test_null_keys_fail_a_spark_map(spark):
    spec = Record({"m": MapOf("e", Part("@k", required=False), "v", as_map=True)}, "r")
    assert rows(extract(docs(spark, "<r><e k='a'><v>1</v></e></r>"), spec)) == [{"m": {"a": "1"}}]
    with pytest.raises(Exception, match="NULL_MAP_KEY"):
        extract(docs(spark, "<r><e><v>1</v></e></r>"), spec).collect()


def test_no_shuffle_and_only_what_is_asked_for(spark):
    spec = Record({"k": Attr("int"), "b": Child()}, "//r")
    plan = extract(docs(spark, "<r k='1'><b/></r>"), spec, keep=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_files(spark, tmp_path):
    spec = Record({"k": Attr("int"), "b": Child()}, "//r")
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.xml").write_bytes(f"<?xml version='1.0' encoding='latin-1'?><d>{''.join(f'<r k="{i * 10 + j}"><b>ä</b></r>' for j in range(3))}</d>".encode("latin-1"))
    want = [(i * 10 + j, "ä") for i in range(3) for j in range(3)]
    key = lambda df: sorted((r.k, r.b) for r in df.collect())
    assert key(read_files(spark, str(tmp_path / "in"), spec)) == want
    assert key(read_large(spark, str(tmp_path / "in"), spec)) == want
    assert key(read_large(spark, f"file://{tmp_path}/in", spec, position="n").filter("n > 0")) == want
    stream = stream_files(spark, str(tmp_path / "in"), spec, max_files=1)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want


def test_large_file_breaks_off_with_its_error(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<d>" + "<r k='1'/>" * 5000 + "<r")
    out = read_large(spark, str(tmp_path / "x.xml"), Record({"k": Attr("int")}, "//r"), mode="PERMISSIVE")
    assert out.filter("size(_errors) = 0").count() == 5000 and out.filter("size(_errors) > 0").count() == 1


def test_nodes_and_records_agree(spark):
    xml = "<r><g><i k='p'>1</i><i k='q'>2</i><i k='p'>3</i></g><g><h><i k='p'>4</i></h><i k='p'>5</i><i>6</i></g></r>"
    assert nodes(docs(spark, xml), text=False).filter("text IS NOT NULL").count() == 0
    table = nodes(docs(spark, xml, "<r/>", None), keep=["id"])
    assert table.filter("id = 0").count() == 10 and table.filter("last < pre OR level < 0").count() == 0
    for path in ("//i", "g/i", "/r/g/i[2]", "//i[@k='p'][2]", "//i[2][@k='p']", "//g//i[1]", "/r//i[@k!='p']", "//i[1 and @k='p' or @k='q']", "/r/*/i"):
        want = sorted(r.t for r in extract(docs(spark, xml), Record({"t": Text()}, path)).collect())
        assert sorted(r.own_text for r in find(table, path, "id").collect()) == want, path


def test_records_deeper_than_there_is_room_for(spark):
    part = Record({"id": Attr("int"), "parts": Child(Self(2), "part", many=True), "twin": Child(Self(2), "twin", required=False)}, "/part")
    assert part.schema["parts"].dataType.elementType.names == ["id", "parts", "twin"] and part.schema["parts"].dataType.elementType["parts"].dataType.elementType.names == ["id"]
    deep = "<part id='1'>\n<part id='2'>\n<part id='3'/>{}</part></part>"
    four = deep.format("").replace("<part id='3'/>", "<part id='3'>\n<part id='4'/><part id='5'/></part>")
    (a,), (b,), (c,) = (rows(extract(docs(spark, x), part, mode="PERMISSIVE")) for x in (deep.format(""), four, deep.format("<twin id='9'><twin id='10'/></twin>")))
    assert a["_errors"] == [] and a["parts"][0]["parts"] == [{"id": 3}]
    (e,) = b["_errors"]
    assert (e["kind"], e["field"], e["line"], e["path"]) == ("Depth", "parts", 4, "/part/part/part/part") and "Self(2)" in e["message"]
    assert [e["field"] for e in c["_errors"]] == ["twin"]
    with pytest.raises(Exception, match="goes on below the 2 levels"):
        extract(docs(spark, four), part).collect()
    assert extract(docs(spark, four, deep.format("")), part, mode="DROPMALFORMED").count() == 1


def test_converters_are_of_their_fields_type(spark):
    def problems(kind, converter):
        with pytest.raises(SpecError) as e:
            extract(docs(spark, "<r><a>x</a></r>"), Record({"c": Child(Record({"a": Child(kind, converter=converter)}), "r2", required=False), "b": Child(kind, "a", converter=converter)}, "r"))
        return e.value.problems

    said = problems("int", lambda x: F.upper(x))
    assert len(said) == 2 and all("gives string, but the field says int" in p for p in said)
    assert "can't be used on a text" in problems("int", lambda x: F.explode(F.array_contains(x, 1)))[0]
    good = Record({"a": Child("int", converter=lambda x: F.length(x)), "u": Child(Poly({"k": Record({"n": Attr("double", converter=lambda x: x.try_cast("double") / 2)})}), required=False)}, "r")
    assert rows(extract(docs(spark, "<r><a>four</a><k n='3'/></r>"), good)) == [{"a": 4, "u": {"_type": "k", "k": {"n": 1.5}}}]
    (r,) = rows(extract(docs(spark, "<r><a>four</a><k n='x'/></r>"), good, mode="PERMISSIVE"))
    assert [e["kind"] for e in r["_errors"]] == ["Coercion"]


def test_lists_of_keys_and_values(spark):
    spec = Record({"m": MapOf("e", Part("k", many=True), Part("v", "int", many=True))}, "r")
    xml = "<r><e><k>a</k><k>b</k><v>1</v></e><e><k>b</k><v>2</v></e><e><k>a</k><k>b</k><v>3</v><v>4</v></e><e/></r>"
    assert rows(extract(docs(spark, xml), spec)) == [{"m": [{"key": ["a", "b"], "value": [1, 3, 4]}, {"key": ["b"], "value": [2]}, {"key": [], "value": []}]}]


def test_lists_with_wrong_values(spark):
    (r,) = rows(extract(docs(spark, "<r><v>1</v><v>x</v><v>3</v><v>y</v></r>"), Record({"v": Child("int", many=True)}, "r"), mode="PERMISSIVE"))
    assert r["v"] == [1, None, 3, None] and [e["raw"] for e in r["_errors"]] == ["x", "y"]


def test_a_reader_serves_many_documents(spark):
    """Nothing of one document is seen in the next, of the same task or after a broken one."""
    spec = Record({"k": Attr("int"), "v": Child("int", many=True), "w": Child(required=False)}, "//r")
    texts = ["<d><r k='1'><v>1</v><w>a</w></r></d>", "<d><r k='2'>", "<d><r k='3'/><r k='4'><v>4</v></r></d>"] * 3
    got = [(r["k"], r["v"], r["w"]) for r in rows(extract(docs(spark, *texts).coalesce(1), spec, mode="DROPMALFORMED"))]
    assert got == [(1, [1], "a"), (3, [], None), (4, [4], None)] * 3


TYPES = Record({
    "i": Attr("int"), "l": Child("long", many=True), "d": Child("double", required=False), "b": Child("boolean"), "day": Child("date"), "t": Child("timestamp_ntz"), "z": Child("timestamp"), "x": Child("decimal(10,2)"), "own": Text(),
    "m": MapOf("e", Part("@k", "int"), Part("v", many=True)), "mm": MapOf("f", "@k", "v", as_map=True, required=False), "u": Child(Poly({"p": Record({"n": Attr("int")}), "q": Record({"s": Child()})}), required=False),
    "n": Child(Record({"a": Attr(), "again": Child(Self(2), "n", required=False)}), "n", many=True),
}, "//r")
TYPED = (
    "<d><r i='+7'><l>1</l><l>-2</l><d> 1e3f </d><b>Yes</b><day>2026-02-28</day><t>2026-02-28T10:20</t><z>2026-02-28T10:20:30+02:00</z><x>1.005</x> own <e k='1'><v>a</v></e><e k='01'><v>b</v></e>"
    "<f k='y'><v>1</v></f><q><s>S</s></q><n a='1'><n a='2'><n a='3'/></n></n></r></d>"
)


def test_table_function(spark):
    """The same rows as extract(), from SQL, and its messages."""
    register(spark, "typed_rows", TYPES)
    docs(spark, TYPED, None, "<d/>").createOrReplaceTempView("typed_docs")
    got = spark.sql("SELECT d.id AS doc, r.* FROM typed_docs d, LATERAL typed_rows(d.content) r")
    want = extract(docs(spark, TYPED, None, "<d/>"), TYPES, keep=["id"])
    assert [r[1:] for r in got.collect()] == [r[1:] for r in want.collect()] and got.count() == 1
    assert spark.sql(f"SELECT i FROM typed_rows(X'{TYPED.encode().hex()}')").first().i == 7  # binary documents
    for bad, said in ((TYPED.replace("+7", "7.5"), "Cannot coerce '7.5' to Int for 'i' at /d/r"), (TYPED.replace("<b>Yes</b>", ""), "Missing required field 'b' at /d/r"), (TYPED.replace("a='3'/", "a='3'><n a='4'/></n"), "goes on below"), (TYPED[:-4], "no element found|unclosed")):
        docs(spark, bad).createOrReplaceTempView("typed_docs")
        with pytest.raises(Exception, match=said):
            spark.sql("SELECT r.* FROM typed_docs d, LATERAL typed_rows(d.content) r").collect()
    with pytest.raises(SpecError, match="table function"):
        register(spark, "f", Record({"a": Child("date", fmt="dd.MM.yyyy")}, "r"))


@pytest.mark.parametrize("kind", VALUES)
def test_table_functions_read_texts_alike(kind):
    good, bad = VALUES[kind]
    read = scalar_reader(scalar(kind))
    assert {x: read(x) for x in [*good, *bad]} == good | dict.fromkeys(bad)
