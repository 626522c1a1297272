"""Queries over documents rendered from the driver's tables, and SQL over the tables themselves that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.extract import extract
from .operators.nodes import find, nodes
from .operators.udtf import register
from .plans.spec import Attr, Child, MapOf, Part, Poly, Record, Self, Text
from .render import joined, order_docs, read, scratch, xml
from .sources.files import read_files, read_large
from .streaming.files import stream_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The lines of an order by number, as the renderer has them.
LINES = """l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS ord FROM lineitem)"""

LINE = '<line n="{ord}" flag="{l_returnflag}" st="{l_linestatus}"><qty>{l_quantity}</qty><price cur="USD">{l_extendedprice}</price></line>'
ORDER = '<root><order key="{o_orderkey}" status="{o_orderstatus}"><total>{o_totalprice}</total>{body}</order></root>'
ATOM, SHOP = "http://www.w3.org/2005/Atom", "urn:shop"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {LINES} {sql}" if " l " in f"{sql} " and "lineitem" not in sql else sql
        return f

    return add


# --- record paths ------------------------------------------------------------------------------------------------------

_ORDERS = "SELECT o_orderkey AS k, o_totalprice AS total FROM orders"
_HEAD = {"k": Attr("long", "key"), "total": Child("double")}


def _orders(spark: SparkSession, sf_dir: str, path: str, doc: str, **how) -> DataFrame:
    return extract(order_docs(spark, sf_dir, doc), Record(_HEAD, path, **how))


_PLAIN = '<order key="{o_orderkey}" status="{o_orderstatus}"><total>{o_totalprice}</total></order>'
_DECOY = '<order key="0"><total>0</total></order>'


@query(_ORDERS)
def rec_descendant(spark, sf_dir):
    return _orders(spark, sf_dir, "//order", f"<root><a><b>{_PLAIN}</b></a></root>")


@query(_ORDERS)
def rec_absolute(spark, sf_dir):
    return _orders(spark, sf_dir, "/root/box/order", f"<root>{_DECOY}<box>{_PLAIN}<x>{_DECOY}</x></box></root>")


@query(_ORDERS)
def rec_relative(spark, sf_dir):
    return _orders(spark, sf_dir, "box/order", f"<root>{_DECOY}<a><box>{_PLAIN}</box></a></root>")


@query(_ORDERS)
def rec_midpath(spark, sf_dir):
    return _orders(spark, sf_dir, "/root/box//order", f"<root>{_DECOY}<box><a><b>{_PLAIN}</b></a></box></root>")


@query(_ORDERS)
def rec_any_element(spark, sf_dir):
    return _orders(spark, sf_dir, "/root/*/order", f"<root>{_DECOY}<anything>{_PLAIN}</anything></root>")


@query(f"{_ORDERS} WHERE o_orderstatus = 'F'")
def pred_eq(spark, sf_dir):
    return _orders(spark, sf_dir, "//order[@status='F']", f"<root>{_PLAIN}</root>")


@query(f"{_ORDERS} WHERE o_orderstatus <> 'F'")
def pred_ne(spark, sf_dir):
    return _orders(spark, sf_dir, "//order[@status!='F']", f"<root>{_PLAIN}</root>")


@query(f"{_ORDERS} WHERE o_orderstatus <> 'F'")
def pred_ne_missing(spark, sf_dir):
    """An absent attribute is not equal to any value."""
    mark = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit(' status="'), "o_orderstatus", F.lit('"')))
    docs = order_docs(spark, sf_dir, '<root><order key="{o_orderkey}"{mark}><total>{o_totalprice}</total></order></root>', {"mark": mark})
    return extract(docs, Record(_HEAD, "//order[@status!='F']"))


def _lines(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    line = Record({"n": Attr("int"), "flag": Attr(), "qty": Child("double")}, path)
    return extract(order_docs(spark, sf_dir, ORDER, body=LINE), line, keep=["doc_id"])


_LINE = "SELECT l_orderkey AS doc_id, ord AS n, l_returnflag AS flag, l_quantity AS qty FROM"


@query(f"{_LINE} l WHERE l_returnflag = 'R' AND l_linestatus = 'F' OR l_returnflag = 'N'")
def pred_and_or(spark, sf_dir):
    return _lines(spark, sf_dir, "//line[@flag='R' and @st='F' or @flag='N']")


@query(f"{_LINE} l WHERE ord = 2")
def pos_n(spark, sf_dir):
    return _lines(spark, sf_dir, "//line[2]")


@query(f"{_LINE} (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS r FROM l WHERE l_returnflag = 'R') WHERE r = 2")
def pos_chain(spark, sf_dir):
    return _lines(spark, sf_dir, "//line[@flag='R'][2]")


@query(f"{_LINE} l WHERE ord = 2 AND l_returnflag = 'R'")
def pos_then_attr(spark, sf_dir):
    return _lines(spark, sf_dir, "//order/line[2][@flag='R']")


@query(f"{_LINE} l WHERE ord = 2 AND l_returnflag = 'R'")
def pos_and(spark, sf_dir):
    return _lines(spark, sf_dir, "//line[2 and @flag='R']")


@query(f"{_LINE} l WHERE ord = 1 OR l_returnflag = 'A'")
def pos_or(spark, sf_dir):
    return _lines(spark, sf_dir, "//line[1 or @flag='A']")


# --- child paths -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS pri FROM orders")
def child_multi(spark, sf_dir):
    """Several segments, and an attribute at the end of a path."""
    doc = '<root><order key="{o_orderkey}"><head pri="{o_orderpriority:e}"><dates><ordered> {o_day} </ordered></dates></head></order></root>'
    spec = Record({"k": Attr("long", "key"), "day": Child(path="head/dates/ordered"), "pri": Child(path="head/@pri")}, "//order")
    return extract(order_docs(spark, sf_dir, doc), spec)


@query("SELECT l_orderkey AS doc_id, ord AS n FROM l")
def attr_leaf_list(spark, sf_dir):
    docs = order_docs(spark, sf_dir, ORDER, body=LINE)
    return extract(docs, Record({"n": Child("int", "line/@n", many=True)}, "//order"), keep=["doc_id"]).select("doc_id", F.explode("n").alias("n"))


@query("SELECT o_orderkey AS doc_id, arg_max(l_quantity, ord) AS last_qty, count(l_orderkey) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def two_fields_one_path(spark, sf_dir):
    """One path for a single value and for a list."""
    docs = order_docs(spark, sf_dir, ORDER, body=LINE)
    out = extract(docs, Record({"last_qty": Child("double", "line/qty", required=False), "all": Child("double", "line/qty", many=True)}, "//order"), keep=["doc_id"])
    return out.select("doc_id", "last_qty", F.size("all").cast("long").alias("n"))


@query(_ORDERS)
def unread_children(spark, sf_dir):
    """Children that no field reads are passed over, whatever is in them: records and fields of the same names too."""
    doc = f'<root><order key="{{o_orderkey}}"><skip><total>-1</total>{_DECOY}<deep><deep><total>x</total></deep></deep></skip><total>{{o_totalprice}}</total><skip/></order></root>'
    return _orders(spark, sf_dir, "//order", doc)


@query("SELECT l_orderkey AS doc_id, sum(l_quantity) AS qty, count(*) AS n FROM l GROUP BY l_orderkey")
def desc_child(spark, sf_dir):
    docs = order_docs(spark, sf_dir, ORDER.replace("{body}", "<a><b>{body}</b></a>"), body=LINE)
    out = extract(docs, Record({"q": Child("double", "//qty", many=True)}, "//order"), keep=["doc_id"])
    return out.select("doc_id", F.explode("q").alias("q")).groupBy("doc_id").agg(F.sum("q").alias("qty"), F.count("q").alias("n"))


@query("SELECT l_orderkey AS doc_id, ord AS i, l_extendedprice AS price, 'USD' AS cur FROM l")
def desc_tail(spark, sf_dir):
    docs = order_docs(spark, sf_dir, ORDER.replace("{body}", "<a>{body}</a>"), body=LINE)
    spec = Record({"price": Child("double", "//line/price", many=True), "cur": Child(path="//line/price/@cur", many=True), "n": Child("int", "//line/@n", many=True)}, "//order")
    out = extract(docs, spec, keep=["doc_id"])
    return out.select("doc_id", F.explode(F.arrays_zip("n", "price", "cur")).alias("z")).select("doc_id", F.col("z.n").alias("i"), "z.price", "z.cur")


@query("SELECT l_orderkey AS doc_id, ord AS n FROM l WHERE l_returnflag <> 'R'")
def desc_unclaimed_only(spark, sf_dir):
    """Descendants are not looked for inside children that another field claims."""
    doc = '<root><order key="{o_orderkey}"><sum count="1">{inside}</sum><x>{outside}</x></order></root>'
    docs = order_docs(spark, sf_dir, doc, inside=(LINE, F.col("l_returnflag") == "R"), outside=(LINE, F.col("l_returnflag") != "R"))
    spec = Record({"count": Child("int", "sum/@count"), "n": Child("int", "//line/@n", many=True)}, "//order")
    return extract(docs, spec, keep=["doc_id"]).select("doc_id", F.explode("n").alias("n"))


@query("SELECT o_orderkey AS doc_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines, o_totalprice AS price FROM orders")
def desc_two_heads(spark, sf_dir):
    """What one head finds hides the other head's elements inside it."""
    docs = order_docs(spark, sf_dir, "<root><order><x>{body}<price>{o_totalprice}</price></x></order></root>", body=LINE)
    spec = Record({"n": Child("int", "//line/@n", many=True), "price": Child("double", "//price", many=True)}, "//order")
    return extract(docs, spec, keep=["doc_id"]).select("doc_id", F.size("n").cast("long").alias("n_lines"), F.explode("price").alias("price"))


@query("""SELECT o_orderkey AS doc_id, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS qty_r, coalesce(sum(l_extendedprice) FILTER (l_returnflag <> 'R' AND ord = 1), 0) AS first_other
  FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def overlap_body_first_match(spark, sf_dir):
    """Of fields that read the inside of one child, the first whose tests hold has it."""
    docs = order_docs(spark, sf_dir, ORDER, body=LINE)
    spec = Record({"q": Child("double", "line[@flag='R']/qty", many=True), "p": Child("double", "line[1]/price", many=True)}, "//order")
    out = extract(docs, spec, keep=["doc_id"])
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", add("q").alias("qty_r"), add("p").alias("first_other"))


@query("SELECT o_orderkey AS doc_id, count(l_orderkey) FILTER (l_returnflag = 'R') AS n_r, count(l_orderkey) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def overlap_attr_all(spark, sf_dir):
    """Attributes are read by every field whose tests hold."""
    docs = order_docs(spark, sf_dir, ORDER, body=LINE)
    spec = Record({"r": Child("int", "line[@flag='R']/@n", many=True), "a": Child("int", "line/@n", many=True)}, "//order")
    return extract(docs, spec, keep=["doc_id"]).select("doc_id", F.size("r").cast("long").alias("n_r"), F.size("a").cast("long").alias("n"))


@query("SELECT o_orderkey AS doc_id, arg_max(l_quantity, ord) AS qty, max(ord) FILTER (l_discount > 0.05) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def last_wins(spark, sf_dir):
    """A single field has the last match; at the end of an attribute path, the last that has the attribute."""
    mark = F.when(F.col("l_discount") > 0.05, F.concat(F.lit(' d="'), F.col("ord").cast("string"), F.lit('"')))
    docs = order_docs(spark, sf_dir, "<root><order>{body}</order></root>", {"mark": mark}, body="<line{mark}><qty>{l_quantity}</qty></line>")
    return extract(docs, Record({"qty": Child("double", "line/qty", required=False), "n": Child("int", "line/@d", required=False)}, "//order"), keep=["doc_id"])


@query("""SELECT o_orderkey AS doc_id, o_orderstatus || '-' || o_orderkey AS own, o_orderstatus || o_orderkey AS joined, '  ' || o_orderpriority || ' ' AS kept, o_orderpriority AS trimmed,
  '' AS empty, CAST(NULL AS VARCHAR) AS missing FROM orders""")
def texts(spark, sf_dir):
    """Own text, text with that of elements inside, white space kept and not, CDATA, empty and missing elements."""
    doc = "<root><order>{o_orderstatus}<a>x</a>-<![CDATA[{o_orderkey}]]><w>{o_orderstatus}<i>{o_orderkey}</i></w><p>  {o_orderpriority:e} </p><t>  {o_orderpriority:e} </t><e/></order></root>"
    spec = Record({"own": Text(), "joined": Child(path="w"), "kept": Child(path="p", preserve_whitespace=True), "trimmed": Child(path="t"), "empty": Child(path="e"), "missing": Child(path="m", required=False)}, "//order")
    return extract(order_docs(spark, sf_dir, doc), spec, keep=["doc_id"])


@query("SELECT l_orderkey AS doc_id, l_quantity AS qty2, l_extendedprice AS price FROM l WHERE ord = 2")
def child_position(spark, sf_dir):
    """Positions on segments of child paths."""
    docs = order_docs(spark, sf_dir, ORDER, body=LINE)
    out = extract(docs, Record({"qty2": Child("double", "line[2]/qty[1]", required=False)}, "//order"), keep=["doc_id"])
    second = extract(docs, Record({"price": Child("double", "price")}, "//order/line[2]"), keep=["doc_id"])
    return out.filter("qty2 IS NOT NULL").select("doc_id", "qty2").join(second, "doc_id")


# --- records inside, maps, unions --------------------------------------------------------------------------------------


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r_regionkey, content): regions with their nations; two small tables of fixed size."""
    n = read(spark, sf_dir, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("i"), xml('<nation id="{n_nationkey}"><name>{n_name:e}</name></nation>').alias("x")).alias("e"))
    r = read(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(joined(F.collect_list("e")).alias("body"))
    return r.select("r_regionkey", xml('<world><region id="{r_regionkey}"><name>{r_name:e}</name><nations>{body}</nations></region></world>').alias("content"))


_NATION = Record({"id": Attr("int"), "name": Child()})
_REGION = Record({"id": Attr("int"), "name": Child(), "nations": Child(_NATION, "nations/nation", many=True)}, "//region")
_NATIONS = "SELECT r_regionkey AS region, r_name AS region_name, n_nationkey AS nation, n_name AS nation_name FROM region JOIN nation ON n_regionkey = r_regionkey"


def _flat(regions: DataFrame) -> DataFrame:
    out = regions.select(F.col("id").alias("region"), F.col("name").alias("region_name"), F.explode("nations").alias("n"))
    return out.select("region", "region_name", F.col("n.id").alias("nation"), F.col("n.name").alias("nation_name"))


@query(_NATIONS)
def nested_list(spark, sf_dir):
    return _flat(extract(_geography(spark, sf_dir), _REGION))


@query("SELECT o_orderkey AS k, c_custkey AS cust, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def nested_single(spark, sf_dir):
    """A record inside a record inside a record; one of them is not there."""
    both = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    docs = both.select(xml('<order key="{o_orderkey}"><customer id="{c_custkey}"><name>{c_name:e}</name><account><bal>{c_acctbal}</bal><segment>{c_mktsegment:e}</segment></account></customer></order>').alias("content"))
    account = Record({"bal": Child("double"), "segment": Child()})
    customer = Record({"id": Attr("long"), "name": Child(), "account": Child(account), "agent": Child(account, required=False)})
    out = extract(docs, Record({"k": Attr("long", "key"), "c": Child(customer, "customer")}, "order"))
    return out.filter("c.agent IS NULL").select("k", F.col("c.id").alias("cust"), F.col("c.name").alias("name"), F.col("c.account.bal").alias("bal"), F.col("c.account.segment").alias("segment"))


_ENTRY = '<price k="{l_returnflag}"><f>{l_returnflag}</f><s>{l_linestatus}</s><v>{l_quantity}</v><n>{ord}</n></price>'


def _map(spark: SparkSession, sf_dir: str, field: MapOf) -> DataFrame:
    docs = order_docs(spark, sf_dir, "<root><order>{body}</order></root>", body=_ENTRY)
    return extract(docs, Record({"m": field}, "//order"), keep=["doc_id"])


@query("SELECT l_orderkey AS doc_id, l_returnflag AS k, arg_max(l_quantity, ord) AS v FROM l GROUP BY ALL")
def map_scalar(spark, sf_dir):
    return _map(spark, sf_dir, MapOf("price", "@k", Part("v", "double"))).select("doc_id", F.explode("m").alias("e")).select("doc_id", "e.key", "e.value").toDF("doc_id", "k", "v")


@query("SELECT l_orderkey AS doc_id, l_returnflag AS k, arg_max(l_quantity, ord) AS v FROM l GROUP BY ALL")
def map_as_map(spark, sf_dir):
    return _map(spark, sf_dir, MapOf("price", "f", Part("v", "double"), as_map=True)).select("doc_id", F.explode("m").alias("k", "v"))


@query("SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY min(ord)) AS INTEGER) - 1 AS place, l_returnflag AS k, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS v FROM l GROUP BY l_orderkey, l_returnflag")
def map_multi(spark, sf_dir):
    """Lists grow from entry to entry; keys stand in the order of their first entries."""
    out = _map(spark, sf_dir, MapOf("price", "f", Part("n", many=True))).select("doc_id", F.posexplode("m").alias("place", "e"))
    return out.select("doc_id", "place", F.col("e.key").alias("k"), F.array_join("e.value", ",").alias("v"))


@query("SELECT l_orderkey AS doc_id, l_returnflag || '+' || ord AS k, l_quantity AS v FROM l")
def map_listkey(spark, sf_dir):
    docs = order_docs(spark, sf_dir, "<root><order>{body}{body}</order></root>", body="<price><x><k>{l_returnflag}</k><k>{ord}</k></x><v>{l_quantity}</v></price>")
    out = extract(docs, Record({"m": MapOf("price", Part("x/k", many=True), Part("//v", "double"))}, "//order"), keep=["doc_id"])
    return out.select("doc_id", F.explode("m").alias("e")).select("doc_id", F.array_join("e.key", "+").alias("k"), F.col("e.value").alias("v"))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS flag, l_linestatus AS st, sum(l_quantity) AS v FROM l GROUP BY ALL")
def map_structkey(spark, sf_dir):
    """Records as keys, lists of records as values, from the entry itself."""
    key = Record({"f": Child(), "s": Child()})
    value = Record({"v": Child("double")})
    out = _map(spark, sf_dir, MapOf("price", Part(".", key), Part(".", value, many=True))).select("doc_id", F.explode("m").alias("e"))
    return out.select("doc_id", F.col("e.key.f").alias("flag"), F.col("e.key.s").alias("st"), F.aggregate("e.value", F.lit(0.0), lambda a, x: a + x["v"]).alias("v"))


@query("SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS k, CASE WHEN arg_max(l_linestatus, ord) = 'F' THEN max(ord) END AS v FROM l GROUP BY 1, 2")
def map_nullkey(spark, sf_dir):
    """Keys and values that are not there are null where they may be."""
    values = {"k": F.when(F.col("l_returnflag") != "N", F.concat(F.lit(' k="'), "l_returnflag", F.lit('"'))), "v": F.when(F.col("l_linestatus") == "F", F.concat(F.lit("<v>"), F.col("ord").cast("string"), F.lit("</v>")))}
    docs = order_docs(spark, sf_dir, "<root><order>{body}</order></root>", values, body="<price{k}>{v}</price>")
    out = extract(docs, Record({"m": MapOf("price", Part("@k", required=False), Part("v", "int", required=False))}, "//order"), keep=["doc_id"])
    return out.select("doc_id", F.explode("m").alias("e")).select("doc_id", F.col("e.key").alias("k"), F.col("e.value").alias("v"))


@query("SELECT o_orderkey AS doc_id, count(l_orderkey) = 0 AS none FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def map_nullable(spark, sf_dir):
    return _map(spark, sf_dir, MapOf("price", "n", "v", required=False)).select("doc_id", F.col("m").isNull().alias("none"))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS k, arg_max(l_quantity, ord) AS v FROM l GROUP BY ALL")
def self_step(spark, sf_dir):
    """The path . is the entry itself: its text is the value."""
    docs = order_docs(spark, sf_dir, "<root><order>{body}</order></root>", body='<price k="{l_returnflag}"> {l_quantity}<!-- as text --></price>')
    out = extract(docs, Record({"m": MapOf("price", "@k", Part(".", "double"))}, "//order"), keep=["doc_id"])
    return out.select("doc_id", F.explode("m").alias("e")).select("doc_id", F.col("e.key").alias("k"), F.col("e.value").alias("v"))


@query("SELECT l_orderkey AS doc_id, l_returnflag || l_linestatus AS k, sum(l_quantity) AS total, count(*) AS n FROM l GROUP BY ALL")
def map_lists(spark, sf_dir):
    """Lists as keys and lists as values: entries with an equal list add to one value."""
    docs = order_docs(spark, sf_dir, "<root><order>{body}</order></root>", body="<price><k>{l_returnflag}</k><k>{l_linestatus}</k><v>{l_quantity}</v></price>")
    out = extract(docs, Record({"m": MapOf("price", Part("k", many=True), Part("v", "double", many=True))}, "//order"), keep=["doc_id"])
    e = out.select("doc_id", F.explode("m").alias("e"))
    return e.select("doc_id", F.array_join("e.key", "").alias("k"), F.aggregate("e.value", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("e.value").cast("long").alias("n"))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS k, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS v FROM l GROUP BY ALL")
def map_attr_list(spark, sf_dir):
    """Values from an attribute at the end of a path, all of them."""
    docs = order_docs(spark, sf_dir, "<root><order>{body}</order></root>", body='<price k="{l_returnflag}"><v n="{ord}"/></price>')
    out = extract(docs, Record({"m": MapOf("price", "@k", Part("v/@n", "int", many=True))}, "//order"), keep=["doc_id"])
    return out.select("doc_id", F.explode("m").alias("e")).select("doc_id", F.col("e.key").alias("k"), F.array_join(F.transform("e.value", lambda x: x.cast("string")), ",").alias("v"))


@query("SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'N' THEN 'm.key' ELSE 'm.value' END AS field, count(*) AS n FROM l WHERE l_returnflag = 'N' OR l_linestatus = 'F' GROUP BY ALL")
def map_missing(spark, sf_dir):
    """Entries without a key, or with a key but without a value, that have to be there."""
    values = {"k": F.when(F.col("l_returnflag") != "N", F.concat(F.lit(' k="'), "l_returnflag", F.lit('"'))), "v": F.when((F.col("l_returnflag") == "N") | (F.col("l_linestatus") != "F"), "<v>1</v>")}
    docs = order_docs(spark, sf_dir, "<root><order>{body}</order></root>", values, body="<price{k}>{v}</price>")
    out = extract(docs, Record({"m": MapOf("price", "@k", Part("v", "int"))}, "//order"), keep=["doc_id"], mode="PERMISSIVE")
    return out.select("doc_id", F.explode("_errors").alias("e")).filter("e.kind = 'Missing'").groupBy("doc_id", F.col("e.field").alias("field")).agg(F.count(F.lit(1)).alias("n"))


_EVENT = Record({"id": Attr("long"), "v": Attr("double")})
_EVENTS = "SELECT event_id AS id, event_type AS kind, CASE WHEN event_type = 'click' THEN user_id END AS u, value AS v FROM events WHERE event_type IN ('click', 'view')"


def _union(spark: SparkSession, sf_dir: str, doc: str, field: Child) -> DataFrame:
    docs = read(spark, sf_dir, "events").select(xml(doc).alias("content"))
    out = extract(docs, Record({"e": field}, "//log")).select(F.explode("e").alias("e") if field.many else "e").filter("e IS NOT NULL")
    return out.select(F.coalesce("e.click.id", "e.view.id").alias("id"), F.col("e._type").alias("kind"), F.col("e.click.u").alias("u"), F.coalesce("e.click.v", "e.view.v").alias("v"))


_KINDS = {"click": Record({"id": Attr("long"), "u": Attr("long"), "v": Attr("double")}), "view": _EVENT}


@query(_EVENTS)
def poly_tag(spark, sf_dir):
    """Kinds by the element's name; other elements are passed over."""
    return _union(spark, sf_dir, '<log><{event_type} id="{event_id}" u="{user_id}" v="{value}"/><other/></log>', Child(Poly(_KINDS), many=True))


@query(_EVENTS)
def poly_attr(spark, sf_dir):
    """Kinds by an attribute; values that are none are passed over."""
    return _union(spark, sf_dir, '<log><ev type="{event_type}" id="{event_id}" u="{user_id}" v="{value}"/><ev/></log>', Child(Poly(_KINDS, "@type"), "ev", many=True))


@query(_EVENTS)
def poly_single(spark, sf_dir):
    """One value: the last."""
    return _union(spark, sf_dir, '<log><click id="0" u="0" v="0"/><x/><view id="0" v="0"/><{event_type} id="{event_id}" u="{user_id}" v="{value}"/></log>', Child(Poly(_KINDS), required=False)).filter("id <> 0")


@query("SELECT o_orderkey AS k, 2 AS depth2, o_totalprice AS total FROM orders")
def self_recursive(spark, sf_dir):
    doc = '<part id="1"><part id="2"><part id="{o_orderkey}"><w>{o_totalprice}</w><part id="4"><w>1</w></part></part></part></part>'
    spec = Record({"id": Attr("long"), "w": Child("double", required=False), "parts": Child(Self(3), "part", many=True)}, "/part")
    out = extract(order_docs(spark, sf_dir, doc), spec).select(F.explode("parts").alias("a")).select("a.id", F.explode("a.parts").alias("b"))
    return out.select(F.col("b.id").alias("k"), F.col("id").cast("int").alias("depth2"), F.col("b.w").alias("total"))


# --- types -------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS k, o_custkey % 1000 AS i, o_totalprice AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus = 'F' AS done, strftime(o_orderdate, '%Y-%m-%d') AS day
  FROM orders""")
def coerce_numbers(spark, sf_dir):
    doc = '<o k="{o_orderkey}"><i> +{i} </i><d>{o_totalprice}</d><c>{o_totalprice}</c><b>{b}</b><day>{o_day}</day></o>'
    values = {"i": F.col("o_custkey") % 1000, "b": F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("0")}
    spec = Record({"k": Attr("long"), "i": Child("int"), "d": Child("double"), "c": Child("decimal"), "b": Child("boolean"), "day": Child("date")}, "o")
    out = extract(order_docs(spark, sf_dir, doc, values), spec)
    return out.select("k", F.col("i").cast("long").alias("i"), "d", F.round(F.col("c") * 100).cast("long").alias("cents"), F.col("b").alias("done"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id AS id, epoch_us(ts) AS local_us, epoch_us(ts) - 7200000000 AS instant_us, epoch_us(date_trunc('second', ts)) AS z_us, epoch_us(date_trunc('minute', ts)) AS pattern_us FROM events")
def coerce_times(spark, sf_dir):
    """Local times, and instants with an offset, with Z and by a pattern."""
    stamp = lambda f: F.date_format("ts", f)
    values = {"l": stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "z": stamp("yyyy-MM-dd'T'HH:mm:ss"), "p": stamp("dd/MM/yyyy HH:mm")}
    docs = read(spark, sf_dir, "events").select(xml('<e id="{event_id}"><l>{l}</l><i>{l}+02:00</i><z>{z}Z</z><p>{p}</p></e>', values).alias("content"))
    spec = Record({"id": Attr("long"), "l": Child("timestamp_ntz"), "i": Child("timestamp"), "z": Child("timestamp"), "p": Child("timestamp_ntz", fmt="dd/MM/yyyy HH:mm")}, "e")
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01T00:00:00").cast("timestamp_ntz"), F.col(c))
    return extract(docs, spec).select("id", us("l").alias("local_us"), F.unix_micros("i").alias("instant_us"), F.unix_micros("z").alias("z_us"), us("p").alias("pattern_us"))


@query("SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def coerce_patterns(spark, sf_dir):
    values = {"m": F.format_number("o_totalprice", 2), "d": F.date_format("o_orderdate", "dd.MM.yyyy")}
    spec = Record({"k": Attr("long"), "m": Child("decimal(18,2)", fmt="'$'#,##0.00"), "d": Child("date", fmt="dd.MM.yyyy")}, "o")
    out = extract(order_docs(spark, sf_dir, '<o k="{o_orderkey}"><m>${m}</m><d>{d}</d></o>', values), spec)
    return out.select("k", (F.col("m") * 100).cast("long").alias("cents"), F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey AS k, 'USD' AS currency, o_totalprice AS amount FROM orders")
def converter_money(spark, sf_dir):
    money = lambda x: F.when(x.rlike("^[A-Z]{3} "), F.struct(F.substring(x, 1, 3).alias("currency"), F.substring(x, 5, 99).try_cast("double").alias("amount")))
    spec = Record({"k": Attr("long"), "m": Child("struct<currency:string,amount:double>", converter=money)}, "o")
    return extract(order_docs(spark, sf_dir, '<o k="{o_orderkey}"><m>USD {o_totalprice}</m></o>'), spec).select("k", "m.currency", "m.amount")


# --- namespaces --------------------------------------------------------------------------------------------------------

_NS_DOC = f'<a:feed xmlns:a="{ATOM}" xmlns:s="{SHOP}"><entry key="0"><total>0</total></entry><a:entry key="{{o_orderkey}}" s:key="-1"><a:total>{{o_totalprice}}</a:total><s:total>5</s:total><total>6</total></a:entry></a:feed>'


def _ns(spark: SparkSession, sf_dir: str, path: str, total: str, ns: dict[str, str], doc: str = _NS_DOC, **how) -> DataFrame:
    return extract(order_docs(spark, sf_dir, doc), Record({"k": Attr("long", "key"), "total": Child("double", total)}, path, ns), **how)


@query(_ORDERS)
def ns_prefix(spark, sf_dir):
    return _ns(spark, sf_dir, "//x:entry", "x:total", {"x": ATOM})


@query(_ORDERS)
def ns_default(spark, sf_dir):
    return _ns(spark, sf_dir, "//entry", "total", {"": ATOM})


@query(_ORDERS)
def ns_clark(spark, sf_dir):
    return _ns(spark, sf_dir, f"//{{{ATOM}}}entry", f"{{{ATOM}}}total", {})


@query("SELECT o_orderkey AS k, o_totalprice AS total FROM orders UNION ALL SELECT 0, 0 FROM orders")
def ns_any(spark, sf_dir):
    """Any namespace in a record path; the total is that of no namespace."""
    doc = f'<feed xmlns:a="{ATOM}"><entry key="0"><total>0</total></entry><a:entry key="{{o_orderkey}}"><total>{{o_totalprice}}</total><a:total>1</a:total></a:entry></feed>'
    return _ns(spark, sf_dir, "//{*}entry", "total", {}, doc)


@query(_ORDERS)
def ns_ignore(spark, sf_dir):
    doc = f'<feed xmlns="{ATOM}" xmlns:s="{SHOP}"><s:entry key="{{o_orderkey}}"><s:total>{{o_totalprice}}</s:total></s:entry></feed>'
    return _ns(spark, sf_dir, "//entry", "total", {}, doc, ignore_namespace=True)


@query("SELECT o_orderkey AS k, o_orderstatus AS own, 'shop' AS theirs, 'en' AS lang FROM orders WHERE o_orderstatus <> 'P'")
def ns_attr(spark, sf_dir):
    """Attributes in a namespace, xml:lang, and tests of both."""
    doc = f'<r xmlns:s="{SHOP}"><o k="{{o_orderkey}}" t="{{o_orderstatus}}" s:t="shop" xml:lang="en"/><o k="0" t="F" s:t="x" xml:lang="en"/><o k="0" t="F" s:t="shop"/></r>'
    spec = Record({"k": Attr("long"), "own": Attr(name="t"), "theirs": Attr(name="z:t"), "lang": Attr(name="xml:lang")}, "//o[@z:t='shop' and @xml:lang='en'][@t!='P']", {"z": SHOP})
    return extract(order_docs(spark, sf_dir, doc), spec)


# --- errors, rules of the scan, sources --------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'Missing' WHEN 'P' THEN 'Coercion' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'Missing required field ''total'' at /root/order (line 2, col 3)' WHEN 'P' THEN 'Cannot coerce ''x' || o_orderkey || ''' to Double for ''total'' at /root/order/total (line 3, col 1)' END AS message
  FROM orders""")
def err_fields(spark, sf_dir):
    total = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("<total>x"), F.col("o_orderkey").cast("string"), F.lit("</total>"))).when(F.col("o_orderstatus") == "O", F.lit("<total>1</total>"))
    docs = order_docs(spark, sf_dir, "<root>\n  <order>\n{total}</order></root>", {"total": total})
    out = extract(docs, Record({"total": Child("double")}, "//order"), keep=["doc_id"], mode="PERMISSIVE")
    return out.select("doc_id", F.get("_errors", F.lit(0))["kind"].alias("kind"), F.get("_errors", F.lit(0))["message"].alias("message"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN o_orderpriority END AS name, o_orderstatus = 'O' AS missing,
  CASE o_orderstatus WHEN 'O' THEN 'Missing required field ''name'' at /root/order (line 1, col 7)' END AS message FROM orders""")
def err_missing(spark, sf_dir):
    """A required text that is not there, and one that is there but empty, which is no error."""
    name = F.when(F.col("o_orderstatus") == "F", F.lit("<name/>")).when(F.col("o_orderstatus") == "P", F.concat(F.lit("<name>"), "o_orderpriority", F.lit("</name>")))
    out = extract(order_docs(spark, sf_dir, "<root><order>{name}</order></root>", {"name": name}), Record({"name": Child()}, "//order"), keep=["doc_id"], mode="PERMISSIVE")
    missing = F.get("_errors", F.lit(0))
    return out.select("doc_id", "name", (F.size("_errors") > 0).alias("missing"), missing["message"].alias("message"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 END AS n_deeper, o_orderkey % 4 = 3 AS too_deep FROM orders")
def err_depth(spark, sf_dir):
    """A record inside itself, below as many levels as there is room for and below one more."""
    part = lambda inside: f"<part>{inside}</part>"
    deep = F.element_at(F.array(*[F.lit(x) for x in ("", part(""), part(part("")), part(part(part(""))))]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    out = extract(order_docs(spark, sf_dir, "<part>{deep}</part>", {"deep": deep}), Record({"parts": Child(Self(2), "part", many=True)}, "/part"), keep=["doc_id"], mode="PERMISSIVE")
    n = F.size("parts") + F.aggregate("parts", F.lit(0), lambda a, x: a + F.size(x["parts"]))
    wrong = F.get("_errors", F.lit(0))["kind"].eqNullSafe("Depth")
    return out.select("doc_id", F.when(~wrong, n.cast("long")).alias("n_deeper"), wrong.alias("too_deep"))


@query("SELECT o_orderkey AS doc_id, 1 AS n_good, CAST(o_orderstatus = 'F' AS INTEGER) AS n_malformed FROM orders")
def err_malformed(spark, sf_dir):
    """Records before the fault are there."""
    end = F.when(F.col("o_orderstatus") == "F", "<order>").otherwise("</root>")
    out = extract(order_docs(spark, sf_dir, f"<root>{_PLAIN}{{end}}", {"end": end}), Record(_HEAD, "//order"), keep=["doc_id"], mode="PERMISSIVE")
    bad = (F.size("_errors") > 0) & (F.get("_errors", F.lit(0))["kind"] == "Malformed")
    return out.groupBy("doc_id").agg(F.sum((~bad).cast("int")).cast("int").alias("n_good"), F.sum(bad.cast("int")).cast("int").alias("n_malformed"))


@query(f"{_ORDERS} WHERE o_orderstatus <> 'F'")
def err_drop(spark, sf_dir):
    total = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    docs = order_docs(spark, sf_dir, '<root><order key="{o_orderkey}"><total>{total}</total></order></root>', {"total": total})
    return extract(docs, Record(_HEAD, "//order"), mode="DROPMALFORMED")


@query("SELECT o_orderkey AS k, o_totalprice AS total, o_orderkey AS outer_k FROM orders")
def embedded_xml(spark, sf_dir):
    """A document inside a document: extracted in two steps."""
    docs = order_docs(spark, sf_dir, f'<envelope id="{{o_orderkey}}"><payload><![CDATA[<root>{_PLAIN}</root>]]></payload></envelope>')
    outer = extract(docs, Record({"outer_k": Attr("long", "id"), "payload": Child()}, "//envelope"))
    return extract(outer, Record(_HEAD, "//order"), "payload", keep=["outer_k"])


@query(_ORDERS)
def outermost_rule(spark, sf_dir):
    """A record inside a record is no record of its own."""
    return _orders(spark, sf_dir, "//order", f'<root><order key="{{o_orderkey}}"><total>{{o_totalprice}}</total>{_DECOY}</order></root>')


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT -o_orderkey FROM orders")
def attr_only_nested(spark, sf_dir):
    """Unless only attributes are read."""
    docs = order_docs(spark, sf_dir, '<root><order key="{o_orderkey}"><x><order key="-{o_orderkey}"/></x></order></root>')
    return extract(docs, Record({"k": Attr("long", "key")}, "//order"))


@query("SELECT l_orderkey AS doc_id, CAST(ord AS BIGINT) AS pos, l_quantity AS qty FROM l")
def record_position(spark, sf_dir):
    docs = order_docs(spark, sf_dir, ORDER, body=LINE)
    return extract(docs, Record({"qty": Child("double")}, "//line"), keep=["doc_id"], position="pos")


@query("SELECT l_orderkey AS doc_id, CAST(ord AS VARCHAR) AS value, l_quantity AS qty FROM l WHERE ord = 2 AND l_returnflag = 'R'")
def nodes_sql(spark, sf_dir):
    """The same by joins over the table of elements, which is written once and read by name for each step."""
    path = scratch(spark)
    nodes(order_docs(spark, sf_dir, ORDER, body=LINE), keep=["doc_id"], text=False).write.parquet(path)
    n = spark.read.parquet(path)
    line = find(n, "//order/line[2][@flag='R']/@n", "doc_id")
    qty = find(n, "//line/qty", "doc_id").select(F.col("doc_id").alias("d"), F.col("parent").alias("p"), F.col("own_text").cast("double").alias("qty"))
    return line.join(qty, (F.col("doc_id") == F.col("d")) & (F.col("pre") == F.col("p"))).select("doc_id", "value", "qty")


@query(_ORDERS)
def sql_udtf(spark, sf_dir):
    """The extraction as a table function of SQL."""
    register(spark, "order_heads", Record(_HEAD, "//order"))
    order_docs(spark, sf_dir, f"<root>{_PLAIN}</root>").createOrReplaceTempView("order_docs")
    return spark.sql("SELECT r.* FROM order_docs d, LATERAL order_heads(d.content) r")


def _region_files(spark: SparkSession, sf_dir: str) -> str:
    """A file for each region."""
    path = scratch(spark)
    _geography(spark, sf_dir).select("r_regionkey", F.col("content").alias("value")).write.partitionBy("r_regionkey").text(path)
    return path


@query(_NATIONS)
def files_read(spark, sf_dir):
    return _flat(read_files(spark, f"{_region_files(spark, sf_dir)}/*/*.txt", _REGION))


@query(_NATIONS)
def files_read_large(spark, sf_dir):
    return _flat(read_large(spark, _region_files(spark, sf_dir), _REGION))


@query(_NATIONS)
def stream_available_now(spark, sf_dir):
    out = scratch(spark)
    found = stream_files(spark, f"{_region_files(spark, sf_dir)}/*/*.txt", _REGION, max_files=2)
    found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _flat(spark.read.parquet(f"{out}/rows"))


@query("""SELECT event_type AS kind, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, count(*) AS n FROM events GROUP BY ALL""")
def windows_over_records(spark, sf_dir):
    """Extracted rows are ordinary rows: an event-time window over them."""
    docs = read(spark, sf_dir, "events").select(xml('<e type="{event_type}"><t>{t}</t></e>', {"t": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")}).alias("content"))
    rows = extract(docs, Record({"kind": Attr(name="type"), "t": Child("timestamp_ntz")}, "e"))
    hour = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01T00:00:00").cast("timestamp_ntz"), F.col("w.start"))
    return rows.groupBy("kind", F.window("t", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("kind", hour.alias("hour_us"), "n")
