"""The engine's queries over the driver's tables, with their DuckDB forms."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, rest
from .__main__ import query as cli_query
from .functions import values as v
from .operators import jsondoc, store
from .operators.durable import delete_path, durable, scratch
from .operators.rules import parser
from .operators.rules.datalog import RuleSet
from .plans import predicates as p
from .plans.layout import Catalog
from .sources import generators, snapshot, triples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None, name: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def _scratch(df: DataFrame, name: str) -> str:
    return scratch(df.sparkSession, name)


# -- scans

ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@register(f"SELECT {ORDER} FROM orders")
def scan_all(t):
    return p.select(store.scan(t("orders"))).select(*ORDER.split(", "))


@register(f"SELECT {ORDER} FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1")
def scan_next(t):
    return store.next_after(t("orders"), 100, "o_orderkey").select(*ORDER.split(", "))


@register(f"SELECT {ORDER} FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def select_limit_offset(t):
    return store.page(t("orders"), 50, 100, "o_orderkey").select(*ORDER.split(", "))


@register("SELECT c_custkey, true AS raw FROM customer UNION ALL SELECT -s_suppkey, true FROM supplier UNION ALL SELECT c_custkey, false FROM customer")
def scan_raw(t):
    """Raw records show in raw scans alone."""
    space = store.insert(t("customer").select("c_custkey"), t("supplier").select((-F.col("s_suppkey")).alias("c_custkey")), raw=True)
    return store.scan(space, raw=True).select("c_custkey", F.lit(True).alias("raw")).union(store.scan(space).select("c_custkey", F.lit(False).alias("raw")))


# -- conditions: a NULL literal and a value each, on a column that has NULLs


def _customers(t):
    return t("customer").select("c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("x"))


def _filter(name: str, cond: str, value_sql: str, null_sql: str) -> None:
    base = "SELECT c_custkey, nullif(c_nationkey, 7) AS x FROM customer"
    sql = f"WITH c AS ({base}) SELECT c_custkey, x, 'value' AS variant FROM c WHERE {value_sql} UNION ALL SELECT c_custkey, x, 'null' AS variant FROM c WHERE {null_sql}"

    @register(sql, name)
    def both(t):
        c = _customers(t)
        return p.select(c, [("x", cond, 9)]).withColumn("variant", F.lit("value")).unionByName(p.select(c, [("x", cond, None)]).withColumn("variant", F.lit("null")))


_filter("filter_eq", "=", "x IS NOT DISTINCT FROM 9", "x IS NULL")
_filter("filter_ne", "!=", "x IS DISTINCT FROM 9", "x IS NOT NULL")
_filter("filter_lt", "<", "x IS NULL OR x < 9", "false")
_filter("filter_gt", ">", "x > 9", "x IS NOT NULL")
_filter("filter_le", "<=", "x IS NULL OR x <= 9", "x IS NULL")
_filter("filter_ge", ">=", "x >= 9", "true")


@register("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 2 ELSE 3 END::INT AS n FROM part WHERE p_size % 3 = 2 AND p_brand <> 'Brand#13'")
def filter_short_record(t):
    f = [v.integer(F.col("p_partkey")), v.integer(F.col("p_size")), v.string(F.col("p_brand"))]
    ragged = t("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.array(f[0])).when(F.col("p_size") % 3 == 1, F.array(*f[:2])).otherwise(F.array(*f)).alias("f"))
    return ragged.where(p.field_condition(F.col("f"), 2, "!=", "Brand#13")).select("p_partkey", F.size("f").alias("n"))


LINE = "l_orderkey, l_partkey, l_linenumber, l_quantity"


@register(f"SELECT {LINE} FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_returnflag = 'R' AND l_linenumber <> 3")
def filter_and(t):
    return p.select(t("lineitem"), [("l_quantity", ">=", 10.0), ("l_quantity", "<", 12.0), ("l_returnflag", "=", "R"), ("l_linenumber", "!=", 3)]).select(*LINE.split(", "))


@register(f"SELECT {LINE} FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 2")
def match_record(t):
    return p.select(t("lineitem"), match={"l_returnflag": "A", "l_linestatus": "F", "l_linenumber": 2, "l_tax": p.ANY}).select(*LINE.split(", "))


@register(f"SELECT {LINE} FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45 AND l_discount <= 0.02")
def match_and_args(t):
    df = t("lineitem")
    place = df.columns.index("l_linenumber")
    return p.select(df, [("l_quantity", ">", 45.0), ("l_discount", "<=", 0.02)], match=[p.ANY] * place + [1]).select(*LINE.split(", "))


@register(f"SELECT {LINE} FROM lineitem WHERE l_quantity > 30 AND l_quantity < 20")
def filter_contradiction(t):
    return p.select(t("lineitem"), [("l_quantity", ">", 30.0), ("l_quantity", "<", 20.0)]).select(*LINE.split(", "))


def _mixed(t):
    size, price, brand = v.integer(F.col("p_size")), v.double(F.col("p_retailprice")), v.string(F.col("p_brand"))
    kind = F.col("p_partkey") % 4
    return t("part").select("p_partkey", F.when(kind == 0, size).when(kind == 1, price).when(kind == 2, brand).otherwise(v.null_value()).alias("val"))


@register("SELECT p_partkey FROM part WHERE p_partkey % 4 = 3 OR (p_partkey % 4 = 0) OR (p_partkey % 4 = 1 AND p_retailprice < 1200)")
def filter_mixed_type(t):
    return _mixed(t).where(p.mixed_condition(F.col("val"), "<", 1200.0)).select("p_partkey")


@register("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size < 25 THEN -1 WHEN p_size = 25 THEN 0 ELSE 1 END WHEN 3 THEN -1 ELSE 1 END::INT AS cmp FROM part")
def compare_values(t):
    return _mixed(t).select("p_partkey", v.compare(F.col("val"), v.integer(F.lit(25))).alias("cmp"))


@register("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'double' WHEN 2 THEN 'string' ELSE 'null' END AS type FROM part")
def type_of(t):
    return _mixed(t).select("p_partkey", v.type_name(F.col("val")).alias("type"))


# -- query objects


@register(f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 37")
def query_rowlimit(t):
    return p.select(t("orders"), [("o_orderstatus", "=", "F")], limit=37, order_by="o_orderkey").select(*ORDER.split(", "))


@register("SELECT count(*) AS res_count FROM orders WHERE o_totalprice > 100000")
def query_count(t):
    return p.select(t("orders"), [("o_totalprice", ">", 100000.0)]).agg(F.count(F.lit(1)).alias("res_count"))


@register("SELECT min(event_id) AS event_id FROM events WHERE event_type = 'click'")
def find_first(t):
    return store.find(t("events"), "event_type", "=", "click", rid="event_id").select("event_id").union(t("events").limit(0).select("event_id")).agg(F.min("event_id").alias("event_id"))


@register("SELECT min(event_id) AS event_id FROM events WHERE value >= 50 AND event_id > 500")
def find_next(t):
    return store.find(t("events"), "value", ">=", 50.0, last=500, rid="event_id").agg(F.min("event_id").alias("event_id"))


@register("SELECT event_id, value FROM events WHERE value >= 50 AND (value > 60 OR value = 60 AND event_id > 500) ORDER BY value, event_id LIMIT 1")
def find_in_index_order(t):
    """The next match by (value, row id), after a value and a row."""
    return store.find_ordered(t("events"), "value", ">=", 50.0, last=(60.0, 500), rid="event_id").select("event_id", "value")


@register("""WITH c AS (SELECT c_custkey, nullif(c_nationkey, 7) AS a, nullif(c_custkey % 25, 9) AS b FROM customer)
  SELECT c_custkey, a IS NOT DISTINCT FROM b AS eq, b IS NOT NULL AND (a IS NULL OR a < b) AS lt, a IS NOT NULL AND (b IS NULL OR a > b) AS gt,
  a IS NULL OR (b IS NOT NULL AND a <= b) AS le, b IS NULL OR (a IS NOT NULL AND a >= b) AS ge FROM c""")
def filter_columns(t):
    """Conditions between two columns that both have NULLs."""
    c = t("customer").select("c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("a"), F.nullif(F.col("c_custkey") % 25, F.lit(9)).alias("b"))
    return c.select("c_custkey", *[p.condition(F.col("a"), k, F.col("b")).alias(n) for n, k in (("eq", "="), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="))])


def _dated(t):
    """Dates, times, chars and URIs in one column."""
    kind = F.col("o_orderkey") % 4
    day, cents = v.date(v.day_number(F.to_date("o_orderdate"))), v.time((F.col("o_orderkey") % 86400 * 100).cast("bigint"))
    return t("orders").select("o_orderkey", F.when(kind == 0, day).when(kind == 1, cents).when(kind == 2, v.char(F.col("o_orderstatus"))).otherwise(v.uri(F.col("o_orderpriority"), F.lit("urn:p:"))).alias("val"))


@register("""SELECT o_orderkey, 'date' AS param FROM orders WHERE o_orderkey % 4 = 0 AND o_orderdate::DATE >= DATE '1996-06-01' OR o_orderkey % 4 = 1
  UNION ALL SELECT o_orderkey, 'time' FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 86400 = 3601
  UNION ALL SELECT o_orderkey, 'char' FROM orders WHERE o_orderkey % 4 = 2 AND o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, 'uri' FROM orders WHERE o_orderkey % 4 = 3 AND o_orderpriority = '1-URGENT'""")
def typed_params(t):
    """Parameters of every type as Python values."""
    wanted = {"date": (">=", datetime.date(1996, 6, 1)), "time": ("=", datetime.time(1, 0, 1)), "char": ("=", v.Typed("char", "F")), "uri": ("=", v.Typed("uri", "1-URGENT", "urn:p:"))}
    rows = _dated(t)
    return reduce(DataFrame.union, [rows.where(p.mixed_condition(F.col("val"), k, x)).select("o_orderkey", F.lit(n).alias("param")) for n, (k, x) in wanted.items()])


@register(f"SELECT {ORDER} FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'O' AND o_custkey < 900")
def cli_query_text(t):
    return cli_query(t("orders"), "o_totalprice >= 200000.0 o_orderstatus != O o_custkey < 900".split()).select(*ORDER.split(", "))


QUERIES["cli_query"], ORACLES["cli_query"] = QUERIES.pop("cli_query_text"), ORACLES.pop("cli_query_text")

# -- changes

CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal"


@register(f"SELECT {CUSTOMER} FROM customer UNION ALL SELECT -s_suppkey, s_name, NULL, NULL FROM supplier")
def insert_union(t):
    return store.insert(t("customer").select(*CUSTOMER.split(", ")), t("supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name")))


@register("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 0 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer")
def update_where(t):
    return store.update_where(t("customer"), {"c_acctbal": 0.0}, [("c_acctbal", "<", 0.0)], {"c_mktsegment": "BUILDING"}).select("c_custkey", "c_acctbal")


@register(f"SELECT {CUSTOMER} FROM customer WHERE NOT (c_nationkey = 3 AND c_acctbal > 1000)")
def delete_where(t):
    return store.delete_where(t("customer"), [("c_nationkey", "=", 3), ("c_acctbal", ">", 1000.0)]).select(*CUSTOMER.split(", "))


@register("SELECT s_suppkey, CASE WHEN s_nationkey = 5 THEN 6 ELSE s_nationkey END::INT AS s_nationkey FROM supplier")
def cas_update(t):
    return store.compare_and_swap(t("supplier"), "s_nationkey", 5, 6).select("s_suppkey", "s_nationkey")


@register("SELECT c_custkey, c_nationkey + coalesce(n, 0)::BIGINT AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def atomic_add(t):
    space = t("customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("total"))
    return store.add_all(space, "total", t("orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("delta")), "c_custkey")


# -- links


@register("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (1, 2, 3, 4, 5)")
def parents_of(t):
    links = store.edges(t("lineitem"), ["l_orderkey"], "l_partkey").where(F.col("child").isin(1, 2, 3, 4, 5)).select("child").distinct()
    return t("lineitem").join(links, F.col("l_orderkey") == F.col("child"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey").distinct()


@register("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def link_hop(t):
    return store.follow(t("nation"), "n_regionkey", t("region"), "r_regionkey").select("n_name", "r_name")


@register("""SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE s_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'regions' ELSE 'suppliers' END AS space
  FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_suppkey = n_regionkey + 1""")
def cross_space_link(t):
    """Links to records of two other spaces."""
    even = F.col("n_nationkey") % 2 == 0
    link = store.external(F.when(even, "regions").otherwise("suppliers"), F.when(even, F.col("n_regionkey")).otherwise(F.col("n_regionkey") + 1))
    spaces = {"regions": t("region").select(F.col("r_regionkey").cast("bigint").alias("rid"), F.col("r_name").alias("name")), "suppliers": t("supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_name").alias("name"))}
    return store.follow_external(t("nation").withColumn("link", link), "link", spaces).select("n_name", "name", F.col("link.space").alias("space"))


@register("SELECT c_custkey FROM customer WHERE c_nationkey <> 4 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def delete_guarded(t):
    links = t("orders").select(F.col("o_custkey").alias("child"))
    return store.delete_guarded(t("customer"), links, t("customer").where("c_nationkey = 4").select(F.col("c_custkey").alias("__rid")), "c_custkey").select("c_custkey")


@register("""WITH RECURSIVE walk(rid, hops) AS (SELECT n_nationkey::BIGINT, 0 FROM nation WHERE n_nationkey = 1
  UNION SELECT (rid * 7 + 3) % 25, hops + 1 FROM walk WHERE hops < 30) SELECT 1::BIGINT AS start, rid, min(hops) AS hops FROM walk GROUP BY rid""")
def link_chain(t):
    key = F.col("n_nationkey").cast("bigint")
    links = t("nation").select(key.alias("parent"), ((key * 7 + 3) % 25).alias("child"))
    return store.chain(links, t("nation").where("n_nationkey = 1").select(key.alias("rid")), 30)


@register("""WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT + 1 AS b FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 2 FROM nation),
  walk(start, rid, hops) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation WHERE n_nationkey < 3
  UNION SELECT start, b, hops + 1 FROM walk JOIN e ON a = rid) SELECT start, rid, min(hops) AS hops FROM walk GROUP BY start, rid""")
def link_reach(t):
    """Every record has two links and both twice, so that the ways to it are very many."""
    key = F.col("n_nationkey").cast("bigint")
    links = t("nation").select(key.alias("parent"), F.explode(F.array(key + 1, key + 2, key + 1, key + 2)).alias("child"))
    return store.chain(links, t("nation").where("n_nationkey < 3").select(key.alias("rid")))


@register("SELECT s_suppkey, c_custkey, CASE WHEN s_nationkey < c_nationkey THEN -1 WHEN s_nationkey > c_nationkey THEN 1 WHEN s_acctbal < c_acctbal THEN -1 WHEN s_acctbal > c_acctbal THEN 1 ELSE 0 END::INT AS cmp FROM supplier JOIN customer ON s_suppkey = c_custkey")
def record_compare(t):
    left = F.array(v.integer(F.col("s_nationkey")), v.double(F.col("s_acctbal")))
    right = F.array(v.integer(F.col("c_nationkey")), v.double(F.col("c_acctbal")))
    return t("supplier").join(t("customer"), F.col("s_suppkey") == F.col("c_custkey")).select("s_suppkey", "c_custkey", v.compare_records(left, right).alias("cmp"))


@register("SELECT p_partkey, (1 + p_size % 3)::INT AS n FROM part")
def record_len(t):
    fields = F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda k: v.integer(k))
    return t("part").select("p_partkey", F.size(fields).alias("n"))


# -- JSON documents


def _order_docs(t):
    """A nested document per order: its lines in an array, their keys in another."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")))).alias("lines"))
    lines = lines.withColumn("flags", F.array_sort(F.array_distinct("lines.n")))
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("cust")).alias("by"), "lines", "flags"))
    return t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), doc.alias("doc"))


def _kv(t):
    return jsondoc.shred(t("events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("doc")))


@register("SELECT event_id AS doc_id, 'k' AS key, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS value FROM events")
def json_shred(t):
    return _kv(t).select("doc_id", "key", F.col("value.i").alias("value"))


@register("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = 17")
def json_query_1(t):
    return jsondoc.search(_order_docs(t), {"part": 17})


@register("SELECT DISTINCT o_orderkey AS doc_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_partkey BETWEEN 30 AND 30")
def json_query_and(t):
    return jsondoc.search(_order_docs(t), {"status": "F", "part": 30})


@register("SELECT DISTINCT o_orderkey AS doc_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 6")
def json_array_match(t):
    return jsondoc.search(_order_docs(t), {"flags": 6})


@register("SELECT o_orderkey AS doc_id FROM orders WHERE o_custkey = 10 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def json_struct_match(t):
    return jsondoc.search(_order_docs(t), {"by": {"cust": 10}})


@register("SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def json_valid(t):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit("}"))).otherwise(F.lit("25"))
    return t("events").select("event_id", jsondoc.is_valid(text).alias("ok"))


@register("SELECT count(*) AS n FROM events WHERE event_id % 10 <> 0")
def json_delete(t):
    return jsondoc.delete(_kv(t), t("events").where("event_id % 10 = 0").select(F.col("event_id").alias("doc_id"))).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey < 20")
def json_find_document(t):
    kv = jsondoc.shred(_order_docs(t))
    return jsondoc.containing(kv, kv.where((F.col("key") == "part") & (F.col("value") < v.integer(F.lit(20)))).select("doc_id", "node"))


@register("SELECT event_id, props AS text FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events)")
def json_print(t):
    return t("events").select("event_id", jsondoc.printed(F.col("props")).alias("text"))


@register("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def resultset_intersect(t):
    o = t("orders")
    return jsondoc.intersect([p.select(o, [("o_totalprice", ">", 150000.0)]).select("o_orderkey"), p.select(o, [("o_orderstatus", "=", "O")]).select("o_orderkey")])


@register("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40")
def resultset_unique(t):
    return jsondoc.unique(p.select(t("lineitem"), [("l_quantity", ">", 40.0)]).select("l_orderkey"))


# -- layouts, kept for each table and built once a session


_LAYOUTS: dict[tuple, Catalog] = {}


def _catalog(df: DataFrame, kind: str, columns: list[str], template: dict | None = None) -> Catalog:
    """A catalog with one layout of a table's columns, built by the first query that asks for it."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, tuple(sorted(df.inputFiles())), tuple(df.columns), kind, tuple(columns), tuple((template or {}).items()))
    if key not in _LAYOUTS:
        c, path = Catalog(df), _scratch(df, "layout")
        c.add_hashed(path, columns, template=template) if kind == "hashed" else c.add_sorted(path, columns[0], template=template)
        _LAYOUTS[key] = c
    return _LAYOUTS[key]


@register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 20 AND l_quantity < 22")
def index_range_scan(t):
    c = _catalog(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "sorted", ["l_quantity"])
    return c.select([("l_quantity", ">=", 20.0), ("l_quantity", "<", 22.0)])


@register("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey = 55")
def index_point(t):
    c = _catalog(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "sorted", ["l_partkey"])
    return c.select([("l_partkey", "=", 55)])


@register("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 ORDER BY c_acctbal")
def index_ordered(t):
    c = _catalog(t("customer").select("c_custkey", "c_acctbal"), "sorted", ["c_acctbal"])
    return c.select([("c_acctbal", ">", 9000.0)], ordered=True)


@register("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey = 12 AND l_linenumber = 3")
def hash_lookup(t):
    c = _catalog(t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "hashed", ["l_partkey", "l_linenumber"])
    return c.select([("l_partkey", "=", 12), ("l_linenumber", "=", 3)])


@register("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 3")
def template_index(t):
    c = _catalog(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "sorted", ["l_quantity"], {"l_returnflag": "R"})
    return c.select([("l_returnflag", "=", "R"), ("l_quantity", "<=", 3.0)])


# -- scalar functions


@register("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'double' WHEN 2 THEN 'date' WHEN 3 THEN 'time' WHEN 4 THEN 'null' ELSE 'string' END AS type FROM events")
def infer_type(t):
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.format_string("-%d.25", "event_id")).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).when(k == 3, F.date_format("ts", "HH:mm:ss")).when(k == 4, F.lit("")).otherwise(F.concat(F.lit(" "), "event_id"))
    return t("events").select("event_id", v.type_name(v.infer(text)).alias("type"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1 ELSE -1 END::INT AS day FROM orders")
def parse_date(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-M-d'x'"))
    return t("orders").select("o_orderkey", v.parse_date(text).alias("day"))


@register("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 100 + 50 ELSE -1 END::INT AS cs FROM events")
def parse_time(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(".5"))).otherwise(F.date_format("ts", "HH:mm"))
    return t("events").select("event_id", v.parse_time(text).alias("cs"))


@register("SELECT o_orderkey, (date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1)::INT AS day FROM orders")
def date_scalar(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", v.ymd_to_date(F.year(d), F.month(d), F.dayofmonth(d)).alias("day"))


@register("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders")
def date_to_ymd(t):
    ymd = v.date_to_ymd(v.day_number(F.to_date("o_orderdate")))
    return t("orders").select("o_orderkey", ymd["year"].alias("y"), ymd["month"].alias("m"), ymd["day"].alias("d"))


@register("SELECT event_id, ((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 100)::INT AS cs FROM events")
def time_scalar(t):
    return t("events").select("event_id", v.hms_to_time(F.hour("ts"), F.minute("ts"), F.second("ts"), F.lit(0)).alias("cs"))


@register("SELECT event_id, (event_id * 977 % 8640000 // 360000)::INT AS h, (event_id * 977 % 8640000 // 6000 % 60)::INT AS m, (event_id * 977 % 8640000 // 100 % 60)::INT AS s, (event_id * 977 % 8640000 % 100)::INT AS c FROM events")
def time_to_hms(t):
    hms = v.time_to_hms(F.col("event_id") * 977 % 8_640_000)
    return t("events").select("event_id", hms["hour"].alias("h"), hms["minute"].alias("m"), hms["second"].alias("s"), hms["cents"].alias("c"))


@register("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.00' AS text FROM events")
def format_datetime(t):
    day, cs = v.day_number(F.to_date("ts")), v.hms_to_time(F.hour("ts"), F.minute("ts"), F.second("ts"), F.lit(0))
    return t("events").select("event_id", v.format_datetime(day, cs).alias("text"))


@register("SELECT p_partkey, CASE WHEN p_size * 20.125 BETWEEN -800 AND 800 THEN round(p_size * 201250)::BIGINT END AS units FROM part")
def fixpoint_round(t):
    return t("part").select("p_partkey", v.fixpoint_units(F.col("p_size") * F.lit(20.125)).alias("units"))


@register("SELECT doc_id, octet_length(encode(text))::INT AS n FROM documents")
def string_len(t):
    return t("documents").select("doc_id", v.string_bytes(F.col("text")).alias("n"))


@register("""SELECT doc_id, CASE WHEN n >= 1000000000 THEN n // 1000000000 || ' GB' WHEN n >= 1000000 THEN n // 1000000 || ' MB'
  WHEN n >= 1000 THEN n // 1000 || ' kB' ELSE n || ' bytes' END AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 3 * 5000) AS n FROM documents)""")
def pretty_size(t):
    return t("documents").select("doc_id", v.pretty_size(F.col("n_chars") * (1 + F.col("doc_id") % 3 * 5000)).alias("size"))


@register("SELECT page_id, to_json(url || chr(34) || chr(9))::VARCHAR AS text FROM pages")
def escape_json(t):
    return t("pages").select("page_id", v.escape_json(F.concat("url", F.lit('"\t'))).alias("text"))


@register("SELECT page_id, url_decode(replace(url, '+', '%2B') || '%20a%2Fb+c') AS text FROM (SELECT page_id, url FROM pages)" .replace("%20a%2Fb+c", "%20a%2Fb%2Bc"))
def url_decode(t):
    return t("pages").select("page_id", v.url_decode(F.concat("url", F.lit("%20a%2Fb+c"))).alias("text"))


# -- printing, files


def _nation_fields():
    return F.array(v.integer(F.col("n_nationkey")), v.string(F.col("n_name")), v.null_value(), v.double(F.col("n_regionkey") / 2))


@register("""SELECT n_nationkey, '"' || n_name || '"' AS name, printf('%.6f', n_regionkey / 2) AS half, 'p:' || n_name AS link FROM nation""")
def print_value(t):
    return t("nation").select("n_nationkey", v.print_value(v.string(F.col("n_name"))).alias("name"), v.print_value(v.double(F.col("n_regionkey") / 2)).alias("half"), v.print_value(v.uri(F.col("n_name"), F.lit("p"))).alias("link"))


@register("""SELECT n_nationkey, unnest(['NULL', '<rec ' || n_nationkey || '>', n_nationkey::VARCHAR, printf('%.6f', n_nationkey / 4), '"' || n_name || '"', '<xsdtype t>"' || n_name || '"', 'p:' || n_name,
  '<blob ' || strlen(n_name) || '>', n_name[1], printf('%.6f', n_nationkey / 8), '<raw date ' || (n_nationkey + 1) || '>' || strftime(DATE '0001-01-01' + n_nationkey, '%Y-%m-%d'),
  '<raw time ' || n_nationkey * 100 || '>' || printf('00:00:%02d.00', n_nationkey), '!' || n_name, '?' || n_nationkey]) AS text, generate_subscripts(range(14), 1)::INT AS type FROM nation""")
def print_all_types(t):
    """A value of each of the fourteen types."""
    k, s = F.col("n_nationkey"), F.col("n_name")
    every = [v.null_value(), v.record(k), v.integer(k), v.double(k / 4), v.string(s), v.xmlliteral(s, F.lit("t")), v.uri(s, F.lit("p")), v.blob(F.encode(s, "UTF-8")), v.char(s), v.fixpoint(k / 8), v.date(k + 1), v.time(k * 100), v.anonconst(s), v.variable(k)]
    return t("nation").select("n_nationkey", F.explode(F.array(*every)).alias("val")).select("n_nationkey", v.print_value(F.col("val")).alias("text"), F.col("val.t").cast("int").alias("type"))


@register("""SELECT n_nationkey, '[' || n_nationkey || ',"' || n_name || '",NULL,' || printf('%.6f', n_regionkey / 2) || ']' AS line FROM nation""")
def print_record(t):
    return t("nation").select("n_nationkey", v.print_record(_nation_fields()).alias("line"))


@register("""SELECT n_nationkey, n_nationkey || ',"' || n_name || '",,' || printf('%.6f', n_regionkey / 2) AS line FROM nation""")
def csv_export_line(t):
    return t("nation").select("n_nationkey", v.csv_line(_nation_fields()).alias("line"))


@register("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, (n_regionkey / 2)::DOUBLE AS half FROM nation")
def csv_roundtrip(t):
    from .sources import csvfile

    path = _scratch(t("nation"), "csv")
    csvfile.write(t("nation").select(_nation_fields().alias("fields")), path)
    f = F.col("fields")
    return csvfile.read(t("nation").sparkSession, f"{path}/part-*").select(f[0]["i"].alias("n_nationkey"), f[1]["s"].alias("n_name"), f[3]["d"].alias("half"))


@register("""SELECT p_partkey, '[' || p_partkey || ',"' || p_name || '",' || p_size || ']' AS line FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 40""")
def rest_search_json(t):
    space = t("part").select("p_name", "p_size", "p_partkey")
    return rest.search_json(space, {"field": "p_size", "value": "7", "count": "40", "showid": "yes"}, "p_partkey")


@register("SELECT count(*) AS count FROM orders WHERE o_totalprice <= 50000.5 AND o_orderstatus = 'O'")
def rest_count(t):
    return rest.count(t("orders"), {"field": ["o_totalprice", "o_orderstatus"], "value": ["50000.5", "O"], "compare": ["ltequal", "equal"]}, "o_orderkey")


@register(f"SELECT {ORDER} FROM orders WHERE o_orderkey < 300 AND o_orderstatus <> 'P'")
def rest_param_types(t):
    words = rest.parse_params("field=o_orderkey&value=300&compare=lessthan&field=o_orderstatus&value=P&compare=not_equal&type=int&type=char")
    request: dict = {}
    for k, x in words:
        request.setdefault(k, []).append(x)
    return rest.search(t("orders"), request, "o_orderkey").select(*ORDER.split(", "))


@register("SELECT c_custkey, CASE WHEN c_nationkey = 4 OR c_custkey IN (10, 20) THEN 0.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 4 THEN 'changed' ELSE c_name END AS c_name FROM customer")
def rest_update(t):
    c = t("customer").select("c_name", "c_acctbal", "c_nationkey", "c_custkey")
    c = rest.update(c, rest.request_of("op=update&field=2&value=4&ufield=1&uvalue=0.5&ufield=c_name&uvalue=changed"), "c_custkey")
    return rest.update(c, rest.request_of("op=update&recids=10,20&ufield=1&uvalue=0.5"), "c_custkey").select("c_custkey", "c_acctbal", "c_name")


@register("SELECT c_custkey, c_name FROM customer WHERE NOT (c_nationkey <= 20 AND c_acctbal > 0)")
def rest_delete(t):
    left, _ = rest.delete(t("customer"), rest.request_of("op=delete&field=c_nationkey&value=20&compare=ltequal&field=c_acctbal&value=0.0&compare=greater"), "c_custkey")
    return left.select("c_custkey", "c_name")


@register("SELECT n_nationkey::BIGINT AS rid, n_name, n_regionkey FROM nation UNION ALL SELECT 25, 'a,b', 3 UNION ALL SELECT 26, '7', NULL UNION ALL SELECT 27, 'x', -1")
def rest_insert(t):
    space = t("nation").select(F.col("n_nationkey").cast("bigint").alias("rid"), "n_name", "n_regionkey")
    return rest.insert(space, rest.request_of('op=insert&rec=["a%2Cb",3]&rec=7&rec=["s:x","i:-1"]&types=yes'))


@register("SELECT n_nationkey::BIGINT AS f0, n_name AS f1 FROM nation WHERE n_nationkey <> 3 AND n_nationkey < 10 UNION ALL SELECT 77, 'new'")
def rest_service(t):
    """A space is made, filled, changed by requests, read and dropped."""
    spark, number = t("nation").sparkSession, uuid.uuid4().int % 10**9
    service, name = rest.Service(spark), f"db{number}"
    api.create(name, t("nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("bigint").alias("rid"), F.col("n_nationkey").cast("bigint").alias("f0"), F.col("n_name").alias("f1")))
    try:
        for request in ("op=insert&rec=5000,old", "op=update&field=0&value=5000&ufield=0&uvalue=77&ufield=1&uvalue=new", "op=delete&field=0&value=3"):
            service.handle(f"{request}&db={number}")
        return api.attach(name).records.select("f0", "f1")
    finally:
        service.handle(f"op=drop&db={number}")


@register("""SELECT o_orderkey, o_custkey, o_totalprice, 'sorted' AS layout FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 = 3 THEN 1000.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey % 10 <> 4
  UNION ALL SELECT -s_suppkey, s_suppkey, 1500.0 FROM supplier) WHERE o_totalprice >= 900 AND o_totalprice < 2000
  UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 = 3 THEN 1000.0 ELSE o_totalprice END, 'hashed' FROM orders WHERE o_custkey = 13
  UNION ALL SELECT -s_suppkey, s_suppkey, 1500.0, 'hashed' FROM supplier WHERE s_suppkey = 13""")
def index_upkeep(t):
    """Layouts follow an insert, an update and a delete without being built again."""
    o = t("orders").select(F.col("o_orderkey").alias("rid"), "o_custkey", "o_totalprice")
    c, spark = Catalog(o), o.sparkSession
    c.add_sorted(scratch(spark, "layout"), "o_totalprice")
    c.add_hashed(scratch(spark, "layout"), ["o_custkey"])
    more = t("supplier").select((-F.col("s_suppkey")).alias("rid"), F.col("s_suppkey").alias("o_custkey"), F.lit(1500.0).alias("o_totalprice"))
    after = o.unionByName(more)
    c.follow(after, new=more)
    changed = after.where("o_custkey % 10 = 3 and rid > 0").withColumn("o_totalprice", F.lit(1000.0))
    after = after.where("not (o_custkey % 10 = 3 and rid > 0)").unionByName(changed)
    c.follow(after, new=changed, gone=changed.select("rid"))
    gone = after.where("o_custkey % 10 = 4 and rid > 0").select("rid")
    c.follow(after.join(gone, "rid", "left_anti").select(after.columns), gone=gone)
    ranged = c.select([("o_totalprice", ">=", 900.0), ("o_totalprice", "<", 2000.0)]).withColumn("layout", F.lit("sorted"))
    hashed = c.select([("o_custkey", "=", 13)]).withColumn("layout", F.lit("hashed"))
    return ranged.unionByName(hashed).withColumnRenamed("rid", "o_orderkey")


@register("SELECT count(*) AS rows, min(c_acctbal) AS least, max(c_acctbal) AS greatest FROM customer")
def index_dump(t):
    """What the files of a layout hold, added up."""
    c = _catalog(t("customer").select("c_custkey", "c_acctbal"), "sorted", ["c_acctbal"])
    return c.dump(c.layouts[0]).agg(F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


@register("""SELECT DISTINCT o_orderkey AS doc_id, 'kept' AS state FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_partkey = 30
  UNION ALL SELECT DISTINCT o_orderkey, 'deleted' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_partkey = 30 AND o_orderkey % 2 = 0""")
def json_index(t):
    """A kept key and value table answers, before and after half of the documents go."""
    docs = _order_docs(t)
    index = jsondoc.JsonIndex(docs.sparkSession, _scratch(docs, "json-index"))
    index.add(docs)
    query = {"status": "F", "part": 30}
    kept = durable(index.find(query).withColumn("state", F.lit("kept")))
    index.delete(t("orders").where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("doc_id")))
    return kept.unionByName(index.find(query).withColumn("state", F.lit("deleted")))


@register("""SELECT n_nationkey::BIGINT AS rid, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2
  UNION ALL SELECT 25, 'twentyfive', 0""")
def journal_log(t):
    """Two connections log their changes; replayed on the rows before them, the log gives the rows after."""
    rows = t("nation").select(F.col("n_nationkey").cast("bigint").alias("rid"), "n_name", "n_regionkey")
    path, name = _scratch(rows, "journal"), f"journal-{uuid.uuid4().hex}"
    first = api.create(name, rows)
    copy = api.create(f"{name}-copy", rows)
    try:
        first.start_logging(path)
        first.update({"n_name": "first"}, [("n_regionkey", "=", 1)])
        first.insert([{"n_name": "x", "n_regionkey": 0}])
        second = api.attach(name)
        second.start_logging(path)
        second.update({"n_name": "one"}, [("n_regionkey", "=", 1)])
        second.update({"n_name": "twentyfive"}, [("rid", "=", 25)])
        second.delete([("n_regionkey", "=", 2)])
        copy.replay_log(path)
        return copy.records
    finally:
        api.drop(name)
        api.drop(f"{name}-copy")


@register("""SELECT c_custkey, '<urn:c:' || c_custkey || '>' AS subject, 'lives/in' AS predicate, c_name AS object FROM customer""")
def ntriples_import(t):
    """Statements written as N-Triples and read again."""
    path = _scratch(t("customer"), "ntriples")
    key = F.col("c_custkey").cast("string")
    triples.write(t("customer").select(v.uri(F.lit("in"), F.lit("http://e/lives/")).alias("predicate"), v.uri(key, F.lit("urn:c:")).alias("subject"), v.string(F.col("c_name")).alias("object")), path)
    got = triples.read(t("customer").sparkSession, f"{path}/part-*")
    s = F.col("subject")
    return got.select(s["s"].cast("bigint").alias("c_custkey"), F.concat(F.lit("<"), s["x"], s["s"], F.lit(">")).alias("subject"), F.concat(F.lit("lives/"), F.col("predicate")["s"]).alias("predicate"), F.col("object")["s"].alias("object"))


@register("""WITH RECURSIVE g(kind, rid, value, inc, k, sign, cycle) AS (
    SELECT 'asc', 0::BIGINT, 0::BIGINT, 1, 0, 1, 17 UNION ALL SELECT 'desc', 0, 100000, -1, 0, -1, 17 UNION ALL SELECT 'mix', 0, 1, 1, 0, 1, 18
    UNION ALL SELECT kind, rid + 1, value + inc, CASE WHEN k + 1 = cycle THEN sign WHEN k % 2 = 0 THEN inc + 2 * sign ELSE inc - sign END, (k + 1) % cycle, sign, cycle FROM g WHERE rid < 399)
  SELECT kind, rid, f0, f0 + 1 AS f1, f0 + 2 AS f2 FROM (SELECT kind, rid, CASE WHEN kind = 'mix' AND k % 2 = 1 THEN 10000 - value ELSE value END AS f0 FROM g)""")
def int_generators(t):
    spark = t("nation").sparkSession
    return reduce(DataFrame.union, [generators.int_rows(spark, kind, 400).withColumn("kind", F.lit(kind)) for kind in generators.SHAPES])


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dump_restore(t):
    path = _scratch(t("nation"), "dump")
    snapshot.dump(t("nation"), path)
    return snapshot.restore(t("nation").sparkSession, path, verify=True)


@register("""WITH e AS (SELECT event_id AS seq, user_id AS rid, event_type AS op FROM events),
  w AS (SELECT rid, arg_max(op, seq) AS val FROM e WHERE seq % 97 <> 0 GROUP BY rid),
  d AS (SELECT rid, max(seq) AS gone FROM e WHERE seq % 97 = 0 GROUP BY rid),
  s AS (SELECT DISTINCT rid FROM e)
  SELECT s.rid, w.val AS v FROM s LEFT JOIN w USING (rid) LEFT JOIN d USING (rid) WHERE gone IS NULL""")
def journal_replay(t):
    e = t("events")
    gone = F.col("event_id") % 97 == 0
    log = e.select(F.col("event_id").alias("seq"), F.when(gone, "DEL").otherwise("SET").alias("op"), F.col("user_id").alias("rid"), F.when(~gone, "v").alias("col"), F.when(~gone, F.col("event_type")).alias("val"))
    space = e.select(F.col("user_id").alias("rid")).distinct().withColumn("v", F.lit(None).cast("string"))
    return snapshot.replay(space, log)


@register("SELECT 'urn:in' AS predicate, 'c' || c_custkey AS subject, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'urn:in', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def triples_scan(t):
    row = lambda s, o: F.struct(F.lit("urn:in").alias("predicate"), s.alias("subject"), o.alias("object"))
    a = store.follow(t("customer"), "c_nationkey", t("nation"), "n_nationkey").select(row(F.concat(F.lit("c"), "c_custkey"), F.col("n_name")).alias("x"))
    b = store.follow(t("nation"), "n_regionkey", t("region"), "r_regionkey").select(row(F.col("n_name"), F.col("r_name")).alias("x"))
    return a.unionByName(b).select("x.*")


@register("""SELECT '<urn:n:' || n_nationkey || '> <urn:in> "' || r_name || '" .' AS line FROM nation JOIN region ON n_regionkey = r_regionkey""")
def triples_export(t):
    both = store.follow(t("nation"), "n_regionkey", t("region"), "r_regionkey")
    return both.select(triples.statement(v.uri(F.lit("in"), F.lit("urn:")), v.uri(F.col("n_nationkey").cast("string"), F.lit("urn:n:")), v.string(F.col("r_name"))).alias("line"))


# -- rules

NATION, REGION, SUPPLIER = ("nation", 2), ("region", 2), ("supplier", 2)


def _facts(t) -> dict:
    n, r, s = t("nation"), t("region"), t("supplier")
    return {NATION: n.select("n_nationkey", "n_regionkey"), REGION: r.select("r_regionkey", "r_name"), SUPPLIER: s.select("s_suppkey", "s_nationkey")}


def _edges(t) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    return t("nation").select(key.alias("a"), ((key * 7 + 3) % 25).alias("b"))


PATHS = """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation),
  path(x, y) AS (SELECT a, b FROM e UNION SELECT path.x, e.b FROM path JOIN e ON path.y = e.a)"""


@register("SELECT s_suppkey AS supplier, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def rules_join(t):
    known = RuleSet(parser.parse_prolog("inregion(S,R) :- supplier(S,N), nation(N,K), region(K,R).")).closure(_facts(t))
    return known["inregion", 2].toDF("supplier", "region")


@register(PATHS + " SELECT x, y::BIGINT AS y FROM path")
def rules_closure(t):
    known = RuleSet(parser.parse_prolog("path(X,Y) :- edge(X,Y). path(X,Z) :- path(X,Y), edge(Y,Z).")).closure({("edge", 2): _edges(t)})
    return known["path", 2].toDF("x", "y")


@register("""WITH RECURSIVE e AS (SELECT 'ring' AS graph, n_nationkey::BIGINT AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION ALL SELECT 'tree', n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 0),
  path(graph, x, y) AS (SELECT graph, a, b FROM e UNION SELECT path.graph, path.x, e.b FROM path JOIN e ON path.graph = e.graph AND path.y = e.a)
  SELECT graph, bool_or(x = y) AS refuted FROM path GROUP BY graph""")
def rules_refute(t):
    """Nothing may lead to itself: one graph refutes that, the other doesn't."""
    rules = RuleSet(parser.parse_prolog("path(X,Y) :- edge(X,Y). path(X,Z) :- path(X,Y), edge(Y,Z). :- path(X,X)."))
    key = F.col("n_nationkey").cast("bigint")
    graphs = {"ring": _edges(t), "tree": t("nation").where("n_nationkey > 0").select(key.alias("a"), F.floor(key / 2).alias("b"))}
    found = [(name, rules.refuted({("edge", 2): durable(edges)})) for name, edges in graphs.items()]
    return t("nation").sparkSession.createDataFrame(found, "graph string, refuted boolean")


@register("SELECT DISTINCT n_regionkey AS region FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def rules_dedup(t):
    known = RuleSet(parser.parse_otter("has(?R) | -supplier(?S,?N) | -nation(?N,?R).")).closure(_facts(t))
    return known["has", 1].toDF("region")


@register("SELECT DISTINCT n_nationkey + n_regionkey AS total FROM nation")
def rules_arith(t):
    known = RuleSet(parser.parse_prolog("total(S) :- nation(N,R), S = +(N,R).")).closure(_facts(t))
    return known["total", 1].toDF("total")


@register("SELECT n_nationkey AS n FROM nation WHERE n_nationkey = n_regionkey")
def rules_equal(t):
    known = RuleSet(parser.parse_prolog("same(N) :- nation(N,R), N = R.")).closure(_facts(t))
    return known["same", 1].toDF("n")


@register("SELECT s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def rules_unify(t):
    known = RuleSet(parser.parse_prolog("here(S) :- supplier(S,N), nation(N,2).")).closure(_facts(t))
    return known["here", 1].toDF("s")
