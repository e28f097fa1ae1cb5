"""JSON documents: validity, shredding, containment queries, printing.

Documents are shredded once, by an Arrow-batched parser, into a table of key
and value rows; queries are then plain filters and semi-joins on that table.
null, true and false are dropped on load, keys are cut to 79 bytes, member
order and repeated keys are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from .durable import delete_path, durable

KEY_BYTES, MOST_NESTED = 79, 6
KV_SCHEMA = f"doc_id bigint, node int, parent int, ord int, key string, element boolean, value {values.TVAL}, subtree string"

Pairs = list  # an object, as (key, value) pairs; an array is a tuple


def without_comments(text: str) -> str:
    """The text with /* */ and // comments outside strings made blank."""
    out, k, inside = [], 0, False
    while k < len(text):
        c = text[k]
        if inside:
            out.append(text[k : k + 2] if c == "\\" else c)
            k += 2 if c == "\\" else 1
            inside = c != '"'
        elif text.startswith("/*", k):
            end = text.find("*/", k + 2)
            if end < 0:
                raise ValueError("a comment without end")
            k = end + 2
            out.append(" ")
        elif text.startswith("//", k):
            end = text.find("\n", k)
            k = len(text) if end < 0 else end
        else:
            inside = c == '"'
            out.append(c)
            k += 1
    return "".join(out)


def _number(text: str):
    n = int(text)
    return n if -(2**63) <= n < 2**63 else float(n)


def _refuse(name: str):
    raise ValueError(name)


def load(text: str | None):
    """An object (list of pairs) or array (tuple), without null, true and false.

    Raises ValueError unless the text is JSON with a container on top and at
    most six containers inside each other.
    """
    if text is None:
        raise ValueError("no text")
    source = without_comments(text) if "/" in text else text
    try:
        tree = json.loads(source, object_pairs_hook=lambda p: [(k.encode()[:KEY_BYTES].decode("utf-8", "ignore"), v) for k, v in p] or _Empty(), parse_int=_number, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    return _container(tree, text.lstrip(), 1)


class _Empty(list):
    """An empty object, as told from an empty array."""


def _container(tree, text: str = "", depth: int = 1):
    if depth > MOST_NESTED:
        raise ValueError("nested too deeply")
    if isinstance(tree, _Empty):
        return tree
    if not isinstance(tree, list):
        raise ValueError("no container on top")
    if tree and all(isinstance(v, tuple) and len(v) == 2 and isinstance(v[0], str) for v in tree):
        return [(k, _container(v, "", depth + 1) if isinstance(v, list) else v) for k, v in tree if v is not None and not isinstance(v, bool)] or _Empty()
    return tuple(_container(v, "", depth + 1) if isinstance(v, list) else v for v in tree if v is not None and not isinstance(v, bool))


def valid(text: str | None) -> bool:
    try:
        load(text)
    except ValueError:
        return False
    return True


def dump(tree) -> str:
    """Compact text that keeps the order of members."""
    if isinstance(tree, tuple):
        return "[" + ",".join(map(dump, tree)) + "]"
    if isinstance(tree, list):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in tree) + "}"
    return json.dumps(tree, ensure_ascii=False)


def _value(v) -> tuple:
    """(type, int, double, string) of a member."""
    if isinstance(v, str):
        return (values.STR, None, None, v)
    if isinstance(v, int):
        return (values.INT, v, None, None)
    return (values.DOUBLE, None, v, None) if isinstance(v, float) else (values.RECORD, None, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``rows_of`` as Arrow columns."""
    column = lambda k, kind: pa.array([r[k] for r in rows], kind)
    value = lambda k, kind: pa.array([r[6][k] for r in rows], kind)
    none = lambda kind: pa.nulls(len(rows), kind)
    tval = pa.StructArray.from_arrays([value(0, pa.int8()), value(1, pa.int64()), value(2, pa.float64()), none(pa.string()), value(3, pa.string()), none(pa.binary()), none(pa.int64())], ["t", "i", "d", "x", "s", "b", "r"])
    columns = [column(0, pa.int64()), column(1, pa.int32()), column(2, pa.int32()), column(3, pa.int32()), column(4, pa.string()), column(5, pa.bool_()), tval, column(7, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "parent", "ord", "key", "element", "value", "subtree"])


def rows_of(doc_id: int, tree) -> Iterator[tuple]:
    """The rows of one document; its own container is node 0.

    A member of an object is one row; an element of an array that is a
    member's value is a row with that key and ``element`` true.
    """
    count = 0

    def walk(node: int, tree) -> Iterator[tuple]:
        nonlocal count
        for ord_, item in enumerate(tree):
            key, v = item if isinstance(tree, list) else (None, item)
            inner = None
            if isinstance(v, (list, tuple)):
                count += 1
                inner = count
            if key is not None:
                yield (doc_id, inner if inner is not None else -1, node, ord_, key, False, _value(v), dump(v) if inner is not None else None)
                if isinstance(v, tuple):
                    for k, e in enumerate(v):
                        yield (doc_id, -1, inner, k, key, True, _value(e), dump(e) if isinstance(e, (list, tuple)) else None)
            if inner is not None:
                yield from walk(inner, v)

    yield from walk(0, tree)


def shred(docs: DataFrame, id_col: str = "doc_id", text_col: str = "doc") -> DataFrame:
    """The key and value table of all valid documents; others have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    out += rows_of(doc_id, load(text.as_py()))
                except ValueError:
                    continue
                if len(out) >= 50_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, KV_SCHEMA)


def is_valid(text: Column) -> Column:
    """Whether a text is JSON with a container on top, not nested too deeply."""

    @F.arrow_udf("boolean")
    def check(texts: pa.Array) -> pa.Array:
        return pa.array([valid(t) for t in texts.to_pylist()], pa.bool_())

    return check(text)


def printed(text: Column) -> Column:
    """The document as stored, in member order; NULL if it isn't valid."""

    def one(text: str | None) -> str | None:
        try:
            return dump(load(text))
        except ValueError:
            return None

    @F.arrow_udf("string")
    def show(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return show(text)


def _stored(value):
    """A Python list or dict as documents keep it."""
    if isinstance(value, (dict, list, tuple)):
        return _container(json.loads(json.dumps(value), object_pairs_hook=lambda p: list(p) or _Empty()))
    return value


def clause(key: str, value) -> Column:
    """Whether a row of the table holds ``key`` with ``value``.

    A list or dict value is compared as a whole, members in order; any other
    value also matches as an element of an array under that key.
    """
    value = _stored(value)
    same = F.col("subtree").eqNullSafe(dump(value)) if isinstance(value, (list, tuple)) else F.col("value") == values.of_python(value)
    return (F.col("key") == key) & same


def find(kv: DataFrame, query: dict) -> DataFrame:
    """Ids of the documents that hold every key and value of ``query``, at any depth.

    All clauses are answered in one pass over the table: rows that meet none
    are left out, and what is left is reduced per document before the shuffle.
    """
    if not query:
        return kv.select("doc_id").distinct()
    hits = [clause(k, v) for k, v in query.items()]
    met = kv.where(reduce(lambda a, b: a | b, hits)).select("doc_id", *[h.alias(f"h{n}") for n, h in enumerate(hits)])
    every = reduce(lambda a, b: a & b, [F.col(f"h{n}") for n in range(len(hits))])
    return met.groupBy("doc_id").agg(*[F.max(f"h{n}").alias(f"h{n}") for n in range(len(hits))]).where(every).select("doc_id")


def may_hold(text: Column, query: dict) -> Column:
    """Whether a document's text can hold the keys and plain values of ``query``; never false for one that does.

    A text with a backslash may spell anything in escapes, so it always can.
    """
    there = lambda part: F.contains(text, F.lit(part))
    tests = []
    for key, value in query.items():
        if len(key.encode()) < KEY_BYTES - 3:  # longer ones may be cut
            tests.append(there(json.dumps(key, ensure_ascii=False)))
        if isinstance(value, str):
            tests.append(there(json.dumps(value, ensure_ascii=False)))
        elif isinstance(value, int) and not isinstance(value, bool):
            tests.append(there(str(abs(value))))
    return there("\\") | reduce(lambda a, b: a & b, tests, F.lit(True))


def search(docs: DataFrame, query: dict, id_col: str = "doc_id", text_col: str = "doc") -> DataFrame:
    """``find`` over documents that aren't shredded yet: only those that can match are."""
    return find(shred(docs.where(may_hold(F.col(text_col), query)), id_col, text_col), query)


class JsonIndex:
    """A kept key and value table: in buckets by key, each sorted by key and value.

    A query reads the buckets of its keys alone.  Documents that are added go
    to further files; the ids of those that are deleted are kept with the
    number of the change and no longer found in what was added before it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets, self.version = spark, path, buckets, 0
        self.gone: DataFrame | None = None

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "doc") -> None:
        self.version += 1
        kv = shred(docs, id_col, text_col).withColumn("__bucket", self._bucket(F.col("key"))).withColumn("__born", F.lit(self.version))
        # a common key is dealt to several tasks
        kv = kv.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(4))).repartition("__bucket", "__salt").drop("__salt")
        kv.sortWithinPartitions("__bucket", "key", "value").write.mode("append").partitionBy("__bucket").parquet(self.path)

    def delete(self, ids: DataFrame) -> None:
        """Forget the documents of ``ids`` (doc_id)."""
        self.version += 1
        died = ids.select("doc_id", F.lit(self.version).alias("died"))
        every = died if self.gone is None else self.gone.unionByName(died)
        self.gone = durable(every.groupBy("doc_id").agg(F.max("died").alias("died")))

    def table(self, keys: list[str] | None = None) -> DataFrame:
        """The rows of documents that aren't deleted, of some keys or of all."""
        rows = self.spark.read.parquet(self.path)
        if keys is not None:
            cut = [k.encode()[:KEY_BYTES].decode("utf-8", "ignore") for k in keys]
            buckets = [r[0] for r in self.spark.createDataFrame([(k,) for k in cut], "key string").select(self._bucket(F.col("key"))).distinct().collect()]
            rows = rows.where(F.col("__bucket").isin(buckets) & F.col("key").isin(cut))
        if self.gone is not None:
            rows = rows.join(self.gone, "doc_id", "left").where(F.col("died").isNull() | (F.col("__born") > F.col("died"))).drop("died")
        return rows.drop("__bucket", "__born")

    def find(self, query: dict) -> DataFrame:
        """Ids of the documents that hold every key and value of ``query``."""
        return find(self.table(list(query) or None), query)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def containing(kv: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents that hold the (doc_id, node) rows of ``nodes``."""
    return nodes.join(kv.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()


def delete(kv: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the documents of ``ids``."""
    return kv.join(ids, "doc_id", "left_anti")


def intersect(results: list[DataFrame]) -> DataFrame:
    """Row ids in every result set."""
    return reduce(DataFrame.intersect, results)


def unique(results: DataFrame) -> DataFrame:
    return results.distinct()
