"""Requests as the REST front end takes them: a dict or query string in, text out."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import values
from .operators import store
from .plans import predicates

# The words of the request language.
COMPARE = {"equal": "=", "not_equal": "!=", "lessthan": "<", "greater": ">", "ltequal": "<=", "gtequal": ">="}
TYPES = ("null", "int", "record", "double", "str", "char")
DEFAULT_COUNT = 100_000


def parse_params(query: str) -> list[tuple[str, str]]:
    """``a=b&c=d`` with %XX escapes; a plus sign stays one."""
    return [(unquote(k), unquote(v)) for k, _, v in (p.partition("=") for p in query.split("&") if p)]


#: Parameters that may be given several times; of others the last one counts.
REPEATED = ("field", "value", "compare", "type", "ufield", "uvalue", "rec")


def request_of(query: str) -> dict:
    """A query string as a request; repeated parameters are lists."""
    out: dict = {}
    for k, v in parse_params(query):
        if k in REPEATED:
            out.setdefault(k, []).append(v)
        else:
            out[k] = v
    return out


def _listed(request: dict, key: str) -> list:
    found = request.get(key)
    return [found] if isinstance(found, str) else list(found or [])


def guess(text: str):
    """Digits are an int, digits with one dot a double, all else a string."""
    if re.fullmatch(r"[0-9]+", text):
        return int(text)
    return float(text) if re.fullmatch(r"[0-9]+\.[0-9]*|\.[0-9]+", text) else text


def typed(text: str, kind: str | None):
    if kind is None:
        return guess(text)
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    return {"null": lambda: None, "int": lambda: int(text), "record": lambda: int(text), "double": lambda: float(text), "str": lambda: text, "char": lambda: text[:1]}[kind]()


def clauses(request: dict) -> list[predicates.Clause]:
    """Conditions of the repeated parameters field, value, compare and type."""
    fields, texts, compares, kinds = (_listed(request, k) for k in ("field", "value", "compare", "type"))
    if len(fields) != len(texts):
        raise ValueError("as many fields as values are needed")
    out = []
    for k, (f, v) in enumerate(zip(fields, texts, strict=True)):
        word = compares[k] if k < len(compares) else "equal"
        if word not in COMPARE:
            raise ValueError(f"unknown comparator {word!r}")
        out.append((int(f) if f.isdigit() else f, COMPARE[word], typed(v, kinds[k] if k < len(kinds) else None)))
    return out


def matching(space: DataFrame, request: dict, rid: str = "rid") -> DataFrame:
    """The rows that ``recids`` or the conditions name; field numbers don't count the row id."""
    if request.get("recids"):
        space = space.where(F.col(rid).isin([int(x) for x in str(request["recids"]).split(",")]))
    return predicates.select(space.select(*[c for c in space.columns if c != rid], rid), clauses(request))


def search(space: DataFrame, request: dict, rid: str = "rid") -> DataFrame:
    """Matching rows from ``from``, at most ``count`` (100,000 by default), in order of row id."""
    return matching(space, request, rid).orderBy(rid).offset(int(request.get("from", 0))).limit(int(request.get("count", DEFAULT_COUNT)))


def count(space: DataFrame, request: dict, rid: str = "rid") -> DataFrame:
    """How many rows match, all of them unless ``from`` or ``count`` is given; nothing is sorted for it."""
    n = F.greatest(F.count(F.lit(1)) - int(request.get("from", 0)), F.lit(0))
    if request.get("count") is not None:
        n = F.least(n, F.lit(int(request["count"])))
    return matching(space, request, rid).agg(n.cast("bigint").alias("count"))


def _hit(space: DataFrame, request: dict, rid: str) -> DataFrame:
    """The row ids that a change is about: every match, unless ``from`` or ``count`` is given."""
    if request.get("from") is None and request.get("count") is None:
        return matching(space, request, rid).select(rid)
    every = {"count": 2**31 - 1} | request
    return search(space, every, rid).select(rid)


def delete(space: DataFrame, request: dict, rid: str = "rid") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, number deleted)."""
    gone = _hit(space, request, rid)
    return space.join(gone, rid, "left_anti"), gone.agg(F.count(F.lit(1)).alias("deleted"))


def changes_of(space: DataFrame, request: dict, rid: str = "rid") -> dict:
    """Column values of the repeated parameters ufield and uvalue (or fld and fldvalue); a field is a number or a name."""
    names = [c for c in space.columns if c != rid]
    fields, texts = _listed(request, "ufield") or _listed(request, "fld"), _listed(request, "uvalue") or _listed(request, "fldvalue")
    if not fields or len(fields) != len(texts):
        raise ValueError("as many fields as values are needed")
    return {names[int(f)] if f.isdigit() else f: typed(x, request.get("fldtype")) for f, x in zip(fields, texts, strict=True)}


def update(space: DataFrame, request: dict, rid: str = "rid") -> DataFrame:
    """Set fields in the rows that a search finds."""
    changes = changes_of(space, request, rid)
    if request.get("recids") or request.get("from") is not None or request.get("count") is not None:
        ids = _hit(space, request, rid).withColumn("__hit", F.lit(True))
        marked = space.join(ids, rid, "left")
        new = {c: F.when(F.col("__hit"), F.lit(x)).otherwise(space[c]).cast(space.schema[c].dataType) for c, x in changes.items()}
        return marked.select(*[new[c].alias(c) if c in new else space[c] for c in space.columns])
    return store.update_where(space, changes, clauses({k: x for k, x in request.items() if k != "fldtype"}))


def records_of(request: dict) -> list[list]:
    """The records of the repeated parameter rec: ``1,a,2.5`` or a JSON array.

    With ``types=yes`` a string's prefix up to a colon names its type.
    """
    import json

    out = []
    for text in _listed(request, "rec"):
        items = json.loads(text) if text.startswith("[") else [guess(x) for x in text.split(",")]
        if not all(x is None or isinstance(x, (str, int, float)) and not isinstance(x, bool) for x in items):
            raise ValueError("a record holds numbers, strings and null only")
        out.append([_prefixed(x) if request.get("types") == "yes" and isinstance(x, str) else x for x in items])
    if not out:
        raise ValueError("no record to insert")
    return out


def _prefixed(text: str):
    kind, colon, rest = text.partition(":")
    names = {"s": "str", "i": "int", "d": "double", "r": "record", "c": "char", "n": "null"}
    return typed(rest, names.get(kind, kind)) if colon and names.get(kind, kind) in TYPES else text


def new_rows(space: DataFrame, request: dict, rid: str = "rid") -> tuple[DataFrame, list[int]]:
    """(the new records as rows, their row ids); fields that a record lacks are NULL."""
    fields = [f for f in space.schema.fields if f.name != rid]
    records = records_of(request)
    if any(len(r) > len(fields) for r in records):
        raise ValueError(f"a record has {len(fields)} fields at most")
    last = space.agg(F.max(rid)).first()[0]
    start = 0 if last is None else last + 1
    ids = list(range(start, start + len(records)))
    text = [(i, *(None if x is None else str(x) for x in r + [None] * (len(fields) - len(r)))) for i, r in zip(ids, records, strict=True)]
    rows = space.sparkSession.createDataFrame(text, T.StructType([T.StructField(rid, T.LongType()), *[T.StructField(f.name, T.StringType()) for f in fields]]))
    return rows.select(*[F.col(c).cast(space.schema[c].dataType).alias(c) for c in space.columns]), ids


def insert(space: DataFrame, request: dict, rid: str = "rid") -> DataFrame:
    """The space with the new records of ``rec``."""
    return space.unionByName(new_rows(space, request, rid)[0])


def json_value(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = values.short_double(column)
    elif isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = values.escape_json(column.cast("string"))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("null"))


def row_json(df: DataFrame, columns: list[str], rid: str | None = None) -> Column:
    """``[v,v,...]`` of a row, with the row id before the fields if named."""
    shown = ([rid] if rid else []) + columns
    return F.concat(F.lit("["), F.concat_ws(",", *[json_value(df[c], df.schema[c].dataType) for c in shown]), F.lit("]"))


def search_json(space: DataFrame, request: dict, rid: str = "rid") -> DataFrame:
    """One JSON array per row found; CSV lines with format=csv."""
    found = search(space, request, rid)
    columns = [c for c in found.columns if c != rid]
    if request.get("format") == "csv":
        quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        text = [F.coalesce(quoted(found[c]) if isinstance(found.schema[c].dataType, T.StringType) else found[c].cast("string"), F.lit("")) for c in columns]
        return found.select(F.col(rid), F.concat_ws(",", *text).alias("line"))
    return found.select(F.col(rid), row_json(found, columns, rid if request.get("showid") in ("yes", "1", True) else None).alias("line"))


def _wrapped(text: str, request: dict) -> str:
    return f"{request['jsonp']}({text});" if request.get("jsonp") else text


def respond(space: DataFrame, request: dict | str, rid: str = "rid") -> str:
    """The whole response text of a reading request; ``jsonp`` wraps it in a call."""
    request = request_of(request) if isinstance(request, str) else request
    op = request.get("op", "search")
    if op == "count":
        text = str(count(space, request, rid).first()[0])
    elif op in ("search", "select"):
        lines = [r.line for r in search_json(space, request, rid).orderBy(rid).collect()]
        text = "\n".join(lines) if request.get("format") == "csv" else "[" + ",\n".join(lines) + "]"
    else:
        raise ValueError(f"unknown operation {op!r}")
    return _wrapped(text, request)


class Service:
    """Requests over named spaces: reading ones, and those that change or make a space.

    ``db`` names the space (1000 by default).  Changes go through a
    connection, so that its lock, its journal and its layouts are kept.
    """

    DEFAULT_DB = "1000"

    def __init__(self, spark) -> None:
        self.spark = spark

    def handle(self, request: dict | str) -> str:
        from . import api

        request = request_of(request) if isinstance(request, str) else request
        op, name = request.get("op", "search"), f"db{int(request.get('db', self.DEFAULT_DB))}"
        if op == "create":
            width = int(request.get("fields", 3))
            api.create(name, self.spark.createDataFrame([], ", ".join(["rid bigint", *[f"f{k} string" for k in range(width)]])))
            return _wrapped("1", request)
        space = api.attach(name)
        if op == "drop":
            api.drop(name)
            return _wrapped("1", request)
        if op == "insert":
            with space.writing():
                rows, ids = new_rows(space.records, request)
                space.add_rows(rows)
            return _wrapped("[" + ",".join(map(str, ids)) + "]", request)
        if op in ("update", "delete"):
            hit = _hit(space.records, request, "rid")
            n = space.delete_rows(hit) if op == "delete" else space.update_rows(hit, changes_of(space.records, request))
            return _wrapped(str(n), request)
        return respond(space.records, request)
