"""A database-like front: named spaces, a connection, cursors, logging.

A space is a DataFrame with a ``rid`` column; each change replaces it by a new
snapshot.  With logging on, changes also go to a journal of Parquet files that
``snapshot.replay`` applies to any earlier snapshot.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .operators import store
from .operators.durable import durable
from .plans import predicates
from .plans.layout import Catalog, Layout
from .sources import snapshot

_SPACES: dict[str, DataFrame] = {}
_LOCKS: dict[str, threading.RLock] = {}
#: Seconds that a writer waits for another one.
LOCK_SECONDS = 2.0


class LockedError(RuntimeError):
    """Another connection is writing to the space."""


# -- constructors of structured records


def triple(subject, prop, obj):
    return F.struct(values.of_python(subject).alias("subject"), values.of_python(prop).alias("property"), values.of_python(obj).alias("object"))


def kvpair(key, value):
    """A triple whose subject is NULL."""
    return triple(None, key, value)


def array(*items):
    return F.array(*[values.of_python(x) for x in items])


def json_object(**members):
    return F.array(*[kvpair(k, x) for k, x in members.items()])


# -- spaces


def create(name: str, df: DataFrame) -> Connection:
    """A new space from a table; rows get ids unless it has a ``rid`` column."""
    if name in _SPACES:
        raise ValueError(f"there is a space {name!r} already")
    _SPACES[name] = df if "rid" in df.columns else store.with_rids(df)
    _LOCKS[name] = threading.RLock()
    return Connection(name)


def attach(name: str) -> Connection:
    if name not in _SPACES:
        raise KeyError(f"there is no space {name!r}")
    return Connection(name)


def drop(name: str) -> None:
    _SPACES.pop(name, None)
    _LOCKS.pop(name, None)


def load(name: str, spark: SparkSession, path: str) -> Connection:
    """A space from a dump, checked against its manifest."""
    return create(name, snapshot.restore(spark, path, verify=True))


class Connection:
    """One writer's view of a space.

    Any number of connections read; one at a time writes.  A change waits for
    the lock of the space for a while and raises ``LockedError`` then;
    ``writing`` holds it over several changes.
    """

    def __init__(self, name: str) -> None:
        self.name, self._log, self._catalog = name, None, None

    @property
    def records(self) -> DataFrame:
        return _SPACES[self.name]

    @contextmanager
    def writing(self) -> Iterator[Connection]:
        lock = _LOCKS[self.name]
        if not lock.acquire(timeout=LOCK_SECONDS):
            raise LockedError(f"another connection is writing to {self.name!r}")
        try:
            yield self
        finally:
            lock.release()

    def _set(self, df: DataFrame, new: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """A new snapshot; layouts follow by the rows that came (``new``) and the ids of those that went (``gone``)."""
        _SPACES[self.name] = durable(df)  # a snapshot of its own, whatever the old one was made of
        if self._catalog is not None:
            if new is None and gone is None:
                self._catalog = None
            else:
                self._catalog.follow(self.records, new, gone)

    # queries

    def query(self, arglist=(), matchrec=None, limit: int | None = None) -> store.Cursor:
        return store.Cursor(predicates.select(store.scan(self.records), list(arglist), matchrec, limit))

    def find(self, column: str, cond, value, last=None):
        """The first matching row after ``last``, or None."""
        return store.find(self.records, column, cond, value, last).first()

    def get(self, rid: int):
        return self.records.where(F.col("rid") == rid).first()

    def size(self) -> int:
        return store.scan(self.records).count()

    # changes

    def insert(self, rows: list[dict] | DataFrame) -> None:
        """Add rows; ids follow the largest there is, in order of the rows of a list."""
        with self.writing():
            last = self.records.agg(F.max("rid")).first()[0]
            start = 0 if last is None else last + 1
            if isinstance(rows, DataFrame):
                self.add_rows(store.with_rids(rows, start=start))
            else:
                self.add_rows(self.records.sparkSession.createDataFrame([tuple(start + k if f == "rid" else r.get(f) for f in self.records.columns) for k, r in enumerate(rows)], self.records.schema))

    def add_rows(self, new: DataFrame) -> None:
        """Add rows that have ids of their own."""
        with self.writing():
            new = durable(new)
            self._set(store.insert(self.records, new), new=store.insert(self.records.limit(0), new))
            self._journal(new, snapshot.CREATE)
            self._journal(new, snapshot.SET)

    def update(self, changes: dict, arglist=(), matchrec=None) -> int:
        return self.update_rows(self.records.where(predicates.conjunction(self.records, list(arglist), matchrec)).select("rid"), changes)

    def update_rows(self, ids: DataFrame, changes: dict) -> int:
        """Set columns of the rows with the ids of ``ids`` (rid); how many there were."""
        with self.writing():
            ids = durable(ids)
            old = self.records.join(ids, "rid", "left_semi")
            new = durable(store.update_where(old, changes).select(self.records.columns))
            self._set(self.records.join(ids, "rid", "left_anti").select(self.records.columns).unionByName(new), new=new, gone=ids)
            self._journal(new.select("rid", *changes), snapshot.SET)
            return ids.count()

    def delete(self, arglist=(), matchrec=None, links: DataFrame | None = None) -> int:
        """Delete the matches; with ``links`` those that others refer to are an error."""
        return self.delete_rows(self.records.where(predicates.conjunction(self.records, list(arglist), matchrec)).select("rid"), links)

    def delete_rows(self, ids: DataFrame, links: DataFrame | None = None) -> int:
        """Delete the rows with the ids of ``ids`` (rid); how many there were."""
        with self.writing():
            gone = durable(ids)
            left = store.delete_strict(self.records, links, gone.withColumnRenamed("rid", "gone_rid")) if links is not None else self.records.join(gone, "rid", "left_anti").select(self.records.columns)
            self._set(left, gone=gone)
            self._journal(gone, snapshot.DELETE)
            return gone.count()

    # logging

    def start_logging(self, path: str) -> None:
        self._log = path

    def stop_logging(self) -> None:
        self._log = None

    def _next_seq(self) -> int:
        """One more than the largest number in the log, whoever wrote it."""
        spark = self.records.sparkSession
        try:
            last = spark.read.schema(snapshot.JOURNAL).parquet(self._log).agg(F.max("seq")).first()[0]
        except AnalysisException:  # no log yet
            last = None
        return 1 if last is None else last + 1

    def _journal(self, rows: DataFrame, op: str) -> None:
        if self._log is None:
            return
        base = F.lit(self._next_seq()).cast("bigint")
        if op == snapshot.SET:
            columns = [c for c in rows.columns if c != "rid"]
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in columns]))
            events = rows.select("rid", pairs.alias("p")).select(base.alias("seq"), F.lit(op).alias("op"), "rid", "p.col", "p.val")
        else:
            events = rows.select(base.alias("seq"), F.lit(op).alias("op"), "rid", F.lit(None).cast("string").alias("col"), F.lit(None).cast("string").alias("val"))
        events.write.mode("append").parquet(self._log)

    def replay_log(self, path: str) -> None:
        """Apply a journal; values are cast back to the columns' types."""
        spark, schema = self.records.sparkSession, self.records.schema
        text = self.records.select("rid", *[F.col(c).cast("string").alias(c) for c in self.records.columns if c != "rid"])
        after = snapshot.replay(text, spark.read.schema(snapshot.JOURNAL).parquet(path))
        with self.writing():
            self._set(after.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))

    def dump(self, path: str) -> None:
        snapshot.dump(self.records, path)

    # layouts

    @property
    def catalog(self) -> Catalog:
        if self._catalog is None:
            self._catalog = Catalog(self.records)
        return self._catalog

    def create_index(self, path: str, columns: list[str], hashed: bool = False, template: dict | None = None) -> Layout:
        if hashed or len(columns) > 1:
            return self.catalog.add_hashed(path, columns, template=template)
        return self.catalog.add_sorted(path, columns[0], template=template)

    def index_id(self, columns: list[str]) -> Layout | None:
        return self.catalog.lookup(columns)

    def drop_index(self, index: Layout) -> None:
        self.catalog.drop(index)

    def indexes(self) -> list[Layout]:
        return list(self.catalog.layouts)

    def info(self) -> dict:
        """Rows, columns, layouts and the bytes of the rows as Spark estimates them."""
        size = self.records._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return {"name": self.name, "rows": self.records.count(), "columns": self.records.columns, "indexes": len(self.indexes()), "bytes": int(str(size))}

    def close(self) -> None:
        self._log = self._catalog = None
