"""Spaces of records: scans, cursors, snapshots that change, links.

A space is a DataFrame with a row id column.  Every change gives a new
snapshot; the old one stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans import predicates
from .durable import durable

NOTDATA = 1  # the meta bit of records that scans don't show


class LinkedError(ValueError):
    """A record that others refer to can't be deleted."""


def with_rids(df: DataFrame, name: str = "rid", start: int = 0) -> DataFrame:
    """Row ids in order of the rows' content: stable over rereads, without a single-task sort.

    Rows are range-partitioned and sorted, and kept so: each partition's first
    id comes from one count per partition, and the ids are given to the very
    rows that were counted.
    """
    spark = df.sparkSession
    keys = df.columns
    ordered = df.repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)
    ordered = durable(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["__part"]: r["n"] for r in ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, firsts = start, []
    for part in sorted(counts):
        firsts.append((part, base))
        base += counts[part]
    if not firsts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    # one row a partition
    table = F.broadcast(spark.createDataFrame(firsts, "__part int, __base bigint"))
    return ordered.join(table, "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


# -- scans and cursors


def scan(space: DataFrame, raw: bool = False) -> DataFrame:
    """All records, without special ones (meta bit 1) unless ``raw``."""
    if raw or "meta" not in space.columns:
        return space
    return space.where(F.coalesce("meta", F.lit(0)).bitwiseAND(F.lit(NOTDATA)) == 0)


def first(space: DataFrame, rid: str = "rid") -> DataFrame:
    return scan(space).orderBy(rid).limit(1)


def next_after(space: DataFrame, last, rid: str = "rid") -> DataFrame:
    return scan(space).where(F.col(rid) > last).orderBy(rid).limit(1)


def page(space: DataFrame, count: int, start: int = 0, rid: str = "rid") -> DataFrame:
    return scan(space).orderBy(rid).offset(start).limit(count)


def find(space: DataFrame, column: str, cond, value, last=None, rid: str = "rid") -> DataFrame:
    """The first match after row ``last``."""
    hit = predicates.condition(F.col(column), cond, value)
    return scan(space).where(hit if last is None else hit & (F.col(rid) > last)).orderBy(rid).limit(1)


def find_ordered(space: DataFrame, column: str, cond, value, last: tuple | None = None, rid: str = "rid") -> DataFrame:
    """The same in index order: by (value, row id), after the pair ``last``."""
    hit = predicates.condition(F.col(column), cond, value)
    if last is not None:
        at, row = last
        after = (F.col(column) > at) | (F.col(column).eqNullSafe(F.lit(at)) & (F.col(rid) > row)) if at is not None else F.col(column).isNotNull() | (F.col(rid) > row)
        hit = hit & after
    return scan(space).where(hit).orderBy(F.col(column).asc_nulls_first(), rid).limit(1)


class Cursor:
    """Rows of a query, one after another; ``count`` runs a count of its own."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self._rows, self._count = df, None, None

    @property
    def count(self) -> int:
        if self._count is None:
            self._count = self.df.count()
        return self._count

    rowcount = count

    def _iterator(self) -> Iterator[Row]:
        if self._rows is None:
            self._rows = self.df.toLocalIterator()
        return self._rows

    def fetchone(self) -> Row | None:
        return next(self._iterator(), None)

    def fetchall(self) -> list[Row]:
        return list(self._iterator())

    def close(self) -> None:
        self._rows = iter(())


# -- changes


def insert(space: DataFrame, rows: DataFrame, raw: bool = False) -> DataFrame:
    """Fields that new rows lack are NULL; raw records are seen by raw scans alone."""
    if raw:
        space = space if "meta" in space.columns else space.withColumn("meta", F.lit(0))
        rows = rows.withColumn("meta", F.lit(NOTDATA))
    return space.unionByName(rows, allowMissingColumns=True)


def delete_where(space: DataFrame, clauses=(), match=None) -> DataFrame:
    return space.where(~predicates.conjunction(space, list(clauses), match))


def update_where(space: DataFrame, changes: dict, clauses=(), match=None) -> DataFrame:
    """Set columns in the rows that match; a value may be a Column over the old row."""
    hit = predicates.conjunction(space, list(clauses), match)
    return space.select(*[(F.when(hit, changes[c] if isinstance(changes[c], Column) else F.lit(changes[c])).otherwise(space[c]).cast(space.schema[c].dataType).alias(c) if c in changes else space[c]) for c in space.columns])


def compare_and_swap(space: DataFrame, column: str, old, new, keys: list | None = None, rid: str = "rid") -> DataFrame:
    """Set ``column`` to ``new`` where it still is ``old`` (among row ids ``keys``)."""
    hit = F.col(column).eqNullSafe(F.lit(old))
    if keys is not None:
        hit = hit & F.col(rid).isin(keys)
    return space.withColumn(column, F.when(hit, F.lit(new)).otherwise(F.col(column)).cast(space.schema[column].dataType))


def add_all(space: DataFrame, column: str, increments: DataFrame, rid: str = "rid") -> DataFrame:
    """Add many increments (``rid``, ``delta``), summed per row before the join."""
    total = increments.groupBy(rid).agg(F.sum("delta").alias("__delta"))
    return space.join(total, rid, "left").withColumn(column, (F.col(column) + F.coalesce("__delta", F.lit(0))).cast(space.schema[column].dataType)).select(space.columns)


# -- links


def edges(space: DataFrame, links: list[str], rid: str = "rid") -> DataFrame:
    """(parent, place, child) of every link field."""
    return reduce(DataFrame.union, [space.where(F.col(c).isNotNull()).select(F.col(rid).alias("parent"), F.lit(k).alias("place"), F.col(c).alias("child")) for k, c in enumerate(links)])


def parents(space: DataFrame, links: DataFrame, of, rid: str = "rid") -> DataFrame:
    """The records that refer to one of the row ids ``of``."""
    hit = links.where(F.col("child").isin(list(of))).select(F.col("parent").alias("__parent")).distinct()
    return space.join(hit, space[rid] == hit["__parent"], "left_semi")


def follow(left: DataFrame, link: str, right: DataFrame, rid: str) -> DataFrame:
    """One hop: each row of ``left`` beside the record its link points to."""
    return left.join(right, left[link] == right[rid])


def external(space: str | Column, rid: Column) -> Column:
    """A link to a record of another space, by the space's name."""
    return F.struct((F.lit(space) if isinstance(space, str) else space).alias("space"), rid.cast("bigint").alias("rid"))


def follow_external(left: DataFrame, link: str, spaces: dict[str, DataFrame], rid: str = "rid") -> DataFrame:
    """One hop along links to several spaces: each row of ``left`` beside the record its link names."""
    tagged = [df.withColumn("__space", F.lit(name)) for name, df in spaces.items()]
    right = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    on = (left[link]["space"] == right["__space"]) & (left[link]["rid"] == right[rid])
    return left.join(right, on).drop("__space")


def chain(links: DataFrame, start: DataFrame, most: int = 100) -> DataFrame:
    """(start, rid, hops) of all records that ``start`` (rid) reaches along ``links`` (parent, child), with the fewest hops.

    A semi-naive fixpoint: a round joins only what the last one found, and
    leaves out what was reached before.  So cycles end, and however many ways
    lead to a record, it is one row.  ``most`` bounds the hops.
    """
    links = links.select("parent", "child").distinct()
    found = durable(start.select(F.col("rid").alias("start"), "rid").distinct().withColumn("hops", F.lit(0)))
    known = [found]
    for hops in range(1, most + 1):
        new = found.join(links, F.col("rid") == F.col("parent")).select("start", F.col("child").alias("rid")).distinct()
        before = reduce(DataFrame.union, known).select("start", "rid")
        found = durable(new.join(before, ["start", "rid"], "left_anti").withColumn("hops", F.lit(hops)))
        if found.isEmpty():
            break
        known.append(found)
    return reduce(DataFrame.union, known)


def delete_guarded(space: DataFrame, links: DataFrame, of: DataFrame, rid: str = "rid") -> DataFrame:
    """Delete the records with the ids of ``of`` that no record refers to; the others stay."""
    free = of.join(links.select(F.col("child").alias(of.columns[0])), of.columns[0], "left_anti")
    return space.join(free, space[rid] == free[free.columns[0]], "left_anti")


def delete_strict(space: DataFrame, links: DataFrame, of: DataFrame, rid: str = "rid") -> DataFrame:
    """The same, but any record still referred to is an error."""
    if not of.join(links.select(F.col("child").alias(of.columns[0])), of.columns[0], "left_semi").isEmpty():
        raise LinkedError("a record that others refer to can't be deleted")
    return space.join(of, space[rid] == of[of.columns[0]], "left_anti")
