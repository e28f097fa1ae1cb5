"""Physical layouts that serve as indexes, and the choice among them.

A sorted layout makes Parquet's row-group statistics narrow, so that a pushed
range reads few groups; a hashed layout is partitioned by a bucket of its
columns, so that a lookup reads one folder; a partial layout holds the rows of
a match record only.  A layout never changes which rows match.

Layouts follow changes of their space: new rows are appended to their files, each
with the number of the change, and the ids of rows that went are kept with the
number of theirs; a row counts if no later change took its id away.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import delete_path, durable
from . import predicates

# Scores of the access path choice.
EQUAL_SCORE, BOUND_SCORE, NULL_SCORE, TEMPLATE_SCORE = 5, 2, -1, 5
#: Bytes that a bucket should have, the most buckets, and tasks that write one bucket.
BUCKET_BYTES, MOST_BUCKETS, SALTS = 64 << 20, 10_000, 4


@dataclass(frozen=True)
class Layout:
    path: str
    kind: str  # "sorted" or "hashed"
    columns: tuple[str, ...]
    buckets: int = 0
    template: tuple[tuple[str, object], ...] = ()


BORN = "__born"  # the number of the change that wrote a row of a layout


@dataclass
class Catalog:
    """The layouts of one space, and the space itself."""

    base: DataFrame
    layouts: list[Layout] = field(default_factory=list)
    version: int = 0
    gone: DataFrame | None = None  # (rid, died): ids that went, and the last change that took them

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    def _write(self, layout: Layout, rows: DataFrame, parts: int = 0, mode: str = "error") -> None:
        """Write rows, those that the template matches, in a layout's order."""
        if layout.template:
            rows = predicates.select(rows, match=dict(layout.template))
        rows = rows.withColumn(BORN, F.lit(self.version).cast("bigint"))
        column = layout.columns[0]
        if layout.kind == "sorted":
            # by all columns after the first, so that a value of very many rows is split too
            keys = [column, F.xxhash64(*[c for c in rows.columns if c != column])]
            rows = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
            rows.sortWithinPartitions(column).write.mode(mode).parquet(layout.path)
        else:
            bucket = F.pmod(F.xxhash64(*layout.columns), F.lit(layout.buckets)).cast("int")
            # a few tasks a bucket: a key of very many rows is not one task's
            salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
            rows = rows.withColumn("__bucket", bucket).withColumn("__salt", salt)
            rows.repartition("__bucket", "__salt").drop("__salt").write.mode(mode).partitionBy("__bucket").parquet(layout.path)

    def add_sorted(self, path: str, column: str, parts: int = 0, template: dict | None = None) -> Layout:
        layout = Layout(path, "sorted", (column,), 0, tuple((template or {}).items()))
        self._write(layout, self.base, parts)
        return self._keep(layout)

    def add_hashed(self, path: str, columns: list[str], buckets: int = 0, template: dict | None = None) -> Layout:
        """``buckets`` 0 makes them of about BUCKET_BYTES, by the size that Spark estimates."""
        if not 1 <= len(columns) <= 10:
            raise ValueError("a hashed layout has one to ten columns")
        if not buckets:
            size = int(str(self.base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            buckets = min(max(-(-size // BUCKET_BYTES), 16), MOST_BUCKETS)
        layout = Layout(path, "hashed", tuple(columns), buckets, tuple((template or {}).items()))
        self._write(layout, self.base)
        return self._keep(layout)

    def follow(self, base: DataFrame, new: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Keep the layouts right after a change: ``new`` rows, and ids (rid) of those that went.

        A row that changed is in both.  ``base`` is the space afterwards.
        """
        self.base, self.version = base, self.version + 1
        if not self.layouts:
            return
        if gone is not None:
            died = gone.select("rid", F.lit(self.version).cast("bigint").alias("died"))
            every = died if self.gone is None else self.gone.unionByName(died)
            self.gone = durable(every.groupBy("rid").agg(F.max("died").alias("died")))
        if new is not None:
            for layout in self.layouts:
                self._write(layout, new.select(base.columns), mode="append")

    def _living(self, rows: DataFrame) -> DataFrame:
        if self.gone is not None:
            rows = rows.join(self.gone, "rid", "left").where(F.col("died").isNull() | (F.col(BORN) >= F.col("died")))
        return rows.select(self.base.columns)

    def _keep(self, layout: Layout) -> Layout:
        self.layouts.append(layout)
        return layout

    def drop(self, layout: Layout) -> None:
        """Forget a layout and delete its files."""
        self.layouts.remove(layout)
        delete_path(self.spark, layout.path)

    def dump(self, layout: Layout) -> DataFrame:
        """What a layout's files hold: file, rows, and the least and greatest value of its first column."""
        rows = self.spark.read.parquet(layout.path).select(F.col("_metadata.file_name").alias("file"), F.col(layout.columns[0]).alias("value"))
        return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("least"), F.max("value").alias("greatest"))

    def lookup(self, columns: list[str], kind: str | None = None) -> Layout | None:
        return next((x for x in self.layouts if x.columns == tuple(columns) and kind in (None, x.kind)), None)

    def choose(self, clauses: list[predicates.Clause]) -> Layout | None:
        """The layout with the best score for a conjunction, or None for the base."""
        equal = {c: v for c, cond, v in clauses if predicates.code(cond) == predicates.EQUAL}
        best, chosen = 0, None
        for x in self.layouts:
            if any(c not in equal or equal[c] != v for c, v in x.template):
                continue  # the query doesn't imply the template
            score = TEMPLATE_SCORE * len(x.template)
            if x.kind == "hashed":
                if any(c not in equal for c in x.columns):
                    continue
                score += EQUAL_SCORE * len(x.columns)
            else:
                mine = [(predicates.code(k), v) for c, k, v in clauses if c == x.columns[0] and predicates.code(k) != predicates.NOT_EQUAL]
                if not mine and not x.template:
                    continue
                score += sum((EQUAL_SCORE if k == predicates.EQUAL else BOUND_SCORE) + (NULL_SCORE if v is None else 0) for k, v in mine)
            if score > best:
                best, chosen = score, x
        return chosen

    def select(self, clauses: list[predicates.Clause] = (), match=None, limit: int | None = None, ordered: bool = False) -> DataFrame:
        """The matching rows, by the best layout; ``ordered`` gives its index order."""
        every = [*predicates.match_clauses(self.base, match), *clauses]
        layout = self.choose(every)
        if layout is None:
            return predicates.select(self.base, every, limit=limit)
        rows = self.spark.read.parquet(layout.path)
        if layout.kind == "hashed":
            equal = {c: v for c, k, v in every if predicates.code(k) == predicates.EQUAL}
            key = F.xxhash64(*[F.lit(equal[c]).cast(self.base.schema[c].dataType) for c in layout.columns])
            rows = rows.where(F.col("__bucket") == F.pmod(key, F.lit(layout.buckets)).cast("int"))
        order = F.col(layout.columns[0]).asc_nulls_first() if ordered and layout.kind == "sorted" else None
        # conditions first: ids that went are looked up for rows that match alone
        named = [(self.base.columns[c] if isinstance(c, int) and c < len(self.base.columns) else c, k, v) for c, k, v in every]
        return predicates.select(self._living(predicates.select(rows, named)), limit=limit, order_by=order)
