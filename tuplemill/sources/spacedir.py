"""Spaces in a folder: numbered snapshots, a lock file, index layouts.

``data-N`` is the space after its Nth change; the largest N whose write is
complete counts, so that a change shows wholly or not at all and readers of
older snapshots aren't disturbed.  A writer holds the file ``LOCK``, which any
file system creates for one writer only.  Layouts belong to the snapshot that
they were made of or follow it by its changes; their list is kept beside the data.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators.durable import delete_path, durable
from ..plans import predicates
from ..plans.layout import Catalog, Layout
from . import snapshot


class LockedError(RuntimeError):
    """Another writer holds the space."""


class SpaceDir:
    """A space below ``path``; rows have ids in the column ``rid``."""

    def __init__(self, spark: SparkSession, path: str, wait: float = 2.0, keep: int = 2) -> None:
        self.spark, self.path, self.wait, self.keep = spark, path.rstrip("/"), wait, keep

    # -- files

    def _at(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete snapshots."""
        fs = self._fs()
        if not fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at())]
        return sorted(int(n[5:]) for n in names if n.startswith("data-") and fs.exists(self._at(f"{n}/_SUCCESS")))

    @contextmanager
    def writing(self) -> Iterator[SpaceDir]:
        """Hold the lock; waits a while for another writer."""
        fs, until = self._fs(), time.monotonic() + self.wait
        fs.mkdirs(self._at())
        while not fs.createNewFile(self._at("LOCK")):
            if time.monotonic() >= until:
                raise LockedError(f"another writer holds {self.path}")
            time.sleep(0.05)
        try:
            yield self
        finally:
            fs.delete(self._at("LOCK"), False)

    # -- rows

    def exists(self) -> bool:
        return bool(self.versions())

    def records(self) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"there is no space at {self.path}")
        return self.spark.read.parquet(f"{self.path}/data-{found[-1]}")

    def create(self, df: DataFrame) -> None:
        """A new space of ``df``; rows get ids unless it has them."""
        if self.exists():
            raise ValueError(f"there is a space at {self.path} already")
        with self.writing():
            (df if "rid" in df.columns else store.with_rids(df)).write.parquet(f"{self.path}/data-1")

    def commit(self, df: DataFrame, new: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Make ``df`` the next snapshot; the lock must be held.  Layouts follow by ``new`` and ``gone``."""
        found = self.versions()
        version = (found[-1] if found else 0) + 1
        delete_path(self.spark, f"{self.path}/data-{version}")  # what a writer that died left
        catalog = self.catalog()
        df.write.parquet(f"{self.path}/data-{version}")
        if catalog.layouts:
            catalog.follow(self.records(), new, gone)
            self._save(catalog, version)
        for old in found[: -self.keep + 1 or None] if self.keep > 1 else found:
            delete_path(self.spark, f"{self.path}/data-{old}")

    def insert(self, rows: DataFrame) -> None:
        """Add rows without ids; columns that the space lacks are added to it, NULL in older rows."""
        with self.writing():
            old = self.records()
            last = old.agg(F.max("rid")).first()[0]
            new = durable(store.with_rids(rows, start=0 if last is None else last + 1))
            same = set(new.columns) <= set(old.columns)
            after = old.unionByName(new, allowMissingColumns=True)
            if not same:
                self._forget()
            self.commit(after, new=old.limit(0).unionByName(new, allowMissingColumns=True) if same else None)

    def delete(self, clauses) -> int:
        """Delete the rows that meet the conditions; how many there were."""
        with self.writing():
            old = self.records()
            gone = durable(old.where(predicates.conjunction(old, list(clauses))).select("rid"))
            self.commit(old.join(gone, "rid", "left_anti").select(old.columns), gone=gone)
            return gone.count()

    def replay(self, path: str) -> None:
        """Apply a journal; values are cast to the columns' types."""
        with self.writing():
            old = self.records()
            text = old.select("rid", *[F.col(c).cast("string").alias(c) for c in old.columns if c != "rid"])
            after = snapshot.replay(text, self.spark.read.schema(snapshot.JOURNAL).parquet(path))
            self._forget()
            self.commit(after.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields]))

    def free(self) -> None:
        delete_path(self.spark, self.path)

    # -- layouts

    def catalog(self) -> Catalog:
        """The layouts that belong to the newest snapshot."""
        found = self.versions()
        if not found:
            return Catalog(self.spark.range(0).withColumnRenamed("id", "rid"))
        catalog = Catalog(self.records())
        name = f"catalog-{found[-1]}"
        if self._fs().exists(self._at(f"{name}/_SUCCESS")):
            kept = json.loads(self.spark.read.text(f"{self.path}/{name}").first().value)
            catalog.layouts = [Layout(x["path"], x["kind"], tuple(x["columns"]), x["buckets"], tuple(map(tuple, x["template"]))) for x in kept["layouts"]]
            catalog.version = kept["version"]
            if kept["gone"]:
                catalog.gone = self.spark.read.parquet(kept["gone"])
        return catalog

    def _save(self, catalog: Catalog, version: int) -> None:
        gone = None
        if catalog.gone is not None:
            gone = f"{self.path}/gone-{uuid.uuid4().hex}"
            catalog.gone.write.parquet(gone)
        text = json.dumps({"version": catalog.version, "gone": gone, "layouts": [vars(x) for x in catalog.layouts]})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/catalog-{version}")
        # the newest two stay, for readers of the snapshot before
        fs = self._fs()
        old = sorted((s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(self._at()) if s.getPath().getName().startswith("gone-"))
        for _, path in old[:-2]:
            delete_path(self.spark, path)

    def _forget(self) -> None:
        """Delete all layouts, where a change can't be followed."""
        for layout in self.catalog().layouts:
            delete_path(self.spark, layout.path)
        for version in self.versions():
            delete_path(self.spark, f"{self.path}/catalog-{version}")

    def create_index(self, columns: list[str], hashed: bool = False) -> int:
        """The number of a new layout."""
        with self.writing():
            catalog = self.catalog()
            number = max([int(x.path.rsplit("-", 1)[1]) for x in catalog.layouts], default=0) + 1
            path = f"{self.path}/index-{number}"
            delete_path(self.spark, path)
            if hashed:
                catalog.add_hashed(path, columns)
            else:
                catalog.add_sorted(path, columns[0])
            self._save(catalog, self.versions()[-1])
            return number

    def drop_index(self, number: int) -> None:
        with self.writing():
            catalog = self.catalog()
            chosen = [x for x in catalog.layouts if x.path.endswith(f"/index-{number}")]
            if not chosen:
                raise KeyError(f"there is no index {number}")
            catalog.drop(chosen[0])
            self._save(catalog, self.versions()[-1])

    def query(self, clauses, limit: int | None = None) -> DataFrame:
        """The matching rows, by the best layout there is."""
        return self.catalog().select(list(clauses), limit=limit)
