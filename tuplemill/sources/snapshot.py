"""Snapshots with a manifest, and a journal of changes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
JOURNAL = "seq bigint, op string, rid bigint, col string, val string"
CREATE, SET, DELETE = "CRE", "SET", "DEL"


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, order-independent checksum)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum")).first()
    return row.n, int(row.sum or 0)


def dump(df: DataFrame, path: str) -> None:
    """Write the rows and a manifest (version, schema, row count, checksum) beside them."""
    spark = df.sparkSession
    df.write.parquet(f"{path}/data")
    rows, total = checksum(spark.read.parquet(f"{path}/data"))
    manifest = json.dumps({"version": VERSION, "schema": df.schema.json(), "rows": rows, "checksum": str(total)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def check(spark: SparkSession, path: str) -> bool:
    """Whether the snapshot is whole: version, schema, row count and checksum agree."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    df = spark.read.parquet(f"{path}/data")
    same = [f["name"] for f in json.loads(manifest["schema"])["fields"]] == df.columns
    return manifest["version"] == VERSION and same and (manifest["rows"], int(manifest["checksum"])) == checksum(df)


def restore(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    if verify and not check(spark, path):
        raise ValueError("the snapshot doesn't fit its manifest")
    return spark.read.parquet(f"{path}/data")


def replay(space: DataFrame, journal: DataFrame, rid: str = "rid") -> DataFrame:
    """``space`` (row id and text columns) after the journal's changes.

    The last write of each field wins; a deleted row goes, unless it was
    created again later, and what was written before a creation is forgotten.
    """
    columns = [c for c in space.columns if c != rid]
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    ends = journal.groupBy("rid").agg(last(CREATE).alias("made"), last(DELETE).alias("gone"))
    w = Window.partitionBy("rid", "col").orderBy(F.col("seq").desc())
    writes = journal.where(F.col("op") == SET).join(ends.select("rid", "made"), "rid").where("made is null or seq > made").withColumn("n", F.row_number().over(w)).where("n = 1")
    wide = writes.groupBy("rid").pivot("col", columns).agg(F.first(F.struct("val")))
    old = space.select(F.col(rid).alias("rid"), *columns, F.lit(True).alias("__old"))
    both = old.join(ends, "rid", "full").join(wide.select("rid", *[F.col(c).alias(f"__{c}") for c in columns]), "rid", "left")
    alive = F.col("gone").isNull() | (F.coalesce("made", F.lit(-1)) > F.col("gone"))
    exists = F.coalesce("__old", F.lit(False)) | F.col("made").isNotNull()
    kept = lambda c: F.when(F.col("made").isNull(), F.col(c))
    return both.where(alive & exists).select(F.col("rid").alias(rid), *[F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.val")).otherwise(kept(c)).alias(c) for c in columns])
