"""The journal as a stream: changes are applied as its files come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshot import JOURNAL


def read(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(journal: DataFrame) -> DataFrame:
    """The last change of each field, as a stateful aggregation."""
    return journal.groupBy("rid", "col").agg(F.max_by(F.struct("op", "val"), "seq").alias("last"), F.max("seq").alias("seq")).select("rid", "col", "last.op", "last.val", "seq")


def run_to(journal: DataFrame, path: str, checkpoint: str) -> None:
    """Append the stream's changes to a table, exactly once."""
    journal.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
