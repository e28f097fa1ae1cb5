"""Exact deduplication by stateful streaming (operator 5).

Arrivals (digest, identifier, locator) flow through a Structured Streaming
aggregation whose keyed state lies in RocksDB, on disk, and never expires: per
digest it keeps the smallest identifier, the locator of that row's content
(file and row number) and the number of arrivals.  The state is then read as a
table.  On hits, that is where a digest came twice, and there alone, the full
bytes of all texts of the digest are compared; should texts differ, they are
told apart by their bytes.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import work_path, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


_OWN = "__own"
#: Digests of repeated texts that may be broadcast to find the texts themselves; beyond, texts are joined with them.
MOST_HITS, HIT_BYTES = 250_000, 64


def normalised(text: Column) -> Column:
    """White space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` such that each row has a file and a row number.

    Tables read from Parquet have them; anything else is written once to the
    shared folder.  A column of the name that Spark keeps for them is renamed;
    ``own_columns`` gives it back.
    """
    if "_metadata" not in map(str.lower, docs.columns):
        try:
            docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
            return docs
        except AnalysisException:
            pass
    return written(docs.toDF(*[_OWN + c if c.lower() == "_metadata" else c for c in docs.columns]), "located")


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, by their own names, of ``located(docs)``."""
    return [F.col(f"`{_OWN}{c}`").alias(c) if c.lower() == "_metadata" else F.col(f"`{c}`") for c in docs.columns]


def _arrivals(docs: DataFrame, id_col: str, text_col: str, digest_chars: int) -> DataFrame:
    sha = F.sha2(normalised(F.col(text_col)), 256)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), sha.alias("text_sha256"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.withColumn("digest", F.substring("text_sha256", 1, digest_chars))


def _first(null_last: str = "doc_id") -> Column:
    """The row that stays: smallest id, nulls last, then by place."""
    return F.min(F.struct(F.col(null_last).isNull().alias("no_id"), F.col(null_last).alias("keep_id"), F.col("file").alias("keep_file"), F.col("row").alias("keep_row")))


def stream_state(arrivals_path: str, schema, spark, checkpoint: str, files_per_trigger: int = 64) -> DataFrame:
    """Run all arrivals through the stateful stream; return its state.

    A later run with the same ``checkpoint`` goes on from that state with the
    files that have come since.
    """
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(arrivals_path)
        seen = arrivals.groupBy("digest").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    first, n = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), F.col(f"{first}.keep_id"), F.col(f"{first}.keep_file"), F.col(f"{first}.keep_row"), F.col(n).alias("group_size"))


def _decide(docs: DataFrame, id_col: str, text_col: str, digest_chars: int, files_per_trigger: int) -> DataFrame:
    """A row per row of ``docs``, which are located: doc_id, text_sha256, file, row, keep_*, group_size."""
    spark = docs.sparkSession
    path = work_path(spark, "arrivals")
    arrivals = _arrivals(docs, id_col, text_col, digest_chars)
    arrivals.write.parquet(path)
    schema = arrivals.schema
    arrivals = spark.read.schema(schema).parquet(path)
    if not arrivals.inputFiles() or arrivals.isEmpty():
        return arrivals.select("doc_id", "text_sha256", "file", "row", "digest", F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), F.col("row").alias("group_size"))
    state = stream_state(path, schema, spark, work_path(spark, "dedup-state"), files_per_trigger)

    # hits: where a digest came again, the full bytes of its texts, least against greatest, reduced before the shuffle
    hits = state.where("group_size > 1").select("digest")
    count = hits.count()
    texts = docs.select(normalised(F.col(text_col)).alias("bytes"), F.col(id_col).cast("bigint").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    texts = texts.withColumn("digest", F.substring(F.sha2("bytes", 256), 1, digest_chars))
    # the bound is proven by the count: at most MOST_HITS digests of HIT_BYTES bytes
    again = texts.join(F.broadcast(hits) if count <= MOST_HITS else hits.hint("merge"), "digest", "left_semi")
    differ = again.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest")).where("least <> greatest").select("digest")
    differ = written(differ, "differing")
    groups = arrivals.join(state, "digest")
    if differ.isEmpty():
        return groups
    # a digest with differing texts: groups by the bytes themselves
    own = texts.join(differ, "digest", "left_semi").groupBy("digest", "bytes").agg(_first().alias("first"), F.count(F.lit(1)).alias("group_size"))
    again = texts.join(differ, "digest", "left_semi").join(own, ["digest", "bytes"]).select("digest", "doc_id", F.sha2("bytes", 256).alias("text_sha256"), "file", "row", "first.keep_id", "first.keep_file", "first.keep_row", "group_size")
    return groups.join(differ, "digest", "left_anti").unionByName(again)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, files_per_trigger: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same once each run of white space is one
    space; null counts as empty.  Of equal texts the smallest doc_id stays; a
    null id loses to any other, and of rows that repeat an id with its text
    exactly one stays, the first by file and row.  ``digest_chars`` shortens
    the digest of the state (tests use it to force collisions).  Hot texts are
    pre-aggregated in each task; the narrow join back is one that Spark splits
    where it is skewed.  An empty table gives no row.
    """
    rows = _decide(located(docs), id_col, text_col, digest_chars, files_per_trigger)
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The filter is by content locator, so it also holds for repeated ids.
    """
    rows = located(docs)
    stays = _decide(rows, id_col, text_col, 64, 64).where("file = keep_file and row = keep_row").select(F.col("file").alias("__stays_file"), F.col("row").alias("__stays_row"))
    placed = rows.select(*own_columns(docs), F.col("_metadata.file_path").alias("__at_file"), F.col("_metadata.row_index").alias("__at_row"))
    left = placed.join(stays, (F.col("__at_file") == F.col("__stays_file")) & (F.col("__at_row") == F.col("__stays_row")), "left_semi")
    return left.drop("__at_file", "__at_row")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
