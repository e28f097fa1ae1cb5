"""Ragged CSV: records of any length, quoted line ends, type inference.

Reading parses each file as a whole (a quoted field may hold a line end, so a
file can't be split); files are read in parallel.  Every field, quoted or not,
is type-inferred by a Column expression afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values


def parse(text: str) -> Iterator[list[str | None]]:
    """Records of a CSV text: blank lines are skipped, an empty field is None, CR is ignored outside quotes, the last line needs no end."""
    record: list[str | None] = []
    field: list[str] = []
    quoted = False  # whether the field has been quoted
    inside = False
    k, n = 0, len(text)
    while k <= n:
        c = text[k] if k < n else "\n"
        if inside and k < n:
            if c == '"' and text[k + 1 : k + 2] == '"':
                field.append('"')
                k += 1
            elif c == '"':
                inside = False
            else:
                field.append(c)
        elif c == '"' and not field and not quoted:
            inside = quoted = True
        elif c == "," or c == "\n":
            if c == "," or record or field or quoted:
                record.append("".join(field) if field or quoted else None)
            field, quoted, inside = [], False, False
            if c == "\n" and record:
                yield record
                record = []
        elif c != "\r":
            field.append(c)
        k += 1


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, fields) with the fields as text; NULL where empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, k, r) for k, r in enumerate(parse(bytes(content).decode("utf-8", "replace")))]
                yield pd.DataFrame(rows, columns=["path", "line", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, line bigint, fields array<string>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, fields) with the fields as tagged values."""
    return read_text(spark, path).withColumn("fields", F.transform("fields", values.infer))


def write(records: DataFrame, path: str, fields: str = "fields") -> None:
    """Write arrays of tagged values, a line each."""
    records.select(values.csv_line(F.col(fields)).alias("value")).write.text(path)
