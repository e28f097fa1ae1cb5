"""Triples: N-Triples files in and out, statements as (predicate, subject, object)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values

BLANK_PREFIX = "urn:local:"
_NODE = r'(?:<([^>]*)>|_:([A-Za-z0-9]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)'
_LINE = rf"^\s*{_NODE}\s+{_NODE}\s+{_NODE}\s*\.\s*$"


def split_uri(text: Column) -> tuple[Column, Column]:
    """(prefix, rest): the prefix goes up to the last colon, slash or number sign."""
    return F.regexp_extract(text, r"^(.*[:/#])", 1), F.regexp_extract(text, r"^(?:.*[:/#])?(.*)$", 1)


def _node(line: Column, k: int) -> Column:
    part = lambda n: F.regexp_extract(line, _LINE, 5 * k + n)
    prefix, rest = split_uri(part(1))
    literal = F.replace(F.replace(part(3), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(part(1) != "", values.uri(rest, prefix)).when(part(2) != "", values.uri(part(2), F.lit(BLANK_PREFIX))).when(part(5) != "", values.xmlliteral(literal, part(5))).otherwise(values.string(literal))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(predicate, subject, object, lang) of each statement line."""
    line = F.col("value")
    rows = spark.read.text(path).where(line.rlike(_LINE))
    return rows.select(_node(line, 1).alias("predicate"), _node(line, 0).alias("subject"), _node(line, 2).alias("object"), F.nullif(F.regexp_extract(line, _LINE, 14), F.lit("")).alias("lang"))


def text_of(value: Column, lang: Column | None = None) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value["s"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    tag = F.lit("") if lang is None else F.coalesce(F.concat(F.lit("@"), lang), F.lit(""))
    return (
        F.when(value["t"] == values.URI, F.concat(F.lit("<"), value["x"], value["s"], F.lit(">")))
        .when(value["t"] == values.STR, F.concat(quoted, tag))
        .when(value["t"] == values.XMLLITERAL, F.concat(quoted, F.lit("^^<"), value["x"], F.lit(">")))
        .otherwise(F.raise_error(F.lit("only URIs and literals can be exported")).cast("string"))
    )


def statement(predicate: Column, subject: Column, obj: Column, lang: Column | None = None) -> Column:
    return F.concat(text_of(subject), F.lit(" "), text_of(predicate), F.lit(" "), text_of(obj, lang), F.lit(" ."))


def write(triples: DataFrame, path: str) -> None:
    lang = F.col("lang") if "lang" in triples.columns else None
    triples.select(statement(F.col("predicate"), F.col("subject"), F.col("object"), lang).alias("value")).write.text(path)
