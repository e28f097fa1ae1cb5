"""Command line: ``python -m tuplemill SPACE COMMAND ...``.

SPACE is a folder that holds a space, or a Parquet table, which can only be read.

  help, version          this text; the version
  create COLUMNS         an empty space, columns as in ``a bigint, b string``
  free                   delete the space
  export PATH            a checked dump of the rows
  import PATH            a space from a dump
  exportcsv PATH         rows as CSV files
  importcsv PATH         add ragged CSV records as text columns f0, f1, ...
  exportrdf PATH         rows (predicate, subject, object) as N-Triples
  importrdf PATH         add N-Triples statements
  importotter PATH       add the clauses of a rule file
  importprolog PATH      the same in Prolog syntax
  runreasoner            look for a refutation of the clauses; proof ends with code 0
  replay PATH            apply a journal
  info                   rows, columns and indexes
  add VALUE ...          add a row
  select [COUNT [FROM]]  print rows
  query COL COND VAL ... print the rows that meet the conditions
  count COL COND VAL ... how many they are
  del COL COND VAL ...   delete them
  addjson FILE           add JSON documents, one a line
  findjson JSON          ids of the documents that hold the keys and values
  createindex COLUMN     a sorted layout
  createhash COLUMN ...  a hashed layout
  dropindex NUMBER       delete a layout
  listindex              list the layouts
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .plans import predicates
from .rest import guess

VERSION = "0.2"


def parse_clauses(words: list[str]) -> list[predicates.Clause]:
    """``column condition value`` three by three; values are inferred."""
    if len(words) % 3:
        raise ValueError("conditions come as column, condition, value")
    return [(int(c) if c.isdigit() else c, k, _value(v)) for c, k, v in zip(*[iter(words)] * 3, strict=True)]


def _value(word: str):
    if word == "NULL":
        return None
    if word[:1] == "-" and not isinstance(guess(word[1:]), str):
        return -guess(word[1:])
    return guess(word)


def query(df: DataFrame, words: list[str]) -> DataFrame:
    return predicates.select(df, parse_clauses(words))


def _tagged(df: DataFrame) -> DataFrame:
    """The rows' columns, without the id, as an array of tagged values."""

    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return values.integer(c)
        if kind in ("float", "double"):
            return values.double(c)
        if kind == "date":
            return values.date(values.day_number(c))
        return c if kind.startswith("struct<t:tinyint") else values.string(c.cast("string"))

    return df.select(F.array(*[one(n, k) for n, k in df.dtypes if n != "rid"]).alias("fields"))


def run(spark: SparkSession, path: str, command: str, rest: list[str], out=print) -> int:
    """One command; the exit code."""
    from .operators import jsondoc
    from .operators.rules import parser, prover
    from .sources import csvfile, snapshot, triples
    from .sources.spacedir import SpaceDir

    space = SpaceDir(spark, path)

    def put(rows: DataFrame) -> None:
        space.insert(rows) if space.exists() else space.create(rows)

    def table() -> DataFrame:
        return space.records() if space.exists() else spark.read.parquet(path)

    def show(df: DataFrame, most: int = 1000) -> None:
        out("\t".join(df.columns))
        for row in df.limit(most).toLocalIterator():
            out("\t".join("NULL" if x is None else str(x) for x in row))

    if command == "create":
        space.create(spark.createDataFrame([], f"rid bigint, {' '.join(rest)}"))
    elif command == "free":
        space.free()
    elif command == "import":
        space.create(snapshot.restore(spark, rest[0], verify=True))
    elif command == "importcsv":
        records = csvfile.read_text(spark, rest[0])
        width = records.agg(F.max(F.size("fields"))).first()[0] or 1
        put(records.select(*[F.get("fields", F.lit(k)).alias(f"f{k}") for k in range(width)]))
    elif command == "importrdf":
        put(triples.read(spark, rest[0]))
    elif command in ("importotter", "importprolog"):
        text = "\n".join(r.value for r in spark.read.text(rest[0], wholetext=True).collect())
        parsed = parser.parse_otter(text) if command == "importotter" else parser.parse_prolog(text)
        from .operators.rules import terms

        put(spark.createDataFrame([(terms.show(c),) for c in parsed], "clause string"))
    elif command == "add":
        old = space.records()
        names = [c for c in old.columns if c != "rid"]
        if len(rest) > len(names):
            raise ValueError(f"a row has {len(names)} fields at most")
        row = [None if v in ("", "NULL") else v for v in rest] + [None] * (len(names) - len(rest))
        new = spark.createDataFrame([tuple(row)], ", ".join(f"`{c}` string" for c in names))
        space.insert(new.select(*[F.col(f"`{c}`").cast(old.schema[c].dataType).alias(c) for c in names]))
    elif command == "del":
        out(str(space.delete(parse_clauses(rest))))
    elif command == "replay":
        space.replay(rest[0])
    elif command == "addjson":
        docs = spark.read.text(rest[0]).withColumnRenamed("value", "doc")
        bad = docs.where(~jsondoc.is_valid(F.col("doc"))).count()
        if bad:
            raise ValueError(f"{bad} lines are no JSON documents")
        put(docs)
    elif command == "createindex":
        out(str(space.create_index([rest[0]])))
    elif command == "createhash":
        out(str(space.create_index(rest, hashed=True)))
    elif command == "dropindex":
        space.drop_index(int(rest[0]))
    elif command == "listindex":
        for x in space.catalog().layouts:
            out(f"{x.path.rsplit('-', 1)[1]}\t{x.kind}\t{','.join(x.columns)}")
    elif command == "select":
        count, start = ([int(x) for x in rest] + [20, 0][len(rest) :])[:2]
        df = table()
        show((df.orderBy("rid") if "rid" in df.columns else df).offset(start).limit(count), count)
    elif command == "query":
        show(space.query(parse_clauses(rest)) if space.exists() else query(table(), rest))
    elif command == "count":
        out(str((space.query(parse_clauses(rest)) if space.exists() else query(table(), rest)).count()))
    elif command == "info":
        df = table()
        out(json.dumps({"rows": df.count(), "columns": df.columns, "indexes": len(space.catalog().layouts), "version": (space.versions() or [0])[-1]}))
    elif command == "export":
        snapshot.dump(table(), rest[0])
    elif command == "exportcsv":
        csvfile.write(_tagged(table()), rest[0])
    elif command == "exportrdf":
        triples.write(table().drop("rid"), rest[0])
    elif command == "findjson":
        docs = table()
        id_col = "rid" if "rid" in docs.columns else docs.columns[0]
        show(jsondoc.search(docs, json.loads(rest[0]), id_col, docs.columns[-1] if "doc" not in docs.columns else "doc").orderBy("doc_id"))
    elif command == "runreasoner":
        # as many clauses as a proof can use lie on one machine: the prover's own budget bounds them
        text = "\n".join(r.clause for r in space.records().orderBy("rid").toLocalIterator())
        status = prover.prove(parser.parse_otter(text)).status
        out(status)
        return 0 if status == prover.PROOF else 1
    else:
        raise ValueError(f"unknown command {command!r}")
    return 0


def main(argv: list[str] | None = None) -> int:
    words = sys.argv[1:] if argv is None else list(argv)
    if not words or "help" in words[:2] or words[0] == "-h":
        print(__doc__)
        return 0
    if "version" in words[:2] or words[0] == "-v":
        print(VERSION)
        return 0
    if len(words) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    return run(SparkSession.builder.getOrCreate(), words[0], words[1], words[2:])


if __name__ == "__main__":
    raise SystemExit(main())
