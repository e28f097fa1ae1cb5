import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tuplemill.llm import exactdedup

SCHEMA = "doc_id long, text string, digest int, file string, row int"
ROWS = [(5, "a  b"), (2, "a\t\nb"), (9, "a b "), (None, "a b"), (4, ""), (3, None), (7, "x"), (7, "x"), (8, "a b"), (8, "other"), (1, "é" * 50_000)]


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("chars", [64, 1])
def test_groups_equal_brute_force(spark, chars):
    """With digests of one character all kinds of texts collide."""
    got = exactdedup.dedup(frame(spark, ROWS), digest_chars=chars, files_per_trigger=1).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len({s for _, s in kept}) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_state_goes_on(spark, tmp_path):
    """A second run with the same checkpoint adds to the state of the first."""
    rows = spark.createDataFrame([("d", 5, "f", 0), ("e", 6, "f", 1)], "digest string, doc_id long, file string, row long")
    path, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    rows.write.parquet(path)
    exactdedup.stream_state(path, rows.schema, spark, state)
    rows.withColumn("doc_id", F.col("doc_id") - 4).where("digest = 'd'").write.mode("append").parquet(path)
    got = exactdedup.stream_state(path, rows.schema, spark, state).collect()
    assert sorted((r.digest, r.keep_id, r.group_size) for r in got) == [("d", 1, 2), ("e", 6, 1)]


def test_drop_duplicates_and_empty(spark):
    docs = frame(spark, ROWS)
    left = exactdedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    texts = [norm(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in ROWS})
    assert exactdedup.drop_duplicates(frame(spark, ROWS).limit(0)).count() == 0
    assert exactdedup.dedup(frame(spark, ROWS).limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = exactdedup.dedup(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
