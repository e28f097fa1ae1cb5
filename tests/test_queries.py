import duckdb
import pytest

import __spark_entry__ as entry
from tuplemill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    rows = sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == rows
    if name not in ("filter_contradiction",):
        assert rows or "rules" in name or "json" in name or "hash" in name or "index" in name or "find" in name


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
