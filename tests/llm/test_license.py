import re

import duckdb
import pytest

from tuplemill.llm import license as lic

SCHEMA = "doc_id long, text string, labels int, low string"
TEXTS = [
    None, "", "MIT", "Under the MIT license under the mit LICENSE", "cc by nc cc-by-nc. CC BY\nNC", "apache license, version 2.0\nunder the mit license x",
    "All rights reserved", "all rights  RESERVED. é", "rights reserved", "This work is licensed under GNU General Public License, version 3",
    "x" * 5000 + "\n" + "a b " * 30_000 + "cc by nc", "license mit the under", "Released under the MIT  License.\n\n\r\n", "İ cc by nc ÀÉ",
]


def brute(text):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    low = (text or "").translate(str.maketrans(lic.UPPER, lic.LOWER))
    ws, base, at = words(low), set(), []
    for label, phrase in lic.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        at += hits
        base |= {label} if hits else set()
    labels, best = set(base), 0.0
    for block in low.split("\n"):
        b = set(words(block))
        for label, t in lic.TEMPLATES:
            t = set(t.split())
            if len(b & t) >= 0.8 * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(b & t) / len(t))
    return (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if at else best)


def rows_of(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]


def test_small_cases_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in enumerate(TEXTS)], SCHEMA)
    assert rows_of(lic.scan(docs)) == [brute(t) for t in TEXTS]
    assert lic.scan(docs.limit(0)).count() == 0
    twice = lic.scan(spark.createDataFrame([(None, TEXTS[3], 0, ""), (None, TEXTS[3], 0, "")], SCHEMA)).collect()
    assert [tuple(r)[1:] for r in twice] == [brute(TEXTS[3])] * 2


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_documents_equal_oracle(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    got = lic.scan(spark.read.parquet(path)).orderBy("doc_id")
    want = con.execute(lic.oracle() + " ORDER BY 1")
    assert [c[0] for c in want.description] == got.columns
    assert [tuple(r) for r in got.collect()] == want.fetchall()


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a", 0, "z")], SCHEMA)
    assert not re.search("Python|Pandas|MapInArrow", lic.scan(docs)._jdf.queryExecution().toString())


WRAPPED = [
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "This work is licensed under the GNU General\nPublic License, version 3",
    " * All rights\r\n *\r\n * reserved.", "all\nrights x reserved", "all\nall\nrights\nall\nreserved", "all reserved\nall all\nrights",
    "\n".join("this source code form is subject to the terms of the mozilla public license".split()), "This Source Code Form is subject\nto terms of a Mozilla Public\nLicense",
    "all\n" * 60_000 + "rights\nreserved", "of the\n" * 60_000, "mozilla public x y\n" + "z " * 9 + "this source code form is subject to the terms of", None, "\n",
]


def brute_runs(text):
    """Labels and best containment of lines and of runs of a template's length."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    low = (text or "").translate(str.maketrans(lic.UPPER, lic.LOWER))
    ws, labels, best = words(low), set(), 0.0
    for label, t in lic.TEMPLATES:
        n, t = len(t.split()), set(t.split())
        for block in [words(b) for b in low.split("\n")] + [ws[i : i + n] for i in range(len(ws))]:
            if len(t.intersection(block)) >= 0.8 * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(t.intersection(block)) / len(t))
    return ",".join(sorted(labels)), best


def test_wrapped_statements_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in enumerate(WRAPPED)], SCHEMA)
    got = [(r.labels, r.score) for r in lic.scan(docs).orderBy("doc_id").collect()]
    assert got == [brute_runs(t) for t in WRAPPED]
    assert got[0][0] == "bsd-3" and got[1] == ("gpl-3,lgpl-3", 1.0) and got[2] == ("all-rights-reserved", 1.0) and got[3] == ("", 0.0)
