import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tuplemill.llm.pii import BASE_KINDS, Finder, find_pii, luhn

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The base contract, with plain regular expressions over the whole text."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@+-_ 0123456789()%\né", max_size=60))
def test_base_spans_equal_regular_expressions(text):
    assert [s for s in Finder().spans(text) if s[0] in BASE_KINDS] == brute(text)


@pytest.mark.parametrize("text", ["1.2.3.4.5.6.7.8", "a@b.c@d.e", "999.1.1.1.1.1", "x@y", "4111 1111-1111 1111", "+1 (499) 555-6503.", "1" * 4000 + ".1.1.1", "@", "+", ""])
def test_corners(text):
    assert [s for s in Finder().spans(text) if s[0] in BASE_KINDS] == brute(text)


def test_added_spans():
    found = Finder().spans('mail mailto:jo@x.org or https://ann:pw@h.net/; token = "1eb9c654e721b4f8" but token ring, http://plain.example')
    assert [s[0] for s in found if s[0] not in BASE_KINDS] == ["address", "address", "account"]


@pytest.mark.parametrize(("text", "value"), [
    ("IBAN DE89370400440532013000", "DE89370400440532013000"), ("account number 12345678", "12345678"), ("IBAN: DE89 3704 0044 0532 0130 00 and more", "DE89 3704 0044 0532 0130 00"),
    ("IBAN: DE89 3704 0044 0532 0130 01", None), ("iban = GB82WEST12345698765432, x", "GB82WEST12345698765432"), ("account is open", None), ("account number unknown", None), ("Account No. 00998877.", "00998877"), ("iban", None), ("IBAN: ", None),
])
def test_accounts(text, value):
    assert [text[a:b] for k, a, b in Finder().spans(text) if k == "account"] == ([value] if value else [])


def test_nulls_and_repeats(spark):
    rows = [(1, None, "x"), (None, "a@b.cc", "y"), (2, "", "z"), (2, "", "z"), (3, "é a@b.cc", "w")]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    by = {(r.doc_id, r.n_email, r.spans) for r in got.collect()}
    assert by == {(1, 0, ""), (None, 1, "email:0:6"), (2, 0, ""), (3, 1, "email:2:8")}
    assert got.where("doc_id = 2").count() == 2
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in find_pii(docs).collect():
        base = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in BASE_KINDS]
