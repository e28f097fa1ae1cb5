import random

import pytest

from tuplemill.llm import warc

SF = "/root/testdata/sf0.001"


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in rows:
        data, f = (h or "").encode(), first.get(h or "")
        again = f is not None and p != f
        out.append((p, len(data), warc.sha1_base32(data), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def table(spark, rows, tmp=None, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "page_id long, url string, html string")
    return sorted(map(tuple, warc.warc_table(df, path=tmp, **kw).collect()), key=str)


def test_small_cases(spark):
    rows = [(3, "u", "aé"), (1, None, "aé"), (2, "a\r\nb", None), (5, "x", ""), (None, "n", "aé"), (None, "n", "lone"), (7, "x", "q" * 300_000), (3, "u", "aé"), (1, "u", "aé")]
    assert table(spark, rows) == brute(rows)
    assert table(spark, []) == []


def test_min_bytes(spark):
    got = table(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], min_bytes=3)
    assert [r[3] for r in got] == ["response", "response", "response", "revisit"]


def test_pages_round_trip_and_format(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(10_000 + k, u, h) for k, u, h in rows[::3]]
    assert table(spark, rows, f"file://{tmp_path}/w") == brute(rows)
    files = sorted((tmp_path / "w").glob("part-*"))
    html = {r[0]: (r[2] or "").encode() for r in rows}
    seen = 0
    for f in files:
        data = f.read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18" and data.endswith(warc.EMPTY_FRAME.encode())
        for headers, block in warc.records_of(data):
            seen += 1
            if headers["WARC-Type"] == "response":
                assert block.split(b"\r\n\r\n", 1)[1] == html[warc._page(headers["X-Page-ID"])]
            else:
                assert headers["WARC-Refers-To"] == warc.record_id(int(headers["X-Refers-To-Page-ID"]))
    assert seen == len(rows)
    assert sum(f.stat().st_size for f in files) < sum(map(len, html.values())) / 2


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(3, "u", "aé"), (1, None, "aé"), (None, "n", "aé"), (None, "n", "aé"), (None, "n", "lone"), (3, "u", "aé"), (1, "u", "aé"), (9, "u", "b"), (10, "u", "b")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w")
    ids = [r.record_id for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()]
    assert len(set(ids)) == len(ids) == len(rows) and "<urn:x-page:9>" in ids
    named = {h.get("WARC-Refers-To") for f in (tmp_path / "w").glob("part-*") for h, _ in warc.records_of(f.read_bytes())}
    assert named == {None, "<urn:x-page:9>"}  # two records have page 1's id, so none is named


@pytest.mark.parametrize("records", [[b"WARC/1.1\r\n"], [b"x" * 9] * 3, [bytes([k]) * 40 for k in range(9)], [random.Random(k).randbytes(900_000) for k in range(6)]])
def test_every_archive_has_a_dictionary(records):
    import zstandard

    data = warc.archive(records)
    n = int.from_bytes(data[4:8], "little")
    assert n >= 8 and data[:4] == b"\x5d\x2a\x4d\x18"
    shared, at = zstandard.ZstdCompressionDict(data[8 : 8 + n]), 8 + n
    for r in records:
        frame = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True).compress(r)
        assert data[at : at + len(frame)] == frame and zstandard.ZstdDecompressor(dict_data=shared).decompress(frame) == r
        at += len(frame)
    assert at == len(data)


def test_records_read_alone_need_only_the_dictionary():
    import zstandard

    records = [warc.record(k, f"http://h/{k}", f"<p>page {k} about {k * 7} things</p>".encode() * 20, False, None) for k in range(200)]
    data = warc.archive(records)
    n = int.from_bytes(data[4:8], "little")
    assert n > 0
    shared = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    one = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True).compress(records[50])
    assert one in data and len(one) < len(zstandard.compress(records[50]))
    assert [b for _, b in warc.records_of(data)] == [b for _, b in warc.records_of(warc.archive(records, dict_bytes=8192))]
    with pytest.raises(ValueError):
        list(warc.records_of(data[:-5]))
