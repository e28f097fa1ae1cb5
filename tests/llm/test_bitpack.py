import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tuplemill.llm import bitpack

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_pack_round_trip(bits, ids):
    ids = np.array([i % (1 << bits) for i in ids], np.uint32)
    data = bitpack.pack(ids, bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    assert bitpack.unpack(data, len(ids), bits).tolist() == ids.tolist()
    assert int.from_bytes(data, "little") == sum(int(x) << (k * bits) for k, x in enumerate(ids))


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_shard_random_access(bits):
    rng = np.random.default_rng(1)
    counts = [0, 3, 9000, 1, 0, 4096]
    ids = rng.integers(0, 1 << bits, sum(counts)).astype(np.uint32)
    data = bitpack.encode_shard([1, None, 3, 3, 4, 9], counts, ids, bits, 2, 7) + b"PBMT"
    shard = bitpack.Shard(data)
    assert shard.doc_ids == [1, None, 3, 3, 4, 9] and (shard.partition, shard.number) == (2, 7)
    at = 0
    for k, n in enumerate(counts):
        assert shard.document(k).tolist() == ids[at : at + n].tolist()
        at += n
    assert shard.ids(4000, 9003).tolist() == ids[4000:9003].tolist()
    with pytest.raises(ValueError):
        bitpack.Shard(data[:-3])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ's  \n\t.,!#|<>é́İßΣ1２½中ّ-_\x1f "), max_size=40))
def test_encoder_equals_library(text):
    enc = bitpack.encoder(PATH)
    assert enc.encode(text).tolist() == enc._library.encode(text, add_special_tokens=False).ids


def random_texts(seed, n):
    """Texts of ASCII, letters of all scripts, marks that compose, and parts of special tokens."""
    rng = random.Random(seed)
    marks = [*range(0x300, 0x370), 0x0344, 0x0345, 0x05B0, 0x064B, 0x0653, 0x093C, 0x09BE, 0x0E38, 0x1AB0, 0x1DC0, 0x3099, 0x309A, 0x20D0, 0xFE20, 0x1D165]
    pools = [
        lambda: chr(rng.randrange(32, 127)), lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), lambda: chr(rng.choice(marks)), lambda: rng.choice("TJHIKSW") + chr(rng.choice(marks)),
        lambda: chr(rng.choice([rng.randrange(0xA0, 0x250), rng.randrange(0x370, 0x700), rng.randrange(0x900, 0x1200), rng.randrange(0x1E00, 0x2200), rng.randrange(0x3040, 0x3100), rng.randrange(0xAC00, 0xAC80), rng.randrange(0x1F600, 0x1F640)])),
        lambda: rng.choice([" ", "\n", "\t", "  ", "\u00a0", "\u2028", "\x85"]), lambda: rng.choice(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|EndOfText|>"]), lambda: rng.choice(["'S", "'s", "Ꭰ", "İ", "ẞ", "Σ", "K", "Å", "ﬁ", "½"]),
    ]
    return ["".join(rng.choice(pools)() for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_random_texts_equal_the_library():
    enc, texts = bitpack.encoder(PATH), random_texts(7, 20_000)
    want = enc._library.encode_batch(texts, add_special_tokens=False)
    for a in range(0, len(texts), 1000):
        for text, got, e in zip(texts[a : a + 1000], enc.encode_all(texts[a : a + 1000]), want[a : a + 1000], strict=True):
            assert got.tolist() == e.ids, repr(text)
    assert enc.encode("T\u0308 J\u030c H\u0331").tolist() == enc._library.encode("T\u0308 J\u030c H\u0331", add_special_tokens=False).ids


def test_files_with_other_settings_get_whole_texts():
    spec = json.loads(bitpack.encoder(PATH)._library.to_str())
    assert bitpack._parts_at_blanks(spec) and not bitpack.encoder(PATH)._whole
    assert not bitpack._parts_at_blanks(spec | {"normalizer": None})
    assert not bitpack._parts_at_blanks(spec | {"pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1]})
    assert not bitpack._parts_at_blanks(spec | {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]})


def test_one_id_of_many_rows_is_split(spark, tmp_path):
    docs = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "concat('w ', id % 700) as text")
    bitpack.write_ids(docs, f"file://{tmp_path}/ids", PATH)
    parts = [r.n for r in bitpack.read_ids(spark, f"file://{tmp_path}/ids").groupBy("partition").count().withColumnRenamed("count", "n").collect()]
    assert len(parts) > 2 and max(parts) < 2000 and sum(parts) == 3000


def test_token_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lib, start, want = bitpack.encoder(PATH)._library, 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = [*lib.encode(r.text, add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitpack.token_table(docs, PATH, shard_ids=20_000).collect()} == want


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(2, "b c", 0), (None, "a", 0), (1, None, 0), (2, "a", 0), (2, "a", 0), (3, "", 0)]
    got = bitpack.token_table(spark.createDataFrame(rows, "doc_id long, text string, start int"), PATH).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2), (2, 7, 3), (3, 10, 1)]
    assert bitpack.token_table(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_pieces_go_to_the_library_many_in_one_text():
    """A call for each new piece costs more than the piece; the mark between pieces may be in texts too."""
    path, calls = public_tokenizers.path("word_bpe_49k.json"), []
    enc = bitpack.WordEncoder(path)
    library = enc._library

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    enc._library = Counting()
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(600)), "a\x1fb \x1f c\x1f", "\x1f<|endoftext|> x.,", "", " \x1f\x1f  é\u0301"]
    assert [x.tolist() for x in enc.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 20


def test_words_of_letters_skip_normaliser_and_pattern():
    """The library's normaliser and word pattern cost more than its merges, and leave such words as they are."""
    enc = bitpack.WordEncoder(PATH)
    library, calls = enc._library, []

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    enc._library = Counting()
    rng = random.Random(3)
    letters = [c for c in map(chr, range(0x250)) if c.isalpha() and c != "İ"]
    words = letters + ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(3000)]
    assert enc.encode_all([" ".join(words)])[0].tolist() == [k for w in words for k in library.encode(w, add_special_tokens=False).ids]
    assert enc.encode_all(words)[7].tolist() == library.encode(words[7], add_special_tokens=False).ids
    assert not calls
    odd = ["İx", "x1", "ǰ̌", "Å", "ɐb", "ﬁ", "don't.", "", "...", "a..!b.", "Σς."]
    assert [x.tolist() for x in enc.encode_all(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_shards_are_read_once(spark):
    got = bitpack.token_table(spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string"), PATH)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got.orderBy("start").collect()] == [(1, 0, 2), (2, 2, 3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("content#") == 0
