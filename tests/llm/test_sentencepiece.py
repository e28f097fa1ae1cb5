import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from tuplemill.llm import sentencepiece as sp

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
BPE = sp.Model(sp.load(PATH))
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = st.text(alphabet=st.sampled_from("aabeehilnorst THEé中\n 😀▁.x1"), max_size=50)


def unigram(byte_fallback: bool) -> bytes:
    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, byte_fallback
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix = "identity", True
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = False, True
    proto.pieces.add(piece="<unk>", score=0, type=2)
    if byte_fallback:
        for b in range(256):
            proto.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for k, p in enumerate(["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aab", "e", "t", "h", "the", "▁the", "he", "s", "st", "abab"]):
        proto.pieces.add(piece=p, score=-2.0 - (k * 7919 % 1009) / 173, type=1)
    return proto.SerializeToString()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bpe_equals_library_and_round_trips(text):
    ids = BPE.encode(text).tolist()
    assert ids == LIB.encode(text)
    assert BPE.decode(ids) == text.replace("▁", " ") == LIB.decode(ids)


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_equals_library(fallback):
    data = unigram(fallback)
    own, lib = sp.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = np.random.default_rng(3)
    for _ in range(600):
        text = "".join(rng.choice(list("aabbethes \nzq"), rng.integers(0, 30)))
        assert own.encode(text).tolist() == lib.encode(text), text


def test_unigram_equals_brute_force():
    own = sp.Model(unigram(True))
    for text in ("abab", "aabthe st", "baab ab", "thehe"):
        norm = own.normalise(text)
        best = -1e9
        for cuts in itertools.product([0, 1], repeat=len(norm) - 1):
            parts, at = [], 0
            for k, c in enumerate((*cuts, 1)):
                if c:
                    parts.append(norm[at : k + 1])
                    at = k + 1
            if all(p in own.ids for p in parts):
                best = max(best, sum(own.score[own.ids[p]] for p in parts))
        assert sum(own.score[k] for k in own.encode(text).tolist()) == pytest.approx(best)


def test_documents_equal_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sp.encode_decode(docs, PATH).collect():
        assert r.ids == LIB.encode(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids)


def test_nulls_and_repeats(spark):
    rows = [(1, None, 0), (None, "a  b\n", 0), (2, "", 0), (2, "", 0), (3, "x" * 200_000, 0)]
    got = sp.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0, r.round_trip) for r in got) == [("1", False, True), ("2", False, True), ("2", False, True), ("3", True, True), ("None", True, True)]
    assert next(r for r in got if r.doc_id == 1).ids_crc32 == zlib.crc32(b"")
    assert sp.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
