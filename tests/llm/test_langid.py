import binascii
import math
from collections import Counter

import numpy as np

from tuplemill.llm import langid

SF = "/root/testdata/sf0.01"


def test_binding_and_bundling_equal_brute_force():
    s = langid.Space(64)
    words = " the cat "
    want = sum(np.roll(s.letter(ord(a)), 2) * np.roll(s.letter(ord(b)), 1) * s.letter(ord(c)).astype(int) for a, b, c in zip(words, words[1:], words[2:], strict=False))
    assert s.bundle("The,  cat!!").tolist() == want.tolist()
    small = langid.Space(64, most=5)
    assert small.bundle("The cat").tolist() == want.tolist()
    assert s.bundle("12 *** !") is None and s.bundle("") is None


def brute_vector(text, letters, dims=64, n=3):
    """A text's vector by plain loops, or None without a letter."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    padded = " " + " ".join(words) + " "
    if not words:
        return None
    out = [0] * dims
    for gram, often in Counter(padded[k : k + n] for k in range(len(padded) - n + 1)).items():
        for d in range(dims):
            bound = 1
            for place in range(n):
                bound *= int(letters.letter(ord(gram[n - 1 - place]))[(d - place) % dims])
            out[d] += often * bound
    return out


def brute_prototypes(rows, letters, dims=64):
    sums = {}
    for lang, text in rows:
        vector = brute_vector(text, letters, dims)
        if lang is not None and vector is not None:
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * dims), vector, strict=True)]
    return sums


def brute_cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_prototypes_and_predictions_equal_brute_force(spark):
    rows = [(k, text, lang) for k, (text, lang) in enumerate([("the cat sat on the mat", "en"), ("and the dog ran, the end", "en"), ("der hund und die katze", "de"), ("ein haus, ein hund!", "de"), ("le chat et le chien", "fr"), (None, "fr"), ("42", "de"), ("une maison", None), ("the katze", "en"), ("日本語", None)])]
    docs, letters = spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Space(64)
    sums = brute_prototypes([(r[2], r[1]) for r in rows], letters)
    profiles = langid.train(docs, dims=64)
    assert profiles.langs == sorted(sums)
    got = {r.doc_id: r for r in langid.identify(docs, profiles).collect()}
    bound, stay = 2 / 64**0.5, set()
    for k, text, _ in rows:
        vector = brute_vector(text, letters)
        if vector is None:
            assert (got[k].lang_pred, got[k].score, got[k].cosine) == ("und", 0.0, 0.0)
            continue
        cosines = {lang: brute_cosine(vector, s) for lang, s in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        score = math.exp(20 * cosines[best]) / sum(math.exp(20 * c) for c in cosines.values())
        assert got[k].lang_pred == best and math.isclose(got[k].score, score, rel_tol=1e-5) and math.isclose(got[k].cosine, cosines[best], abs_tol=1e-5)
        if cosines[best] >= bound:
            stay.add(k)
    assert {r.doc_id for r in langid.filter_identified(docs, profiles).collect()} == stay and 9 not in stay and 0 in stay


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.train(docs)
    foreign = ["".join(chr(0x4E00 + (k * 7919 + j * 31) % 5000) for j in range(80)) for k in range(60)]
    mixed = docs.select("doc_id", "text").union(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(foreign)], "doc_id long, text string"))
    left = {r.doc_id for r in langid.filter_identified(mixed, profiles).collect()}
    assert sum(i < 0 for i in left) <= 9 and sum(i >= 0 for i in left) >= 0.99 * docs.count()
    # where nothing was learned, texts with a letter stay
    nothing = langid.train(docs.where("false"))
    assert langid.filter_identified(spark.createDataFrame([(1, "a"), (2, "1"), (3, None)], "doc_id long, text string"), nothing).count() == 1


def test_long_text_equals_its_parts():
    s, t = langid.Space(32), langid.Space(32, most=200_000)
    text = " ".join(chr(97 + i % 26) + chr(0x4E00 + i) for i in range(9000))
    assert np.allclose(s.bundle(text), t.bundle(text))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.learn_and_identify(docs).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, score string, held_out int"
    rows = [(1, "the cat and the dog", "en", "x", 1), (3, "der hund und die katze", "de", "y", 2), (3, "der hund und die katze", "de", "y", 2), (None, "the dog", None, None, None), (5, None, "en", None, None), (7, "!! 12", "fr", None, None), (8, "", "de", None, None)]
    got = [(r.doc_id, r.lang_pred) for r in langid.learn_and_identify(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (3, "de"), (3, "de"), (None, "en"), (5, "und"), (7, "und"), (8, "und")], key=str)
    empty = spark.createDataFrame([], schema)
    assert langid.learn_and_identify(empty).count() == 0
    docs = spark.createDataFrame(rows, schema)
    kept = langid.filter_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and kept.count() == 4
