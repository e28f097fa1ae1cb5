import binascii
import re

import corpus_pipeline
import numpy as np
import sentencepiece
from tuplemill.llm import decontam, langid, ngramjoin
from tuplemill.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    letters = langid.Space(1024, most=200_000)
    vectors = {i: letters.bundle(r.text) for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    sums = {}
    for i, v in vectors.items():
        if binascii.crc32(str(i).encode()) % 4 != 2 and docs[i].lang is not None:
            sums[docs[i].lang] = sums.get(docs[i].lang, 0) + v
    cosine = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    kept = [i for i in sorted(vectors) if max(cosine(vectors[i], p) for p in sums.values()) >= 2 / 1024**0.5]
    first = {}
    for i in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i].text), i)
    kept = sorted(first.values())
    sets = [ngramjoin.shingles(docs[i].text) for i in kept]
    roots = ngramjoin._roots(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if ngramjoin.linked(sets[a], sets[b])])
    kept = [i for k, i in enumerate(kept) if roots[k] == k]
    items = [dict(item_id=r.item_id, words=decontam.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def contaminated(text):
        w = decontam.words_of(text)
        for item in items:
            x, k = item["words"], int(decontam.RATE * len(item["words"]))
            if len(set(w) & set(x)) < len(set(x)) - k:
                continue
            for s in range(max(1, len(w) - len(x) + 1)):
                part = w[s : s + len(x)]
                if len(set(part) & set(x)) >= len(set(x)) - k and decontam.edit_distance(part, x, k) <= k:
                    return True
        return False

    kept = [i for i in kept if not contaminated(docs[i].text)]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == kept
    assert all(r.round_trip and r.ids == lib.encode(docs[i].text) for i, r in got.items())


def test_stages_keep_columns_on_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, digest int, kept string, ids int"
    rows = [(None, "the cat sat", "en", None, None, "n", 1, "k", 2), (1, None, None, "s", 0, None, None, None, None), (2, "the cat  sat", "en", "s", 3, None, None, None, None), (2, "the cat  sat", "en", "s", 3, None, None, None, None), (4, "", "en", "s", 0, None, None, None, None)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        assert [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()] == ([2] if some else [])
