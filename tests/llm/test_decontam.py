import random

import numpy as np
import pytest

from tuplemill.llm import decontam as dc

SF = "/root/testdata/sf0.001"


def brute(items, text):
    words, out = dc.words_of(text), set()
    for item_id, item in items:
        w = dc.words_of(item)
        if len(w) < dc.MIN_WORDS:
            continue
        k = int(dc.RATE * len(w))
        for s in range(max(1, len(words) - len(w) + 1)):
            if words and dc.edit_distance(words[s : s + len(w)], w, k) <= k:
                out.add(item_id)
    return sorted(out, key=lambda i: (i is None, i))


def spoiled(words, k, rng):
    words = list(words)
    for _ in range(k):
        p = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(p, "zz"), lambda: words.insert(p, "yy"), lambda: words.pop(p)])()
    return words


def test_edit_distance():
    assert [dc.edit_distance("kitten", "sitting", 9), dc.edit_distance("abc", "abc", 0), dc.edit_distance("", "ab", 5), dc.edit_distance("abcdef", "zzzzzz", 2)] == [3, 0, 2, 3]


def test_edit_distances_in_rows():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (300, 7)), rng.integers(0, 4, (300, 9))
    assert dc.edit_distances(a, b).tolist() == [dc.edit_distance(x.tolist(), y.tolist(), 20) for x, y in zip(a, b, strict=True)]


def test_planted_passages_equal_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([4, 5, 8, 15, 30, 59])))) for k in range(25)] + [(None, None), (30, ""), (31, "w1 w1 w1 w1 w1 w1")]
    index, wrong, total = dc.Index(items), 0, 0
    for _ in range(150):
        item = rng.choice(items[:25])[1].split()
        middle = spoiled(item, rng.randrange(int(0.32 * len(item)) + 1), rng)
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(40)) + middle + rng.choices(vocabulary, k=rng.randrange(40)))
        got, want = index.matches(text), brute(items, text)
        assert set(got) <= set(want)
        wrong, total = wrong + (got != want), total + bool(want)
    assert total > 60 and wrong <= 0.03 * total


@pytest.mark.parametrize("length", [5, 8, 16, 20, 40, 59, 100, 200])
def test_recall_at_all_allowed_edits(length):
    """Of fresh sequences with every edit they may have, the walks in use find the stated part."""
    edits = int(dc.RATE * length)
    rng, walks = np.random.default_rng(99), dc.Walks(length, dc.repeats_for(length, edits))
    plain = rng.integers(1, 2**62, (600, length), dtype=np.uint64)
    changed = np.stack([dc.edited(p, edits, rng) for p in plain])
    found = (walks.keys(plain) == walks.keys(changed)).any(0).mean()
    assert found >= dc.RECALL - 2 * (dc.RECALL * (1 - dc.RECALL) / 600) ** 0.5
    more = dc.Walks(length, walks.repeats + 9)
    assert (more.keys(plain[:5])[: walks.repeats] == walks.keys(plain[:5])).all()


def test_pairs_that_many_items_share_lose_nothing():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    items = [(k, " ".join(["of the"] + rng.choices(vocabulary, k=6) + ["of the", "in a"] + rng.choices(vocabulary, k=9))) for k in range(120)]
    index, plain = dc.Index(items), dc.Index(items[:60])
    assert index.spared.sum() and not plain.spared.sum() and len(index.owners) < 119 * len(index.pairs)
    missed = 0
    for k in range(60):
        text = " ".join(rng.choices(vocabulary, k=30) + ["of the"] + spoiled(items[k][1].split(), rng.randrange(4), rng) + ["of the"] * 3)
        missed += k not in index.matches(text)
        assert set(index.matches(text)) <= set(brute(items, text))
        short = " ".join(items[k][1].split()[:-2])  # shorter than the item
        assert k in index.matches(short)
    assert missed <= 3


def test_documents_equal_brute_force(spark):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text) < 1200}
    small = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in dc.contamination(small, benchmark).collect()}
    for doc_id, text in list(texts.items())[::3]:
        w = set(dc.words_of(text))  # only items with half of their words there can be near
        assert got[doc_id] == brute([i for i in items if len(w & set(dc.words_of(i[1]))) * 2 >= len(set(dc.words_of(i[1])))], text)
    assert any(got.values())
    left = dc.filter_clean(small, benchmark)
    assert {r.doc_id for r in left.collect()} == {d for d, found in got.items() if not found}


def test_blocks_nulls_and_repeats(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j", 0), (1, "k l m n o p q r", 0), (2, "k l m n o p q r", 0), (None, "s t u v w x y z", 0), (3, None, 0)], "item_id long, text string, item_ids int")
    rows = [(1, None), (None, "x A b, c d e f g h i j"), (2, ""), (3, "k l m n o p q r"), (3, "k l m n o p q r"), (4, "s t u v w x y z"), (5, "a b")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, contaminated int")
    for size in (1, 1 << 20):
        got = sorted(((str(r.doc_id), str(r.item_ids)) for r in dc.contamination(docs, items, block_bytes=size).collect()))
        assert got == [("1", "[]"), ("2", "[]"), ("3", "[1, 2]"), ("3", "[1, 2]"), ("4", "[None]"), ("5", "[]"), ("None", "[1]")]
        left = dc.filter_clean(docs, items, block_bytes=size)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert dc.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert dc.contamination(docs.limit(0), items).count() == 0
