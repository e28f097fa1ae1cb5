import random

import numpy as np
import pytest

from tuplemill.llm import ngramjoin as nj

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, component_id int, node string"


def brute_sets(text, words=5):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows):
    sets = [brute_sets(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    roots = nj._roots(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], i))
    return sorted(((i, len(sets[k]), least.get(roots[k])) for k, (i, _) in enumerate(rows)), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df, **kw).collect()), key=str)


def corpus(seed, n=260):
    """Clusters of near copies, chains, hot passages, short texts and copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(n):
        pick = rng.random()
        if pick < 0.25 or not rows:
            text = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 12, 20, 60, 150]))]
        elif pick < 0.45:
            text = passage + [word() for _ in range(rng.choice([0, 1, 5, 10, 15, 20, 30, 100]))]
        else:
            text = list(rng.choice(rows[-40:] if pick < 0.8 else rows)[1])
            for _ in range(rng.randrange(4)):
                if text:
                    p = rng.randrange(len(text))
                    rng.choice([lambda: text.__setitem__(p, word()), lambda: text.insert(p, word()), lambda: text.pop(p)])()
        rows.append((k * 3 % 1000, text))
    return [(i, " ".join(t)) for i, t in rows]


def test_shingles_equal_brute_force():
    for text in (None, "", " \t", "a", "A b c d E f", "x y z w v x y z w v x", "É é"):
        assert len(nj.shingles(text)) == len(brute_sets(text))
    assert nj.shingles("a B c d e f").tolist() == nj.shingles(" A b\nc\td  E F ").tolist()


@pytest.mark.parametrize("sizes", [(1, 40), (60, 200), (900, 1300)])
def test_linked_sets_share_the_spare_points(sizes):
    """The pigeonhole: sets at the very threshold agree on the points beyond the difference."""
    rng, plan = np.random.default_rng(2), nj.Plan()
    for _ in range(150):
        n = int(rng.integers(*sizes))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        k = nj.Scheme.difference(len(a), len(a) * 4 // 3, 3, 4)
        out = int(rng.integers(0, k + 1))
        b = np.unique(np.concatenate([a[: len(a) - out] if rng.random() < 0.5 else a, rng.integers(0, 2**63, k - out, dtype=np.uint64)]))
        if not len(b) or not nj.linked(a, b):
            continue
        small, large = sorted([a, b], key=len)
        scheme = plan.of(len(small))[0]
        assert scheme in plan.of(len(large))
        keys, points = nj.signatures(small, scheme)
        spare = nj.Emitter.total(small, scheme) - nj.Scheme.difference(len(small), len(small) * 4 // 3, 3, 4)
        assert points[np.isin(keys, nj.signatures(large, scheme)[0])].sum() >= spare


@pytest.mark.parametrize(("seed", "hot", "block"), [(1, 8, 100_000), (2, 2, 60)])
def test_components_equal_brute_force(spark, seed, hot, block):
    rows = corpus(seed, 180) + [(2000, None), (2001, ""), (2001, ""), (None, "lone w1"), (None, None), (5, "lone w1"), (7, "z " * 30_000)]
    assert got(spark, rows, hot=hot, block=block) == brute(rows)


def test_connected_equals_all_links():
    for seed in range(6):
        sets = [x for _, t in corpus(seed, 90) if len(x := nj.shingles(t))]
        for centres in (0, 2, 8):
            found, want = nj.connected(sets, centres=centres), nj._roots(len(sets), nj.join_sets(sets))
            assert len(set(zip(found, want, strict=True))) == len(set(found)) == len(set(want))
    assert nj.connected([]) == []


def test_uneven_nodes_meet_all_rows(spark, monkeypatch):
    """With every node uneven the exact fallback alone finds all links; a pass takes a few sets."""
    rows = corpus(4, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed = nj.written(nj._rows(docs, 5), "rows")
    every = placed.where("node is not null").select("node").distinct()
    edges = nj._short_of_points(docs, placed, every, 5, 3, 4, most_bytes=20_000)
    ids = {bytes(r.node): r.doc_id for r in placed.where("node is not null").groupBy("node").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id").collect()}
    sets = {nj.node_of(x): x for _, t in rows if len(x := nj.shingles(t))}
    nodes = sorted(sets)
    want = {(nodes[i], nodes[j]) for i, j in nj.join_sets([sets[n] for n in nodes])}
    assert want and {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in edges.collect()} == want and len(ids) == len(sets)
    # nodes that a poor allocation leaves without points go that way, and the whole join is right
    monkeypatch.setattr(nj.Scheme, "_allocate", lambda self, num, den: (2, 0))
    emitter = nj.Emitter(1, 3, 4)
    list(emitter.add(nj.shingles(" ".join(f"u{k}" for k in range(40))), b"n" * 16))
    assert emitter.uneven == [b"n" * 16]


def test_meeting_is_the_same_however_often_it_settles():
    sets = [x for _, t in corpus(5, 200) if len(x := nj.shingles(t))]
    blobs = []
    for k in range(0, len(sets), 7):
        emitter = nj.Emitter(1, 3, 4)
        for x in sets[k : k + 7]:
            assert not list(emitter.add(x, nj.node_of(x)))
        blobs += [blob for p, blob in emitter.flush() if p >= 0]
    seen = []
    for most, at_once in ((10**9, 10**9), (300, 10**9), (1, 40)):
        met, hot, points = nj.Meeting(3, most), set(), {}
        for blob in blobs:
            for heads, keys, codes in met.add(blob):
                hot |= set(zip(keys.tolist(), map(bytes, nj._nodes(heads).to_pylist()), codes.tolist(), nj._spares(heads).tolist(), strict=True))
        for heads, keys, codes in met.settle():
            hot |= set(zip(keys.tolist(), map(bytes, nj._nodes(heads).to_pylist()), codes.tolist(), nj._spares(heads).tolist(), strict=True))
        for a, b, n in met.pairs(at_once):
            for x, y, k in zip(nj._nodes(a).to_pylist(), nj._nodes(b).to_pylist(), n.tolist(), strict=True):
                points[x, y] = points.get((x, y), 0) + k
        seen.append((hot, points))
    assert seen[0][0] and seen[0][1] and seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("block", [150])
def test_heavy_groups_equal_all_links(spark, block):
    """Groups beyond a block: centres first, what they leave against the whole group."""
    texts = corpus(6, 120)
    sets = {nj.node_of(x): x for _, t in texts if len(x := nj.shingles(t))}
    nodes = sorted(sets)
    group = {n: b"%d" % (k % 2) for k, n in enumerate(nodes)}
    weight = {g: sum(len(sets[n]) for n in nodes if group[n] == g) for g in (b"0", b"1")}
    rows = [(group[n], n, len(sets[n]), weight[group[n]], sets[n].tobytes()) for n in nodes]
    edges = nj._heavy_links(spark.createDataFrame(rows, "group binary, node binary, n_shingles long, weight long, blob binary"), 3, 4, block, centres=2)
    found = [(nodes.index(bytes(r.a)), nodes.index(bytes(r.b))) for r in edges.collect()]
    want = [(i, j) for i, j in nj.join_sets([sets[n] for n in nodes]) if group[nodes[i]] == group[nodes[j]]]
    assert want and nj._roots(len(nodes), found) == nj._roots(len(nodes), want)


def chain(n, words=70, step=9):
    """Texts of which each links with the next alone, and none with any other."""
    return [" ".join(f"c{k * step + i}" for i in range(words)) for k in range(n)]


def test_stars_of_a_heavy_group_link(spark):
    """Nodes of two centres may link while the centres don't: a chain, its links at the threshold and below."""
    for step, of_one in ((9, True), (10, False)):
        texts = chain(41, step=step)
        sets = {nj.node_of(x): x for t in texts if len(x := nj.shingles(t))}
        nodes = sorted(sets)
        want = nj._roots(len(nodes), nj.join_sets([sets[n] for n in nodes]))
        assert (len(set(want)) == 1) == of_one
        rows = [(b"g", n, len(sets[n]), 41 * 66, sets[n].tobytes()) for n in nodes]
        df = spark.createDataFrame(rows, "group binary, node binary, n_shingles long, weight long, blob binary")
        found = [(nodes.index(bytes(r.a)), nodes.index(bytes(r.b))) for r in nj._heavy_links(df, 3, 4, 300, centres=6).collect()]
        assert nj._roots(len(nodes), found) == want
    rows = list(enumerate(chain(41)))
    assert got(spark, rows, block=300) == brute(rows)


def test_documents_and_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    found = nj.join(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == want
    left = nj.keep_one(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _, c in want if i == c}
    assert nj.join(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a, 0), (5, b, 1), (2, b + " z", 2), (3, c, 3), (None, c + " z", 4), (3, c, 5), (None, "d " + a[9:], 6), (None, None, 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").coalesce(1)
    assert sorted(r.node for r in nj.keep_one(docs).collect()) == [0, 2, 3, 7, 8]
    nulls = spark.createDataFrame([(None, c, 1), (None, c + " z", 2), (None, a, 3)], "doc_id long, text string, node int").coalesce(1)
    assert sorted(r.node for r in nj.keep_one(nulls).collect()) == [1, 3]


def test_one_row_of_a_chain_across_centres_stays(spark):
    """The pipeline's stage on a heavy group whose links cross from one centre's sets to another's."""
    docs = spark.createDataFrame(list(enumerate([*chain(41), "another text of six words"])), "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in nj.keep_one(docs, block=300).collect()) == [0, 41]
