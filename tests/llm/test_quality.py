import math

import numpy as np

from tuplemill.llm import quality

SF = "/root/testdata/sf0.01"


def test_pairwise_model_ranks_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.learn_and_score(docs, labels).collect()]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, _, y in out if y], [s for s, _, y in out if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.97
    assert np.mean([p == y for _, p, y in out]) > 0.93


def test_gradient_step_prefers_the_better():
    x = np.zeros((40, quality.SHAPES + 12))
    x[20:, 3] = 1
    model = quality.fit_pairs(x, np.r_[np.zeros(20), np.ones(20)].astype(int), pairs=4000, epochs=50)
    s = model.score(x)
    assert s[:20].max() < 0.3 <= s[20:].min()


def test_pair_loss_and_gradient_equal_brute_force():
    rng = np.random.default_rng(3)
    w, d = rng.normal(size=7), rng.normal(size=(50, 7)) * 3
    loss, gradient = quality.pair_loss(w, d, 0.1)
    assert abs(loss - sum(math.log(1 + math.exp(-sum(a * b for a, b in zip(row, w, strict=True)))) for row in d.tolist()) / 50 - 0.05 * sum(x * x for x in w)) < 1e-9
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert abs((quality.pair_loss(w + step, d, 0.1)[0] - quality.pair_loss(w - step, d, 0.1)[0]) / 2e-6 - gradient[k]) < 1e-6


def test_threshold_is_the_stated_quantile():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, quality.SHAPES + 12))
    y = (x[:, 3] + rng.normal(size=200) * 0.3 > 0.5).astype(int)
    for quantile, below in ((None, int((y == 0).sum())), (0.25, 50), (0.0, 0), (1.0, 200)):
        model = quality.fit_pairs(x, y, pairs=4000, epochs=50, quantile=quantile)
        assert int((model.score(x) < model.cut).sum()) == below


def test_repeated_ids_teach_once(spark):
    docs = spark.range(500).selectExpr("id % 4 as doc_id", "concat('word ', id) as text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    taught = []
    fit, quality.fit_pairs = quality.fit_pairs, lambda x, y, **_: taught.append(len(x))
    try:
        quality.train(docs, labels)
    finally:
        quality.fit_pairs = fit
    assert taught[0] <= 4


def test_degenerate_inputs(spark):
    rows = [(1, "ok text", "x"), (None, None, "y"), (3, "", "z"), (3, "", "z"), (4, "!! !!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, text int")
    got = quality.learn_and_score(docs, labels).collect()
    assert len(got) == 5 and [r.doc_id for r in got].count(3) == 2 and all(0 <= r.score <= 1 for r in got)
    assert len(quality.learn_and_score(docs, labels.limit(0)).collect()) == 5
    assert quality.learn_and_score(docs.limit(0), labels).count() == 0
    assert len(quality.features("a " * 300_000)) == quality.SHAPES + 12


def test_words_of_long_texts_are_counted():
    one = [f"w{i % 5000}" for i in range(199_999)]
    for words in (one, [*one, "w0"], one + one):
        stats = quality.features(" ".join(words))[quality.SHAPES :]
        assert stats[6] == 5000 / len(words) and stats[7] == words.count("w0") / len(words)
