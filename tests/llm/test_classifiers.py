import random
import zlib

import numpy as np

from corpusloom.llm import arrow_text, linear, quality, toxicity


def corpus(n=600, seed=9):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.25, rng.random() < 0.3
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum"])
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        docs.append((i, text, "en", 0))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels, {i: (int("!!" not in t), int("idiot" in t.lower() or "scum" in t.lower())) for i, t, *_ in docs}


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, quality int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = corpus()
    extra = [(5000, None, None, None), (5001, "", "x", 1), (3, docs[3][1], "en", 0)]
    got = quality.score(*frames(spark, docs + extra, [*labels, (1, None, 1), (9999, 1, 0)])).collect()
    assert len(got) == len(docs) + 3
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in held]) > 0.95


def test_toxicity_chain(spark):
    docs, labels, truth = corpus(seed=10)
    frame, marks = frames(spark, docs + [(5000, None, None, None)], labels)
    chain = toxicity.train(frame, marks)
    got = {r.doc_id: r for r in toxicity.score(frame, chain).collect()}
    assert np.mean([got[i].is_toxic == bool(truth[i][1]) for i in truth]) > 0.95
    assert not got[5000].is_toxic
    kept = toxicity.drop_toxic(frame, chain)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].is_toxic}


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(1)
    first = rng.integers(0, 2, 400)
    items = [np.array([0] if a else [1]) for a in first]
    import pandas as pd

    weights = toxicity.fit_chain(items, pd.DataFrame({"a": first, "b": first}), 2)
    assert len(weights[0]) == 3 and len(weights[1]) == 4 and weights[1][2] > 0.05


def test_no_labels_and_no_documents(spark):
    docs, labels, _ = corpus(40)
    frame, marks = frames(spark, docs, labels)
    assert {r.score for r in quality.score(frame, marks.where("false")).collect()} == {0.5}
    assert quality.score(frame.where("false"), marks).count() == 0
    chain = toxicity.train(frame, marks.where("false"))
    assert toxicity.score(frame.where("false"), chain).count() == 0
    assert {r.p_toxic for r in toxicity.score(frame, chain).collect()} == {0.0}


def test_features_do_not_cross_documents():
    import pyarrow as pa

    def of(texts):
        ((_, _, offsets, data),) = arrow_text.pieces(pa.array(texts))
        h, row = linear.features(data, offsets)
        return [sorted(h[row == i].tolist()) for i in range(len(texts))]


    together = of(["a b c", "", "d E 1!"])
    assert together == [of(["a b c"])[0], [], of(["d E 1!"])[0]]


def test_fitting_sample_is_bounded(spark):
    docs, labels, truth = corpus(1200, seed=11)
    frame, marks = frames(spark, docs, labels)
    for most in (50, 470):  # far fewer than the labelled rows, and nearly all of them
        got = quality.score(frame, marks, most=most).collect()
        assert np.mean([r.predicted == truth[r.doc_id][0] for r in got]) > 0.9


def test_dual_coordinate_descent_solves_the_hinge_loss_problem():
    """Against projected gradient ascent on the same dual: one optimum, no duality gap."""
    rng = np.random.default_rng(6)
    n, d, cost = 40, 12, 0.7
    rows = [np.flatnonzero(rng.random(d) < 0.5) for _ in range(n)]
    rows = [r if len(r) else np.array([0]) for r in rows]
    scale = rng.normal(size=d)
    y = (rng.random(n) < 0.3).astype(float)
    w = quality.dual_coordinate_descent(rows, scale, y, cost=cost, epochs=4000)
    x = np.zeros((n, d + 1))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum() + 1e-12)
    x[:, d] = 1
    sign = np.where(y > 0, 1.0, -1.0)
    bound = np.where(y > 0, cost / (2 * y.mean()), cost / (2 * (1 - y.mean())))
    z = x * sign[:, None]
    alpha = np.zeros(n)
    for _ in range(60_000):
        alpha = np.clip(alpha + 0.02 * (1 - z @ (z.T @ alpha)), 0, bound)
    primal = lambda w: w @ w / 2 + (bound * np.maximum(0, 1 - z @ w)).sum()
    best = z.T @ alpha
    dual = alpha.sum() - best @ best / 2
    assert abs(primal(best) - dual) < 1e-6 * dual and abs(primal(w) - dual) < 1e-6 * dual and np.abs(w - best).max() < 1e-3
