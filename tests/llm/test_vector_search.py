import numpy as np
import pytest

from corpusloom.llm import vector_search as vs


def brute(x, k=20):
    out = {}
    for q in range(0, len(x), 20):
        score = x @ x[q]
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-score[i], i))[:k]
        out[q] = [(i, score[i]) for i in order]
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / len(w) for q, w in want.items()])


def collected(df):
    out = {}
    for r in df.sort("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind", ["uniform", "clusters", "norms"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    if kind == "clusters":
        x = rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] + 0.2 * x
    if kind != "norms":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got, want = collected(vs.search(df, vector_block=700, query_block=60)), brute(x)
    assert recall(got, want) >= 0.9 and got.keys() == want.keys()
    for q, found in got.items():
        assert len(found) == 20 and all(abs(s - x[q] @ x[v]) < 1e-12 for v, s in found)


def test_ties_copies_and_unusable_vectors(spark):
    e = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.5]]
    rows = [(i, e[i % 2 if i < 70 else 2]) for i in range(80)] + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, [float("inf"), 0.0])]
    got = collected(vs.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert set(got) == {0, 20, 40, 60}
    assert [v for v, _ in got[40]] == [i for i in range(0, 70, 2) if i != 40][:20]


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert [(v, s) for v, s in collected(vs.search(few))[0]] == [(2, 6.0), (1, 4.0)]
    assert vs.search(few.where("false")).count() == 0
    assert vs.search(few.where("vec_id = 0")).count() == 0


def test_vectors_of_different_lengths(spark):
    rng = np.random.default_rng(3)
    long, short = rng.normal(size=(90, 8)), rng.normal(size=(90, 3))
    rows = [(i, (long if i % 2 else short)[i // 2].tolist()) for i in range(180)] + [(200, [0.5]), (201, [])]
    got = collected(vs.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert set(got) == set(range(0, 180, 20))
    assert all(len(v) == 20 and all(i % 2 == 0 for i, _ in v) for v in got.values())


def test_sample_is_bounded_and_never_empty(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(2000)], "vec_id long, v array<double>")
    assert vs.sampled(rows, 2000, 50).shape == (50, 2)
    one = spark.createDataFrame([(7, [1.0, 2.0])] * 500, "vec_id long, v array<double>")
    assert 1 <= len(vs.sampled(one, 500, 5)) <= 5
