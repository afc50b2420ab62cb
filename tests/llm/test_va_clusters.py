import hashlib
import math
import random

import numpy as np
import pytest

from corpusloom.llm import va_clusters

D = va_clusters.DIMENSIONS


def brute(rows, rounds=10, most=8):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == D and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))
    cents = [list(v) for _, v in order[:most]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            if mine:
                cents[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(r[2] for r in last)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, k, d, sum(r[2] for r in last if r[1] == k), total, sha[k]) for i, k, d in last), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, distance string")


def sample(n=300, seed=2):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.2) for _ in range(D)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.08))) for c in rng.choice(centers)]) for i in range(n)]
    odd = [(None, rows[3][1]), (7, rows[7][1]), (1000, None), (1001, [0.5]), (1002, [*rows[0][1][:-1], None]), (1003, [*rows[0][1][:-1], float("nan")]), (1004, [*rows[0][1][:-1], float("inf")]), (1005, [0.0] * D)]
    return rows + odd + [(2000 + i, rows[0][1]) for i in range(150)]  # a third of the rows are one vector


def got(spark, rows, **more):
    return sorted((tuple(r) for r in va_clusters.cluster(frame(spark, rows), **more).collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    rows = sample()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_bits_of_a_cell_do_not_change_rows(spark, bits):
    rows = sample(60, 4)
    assert got(spark, rows, bits=bits, rounds=3) == brute(rows, 3)


def test_few_and_no_vectors(spark):
    rows = sample(20, 5)[:3]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None)]) == []
    same = [(i, [0.25] * D) for i in range(12)]
    assert got(spark, same) == brute(same)  # every centroid is the same: all go to number 0


def test_components_without_an_exact_distance_end_the_job(spark):
    with pytest.raises(Exception, match="no exact squared distance"):
        got(spark, [(1, [1e30] * D)])


def test_intervals_hold_every_distance():
    rng = np.random.default_rng(1)
    x, cents = rng.integers(-300, 300, (200, D)), rng.integers(-300, 300, (4, D))
    low, high = x.min(0)[:, None], x.max(0)[:, None]
    edges = low + (high + 1 - low) * np.arange(9) // 8
    cell = np.stack([np.searchsorted(edges[j], x[:, j], "right") - 1 for j in range(D)], 1)
    low, high = va_clusters.intervals(cell, (x**2).sum(1), va_clusters.lookup(edges, cents))
    far = np.stack([((x - c) ** 2).sum(1) for c in cents], 1)
    assert (low <= far).all() and (far <= high).all() and (low < high).any()


def test_fetching_joins_at_the_vectors_and_leaves_most_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    with va_clusters.stored(va_clusters.integers(docs)) as (plain, bucketed):
        edges = va_clusters.edges_of(plain)
        before = va_clusters.fit(plain, bucketed, rounds=3)
        after = va_clusters.fit(plain, bucketed, rounds=4)
        need = va_clusters.undecided(va_clusters.cells(plain, edges), edges, after, before)
        fetch = need.join(bucketed, "row")
        assert fetch.count() == need.count() < 0.5 * plain.count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            plan = need.join(bucketed, "row")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert plan.count("Exchange hashpartitioning") == 1  # row numbers move, vectors don't
