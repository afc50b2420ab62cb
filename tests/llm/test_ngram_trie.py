import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import ngram_trie as lm

U64 = np.uint64


def brute(rows, order, s=lm.STRENGTH):
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = [defaultdict(Counter) for _ in range(order)]

    def contexts(w, i):
        for k in range(order):
            yield tuple(["<s>", *w][max(0, i + 1 - k) : i + 1]) if k else ()

    for i, t in rows:
        if not held(i):
            w = toks(t)
            for j, x in enumerate(w):
                for k, h in enumerate(contexts(w, j)):
                    counts[k][h][x] += 1
    uni = counts[0][()]
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        w = toks(t)
        base = total = 0.0
        for j, x in enumerate(w):
            p = b = (uni[x] + 0.1) / (n + 0.1 * (v + 1))
            for k, h in enumerate(contexts(w, j)):
                c = counts[k].get(h)
                if k and c:
                    z = sum(c.values()) + s * len(c)
                    p = c[x] / z + s * len(c) / z * p
            base, total = base + math.log10(b), total + math.log10(p)
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, base, total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rng = random.Random(13)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "THE", "ÉTÉ"]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([5, 63])]) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "w1 w2"), (3, rows[3][1]), (3, rows[3][1]), (900, "w1 " * 5000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    got = lm.score(frame, order, n_shards=5, chunk_bytes=2000).collect()
    want = brute(rows, order)
    key = lambda r: (str(r[0]), r[2])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert g.score == pytest.approx(w[6], abs=1e-4 * g.n_tokens)  # half a quantisation step each


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_elias_fano(n, tmp_path):
    rng = np.random.default_rng(3)
    x = np.sort(np.concatenate([rng.integers(0, 1 << 48, n // 2), rng.integers(5000, 6000, n - n // 2)]).astype(U64))
    with open(tmp_path / "bits", "w+b") as f:
        ef = lm.EliasFano(x, 1 << 48).mapped(f).open()
        assert (ef.get(np.arange(n)) == x).all()
        q = np.concatenate([x, x + U64(1), rng.integers(0, 1 << 48, 100).astype(U64)])
        at, hit = ef.find(q)
        assert (at == np.searchsorted(x, q)).all() and (hit == np.isin(q, x)).all()


def test_long_words_that_collide_under_polynomial_hashes_are_unknown(spark):
    x, y = "a", "b"
    while len(x) < 2048:
        x, y = x + y, y + x
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = spark.createDataFrame([(ids[0], x), (held, f"{y} z")], "doc_id long, text string")
    got = {r.doc_id: r.n_known for r in lm.score(rows).collect()}
    assert got == {ids[0]: 2, held: 1}
