import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import suffix_dedup as sd


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, [2, 3, 4, 27, 200, 258][seed], 3000)
    t[500:900] = t[1500:1900]
    t = np.append(t, 0)
    raw = [tuple(t[i:].tolist()) for i in range(len(t))]
    few = sd.FEW
    for sd.FEW in (0, 10**9, few):  # by stretches, one by one, as in production
        assert sd.suffix_array(t, 258).tolist() == sorted(range(len(t)), key=raw.__getitem__)


def test_suffix_array_of_a_long_text_with_many_names():
    rng = np.random.default_rng(3)
    t = np.append(rng.integers(1, 27, 60_000), 0)
    t[20_000:26_000] = t[40_000:46_000]
    data = bytes(t.astype(np.uint8))
    assert sd.suffix_array(t, 258).tolist() == sorted(range(len(t)), key=lambda i: data[i : i + 8000])


def test_same_bytes():
    data = np.frombuffer(b"abcdefghijklmnop-abcdefghijklmnoq-abc" + bytes(8), np.uint8)
    got = sd.same_bytes(data, np.array([0, 0, 0, 3]), np.array([17, 17, 34, 20]), np.array([15, 16, 3, 0]))
    assert got.tolist() == [True, False, True, True]


def test_permuted_prefixes():
    rng = np.random.default_rng(1)
    t = rng.integers(97, 99, 2000).astype(np.uint8)
    sa = np.array(sorted(range(1900), key=lambda i: t[i:].tobytes()))
    got = sd.permuted_prefixes(t, sa)
    for a, b in zip(sa, sa[1:], strict=False):
        k = 0
        while k < 50 and b + k < 2000 and a + k < 2000 and t[a + k] == t[b + k]:
            k += 1
        assert got[b] == k


def test_equals_brute_force(spark):
    rng = random.Random(14)
    vocab = ["the", "of", "élan", "ing", "tion", "re", "x", "\n", "漢字"]
    text = lambda n: " ".join(rng.choice(vocab) + str(rng.randrange(99)) for _ in range(n))
    base = [text(rng.randrange(5, 60)) for _ in range(25)]
    rows = []
    for i in range(120):
        t = text(rng.randrange(0, 30))
        if rng.random() < 0.6:
            b = rng.choice(base)
            cut = sorted(rng.randrange(len(b)) for _ in range(2))
            t = t[: len(t) // 2] + b[cut[0] : cut[1] + 1] + t[len(t) // 2 :]
        rows.append((i * 31 % 997, t))
    rows += [(2000, "a" * 400), (2001, "b" + "a" * 120), (2002, "ab" * 200), (2003, "ab" * 40), (2004, None), (2005, ""), (2006, base[0]), (2007, base[0]), (2007, base[0]), (1, base[0] * 9)]
    frame = spark.createDataFrame([(i, t, b"k") for i, t in rows], "doc_id long, text string, kept binary")
    for n_shards, chunk in ((3, 600), (7, 1 << 20)):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.deduplicate(frame.repartition(3), n_shards, chunk).collect())
        assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert sd.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "q" * 60), (5, "q" * 60), (5, "q" * 60)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in sd.deduplicate(rows).collect()), key=str)
    assert got == [(5, 0), (5, 0), (None, 60)]


def test_only_contexts_that_may_share_a_string_are_sorted():
    """Contexts with one anchor: those that share 50 bytes around it are kept whatever the side, those that share 45 aren't."""
    rng = random.Random(9)
    letters = lambda n, of="abcdefghij": "".join(rng.choice(of) for _ in range(n))
    anchor, spans, want = letters(sd.ANCHOR), [], []
    for left in range(27):
        for shared in (26, 21):
            if left <= shared:
                near, far = letters(left), letters(shared - left)
                for other in ("klmnop", "qrstuv"):
                    spans.append(letters(26 - len(near), other) + near + anchor + far + letters(26 - len(far), other))
                    want.append(shared == 26)
    data = np.frombuffer("".join(spans).encode(), np.uint8)
    lo = np.cumsum([0, *map(len, spans)])
    at = np.array([s.index(anchor) for s in spans]) + lo[:-1]
    assert sd._alike(sd.prefix_sums(data), lo[:-1], at, lo[1:]).tolist() == want
