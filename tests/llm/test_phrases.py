import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from corpusloom.llm import phrases


def brute(docs, least, top):
    f, n, out = Counter(), Counter(), []
    for lang, text in docs:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {}
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside.get((lang, p[i : i + m]), 0), a)
    for (lang, p), a in cand.items():
        if inside.get((lang, p), 0) >= a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    best = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        best += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(best)


def sample(seed=1, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "él", "ß", "x" * 30, "日本"]
    docs = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = ["New", "York", "city", "hall", "steps"]
        text = "".join(x + rng.choice([" ", " ", " ", "\t", ", ", "\n", ".", "\xa0"]) for x in w)
        docs.append((rng.choice(["en", "en", "de", None]), text))
    return docs + [(None, None), ("fr", ""), ("fr", "one two"), *[("es", "uno dos tres")] * 30]


def mined(spark, docs, **more):
    data = [(*d, 1, "n") for d in docs]
    return sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(data, "lang string, text string, rank int, phrase string"), **more).collect())


@pytest.mark.parametrize(("shards", "seed"), [(2, 1), (1, 2), (4, 3)])
def test_phrases_equal_brute_force(spark, shards, seed):
    docs = sample(seed)
    assert mined(spark, docs, least=10, top=40, shards=shards) == brute(docs, 10, 40) != []


def test_crowded_bitmaps_change_nothing(spark, monkeypatch):
    docs = sample(4, 120)
    monkeypatch.setattr(phrases, "LEAST_BITS", 8)
    monkeypatch.setattr(phrases, "MOST_BITS", 8)  # nearly every hash seems to have reached the threshold
    assert mined(spark, docs, least=8, top=1000, shards=2) == brute(docs, 8, 1000)


def test_blocks_cut_long_texts_between_words():
    import numpy as np

    data = np.frombuffer(b"aa bb cc. dd ee ff gg hh ii" + b"jj kk", np.uint8)
    offsets = np.array([0, 27, 32])
    seen = []
    for fresh, starts, ends, row in phrases.blocks(offsets, data, 6):
        seen += [(data[s:e].tobytes(), r) for f, s, e, r in zip(fresh, starts, ends, row, strict=True) if f]
        assert fresh.sum() >= 1 and (~fresh).sum() <= 4
    assert seen == [(w, 0) for w in b"aa bb cc. dd ee ff gg hh ii".replace(b".", b"").split()] + [(b"jj", 1), (b"kk", 1)]


def test_long_text_and_empty_table(spark):
    docs = [("en", "alpha beta gamma " * 150_000), ("en", "w" * 100_000)]
    got = mined(spark, docs)
    assert got == brute(docs, 100, 2000) != []
    assert mined(spark, []) == [] and mined(spark, [("en", None)]) == []


def test_last_counts_are_packed_and_summed_by_words(spark, monkeypatch):
    """However many phrases a task holds, it sends one row for each part; small limits and bits that all are set give the same counts."""
    docs = sample(5, 200)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "EACH", 7)
    assert mined(spark, docs, least=10, top=1000) == brute(docs, 10, 1000) != []
    counts = pa.table({"lang": ["en", "de"] * 5000, "phrase": pa.array([b"p%d" % (i // 2) for i in range(10_000)], pa.large_binary()), "k": pa.array([1] * 10_000, pa.int32()), "f": list(range(10_000))})
    parts = {at: pa.ipc.open_stream(t).read_all() for at, t in phrases.packed(counts, 13)}
    assert len(parts) == 13 and sum(map(len, parts.values())) == 10_000
    again = {at: pa.ipc.open_stream(t).read_all() for at, t in phrases.packed(counts.slice(4000, 10), 13)}
    assert all(set(t["f"].to_pylist()) <= set(parts[at]["f"].to_pylist()) for at, t in again.items())
