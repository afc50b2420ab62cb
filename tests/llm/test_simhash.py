import random

import numpy as np
import xxhash

from corpusloom.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, rep string")


def test_matches_brute_force_with_small_leaves(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "THE"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 30, 200]))] for _ in range(25)]
    texts = [None, "", " \n\t", "one", "one", "two words"]
    for b in base:
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randrange(3)):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            texts.append(" ".join(c))
        texts.append(" ".join(b))
    rows = [(i * 3, t, "clash", "clash") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    want_fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(want_fp)
    for leaves in (4096, 3):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, rows), leaves=leaves).collect()}
        assert got == {i: (f"{want_fp[i]:016x}", want[i]) for i in want_fp}


def test_trie_pairs_equals_all_pairs():
    rng = np.random.default_rng(2)
    core = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    a = np.unique(np.concatenate([core, *(core ^ (np.uint64(1) << rng.integers(0, 64, 6).astype(np.uint64)) for _ in range(40))]))
    i, j = simhash.trie_pairs(a, a, 2, True, leaf=4)
    want = {(x, y) for x in range(len(a)) for y in range(x + 1, len(a)) if int(a[x] ^ a[y]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_empty_and_repeated_rows(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    rows = [(7, "a b c d", "x", "y")] * 3 + [(2, "a b c d", "x", "y")]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {2}


def test_long_text_needs_no_prefix(spark):
    long = " ".join(f"t{i}" for i in range(70_000))
    got = simhash.near_duplicates(docs_of(spark, [(1, long, "", ""), (2, long + " tail", "", "")])).collect()
    assert {r.fingerprint for r in got} == {f"{brute_fingerprint(long):016x}", f"{brute_fingerprint(long + ' tail'):016x}"}
