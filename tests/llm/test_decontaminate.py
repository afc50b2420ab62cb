import random
import re

from corpusloom.llm import decontaminate as d


def brute(docs, items):
    """All diagonals, all segments."""
    words = lambda t: [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]
    out = set()
    for i, t in docs:
        a = words(t)
        for k, u in items:
            b = words(u)
            for g in range(-len(b), len(a)):
                same = [j for j in range(max(0, -g), min(len(b), len(a) - g)) if a[j + g] == b[j]]
                if any(y - x + 1 >= min(10, len(b)) and y - x + 1 >= 0.8 * (same[y] - same[x] + 1) for x in range(len(same)) for y in range(x, len(same))):
                    out.add((i, k))
    return out


def case():
    rng = random.Random(5)
    vocab = [f"tok{i}" for i in range(3000)] + ["Élan", "straße"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 50)))) for k in range(30)]
    docs = []
    for i in range(120):
        filler = [rng.choice(vocab) for _ in range(rng.randrange(0, 150))]
        if i % 3 == 0:
            w = items[i % 30][1].split()
            for _ in range(len(w) // 8 if i % 2 else 0):
                w[rng.randrange(len(w))] = "changed"
            if i % 4 == 0:
                w = w[: max(12, len(w) // 2)]
            at = rng.randrange(len(filler) + 1)
            filler[at:at] = [x.upper() + "," if x.isascii() else x for x in w]
        docs.append((i, " ".join(filler)))
    return docs + [(900, None), (901, ""), (902, "tok1")], items


def test_finds_what_brute_force_finds(spark):
    docs, items = case()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (77, None), (78, "too short")], "item_id long, text string")
    got = d.find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    in_blocks = {(r.doc_id, r.item_id) for r in d.find_leaks(frame, bench, most=100).collect()}
    assert in_blocks == brute(docs, items)
    kept = {r.doc_id for r in d.drop_leaks(frame, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in brute(docs, items)}


def test_empty_tables_and_repeats(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert d.find_leaks(none, bench).count() == 0 == d.find_leaks(none, none.withColumnRenamed("doc_id", "item_id")).count()
    rows = spark.createDataFrame([(5, "x A b. C d e f g h i j k l m n y")] * 3, "doc_id long, text string")
    got = d.find_leaks(rows, bench).collect()
    assert [(r.doc_id, r.item_id, r.token_start, r.n_tokens, r.n_equal) for r in got] == [(5, 1, 1, 14, 14)] * 3


def check_equals_brute_force(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = d.find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.n_equal >= 0.8 * r.n_tokens for r in got)
    assert {r.doc_id for r in d.drop_leaks(frame, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    return want


def test_evenly_replaced_tokens(spark):
    items = [(n, " ".join(f"i{n}t{k}" for k in range(n))) for n in (5, 8, 10, 11, 13, 15, 25, 60, 100)]
    docs = []
    for n, text in items:
        for every in (4, 5, 6):
            for first in range(every):
                w = [f"r{k}" if k % every == first else t for k, t in enumerate(text.split())]
                docs.append((len(docs), " ".join(["before"] * (first * 7) + w + ["after"] * 9)))
    want = check_equals_brute_force(spark, docs, items)
    hundred = [(i, k) for i, k in want if k == 100]
    assert len(hundred) >= 10


def test_short_items_and_items_without_an_id(spark):
    items = [(1, "Alpha beta, gamma delta"), (2, "epsilon"), (3, "beta gamma"), (4, "beta GAMMA"), (5, "..."), (None, "one two three four five six"), (None, "zeta eta")]
    docs = [(0, "x alpha BETA gamma; delta y beta gamma"), (1, "alpha beta gamma x delta"), (2, "epsilon " * 500), (3, "delta epsilo beta"), (4, "beta"), (5, "gamma"), (6, "say one two three four five six"), (7, "zeta eta"), (8, None), (9, "")]
    want = check_equals_brute_force(spark, docs, items)
    assert want == {(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (2, 2), (6, None), (7, None)}
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.item_id, r.token_start, r.n_tokens) for r in got.where("doc_id = 0").collect()) == [(1, 1, 4), (3, 2, 2), (4, 2, 2)]


def test_short_run_does_not_hide_a_longer_overlap(spark):
    # 9 equal tokens score best; the 12 of 14 after them are the leak
    text = [f"t{k}" for k in range(60)]
    w = list(text)
    for k in [*range(9, 30), 34, 39, *range(44, 60)]:
        w[k] = f"r{k}"
    assert check_equals_brute_force(spark, [(1, " ".join(w)), (2, " ".join(w[:30]))], [(7, " ".join(text))]) == {(1, 7)}


def test_random_overlaps(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"i{k}t{j}" for j in range(rng.choice([5, 7, 10, 12, 20, 45])))) for k in range(40)]
    docs = []
    for i in range(300):
        text, share = items[i % 40][1].split(), rng.choice([0.1, 0.15, 0.2, 0.25, 0.3])
        w = [f"r{rng.randrange(9999)}" if rng.random() < share else t for t in text]
        docs.append((i, " ".join(["x"] * rng.randrange(4) + w + ["y"] * rng.randrange(4))))
    assert len(check_equals_brute_force(spark, docs, items)) > 50
