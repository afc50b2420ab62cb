import random

from corpusloom.llm import near_copies


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows):
    """Ids that stay: the least of each component of pairs at 0.8 or more."""
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}
    pairs = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[x + 1 :] if jaccard(a, b) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return {i for i in comp if comp[i] == i}


def copies(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def kept(spark, rows):
    return sorted(r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_replaced_words_are_near_copies(spark):
    rng = random.Random(6)
    rows, near = [], 0
    for n, changes in ((60, 1), (200, 1), (200, 3), (1000, 5), (1000, 20)):
        for _ in range(20):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            copy = copies(rng, base, changes)
            near += jaccard(shingles(" ".join(base)), shingles(copy)) >= 0.8
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, copy)]
    got = kept(spark, rows)
    assert near > 90 and set(got) == brute(rows) and len(got) == len(rows) - near


def test_equals_brute_force_over_chains_and_large_groups(spark):
    rng = random.Random(7)
    rows = [(900, None), (901, " \n"), (902, ""), (903, "one"), (904, "One"), (905, "two words"), (906, "two word")]
    for g in range(12):
        text = [f"g{g}w{rng.randrange(300)}" for _ in range(120)]
        for _ in range(12):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    assert set(kept(spark, rows)) == brute(rows)


def test_empty_table_and_missing_ids(spark):
    assert kept(spark, []) == []
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e  f")]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in got), key=str) == [2, None, None]


def test_rows_of_one_id_with_different_texts(spark):
    # id 5 has a copy of id 1's text, and texts of its own
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (5, "G h i j k l"), (5, "m n o p q r")]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in got) == [(1, "a b c d e f"), (5, "g h i j k l"), (5, "m n o p q r")]


def test_buckets_of_many_parts_are_compared_in_blocks(spark, monkeypatch):
    """Texts that share bands but mostly aren't similar; small blocks give the same links."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, copies(rng, base[: 60 + i % 20], rng.randrange(0, 9))) for i in range(120)]
    members = spark.createDataFrame([(k, i, len(shingles(t)), i // 3) for k in (1, 2) for i, t in rows], "key long, class long, size long, part long")
    texts = spark.createDataFrame(rows, "class long, text string")
    want = {(i, j) for x, (i, a) in enumerate(rows) for j, b in rows[x + 1 :] if i // 3 != j // 3 and jaccard(shingles(a), shingles(b)) >= 0.8}
    for size in (512, 7):
        monkeypatch.setattr(near_copies, "BLOCK_CLASSES", size)
        monkeypatch.setattr(near_copies, "TOGETHER", 16 if size == 7 else 2048)
        got = near_copies.similar_in_blocks(members, texts).collect()
        # pairs within a bucket's largest part are never needed; all others are there once
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 50


def thue_morse(n, a, b):
    word = a
    other = b
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


def test_words_that_collide_under_polynomial_hashes_are_told_apart(spark):
    x, y = thue_morse(2048, "a", "b")
    rows = [(1, f"{x} one two three four five six"), (2, f"{y} one two three four five six"), (3, x), (4, y)]
    assert kept(spark, rows) == [1, 2, 3, 4]


def test_fingerprints_propose_and_the_shingles_decide(spark, monkeypatch):
    """The trie join links classes by itself, its wrong links are dropped, and what it misses comes from the buckets."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, copies(rng, base, 40)), (4, "other " * 9), (5, "a b c d e f"), (6, "a b c d e f a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = near_copies.marked(docs).cache()
    names = {r["class"]: r.id for r in marked.select("class", "row.doc_id").toDF("class", "id").collect()}
    links = {tuple(sorted((names[r.a], names[r.b]))) for r in near_copies.by_fingerprint(marked).collect()}
    assert (1, 2) in links and not any(4 in pair for pair in links)
    asked = []
    whole = near_copies.hamming_links
    monkeypatch.setattr(near_copies, "hamming_links", lambda kinds, radius: asked.append(radius) or whole(kinds, radius))
    assert set(kept(spark, rows)) == brute(rows) and asked == [near_copies.RADIUS]
    monkeypatch.setattr(near_copies, "RADIUS", 2)
    monkeypatch.setattr(near_copies, "hamming_links", lambda kinds, radius: whole(kinds, 64))  # every fingerprint seems near
    assert set(kept(spark, rows)) == brute(rows)


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_are_like_no_other_are_not_shuffled(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"{rng.randrange(16**6):x}" for _ in range(3000))) for i in range(200)]
    rows += [(1000, rows[3][1]), (1001, copies(rng, rows[4][1].split(), 9)), (1001, rows[5][1]), (7, rows[7][1].upper())]
    before = shuffled(spark)
    assert kept(spark, rows) == list(range(200))
    moved = shuffled(spark) - before
    assert 0 < moved < 0.5 * sum(len(t) // 2 for _, t in rows)  # a hexadecimal digit holds half a byte


def test_bitmaps_rule_out_only_what_is_not_asked_for(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id * id - 7 as class", "id")
    for n in (0, 1, 300, 5000):
        names = spark.range(n).selectExpr("id * id * 9 - 7 as name")
        for most in (26, 8):  # of 8: nearly every bit is set
            monkeypatch.setattr(near_copies, "BITMAP", most)
            want = {i * i * 9 - 7 for i in range(n)}
            got = near_copies.flagged(rows, "class", names).collect()
            assert len(got) == 5000 and all(r.asked for r in got if r["class"] in want)
            assert most == 8 or sum(r.asked for r in got) <= len(want) + 600
            assert near_copies.possible(rows, "class", names).count() == sum(r.asked for r in got)
