import random
import re

from corpusloom.llm import quality_rules

BLANK = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(BLANK, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [s for s in text.split("\n") if re.search(BLANK, s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def rows(spark, texts):
    data = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    return quality_rules.apply(spark.createDataFrame(data, "doc_id long, text string, failed string, n_words double"))


def check(spark, texts):
    got = {r.doc_id: r for r in rows(spark, texts).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    return got


def texts(seed=3, n=150):
    rng = random.Random(seed)
    out = [None, "", " \n\t\x0b\x0c\r ", "a", "a b c d e", "a b c d e f", "x " * 9, "x " * 10, " a b\x85c d", "ß|é\n\nß|é\n", "#*$%&|<>!"]
    for _ in range(n):
        words = [rng.choice(["a", "b", "the", "é", "x#", "1"]) for _ in range(rng.randrange(40))]
        out.append("".join(w + rng.choice([" ", "\n", "\t ", "\r\n", "\x0b"]) for w in words))
    return out


def test_counts_equal_brute_force(spark):
    check(spark, texts())


def test_texts_whose_hashes_do_not_decide_are_compared_by_words(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 3)  # longer texts take the sorted windows
    check(spark, texts(5, 60))
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 62)  # two bits of hash: most windows collide
    check(spark, texts(6, 60))


def test_rules_and_long_texts(spark):
    clean = " ".join(f"the river{i} ran on and nobody{i} of town." for i in range(30))
    long = " ".join(f"word{i} the of" for i in range(200_000))
    got = check_rules(spark, [clean, "### " + "bad# $word " * 40, "WAKE UP!! " * 30, " ".join(f"zx{i}" for i in range(60)), long, "- the a\n" * 60])
    assert [got[i].kept for i in range(6)] == [True, False, False, False, True, False]
    assert "symbols" in got[1].failed and "exclamations" in got[2].failed and got[3].failed == "stop_words" and "bullet_lines" in got[5].failed
    assert got[4].n_words == 600_000 and got[4].n_repeat_words == 0


def check_rules(spark, texts):
    return {r.doc_id: r for r in rows(spark, texts).collect()}


def test_no_user_function_and_no_shuffle(spark):
    plan = rows(spark, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_and_repeated_rows(spark):
    assert rows(spark, []).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert quality_rules.apply(twice).count() == 3
