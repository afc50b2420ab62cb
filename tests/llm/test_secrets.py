import hashlib
import random
import re

from corpusloom.llm import secrets

PATTERNS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def brute(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, ok)) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if ok(m)]
    return [s for *_, s in sorted(found)]


def texts():
    rng = random.Random(3)
    parts = ["token = ", "PassWord:'", "api_key=", "apikey : \"", "secret=secret=", "token:secret:", "AKIA", "AKIAAKIA", "😀", "é\n", "deadbeef" * 3, "0123456789abcdef", "x", " ", "\n", "=", "ABCDEFGHIJ", "a1B2c3D4e5F6g7H8", "short", "İ"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    return [None, "", "token=abcdefghijk", "token=abcdefghijkl", *out, "word " * 30_000 + "token = 0123456789abcdef" + " word" * 10]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "c") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string"))).collect()}
    for i, t, _ in rows:
        want = brute(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, r.spans)
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in PATTERNS)


def sample(rng, n):
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))


def test_markov_models_find_random_strings_and_leave_words(spark):
    rng = random.Random(4)
    words = ["retrieval", "document", "threshold", "language", "internal", "ordering", "partition"]
    ident = lambda: "_".join(rng.choice(words) for _ in range(4))
    rows = [(i, f"{ident()} token = {sample(rng, 40)} {ident()}") for i in range(150)]
    rows += [(1000, f"note {sample(rng, 44)} end"), (1001, f"note {ident()} end")]
    got = {r.doc_id: r.spans for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1000] == "markov:5:49" and got[1001] == ""
    assert not any("markov" in got[i] for i in range(150))


def test_tokens_of_12_to_19_characters(spark):
    rng = random.Random(9)
    parts = ["re", "tri", "val", "doc", "ment", "thres", "hold", "lan", "guage", "ter", "nal", "or", "der", "ing", "par", "ti", "tion", "gen", "era", "Get", "User", "Name", "In", "_"]
    ident = lambda: "".join(rng.choice(parts) for _ in range(12))[: rng.randrange(12, 20)]
    rows = [(i, f"{' '.join(ident() for _ in range(20))} token = {sample(rng, 40)}") for i in range(400)]
    secret = {1000 + i: sample(rng, 12 + i % 8) for i in range(160)}
    rows += [(i, f"note {v} end") for i, v in secret.items()] + [(2000 + i, f"note {ident()} end") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.report(secrets.scan(docs)).collect()}
    found = [i for i, v in secret.items() if got[i] == f"markov:5:{5 + len(v)}"]
    false = [i for i in range(2000, 2160) if got[i]]
    assert len(found) >= 0.85 * len(secret) and len(false) <= 2
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert all(clean[i] == "note [SECRET] end" for i in found)


def test_ordinary_model_is_trained_on_words_of_12_letters(spark):
    rows = [(i, f"{w}ification password={'0123456789ab'}") for i, w in enumerate(["class", "ident", "spec", "just", "modif", "qual"] * 5)]
    table, limits = secrets.train(secrets.found(spark.createDataFrame(rows, "doc_id long, text string")))
    cell = lambda a, b: table[(secrets.ALPHABET.index(a) + 1) * (len(secrets.ALPHABET) + 1) + secrets.ALPHABET.index(b) + 1]
    assert cell("f", "i") < -1 < cell("f", "q") and len(limits) == 2 * (secrets.LONG - secrets.IDENTIFIER + 1)


def test_redaction_keeps_rows_and_columns(spark):
    key = "0123456789abcdef0123"
    rows = [(1, f"a token = {key} b", "s", 30), (None, "plain", None, None), (1, None, "s", 0), (2, f"{key}{key}", "s", 40)]
    out = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"))
    assert out.columns == ["doc_id", "text", "source", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(1, "a [SECRET] b", "s", 12), (None, "plain", None, None), (1, None, "s", 0), (2, "[SECRET]", "s", 8)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.report(secrets.scan(empty)).count() == 0


def test_redact_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "password = abcdefghijkl123", 9, "x", None), (2, None, 0, "y", "z")], "doc_id long, text string, assign int, __hex string, row string")
    got = sorted(tuple(r) for r in secrets.redact(df).collect())
    assert got == [(1, "[SECRET]", 9, "x", None), (2, None, 0, "y", "z")]


ORDINARY = """src/main/java/App 2024-01-15T10-30-00 kubernetes-deployment-v2 utf-8-validation iPhone14ProMax128 com/example/service /usr/local/bin/python3 http//example/path
0123456789012 getUserNameFromDatabase application/json node_modules/react-dom internationalization max_shuffle_partitions=200 v2025-11-28-build-17 README_first-draft
Content-Type/text-html com/google/android/gms customer_id_000123 ISO-8859-1-encoding windows-1252-codepage PostgreSQL15database requests_per_second ThreadPoolExecutor
x86_64-unknown-linux-gnu Donaudampfschifffahrt covid19vaccination report-2023-final-v3""".split()


def test_ordinary_strings_with_digits_and_signs_stay(spark):
    """Models of the given documents: ordinary strings aren't reported or overwritten, random ones are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    own = [(10**9 + i, f"see {t} here") for i, t in enumerate(ORDINARY)]
    keys = [(2 * 10**9 + i, f"see {sample(rng, 12 + i % 20)} here") for i in range(100)]
    both = docs.unionByName(spark.createDataFrame(own + keys, "doc_id long, text string"))
    clean = {r.doc_id: r.text for r in secrets.redact(both).where("doc_id >= 1000000000").collect()}
    assert {t for i, t in own if clean[i] != t} <= {"see iPhone14ProMax128 here"}  # one of 28
    assert sum(clean[i] == "see [SECRET] here" for i, _ in keys) >= 95


def test_scores_and_limits_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["".join(rng.choice("etaoin") for _ in range(rng.randrange(12, 24))) for _ in range(20)] + [f"token={sample(rng, 20)}", sample(rng, 15), "a-1-b-2-c-3-d-4"])) for i in range(60)]
    hits = secrets.found(spark.createDataFrame(rows, "doc_id long, text string"))
    table, limits = secrets.train(hits)
    place = lambda c: secrets.ALPHABET.find(c) + 1
    got = {r.doc_id: {(x.start, x.end) for x in r.markov} for r in secrets.with_markov(hits, table, limits).collect()}
    for i, text in rows:
        base = [m.span() for k, (p, ok) in PATTERNS.items() for m in p.finditer(text) if ok(m)]
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", text):
            t = m[0]
            mean = sum(table[place(a) * (len(secrets.ALPHABET) + 1) + place(b)] for a, b in zip(t, t[1:])) / (len(t) - 1)
            least = limits[min(len(t), secrets.LONG) - secrets.IDENTIFIER + (0 if t.isalpha() else secrets.LONG - secrets.IDENTIFIER + 1)]
            if mean >= least and re.search("[A-Za-z]", t) and not any(s < m.end() and m.start() < e for s, e in base):
                want.add(m.span())
        assert got[i] == want
    assert sum(map(len, got.values())) >= 10


def test_ratios_equal_a_plain_count():
    import math
    from collections import Counter

    n = len(secrets.ALPHABET) + 1
    cell = lambda a, b: (secrets.ALPHABET.index(a) + 1) * n + secrets.ALPHABET.index(b) + 1
    counts = Counter({(0, cell("a", "b")): 6, (0, cell("a", "-")): 2, (0, cell("b", "c")): 4, (1, cell("a", "7")): 3})
    table = secrets.ratios(counts)
    q = (6 + 0.5) / (8 + 0.5 * n)
    kind = (10 + 0.5 * 26) / (12 + 0.5 * n) / 26  # lower case after lower case
    p = 0.5 / (3 + 0.5 * n)
    want = math.log((0.5 / n + 0.5 * p) / ((1 - secrets.CLASSES) * q + secrets.CLASSES * kind))
    assert abs(table[cell("a", "b")] - want) < 1e-12 and table[cell("q", "z")] < 0 < table[cell("a", "7")]
