"""Secret scanning with DataFrame functions only: fixed patterns, then character Markov models.

Positions come without a Python loop: ``split`` by a pattern gives the text between its matches and
``regexp_extract_all`` the matches, so running sums of their lengths (in code points) are the spans.

The Markov stage scores every other token of twelve characters or more by the log-likelihood ratio of two
character-bigram models, one of random strings and one of ordinary identifiers. Both are counted over labelled samples:
the values inside the base matches are random strings, mixed with uniform ones since most of them are digits or hex.
Ordinary identifiers are the words of twelve letters or more outside them, each by its hash in one of nine forms: as it is, as a
path, with hyphens, underscores, capitals, an equals sign or numbers, or as a time stamp. Character pairs that no sample
has fall back on pairs of character classes, so foreign words aren't random. A fifth of the distinct samples is held out
and sets the threshold of each length, for letters alone and for mixed tokens. Tokens without a letter are never reported.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import written

#: The base kinds in their order, pattern and least length (of group 2 for assign).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens the Markov models look at and the least length of a sample; lengths from LONG on share a threshold.
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
IDENTIFIER = 12
LONG = 20
#: Characters of the models, in natural order; any other counts as the last.
ALPHABET = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
#: Least mean log-likelihood ratio (nats a bigram) of a reported token of a length with fewer than HELD_OUT held-out words.
THRESHOLD = 0.5
SMOOTHING = 0.5
#: Weight of uniform strings in the random model, and the share of a length's held-out words that may be reported.
UNIFORM = 0.5
#: Weight of character classes in the ordinary model.
CLASSES = 0.15
FALSE_SHARE = 0.001
HELD_OUT = 100

Span = "array<struct<start:int,end:int,hit:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` (never empty) as structs (start, end, hit), end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {Span})").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), x["hit"].alias("hit")))).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.when(F.size(hits) == 0, F.expr(f"cast(array() as {Span})")).otherwise(F.aggregate(zipped, start, add, lambda a: a["out"]))


def found(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, assign, access, hex, tokens): the spans of each kind and of the tokens for the Markov models."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *[spans(F.col("text"), p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("tokens", TOKEN))])
    value = lambda x: F.length(x["hit"]) - F.length(F.regexp_extract(x["hit"], ASSIGN_HEAD, 0)) >= 12
    return rows.withColumn("assign", F.filter("assign", value))


def _instr(char: Column) -> Column:
    return F.call_function("instr", F.lit(ALPHABET), char)


def _bigram(token: Column, i: Column) -> Column:
    """Cell of the bigram that starts at character i (from 1) of ``token`` in a square table."""
    n = len(ALPHABET) + 1
    return _instr(F.substring(token, i, F.lit(1))) * n + _instr(F.substring(token, i + 1, F.lit(1)))


def _score(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of the bigrams of ``token``."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda a, i: a + F.get(model, _bigram(token, i)))
    return total / (F.length(token) - 1)


def _forms(word: Column) -> Column:
    """One of the forms of an ordinary identifier made of ``word``, chosen by its hash."""
    h = F.pmod(F.xxhash64(word), F.lit(1 << 40))
    part = lambda i, n=None: F.substring(word, i, F.lit(n or 1 << 20))
    digits = lambda n, shift: F.lpad((F.shiftright(h, shift) % 10**n).cast("string"), n, "0")
    upper = lambda i, n=None: F.initcap(part(i, n))
    forms = [
        word, F.concat(part(1, 4), F.lit("/"), part(5, 5), F.lit("/"), part(10)), F.concat(part(1, 5), F.lit("-"), part(6, 5), F.lit("-"), part(11)), F.concat(part(1, 5), F.lit("_"), part(6)),
        F.concat(part(1, 5), upper(6, 5), upper(11)), F.concat(part(1, 5), F.lit("="), part(6)), F.concat(part(1, 8), F.when(h % 2 == 0, "-v").otherwise(""), digits(1, 5), F.when(h % 3 == 0, digits(3, 9)).otherwise("")),
        F.concat(F.lit("20"), digits(2, 3), F.lit("-"), digits(2, 11), F.lit("-"), digits(2, 17), F.when(h % 2 == 0, F.concat(F.lit("T"), digits(2, 23), F.lit("-"), digits(2, 5))).otherwise(F.concat(F.lit("_"), part(1, 6)))),
        F.concat(part(1, 5), digits(2, 4), upper(6, 3), upper(9, 4), digits(3, 13)),
    ]
    return F.element_at(F.array(*forms), (F.pmod(F.xxhash64(word, F.lit(7)), F.lit(len(forms))) + 1).cast("int"))


def _mixed(token: Column) -> Column:
    """1 for tokens with other characters than letters, else 0."""
    return (~token.rlike("^[A-Za-z]+$")).cast("int")


def train(hits: DataFrame, threshold: float = THRESHOLD) -> tuple[list[float], list[float]]:
    """Log-likelihood ratios (random against ordinary) of all character bigrams, as one flat table, and the least
    score of a reported token by its length from IDENTIFIER to LONG, first of letters alone, then of mixed tokens.

    The samples are all base values (random) and all words of letters outside them, in their forms (ordinary), of ``hits``. The
    counts are combined before the shuffle; the result has a fixed size, whatever the input. Without samples of a
    class its model is uniform. A length's least score leaves FALSE_SHARE of its held-out ordinary samples above it
    and is never below even odds (0); without HELD_OUT such samples it is that of all lengths, and ``threshold`` at least.
    """
    n = len(ALPHABET) + 1
    base = F.flatten(F.array(*[F.transform(F.col(k), lambda x: F.regexp_replace(x["hit"], ASSIGN_HEAD, "")) for k in KINDS[:3]]))
    plain = F.transform(F.filter("tokens", lambda x: x["hit"].rlike("^[A-Za-z_]+$") & _free(x)), lambda x: _forms(x["hit"]))
    samples = hits.select(F.explode(F.concat(F.transform(base, lambda v: F.struct(v.alias("v"), F.lit(1).alias("random"))), F.transform(plain, lambda v: F.struct(v.alias("v"), F.lit(0).alias("random"))))).alias("s")).select("s.v", "s.random").where(F.length("v") >= IDENTIFIER)
    samples = samples.withColumn("held", F.pmod(F.xxhash64("v"), F.lit(5)) == 0)
    cells = samples.where("not held").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: _bigram(F.col("v"), i))).alias("cell"))
    counts = {(r["random"], r["cell"]): r["count"] for r in cells.groupBy("random", "cell").count().collect()}
    table = ratios(counts)
    scored = samples.where("held and random = 0").select(F.least(F.length("v"), F.lit(LONG)).alias("size"), _mixed(F.col("v")).alias("mixed"), _score(F.col("v"), F.lit(table)).alias("score"))
    ends = scored.unionByName(scored.withColumn("size", F.lit(0))).groupBy("size", "mixed").agg(F.count("*").alias("n"), F.percentile_approx("score", 1 - FALSE_SHARE, 10_000).alias("high")).collect()
    high = {(r["mixed"], r["size"]): max(0.0, r["high"]) for r in ends if r["n"] >= HELD_OUT}
    return table, [high.get((m, k), max(threshold, high.get((m, 0), 0.0))) for m in (0, 1) for k in range(IDENTIFIER, LONG + 1)]


def _kind(at: int) -> str:
    """Class of the character at a place of ALPHABET (from 1; 0 is any other)."""
    c = ALPHABET[at - 1] if at else ""
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else c or "other"


def ratios(counts: dict[tuple[int, int], int]) -> list[float]:
    """Log-likelihood ratios of all bigrams from the counts by (random, cell)."""
    n = len(ALPHABET) + 1
    kinds = [_kind(a) for a in range(n)]
    size = Counter(kinds)
    of = lambda c, a, b: counts.get((c, a * n + b), 0)
    sums = {(c, a): sum(of(c, a, b) for b in range(n)) for c in (0, 1) for a in range(n)}
    pairs, heads = Counter(), Counter()
    for a in range(n):
        for b in range(n):
            pairs[kinds[a], kinds[b]] += of(0, a, b)
            heads[kinds[a]] += of(0, a, b)
    table = []
    for a in range(n):
        for b in range(n):
            p, q = ((of(c, a, b) + SMOOTHING) / (sums[c, a] + SMOOTHING * n) for c in (1, 0))
            by_kind = (pairs[kinds[a], kinds[b]] + SMOOTHING * size[kinds[b]]) / (heads[kinds[a]] + SMOOTHING * n) / size[kinds[b]]
            table.append(math.log((UNIFORM / n + (1 - UNIFORM) * p) / ((1 - CLASSES) * q + CLASSES * by_kind)))
    return table


def _free(x: Column) -> Column:
    """Whether a span touches no base span."""
    return reduce(lambda a, b: a & b, [~F.exists(F.col(k), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])) for k in KINDS[:3]])


def with_markov(hits: DataFrame, table: list[float], limits: list[float]) -> DataFrame:
    """Adds ``markov``: the token spans outside every base span whose mean log-likelihood ratio reaches their length's limit."""
    model, least = F.lit(table), F.lit(limits)
    limit = lambda x: F.get(least, F.least(F.length(x["hit"]), F.lit(LONG)) - IDENTIFIER + (LONG - IDENTIFIER + 1) * _mixed(x["hit"]))
    return hits.withColumn("markov", F.filter("tokens", lambda x: x["hit"].rlike("[A-Za-z]") & _free(x) & (_score(x["hit"], model) >= limit(x))))


def _tags(kind: str) -> Column:
    tag = lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))
    return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), tag(x).alias("tag")))


def _listing(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(F.array_sort(F.concat(*map(_tags, kinds))), lambda x: x["tag"]), ",")


def scan(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, assign, access, hex, markov) spans of every row of ``docs``.

    A null text is empty and has no spans. Repeated rows stay repeated; other columns are not read. Both models
    come from the same texts; an empty table gives an empty result.
    """
    hits = written(found(docs, text, key), "secret-spans")
    return with_markov(hits, *train(hits, threshold))


def report(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans), one row a document."""
    return scanned.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listing(KINDS[:3]), 256).alias("base_sha256"), _listing(KINDS).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ..., n_chars) with every found span replaced by ``mark``; all rows and columns stay,
    whatever their names.

    Spans are cut out of the row's own text, so a repeated or null doc_id does no harm. n_chars, if there is one,
    is counted anew where something was replaced.
    """
    row = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), *[spans(text, p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("tokens", TOKEN))])
    value = lambda x: F.length(x["hit"]) - F.length(F.regexp_extract(x["hit"], ASSIGN_HEAD, 0)) >= 12
    named = written(hits.withColumn("assign", F.filter("assign", value)), "secret-rows")
    named = with_markov(named, *train(named, threshold))
    every = F.array_sort(F.concat(*[F.transform(F.col(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS]))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("row.text")

    def cut(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.when(fresh, piece).otherwise(F.lit(""))).alias("out"))

    clean = F.when(F.size(every) == 0, text).otherwise(F.aggregate(every, begin, cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))
    out = named.select("row", clean.alias("clean"), (F.size(every) > 0).alias("changed"))
    cols = []
    for c in row:
        if c == "text":
            cols.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("changed"), F.length("clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars")).alias("n_chars"))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)
