"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Counts of a text (words, letters, symbols, lines, stop words, repeats) are column expressions over arrays that the same
row holds; a rule compares two of them as ``count * 1000 >= limit * per`` in whole numbers, so no ratio is ever
rounded. No user function, no shuffle: documents stream through one projection whatever their source or size.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: symbols, characters between words, words of a window, and the limits of ``base_failed``.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
#: The commonest function words of the languages that the corpus is kept for, in natural order by language.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "by", "be", "this", "are", "at", "from",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "est", "dans", "qui", "par", "sur", "pas", "au", "avec",
    "el", "y", "los", "se", "las", "del", "por", "con", "no", "una", "su", "para", "al",
]
#: The mark before an item of a list.
BULLETS = r"^[\x20\x09-\x0D]*[-•*]"
#: Bits for the place of a window beside its hash.
PLACE_BITS = 20


class Rule(NamedTuple):
    """A text fails if ``1000 * count < least * per`` or ``1000 * count > most * per``, looked at from ``words`` words on."""

    name: str
    count: str
    per: str
    least: int | None = None
    most: int | None = None
    words: int = 1


#: The table. Limits are thousandths of ``per`` (``one`` is the number 1).
RULES = [
    Rule("length", "n_words", "one", least=LEAST_WORDS * 1000, most=2_000_000_000, words=0),
    Rule("word_length", "word_chars", "n_words", least=2_000, most=12_000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("exclamations", "n_exclamations", "n_words", most=300),
    Rule("stop_words", "n_stop_words", "n_words", least=20, words=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900, words=50),
    Rule("unfinished_lines", "n_unfinished_lines", "n_lines", most=300, words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=400, words=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=REPEAT_PERCENT * 10),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_windows(words: Column) -> Column:
    """The hash of every window of WINDOW words, in order."""
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    return F.when(F.size(words) > WINDOW, hashes)


def ordered_windows(hashes: Column) -> Column:
    """Hash and place of every window as one number each, sorted; null where no hash occurs twice (then no window does)."""
    own = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long")))
    return F.when((F.size(F.array_distinct(hashes)) < F.size(hashes)) & (F.size(hashes) <= 1 << PLACE_BITS), F.sort_array(own))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _same_hash(x: Column, y: Column) -> Column:
    return F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)


def places_by_hash(ordered: Column) -> Column:
    """Places of the windows that share their hash with another, in order."""
    return F.sort_array(F.transform(F.filter(ordered, lambda e, k: _same_hash(e, F.get(ordered, k - 1)) | _same_hash(e, F.get(ordered, k + 1))), _place))


def hashes_hold(ordered: Column, words: Column) -> Column:
    """True if neighbours with one hash are the same words, so that equal hashes mean equal windows in this text."""
    def window(at: Column) -> Column:
        return F.slice(words, _place(at) + 1, WINDOW)

    def same(k: Column) -> Column:
        left, right = F.get(ordered, k - 1), F.get(ordered, k)
        return ~_same_hash(left, right) | (window(left) == window(right))

    return F.forall(F.sequence(F.lit(1), F.size(ordered) - 1), same)


def places_by_words(words: Column) -> Column:
    """As ``places_by_hash``, by sorting the windows themselves: for texts whose hashes collide or that pass PLACE_BITS."""
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    windows = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.alias("i"))))

    def repeated(x: Column) -> Column:
        return F.transform(F.filter(x, lambda e, i: (F.get(x, i - 1)["w"] == e["w"]) | (F.get(x, i + 1)["w"] == e["w"])), lambda e: e["i"])

    return F.sort_array(let(windows, repeated))


def covered(places: Column) -> Column:
    """Words that lie in a window that begins at one of ``places``."""
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("int").alias("n"), i.alias("last"))
    return F.aggregate(places, first, step, lambda a: a["n"])


def count_of(text: Column, marks: str) -> Column:
    """Characters of ``text`` that are among ``marks``."""
    return F.regexp_count(text, F.lit(f"[{marks}]"))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id and every count that a rule can name) for each row; words and lines leave the row again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.select("*", hashed_windows(F.col("words")).alias("hashes")).select("*", ordered_windows(F.col("hashes")).alias("ordered"))
    long = F.size("hashes") > 1 << PLACE_BITS
    places = (
        F.when(long | ~hashes_hold(F.col("ordered"), F.col("words")), places_by_words(F.col("words")))
        .when(F.col("ordered").isNotNull(), places_by_hash(F.col("ordered"))).otherwise(F.array().cast("array<int>"))
    )
    rows = rows.select("doc_id", "text", "words", "lines", places.alias("places"))
    return rows.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        covered(F.col("places")).alias("n_repeat_words"),
        count_of(F.col("text"), "!").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS + [w.capitalize() for w in STOP_WORDS] + [w.upper() for w in STOP_WORDS]))).alias("n_stop_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda s: s.rlike(BULLETS))).alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda s: F.endswith(F.rtrim(s, F.lit(BLANKS)), F.lit("...")) | F.endswith(F.rtrim(s, F.lit(BLANKS)), F.lit("…")))).alias("n_unfinished_lines"),
    )


def failures(rules: list[Rule]) -> Column:
    """The names of the rules that a measured row fails, in the table's order."""
    def failed(rule: Rule) -> Column:
        count = F.col(rule.count).cast("long") * 1000
        per = F.lit(1) if rule.per == "one" else F.col(rule.per).cast("long")
        ends = [count < per * rule.least] if rule.least is not None else []
        ends += [count > per * rule.most] if rule.most is not None else []
        bad = ends[0] if len(ends) == 1 else ends[0] | ends[1]
        return F.when(bad & (F.col("n_words") >= rule.words), F.lit(rule.name))

    return F.concat_ws(",", *[failed(r) for r in rules])


def apply(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, kept and the failed rules' names.

    ``base_failed``: fewer than LEAST_WORDS words, or more than REPEAT_PERCENT per cent of them repeated. ``kept`` is
    false for those and for every row that fails a rule of the table. Null and blank texts have no words and fail;
    repeated rows stay repeated, ties don't arise, other columns aren't read, and an empty table gives an empty one.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = measured(docs)
    rows = rows.select("*", failures(RULES if rules is None else rules).alias("failed"))
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words").cast("long") * 100 > F.col("n_words").cast("long") * REPEAT_PERCENT)
    rows = rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in longs], base.alias("base_failed"), "failed")
    return rows.select("doc_id", *longs, "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")
