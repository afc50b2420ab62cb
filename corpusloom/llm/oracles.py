"""DuckDB SQL with the rows of those queries of this subpackage that SQL can express."""

from corpusloom.llm.quality_rules import RULES, STOP_WORDS, Rule


def _failed(rule: Rule) -> str:
    count, per = f"{rule.count}::BIGINT * 1000", "1" if rule.per == "one" else rule.per
    ends = [f"{count} < {per}::BIGINT * {rule.least}"] if rule.least is not None else []
    ends += [f"{count} > {per}::BIGINT * {rule.most}"] if rule.most is not None else []
    return f"CASE WHEN ({' OR '.join(ends)}) AND n_words >= {rule.words} THEN '{rule.name}' END"


_STOPS = ", ".join(f"'{w}'" for s in STOP_WORDS for w in (s, s.capitalize(), s.upper()))
QUALITY_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM parts WHERE len(words) > 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS k FROM windows) WHERE k > 1),
repeats AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY r),
counts AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations, len(list_filter(words, lambda w: w IN ({_STOPS}))) AS n_stop_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda s: regexp_matches(s, '^[\x20\x09-\x0D]*[-•*]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda s: regexp_matches(s, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_unfinished_lines
  FROM parts LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {", ".join(_failed(r) for r in RULES)}) AS failed
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM judged
"""

PHRASES = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM f WHERE k > 1),
inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(f) AS longer
  FROM (SELECT lang, p, f, m, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 5) t(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * f),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, n.n, cut, 1000::HUGEINT * c.f * n.n // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT lang, p, f, k AS size, unnest(range(1, k)) AS cut FROM kept) c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1:size]),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
named AS (SELECT *, array_to_string(p, ' ') AS phrase FROM weakest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM named QUALIFY rank <= 2000
"""
