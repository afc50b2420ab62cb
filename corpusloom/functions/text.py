"""Column functions over text: white space, HTML, query tokens and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the query language, in natural order.
STOPWORDS = ["请问", "帮我", "我的", "我该", "我想", "我要", "怎么", "如何", "怎样", "咋办", "怎么办", "怎么样", "一下", "一下子"]
SPLIT_MARKERS = ["怎么办", "怎么样", "怎么", "如何", "怎样", "咋办", "请问", "帮我", "我该", "我想", "我要", "我的", "一下子", "一下"]
EDGE_NOISE = "的了呢吗吧啊呀嘛哈哦哇喔"
RECENT_WORDS = ["最近", "最新", "近期", "新近", "新上传", "刚上传", "最近上传", "刚刚", "近日", "recent", "latest", "new", "just"]
FILE_TYPE_WORDS = {
    "pdf": ["pdf"],
    "document": ["document", "doc", "docx", "ppt", "pptx", "excel", "xlsx", "附件", "文档", "资料"],
    "image": ["image", "images", "picture", "pictures", "图", "图片", "架构图", "png", "jpg", "jpeg", "photo", "photos"],
}
TOKEN = r"[a-z0-9_\-]+|[一-鿿]+"
CJK = "一-鿿"
WORD = rf"[{CJK}]|[\p{{L}}\p{{N}}_\-&&[^{CJK}]]+"
#: Every character that counts as white space at the ends of a text.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column | str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


def canonical_json(text: Column | str) -> Column:
    """JSON with the keys of every object sorted, no spaces and decimals without trailing zeros; other texts stay."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.col(text) if isinstance(text, str) else text)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces don't match, so plain text isn't rebuilt."""
    return strip(F.regexp_replace(text, r"(?U) \s+|[^\S ]\s*", " "))


def strip_html(text: Column) -> Column:
    """Tags as spaces, only where a text has both angle brackets."""
    return F.when(text.contains("<") & text.contains(">"), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(text)


def page_text(html: Column) -> Column:
    """Text of a raw page: scripts, styles and comments go first."""
    return strip_html(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "))


def lines_of(text: Column) -> Column:
    """Non-empty lines with collapsed white space; form feeds end lines, as do the other Unicode line ends."""
    parts = F.split(strip_html(F.regexp_replace(text, "\f", "\n")), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    return F.filter(F.transform(parts, collapse), lambda x: x != "")


def words(text: Column) -> Column:
    """Terms for lexical scoring: lower-case runs of letters, digits, underscores and hyphens; of runs of Chinese characters
    every character and, after all these, every two neighbours."""
    lower = F.lower(text)
    pairs = F.regexp_extract_all(lower, F.lit(f"(?=([{CJK}]{{2}}))"), F.lit(1))
    plain = F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))
    return F.when(lower.rlike(f"[{CJK}]"), F.concat(plain, pairs)).otherwise(plain)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(strip(text)), F.lit(TOKEN), F.lit(0))


def _edges(text: Column) -> Column:
    return F.btrim(strip(text), F.lit(EDGE_NOISE))


def expand_cjk(token: Column) -> Column:
    """Parts of a token of Chinese characters between question words, with their first and last two characters."""
    split = token
    for marker in SPLIT_MARKERS:
        split = F.replace(split, F.lit(marker), F.lit(" "))
    ends = lambda x: F.array(x, F.substring(x, 1, 2), F.right(x, F.lit(2)))
    parts = F.transform(F.split(split, " +"), _edges)
    parts = F.flatten(F.transform(F.filter(parts, lambda x: F.length(x) >= 2), lambda x: F.when(F.length(x) >= 4, ends(x)).otherwise(F.array(x))))
    every = F.transform(F.concat(parts, F.array(F.substring(token, 1, 2), F.right(token, F.lit(2)))), _edges)
    every = F.array_distinct(F.filter(every, lambda x: (F.length(x) >= 2) & ~x.isin(STOPWORDS)))
    return F.when(token.rlike("^[\\u4e00-\\u9fff]{4,}$"), every).otherwise(F.array().cast("array<string>"))


def keywords(found: Column) -> Column:
    """Tokens, each followed by its expansions; two characters or more, no stopwords, first occurrences."""
    every = F.flatten(F.transform(found, lambda t: F.concat(F.array(t), expand_cjk(t))))
    return F.array_distinct(F.filter(every, lambda x: (F.length(x) >= 2) & ~x.isin(STOPWORDS)))


def query_features(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds normalized, tokens, keywords, identifiers, rule_tokens, wants_recent, wants_pdf, wants_document, wants_image."""
    out = queries.withColumn("normalized", F.lower(strip(F.col(text)))).withColumn("tokens", tokens(F.col("normalized")))
    out = out.withColumn("keywords", keywords(F.col("tokens"))).withColumn("identifiers", F.filter("tokens", lambda t: t.rlike(r"^[a-z0-9_\-]+$")))
    rule = F.array_distinct(F.filter(F.transform(F.concat("identifiers", "keywords"), lambda t: F.lower(strip(t))), lambda t: F.length(t) >= 2))
    out = out.withColumn("rule_tokens", rule)
    out = out.withColumn("wants_recent", F.exists(F.array(*map(F.lit, RECENT_WORDS)), lambda w: F.contains(F.col("normalized"), w)))
    for kind, found in FILE_TYPE_WORDS.items():
        ascii_, other = [w for w in found if w.isascii()], [w for w in found if not w.isascii()]
        hit = F.arrays_overlap("tokens", F.array(*map(F.lit, ascii_)))
        for w in other:
            hit = hit | F.col("normalized").contains(w)
        out = out.withColumn(f"wants_{kind}", hit)
    return out
