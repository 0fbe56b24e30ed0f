"""Text expressions: Column in, Column out, all on the JVM but for NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of Unicode text processing (29 characters), for both Spark and DuckDB patterns.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Line ends: those of text files and the separators that Unicode counts among them.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Sentence marks that a chunk may end at.
SENTENCE_MARKS = "。！？!?；;\n"
# Titles of chapters without teaching content.
LOW_SIGNAL = "(?i)(前言|序|目录|版权|编委|主编|副主编|简介|封面|扉页|致谢|附录|索引|参考文献|数字版)"
LOW_SIGNAL_EVAL = "(?i)(前言|序|目录|版权|编委|主编|副主编|简介|封面|扉页|致谢|附录|索引|参考文献|英文版|数字版)"
# Punctuation that names are compared without.
NAME_PUNCTUATION = r"""[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\-_·•:：,，.。;；、/\\|()\[\]{}<>《》“”"'`~!！?？]+"""
# Names that stand for no concept.
EMPTY_NAME = r"^(无|空|n/?a|none|null|unknown|未命名)\z"
# Synonyms and the key they share.
SYNONYMS = {
    "leukocyte": "白细胞",
    "leucocyte": "白细胞",
    "whitebloodcell": "白细胞",
    "whitebloodcells": "白细胞",
    "白blood细胞": "白细胞",
    "白血球": "白细胞",
}
# Question words that say nothing about the topic.
QUESTION_STOP_TERMS = ("什么", "哪些", "为何", "为什么", "如何", "有何", "根据", "内容", "概括", "定义", "人体", "不同", "部位")
CHAPTER_NUMERALS = r"一二三四五六七八九十百千万零〇两\d"


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def drop_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def query_key(c: Column) -> Column:
    return F.lower(drop_space(c))


def clean_extracted(c: Column) -> Column:
    """Text from an extractor without zero-width characters; broken characters become spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"[\x{feff}\x{200b}-\x{200d}]", ""), r"[\x{fffd}\x08]+", " "))


def clean_title(c: Column) -> Column:
    """A heading without Markdown signs and without a trailing page number."""
    return strip(F.regexp_replace(squeeze(F.regexp_replace(clean_extracted(c), rf"{WS}+[0-9]+{WS}*\z", "")), r"^#+|#+\z", ""))


def content_lines(c: Column) -> Column:
    """Trimmed non-empty lines joined by line feeds."""
    lines = F.transform(F.split(blank_to_empty(c), LINE_END), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def heading_key(c: Column) -> Column:
    return F.regexp_replace(blank_to_empty(c), rf"({WS}|[|｜])+", "")


def stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?\z", 1)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    forms = {v: unicodedata.normalize("NFKC", v) for v in set(values) if isinstance(v, str)}
    return pd.Series([forms.get(v) for v in values], dtype=object)


def nfkc(c: Column) -> Column:
    """The compatibility composed form; ASCII texts stay on the JVM, others are mapped once a distinct value of a batch."""
    plain = c.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))


def name_key(c: Column) -> Column:
    """Compatibility form in lower case without punctuation: the key that equal names share."""
    return F.regexp_replace(F.lower(nfkc(blank_to_empty(c))), NAME_PUNCTUATION, "")


def synonym_key(key: Column) -> Column:
    """The name key with synonyms replaced; a whole match wins over replacing parts."""
    parts = key
    for source, target in SYNONYMS.items():
        parts = F.replace(parts, F.lit(source), F.lit(target))
    whole = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(whole, key), parts)


def name_tokens(normalised: Column) -> Column:
    """Latin words, Han characters and pairs of successive Han characters of an NFKC lower-case text, distinct."""
    latin = F.regexp_extract_all(normalised, F.lit("[a-z0-9]+"), 0)
    han = F.regexp_extract_all(normalised, F.lit("[一-鿿]"), 0)
    return let(han, lambda h: F.array_distinct(F.concat(latin, h, windows(h, 2))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression used inside a lambda would be computed at every step."""
    return F.get(F.transform(F.array(value), body), 0)


def letters(text: Column) -> Column:
    """The characters of a text as an array, so that windows cost no scan from the start of the text."""
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def windows(chars: Column, size: int) -> Column:
    """All substrings of a length, in order, of an array of characters; empty when it is shorter."""
    last = F.size(chars) - size
    glue = lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), glue)).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Search terms with repeats: Han runs and their 2-, 3- and 4-grams, and Latin words longer than one letter."""
    runs = F.regexp_extract_all(F.lower(blank_to_empty(text)), F.lit("[一-鿿]+|[a-z0-9]+"), 0)

    def expand(run: Column) -> Column:
        grams = let(letters(run), lambda c: F.concat(F.array(run), windows(c, 2), windows(c, 3), windows(c, 4)))
        none = F.array().cast("array<string>")
        han = run.rlike("^[一-鿿]")
        return F.when(han, F.when(F.length(run) > 2, grams).otherwise(F.array(run))).otherwise(F.when(F.length(run) > 1, F.array(run)).otherwise(none))

    return F.flatten(F.transform(runs, expand))


def grams(text: Column) -> Column:
    """Character 2- and 3-grams with repeats of the text without white space."""
    return let(letters(query_key(blank_to_empty(text))), lambda c: F.concat(windows(c, 2), windows(c, 3)))


def salient(text: Column) -> Column:
    """The first six distinct 4-, 3- and 2-grams that are wholly Han or wholly Latin, longest first, then by code point."""
    every = let(letters(query_key(blank_to_empty(text))), lambda c: F.array_distinct(F.concat(windows(c, 4), windows(c, 3), windows(c, 2))))
    kept = F.filter(every, lambda g: g.rlike(r"^([一-鿿]+|[a-z0-9]+)\z") & ~g.isin(*QUESTION_STOP_TERMS))
    ordered = F.array_sort(F.transform(kept, lambda g: F.named_struct(F.lit("n"), -F.length(g), F.lit("g"), g)))
    return F.slice(F.transform(ordered, lambda s: s["g"]), 1, 6)


def sentences(text: Column, n: int) -> Column:
    """The first n sentences, joined by spaces."""
    every = F.regexp_extract_all(blank_to_empty(text), F.lit("[^。！？!?；;\n]+[。！？!?；;]?"), 0)
    return strip(F.array_join(F.transform(F.slice(every, 1, n), strip), " "))


def leading_sentence(text: Column, limit: int) -> Column:
    """The text up to its first sentence mark, else its first ``limit`` characters."""
    first = strip(F.regexp_extract(text, r"^[^。！？!?；;]*[。！？!?；;]?", 0))
    return F.when(first != "", first).otherwise(F.substring(text, 1, limit))


def marked_sentences(text: Column) -> Column:
    """Non-blank stretches that end with a sentence mark (kept) or the end of the text."""
    every = F.regexp_extract_all(text, F.lit("[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+"), 0)
    return F.filter(F.transform(every, strip), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    """A rough token count: 0.7 a Han character, 1.1 a Latin word, 0.15 any other character; at least 1, 0 for no text."""
    t = blank_to_empty(text)
    han = F.length(F.regexp_replace(t, "[^一-鿿]+", ""))
    words = F.regexp_count(t, F.lit("[a-zA-Z0-9_]+"))
    letters = F.length(F.regexp_replace(t, "[^a-zA-Z0-9_]+", ""))
    rest = F.greatest(F.lit(0), F.length(t) - han - letters)
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.bround(han * 0.7 + words * 1.1 + rest * 0.15, 0).cast("int")))


def citation_label(title: Column, chapter: Column, start: Column, end: Column) -> Column:
    """[title, chapter, pages] with a page range, one page, or that the page is unknown."""
    pages = (
        F.when((start > 0) & (end > 0) & (start != end), F.format_string("第 %d-%d 页", start, end))
        .when(start > 0, F.format_string("第 %d 页", start))
        .otherwise("页码未知")
    )
    return F.concat(F.lit("["), F.concat_ws(", ", title, chapter, pages), F.lit("]"))


def excerpt(text: Column, term: Column, window: int = 180, fallback: int = 360) -> Column:
    """The surroundings of a term's first occurrence with ellipses at cut ends, else the beginning of the text."""
    at = F.instr(text, term)
    start = F.greatest(F.lit(1), at - window)
    end = F.least(F.length(text), at - 1 + F.length(term) + window)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), strip(F.substring(text, start, end - start + 1)), F.when(end < F.length(text), "...").otherwise(""))
    return F.when((F.length(term) > 0) & (at > 0), cut).otherwise(F.substring(text, 1, fallback))


def chapter_level(title: Column) -> Column:
    """primary, secondary or content by the numbering of a heading."""
    key = heading_key(title)
    return (
        F.when((key == "绪论") | key.rlike(f"^第[{CHAPTER_NUMERALS}]+章"), "primary")
        .when(key.rlike(f"^第[{CHAPTER_NUMERALS}]+节") | key.rlike("^[一二三四五六七八九十]+、") | key.rlike("^（[一二三四五六七八九十]+）"), "secondary")
        .otherwise("content")
    )


def low_signal_chapter(title: Column, content: Column) -> Column:
    """Whether a chapter is left out of the search index."""
    t, body = strip(blank_to_empty(title)), content_lines(content)
    return ((t == "") & (body == "")) | t.rlike(LOW_SIGNAL) | ((F.length(body) < 120) & F.substring(body, 1, 80).rlike(LOW_SIGNAL))


def low_signal_chunk(title: Column, page_start: Column, text: Column) -> Column:
    return strip(blank_to_empty(title)).rlike(LOW_SIGNAL) | ((F.coalesce(page_start, F.lit(0)) <= 15) & (F.length(strip(text)) < 320))


def joined_hash(*parts: Column) -> Column:
    """SHA-1 over parts that are each ended by a NUL."""
    return F.sha1(F.concat(*[x for p in parts for x in (blank_to_empty(p.cast("string")), F.lit("\0"))]))


def optional_int(c: Column) -> Column:
    """A whole number, or null where there is none."""
    return F.try_to_number(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("S999999999")).cast("int")


def collection_name(index_id: Column) -> Column:
    """A name for an index's collection: safe characters, at most 60."""
    safe = F.regexp_replace(F.regexp_replace(index_id, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return F.substring(F.concat(F.lit("rag_"), F.when(safe == "", "default").otherwise(safe)), 1, 60)
