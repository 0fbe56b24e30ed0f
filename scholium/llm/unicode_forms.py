"""Problem 1: text that looks the same but differs in its characters.

Two forms are produced for every distinct value:

* ``plain``: the spelling an ordinary keyboard gives. Compatibility forms of letters, digits, hyphens, Roman
  numerals and Han radicals are mapped, accents are composed (NFC), every white space is U+0020,
  default-ignorable characters are gone and look-alike letters of another script are replaced. Full-width Chinese
  punctuation, dashes, curly quotes, superscripts and subscripts stay as they are.
* ``key``: for comparing. The plain form under NFKC, full case folding and collapsed white space.

Defined results: null stays null (never a case), an empty text stays empty, repeated rows and ties give repeated
rows, extra columns are kept untouched.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Default_Ignorable_Code_Point of the Unicode Character Database.
IGNORABLE = (
    r"\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    r"\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
# White space but U+0020 and the line feed, which problem 2 deals with.
SPACES = r"\t\v\f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Hyphens that a keyboard gives as U+002D.
HYPHENS = r"\u2010\u2011\u2043\u2212\ufe63\uff0d"
# EquivalentUnifiedIdeograph of radicals that have no compatibility mapping.
RADICALS = dict(
    "⺀冫 ⺁厂 ⺄乙 ⺅亻 ⺆冂 ⺈刀 ⺉刂 ⺊卜 ⺌小 ⺍小 ⺎兀 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺘扌 ⺙攵 ⺛旡 ⺝月 ⺞歹 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺦丬 ⺨犭 ⺩王 ⺪疋 "
    "⺫目 ⺬礻 ⺭礻 ⺮竹 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺶羊 ⺷羊 ⺸羊 ⺹耂 ⺺肀 ⺻聿 ⺼月 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻇角 ⻈讠 ⻉贝 ⻊足 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐釒 "
    "⻑長 ⻒镸 ⻓长 ⻔门 ⻕阜 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻞飠 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟".split()
)
# Letters of other scripts that look like a Latin letter.
LOOKALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορικυχ" "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ" "հոսօցԼՕՏ",
        "ABEZHIKMNOPTYXvopikux" "ABESIJKMHOPCTYXaesijopcyxhdqwl" "hnuogLOS",
    )
)
# Kana that look like a Han character.
KANA = dict(zip("ニロハエカタトチミヒ", "二口八工力夕卜千三匕"))

_ignorable = re.compile(f"[{IGNORABLE}]")
_space = re.compile(f"[{SPACES}]")
_hyphen = re.compile(f"[{HYPHENS}]")
_word = re.compile(r"[^\W\d_]+")
_kana = re.compile("(?<![぀-ヿ])[" + "".join(KANA) + "](?![぀-ヿ])")
_greek_cyrillic = re.compile("[Ͱ-ϿЀ-ԯ԰-֏]")
#: What is certainly plain: ASCII, the common Han block, Chinese and general punctuation, ordinary accented letters.
PLAIN = (
    r"^[\n -~一-鿿、-〗‒-‧‰-※！％（）＋，．／：；？～"
    r"¡-¬®-´¶-ÿŒœ⁰-ⁿ₀-ₜα-θλμξπσφψω]*$"
)


def _compatibility(char: str) -> str:
    """The keyboard form of one character, or itself where the form belongs to ordinary Chinese or scientific text."""
    if char in RADICALS:
        return RADICALS[char]
    code = ord(char)
    folded = unicodedata.normalize("NFKC", char)
    if folded == char:
        return char
    full_width_word = 0xFF10 <= code <= 0xFF19 or 0xFF21 <= code <= 0xFF3A or 0xFF41 <= code <= 0xFF5A
    han = 0x2F00 <= code <= 0x2FDF or 0xF900 <= code <= 0xFAFF or 0x2F800 <= code <= 0x2FA1F
    letters = 0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F or 0x1D400 <= code <= 0x1D7FF or 0x0132 <= code <= 0x0133
    letters = letters or 0x01C4 <= code <= 0x01CC or 0x2100 <= code <= 0x214F and len(folded) == 1 and folded.isalpha()
    return folded if full_width_word or han or letters or char in "µſKÅ" else char


def _unmask(word: str, context: str) -> str:
    """One run of letters with the look-alikes of another script replaced."""
    foreign = _greek_cyrillic.findall(word)
    if not foreign:
        return word
    latin = any(c.isascii() or "LATIN" in unicodedata.name(c, "") for c in word)
    if latin:
        out = list(word)
        for i, c in enumerate(word):
            if c not in LOOKALIKES:
                continue
            if "α" <= c <= "ω":  # a Greek sign beside capitals is a sign, inside a word it is a mask
                beside = word[max(0, i - 1) : i] + word[i + 1 : i + 2]
                if not any(b.islower() and (b.isascii() or b in LOOKALIKES) for b in beside):
                    continue
            out[i] = LOOKALIKES[c]
        return "".join(out)
    if len(word) == 1 and word.islower() and word < "Ѐ":
        return word
    block = (lambda c: ord(c) // 0x100 if c < "԰" else 5.5) if word else None
    native = any(c not in LOOKALIKES and block(c) == block(foreign[0]) for c in _greek_cyrillic.findall(context))
    if native or any(c not in LOOKALIKES for c in word):
        return word
    return "".join(LOOKALIKES[c] for c in word)


@lru_cache(maxsize=1 << 16)
def plain_form(text: str) -> str:
    out = _ignorable.sub("", text)
    out = _hyphen.sub("-", _space.sub(" ", out))
    out = unicodedata.normalize("NFC", "".join(map(_compatibility, out))) if not out.isascii() else out
    if _greek_cyrillic.search(out):
        whole = out
        out = _word.sub(lambda m: _unmask(m.group(), whole), out)
    if _kana.search(out):
        out = _kana.sub(lambda m: KANA[m.group()] if _beside_han(out, m) else m.group(), out)
    return out


def _beside_han(text: str, match: re.Match) -> bool:
    beside = text[max(0, match.start() - 1) : match.start()] + text[match.end() : match.end() + 1]
    return any("一" <= c <= "鿿" or c in "、，。（）" for c in beside)


@lru_cache(maxsize=1 << 16)
def key_form(text: str) -> str:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", plain_form(text)).casefold())
    return " ".join(_ignorable.sub("", folded).split())


def _per_value(function, values: pd.Series) -> pd.Series:
    """function once for each distinct value of a batch."""
    codes, distinct = pd.factorize(values)
    done = pd.Series([function(v) for v in distinct] + [None], dtype=object)
    return pd.Series(done.to_numpy()[codes], index=values.index, dtype=object)


@F.pandas_udf(StringType())
def _plain_udf(values: pd.Series) -> pd.Series:
    return _per_value(plain_form, values)


@F.pandas_udf(StringType())
def _key_udf(values: pd.Series) -> pd.Series:
    return _per_value(key_form, values)


def normalise(df: DataFrame, column: str, plain: str = "plain", key: str | None = "key") -> DataFrame:
    """df with the plain form and, unless key is None, the comparison key of a column.

    The Arrow function sees a batch's distinct values once; texts that are plain by a JVM-side pattern and ASCII
    need no Python at all for ``key``.
    """
    out = df.withColumn(plain, _plain_udf(F.col(column)))
    return out if key is None else out.withColumn(key, _key_udf(F.col(column)))


def suspicious(column: Column) -> Column:
    """JVM-side test that keeps a superset of the values that plain_form() changes."""
    return column.isNotNull() & ~column.rlike(PLAIN)


def not_plain(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value looks plain but isn't, with their plain form in ``plain``."""
    return (
        df.where(suspicious(F.col(column)))
        .withColumn("plain", _plain_udf(F.col(column)))
        .where(F.col("plain") != F.col(column))
    )
