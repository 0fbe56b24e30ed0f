"""Problem 7: text that was decoded with the wrong character encoding.

For every pair of a wrong decoder and a true encoding, characters are mapped back to the legacy bytes, an automaton
of the true encoding's byte structure finds the maximal well-formed multibyte spans, and those spans alone are
decoded. A span is accepted when the decoded characters are likelier than the written ones under the character
frequencies of the whole corpus, so that rare but genuine characters stay. What was lost in the damage
(replacement characters) stays as it is.

Defined results: null stays null and is no case, empty texts stay empty, repeated rows give repeated rows, extra
columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

UNSEEN = math.log(1e-11)
#: Least gain in log probability for a span that stands alone, and for one in a text with such a span of its kind.
ALONE, TOGETHER = 6.0, 2.0
#: For Big5, where any Han text is well formed, a span needs so much.
BIG5_GAIN, BIG5_LENGTH = 13.0, 3


def character_counts(texts: DataFrame, column: str) -> DataFrame:
    """(code, n) over all texts: counted within each Arrow batch, summed after one small shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            joined = "".join(batch[column])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            code, n = np.unique(codes, return_counts=True)
            yield pd.DataFrame({"code": code.astype(np.int32), "n": n.astype(np.int64)})

    some = texts.select(column).where(F.col(column).isNotNull())
    return some.mapInPandas(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _single_byte(codec: str) -> list[str]:
    """The characters that a byte may have become."""
    table = []
    for byte in range(256):
        char = bytes([byte]).decode(codec, "replace")
        table.append("" if char == "�" else char)
    return table


def _tables() -> dict[str, list[str]]:
    cp1252, latin = _single_byte("cp1252"), _single_byte("latin-1")
    both = [a if a == b else a + b for a, b in zip(cp1252, latin)]
    return {"cp1252": both, "mac_roman": _single_byte("mac_roman"), "cp1251": _single_byte("cp1251"), "cp437": _single_byte("cp437")}


def _class(table: list[str], *ranges: tuple[int, int]) -> str:
    return "[" + re.escape("".join(table[b] for low, high in ranges for b in range(low, high + 1))) + "]"


def _utf8_pattern(table: list[str]) -> str:
    tail = _class(table, (0x80, 0xBF))
    return f"(?:{_class(table, (0xC2, 0xDF))}{tail}|{_class(table, (0xE0, 0xEF))}{tail}{{2}}|{_class(table, (0xF0, 0xF4))}{tail}{{3}})+"


def _gb_pattern(table: list[str]) -> str:
    lead, digit = _class(table, (0x81, 0xFE)), _class(table, (0x30, 0x39))
    return f"(?:{lead}{digit}{lead}{digit}|{lead}{_class(table, (0x40, 0x7E), (0x80, 0xFE))})+"


class Repairer:
    """Finds and decodes damaged spans; counts are the corpus's character counts."""

    def __init__(self, counts: dict[int, int]):
        total = max(1, sum(counts.values()))
        self.logp = {chr(c): math.log(n / total) for c, n in counts.items() if c < 0x110000}
        self.single = []
        for name, table in _tables().items():
            back = {c: b for b, chars in enumerate(table) for c in chars}
            for target, pattern in (("utf-8", _utf8_pattern(table)), ("gb18030", _gb_pattern(table))):
                if (name, target) in (("cp437", "gb18030"), ("mac_roman", "gb18030")):
                    continue
                high = _class(table, (0x80, 0xFE))
                two = re.compile(f"{high}{{2}}")
                self.single.append((name, target, re.compile(pattern), back, two))
        self.big5 = np.zeros(0x10000, dtype=np.float32)
        self.big5_to = {}
        for lead in range(0xA1, 0xFA):
            for trail in (*range(0x40, 0x7F), *range(0xA1, 0xFF)):
                raw = bytes([lead, trail])
                try:
                    wrong = raw.decode("big5")
                except UnicodeDecodeError:
                    try:
                        wrong = raw.decode("cp950")
                    except UnicodeDecodeError:
                        continue
                try:
                    right = raw.decode("gb18030")
                except UnicodeDecodeError:
                    continue
                if len(wrong) == len(right) == 1 and ord(wrong) < 0x10000:
                    self.big5_to.setdefault(wrong, right)
                    self.big5[ord(wrong)] = self._p(right) - self._p(wrong)

    def _p(self, char: str) -> float:
        return self.logp.get(char, UNSEEN)

    def _gain(self, written: str, meant: str) -> float:
        return sum(map(self._p, meant)) - sum(map(self._p, written))

    def _single_spans(self, text: str) -> list[tuple[int, int, str, float, str]]:
        found = []
        for name, target, pattern, back, two in self.single:
            if not two.search(text):
                continue
            for match in pattern.finditer(text):
                span = match.group()
                raw = bytes(back[c] for c in span)
                try:
                    meant = raw.decode(target)
                except UnicodeDecodeError:
                    continue
                if any(c < " " and c not in "\n\t\r" or "\x7f" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff" for c in meant):
                    continue
                start, end = match.span()
                if span[-1] in "“”‘’\"" and text[start - 1 : start] in ("„", "“", "‚", "‘", "«", "\""):
                    continue  # a quoted character and its closing quotation mark
                if target == "gb18030":
                    start, meant = self._trim(span, meant, start)
                    end = start + len(span) if not meant else end
                    span = text[start:end]
                    if not meant:
                        continue
                    lone = meant.isalpha() and not meant.isascii() and len(meant) == 1
                    if lone and "㐀" <= meant <= "鿿" and text[start - 1 : start].isalpha() and text[start - 1 : start].isascii():
                        continue
                found.append((start, end, meant, self._gain(span, meant), f"{name}>{target}"))
        return found

    def _trim(self, span: str, meant: str, start: int) -> tuple[int, str]:
        """Drop decoded units at the start that are less likely than what is written: clean text before the damage."""
        at = 0
        units = []
        for c in meant:
            width = len(c.encode("gb18030"))
            units.append((c, width))
        while units:
            c, width = units[0]
            if self._gain(span[at : at + width], c) > 0:
                break
            at += width
            units.pop(0)
        return start + at, "".join(c for c, _ in units)

    _utf8_bytes = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
    _strong = re.compile(rb"(?:[\xe2-\xe9\xef][\x80-\xbf]{2}){2}|[\xc3][\x80-\xbf]")

    def _gb_spans(self, text: str) -> list[tuple[int, int, str, float, str]]:
        raw = text.replace("�", "?").encode("gb18030", "replace")
        if not self._strong.search(raw):
            return []
        widths = np.fromiter((1 if c < "\x80" or c == "�" else len(c.encode("gb18030", "replace")) for c in text), dtype=np.int64, count=len(text))
        offsets = np.r_[0, np.cumsum(widths)]
        place = {int(o): i for i, o in enumerate(offsets)}
        found = []
        for match in self._utf8_bytes.finditer(raw):
            low, high = match.span()
            while low < high and low not in place:  # the first character may begin before the span
                low += 1
                while low < high and 0x80 <= raw[low] < 0xC0:
                    low += 1
            while high > low and high not in place:
                high -= 1
                while high > low and 0x80 <= raw[high] < 0xC0:
                    high -= 1
            if low >= high:
                continue
            try:
                meant = raw[low:high].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if any("\x7f" <= c <= "\x9f" or c < " " for c in meant):
                continue
            start, end = place[low], place[high]
            found.append((start, end, meant, self._gain(text[start:end], meant), "gb18030>utf-8"))
        return found

    def _big5_spans(self, text: str) -> list[tuple[int, int, str, float, str]]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        gains = self.big5[np.minimum(codes, 0xFFFF)]
        sums = np.cumsum(np.r_[0, gains])
        width = min(6, len(gains))
        if (sums[width:] - sums[:-width]).max() < BIG5_GAIN / 2:
            return []
        found, best, start = [], 0.0, 0
        total, at = 0.0, 0
        end = 0
        for i, (g, code) in enumerate(zip(gains, codes)):
            g = float(g) if g or code < 0x80 or code == 0xFFFD else -4.0  # what Big5 doesn't have breaks a span
            if total <= 0:
                total, at = 0.0, i
            total += g
            if total > best:
                best, start, end = total, at, i + 1
            elif total < best - 12:
                self._keep(text, start, end, best, found)
                best, total = 0.0, 0.0
        self._keep(text, start, end, best, found)
        return found

    def _keep(self, text: str, start: int, end: int, gain: float, found: list) -> None:
        span = text[start:end]
        mapped = [self.big5_to.get(c) for c in span]
        if gain >= BIG5_GAIN and sum(m is not None for m in mapped) >= BIG5_LENGTH:
            found.append((start, end, "".join(m or c for m, c in zip(mapped, span)), gain, "big5>gb18030"))

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, restored, kind) of the damaged spans, in order, without overlaps."""
        if text.isascii():
            return []
        candidates = self._single_spans(text) + self._gb_spans(text)
        candidates += self._big5_spans(text)
        total: dict[str, float] = {}
        for *_, gain, kind in candidates:
            if gain >= ALONE:
                total[kind] = total.get(kind, 0.0) + gain
        chosen: list[tuple[int, int, str, str]] = []
        taken = np.zeros(len(text) + 1, dtype=bool)
        for start, end, meant, gain, kind in sorted(candidates, key=lambda c: (-total.get(c[4], 0.0), -c[3])):
            if gain >= (TOGETHER if kind in total else ALONE) and not taken[start:end].any():
                taken[start:end] = True
                chosen.append((start, end, meant, kind))
        for match in self._lost.finditer(text):  # what a strict decoder replaced: a case, though nothing can be restored
            if not taken[match.start() : match.end()].any():
                chosen.append((*match.span(), match.group(), "lost"))
        return sorted(chosen)

    _lost = re.compile("\ufffd+")

    def repaired(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        """The restored text and the spans of the text as given; damage done twice is undone twice."""
        first = self.spans(text)
        out, rounds, found = self.restore(text, first), 1, first
        while rounds < 3 and any(kind != "lost" for *_, kind in found):
            found = self.spans(out)
            out, rounds = self.restore(out, found), rounds + 1
        return out, first

    def restore(self, text: str, spans: list[tuple[int, int, str, str]] | None = None) -> str:
        out, at = [], 0
        for start, end, meant, _ in self.spans(text) if spans is None else spans:
            out += [text[at:start], meant]
            at = end
        return "".join([*out, text[at:]])


SPAN = StructType([StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("kind", StringType())])


def repair(texts: DataFrame, column: str, counts: dict[int, int], restored: str = "restored", spans: str = "spans") -> DataFrame:
    """texts with the restored text and the damaged spans; pure ASCII and null texts never reach Python.

    counts come from character_counts(): no more entries than Unicode has characters, which bounds the broadcast.
    """
    held = texts.sparkSession.sparkContext.broadcast(counts)
    result = StructType([StructField("restored", StringType()), StructField("spans", ArrayType(SPAN))])

    @F.pandas_udf(result)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(held.value)
        for batch in batches:
            rows = []
            for text in batch:
                after, found = repairer.repaired(text) if text else (text, [])
                rows.append((after, [{"char_start": s, "char_end": e, "kind": k} for s, e, _, k in found]))
            yield pd.DataFrame(rows, columns=["restored", "spans"])

    out = texts.withColumn("__repair", run(F.col(column)))
    return out.withColumn(restored, F.col("__repair.restored")).withColumn(spans, F.col("__repair.spans")).drop("__repair")


def collect_counts(counts: DataFrame) -> dict[int, int]:
    """The counts on the driver: one entry a code point."""
    return {r["code"]: r["n"] for r in counts.collect()}
