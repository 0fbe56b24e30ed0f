"""Problem 2: what page layout and recognition left in the text of scanned books.

Three passes. The first counts, over the whole corpus, words, the neighbours of characters that recognition mixes up,
and the folded short lines of every book. Lines that come back at page edges of a book, and stand there more often than
elsewhere, are its running headers and footers, as are lines that fold to nearly the chapter's or the book's
title. The last pass removes these and the page numbers (marked ones, and bare ones that fit the chapter's pages or run in
sequence), corrects misread words and characters towards what the corpus says, and joins lines: a word cut by a
hyphen is joined by the corpus vocabulary. Where a sentence ends with its line, the widths of the lines around tell: a line is
wrapped if the next word wouldn't have fitted the width that lines near it, broken within a sentence, have; and what a page
number or running line alone parts goes on.

What is broadcast has a proven bound: words with a relative frequency of at least WORD_SHARE (no more than
1 / WORD_SHARE of them), pairs of a confusable character and a neighbour, and sub-headings that at least BOOK_SHARE of
all books have.

Defined results: null content stays null, blank stays as it is; the author's lists, tables, sub-headings, line ends and hyphens
stay; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import product
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .encoding_repair import character_counts, collect_counts, repair
from .unicode_forms import plain_form

WORD_SHARE = 1e-6
#: How many times more frequent than a word the word must be that it was misread from.
MORE = 12
BOOK_SHARE = 0.05
#: A line whose last sentence is longer is an unbroken run of its author, not a printed line.
UNBROKEN = 80
# Character -> what recognition should have read.
MISREAD = dict(
    "旳的 皿血 吋时 绌细 袍胞 休体 己已 囚因 笫第 夭天 末未 入人 仅反 肟肝 埋理 曰日 灸炎 弓与 巳已 臼白 侯候 卑单 土士 干千 夂久 兔免 凤风 鸟乌 戌戍 拔拨 辨辩".split()
)
# What recognition reads -> what was printed, in words of Latin letters.
LATIN_MISREAD = (("rn", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("ii", "ü"), ("vv", "w"), ("li", "h"), ("b", "h"), ("c", "e"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("0", "o"), ("5", "s"), ("8", "b"))
_closing = re.compile(r"[，。；、）”’」』！？]|[,;](?=\s)")
_page = re.compile(
    r"^[\f\s]*(?:[-–—·•~*]\s*(?P<a>\d{1,5})\s*[-–—·•~*]|[\[〔【(（<《]\s*(?P<b>\d{1,5})\s*[\]〕】)）>》]|"
    r"第\s*(?P<c>\d{1,5})\s*页(?:\s*[/共]\s*\d+\s*页?)?|(?:p|pp|page|seite|s)\.?\s*(?P<d>\d{1,5})|(?P<e>\d{1,5})\s*/\s*\d{1,5}|(?P<f>\d{1,5}))[\f\s]*$",
    re.IGNORECASE,
)
_terminal = re.compile(r"[。！？；：.!?;:…][”’」』）)】\"']*\s*$|[|】]\s*$")
_block = re.compile(r"^\s*(?:[*\-•·–]\s|\d{1,3}\s*[.．、)）:：]|[（(]\s*[\d一二三四五六七八九十]{1,3}\s*[)）]|【|[一二三四五六七八九十]{1,3}、|表\s*\d|图\s*\d|Table |Tab\.|Tableau |Tabelle |[#>])")
_table = re.compile(r"\|")
_breaks = re.compile(r"\r\n|[\r\x0b\x85  ]")
_word = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿŒœß0-9!]*[A-Za-zÀ-ÖØ-öø-ÿŒœß][A-Za-zÀ-ÖØ-öø-ÿŒœß0-9!]*")
_letters = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿŒœß]+")
_confused = re.compile("[" + "".join(dict.fromkeys([*MISREAD, *MISREAD.values()])) + "]")
_hyphen_end = re.compile(r"(\w+)[-‐‑­]\s*$")
_leader = re.compile(r"\s*(?:…{2,}|\.{4,}|(?:\s\.){3,}|·{4,})\s*\d*\s*$")
_private = re.compile("[\ue000-\uf8ff]")
_han = re.compile("[㐀-鿿]")


def fold(text: str) -> str:
    """A line for fuzzy comparing: letters and Han only, look-alikes of recognition folded together."""
    out = unicodedata.normalize("NFKC", text).casefold().replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w")
    out = "".join(MISREAD.get(c, c) for c in out).translate(_FOLD)
    return "".join(c for c in out if c.isalpha())


_FOLD = str.maketrans({"1": "l", "!": "l", "i": "l", "0": "o", "5": "s", "b": "h", "c": "e"})


def split_lines(text: str) -> list[str]:
    return _breaks.sub("\n", text).split("\n")


def is_short(line: str) -> bool:
    return 1 < len(line.strip()) <= 100 and line.count("|") < 2 and not _terminal.search(line)


STATS = "kind string, textbook_id string, chapter_id string, key string, n bigint, edges bigint"


def at_edge(lines: list[str], i: int) -> bool:
    """Whether a line stands at a page edge: beside a form feed, a page number or an end of the text, or within a sentence."""
    before, after = i - 1, i + 1
    while before >= 0 and not lines[before].strip():
        before -= 1
    while after < len(lines) and not lines[after].strip():
        after += 1
    beside = lines[max(before, 0) : after + 1]
    if any("\f" in line for line in beside):
        return True
    if before < 0 or after >= len(lines):
        return True
    last = lines[before].rstrip()
    if _number(last)[1] or _number(lines[after])[1]:
        return True
    return not _terminal.search(last) and not _table.search(last) and (_goes_on(last) or not _heading_like(last))


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        words: Counter = Counter()
        near: Counter = Counter()
        for book, chapter, content in batch.itertuples(index=False):
            if not content:
                continue
            for match in _letters.finditer(content):
                words[match.group().lower()] += 1
            for match in _confused.finditer(content):
                i, c = match.start(), match.group()
                near["l" + content[i - 1 : i] + c] += 1
                near["r" + content[i + 1 : i + 2] + c] += 1
            lines, keys, edges = split_lines(content), Counter(), Counter()
            for i, line in enumerate(lines):
                key = fold(line) if is_short(line) else ""
                if key:
                    keys[key] += 1
                    edges[key] += at_edge(lines, i)
            rows += [("line", book, chapter, k, n, edges[k]) for k, n in keys.items()]
        rows += [("word", None, None, w, n, 0) for w, n in words.items()] + [("near", None, None, w, n, 0) for w, n in near.items()]
        yield pd.DataFrame(rows, columns=["kind", "textbook_id", "chapter_id", "key", "n", "edges"])


def statistics(chapters: DataFrame) -> tuple[dict[str, int], dict[str, int], set[str], DataFrame]:
    """(vocabulary, neighbours, sub-headings, running lines of each chapter).

    The vocabulary holds the words of at least WORD_SHARE of all; under "" stands the most that a word outside it may have.
    """
    counted = stage(chapters.select("textbook_id", "chapter_id", "content").mapInPandas(_statistics, STATS), "page-lines")
    summed = counted.where("kind <> 'line'").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    total = counted.where("kind = 'word'").agg(F.sum("n")).first()[0] or 0
    frequent = summed.where((F.col("kind") == "word") & (F.col("n") >= total * WORD_SHARE) | (F.col("kind") == "near"))
    vocabulary, near = {}, {}
    for row in frequent.collect():
        (vocabulary if row["kind"] == "word" else near)[row["key"]] = row["n"]
    vocabulary[""] = max(0, ceil(total * WORD_SHARE) - 1)
    lines = counted.where("kind = 'line'")
    books = lines.select("textbook_id").distinct().count()
    # repeated deliveries of a chapter count once
    in_chapter = lines.groupBy("textbook_id", "chapter_id", "key").agg(F.max("n").alias("n"), F.max("edges").alias("edges"))
    in_book = in_chapter.groupBy("textbook_id", "key").agg(F.sum("n").alias("n"), F.sum("edges").alias("edges"))
    shared = in_book.groupBy("key").agg(F.count("*").alias("books")).where(F.col("books") > max(3, books * BOOK_SHARE))
    headings = {r["key"] for r in shared.select("key").collect()}
    repeated = in_book.where("edges >= 3 and 2 * edges > n").select(F.col("textbook_id").alias("_b"), F.col("key").alias("_k"))
    running = lines.join(repeated, (F.col("textbook_id") == F.col("_b")) & (F.col("key") == F.col("_k")))
    return vocabulary, near, headings, running.groupBy("textbook_id", "chapter_id").agg(F.collect_set("key").alias("running"))


class Cleaner:
    def __init__(self, vocabulary: dict[str, int], near: dict[str, int], headings: set[str]):
        self.vocabulary, self.near, self.headings = vocabulary, near, headings
        self.known: dict[str, str | None] = {}

    # -- characters and words ---------------------------------------------------------------------------------

    def _han_misreads(self, text: str) -> list[tuple[int, str]]:
        found = []
        for i, c in enumerate(text):
            right = MISREAD.get(c)
            if right is None:
                continue
            left, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
            left, after = (MISREAD.get(x, x) for x in (left, after))
            was = [self.near.get("l" + left + c, 0), self.near.get("r" + after + c, 0)]
            be = [self.near.get("l" + left + right, 0), self.near.get("r" + after + right, 0)]
            # the printed form is what both neighbours, or by far one of them, are used to
            good = sum(b > 3 * w for w, b in zip(was, be))
            bad = sum(w > 3 * b for w, b in zip(was, be))
            if good == 2 or good == 1 and bad == 0 or good == 1 and sum(be) > 20 * sum(was):
                found.append((i, right))
        return found

    def _latin_misread(self, word: str) -> str | None:
        """The word of the vocabulary that was misread as this one, if there is one: by far more frequent, at any size of corpus."""
        lower = word.lower()
        if lower in self.known:
            return self.known[lower]
        own = self.vocabulary.get(lower, self.vocabulary.get("", 0))
        best: tuple[int, str] | None = None
        if len(lower) > 3 and not lower.isdigit():
            spots = []
            for wrong, right in LATIN_MISREAD:
                at = lower.find(wrong)
                while at >= 0:
                    spots.append((at, wrong, right))
                    at = lower.find(wrong, at + 1)
            odd = sum(c in "0158!" for c in lower)
            tried = [((s,)) for s in spots] + ([p for p in product(spots, spots) if p[0][0] + len(p[0][1]) <= p[1][0]] if len(spots) < 14 else [])
            if odd >= 2 and len(spots) < 12:
                tried += [p for p in product(spots, spots, spots) if p[0][0] + len(p[0][1]) <= p[1][0] and p[1][0] + len(p[1][1]) <= p[2][0]]
            for change in tried:
                out = lower
                for at, wrong, right in sorted(change, reverse=True):
                    out = out[:at] + right + out[at + len(wrong) :]
                n = self.vocabulary.get(out, 0)
                if n > MORE * own and (best is None or n > best[0]):
                    best = (n, out)
        self.known[lower] = best[1] if best else None
        return self.known[lower]

    def _fix_words(self, text: str) -> tuple[str, int, int]:
        """(text, certain misreads, weaker ones)."""
        certain = weak = 0
        han = self._han_misreads(text)
        if han:
            chars = list(text)
            for i, right in han:
                chars[i] = right
            text = "".join(chars)
            certain += len(han)
        out, at = [], 0
        for match in _word.finditer(text):
            word = match.group()
            core = word.rstrip("!")
            if len(core) < 4 or core.isdigit():
                continue
            if re.search(r"[A-Z].*\d|^\d", core) and not re.search(r"[a-z][01!5][a-z]", core):
                continue
            right = self._latin_misread(core)
            if right:
                certain += bool(re.search(r"[0158!]", core))
                weak += not re.search(r"[0158!]", core)
                right = right.capitalize() if core[:1].isupper() or core[:1] in "0158!" and right[:1].isupper() else right
                out += [text[at : match.start()], right]
                at = match.start() + len(core)
        return "".join([*out, text[at:]]), certain, weak

    # -- lines ------------------------------------------------------------------------------------------------

    def clean(self, content: str, title: str, book: str, pages: tuple, running: set[str]) -> tuple[str, list[str]]:
        """(continuous text, kinds of traces found)."""
        traces = []
        text = content
        close = unspace(text)
        if close != text:
            traces.append("spaced")
            text = close
        text, certain, weak = self._fix_words(text)
        if certain or weak > 1:
            traces.append("misread")
        if "\f" in content:
            traces.append("page break")
        lines, printed = split_lines(text), split_lines(content)
        titles = [k for k in (fold(title), fold(book), fold(book + title), fold(title + book)) if len(k) > 1]
        numbers = [(_number(line), i) for i, line in enumerate(lines)]
        bare = [n for (n, kind), _ in numbers if kind == "bare"]
        low, high = pages
        kept, removed = [], False
        for i, line in enumerate(lines):
            n, kind = numbers[i][0]
            if kind == "marked" or kind == "bare" and (low and high and min(low, high) - 1 <= n <= max(low, high) + 1 or {n - 1, n + 1} & set(bare)):
                traces.append("page number")
                removed = True
                continue
            body = line.replace("\f", "")
            if body.strip() and is_short(body) and self._running(body, titles, running):
                traces.append("running line")
                removed = True
                continue
            kept.append((body, removed or "\f" in line, len((printed[i] if len(printed) == len(lines) else line).strip("\f"))))
            removed = False
        out = self._join(kept, traces)
        if set(traces) - {"misread", "spaced"}:  # the page's blank lines part what lines part anyhow
            out = re.sub(r"\n(?:[^\S\n]*\n)+", "\n", out)
        return out.rstrip("\n") if traces else out, sorted(set(traces))

    def _running(self, line: str, titles: list[str], running: set[str]) -> bool:
        key = fold(line)
        if not key:
            return False
        if key in running and not _block.search(line):
            return True
        if key in self.headings:
            return False
        for k in titles:
            if key == k:
                return True
            if len(k) > 4 and abs(len(k) - len(key)) <= 0.25 * len(k) and SequenceMatcher(None, k, key, False).ratio() >= 0.85:
                return True
        return False

    def _join(self, lines: list[tuple[str, bool, int]], traces: list[str]) -> str:
        """The lines, joined where they go on; each comes with whether something was cut before it and how wide it was printed."""
        wrapped = self._wrapped(lines)
        out: list[str] = []
        gap = blank = False  # since the last line that isn't blank
        printed = ""  # the last line that isn't blank, as it was printed
        for i, (line, after_gap, _) in enumerate(lines):
            gap = gap or after_gap
            last = out[-1] if out else ""
            if not line.strip():
                blank = True
                if out:
                    out.append(line)
                continue
            if blank and gap and out:  # blank lines that the page left
                while out and not out[-1].strip():
                    out.pop()
                last = out[-1] if out else ""
                if last and self._continues(out, line, printed):
                    blank = False
            if out and last.strip() and not blank and (self._continues(out, line, printed) or wrapped[i] or gap and self._parted(last, line)):
                self._append(out, line, traces, gap)
            else:
                out.append(line)
            gap = blank = False
            printed = line
        return "\n".join(out)

    def _append(self, out: list[str], line: str, traces: list[str], gap: bool) -> None:
        last = out[-1]
        cut = _hyphen_end.search(last)
        if cut and line[:1].isalpha():
            traces.append("hyphenation")
            first = re.match(r"\w+", line).group()
            whole, parts = (cut.group(1) + first).lower(), (cut.group(1) + "-" + first).lower()
            keep = first.lower() in self.vocabulary and cut.group(1).lower() in self.vocabulary and not self.vocabulary.get(whole) and first[:1].isupper() or parts in self.vocabulary
            out[-1] = (last.rstrip()[:-1] + "-" if keep else last.rstrip()[:-1]) + line
            return
        if not (gap and _terminal.search(last)):
            traces.append("line break")
        within = _han.search(last[-20:]) and last.rstrip()[-1:].isdigit() and line.lstrip()[:1].isdigit()  # a number in Han text
        latin = not within and last.rstrip()[-1:].isascii() and line.lstrip()[:1].isascii() or not (within or _han.match(last.rstrip()[-1:]) or _han.match(line.lstrip()[:1]) or line.lstrip()[:1] in "，。；：、）”" or last.rstrip()[-1:] in "，。；：、）”！？")
        out[-1] = last.rstrip() + (" " if latin else "") + line.lstrip()

    def _wrapped(self, lines: list[tuple[str, bool, int]]) -> list[bool]:
        """For each line, whether the line before it was wrapped, told by the widths of sure breaks up to five lines away."""
        out = [False] * len(lines)
        before, sure = [], {}
        for i, (line, _, _) in enumerate(lines):
            if line.strip() and before and self._continues(before, line, before[-1]):
                sure[i - 1] = lines[i - 1][2]
            before = [*before[-1:], line] if line.strip() else []
        for i in range(1, len(lines)):
            (last, _, width), (line, _, _) = lines[i - 1], lines[i]
            if i - 1 in sure or not last.strip() or not line.strip() or _table.search(last) or _table.search(line):
                continue
            if _block.search(line) and _terminal.search(last.rstrip()):
                continue
            near = []
            for step in (range(i - 2, max(-1, i - 7), -1), range(i, min(len(lines), i + 5))):
                for j in step:
                    if not lines[j][0].strip():
                        break
                    near += [sure[j]] if j in sure else []
            han = _han.search(last) is not None
            first = 1 if han else 1 + len(line.split(" ", 1)[0])
            if near and (width >= max(near) - (len(near) > 1) if han else len(near) > 1 and width + first > max(near) and width <= max(near) + 2):
                out[i] = True
        return out

    def _parted(self, last: str, line: str) -> bool:
        """Whether prose goes on after what the page put between two of its sentences."""
        if _table.search(last) or _table.search(line) or _block.search(line) or _block.search(last):
            return False
        if fold(last) in self.headings or fold(line) in self.headings:
            return False
        return bool(_terminal.search(last.rstrip())) and _prose(last) and _prose(line)

    def _continues(self, out: list[str], line: str, printed: str) -> bool:
        """Whether line goes on with the sentence that the last kept line, of which ``printed`` is the last line on paper, broke off."""
        last = out[-1].rstrip()
        if _table.search(last) or _table.search(line):
            return False
        if _closing.match(line.lstrip()) or line[:1].islower() and last[-1:] in ";:,":
            return True
        if _terminal.search(last):
            return False
        if "\ufffd" in last[-4:] or "\ufffd" in line[:3] or _private.search(last[-4:]):  # lost characters: no telling
            return False
        if len(re.split(r"[。！？；.!?;]", printed.rstrip())[-1]) > UNBROKEN:
            return False
        if _block.search(line) and not (_hyphen_end.search(last) and line[:1].islower()):
            return False
        if fold(last) in self.headings or fold(line) in self.headings:
            return False
        if _block.search(last) and not _goes_on(last):
            return False
        if line[:1].islower():
            return True
        if not _goes_on(last) and _heading_like(last) and (len(out) == 1 or _terminal.search(out[-2].rstrip()) or _table.search(out[-2]) or not _goes_on(out[-2])):
            return False
        return True


def _goes_on(line: str) -> bool:
    """Prose: has inner punctuation or is long."""
    return bool(re.search(r"[，。；！？]|[a-z]{2}[,.;] ", line)) or len(line) > (60 if not _han.search(line) else 24)


def _prose(line: str) -> bool:
    """A sentence: ends as one, or is too long for a heading."""
    return bool(_terminal.search(line.rstrip())) or _goes_on(line)


def _heading_like(line: str) -> bool:
    return len(line) <= (20 if _han.search(line) else 60) and not line[:1].islower() and not re.search(r"[，。；,]", line)


def _number(line: str) -> tuple[int, str]:
    match = _page.match(line)
    if not match:
        return -1, ""
    groups = match.groupdict()
    if groups["f"]:
        return int(groups["f"]), "bare" if "\f" not in line else "marked"
    return int(next(v for v in groups.values() if v)), "marked"


_letterspaced = re.compile(r"(?:[^\s|](?: {3}| |\n ?)){6,}|(?<![A-Za-z])(?:[一-鿿（）、，。；：](?: {3}| )){3,}")
_wide = re.compile("[㐀-鿿、-】＀-｠]")


def unspace(text: str) -> str:
    """Letterspaced text without the spaces between its characters; where a space was printed there are three."""

    def tighten(match: re.Match) -> str:
        run = match.group()
        if len(_wide.findall(run)) < 3:
            return run
        return re.sub(r" {3}|\n ?| ", lambda m: {" ": "", "   ": " "}.get(m.group(), "\n"), run)

    return _letterspaced.sub(tighten, text)


_TITLE_NUMBER = re.compile(r"^\s*\d{1,4}\s+(?=\S)|\s+[-–—]\s*\d{1,4}\s*[-–—]\s*$|\s*\|\s*\d{1,4}\s*$|\s{2,}\d{1,4}\s*$")
_TITLE_START = re.compile(r"(?:^|\s)(第[一二三四五六七八九十百\d]+[章节篇]\s|Chapter \d|[一二三四五六七八九十]{1,3}、|（[一二三四五六七八九十]+）|\d{1,2}\. )")


def clean_title(title: str, book: str, cleaner: Cleaner) -> tuple[str, list[str]]:
    """(clean title, kinds of traces)."""
    traces, out = [], title
    if "\n" in out:
        lines = [part.strip() for part in out.split("\n")]
        joined = lines[0]
        for part in lines[1:]:
            if _hyphen_end.search(joined) and part[:1].islower():
                joined = re.sub(r"[-‐‑­]\s*$", "", joined) + part
                traces.append("hyphenation")
            elif re.search(r"\s\d{1,4}\s*$", lines[0]) or fold(part) == fold(book):
                traces.append("running line")
                joined = re.sub(r"\s+\d{1,4}\s*$", "", joined)
            else:
                joined += " " + part
                traces.append("line break")
        out = joined
    if _leader.search(out):
        traces.append("leader")
        out = _leader.sub("", out)
    if re.search(r"(?:[一-鿿] ){3,}[一-鿿]", out):
        traces.append("spaced")
        out = re.sub(r"(?<=[一-鿿]) (?=[一-鿿])", "", out)
        out = re.sub(r" ?- ?", "-", out)
    numbered = _TITLE_NUMBER.search(out)
    if numbered:
        traces.append("page number")
        out = _TITLE_NUMBER.sub("", _TITLE_NUMBER.sub("", out))
        start = _TITLE_START.search(out, 1)
        if "|" in out:
            parts = [p.strip() for p in out.split("|")]
            out = next((p for p in parts if fold(p) != fold(book)), parts[-1]) if fold(book) in map(fold, parts) else parts[-1]
        elif book and out.startswith(book):
            out = out[len(book) :].strip()
        elif start:
            out = out[start.start(1) :]
    fixed, certain, weak = cleaner._fix_words(out)
    if certain or weak:
        traces.append("misread")
        out = fixed
    return out.strip() if traces else out, sorted(set(traces))


CLEANED = "textbook_id string, chapter_id string, clean_title string, clean_content string, title_traces array<string>, content_traces array<string>"


def clean_chapters(chapters: DataFrame, textbooks: DataFrame) -> DataFrame:
    """Every chapter row with its clean title and content and the kinds of traces that were found in them.

    Wrongly decoded stretches (problem 7) are restored first: their characters would pass for missing punctuation.
    """
    spark = chapters.sparkSession
    counts = collect_counts(character_counts(chapters, "content"))
    chapters = stage(repair(chapters, "content", counts).withColumn("content", F.col("restored")).drop("restored", "spans"), "restored")
    vocabulary, near, headings, running = statistics(chapters)
    held = spark.sparkContext.broadcast((vocabulary, near, headings))
    books = textbooks.groupBy("textbook_id").agg(F.min("title").alias("book"))
    rows = (
        chapters.select("textbook_id", "chapter_id", "title", "content", "page_start", "page_end")
        .join(books, "textbook_id", "left")
        .join(running, ["textbook_id", "chapter_id"], "left")
        .select("textbook_id", "chapter_id", "title", "content", "page_start", "page_end", "book", "running")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleaner = Cleaner(*held.value)
        for batch in batches:
            out = []
            for b, c, title, content, low, high, book, lines in batch.itertuples(index=False):
                new_title, title_traces = clean_title(title, book or "", cleaner) if title else (title, [])
                new_title = plain_form(new_title) if new_title else new_title
                pages = tuple(None if pd.isna(p) else int(p) for p in (low, high))
                new, traces = cleaner.clean(content, new_title or "", book or "", pages, set(lines) if lines is not None else set()) if content else (content, [])
                out.append((b, c, new_title, new if traces else content, title_traces, traces))
            yield pd.DataFrame(out, columns=["textbook_id", "chapter_id", "clean_title", "clean_content", "title_traces", "content_traces"])

    return rows.mapInPandas(run, CLEANED)
