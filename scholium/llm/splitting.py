"""Problem 5: items above a size limit become ordered pieces that end at natural boundaries and overlap.

An oversized text is cut into atomic segments, then agglomerated: adjacent segments wait in a heap by the strength
of the boundary between them, the weakest boundary is merged first, and a merge stands only while the combined size
plus the overlap fits the limit. Every piece but the first begins ``overlap`` code points before the end of the
piece before it. A run without any natural boundary is cut at the limit.

Defined results: null and empty texts and texts within the limit give no pieces (they are whole already); repeated
rows give repeated pieces; limits without an overlap count as overlap 0; extra columns are not carried along.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak: paragraph, line, sentence, clause, word. A boundary is the place after the match.
LEVELS = (
    (5, re.compile(r"\r?\n[ \t\r]*\n\s*")),
    (4, re.compile(r"\r?\n|[\r  \x0b\x0c\x85]")),
    (3, re.compile(r"[。！？!?…]+[”’」』）)\"']*|\.(?=\s)[”’)\"']*")),
    (2, re.compile(r"[；;：:，,、](?!\d)")),
    (1, re.compile(r"\s+")),
)
PIECES = "item_kind string, item_key string, piece_index int, char_start int, char_end int, boundary int, text string"


def boundaries(text: str, room: int) -> dict[int, int]:
    """position -> strength of the boundary that ends there; weak kinds only within stretches longer than room."""
    found: dict[int, int] = {}
    whole = [(0, len(text))]
    for strength, pattern in LEVELS:
        for start, end in whole:
            for match in pattern.finditer(text, start, end):
                found.setdefault(match.end(), strength)
        if strength <= 3:
            ends = [0, *sorted(found), len(text)]
            whole = [(i, j) for i, j in zip(ends, ends[1:]) if j - i > room]
            if not whole:
                break
    found.pop(len(text), None)
    found.pop(0, None)
    return found


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of each piece; the last piece has strength 6."""
    overlap = max(0, min(overlap, limit - 1))
    if len(text) <= limit:
        return [(0, len(text), 6)]
    room = limit - overlap
    strength = boundaries(text, room)
    cuts = sorted(strength)
    ends, last = [], 0
    for end in [*cuts, len(text)]:  # atoms longer than a piece can hold are cut hard
        while end - last > room:
            last += room
            ends.append(last)
            strength.setdefault(last, 0)
        if end > last:
            ends.append(end)
            last = end
    starts = [0, *ends[:-1]]
    before = list(range(-1, len(ends) - 1))
    after = [*range(1, len(ends)), -1]
    alive = [True] * len(ends)
    heap = [(strength.get(ends[i], 0), ends[i + 1] - starts[i], i, i + 1) for i in range(len(ends) - 1)]
    heapq.heapify(heap)
    while heap:
        level, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or size != ends[j] - starts[i]:
            continue
        if size + (overlap if starts[i] else 0) > limit:
            continue
        ends[i], alive[j], after[i] = ends[j], False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
            heapq.heappush(heap, (strength.get(ends[i], 0), ends[after[i]] - starts[i], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strength.get(starts[i], 0), ends[i] - starts[before[i]], before[i], i))
    pieces = []
    for i in range(len(ends)):
        if alive[i]:
            pieces.append((max(0, starts[i] - overlap) if starts[i] else 0, ends[i], strength.get(ends[i], 6)))
    return pieces


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, key, text, limit, overlap in batch.itertuples(index=False):
            for n, (start, end, level) in enumerate(split(text, int(limit), int(overlap))):
                rows.append((kind, key, n, start, end, level, text[start:end]))
        yield pd.DataFrame(rows, columns=["item_kind", "item_key", "piece_index", "char_start", "char_end", "boundary", "text"])


def pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every (item_kind, item_key, text) row that is longer than its kind's limit.

    Limits are a handful of rows by design (one a kind), so they are broadcast; the length test runs in the JVM and
    only oversized texts reach Python. Pieces of one item come from one row: nothing is shuffled.
    """
    sizes = limits.where(F.col("unit") == "characters").select(
        "item_kind", F.col("max_size").alias("_limit"), F.coalesce("overlap", F.lit(0)).alias("_overlap")
    )
    over = (
        items.select("item_kind", "item_key", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(sizes), "item_kind")
        .where(F.length("text") > F.col("_limit"))
        .select("item_kind", "item_key", "text", "_limit", "_overlap")
    )
    return over.mapInPandas(_split_batches, PIECES)


def corpus_items(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """chapters.content and chunks.text under one shape."""
    chapter = chapters.select(
        F.lit("chapter").alias("item_kind"), F.concat_ws(":", "textbook_id", "chapter_id").alias("item_key"), F.col("content").alias("text")
    )
    chunk = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text")
    return chapter.unionByName(chunk)
