"""Problem 9: evaluation texts that turn up in corpus documents.

A prefix-filtered set join. Texts are folded to their letters and digits (case, width, spacing and punctuation go) and
cut into shingles of SHINGLE code points. The corpus is read once: of every document the places of its shingles that some
item has are kept as a staged table of numbers, and how many documents have each shingle is counted on the way. Shingles
of an item are then ordered by their rarity in the corpus; a document can only hold a share t of an item's n shingles if
it has one of the n - ceil(t n) + 1 rarest, the necessary prefix, so documents and items are joined on those alone. Pairs
that meet are bounded by the number of the item's shingles that the document holds (length) and by what lies within one
item-sized window (position); every window that is left is verified exactly.

A case holds at least COVERED of the item in running order, in runs of RUN or more characters: as two runs with one
interruption of any length, or as several runs within an item-sized window (a few altered words). Several runs must hold
some of what only this item says (OWN), as texts of the same pattern about other things share as many.

Nothing of the corpus is shuffled but counts; the items travel to the documents. They are held-out test sets of a
bounded size, taken in blocks of ITEM_BLOCK, one pass over the corpus each.

Defined results: null and blank texts give nothing; items shorter than a shingle never match; copies of a document
give a row each; repeated rows give one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

SHINGLE, RUN = 4, 4
CONTAINED = 0.3
COVERED = 0.5
#: Of two runs with a long interruption between them each holds at least this share of the item.
APART = 0.125
#: Share of the shingles that no other item has which a case of more than two runs must hold.
OWN = 0.2
ITEM_BLOCK = 4_096
_BITS = 22
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _kept() -> np.ndarray:
    """For each code point: kept when folding (letters, digits, marks of scripts that need them)."""
    global _KEPT
    if _KEPT is None:
        _KEPT = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
        _KEPT[0] = True
    return _KEPT


_KEPT: np.ndarray | None = None


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins): letters and digits of the compatibility and case folded texts."""
    joined = "\0".join(unicodedata.normalize("NFKC", t).casefold().replace("\0", "") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = codes[_kept()[codes]]
    ends = np.flatnonzero(codes == 0)
    return codes, np.r_[0, ends + 1]


def hashes(codes: np.ndarray) -> np.ndarray:
    """A hash for each window of SHINGLE code points; windows over the end of a text get 0."""
    n = max(0, len(codes) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    crossing = np.zeros(n, dtype=bool)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            part = codes[k : k + n].astype(np.uint64)
            out = (out ^ (part + np.uint64(1))) * _PRIME
            out ^= out >> np.uint64(29)
            crossing |= part == 0
    out[out == 0] = 1
    out[crossing] = 0
    return out


def shared_shingles(rows: list[tuple[str, str]]) -> np.ndarray:
    """The shingles that items of more than one name have, in order."""
    owners = {name: i for i, name in enumerate(dict.fromkeys(name for name, _ in rows))}
    codes, starts = folded([text for _, text in rows])
    every = hashes(codes)
    owner = np.array([owners[name] for name, _ in rows], dtype=np.uint64)[np.searchsorted(starts, np.arange(len(every)), side="right") - 1]
    pairs = np.unique(np.stack([every, owner])[:, every != 0], axis=1)[0]
    keys, n = np.unique(pairs, return_counts=True)
    return keys[n > 1]


class Items:
    """The shingles of a block of items, as arrays that documents are looked up in."""

    def __init__(self, rows: list[tuple[str, str]], shared: np.ndarray | None = None):
        self.names = [name for name, _ in rows]
        codes, starts = folded([text for _, text in rows])
        self.length = np.diff(np.r_[starts, len(codes) + 1]) - 1
        every = hashes(codes)
        item = np.searchsorted(starts, np.arange(len(every)), side="right") - 1
        order = np.lexsort((np.arange(len(every)), item, every))
        order = order[every[order] != 0]
        # one entry for each place of a shingle; an entry is first if it is the first of its shingle and item
        self.hash, self.item, self.at = every[order], item[order].astype(np.int32), (order - starts[item[order]]).astype(np.int32)
        self.first = np.r_[True, (self.hash[1:] != self.hash[:-1]) | (self.item[1:] != self.item[:-1])][: len(order)]
        self.keys, self.begin = np.unique(self.hash, return_index=True)
        self.end = np.r_[self.begin[1:], len(self.hash)].astype(np.int64)
        self.key = np.repeat(np.arange(len(self.keys)), self.end - self.begin)
        self.size = np.bincount(self.item[self.first], minlength=len(rows))
        shared = shared_shingles(rows) if shared is None else shared
        self.own = ~np.isin(self.hash, shared)
        self.own_size = np.bincount(self.item[self.own & self.first], minlength=len(rows))
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.keys >> np.uint64(64 - _BITS)] = True
        self.least = int(np.ceil(CONTAINED * self.size[self.size > 0]).min()) if len(self.keys) else 1
        self.prefix = np.ones(len(self.hash), dtype=bool)
        self.leading = np.ones(len(self.keys), dtype=bool)

    def order(self, frequency: np.ndarray) -> None:
        """Mark the necessary prefix of each item, by how many documents have each key, rarest shingles first."""
        entry = np.flatnonzero(self.first)
        df = np.repeat(frequency, self.end - self.begin)[entry]
        rank = entry[np.lexsort((self.hash[entry], df, self.item[entry]))]
        start = np.r_[0, np.cumsum(self.size)[:-1]]
        place = np.arange(len(rank)) - start[self.item[rank]]
        needed = np.array([s - ceil(CONTAINED * s) + 1 for s in self.size], dtype=np.int64)
        self.prefix = np.zeros(len(self.hash), dtype=bool)
        self.prefix[rank[place < needed[self.item[rank]]]] = True
        self.leading = np.add.reduceat(self.prefix, self.begin) > 0 if len(self.keys) else self.leading

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index of key) of every window of codes that is a shingle of an item."""
        h = hashes(codes)
        where = np.flatnonzero(self.seen[h >> np.uint64(64 - _BITS)])
        h = h[where]
        found = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        ok = self.keys[found] == h if len(self.keys) else np.zeros(len(h), bool)
        return where[ok], found[ok]

    def lookup(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, keys) of the shingles of items in each text."""
        codes, starts = folded(texts)
        where, key = self.hits(codes)
        cut = np.searchsorted(where, np.r_[starts, len(codes) + 1])
        return [((where[a:b] - start).astype(np.int32), key[a:b].astype(np.int32)) for start, a, b in zip(starts, cut[:-1], cut[1:])]

    def _expand(self, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document and item as one number, entry, index of the hit) for each place of the shingle of a hit in an item."""
        many = self.end[key] - self.begin[key]
        which = np.repeat(np.arange(len(key)), many)
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.begin[key[which]]
        return doc[which].astype(np.int64) * len(self.names) + self.item[entry], entry, which

    def matches(self, found: list[tuple[np.ndarray, np.ndarray]], prefix: bool = True) -> list[tuple[int, int, float]]:
        """(document, item, share covered) of every verified case, of the hits of documents."""
        n = len(self.names)
        doc = np.repeat(np.arange(len(found)), [len(where) for where, _ in found])
        if not len(doc):
            return []
        where, key = (np.concatenate(x) for x in zip(*found))
        lead = self.leading[key] if prefix else np.ones(len(key), dtype=bool)
        met, entry, _ = self._expand(doc[lead], key[lead])
        met = np.unique(met[self.prefix[entry]] if prefix else met)
        # all shingles of the documents that met an item
        near = np.isin(doc, met // n)
        pair, entry, which = self._expand(doc[near], key[near])
        chosen = np.isin(pair, met)
        pair, entry, where = pair[chosen], entry[chosen], where[near][which[chosen]]
        if not len(pair):
            return []
        # runs: hits side by side in both texts
        at, place = where.astype(np.int64), self.at[entry].astype(np.int64)
        order = np.lexsort((at, at - place, pair))
        pair, entry, at, place = pair[order], entry[order], at[order], place[order]
        low = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(at) != 1) | (np.diff(place) != 1)])
        size = np.diff(np.r_[low, len(at)]) + SHINGLE - 1
        of = pair[low]
        heads = np.flatnonzero(np.r_[True, np.diff(of) != 0])
        pairs, tails = of[heads], np.r_[heads[1:], len(of)]
        item = (pairs % n).astype(np.int64)
        # bounds of every pair: distinct shingles, its own ones among them, what runs can cover
        once, back = np.unique(np.searchsorted(pairs, pair) * len(self.keys) + self.key[entry], return_index=True)
        held = np.bincount(once // len(self.keys), minlength=len(pairs))
        owned = np.bincount(once // len(self.keys), weights=self.own[entry[back]], minlength=len(pairs))
        ranked = size[np.lexsort((-size, of))]
        two = ranked[heads] + np.where(tails - heads > 1, ranked[np.minimum(heads + 1, len(ranked) - 1)], 0)
        every = np.add.reduceat(size, heads)
        need = COVERED * self.length[item]
        likely = (held >= CONTAINED * self.size[item]) & ((two >= need) | (every >= need) & (owned >= OWN * self.own_size[item]))
        out = []
        ends = np.r_[low[1:], len(at)]
        for p in np.flatnonzero(likely):
            d, i = divmod(int(pairs[p]), n)
            runs = slice(heads[p], tails[p])
            by = np.lexsort((place[low[runs]], at[low[runs]]))
            share = self.share(at[low[runs]][by], place[low[runs]][by], size[runs][by], [entry[a:b] for a, b in zip(low[runs][by], ends[runs][by])], i)
            if share >= COVERED:
                out.append((d, i, share))
        return out

    def share(self, start: np.ndarray, begin: np.ndarray, size: np.ndarray, entries: list[np.ndarray], item: int) -> float:
        """The largest share of the item in running order, of runs from a place of the document and one of the item on."""
        text = int(self.length[item])
        best = self._two(start, begin, size, text)
        width = int(1.6 * text) + 20
        until = np.searchsorted(start, start + width, side="right")
        total = np.r_[0, np.cumsum(size)]
        for i in np.flatnonzero(total[until] - total[np.arange(len(start))] >= COVERED * text):
            some = slice(i, until[i])
            held = np.unique(np.concatenate(entries[some]))
            covered = np.zeros(text + SHINGLE, dtype=bool)
            for k in range(SHINGLE):
                covered[self.at[held] + k] = True
            own = len(np.unique(self.key[held[self.own[held]]]))
            if covered.sum() >= max(COVERED * text, best * text) and own >= OWN * self.own_size[item]:
                best = max(best, _in_order(start[some], begin[some], size[some]) / max(1, text))
        return min(best, 1.0)

    @staticmethod
    def _two(start: np.ndarray, begin: np.ndarray, size: np.ndarray, text: int) -> float:
        """The most that one run, or two that follow each other, hold of the item."""
        best = int(size.max())
        keep = np.flatnonzero(size >= min(COVERED * text - best, COVERED * text / 2))
        start, begin, size = start[keep], begin[keep], size[keep]
        long_ = size >= APART * text
        for j in range(len(start)):  # overlaps count once
            over = np.maximum(np.maximum(start + size - start[j], begin + size - begin[j]), 0)
            ok = (start < start[j]) & (begin < begin[j]) & (size[j] - over >= RUN)
            ok &= (start[j] - start - size <= 0.6 * text + 20) | long_ & long_[j]
            if ok.any():
                best = max(best, int((size + size[j] - over)[ok].max()))
        return best / max(1, text)


def _in_order(start: np.ndarray, begin: np.ndarray, size: np.ndarray) -> int:
    """The most characters that a chain of runs holds which follow each other in both texts; overlaps count once."""
    best = size.astype(np.int64).copy()
    for j in range(1, len(start)):
        over = np.maximum(np.maximum(start[:j] + size[:j] - start[j], begin[:j] + size[:j] - begin[j]), 0)
        ok = (start[:j] < start[j]) & (begin[:j] < begin[j]) & (size[j] - over >= RUN)
        if ok.any():
            best[j] = max(best[j], int((best[:j] + size[j] - over)[ok].max()))
    return int(best.max())


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, question_id, part, share): documents that hold at least half of an item's question or answer.

    ``items`` has (question_id, part, text) and is collected: a test set, taken in blocks of ITEM_BLOCK.
    """
    spark = documents.sparkSession
    rows = [r for r in items.where(F.length(F.trim("text")) > 0).distinct().orderBy("question_id", "part", "text").collect()]
    texts = documents.select("doc_id", "text").where(F.length("text") >= SHINGLE)
    empty = "doc_id bigint, question_id string, part string, share double"
    out = spark.createDataFrame([], empty)
    shared = shared_shingles([(r["question_id"], r["text"]) for r in rows]) if rows else None
    for start in range(0, len(rows), ITEM_BLOCK):
        block = rows[start : start + ITEM_BLOCK]
        index = Items([(r["question_id"], r["text"]) for r in block], shared)
        if len(index.keys):
            out = out.unionByName(_scan(texts, index, [(r["question_id"], r["part"]) for r in block], empty))
    return out.groupBy("doc_id", "question_id", "part").agg(F.max("share").alias("share"))


def _scan(texts: DataFrame, index: Items, names: list[tuple[str, str]], schema: str) -> DataFrame:
    context = texts.sparkSession.sparkContext
    plain = context.broadcast(index)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = plain.value.lookup(list(batch["text"]))
            n = np.zeros(len(plain.value.keys), dtype=np.int32)
            rows = []
            for doc, (where, key) in zip(batch["doc_id"], found):
                distinct = np.unique(key)
                n[distinct] += 1
                if len(distinct) >= plain.value.least:  # fewer are a case of no item
                    rows.append((doc, where.tobytes(), key.tobytes()))
            some = np.flatnonzero(n).astype(np.int32)
            rows.append((None, n[some].tobytes(), some.tobytes()))  # in how many documents of the batch a shingle is
            yield pd.DataFrame(rows, columns=["doc_id", "places", "shingles"])

    seen = stage(texts.mapInPandas(look, "doc_id bigint, places binary, shingles binary"), "shingles")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(plain.value.keys), dtype=np.int64)
        for batch in batches:
            for n, key in zip(batch["places"], batch["shingles"]):
                total[np.frombuffer(key, dtype=np.int32)] += np.frombuffer(n, dtype=np.int32)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"k": some.astype(np.int64), "n": total[some]})

    # document frequencies over all documents: no more rows than the items have shingles
    counts = seen.where("doc_id is null").mapInPandas(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(index.keys), dtype=np.int64)
    frequency[counts["k"].to_numpy()] = counts["n"].to_numpy()
    index.order(frequency)
    ordered = context.broadcast(index)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            found = ordered.value.matches([(np.frombuffer(w, dtype=np.int32), np.frombuffer(k, dtype=np.int32)) for w, k in zip(batch["places"], batch["shingles"])])
            yield pd.DataFrame(
                [(int(ids[d]), *names[i], share) for d, i, share in found], columns=["doc_id", "question_id", "part", "share"]
            )

    return seen.where("doc_id is not null").mapInPandas(match, schema)


def eval_texts(items: DataFrame) -> DataFrame:
    """(question_id, part, text) for the questions and the expected answers."""
    question = items.select("question_id", F.lit("question").alias("part"), F.col("question").alias("text"))
    return question.unionByName(items.select("question_id", F.lit("answer").alias("part"), F.col("expected_answer").alias("text")))
