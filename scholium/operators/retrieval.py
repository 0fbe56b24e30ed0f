"""Search over chunks: keyword, character n-gram, vector and hybrid scores, top k for each question, citations.

Questions are few beside the chunks: they are taken in blocks of ASKED, one pass over the chunks each. A pass reads a chunk's text
once, counts its tokens, and meets the questions through an inverted index of the block, so chunks that share nothing with a question
are never paired with it; sums of minima with the totals give every measure. Where only the best k are wanted, no more than k rows
a question leave a batch, and texts never travel.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import text as T

TOP_K = 5


#: Questions of a pass over the chunks: what is collected and broadcast at once.
ASKED = 4_096
#: Vectors that a block of questions is compared with at once: a few arrays of ASKED times as many numbers are held.
COMPARED = 512
_run = re.compile("[一-鿿]+|[a-z0-9]+")
PAIRS = "question_id string, chunk_id string, keyword double, keyword_recall double, title double, title_recall double, ngram double, within double, low double"
#: The token kinds that a mode's score is made of; "key" finds the texts that hold a whole question.
KINDS = {"keyword": ("body", "head", "key"), "char_ngram": ("head", "gram"), "vector": ("head", "key"), "hybrid": ("body", "head", "gram")}


def _windows(text: str, *sizes: int) -> list[str]:
    return [text[i : i + n] for n in sizes for i in range(len(text) - n + 1)]


def _terms(lower: str) -> list[str]:
    """The same as functions.text.terms of a text in lower case."""
    out = []
    for run in _run.findall(lower):
        if run[0] >= "一":
            out.append(run)
            if len(run) > 2:
                out += _windows(run, 2, 3, 4)
        elif len(run) > 1:
            out.append(run)
    return out


class _Asked:
    """An inverted index of a block of questions, for each kind of token."""

    def __init__(self, rows: pd.DataFrame, kinds: tuple[str, ...]):
        self.ids, self.keys = rows["question_id"].to_numpy(dtype=object), rows["key"].tolist()
        terms = [Counter(_terms(t)) for t in rows["lower"]]
        grams = [Counter(_windows(k, 2, 3)) for k in self.keys]
        self.terms = np.array([sum(c.values()) for c in terms], dtype=np.int64)
        self.norms = np.array([sqrt(sum(n * n for n in c.values())) for c in grams])
        self.index = {k: self._inverted(grams if k == "gram" else terms) for k in kinds if k != "key"}
        self.starts: dict[str, list[int]] = {}
        if "key" in kinds:
            for q, key in enumerate(self.keys):
                if key:
                    self.starts.setdefault(key[:3], []).append(q)

    @staticmethod
    def _inverted(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        """(token -> number, where its questions begin, the questions, how often they have it)."""
        held: dict[str, list[tuple[int, int]]] = {}
        for q, c in enumerate(counts):
            for token, n in c.items():
                held.setdefault(token, []).append((q, n))
        flat = np.array([x for some in held.values() for x in some], dtype=np.int64).reshape(-1, 2)
        return {t: i for i, t in enumerate(held)}, np.r_[0, np.cumsum([len(v) for v in held.values()])].astype(np.int64), flat[:, 0], flat[:, 1]

    def sums(self, kind: str, found: list[tuple[int, int, int]], product: bool) -> tuple[np.ndarray, np.ndarray]:
        """(chunk and question as one number, sum over shared tokens) of (chunk, token, times) found in a batch."""
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        _, begin, question, times = self.index[kind]
        chunk, token, n = np.array(found, dtype=np.int64).T
        many = begin[token + 1] - begin[token]
        which = np.repeat(np.arange(len(token)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[token[which]]
        value = n[which] * times[at] if product else np.minimum(n[which], times[at])
        pair, back = np.unique(chunk[which] * len(self.ids) + question[at], return_inverse=True)
        return pair, np.bincount(back, weights=value, minlength=len(pair)).astype(np.int64)


def _measured(batch: pd.DataFrame, asked: _Asked, kinds: tuple[str, ...], placed: bool = False) -> pd.DataFrame:
    """PAIRS of a batch of chunks (chunk_id, key, lower, head, low); placed adds where chunk and question are in the batch and the block."""
    found: dict[str, list] = {k: [] for k in ("body", "head", "gram")}
    totals = {"body": np.zeros(len(batch), dtype=np.int64), "head": np.zeros(len(batch), dtype=np.int64)}
    norms, met = np.zeros(len(batch)), []
    keys = batch["key"].tolist()
    for i, (key, lower, head) in enumerate(zip(keys, batch["lower"], batch["head"])):
        for kind, tokens in (("body", _terms(lower)), ("head", _terms(head))):
            totals[kind][i] = len(tokens)
            if kind in kinds:
                known = asked.index[kind][0]
                found[kind] += [(i, known[t], n) for t, n in Counter(t for t in tokens if t in known).items()]
        if "gram" in kinds:
            counts, known = Counter(_windows(key, 2, 3)), asked.index["gram"][0]
            norms[i] = sqrt(sum(n * n for n in counts.values()))
            found["gram"] += [(i, known[t], n) for t, n in counts.items() if t in known]
        if asked.starts:
            for start in asked.starts.keys() & {key[j : j + n] for n in (1, 2, 3) for j in range(len(key) - n + 1)}:
                met += [i * len(asked.ids) + q for q in asked.starts[start]]
    sums = {kind: asked.sums(kind, found[kind], kind == "gram") for kind in found}
    pairs = np.unique(np.concatenate([*(p for p, _ in sums.values()), np.array(met, dtype=np.int64)]))
    got = {}
    for kind, (pair, value) in sums.items():
        got[kind] = np.zeros(len(pairs), dtype=np.int64)
        got[kind][np.searchsorted(pairs, pair)] = value
    chunk, question = pairs // len(asked.ids), pairs % len(asked.ids)
    wanted = asked.terms[question]

    def ratio(shared: np.ndarray, there: np.ndarray, union: bool) -> np.ndarray:
        below = wanted + there - shared if union else wanted
        return np.where((wanted == 0) | (there == 0) | (below == 0), 0.0, shared / np.maximum(below, 1))

    scale = asked.norms[question] * norms[chunk]
    body, head = totals["body"][chunk], totals["head"][chunk]
    return pd.DataFrame(
        {
            "question_id": asked.ids[question],
            "chunk_id": batch["chunk_id"].to_numpy(dtype=object)[chunk],
            "keyword": ratio(got["body"], body, True),
            "keyword_recall": ratio(got["body"], body, False),
            "title": ratio(got["head"], head, True),
            "title_recall": ratio(got["head"], head, False),
            "ngram": np.where(scale == 0, 0.0, got["gram"] / np.where(scale == 0, 1.0, scale)),
            "within": [0.15 if asked.keys[q] and asked.keys[q] in keys[c] else 0.0 for c, q in zip(chunk, question)],
            "low": np.where(batch["low"].to_numpy(dtype=bool)[chunk], 0.12, 0.0),
            **({"_c": chunk, "_q": question} if placed else {}),
        }
    )


def _read(chunks: DataFrame, **more: Column) -> DataFrame:
    title = T.blank_to_empty(F.col("chapter_title"))
    return chunks.select(
        "chunk_id", T.query_key(T.blank_to_empty(F.col("text"))).alias("key"), F.lower(T.blank_to_empty(F.col("text"))).alias("lower"), F.lower(title).alias("head"),
        T.low_signal_chunk(F.col("chapter_title"), F.col("page_start"), F.col("text")).alias("low"), *[c.alias(n) for n, c in more.items()],
    )


def _ask(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.lower(T.blank_to_empty(F.col("question"))).alias("lower"), T.query_key(F.col("question")).alias("key")).where("question_id is not null")


def lexical_of(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, mode: str) -> DataFrame:
    """The rows of lexical_pairs() for the candidates (question_id, chunk_id) alone: nothing else is measured."""
    kinds = KINDS[mode]
    ask = _ask(questions).toDF("question_id", "_lower", "_key")
    pairs = candidates.select("question_id", "chunk_id").distinct().join(ask, "question_id").join(_read(chunks), "chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = batch.fillna({"low": False, "_lower": "", "_key": ""})
            for _, rows in some.groupby("question_id", sort=False):
                asked = rows[["question_id", "_lower", "_key"]].head(1).set_axis(["question_id", "lower", "key"], axis=1)
                yield _measured(rows, _Asked(asked, kinds), kinds)

    return pairs.mapInPandas(run, PAIRS)


def lexical_pairs(questions: DataFrame, chunks: DataFrame, mode: str = "hybrid", k: int | None = None, min_score: float = 0.0) -> DataFrame:
    """Every pair with a token of the mode's kinds in common, with all the measures that its score is made of.

    With k, of each batch only those that can be among the k best of their question by the mode's score.
    """
    spark, kinds = chunks.sparkSession, KINDS[mode]
    read, ask = _read(chunks), _ask(questions)
    passes = max(1, -(-ask.count() // ASKED))
    out = None
    for turn in range(passes):  # about ASKED questions come to the driver at once
        block = _Asked(ask.where(F.pmod(F.xxhash64("question_id"), F.lit(passes)) == turn).toPandas().fillna({"lower": "", "key": ""}), kinds)
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], held: object = held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), 1_000):
                    rows = _measured(batch.iloc[start : start + 1_000].fillna({"low": False}), held.value, kinds)
                    if k is not None:
                        score = np.clip(_weighed(mode, *(rows[c].to_numpy() for c in ("keyword", "title", "ngram", "within", "low"))), 0.0, 1.0)
                        rows = rows.assign(_s=score)[(score > 0) & (score >= min_score)].sort_values(["_s", "chunk_id"], ascending=[False, True])
                        rows = rows.groupby("question_id", sort=False).head(k).drop(columns="_s")
                    yield rows

        part = read.mapInPandas(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def _firsts(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """What can still be among the k best by score, rounded to four places, and chunk id: of one score k rows a question are enough."""
    rows = rows.sort_values(["score", "chunk_id"], ascending=[False, True])
    rows = rows[rows.groupby(["question_id", "score"], sort=False).cumcount() < k]
    kth = rows[rows.groupby("question_id", sort=False).cumcount() == k - 1].set_index("question_id")["score"]
    return rows[rows["score"] >= rows["question_id"].map(kth).fillna(-1.0) - 0.00015]


def phrased_pairs(questions: DataFrame, chunks: DataFrame, kinds: str, weigh: Callable, low: Column, k: int, min_score: float) -> DataFrame:
    """(question_id, chunk_id, score) of the pairs of lexical_pairs() that can be among the k best of their question; no more leave a task.

    ``weigh(rows, body, head, low)`` is the score before clamping, body and head being the shares of the question's salient phrases that
    text and title hold, which it may not fall with: they are looked up only where the pair could be kept with all of them. ``low`` is the
    chunk's sign of a low-signal title.
    """
    spark = chunks.sparkSession
    read = _read(chunks, title=T.query_key(T.blank_to_empty(F.col("chapter_title"))), sign=low)
    ask = _ask(questions).join(questions.select("question_id", T.salient(F.col("question")).alias("phrases")), "question_id")
    passes = max(1, -(-ask.count() // ASKED))
    out = None
    for turn in range(passes):
        rows = ask.where(F.pmod(F.xxhash64("question_id"), F.lit(passes)) == turn).toPandas().fillna({"lower": "", "key": ""})
        held = spark.sparkContext.broadcast((_Asked(rows, KINDS[kinds]), [list(p) for p in rows["phrases"]]))

        def run(batches: Iterator[pd.DataFrame], held: object = held) -> Iterator[pd.DataFrame]:
            block, phrases = held.value
            kept = pd.DataFrame({"question_id": [], "chunk_id": [], "score": []})
            for batch in batches:
                for start in range(0, len(batch), 1_000):
                    some = batch.iloc[start : start + 1_000].fillna({"low": False, "sign": False})
                    rows, sign = _measured(some, block, KINDS[kinds], placed=True), some["sign"].to_numpy(dtype=bool)
                    sign = np.where(sign[rows["_c"].to_numpy()], 0.12, 0.0)
                    score = lambda r, body, head, sign: np.clip(weigh(r, body, head, sign), 0.0, 1.0)
                    least = rows.assign(score=score(rows, 0.0, 0.0, sign), most=score(rows, 1.0, 1.0, sign), sign=sign)
                    known = pd.concat([kept, least[["question_id", "chunk_id", "score"]]]).sort_values("score", ascending=False)
                    kth = known[known.groupby("question_id", sort=False).cumcount() == k - 1].set_index("question_id")["score"]
                    rows = least[(least["most"] >= min_score) & (least["most"] >= least["question_id"].map(kth).fillna(-1.0) - 0.00015)]
                    hits = {}
                    for name, texts in (("body", some["key"].tolist()), ("head", some["title"].tolist())):
                        hits[name] = np.array([sum(p in texts[c] for p in phrases[q]) / len(phrases[q]) if phrases[q] and texts[c] else 0.0 for c, q in zip(rows["_c"], rows["_q"])], dtype=float)
                    rows = rows.assign(score=score(rows, hits["body"], hits["head"], rows["sign"]))
                    rows = rows.loc[rows["score"] >= min_score, ["question_id", "chunk_id", "score"]]
                    kept = _firsts(pd.concat([kept, rows]) if len(kept) else rows, k)
            yield kept

        part = read.mapInPandas(run, "question_id string, chunk_id string, score double")
        out = part if out is None else out.unionByName(part)
    return out


def _weighed(mode: str, keyword, title, ngram, within, low, vector=0.0):
    """The score of a retrieval mode before clamping, of columns or arrays alike."""
    return {
        "keyword": lambda: keyword + title * 0.18 + within - low,
        "char_ngram": lambda: ngram + title * 0.12 + within - low,
        "vector": lambda: vector + title * 0.06 + within * 0.3 - low,
        "hybrid": lambda: vector * 0.45 + keyword * 0.22 + ngram * 0.18 + title * 0.15 + within - low,
    }[mode]()


def mode_score(mode: str, vector: Column | None = None) -> Column:
    """The clamped score of a retrieval mode over the columns of lexical_pairs()."""
    vector = F.lit(0.0) if vector is None else vector
    return S.clamp(_weighed(mode, *(F.col(c) for c in ("keyword", "title", "ngram", "within", "low")), vector))


def top(scored: DataFrame, k: int, min_score: float) -> DataFrame:
    """The k best chunks of each question, ties by chunk id; scores of 0 and below min_score are left out."""
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    kept = scored.where((F.col("score") > 0) & (F.col("score") >= min_score))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def lexical_top(questions: DataFrame, chunks: DataFrame, mode: str = "keyword", k: int = TOP_K, min_score: float = 0.0) -> DataFrame:
    scored = lexical_pairs(questions, chunks, mode, min(k, TOP_K), min_score).withColumn("score", mode_score(mode))
    return top(scored, min(k, TOP_K), min_score).select("question_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def vector_top(queries: DataFrame, vectors: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): exact top k by cosine of a stated query set against all vectors.

    The query set is taken in blocks of ASKED, a pass over the vectors each; no more than k rows a query leave a task. Vectors are only
    compared with those of the same length and group; null and all-zero ones never match.
    """
    spark = vectors.sparkSession
    keyed = lambda df, name: df.where(F.col("embedding").isNotNull()).select(F.col(name).alias("id"), (F.col(group) if group else F.lit("")).cast("string").alias("grp"), F.col("embedding").cast("array<double>").alias("v"))
    ask, read = keyed(queries, "query_id"), keyed(vectors, "chunk_id")
    passes = max(1, -(-ask.count() // ASKED))
    found = spark.createDataFrame([], "query_id string, chunk_id string, similarity double")
    for turn in range(passes):
        block = ask.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn).toPandas()
        held = spark.sparkContext.broadcast({key: _unit(some) for key, some in block.groupby(["grp", block["v"].map(len)])})
        found = found.unionByName(read.mapInPandas(_nearest(held, k), found.schema))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors of length 1) of the rows that aren't all zero."""
    x = np.stack(rows["v"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0))
    norm = np.sqrt((x * x).sum(1))
    ok = norm > 0
    return rows["id"].to_numpy(dtype=object)[ok], x[ok] / norm[ok, None]


def _nearest(held: object, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, some in batch.groupby(["grp", batch["v"].map(len)]):
                if key not in held.value:
                    continue
                (names, q), (ids, y) = held.value[key], _unit(some)
                for start in range(0, len(y), COMPARED):
                    part = ids[start : start + COMPARED]
                    exact = np.maximum(q @ y[start : start + COMPARED].T, 0.0)
                    exact[names[:, None] == part[None, :]] = -np.inf
                    rounded = np.round(exact, 6)
                    n = min(k, exact.shape[1])
                    least = -np.partition(-rounded, n - 1, axis=1)[:, n - 1]  # with all ties of the k-th
                    i, j = np.nonzero((rounded >= least[:, None]) & np.isfinite(exact))
                    yield pd.DataFrame({"query_id": names[i], "chunk_id": part[j], "similarity": exact[i, j]})

    return run


def reranked(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, mode: str, k: int = TOP_K, min_score: float = 0.0) -> DataFrame:
    """Second stage of vector and hybrid search: the candidates (question_id, chunk_id, similarity) under the full score."""
    lexical = lexical_of(questions, candidates, chunks, mode)
    rows = candidates.join(lexical, ["question_id", "chunk_id"], "left").fillna(0.0, ["keyword", "title", "ngram", "within", "low"])
    scored = rows.withColumn("score", mode_score(mode, F.col("similarity")))
    return top(scored, min(k, TOP_K), min_score).select("question_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def candidate_pool(k: int) -> int:
    return max(2 * k, 10)


def citations(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Matches with what a citation shows."""
    label = T.citation_label(F.col("textbook_title"), F.col("chapter_title"), F.col("page_start"), F.col("page_end"))
    info = chunks.select("chunk_id", "textbook_id", "chapter_id", label.alias("citation"), T.leading_sentence(F.col("text"), 220).alias("_first"))
    return matches.join(info, "chunk_id")


def answers(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, answer): the first sentence of the best chunk with its citation."""
    return citations(matches.where("rank = 1"), chunks).select("question_id", F.trim(F.concat_ws(" ", "_first", "citation")).alias("answer"))
