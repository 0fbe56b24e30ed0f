"""Problem 6: the k most similar vectors of every vector, by an inverted file with product-quantised residuals.

Vectors are scaled to length 1. A quantiser of two levels splits them into lists: the nearest of up to COARSE centroids, then
the nearest of the FINE centroids that the residuals of all lists share, as many as keep a list at about ROWS_A_LIST vectors
however many there are. What is left of a vector is stored as one code a subspace. A query visits its nearest lists and ranks their
entries by asymmetric distance tables (the query against coded entries); what passes is reranked by its cosine, first on
vectors of one byte a number, at the end exactly. Only the quantisers are fitted, on a bounded sample (TRAIN_ROWS); every
vector is indexed. How many lists a query visits, and how far the tables may err, is measured for the fitted quantisers,
on rows they weren't fitted on if the table has more, so that what is left out costs no more than a stated share.

Scale: copies of one vector are collapsed before indexing. Through the shuffle go no vectors but their bytes of one a number (64
for a visit, 72 for an entry) and 8-byte row hashes; a hash that two rows share costs a comparison, as the end is exact. A list
that is longer than BLOCK is cut into blocks of at most BLOCK entries and BLOCK queries, so that no task holds more
however hot it is. The index is a table in the shared checkpoint folder, without the exact vectors, which stay in the table of usable(). Broadcast are the quantisers alone: at most COARSE +
TRAIN_ROWS / 4 + SUBSPACES * CODES vectors. Beyond COARSE * TRAIN_ROWS / 4 * ROWS_A_LIST rows lists grow with the table.

Defined results: null, zero and cut-off vectors and vectors with a blank group never match; repeated rows count once;
ties rank by id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

DIM = 64
TRAIN_ROWS = 16_384
#: Rows kept out of the fitting of a larger table, on which the number of lists to visit is measured.
TEST_ROWS = 8_192
COARSE = 1_024
ROWS_A_LIST = 64
SUBSPACES = 8
CODES = 256
BLOCK = 4_096
#: Share of the pairs at exactly the least similarity, and of the k nearest, that the lists not visited may cost.
PAIR_LOSS, NEAREST_LOSS = 0.001, 0.01
#: Similarities of neighbours that are equal so far tie and rank by id.
DIGITS = 6
#: More than six standard errors of a cosine of vectors of one byte a number: what is less than this below the k-th best is compared exactly.
BYTE_ERROR = 0.02
#: Lists share a call of the scoring function until they hold about so many rows.
ROWS_A_CALL = 8_192
FLOAT = np.float32


def usable(vectors: DataFrame, models: DataFrame, key: str = "chunk_id", group: str = "embedding_model") -> DataFrame:
    """(grp, id, unit): distinct vectors of DIM numbers that aren't all zero, as bytes, of a non-blank group."""
    unit = F.expr("sqrt(aggregate(embedding, 0D, (s, x) -> s + double(x) * double(x)))")
    clean = vectors.where((F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    normed = clean.select(F.col(key).alias("id"), "embedding", unit.alias("_n")).where(F.col("_n") > 0)
    named = models.select(F.col(key).alias("id"), F.trim(F.col(group)).alias("grp")).where(F.col("grp") != "").distinct()
    joined = normed.join(named, "id").dropDuplicates(["id", "grp"])
    return joined.mapInPandas(_pack, "grp string, id string, unit binary")


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            x = np.stack(batch["embedding"].to_numpy()).astype(FLOAT)
            x /= np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(FLOAT)
            yield pd.DataFrame({"grp": batch["grp"], "id": batch["id"], "unit": [r.tobytes() for r in x]})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=FLOAT).reshape(-1, DIM)


def collapse(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (the smallest id of equal vectors) and the (grp, rep, id) membership of the copies.

    Copies find each other by the SHA-256 of their bytes: the vectors themselves are shuffled once, for the representatives.
    """
    reps = vectors.groupBy("grp", "unit").agg(F.min("id").alias("id"))
    keyed = vectors.select("grp", F.unhex(F.sha2("unit", 256)).alias("_u"), "id")
    copied = keyed.groupBy("grp", "_u").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    members = keyed.join(copied, ["grp", "_u"]).select("grp", "rep", "id")
    return reps.select("grp", "id", "unit"), members


def _kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - (0 if spherical else (centres**2).sum(1) / 2)).argmax(1)
        order = np.argsort(near, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        sums = np.add.reduceat(x[order], heads, axis=0)
        used = near[order][heads]
        centres[used] = sums / np.diff(np.r_[heads, len(x)])[:, None]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(FLOAT)


def _visits(ranks: np.ndarray, loss: float, lists: int) -> int:
    """The least number of lists with which no more than that share of the ranks (from 0) is left out."""
    if not len(ranks):
        return lists
    return int(min(lists, np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(len(ranks) * (1 - loss))) - 1)] + 1))


class Quantisers:
    """The fitted centroids, the codebooks (SUBSPACES, CODES, DIM / SUBSPACES), and what was measured for them."""

    def __init__(self, coarse: np.ndarray, fine: np.ndarray, books: np.ndarray):
        self.coarse, self.fine, self.books = coarse, fine, books
        self.lists = len(coarse) * len(fine)
        self.visits, self.reach, self.slack = self.lists, len(coarse), 2.0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        first = (x @ self.coarse.T).argmax(1)
        if len(self.fine) == 1:
            return first
        rest = x - self.coarse[first]
        return first * len(self.fine) + (rest @ self.fine.T - (self.fine**2).sum(1) / 2).argmax(1)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, nearness) of the lists under the ``reach`` nearest coarse centroids of each vector."""
        near = x @ self.coarse.T
        reach = min(self.reach, len(self.coarse))
        top = np.argpartition(-near, reach - 1, axis=1)[:, :reach]
        if len(self.fine) == 1:
            return top, np.take_along_axis(near, top, 1)
        # |x - c - f|^2 with one value less for all lists of x
        cross = self.coarse @ self.fine.T + (self.fine**2).sum(1) / 2 + ((self.coarse**2).sum(1) / 2)[:, None]
        score = np.take_along_axis(near, top, 1)[:, :, None] + (x @ self.fine.T)[:, None, :] - cross[top]
        lists = top[:, :, None] * len(self.fine) + np.arange(len(self.fine))
        return lists.reshape(len(x), -1), score.reshape(len(x), -1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The lists that each vector visits, the nearest first."""
        out = []
        for start in range(0, len(x), 1_024):
            lists, score = self.scores(x[start : start + 1_024])
            n = min(self.visits, lists.shape[1])
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
            out.append(np.take_along_axis(lists, top, 1))
        return np.concatenate(out).astype(np.int32) if out else np.zeros((0, 1), dtype=np.int32)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = (x - self.centre(lists)).reshape(len(x), SUBSPACES, -1)
        code = np.empty((len(x), SUBSPACES), dtype=np.uint8)
        for m in range(SUBSPACES):
            code[:, m] = (residual[:, m] @ self.books[m].T - (self.books[m] ** 2).sum(1) / 2).argmax(1)
        return code

    def tables(self, x: np.ndarray) -> np.ndarray:
        """(vectors, SUBSPACES, CODES): the products of each vector with every code."""
        return np.einsum("qmd,mcd->qmc", x.reshape(len(x), SUBSPACES, -1), self.books)

    def estimate(self, x: np.ndarray, code: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The cosine of each vector with the coded entry beside it, by its table."""
        table = self.tables(x)
        return (x * self.centre(lists)).sum(1) + table[np.arange(len(x))[:, None], np.arange(SUBSPACES), code].sum(1)

    def rank(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The rank of a list among those of each vector; past all lists if it isn't under the ``reach`` coarse centroids."""
        out = []
        for start in range(0, len(x), 512):
            lists, score = self.scores(x[start : start + 512])
            hit = lists == own[start : start + 512, None]
            mine = np.where(hit, score, -np.inf).max(1)
            out.append(np.where(hit.any(1), (score > mine[:, None]).sum(1), self.lists))
        return np.concatenate(out)


def _rank_coarse(x: np.ndarray, coarse: np.ndarray, own: np.ndarray) -> np.ndarray:
    near = x @ coarse.T
    return (near > near[np.arange(len(x)), own][:, None]).sum(1)


def pair_probes(min_similarity: float, loss: float = PAIR_LOSS):
    """What pairs of that similarity need, either side visiting, measured on random partners of sampled vectors."""

    def measure(q: Quantisers, x: np.ndarray, grp: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        x = np.resize(x, (max(len(x), 4_096), DIM))[: 4_096 if len(q.fine) > 1 else 8_192].astype(np.float64)
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = min_similarity * x + np.sqrt(1 - min_similarity**2) * z
        own_x, own_y = q.assign(x), q.assign(y)
        n = len(q.fine)
        if n > 1:
            both = np.minimum(_rank_coarse(x, q.coarse, own_y // n), _rank_coarse(y, q.coarse, own_x // n))
            q.reach = _visits(both, loss / 4, len(q.coarse))
        q.visits = _visits(np.minimum(q.rank(x, own_y), q.rank(y, own_x)), loss, q.lists)
        missed = min_similarity - np.maximum(q.estimate(x, q.encode(y, own_y), own_y), q.estimate(y, q.encode(x, own_x), own_x))
        q.slack = float(np.quantile(missed, 1 - loss / 4))

    return measure


def nearest_probes(k: int, loss: float = NEAREST_LOSS):
    """What the k nearest need; those within the sample are no nearer than those of the table, so it's enough."""

    def measure(q: Quantisers, x: np.ndarray, grp: np.ndarray) -> None:
        own, n = q.assign(x), len(q.fine)
        pairs = []
        for start in range(0, min(len(x), 1_024), 128):
            asked = np.arange(start, min(len(x), start + 128))
            near = np.where(grp[asked][:, None] == grp[None, :], x[asked] @ x.T, -np.inf)
            near[np.arange(len(asked)), asked] = -np.inf
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            i, j = np.nonzero(np.isfinite(np.take_along_axis(near, top, 1)))
            pairs.append(np.stack([asked[i], top[i, j]]))
        a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=int)
        if len(a):
            if n > 1:
                q.reach = _visits(_rank_coarse(x[a], q.coarse, own[b] // n), loss / 4, len(q.coarse))
            q.visits = _visits(q.rank(x[a], own[b]), loss, q.lists)
            # how far below its cosine the tables may put a neighbour, beside how far above they put others
            off = (x[a] * x[b]).sum(1) - q.estimate(x[a], q.encode(x[b], own[b]), own[b])
            q.slack = float(np.quantile(off, 1 - loss) - np.quantile(off, 0.25))

    return measure


def fit(base: DataFrame, rows: int, measure) -> Quantisers:
    """The quantisers, from about TRAIN_ROWS rows by hash, and what is measured for them.

    The share of hashes is set from the number of rows, so the driver gets no more at any size than at this one.
    ``measure`` may be a number of lists to visit instead.
    """
    share = min(1.0, (TRAIN_ROWS + TEST_ROWS) / rows)
    kept = F.pmod(F.xxhash64("unit", "grp"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1
    sample = base.where(kept).select("grp", "unit").distinct().toPandas()
    if not len(sample):  # a handful of rows whose hashes all lie outside
        sample = base.select("grp", "unit").limit(TRAIN_ROWS).toPandas()
    sample = sample.sort_values(["grp", "unit"]).sample(frac=1.0, random_state=7)
    every, grp = _matrix(sample["unit"]), sample["grp"].to_numpy(dtype=object)
    # of a table that is fitted whole, every row lies as near to its centroid as the fitted ones
    x, test = (every, slice(None)) if rows <= TRAIN_ROWS else (every[:TRAIN_ROWS], slice(min(TRAIN_ROWS, max(0, len(every) - TEST_ROWS)), None))
    coarse = _kmeans(x, int(min(COARSE, max(1, rows // ROWS_A_LIST))), 6, spherical=True)
    residual = x - coarse[(x @ coarse.T).argmax(1)]
    levels = int(min(TRAIN_ROWS // 4, max(1, -(-rows // (COARSE * ROWS_A_LIST)))))
    fine = _kmeans(residual, levels, 4, spherical=False) if levels > 1 else np.zeros((1, DIM), dtype=FLOAT)
    q = Quantisers(coarse, fine, np.zeros((SUBSPACES, CODES, DIM // SUBSPACES), dtype=FLOAT))
    residual = x - q.centre(q.assign(x))
    for m, part in enumerate(np.split(residual, SUBSPACES, axis=1)):
        book = _kmeans(np.ascontiguousarray(part), CODES, 4, spherical=False)
        q.books[m, : len(book)] = book
        q.books[m, len(book) :] = book[0]
    if callable(measure):
        measure(q, every[test], grp[test])
    else:
        q.visits = min(measure, q.lists)
    return q


INDEX = "grp string, h long, id string, small binary, code binary, list int, lists array<int>"


def _small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of one byte, their scale) of each vector; no number is off by more than half the scale."""
    scale = np.maximum(np.abs(x).max(1), 1e-12).astype(FLOAT) / FLOAT(127)
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def build_index(vectors: DataFrame, measure) -> tuple[DataFrame, DataFrame, object]:
    """(index table, membership of copies, broadcast quantisers); ``vectors`` is a staged table of usable()."""
    spark = vectors.sparkSession
    reps, members = collapse(vectors)
    rows = vectors.count()
    quantisers = spark.sparkContext.broadcast(fit(vectors, rows, measure) if rows else None)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q, x = quantisers.value, _matrix(batch["unit"])
                own, (small, scale) = q.assign(x), _small(x)
                packed = [v.tobytes() + s.tobytes() for v, s in zip(small, scale)]
                yield batch.drop(columns="unit").assign(small=packed, code=[c.tobytes() for c in q.encode(x, own)], list=own.astype(np.int32), lists=list(q.nearest(x)))

    hashed = reps.select("grp", F.xxhash64("grp", "id").alias("h"), "id", "unit")
    return stage(hashed.mapInPandas(encode, INDEX), "index"), members, quantisers


def candidates(index: DataFrame, queries: DataFrame, quantisers: object, k: int | None, min_similarity: float = -1.0, shortlist: int = 64) -> DataFrame:
    """(q, e, near): hashes of query and entry, and about their similarity, for what the lists of each query hold.

    With k, what the tables put among the shortlist of a list or within ``slack`` of its k best, and of these all that may be
    among the k best; without, everything
    that may reach min_similarity.
    """
    spark: SparkSession = index.sparkSession
    new = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  # both sides come from the index
    cell = F.xxhash64("grp", "list").alias("cell")  # a list of one group
    entries = index.select(cell, *new("list", "h", "small", "code"))
    visits = queries.select("grp", F.explode("lists").alias("list"), *new("h", "small")).select(cell, "h", "small")
    # lists longer than a block are cut; all others go whole to a call by their hash
    size = entries.groupBy("cell").agg(F.count("*").alias("n")).join(visits.groupBy("cell").agg(F.count("*").alias("q")), "cell")
    size = stage(size, "sizes")
    total = size.agg(F.sum(F.col("n") + F.col("q"))).first()[0] or 0
    calls = max(1, int(total // ROWS_A_CALL))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    hot = size.where((F.col("n") > BLOCK) | (F.col("q") > BLOCK)).select("cell", blocks("n").alias("nb"), blocks("q").alias("qb"))
    own = F.pmod(F.xxhash64("cell"), F.lit(calls))

    def spread(side: DataFrame, mine: str, other: str) -> DataFrame:
        cut = side.join(hot, "cell", "left")
        block = F.pmod(F.col("h"), F.coalesce(mine, F.lit(1))).cast("int")
        copy = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        cut = cut.withColumn("_m", block).withColumn("_o", copy)
        n, q = ("_m", "_o") if mine == "nb" else ("_o", "_m")
        return cut.withColumn("call", F.when(F.col("nb").isNull(), own).otherwise(-1 - F.pmod(F.xxhash64("cell", n, q), F.lit(1 << 62)))).drop("nb", "qb", "_m", "_o")

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            by_cell = {key: frame for key, frame in held.groupby("cell", sort=False)}
            for key, some in asked.groupby("cell", sort=False):
                if key in by_cell:
                    out += _score_list(int(by_cell[key]["list"].iloc[0]), some, by_cell[key], quantisers.value, k, min_similarity, shortlist)
        if not out:
            return pd.DataFrame({"q": np.zeros(0, np.int64), "e": np.zeros(0, np.int64), "near": np.zeros(0, FLOAT)})
        q, e, near = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"q": q, "e": e, "near": near})

    left = spread(visits, "qb", "nb").repartition(calls_parts(spark, calls), "call")
    right = spread(entries, "nb", "qb").repartition(calls_parts(spark, calls), "call")
    return left.groupBy("call").cogroup(right.groupBy("call")).applyInPandas(score, "q long, e long, near float")


def calls_parts(spark: SparkSession, calls: int) -> int:
    """Partitions for that many calls: a few calls a task, at least one task a core."""
    return max(1, min(calls, max(-(-calls // 16), spark.sparkContext.defaultParallelism)))


def _unpack(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), DIM + 4)
    scale = np.ascontiguousarray(raw[:, DIM:]).view(FLOAT)[:, 0]
    return raw[:, :DIM].view(np.int8).astype(FLOAT) * scale[:, None], scale


def _score_list(key: int, some: pd.DataFrame, entries: pd.DataFrame, q: Quantisers, k: int | None, min_similarity: float, shortlist: int) -> list:
    codes = np.frombuffer(b"".join(entries["code"]), dtype=np.uint8).reshape(-1, SUBSPACES)
    (x, scale), (y, scales) = _unpack(some["small"]), _unpack(entries["small"])
    names, ids = some["h"].to_numpy(), entries["h"].to_numpy()
    off = x @ q.centre(np.array([key]))[0]
    rows = []
    step = int(max(8, min(512, (1 << 18) // len(y))))  # pairs compared at once
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        table = q.tables(x[part])
        near = np.repeat(off[part][:, None], len(y), axis=1)
        for m in range(SUBSPACES):  # the tables: the cosine with the coded entry
            near += table[:, m][:, codes[:, m]]
        if k is None:
            i, j = np.nonzero(near >= min_similarity - q.slack)
        else:
            n = min(len(y), shortlist)
            low = -np.partition(-near, n - 1, axis=1)[:, n - 1]
            at_k = -np.partition(-near, min(len(y), k + 1) - 1, axis=1)[:, min(len(y), k + 1) - 1]
            i, j = np.nonzero(near >= np.minimum(low, at_k - q.slack)[:, None])
        other = names[start + i] != ids[j]
        i, j = i[other], j[other]
        close = (x[start + i] * y[j]).sum(1)
        if k is None:  # half a scale a number is the most that either vector is off
            keep = close >= min_similarity - (scale[start + i] + scales[j]) * (np.sqrt(DIM) / 2 * 1.05)
        else:
            order = np.lexsort((-close, i))
            place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
            least = np.full(len(near), -np.inf)
            at_k = order[place == k - 1]
            least[i[at_k]] = close[at_k]
            keep = close >= least[i] - BYTE_ERROR
        rows.append((names[start + i[keep]], ids[j[keep]], close[keep].astype(FLOAT)))
    return rows


def _exact(base: DataFrame, found: DataFrame) -> DataFrame:
    """(grp, query, id, similarity): pairs of hashes with their exact cosine, within one group."""
    side = lambda h, name, unit: base.select(F.xxhash64("grp", "id").alias(h), F.col("grp").alias(f"_{h}"), F.col("id").alias(name), F.col("unit").alias(unit))
    both = found.join(side("q", "query", "u"), "q").join(side("e", "id", "v"), "e").where((F.col("_q") == F.col("_e")) & (F.col("query") != F.col("id")))

    def cosine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                exact = (_matrix(batch["u"]).astype(np.float64) * _matrix(batch["v"]).astype(np.float64)).sum(1)
                yield batch[["grp", "query", "id"]].assign(similarity=exact)

    return both.select(F.col("_q").alias("grp"), "query", "id", "u", "v").mapInPandas(cosine, "grp string, query string, id string, similarity double")


def search(base: DataFrame, index: DataFrame, queries: DataFrame, quantisers: object, k: int) -> DataFrame:
    """(grp, query, id, similarity): the k best other entries of each query row of the index, within its lists."""
    found = candidates(index, queries, quantisers, k)
    nearest = Window.partitionBy("q").orderBy(F.desc("near"), "e")
    ranked = found.withColumn("_r", F.row_number().over(nearest))
    least = F.max(F.when(F.col("_r") == k, F.col("near"))).over(Window.partitionBy("q"))
    some = ranked.withColumn("_k", least).where((F.col("_r") <= k) | (F.col("near") >= F.col("_k") - BYTE_ERROR)).select("q", "e")
    best = Window.partitionBy("grp", "query").orderBy(F.desc(F.round("similarity", DIGITS)), "id")
    return _exact(base, some).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def similar_classes(vectors: DataFrame, min_similarity: float, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((grp, a, b) pairs of different vectors with at least that cosine, (grp, rep, id) membership of their copies).

    a and b stand for all copies of their vector, a < b; however many partners a vector has, all are found.
    """
    base = stage(vectors, "vectors")
    index, members, quantisers = build_index(base, probes or pair_probes(min_similarity))
    found = candidates(index, index, quantisers, None, min_similarity)
    once = found.select(F.least("q", "e").alias("q"), F.greatest("q", "e").alias("e")).distinct()
    exact = _exact(base, once).where(F.col("similarity") >= min_similarity)
    return exact.select("grp", F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).distinct(), members


def similar_pairs(vectors: DataFrame, min_similarity: float, probes: int | None = None) -> DataFrame:
    """(a, b): each pair of rows of one group with at least that cosine, a < b.

    This gives every pair of copies as well, for results that are defined so; where vectors have many copies,
    similar_classes says the same without.
    """
    found, members = similar_classes(vectors, min_similarity, probes)
    members = stage(members, "members")
    alike = members.alias("l").join(members.alias("r"), ["grp", "rep"]).where(F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    copies = lambda side: members.select("grp", F.col("rep").alias(side), F.col("id").alias(f"_{side}"))
    wide = found.join(copies("a"), ["grp", "a"], "left").join(copies("b"), ["grp", "b"], "left").select(
        F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")
    )
    return wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(alike).distinct()


def _expanded(base: DataFrame, members: DataFrame, found: DataFrame, is_query, k: int) -> DataFrame:
    """Neighbours of classes of equal vectors as neighbours of rows: each query row gets its copies and every member of a class.

    No more than the k + 1 smallest ids of a class can be among the answers, one of them being the query itself.
    """
    by_id = Window.partitionBy("grp", "rep").orderBy("id")
    few = members.withColumn("_m", F.row_number().over(by_id)).where(F.col("_m") <= k + 1).drop("_m")
    own = few.select("grp", F.col("rep").alias("query"), "id", F.lit(1.0).alias("similarity"))
    copies = few.select("grp", F.col("rep").alias("id"), F.col("id").alias("_id"))
    others = found.join(copies, ["grp", "id"], "left").select("grp", "query", F.coalesce("_id", "id").alias("id"), "similarity")
    best = Window.partitionBy("grp", "query").orderBy(F.desc("similarity"), "id")
    answers = own.union(others).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    asked = base.where(is_query).select("grp", "id").join(members, ["grp", "id"], "left").select("grp", F.coalesce("rep", "id").alias("query"), F.col("id").alias("_query"))
    rows = asked.join(answers, ["grp", "query"]).where(F.col("id") != F.col("_query")).select("grp", F.col("_query").alias("query"), "id", "similarity")
    return rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def neighbours(vectors: DataFrame, is_query, k: int = 10, probes: int | None = None) -> DataFrame:
    """(grp, query, id, similarity) of the k nearest other rows, copies included, for the rows of a query set, against all rows."""
    base = stage(vectors, "asked")
    index, members, quantisers = build_index(base, probes or nearest_probes(k))
    members = stage(members, "members")
    # a class is searched if any of its rows is asked for
    asked = base.where(is_query).select("grp", "id").join(members, ["grp", "id"], "left").select("grp", F.coalesce("rep", "id").alias("id")).distinct()
    found = search(base, index, index.join(asked, ["grp", "id"], "left_semi"), quantisers, k)
    return _expanded(base, members, found.withColumn("similarity", F.round("similarity", DIGITS)), is_query, k)


#: Queries of a pass of brute_force over the table.
ASKED = 4_096


def brute_force(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """The same by comparing every query with every row, for measuring recall: a pass over the table for each ASKED queries."""
    spark = vectors.sparkSession
    base = stage(vectors, "exact")
    asked = base.where(is_query)
    passes = max(1, -(-asked.count() // ASKED))
    out = spark.createDataFrame([], "grp string, query string, id string, similarity double")
    for turn in range(passes):  # no more than about ASKED rows come to the driver at once
        some = asked.where(F.pmod(F.xxhash64("id", "grp"), F.lit(passes)) == turn).toPandas()
        held = spark.sparkContext.broadcast({g: (f["id"].to_numpy(dtype=object), _matrix(f["unit"]).astype(np.float64)) for g, f in some.groupby("grp")})
        out = out.unionByName(base.mapInPandas(_compare(held, k), out.schema))
    best = Window.partitionBy("grp", "query").orderBy(F.desc("similarity"), "id")
    return out.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def _compare(held: object, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}  # the k best so far of each query: no more rows leave a task
        for batch in batches:
            for grp, rows in batch.groupby("grp"):
                if grp not in held.value:
                    continue
                names, q = held.value[grp]
                ids, y = rows["id"].to_numpy(dtype=object), _matrix(rows["unit"]).astype(np.float64)
                for start in range(0, len(y), 1_024):
                    some, exact = ids[start : start + 1_024], np.round(q @ y[start : start + 1_024].T, DIGITS)
                    exact[names[:, None] == some[None, :]] = -np.inf
                    old_ids, old = best.get(grp, (np.full((len(names), 0), "", dtype=object), np.zeros((len(names), 0))))
                    all_ids = np.concatenate([old_ids, np.broadcast_to(some, exact.shape)], axis=1)
                    exact = np.concatenate([old, exact], axis=1)
                    # everything as near as the k-th, then ties by id
                    least = -np.partition(-exact, min(k, exact.shape[1]) - 1, axis=1)[:, min(k, exact.shape[1]) - 1]
                    kept_ids, kept = np.full((len(names), k), "", dtype=object), np.full((len(names), k), -np.inf)
                    i, j = np.nonzero(exact >= least[:, None])
                    order = np.lexsort((all_ids[i, j].astype(str), -exact[i, j], i))
                    i, j = i[order], j[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, place = i[place < k], j[place < k], place[place < k]
                    kept_ids[i, place], kept[i, place] = all_ids[i, j], exact[i, j]
                    best[grp] = kept_ids, kept
        for grp, (ids, exact) in best.items():
            i, j = np.nonzero(exact > -np.inf)
            yield pd.DataFrame({"grp": grp, "query": held.value[grp][0][i], "id": ids[i, j], "similarity": exact[i, j]})

    return score
