"""Problem 8: texts of varying length go into containers of fixed capacity with little room unused.

Vector bin packing by the dot-product heuristic: an item is a vector of tokens, segments (1) and loss-bearing tokens, a
container has a limit for each, and the open container takes the fitting item whose vector has the largest dot product with what
room is left. An item is only cut when it alone exceeds a limit, and then so that no piece does; no container exceeds any.

Scale: items are packed in blocks of about BLOCK by hash, each in one task; what the blocks leave in containers below
WELL_FILLED is packed once more together, in blocks again, so the unused room doesn't grow with the number of blocks.
Nothing is collected; tokens are counted where the text is read and only the counts are shuffled.

Which tokens bear loss is the caller's: ``loss_from`` is a column with the number of characters of a text before its first
loss-bearing one (the prompt), 0 where the whole text bears loss. The default limit on them is the capacity, so that
no text that fits is cut for its loss.

Defined results: null and blank texts need no room and get container null; copies are packed like any other text; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCK = 4_096
WELL_FILLED = 0.97
MAX_SEGMENTS = 32
#: Blocks a task, whatever their bytes: the rows are short, packing them isn't.
BLOCKS_A_TASK = 2


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SEGMENTS = "doc_id bigint, part int, token_start int, token_end int, tokens int, loss_tokens int"


def segments(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, loss_from: Column | None = None, max_loss: int | None = None) -> DataFrame:
    """Each text as one segment, or as pieces within capacity tokens and max_loss loss-bearing ones where it exceeds them."""
    most = min(capacity, max_loss or capacity)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            rows = []
            for doc, text, begin in batch.itertuples(index=False):
                n = len(encode(text))
                prompt = min(n, len(encode(text[:begin]))) if begin else 0
                part = start = 0
                while start < n:
                    end = min(n, start + capacity, max(start, prompt) + most)
                    rows.append((doc, part, start, end, end - start, max(0, end - max(start, prompt))))
                    part, start = part + 1, end
            yield pd.DataFrame(rows, columns=["doc_id", "part", "token_start", "token_end", "tokens", "loss_tokens"])

    begin = F.coalesce(F.lit(0) if loss_from is None else loss_from, F.lit(0)).cast("int").alias("begin")
    return documents.select("doc_id", "text", begin).where(F.length(F.trim("text")) > 0).mapInPandas(count, SEGMENTS)


def fill(size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The container of each item by the dot-product heuristic; size is (items, dimensions)."""
    share = size / limit
    if (share > 1.0).any():
        raise ValueError("an item exceeds a limit by itself")
    order = np.lexsort((np.arange(len(size)), -share.sum(1)))
    share = share[order]
    container = np.full(len(size), -1)
    left = np.arange(len(size))
    current, weight = 0, np.array([2.0, 0.5, 1.0])[: size.shape[1]]
    while len(left):
        room = np.ones(size.shape[1])
        open_ = True
        while open_ and len(left):
            some = share[left]
            fits = (some <= room + 1e-12).all(1)
            if not fits.any():
                open_ = False
                continue
            score = np.where(fits, some @ (weight * np.maximum(room, 1e-9)), -1.0)
            best = int(score.argmax())
            container[left[best]] = current
            room = room - share[left[best]]
            left = np.delete(left, best)
        current += 1
    out = np.empty(len(size), dtype=np.int64)
    out[order] = container
    return out


def pack(items: DataFrame, capacity: int, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Every segment with its container; containers keep to capacity, max_segments and max_loss at once."""
    limit = np.array([capacity, max_segments, max_loss or capacity], dtype=float)
    kept = stage(items, "segments")

    def blocks(rows: DataFrame, label: str) -> DataFrame:
        n = max(1, -(-rows.count() // BLOCK))
        salted = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(n)).cast("int"))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["doc_id", "part"], ignore_index=True)
            size = np.stack([frame["tokens"], np.ones(len(frame)), frame["loss_tokens"]], axis=1)
            bins = fill(size, limit)
            used = np.bincount(bins, weights=frame["tokens"])
            return frame.assign(container=[f"{label}{b}-{k}" for b, k in zip(frame["_block"], bins)], filled=used[bins] / capacity).drop(columns="_block")

        # a set number of partitions isn't merged by bytes
        tasks = max(-(-n // BLOCKS_A_TASK), min(n, rows.sparkSession.sparkContext.defaultParallelism))
        return salted.repartition(tasks, "_block").groupBy("_block").applyInPandas(run, f"{SEGMENTS}, container string, filled double")

    first = stage(blocks(kept, "a"), "containers")
    done = first.where(F.col("filled") >= WELL_FILLED)
    again = blocks(first.where(F.col("filled") < WELL_FILLED).drop("container", "filled"), "b")
    return done.unionByName(again)


def capacity_of(limits: DataFrame) -> int:
    row = limits.where((F.col("item_kind") == "container") & (F.col("unit") == "tokens")).select("max_size").first()
    if row is None:
        raise ValueError("size_limits has no limit in tokens for containers")
    return row["max_size"]


def packed_documents(
    documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, loss_from: Column | None = None, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None
) -> DataFrame:
    capacity = capacity_of(limits)
    packed = pack(segments(documents, capacity, tokenizer, loss_from, max_loss), capacity, max_segments, max_loss)
    blank = documents.where(F.col("text").isNull() | (F.length(F.trim("text")) == 0)).select("doc_id")
    empty = blank.select("doc_id", *[F.lit(0).alias(c) for c in ("part", "token_start", "token_end", "tokens", "loss_tokens")])
    return packed.unionByName(empty.withColumn("container", F.lit(None).cast("string")).withColumn("filled", F.lit(None).cast("double")))


def _bins(packed: DataFrame) -> DataFrame:
    return packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"))


def report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, and the share of room used."""
    capacity = capacity_of(limits)
    return _bins(packed).agg(
        F.count("*").alias("containers"),
        F.sum("t").alias("tokens"),
        F.ceil(F.sum("t") / capacity).alias("lower_bound"),
        F.round(F.sum("t") / (F.count("*") * capacity), 4).alias("used"),
        F.max("t").alias("fullest"),
        F.max("s").alias("most_segments"),
        F.max("l").alias("most_loss"),
    )


def violations(packed: DataFrame, limits: DataFrame, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """One row: documents packed and blank, containers beyond each limit, and texts that were cut though they fit."""
    capacity = capacity_of(limits)
    count = lambda c: F.coalesce(F.count(F.when(c, 1)), F.lit(0))
    over = _bins(packed).agg(count(F.col("t") > capacity).alias("over_tokens"), count(F.col("s") > max_segments).alias("over_segments"), count(F.col("l") > (max_loss or capacity)).alias("over_loss"))
    texts = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l"), F.max(F.col("container").isNull()).alias("blank"))
    cut = (F.col("pieces") > 1) & (F.col("t") <= capacity) & (F.col("l") <= (max_loss or capacity))
    whole = texts.agg(F.count("*").alias("documents"), count(F.col("blank")).alias("blank"), count(cut).alias("cut_though_fitting"))
    both = whole.unionByName(over, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
