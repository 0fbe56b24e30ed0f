"""Connectors to models outside: injected callables, run in batches on the executors, with a fallback where they fail."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[str], str]


def embed(df: DataFrame, key: str, text: str, provider: Embedder, batch: int = 96) -> DataFrame:
    """(key, embedding) of the texts; a batch that fails or comes back short gives null vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                try:
                    vectors = provider(some["t"].tolist())
                except Exception:  # noqa: BLE001  # whatever a provider raises, its rows stay
                    vectors = []
                if len(vectors) != len(some):
                    vectors = [None] * len(some)
                yield pd.DataFrame({"k": some["k"], "embedding": vectors})

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "k string, embedding array<double>").withColumnRenamed("k", key)


def ask(df: DataFrame, key: str, prompt: str, provider: Chat) -> DataFrame:
    """(key, reply, error) of each prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for k, p in zip(frame["k"], frame["p"]):
                try:
                    rows.append((k, provider(p), None))
                except Exception as wrong:  # noqa: BLE001
                    rows.append((k, None, str(wrong)))
            yield pd.DataFrame(rows, columns=["k", "reply", "error"])

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(prompt).alias("p"))
    return rows.mapInPandas(run, "k string, reply string, error string").withColumnRenamed("k", key)


def json_object(column: str):
    """The outermost JSON object in a reply, whatever stands around it; null where there is none."""
    return F.nullif(F.regexp_extract(column, r"(?s)\{.*\}", 0), F.lit(""))


def parse_points(replies: DataFrame) -> DataFrame:
    """Replies {"nodes": [{id, name, definition, category}]} into rows; unusable names and repeats of a chapter go."""
    schema = "struct<nodes:array<struct<id:string,name:string,definition:string,category:string>>>"
    rows = replies.select("*", F.posexplode(F.from_json(json_object("reply"), schema)["nodes"]).alias("_i", "_n"))
    name = F.trim(F.col("_n.name"))
    good = F.length(name).between(2, 40) & ~name.rlike(r"^[\d\s.%]+$")
    kept = rows.where(good).withColumn("_k", F.lower(F.regexp_replace(name, r"\s+", "")))
    first = kept.groupBy("textbook_id", "chapter_id", "_k").agg(F.min_by(F.struct("_i", "_n"), "_i").alias("_f"))
    return first.select("textbook_id", "chapter_id", F.col("_f._i").alias("node_ord"), F.col("_f._n.id").alias("llm_id"), F.trim("_f._n.name").alias("name"), F.col("_f._n.definition").alias("definition"), F.col("_f._n.category").alias("category"))


def echo(text: str) -> str:
    """A provider for tests."""
    return json.dumps({"nodes": [{"id": "1", "name": text[:10], "definition": text, "category": ""}]}, ensure_ascii=False)
