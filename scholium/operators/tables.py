"""The current version of each table: rows delivered again count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

KEYS = {
    "textbooks": ["textbook_id"],
    "chapters": ["textbook_id", "chapter_id"],
    "chunks": ["chunk_id"],
    "chunk_vectors": ["chunk_id"],
    "nodes": ["textbook_id", "node_id"],
    "edges": ["textbook_id", "edge_id"],
    "decisions": ["decision_id"],
}


def latest(df: DataFrame, keys: list[str], by: str = "ingested_at") -> DataFrame:
    """One row a key, that of the last delivery: a combinable aggregate rather than a window over sorted groups."""
    if by not in df.columns:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace current rows of the same key."""
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def numbered(rows: DataFrame, order: list[str], name: str, running: dict[str, Column] | None = None) -> DataFrame:
    """rows with their place (from 1) in a global order, and running sums of columns along it, without one task for all.

    Rows are spread by ranges of the order; each range is numbered by itself and moved by what the ranges before it hold, one
    row a range on the driver. ``running`` maps names of sums to what is summed.
    """
    running = running or {}
    ranged = rows.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(running.values())]).repartitionByRange(*order)
    ranged = cut(ranged.withColumn("_p", F.spark_partition_id()))
    held = ranged.groupBy("_p").agg(F.count("*").alias("n"), *[F.sum(f"_s{i}").alias(f"s{i}") for i in range(len(running))]).orderBy("_p").collect()
    before = [0] * (1 + len(running))
    offsets = []
    for row in held:
        offsets.append((row["_p"], *before))
        before = [b + (row[c] or 0) for b, c in zip(before, ["n", *[f"s{i}" for i in range(len(running))]])]
    fields = ", ".join(["_p int", "_o long", *[f"_o{i} long" for i in range(len(running))]])
    moved = ranged.join(rows.sparkSession.createDataFrame(offsets, fields), "_p")
    within = Window.partitionBy("_p").orderBy(*order)
    out = moved.withColumn(name, (F.row_number().over(within) + F.col("_o")).cast("long"))
    for i, total in enumerate(running):
        out = out.withColumn(total, F.sum(f"_s{i}").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_o{i}"))
    return out.select(*rows.columns, name, *running)
