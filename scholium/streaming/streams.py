"""Streams: files as they arrive, chat histories of bounded length, and event windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.segments import split_chapters
from ..sources.files import decoded


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """(textbook_id, filename, text) of Markdown files as they arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.substring(F.sha1(name), 1, 12).alias("textbook_id"), name.alias("filename"), decoded("content").alias("text"))


def ingest_stream(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Chapters of arriving files into a parquet table, each micro-batch by the batch operator."""

    def write(batch: DataFrame, _: int) -> None:
        split_chapters(batch, True).write.mode("append").parquet(target)

    return arriving_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def histories(messages: DataFrame, keep: int = 80) -> DataFrame:
    """(session_id, messages): the last ``keep`` messages of each session after each trigger, in bounded state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            held += [f"{t.isoformat()}\t{c}" for t, c in zip(frame["created_at"], frame["content"])]
            held = sorted(held)[-keep:]
        state.update((held,))
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(held)], "newest": [held[-1].split("\t", 1)[1] if held else None]})

    return messages.groupBy("session_id").applyInPandasWithState(update, "session_id string, n int, newest string", "messages array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; what comes later than the watermark is dropped by Spark."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
