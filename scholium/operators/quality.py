"""How well a textbook was parsed: counts, a score with its deductions, and the warnings behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def duplicate_titles(chapters: DataFrame) -> DataFrame:
    """(textbook_id, duplicate_title_count): titles that occur more than once, ignoring case and spacing."""
    key = F.lower(T.squeeze(F.col("title")))
    counted = chapters.where(key != "").groupBy("textbook_id", key.alias("k")).agg(F.count("*").alias("n"))
    return counted.where("n > 1").groupBy("textbook_id").agg(F.count("*").alias("duplicate_title_count"))


def quality(textbooks: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row a textbook; textbooks without chapters count too."""
    counts = chapters.groupBy("textbook_id").agg(
        F.count("*").alias("chapter_count"),
        F.count_if(F.col("char_count") == 0).alias("empty_chapter_count"),
        F.count_if((F.col("char_count") > 0) & (F.col("char_count") < 80)).alias("short_chapter_count"),
        F.count_if(F.col("page_start") > F.col("page_end")).alias("page_span_inversions"),
    )
    names = ["chapter_count", "empty_chapter_count", "short_chapter_count", "page_span_inversions", "duplicate_title_count"]
    rows = (
        textbooks.select("textbook_id", "filename", "total_pages", "total_chars")
        .join(counts, "textbook_id", "left")
        .join(duplicate_titles(chapters), "textbook_id", "left")
        .fillna(0, names)
    )
    short = (F.col("chapter_count") > 0) & (F.try_divide("short_chapter_count", "chapter_count") > 0.4)
    rules = [
        (F.col("chapter_count") == 0, F.lit(0.45), F.lit("no chapters")),
        (F.col("total_chars") == 0, F.lit(0.45), F.lit("no text")),
        (F.col("empty_chapter_count") > 0, F.least(F.lit(0.2), F.col("empty_chapter_count") * 0.04), F.format_string("%d empty chapters", "empty_chapter_count")),
        (short, F.lit(0.12), F.lit("many short chapters")),
        (F.col("duplicate_title_count") > 0, F.least(F.lit(0.12), F.col("duplicate_title_count") * 0.03), F.format_string("%d duplicate titles", "duplicate_title_count")),
        (F.col("page_span_inversions") > 0, F.lit(0.18), F.lit("page spans inverted")),
        (F.coalesce(F.col("total_pages") <= 0, F.lit(False)), F.lit(0.08), F.lit("page total implausible")),
    ]
    score = F.lit(1.0)
    for rule, cost, _ in rules:
        score = score - F.when(rule, cost).otherwise(0.0)
    warnings = F.array_compact(F.array(*[F.when(rule, said) for rule, _, said in rules]))
    average = F.when(F.col("chapter_count") > 0, F.round(F.try_divide("total_chars", "chapter_count"), 2)).otherwise(0.0)
    out = rows.withColumn("avg_chars_per_chapter", average).withColumn("score", F.greatest(F.lit(0.0), F.round(score, 2))).withColumn("warnings", warnings)
    return out.withColumn("level", F.when(F.col("score") >= 0.85, "good").when(F.col("score") >= 0.6, "warning").otherwise("poor"))


def upload_quality(uploads: DataFrame, textbooks: DataFrame, chapters: DataFrame) -> DataFrame:
    """The quality of each upload (filename, status, error, textbook_id): failed ones score 0 and say why."""
    score = quality(textbooks, chapters).select("textbook_id", F.col("score").alias("_s"), F.col("level").alias("_l"), F.col("warnings").alias("_w"))
    rows = uploads.join(score, "textbook_id", "left")
    failed = (F.col("status") != "completed") | F.col("_s").isNull()
    said = F.array(F.coalesce("error", F.lit("not parsed, nothing to keep")))
    return rows.select(*uploads.columns, F.when(failed, 0.0).otherwise(F.col("_s")).alias("score"), F.when(failed, "failed").otherwise(F.col("_l")).alias("level"), F.when(failed, said).otherwise(F.col("_w")).alias("warnings"))
