"""Files into textbooks and chapters: Markdown, plain text, Word documents and extracted page lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.segments import as_chapters, chapter_title, chapters_from_pages, split_chapters

FORMATS = ("pdf", "md", "markdown", "txt", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 with or without a mark, then GB18030, then Latin-1."""

    def one(value: bytes | None) -> str | None:
        if value is None:
            return None
        for encoding in ("utf-8-sig", "gb18030"):
            try:
                return bytes(value).decode(encoding)
            except UnicodeDecodeError:
                continue
        return bytes(value).decode("latin-1")

    return raw.map(one)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder in order of their path, with an id for each supported one and an error for the others."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("filename", name).withColumn("format", F.lower(F.regexp_extract("filename", r"\.([^.]+)\z", 1)))
    good = F.col("format").isin(*FORMATS)
    number = F.row_number().over(Window.orderBy("path"))  # names only: contents don't take part in the sort's keys
    ids = rows.where(good).select("path", F.format_string("book_%02d", number - 1).alias("textbook_id"))
    rows = rows.join(ids, "path", "left")
    return rows.withColumn("status", F.when(good, "completed").otherwise("failed")).withColumn("error", F.when(~good, F.concat(F.lit("unsupported format: "), F.when(F.col("format") == "", "unknown").otherwise(F.col("format")))))


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for book, raw in zip(batch["textbook_id"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as archive:
                    tree = ElementTree.fromstring(archive.read("word/document.xml"))
                for n, p in enumerate(tree.iter(f"{_W}p")):
                    style = p.find(f"{_W}pPr/{_W}pStyle")
                    text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
                    rows.append((book, n, text, "" if style is None else style.get(f"{_W}val") or "", None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as wrong:
                rows.append((book, 0, None, None, str(wrong)))
        yield pd.DataFrame(rows, columns=["textbook_id", "line_ord", "text", "style", "error"])


def word_paragraphs(files: DataFrame) -> DataFrame:
    """(textbook_id, line_ord, text, style, error) of Word documents; a broken file gives one row with its error."""
    return files.select("textbook_id", "content").mapInPandas(_paragraphs, "textbook_id string, line_ord int, text string, style string, error string")


def chapters_from_word(paragraphs: DataFrame) -> DataFrame:
    """Chapters at heading styles and at chapter headings; empty paragraphs are skipped."""
    rows = paragraphs.where("error is null").withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    title = F.when(F.lower("style").rlike("^(heading|标题|title)"), T.clean_title(F.col("text"))).otherwise(chapter_title(F.col("text")))
    book = Window.partitionBy("textbook_id").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("title", title).withColumn("_seg", F.sum(F.col("title").isNotNull().cast("int")).over(book))
    parts = rows.groupBy("textbook_id", "_seg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "text"))), lambda s: s["text"]), "\n").alias("content"), F.max("title").alias("title")
    )
    return as_chapters(parts.withColumn("chapter_ord", F.row_number().over(Window.partitionBy("textbook_id").orderBy("_seg"))))


@dataclass
class Ingested:
    log: DataFrame
    textbooks: DataFrame
    chapters: DataFrame


def ingest(spark: SparkSession, folder: str, page_lines: DataFrame | None = None) -> Ingested:
    """All supported files of a folder. Pages of PDF files come from an extractor as page_lines; without it they fail as rows."""
    files = scan(spark, folder)
    done = files.where("status = 'completed'")
    text = done.where(F.col("format").isin("md", "markdown", "txt")).withColumn("text", decoded("content"))
    markdown, plain = text.where("format <> 'txt'"), text.where("format = 'txt'")
    paragraphs = word_paragraphs(done.where("format = 'docx'"))
    chapters = split_chapters(markdown, True).unionByName(split_chapters(plain, False)).unionByName(chapters_from_word(paragraphs))
    failed = paragraphs.where("error is not null").select("textbook_id", F.col("error").alias("_e"))
    if page_lines is None:
        failed = failed.unionByName(done.where("format = 'pdf'").select("textbook_id", F.lit("no page lines").alias("_e")))
    else:
        chapters = chapters.unionByName(chapters_from_pages(page_lines.join(done.select("textbook_id"), "textbook_id", "left_semi")))
    log = files.join(failed, "textbook_id", "left").select(
        "filename", "format", "length", "textbook_id", F.when(F.col("_e").isNotNull(), "failed").otherwise(F.col("status")).alias("status"), F.coalesce("error", "_e").alias("error")
    )
    sums = chapters.groupBy("textbook_id").agg(F.sum("char_count").cast("int").alias("total_chars"), F.max("page_end").alias("total_pages"))
    ok = log.where("status = 'completed'").select("textbook_id", "filename")
    books = ok.join(sums, "textbook_id", "left").select(
        F.regexp_extract("textbook_id", r"(\d+)\z", 1).cast("int").alias("textbook_ord"), "textbook_id", "filename", T.stem(F.col("filename")).alias("title"), "total_pages", F.coalesce("total_chars", F.lit(0)).alias("total_chars")
    )
    return Ingested(log, books, chapters.join(ok.select("textbook_id"), "textbook_id", "left_semi"))
