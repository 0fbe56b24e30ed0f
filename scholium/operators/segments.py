"""Segmentation: files and pages into chapters, chapters into overlapping chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

BODY = "正文"
CHAPTER_HEAD = rf"(?i)^{T.WS}*((第{T.WS}*[{T.CHAPTER_NUMERALS}]+{T.WS}*[章节篇编部讲])|(chapter{T.WS}+\d+))"


def chapter_title(line: Column) -> Column:
    """The clean title where a line of at most 80 characters is a chapter heading, else null."""
    flat = T.squeeze(line)
    return F.when((flat != "") & (F.length(flat) <= 80) & flat.rlike(CHAPTER_HEAD), T.clean_title(flat))


def split_chapters(files: DataFrame, markdown: bool) -> DataFrame:
    """(textbook_id, text) into chapters at headings; what precedes the first heading is the chapter BODY.

    A running count of headings numbers the segments; the lines of a segment are put together in order by one aggregate.
    """
    text = F.regexp_replace("text", f"(?:{T.LINE_END})\\z", "")
    lines = files.select("textbook_id", F.posexplode(F.split(text, T.LINE_END)).alias("line_ord", "line"))
    head = F.regexp_extract("line", r"^#{1,3}[ \t]+(.+?)[ \t]*\z", 1)
    title = F.when(head != "", T.clean_title(head)) if markdown else chapter_title(F.col("line"))
    running = Window.partitionBy("textbook_id").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("title", title).withColumn("_seg", F.sum(F.col("title").isNotNull().cast("int")).over(running))
    parts = marked.groupBy("textbook_id", "_seg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda s: s["line"]), "\n").alias("content"),
        F.max("title").alias("title"),
    )
    order = Window.partitionBy("textbook_id").orderBy("_seg")
    return as_chapters(parts.withColumn("chapter_ord", F.row_number().over(order)))


def as_chapters(parts: DataFrame) -> DataFrame:
    """(textbook_id, chapter_ord, title, content, optional pages) as chapter rows."""
    pages = [F.col(c) if c in parts.columns else F.lit(None).cast("int").alias(c) for c in ("page_start", "page_end")]
    content = T.strip(T.blank_to_empty(F.col("content")))
    return parts.select(
        "textbook_id",
        "chapter_ord",
        F.format_string("ch_%02d", "chapter_ord").alias("chapter_id"),
        T.clean_title(F.coalesce("title", F.lit(BODY))).alias("title"),
        *pages,
        content.alias("content"),
        F.length(content).alias("char_count"),
    )


# -- extracted pages ----------------------------------------------------------------------------------------------------


def block_lines(blocks: DataFrame) -> DataFrame:
    """(.., line_ord, text, size, bold): lines of page blocks whose column ``lines`` is array<struct<spans: array<struct<text, size, font>>>>.

    A line is as large as its largest span and bold if any span is; line ends within a span open further lines; blank ones go.
    """
    rows = blocks.select(*[c for c in blocks.columns if c != "lines"], F.posexplode("lines").alias("_l", "_line"))
    spans_ = F.coalesce(F.col("_line.spans"), F.array().cast(rows.schema["_line"].dataType["spans"].dataType))
    raw = F.array_join(F.transform(spans_, lambda x: T.blank_to_empty(x["text"])), "")
    size = F.coalesce(F.array_max(F.transform(spans_, lambda x: x["size"].cast("double"))), F.lit(0.0))
    bold = F.exists(spans_, lambda x: F.lower(T.blank_to_empty(x["font"])).contains("bold"))
    cut = rows.withColumn("size", size).withColumn("bold", bold).select("*", F.posexplode(F.split(raw, T.LINE_END)).alias("_i", "_t"))
    cut = cut.withColumn("text", T.clean_extracted(F.col("_t"))).where("text <> ''")
    return cut.withColumn("line_ord", F.col("_l") * 1_000 + F.col("_i")).drop("_l", "_line", "_i", "_t")


def repeated_margins(lines: DataFrame) -> DataFrame:
    """(textbook_id, text) of the running headers and footers in the first 40 pages: margin lines on a quarter of them."""
    sampled = lines.where("page <= 40")
    pages = sampled.groupBy("textbook_id").agg(F.countDistinct("page").alias("_n"))
    margin = ~((F.col("y0") > F.col("page_height") * 0.12) & (F.col("y1") < F.col("page_height") * 0.88))
    text = T.squeeze(F.col("text"))
    counted = sampled.where(margin & (F.length(text) > 0) & (F.length(text) <= 80)).groupBy("textbook_id", text.alias("text")).agg(F.count("*").alias("n"))
    return counted.join(pages, "textbook_id").where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("_n") / 4))).select("textbook_id", "text")


def broken_ratio_high(text: Column) -> Column:
    """Six or more broken runs, or more than 18 in 100 characters."""
    n = F.regexp_count(text, F.lit(r"[\x{fffd}\x08]+"))
    return (n > 0) & ((n >= 6) | (n / F.greatest(F.length(text), F.lit(1)) > 0.18))


def contents_pages(lines: DataFrame) -> DataFrame:
    """(textbook_id, page) of the pages that look like a table of contents."""
    text = F.col("text")
    tail = text.rlike(rf"\d+{T.WS}*\z")
    section = text.rlike(rf"^{T.WS}*(第[{T.CHAPTER_NUMERALS}]+[章节]|[一二三四五六七八九十]+、)") & tail
    first = Window.partitionBy("textbook_id", "page").orderBy("line_ord")
    marked = lines.withColumn("_r", F.row_number().over(first))
    counts = marked.groupBy("textbook_id", "page").agg(
        F.max((text.contains("目录") & (F.col("_r") <= 8)).cast("int")).alias("named"),
        F.sum(text.rlike(rf"[\x{{fffd}}\x08]{{3,}}.*\d+{T.WS}*\z").cast("int")).alias("entries"),
        F.sum((tail & (F.length("text") <= 80)).cast("int")).alias("tails"),
        F.sum(broken_ratio_high(text).cast("int")).alias("broken"),
        F.sum(section.cast("int")).alias("sections"),
    )
    return counts.where(
        "named = 1 or entries >= 4 or broken >= 6 and tails >= 6 or sections >= 8 and tails >= 8"
    ).select("textbook_id", "page")


def page_line_title(text: Column, size: Column, bold: Column) -> Column:
    """The title where a line of a page is a chapter heading by wording or by its type size."""
    short = (F.length(text) <= 50) & ~text.rlike(r"[。.；;，,]\z") & ~text.rlike(r"^\d+\z")
    by_type = short & ((size >= 20) | ((size >= 15) & bold))
    return F.when(~broken_ratio_high(text), F.coalesce(chapter_title(text), F.when(by_type, T.clean_title(text))))


def chapters_from_pages(lines: DataFrame) -> DataFrame:
    """Page lines (textbook_id, page, line_ord, text, size, bold, y0, y1, page_height) into chapters.

    Margins, margin page numbers and contents pages are left out. A heading opens a chapter unless it repeats the
    running one; a number alone takes the next large line as its title, and a short Han line continues a heading.
    """
    margins = repeated_margins(lines).withColumnRenamed("text", "_m")
    flat = T.squeeze(F.col("text"))
    edge = (F.col("y0") < F.col("page_height") * 0.08) | (F.col("y1") > F.col("page_height") * 0.93)
    body = (
        lines.where(~(edge & flat.rlike(rf"(?i)^((第{T.WS}*)?\d+{T.WS}*(页)?|page{T.WS}+\d+)\z")))
        .join(margins, (lines.textbook_id == margins.textbook_id) & (flat == F.col("_m")), "left_anti")
        .withColumn("text", T.clean_extracted(F.col("text")))
        .where("text <> ''")
    )
    body = body.join(contents_pages(body), ["textbook_id", "page"], "left_anti")
    page = Window.partitionBy("textbook_id", "page").orderBy("line_ord")
    ahead = F.lead(F.struct("text", "size", "bold")).over(page)
    numeral = f"[{T.CHAPTER_NUMERALS}]+"
    marked = body.withColumn("_own", page_line_title(F.col("text"), F.col("size"), F.col("bold"))).withColumn("_next", ahead)
    after = F.trim(F.col("_next.text"))
    continues = (
        F.col("_own").isNotNull()
        & (F.length(after).between(1, 4))
        & ~after.rlike(r"[。；;，,：:!?？]\z")
        & ~after.rlike(r"^\d+\z")
        & after.rlike("[一-鿿]")
        & (
            F.col("_own").rlike(rf"^(第{numeral}章|绪)\z")
            | F.col("_own").rlike(rf"^第{numeral}章{T.WS}*[一-鿿]{{1,3}}\z")
            | (F.col("_own").rlike(rf"^第{numeral}节.*[一-鿿]\z") & (F.length("_own") <= 10))
        )
    )
    large = (F.col("size") >= 15) | (F.col("_next.size") >= 15) | F.col("bold") | F.col("_next.bold")
    numbered = F.col("text").rlike(r"^\d+\z") & (F.length(after) <= 40) & ~after.rlike(r"^\d+\z") & ~after.rlike(r"[。.；;，,]\z") & large
    marked = marked.withColumn("_two", F.coalesce(continues | (F.col("_own").isNull() & numbered), F.lit(False)))
    title = (
        F.when(F.col("_two") & F.col("_own").isNotNull(), T.clean_title(F.concat("_own", "_next.text")))
        .when(F.col("_two"), T.clean_title(F.concat_ws(" ", "text", "_next.text")))
        .otherwise(F.col("_own"))
    )
    # a line taken into the title above it opens nothing itself; runs of taken lines alternate
    taken = F.lag("_two", 1, False).over(page) & ~F.coalesce(F.lag("_two", 2, False).over(page), F.lit(False))
    marked = marked.withColumn("_taken", taken).withColumn("title", F.when(~F.col("_taken"), title))
    book = Window.partitionBy("textbook_id").orderBy("page", "line_ord")
    before = F.last("title", ignorenulls=True).over(book.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("title").isNotNull() & (F.coalesce(before, F.lit(BODY)) != F.col("title"))
    marked = marked.withColumn("_opens", opens).withColumn("_seg", F.sum(F.col("_opens").cast("int")).over(book.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.when(F.col("_opens") | F.col("_taken"), F.lit(None).cast("string")).otherwise(F.col("text"))
    parts = marked.groupBy("textbook_id", "_seg").agg(
        F.max(F.when(F.col("_opens"), F.col("title"))).alias("title"),
        F.min("page").alias("page_start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_ord", kept.alias("t")))), lambda s: s["t"]), "\n").alias("content"),
    )
    order = Window.partitionBy("textbook_id").orderBy("_seg")
    last = lines.groupBy("textbook_id").agg(F.max("page").alias("_pages"))
    follow = F.lead("page_start").over(order)
    ended = F.when(follow.isNull(), F.col("_pages")).when(follow == F.col("page_start"), follow).otherwise(follow - 1)
    return as_chapters(parts.join(last, "textbook_id").withColumn("page_end", ended).withColumn("chapter_ord", F.row_number().over(order)))


# -- chunks -------------------------------------------------------------------------------------------------------------


def stride_chunks(chapters: DataFrame, size: int = 1200, overlap: int = 160) -> DataFrame:
    """Pieces of a fixed length at a fixed stride; blank pieces are dropped and don't count."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and below it")
    content = T.strip(T.blank_to_empty(F.col("content")))
    flat = chapters.withColumn("_c", content).where("_c <> ''")
    cut = flat.withColumn("char_start", F.explode(F.sequence(F.lit(0), F.length("_c") - 1, F.lit(max(1, size - overlap)))))
    cut = cut.withColumn("char_end", F.least(F.length("_c"), F.col("char_start") + size))
    cut = cut.withColumn("text", T.strip(F.substring(F.col("_c"), F.col("char_start") + 1, F.lit(size)))).where("text <> ''")
    order = Window.partitionBy("textbook_id", "chapter_id").orderBy("char_start")
    cut = cut.withColumn("chunk_index", F.row_number().over(order))
    return cut.select(
        F.format_string("%s:%s:chunk_%03d", "textbook_id", "chapter_id", "chunk_index").alias("chunk_id"),
        "textbook_id", "chapter_id", F.col("title").alias("chapter_title"), "chunk_index", "char_start", "char_end", "text", "page_start", "page_end",
    )


def spans(body: Column, size: int, overlap: int, least: int = 500) -> Column:
    """array<struct<start, end>> of boundary-aware chunks, one pass over a text: it is never copied from its start again.

    A chunk ends after the last sentence mark in its part beyond ``least`` characters, else at ``size``.
    """
    lower = min(least, size)
    mark = re.compile(f"[{T.SENTENCE_MARKS}]")

    @F.pandas_udf("array<struct<char_start:int,char_end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[dict]:
            out, start, n = [], 0, len(text or "")
            while start < n:
                end = n
                if n - start > size:
                    marks = [m.end() for m in mark.finditer(text, start + lower, start + size)]
                    end = marks[-1] if marks else start + size
                out.append({"char_start": start, "char_end": end})
                start = n if end >= n else max(end - overlap, start + 1)
            return out

        return texts.map(of)

    return cut(body)


def boundary_chunks(chapters: DataFrame, size: int = 800, overlap: int = 80, skip_low_signal: bool = True) -> DataFrame:
    """Overlapping chunks of the normalised content that end at sentence marks where they can."""
    rows = chapters.where(~T.low_signal_chapter(F.col("title"), F.col("content"))) if skip_low_signal else chapters
    rows = rows.withColumn("_b", T.content_lines(F.col("content"))).where("_b <> ''")
    cut = rows.select("*", F.posexplode(spans(F.col("_b"), size, overlap)).alias("_i", "_s"))
    cut = cut.withColumn("text", T.strip(F.substring(F.col("_b"), F.col("_s.char_start") + 1, F.col("_s.char_end") - F.col("_s.char_start"))))
    return cut.where("text <> ''").select(
        F.format_string("%s:%s:chunk_%04d", "textbook_id", "chapter_id", F.col("_i") + 1).alias("chunk_id"),
        "textbook_id", "chapter_id", F.col("title").alias("chapter_title"), "page_start", "page_end",
        (F.col("_i") + 1).alias("chunk_index"), "_s.char_start", "_s.char_end", "text",
    )


def chunk_estimate(chapters: DataFrame, size: int = 800, overlap: int = 80) -> DataFrame:
    """(textbook_id, chunks): how many chunks indexing would make, without cutting."""
    n = F.length(T.content_lines(F.col("content")))
    kept = chapters.where(~T.low_signal_chapter(F.col("title"), F.col("content")) & (n > 0))
    return kept.groupBy("textbook_id").agg(F.sum(F.greatest(F.lit(1), F.ceil((n - overlap) / max(1, size - overlap)))).cast("bigint").alias("chunks"))
