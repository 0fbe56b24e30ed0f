"""What a reader sees: chapter groups, node shapes and sizes, search, expansion, a spiral layout."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

GOLDEN_ANGLE = pi * (3 - sqrt(5))
WORLD = (1200.0, 760.0)
COLORS = 8


def title_kind(title: Column) -> Column:
    """level1, level2, front or other."""
    key, level = T.heading_key(title), T.chapter_level(title)
    return F.when(key.isin("", "正文"), "front").when(level == "primary", "level1").when(level == "secondary", "level2").otherwise("other")


def page(c: Column) -> Column:
    """A page number, or null where it is missing or 0."""
    return F.when(c != 0, c)


def chapter_groups(chapters: DataFrame) -> DataFrame:
    """A group for each top heading with the page range, the characters and the distinct headings below it.

    A second-level heading right before a top heading of the same page belongs to that one; a repeated top heading goes on
    with its first group.
    """
    book = Window.partitionBy("textbook_id").orderBy("chapter_ord")
    rows = chapters.withColumn("kind", title_kind(F.col("title"))).withColumn("_key", T.heading_key(F.col("title")))
    follow = F.lead(F.struct("kind", "page_start", "chapter_ord")).over(book)
    swap = F.coalesce((F.col("kind") == "level2") & (follow["kind"] == "level1") & (page(F.col("page_start")) == page(follow["page_start"])), F.lit(False))
    rows = rows.withColumn("_swap", swap).withColumn("_at", F.when(swap, follow["chapter_ord"] + 0.5).otherwise(F.col("chapter_ord").cast("double")))
    # a top heading that follows a swapped one opens its group anew
    rows = rows.withColumn("_after", F.lag("_swap", 1, False).over(book))
    same = Window.partitionBy("textbook_id", "_key").orderBy("_at")
    opened = F.when(F.col("kind") == "level1", F.when(F.col("_after"), F.col("chapter_id")).otherwise(F.first("chapter_id").over(same)))
    moved = Window.partitionBy("textbook_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_open", opened).withColumn("group_id", F.last("_open", ignorenulls=True).over(moved))
    kept = rows.where(F.col("group_id").isNotNull() & (F.col("kind") != "front"))
    child = F.when(F.col("kind") != "level1", F.struct("_key", F.coalesce(page(F.col("page_start")), -F.col("chapter_ord")).alias("p")))
    return kept.groupBy("textbook_id", F.concat(F.lit("group_"), "group_id").alias("group_id")).agg(
        F.min_by("title", "_at").alias("title"),
        F.min(page(F.col("page_start"))).alias("page_start"),
        F.max(page(F.col("page_end"))).alias("page_end"),
        F.sum("char_count").alias("char_count"),
        F.count_distinct(child).alias("children"),
    )


def radius(frequency: Column) -> Column:
    return F.least(F.lit(42.0), F.greatest(F.lit(17.0), 15 + 3.2 * F.sqrt(frequency)))


def shape(level: Column, category: Column, node_type: Column) -> Column:
    """Top headings, then content blocks, then diseases and methods, then the rest."""
    return (
        F.when((level == "primary") | (node_type == "chapter"), "hexagon").when(category == "内容块", "square").when(category.isin("疾病", "方法"), "diamond").otherwise("circle")
    )


def search(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes that show the needle anywhere, whatever the case."""
    none = F.array().cast("array<string>")
    shown = F.concat_ws("\n", "name", "definition", "chapter_title", "textbook_id", F.array_join(F.coalesce("aliases", none), "\n"))
    return nodes.where(F.lower(shown).contains(needle.lower()))


def visible(nodes: DataFrame, edges: DataFrame, expanded: str | None) -> tuple[DataFrame, DataFrame]:
    """Top nodes and the children of the expanded one, and the edges with both ends visible."""
    top = F.col("level") == "primary"
    shown = nodes.where(top | (F.col("parent_id") == expanded) if expanded else top)
    ends = shown.select("textbook_id", "node_id").distinct()
    kept = edges
    for end in ("source", "target"):
        kept = kept.join(ends.withColumnRenamed("node_id", end), ["textbook_id", end], "left_semi")
    return shown, kept


def qualified(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graphs of all textbooks as one, under qualified ids."""
    q = lambda c: F.concat_ws(":", "textbook_id", c)
    return nodes.withColumn("node_id", q("node_id")), edges.withColumn("source", q("source")).withColumn("target", q("target")).withColumn("edge_id", q("edge_id"))


def layout(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """Start positions on a spiral, nodes of high degree and frequency inside; one spiral a textbook."""
    rows = nodes.join(degree, ["textbook_id", "node_id"], "left").fillna(0, ["degree"])
    order = Window.partitionBy("textbook_id").orderBy(F.desc("degree"), F.desc(F.coalesce("frequency", F.lit(0))), "node_id")
    i = F.row_number().over(order) - 1
    rows = rows.withColumn("i", i)
    ring = F.when(F.col("i") == 0, 0.0).otherwise(92 + 46 * F.ceil(F.sqrt("i")))
    angle = F.col("i") * F.lit(GOLDEN_ANGLE)
    return rows.select("textbook_id", "node_id", "i", F.round(WORLD[0] / 2 + F.cos(angle) * ring, 3).alias("x"), F.round(WORLD[1] / 2 + F.sin(angle) * ring * 0.72, 3).alias("y"), F.round(radius(F.greatest(F.lit(1), F.coalesce("frequency", F.lit(1)))), 3).alias("r"))


def source_colors(nodes: DataFrame) -> DataFrame:
    """(textbook_id, color): a colour number for each source in order."""
    return nodes.select("textbook_id").distinct().withColumn("color", (F.row_number().over(Window.orderBy("textbook_id")) - 1) % COLORS)


def last_messages(messages: DataFrame, session: str, order: list[str], keep: int = 80) -> DataFrame:
    """The newest messages of each session."""
    newest = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= keep).drop("_r")


def file_size(bytes_: Column) -> Column:
    return (
        F.when(bytes_ < 1024, F.format_string("%d B", bytes_))
        .when(bytes_ < 1024 * 1024, F.format_string("%.1f KB", bytes_ / 1024.0))
        .otherwise(F.format_string("%.1f MB", bytes_ / 1048576.0))
    )


def graph_view(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Nodes as a reader's graph shows them: label, weight, source, description; missing values have stand-ins."""
    rows = nodes.join(titles.select("textbook_id", F.col("title").alias("source_title")), "textbook_id", "left")
    weight = F.coalesce("frequency", F.col("source_count") if "source_count" in nodes.columns else F.lit(1), F.lit(1))
    return rows.select(
        "textbook_id", F.col("node_id").alias("id"), F.col("name").alias("label"), weight.alias("frequency"), F.coalesce("source_textbook_id", "textbook_id").alias("source_id"), "source_title",
        F.coalesce("chapter_title", "chapter_id", F.lit("")).alias("chapter_title"), T.blank_to_empty(F.col("definition")).alias("description"), F.col("node_type").alias("type"), "category", "level",
    )
