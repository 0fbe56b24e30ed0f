"""A property graph for each textbook: chapter nodes, content blocks, and the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def definition(content: Column, term: Column) -> Column:
    """The first sentence of 12 to 260 characters with the term, else the first of 24 or more, else the beginning."""
    flat = T.squeeze(content)
    every = T.marked_sentences(flat)
    with_term = F.filter(every, lambda s: s.contains(term) & F.length(s).between(12, 260))
    long = F.filter(every, lambda s: F.length(s) >= 24)
    return F.when(flat != "", F.coalesce(F.get(with_term, 0), F.substring(F.get(long, 0), 1, 260), F.substring(flat, 1, 260)))


def summary(content: Column) -> Column:
    """The first sentence of 28 or more characters, cut at 260, else the beginning."""
    flat = T.squeeze(T.blank_to_empty(content))
    long = F.filter(T.marked_sentences(flat), lambda s: F.length(s) >= 28)
    return F.when(flat != "", F.coalesce(F.substring(F.get(long, 0), 1, 260), F.substring(flat, 1, 260)))


def is_block(title: Column, char_count: Column) -> Column:
    """Whether a chapter makes a content block: enough text under a telling title."""
    key = T.heading_key(title)
    return (
        ~key.isin("", "正文", "本章数字资源", "推荐阅读", "中英文名词对照索引")
        & (char_count >= 80)
        & ~key.rlike(r"^\d+(主编|副主编)")
        & ~T.strip(title).rlike(r"^[A-Za-z ]+\z")
    )


def placed_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters with their level and the primary node that is current at each of them.

    A repeated primary heading brings its first node back; whatever precedes the first primary has none.
    """
    book = Window.partitionBy("textbook_id").orderBy("chapter_ord")
    same = Window.partitionBy("textbook_id", "_key").orderBy("chapter_ord")
    own = F.concat_ws("_", "textbook_id", "chapter_id", F.lit("primary"))
    rows = chapters.withColumn("level", T.chapter_level(F.col("title"))).withColumn("_key", F.when(F.col("level") == "primary", T.heading_key(F.col("title"))))
    rows = rows.withColumn("_id", F.when(F.col("level") == "primary", F.first(own).over(same)))
    first = F.when(F.col("level") == "primary", F.row_number().over(same) == 1).otherwise(F.lit(False))
    running = book.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_first", first).withColumn("parent_id", F.last("_id", ignorenulls=True).over(running))


def graph_nodes(chapters: DataFrame) -> DataFrame:
    """Primary nodes and content blocks, numbered in order of appearance."""
    placed = placed_chapters(chapters)
    content, title = T.blank_to_empty(F.col("content")), F.col("title")
    excerpt = T.excerpt(content, title)
    blocks = placed.where((F.col("level") != "primary") & F.col("parent_id").isNotNull() & is_block(title, F.col("char_count"))).select(
        "textbook_id", "chapter_ord", "chapter_id",
        F.concat_ws("_", "textbook_id", "chapter_id", F.lit("block")).alias("node_id"),
        T.squeeze(F.replace(title, F.lit("|"), F.lit(" | "))).alias("name"),
        summary(content).alias("definition"),
        F.lit("secondary").alias("level"),
        "parent_id",
        F.greatest(F.lit(1), F.floor(F.col("char_count") / 800)).cast("int").alias("frequency"),
        excerpt.alias("source_excerpt"), "page_start", "page_end", "char_count",
    )
    heads = placed.where("_first").select(
        "textbook_id", "chapter_ord", "chapter_id",
        F.col("_id").alias("node_id"),
        title.alias("name"),
        F.coalesce(definition(content, title), F.substring(content, 1, 220)).alias("definition"),
        F.lit("primary").alias("level"),
        F.lit(None).cast("string").alias("parent_id"),
        F.greatest(F.lit(1), F.floor(F.col("char_count") / 1000)).cast("int").alias("frequency"),
        excerpt.alias("source_excerpt"), "page_start", "page_end", "char_count",
    )
    order = Window.partitionBy("textbook_id").orderBy("chapter_ord")
    return heads.unionByName(blocks).withColumn("node_ord", F.row_number().over(order))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """An edge from each content block's primary node, numbered within the textbook."""
    order = Window.partitionBy("textbook_id").orderBy("chapter_ord")
    rows = nodes.where("level = 'secondary'").withColumn("edge_ord", F.row_number().over(order))
    return rows.select(
        "textbook_id", "edge_ord",
        F.format_string("%s_%s_parent_%03d", "textbook_id", "chapter_id", "edge_ord").alias("edge_id"),
        F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.lit("contains").alias("relation"), F.lit(1.0).alias("weight"),
    )


def prerequisite_edges(nodes: DataFrame) -> DataFrame:
    """Edges between the first nodes of successive chapters that have a content block."""
    order = Window.partitionBy("textbook_id").orderBy("chapter_ord")
    first = nodes.where("level = 'secondary'")
    rows = first.withColumn("target", F.lead("node_id").over(order)).withColumn("edge_ord", F.row_number().over(order)).where("target is not null")
    return rows.select(
        "textbook_id", "edge_ord",
        F.format_string("%s_chapter_prereq_%03d", "textbook_id", "edge_ord").alias("edge_id"),
        F.col("node_id").alias("source"), "target", F.lit("prerequisite").alias("relation"), F.lit(0.8).alias("weight"),
    )


def graph_edges(nodes: DataFrame) -> DataFrame:
    return contains_edges(nodes).unionByName(prerequisite_edges(nodes))


def star_edges(nodes: DataFrame) -> DataFrame:
    """Edges from each chapter's first node to its others, relations in turn: for nodes extracted without edges."""
    # The relations of a graph.
    relations = F.array(*[F.lit(r) for r in ("contains", "prerequisite", "parallel", "applies_to")])
    order = Window.partitionBy("textbook_id", "chapter_id").orderBy("node_ord")
    rows = nodes.withColumn("source", F.first("node_id").over(order)).withColumn("_i", F.row_number().over(order) - 1).where("_i > 0")
    return rows.select("textbook_id", "chapter_id", "source", F.col("node_id").alias("target"), F.get(relations, F.col("_i") % 4).alias("relation"))


def resolved_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Extracted (textbook_id, source, target, relation) whose ends are node ids or names; unknown ends, loops and odd relations go."""
    by_id = nodes.select("textbook_id", F.col("llm_id").alias("_k"), F.col("node_id").alias("_id"))
    by_name = nodes.groupBy("textbook_id", T.query_key(F.col("name")).alias("_k")).agg(F.min("node_id").alias("_id"))
    out = raw
    for end in ("source", "target"):
        ids = by_id.select("textbook_id", F.col("_k").alias(end), F.col("_id").alias(f"_i{end}"))
        names = by_name.select("textbook_id", F.col("_k").alias(f"_k{end}"), F.col("_id").alias(f"_n{end}"))
        out = out.join(ids, ["textbook_id", end], "left").withColumn(f"_k{end}", T.query_key(F.col(end))).join(names, ["textbook_id", f"_k{end}"], "left")
    out = out.select("textbook_id", F.coalesce("_isource", "_nsource").alias("source"), F.coalesce("_itarget", "_ntarget").alias("target"), F.lower("relation").alias("relation"))
    return out.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")) & F.col("relation").isin("prerequisite", "parallel", "contains", "applies_to"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select("textbook_id", F.explode(F.array("source", "target")).alias("node_id")).groupBy("textbook_id", "node_id").agg(F.count("*").alias("degree"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges of a textbook once for each unordered pair and relation, without loops: mean weight, all evidence, count."""
    evidence = F.coalesce("evidence", F.array().cast("array<string>"))
    keyed = edges.where("source <> target").select(
        "textbook_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), F.lower("relation").alias("relation"), "weight", evidence.alias("evidence")
    )
    out = keyed.groupBy("textbook_id", "source", "target", "relation").agg(
        F.round(F.avg("weight"), 4).alias("weight"),
        F.count("*").alias("source_edge_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("_e"),
    )
    said = F.array_distinct(F.filter(F.transform("_e", T.strip), lambda s: s != ""))
    return out.withColumn("evidence", F.array_sort(said)).drop("_e")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(textbook_id, measure, n): nodes by level and edges by relation."""
    by_level = nodes.groupBy("textbook_id", F.concat(F.lit("nodes:"), "level").alias("measure")).agg(F.count("*").alias("n"))
    by_relation = edges.groupBy("textbook_id", F.concat(F.lit("edges:"), F.lower("relation")).alias("measure")).agg(F.count("*").alias("n"))
    return by_level.unionByName(by_relation)
