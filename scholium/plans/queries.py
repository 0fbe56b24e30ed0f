"""The registered queries for the core operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets, evaluation, feedback, graphs, integration, quality, retrieval, segments, views
from ..operators.tables import KEYS, latest
from ..session import cut, stage, table
from ..sources import store

S, D = SparkSession, DataFrame


def _t(spark: S, d: str, name: str) -> D:
    return latest(table(spark, d, name), KEYS[name])


def _titled(spark: S, d: str) -> D:
    books = _t(spark, d, "textbooks").select("textbook_id", F.col("title").alias("textbook_title"))
    return _t(spark, d, "chapters").join(books, "textbook_id", "left")


def chapter_quality(spark: S, d: str) -> D:
    out = quality.quality(_t(spark, d, "textbooks"), _t(spark, d, "chapters"))
    return out.select("textbook_id", "chapter_count", "empty_chapter_count", "short_chapter_count", "page_span_inversions", "duplicate_title_count", "avg_chars_per_chapter", "score", "level", F.size("warnings").alias("warnings"))


def clean_titles(spark: S, d: str) -> D:
    return _t(spark, d, "chapters").select("textbook_id", "chapter_id", T.clean_title(F.col("title")).alias("clean"), T.heading_key(F.col("title")).alias("heading"), T.chapter_level(F.col("title")).alias("level"), views.title_kind(F.col("title")).alias("kind"))


def content_normalised(spark: S, d: str) -> D:
    body = T.content_lines(F.col("content"))
    return _t(spark, d, "chapters").select("textbook_id", "chapter_id", F.sha1(body).alias("body_hash"), F.length(body).alias("body_length"), F.sha1(T.query_key(T.blank_to_empty(F.col("content")))).alias("key_hash"))


def store_chunks(spark: S, d: str) -> D:
    return segments.stride_chunks(_t(spark, d, "chapters")).select("chunk_id", "chunk_index", "char_start", "char_end", F.sha1("text").alias("text_hash"))


def search_chunks(spark: S, d: str) -> D:
    return segments.boundary_chunks(_t(spark, d, "chapters")).select("chunk_id", "chunk_index", "char_start", "char_end", F.sha1("text").alias("text_hash"))


def chunk_estimates(spark: S, d: str) -> D:
    return segments.chunk_estimate(_t(spark, d, "chapters"))


def term_statistics(spark: S, d: str) -> D:
    rows = _t(spark, d, "chunks").select("chunk_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return rows.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.count_distinct("term").alias("distinct_terms"), F.max("term").alias("last_term"))


def gram_statistics(spark: S, d: str) -> D:
    g = T.grams(F.col("text"))
    return _t(spark, d, "chunks").select("chunk_id", F.size(g).alias("grams"), F.size(F.array_distinct(g)).alias("distinct_grams"))


def salient_terms(spark: S, d: str) -> D:
    return table(spark, d, "eval_items").select("question_id", F.array_join(T.salient(F.col("question")), " ").alias("salient"))


def opening_sentences(spark: S, d: str) -> D:
    return _t(spark, d, "chunks").select("chunk_id", T.sentences(F.col("text"), 2).alias("opening"))


def citation_labels(spark: S, d: str) -> D:
    return _t(spark, d, "chunks").select("chunk_id", T.citation_label(F.col("textbook_title"), F.col("chapter_title"), F.col("page_start"), F.col("page_end")).alias("citation"))


def token_estimates(spark: S, d: str) -> D:
    rows = _t(spark, d, "chunks").select("textbook_id", T.token_estimate(F.col("text")).alias("t"))
    return rows.groupBy("textbook_id").agg(F.sum("t").alias("tokens"), F.count("*").alias("chunks"))


def embedding_texts(spark: S, d: str) -> D:
    none = F.array().cast("array<string>")
    blank = lambda c: F.nullif(T.blank_to_empty(F.col(c)), F.lit(""))
    text = F.concat_ws("\n", blank("name"), F.nullif(F.array_join(F.coalesce("aliases", none), " "), F.lit("")), blank("definition"), blank("category"), blank("chapter_title"))
    return _t(spark, d, "nodes").select("textbook_id", "node_id", F.substring(T.strip(text), 1, 1200).alias("embedding_text"), integration.char_count().alias("char_count"))


def textbook_signatures(spark: S, d: str) -> D:
    return store.signatures(_t(spark, d, "textbooks"), _t(spark, d, "chapters"))


def low_signal_chapters(spark: S, d: str) -> D:
    return _t(spark, d, "chapters").where(T.low_signal_chapter(F.col("title"), F.col("content"))).select("textbook_id", "chapter_id")


def graph_nodes(spark: S, d: str) -> D:
    return graphs.graph_nodes(_t(spark, d, "chapters")).select("textbook_id", "node_ord", "node_id", "name", "level", "parent_id", "frequency", F.sha1(T.blank_to_empty(F.col("definition"))).alias("definition_hash"), F.sha1("source_excerpt").alias("excerpt_hash"))


def graph_edges(spark: S, d: str) -> D:
    return graphs.graph_edges(graphs.graph_nodes(_t(spark, d, "chapters")))


def distinct_edges(spark: S, d: str) -> D:
    out = graphs.distinct_edges(_t(spark, d, "edges"))
    return out.withColumn("evidence", F.array_join("evidence", "\n"))


def node_degrees(spark: S, d: str) -> D:
    return graphs.degrees(_t(spark, d, "edges"))


def graph_statistics(spark: S, d: str) -> D:
    return graphs.graph_stats(_t(spark, d, "nodes"), _t(spark, d, "edges"))


def graph_union(spark: S, d: str) -> D:
    _, edges = views.qualified(_t(spark, d, "nodes"), _t(spark, d, "edges"))
    return edges.select("edge_id", "source", "target", "relation", "weight")


def keyword_search(spark: S, d: str) -> D:
    return retrieval.lexical_top(table(spark, d, "eval_items"), _t(spark, d, "chunks"), "keyword", min_score=0.02)


def ngram_search(spark: S, d: str) -> D:
    return retrieval.lexical_top(table(spark, d, "eval_items"), _t(spark, d, "chunks"), "char_ngram", min_score=0.02)


def _queries(vectors: D) -> D:
    """Every fiftieth row by a hash of its id."""
    return vectors.where(F.conv(F.substring(F.md5("chunk_id"), 1, 6), 16, 10).cast("int") % 50 == 0).withColumnRenamed("chunk_id", "query_id")


def vector_search(spark: S, d: str) -> D:
    vectors = _t(spark, d, "chunk_vectors")
    out = retrieval.vector_top(_queries(vectors), vectors, retrieval.TOP_K)
    return out.select("query_id", "chunk_id", F.round("similarity", 4).alias("similarity"), "rank")


def hybrid_search(spark: S, d: str) -> D:
    """Chunks of the query set as questions: vector candidates, then the hybrid score over all signals."""
    vectors, chunks = _t(spark, d, "chunk_vectors"), _t(spark, d, "chunks")
    found = retrieval.vector_top(_queries(vectors), vectors, retrieval.candidate_pool(retrieval.TOP_K))
    found = cut(found.select(F.col("query_id").alias("question_id"), "chunk_id", "similarity"))
    asked = found.select("question_id").distinct().join(chunks.select(F.col("chunk_id").alias("question_id"), T.sentences(F.col("text"), 1).alias("question")), "question_id")
    return retrieval.reranked(asked, found, chunks, "hybrid")


def search_answers(spark: S, d: str) -> D:
    chunks = _t(spark, d, "chunks")
    matches = retrieval.lexical_top(table(spark, d, "eval_items"), chunks, "keyword", min_score=0.02)
    return retrieval.answers(matches, chunks)


def eval_coverage(spark: S, d: str) -> D:
    return evaluation.coverage(table(spark, d, "eval_items"))


def eval_sources(spark: S, d: str) -> D:
    return evaluation.candidate_sources(_t(spark, d, "chapters"), 24).select("source_id", "textbook_id", "chapter_id", "rank", F.sha1("excerpt").alias("excerpt_hash"))


def eval_plans(spark: S, d: str) -> D:
    return evaluation.plans(stage(evaluation.candidate_sources(_t(spark, d, "chapters"), 24), "sources"), 24)


def eval_leaderboard(spark: S, d: str) -> D:
    return evaluation.leaderboard(table(spark, d, "eval_items"), _titled(spark, d), evaluation.GRID)


def decision_ranking(spark: S, d: str) -> D:
    return feedback.rank_decisions(_t(spark, d, "decisions"), "为什么合并“LPKα 信号”？", 10).select("decision_id", "match", "confidence")


def decision_counts(spark: S, d: str) -> D:
    none = F.array().cast("array<string>")
    return _t(spark, d, "decisions").groupBy("action", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"), F.sum(F.size(F.coalesce("node_ids", none))).alias("nodes"))


def chapter_groups(spark: S, d: str) -> D:
    return views.chapter_groups(_t(spark, d, "chapters"))


def node_layout(spark: S, d: str) -> D:
    nodes = _t(spark, d, "nodes")
    return views.layout(nodes, graphs.degrees(_t(spark, d, "edges")))


def node_search(spark: S, d: str) -> D:
    return views.search(_t(spark, d, "nodes"), "LPK").select("textbook_id", "node_id", "name", views.shape(F.col("level"), F.col("category"), F.col("node_type")).alias("shape"))


def visible_edges(spark: S, d: str) -> D:
    nodes = _t(spark, d, "nodes")
    parent = nodes.where("parent_id is not null").agg(F.min("parent_id")).first()[0]
    return views.visible(nodes, _t(spark, d, "edges"), parent)[1].select("textbook_id", "edge_id", "source", "target")


def chat_history(spark: S, d: str) -> D:
    return views.last_messages(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", "event_type")


def event_windows(spark: S, d: str) -> D:
    events = table(spark, d, "events")
    rows = events.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows


def definition_conflicts(spark: S, d: str) -> D:
    rows = cut(integration.prepared(_t(spark, d, "nodes")))
    return integration.conflicts(rows).select("normalized_name", "left_id", "right_id", "token_jaccard", "definition_jaccard")


def entity_groups(spark: S, d: str) -> D:
    rows = cut(integration.prepared(_t(spark, d, "nodes")))
    valid = rows.where(~integration.is_empty(F.col("norm")))
    return integration.merge_groups(valid)[0]


def _integrated(spark: S, d: str) -> integration.Integration:
    return integration.integrate(_t(spark, d, "nodes"), _t(spark, d, "edges"))


def integrated_nodes(spark: S, d: str) -> D:
    return _integrated(spark, d).nodes.select("node_id", "name", "definition", "source_count")


def integrated_edges(spark: S, d: str) -> D:
    return _integrated(spark, d).edges.select("source", "target", "relation", "weight", "source_edge_count")


def integration_decisions(spark: S, d: str) -> D:
    return _integrated(spark, d).decisions.select("action", "result_node", "canonical_name", "score", "confidence", "reason")


def integration_stats(spark: S, d: str) -> D:
    return _integrated(spark, d).stats


def feedback_applied(spark: S, d: str) -> D:
    """The merged view of the graph after four commands."""
    after = _commanded(spark, d)
    return after.nodes.select("node_id", "name", "teacher_feedback")


def eval_dataset(spark: S, d: str) -> D:
    """Questions with fixed wordings over planned sources, with their expected answers and the number of citations."""
    items, _ = datasets.dataset(_t(spark, d, "chapters"), 24, _t(spark, d, "textbooks"), planned=datasets.single_plans)
    return items.select("question_id", "question", "question_type", "difficulty", "expected_answer", F.size("expected_citations").alias("citations"))


def requested_textbooks(spark: S, d: str) -> D:
    """Textbooks asked for by id, in order, with those that aren't stored."""
    ids = spark.createDataFrame([(1, "book_02"), (2, "no_such_book"), (3, "book_00"), (4, "book_01")], "ord int, textbook_id string")
    return datasets.requested(_t(spark, d, "textbooks"), ids).select("ord", "textbook_id", "title", "found")


def query_tokens(spark: S, d: str) -> D:
    return datasets.token_usage(table(spark, d, "eval_items"))


def index_job(spark: S, d: str) -> D:
    chapters = _t(spark, d, "chapters")
    return datasets.index_job(chapters, segments.chunk_estimate(chapters)).drop("error")


def decision_sources(spark: S, d: str) -> D:
    nodes = _t(spark, d, "nodes").select(F.concat_ws(":", "textbook_id", "node_id").alias("qid"), "name")
    return feedback.source_names(_t(spark, d, "decisions"), nodes).select("decision_id", F.array_join("sources", "|").alias("sources"))


def graph_view(spark: S, d: str) -> D:
    return views.graph_view(_t(spark, d, "nodes"), _t(spark, d, "textbooks"))


def node_conflicts(spark: S, d: str) -> D:
    """For each merged node that is kept, how many definitions of it disagree, and the first such pair."""
    done = _integrated(spark, d)
    out = integration.node_conflicts(done.conflicts, done.node_map, done.nodes)
    return out.select("node_id", F.size("conflicts").alias("conflicts"), F.col("conflicts")[0]["left_id"].alias("left_id"), F.col("conflicts")[0]["right_id"].alias("right_id"))


def _commanded(spark: S, d: str) -> feedback.Graph:
    none = F.lit(None).cast("string")
    nodes = views.qualified(_t(spark, d, "nodes"), _t(spark, d, "edges"))[0].select("node_id", "name", "definition", "aliases", none.alias("teacher_feedback"), none.alias("split_from"))
    edges = views.qualified(_t(spark, d, "nodes"), _t(spark, d, "edges"))[1].select("edge_id", "source", "target", "relation", "weight")
    return feedback.apply(feedback.Graph(nodes, edges), "保留“CO₂ 敏感血小板”。删除“未命名”。合并“骨的生长”和“LPKα 信号”")


def feedback_decisions(spark: S, d: str) -> D:
    """What the commands decided, a row for each node."""
    return _commanded(spark, d).decisions.select("decision_id", "action", "affected_node", "result_node", "canonical_name")


QUERIES = {
    f.__name__: f
    for f in (
        keyword_search, chapter_quality, clean_titles, content_normalised, store_chunks, search_chunks, chunk_estimates, term_statistics, gram_statistics, salient_terms, opening_sentences,
        citation_labels, token_estimates, embedding_texts, textbook_signatures, low_signal_chapters, graph_nodes, graph_edges, distinct_edges, node_degrees, graph_statistics, graph_union,
        ngram_search, vector_search, hybrid_search, search_answers, eval_coverage, eval_sources, eval_plans, eval_leaderboard, decision_ranking, decision_counts, chapter_groups,
        node_layout, node_search, visible_edges, chat_history, event_windows, definition_conflicts, entity_groups, integrated_nodes, integrated_edges, integration_decisions, integration_stats, feedback_applied,
        eval_dataset, requested_textbooks, query_tokens, index_job, decision_sources, graph_view, node_conflicts, feedback_decisions,
    )
}
