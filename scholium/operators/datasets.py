"""Evaluation data from question plans, and what callers ask for by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import stage
from .evaluation import _numbered_plans, candidate_sources, coverage, cross_pairs, plans, quotas

# The wording of questions made without a model, by question type; %1$s and %3$s are books, %2$s a chapter.
TEMPLATES = {
    "factual": "根据《%1$s》中“%2$s”的内容，请概括该知识点的核心定义或要点。",
    "reasoning": "根据《%1$s》中“%2$s”的片段，概括其中描述的机制、原因或后果。",
}
COMPARING = "结合《%1$s》和《%3$s》相关片段，比较两段内容的联系与差异。"


def planned_sources(planned: DataFrame, sources: DataFrame) -> DataFrame:
    """(plan_id, question_type, difficulty, cited): the sources of each plan in order; unknown ids are passed over."""
    each = planned.select("plan_id", "question_type", "difficulty", F.posexplode("source_ids").alias("pos", "source_id"))
    held = each.join(sources.select("source_id", F.struct("source_id", "textbook_id", "textbook_title", "chapter_id", "title", "page_start", "page_end", "excerpt").alias("s")), "source_id")
    return held.groupBy("plan_id", "question_type", "difficulty").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("_c")).withColumn("cited", F.transform("_c", lambda c: c["s"])).drop("_c")


def single_plans(sources: DataFrame, n: int) -> DataFrame:
    """Question plans as the SQL of eval_dataset has them: other than evaluation.plans(), comparative ones are of single sources and none are made for what is missing."""
    want = quotas(n)
    order = Window.orderBy("textbook_id", "rank")
    numbered = sources.withColumn("_i", F.row_number().over(order) - 1).select("_i", "source_id", "title")
    count = numbered.agg(F.count("*").alias("_n"))
    kinds = [(k, want[k]) for k in ("factual", "reasoning", "comparative")]
    spark = sources.sparkSession
    slots = spark.createDataFrame([(k, i, o) for o, (k, m) in enumerate(kinds) for i in range(m)], "question_type string, i int, o int").crossJoin(count)
    single = slots.where("_n > 0").withColumn("_i", F.col("i") % F.col("_n")).join(numbered, "_i").select("question_type", "o", "i", F.array("source_id").alias("source_ids"))
    best = Window.orderBy(F.desc("score"), "l", "r")
    pairs = cross_pairs(sources, want["cross_textbook"]).withColumn("i", F.row_number().over(best) - 1).select(F.lit("cross_textbook").alias("question_type"), F.lit(3).alias("o"), "i", F.array("l", "r").alias("source_ids"))
    every = single.unionByName(pairs)
    return _numbered_plans(every)


def templated(planned: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of the plans by fixed wordings: what the sources' first sentences say is the expected answer."""
    rows = planned_sources(planned, sources)
    first, last = F.col("cited")[0], F.element_at("cited", -1)
    words = lambda form: F.format_string(form, T.blank_to_empty(first["textbook_title"]), T.blank_to_empty(first["title"]), T.blank_to_empty(last["textbook_title"]))
    question = F.when(F.col("question_type") == "factual", words(TEMPLATES["factual"])).when(F.col("question_type") == "reasoning", words(TEMPLATES["reasoning"])).otherwise(words(COMPARING))
    answer = F.substring(F.trim(F.array_join(F.transform("cited", lambda c: T.sentences(c["excerpt"], 1)), " ")), 1, 220)
    return rows.select(
        F.replace("plan_id", F.lit("plan"), F.lit("q")).alias("question_id"), question.alias("question"), "question_type", "difficulty",
        F.when(answer != "", answer).otherwise(F.substring(first["excerpt"], 1, 180)).alias("expected_answer"), F.col("cited").alias("expected_citations"), F.lit("fallback-template").alias("notes"),
    )


def dataset(chapters: DataFrame, n: int, textbooks: DataFrame, asked: DataFrame | None = None, planned: Callable[[DataFrame, int], DataFrame] = plans) -> tuple[DataFrame, DataFrame]:
    """(items, coverage) of n questions over the chapters.

    ``asked`` are replies of a model by plan (question_id, question, expected_answer); where a reply is missing or blank the
    whole set falls back to fixed wordings, so that it is of one kind. ``planned`` makes the plans.
    """
    titles = textbooks.select("textbook_id", F.col("title").alias("textbook_title"))
    sources = stage(candidate_sources(chapters, n).join(titles, "textbook_id", "left"), "sources")
    items = templated(planned(sources.drop("textbook_title"), n), sources)
    if asked is not None:
        said = asked.where((F.trim("question") != "") & (F.trim("expected_answer") != "")).select("question_id", F.col("question").alias("_q"), F.col("expected_answer").alias("_a"))
        joined = items.join(said, "question_id", "left")
        if joined.where("_q is null").isEmpty():
            items = joined.withColumn("question", F.col("_q")).withColumn("expected_answer", F.col("_a")).withColumn("notes", F.lit("model")).drop("_q", "_a")
    return items, coverage(items)


def resolved(inline: DataFrame | None, cached: dict[str, DataFrame], name: str | None) -> DataFrame:
    """The data set given with a call, else the cached one of that name."""
    if inline is not None:
        return inline
    if name not in cached:
        raise KeyError(f"no such data set: {name}")
    return cached[name]


def requested(rows: DataFrame, ids: DataFrame, key: str = "textbook_id") -> DataFrame:
    """ids (ord, key) in the order asked for, with their rows and whether they are there at all."""
    return ids.select("ord", key).join(rows.withColumn("found", F.lit(True)), key, "left").fillna(False, ["found"])


def required(rows: DataFrame, ids: DataFrame, key: str = "textbook_id") -> DataFrame:
    """The rows asked for in order; ids without a row raise, naming up to ten."""
    out = requested(rows, ids, key)
    missing = [r[key] for r in out.where(~F.col("found")).orderBy("ord").limit(10).collect()]
    if missing:
        raise LookupError(f"not stored: {', '.join(map(str, missing))}")
    return out.orderBy("ord").drop("found", "ord")


def token_usage(items: DataFrame, question: str = "question", answer: str = "expected_answer", context: str | None = None) -> DataFrame:
    """(question_id, input_tokens, output_tokens, total_tokens), estimated; a context counts only if a model saw it."""
    given = T.token_estimate(F.col(question)) + (T.token_estimate(F.col(context)) if context else 0)
    made = T.token_estimate(F.col(answer))
    return items.select("question_id", given.alias("input_tokens"), made.alias("output_tokens"), (given + made).alias("total_tokens"))


def retrieval_info(matches: DataFrame, index_id: str, mode: str, k: int, min_score: float, model: str = "none", embeddings: int = 0) -> DataFrame:
    """One row on how a search was run and how many chunks it matched."""
    return matches.agg(F.count("*").alias("matched_chunks")).select(
        F.lit(index_id).alias("index_id"), F.lit(mode).alias("retrieval_mode"), F.lit(model).alias("embedding_model"), F.lit(embeddings).alias("embedding_count"), F.lit(min(k, 5)).alias("top_k"),
        F.lit(min_score).alias("min_score"), "matched_chunks",
    )


def index_job(chapters: DataFrame, estimates: DataFrame, status: str = "queued", error: str | None = None) -> DataFrame:
    """One row on an indexing job: status and how much there is to do."""
    counts = chapters.agg(F.count_distinct("textbook_id").alias("textbook_count"), F.count("*").alias("chapter_count"))
    guess = estimates.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("estimated_chunk_count"))
    both = counts.unionByName(guess, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(F.lit(status).alias("status"), "*", F.lit(error).cast("string").alias("error"))
