"""The pN_ queries: each maps (spark, folder) to a DataFrame over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage, table
from . import components, encoding_repair, leakage, neighbours, packing, page_noise, personal_data, splitting, survivors, unicode_forms


def _names(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select(F.lit("node").alias("record_kind"), F.col("node_id").alias("record_key"), F.col("name").alias("value"))
    chapters = table(spark, d, "chapters").select(
        F.lit("chapter").alias("record_kind"), F.concat_ws(":", "textbook_id", "chapter_id").alias("record_key"), F.col("title").alias("value")
    )
    return nodes.unionByName(chapters)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unicode_forms.not_plain(_names(spark, d), "value").select("record_kind", "record_key").distinct()


def p1_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name and title in its plain spelling, with the key that equal-looking names share."""
    return unicode_forms.normalise(_names(spark, d).distinct(), "value")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every chapter with its clean title and continuous content, and the kinds of traces found."""
    return page_noise.clean_chapters(table(spark, d, "chapters"), table(spark, d, "textbooks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = p2_clean(spark, d).where((F.size("title_traces") > 0) | (F.size("content_traces") > 0))
    return found.select("textbook_id", "chapter_id").distinct()


def p2_proof(spark: SparkSession, d: str) -> DataFrame:
    """For each proof-read chapter, whether title and content were damaged and whether they came out as the proof has them."""
    proofs = table(spark, d, "chapter_proofs").withColumnsRenamed({"clean_title": "proof_title", "clean_content": "proof_content"})
    raw = table(spark, d, "chapters").select("textbook_id", "chapter_id", "title", "content").distinct()
    came = p2_clean(spark, d).select("textbook_id", "chapter_id", "clean_title", "clean_content").distinct()
    both = proofs.join(raw, ["textbook_id", "chapter_id"]).join(came, ["textbook_id", "chapter_id"])
    return both.select(
        "textbook_id", "chapter_id", (F.col("title") != F.col("proof_title")).alias("title_damaged"), F.col("clean_title").eqNullSafe(F.col("proof_title")).alias("title_exact"),
        (F.col("content") != F.col("proof_content")).alias("content_damaged"), F.col("clean_content").eqNullSafe(F.col("proof_content")).alias("content_exact"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.decision_groups(table(spark, d, "decisions"))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(p3_found(spark, d), table(spark, d, "nodes"), table(spark, d, "extractors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_survivors(spark, d).where(F.col("best_key").isNotNull()).select("group_key", F.col("best_key").alias("node_key"))


def p4_winners(spark: SparkSession, d: str) -> DataFrame:
    """What survives of each group with a member that beats all others: that member's own bundles, whole."""
    won = p4_survivors(spark, d).where(F.col("best_key").isNotNull())
    return won.select("group_key", F.col("best_key").alias("node_key"), "member_count", "definition", "extractor", "chapter_title", "page_start", "page_end", "source_excerpt", "frequency", "node_type", "level")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.corpus_items(table(spark, d, "chapters"), table(spark, d, "chunks"))
    return splitting.pieces(items, table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).select("item_kind", "item_key").distinct()


def p5_limits(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of item, how many were cut, and how many pieces or items break a rule: none."""
    limits = table(spark, d, "size_limits").select("item_kind", "max_size", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    items = splitting.corpus_items(table(spark, d, "chapters"), table(spark, d, "chunks")).groupBy("item_kind", "item_key").agg(F.max(F.length("text")).alias("length"))
    pieces = p5_pieces(spark, d).select("item_kind", "item_key", "piece_index", "char_start", "char_end", F.length("text").alias("n")).distinct().join(limits, "item_kind")
    after = F.lag("char_end").over(Window.partitionBy("item_kind", "item_key").orderBy("piece_index"))
    rows = pieces.withColumn("_over", F.col("n") > F.col("max_size")).withColumn("_apart", after.isNotNull() & (F.col("char_start") != after - F.col("overlap")))
    whole = rows.groupBy("item_kind", "item_key").agg(F.count_if("_over").alias("over"), F.count_if("_apart").alias("apart"), F.min("char_start").alias("a"), F.max("char_end").alias("b")).join(items, ["item_kind", "item_key"])
    return whole.groupBy("item_kind").agg(F.count("*").alias("items"), F.sum("over").alias("pieces_over"), F.sum("apart").alias("wrong_overlaps"), F.count_if((F.col("a") != 0) | (F.col("b") != F.col("length"))).alias("not_covered"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.usable(table(spark, d, "chunk_vectors"), table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.similar_pairs(_vectors(spark, d), min_similarity=0.9)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def asked():
    """The query set of searches: every fiftieth row, by the hash of its id as ids are texts."""
    return F.pmod(F.xxhash64("id"), F.lit(50)) == 0


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(_vectors(spark, d), asked(), k=10)


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of p6_neighbours against brute force, over the same query set."""
    vectors = _vectors(spark, d)
    exact = neighbours.brute_force(vectors, asked(), k=10).select("grp", "query", "id")
    found = neighbours.neighbours(vectors, asked(), k=10).select("grp", "query", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["grp", "query", "id"], "left").agg(
        F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall")
    )


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    chapters = table(spark, d, "chapters").select(
        F.lit("chapter").alias("record_kind"), F.concat_ws(":", "textbook_id", "chapter_id").alias("record_key"), F.col("content").alias("text")
    )
    books = table(spark, d, "textbooks").select(F.lit("textbook").alias("record_kind"), F.col("textbook_id").alias("record_key"), F.col("title").alias("text"))
    return chapters.unionByName(books)


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every title and content with its restored text and the spans that were damaged."""
    texts = _damaged(spark, d)
    counts = encoding_repair.collect_counts(encoding_repair.character_counts(texts, "text"))
    return encoding_repair.repair(texts, "text", counts)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_restored(spark, d).where(F.size("spans") > 0).select("record_kind", "record_key").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its container; the first line is the prompt, which bears no loss, if there are more lines."""
    prompt = F.length(F.regexp_extract("text", r"^\s*[^\n]*\n(?=\s*\S)", 0))
    return packing.packed_documents(table(spark, d, "documents"), table(spark, d, "size_limits"), loss_from=prompt)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p8_packed(spark, d), table(spark, d, "size_limits"))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """How many containers break a limit, and how many texts were cut though they fit: none."""
    return packing.violations(stage(p8_packed(spark, d), "packed"), table(spark, d, "size_limits"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each document and part of an evaluation item that it gives away, with the share of the part that it repeats."""
    return leakage.leaks(table(spark, d, "documents"), leakage.eval_texts(table(spark, d, "eval_items")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "question_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """For each evaluation item, in how many documents it leaked."""
    return p9_found(spark, d).groupBy("question_id").agg(F.count("*").alias("documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.kinds(table(spark, d, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders in the place of personal data, and the spans replaced."""
    return personal_data.find(table(spark, d, "documents").select("doc_id", "text"), "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_names, p2_found, p2_clean, p2_proof, p3_found, p4_found, p4_survivors, p4_winners, p5_found, p5_pieces, p5_limits, p6_found, p6_neighbours, p6_recall, p7_found, p7_restored, p8_packed, p8_report, p8_limits, p9_found, p9_leaks, p9_items, p10_found, p10_redacted)}
