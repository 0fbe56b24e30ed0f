"""Tables kept between runs: textbooks by content signature, an index with its manifest, JSON artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.segments import boundary_chunks
from ..session import cut


def signatures(textbooks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(textbook_id, signature): a hash of the file name, the title and the chapters in order."""
    part = F.sha1(F.concat_ws("\0", "chapter_id", "title", T.blank_to_empty(F.col("content"))))
    held = chapters.groupBy("textbook_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_ord", part.alias("h")))), lambda s: s["h"]), "\0").alias("_c"))
    return textbooks.join(held, "textbook_id", "left").select("textbook_id", T.joined_hash(F.col("filename"), F.col("title"), F.col("_c")).alias("signature"))


def fingerprint(chapters: DataFrame, size: int, overlap: int, model: str) -> DataFrame:
    """(textbook_id, fingerprint) of what indexing a textbook depends on."""
    part = F.sha2(T.content_lines(F.col("content")), 256)
    held = chapters.groupBy("textbook_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_ord", F.concat_ws(":", "chapter_id", "title", part).alias("h")))), lambda s: s["h"]), "\n").alias("_c"))
    return held.select("textbook_id", F.sha2(F.concat_ws("\n", F.lit(f"{size}/{overlap}/{model}"), "_c"), 256).alias("fingerprint"))


def unique_ids(incoming: DataFrame, taken: DataFrame) -> DataFrame:
    """incoming (textbook_id, signature) with ids that nobody has: a suffix of the signature, then a number."""
    suffixed = F.concat_ws("_", "textbook_id", F.substring(F.sha1("signature"), 1, 8))
    order = Window.partitionBy("_id").orderBy("signature")
    rows = incoming.join(taken.select("textbook_id", F.lit(True).alias("_t")).distinct(), "textbook_id", "left")
    first = Window.partitionBy("textbook_id").orderBy("signature")
    rows = rows.withColumn("_id", F.when(F.col("_t") | (F.row_number().over(first) > 1), suffixed).otherwise(F.col("textbook_id")))
    n = F.row_number().over(order)
    return rows.withColumn("stored_id", F.when(n > 1, F.concat_ws("_", "_id", n)).otherwise(F.col("_id"))).drop("_t", "_id")


def put(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store with what is new by signature; rows are (textbook_id, signature, ...)."""
    new = incoming.dropDuplicates(["signature"]).join(store.select("signature"), "signature", "left_anti")
    named = unique_ids(new, store).withColumn("textbook_id", F.col("stored_id")).drop("stored_id")
    return store.unionByName(named, allowMissingColumns=True)


def delete(store: DataFrame, textbook_id: str) -> DataFrame:
    return store.where(F.col("textbook_id") != textbook_id)


def listed(store: DataFrame) -> DataFrame:
    """What the store holds, newest first where rows say when."""
    by = [F.desc(c) for c in ("stored_at",) if c in store.columns]
    return store.orderBy(*by, "textbook_id")


def get(store: DataFrame, textbook_id: str) -> DataFrame:
    """The row of one textbook; an unknown one raises."""
    found = store.where(F.col("textbook_id") == textbook_id)
    if found.isEmpty():
        raise LookupError(f"not stored: {textbook_id}")
    return found


def clear(spark: SparkSession, folder: str) -> bool:
    """Remove an index or a store; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def build_index(chapters: DataFrame, folder: str, size: int = 800, overlap: int = 80, model: str = "none") -> DataFrame:
    """Chunks as parquet by textbook with a manifest; textbooks whose fingerprint is in the manifest aren't cut again."""
    spark = chapters.sparkSession
    now = fingerprint(chapters, size, overlap, model)
    known = manifest(spark, folder)
    todo = cut(now.join(known.select("textbook_id", "fingerprint"), ["textbook_id", "fingerprint"], "left_anti"))
    if not todo.isEmpty():
        chunks = boundary_chunks(chapters.join(todo.select("textbook_id"), "textbook_id", "left_semi"), size, overlap)
        chunks.repartition("textbook_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("textbook_id").parquet(f"{folder}/chunks")
        merged = cut(known.join(todo.select("textbook_id"), "textbook_id", "left_anti").unionByName(todo))  # read before it is overwritten
        merged.write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/chunks")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest; a missing one is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    schema = "textbook_id string, fingerprint string"
    return spark.read.schema(schema).json(f"{folder}/manifest") if there else spark.createDataFrame([], schema)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def documents_view(chunks: DataFrame) -> DataFrame:
    """Chunks as (id, text, metadata) with texts for missing metadata, as vector stores want them."""
    meta = [c for c in chunks.columns if c not in ("chunk_id", "text")]
    values = [x for c in meta for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return chunks.select(F.col("chunk_id").alias("id"), "text", F.create_map(*values).alias("metadata"))


def graph_seed(textbooks: DataFrame, chapters: DataFrame) -> DataFrame:
    """A row a textbook with its chapters in order."""
    item = F.struct("chapter_ord", "chapter_id", "title", "page_start", "page_end", "char_count")
    held = chapters.groupBy("textbook_id").agg(F.array_sort(F.collect_list(item)).alias("chapters"))
    return textbooks.select("textbook_id", "filename", "title", "total_pages", "total_chars").join(held, "textbook_id", "left")
