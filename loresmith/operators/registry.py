"""What is already indexed, what is still to do, and the counts of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresmith.functions.hashing import embedding_key
from loresmith.functions.text import truncate
from loresmith.operators.chunking import dedup_exact

EMBED_CAP, EMBED_BATCH = 8000, 32  # fixed values
BUCKET_DIGITS = 2  # hexadecimal digits of a key that name its bucket of batches
PART_DIGITS = 3  # further digits by which a bucket is numbered in parts


def skip_indexed(files: DataFrame, registry: DataFrame, order: str) -> DataFrame:
    """Add status (new / skipped) with the earlier id and chunk count.

    A file is skipped when its hash is registered, or when an earlier file of the same run has it.  The first of each
    hash is found by a partial minimum; the join sends a very common hash through AQE's skew split.
    """
    first = files.groupBy("file_hash").agg(F.min(order).alias("_first"))
    known = first.join(
        registry.select("file_hash", F.col("document_id").alias("known_document_id"), "chunk_count"), "file_hash", "left"
    )
    rows = files.join(known, "file_hash", "left")
    seen = F.col("known_document_id").isNotNull() | (F.col(order) != F.col("_first"))
    return rows.withColumn("status", F.when(seen, "skipped").otherwise("new")).drop("_first")


def work_list(files: DataFrame, registry: DataFrame, order: list) -> DataFrame:
    """Only the files to index: one per unseen hash."""
    unseen = files.join(registry.select("file_hash"), "file_hash", "left_anti")
    return dedup_exact(unseen, "file_hash", order, scope=())


def registry_upsert(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates replace rows of the same hash; among updates the latest ingested_at wins."""
    cols = registry.columns
    both = registry.withColumn("_new", F.lit(0)).unionByName(updates.select(*cols).withColumn("_new", F.lit(1)))
    w = Window.partitionBy("file_hash").orderBy(F.desc("_new"), F.desc("ingested_at"))
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).select(*cols)


def merge_summaries(registry: DataFrame, summaries: DataFrame) -> DataFrame:
    """Add summary hashes(file_hash, summary_hash) to registered files as a sorted set; unknown files are ignored."""
    found = summaries.groupBy("file_hash").agg(F.collect_set("summary_hash").alias("_found"))
    rows = registry.join(found, "file_hash", "left")
    merged = F.array_sort(F.array_union(F.coalesce("summary_hashes", F.array().cast("array<string>")), "_found"))
    has = F.col("_found").isNotNull()
    return rows.withColumns(
        {
            "summary_hashes": F.when(has, merged).otherwise(F.col("summary_hashes")),
            "summary_generated": F.col("summary_generated") | has,
        }
    ).drop("_found")


def summary_counts() -> dict[str, Column]:
    """The aggregates of an ingest log: files by status and chunks added."""
    status = F.col("status")
    return {
        "total": F.count("*"),
        **{name: F.count_if(status == name) for name in ("indexed", "skipped", "failed")},
        "chunks_added": F.coalesce(F.sum(F.when(status == "indexed", F.col("chunks_added"))), F.lit(0)),
    }


def ingest_summary(log: DataFrame) -> DataFrame:
    """One row: files by status and chunks added."""
    return log.agg(*[c.alias(name) for name, c in summary_counts().items()])


def embedding_input() -> Column:
    given = [F.nullif(F.col(c), F.lit("")) for c in ("embedding_text", "clean_content", "content")]
    return F.coalesce(*given)


def embedding_worklist(
    chunks: DataFrame, cache: DataFrame, provider: str, model: str, task: str, prefix: int = BUCKET_DIGITS
) -> DataFrame:
    """Distinct texts that are not cached, in batches of 32: key, text (cut to the cap, with dots), batch_id.

    Batches are numbered along the keys of a bucket, which are those with equal first ``prefix`` hexadecimal digits.  The keys
    are counted by ``PART_DIGITS`` more digits first and numbered from there on inside each part, so that the ids are the
    same however many keys there are, and no task sorts more than a part of a bucket (a key being a hash).
    """
    text = embedding_input()
    rows = chunks.select("chunk_id", text.alias("text")).where(F.col("text").isNotNull())
    rows = rows.withColumn("key", embedding_key(F.lit(provider), F.lit(model), F.lit(task), F.col("text")))
    todo = dedup_exact(rows, "key", [F.col("chunk_id")], scope=()).join(cache.select("key"), "key", "left_anti")
    todo = todo.withColumns({"bucket": F.substring("key", 1, prefix), "part": F.substring("key", prefix + 1, PART_DIGITS)})
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = todo.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    starts = starts.select("bucket", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("key"))
    todo = todo.withColumn("nth", inside).join(starts, ["bucket", "part"])
    number = F.floor((F.col("start") + F.col("nth") - 1) / EMBED_BATCH).cast("string")
    return todo.select(
        "key", truncate(F.col("text"), EMBED_CAP).alias("text"), "chunk_id",
        F.concat("bucket", F.lit("-"), number).alias("batch_id"),
    )


def embedding_validation(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, vectors, chunks without a vector, vectors without a chunk, empty vectors, and the verdict."""
    pairs = chunks.select("chunk_id", F.lit(True).alias("c")).join(
        vectors.select("chunk_id", F.lit(True).alias("v"), F.size("vector").alias("dim")), "chunk_id", "full_outer"
    )
    counts = pairs.agg(
        F.count("c").alias("chunks"),
        F.count("v").alias("vectors"),
        F.count_if(F.col("v").isNull()).alias("missing"),
        F.count_if(F.col("c").isNull()).alias("orphans"),
        F.count_if(F.col("v") & (F.coalesce("dim", F.lit(0)) <= 0)).alias("empty"),
    )
    bad = F.col("missing") + F.col("orphans") + F.col("empty")
    return counts.withColumn("valid", bad == 0)


def store_stats(**layers: DataFrame) -> DataFrame:
    """Rows per layer, in one table."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def upsert_index(index: DataFrame, new: DataFrame, skip_existing: bool = True, key: str = "chunk_id") -> DataFrame:
    """The index with the new rows; an id already present is kept (skip_existing) or replaced."""
    if skip_existing:
        return index.unionByName(new.join(index.select(key), key, "left_anti"))
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def delete_by_document(index: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """The index without any row of the listed documents."""
    return index.join(documents.select(key).distinct(), key, "left_anti")
