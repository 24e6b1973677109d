"""Reading and writing chunks, cards and the question log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.config import PRIVACY, PrivacyPolicy
from loresmith.functions.privacy import anonymize
from loresmith.operators.cards import CARD_SCHEMA, render_markdown

CARD_SEPARATOR = "\n\n---\n\n"
PREVIEW_CHARS = 600  # fixed value


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """One folder per category, so that a category filter prunes files."""
    chunks.write.mode(mode).partitionBy("uploaded_category").format(fmt).save(path)


def read_chunks(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """Chunks as written; unreadable JSON lines are skipped."""
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("mode", "DROPMALFORMED") if fmt == "json" else reader).load(path)


def cards_by_file(cards: DataFrame) -> DataFrame:
    """Per source file its cards as one JSON array and one markdown text.  A file has at most a few dozen cards."""
    names = [f.split()[0] for f in CARD_SCHEMA.split(", ") if " " in f and f.split()[0] in cards.columns]
    # A missing rendering is filled in, so that readers need no template.
    markdown = F.when(F.coalesce("sanitized_markdown", F.lit("")) == "", render_markdown()).otherwise(
        F.trim("sanitized_markdown")
    )
    rows = cards.withColumn("sanitized_markdown", markdown)
    item = F.struct("card_id", F.struct(*names).alias("card"), "sanitized_markdown")
    grouped = rows.groupBy("source_file_hash").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(
        "source_file_hash",
        F.to_json(F.transform("items", lambda i: i["card"])).alias("json"),
        F.concat(F.array_join(F.transform("items", lambda i: i["sanitized_markdown"]), CARD_SEPARATOR), F.lit("\n")).alias(
            "markdown"
        ),
    )


def write_cards(cards: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON array per line and file."""
    cards_by_file(cards).select(F.col("json").alias("value")).write.mode(mode).text(path)


def read_cards(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Cards from arrays of objects (per line, or one per file); unknown keys are ignored, broken text is skipped."""
    rows = (
        spark.read.schema(f"{CARD_SCHEMA}, normalized_document_id string, normalized_document_type string")
        .option("mode", "DROPMALFORMED")
        .option("multiLine", multi_line)
        .json(path)
    )
    lists = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
    empty = {c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in lists}
    return rows.withColumns(
        {
            "card_id": F.coalesce("card_id", "normalized_document_id"),
            "card_type": F.coalesce("card_type", "normalized_document_type"),
            **empty,
        }
    ).drop("normalized_document_id", "normalized_document_type")


def qa_log_rows(results: DataFrame, text_col: str = "body", policy: PrivacyPolicy = PRIVACY) -> DataFrame:
    """One row per question with its cited chunks; each carries a de-identified preview of 600 characters.

    ``results`` are the final rows of a question (top k), so a group is small.
    """
    preview = F.substring(anonymize(F.coalesce(F.col(text_col), F.lit("")), policy), 1, PREVIEW_CHARS)
    item = F.struct(
        "rank_n", "chunk_id", "document_id", "file_name", "section_title", "content_type", "uploaded_category",
        "source_type", "score", "final_score", "retrieval_role", preview.alias("preview"),
    )
    return results.groupBy("query_id").agg(
        F.count("*").alias("n_passed"), F.array_sort(F.collect_list(item)).alias("retrieved_chunks")
    )


def append_qa_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)
