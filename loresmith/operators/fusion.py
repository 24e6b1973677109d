"""Reciprocal-rank fusion of vector and keyword candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loresmith.config import RETRIEVAL, RetrievalConfig
from loresmith.vocab import CATEGORY_LABELS

ALL_LABELS = ("all", "전체")


def category_filter(df: DataFrame, category: str | None, column: str = "uploaded_category") -> DataFrame:
    """Equality filter (pushed to the scan); empty or "all" keeps everything; display labels are understood."""
    if not category or category in ALL_LABELS:
        return df
    return df.where(F.col(column) == CATEGORY_LABELS.get(category, category))


def rrf_fuse(vector: DataFrame, keyword: DataFrame, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """Full outer join by (query_id, chunk_id) with the fused score, the better single score and the sources."""
    both = vector.select("query_id", "chunk_id", "vector_rank", "vector_score").join(
        keyword.select("query_id", "chunk_id", "bm25_rank", "bm25_score", "bm25_norm"),
        ["query_id", "chunk_id"],
        "full_outer",
    )
    zero = F.lit(0.0)
    from_vector = F.coalesce(cfg.rrf_vector_weight / (cfg.rrf_k + F.col("vector_rank")), zero)
    from_keyword = F.coalesce(cfg.rrf_bm25_weight / (cfg.rrf_k + F.col("bm25_rank")), zero)
    return both.select(
        "*",
        (from_vector + from_keyword).alias("rrf_score"),
        F.greatest(F.coalesce("vector_score", zero), F.coalesce("bm25_norm", zero)).alias("score"),
        F.array_compact(
            F.array(
                F.when(F.col("vector_rank").isNotNull(), F.lit("vector")),
                F.when(F.col("bm25_rank").isNotNull(), F.lit("bm25")),
            )
        ).alias("sources"),
    )


def rank_fused(fused: DataFrame) -> DataFrame:
    """Order by the fused score, then the single score, then the id."""
    w = Window.partitionBy("query_id").orderBy(
        F.round("rrf_score", 9).desc(), F.round("score", 9).desc(), F.col("chunk_id")
    )
    return fused.withColumn("rrf_rank", F.row_number().over(w))


def fusion_counts(fused: DataFrame) -> DataFrame:
    """Per question: candidates of each side, of both, and of the union."""
    v, b = F.col("vector_rank").isNotNull(), F.col("bm25_rank").isNotNull()
    return fused.groupBy("query_id").agg(
        F.count_if(v).alias("vector_count"),
        F.count_if(b).alias("bm25_count"),
        F.count("*").alias("merged_count"),
        F.count_if(v & ~b).alias("vector_only_count"),
        F.count_if(b & ~v).alias("bm25_only_count"),
        F.count_if(v & b).alias("overlap_count"),
    )
