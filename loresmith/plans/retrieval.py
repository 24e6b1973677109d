"""A table of questions against a table of chunks, from search to the final rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresmith.config import RETRIEVAL, RetrievalConfig
from loresmith.operators import fusion, keyword, keyword_blocks, nearest, policy, scoring
from loresmith.session import broadcast_if_small, written


@dataclass(frozen=True)
class Corpus:
    """The searchable side.

    texts(chunk_id, text), vectors(chunk_id, vector), chunks(chunk_id + attributes), children(parent_chunk_id + same).
    """

    texts: DataFrame
    vectors: DataFrame
    chunks: DataFrame | Callable[[DataFrame], DataFrame]
    children: DataFrame | None = None
    index: keyword.KeywordIndex | keyword_blocks.BlockIndex | None = None


def search(questions: DataFrame, query_vectors: DataFrame, corpus: Corpus, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """Fused candidates.  A few rows per question, written once because several later steps read them."""
    found = nearest.vector_topk(query_vectors, corpus.vectors, cfg.over_fetch)
    if not cfg.hybrid:
        kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
        none = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, bm25_rank int, bm25_score double, bm25_norm double"
        words = questions.sparkSession.createDataFrame([], none)
    elif isinstance(corpus.index, keyword_blocks.BlockIndex):
        words = keyword_blocks.bm25_topk_pruned(questions, corpus.index, cfg.bm25_top_k, cfg)
    elif corpus.index is not None:
        words = keyword.bm25_topk(questions, corpus.index, cfg.bm25_top_k, cfg)
    else:
        words = keyword.bm25_scan(questions, corpus.texts, cfg.bm25_top_k, cfg, doc_id_col="chunk_id")
    return written(fusion.rrf_fuse(found, words, cfg), "candidates")


def describe(fused: DataFrame, features: DataFrame, corpus: Corpus) -> DataFrame:
    """Candidates with the attributes of their chunk and the features of their question.

    The candidates are measured and broadcast, so the chunk table is scanned once and never shuffled.  The result is
    again a few rows per question; it is written because the ranking stages read it more than once.
    """
    chunks = corpus.chunks
    if callable(chunks):
        chunks = chunks(broadcast_if_small(fused.select("chunk_id").distinct()))
    rows = chunks.join(broadcast_if_small(fused), "chunk_id")
    return written(rows.join(broadcast_if_small(features), "query_id"), "described")


def with_texts(rows: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the text of each row's chunk, or null.  Only texts of the (measured, broadcast) rows leave the scan."""
    wanted = broadcast_if_small(rows.select("chunk_id").distinct())
    return rows.join(texts.select("chunk_id", text_col).join(wanted, "chunk_id", "left_semi"), "chunk_id", "left")


def rank(candidates: DataFrame, corpus: Corpus, as_of, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """Score, prioritize, add children, apply thresholds and diversity; ``rank_n`` numbers the rows that passed."""
    rows = scoring.score_candidates(candidates, as_of, cfg)
    rows = policy.normalized_priority(rows, cfg)
    if corpus.children is not None:
        rows = policy.expand_children(rows, corpus.children, cfg)
    rows = policy.threshold_and_cap(rows, cfg)
    rows = rows.withColumn("score_before", F.col("final_score"))
    rows = policy.diversity_penalty(rows, cfg, within=("query_id", "passed"))
    rows = rows.withColumns(
        {
            "final_score": F.when(F.col("passed"), F.col("final_score")).otherwise(F.col("score_before")),
            "diversity_bonus": F.when(F.col("passed"), F.col("diversity_bonus")),
        }
    ).drop("score_before")
    place = F.row_number().over(scoring.by_score("query_id", "passed"))
    # A few rows per question, read again for texts, evidence and context: written once.
    return written(rows.withColumn("rank_n", F.when(F.col("passed"), place)), "ranked")


def retrieve(
    questions: DataFrame,
    features: DataFrame,
    query_vectors: DataFrame,
    corpus: Corpus,
    as_of,
    cfg: RetrievalConfig = RETRIEVAL,
) -> DataFrame:
    """Every candidate of every question with all factors, flags and its place in the result."""
    return rank(describe(search(questions, query_vectors, corpus, cfg), features, corpus), corpus, as_of, cfg)


def final_rows(ranked: DataFrame, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    return ranked.where(F.col("rank_n") <= cfg.top_k)
