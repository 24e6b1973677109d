"""Ranking policy: card priority, child rows, thresholds, diversity and the final cut.

Stage order matters: priority, children, thresholds, diversity, cut.  Candidates are a bounded number of rows per
question, so the windows below are over small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresmith import vocab
from loresmith.config import RETRIEVAL, RetrievalConfig
from loresmith.functions.lookup import lookup
from loresmith.functions.text import fixed
from loresmith.operators.scoring import by_score, is_topic_mismatch
from loresmith.session import broadcast_if_small


def is_card(content_type: Column, source_type: Column) -> Column:
    return F.coalesce(
        F.lower(content_type).isin(*vocab.CARD_CONTENT_TYPES) | (F.lower(source_type) == vocab.CARD_SOURCE_TYPE),
        F.lit(False),
    )


def card_type_boost(card_type: Column, intents: Column, cfg: RetrievalConfig = RETRIEVAL) -> tuple[Column, Column]:
    """(boost, does the type answer the question's intent)."""
    kind = F.lower(F.trim(F.coalesce(card_type, F.lit(""))))
    expected = lookup(kind, vocab.CARD_TYPE_INTENT, F.lit(None).cast("string"))
    fits = F.coalesce(F.array_contains(intents, expected), F.lit(False))
    return lookup(kind, vocab.CARD_TYPE_BOOST, 1.0) * F.when(fits, cfg.card_intent_bonus).otherwise(1.0), fits


def normalized_priority(candidates: DataFrame, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """Cards first: boost them, damp raw rows of the same files, label every row with its role."""
    card = is_card(F.col("content_type"), F.col("source_type"))
    rows = candidates.withColumn("is_card", card)
    if not cfg.prioritize_cards:
        return rows.withColumns(
            {
                "type_boost": F.lit(1.0),
                "type_match": F.lit(False),
                "topic_mismatch_demoted": F.lit(False),
                "retrieval_role": F.when(F.col("is_card"), "primary_card").otherwise("raw_fallback"),
            }
        )
    boost, fits = card_type_boost(F.col("card_type"), F.col("query_intent"), cfg)
    mismatch = is_topic_mismatch(F.col("topic_tags"), F.col("primary_topic"), F.col("query_topics"))

    def shares(key: str) -> Column:
        known = F.coalesce(F.col(key), F.lit("")) != ""
        return known & F.max("is_card").over(Window.partitionBy("query_id", key))

    rows = rows.withColumns(
        {"topic_mismatch_demoted": mismatch, "card_file": shares("source_file_hash") | shares("file_name")}
    )
    promoted = F.col("is_card") & ~F.col("topic_mismatch_demoted")
    evidence = ~F.col("is_card") & F.col("card_file") & ~F.col("topic_mismatch_demoted")
    return rows.withColumns(
        {
            "type_boost": F.when(promoted, boost).otherwise(1.0),
            "type_match": promoted & fits,
            "retrieval_role": F.when(promoted, "primary_card")
            .when(evidence, "raw_evidence")
            .otherwise("raw_fallback"),
            "final_score": F.when(promoted, F.col("final_score") * cfg.card_boost * boost)
            .when(evidence, F.col("final_score") * cfg.raw_evidence_boost)
            .otherwise(F.col("final_score")),
        }
    ).drop("card_file")


def expand_children(candidates: DataFrame, chunks: DataFrame, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """Append up to ``children_per_parent`` raw-table rows below each spreadsheet summary.

    ``chunks`` holds child rows with parent_chunk_id, sheet_name and the chunk attributes.  Only children of parents
    among the candidates leave the scan; per parent and sheet at most that many survive before the join, and the limit
    is pushed below the shuffle, so a parent with very many children costs no more than any other.  A child reachable from two parents belongs to the better one; one that
    is already a candidate is not added again.
    """
    n = cfg.children_per_parent
    candidates = candidates.withColumns({"rank_k1": F.row_number().over(by_score()), "is_child": F.lit(False)})
    # A sheetless child fits every sheet, so per parent the first n of each sheet group cover any parent's sheet.
    first = Window.partitionBy("parent_chunk_id", "sheet_name").orderBy("chunk_id")
    wanted = candidates.where(F.col("content_type") == "excel_summary").select(F.col("chunk_id").alias("parent_chunk_id"))
    kids = chunks.join(broadcast_if_small(wanted.distinct()), "parent_chunk_id", "left_semi")
    kids = kids.withColumn("child_no", F.row_number().over(first)).where(F.col("child_no") <= n).drop("child_no")
    parents = candidates.where(F.col("content_type") == "excel_summary").select(
        "query_id",
        F.col("chunk_id").alias("parent_chunk_id"),
        F.col("sheet_name").alias("parent_sheet"),
        F.col("rank_k1").alias("parent_rank"),
        F.col("final_score").alias("parent_final"),
        F.col("score").alias("parent_score"),
        "category_boost",
        "content_type_boost",
        F.col("source_weight").alias("parent_weight"),
        "query_topics",
        "query_intent",
        "query_date",
    )
    same_sheet = (
        (F.coalesce("sheet_name", F.lit("")) == "")
        | (F.coalesce("parent_sheet", F.lit("")) == "")
        | (F.col("sheet_name") == F.col("parent_sheet"))
    )
    joined = parents.join(kids, "parent_chunk_id").where(same_sheet)
    nth = Window.partitionBy("query_id", "parent_chunk_id").orderBy("chunk_id")
    joined = joined.withColumn("child_no", F.row_number().over(nth)).where(F.col("child_no") <= n).drop("child_no")
    joined = joined.join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    best = Window.partitionBy("query_id", "chunk_id").orderBy("parent_rank")
    children = (
        joined.withColumn("child_no", F.row_number().over(best))
        .where(F.col("child_no") == 1)
        .withColumns(
            {
                "final_score": F.col("parent_final") * cfg.child_score_ratio,
                "score": F.greatest(F.lit(0.0), F.col("parent_score") * cfg.child_score_ratio),
                "source_weight": F.coalesce("source_weight", "parent_weight"),
                "is_child": F.lit(True),
                "is_card": is_card(F.col("content_type"), F.col("source_type")),
                "topic_mismatch_demoted": F.lit(False),
            }
        )
        .drop("parent_rank", "parent_final", "parent_score", "parent_weight", "parent_sheet", "child_no")
    )
    return candidates.drop("rank_k1").unionByName(children, allowMissingColumns=True)


def threshold_and_cap(candidates: DataFrame, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """Add rank, passed and filter_reason.  The file cap counts rows that passed everything else."""
    rows = candidates.withColumn("rank_k3", F.row_number().over(by_score()))
    sim, fin = F.coalesce("score", F.lit(0.0)), F.coalesce("final_score", F.lit(0.0))
    reason = F.when(sim < cfg.min_similarity, _reason("similarity", sim, "min_similarity", cfg.min_similarity)).when(
        fin < cfg.min_final, _reason("final_score", fin, "min_final", cfg.min_final)
    )
    if cfg.date_filter:
        differs = F.coalesce(F.col("document_date") != F.col("query_date"), F.lit(False))
        text = F.format_string(
            "date_filter_excluded(query_date=%s, doc_date=%s)",
            F.col("query_date").cast("string"), F.col("document_date").cast("string"),
        )
        reason = F.when(differs, text).otherwise(reason)
    rows = rows.withColumn("filter_reason", reason)
    if cfg.max_per_file > 0:
        rows = rows.withColumn("file_key", F.coalesce(F.nullif("file_name", F.lit("")), F.col("document_id")))
        running = F.count_if(F.col("filter_reason").isNull()).over(
            Window.partitionBy("query_id", "file_key").orderBy("rank_k3")
        )
        over = F.col("filter_reason").isNull() & (running > cfg.max_per_file)
        capped = F.lit(f"file_cap_exceeded(max_per_file={cfg.max_per_file})")
        rows = rows.withColumn("filter_reason", F.when(over, capped).otherwise(F.col("filter_reason")))
        rows = rows.drop("file_key")
    return rows.withColumn("passed", F.col("filter_reason").isNull())


def _reason(name: str, value: Column, limit_name: str, limit: float) -> Column:
    return F.concat(F.lit(f"{name}("), fixed(value, 3), F.lit(f") < {limit_name}({limit:.2f})"))


def diversity_penalty(
    passed: DataFrame, cfg: RetrievalConfig = RETRIEVAL, rank_col: str = "rank_k3", within: tuple = ("query_id",)
) -> DataFrame:
    """Damp rows whose file or section already appeared above them; blank keys are not counted."""
    file_key = F.trim(F.coalesce("file_name", F.lit("")))
    section = F.trim(F.coalesce("section_title", F.lit("")))
    kind = F.trim(F.coalesce("content_type", F.lit("")))
    rows = passed.withColumns({"_f": file_key, "_s": section, "_c": kind})
    earlier = lambda *keys: F.row_number().over(Window.partitionBy(*within, *keys).orderBy(rank_col)) - 1
    rows = rows.withColumns(
        {
            "_nf": F.when(F.col("_f") == "", 0).otherwise(earlier("_f")),
            "_ns": F.when(F.col("_s") == "", 0).otherwise(earlier("_s", "_c")),
        }
    )
    bonus = F.pow(F.lit(cfg.same_file_penalty), "_nf") * F.pow(F.lit(cfg.same_section_penalty), "_ns")
    lam = cfg.diversity_lambda
    return (
        rows.withColumn("diversity_bonus", bonus)
        .withColumn("final_score", F.col("final_score") * (lam + (1.0 - lam) * F.col("diversity_bonus")))
        .drop("_f", "_s", "_c", "_nf", "_ns")
    )


def top_k(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank_n", F.row_number().over(by_score())).where(F.col("rank_n") <= k)


def role_of(role: Column, content_type: Column, source_type: Column) -> Column:
    """The given role wins; an unlabelled row is judged by what it is."""
    known = F.lower(F.coalesce(role, F.lit("")))
    guess = F.when(is_card(content_type, source_type), "primary_card").otherwise("raw_fallback")
    return F.when(known.isin("primary_card", "raw_evidence", "raw_fallback"), known).otherwise(guess)


def split_by_role(passed: DataFrame) -> DataFrame:
    """Per question the number of primary, evidence and fallback rows."""
    role = role_of(F.col("retrieval_role"), F.col("content_type"), F.col("source_type"))
    return passed.groupBy("query_id").agg(
        F.count_if(role == "primary_card").alias("primary_count"),
        F.count_if(role == "raw_evidence").alias("evidence_count"),
        F.count_if(role == "raw_fallback").alias("fallback_count"),
    )


def retrieval_summary(questions: DataFrame, candidates: DataFrame, k: int, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """One row per question, zeros for one without candidates.

    ``candidates`` are all rows with passed and, for rows inside the final cut, rank_n.
    """
    inside = F.coalesce(F.col("rank_n") <= k, F.lit(False))
    role = role_of(F.col("retrieval_role"), F.col("content_type"), F.col("source_type"))
    counts = candidates.groupBy("query_id").agg(
        F.count("*").alias("candidate_count"),
        F.count_if(inside).alias("passed_count"),
        F.count_if(~inside).alias("dropped_count"),
        F.count_if("is_card").alias("card_candidate_count"),
        F.count_if(~F.col("is_card")).alias("raw_candidate_count"),
        F.count_if(F.col("topic_match") == "mismatch").alias("topic_mismatch_count"),
        F.count_if("topic_mismatch_demoted").alias("topic_mismatch_demoted_count"),
        F.count_if(inside & (role == "primary_card")).alias("primary_count"),
        F.count_if(inside & (role == "raw_evidence")).alias("evidence_count"),
        F.count_if(inside & (role == "raw_fallback")).alias("fallback_count"),
    )
    names = [c for c in counts.columns if c != "query_id"]
    return questions.join(counts, "query_id", "left").withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in names},
            "min_similarity": F.lit(cfg.min_similarity),
            "min_final": F.lit(cfg.min_final),
            "max_per_file": F.lit(cfg.max_per_file),
            "top_k": F.lit(k),
        }
    )


def debug_filter(rows: DataFrame, content_type: str | None = None, card_type: str | None = None) -> DataFrame:
    """Look at results of one content type and card type; None keeps everything."""
    if content_type:
        rows = rows.where(F.lower(F.coalesce("content_type", F.lit(""))) == content_type)
    if card_type:
        rows = rows.where(F.lower(F.coalesce("card_type", F.lit(""))) == card_type)
    return rows
