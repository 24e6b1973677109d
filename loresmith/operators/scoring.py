"""The seven factors of a candidate's score, each a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresmith import vocab
from loresmith.config import RETRIEVAL, RetrievalConfig
from loresmith.functions.lookup import lookup


def source_weight(source_type: Column, content_type: Column, category: Column) -> Column:
    """Weight by spreadsheet content type, else by source type, else by category, else the default."""
    w = vocab.SOURCE_WEIGHTS
    by_category = lookup(category, w, vocab.DEFAULT_SOURCE_WEIGHT)
    by_source = lookup(source_type, w, by_category)
    special = {k: w[k] for k in ("excel_summary", "excel_raw_table")}
    return lookup(content_type, special, by_source)


def category_boost(category: Column, classes: dict[str, Column]) -> Column:
    """Base boost of the category times one multiplier per class of the question."""
    cat = F.lower(F.when(F.coalesce(category, F.lit("")) == "", "misc").otherwise(category))
    boost = lookup(cat, vocab.CATEGORY_BOOST, 1.0)
    for name, flag in classes.items():
        boost = boost * F.when(flag, lookup(cat, vocab.CLASS_MULTIPLIERS[name], 1.0)).otherwise(1.0)
    return boost


def content_type_boost(content_type: Column) -> Column:
    return lookup(F.lower(F.coalesce(content_type, F.lit("text"))), vocab.CONTENT_BOOST, 1.0)


def recency(created_at: Column, as_of: Column) -> Column:
    """1.0 for a week, then 0.97, 0.93 and 0.85; unknown or future dates count as fresh."""
    days = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(created_at.cast("timestamp"))) / 86400.0
    chain = F.when(created_at.isNull(), 1.0)
    for limit, value in vocab.RECENCY_STEPS:
        chain = chain.when(days <= limit, value)
    return chain.otherwise(vocab.RECENCY_OLD)


def half_penalty(penalty: float) -> float:
    return penalty + (1.0 - penalty) * 0.5


def date_match(chunk_date: Column, query_date: Column, cfg: RetrievalConfig = RETRIEVAL) -> tuple[Column, Column]:
    """(factor, label): exact, mismatch, or none with a half penalty when only the question has a date."""
    factor = (
        F.when(query_date.isNull(), 1.0)
        .when(chunk_date.isNull(), half_penalty(cfg.date_mismatch_penalty))
        .when(chunk_date == query_date, cfg.date_exact_boost)
        .otherwise(cfg.date_mismatch_penalty)
    )
    label = (
        F.when(query_date.isNull() | chunk_date.isNull(), "none")
        .when(chunk_date == query_date, "exact")
        .otherwise("mismatch")
    )
    return factor, label


def _clean(tags: Column) -> Column:
    """Trimmed lower-case tags without blanks."""
    return F.filter(F.transform(F.coalesce(tags, F.array()), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def _generic() -> Column:
    return F.array(*[F.lit(g) for g in vocab.GENERIC_TOPICS])


def topic_match(
    tags: Column, source_type: Column, topics: Column, intents: Column, cfg: RetrievalConfig = RETRIEVAL
) -> tuple[Column, Column]:
    """(factor, label): match, mismatch, neutral (only generic tags) or none."""
    mine, asked = _clean(tags), _clean(topics)
    guide = (F.lower(F.coalesce(source_type, F.lit(""))) == "guide") & F.array_contains(intents, "procedure")
    no_topic, no_tags = F.size(asked) == 0, F.size(mine) == 0
    overlap = F.arrays_overlap(mine, asked)
    only_generic = F.size(F.array_except(mine, _generic())) == 0
    factor = (
        F.when(no_topic, 1.0)
        .when(no_tags & guide, 0.95)
        .when(no_tags, half_penalty(cfg.topic_mismatch_penalty))
        .when(overlap, cfg.topic_match_boost)
        .when(only_generic, 1.0)
        .otherwise(cfg.topic_mismatch_penalty)
    )
    label = (
        F.when(no_topic | no_tags, "none").when(overlap, "match").when(only_generic, "neutral").otherwise("mismatch")
    )
    return factor, label


def specific_topics(tags: Column, primary: Column) -> Column:
    """Tags and primary topic without the generic ones."""
    both = F.array_union(_clean(tags), _clean(F.array(primary)))
    return F.array_except(F.array_compact(both), _generic())


def is_topic_mismatch(tags: Column, primary: Column, topics: Column) -> Column:
    """The chunk has topics of its own, the question has some, and none is shared."""
    mine, asked = specific_topics(tags, primary), _clean(topics)
    return (F.size(asked) > 0) & (F.size(mine) > 0) & ~F.arrays_overlap(mine, asked)


def score_candidates(candidates: DataFrame, as_of: Column, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """Add every factor and final_score to candidates that carry chunk attributes and query features."""
    classes = {name: F.col(name) for name in vocab.QUERY_CLASSES}
    date_factor, date_label = date_match(F.col("document_date"), F.col("query_date"), cfg)
    topic_factor, topic_label = topic_match(
        F.col("topic_tags"), F.col("source_type"), F.col("query_topics"), F.col("query_intent"), cfg
    )
    weight = F.col("source_weight")
    scored = candidates.withColumns(
        {
            "similarity": F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)),
            "source_weight": F.when(weight.isNull() | (weight == 0), 0.5).otherwise(weight),
            "category_boost": category_boost(F.col("uploaded_category"), classes),
            "content_type_boost": content_type_boost(F.col("content_type")),
            "recency": recency(F.col("created_at"), as_of),
            "date_boost": date_factor,
            "date_match": date_label,
            "topic_boost": topic_factor,
            "topic_match": topic_label,
        }
    )
    factors = ("source_weight", "category_boost", "content_type_boost", "recency", "date_boost", "topic_boost")
    final = F.col("similarity")
    for f in factors:
        final = final * F.col(f)
    return scored.withColumn("final_score", final)


def by_score(*partition: str) -> "Window":
    """Window of one question, best final score first, ties by chunk id."""
    return Window.partitionBy(*(partition or ("query_id",))).orderBy(
        F.round("final_score", 9).desc(), F.col("chunk_id")
    )
