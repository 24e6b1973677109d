"""What the final rows are worth, and how they become a budgeted context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresmith import vocab
from loresmith.config import RETRIEVAL, RetrievalConfig
from loresmith.functions.lookup import first_tag, lookup, mentions_any
from loresmith.functions.privacy import preview
from loresmith.functions.text import fixed, truncate
from loresmith.operators.policy import role_of
from loresmith.operators.scoring import is_topic_mismatch, specific_topics


def with_role(rows: DataFrame) -> DataFrame:
    role = role_of(F.col("retrieval_role"), F.col("content_type"), F.col("source_type"))
    return rows.withColumn("role", role)


def evidence_policy(summary: DataFrame, passed: DataFrame, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """One verdict per question from its summary row and its final rows.

    ``summary`` carries query_topics, passed_count and card_candidate_count.
    """
    rows = with_role(passed)
    fallback = F.col("role") == "raw_fallback"
    known = F.size(specific_topics(F.col("topic_tags"), F.col("primary_topic"))) > 0
    differs = is_topic_mismatch(F.col("topic_tags"), F.col("primary_topic"), F.col("query_topics"))
    counts = rows.groupBy("query_id").agg(
        F.count_if(F.col("role") == "primary_card").alias("n_primary"),
        F.count_if(F.col("role") == "raw_evidence").alias("n_evidence"),
        F.count_if(fallback).alias("n_fallback"),
        F.count_if(fallback & known & (F.size("query_topics") > 0)).alias("n_known"),
        F.count_if(fallback & differs).alias("n_mismatch"),
    )
    base = summary.select("query_id", "query_topics", "passed_count", "card_candidate_count")
    v = base.join(counts, "query_id", "left").fillna(0)
    topic_clear = F.size("query_topics") > 0
    v = v.withColumns(
        {
            "ratio": F.when(F.col("n_known") > 0, F.col("n_mismatch") / F.col("n_known")).otherwise(0.0),
            "raw_fallback_only": (F.col("n_primary") == 0) & (F.col("n_fallback") > 0),
        }
    )
    high = F.col("ratio") >= cfg.weak_mismatch_ratio
    only = F.col("raw_fallback_only")
    return v.select(
        "query_id",
        "raw_fallback_only",
        F.when(~only, None)
        .when(F.col("card_candidate_count") > 0, "no_primary_normalized_document")
        .otherwise("no_normalized_document_candidate")
        .alias("raw_fallback_only_reason"),
        F.col("n_mismatch").alias("fallback_mismatch_count"),
        F.col("ratio").alias("fallback_mismatch_ratio"),
        ((F.col("n_primary") > 0) | (F.col("n_evidence") > 0)).alias("primary_evidence_available"),
        (F.col("card_candidate_count") > 0).alias("normalized_document_available"),
        (only & topic_clear & (F.col("n_fallback") >= cfg.weak_min_fallback) & high).alias("weak_evidence_warning"),
        F.when(F.col("passed_count") < cfg.min_retrieved, "insufficient")
        .when(F.col("n_primary") > 0, "strong")
        .when(F.col("n_evidence") > 0, "medium")
        .when(only & topic_clear & high, "insufficient")
        .when(only & topic_clear & (F.col("n_mismatch") == 0), "medium")
        .when(only, "weak")
        .otherwise("insufficient")
        .alias("evidence_strength"),
    )


def answerability(summary: DataFrame, cfg: RetrievalConfig = RETRIEVAL) -> DataFrame:
    """Whether to answer at all, why not, and from what."""
    skip = F.col("passed_count") < cfg.min_retrieved
    cards = F.lit(cfg.answer_with_cards) & (F.col("primary_count") > 0)
    return summary.select(
        "query_id",
        skip.alias("generation_skipped"),
        F.when(skip & (F.col("candidate_count") == 0), "no_candidates")
        .when(skip, "below_threshold")
        .alias("skip_reason"),
        F.when(skip, "insufficient_evidence").when(cards, "knowledge_card").otherwise("raw_fallback").alias("answer_mode"),
    )


def cap_per_file(rows: DataFrame, n: int, file_col: str, order: list, group: tuple = ()) -> DataFrame:
    """The first n rows of each file; n <= 0 keeps all.  The limit is applied before the shuffle as well."""
    if n <= 0:
        return rows
    key = F.coalesce(F.col(file_col), F.lit(""))
    w = Window.partitionBy(*group, key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def budget_pack(
    blocks: DataFrame, max_chars: int | Column, length: Column, order_col: str, group: tuple, separator: int = 0
) -> DataFrame:
    """The leading blocks whose running length fits; the first always stays.

    Lengths are never negative, so the running length only grows and the rows that fit are a prefix.
    """
    w = Window.partitionBy(*group).orderBy(order_col)
    rows = blocks.withColumns({"_n": F.row_number().over(w), "running_chars": F.sum(length + separator).over(w)})
    return rows.where((F.col("_n") == 1) | (F.col("running_chars") <= max_chars)).drop("_n")


def _or_dash(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)


def _listed(tags: Column) -> Column:
    quoted = F.transform(F.coalesce(tags, F.array()), lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _block(title: str, number: Column, lines: list[tuple[str, Column]], body: Column) -> Column:
    parts = [F.concat(F.lit(f"[{title} #"), number.cast("string"), F.lit("]"))]
    parts += [F.concat(F.lit(f"- {name}: "), value.cast("string")) for name, value in lines]
    return F.concat(F.concat_ws("\n", *parts, F.lit("---"), body), F.lit("\n"))


def _score_text() -> Column:
    return fixed(F.col("final_score"), 4)


def card_block(number: Column, body: Column) -> Column:
    """Context block of a card (fixed layout)."""
    return _block(
        "ND",
        number,
        [
            ("normalized_document_id", _or_dash(F.col("card_id"))),
            ("normalized_document_type", _or_dash(F.col("card_type"))),
            ("title", _or_dash(F.col("section_title"))),
            ("primary_topic", _or_dash(F.col("primary_topic"))),
            ("topic_tags", _listed(F.col("topic_tags"))),
            ("task_type", _or_dash(F.col("task_type"))),
            ("answer_use_cases", _or_dash(F.array_join("answer_use_cases", ","))),
            ("source_file_name", _or_dash(F.col("file_name"))),
            ("source_category", _or_dash(F.col("uploaded_category"))),
            ("display_date", _or_dash(F.col("display_date"))),
            ("final_score", _score_text()),
            ("parent_raw_chunk_ids", _listed(F.col("parent_raw_chunk_ids"))),
        ],
        body,
    )


def raw_block(number: Column, body: Column) -> Column:
    """Context block of a raw chunk beside cards (fixed layout)."""
    return _block(
        "RAW",
        number,
        [
            ("file_name", _or_dash(F.col("file_name"))),
            ("uploaded_category", _or_dash(F.col("uploaded_category"))),
            ("source_type", _or_dash(F.col("source_type"))),
            ("content_type", _or_dash(F.col("content_type"))),
            ("section_title", _or_dash(F.col("section_title"))),
            ("display_date", _or_dash(F.col("display_date"))),
            ("chunk_index", F.coalesce(F.col("chunk_index").cast("string"), F.lit("None"))),
            ("final_score", _score_text()),
        ],
        body,
    )


def plain_block(number: Column, body: Column) -> Column:
    """Context block used when there is no card (fixed layout)."""
    return _block(
        "근거",
        number,
        [
            ("file_name", _or_dash(F.col("file_name"))),
            ("uploaded_category", _or_dash(F.col("uploaded_category"))),
            ("source_type", _or_dash(F.col("source_type"))),
            ("content_type", _or_dash(F.col("content_type"))),
            ("section_title", _or_dash(F.col("section_title"))),
            ("display_date", _or_dash(F.col("display_date"))),
            ("primary_topic", _or_dash(F.col("primary_topic"))),
            ("todo_phase", _or_dash(F.col("todo_phase"))),
            ("parser_format", _or_dash(F.col("parser_format"))),
            ("chunk_index", F.coalesce(F.col("chunk_index").cast("string"), F.lit("?"))),
            ("final_score", _score_text()),
        ],
        body,
    )


# Columns a context block may name; a missing one counts as unknown.
BLOCK_COLUMNS = {
    "card_id": "string",
    "card_type": "string",
    "primary_topic": "string",
    "topic_tags": "array<string>",
    "task_type": "string",
    "answer_use_cases": "array<string>",
    "display_date": "string",
    "parent_raw_chunk_ids": "array<string>",
    "todo_phase": "string",
    "parser_format": "string",
    "chunk_index": "long",
}


def context_blocks(passed: DataFrame, cfg: RetrievalConfig = RETRIEVAL, body_col: str = "body") -> DataFrame:
    """Final rows as numbered text blocks within the context budget.

    With a card among the rows: cards get 70 %, evidence 25 % and fallback the rest of the characters.  Without one,
    rows are capped per file and share the whole budget.  ``body`` is the de-identified text of the row.
    """
    missing = {c: F.lit(None).cast(t) for c, t in BLOCK_COLUMNS.items() if c not in passed.columns}
    rows = with_role(passed.withColumns(missing) if missing else passed)
    q = Window.partitionBy("query_id")
    rows = rows.withColumns(
        {
            "has_card": F.max(F.col("role") == "primary_card").over(q),
            "n_rows": F.count("*").over(q),
            "role_size": F.count("*").over(Window.partitionBy("query_id", "role")),
            "role_no": F.row_number().over(Window.partitionBy("query_id", "role").orderBy("rank_n")),
            "file_no": F.row_number().over(
                Window.partitionBy("query_id", F.coalesce("file_name", F.lit(""))).orderBy("rank_n")
            ),
        }
    )
    card_budget = int(cfg.max_context_chars * 0.70)
    raw_budget = int(cfg.max_context_chars * 0.25)
    rest = cfg.max_context_chars - card_budget - raw_budget
    limits = {
        "primary_card": cfg.max_primary,
        "raw_evidence": cfg.max_evidence,
        "raw_fallback": max(1, cfg.max_evidence),
    }
    budgets = {"primary_card": card_budget, "raw_evidence": raw_budget, "raw_fallback": rest}
    floors = {"primary_card": 1000, "raw_evidence": 500, "raw_fallback": 400}
    role = F.col("role")
    listed = F.when(role == "raw_fallback", F.col("role_size")).otherwise(
        F.least(F.col("role_size"), lookup(role, limits, 0))
    )
    share = F.greatest(lookup(role, floors, 0), F.floor(lookup(role, budgets, 0) / F.greatest(F.lit(1), listed)))
    plain_share = F.greatest(F.lit(800), F.floor(F.lit(cfg.max_context_chars) / F.greatest(F.lit(2), F.col("n_rows"))))
    rows = rows.withColumns(
        {
            "lane": F.when(F.col("has_card"), role).otherwise("plain"),
            "body_limit": F.when(F.col("has_card"), share).otherwise(plain_share).cast("int"),
            "budget": F.when(F.col("has_card"), lookup(role, budgets, 0)).otherwise(cfg.max_context_chars),
        }
    )
    per_file = F.col("file_no") <= cfg.max_per_file if cfg.max_per_file > 0 else F.lit(True)
    admitted = (F.col("has_card") & (F.col("role_no") <= lookup(role, limits, 0))) | (~F.col("has_card") & per_file)
    rows = rows.where(admitted)
    lane = Window.partitionBy("query_id", "lane").orderBy("rank_n")
    rows = rows.withColumn("block_no", F.row_number().over(lane))
    body, no = truncate(F.col(body_col), F.col("body_limit")), F.col("block_no")
    text = (
        F.when(F.col("lane") == "plain", plain_block(no, body))
        .when(F.col("lane") == "primary_card", card_block(no, body))
        .otherwise(raw_block(no, body))
    )
    return budget_pack(
        rows.withColumn("block", text), F.col("budget"), F.length("block"), "block_no", ("query_id", "lane")
    ).select("query_id", "lane", "block_no", "chunk_id", "block", "running_chars")


def context_text(blocks: DataFrame) -> DataFrame:
    """All blocks of a question as one text: cards, then evidence, then fallback.  At most a few blocks per question."""
    place = lookup(F.col("lane"), {"primary_card": 0, "plain": 0, "raw_evidence": 1}, 2)
    parts = F.array_sort(F.collect_list(F.struct(place.alias("p"), "block_no", "block")))
    return blocks.groupBy("query_id").agg(
        F.count("*").alias("used_blocks"), F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("context")
    )


def use_cases(value: Column) -> Column:
    """Known use cases of a text list, in order, once each; separated by commas or bars."""
    items = F.transform(F.split(F.coalesce(value, F.lit("")), "[,|]"), lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(items, lambda v: v.isin(*vocab.USE_CASES)))


def answer_format(
    questions: DataFrame,
    cards: DataFrame,
    text_col: str = "question",
    glossary_words=vocab.GLOSSARY_WORDS,
    intents=vocab.ANSWER_INTENTS,
    implied_by=vocab.CARD_TYPE_USE_CASE,
) -> DataFrame:
    """Answer template per question.

    Glossary words or a glossary card; else the question's intent; else the first card's use case; else the first card
    type that implies one; else free form.  ``cards`` are the primary rows: query_id, rank_n, card_type,
    answer_use_cases (text list).
    """
    kind = F.lower(F.coalesce("card_type", F.lit("")))
    implied = lookup(kind, implied_by, F.lit(None).cast("string"))
    stated = F.get(use_cases(F.col("answer_use_cases")), F.lit(0))
    facts = cards.groupBy("query_id").agg(
        F.max(kind == "glossary").alias("has_glossary"),
        F.min_by(stated, F.when(stated.isNotNull(), F.col("rank_n"))).alias("stated"),
        F.min_by(implied, F.when(implied.isNotNull(), F.col("rank_n"))).alias("implied"),
    )
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    glossary = F.coalesce("has_glossary", F.lit(False)) | mentions_any(low, glossary_words)
    return questions.join(facts, "query_id", "left").select(
        "query_id",
        F.when(glossary, "glossary")
        .otherwise(F.coalesce(first_tag(low, intents), "stated", "implied", F.lit("freeform_grounded")))
        .alias("answer_format"),
    )


def source_listing(passed: DataFrame, per_role: int = 3, preview_chars: int = 240, body_col: str = "body") -> DataFrame:
    """What to show for the cited rows: a label, a short de-identified preview and the role; at most ``per_role`` of each role."""
    rows = with_role(passed)
    w = Window.partitionBy("query_id", "role").orderBy("rank_n")
    rows = rows.withColumn("source_no", F.row_number().over(w)).where(F.col("source_no") <= per_role)
    blank_to_null = lambda c: F.nullif(F.col(c), F.lit(""))
    named = F.concat_ws(" · ", blank_to_null("file_name"), blank_to_null("section_title"))
    other = F.coalesce(blank_to_null("uploaded_category"), blank_to_null("source_type"), F.lit("unknown"))
    label = F.when(named == "", other).otherwise(named)
    kind = blank_to_null("card_type")
    label = F.when(kind.isNotNull(), F.concat(label, F.lit(" ("), kind, F.lit(")"))).otherwise(label)
    return rows.select(
        "query_id", "role", "source_no", "chunk_id", label.alias("label"),
        preview(F.col(body_col), preview_chars).alias("preview"),
        "content_type", "primary_topic", "topic_match", "date_match", "final_score",
    )


def request_gate(requests: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Requests whose id is on the allow-list; an empty list admits all.

    ``allowed`` has one column named like ``column``.  Emptiness is read from one row of it.
    """
    if allowed.isEmpty():
        return requests
    return requests.join(allowed.select(column).distinct(), column, "left_semi")
