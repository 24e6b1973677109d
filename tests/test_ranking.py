"""Scoring factors, ranking policy, evidence and context on literal candidates."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loresmith.config import RetrievalConfig
from loresmith.operators import evidence, policy, scoring

BASE = dict(
    query_id=1, chunk_id=1, document_id="d", file_name="f", source_file_hash="h", section_title="s", sheet_name=None,
    uploaded_category="guide", source_type="guide", content_type="text", card_type=None, topic_tags=[], primary_topic=None,
    source_weight=1.0, created_at=None, document_date=None, score=0.8, query_date=None, query_topics=[], query_intent=[],
    is_settlement=False, is_todo=False, is_setting=False, is_kakao=False,
)
SCHEMA = (
    "query_id long, chunk_id long, document_id string, file_name string, source_file_hash string, section_title string, "
    "sheet_name string, uploaded_category string, source_type string, content_type string, card_type string, "
    "topic_tags array<string>, primary_topic string, source_weight double, created_at timestamp, document_date date, "
    "score double, query_date date, query_topics array<string>, query_intent array<string>, is_settlement boolean, "
    "is_todo boolean, is_setting boolean, is_kakao boolean"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def candidates(spark, *rows):
    full = [{**BASE, **r} for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], SCHEMA)


def scored(spark, *rows):
    return scoring.score_candidates(candidates(spark, *rows), F.lit("2026-05-01"))


def first(spark, **r):
    return scored(spark, r).first()


@pytest.mark.parametrize(
    "chunk, asked, factor, label",
    [
        (date(2026, 4, 29), date(2026, 4, 29), 1.25, "exact"),
        (date(2026, 4, 28), date(2026, 4, 29), 0.55, "mismatch"),
        (None, date(2026, 4, 29), 0.775, "none"),
        (date(2026, 4, 28), None, 1.0, "none"),
    ],
)
def test_date_factor(spark, chunk, asked, factor, label):
    r = first(spark, document_date=chunk, query_date=asked)
    assert (r["date_boost"], r["date_match"]) == (pytest.approx(factor), label)


@pytest.mark.parametrize(
    "tags, asked, intents, source, factor, label",
    [
        (["Meta "], ["meta"], [], "guide", 1.2, "match"),
        (["kakao"], ["meta"], [], "guide", 0.8, "mismatch"),
        (["common"], ["meta"], [], "guide", 1.0, "neutral"),
        ([], ["meta"], [], "guide", 0.9, "none"),
        ([], ["meta"], ["procedure"], "guide", 0.95, "none"),
        ([], ["meta"], ["procedure"], "txt", 0.9, "none"),
        (["kakao"], [], [], "guide", 1.0, "none"),
    ],
)
def test_topic_factor(spark, tags, asked, intents, source, factor, label):
    r = first(spark, topic_tags=tags, query_topics=asked, query_intent=intents, source_type=source)
    assert (r["topic_boost"], r["topic_match"]) == (pytest.approx(factor), label)


def test_weights_and_clamps(spark):
    assert first(spark, source_weight=0.0)["source_weight"] == 0.5
    assert first(spark, score=-0.4)["final_score"] == 0.0
    assert first(spark, uploaded_category="slack", is_todo=True)["category_boost"] == pytest.approx(1.5)
    assert first(spark, content_type="note")["content_type_boost"] == 0.8
    ages = [(30, 0.97), (5, 1.0), (200, 0.93), (900, 0.85)]
    for days, want in ages:
        at = datetime.fromtimestamp(datetime(2026, 5, 1).timestamp() - days * 86400)
        assert first(spark, created_at=at)["recency"] == want
    assert first(spark, created_at=datetime(2030, 1, 1))["recency"] == 1.0


def roles(df):
    return {r["chunk_id"]: r for r in df.collect()}


def test_cards_lead_and_raw_rows_of_their_file_follow(spark):
    card = dict(chunk_id=1, content_type="normalized_document", source_type="llm_normalized", card_type="workflow", query_intent=["procedure"])
    got = roles(policy.normalized_priority(scored(spark, card, dict(chunk_id=2), dict(chunk_id=3, file_name="g", source_file_hash="x"), dict(chunk_id=4, file_name="g2"))))
    assert [got[i]["retrieval_role"] for i in (1, 2, 3, 4)] == ["primary_card", "raw_evidence", "raw_fallback", "raw_evidence"]
    assert got[1]["type_boost"] == pytest.approx(1.30 * 1.10) and got[1]["type_match"]
    assert got[2]["final_score"] == pytest.approx(0.85 * 0.8 * 1.05)
    off = roles(policy.normalized_priority(scored(spark, card, dict(chunk_id=2)), RetrievalConfig(prioritize_cards=False)))
    assert off[2]["retrieval_role"] == "raw_fallback" and off[1]["type_boost"] == 1.0


def test_mismatched_card_is_demoted(spark):
    card = dict(chunk_id=1, content_type="knowledge_card", card_type="faq", topic_tags=["kakao"], query_topics=["meta"])
    primary = dict(card, chunk_id=2, topic_tags=[], primary_topic="kakao")
    generic = dict(card, chunk_id=3, topic_tags=["common"])
    got = roles(policy.normalized_priority(scored(spark, card, primary, generic)))
    assert [got[i]["retrieval_role"] for i in (1, 2, 3)] == ["raw_fallback", "raw_fallback", "primary_card"]
    assert got[1]["topic_mismatch_demoted"] and got[1]["type_boost"] == 1.0


def test_threshold_reasons_and_cap(spark):
    rows = [dict(chunk_id=i, score=s) for i, s in ((1, 0.9), (2, 0.8), (3, 0.7), (4, 0.2))] + [dict(chunk_id=5, score=0.5, source_weight=0.4)]
    got = roles(policy.threshold_and_cap(scored(spark, *rows)))
    assert [got[i]["passed"] for i in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert got[3]["filter_reason"] == "file_cap_exceeded(max_per_file=2)"
    assert got[4]["filter_reason"] == "similarity(0.200) < min_similarity(0.35)"
    assert got[5]["filter_reason"].startswith("final_score(0.210) < min_final(0.30)")
    free = roles(policy.threshold_and_cap(scored(spark, *rows), RetrievalConfig(max_per_file=0)))
    assert free[3]["passed"]
    dated = roles(policy.threshold_and_cap(scored(spark, dict(document_date=date(2026, 1, 1), query_date=date(2026, 1, 2))), RetrievalConfig(date_filter=True)))
    assert dated[1]["filter_reason"] == "date_filter_excluded(query_date=2026-01-02, doc_date=2026-01-01)"


def test_diversity_counts_files_and_sections(spark):
    rows = scored(spark, dict(chunk_id=1, score=0.9), dict(chunk_id=2, score=0.8), dict(chunk_id=3, score=0.7, file_name="", section_title=""))
    got = roles(policy.diversity_penalty(policy.threshold_and_cap(rows)))
    assert [round(got[i]["diversity_bonus"], 6) for i in (1, 2, 3)] == [1.0, 0.63, 1.0]
    assert got[2]["final_score"] == pytest.approx(0.8 * 1.05 * (0.7 + 0.3 * 0.63))


def test_children_of_summaries(spark):
    parent = dict(chunk_id=1, content_type="excel_summary", sheet_name="a", score=0.9)
    kids = spark.createDataFrame(
        [(10 + i, 1, "b" if i == 0 else "a", "excel_raw_table", "excel", "kf") for i in range(4)],
        "chunk_id long, parent_chunk_id long, sheet_name string, content_type string, source_type string, file_name string",
    ).withColumns({"uploaded_category": F.lit("excel"), "source_weight": F.lit(0.95)})
    rows = policy.normalized_priority(scored(spark, parent, dict(chunk_id=11, score=0.1)))
    got = roles(policy.expand_children(rows, kids))
    assert sorted(got) == [1, 11, 12]  # sheet b is filtered before the limit; 11 is a candidate already
    assert got[12]["is_child"] and got[12]["score"] == pytest.approx(0.81)
    assert got[12]["final_score"] == pytest.approx(got[1]["final_score"] * 0.9) and got[12]["retrieval_role"] is None


def test_summary_has_a_row_for_every_question(spark):
    rows = policy.threshold_and_cap(policy.normalized_priority(scored(spark, dict(chunk_id=1), dict(chunk_id=2, score=0.1))))
    rows = rows.withColumn("rank_n", F.when(F.col("passed"), 1))
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    a, b = policy.retrieval_summary(asked, rows, 5).orderBy("query_id").collect()
    assert (a["candidate_count"], a["passed_count"], a["dropped_count"], a["fallback_count"]) == (2, 1, 1, 1)
    assert (b["candidate_count"], b["passed_count"]) == (0, 0)


def verdict(spark, rows, topics, n_cards=0):
    df = candidates(spark, *[dict(r, chunk_id=i, query_topics=topics) for i, r in enumerate(rows)]) if rows else candidates(spark, {}).limit(0)
    role = df.withColumn("retrieval_role", F.col("section_title"))
    s = spark.createDataFrame([(1, topics, len(rows), n_cards)], "query_id long, query_topics array<string>, passed_count long, card_candidate_count long")
    return evidence.evidence_policy(s, role).first()


def fallback(*tags):
    return dict(section_title="raw_fallback", topic_tags=list(tags))


def test_evidence_strength(spark):
    assert verdict(spark, [dict(section_title="primary_card")], ["meta"])["evidence_strength"] == "strong"
    assert verdict(spark, [dict(section_title="raw_evidence")], ["meta"])["evidence_strength"] == "medium"
    assert verdict(spark, [fallback("meta")], ["meta"])["evidence_strength"] == "medium"
    weak = verdict(spark, [fallback("kakao"), fallback("kakao"), fallback("common")], ["meta"], 1)
    assert weak["weak_evidence_warning"] and weak["fallback_mismatch_ratio"] == 1.0 and weak["evidence_strength"] == "insufficient"
    assert weak["raw_fallback_only_reason"] == "no_primary_normalized_document"
    assert verdict(spark, [fallback("kakao")], [])["evidence_strength"] == "weak"
    assert verdict(spark, [], ["meta"])["evidence_strength"] == "insufficient"


def test_budget_and_context(spark):
    blocks = spark.createDataFrame([(1, 1, 50), (1, 2, 10), (2, 1, 5), (2, 2, 5), (2, 3, 1)], "q int, n int, size int")
    kept = evidence.budget_pack(blocks, 10, F.col("size"), "n", ("q",))
    assert sorted((r["q"], r["n"]) for r in kept.collect()) == [(1, 1), (2, 1), (2, 2)]
    rows = candidates(spark, *[dict(chunk_id=i, card_type="faq") for i in range(3)]).withColumns(
        {"rank_n": F.col("chunk_id") + 1, "body": F.repeat(F.lit("x"), F.lit(9000)), "final_score": F.lit(0.5),
         "retrieval_role": F.when(F.col("chunk_id") == 0, "primary_card").otherwise("raw_evidence")})
    out = {r["lane"]: r for r in evidence.context_blocks(rows).collect()}
    assert len(out["primary_card"]["block"]) < 4200 + 400 and out["primary_card"]["block"].startswith("[ND #1]\n")
    assert out["raw_evidence"]["block"].startswith("[RAW #1]\n- file_name: f\n")
    text = evidence.context_text(evidence.context_blocks(rows)).first()
    assert text["context"].index("[ND #1]") < text["context"].index("[RAW #1]")


def test_answer_format_order(spark):
    q = spark.createDataFrame([(1, "용어 뜻"), (2, "오류 대응"), (3, "x"), (4, "x"), (5, "x")], "query_id long, question string")
    cards = spark.createDataFrame([(3, 1, "workflow", "Summary | procedure"), (4, 1, "unknown", ""), (4, 2, "decision", None)], "query_id long, rank_n int, card_type string, answer_use_cases string")
    got = {r["query_id"]: r["answer_format"] for r in evidence.answer_format(q, cards).collect()}
    assert got == {1: "glossary", 2: "troubleshooting", 3: "summary", 4: "compare", 5: "freeform_grounded"}


def test_request_gate(spark):
    r = spark.createDataFrame([("u1",), ("u2",), (None,)], "user string")
    empty = spark.createDataFrame([], "user string")
    assert evidence.request_gate(r, "user", empty).count() == 3
    assert evidence.request_gate(r, "user", spark.createDataFrame([("u2",), ("u2",)], "user string")).count() == 1
