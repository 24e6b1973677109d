"""Threads, chats, headings, tables and cards on literal files."""

import pytest
from pyspark.sql import functions as F

from loresmith.operators import cards, sections
from loresmith.sources import stores

THREAD = """[2026년 4월 29일 TODO]

Daily Channel  [오전 8:00]
good morning!

김하늘[기획팀]  [오전 10:02]
@박별[개발팀] 안녕하세요. 오늘 할 일 공유드려요.
- BAU 캠페인 시트 작성

박별[개발팀]  [오후 1:50]
@김하늘[기획팀] 확인했습니다.

4/29 kim 중간 TODO

셋팅 내용
- 네이밍 및 매핑
[09:12] lee: legacy form
choi 9:15 PM
late body
[오전 10:57] inline alone
4/29 kim 퇴근! TODO
- done
"""


def files(spark, text, name="[2026년 4월 29일].txt"):
    return spark.createDataFrame([("d1", name, "stem", text)], "document_id string, file_name string, file_stem string, text string")


def test_thread_messages(spark):
    rows = sections.thread_messages(files(spark, THREAD)).orderBy("msg_no").collect()
    said = [(r["speaker"], r["team"], r["time"], r["message"]) for r in rows]
    assert said[0] == ("(section_header)", "", "", "[2026년 4월 29일 TODO]\nDaily Channel  [오전 8:00]\ngood morning!")
    assert said[1] == ("김하늘", "기획팀", "오전 10:02", "@박별[개발팀] 안녕하세요. 오늘 할 일 공유드려요.\n- BAU 캠페인 시트 작성")
    assert said[2] == ("박별", "개발팀", "오후 1:50", "@김하늘[기획팀] 확인했습니다.")
    assert said[3][0] == said[4][0] == "(section_header)" and said[4][3] == "셋팅 내용\n- 네이밍 및 매핑"
    assert said[5] == ("lee", "", "09:12", "legacy form")
    assert said[6] == ("choi", "", "9:15 PM", "late body")
    assert said[7] == ("(unknown)", "", "오전 10:57", "inline alone")
    assert [r["phase"] for r in rows if r["is_section_header"]] == ["initial", "mid", "mid", "end_of_day"]


def test_thread_sections(spark):
    rows = sections.thread_sections(files(spark, THREAD), 2026).orderBy("block_index").collect()
    assert [r["section_title"] for r in rows] == ["[2026년 4월 29일 TODO]", "4/29 kim 중간 TODO", "셋팅 내용", "4/29 kim 퇴근! TODO"]
    first = rows[0]
    assert str(first["document_date"]) == "2026-04-29" and first["date_source"] == "file_name"
    assert first["display_speakers"] == ["담당자 A", "담당자 B"] and first["original_speakers"] == ["김하늘", "박별"]
    assert first["time_range_display"] == "오전 · 오후" and first["parser_format"] == "slack_todo_sections"
    for secret in ("김하늘", "박별", "10:02"):
        assert secret not in first["sanitized_content"] and secret in first["content"]
    assert "meta" in first["topic_tags"]


def test_header_cut_by_blank_line_is_lost(spark):
    rows = sections.thread_messages(files(spark, "lee 9:12 AM\n\nbody\nmore")).collect()
    assert [(r["speaker"], r["message"]) for r in rows] == [("(unknown)", "body\nmore")]


def test_unstructured_thread_is_one_block(spark):
    rows = sections.thread_sections(files(spark, "just a note\nwith 2 lines 3/4"), 2026).collect()
    assert len(rows) == 1 and rows[0]["parser_format"] == "fallback_block" and rows[0]["section_title"] == "stem"
    assert "해당 업무일" in rows[0]["sanitized_content"]


def test_long_section_is_cut_into_blocks(spark):
    text = "4/29 kim TODO\n" + "\n".join(f"[09:{i % 60:02d}] lee: m{i}" for i in range(95))
    rows = sections.thread_sections(files(spark, text), 2026).orderBy("sub_block_index").collect()
    assert [r["message_count"] for r in rows] == [40, 40, 16]
    assert rows[2]["section_title"] == "4/29 kim TODO (계속 3)"


def test_chat_export(spark):
    text = "loose start\n--------------- 2025년 5월 1일 목요일 ---------------\n2025년 5월 1일 오후 2:13, 김민 : 첫 줄\n둘째 줄\n[이수] [오전 9:05] hi\n\n"
    rows = sections.chat_export_messages(files(spark, text)).orderBy("msg_no").collect()
    assert [(r["speaker"], r["datetime"], r["date_section"], r["message"]) for r in rows] == [
        ("(unknown)", "", "", "loose start"),
        ("김민", "2025년 5월 1일 오후 2:13", "2025년 5월 1일 목요일", "첫 줄\n둘째 줄"),
        ("이수", "오전 9:05", "2025년 5월 1일 목요일", "hi"),
    ]
    block = sections.chat_sections(files(spark, text)).first()
    assert block["message_count"] == 3 and block["content"].endswith("[오전 9:05 이수] hi")
    assert sections.chat_sections(files(spark, " \n ")).count() == 0


def test_headings(spark):
    rows = sections.heading_sections(files(spark, "intro\n# A\nbody a\n## \n### B\n\n")).orderBy("section_no").collect()
    assert [(r["section_title"], r["heading_level"], r["content"]) for r in rows] == [("stem", 0, "intro"), ("A", 1, "body a")]
    alone = sections.heading_sections(files(spark, "# only\n## heads")).collect()
    assert [(r["section_title"], r["content"]) for r in alone] == [("stem", "# only\n## heads")]
    assert sections.plain_text_sections(files(spark, "  ")).count() == 0


def test_table_cells(spark):
    df = spark.createDataFrame([(1.0, None, " x "), (1.5, "y" * 300, None), (None, None, " ")], "a double, b string, c string")
    rows = [r["row_text"] for r in sections.table_rows_to_text(df).collect()]
    assert rows[0] == "1\t\tx" and rows[1] == "1.5\t" + "y" * 197 + "..." and len(rows) == 2


RESPONSES = {
    "empty": "  ", "not_json": "oops {", "not_object": "[1]", "no_cards": '{"x": 1}', "cards_not_list": '{"cards": "x"}',
}


@pytest.mark.parametrize("status", list(RESPONSES))
def test_malformed_responses(spark, status):
    df = spark.createDataFrame([(RESPONSES[status],)], "response string")
    assert cards.parse_cards(df).first()["parse_status"] == status


def coerced(spark, response, kind="guide"):
    df = spark.createDataFrame([(response,)], "response string").withColumns(
        {"kind": F.lit(kind), "file_name": F.lit("f.md"), "file_hash": F.lit("hh"), "file_hash_short": F.lit("h"),
         "source_category": F.lit("guide"), "source_type": F.lit("guide"), "document_date": F.lit(None).cast("date"),
         "display_date": F.lit(None).cast("string"), "input_topic_tags": F.array(F.lit(" in "), F.lit("a"))})
    return cards.coerce_cards(cards.parse_cards(df))


def test_cards_are_coerced(spark, tmp_path):
    response = '```json\n{"cards": [{"card_type": "Nope", "title": " ", "summary": "s", "topic_tags": "a", "steps": ["x", null, " "],' \
        ' "evidence_spans": [{"section": "sec", "chunk_index": "2", "text": "q"}, 5]}, 7, {"card_type": "FAQ", "title": "t", "summary": ""}]}\n```'
    a, b = coerced(spark, response).orderBy("card_no").collect()
    assert (a["card_id"], a["title"], a["topic_tags"], a["steps"]) == ("kc_h_000_workflow", "(제목 없음)", ["a"], ["x"])
    assert [tuple(s) for s in a["evidence_spans"]] == [("sec", 2, "q")]
    assert b["card_id"] == "kc_h_002_faq"
    assert "1. x" in a["sanitized_markdown"] and "- section: sec, chunk_index: 2, summary: q" in a["sanitized_markdown"]
    slack = coerced(spark, response, "slack").orderBy("card_no").first()
    assert slack["card_type"] == "issue" and slack["topic_tags"] == ["a", "in"]
    rows = coerced(spark, response)
    assert [r[0] for r in rows.orderBy("card_no").select(cards.is_valid_card()).collect()] == [True, False]
    raw = spark.createDataFrame([("doc", i, f"c{i}") for i in range(5)], "document_id string, chunk_index int, chunk_id string")
    chunk = cards.cards_to_chunks(rows.withColumn("document_id", F.lit("doc")), raw).collect()
    assert len(chunk) == 1 and chunk[0]["parent_raw_chunk_ids"] == ["c0", "c1", "c2"] and chunk[0]["source_weight"] == 1.25
    path = str(tmp_path / "cards")
    stores.write_cards(rows, path)
    assert stores.read_cards(spark, path).count() == 2


def test_card_cap(spark):
    many = '{"cards": [' + ", ".join('{"title": "t"}' for _ in range(40)) + "]}"
    assert coerced(spark, many).count() == 30


def test_card_search(spark):
    rows = coerced(spark, '{"cards": [{"title": "Alpha", "summary": "s", "steps": ["Find ME"]}, {"title": "b", "summary": "s", "primary_topic": "meta"}]}')
    assert cards.filter_cards(rows, query=" find me ").count() == 1
    assert cards.filter_cards(rows, primary_topic="unknown").count() == 1
    assert cards.filter_cards(rows, card_type="전체", source_file_name="f.md").count() == 2
    stats = {(r["facet"], r["name"]): r["n"] for r in cards.card_stats(rows).collect()}
    assert stats[("total", "all")] == 2 and stats[("primary_topic", "unknown")] == 1


def test_long_chat_with_a_divider_before_every_message(spark):
    """The last divider is found in one pass: a file of many dividers is as quick, message for message, as a short one."""
    lines = ["[이수] [오전 9:00] before any divider"]
    for i in range(12_000):
        lines += [f"--------------- 2026년 4월 {i % 28 + 1}일 ---------------", f"[이수] [오전 9:{i % 60:02d}] message {i}"]
    files = spark.createDataFrame([("d", "\n".join(lines))], "document_id string, text string")
    got = sections.chat_export_messages(files).select("msg_no", "date_section", "message").collect()
    days = {r["msg_no"]: r["date_section"] for r in got}
    assert len(days) == 12_001 and not days[0]
    assert len(set(days.values())) == 29 and days[1] == days[29] != days[2]
