import pytest
from pyspark.sql import functions as F

from loresmith.config import PrivacyPolicy
from loresmith.functions import dates, privacy, questions, text


def test_clean_text_rules(one):
    raw = "﻿가 <@U12>  and\t\tmore  \n\n\n\n<#C1|room> <https://x.example/a|here>\r\n"
    assert one(lambda c: text.clean_text(c, F.lit("text")), raw) == "가 [멘션] and more\n\n#room here (https://x.example/a)"
    assert one(lambda c: text.clean_text(c, F.lit("table")), "a\t\tb  \n c") == "a\t\tb\n c"


@pytest.mark.parametrize("n, want", [(10, "hello w..."), (3, "hel"), (50, "hello world again")])
def test_truncate(one, n, want):
    assert one(lambda c: text.truncate(c, n), "hello world again") == want


def test_clip_and_tokens(one):
    assert one(lambda c: text.clip(c, 6), "hello world") == "hello…"
    assert one(text.rough_token_count, "aaaaaaaaaa") == 4
    assert one(text.rough_token_count, "") == 0


@pytest.mark.parametrize(
    "raw, question, debug",
    [
        ("<@U123|bot>: 질문이요", "질문이요", False),
        ("<@U1> 봇아, 절차 알려줘 --debug", "절차 알려줘", True),
        (" ,.: hi --debugger", "hi --debugger", False),
        (None, "", False),
    ],
)
def test_clean_question(one, raw, question, debug):
    got = one(lambda c: text.clean_question(c, 100), raw)
    assert (got["question"], got["debug"]) == (question, debug)


def test_markup(one):
    answer = "## 1. 결론 ##\nbody **x**\n\n\n\nsee 참고 근거 here\n## 6. 참고 근거\n- a"
    assert one(text.markup_convert, answer) == "*1. 결론*\nbody **x**\n\nsee 참고 근거 here"
    assert one(text.trim_answer, "a\n\n*진단*\nrest") == "a"
    assert one(text.trim_answer, "a\nReferences\n- b") == "a"
    assert one(text.trim_answer, "a\nReferences\nare inline") == "a\nReferences\nare inline"


def test_links_and_mentions(one):
    assert one(privacy.mask_links_and_files, "see https://a.b/c?d and plan.xlsx, pic.PNG") == "see [링크] and [파일], [이미지]"
    assert one(privacy.mask_mentions, "@하늘[팀] and <@U1>") == "@담당자 and @담당자"


def test_names_get_stable_letters(one):
    got = one(privacy.pseudonymize_speakers, "박별[가]: hi\n김하늘[나]: ok\n박별[가] bye")
    assert got == "담당자 A: hi\n담당자 B: ok\n담당자 A bye"
    policy = PrivacyPolicy(author_hints=("박별",))
    assert one(lambda c: privacy.pseudonymize_speakers(c, policy), "박별[가] 김하늘[나]") == "작성자 담당자 A"


@pytest.mark.parametrize(
    "time, bucket",
    [("오전 10:02", "morning"), ("오후 1:50", "afternoon"), ("오후 6:45", "evening"), ("12:05 AM", "morning"), ("13:30", "afternoon"), ("", "unknown"), ("hello", "unknown"), ("25:10", "unknown")],
)
def test_time_bucket(one, time, bucket):
    assert one(privacy.time_bucket, time) == bucket


def test_times_and_dates(one):
    assert one(privacy.generalize_times, "[오후 6:45] x 9:05 AM") == "[퇴근 전] x [오전]"
    assert one(privacy.generalize_times, "[PM 6:45]") == "[오전]"  # a Latin mark in brackets is read as 24-hour
    assert one(privacy.generalize_dates, "2026년 4월 29일, 4/29 and 2026-04-29") == "해당 업무일, 해당 업무일 and 해당 업무일"


def test_policy_switches(one):
    raw = "박별[팀] https://a.b 10:02 4/29"
    assert one(lambda c: privacy.anonymize(c, PrivacyPolicy(anonymize=False)), raw) == raw
    shown = PrivacyPolicy(show_names=True, show_times=True, show_dates=True, mask_links=False)
    assert one(lambda c: privacy.anonymize(c, shown), raw) == raw
    hidden = one(privacy.anonymize, raw)
    for secret in ("박별", "a.b", "10:02", "4/29"):
        assert secret not in hidden


@pytest.mark.parametrize(
    "name, content, want, source",
    [
        ("[2026년 4월 29일 TODO].txt", "", "2026-04-29", "file_name"),
        ("2026_04_29_slack.txt", "", "2026-04-29", "file_name"),
        ("2026-13-45 4/29.txt", "", "2025-04-29", "file_name"),
        ("x.txt", "a\n4월 3일", "2025-04-03", "content_title"),
        ("x.txt", "\n" * 30 + "4월 3일", None, "unknown"),
        ("2026-02-30.txt", "", None, "unknown"),
    ],
)
def test_document_date(one, name, content, want, source):
    got = one(lambda a, b: dates.document_date(a, b, 2025), name, content)
    assert (str(got["document_date"]) if got["document_date"] else None, got["date_source"]) == (want, source)


def test_query_features(spark):
    df = spark.createDataFrame([(1, "카카오톡 발송 오류 4/29 어떻게"), (2, "")], "query_id long, question string")
    a, b = questions.query_features(df, 2026).orderBy("query_id").collect()
    assert str(a["query_date"]) == "2026-04-29" and a["query_topic"] == "kakao" and a["is_kakao"]
    assert a["query_intent"] == ["procedure", "issue_lookup"]
    assert b["query_date"] is None and b["query_topics"] == [] and not b["is_kakao"]


WIDE = "　  \u0085"


def test_white_space_of_any_kind(one):
    """Blanks beyond ASCII count as white space, as everywhere in Korean text."""
    assert one(text.strip, f"{WIDE}제목 하나{WIDE}") == "제목 하나"
    assert one(text.squeeze, f"{WIDE}a{WIDE}b\tc{WIDE}") == "a b c"
    assert one(text.rough_token_count, "a\u3000b\xa0c\u2003d e") == 5
    assert one(lambda c: text.drop_noise_lines(c, 1), f"x\n{WIDE}\ny") == "x\ny"
    assert one(lambda c: text.truncate(c, 8), f"abcd{WIDE}efgh") == "abcd..."


def test_edges_next_to_korean_particles(one):
    """A particle is part of the word before it: no edge between a date or file name and the particle."""
    assert one(privacy.generalize_dates, "4/29일 4/29 (4/29)") == "4/29일 해당 업무일 (해당 업무일)"
    assert one(privacy.mask_links_and_files, "파일.pdf를 sheet.xlsx.") == "파일.pdf를 [파일]."
    assert one(privacy.preview, f"<@U1AB> 김하늘[기획팀]:{WIDE}a.png 9:05") == "@담당자 담당자 A: [이미지] [오전]"
