"""Closed domains, lookup tables and keyword dictionaries.

All of these are fixed values: results depend on them being exactly these.  Keyword dictionaries are only defaults;
every operator that uses one takes another as a parameter.
"""

from __future__ import annotations

# --- fixed values: closed domains -------------------------------------------------------------------------------
FILE_EXTENSIONS = ("xlsx", "xlsm", "docx", "txt", "md")
CATEGORIES = ("slack", "guide", "kakao", "excel", "misc")
CATEGORY_FOLDERS = {
    "slack": "slack_manual",
    "guide": "guide",
    "kakao": "kakao",
    "excel": "excel",
    "misc": "misc",
}
CATEGORY_LABELS = {
    "Slack 대화": "slack",
    "가이드": "guide",
    "카톡 대화": "kakao",
    "Excel": "excel",
    "기타": "misc",
}
CARD_TYPES = (
    "workflow",
    "issue",
    "checklist",
    "faq",
    "decision",
    "glossary",
    "communication_template",
    "context_note",
    "status_update",
    "action_item",
    "issue_log",
    "decision_log",
    "campaign_summary",
    "communication_history",
    "reference_note",
    "report_insight",
)
USE_CASES = (
    "procedure",
    "summary",
    "troubleshooting",
    "draft_message",
    "compare",
    "history_lookup",
    "checklist",
    "freeform_grounded",
)
CARD_CONTENT_TYPES = ("normalized_document", "knowledge_card")
CARD_SOURCE_TYPE = "llm_normalized"
GENERIC_TOPICS = ("common", "general", "shared", "misc", "etc", "none", "unknown", "공통", "기타")

# --- fixed values: weights ----------------------------------------------------------------------------------------
SOURCE_WEIGHTS = {
    "excel_summary": 1.1,
    "excel_raw_table": 0.95,
    "excel": 1.0,
    "guide": 1.0,
    "slack_manual": 0.8,
    "slack": 0.8,
    "word": 0.75,
    "markdown": 0.7,
    "txt": 0.65,
    "kakao": 0.45,
    "misc": 0.5,
}
DEFAULT_SOURCE_WEIGHT = 0.7
CATEGORY_BOOST = {"guide": 1.05, "excel": 1.05, "slack": 1.0, "kakao": 0.9, "misc": 0.9}
CLASS_MULTIPLIERS = {
    "is_settlement": {"guide": 1.30, "excel": 1.05, "slack": 0.90, "kakao": 0.80, "misc": 0.85},
    "is_todo": {"slack": 1.50, "guide": 0.85, "kakao": 0.95},
    "is_setting": {"slack": 1.10, "guide": 1.10},
    "is_kakao": {"slack": 1.15, "guide": 1.10, "kakao": 1.05},
}
CONTENT_BOOST = {
    "guide": 1.15,
    "excel_summary": 1.15,
    "excel_raw_table": 1.0,
    "table": 1.0,
    "text": 1.0,
    "conversation": 0.85,
    "note": 0.8,
}
RECENCY_STEPS = ((7, 1.0), (90, 0.97), (365, 0.93))
RECENCY_OLD = 0.85
CARD_TYPE_BOOST = {
    "workflow": 1.30,
    "checklist": 1.25,
    "faq": 1.20,
    "decision": 1.20,
    "communication_template": 1.20,
    "glossary": 1.10,
}
CARD_TYPE_INTENT = {
    "workflow": "procedure",
    "checklist": "procedure",
    "faq": "explanation",
    "decision": "explanation",
    "issue": "issue_lookup",
    "communication_template": "communication",
    "glossary": "glossary",
}
CARD_TYPE_USE_CASE = {
    "workflow": "procedure",
    "checklist": "checklist",
    "issue": "troubleshooting",
    "issue_log": "troubleshooting",
    "decision": "compare",
    "decision_log": "compare",
    "communication_template": "draft_message",
    "reference_note": "freeform_grounded",
    "status_update": "summary",
    "campaign_summary": "summary",
    "context_note": "summary",
    "action_item": "checklist",
    "communication_history": "history_lookup",
    "report_insight": "summary",
}

# --- fixed values: keyword dictionaries (ordered) -----------------------------------------------------------------
QUERY_CLASSES = {
    "is_settlement": (
        "정산", "세금계산서", "인보이스", "sf", "모비사인", "입금",
        "광고주 공유용", "공유용 정산", "재무팀", "발행 요청",
    ),
    # Fixed values; one word of the original list, a name of a person, is left out on purpose.
    "is_todo": ("오늘", "어제", "todo", "스레드", "말씀", "피드백", "오늘자", "당일", "어제자"),
    "is_setting": (
        "asc", "bau", "메타", "캠페인 세팅", "캠페인세팅", "광고세트",
        "컨첵시트", "컨첵 시트", "토글", "크첵",
    ),
    "is_kakao": ("카카오톡", "카카오 메시지", "카카오메시지", "카카오 발송", "발송"),
}
QUERY_TOPICS = {
    "meta": (
        "메타", "asc", "bau", "캠페인", "광고세트", "카탈로그", "컨첵", "크첵",
        "t&d", "td", "랜딩", "네이밍", "매핑", "토글",
    ),
    "kakao": ("카카오", "카카오톡", "카카오메시지", "메시지 발송", "발송", "잔액", "충전"),
    "settlement": ("정산", "세금계산서", "인보이스", "모비사인", "sf", "입금", "거래명세서"),
    "outdoor": ("옥외", "파르나스", "편성표", "구좌", "선입금"),
    "report": ("dr", "rd", "리포트", "월간보고", "월간 보고"),
    "nbt": ("nbt", "토스"),
    "greenp": ("그린피", "greenp"),
    "youtube": ("유튜브", "youtube", "구글 유튜브"),
}
SECTION_TOPICS = {
    **QUERY_TOPICS,
    "kakao": ("카카오", "카카오톡", "카카오메시지", "메시지", "발송", "잔액", "충전"),
    "common": ("광고주 공유", "노티", "메일 전달", "크첵"),
}
QUERY_INTENTS = {
    "procedure": (
        "순서", "프로세스", "어떻게 진행", "어떻게 해야", "방법", "단계",
        "가이드", "체크리스트", "셋팅", "세팅", "어떻게",
    ),
    "todo_lookup": ("그날", "놓치면 안", "놓치면 안되는", "놓치면 안 되는", "뭐였어", "뭐 였어", "todo", "할 일"),
    "explanation": ("설명", "차이", "이유", "원인", "왜"),
    "issue_lookup": (
        "이슈", "문제", "어려웠", "발생한", "발송 관련", "어땠어", "안 됨", "안됨", "실패", "오류",
    ),
    "communication": ("문안", "메일", "공유", "전달", "회신"),
    "glossary": ("용어", "무슨 뜻", "정의"),
}
ANSWER_INTENTS = {
    "draft_message": ("문안", "보낼 말", "메일", "슬랙", "공유문", "회신", "광고주에게"),
    "history_lookup": (
        "예전에", "과거", "이전", "전에", "히스토리", "비슷한 케이스", "유사 사례", "사례 있었", "비슷한 이슈",
    ),
    "troubleshooting": ("오류", "문제", "이슈", "안돼", "안 돼", "실패", "원인", "대응"),
    "compare": ("비교", "차이", "a안", "b안", "뭐가 나아", "추천"),
    "checklist": ("체크리스트", "확인할 것", "점검", "누락"),
    "summary": ("요약", "정리", "핵심", "현재 상황", "한눈에"),
    "procedure": ("방법", "절차", "어떻게", "세팅", "셋팅", "진행", "처리 순서"),
}
GLOSSARY_WORDS = QUERY_INTENTS["glossary"]

# --- fixed values: de-identification labels ------------------------------------------------------------------------
BUCKET_LABELS = {"morning": "오전", "afternoon": "오후", "evening": "퇴근 전", "unknown": "업무 시간대"}
ROLE_LABELS = {"author": "작성자", "reviewer": "검토자", "bot": "봇/채널", "participant": "담당자"}
MENTION_LABEL = "@담당자"
LINK_LABEL = "[링크]"
IMAGE_LABEL = "[이미지]"
FILE_LABEL = "[파일]"
ATTACHMENT_LABEL = "[이미지/파일 첨부]"

# --- fixed values: section-header phases (ordered; a line takes the first that fits) --------------------------------
TODO_PHASES = (
    (r"^\[?\s*\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일\s*TODO\s*\]?\s*$", "initial"),
    (r"^\d{1,2}/\d{1,2}\s+[^\n]*?오전\s*TODO\s*$", "morning"),
    (r"^\d{1,2}/\d{1,2}\s+[^\n]*?중간\s*TODO\s*$", "mid"),
    (r"^\d{1,2}/\d{1,2}\s+[^\n]*?퇴근[!]?\s*TODO\s*$", "end_of_day"),
    (r"^[^\n]*?(명일|내일)[^\n]*?TODO\s*$", "tomorrow"),
    (r"^\d{1,2}/\d{1,2}\s+[^\n]*?TODO\s*$", "initial"),
    (r"^\s*셋팅\s*내용\s*$", "mid"),
    (r"^\s*크첵\s*해주실\s*내용\s*$", "mid"),
    (r"^\s*\d+\.\s+.{0,80}원인\s*분석\s*$", "mid"),
    (r"^\s*\d+\.\s+.{0,80}운영\s*방향\s*제언\s*$", "mid"),
)

# --- fixed values: answer clean-up ---------------------------------------------------------------------------------
ANSWER_CUT_HEADINGS = (
    "참고 근거", "참고근거", "불확실한 부분", "불확실한부분", "진단", "진단 정보", "References", "Diagnostics",
)
INFORMAL_PREFIXES = ("봇아", "봇:", "bot:")
