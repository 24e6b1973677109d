"""Shared bindings: how the given tables stand in for questions, chunks, cards, files and threads.

Every rule exists twice, as a Spark expression and as SQL, and says the same in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def register(fn: QueryFn) -> QueryFn:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: list[str]) -> Column:
    """values[key mod n] as an expression."""
    n = len(values)
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(n)) + 1).cast("int"))


def sql_pick(key: str, values: list[str]) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][(({key}) % {len(values)} + 1)::INT]"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_case(expr: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {default} END"


# --- questions ------------------------------------------------------------------------------------------------------
QUESTION_TAILS = [
    "정산 방법 알려줘", "오늘 todo 뭐였어", "메타 캠페인 세팅 어떻게 진행", "카카오톡 발송 이슈", "월간 보고 설명",
    "유튜브 용어 정의", "plain question",
]
LANG_CATEGORY = {"en": "guide", "fr": "slack", "de": "kakao"}
CATEGORY_SOURCE = {"guide": "guide", "slack": "slack_manual", "kakao": "kakao"}
CONTENT_TYPES = ["text", "guide", "table", "conversation", "note", "excel_summary", "excel_raw_table"]
STAND_IN_CARD_TYPES = ["workflow", "checklist", "faq", "decision", "issue", "glossary"]
LABEL_TOPICS = ["meta", "kakao", "settlement", "outdoor", "report", "youtube", "common", "meta", "kakao", ""]
AS_OF = "2001-08-01"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as questions: a keyword tail by item, and every third one carries a date."""
    items = table(spark, sf_dir, "benchmark")
    dates = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")
    )
    dated = F.when((F.col("item_id") % 3 == 0) & F.col("d").isNotNull(), F.concat(F.lit(" "), "d")).otherwise("")
    return items.join(dates, "item_id", "left").select(
        F.col("item_id").alias("query_id"),
        F.concat("text", F.lit(" "), pick(F.col("item_id"), QUESTION_TAILS), dated).alias("question"),
    )


SQL_QUESTIONS = f"""questions AS (
  SELECT b.item_id AS query_id,
         b.text || ' ' || {sql_pick('b.item_id', QUESTION_TAILS)} ||
         CASE WHEN b.item_id % 3 = 0 AND o.o_orderdate IS NOT NULL
              THEN ' ' || strftime(o.o_orderdate, '%Y-%m-%d') ELSE '' END AS question
  FROM benchmark b LEFT JOIN orders o ON o.o_orderkey = b.item_id)"""


# --- texts ----------------------------------------------------------------------------------------------------------
# White space of any kind, as a class of the SQL engine's patterns.
SQL_SPACE = (
    "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
    "\\x{202f}\\x{205f}\\x{3000}]"
)


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_squeeze(e: str) -> str:
    return sql_strip(f"regexp_replace({e}, '{SQL_SPACE}+', ' ', 'g')")


def sql_mentions(e: str) -> str:
    return (
        f"regexp_replace(regexp_replace({e}, '<@[A-Z0-9]+>', '@담당자', 'g'), "
        "'@\\s*([가-힣A-Za-z0-9_]{2,30})(?:\\[([^\\[\\]]{1,30})\\])?', '@담당자', 'g')"
    )


# A word edge that is the same in both engines wherever the text before the name is ASCII.
def sql_links(e: str) -> str:
    for pattern, label in (
        ("(drive\\.google\\.com|docs\\.google\\.com)[^\\s)>\\]]*", "[링크]"),
        ("https?://[^\\s)>\\]]+", "[링크]"),
        ("(?i)\\b\\S+\\.(png|jpg|jpeg|gif|bmp|webp)\\b", "[이미지]"),
        ("(?i)\\b\\S+\\.(xlsx|xlsm|docx|pdf|csv)\\b", "[파일]"),
        ("\\b\\d+\\s*개\\s*파일", "[이미지/파일 첨부]"),
    ):
        e = f"regexp_replace({e}, '{pattern}', '{label}', 'g')"
    return e
