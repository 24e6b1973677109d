"""Cleaning, de-identification, chunking and duplicates over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    CONTENT_TYPES,
    LANG_CATEGORY,
    SQL_SPACE,
    Registry,
    pick,
    sql_case,
    sql_links,
    sql_mentions,
    sql_pick,
    sql_squeeze,
    sql_strip,
    table,
)
from catalog.ranking import SQL_WEIGHT, sql_tags
from loresmith import vocab
from loresmith.config import ChunkConfig, PrivacyPolicy
from loresmith.functions import dates, hashing, privacy, text
from loresmith.functions.lookup import lookup, matching_tags
from loresmith.operators import chunking, dictionary
from loresmith.session import spread

REG = Registry()
NL = "chr(10)"
LINES = "regexp_split_to_array({}, '\\r\\n|\\n|\\r')"


def docs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", *cols))


def short(e: str, name: str) -> str:
    """Long texts are compared by length and hash."""
    return f"length({e}) AS {name}_len, sha256({e}) AS {name}_sha"


def short_cols(c, name: str):
    return [F.length(c).cast("long").alias(f"{name}_len"), F.sha2(c, 256).alias(f"{name}_sha")]


# Markup put around the text so that every cleaning rule has something to do.
def marked(text_col):
    return F.concat(
        F.lit("﻿<@U123AB> "), text_col, F.lit("  \t\n\n\n\n<#C12|general>​ see <https://a.example/x|the  page>\r\n")
    )


SQL_MARKED = """(chr(65279) || '<@U123AB> ' || text || '  ' || chr(9) || repeat(chr(10), 4) || '<#C12|general>' || chr(8203)
  || ' see <https://a.example/x|the  page>' || chr(13) || chr(10))"""


def sql_clean(e: str, kind: str) -> str:
    s = f"regexp_replace({e}, '[\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{feff}}]', '', 'g')"
    s = f"regexp_replace({s}, '\\r\\n|\\r', chr(10), 'g')"
    s = f"regexp_replace({s}, '<@[A-Z0-9]+>', '[멘션]', 'g')"
    s = f"regexp_replace({s}, '<#[A-Z0-9]+\\|([^>]+)>', '#\\1', 'g')"
    s = f"regexp_replace({s}, '<(https?://[^|>]+)\\|([^>]+)>', '\\2 (\\1)', 'g')"
    s = f"regexp_replace({s}, '[ \\t]+\\n', chr(10), 'g')"
    s = f"CASE WHEN {kind} IN ('table', 'excel_raw_table', 'conversation') THEN {s} ELSE regexp_replace({s}, '[ \\t]{{2,}}', ' ', 'g') END"
    return sql_strip(f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


KIND = sql_pick("doc_id", CONTENT_TYPES)


@REG.add(
    "t1_clean_text",
    f"SELECT doc_id, {short('c', 'clean')} FROM (SELECT doc_id, {sql_clean(f'nfc_normalize({SQL_MARKED})', KIND)} AS c FROM documents)",
)
def t1_clean_text(spark, sf):
    d = docs(spark, sf, "text")
    clean = text.clean_text(marked(F.col("text")), pick(F.col("doc_id"), CONTENT_TYPES))
    return d.select("doc_id", clean.alias("c")).select("doc_id", *short_cols(F.col("c"), "clean"))


@REG.add(
    "t2_shorten_urls",
    "SELECT page_id, 'see ' || regexp_replace(url, 'https?://([^\\s)/?#]+)[^\\s)]*', '[link:\\1]', 'g') || ' (end)' AS s FROM pages",
)
def t2_shorten_urls(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", text.shorten_urls(F.concat(F.lit("see "), "url", F.lit(" (end)"))).alias("s"))


@REG.add(
    "t3_drop_noise_lines",
    f"""SELECT doc_id, {short('s', 'kept')} FROM (
          SELECT doc_id, array_to_string([x for x in {LINES.format('text')} if length({sql_strip('x')}) >= 30], chr(10)) AS s
          FROM documents)""",
)
def t3_drop_noise_lines(spark, sf):
    d = docs(spark, sf, "text").select("doc_id", text.drop_noise_lines(F.col("text"), 30).alias("s"))
    return d.select("doc_id", *short_cols(F.col("s"), "kept"))


@REG.add(
    "t4_mask_mentions",
    f"SELECT doc_id, {short('s', 'masked')} FROM (SELECT doc_id, {sql_mentions(SQL_MARKED)} AS s FROM documents)",
)
def t4_mask_mentions(spark, sf):
    d = docs(spark, sf, "text").select("doc_id", privacy.mask_mentions(marked(F.col("text"))).alias("s"))
    return d.select("doc_id", *short_cols(F.col("s"), "masked"))


SQL_FILES = """(url || ' drive.google.com/d/' || page_id || ' pic' || page_id || '.PNG sheet_' || page_id || '.xlsx 3 개 파일 ' || url)"""


def files_text():
    n = F.col("page_id").cast("string")
    return F.concat(
        "url", F.lit(" drive.google.com/d/"), n, F.lit(" pic"), n, F.lit(".PNG sheet_"), n, F.lit(".xlsx 3 개 파일 "), "url"
    )


@REG.add(
    "t5_mask_links_and_files",
    f"SELECT page_id, {sql_links(SQL_FILES)} AS masked, sha256({sql_links('html')}) AS html_sha FROM pages",
)
def t5_mask_links_and_files(spark, sf):
    p = spread(table(spark, sf, "pages"))
    return p.select(
        "page_id", privacy.mask_links_and_files(files_text()).alias("masked"),
        F.sha2(privacy.mask_links_and_files(F.col("html")), 256).alias("html_sha"),
    )


NAMES = ["김하늘", "박별", "최바다솔", "정산들"]


def named_text():
    """Two name[team] marks around the text, the first repeated after it."""
    a, b = pick(F.col("doc_id"), NAMES), pick(F.col("doc_id") + 1, NAMES)
    return F.concat(a, F.lit("[기획팀]: "), "text", F.lit("\n"), b, F.lit("[개발팀]: ok\n"), a, F.lit("[기획팀] 끝"))


SQL_NAMED = f"""({sql_pick('doc_id', NAMES)} || '[기획팀]: ' || text || {NL} || {sql_pick('doc_id + 1', NAMES)} || '[개발팀]: ok' || {NL}
  || {sql_pick('doc_id', NAMES)} || '[기획팀] 끝')"""


@REG.add(
    "t6_pseudonymize_speakers",
    f"""SELECT doc_id, {short('s', 'masked')} FROM (
          SELECT doc_id, '담당자 A: ' || text || {NL} || '담당자 B: ok' || {NL} || '담당자 A 끝' AS s FROM documents)""",
)
def t6_pseudonymize_speakers(spark, sf):
    d = docs(spark, sf, "text").select("doc_id", privacy.pseudonymize_speakers(named_text()).alias("s"))
    return d.select("doc_id", *short_cols(F.col("s"), "masked"))


def sql_bucket(hour: str) -> str:
    return (
        f"CASE WHEN {hour} BETWEEN 0 AND 11 THEN 'morning' WHEN {hour} BETWEEN 12 AND 17 THEN 'afternoon' "
        f"WHEN {hour} BETWEEN 18 AND 23 THEN 'evening' ELSE 'unknown' END"
    )


SQL_LABEL = {k: f"'{v}'" for k, v in vocab.BUCKET_LABELS.items()}


def sql_label(bucket: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SQL_LABEL.items())
    return f"CASE {bucket} {arms} END"


def event_time():
    """Alternating 24-hour, Latin and Korean clock forms of the event time."""
    ts, n = F.col("ts"), F.col("event_id") % 3
    h12 = F.date_format(ts, "h:mm")
    noon = F.hour(ts) >= 12
    latin = F.concat(h12, F.when(noon, " PM").otherwise(" AM"))
    korean = F.concat(F.when(noon, "오후 ").otherwise("오전 "), h12)
    return F.when(n == 0, F.date_format(ts, "HH:mm")).when(n == 1, latin).otherwise(korean)


@REG.add(
    "t7_time_bucket",
    f"SELECT event_id, {sql_bucket('hour(ts)')} AS bucket, {sql_label(sql_bucket('hour(ts)'))} AS label FROM events",
)
def t7_time_bucket(spark, sf):
    bucket = privacy.time_bucket(event_time())
    return table(spark, sf, "events").select(
        "event_id", bucket.alias("bucket"), privacy.anonymize_timestamp(event_time()).alias("label")
    )


@REG.add(
    "t8_time_range_display",
    f"""SELECT conv_id, CASE WHEN n > 1 THEN a || ' · ' || b ELSE a END AS shown FROM (
          SELECT conv_id, {sql_label('first_bucket')} AS a, {sql_label('other_bucket')} AS b,
                 CASE WHEN other_bucket IS NULL THEN 1 ELSE 2 END AS n
          FROM (SELECT e.user_id AS conv_id, arg_min(b, event_id) AS first_bucket,
                       arg_min(b, event_id) FILTER (b <> fb) AS other_bucket
                FROM (SELECT *, {sql_bucket('hour(ts)')} AS b FROM events) e
                JOIN (SELECT user_id, arg_min({sql_bucket('hour(ts)')}, event_id) AS fb FROM events GROUP BY user_id) f
                  USING (user_id)
                GROUP BY e.user_id))""",
)
def t8_time_range_display(spark, sf):
    """First appearance of each bucket per user (reduced before the shuffle), then the display text."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), "event_id", privacy.time_bucket(event_time()).alias("b"))
    first = e.groupBy("conv_id", "b").agg(F.min("event_id").alias("at"))
    seen = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "b"))).alias("s"))
    return seen.select("conv_id", privacy.time_range_display(F.transform("s", lambda x: x["b"])).alias("shown"))


@REG.add(
    "t9_generalize_times",
    f"""SELECT event_id, '[' || l || '] start [' || l || ']end [' || l || '], at [' ||
               {sql_label(sql_bucket('hour(ts) % 12'))} || '] 1:2:30 99 [업무 시간대].' AS s
        FROM (SELECT event_id, ts, {sql_label(sql_bucket('hour(ts)'))} AS l FROM events)""",
)
def t9_generalize_times(spark, sf):
    """A Korean bracket, a bare clock, a Latin suffix, a Latin bracket (read as 24-hour) and an impossible hour."""
    ts = F.col("ts")
    noon, h12, h24 = F.hour(ts) >= 12, F.date_format(ts, "h:mm"), F.date_format(ts, "HH:mm")
    s = F.concat(
        F.lit("["), F.when(noon, "오후 ").otherwise("오전 "), h12, F.lit("] start "), h24, F.lit("  end "), h12,
        F.when(noon, " PM").otherwise("AM"), F.lit(", at [PM "), (F.hour(ts) % 12).cast("string"),
        F.lit(":05] 1:2:30 99 77:10."),
    )
    return table(spark, sf, "events").select("event_id", privacy.generalize_times(s).alias("s"))


@REG.add(
    "t10_generalize_dates",
    """SELECT o_orderkey, 'on 해당 업무일, 해당 업무일 and 해당 업무일 / 해당 업무일; 해당 업무일x 1/2345' AS s,
              CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE '해당 업무일' END AS shown,
              CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE CAST(o_orderdate::DATE AS VARCHAR) END AS shown_open
       FROM orders""",
)
def t10_generalize_dates(spark, sf):
    d = F.col("o_orderdate")
    # A four-digit year outside 20xx is only caught by the Korean form.
    y = F.lit("2024")
    s = F.concat(
        F.lit("on "), F.date_format(d, "yyyy년 M월 d일"), F.lit(", "), y, F.date_format(d, "-MM-dd"), F.lit(" and "),
        y, F.date_format(d, "/M/d"), F.lit(" / "), F.date_format(d, "M/d"), F.lit("; "), F.date_format(d, "yyyy 년 MM월dd일"),
        F.lit("x 1/2345"),
    )
    day = F.when(F.col("o_orderkey") % 7 != 0, d.cast("date"))
    return table(spark, sf, "orders").select(
        "o_orderkey", privacy.generalize_dates(s).alias("s"), privacy.display_date(day).alias("shown"),
        privacy.display_date(day, PrivacyPolicy(show_dates=True)).alias("shown_open"),
    )


@REG.add(
    "t11_anonymize",
    f"""SELECT doc_id, {short('s', 'safe')} FROM (
          SELECT doc_id, {sql_mentions(sql_links("('담당자 A: ' || text || chr(10) || '담당자 B: ok' || chr(10) || '담당자 A 끝')"))}
                 || ' [오전]on 해당 업무일' AS s FROM documents)""",
)
def t11_anonymize(spark, sf):
    s = F.concat(named_text(), F.lit(" [오전 9:30]on 2024년 5월 1일"))
    d = docs(spark, sf, "text").select("doc_id", privacy.anonymize(s).alias("s"))
    return d.select("doc_id", *short_cols(F.col("s"), "safe"))


@REG.add(
    "t12_truncate",
    """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, 297), '\\s+$', '') || '...' END AS dots,
              CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 119), '\\s+$', '') || '…' END AS clip,
              sha256(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 800) || chr(10) || chr(10)
                || '... (중략, 원본은 길어서 일부만 전달) ...' || chr(10) || chr(10) || right(text, 200) END) AS head_tail_sha
       FROM documents""",
)
def t12_truncate(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.truncate(t, 300).alias("dots"), text.clip(t, 120).alias("clip"),
        F.sha2(text.head_and_tail(t, 1000), 256).alias("head_tail_sha"),
    )


@REG.add(
    "t13_rough_token_count",
    f"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(
          len([w for w in regexp_split_to_array(text, '\\s+') if w <> '']), greatest(1, floor(length(text) / 2.5)::BIGINT)) END AS tokens
        FROM documents""",
)
def t13_rough_token_count(spark, sf):
    return docs(spark, sf, "text").select("doc_id", text.rough_token_count(F.col("text")).alias("tokens"))


@REG.add(
    "t15_clean_question",
    """WITH q AS (
         SELECT conv_id, turn, turn % 2 = 0 AS debug, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t
         FROM conversations WHERE role = 'user')
       SELECT conv_id, turn, substr(CASE WHEN debug THEN regexp_replace(t, '^[ ,.:;>]+', '') || ' more' ELSE t END, 1, 120) AS question,
              debug FROM q""",
)
def t15_clean_question(spark, sf):
    even = F.col("turn") % 2 == 0
    raw = F.when(even, F.concat(F.lit("<@U9ABC|bot>: 봇아, "), "text", F.lit("  --debug more"))).otherwise(
        F.concat(F.lit(" <@W1> "), "text")
    )
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    c = c.select("conv_id", "turn", text.clean_question(raw, 120).alias("q"))
    return c.select("conv_id", "turn", "q.question", "q.debug")


@REG.add(
    "t16_markup_convert",
    """WITH a AS (
         SELECT conv_id, turn, '## 1. 결론 ##' || chr(10) || text AS t FROM conversations WHERE role = 'assistant'),
       l AS (
         SELECT conv_id, turn, [CASE WHEN regexp_matches(x, '^\\s{0,3}#{1,6}\\s+')
                  THEN '*' || regexp_replace(regexp_replace(x, '^\\s{0,3}#{1,6}\\s+', ''), '\\s+#*\\s*$', '') || '*'
                  ELSE regexp_replace(x, '[ \\t\\r\\f]+$', '') END for x in string_split(t, chr(10))] AS xs FROM a)
       SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(xs, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'),
                '^\\s+|\\s+$', '', 'g') AS message FROM l""",
)
def t16_markup_convert(spark, sf):
    answer = F.concat(F.lit("## 1. 결론 ##\n"), "text", F.lit("\n\n\n\n### 6. 참고 근거\n- a.md\n"))
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", text.markup_convert(answer).alias("message"))


@REG.add(
    "t17_preview",
    f"""SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE regexp_replace(substr(s, 1, 239), '{SQL_SPACE}+$', '') || '…' END AS preview
        FROM (SELECT doc_id, {sql_squeeze(sql_mentions(sql_links("'@kim see https://a.example/x ' || text")))} AS s FROM documents)""",
)
def t17_preview(spark, sf):
    given = F.concat(F.lit("@kim see https://a.example/x "), "text")
    return docs(spark, sf, "text").select("doc_id", privacy.preview(given).alias("preview"))


# --- scalar parsers -----------------------------------------------------------------------------------------------------
NAME_FORMS = ["korean", "dash", "under", "monthday", "short", "bad", "content", "none"]


@REG.add(
    "p11_extract_document_date",
    """SELECT o_orderkey,
         CASE k WHEN 0 THEN d WHEN 1 THEN strftime(o_orderdate, '2024-%m-%d') WHEN 2 THEN strftime(o_orderdate, '2024-%m-%d')
                WHEN 6 THEN d WHEN 7 THEN '-'
                ELSE CASE WHEN leap THEN '-' ELSE strftime(o_orderdate, '2001-%m-%d') END END AS document_date,
         CASE WHEN k < 3 OR (k < 6 AND NOT leap) THEN 'file_name' WHEN k = 6 THEN 'content_title' ELSE 'unknown' END AS date_source
       FROM (SELECT *, o_orderkey % 8 AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%m-%d') = '02-29' AS leap FROM orders)""",
)
def p11_extract_document_date(spark, sf):
    """Names in every written form; an impossible date falls through to the next form; one date is on line 2 of the text.

    29 February is a date in 2024 and none in 2001.
    """
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    name = (
        F.when(k == 0, F.concat(F.lit("["), F.date_format(d, "yyyy년 M월 d일"), F.lit(" TODO].txt")))
        .when(k == 1, F.concat(F.lit("2024"), F.date_format(d, "-MM-dd"), F.lit(" plan.md")))
        .when(k == 2, F.concat(F.lit("2024"), F.date_format(d, "_MM_dd"), F.lit("_thread.txt")))
        .when(k == 3, F.concat(F.date_format(d, "M월 d일"), F.lit(" 회의.docx")))
        .when(k == 4, F.concat(F.date_format(d, "M/d"), F.lit(" notes")))
        .when(k == 5, F.concat(F.lit("2024-13-45 "), F.date_format(d, "M/d"), F.lit(".txt")))
        .otherwise("notes.txt")
    )
    body = F.when(k == 6, F.concat(F.lit("title\n"), F.date_format(d, "yyyy년 MM월 dd일"))).otherwise("title")
    late = F.when(k == 7, F.concat(F.lit("\n" * 25), F.date_format(d, "yyyy년 MM월 dd일"))).otherwise("")
    found = dates.document_date(name, F.concat(body, late), 2001)
    return table(spark, sf, "orders").select("o_orderkey", found.alias("f")).select(
        "o_orderkey", F.coalesce(F.col("f.document_date").cast("string"), F.lit("-")).alias("document_date"), "f.date_source"
    )


WORD_TOPICS = {"common": ("the ", "and "), "report": ("tion", "ment"), "meta": ("ouel", "ungh"), "kakao": ("ß",)}


@REG.add(
    "p12_detect_topic_tags",
    f"""SELECT doc_id, array_to_string(t, ',') AS tags, coalesce(t[1], '-') AS primary_topic
        FROM (SELECT doc_id, {sql_tags('lower(text)', WORD_TOPICS)} AS t FROM documents)""",
)
def p12_detect_topic_tags(spark, sf):
    d = docs(spark, sf, "text").select("doc_id", matching_tags(F.lower("text"), WORD_TOPICS).alias("t"))
    return d.select(
        "doc_id", F.array_join("t", ",").alias("tags"), F.coalesce(F.get("t", F.lit(0)), F.lit("-")).alias("primary_topic")
    )


# The words of the benchmark items, alone and in pairs, as a dictionary of twelve tags.
SQL_KEYWORDS = """w AS (SELECT item_id, string_split(lower(text), ' ') AS ws FROM benchmark),
dictionary AS (
  SELECT DISTINCT 'topic' || item_id % 12 AS tag, item_id % 12 AS tag_no, keyword
  FROM (SELECT item_id, unnest(ws) AS keyword FROM w
        UNION ALL
        SELECT item_id, ws[i] || ' ' || ws[i + 1] FROM (SELECT item_id, ws, unnest(range(1, len(ws))) AS i FROM w))
  WHERE keyword <> '')"""


def keyword_table(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id") % 12, F.split(F.lower("text"), " ")).toDF("tag_no", "ws")
    pairs = F.zip_with("ws", F.slice("ws", 2, F.size("ws")), lambda a, b: F.concat(a, F.lit(" "), b))
    keywords = F.explode(F.concat("ws", F.filter(pairs, lambda p: p.isNotNull())))
    return items.select("tag_no", F.concat(F.lit("topic"), "tag_no").alias("tag"), keywords.alias("keyword")).distinct()


@REG.add(
    "p12_tags_by_table",
    f"""WITH {SQL_KEYWORDS},
        tags AS (SELECT DISTINCT doc_id, tag_no, tag FROM documents JOIN dictionary ON contains(lower(text), keyword))
        SELECT d.doc_id, coalesce(string_agg(tag, ',' ORDER BY tag_no), '') AS tags, coalesce(arg_min(tag, tag_no), '-') AS primary_topic
        FROM documents d LEFT JOIN tags USING (doc_id) GROUP BY d.doc_id""",
)
def p12_tags_by_table(spark, sf):
    texts = docs(spark, sf, "text").select(F.col("doc_id").alias("text_id"), "text")
    found = dictionary.tags_in(texts, keyword_table(spark, sf))
    return found.select(
        F.col("text_id").alias("doc_id"), F.array_join("tags", ",").alias("tags"),
        F.coalesce(F.get("tags", F.lit(0)), F.lit("-")).alias("primary_topic"),
    )


@REG.add(
    "p12_keywords_by_table",
    f"""WITH {SQL_KEYWORDS}
        SELECT doc_id, count(DISTINCT keyword) AS n_keywords, md5(string_agg(DISTINCT keyword, '|' ORDER BY keyword)) AS keywords_md5
        FROM documents JOIN dictionary ON contains(lower(text), keyword) GROUP BY doc_id""",
)
def p12_keywords_by_table(spark, sf):
    texts = docs(spark, sf, "text").select(F.col("doc_id").alias("text_id"), "text")
    found = dictionary.keywords_in(texts, keyword_table(spark, sf)).groupBy("text_id").agg(F.sort_array(F.collect_list("keyword")).alias("k"))
    return found.select(F.col("text_id").alias("doc_id"), F.size("k").cast("long").alias("n_keywords"), F.md5(F.array_join("k", "|")).alias("keywords_md5"))


# --- chunks ---------------------------------------------------------------------------------------------------------------
SQL_HARD = """pieces AS (
  SELECT doc_id, i AS piece_no, substr(text, i * 1000 + 1, 1200) AS piece
  FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1200 THEN 1
               ELSE ceil((length(text) - 1200) / 1000.0)::BIGINT + 1 END)) AS i FROM documents))"""


@REG.add(
    "c1_hard_split",
    f"WITH {SQL_HARD} SELECT doc_id, piece_no, length(piece) AS n, sha256(piece) AS sha FROM pieces WHERE regexp_matches(piece, '\\S')",
)
def c1_hard_split(spark, sf):
    d = docs(spark, sf, "text").select("doc_id", F.posexplode_outer(chunking.hard_split(F.col("text"), 1200, 200)).alias("piece_no", "p"))
    d = d.where(F.col("p").isNotNull())
    return d.select("doc_id", F.col("piece_no").cast("long"), F.length("p").alias("n"), F.sha2("p", 256).alias("sha"))


# The packing as a recursive walk over lines: state = (next line, first line of the open chunk).
SQL_LINE_CHUNKS = f"""WITH RECURSIVE lines AS (
  SELECT doc_id, text, length(text) AS n_text, string_split(text, chr(10)) AS ls FROM documents),
walk AS (
  SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS buf, 0::BIGINT AS blen, []::VARCHAR[] AS done
  FROM lines WHERE n_text > 1200
  UNION ALL
  SELECT w.doc_id, w.i + 1,
    CASE WHEN length(l) + 1 > 1200 THEN [] WHEN full_up THEN tail || [l] ELSE buf || [l] END,
    CASE WHEN length(l) + 1 > 1200 THEN 0
         WHEN full_up THEN coalesce(list_sum([length(x) + 1 for x in tail]), 0) + length(l) + 1
         ELSE blen + length(l) + 1 END,
    CASE WHEN length(l) + 1 > 1200 THEN
           CASE WHEN len(buf) > 0 THEN [{sql_strip("array_to_string(buf, chr(10))")}] ELSE [] END
           || [substr(l, k * 1000 + 1, 1200) for k in
               range(0, CASE WHEN length(l) <= 1200 THEN 1 ELSE ceil((length(l) - 1200) / 1000.0)::BIGINT + 1 END)]
         WHEN full_up THEN [{sql_strip("array_to_string(buf, chr(10))")}] ELSE [] END
  FROM (SELECT *, blen + length(l) + 1 > 1200 AND len(buf) > 0 AS full_up,
               CASE WHEN len(buf) = 0 THEN [] ELSE
                 buf[(len(buf) - len([s for s in [list_sum([length(x) + 1 for x in buf[j:len(buf)]]) for j in range(1, len(buf) + 1)] if s <= 200]) + 1):len(buf)]
               END AS tail
        FROM (SELECT w.*, x.ls[w.i + 1] AS l FROM walk w JOIN lines x USING (doc_id) WHERE w.i < len(x.ls))) w),
emitted AS (
  SELECT doc_id, i, 0 AS last, done AS ps FROM walk
  UNION ALL
  SELECT w.doc_id, w.i, 1, CASE WHEN len(buf) > 0 THEN [{sql_strip("array_to_string(buf, chr(10))")}] ELSE [] END
  FROM walk w JOIN lines x USING (doc_id) WHERE w.i = len(x.ls)
  UNION ALL
  SELECT doc_id, 0, 0, CASE WHEN text = '' THEN [] ELSE [text] END FROM lines WHERE n_text <= 1200),
flat AS (SELECT doc_id, i, last, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM emitted)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, last, k) - 1 AS piece_no, length(piece) AS n,
       sha256(piece) AS sha
FROM flat WHERE n_text_ok(piece)"""
SQL_LINE_CHUNKS = SQL_LINE_CHUNKS.replace("n_text_ok(piece)", "regexp_matches(piece, '\\S')")


@REG.add("c2_line_chunks", SQL_LINE_CHUNKS)
def c2_line_chunks(spark, sf):
    d = docs(spark, sf, "text").select("doc_id", chunking.line_chunks(F.col("text")).alias("pieces"))
    d = d.select("doc_id", F.posexplode_outer("pieces").alias("piece_no", "p")).where(F.col("p").isNotNull())
    return d.select("doc_id", F.col("piece_no").cast("long"), F.length("p").alias("n"), F.sha2("p", 256).alias("sha"))


def two_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as two sections: its text, and the text again as a whole summary or a second text."""
    d = docs(spark, sf, "text").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), "doc_id", "text")
    kinds = F.array(F.lit("text"), F.when(F.col("doc_id") % 2 == 0, "excel_summary").otherwise("text"))
    return d.select(
        "document_id", F.posexplode(kinds).alias("section_no", "content_type"),
        F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("section_title"), F.col("text").alias("content"),
    )


@REG.add(
    "c3_chunk_policy",
    f"""WITH clean AS (SELECT doc_id, {sql_clean('text', "'text'")} AS c FROM documents),
        s AS (SELECT doc_id, c, 0 AS section_no, false AS whole FROM clean UNION ALL
              SELECT doc_id, c, 1, doc_id % 2 = 0 FROM clean),
        p AS (SELECT doc_id, section_no, whole, c, unnest(range(0, CASE WHEN whole OR length(c) <= 1200 THEN 1
                       ELSE ceil((length(c) - 1200) / 1000.0)::BIGINT + 1 END)) AS k FROM s WHERE c <> ''),
        t AS (SELECT doc_id, section_no, k, CASE WHEN whole THEN c ELSE substr(c, k * 1000 + 1, 1200) END AS piece FROM p)
        SELECT 'doc_' || doc_id AS document_id, section_no,
               row_number() OVER (PARTITION BY doc_id, section_no ORDER BY k) - 1 AS section_chunk_index,
               row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) - 1 AS chunk_index,
               length(piece) AS n, sha256(piece) AS sha
        FROM t WHERE regexp_matches(piece, '\\S')""",
)
def c3_chunk_policy(spark, sf):
    rows = chunking.chunk_pieces(two_sections(spark, sf), ChunkConfig(), normalize=False, policy="hard")
    return rows.select(
        "document_id", F.col("section_no").cast("long"), F.col("section_chunk_index").cast("long"), "chunk_index",
        F.length("piece").alias("n"), F.sha2("piece", 256).alias("sha"),
    )


@REG.add(
    "c4_context_header",
    f"""SELECT doc_id, '[파일명] ' || source || '.md' || {NL} || '[카테고리] ' || {sql_case('lang', LANG_CATEGORY, "'misc'")} || {NL}
               || '[출처] markdown' || {NL} || '[시트/섹션] -' || {NL} || '[콘텐츠유형] ' || {KIND} || {NL}
               || CASE WHEN doc_id % 2 = 0 THEN '[문서날짜] 2024-05-01' || {NL} ELSE '' END
               || CASE doc_id % 3 WHEN 1 THEN '[TODO단계] mid' || {NL} ELSE '' END
               || CASE WHEN doc_id % 5 = 0 THEN '[업무주제] meta' || {NL} || '[topic_tags] meta, kakao' || {NL} ELSE '' END
               || '[내용]' || {NL} AS header FROM documents""",
)
def c4_context_header(spark, sf):
    n = F.col("doc_id")
    header = chunking.context_header(
        F.concat("source", F.lit(".md")), lookup(F.col("lang"), LANG_CATEGORY, "misc"), F.lit("markdown"), F.lit(None),
        pick(n, CONTENT_TYPES), F.when(n % 2 == 0, "2024-05-01"), pick(n, ["unknown", "mid", ""]),
        F.when(n % 5 == 0, "meta"), F.when(n % 5 == 0, F.array(F.lit("meta"), F.lit("kakao"))),
    )
    return table(spark, sf, "documents").select("doc_id", header.alias("header"))


@REG.add(
    "c5_chunk_id",
    f"""WITH {SQL_HARD}, d AS (SELECT doc_id, 'doc_' || substr(sha256(sha256(text)), 1, 10) AS document_id FROM documents)
        SELECT doc_id, piece_no, substr(document_id, 1, 10) || '_' || printf('%05d', piece_no) || '_' || substr(sha256(piece), 1, 6) AS chunk_id,
               sha256(piece) AS chunk_hash FROM pieces JOIN d USING (doc_id) WHERE regexp_matches(piece, '\\S')""",
)
def c5_chunk_id(spark, sf):
    d = docs(spark, sf, "text").select(
        "doc_id", hashing.make_document_id(hashing.file_fingerprint(F.col("text"))).alias("document_id"),
        F.posexplode_outer(chunking.hard_split(F.col("text"), 1200, 200)).alias("piece_no", "p"),
    ).where(F.col("p").isNotNull())
    return d.select(
        "doc_id", F.col("piece_no").cast("long"), hashing.chunk_id(F.col("document_id"), F.col("piece_no"), F.col("p")).alias("chunk_id"),
        hashing.text_hash(F.col("p")).alias("chunk_hash"),
    )


SOURCE_KINDS = ["guide", "slack_manual", "word", "markdown", "txt", "unheard"]


@REG.add(
    "c6_source_weight",
    f"""SELECT doc_id, ({SQL_WEIGHT})::DOUBLE AS source_weight FROM (
          SELECT doc_id, {sql_pick('doc_id', SOURCE_KINDS)} AS source_type, {KIND} AS content_type,
                 {sql_case('lang', {**LANG_CATEGORY, 'es': 'elsewhere'}, "'misc'")} AS uploaded_category FROM documents)""",
)
def c6_source_weight(spark, sf):
    n, category = F.col("doc_id"), lookup(F.col("lang"), {**LANG_CATEGORY, "es": "elsewhere"}, "misc")
    weight = chunking.source_weight(pick(n, SOURCE_KINDS), pick(n, CONTENT_TYPES), category)
    return table(spark, sf, "documents").select("doc_id", weight.alias("source_weight"))


@REG.add(
    "c7_link_parent_child",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag AS sheet_name, count(*) AS n,
              CASE WHEN l.l_returnflag = 'R' THEN '-' ELSE 'sum' || l.l_orderkey || l.l_returnflag END AS parent_chunk_id
       FROM lineitem l GROUP BY l.l_orderkey, l.l_linenumber, l.l_returnflag""",
)
def c7_link_parent_child(spark, sf):
    """Orders give each document two summaries for sheet A (the first wins) and one for N; lineitems are raw rows."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"))
    summaries = o.select(
        "document_id",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("sheet_name"), F.lit(i).cast("long").alias("chunk_index"), F.lit(p).alias("p"))
                      for s, i, p in (("A", 1, "sum"), ("A", 2, "late"), ("N", 3, "sum"))])
        ).alias("s"),
    ).select(
        "document_id", "s.sheet_name", "s.chunk_index", F.lit("excel_summary").alias("content_type"),
        F.concat("s.p", "document_id", "s.sheet_name").alias("chunk_id"),
    )
    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_returnflag").alias("sheet_name"),
        F.col("l_linenumber").cast("long").alias("chunk_index"), F.lit("excel_raw_table").alias("content_type"),
        F.concat(F.lit("raw"), F.col("l_orderkey").cast("string")).alias("chunk_id"),
    )
    rows = chunking.link_parent_child(summaries.unionByName(raw)).where(F.col("content_type") == "excel_raw_table")
    return rows.groupBy(
        F.col("document_id").cast("long").alias("l_orderkey"), F.col("chunk_index").alias("l_linenumber"), "sheet_name",
        F.coalesce("parent_chunk_id", F.lit("-")).alias("parent_chunk_id"),
    ).agg(F.count("*").alias("n"))


@REG.add(
    "c8_dedup_exact",
    """SELECT doc_id, sha256(text) AS chunk_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""",
)
def c8_dedup_exact(spark, sf):
    d = docs(spark, sf, "text").select("doc_id", hashing.text_hash(F.col("text")).alias("chunk_hash"))
    return chunking.dedup_exact(d, "chunk_hash", [F.col("doc_id")], scope=())


@REG.add(
    "c8_dedup_report",
    """SELECT source, count(*) AS rows, count(DISTINCT sha256(text)) AS kept, count(*) - count(DISTINCT sha256(text)) AS dropped
       FROM documents GROUP BY source""",
)
def c8_dedup_report(spark, sf):
    d = docs(spark, sf, "source", "text").select("source", hashing.text_hash(F.col("text")).alias("chunk_hash"))
    return chunking.dedup_report(d, "chunk_hash", ("source",))
