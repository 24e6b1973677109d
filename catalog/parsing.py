"""Section building over texts rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import Registry, table
from catalog.ranking import sql_date, sql_tags
from catalog.texts import docs, short, short_cols, sql_bucket, sql_label, sql_links, sql_mentions, sql_strip
from loresmith.operators import sections

REG = Registry()


def rendered(rules) -> F.Column:
    """documents.text with markup put before lines that start in a given way."""
    t = F.col("text")
    for start, before in rules:
        t = F.regexp_replace(t, f"(?m)^({start})", before + "$1")
    return t


def sql_rendered(rules) -> str:
    e = "text"
    for start, before in rules:
        text = before.replace("\n", "' || chr(10) || '")
        e = f"regexp_replace({e}, '(?m)^({start})', '{text}' || '\\1', 'g')"
    return e


def files(spark: SparkSession, sf: str, text) -> DataFrame:
    return docs(spark, sf, "source", "text").select(
        F.col("doc_id").alias("document_id"), F.concat("source", F.lit(".txt")).alias("file_name"),
        F.col("source").alias("file_stem"), text.alias("text"),
    )


@REG.add(
    "p1_plain_text_sections",
    f"""SELECT doc_id AS document_id, source AS section_title, length(s) AS char_count, sha256(s) AS sha
        FROM (SELECT doc_id, source, {sql_strip('text')} AS s FROM documents) WHERE s <> ''""",
)
def p1_plain_text_sections(spark, sf):
    out = sections.plain_text_sections(files(spark, sf, F.col("text")))
    return out.select("document_id", "section_title", "char_count", F.sha2("content", 256).alias("sha"))


HEADS = (("Th", "# About "), ("An?d? ", "### "), ("La", "## "), ("In", "#### \n"))
SQL_HEADS = f"""t AS (SELECT doc_id, source, {sql_strip(sql_rendered(HEADS))} AS text FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t WHERE text <> ''),
m AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+') AS h,
             sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l),
s AS (SELECT doc_id, g, any_value(source) AS source, max(CASE WHEN h THEN line END) AS head,
             {sql_strip("coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY i), '')")} AS body
      FROM m GROUP BY doc_id, g)"""


@REG.add(
    "p2_heading_sections",
    f"""WITH {SQL_HEADS}
        SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS section_no,
               CASE WHEN head IS NULL THEN source
                    ELSE coalesce(nullif({sql_strip("regexp_extract(head, '^(#{1,6})\\s+(.*)$', 2)")}, ''), source) END AS section_title,
               CASE WHEN head IS NULL THEN 0 ELSE length(regexp_extract(head, '^(#{{1,6}})', 1)) END AS heading_level,
               {short('body', 'body')}
        FROM s WHERE body <> ''
        UNION ALL
        SELECT doc_id, 0, source, 0, {short('text', 'body')} FROM t
        WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM s WHERE body <> '')""",
)
def p2_heading_sections(spark, sf):
    out = sections.heading_sections(files(spark, sf, rendered(HEADS)))
    return out.select(
        "document_id", F.col("section_no").cast("long"), "section_title", "heading_level", *short_cols(F.col("content"), "body")
    )


CHAT = (
    ("Th", "[kim] [오후 2:13] "),
    ("An", "2024년 5월 1일 오전 9:05, lee : "),
    ("La", "------- 2024년 5월 2일 목요일 -------\n"),
    ("In", "\n"),
)
SQL_CHAT = f"""l AS (
  SELECT doc_id, unnest(string_split({sql_rendered(CHAT)}, chr(10))) AS raw,
         generate_subscripts(string_split({sql_rendered(CHAT)}, chr(10)), 1) AS i FROM documents),
k AS (
  SELECT doc_id, i, {sql_strip('raw')} AS x FROM l WHERE {sql_strip('raw')} <> ''),
c AS (
  SELECT *, CASE WHEN regexp_matches(x, '^-{{3,}}\\s*\\d{{4}}년\\s*\\d{{1,2}}월\\s*\\d{{1,2}}일.*?\\s*-{{3,}}') THEN 'd'
                 WHEN starts_with(x, '2024년 5월 1일 오전 9:05, lee : ') THEN 'a'
                 WHEN starts_with(x, '[kim] [오후 2:13] ') THEN 'b' ELSE 'o' END AS kind FROM k),
s AS (
  SELECT *, kind IN ('a', 'b') OR (kind = 'o' AND row_number() OVER w = 1) AS opens, last_value(
           CASE WHEN kind = 'd' THEN '2024년 5월 2일 목요일' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS day
  FROM c WINDOW w AS (PARTITION BY doc_id, kind = 'd' ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS msg_no FROM s),
messages AS (
  SELECT doc_id, msg_no, arg_min(kind, i) AS kind, coalesce(arg_min(coalesce(day, ''), i), '') AS date_section,
         string_agg(CASE WHEN opens AND kind = 'a' THEN {sql_strip("replace(x, '2024년 5월 1일 오전 9:05, lee : ', '')")}
                         WHEN opens AND kind = 'b' THEN {sql_strip("replace(x, '[kim] [오후 2:13] ', '')")} ELSE x END,
                    chr(10) ORDER BY i) AS message
  FROM g WHERE kind <> 'd' AND msg_no >= 0 GROUP BY doc_id, msg_no)"""


@REG.add(
    "p3_chat_export_messages",
    f"""WITH {SQL_CHAT}
        SELECT doc_id AS document_id, msg_no::BIGINT AS msg_no, date_section,
               CASE kind WHEN 'a' THEN '2024년 5월 1일 오전 9:05' WHEN 'b' THEN '오후 2:13' ELSE '' END AS datetime,
               CASE kind WHEN 'a' THEN 'lee' WHEN 'b' THEN 'kim' ELSE '(unknown)' END AS speaker, {short('message', 'm')}
        FROM messages""",
)
def p3_chat_export_messages(spark, sf):
    out = sections.chat_export_messages(files(spark, sf, rendered(CHAT)))
    return out.select("document_id", "msg_no", "date_section", "datetime", "speaker", *short_cols(F.col("message"), "m"))


@REG.add(
    "p3_chat_sections",
    f"""WITH {SQL_CHAT},
        lines AS (SELECT doc_id, msg_no, msg_no // 5 AS block_no, CASE kind WHEN 'a' THEN '2024년 5월 1일 오전 9:05' WHEN 'b' THEN '오후 2:13' ELSE '' END AS dt,
                         CASE kind WHEN 'a' THEN '[2024년 5월 1일 오전 9:05 lee] ' WHEN 'b' THEN '[오후 2:13 kim] ' ELSE '[(unknown)] ' END || message AS line FROM messages)
        SELECT doc_id AS document_id, block_no::BIGINT AS block_no, '카톡대화 블록 ' || (block_no + 1)::BIGINT AS section_title, count(*) AS message_count,
               arg_min(dt, msg_no) AS first_dt, arg_max(dt, msg_no) AS last_dt,
               sha256({sql_strip("string_agg(line, chr(10) ORDER BY msg_no)")}) AS sha
        FROM lines GROUP BY doc_id, block_no""",
)
def p3_chat_sections(spark, sf):
    out = sections.chat_sections(files(spark, sf, rendered(CHAT)), block=5)
    return out.select(
        "document_id", "block_no", "section_title", "message_count", "first_dt", "last_dt", F.sha2("content", 256).alias("sha")
    )


# Every thread form appears: team header and body, header cut off by a blank, bracket form, name-and-time header, inline
# time after a header and alone, section headers.
THREAD = (
    ("The", "홍길동[개발팀]  [오전 10:02]\n"),
    ("Thi", "홍길동[개발팀]  [오전 10:02]\n\n"),
    ("In", "[09:12] kim lee: "),
    ("La", "lee 9:12 AM\n"),
    ("Le", "choi 1:30 pm\n[오후 1:50] @kim "),
    ("Un", "[14:05] "),
    ("An", "4/29 kim 중간 TODO\n"),
    ("Di", "[2024년 5월 1일 TODO]\n"),
)
SQL_SECTION = f"""CASE WHEN line = '[2024년 5월 1일 TODO]' THEN 'initial' WHEN line = '4/29 kim 중간 TODO' THEN 'mid' END"""
SQL_THREAD = f"""t AS (SELECT doc_id, source, {sql_strip(sql_rendered(THREAD))} AS text FROM documents),
l AS (SELECT doc_id, {sql_strip('unnest(string_split(text, chr(10)))')} AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
k AS (SELECT *, {SQL_SECTION} AS phase,
        CASE WHEN line = '' THEN 'blank' WHEN {SQL_SECTION} IS NOT NULL THEN 'section'
             WHEN line = '홍길동[개발팀]  [오전 10:02]' THEN 'team'
             WHEN regexp_matches(line, '^\\[(\\d{{1,2}}:\\d{{2}}(?:\\s*[APap][Mm])?)\\]\\s+([^:]+?):\\s*(.*)$') THEN 'bracket'
             WHEN regexp_matches(line, '^([^\\s].{{0,40}}?)\\s+(\\d{{1,2}}:\\d{{2}}\\s*[APap][Mm])\\s*$') THEN 'time'
             WHEN regexp_matches(line, '^\\[(오전|오후|AM|PM|am|pm)?\\s*(\\d{{1,2}}):(\\d{{2}})\\s*\\]\\s*(.*)$') THEN 'inline'
             ELSE 'loose' END AS kind FROM l),
p AS (SELECT *, lag(kind) OVER w AS pk, lag(line) OVER w AS pl FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT *, kind IN ('section', 'bracket', 'inline') OR (kind = 'loose' AND coalesce(pk IN ('team', 'time'), false)) AS opens0 FROM p),
o2 AS (SELECT *, opens0 OR (kind = 'loose' AND NOT opens0
          AND sum(CASE WHEN opens0 OR kind = 'loose' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) = 1) AS opens FROM o),
g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS msg_no FROM o2),
heads AS (
  SELECT doc_id, msg_no, i, kind, phase, line, pk, pl,
         CASE WHEN kind = 'section' THEN '(section_header)'
              WHEN kind = 'bracket' THEN {sql_strip("regexp_extract(line, '^\\[(\\d{1,2}:\\d{2}(?:\\s*[APap][Mm])?)\\]\\s+([^:]+?):\\s*(.*)$', 2)")}
              WHEN pk = 'team' THEN '홍길동' WHEN pk = 'time' THEN {sql_strip("regexp_extract(pl, '^([^\\s].{0,40}?)\\s+(\\d{1,2}:\\d{2}\\s*[APap][Mm])\\s*$', 1)")}
              ELSE '(unknown)' END AS speaker,
         CASE WHEN kind IN ('inline', 'loose') AND pk = 'team' THEN '개발팀' ELSE '' END AS team,
         CASE WHEN kind = 'section' THEN ''
              WHEN kind = 'bracket' THEN regexp_extract(line, '^\\[(\\d{{1,2}}:\\d{{2}}(?:\\s*[APap][Mm])?)\\]', 1)
              WHEN kind = 'inline' THEN trim(regexp_extract(line, '^\\[(오전|오후|AM|PM|am|pm)?\\s*(\\d{{1,2}}):(\\d{{2}})', 1) || ' ' ||
                   regexp_extract(line, '^\\[(오전|오후|AM|PM|am|pm)?\\s*(\\d{{1,2}}:\\d{{2}})', 2))
              WHEN pk = 'team' THEN '오전 10:02'
              WHEN pk = 'time' THEN regexp_extract(pl, '(\\d{{1,2}}:\\d{{2}}\\s*[APap][Mm])\\s*$', 1) ELSE '' END AS time,
         CASE WHEN kind = 'bracket' THEN {sql_strip("regexp_extract(line, '^\\[(\\d{1,2}:\\d{2}(?:\\s*[APap][Mm])?)\\]\\s+([^:]+?):\\s*(.*)$', 3)")}
              WHEN kind = 'inline' THEN {sql_strip("regexp_extract(line, '^\\[(오전|오후|AM|PM|am|pm)?\\s*(\\d{1,2}):(\\d{2})\\s*\\]\\s*(.*)$', 4)")}
              ELSE line END AS first_text
  FROM g WHERE opens),
more AS (SELECT doc_id, msg_no, string_agg(line, chr(10) ORDER BY i) AS rest FROM g WHERE NOT opens AND kind = 'loose' AND msg_no >= 0
         GROUP BY doc_id, msg_no),
msg0 AS (
  SELECT h.*, first_text || CASE WHEN rest IS NULL THEN '' ELSE chr(10) || rest END AS message,
         sum(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY h.doc_id ORDER BY h.msg_no) AS passed,
         max(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY h.doc_id) AS any_head,
         first_value(kind) OVER (PARTITION BY h.doc_id ORDER BY h.msg_no) AS first_kind
  FROM heads h LEFT JOIN more USING (doc_id, msg_no)),
msg AS (
  SELECT *, CASE WHEN any_head = 0 THEN 0 WHEN first_kind <> 'section' THEN passed ELSE passed - 1 END AS section_no,
         row_number() OVER (PARTITION BY doc_id, passed ORDER BY msg_no) - 1 AS pos,
         CASE WHEN any_head = 0 THEN 'Slack 대화' WHEN passed = 0 THEN 'Slack 인트로'
              ELSE first_value(line) OVER (PARTITION BY doc_id, passed ORDER BY msg_no) END AS title,
         CASE WHEN passed = 0 THEN 'unknown' ELSE first_value(phase) OVER (PARTITION BY doc_id, passed ORDER BY msg_no) END AS todo_phase
  FROM msg0)"""


@REG.add(
    "p4_thread_messages",
    f"""WITH {SQL_THREAD}
        SELECT doc_id AS document_id, msg_no::BIGINT AS msg_no, speaker, team, time, coalesce(phase, '-') AS phase,
               kind = 'section' AS is_section_header, {short('message', 'm')} FROM msg""",
)
def p4_thread_messages(spark, sf):
    out = sections.thread_messages(files(spark, sf, rendered(THREAD)))
    return out.select(
        "document_id", "msg_no", "speaker", "team", "time", F.coalesce("phase", F.lit("-")).alias("phase"),
        "is_section_header", *short_cols(F.col("message"), "m"),
    )


PHASE_LINES = [
    ("[{y}년 {m}월 {d}일 TODO]", "initial"), ("{m}/{d} kim 오전 TODO", "morning"), ("{m}/{d} kim 중간 TODO", "mid"),
    ("{m}/{d} kim 퇴근! TODO", "end_of_day"), ("kim 명일 TODO", "tomorrow"), ("{m}/{d} kim TODO", "initial"),
    ("셋팅 내용", "mid"), ("{d}. 성과 원인 분석", "mid"), ("TODO {m}/{d}", "-"),
]


@REG.add(
    "p5_todo_phase",
    f"""SELECT o_orderkey, ['{"', '".join(p for _, p in PHASE_LINES)}'][o_orderkey % {len(PHASE_LINES)} + 1] AS phase FROM orders""",
)
def p5_todo_phase(spark, sf):
    """Header lines of every kind, dated by the order."""
    d = F.col("o_orderdate")
    parts = {"{y}": F.date_format(d, "yyyy"), "{m}": F.date_format(d, "M"), "{d}": F.date_format(d, "d")}
    lines = []
    for pattern, _ in PHASE_LINES:
        line = F.lit(pattern)
        for mark, value in parts.items():
            line = F.replace(line, F.lit(mark), value)
        lines.append(line)
    line = F.element_at(F.array(*lines), (F.col("o_orderkey") % len(PHASE_LINES) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(sections.todo_phase(line), F.lit("-")).alias("phase"))


@REG.add(
    "p6_thread_sections",
    f"""WITH {SQL_THREAD},
        blocks AS (
          SELECT doc_id, section_no, pos // 4 AS sub_no, any_value(title) AS title, any_value(todo_phase) AS todo_phase, any_value(any_head) AS any_head,
                 count(*) AS message_count,
                 {sql_strip('''string_agg(CASE WHEN kind = 'section' THEN message ELSE '[' || trim(time || ' ' || speaker ||
                   CASE WHEN team <> '' THEN '[' || team || ']' ELSE '' END) || '] ' || message END, chr(10) ORDER BY msg_no)''')} AS body
          FROM msg GROUP BY doc_id, section_no, pos // 4),
        named AS (SELECT doc_id FROM msg GROUP BY doc_id HAVING bool_or(speaker <> '(unknown)')),
        all_rows AS (
          SELECT doc_id, section_no, sub_no, CASE WHEN sub_no = 0 THEN title ELSE title || ' (계속 ' || (sub_no + 1)::BIGINT || ')' END AS section_title,
                 todo_phase, message_count, body, CASE WHEN any_head = 1 THEN 'slack_todo_sections' ELSE 'structured_slack_messages' END AS parser_format
          FROM blocks SEMI JOIN named USING (doc_id)
          UNION ALL
          SELECT doc_id, 0, 0, source, 'unknown', 0, text, 'fallback_block' FROM t ANTI JOIN named USING (doc_id) WHERE text <> '')
        SELECT a.doc_id AS document_id, section_no::BIGINT AS block_index, sub_no::BIGINT AS sub_block_index, section_title, todo_phase,
               message_count, parser_format, {short('body', 'body')},
               coalesce(CAST({sql_date("array_to_string(string_split(t.text, chr(10))[1:20], chr(10))", 2001)} AS VARCHAR), '-') AS document_date
        FROM all_rows a JOIN t USING (doc_id)""",
)
def p6_thread_sections(spark, sf):
    out = sections.thread_sections(files(spark, sf, rendered(THREAD)), 2001, block=4)
    return out.select(
        "document_id", "block_index", "sub_block_index", "section_title", "todo_phase", "message_count", "parser_format",
        *short_cols(F.col("content"), "body"), F.coalesce(F.col("document_date").cast("string"), F.lit("-")).alias("document_date"),
    )


@REG.add(
    "p7_block_split",
    """SELECT conv_id, (n // 3)::BIGINT AS block_no, 'talk' || CASE WHEN n // 3 = 0 THEN '' ELSE ' (계속 ' || (n // 3 + 1)::BIGINT || ')' END AS section_title,
              count(*) AS message_count, min(turn) AS first_turn, max(turn) AS last_turn,
              sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) GROUP BY conv_id, n // 3""",
)
def p7_block_split(spark, sf):
    c = table(spark, sf, "conversations")
    placed = sections.block_split(c, ["conv_id"], "turn", 3)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]), "\n")
    blocks = placed.groupBy("conv_id", "block_no").agg(
        F.count("*").alias("message_count"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.sha2(body, 256).alias("sha"),
    )
    return blocks.withColumn("section_title", sections.block_title(F.lit("talk"), F.col("block_no"), "thread"))


@REG.add(
    "p7_table_blocks",
    """WITH r AS (SELECT p_brand, p_partkey, p_partkey || chr(9) || p_name || chr(9) || p_size AS row_text,
                         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)
       SELECT p_brand, (n // 60)::BIGINT AS block_no, p_brand || CASE WHEN n // 60 = 0 THEN '' ELSE ' (블록 ' || (n // 60 + 1)::BIGINT || ')' END AS section_title,
              count(*) AS block_row_count, any_value(t) AS sheet_row_count, 3 AS sheet_col_count,
              sha256(string_agg(row_text, chr(10) ORDER BY p_partkey)) AS sha
       FROM r JOIN (SELECT p_brand, count(*) AS t FROM part GROUP BY p_brand) USING (p_brand) GROUP BY p_brand, n // 60""",
)
def p7_table_blocks(spark, sf):
    """Each brand is a sheet of its parts."""
    rows = sections.table_rows_to_text(table(spark, sf, "part"), ["p_partkey", "p_name", "p_size"])
    out = sections.table_sections(rows, "p_brand", "p_partkey")
    return out.select(
        "p_brand", "block_no", "section_title", "block_row_count", "sheet_row_count", "sheet_col_count",
        F.sha2("content", 256).alias("sha"),
    )


ROLL_TOPICS = {"common": ("the ", "and "), "report": ("tion", "ment"), "meta": ("ouel", "ungh")}
SQL_TALK = f"""talk AS (
  SELECT conv_id, turn, role AS speaker, ((8 + turn * 3) % 24) || ':05' AS time, text AS message,
         {sql_mentions(sql_links('text'))} AS safe, {sql_bucket('((8 + turn * 3) % 24)')} AS bucket,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS block_no FROM conversations),
firsts AS (SELECT conv_id, block_no, speaker, row_number() OVER (PARTITION BY conv_id, block_no ORDER BY min(turn)) - 1 AS no
           FROM talk GROUP BY conv_id, block_no, speaker),
bfirst AS (SELECT conv_id, block_no, bucket, row_number() OVER (PARTITION BY conv_id, block_no ORDER BY min(turn)) AS no
           FROM talk GROUP BY conv_id, block_no, bucket),
ranges AS (SELECT conv_id, block_no, string_agg({sql_label('bucket')}, ' · ' ORDER BY no) AS time_range FROM bfirst WHERE no <= 2
           GROUP BY conv_id, block_no),
rolled AS (
  SELECT conv_id, block_no, count(*) AS message_count,
         {sql_strip("string_agg('[' || time || ' ' || speaker || '] ' || message, chr(10) ORDER BY turn)")} AS content,
         {sql_strip(f"string_agg('[' || {sql_label('bucket')} || ' 담당자 ' || chr(65 + no::INT) || '] ' || safe, chr(10) ORDER BY turn)")} AS safe,
         string_agg(bucket, ',' ORDER BY turn) AS time_buckets
  FROM talk JOIN firsts USING (conv_id, block_no, speaker) GROUP BY conv_id, block_no)"""


@REG.add(
    "p8_section_rollup",
    f"""WITH {SQL_TALK},
        names AS (SELECT conv_id, block_no, string_agg(speaker, ',' ORDER BY no) AS speakers,
                         string_agg('담당자 ' || chr(65 + no::INT), ',' ORDER BY no) AS display_speakers FROM firsts GROUP BY conv_id, block_no)
        SELECT conv_id, block_no::BIGINT AS block_no, message_count, speakers, display_speakers, time_buckets, time_range,
               sha256(content) AS content_sha, sha256(safe) AS safe_sha,
               array_to_string({sql_tags("lower('talk' || chr(10) || content)", ROLL_TOPICS)}, ',') AS topics
        FROM rolled JOIN names USING (conv_id, block_no) JOIN ranges USING (conv_id, block_no)""",
)
def p8_section_rollup(spark, sf):
    c = sections.block_split(table(spark, sf, "conversations"), ["conv_id"], "turn", 3)
    messages = c.select(
        "conv_id", "block_no", F.col("turn").alias("msg_no"), F.col("role").alias("speaker"), F.lit("").alias("team"),
        F.concat(((F.col("turn") * 3 + 8) % 24).cast("string"), F.lit(":05")).alias("time"), F.col("text").alias("message"),
        F.lit(False).alias("is_section_header"), F.lit("talk").alias("section_title"),
    )
    out = sections.section_rollup(messages, ["conv_id", "block_no"], topics=ROLL_TOPICS)
    return out.select(
        "conv_id", "block_no", "message_count", F.array_join("original_speakers", ",").alias("speakers"),
        F.array_join("display_speakers", ",").alias("display_speakers"), F.array_join("time_buckets", ",").alias("time_buckets"),
        F.col("time_range_display").alias("time_range"), F.sha2("content", 256).alias("content_sha"),
        F.sha2("sanitized_content", 256).alias("safe_sha"), F.array_join("topic_tags", ",").alias("topics"),
    )


@REG.add(
    "p9_unstructured_fallback",
    f"""WITH {SQL_THREAD} SELECT doc_id AS document_id, source AS section_title, {short('text', 'body')}
        FROM t WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM msg WHERE speaker <> '(unknown)')""",
)
def p9_unstructured_fallback(spark, sf):
    out = sections.unstructured_files(files(spark, sf, rendered(THREAD)))
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    return out.select("document_id", F.col("file_stem").alias("section_title"), *short_cols(body, "body"))


@REG.add(
    "p10_table_rows_to_text",
    """SELECT c_custkey, c_custkey || chr(9) || c_name || chr(9) || CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR
              ELSE c_acctbal::VARCHAR END || chr(9) || CASE WHEN c_custkey % 3 = 0 THEN chr(9) || 'x' ELSE c_mktsegment END AS row_text,
              CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 4 END AS cell_count
       FROM customer WHERE c_custkey % 11 <> 0
       UNION ALL
       SELECT c_custkey, c_custkey || chr(9) || repeat('ab', 98) || 'a...', 2 FROM customer WHERE c_custkey % 11 = 0""",
)
def p10_table_rows_to_text(spark, sf):
    """Null, padded, integral and over-long cells; trailing empty cells."""
    k, plain = F.col("c_custkey"), F.col("c_custkey") % 11 != 0
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(plain, F.concat(F.lit("  "), "c_name")).otherwise(F.repeat(F.lit("ab"), F.lit(150))).alias("name"),
        F.when(plain, F.col("c_acctbal")).alias("bal"),
        F.when(plain & (k % 3 != 0), F.concat("c_mktsegment", F.lit(" "))).alias("seg"),
        F.when(plain & (k % 3 == 0), "x").otherwise("").alias("note"),
    )
    return sections.table_rows_to_text(rows).select("c_custkey", "row_text", "cell_count")
