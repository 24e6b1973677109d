"""Cards: eligibility, inputs, parsing, coercion, checks, rendering, chunks, statistics and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import LANG_CATEGORY, Registry, pick, sql_case, sql_pick, table
from catalog.texts import NL, docs, sql_strip
from loresmith.config import CardConfig
from loresmith.functions.lookup import lookup
from loresmith.operators import cards
from loresmith.session import scratch_dir
from loresmith.sources import stores

REG = Registry()
CATEGORY = sql_case("lang", LANG_CATEGORY, "'misc'")
KINDS = ["word", "guide", "slack", "excel"]
TYPES = ["workflow", "FAQ", "checklist", "bogus", "glossary", "decision", "issue"]


@REG.add(
    "n1_eligible_for_normalization",
    f"""SELECT doc_id, CASE WHEN c = 'guide' OR s = 'guide' THEN 'guide' WHEN c IN ('slack', 'slack_manual') OR s IN ('slack', 'slack_manual') THEN 'slack'
               ELSE '-' END AS kind FROM (SELECT doc_id, {CATEGORY} AS c, {sql_pick('doc_id', KINDS)} AS s FROM documents)""",
)
def n1_eligible_for_normalization(spark, sf):
    kind = cards.eligible_for_normalization(
        F.concat(F.lit(" "), lookup(F.col("lang"), LANG_CATEGORY, "misc")), pick(F.col("doc_id"), KINDS)
    )
    return table(spark, sf, "documents").select("doc_id", F.coalesce(kind, F.lit("-")).alias("kind"))


@REG.add(
    "n2_normalization_input",
    f"""WITH t AS (SELECT conv_id, turn, {sql_strip("CASE WHEN turn % 3 = 1 THEN 'safe ' || text ELSE text END")} AS x,
                          {sql_pick('conv_id + turn', ['meta', 'kakao', 'report'])} AS tag, CASE WHEN turn >= 1 THEN 'p' || turn END AS todo_phase FROM conversations),
        j AS (SELECT conv_id, string_agg(x, chr(10) || chr(10) ORDER BY turn) FILTER (x <> '') AS s FROM t GROUP BY conv_id),
        g AS (SELECT conv_id, string_agg(tag, ',' ORDER BY first_turn) AS tags FROM (SELECT conv_id, tag, min(turn) AS first_turn FROM t GROUP BY ALL) GROUP BY conv_id),
        p AS (SELECT conv_id, arg_min(todo_phase, turn) FILTER (todo_phase IS NOT NULL) AS todo_phase FROM t GROUP BY conv_id)
        SELECT conv_id AS document_id, CASE WHEN length(s) > 900 THEN substr(s, 1, 897) || '...' ELSE coalesce(s, '') END AS text, tags, coalesce(todo_phase, '-') AS todo_phase
        FROM j JOIN g USING (conv_id) JOIN p USING (conv_id)""",
)
def n2_normalization_input(spark, sf):
    """Conversations as documents of one section per turn; a small cap, so that many are cut."""
    t = F.col("turn")
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("document_id"), t.alias("section_no"), F.col("text").alias("content"),
        F.when(t % 3 == 1, F.concat(F.lit("safe "), "text")).otherwise("  ").alias("sanitized_content"),
        F.array(pick(F.col("conv_id") + t, ["meta", "kakao", "report"]), F.lit(" ")).alias("topic_tags"),
        F.when(t >= 1, F.concat(F.lit("p"), t.cast("string"))).otherwise("").alias("todo_phase"),
        F.lit(None).cast("string").alias("parser_format"), F.lit(None).cast("date").alias("document_date"),
        F.lit(None).cast("string").alias("display_date"),
    )
    out = cards.normalization_input(rows, CardConfig(max_chars=900))
    return out.select("document_id", "text", F.array_join("topic_tags", ",").alias("tags"), F.coalesce("todo_phase", F.lit("-")).alias("todo_phase"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """A model answer per document: five malformed forms, then two cards with an entry between them that is no object."""
    n, k = F.col("doc_id"), F.col("doc_id") % 10
    first = F.to_json(
        F.struct(
            pick(n, TYPES).alias("card_type"), F.concat(F.lit(" T"), n.cast("string")).alias("title"),
            F.col("text").alias("summary"), F.lit("meta").alias("topic_tags"),
            F.array(F.lit("s1"), F.lit(" "), F.lit("s2")).alias("steps"), F.lit("only one").alias("checkpoints"),
            F.array(pick(n, ["procedure", "summary", "wrong"])).alias("answer_use_cases"),
            F.array(
                F.struct(F.lit("sec").alias("section"), F.lit("3").alias("chunk_index"), F.lit("quote").alias("text")),
                F.struct(F.lit("").alias("section"), F.lit("x").alias("chunk_index"), F.lit("").alias("text")),
            ).alias("evidence_spans"),
            F.lit(5).alias("cautions"), F.concat(F.lit("topic"), (n % 4).cast("string")).alias("primary_topic"),
        )
    )
    second = F.to_json(
        F.struct(
            F.lit("  ").alias("title"), n.alias("summary"), F.array(F.lit("b"), F.lit(" in ")).alias("topic_tags"),
            F.lit("weekly").alias("task_type"), F.lit("now").alias("when_to_use"),
        )
    )
    body = F.concat(F.lit('{"cards": ['), first, F.lit(', "no object", '), second, F.lit("]}"))
    response = (
        F.when(k == 0, "  ")
        .when(k == 1, "not json {")
        .when(k == 2, "[1, 2]")
        .when(k == 3, '{"cards": {"a": 1}}')
        .when(k == 4, '{"items": []}')
        .when(k < 7, F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
        .otherwise(body)
    )
    category = lookup(F.col("lang"), LANG_CATEGORY, "misc")
    return docs(spark, sf, "lang", "source", "text").select(
        "doc_id", F.concat(F.lit("doc_"), n.cast("string")).alias("document_id"), response.alias("response"),
        F.when(category == "slack", "slack").otherwise("guide").alias("kind"), F.col("source").alias("file_name"),
        F.concat(F.lit("h"), n.cast("string")).alias("file_hash"), F.concat(F.lit("h"), n.cast("string")).alias("file_hash_short"),
        category.alias("source_category"), F.lit("markdown").alias("source_type"), F.lit(None).cast("date").alias("document_date"),
        F.lit("2024").alias("display_date"), F.array(F.lit("in"), F.lit("meta ")).alias("input_topic_tags"),
    )


def coerced(spark: SparkSession, sf: str) -> DataFrame:
    parsed = cards.parse_cards(responses(spark, sf))
    rows = cards.coerce_cards(parsed)
    return rows.withColumn("document_id", F.concat(F.lit("doc_"), F.substring("source_file_hash", 2, 20)))


SQL_CARDS = f"""base AS (
  SELECT doc_id, source, {CATEGORY} AS category, {CATEGORY} = 'slack' AS slack, text AS head, {sql_pick('doc_id', TYPES)} AS t FROM documents WHERE doc_id % 10 >= 5),
cards AS (
  SELECT doc_id, source, category, slack, 0 AS card_no, CASE WHEN t = 'bogus' THEN CASE WHEN slack THEN 'issue' ELSE 'workflow' END ELSE lower(t) END AS card_type,
         'T' || doc_id AS title, {sql_strip('head')} AS summary, 'topic' || doc_id % 4 AS primary_topic,
         CASE WHEN slack THEN 'meta,in' ELSE 'meta' END AS tags, 's1,s2' AS steps, 'only one' AS checkpoints,
         {sql_pick('doc_id', ['procedure', 'summary', 'wrong'])} AS use_cases, 'sec/3/quote;/-1/' AS spans, '-' AS task_type, '' AS when_to_use FROM base
  UNION ALL
  SELECT doc_id, source, category, slack, 2, CASE WHEN slack THEN 'issue' ELSE 'workflow' END, '(제목 없음)', doc_id::VARCHAR, NULL,
         CASE WHEN slack THEN 'b,in,meta' ELSE 'b, in ' END, '', '', '', '', 'weekly', 'now' FROM base),
named AS (SELECT *, 'kc_h' || doc_id || '_' || printf('%03d', card_no) || '_' || card_type AS card_id,
                 summary <> '' AND use_cases <> 'wrong' AS valid FROM cards)"""


@REG.add(
    "n3_parse_cards",
    """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_object' WHEN 3 THEN 'cards_not_list' WHEN 4 THEN 'no_cards' ELSE 'ok' END AS parse_status,
              CASE WHEN doc_id % 10 < 5 THEN 0 ELSE 3 END AS n_cards FROM documents
       UNION ALL SELECT -1 - event_id, 'no_cards', 0 FROM events""",
)
def n3_parse_cards(spark, sf):
    """Model answers, and the event properties as answers without cards."""
    n = F.coalesce(F.size("cards"), F.lit(0)).cast("long").alias("n_cards")
    answers = cards.parse_cards(responses(spark, sf)).select("doc_id", "parse_status", n)
    events = table(spark, sf, "events").select((F.lit(-1) - F.col("event_id")).alias("doc_id"), F.col("props").alias("response"))
    return answers.unionByName(cards.parse_cards(events).select("doc_id", "parse_status", n))


def card_columns(rows: DataFrame) -> DataFrame:
    spans = F.transform(
        "evidence_spans", lambda s: F.concat_ws("/", s["section_title"], s["chunk_index"].cast("string"), s["summary"])
    )
    return rows.select(
        "card_id", "card_type", "title", "summary", "source_file_name", "source_category",
        F.coalesce("primary_topic", F.lit("-")).alias("primary_topic"), F.array_join("topic_tags", ",").alias("tags"),
        F.array_join("steps", ",").alias("steps"), F.array_join("checkpoints", ",").alias("checkpoints"),
        F.array_join("answer_use_cases", ",").alias("use_cases"), F.array_join(spans, ";").alias("spans"),
        F.size("cautions").cast("long").alias("n_cautions"), F.coalesce("task_type", F.lit("-")).alias("task_type"), "when_to_use",
    )


SQL_CARD_COLUMNS = """SELECT card_id, card_type, title, summary, source AS source_file_name, category AS source_category, coalesce(primary_topic, '-') AS primary_topic,
       tags, steps, checkpoints, use_cases, spans, 0 AS n_cautions, task_type, when_to_use FROM named"""


@REG.add("n4_coerce_card", f"WITH {SQL_CARDS} {SQL_CARD_COLUMNS}")
def n4_coerce_card(spark, sf):
    return card_columns(coerced(spark, sf))


@REG.add("n5_validate_card", f"WITH {SQL_CARDS} SELECT card_id, valid FROM named")
def n5_validate_card(spark, sf):
    return coerced(spark, sf).select("card_id", cards.is_valid_card().alias("valid"))


def sql_bullets(e: str, mark: str = "- ") -> str:
    if mark == "1. ":
        return f"CASE WHEN {e} = '' THEN '1. (없음)' ELSE array_to_string([i || '. ' || x for x, i in string_split({e}, ',')], chr(10)) END"
    return f"CASE WHEN {e} = '' THEN '- (없음)' ELSE '- ' || {e} END"


SQL_MARKDOWN = f"""markdown AS (
  SELECT *, '# ' || title || repeat({NL}, 2) || '- card_type: ' || card_type || {NL} || '- primary_topic: ' || coalesce(primary_topic, '-') || {NL}
    || '- task_type: ' || task_type || {NL} || '- source_file: ' || source || {NL} || '- source_category: ' || category || {NL} || '- display_date: 2024' || {NL}
    || '- answer_use_cases: ' || CASE WHEN use_cases = '' THEN '-' ELSE use_cases END || repeat({NL}, 2) || '## 요약' || {NL} || summary || repeat({NL}, 2)
    || '## 언제 사용하는가' || {NL} || when_to_use || repeat({NL}, 2) || '## 선행 조건' || {NL} || '- (없음)' || repeat({NL}, 2)
    || '## 업무 절차' || {NL} || CASE WHEN steps = '' THEN '1. (없음)' ELSE '1. s1' || {NL} || '2. s2' END || repeat({NL}, 2)
    || '## 체크포인트' || {NL} || CASE WHEN checkpoints = '' THEN '- (없음)' ELSE '- ' || checkpoints END || repeat({NL}, 2)
    || '## 주의사항' || {NL} || '- (없음)' || repeat({NL}, 2) || '## 예시' || {NL} || '- (없음)' || repeat({NL}, 2)
    || '## 관련 용어' || {NL} || '- (없음)' || repeat({NL}, 2) || '## 미확인 사항' || {NL} || '- (없음)' || repeat({NL}, 2) || '## 근거' || {NL}
    || CASE WHEN spans = '' THEN '- (근거 없음)' ELSE '- section: sec, chunk_index: 3, summary: quote' || {NL} || '- section: -, chunk_index: -1, summary: -' END AS md
  FROM named)"""


@REG.add("n6_render_card_markdown", f"WITH {SQL_CARDS}, {SQL_MARKDOWN} SELECT card_id, md AS markdown FROM markdown")
def n6_render_card_markdown(spark, sf):
    return coerced(spark, sf).select("card_id", cards.render_markdown().alias("markdown"))


@REG.add(
    "n7_cards_to_chunks",
    f"""WITH {SQL_CARDS}, {SQL_MARKDOWN}
        SELECT 'chunk_doc_' || doc_id || '_norm_' || printf('%04d', card_no) || '_' || right(card_id, 24) AS chunk_id, card_no AS chunk_index, 1.25::DOUBLE AS source_weight,
               title AS section_title, sha256(md) AS content_sha,
               (SELECT coalesce(string_agg(l.l_linenumber::VARCHAR, ',' ORDER BY l.l_linenumber), '') FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
                 QUALIFY dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3) l WHERE l.l_orderkey = doc_id) AS parents
        FROM markdown WHERE valid""",
)
def n7_cards_to_chunks(spark, sf):
    """The lines of the order with the document's number stand in for its raw chunks."""
    raw = table(spark, sf, "lineitem").select(
        F.concat(F.lit("doc_"), F.col("l_orderkey").cast("string")).alias("document_id"),
        F.col("l_linenumber").cast("long").alias("chunk_index"), F.col("l_linenumber").cast("string").alias("chunk_id"),
    ).distinct()
    out = cards.cards_to_chunks(coerced(spark, sf), raw)
    return out.select(
        "chunk_id", "chunk_index", "source_weight", "section_title", F.sha2("content", 256).alias("content_sha"),
        F.array_join("parent_raw_chunk_ids", ",").alias("parents"),
    )


@REG.add(
    "n8_card_stats",
    f"""WITH {SQL_CARDS}
        SELECT 'total' AS facet, 'all' AS name, count(*) AS n FROM named
        UNION ALL SELECT 'card_type', card_type, count(*) FROM named GROUP BY card_type
        UNION ALL SELECT 'primary_topic', coalesce(primary_topic, 'unknown'), count(*) FROM named GROUP BY primary_topic
        UNION ALL SELECT 'source_file_name', source, count(*) FROM named GROUP BY source""",
)
def n8_card_stats(spark, sf):
    return cards.card_stats(coerced(spark, sf))


@REG.add(
    "n9_filter_cards",
    f"""WITH {SQL_CARDS} SELECT card_id, primary_topic FROM named WHERE primary_topic = 'topic1'
        AND contains(lower(title || chr(10) || summary || chr(10) || when_to_use || chr(10) || replace(steps, ',', chr(10)) || chr(10) || checkpoints), 'the')""",
)
def n9_filter_cards(spark, sf):
    out = cards.filter_cards(coerced(spark, sf), card_type="전체", primary_topic="topic1", query=" THE ")
    return out.select("card_id", "primary_topic")


@REG.add(
    "n10_card_display",
    f"""WITH {SQL_CARDS} SELECT title, card_type, coalesce(primary_topic, 'unknown') AS primary_topic, replace(task_type, '-', '') AS task_type, source AS source_file_name,
        '2024' AS display_date, CASE WHEN checkpoints = '' THEN 0 ELSE 1 END AS checkpoints_count, CASE WHEN steps = '' THEN 0 ELSE 2 END AS steps_count,
        0 AS open_questions_count FROM named""",
)
def n10_card_display(spark, sf):
    return cards.card_display(coerced(spark, sf))


@REG.add(
    "n11_summaries_first",
    """WITH s AS (SELECT l_orderkey AS document_id, l_returnflag AS sheet_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS section_no
                  FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)),
       r AS (SELECT l_orderkey AS document_id, l_returnflag AS sheet_name, l_linenumber - 1 AS section_no FROM lineitem GROUP BY ALL)
       SELECT document_id, sheet_name, section_no, 'summary' AS kind FROM s
       UNION ALL SELECT r.document_id, r.sheet_name, r.section_no + k.n, 'raw' FROM r JOIN (SELECT document_id, count(*) AS n FROM s GROUP BY 1) k USING (document_id)""",
)
def n11_summaries_first(spark, sf):
    """Per order one summary per return flag, then its line numbers."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("sheet_name"),
        (F.col("l_linenumber") - 1).cast("long").alias("section_no"), F.lit("raw").alias("kind"),
    ).distinct()
    sums = lines.groupBy("document_id").agg(F.array_sort(F.collect_set("sheet_name")).alias("flags"))
    sums = sums.select("document_id", F.posexplode("flags").alias("section_no", "sheet_name"))
    sums = sums.select("document_id", "sheet_name", F.col("section_no").cast("long"), F.lit("summary").alias("kind"))
    return cards.summaries_first(sums, lines)


@REG.add(
    "n11_summaries_by_file",
    """SELECT 'src' || l_orderkey % 20 AS file_name, count(*) AS summaries, count(DISTINCT l_returnflag) AS sheets, strftime(min(shipped), '%Y-%m-%d') AS first_at
       FROM (SELECT l_orderkey, l_returnflag, min(l_shipdate) AS shipped FROM lineitem GROUP BY ALL) GROUP BY l_orderkey % 20""",
)
def n11_summaries_by_file(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("sheet_name")).agg(
        F.min("l_shipdate").alias("created_at")
    ).withColumn("file_name", F.concat(F.lit("src"), (F.col("l_orderkey") % 20).cast("string")))
    out = cards.summaries_by_file(sums)
    return out.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd"))


@REG.add("s7_write_read_cards", f"WITH {SQL_CARDS} {SQL_CARD_COLUMNS}")
def s7_write_read_cards(spark, sf):
    """Round trip through JSON arrays, with broken text among them."""
    path = scratch_dir(spark, "cards")
    stores.write_cards(coerced(spark, sf), path)
    table(spark, sf, "region").select(F.concat(F.lit('[{"card_id": '), "r_name").alias("value")).write.mode("append").text(path)
    return card_columns(stores.read_cards(spark, path))


@REG.add(
    "s7_cards_markdown",
    f"""WITH {SQL_CARDS}, {SQL_MARKDOWN} SELECT 'h' || doc_id AS source_file_hash, sha256(string_agg(md, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY card_id) || {NL}) AS sha
        FROM markdown GROUP BY doc_id""",
)
def s7_cards_markdown(spark, sf):
    return stores.cards_by_file(coerced(spark, sf)).select("source_file_hash", F.sha2("markdown", 256).alias("sha"))
