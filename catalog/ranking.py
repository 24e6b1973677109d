"""Question features, scoring, ranking policy, evidence and context over the hybrid candidates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import search
from catalog.base import (
    sql_links,
    sql_mentions,
    sql_squeeze,
    AS_OF,
    CATEGORY_SOURCE,
    CONTENT_TYPES,
    LABEL_TOPICS,
    LANG_CATEGORY,
    SQL_QUESTIONS,
    STAND_IN_CARD_TYPES,
    Registry,
    pick,
    questions,
    sql_case,
    sql_pick,
    table,
)

from loresmith import vocab
from loresmith.config import CARDS, RETRIEVAL
from loresmith.functions.lookup import lookup
from loresmith.functions.privacy import anonymize
from loresmith.functions.questions import answer_intent, query_features
from loresmith.operators import evaluate, evidence, policy, scoring
from loresmith.plans import retrieval

REG = Registry()
DEFAULT_YEAR = 2001
CHILD_BASE = 10_000_000_000


# --- SQL for question features ----------------------------------------------------------------------------------------
def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.lower()}')" for w in words) + ")"


def sql_tags(text: str, dictionary) -> str:
    arms = ", ".join(f"CASE WHEN {sql_any(text, ws)} THEN '{tag}' END" for tag, ws in dictionary.items())
    return f"[x for x in [{arms}] if x IS NOT NULL]"


def sql_first(text: str, dictionary) -> str:
    arms = ", ".join(f"CASE WHEN {sql_any(text, ws)} THEN '{tag}' END" for tag, ws in dictionary.items())
    return f"coalesce({arms})"


# (pattern, groups for year / month / day, group of the whole text); year None means the default year
SQL_DATE_FORMS = (
    (r"((\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일)", (2, 3, 4)),
    (r"(?:^|[^0-9])((20\d{2})[-/_.\s](\d{1,2})[-/_.\s](\d{1,2}))(?:$|[^0-9])", (2, 3, 4)),
    (r"((\d{1,2})\s*월\s*(\d{1,2})\s*일)", (None, 2, 3)),
    (r"(?:^|[^0-9])((\d{1,2})/(\d{1,2}))(?:$|[^0-9])", (None, 2, 3)),
)


def sql_date(text: str, year: int, want: str = "d") -> str:
    """First form giving a real date: the DATE (want='d') or its text (want='t')."""
    arms = []
    for pattern, (y, m, d) in SQL_DATE_FORMS:
        part = lambda g: f"regexp_extract({text}, '{pattern}', {g})"  # noqa: E731, B023
        ys = f"'{year:04d}'" if y is None else part(y)
        date = f"try_cast({ys} || '-' || lpad({part(m)}, 2, '0') || '-' || lpad({part(d)}, 2, '0') AS DATE)"
        arms.append(date if want == "d" else f"CASE WHEN {date} IS NOT NULL THEN {part(1)} END")
    return f"coalesce({', '.join(arms)})"


SQL_FEATURES = f"""features AS (
  SELECT query_id, question, {sql_date('question', DEFAULT_YEAR)} AS query_date,
         {sql_tags('lower(question)', vocab.QUERY_TOPICS)} AS query_topics,
         {sql_tags('lower(question)', vocab.QUERY_INTENTS)} AS query_intent,
         {', '.join(f"{sql_any('lower(question)', ws)} AS {n}" for n, ws in vocab.QUERY_CLASSES.items())}
  FROM questions)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    return query_features(questions(spark, sf), DEFAULT_YEAR)


@REG.add(
    "t18_infer_intents",
    f"""WITH {SQL_QUESTIONS}
        SELECT query_id, array_to_string({sql_tags('lower(question)', vocab.QUERY_INTENTS)}, ',') AS intents,
               coalesce({sql_first('lower(question)', vocab.ANSWER_INTENTS)}, '-') AS answer_intent,
               {', '.join(f"{sql_any('lower(question)', ws)} AS {n}" for n, ws in vocab.QUERY_CLASSES.items())}
        FROM questions""",
)
def t18_infer_intents(spark, sf):
    f = features(spark, sf)
    return f.select(
        "query_id", F.array_join("query_intent", ",").alias("intents"),
        F.coalesce(answer_intent(F.col("question")), F.lit("-")).alias("answer_intent"), *vocab.QUERY_CLASSES,
    )


@REG.add(
    "t19_query_features",
    f"""WITH {SQL_QUESTIONS}, {SQL_FEATURES}
        SELECT query_id, coalesce(CAST(query_date AS VARCHAR), '-') AS query_date,
               array_to_string(query_topics, ',') AS query_topics, coalesce(query_topics[1], '-') AS query_topic,
               array_to_string(query_intent, ',') AS query_intent, is_settlement, is_todo, is_setting, is_kakao
        FROM features""",
)
def t19_query_features(spark, sf):
    return features(spark, sf).select(
        "query_id", F.coalesce(F.col("query_date").cast("string"), F.lit("-")).alias("query_date"),
        F.array_join("query_topics", ",").alias("query_topics"),
        F.coalesce("query_topic", F.lit("-")).alias("query_topic"),
        F.array_join("query_intent", ",").alias("query_intent"), *vocab.QUERY_CLASSES,
    )


# --- the corpus side ----------------------------------------------------------------------------------------------------
def chunks(spark: SparkSession, sf: str, ids: DataFrame | None = None) -> DataFrame:
    """documents as chunks: language gives the category, the vector's label topic and card, the order the dates.

    ``ids(chunk_id)``: only these chunks; each table is reduced to them before the tables are joined.
    """
    d, e, o = (table(spark, sf, n) for n in ("documents", "embeddings", "orders"))
    d = d.select(F.col("doc_id").alias("chunk_id"), "lang", "source")
    e = e.select(F.col("vec_id").alias("chunk_id"), "label")
    o = o.select(F.col("o_orderkey").alias("chunk_id"), "o_orderdate")
    if ids is not None:
        d, e, o = (t.join(ids, "chunk_id", "left_semi") for t in (d, e, o))
    rows = d.join(e, "chunk_id", "left").join(o, "chunk_id", "left")
    rows = rows.withColumn("uploaded_category", lookup(F.col("lang"), LANG_CATEGORY, "misc"))
    card = F.coalesce(F.col("label") < 2, F.lit(False))
    cid = F.col("chunk_id")
    topic = F.coalesce(pick(F.col("label"), LABEL_TOPICS), F.lit(""))
    rows = rows.withColumns(
        {
            "content_type": F.when(card, "normalized_document").otherwise(pick(cid, CONTENT_TYPES)),
            "source_type": F.when(card, vocab.CARD_SOURCE_TYPE).otherwise(
                lookup(F.col("uploaded_category"), CATEGORY_SOURCE, "txt")
            ),
            "card_type": F.when(card, pick(cid, STAND_IN_CARD_TYPES)),
            "topic_tags": F.filter(F.array(topic), lambda t: t != ""),
            "primary_topic": F.nullif(topic, F.lit("")),
        }
    )
    weight = scoring.source_weight(F.col("source_type"), F.col("content_type"), F.col("uploaded_category"))
    return rows.select(
        "chunk_id",
        F.concat(F.lit("doc"), cid.cast("string")).alias("document_id"),
        F.col("source").alias("file_name"),
        F.concat(F.lit("h"), (cid % 50).cast("string")).alias("source_file_hash"),
        F.concat(F.lit("sec"), (cid % 3).cast("string")).alias("section_title"),
        F.concat(F.lit("sheet"), (cid % 2).cast("string")).alias("sheet_name"),
        (cid % 100).alias("chunk_index"),
        "uploaded_category", "content_type", "source_type", "card_type", "topic_tags", "primary_topic",
        F.when(card, CARDS.source_weight).otherwise(weight).alias("source_weight"),
        F.col("o_orderdate").alias("created_at"),
        F.when(cid % 5 != 0, F.col("o_orderdate").cast("date")).alias("document_date"),
    )


def children(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem rows (one per order and line number) as raw-table rows below the order's document."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("created_at")
    )
    return rows.select(
        (F.lit(CHILD_BASE) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        F.col("l_orderkey").alias("parent_chunk_id"),
        F.concat(F.lit("doc"), F.col("l_orderkey").cast("string")).alias("document_id"),
        F.concat(F.lit("src"), (F.col("l_orderkey") % 20).cast("string")).alias("file_name"),
        F.concat(F.lit("sheet"), (F.col("l_linenumber") % 2).cast("string")).alias("sheet_name"),
        F.lit("rows").alias("section_title"),
        F.col("l_linenumber").cast("long").alias("chunk_index"),
        F.lit("excel").alias("uploaded_category"),
        F.lit("excel_raw_table").alias("content_type"),
        F.lit("excel").alias("source_type"),
        F.lit(0.95).alias("source_weight"),
        "created_at",
        F.array().cast("array<string>").alias("topic_tags"),
        F.lit(None).cast("string").alias("primary_topic"),
    )


def corpus(spark: SparkSession, sf: str) -> retrieval.Corpus:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.Corpus(texts, search.vectors(spark, sf), lambda ids: chunks(spark, sf, ids), children(spark, sf))


@REG.add(
    "r6_vector_only",
    f"""WITH {search.SQL_VECTOR}
        SELECT query_id, chunk_id, vector_rank, round(1.0 / (60 + vector_rank), 6) AS rrf_score, round(greatest(vector_score, 0.0), 6) AS score
        FROM vector""",
)
def r6_vector_only(spark, sf):
    """Candidates with keyword search switched off."""
    found = retrieval.search(
        questions(spark, sf), search.query_vectors(spark, sf), corpus(spark, sf), replace(RETRIEVAL, hybrid=False))
    return found.select(
        "query_id", "chunk_id", "vector_rank", F.round("rrf_score", 6).alias("rrf_score"), F.round("score", 6).alias("score"))


def described(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    fused = retrieval.search(questions(spark, sf), search.query_vectors(spark, sf), c)
    return retrieval.describe(fused, features(spark, sf), c)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_candidates(described(spark, sf), F.lit(AS_OF))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    return retrieval.retrieve(
        questions(spark, sf), features(spark, sf), search.query_vectors(spark, sf), c, F.lit(AS_OF)
    )


def finals(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.final_rows(ranked(spark, sf))


def summary(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    rows = ranked(spark, sf) if rows is None else rows
    return policy.retrieval_summary(features(spark, sf), rows, RETRIEVAL.top_k)


# --- the same in SQL ----------------------------------------------------------------------------------------------------
SPECIAL_WEIGHTS = {k: vocab.SOURCE_WEIGHTS[k] for k in ("excel_summary", "excel_raw_table")}
SQL_WEIGHT = sql_case(
    "content_type",
    SPECIAL_WEIGHTS,
    sql_case("source_type", vocab.SOURCE_WEIGHTS, sql_case("uploaded_category", vocab.SOURCE_WEIGHTS, "0.7")),
)
SQL_CHUNKS = f"""chunk_base AS (
  SELECT d.doc_id AS chunk_id, d.source AS file_name, o.o_orderdate AS created_at,
         coalesce(e.label < 2, false) AS card, coalesce({sql_pick('e.label', LABEL_TOPICS)}, '') AS topic,
         {sql_case('d.lang', LANG_CATEGORY, "'misc'")} AS uploaded_category
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN orders o ON o.o_orderkey = d.doc_id),
chunk_kind AS (
  SELECT *, CASE WHEN card THEN 'normalized_document' ELSE {sql_pick('chunk_id', CONTENT_TYPES)} END AS content_type,
         CASE WHEN card THEN 'llm_normalized'
              ELSE {sql_case('uploaded_category', CATEGORY_SOURCE, "'txt'")} END AS source_type,
         CASE WHEN card THEN {sql_pick('chunk_id', STAND_IN_CARD_TYPES)} END AS card_type,
         CASE WHEN topic = '' THEN []::VARCHAR[] ELSE [topic] END AS topic_tags, nullif(topic, '') AS primary_topic
  FROM chunk_base),
chunks AS (
  SELECT *, 'doc' || chunk_id AS document_id, 'h' || chunk_id % 50 AS source_file_hash,
         'sec' || chunk_id % 3 AS section_title, 'sheet' || chunk_id % 2 AS sheet_name, chunk_id % 100 AS chunk_index,
         (CASE WHEN card THEN 1.25 ELSE {SQL_WEIGHT} END)::DOUBLE AS source_weight,
         CASE WHEN chunk_id % 5 <> 0 THEN created_at::DATE END AS document_date
  FROM chunk_kind)"""


def sql_class_boost() -> str:
    out = "(" + sql_case("uploaded_category", vocab.CATEGORY_BOOST, "1.0") + ")::DOUBLE"
    for name, mult in vocab.CLASS_MULTIPLIERS.items():
        out += f" * (CASE WHEN {name} THEN {sql_case('uploaded_category', mult, '1.0')} ELSE 1.0 END)::DOUBLE"
    return out


SQL_ASKED = "len(query_topics) > 0"
SQL_SPECIFIC = f"[t for t in topic_tags if t NOT IN ({', '.join(repr(g) for g in vocab.GENERIC_TOPICS)})]"
SQL_DAYS = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400.0"
SQL_SCORED = f"""factors AS (
  SELECT *, greatest(score, 0.0) AS similarity, {sql_class_boost()} AS category_boost,
         ({sql_case('content_type', vocab.CONTENT_BOOST, '1.0')})::DOUBLE AS content_type_boost,
         (CASE WHEN created_at IS NULL THEN 1.0 WHEN {SQL_DAYS} <= 7 THEN 1.0 WHEN {SQL_DAYS} <= 90 THEN 0.97
               WHEN {SQL_DAYS} <= 365 THEN 0.93 ELSE 0.85 END)::DOUBLE AS recency,
         (CASE WHEN query_date IS NULL THEN 1.0 WHEN document_date IS NULL THEN 0.775
               WHEN document_date = query_date THEN 1.25 ELSE 0.55 END)::DOUBLE AS date_boost,
         CASE WHEN query_date IS NULL OR document_date IS NULL THEN 'none'
              WHEN document_date = query_date THEN 'exact' ELSE 'mismatch' END AS date_match,
         (CASE WHEN NOT {SQL_ASKED} THEN 1.0
               WHEN len(topic_tags) = 0 AND source_type = 'guide' AND list_contains(query_intent, 'procedure') THEN 0.95
               WHEN len(topic_tags) = 0 THEN 0.9
               WHEN list_has_any(topic_tags, query_topics) THEN 1.2
               WHEN len({SQL_SPECIFIC}) = 0 THEN 1.0 ELSE 0.8 END)::DOUBLE AS topic_boost,
         CASE WHEN NOT {SQL_ASKED} OR len(topic_tags) = 0 THEN 'none'
              WHEN list_has_any(topic_tags, query_topics) THEN 'match'
              WHEN len({SQL_SPECIFIC}) = 0 THEN 'neutral' ELSE 'mismatch' END AS topic_match
  FROM fused JOIN chunks USING (chunk_id) JOIN features USING (query_id)),
scored_rows AS (
  SELECT *, similarity * source_weight * category_boost * content_type_boost * recency * date_boost * topic_boost
            AS final_score
  FROM factors)"""
SQL_BASE = f"{search.SQL_HYBRID},\n{SQL_FEATURES},\n{SQL_CHUNKS},\n{SQL_SCORED}"

SQL_PRIORITY = f"""judged AS (
  SELECT *, len(query_topics) > 0 AND len({SQL_SPECIFIC}) > 0 AND NOT list_has_any({SQL_SPECIFIC}, query_topics)
            AS demoted,
         bool_or(card) OVER (PARTITION BY query_id, source_file_hash)
           OR bool_or(card) OVER (PARTITION BY query_id, file_name) AS card_file,
         coalesce(list_contains(query_intent, {sql_case('card_type', vocab.CARD_TYPE_INTENT, 'NULL')}), false) AS fits
  FROM scored_rows),
roles AS (
  SELECT *, CASE WHEN card AND NOT demoted
                 THEN ({sql_case('card_type', vocab.CARD_TYPE_BOOST, '1.0')})::DOUBLE
                      * (CASE WHEN fits THEN 1.1 ELSE 1.0 END)::DOUBLE ELSE 1.0::DOUBLE END AS type_boost,
         CASE WHEN card AND NOT demoted THEN 'primary_card'
              WHEN NOT card AND card_file AND NOT demoted THEN 'raw_evidence' ELSE 'raw_fallback' END AS retrieval_role
  FROM judged),
priority AS (
  SELECT * REPLACE (CASE retrieval_role WHEN 'primary_card' THEN final_score * 1.35::DOUBLE * type_boost
                    WHEN 'raw_evidence' THEN final_score * 0.85::DOUBLE ELSE final_score END AS final_score)
  FROM roles)"""

SQL_CHILDREN = f"""kids AS (
  SELECT {CHILD_BASE} + l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS parent_chunk_id,
         'doc' || l_orderkey AS document_id, 'src' || l_orderkey % 20 AS file_name,
         'sheet' || l_linenumber % 2 AS sheet_name, l_linenumber::BIGINT AS chunk_index
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
parents AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, chunk_id) AS parent_rank
  FROM priority),
kid_rows AS (
  SELECT p.query_id, k.*, p.final_score * 0.9::DOUBLE AS kid_final, greatest(0.0, p.score * 0.9::DOUBLE) AS kid_score,
         p.parent_rank, p.query_topics, p.query_intent,
         row_number() OVER (PARTITION BY p.query_id, k.parent_chunk_id ORDER BY k.chunk_id) AS kid_no
  FROM parents p JOIN kids k ON k.parent_chunk_id = p.chunk_id AND k.sheet_name = p.sheet_name
  WHERE p.content_type = 'excel_summary'),
expanded AS (
  SELECT query_id, chunk_id, document_id, file_name, section_title, content_type, source_type, uploaded_category,
         card_type, topic_tags, primary_topic, query_topics, topic_match, date_match, card, demoted, retrieval_role,
         chunk_index, score, final_score, NULL::BIGINT AS parent_chunk_id, false AS is_child
  FROM priority
  UNION ALL BY NAME
  SELECT query_id, chunk_id, document_id, file_name, 'rows' AS section_title, 'excel_raw_table' AS content_type,
         'excel' AS source_type, 'excel' AS uploaded_category, NULL AS card_type, []::VARCHAR[] AS topic_tags,
         NULL AS primary_topic, query_topics, NULL AS topic_match, NULL AS date_match, false AS card,
         false AS demoted, NULL AS retrieval_role, chunk_index, kid_score AS score, kid_final AS final_score,
         parent_chunk_id, true AS is_child
  FROM kid_rows WHERE kid_no <= 2)"""

SQL_THRESHOLD = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, chunk_id) AS rank_k3,
         CASE WHEN score < 0.35 THEN printf('similarity(%.3f) < min_similarity(0.35)', floor(score * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE)
              WHEN final_score < 0.30 THEN printf('final_score(%.3f) < min_final(0.30)', floor(final_score * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE) END AS reason
  FROM expanded),
capped AS (
  SELECT *, CASE WHEN reason IS NULL AND sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END)
                   OVER (PARTITION BY query_id, file_name ORDER BY rank_k3) > 2
                 THEN 'file_cap_exceeded(max_per_file=2)' ELSE reason END AS filter_reason
  FROM placed)"""

SQL_DIVERSITY = """counted AS (
  SELECT *, filter_reason IS NULL AS passed,
         row_number() OVER (PARTITION BY query_id, filter_reason IS NULL, file_name ORDER BY rank_k3) - 1 AS nf,
         row_number() OVER (PARTITION BY query_id, filter_reason IS NULL, section_title, content_type
                            ORDER BY rank_k3) - 1 AS ns
  FROM capped),
damped AS (
  SELECT * REPLACE (CASE WHEN passed THEN final_score * (0.7::DOUBLE + (1.0::DOUBLE - 0.7::DOUBLE)
                           * pow(0.7::DOUBLE, nf) * pow(0.9::DOUBLE, ns)) ELSE final_score END AS final_score),
         CASE WHEN passed THEN pow(0.7::DOUBLE, nf) * pow(0.9::DOUBLE, ns) END AS diversity_bonus
  FROM counted),
ranked AS (
  SELECT *, CASE WHEN passed THEN row_number() OVER (PARTITION BY query_id, passed
                   ORDER BY round(final_score, 9) DESC, chunk_id) END AS rank_n
  FROM damped),
final AS (
  SELECT *, coalesce(retrieval_role, 'raw_fallback') AS role FROM ranked WHERE rank_n <= 5)"""
SQL_RANKED = f"{SQL_BASE},\n{SQL_PRIORITY},\n{SQL_CHILDREN},\n{SQL_THRESHOLD},\n{SQL_DIVERSITY}"
SQL_SUMMARY = """summary AS (
  SELECT f.query_id, f.question, f.query_topics, count(r.chunk_id) AS candidate_count,
         count(*) FILTER (r.rank_n <= 5) AS passed_count,
         count(r.chunk_id) - count(*) FILTER (r.rank_n <= 5) AS dropped_count,
         count(*) FILTER (r.card) AS card_candidate_count, count(*) FILTER (NOT r.card) AS raw_candidate_count,
         count(*) FILTER (r.topic_match = 'mismatch') AS topic_mismatch_count,
         count(*) FILTER (r.demoted) AS topic_mismatch_demoted_count,
         count(*) FILTER (r.rank_n <= 5 AND r.retrieval_role = 'primary_card') AS primary_count,
         count(*) FILTER (r.rank_n <= 5 AND r.retrieval_role = 'raw_evidence') AS evidence_count,
         count(*) FILTER (r.rank_n <= 5 AND coalesce(r.retrieval_role, 'raw_fallback') = 'raw_fallback')
           AS fallback_count
  FROM features f LEFT JOIN ranked r USING (query_id) GROUP BY f.query_id, f.question, f.query_topics)"""


def r6(*names: str):
    """Rounded by the same arithmetic as the SQL: halves go up, whatever the engine's own round does."""
    return [(F.floor(F.col(n) * 1e6 + 0.5) / 1e6).alias(n) for n in names]


def sql_r6(*names: str) -> str:
    return ", ".join(f"floor({n}::DOUBLE * 1e6 + 0.5) / 1e6 AS {n}" for n in names)


# --- scoring ------------------------------------------------------------------------------------------------------------
@REG.add("w1_category_boost", f"WITH {SQL_BASE} SELECT query_id, chunk_id, {sql_r6('category_boost')} FROM scored_rows")
def w1_category_boost(spark, sf):
    return scored(spark, sf).select("query_id", "chunk_id", *r6("category_boost"))


@REG.add(
    "w2_content_type_boost",
    f"WITH {SQL_BASE} SELECT query_id, chunk_id, {sql_r6('content_type_boost')} FROM scored_rows",
)
def w2_content_type_boost(spark, sf):
    return scored(spark, sf).select("query_id", "chunk_id", *r6("content_type_boost"))


@REG.add(
    "w3_recency",
    f"""SELECT o_orderkey, (CASE WHEN o_orderdate IS NULL THEN 1.0 WHEN d <= 7 THEN 1.0 WHEN d <= 90 THEN 0.97
               WHEN d <= 365 THEN 0.93 ELSE 0.85 END)::DOUBLE AS recency
        FROM (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate)) / 86400.0 AS d FROM orders)""",
)
def w3_recency(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", scoring.recency(F.col("o_orderdate"), F.lit(AS_OF)).alias("recency"))


@REG.add(
    "w4_date_match",
    """SELECT o_orderkey, coalesce(CAST(q AS VARCHAR), '-') AS query_date,
              (CASE WHEN q IS NULL THEN 1.0 WHEN d IS NULL THEN 0.775 WHEN d = q THEN 1.25 ELSE 0.55 END)::DOUBLE
                AS date_boost,
              CASE WHEN q IS NULL OR d IS NULL THEN 'none' WHEN d = q THEN 'exact' ELSE 'mismatch' END AS date_match
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS d,
                    CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN DATE '1998-01-01' END AS q
             FROM orders)""",
)
def w4_date_match(spark, sf):
    """Each order as a chunk dated by it, asked with its own date, with another, or with none."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(key % 5 != 0, day).alias("d"),
        F.when(key % 3 == 0, day).when(key % 3 == 1, F.lit("1998-01-01").cast("date")).alias("query_date"),
    )
    factor, label = scoring.date_match(F.col("d"), F.col("query_date"))
    text = F.coalesce(F.col("query_date").cast("string"), F.lit("-"))
    return o.select("o_orderkey", text.alias("query_date"), factor.alias("date_boost"), label.alias("date_match"))


@REG.add(
    "w5_topic_match",
    f"WITH {SQL_BASE} SELECT query_id, chunk_id, {sql_r6('topic_boost')}, topic_match FROM scored_rows",
)
def w5_topic_match(spark, sf):
    return scored(spark, sf).select("query_id", "chunk_id", *r6("topic_boost"), "topic_match")


@REG.add("w6_is_topic_mismatch", f"WITH {SQL_BASE}, {SQL_PRIORITY} SELECT query_id, chunk_id, demoted AS mismatch FROM judged")
def w6_is_topic_mismatch(spark, sf):
    mismatch = scoring.is_topic_mismatch(F.col("topic_tags"), F.col("primary_topic"), F.col("query_topics"))
    return described(spark, sf).select("query_id", "chunk_id", mismatch.alias("mismatch"))


FACTORS = ("similarity", "source_weight", "category_boost", "content_type_boost", "recency", "date_boost", "topic_boost",
           "final_score")


@REG.add(
    "w7_final_score",
    f"""WITH {SQL_BASE}
        SELECT query_id, chunk_id, date_match, topic_match, {sql_r6(*FACTORS)},
               row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, chunk_id) AS rank_w
        FROM scored_rows""",
)
def w7_final_score(spark, sf):
    rows = scored(spark, sf).withColumn("rank_w", F.row_number().over(scoring.by_score()))
    return rows.select("query_id", "chunk_id", "date_match", "topic_match", *r6(*FACTORS), "rank_w")


# --- policy -------------------------------------------------------------------------------------------------------------
@REG.add(
    "k1_normalized_priority",
    f"""WITH {SQL_BASE}, {SQL_PRIORITY}
        SELECT query_id, chunk_id, card AS is_card, demoted AS topic_mismatch_demoted, retrieval_role,
               {sql_r6('type_boost', 'final_score')} FROM priority""",
)
def k1_normalized_priority(spark, sf):
    return policy.normalized_priority(scored(spark, sf)).select(
        "query_id", "chunk_id", "is_card", "topic_mismatch_demoted", "retrieval_role", *r6("type_boost", "final_score")
    )


@REG.add(
    "k2_expand_children",
    f"""WITH {SQL_BASE}, {SQL_PRIORITY}, {SQL_CHILDREN}
        SELECT query_id, chunk_id, coalesce(parent_chunk_id, -1) AS parent_chunk_id, is_child,
               {sql_r6('score', 'final_score')} FROM expanded""",
)
def k2_expand_children(spark, sf):
    rows = policy.expand_children(policy.normalized_priority(scored(spark, sf)), children(spark, sf))
    return rows.select(
        "query_id", "chunk_id", F.coalesce("parent_chunk_id", F.lit(-1)).alias("parent_chunk_id"), "is_child",
        *r6("score", "final_score"),
    )


@REG.add(
    "k3_threshold_and_cap",
    f"""WITH {SQL_BASE}, {SQL_PRIORITY}, {SQL_CHILDREN}, {SQL_THRESHOLD}
        SELECT query_id, chunk_id, rank_k3, filter_reason IS NULL AS passed,
               coalesce(filter_reason, '-') AS filter_reason FROM capped""",
)
def k3_threshold_and_cap(spark, sf):
    rows = policy.expand_children(policy.normalized_priority(scored(spark, sf)), children(spark, sf))
    return policy.threshold_and_cap(rows).select(
        "query_id", "chunk_id", "rank_k3", "passed", F.coalesce("filter_reason", F.lit("-")).alias("filter_reason")
    )


@REG.add(
    "k4_diversity_penalty",
    f"WITH {SQL_RANKED} SELECT query_id, chunk_id, {sql_r6('diversity_bonus', 'final_score')} FROM ranked WHERE passed",
)
def k4_diversity_penalty(spark, sf):
    rows = ranked(spark, sf).where("passed")
    return rows.select("query_id", "chunk_id", *r6("diversity_bonus", "final_score"))


@REG.add("k5_top_k", f"WITH {SQL_RANKED} SELECT query_id, chunk_id, rank_n, {sql_r6('final_score')} FROM final")
def k5_top_k(spark, sf):
    passed = ranked(spark, sf).where("passed").drop("rank_n")
    return policy.top_k(passed, RETRIEVAL.top_k).select("query_id", "chunk_id", "rank_n", *r6("final_score"))


@REG.add(
    "k6_split_by_role",
    f"""WITH {SQL_RANKED}
        SELECT query_id, count(*) FILTER (role = 'primary_card') AS primary_count,
               count(*) FILTER (role = 'raw_evidence') AS evidence_count,
               count(*) FILTER (role = 'raw_fallback') AS fallback_count FROM final GROUP BY query_id""",
)
def k6_split_by_role(spark, sf):
    return policy.split_by_role(finals(spark, sf))


COUNTS = ("candidate_count", "passed_count", "dropped_count", "card_candidate_count", "raw_candidate_count",
          "topic_mismatch_count", "topic_mismatch_demoted_count", "primary_count", "evidence_count", "fallback_count")


@REG.add(
    "k7_retrieval_summary",
    f"""WITH {SQL_RANKED}, {SQL_SUMMARY}
        SELECT query_id, {', '.join(COUNTS)}, 0.35::DOUBLE AS min_similarity, 0.3::DOUBLE AS min_final,
               2 AS max_per_file, 5 AS top_k FROM summary""",
)
def k7_retrieval_summary(spark, sf):
    return summary(spark, sf).select("query_id", *COUNTS, "min_similarity", "min_final", "max_per_file", "top_k")


@REG.add(
    "k8_debug_filter",
    f"""WITH {SQL_RANKED} SELECT query_id, chunk_id, card_type FROM ranked
        WHERE content_type = 'normalized_document' AND card_type = 'workflow'""",
)
def k8_debug_filter(spark, sf):
    rows = policy.debug_filter(ranked(spark, sf), "normalized_document", "workflow")
    return rows.select("query_id", "chunk_id", "card_type")


# --- evidence -----------------------------------------------------------------------------------------------------------
SQL_EVIDENCE = f"""tallies AS (
  SELECT s.query_id, s.query_topics, s.passed_count, s.card_candidate_count,
         count(*) FILTER (f.role = 'primary_card') AS np, count(*) FILTER (f.role = 'raw_evidence') AS ne,
         count(*) FILTER (f.role = 'raw_fallback') AS nf,
         count(*) FILTER (f.role = 'raw_fallback' AND len(s.query_topics) > 0
                          AND len({SQL_SPECIFIC.replace('topic_tags', 'f.topic_tags')}) > 0) AS nk,
         count(*) FILTER (f.role = 'raw_fallback' AND len(s.query_topics) > 0
                          AND len({SQL_SPECIFIC.replace('topic_tags', 'f.topic_tags')}) > 0
                          AND NOT list_has_any({SQL_SPECIFIC.replace('topic_tags', 'f.topic_tags')}, s.query_topics))
           AS nm
  FROM summary s LEFT JOIN final f USING (query_id)
  GROUP BY s.query_id, s.query_topics, s.passed_count, s.card_candidate_count),
ratios AS (
  SELECT *, CASE WHEN nk > 0 THEN nm / nk ELSE 0.0 END AS ratio, np = 0 AND nf > 0 AS only_raw,
         len(query_topics) > 0 AS clear FROM tallies)"""


@REG.add(
    "e1_evidence_policy",
    f"""WITH {SQL_RANKED}, {SQL_SUMMARY}, {SQL_EVIDENCE}
        SELECT query_id, only_raw AS raw_fallback_only,
               CASE WHEN NOT only_raw THEN '-' WHEN card_candidate_count > 0 THEN 'no_primary_normalized_document'
                    ELSE 'no_normalized_document_candidate' END AS raw_fallback_only_reason,
               nm AS fallback_mismatch_count, round(ratio, 6) AS fallback_mismatch_ratio,
               np > 0 OR ne > 0 AS primary_evidence_available, card_candidate_count > 0 AS normalized_document_available,
               only_raw AND clear AND nf >= 2 AND ratio >= 0.7 AS weak_evidence_warning,
               CASE WHEN passed_count < 1 THEN 'insufficient' WHEN np > 0 THEN 'strong' WHEN ne > 0 THEN 'medium'
                    WHEN only_raw AND clear AND ratio >= 0.7 THEN 'insufficient'
                    WHEN only_raw AND clear AND nm = 0 THEN 'medium' WHEN only_raw THEN 'weak'
                    ELSE 'insufficient' END AS evidence_strength
        FROM ratios""",
)
def e1_evidence_policy(spark, sf):
    rows = ranked(spark, sf)
    out = evidence.evidence_policy(summary(spark, sf, rows), retrieval.final_rows(rows))
    return out.withColumns(
        {
            "fallback_mismatch_ratio": F.round("fallback_mismatch_ratio", 6),
            "raw_fallback_only_reason": F.coalesce("raw_fallback_only_reason", F.lit("-")),
        }
    )


@REG.add(
    "e2_answerability",
    f"""WITH {SQL_RANKED}, {SQL_SUMMARY}
        SELECT query_id, passed_count < 1 AS generation_skipped,
               CASE WHEN passed_count >= 1 THEN '-' WHEN candidate_count = 0 THEN 'no_candidates'
                    ELSE 'below_threshold' END AS skip_reason,
               CASE WHEN passed_count < 1 THEN 'insufficient_evidence' WHEN primary_count > 0 THEN 'knowledge_card'
                    ELSE 'raw_fallback' END AS answer_mode FROM summary""",
)
def e2_answerability(spark, sf):
    out = evidence.answerability(summary(spark, sf))
    return out.withColumn("skip_reason", F.coalesce("skip_reason", F.lit("-")))


@REG.add(
    "e3_cap_per_file",
    """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
       WHERE n <= 2""",
)
def e3_cap_per_file(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return evidence.cap_per_file(docs, 2, "source", [F.col("doc_id")])


@REG.add(
    "e4_budget_pack",
    f"""WITH {SQL_RANKED},
        blocks AS (SELECT r.query_id, r.rank_n, r.chunk_id, length(d.text) + 2 AS n
                   FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.passed),
        running AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank_n)::BIGINT AS running_chars,
                           row_number() OVER (PARTITION BY query_id ORDER BY rank_n) AS k FROM blocks)
        SELECT query_id, chunk_id, rank_n, running_chars FROM running WHERE k = 1 OR running_chars <= 6000""",
)
def e4_budget_pack(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").alias("n"))
    blocks = ranked(spark, sf).where("passed").select("query_id", "chunk_id", "rank_n")
    blocks = retrieval.with_texts(blocks, texts, "n").where(F.col("n").isNotNull())
    packed = evidence.budget_pack(blocks, RETRIEVAL.max_context_chars, F.col("n"), "rank_n", ("query_id",), separator=2)
    return packed.select("query_id", "chunk_id", "rank_n", "running_chars")


def final_with_text(spark: SparkSession, sf: str) -> DataFrame:
    """Final rows with their whole document text, de-identified, as the body; a raw-table child has none."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    rows = retrieval.with_texts(finals(spark, sf), texts, "body")
    return rows.withColumns(
        {
            "body": anonymize(F.coalesce("body", F.lit(""))),
            "display_date": F.col("document_date").cast("string"),
            "card_id": F.when(F.col("is_card"), F.concat(F.lit("kc_"), F.col("chunk_id").cast("string"))),
        }
    )


SQL_SAFE = sql_mentions(sql_links("coalesce(d.text, '')"))
SQL_LANES = ("""laned AS (
  SELECT f.*, {SQL_SAFE} AS body, bool_or(role = 'primary_card') OVER q AS has_card, count(*) OVER q AS n_rows,
         count(*) OVER (PARTITION BY query_id, role) AS role_size,
         row_number() OVER (PARTITION BY query_id, role ORDER BY rank_n) AS role_no,
         row_number() OVER (PARTITION BY query_id, file_name ORDER BY rank_n) AS file_no
  FROM final f LEFT JOIN documents d ON d.doc_id = f.chunk_id WINDOW q AS (PARTITION BY query_id)),
budgets AS (
  SELECT *, CASE WHEN has_card THEN role ELSE 'plain' END AS lane,
         CASE WHEN NOT has_card THEN greatest(800, 6000 // greatest(2, n_rows))
              WHEN role = 'primary_card' THEN greatest(1000, 4200 // least(role_size, 5))
              WHEN role = 'raw_evidence' THEN greatest(500, 1500 // least(role_size, 3))
              ELSE greatest(400, 300 // role_size) END AS body_limit,
         CASE WHEN NOT has_card THEN 6000 WHEN role = 'primary_card' THEN 4200 WHEN role = 'raw_evidence' THEN 1500
              ELSE 300 END AS budget
  FROM laned
  WHERE (has_card AND role_no <= CASE role WHEN 'primary_card' THEN 5 ELSE 3 END) OR (NOT has_card AND file_no <= 2)),
texts AS (
  SELECT b.*, row_number() OVER (PARTITION BY query_id, lane ORDER BY rank_n) AS block_no,
         CASE WHEN length(body) <= body_limit THEN body
              ELSE regexp_replace(substr(body, 1, body_limit - 3), '\\s+$', '') || '...' END AS cut,
         coalesce(CAST(c.document_date AS VARCHAR), '-') AS display_date
  FROM budgets b LEFT JOIN chunks c USING (chunk_id)),
blocks AS (
  SELECT *, CASE lane
    WHEN 'primary_card' THEN '[ND #' || block_no || ']' || chr(10) || '- normalized_document_id: kc_' || chunk_id || chr(10)
      || '- normalized_document_type: ' || card_type || chr(10) || '- title: ' || section_title || chr(10)
      || '- primary_topic: ' || coalesce(primary_topic, '-') || chr(10)
      || '- topic_tags: [' || array_to_string(['''' || t || '''' for t in topic_tags], ', ') || ']' || chr(10)
      || '- task_type: -' || chr(10) || '- answer_use_cases: -' || chr(10) || '- source_file_name: ' || file_name || chr(10)
      || '- source_category: ' || uploaded_category || chr(10) || '- display_date: ' || display_date || chr(10)
      || '- final_score: ' || printf('%.4f', floor(final_score * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE) || chr(10) || '- parent_raw_chunk_ids: []' || chr(10)
    WHEN 'plain' THEN '[근거 #' || block_no || ']' || chr(10) || '- file_name: ' || file_name || chr(10)
      || '- uploaded_category: ' || uploaded_category || chr(10) || '- source_type: ' || source_type || chr(10)
      || '- content_type: ' || content_type || chr(10) || '- section_title: ' || section_title || chr(10)
      || '- display_date: ' || display_date || chr(10) || '- primary_topic: ' || coalesce(primary_topic, '-') || chr(10)
      || '- todo_phase: -' || chr(10) || '- parser_format: -' || chr(10) || '- chunk_index: ' || chunk_index || chr(10)
      || '- final_score: ' || printf('%.4f', floor(final_score * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE) || chr(10)
    ELSE '[RAW #' || block_no || ']' || chr(10) || '- file_name: ' || file_name || chr(10)
      || '- uploaded_category: ' || uploaded_category || chr(10) || '- source_type: ' || source_type || chr(10)
      || '- content_type: ' || content_type || chr(10) || '- section_title: ' || section_title || chr(10)
      || '- display_date: ' || display_date || chr(10) || '- chunk_index: ' || chunk_index || chr(10)
      || '- final_score: ' || printf('%.4f', floor(final_score * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE) || chr(10)
    END || '---' || chr(10) || cut || chr(10) AS block
  FROM texts),
packed AS (
  SELECT * FROM (SELECT *, sum(length(block)) OVER (PARTITION BY query_id, lane ORDER BY block_no)::BIGINT AS running_chars
                 FROM blocks) WHERE block_no = 1 OR running_chars <= budget)""").replace("{SQL_SAFE}", SQL_SAFE)


@REG.add(
    "e5_context_blocks",
    f"WITH {SQL_RANKED}, {SQL_LANES} SELECT query_id, chunk_id, lane, block_no, block, running_chars FROM packed",
)
def e5_context_blocks(spark, sf):
    return evidence.context_blocks(final_with_text(spark, sf))


USE_CASE_TEXTS = ["", "Summary | procedure", "compare,summary", "nonsense"]


@REG.add(
    "e6_answer_format",
    f"""WITH {SQL_RANKED},
        cards AS (SELECT query_id, rank_n, card_type,
                         {sql_case('card_type', vocab.CARD_TYPE_USE_CASE, 'NULL')} AS implied,
                         CASE chunk_id % 4 WHEN 1 THEN 'summary' WHEN 2 THEN 'compare' END AS stated
                  FROM final WHERE role = 'primary_card'),
        facts AS (SELECT query_id, bool_or(card_type = 'glossary') AS g,
                         arg_min(stated, rank_n) FILTER (stated IS NOT NULL) AS stated,
                         arg_min(implied, rank_n) FILTER (implied IS NOT NULL) AS implied FROM cards GROUP BY query_id)
        SELECT query_id, CASE WHEN coalesce(g, false) OR {sql_any('lower(question)', vocab.GLOSSARY_WORDS)} THEN 'glossary'
               ELSE coalesce({sql_first('lower(question)', vocab.ANSWER_INTENTS)}, stated, implied, 'freeform_grounded')
               END AS answer_format
        FROM questions LEFT JOIN facts USING (query_id)""",
)
def e6_answer_format(spark, sf):
    cards = evidence.with_role(finals(spark, sf)).where(F.col("role") == "primary_card")
    cards = cards.withColumn("answer_use_cases", pick(F.col("chunk_id"), USE_CASE_TEXTS))
    return evidence.answer_format(questions(spark, sf), cards)


@REG.add(
    "e7_source_listing",
    f"""WITH {SQL_RANKED},
        numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY rank_n) AS source_no FROM final),
        shown AS (SELECT n.*, {sql_squeeze(sql_mentions(sql_links("coalesce(d.text, '')")))} AS flat
                  FROM numbered n LEFT JOIN documents d ON d.doc_id = n.chunk_id WHERE source_no <= 3)
        SELECT query_id, role, source_no, chunk_id,
               file_name || ' · ' || section_title || CASE WHEN card_type IS NULL THEN '' ELSE ' (' || card_type || ')' END
                 AS label,
               CASE WHEN length(flat) <= 240 THEN flat ELSE rtrim(substr(flat, 1, 239)) || '…' END AS preview,
               coalesce(topic_match, '-') AS topic_match, {sql_r6('final_score')}
        FROM shown""",
)
def e7_source_listing(spark, sf):
    out = evidence.source_listing(final_with_text(spark, sf))
    return out.select(
        "query_id", "role", "source_no", "chunk_id", "label", "preview",
        F.coalesce("topic_match", F.lit("-")).alias("topic_match"), *r6("final_score"),
    )


@REG.add(
    "e8_request_gate",
    """SELECT event_id, user_id FROM events
       WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def e8_request_gate(spark, sf):
    """Allowed users are the customers with an urgent order."""
    allowed = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    allowed = allowed.select(F.col("o_custkey").alias("user_id"))
    return evidence.request_gate(table(spark, sf, "events"), "user_id", allowed).select("event_id", "user_id")


@REG.add(
    "a5_score_distribution",
    f"""WITH {SQL_RANKED}
        SELECT uploaded_category, count(*) AS n, floor(avg(final_score) * 1e6 + 0.5) / 1e6 AS mean_score,
               floor(quantile_disc(final_score, 0.5) * 1e6 + 0.5) / 1e6 AS median_score, floor(max(final_score) * 1e6 + 0.5) / 1e6 AS max_score,
               floor(count(*) / (SELECT count(*) FROM final) * 1e6 + 0.5) / 1e6 AS share
        FROM final GROUP BY uploaded_category""",
)
def a5_score_distribution(spark, sf):
    out = evaluate.score_distribution(finals(spark, sf))
    return out.select("uploaded_category", "n", *r6("mean_score", "median_score", "max_score", "share"))
