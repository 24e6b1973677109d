"""Retrieval: tokens, index, BM25, cosine search, fusion; and the quality measures on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import SQL_QUESTIONS, Registry, questions, table
from loresmith.functions.tokens import SEPARATORS, TOKEN, search_tokens
from loresmith.functions.vectors import cosine
from loresmith.operators import containment, evaluate, fusion, keyword, keyword_blocks, nearest, rotated
from loresmith.operators.keyword_store import KeywordStore
from loresmith.session import scratch_dir, spread

REG = Registry()


def sql_terms(name: str, source: str, id_expr: str, text_expr: str) -> str:
    """CTE <name>(id, term): one row per emitted token, aliases included."""
    return f"""{name}_base AS (
  SELECT {id_expr} AS id, unnest(regexp_extract_all(lower({text_expr}), '{TOKEN}')) AS t FROM {source}),
{name} AS (
  SELECT id, t AS term FROM {name}_base
  UNION ALL
  SELECT id, regexp_replace(t, '{SEPARATORS}', '', 'g') FROM {name}_base WHERE regexp_matches(t, '{SEPARATORS}')
  UNION ALL
  SELECT id, p FROM (SELECT id, unnest(regexp_split_to_array(t, '{SEPARATORS}')) AS p
                     FROM {name}_base WHERE regexp_matches(t, '{SEPARATORS}')) WHERE p <> '')"""


SQL_INDEX = (
    sql_terms("doc_terms", "documents", "doc_id", "text")
    + """,
postings AS (SELECT id AS doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
doc_stats AS (
  SELECT d.doc_id, coalesce(p.dl, 0)::BIGINT AS dl
  FROM documents d LEFT JOIN (SELECT doc_id, sum(tf) AS dl FROM postings GROUP BY doc_id) p USING (doc_id)),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM doc_stats),
terms AS (
  SELECT term, count(*) AS df, ln(1.0 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM postings, corpus GROUP BY term)"""
)


def sql_bm25(source: str, text: str, k: int) -> str:
    """CTEs up to bm25(query_id, chunk_id, bm25_score, bm25_rank, bm25_norm) for a table of questions."""
    return (
        SQL_INDEX
        + ",\n"
        + sql_terms("q_terms", source, "query_id", text)
        + f""",
asked AS (SELECT DISTINCT id AS query_id, term FROM q_terms),
scored AS (
  SELECT query_id, doc_id AS chunk_id,
         sum(idf * (tf * 2.5) / (tf + 1.5 * (1.0 - 0.75 + 0.75 * dl / avgdl))) AS bm25_score
  FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN doc_stats USING (doc_id), corpus
  GROUP BY query_id, doc_id),
bm25_all AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, chunk_id) AS bm25_rank
  FROM scored WHERE bm25_score > 0),
bm25 AS (
  SELECT *, round(bm25_score / max(bm25_score) OVER (PARTITION BY query_id), 12) AS bm25_norm
  FROM bm25_all WHERE bm25_rank <= {k})"""
    )


SQL_BENCH = "bench AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
SQL_VECTOR = """vector AS (
  SELECT * FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id,
           round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS vector_score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY
             round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS vector_rank
    FROM embeddings q SEMI JOIN benchmark b ON q.vec_id = b.item_id, embeddings v)
  WHERE vector_rank <= 15)"""
SQL_FUSED = """fused AS (
  SELECT query_id, chunk_id, vector_rank, vector_score, bm25_rank, bm25_score, bm25_norm,
         coalesce(1.0 / (60 + vector_rank), 0.0) + coalesce(1.0 / (60 + bm25_rank), 0.0) AS rrf_score,
         greatest(coalesce(vector_score, 0.0), coalesce(bm25_norm, 0.0)) AS score
  FROM vector FULL OUTER JOIN bm25 USING (query_id, chunk_id))"""


def bench(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vector with a question's number stands in for that question's embedding."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id"))
    asked = vectors(spark, sf).join(items, "chunk_id", "left_semi")
    return asked.select(F.col("chunk_id").alias("query_id"), "vector")


def keyword_hits(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    return keyword.bm25_scan(bench(spark, sf), table(spark, sf, "documents"), k)


@REG.add(
    "r1_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def r1_cosine(spark, sf):
    a, b = vectors(spark, sf), vectors(spark, sf)
    b = b.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vector").alias("other"))
    return a.join(b, "chunk_id").select(
        F.col("chunk_id").alias("vec_id"), F.round(cosine(F.col("vector"), F.col("other")), 6).alias("cosine")
    )


@REG.add(
    "r2_vector_topk",
    f"WITH {SQL_VECTOR} SELECT query_id, chunk_id, vector_rank, round(vector_score, 6) AS vector_score FROM vector",
)
def r2_vector_topk(spark, sf):
    found = nearest.vector_topk(query_vectors(spark, sf), vectors(spark, sf), 15)
    return found.select("query_id", "chunk_id", "vector_rank", F.round("vector_score", 6).alias("vector_score"))


@REG.add(
    "r2_vector_topk_rotated",
    f"WITH {SQL_VECTOR} SELECT query_id, chunk_id, vector_rank, round(vector_score, 6) AS vector_score FROM vector",
)
def r2_vector_topk_rotated(spark, sf):
    """The same rows from vectors in principal axes, given up by bounds after their leading components."""
    stored = vectors(spark, sf)
    axes = rotated.principal_axes(stored)
    found = rotated.vector_topk_rotated(query_vectors(spark, sf), rotated.rotated_vectors(stored, axes), axes, 15)
    return found.select("query_id", "chunk_id", "vector_rank", F.round("vector_score", 6).alias("vector_score"))


@REG.add(
    "r2a_vector_topk_approx",
    f"""WITH {SQL_VECTOR} SELECT query_id, chunk_id, vector_rank, round(vector_score, 6) AS vector_score FROM vector""",
)
def r2a_vector_topk_approx(spark, sf):
    """The found rows.  At this size the quantized scan misses none, so the SQL is that of the exact search."""
    found = nearest.vector_topk_approx(query_vectors(spark, sf), vectors(spark, sf), 15)
    return found.select("query_id", "chunk_id", "vector_rank", F.round("vector_score", 6).alias("vector_score"))


@REG.add(
    "r3_tokenize",
    f"""WITH {sql_terms("doc_terms", "documents", "doc_id", "text")}
        SELECT id AS doc_id, count(*) AS tokens, count(DISTINCT term) AS distinct_tokens,
               min(term) AS first_token, max(term) AS last_token
        FROM doc_terms GROUP BY id""",
)
def r3_tokenize(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", search_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return docs.select(
        "doc_id",
        F.size("t").cast("long").alias("tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"),
        F.array_min("t").alias("first_token"),
        F.array_max("t").alias("last_token"),
    )


@REG.add(
    "r4_bm25_index",
    f"""WITH {SQL_INDEX}
        SELECT term, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl, n_docs, tf_total
        FROM terms JOIN (SELECT term, sum(tf)::BIGINT AS tf_total FROM postings GROUP BY term) USING (term), corpus""",
)
def r4_bm25_index(spark, sf):
    index = keyword.build_index(table(spark, sf, "documents"))
    totals = index.postings.groupBy("term").agg(F.sum("tf").alias("tf_total"))
    n_docs = index.corpus.select("n_docs").scalar()
    return index.terms.join(totals, "term").select(
        "term", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"), n_docs.alias("n_docs"), "tf_total"
    )


SQL_BM25_OUT = """SELECT query_id, chunk_id, bm25_rank, round(bm25_score, 6) AS bm25_score,
       round(bm25_norm, 6) AS bm25_norm FROM bm25"""


@REG.add("r5_bm25_topk", f"WITH {SQL_BENCH},\n{sql_bm25('bench', 'question', 5)}\n{SQL_BM25_OUT}")
def r5_bm25_topk(spark, sf):
    return keyword_hits(spark, sf).select(
        "query_id", "chunk_id", "bm25_rank", F.round("bm25_score", 6).alias("bm25_score"),
        F.round("bm25_norm", 6).alias("bm25_norm"),
    )


@REG.add("r5_bm25_topk_indexed", f"WITH {SQL_BENCH},\n{sql_bm25('bench', 'question', 20)}\n{SQL_BM25_OUT}")
def r5_bm25_topk_indexed(spark, sf):
    index = keyword.build_index(table(spark, sf, "documents"))
    return keyword.bm25_topk(bench(spark, sf), index).select(
        "query_id", "chunk_id", "bm25_rank", F.round("bm25_score", 6).alias("bm25_score"),
        F.round("bm25_norm", 6).alias("bm25_norm"),
    )


def ranked_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id", "chunk_id", "bm25_rank", F.round("bm25_score", 6).alias("bm25_score"), F.round("bm25_norm", 6).alias("bm25_norm"))


@REG.add("r5_bm25_topk_pruned", f"WITH {SQL_BENCH},\n{sql_bm25('bench', 'question', 5)}\n{SQL_BM25_OUT}")
def r5_bm25_topk_pruned(spark, sf):
    """The best five by bounds on blocks of postings: the rows of the search that scores everything."""
    index = keyword_blocks.build_block_index(table(spark, sf, "documents"))
    return ranked_columns(keyword_blocks.bm25_topk_pruned(bench(spark, sf), index, 5))


def stored_index(spark: SparkSession, sf: str) -> KeywordStore:
    """Documents added in batches by source, those of good quality replaced by a text with its language, toxic ones deleted."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf, "labels")
    store = KeywordStore.create(spark, scratch_dir(spark, "keyword-store"))
    early = F.col("source") < "src3"
    for batch in (documents.where(early), documents.where(~early)):
        store.add(batch, facet_col="lang")
    good = documents.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    store.add(good.withColumn("text", F.concat("lang", F.lit(" "), "text")), skip_existing=False, facet_col="lang")
    store.delete(labels.where("toxic = 1").select("doc_id"))
    return store


SQL_HELD = """held AS (
  SELECT d.doc_id, d.lang, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN lang || ' ' || text ELSE text END AS text
  FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def sql_held(condition: str, k: int) -> str:
    """CTEs up to bm25 over the held documents that meet the condition."""
    ranked = sql_bm25("bench", "question", k).replace("documents", "held_part")
    return f"{SQL_HELD}, held_part AS (SELECT * FROM held WHERE {condition}), {SQL_BENCH},\n{ranked}"


@REG.add("r4_stored_index_topk", f"WITH {sql_held('true', 5)}\n{SQL_BM25_OUT}")
def r4_stored_index_topk(spark, sf):
    """Keyword search over an index that was added to, replaced in and deleted from, batch by batch."""
    return ranked_columns(keyword_blocks.bm25_topk_pruned(bench(spark, sf), stored_index(spark, sf).index(), 5))


@REG.add(
    "r4_stored_index_terms",
    f"""WITH {sql_held('true', 5)}
        SELECT term, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl, n_docs FROM terms, corpus""",
)
def r4_stored_index_terms(spark, sf):
    index = stored_index(spark, sf).index()
    n_docs = index.corpus.select("n_docs").scalar()
    return index.terms_among(None).select(
        "term", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"), n_docs.alias("n_docs"))


FACETS = {"en": ["en"], "de": ["de"], "de+fr": ["de", "fr"]}


def sql_facet(name: str, langs: list[str]) -> str:
    listed = ", ".join(f"'{lang}'" for lang in langs)
    return f"""SELECT '{name}' AS facets, * FROM (WITH {sql_held(f"lang IN ({listed})", 5)}\n{SQL_BM25_OUT})"""


@REG.add("r4_faceted_topk", " UNION ALL ".join(sql_facet(name, langs) for name, langs in FACETS.items()))
def r4_faceted_topk(spark, sf):
    """One index asked within categories: statistics are those of the category's documents, or of two categories' together."""
    index, parts = stored_index(spark, sf).index(), []
    for name, langs in FACETS.items():
        found = keyword_blocks.bm25_topk_pruned(bench(spark, sf), index.only(langs), 5)
        parts.append(ranked_columns(found).select(F.lit(name).alias("facets"), "*"))
    return parts[0].union(parts[1]).union(parts[2])


SQL_HYBRID = f"{SQL_QUESTIONS},\n{sql_bm25('questions', 'question', 20)},\n{SQL_VECTOR},\n{SQL_FUSED}"


def fused(spark: SparkSession, sf: str) -> DataFrame:
    found = nearest.vector_topk(query_vectors(spark, sf), vectors(spark, sf), 15)
    return fusion.rrf_fuse(found, keyword.bm25_scan(questions(spark, sf), table(spark, sf, "documents")))


@REG.add(
    "r6_rrf_fuse",
    f"""WITH {SQL_HYBRID}
        SELECT query_id, chunk_id, coalesce(vector_rank, 0) AS vector_rank, coalesce(bm25_rank, 0) AS bm25_rank,
               round(rrf_score, 6) AS rrf_score, round(score, 6) AS score,
               CASE WHEN vector_rank IS NULL THEN 'bm25' WHEN bm25_rank IS NULL THEN 'vector'
                    ELSE 'vector,bm25' END AS sources,
               row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, round(score, 9) DESC,
                                  chunk_id) AS rrf_rank
        FROM fused""",
)
def r6_rrf_fuse(spark, sf):
    return fusion.rank_fused(fused(spark, sf)).select(
        "query_id", "chunk_id", F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"),
        F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.round("rrf_score", 6).alias("rrf_score"),
        F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"), "rrf_rank",
    )


@REG.add(
    "r6_fusion_counts",
    f"""WITH {SQL_HYBRID}
        SELECT query_id, count(vector_rank) AS vector_count, count(bm25_rank) AS bm25_count, count(*) AS merged_count,
               count(*) FILTER (bm25_rank IS NULL) AS vector_only_count,
               count(*) FILTER (vector_rank IS NULL) AS bm25_only_count,
               count(*) FILTER (vector_rank IS NOT NULL AND bm25_rank IS NOT NULL) AS overlap_count
        FROM fused GROUP BY query_id""",
)
def r6_fusion_counts(spark, sf):
    return fusion.fusion_counts(fused(spark, sf))


@REG.add(
    "r7_category_filter",
    "SELECT doc_id, lang AS uploaded_category FROM documents WHERE lang = 'en'",
)
def r7_category_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("uploaded_category"))
    return fusion.category_filter(fusion.category_filter(docs, "전체"), "en")


# --- quality ----------------------------------------------------------------------------------------------------------
SQL_TRUTH = """truth AS (
  SELECT b.item_id AS query_id, d.doc_id AS chunk_id
  FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text))"""
SQL_HITS = f"""{SQL_BENCH},
{sql_bm25('bench', 'question', 5)},
{SQL_TRUTH},
hits AS (
  SELECT b.query_id, min(bm25_rank) AS rank
  FROM bench b LEFT JOIN (SELECT bm25.* FROM bm25 SEMI JOIN truth USING (query_id, chunk_id)) r USING (query_id)
  GROUP BY b.query_id)"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """A document is a true answer to an item when it contains the item, letter for letter."""
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    pairs = containment.containing_pairs(passages, spread(texts))
    return pairs.select(F.col("passage_id").alias("query_id"), F.col("text_id").alias("chunk_id"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.query_hits(keyword_hits(spark, sf), truth(spark, sf), bench(spark, sf), "bm25_rank")


@REG.add("a7_truth_pairs", f"WITH {SQL_TRUTH} SELECT query_id, chunk_id FROM truth")
def a7_truth_pairs(spark, sf):
    return truth(spark, sf)


@REG.add(
    "a1_hit_rate",
    f"""WITH {SQL_HITS} SELECT count(*) AS queries,
        round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate FROM hits""",
)
def a1_hit_rate(spark, sf):
    return evaluate.hit_rate(hits(spark, sf)).select("queries", F.round("hit_rate", 6).alias("hit_rate"))


@REG.add(
    "a2_reciprocal_rank",
    f"WITH {SQL_HITS} SELECT count(*) AS queries, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM hits",
)
def a2_reciprocal_rank(spark, sf):
    return evaluate.mean_reciprocal_rank(hits(spark, sf)).select("queries", F.round("mrr", 6).alias("mrr"))


@REG.add(
    "a3_source_coverage",
    f"""WITH {SQL_BENCH},
{sql_bm25('bench', 'question', 5)},
cited AS (SELECT bm25.query_id, d.source FROM bm25 JOIN documents d ON d.doc_id = bm25.chunk_id)
SELECT b.item_id AS answer_id, count(c.source) AS cited_count,
       round(coalesce(avg(CASE WHEN contains(lower(b.text || ' (SRC' || b.item_id % 20 || ')'), c.source)
                               THEN 1.0 ELSE 0.0 END) FILTER (c.source IS NOT NULL), 0.0), 6) AS coverage
FROM benchmark b LEFT JOIN cited c ON c.query_id = b.item_id GROUP BY b.item_id""",
)
def a3_source_coverage(spark, sf):
    """Answers name one source each; the cited chunks are the keyword hits."""
    source = F.concat(F.lit(" (SRC"), (F.col("item_id") % 20).cast("string"), F.lit(")"))
    answers = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("answer_id"), F.concat("text", source).alias("answer")
    )
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_name"))
    cited = keyword_hits(spark, sf).join(docs, "chunk_id").select(F.col("query_id").alias("answer_id"), "file_name")
    return evaluate.source_coverage(answers, cited).select(
        "answer_id", "cited_count", F.round("coverage", 6).alias("coverage")
    )


@REG.add(
    "a4_embedding_compare",
    """WITH s AS (
         SELECT 'label' || a.label AS model,
                list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
         FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
       SELECT model, count(*) AS pairs, round(avg(sim), 6) AS mean_sim, round(min(sim), 6) AS min_sim,
              round(max(sim), 6) AS max_sim FROM s GROUP BY model""",
)
def a4_embedding_compare(spark, sf):
    """Each vector against its successor; the label plays the model that produced the pair."""
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("doc_vector"))
    pairs = e.join(nxt, "vec_id").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("model"),
        F.col("embedding").alias("query_vector"), "doc_vector",
    )
    out = evaluate.embedding_compare(pairs)
    return out.select("model", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_sim", "min_sim", "max_sim")])


@REG.add(
    "a6_usage_counters",
    """SELECT event_type AS kind, count(*) AS calls, sum((props->>'$.k')::BIGINT)::BIGINT AS items,
              arg_max(value, (ts, event_id)) AS last_size
       FROM events GROUP BY event_type""",
)
def a6_usage_counters(spark, sf):
    e = table(spark, sf, "events")
    items = F.get_json_object("props", "$.k").cast("long")
    return evaluate.usage_counters(e, "event_type", items, "ts", F.col("value"))
