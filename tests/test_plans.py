"""What the plans look like: limits before shuffles, pruned scans, no Python where the JVM suffices, no cross joins."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loresmith.config import RetrievalConfig
from loresmith.functions.questions import query_features
from loresmith.operators import evidence, keyword
from loresmith.plans import retrieval
from loresmith.plans.ingest import ingest_documents
from loresmith.session import fits_broadcast, scratch_dir, written
from loresmith.sources import files

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["r5_bm25_topk", "c8_dedup_exact", "e3_cap_per_file", "g1_work_list"])
def test_row_limits_are_pushed_below_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize(
    "name", ["r5_bm25_topk", "t11_anonymize", "c2_line_chunks", "p4_thread_messages", "p6_thread_sections", "n4_coerce_card", "k3_threshold_and_cap", "g4_embedding_worklist"]
)
def test_no_python_in_jvm_operators(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "Python" not in text and "MapInArrow" not in text


@pytest.mark.parametrize("name", ["r5_bm25_topk", "r2_vector_topk", "k5_top_k", "a7_truth_pairs", "k2_expand_children"])
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["r7_category_filter"](spark, SF))
    assert "EqualTo(lang,en)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 110


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "bm25_rank", "bm25_score", "bm25_norm"] and df.count() > 0


@pytest.mark.parametrize("hybrid", [True, False])
def test_from_files_to_context(spark, tmp_path, hybrid):
    """Chunks as the ingest makes them (string ids) are indexed, found, ranked and packed."""
    texts = {"guide": "# 정산\nsettlement steps alpha beta", "misc": "gamma delta unrelated notes", "slack_manual": "[09:12] kim: alpha meeting"}
    for folder, text in texts.items():
        (tmp_path / "raw" / folder).mkdir(parents=True)
        (tmp_path / "raw" / folder / "f.md").write_text(text)
    root = str(tmp_path / "raw")
    made = written(ingest_documents(files.load_documents(files.read_files(spark, root), root), 2026), "chunks")
    assert made.schema["chunk_id"].dataType.simpleString() == "string" and made.count() == 3
    ids = sorted(r["chunk_id"] for r in made.collect())
    vectors = spark.createDataFrame([(c, [float(i == k) for k in range(3)]) for i, c in enumerate(ids)], "chunk_id string, vector array<double>")
    texts_of = made.select("chunk_id", F.col("clean_content").alias("text"))
    chunks = made.withColumns({
        "card_type": F.lit(None).cast("string"), "source_file_hash": F.lit(None).cast("string"),
        "created_at": F.lit(None).cast("timestamp")})
    corpus = retrieval.Corpus(texts_of, vectors, chunks, None, keyword.build_index(texts_of, "chunk_id"))
    asked = spark.createDataFrame([(1, "settlement alpha")], "query_id long, question string")
    target = next(r["chunk_id"] for r in made.collect() if "settlement" in r["clean_content"])
    q = vectors.where(F.col("chunk_id") == target).select(F.lit(1).cast("long").alias("query_id"), "vector")
    cfg = RetrievalConfig(hybrid=hybrid)
    ranked = retrieval.retrieve(asked, query_features(asked, 2026), q, corpus, F.lit("2026-05-01"), cfg)
    final = retrieval.with_texts(retrieval.final_rows(ranked, cfg), texts_of.withColumnRenamed("text", "body"), "body").withColumns(
        {"display_date": F.lit("-"), "card_id": F.lit(None).cast("string"), "document_date": F.col("document_date")})
    first = final.orderBy("rank_n").first()
    assert first["chunk_id"] == target
    assert (final.where("bm25_rank IS NOT NULL").count() > 0) is hybrid
    blocks = evidence.context_blocks(final).orderBy("block_no").collect()
    assert "settlement steps" in blocks[0]["block"]


def test_broadcast_guard_adds_partial_sums(spark):
    """Nothing but sums leaves the tasks, and strings, arrays and nested values are measured."""
    df = spark.range(0, 1000, 1, 8).select(F.lit("x" * 100).alias("s"), F.array(F.lit(1.0), F.lit(2.0)).alias("a"), F.struct(F.lit("y" * 50)).alias("n"))
    assert fits_broadcast(df) and not fits_broadcast(df, max_bytes=100_000) and not fits_broadcast(df, max_rows=999)
    assert fits_broadcast(df.limit(0))


def test_scratch_folder_is_the_sessions(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
