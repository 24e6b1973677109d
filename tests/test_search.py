import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresmith.functions.tokens import search_tokens
from loresmith.functions.vectors import cosine
from loresmith.operators import containment, evaluate, fusion, keyword, nearest


def docs_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def questions_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("T&D report", ["t&d", "report", "td", "t", "d"]),
        ("Advantage+", ["advantage+", "advantage", "advantage"]),
        ("정산 가이드", ["정산", "가이드"]),
        ("", []),
        ("... !!", []),
    ],
)
def test_tokens(one, text, tokens):
    assert one(search_tokens, text) == tokens


def brute_bm25(docs, question, tokens_of, k1=1.5, b=0.75):
    tf = [Counter(tokens_of(d)) for d in docs]
    avg = sum(sum(c.values()) for c in tf) / len(docs)
    out = {}
    for i, c in enumerate(tf):
        s = 0.0
        for t in set(tokens_of(question)):
            df = sum(1 for x in tf if t in x)
            if c[t]:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                s += idf * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sum(c.values()) / avg))
        if s > 0:
            out[i] = s
    return out


def test_bm25_scan_and_index_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)]
    asked = ["alpha beta", "ZETA zeta zeta", "nothing", "", "gamma delta eps"]
    plain = lambda s: s.lower().split()
    q, d = questions_df(spark, asked), docs_df(spark, docs)
    scan = keyword.bm25_scan(q, d, 100)
    index = keyword.bm25_topk(q, keyword.build_index(d), 100)
    for result in (scan, index):
        got = {}
        for r in result.collect():
            got.setdefault(r["query_id"], {})[r["chunk_id"]] = r["bm25_score"]
        for i, text in enumerate(asked):
            want = brute_bm25(docs, text, plain)
            assert got.get(i, {}).keys() == want.keys()
            for doc, score in want.items():
                assert got[i][doc] == pytest.approx(score)


def test_bm25_ranks_and_normalization(spark):
    d = docs_df(spark, ["apple pie", "apple", "banana"])
    rows = keyword.bm25_scan(questions_df(spark, ["apple"]), d, 5).orderBy("bm25_rank").collect()
    assert [r["bm25_rank"] for r in rows] == [1, 2]
    assert rows[0]["bm25_norm"] == 1.0 and rows[0]["chunk_id"] == 1
    assert keyword.bm25_scan(questions_df(spark, ["apple"]), d, 0).count() == 0


def test_index_survives_save_and_load(spark, tmp_path):
    index = keyword.build_index(docs_df(spark, ["apple pie", "", "banana"]))
    index.save(str(tmp_path / "ix"))
    back = keyword.KeywordIndex.load(spark, str(tmp_path / "ix"))
    assert back.corpus.first()["n_docs"] == 3
    assert back.terms.count() == 3


def test_hot_term_is_not_gathered(spark):
    """A third of all documents share one term; the result is whole and equal ids follow each other."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot x").otherwise("cold").alias("text"))
    rows = keyword.bm25_scan(questions_df(spark, ["hot"]), d, 2000).agg(F.count("*"), F.min("chunk_id"), F.max("chunk_id")).first()
    assert tuple(rows) == (1000, 0, 2997)


def vectors(spark, n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows, "chunk_id long, vector array<float>")


def brute_knn(m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T
    return {(q, int(c)) for q in range(len(m)) for c in np.lexsort((np.arange(len(m)), -sims[q].round(6)))[:k]}


def test_vector_topk_in_any_blocks_equals_brute_force(spark):
    m, v = vectors(spark, 120)
    q = v.select(F.col("chunk_id").alias("query_id"), "vector")
    want = brute_knn(m, 7)
    for limits in ({}, {"query_block": 13, "slice_rows": 11}):
        got = nearest.vector_topk(q, v, 7, **limits).collect()
        assert {(r["query_id"], r["chunk_id"]) for r in got} == want
        assert all(r["vector_score"] == 1.0 for r in got if r["query_id"] == r["chunk_id"])


def test_vector_topk_skips_empty_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, [0.0, 0.0])], "chunk_id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r["chunk_id"], r["vector_score"]) for r in nearest.vector_topk(q, v, 5).orderBy("vector_rank").collect()] == [(1, 1.0), (3, 0.0)]


def test_vector_topk_approx_recall(spark):
    sf = "/root/testdata/sf0.01"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = v.select(F.col("chunk_id").alias("query_id"), "vector")
    exact = nearest.vector_topk(q, v, 5).select("query_id", "chunk_id")
    near = nearest.vector_topk_approx(q, v, 5).select("query_id", "chunk_id")
    found = exact.intersect(near).count() / exact.count()
    share = nearest.vector_candidates_approx(q, v, 5).count() / 500**2
    assert found > 0.95 and share < 0.05


def test_vector_topk_ids_and_lengths(spark):
    """Ids as the engine makes them; a vector of another length is not compared."""
    v = spark.createDataFrame(
        [("doc_b_00001_aaaaaa", [1.0, 0.0]), ("doc_a_00001_aaaaaa", [1.0, 0.0]), ("doc_c_00001_aaaaaa", [1.0, 0.0, 0.0])],
        "chunk_id string, vector array<float>")
    q = spark.createDataFrame([("q1", [2.0, 0.0])], "query_id string, vector array<float>")
    for search in (nearest.vector_topk, nearest.vector_topk_approx):
        got = search(q, v, 5).orderBy("vector_rank").collect()
        assert [(r["query_id"], r["chunk_id"], r["vector_score"]) for r in got] == [
            ("q1", "doc_a_00001_aaaaaa", 1.0), ("q1", "doc_b_00001_aaaaaa", 1.0)]


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([], [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_containing_pairs_of_short_passages(spark):
    passages = spark.createDataFrame([(1, "abc"), (2, "b"), (3, "zz"), (4, ""), (5, "abc")], "passage_id long, passage string")
    texts = spark.createDataFrame([(10, "xxabcxx"), (11, "b b b"), (12, None), (13, "none of it")], "text_id long, text string")
    want = {(1, 10), (5, 10), (2, 10), (2, 11)}
    assert {tuple(r) for r in containment.containing_pairs(passages, texts).collect()} == want


def test_containing_pairs_of_longer_passages(spark):
    """Edge words may be cut in the text; ids are strings."""
    passages = spark.createDataFrame([("p", "ut inner word\nlast"), ("q", "one inner"), ("r", "a b")], "passage_id string, passage string")
    texts = spark.createDataFrame(
        [("t", "cut inner word\nlasting"), ("u", "inner word"), ("v", "none inner  a b"), ("w", "ut inner word last")], "text_id string, text string")
    assert {tuple(r) for r in containment.containing_pairs(passages, texts).collect()} == {("p", "t"), ("q", "v"), ("r", "v")}


def test_fusion_and_quality(spark):
    v = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.5)], "query_id long, chunk_id long, vector_rank int, vector_score double")
    b = spark.createDataFrame([(1, 11, 1, 7.0, 1.0), (1, 12, 2, 3.0, 0.4)], "query_id long, chunk_id long, bm25_rank int, bm25_score double, bm25_norm double")
    fused = fusion.rank_fused(fusion.rrf_fuse(v, b))
    rows = {r["chunk_id"]: r for r in fused.collect()}
    assert rows[11]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61) and rows[11]["rrf_rank"] == 1
    assert rows[11]["score"] == 1.0 and rows[11]["sources"] == ["vector", "bm25"]
    c = fusion.fusion_counts(fused).first()
    assert (c["vector_count"], c["bm25_count"], c["merged_count"], c["overlap_count"]) == (2, 2, 3, 1)
    truth = spark.createDataFrame([(1, 10), (1, 99)], "query_id long, chunk_id long")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = evaluate.query_hits(fused, truth, asked, "rrf_rank")
    assert evaluate.hit_rate(hits).first()["hit_rate"] == 0.5
    assert evaluate.mean_reciprocal_rank(hits).first()["mrr"] == pytest.approx(0.25)


def test_category_filter_labels(spark):
    df = spark.createDataFrame([("guide",), ("slack",)], "uploaded_category string")
    assert fusion.category_filter(df, "가이드").count() == 1
    assert fusion.category_filter(df, "all").count() == fusion.category_filter(df, None).count() == 2
