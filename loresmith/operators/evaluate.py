"""Retrieval quality and usage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresmith.functions.vectors import cosine
from loresmith.session import written

BINS = 1024  # of a category's histogram
SORTED_ROWS = 100_000  # values of a category that one task may sort


def query_hits(results: DataFrame, truth: DataFrame, queries: DataFrame, rank_col: str = "rank_n") -> DataFrame:
    """Per question: does any true chunk occur (hit) and 1 / its best rank.  No truth means 0 for both."""
    found = (
        results.select("query_id", "chunk_id", F.col(rank_col).alias("rank"))
        .join(truth.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"])
        .groupBy("query_id")
        .agg(F.min("rank").alias("rank"))
    )
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id",
        F.col("rank").isNotNull().cast("double").alias("hit"),
        F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("queries"), F.avg("hit").alias("hit_rate"))


def mean_reciprocal_rank(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("queries"), F.avg("reciprocal_rank").alias("mrr"))


def source_coverage(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Share of an answer's cited chunks whose file name occurs in its text (case ignored); 0 without citations."""
    named = cited.select("answer_id", "file_name")
    text = answers.select("answer_id", F.lower(F.coalesce("answer", F.lit(""))).alias("answer"))
    inside = F.contains(F.col("answer"), F.lower(F.coalesce("file_name", F.lit("")))).cast("double")
    rows = text.join(named.withColumn("cited", F.lit(True)), "answer_id", "left")
    return rows.groupBy("answer_id").agg(
        F.count("cited").alias("cited_count"),
        F.coalesce(F.avg(F.when(F.col("cited"), inside)), F.lit(0.0)).alias("coverage"),
    )


def embedding_compare(pairs: DataFrame) -> DataFrame:
    """Similarity figures per model for pairs(model, query_vector, doc_vector)."""
    scored = pairs.select("model", cosine(F.col("query_vector"), F.col("doc_vector")).alias("sim"))
    return scored.groupBy("model").agg(
        F.count("*").alias("pairs"),
        F.avg("sim").alias("mean_sim"),
        F.min("sim").alias("min_sim"),
        F.max("sim").alias("max_sim"),
    )


def exact_quantile(rows: DataFrame, by: str, value: str, q: float, limit: int = SORTED_ROWS) -> DataFrame:
    """(by, value): the smallest value with at least ``q`` of a category's values up to it; nulls do not count.

    The wanted rank is followed through histograms between smallest and largest value, bin by bin, until at most ``limit``
    values, or one value that occurs often, are left; those alone are sorted.  No task holds a category, whatever its
    size and ties.  Categories have no ``null`` name and number a few thousand at most: each is a row of a broadcast.
    """
    rows = rows.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    whole = rows.groupBy("by").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    spans = written(whole.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("n") * q - 1e-9)).cast("long")), "rank-spans")
    wide = (F.col("n") > limit) & (F.col("lo") < F.col("hi"))
    while not spans.where(wide).isEmpty():
        inside = rows.join(F.broadcast(spans.where(wide)), "by").where(F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
        bins = inside.withColumn("bin", F.least(F.lit(BINS - 1), place)).groupBy("by", "bin").agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("rank").alias("rank"))
        upto = F.sum("n").over(Window.partitionBy("by").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.withColumn("rank", F.col("rank") - upto + F.col("n")).where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
        spans = written(spans.where(~wide).unionByName(bins.select(*spans.columns)), "rank-spans")
    left = rows.join(F.broadcast(spans.where("lo < hi")), "by").where(F.col("v").between(F.col("lo"), F.col("hi")))
    nth = F.row_number().over(Window.partitionBy("by").orderBy("v"))
    sorted_out = left.withColumn("nth", nth).where(F.col("nth") == F.col("rank")).select("by", "v")
    found = spans.where("lo >= hi").select("by", F.col("lo").alias("v")).union(sorted_out)
    return found.select(F.col("by").alias(by), F.col("v").alias(value))


def score_distribution(results: DataFrame, by: str = "uploaded_category", score: str = "final_score") -> DataFrame:
    """Count, share, mean, exact median (the lower one of two) and maximum of the scores of each category."""
    grouped = results.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))
    medians = exact_quantile(results.where(F.col(by).isNotNull()), by, score, 0.5)
    grouped = grouped.join(medians.withColumnRenamed(score, "median_score"), by, "left")
    grouped = grouped.select(by, "n", "mean_score", "median_score", "max_score")
    return grouped.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row per category


def usage_counters(calls: DataFrame, kind: str, items: Column, at: str, size: Column) -> DataFrame:
    """Per call kind: calls, items, and the size of the latest call."""
    return calls.groupBy(F.col(kind).alias("kind")).agg(
        F.count("*").alias("calls"),
        F.sum(items).alias("items"),
        F.max_by(size, F.struct(at, "event_id")).alias("last_size"),
    )
