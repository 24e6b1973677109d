import numpy as np
from pyspark.sql import functions as F

from loresmith.operators import nearest


def test_crowded_vectors_are_not_missed(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=16)
    rows = [(i, (base + rnd.normal(size=16) * 0.002).tolist()) for i in range(3000)]
    vectors = spark.createDataFrame([*rows, (5000, [0.0] * 16)], "chunk_id long, vector array<double>")
    queries = vectors.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "vector")
    keys = lambda df: {(r["query_id"], r["vector_rank"], r["chunk_id"]) for r in df.collect()}
    want = keys(nearest.vector_topk(queries, vectors, 5))
    assert len(want) == 100 and keys(nearest.vector_topk_approx(queries, vectors, 5)) == want
