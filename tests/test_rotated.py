import numpy as np
import pytest
from pyspark.sql import functions as F

from loresmith.operators import nearest, rotated


def clustered(n, dim, seed, centres=40, axes=6):
    """Vectors near a few centres that spread along few directions, with copies for ties and a zero."""
    rng = np.random.default_rng(seed)
    basis = rng.normal(size=(axes, dim))
    m = rng.normal(size=(centres, axes))[rng.integers(centres, size=n)] @ basis + 0.02 * rng.normal(size=(n, dim))
    m[n // 2] = m[0]
    m[1] = 0
    return m


def frame(spark, m, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} long, vector array<float>")


def rows_of(found):
    return sorted((r["query_id"], r["vector_rank"], r["chunk_id"], round(r["vector_score"], 9)) for r in found.collect())


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_equal_to_the_whole_scan(spark, kind):
    m = clustered(900, 24, 1) if kind == "clustered" else np.random.default_rng(2).normal(size=(900, 24))
    vectors, queries = frame(spark, m, "chunk_id"), frame(spark, m[:60] + 0.01, "query_id")
    axes = rotated.principal_axes(vectors)
    turned = rotated.rotated_vectors(vectors, axes)
    for limits in ({}, {"query_block": 17, "slice_rows": 100}):
        assert rows_of(rotated.vector_topk_rotated(queries, turned, axes, 7, **limits)) == rows_of(nearest.vector_topk(queries, vectors, 7))


def test_lengths_axes_and_empty(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0, 1.0]), (4, []), (5, None), (6, [0.0, 0.0])], "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(10, [2.0, 1.0]), (11, [0.0, 0.0, 3.0]), (12, None)], "query_id long, vector array<float>")
    want = rows_of(nearest.vector_topk(queries, vectors, 5))
    axes = rotated.principal_axes(vectors)
    assert set(axes) == {2, 3} and all(np.allclose(a.T @ a, np.eye(d)) for d, a in axes.items())
    # Axes of a bounded sample, or none at all, change nothing that is found.
    for some in (axes, {}, rotated.principal_axes(vectors, sample=1)):
        assert rows_of(rotated.vector_topk_rotated(queries, rotated.rotated_vectors(vectors, some), some, 5)) == want
    none = vectors.where(F.lit(False))
    assert rotated.principal_axes(none) == {}
    assert rotated.vector_topk_rotated(queries, rotated.rotated_vectors(none, {}), {}, 5).count() == 0


def test_products_spared_on_clustered_vectors():
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    m = unit(clustered(40_000, 64, 3))
    values, columns = np.linalg.eigh(m.T @ m)
    m = m @ columns[:, np.argsort(-values)]
    q, order = m[:100], np.arange(len(m))
    a, b, sim, products = rotated.best_of(q, m, order, 10)
    assert products < 0.4 * len(q) * len(m) * 64
    want = nearest._best(q, m, order, 10)
    assert (a == want[0]).all() and (b == want[1]).all() and np.allclose(sim, want[2], atol=1e-12)
