import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresmith.llm import topk


def brute(rows, queries, k=10):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, q in queries:
        if i is None or not ok(q):
            continue
        q = [math.floor(1024 * x) for x in q]
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def rows(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    made = centers[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 0.3
    made[rng.integers(0, n, n // 3)] = made[0]
    return [(i, [float(x) for x in v]) for i, v in enumerate(made)]


@pytest.mark.parametrize("block, width", [(3, 50), (32_768, 65_536)])
def test_against_brute_force(spark, block, width):
    given = rows(1500, 20) + [(2000, None), (2100, [1.0] * 19 + [float("nan")]), (2200, [1.0] * 19 + [None]),
                              (2300, [float("inf")] * 20), (2400, [1.0, 2.0]), (2401, [3.0, 1.0]), (None, [1.0] * 20), (2500, [])]
    df = spark.createDataFrame([(*r, "x") for r in given], "vec_id long, embedding array<double>, block string")
    got = topk.top_k(df, topk.every_hundredth(df), query_block=block, slice_rows=width)
    assert sorted(map(tuple, got.collect())) == brute(given, [r for r in given if r[0] is not None and r[0] % 100 == 0])
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_pruning_in_numpy_is_exact():
    rng = np.random.default_rng(4)
    given = np.array([v for _, v in rows(5000, 64, 3)])
    for scale in (1024, 1 << 26):
        whole = np.floor(given * scale).astype(np.int64)
        ids = rng.permutation(5000).astype(np.int64)
        q, r, s = topk.best_pairs(whole[:40], ids[:40], np.full(40, -np.inf), whole, ids, 10)
        scores = whole[:40] @ whole.T
        for i in range(40):
            order = [j for j in np.lexsort((ids, -scores[i])) if ids[j] != ids[i]][:10]
            assert ids[r[q == i]].tolist() == ids[order].tolist() and s[q == i].tolist() == scores[i, order].tolist()


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, topk.every_hundredth(df)).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert topk.top_k(df.where(F.lit(False)), df).count() == 0 and topk.top_k(df, df.where(F.lit(False))).count() == 0
