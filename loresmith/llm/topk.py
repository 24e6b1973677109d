"""Exact top-k by inner product, with bounds from segment statistics at several resolutions.

A vector is cut into 1, 4, 16 segments; of each segment its mean m and deviation d (root of the summed squared differences
from the mean) are kept.  For two vectors, ``|x - y|^2 >= sum over segments of L * (m_x - m_y)^2 + (d_x - d_y)^2``.  With
``x . y = (|x|^2 + |y|^2 - |x - y|^2) / 2`` a lower bound of the distance is an upper bound of the score, so a pair whose
distance is surely too large for the score reached so far is dropped at the coarsest resolution that shows it.  The
survivors' scores are computed exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 10
SCALE = 1024
EVERY = 100
LEVELS = (1, 4, 16)
QUERY_BLOCK = 32_768
SLICE = 65_536
STRIPE = 2_048  # rows(queries) x rows(candidates) of one score matrix: at most STRIPE x STRIPE
PAIR_STEP = 1 << 16
DENSE = 0.05  # above this share of surviving pairs a whole matrix product is cheaper than single pairs
EXACT = float(1 << 53)


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _statistics(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each resolution the columns sqrt(L) * mean and deviation of the segments, as one matrix; and the squared norms."""
    out, dim = [], rows.shape[1]
    for parts in LEVELS:
        if parts > dim:
            break
        edges = np.linspace(0, dim, parts + 1).astype(int)
        length = np.diff(edges)
        sums = np.add.reduceat(rows, edges[:-1], axis=1)
        squares = np.add.reduceat(rows * rows, edges[:-1], axis=1)
        deviation = np.sqrt(np.maximum(0.0, squares - sums * sums / length))
        out.append(np.concatenate([sums / np.sqrt(length), deviation], axis=1))
    return out


def _bound(q_stats: np.ndarray, c_stats: np.ndarray, q_norm: np.ndarray, c_norm: np.ndarray) -> np.ndarray:
    """Upper bound of the scores of paired rows, from the lower bound of their distances."""
    distance = ((q_stats - c_stats) ** 2).sum(axis=1)
    return (q_norm + c_norm - distance) / 2


def best_pairs(
    queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of each query's k best rows with a score of its floor or more, ties to smaller ids.

    The row with the query's own id is left out.  ``floors`` holds -inf where nothing is known.
    """
    # Products and sums below 2 ** 53 are exact in doubles; larger numbers are multiplied as integers.
    largest = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(rows).max(initial=0))) * max(1, rows.shape[1])
    exact = np.float64 if largest < EXACT else np.int64
    order = np.argsort(ids, kind="stable")
    real_q, real_c = queries.astype(np.float64), rows[order].astype(np.float64)
    whole_q, whole_c = queries.astype(exact), rows[order].astype(exact)
    ids = ids[order]
    q_norm, c_norm = (real_q**2).sum(axis=1), (real_c**2).sum(axis=1)
    q_stats, c_stats = _statistics(real_q), _statistics(real_c)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(queries))]
    floors = floors.astype(np.float64).copy()
    for q0 in range(0, len(queries), STRIPE):
        q1 = min(len(queries), q0 + STRIPE)
        for c0 in range(0, len(rows), STRIPE):
            c1 = min(len(rows), c0 + STRIPE)
            # Rounding of the bounds is far below this slack.
            slack = 1e-9 * (q_norm[q0:q1, None] + c_norm[None, c0:c1]) + 1e-6
            live = None  # surviving pairs, once they are few
            for q_level, c_level in zip(q_stats, c_stats):
                if live is None:
                    alive = q_level[q0:q1] @ c_level[c0:c1].T + slack >= floors[q0:q1, None]
                    if np.count_nonzero(alive) <= DENSE * alive.size:
                        live = np.argwhere(alive)
                else:
                    keep = [np.zeros(0, bool)]
                    for a in range(0, len(live), PAIR_STEP):
                        i, j = live[a : a + PAIR_STEP].T
                        up = _bound(q_level[q0 + i], c_level[c0 + j], q_norm[q0 + i], c_norm[c0 + j]) + slack[i, j]
                        keep.append(up >= floors[q0 + i])
                    live = live[np.concatenate(keep)]
            if live is None:
                scores = whole_q[q0:q1] @ whole_c[c0:c1].T
                live = np.argwhere((scores >= floors[q0:q1, None]) & (query_ids[q0:q1, None] != ids[None, c0:c1]))
                values = scores[live[:, 0], live[:, 1]]
            else:
                live = live[query_ids[q0 + live[:, 0]] != ids[c0 + live[:, 1]]]
                parts = [np.einsum("ij,ij->i", whole_q[q0 + p[:, 0]], whole_c[c0 + p[:, 1]])
                         for p in (live[a : a + PAIR_STEP] for a in range(0, len(live), PAIR_STEP))]
                values = np.concatenate(parts) if parts else np.zeros(0, exact)
                reached = values >= floors[q0 + live[:, 0]]
                live, values = live[reached], values[reached]
            hit, starts = np.unique(live[:, 0], return_index=True)
            for i, at, score in zip(hit, np.split(live[:, 1], starts[1:]), np.split(values, starts[1:])):
                q = q0 + int(i)
                # Rows stand in the order of their ids, so a stable sort by score breaks ties as asked.
                best = [(score, at + c0), *found[q]]
                score, at = (np.concatenate(x) for x in zip(*best))
                pick = np.lexsort((at, -score))[:k]
                found[q] = [(score[pick], at[pick])]
                if len(pick) == k:
                    floors[q] = max(floors[q], float(score[pick[-1]]))
    counts = [len(x[0][0]) if x else 0 for x in found]
    at = np.concatenate([x[0][1] for x in found if x] or [np.zeros(0, np.int64)])
    scores = np.concatenate([x[0][0] for x in found if x] or [np.zeros(0)])
    return np.repeat(np.arange(len(queries)), counts), order[at], scores.astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("v").combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _scan(queries: DataFrame, rows: DataFrame, blocks: int, slices: int, k: int) -> DataFrame:
    """Best k of each query in each slice: query blocks meet candidate slices, both of bounded size, in one group each."""
    left = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def meet(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not len(asked) or not len(given):
            a, b, scores = (np.zeros(0, np.int64),) * 3
        else:
            floors = asked.column("floor").to_numpy()
            floors = np.where(np.isnan(floors), -np.inf, floors)
            a, b, scores = best_pairs(
                _matrix(asked), asked.column("id").to_numpy(), floors, _matrix(given), given.column("id").to_numpy(), k)
        take = lambda t, name, at: t.column(name).combine_chunks().take(pa.array(at, pa.int64()))
        return pa.table({
            "query_id": take(asked, "id", a), "qh": take(asked, "qh", a), "vec_id": take(given, "id", b),
            "score": pa.array(scores, pa.int64())})

    keys = ["dim", "block", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, "query_id long, qh long, vec_id long, score long")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, vec_id: str = "vec_id",
    vector: str = "embedding", query_block: int = QUERY_BLOCK, slice_rows: int = SLICE,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k rows of ``vectors`` with the highest inner product for each query.

    Components become ``floor(scale * x)``.  Ties go to the smaller id; fewer candidates give fewer rows.  Rows with the
    query's id are its own and no candidates.  A vector that is null or holds a null, NaN or infinite component, or has no
    id, takes no part; vectors of unequal length are not compared.  Repeated candidates are ranked each; query rows that
    share an id are answered each by itself, equal ones once.  Other columns are not read.  Empty inputs: no rows.

    Every query visits every slice of the candidates; the groups are numbered, so neither a common vector nor a repeated
    id makes one larger.  One slice is searched first: the scores found there prune all others.
    """
    spark = vectors.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        good = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
        made = good.select(F.col(vec_id).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"))
        return made.withColumn("dim", F.size("v")).where("dim > 0")

    asked = prepared(queries).distinct().withColumn("qh", F.xxhash64("v"))
    given = prepared(vectors)
    n_asked, n_given = asked.count(), given.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n_asked / query_block))
    slices = max(1, math.ceil(n_given / slice_rows), min(cores, math.ceil(n_given / STRIPE)))
    # The number of a row stays the same if its task runs again within the job, and any row may be in any group.
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "qh"), F.lit(blocks)).cast("int"))
    given = given.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int"))
    first = _scan(asked.withColumn("floor", F.lit(float("-inf"))), given.where("slice = 0"), blocks, 1, k)
    floors = first.groupBy("query_id", "qh").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor"))
    floors = floors.where(F.col("n") >= k).select(F.col("query_id").alias("id"), "qh", "floor")
    known = asked.join(floors, ["id", "qh"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = _scan(known, given, blocks, slices, k)
    ranked = found.withColumn("rank", F.expr(
        "row_number() OVER (PARTITION BY query_id, qh ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every_hundredth(vectors: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return vectors.where(F.col(vec_id) % EVERY == 0)


TOPK_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= {K}"""
