"""Exact nearest vectors that look at few components of most vectors: rotation to principal axes and bounds on the rest.

Unit vectors are rotated so that the leading components carry most of the length; a rotation changes no similarity.  Of two
rotated vectors the product of the leading components is known, and by Cauchy-Schwarz the rest adds at most the product of the
lengths of their rests.  Pairs whose bound stays below the k-th best similarity found so far are given up after the leading
components; the others go on to further ones.  The axes are fitted on a bounded sample: they decide how much is
spared, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.operators.nearest import (
    PLACES, QUERY_BLOCK, SLICE_ROWS, STRIPE_QUERIES, STRIPE_ROWS, meet_in_slices, ranked, unit_rows,
)
from loresmith.session import written

SAMPLE_ROWS = 20_000  # vectors of each length on which axes are fitted
LENGTHS_MAX = 16  # most usual lengths of vectors that get axes of their own; others are searched unrotated
CUTS = (1 / 8, 1 / 4, 1 / 2)  # shares of the components after which bounds are looked at
GATHER_BELOW = 0.2  # share of pairs still open below which they are multiplied one by one
MARGIN = 2 / PLACES


def principal_axes(vectors: DataFrame, sample: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """For each usual length of ``vectors(vector)`` the axes (columns) by falling variance around zero of a bounded sample."""
    sized = vectors.select("vector", F.size("vector").alias("dim")).where("dim > 0")
    dims = [r["dim"] for r in sized.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS_MAX).collect()]
    axes = {}
    for dim in dims:
        chosen = sized.where(F.col("dim") == dim).orderBy(F.xxhash64("vector")).limit(sample)
        rows = unit_rows(chosen.select("vector").toArrow())
        values, columns = np.linalg.eigh(rows.T @ rows)
        axes[dim] = columns[:, np.argsort(-values, kind="stable")]
    return axes


def rotate(vectors: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with unit length (zero stays zero) in the given axes, as doubles; other columns and rows stay."""
    sent = vectors.sparkSession.sparkContext.broadcast(axes)
    place = vectors.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            dims, out = np.diff(lists.offsets.to_numpy()), [None] * len(lists)
            for dim in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero((dims == dim) & np.asarray(lists.is_valid()))
                turned = unit_rows(pa.table({"vector": lists.take(pa.array(at))}))
                turned = turned @ sent.value[dim] if dim in sent.value else turned
                for i, row in zip(at.tolist(), turned):
                    out[i] = row
            columns = [pa.array(out, pa.list_(pa.float64())) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    kinds = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == "vector" else f.dataType) for f in vectors.schema])
    return vectors.mapInArrow(run, kinds)


def _rests(m: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Length of the components from each cut on."""
    upto = np.cumsum(m[:, ::-1] ** 2, axis=1)[:, ::-1]
    return [np.sqrt(upto[:, c]) if c < m.shape[1] else np.zeros(len(m)) for c in cuts]


def best_of(q: np.ndarray, c: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, similarity) of the k best rows of each query, ties by ``order``, and the products of components it took."""
    dim, found, products = q.shape[1], [], 0
    ends = sorted({max(1, round(dim * share)) for share in CUTS} | {dim})
    rest_q, rest_c = _rests(q, ends), _rests(c, ends)
    for a in range(0, len(q), STRIPE_QUERIES):
        left = q[a : a + STRIPE_QUERIES]
        keys, at, sims = (np.zeros((len(left), 0), kind) for kind in (np.int64, np.int64, np.float64))
        least = np.full(len(left), -np.inf)
        for b in range(0, len(c), STRIPE_ROWS):
            right = c[b : b + STRIPE_ROWS]
            sim, done, open_pairs = np.zeros((len(left), len(right))), 0, None
            for n, end in enumerate(ends):
                if open_pairs is None:
                    sim += left[:, done:end] @ right[:, done:end].T
                    products += sim.size * (end - done)
                else:
                    i, j = open_pairs
                    sim[i, j] += np.einsum("ij,ij->i", left[i, done:end], right[j, done:end])
                    products += len(i) * (end - done)
                done = end
                if end < dim and np.isfinite(least).any():
                    if open_pairs is None:
                        bound = sim + rest_q[n][a : a + len(left), None] * rest_c[n][b : b + len(right)]
                        alive = bound >= least[:, None] - MARGIN
                        if alive.mean() < GATHER_BELOW:
                            open_pairs = np.nonzero(alive)
                    else:
                        i, j = open_pairs
                        kept = sim[i, j] + rest_q[n][a + i] * rest_c[n][b + j] >= least[i] - MARGIN
                        open_pairs = i[kept], j[kept]
            if open_pairs is not None:
                whole = np.full_like(sim, -2.0)  # below every similarity
                whole[open_pairs] = sim[open_pairs]
                sim = whole
            key = -np.rint(sim * PLACES).astype(np.int64) * len(c) + order[b : b + len(right)]
            few = min(k, key.shape[1])
            pick = np.argpartition(key, few - 1, axis=1)[:, :few]
            keys = np.concatenate([keys, np.take_along_axis(key, pick, axis=1)], axis=1)
            at = np.concatenate([at, pick + b], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(sim, pick, axis=1)], axis=1)
            pick = np.argsort(keys, axis=1)[:, :k]
            keys, at, sims = (np.take_along_axis(x, pick, axis=1) for x in (keys, at, sims))
            if sims.shape[1] == k:
                least = sims[:, -1]
        real = sims > -1.5
        found.append((np.repeat(np.arange(len(left)), real.sum(axis=1)) + a, at[real], sims[real]))
    return *(np.concatenate(x) for x in zip(*found)), products


def rotated_vectors(vectors: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """The searchable table, written: vectors(chunk_id, vector) in the given axes."""
    return written(rotate(vectors.select("chunk_id", "vector"), axes), "rotated")


def vector_topk_rotated(
    queries: DataFrame, turned: DataFrame, axes: dict[int, np.ndarray], k: int,
    query_block: int = QUERY_BLOCK, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Exact cosine top ``k`` of queries(query_id, vector) among :func:`rotated_vectors` made with the same axes.

    The rows are those of :func:`nearest.vector_topk`, whose conditions hold here too.
    """
    asked = written(rotate(queries.select("query_id", "vector"), axes), "rotated-queries")

    def best(q: np.ndarray, c: np.ndarray, order: np.ndarray, k: int):
        return best_of(q, c, order, k)[:3]

    return ranked(meet_in_slices(asked, turned, k, query_block, slice_rows, best), k)

