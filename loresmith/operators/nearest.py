"""Nearest vectors for a table of query vectors: exact, and by a scan of quantized vectors with exact scores for all that may be best."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.functions.vectors import cosine
from loresmith.session import broadcast_if_small, written

QUERY_BLOCK = 8_192  # queries and vectors that meet in one group
SLICE_ROWS = 65_536
STRIPE_QUERIES, STRIPE_ROWS = 512, 8_192  # the largest matrix of similarities
PLACES = 1e9  # similarities that agree in nine decimals are ties
LEVELS = 127  # of a quantized component
FURTHER = 1.4  # rows per wanted one whose bounds decide which quantized candidates are scored exactly


def _codes(df: DataFrame) -> DataFrame:
    """``vector`` as one byte per component, with the ``scale`` that turns the codes into a unit vector, and how far off that is."""
    v = F.col("vector")
    largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    codes = F.transform(v, lambda x: F.coalesce(F.round(x.cast("double") / F.nullif(largest, F.lit(0.0)) * LEVELS), F.lit(0.0)).cast("tinyint"))
    scale = F.coalesce(largest / (length * LEVELS), F.lit(0.0))
    coded = df.withColumns({"unit": v, "length": length, "scale": F.when(length > 0, scale).otherwise(0.0), "vector": codes})
    off = F.zip_with("unit", "vector", lambda x, c: x.cast("double") / F.col("length") - c * F.col("scale"))
    error = F.coalesce(F.sqrt(F.aggregate(off, F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))
    return coded.withColumn("error", F.when(F.col("length") > 0, error).otherwise(0.0)).drop("unit", "length")


def unit_rows(table: pa.Table) -> np.ndarray:
    """Unit rows of the vectors or of their codes; a zero row stays zero."""
    values = table.column("vector").combine_chunks()
    m = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    if "scale" in table.column_names:
        return m * table.column("scale").to_numpy()[:, None]
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(q: np.ndarray, c: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of the k best rows of each query; ties go to the row with the smaller ``order``."""
    found = []
    for a in range(0, len(q), STRIPE_QUERIES):
        left = q[a : a + STRIPE_QUERIES]
        keys, at = np.zeros((len(left), 0), np.int64), np.zeros((len(left), 0), np.int64)
        for b in range(0, len(c), STRIPE_ROWS):
            right = c[b : b + STRIPE_ROWS]
            # One number per pair: similarity first, place of the id after it.
            key = -np.rint(left @ right.T * PLACES).astype(np.int64) * len(c) + order[b : b + STRIPE_ROWS]
            few = min(k, key.shape[1])
            pick = np.argpartition(key, few - 1, axis=1)[:, :few]
            keys = np.concatenate([keys, np.take_along_axis(key, pick, axis=1)], axis=1)
            at = np.concatenate([at, pick + b], axis=1)
        pick = np.argsort(keys, axis=1)[:, :k]
        at = np.take_along_axis(at, pick, axis=1)
        rows = np.repeat(np.arange(len(left)), at.shape[1])
        found.append((rows + a, at.ravel(), np.einsum("ij,ij->i", left[rows], c[at.ravel()])))
    return tuple(np.concatenate(x) for x in zip(*found))


def _within(
    q: np.ndarray, c: np.ndarray, order: np.ndarray, k: int, off_q: np.ndarray, off_c: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of all rows that can be among a query's k best, by how far the rows may be off."""
    found = []
    for a in range(0, len(q), STRIPE_QUERIES):
        left, off = q[a : a + STRIPE_QUERIES], off_q[a : a + STRIPE_QUERIES, None]
        least, bar, held = np.zeros((len(left), 0)), np.full(len(left), -np.inf), []
        for b in range(0, len(c), STRIPE_ROWS):
            near = left @ c[b : b + STRIPE_ROWS].T
            error = off + (1 + off) * off_c[None, b : b + STRIPE_ROWS] + 2 / PLACES
            least = np.concatenate([least, near - error], axis=1)
            if least.shape[1] >= k:
                least = -np.partition(-least, k - 1, axis=1)[:, :k]
                bar = least.min(axis=1)
            row, at = np.nonzero(near + error >= bar[:, None])
            held.append((row, at + b, near[row, at], (near + error)[row, at]))
        row, at, near, most = (np.concatenate(x) for x in zip(*held))
        stays = most >= bar[row]
        found.append((row[stays] + a, at[stays], near[stays]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _meet(asked: pa.Table, given: pa.Table, k: int, best: Callable) -> pa.Table:
    if not asked.num_rows or not given.num_rows:
        a = b = np.zeros(0, np.int64)
        score = np.zeros(0)
    else:
        ids = given.column("chunk_id").combine_chunks()
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        if "error" in asked.column_names:
            best = partial(_within, off_q=asked.column("error").to_numpy(), off_c=given.column("error").to_numpy())
        a, b, score = best(unit_rows(asked), unit_rows(given), order, k)
    take = lambda t, name, at: t.column(name).combine_chunks().take(pa.array(at, pa.int64()))
    return pa.table({
        "query_id": take(asked, "query_id", a), "chunk_id": take(given, "chunk_id", b), "vector_score": pa.array(score, pa.float64())})


def meet_in_slices(
    queries: DataFrame, vectors: DataFrame, k: int, query_block: int, slice_rows: int, best: Callable = _best, quantized: bool = False
) -> DataFrame:
    """The best k of each query in each slice.  Blocks of queries meet numbered slices of vectors of the same length.

    ``best`` finds them among unit rows, by default by the product of all with all.
    """
    # Columns of their own on both sides: queries may have been taken from the vectors themselves.
    own = lambda df, name: df.select(
        F.col(name).alias(name), F.col("vector").alias("vector"), F.size("vector").alias("dim")).where("dim > 0")
    queries, vectors = own(queries, "query_id"), own(vectors, "chunk_id")
    if quantized:
        queries, vectors = _codes(queries), _codes(vectors)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_queries, n_vectors = queries.count(), vectors.count()
    blocks = max(1, math.ceil(n_queries / query_block))
    slices = max(1, math.ceil(n_vectors / slice_rows), min(cores, math.ceil(n_vectors / 1024)))
    # Any row may be in any group, and a task that runs again numbers its rows as before.
    number = F.monotonically_increasing_id()
    left = queries.withColumn("block", F.pmod(number, F.lit(blocks))).withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    right = vectors.withColumn("slice", F.pmod(number, F.lit(slices))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    schema = T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("vector_score", T.DoubleType())])
    keys = ("dim", "block", "slice")
    meet = partial(_meet, k=k, best=best)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: meet(a, b), schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Number the best k.  Similarities keep 12 decimals: the rest is noise of the summation order."""
    found = found.withColumn("vector_score", F.round("vector_score", 12))
    w = Window.partitionBy("query_id").orderBy(F.round("vector_score", 9).desc(), F.col("chunk_id"))
    return found.withColumn("vector_rank", F.row_number().over(w)).where(F.col("vector_rank") <= k)


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int, query_block: int = QUERY_BLOCK, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Exact cosine top ``k``: queries(query_id, vector) x vectors(chunk_id, vector), ids of any type.

    Filter ``vectors`` first to search a part of them.  Every query visits every slice; both sides of a group and the
    matrix of similarities are bounded whatever the tables hold.  Vectors of another length than the query's are not
    compared with it.
    """
    return ranked(meet_in_slices(queries, vectors, k, query_block, slice_rows), k)


def vector_candidates_approx(queries: DataFrame, vectors: DataFrame, k: int, further: float = FURTHER) -> DataFrame:
    """(query_id, chunk_id): the rows that can be among a slice's ``further * k`` best by quantized vectors, an eighth of the size.

    How far a quantized vector is off bounds its similarities, so none of the best k is missed.
    """
    found = meet_in_slices(queries, vectors, math.ceil(further * k), QUERY_BLOCK, SLICE_ROWS, quantized=True)
    return written(found.select("query_id", "chunk_id"), "near")


def vector_topk_approx(queries: DataFrame, vectors: DataFrame, k: int, further: float = FURTHER) -> DataFrame:
    """Cosine top ``k`` with exact similarities, among the candidates of the quantized scan."""
    pairs = vector_candidates_approx(queries, vectors, k, further)
    asked = queries.select("query_id", F.col("vector").alias("query_vector"))
    rows = vectors.select("chunk_id", "vector").join(broadcast_if_small(pairs), "chunk_id")
    found = rows.join(broadcast_if_small(asked), "query_id")
    return ranked(found.select("query_id", "chunk_id", cosine(F.col("query_vector"), F.col("vector")).alias("vector_score")), k)
