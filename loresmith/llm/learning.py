"""Bounded training samples: which labelled rows a model learns from, and their features on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.common import held_out, text_of
from loresmith.session import broadcast_if_small, written


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(label, text) of at most ``per_label`` documents of each label, by smallest hash of the id.

    ``labels`` has (id, label), ids that may repeat, at most a few hundred labels.  Held-out ids, null ids and null labels
    are never used; an id with several labels counts for the largest one.  The choice reads ids and labels only; then the
    chosen ids, whose number is bounded, are looked up in the documents and each gives its smallest text.
    """
    usable = labels.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    known = usable.groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id"))
    sizes = written(known.groupBy("label").agg(F.count("*").alias("size")), "label-sizes")
    known = _thinned(known, sizes, per_label)
    rank = F.expr("row_number() OVER (PARTITION BY label ORDER BY h, id)")
    chosen = written(known.withColumn("rank", rank).where(F.col("rank") <= per_label).select("id", "label"), "chosen")
    rows = docs.select(F.col(doc_id).alias("id"), text_of(docs, text).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return found.select("label", "text")


def _thinned(known: DataFrame, sizes: DataFrame, per_label: int) -> DataFrame:
    """Rows below a threshold on the hash, about 1.5 * per_label of each label, before any exchange by label.

    One row per label is broadcast, behind a check of its size, so that no label's rows meet in one task to be thinned.
    """
    share = (F.col("h") / 2.0**64 + 0.5) * F.col("size")
    return known.join(broadcast_if_small(sizes), "label").where(share < 1.5 * per_label + 100)


def gathered(rows: DataFrame, features: Callable[[pa.Array], list[tuple[np.ndarray, np.ndarray]]]):
    """Feature numbers and weights of bounded ``rows`` (label, text), computed on the executors: labels, [(numbers, weights)].

    The order does not depend on the partitions.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.array([n for n, _ in made], pa.list_(pa.int32())),
                pa.array([w for _, w in made], pa.list_(pa.float32())), batch.column("h")], names=["label", "n", "w", "h"])

    schema = T.StructType([
        rows.schema["label"], T.StructField("n", T.ArrayType(T.IntegerType())),
        T.StructField("w", T.ArrayType(T.FloatType())), T.StructField("h", T.LongType())])
    table = rows.withColumn("h", F.xxhash64("text")).mapInArrow(compute, schema).toArrow()
    table = table.sort_by([("h", "ascending"), ("label", "ascending")])
    pairs = []
    for chunk in table.to_batches():
        numbers, weights = chunk.column("n"), chunk.column("w")
        pairs.extend((numbers[i].values.to_numpy(), weights[i].values.to_numpy()) for i in range(len(chunk)))
    return table.column("label").to_pylist(), pairs


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -80, 80)))
