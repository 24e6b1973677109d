"""Vectors by a function of the caller's: batches of the work-list go in, a cache table by key comes out.

The function is loaded once per Python worker and called once per batch.  A batch that raises, or gives another number of
vectors than texts, keeps its rows with the reason and is tried again by the next run, since only vectors enter the cache.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.functions.hashing import embedding_key
from loresmith.operators.registry import embedding_input, embedding_worklist
from loresmith.session import broadcast_if_small, written

EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]
CACHE_SCHEMA = "key string, vector array<float>"
EMBEDDED_SCHEMA = "key string, batch_id string, vector array<float>, error string"
FAILURE_SCHEMA = "key string, batch_id string, error string"
_LOADED: dict[str, EmbedFn] = {}  # in each Python worker


def _embedded(embed: EmbedFn, keys: list[str], batch_id: str, texts: list[str]) -> pa.RecordBatch:
    try:
        vectors = [None if v is None else [float(x) for x in v] for v in embed(texts)]
        error = None if len(vectors) == len(texts) else f"{len(vectors)} vectors for {len(texts)} texts"
    except Exception as failure:  # whatever the caller's function raises is that batch's result
        error = f"{type(failure).__name__}: {failure}"
    n = len(texts)
    if error is None:
        errors = ["no vector" if not v else None for v in vectors]
    else:
        vectors, errors = [None] * n, [error] * n
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array([batch_id] * n), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())],
        names=["key", "batch_id", "vector", "error"])


def embed_batches(todo: DataFrame, load: Callable[[], EmbedFn], name: str) -> DataFrame:
    """(key, batch_id, vector, error) for every row of a work-list (key, text, batch_id).

    All rows of a batch meet in one task, next to each other.  ``load`` makes the function; a worker that has made one for
    ``name`` (say provider and model) uses it again.
    """

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, texts = None, [], []
        for record in records:
            columns = [record.column(c).to_pylist() for c in ("batch_id", "key", "text")]
            for batch_id, key, text in zip(*columns):
                if name not in _LOADED:
                    _LOADED[name] = load()
                if batch_id != current and keys:
                    yield _embedded(_LOADED[name], keys, current, texts)
                    keys, texts = [], []
                current = batch_id
                keys.append(key)
                texts.append(text)
        if keys:
            yield _embedded(_LOADED[name], keys, current, texts)

    ordered = todo.select("batch_id", "key", "text").repartition("batch_id").sortWithinPartitions("batch_id", "key")
    return ordered.mapInArrow(run, EMBEDDED_SCHEMA)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, made empty where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def embed_missing(
    chunks: DataFrame, cache_path: str, provider: str, model: str, task: str, load: Callable[[], EmbedFn],
) -> DataFrame:
    """Embed the texts of ``chunks`` that the cache lacks and add their vectors to it; the failures (key, batch_id, error).

    What the function gave is written before it is used, and keys that the cache has by then are not added again, so a run
    that is repeated after a failure neither calls the function for cached texts nor leaves a key twice.  One run at
    a time may write a cache.
    """
    cache = open_cache(chunks.sparkSession, cache_path)
    todo = embedding_worklist(chunks, cache, provider, model, task)
    made = written(embed_batches(todo, load, f"{provider}|{model}|{task}"), "embedded")
    found = made.where("error IS NULL").select("key", "vector")
    known = cache.join(broadcast_if_small(found.select("key")), "key", "left_semi").select("key")
    found.join(broadcast_if_small(known), "key", "left_anti").write.mode("append").parquet(cache_path)
    return made.where("error IS NOT NULL").select("key", "batch_id", "error")


def chunk_vectors(chunks: DataFrame, cache: DataFrame, provider: str, model: str, task: str) -> DataFrame:
    """(chunk_id, vector) of every chunk whose text is cached; chunks of equal text share a vector."""
    keyed = chunks.select("chunk_id", embedding_key(F.lit(provider), F.lit(model), F.lit(task), embedding_input()).alias("key"))
    return keyed.where("key IS NOT NULL").join(cache, "key").select("chunk_id", "vector")
