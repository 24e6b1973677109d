import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from loresmith.operators import embedding, evaluate, registry as reg
from loresmith.session import scratch_dir

NAMES = ("local", "m1", "doc")


def chunks_of(spark, n):
    rows = [(i, f"text {i % (n // 2)}" if i % 10 else "", "", f"content {i}") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, embedding_text string, clean_content string, content string")


def loader(folder, bad=None):
    """A function that leaves one file for each load and each call, and fails for a batch that holds the text ``bad``."""

    def load():
        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def embed(texts):
            with open(f"{folder}/call-{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(texts)))
            if bad in texts and not os.path.exists(f"{folder}/mended"):
                raise ValueError("no such luck")
            return [[float(len(t)), 0.5] for t in texts]

        return embed

    return load


def calls(folder):
    return [int(open(f).read()) for f in glob.glob(f"{folder}/call-*")]


def test_second_run_calls_nothing(spark, tmp_path):
    chunks, cache = chunks_of(spark, 300), scratch_dir(spark, "vectors")
    assert embedding.embed_missing(chunks, cache, *NAMES, loader(tmp_path)).count() == 0
    work = reg.embedding_worklist(chunks, spark.createDataFrame([], "key string"), *NAMES)
    assert sorted(calls(tmp_path)) == sorted(r["count"] for r in work.groupBy("batch_id").count().collect())
    pids = [os.path.basename(f).split("-")[1] for f in glob.glob(f"{tmp_path}/load-*")]
    assert len(pids) == len(set(pids))  # once per worker
    n = len(calls(tmp_path))
    assert embedding.embed_missing(chunks, cache, *NAMES, loader(tmp_path)).count() == 0 and len(calls(tmp_path)) == n
    vectors = embedding.chunk_vectors(chunks, embedding.open_cache(spark, cache), *NAMES)
    assert {r["chunk_id"]: r["vector"] for r in vectors.collect()} == {
        r["chunk_id"]: [float(len(r["embedding_text"] or r["content"])), 0.5] for r in chunks.collect()}
    assert reg.embedding_validation(chunks, vectors).first()["valid"]


def test_a_batch_fails_alone_and_is_tried_again(spark, tmp_path):
    chunks, cache = chunks_of(spark, 400), scratch_dir(spark, "vectors")
    failed = embedding.embed_missing(chunks, cache, "local", "m2", "doc", loader(tmp_path, bad="content 10")).collect()
    assert len({r["batch_id"] for r in failed}) == 1 and {r["error"] for r in failed} == {"ValueError: no such luck"}
    before = len(calls(tmp_path))
    kept = embedding.open_cache(spark, cache).count()
    assert kept + len(failed) == chunks.select(embedding.embedding_input()).distinct().count()
    open(f"{tmp_path}/mended", "w").close()
    assert embedding.embed_missing(chunks, cache, "local", "m2", "doc", loader(tmp_path)).count() == 0
    assert len(calls(tmp_path)) == before + 1  # only the failed batch is asked for again
    keys = embedding.open_cache(spark, cache).select("key")
    assert keys.count() == keys.distinct().count() == kept + len(failed)


def test_results_that_do_not_fit(spark):
    todo = spark.createDataFrame([("k1", "a", "b1"), ("k2", "b", "b1"), ("k3", "c", "b2")], "key string, text string, batch_id string")
    got = embedding.embed_batches(todo, lambda: lambda texts: [[1.0]], "short").collect()
    assert {r["key"]: r["error"] for r in got} == {"k1": "1 vectors for 2 texts", "k2": "1 vectors for 2 texts", "k3": None}
    got = embedding.embed_batches(todo, lambda: lambda texts: [[] for _ in texts], "empty").collect()
    assert {r["error"] for r in got} == {"no vector"}
    assert embedding.embed_batches(todo.where(F.lit(False)), lambda: 1 / 0, "never").count() == 0


def test_batch_ids_do_not_depend_on_parts(spark, monkeypatch):
    chunks, empty = chunks_of(spark, 900), spark.createDataFrame([], "key string")
    ids = lambda: {r["key"]: r["batch_id"] for r in reg.embedding_worklist(chunks, empty, *NAMES, prefix=0).collect()}
    want = ids()
    assert len(want) > 128 and want == {k: f"-{i // 32}" for i, k in enumerate(sorted(want))}
    monkeypatch.setattr(reg, "PART_DIGITS", 1)
    assert ids() == want


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
def test_exact_quantile_with_ties(spark, q):
    rng = random.Random(3)
    rows = [(c, None if rng.random() < 0.01 else rng.choice([rng.random(), 0.25, 0.25, -1e9, 3.0])) for c in "aab" for _ in range(4000)]
    rows += [("one", 7.0), ("none", None), *[("same", 1.5)] * 500, ("near", 1.0), ("near", 1.0 + 2**-52), ("near", 1e300)]
    df = spark.createDataFrame(rows, "c string, v double")
    want = {}
    for c in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == c and v is not None)
        if values:
            want[c] = values[max(1, -(-len(values) * q // 1)) .__int__() - 1]
    for limit in (1, 50, 10**6):
        assert {r["c"]: r["v"] for r in evaluate.exact_quantile(df, "c", "v", q, limit).collect()} == want


def test_quantile_of_a_million(spark):
    df = spark.range(1_000_000).select(F.lit("x").alias("c"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("v"))
    want = df.select(F.percentile("v", 0.5)).first()[0]
    assert evaluate.exact_quantile(df, "c", "v", 0.5, limit=1000).first()["v"] == want
