import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loresmith.llm import sharding


def brute(rows, limit):
    """Shard bits of every (id, text) by splitting oversized buckets one bit at a time."""
    keyed = [(int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16), len((t or "").encode()) + 32, (d, t))
             for d, t in rows]
    out = {}

    def split(group, depth):
        if sum(b for _, b, _ in group) <= limit or len(group) == 1 or depth == 60:
            for h, _, key in group:
                out[key] = "s" + (format(h, "060b")[:depth] if depth else "")
            return
        for bit in (0, 1):
            half = [x for x in group if x[0] >> (59 - depth) & 1 == bit]
            if half:
                split(half, depth + 1)

    split(keyed, 0)
    return out


@pytest.mark.parametrize("limit", [100, 1000, 20_000, 10**9])
def test_against_splitting_one_bit_at_a_time(spark, make_docs, limit):
    rng = random.Random(limit)
    rows = [(i, "é" * rng.choice([0, 1, 10, 50, 400])) for i in range(400)] + [(900, None), (901, ""), (None, "x"), (902, "y" * 5000)]
    docs = make_docs(rows)
    got = sharding.shard(docs, limit)
    assert got.columns == [*docs.columns, "shard_id", "row_bytes"]
    assert {(r["doc_id"], r["text"]): r["shard_id"] for r in got.collect()} == brute(rows, limit)
    sizes = got.groupBy("shard_id").agg(F.sum("row_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= limit or r["n"] == 1 for r in sizes) and sum(r["n"] for r in sizes) == len(rows)


def test_equal_rows_are_dealt_out_by_number(spark, make_docs):
    rows = [(7, "same text")] * 500 + [(i, "other") for i in range(50)]
    got = sharding.shard(make_docs(rows), 1000).groupBy("shard_id").agg(F.sum("row_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 1000 for r in got) and sum(r["n"] for r in got) == len(rows)


def test_written_shards_and_empty(spark, make_docs, tmp_path):
    docs = make_docs([(i, "x" * 100) for i in range(100)])
    sharding.write_shards(sharding.shard(docs, 1000), str(tmp_path / "out"))
    folders = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert len(folders) > 10 and all(len(list(p.glob("*.parquet"))) == 1 for p in folders)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    assert sharding.shard(docs.where(F.lit(False))).count() == 0


def test_number_of_tasks_follows_the_bytes(spark, make_docs, monkeypatch):
    docs = make_docs([(i, "x" * 500) for i in range(400)])
    plain = sorted((r["doc_id"], r["shard_id"]) for r in sharding.shard(docs, limit=4000).collect())
    monkeypatch.setattr(sharding, "TASK_BYTES", 10_000)
    made = sharding.shard(docs, limit=4000)
    assert made.rdd.getNumPartitions() == -(-400 * 532 // 10_000)
    assert sorted((r["doc_id"], r["shard_id"]) for r in made.collect()) == plain
