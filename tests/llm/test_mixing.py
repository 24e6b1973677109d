import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loresmith.llm import mixing


def poisson(u, rate):
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c < u:
        k += 1
        p *= rate / k
        c += p
    return k


def expected(rows, rate_of, seed=mixing.SEED):
    out = Counter()
    for doc, text, source in rows:
        digest = hashlib.md5(f"{seed}:{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()
        rate = rate_of(source)
        draws = max(1, math.ceil(rate / mixing.RATE_PER_DRAW))
        n = 0
        for j in range(1, draws + 1):
            u = int(hashlib.md5(f"{digest}#{j}".encode()).hexdigest()[: mixing.HEX_DIGITS], 16) / 16**mixing.HEX_DIGITS
            n += poisson(u, rate / draws) if rate > 0 else 0
        out[(doc, text, source)] += n
    return +out


def rows():
    made = [(i, "x" * (i % 37 + 1), ["a", "b", "c"][0 if i % 3 else i % 2]) for i in range(600)]
    return made + [(700, None, "a"), (701, "", "b"), (None, "yy", "c"), (702, "zz", None), (703, "z", None), (5, "x" * 6, "c"), (5, "x" * 6, "c"),
                   (704, "", "empty source")]


def test_tempered_against_inversion_in_python(spark, make_docs):
    given = [(d, t, s) for d, t, s in rows()]
    docs = make_docs([(d, t, "en", s) for d, t, s in given])
    size = Counter()
    for _, t, s in given:
        size[s] += len(t or "")
    weighed = sum(math.sqrt(v) for v in size.values() if v)
    total = sum(size.values())
    rate = lambda s: math.sqrt(size[s]) / weighed * total / size[s] if size[s] else 0.0
    got = mixing.mix_sources(docs)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == expected(given, rate)
    assert got.columns == [*docs.columns, "copy", "mix_key"]
    again = mixing.mix_sources(docs.repartition(7))
    assert sorted(r["mix_key"] for r in got.collect()) == sorted(r["mix_key"] for r in again.collect())


def test_listed_weights_and_large_rates(spark, make_docs):
    given = [(i, "x" * 10, "big") for i in range(300)] + [(1000, "x" * 2, "tiny"), (1001, "x" * 10, "unlisted")]
    docs = make_docs([(d, t, "en", s) for d, t, s in given])
    rate = {"big": 0.5 * 3012 / 3000, "tiny": 0.5 * 3012 / 2, "unlisted": 0.0}
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix_sources(docs, {"big": 1.0, "tiny": 1.0, "absent": 0.0}).collect())
    assert got == expected(given, rate.get) and got[(1000, "xx", "tiny")] > 600


def test_shares_come_near_the_targets(spark, make_docs):
    docs = make_docs([(i, "word " * (i % 9 + 1), "en", "a" if i % 10 else "b") for i in range(20_000)])
    got = {r["source"]: r["n"] for r in mixing.mix_sources(docs, {"a": 1.0, "b": 3.0}).groupBy("source").agg(
        F.sum(F.length("text")).alias("n")).collect()}
    assert got["b"] / (got["a"] + got["b"]) == pytest.approx(0.75, abs=0.02)


def test_native_plan_and_empty(spark, make_docs):
    docs = make_docs([(1, "x", "en", "a")])
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix_sources(docs.where(F.lit(False))).count() == 0


def test_unmarked_keeps_columns_of_the_input(spark, make_docs):
    docs = make_docs([(i, "x" * 20, "en", "s") for i in range(50)]).withColumn("copy", F.lit("own")).withColumn("mix_key", F.col("doc_id"))
    for made in (mixing.mix_sources(docs, marked=False), corpus_pipeline.mix_sources(spark, docs, "")):
        rows = made.collect()
        assert made.columns == docs.columns and rows and all(r["copy"] == "own" and r["mix_key"] == r["doc_id"] for r in rows)
