import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loresmith.llm import sharding
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_copies import brute as first_of_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf).toPandas()
        out.append((name, docs.toPandas(), made))
        docs = spark.createDataFrame(pa.Table.from_pandas(made, preserve_index=False))
    return out


def test_columns_and_order(stages):
    assert [name for name, _, _ in stages] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    for _, _, made in stages[:-1]:
        assert list(made.columns) == COLUMNS
    assert list(stages[-1][2].columns) == [*COLUMNS, "shard_id", "row_bytes"]


def test_every_stage_against_brute_force(spark, stages):
    by_name = {name: (given, made) for name, given, made in stages}
    given, made = by_name["language"]
    assert len(made) >= 0.99 * len(given) and set(made.doc_id) <= set(given.doc_id)
    given, made = by_name["near_duplicates"]
    assert sorted(made.doc_id) == first_of_near_copies(list(zip(given.doc_id, given.text)))
    given, made = by_name["decontamination"]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_ in leaks(list(zip(given.doc_id, given.text)), items)}
    assert bad and sorted(made.doc_id) == sorted(set(given.doc_id) - bad)
    given, made = by_name["mixing"]
    assert set(made.doc_id) <= set(given.doc_id)
    given, made = by_name["sharding"]
    assert sorted(made.doc_id) == sorted(given.doc_id)
    sizes = made.groupby("shard_id").row_bytes.sum()
    assert (sizes <= sharding.LIMIT_BYTES).all()


def test_run_is_registered_and_whole(spark, stages):
    got = entry.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    want = stages[-1][2]
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(want.doc_id)


def test_no_stage_reads_a_part_only():
    assert not re.search(r"\.limit\(|\.sample\(|localCheckpoint", open(corpus_pipeline.__file__).read())
