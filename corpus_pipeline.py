"""A corpus from raw documents to shards: language, near-duplicates, benchmark leaks, source mix, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog.base import Registry
from loresmith.llm import decontaminate, langid, mixing, near_copies, sharding
from loresmith.llm.common import table
from loresmith.session import written

REG = Registry()


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those of no language by half of their words or more."""
    return langid.with_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard 0.8 or more stays: the one with the smallest id.

    Candidates are the pairs that ``simhash`` (op2) links by fingerprints of five-word shingles, and pairs by MinHash beyond its two bits.
    """
    return near_copies.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources have their target shares; all copies in random order."""
    return mixing.mix_sources(docs, marked=False)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its shard."""
    return sharding.shard(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", make_shards),
]

ORACLE_SQL = None  # learned labels and XXH64 fingerprints are beyond SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


REG.queries["pipeline"] = run
