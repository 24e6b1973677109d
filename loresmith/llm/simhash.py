"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within two bits by multi-index hashing.

Fingerprints differing in at most two bits agree up to one bit in the first half or agree wholly in the second.  So
the first half is looked up with every value of its one-bit ball, the second half as it is, and whole distances are
verified.  Only different fingerprints are searched; copies are grouped first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.common import bounded_batches, packed, text_of, unpacked
from loresmith.llm.components import components
from loresmith.session import broadcast_if_small, written

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
HALF = BITS // 2
BUCKET_MAX = 64  # fingerprints in a bucket that are compared one by one; fuller buckets go the way of ``_star_links``
PIECE_BYTES = 1 << 20


def _pieces(text: bytes):
    """Words of a text in runs of about PIECE_BYTES, so that a long text never stands whole as a list of words."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end].split()
        start = end


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """SimHash of one text by its shingles of ``width`` (two or more) words, as a signed 64-bit number."""
    digest, join, ones, total, carry = xxhash.xxh64_intdigest, b" ".join, np.zeros(BITS, np.int64), 0, []

    def add(shingles):
        nonlocal ones, total
        values = np.array([digest(s, SEED) for s in shingles], np.dtype("<u8"))
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(values)

    for words in _pieces(text.encode("utf-8").lower()):
        words = carry + words
        if len(words) >= width:
            add(map(join, zip(*(words[k:] for k in range(width)))))
        carry = words[-(width - 1):]
    if not total and carry:
        add([join(carry)])
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.dtype("<i8"))[0])


def fingerprint_of(body: Column, width: int = SHINGLE) -> Column:
    """``fingerprint`` as a column."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(t.as_py() or "", width) for t in texts), pa.int64())

    return of(body)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, text_hash, fp) per row, written: the only pass over the texts."""
    bounded_batches(docs.sparkSession)
    body = text_of(docs, text)
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), fingerprint_of(body).alias("fp"))
    return written(rows, "fingerprints")


def _first(fp: str):
    return F.shiftrightunsigned(fp, HALF)


def _second(fp: str):
    return F.col(fp).bitwiseAND(F.lit((1 << HALF) - 1))


def _flip(value, bit):
    return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))


def _entry(segment: int, key):
    return F.struct(F.lit(segment).alias("segment"), key.alias("key"))


def _star_links(crowd: DataFrame) -> DataFrame:
    """Exact links among ``crowd`` (fp) for buckets too full to be compared one by one, without making pairs.

    Two fingerprints are within two bits of each other exactly if their one-bit balls share a value.  Each fingerprint
    goes to the 65 values of its ball; a value has at most 65 visitors, which are linked to the smallest of them.
    """
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda j: _flip(F.col("fp"), j)))
    met = crowd.select("fp", F.explode(ball).alias("meet")).groupBy("meet").agg(F.collect_set("fp").alias("fps"))
    met = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return met.where("a <> b").distinct()


def links(distinct: DataFrame, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, each once) that connect all those within two bits."""
    first, second = _first("fp"), _second("fp")
    entries = distinct.select("fp", F.explode(F.array(_entry(0, first), _entry(1, second))).alias("e")).select("fp", "e.*")
    # Of two halves differing in one bit, the one with the bit set probes: each pair is met once.
    one = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda j: F.bit_get(first, j) == 1),
        lambda j: _entry(0, _flip(first, j)),
    )
    ball = F.concat(F.array(_entry(0, first), _entry(1, second)), one)
    probes = distinct.select(F.col("fp").alias("a"), F.explode(ball).alias("e")).select("a", "e.*")
    full = written(entries.groupBy("segment", "key").count().where(F.col("count") > bucket_max).select("segment", "key"), "full")
    open_entries = entries.join(full, ["segment", "key"], "left_anti").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = probes.join(open_entries, ["segment", "key"]).where(near & (F.col("a") != F.col("b"))).select("a", "b")
    if full.isEmpty():
        return pairs
    crowd = written(probes.join(full, ["segment", "key"], "left_semi").select(F.col("a").alias("fp")).distinct(), "crowd")
    return pairs.union(_star_links(crowd))


def _grouped(rows: DataFrame, bucket_max: int) -> DataFrame:
    """(fp, group, component_id) for each different fingerprint: group is equal within a component."""
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    roots = components(links(distinct, bucket_max))
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "rep")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = linked.select(F.col("fp").alias("node"), "root").join(smallest, "root")
    joined = distinct.join(linked, distinct["fp"] == linked["node"], "left")
    alone = F.col("root").isNull()
    return written(joined.select(
        "fp", F.coalesce("root", "fp").alias("group"),
        F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"),
    ), "groups")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_max: int = BUCKET_MAX
) -> DataFrame:
    """Class of every row: id under its own name, ``fingerprint`` (16 hex digits) and ``component_id``.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles have three words, repeats count.  A
    shorter text is one shingle; a null or empty text has fingerprint zero and links like any other.  ``component_id`` is the
    smallest id reachable over links of two bits or fewer, null only if no row of the component has an id.  Repeated rows
    give repeated results.  Other columns of the input are not read.  Empty input gives an empty result.
    """
    rows = fingerprints(docs, text, doc_id)
    groups = _grouped(rows, bucket_max).select("fp", "component_id")
    return rows.join(groups, "fp").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_max: int = BUCKET_MAX) -> DataFrame:
    """Rows of ``docs`` with one row of each near-duplicate component: the smallest (id, hash of the text), nulls first.

    Rows that repeat in id and text are one document and are reduced to one row as well.  Columns stay as they are.
    """
    rows = fingerprints(docs, text, doc_id)
    documents = rows.groupBy("id", "text_hash", "fp").agg(F.count("*").alias("n"))
    documents = written(documents.join(_grouped(rows, bucket_max).select("fp", "group"), "fp"), "documents")
    return first_of_groups(docs, documents, text, doc_id)


def first_of_groups(docs: DataFrame, documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows of ``docs`` that are the first of their group; ``documents`` (id, text_hash, n, group) has each document once."""
    first = documents.groupBy("group").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    judged = documents.join(first, "group").select(
        F.col("id").alias("jid"), F.col("text_hash").alias("jth"), "n", (F.struct("id", "text_hash") == F.col("first")).alias("stays")
    )
    judged = written(judged, "judged")
    keyed = docs.select(packed(docs).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text_of(docs, text)).alias("th"))

    def same(other: DataFrame):
        return keyed["id"].eqNullSafe(other["jid"]) & (keyed["th"] == other["jth"])

    gone = broadcast_if_small(judged.where("NOT stays").select("jid", "jth"))
    kept = keyed.join(gone, same(gone), "left_anti")
    repeated = judged.where("stays AND n > 1").select("jid", "jth")
    if repeated.isEmpty():
        return kept.select(*unpacked("row", docs))
    repeated = broadcast_if_small(repeated)
    single = kept.join(repeated, same(repeated), "left_anti")
    # Equal copies are combined before the shuffle, however many there are.
    copies = kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["id", "th"])
    return single.unionByName(copies).select(*unpacked("row", docs))
