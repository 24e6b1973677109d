"""Benchmark decontamination: which documents hold which test items.

Test items are parted by size (number of distinct shingles, in powers of two).  An item's MinHash sketch is the lowest k of
its shingle hashes, with k fixed by its size class so that k is more than the shingles an item may lack.  A document of
any length holds a large enough part of an item only if it holds a known number of the sketch's values; documents are
probed for those values, and candidates are verified by their exact shingles.  No item that qualifies can be missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.bytesweep import LOWER, WORD_BYTES, chunks, shingle_hashes, word_hashes
from loresmith.llm.common import bounded_batches, packed, text_of, unpacked
from loresmith.session import broadcast_if_small, written

SHINGLE = 5
THRESHOLD = 0.8
EXTRA = 8  # sketch values beyond those an item may lack
FILTER_BITS = 26  # the probe filter is a bitmap of 2 ** FILTER_BITS bits (8 MB), whatever the number of items


def _items(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """Items once each; texts that share an id stay apart."""
    body = text_of(items, text)
    return items.select(F.struct(F.col(item_id).alias("id"), F.xxhash64(body).alias("th")).alias("item"), body.alias("text")).distinct()


def item_sketches(items: DataFrame, text: str, item_id: str, threshold: float) -> DataFrame:
    """(item, width, value, need): the sketch of each item, one row per value; width is its words per shingle."""
    rows = _items(items, text, item_id)
    schema = T.StructType([
        T.StructField("item", rows.schema["item"].dataType), T.StructField("width", T.IntegerType()),
        T.StructField("need", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, needs, sketches = [], [], []
            for _, data, bounds in chunks(batch.column("text")):
                words, firsts = word_hashes(LOWER[data], bounds)
                for a, b in zip(firsts[:-1], firsts[1:]):
                    width = min(SHINGLE, int(b - a))
                    hashes = np.unique(shingle_hashes(words[a:b], np.array([0, b - a]), max(1, width))[0])
                    n = len(hashes)
                    most = 2 ** int(n).bit_length() - 1  # the largest size of the class
                    lacking = n - math.ceil(round(threshold * n, 9))
                    k = min(n, math.floor((1 - threshold) * most) + EXTRA)
                    widths.append(width)
                    needs.append(k - lacking)
                    sketches.append(hashes[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(widths, pa.int32()), pa.array(needs, pa.int32()),
                 pa.array(sketches, pa.list_(pa.int64()))], names=["item", "width", "need", "sketch"])

    made = rows.mapInArrow(sketched, schema)
    return made.select("item", "width", "need", F.explode("sketch").alias("value"))


def probe_filter(sketches: DataFrame) -> np.ndarray:
    """Bitmap of the sketch values by their leading bits; its size is fixed, so it can be broadcast for any number of items."""
    place = F.shiftrightunsigned("value", 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    packs = sketches.groupBy(F.shiftright(place, 6).alias("pack")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[packs["pack"].to_numpy()] = packs["bits"].to_numpy()
    return bitmap.view(np.uint8)


def _probed(rows: DataFrame, widths: list[int], bitmap) -> DataFrame:
    """Rows (id, th, text) that hold sketch values, with the distinct values they hold."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        for batch in batches:
            picked, values = [], []
            for first, data, bounds in chunks(batch.column("text")):
                words, firsts = word_hashes(LOWER[data], bounds)
                found = []
                for width in widths:
                    hashes, at = shingle_hashes(words, firsts, width)
                    place = hashes >> np.uint64(64 - FILTER_BITS)
                    hit = (known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    found.append(np.rec.fromarrays([at[hit], hashes[hit].view(np.int64)], names="at,value"))
                found = np.unique(np.concatenate(found)) if found else np.zeros(0, [("at", np.int64), ("value", np.int64)])
                held, starts = np.unique(found["at"], return_index=True)
                picked.extend(int(first + r) for r in held)
                values.extend(np.split(found["value"], starts[1:]) if len(held) else [])
            kept = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(values, pa.list_(pa.int64()))], names=["id", "th", "text", "values"])

    schema = T.StructType([*rows.schema.fields, T.StructField("values", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(probe, schema)


def _words(text: str, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text in runs of about ``limit`` bytes."""
    if not text:
        return
    data = LOWER[np.frombuffer(text.encode("utf-8"), np.uint8)]
    clean = np.where(WORD_BYTES[data], data, np.uint8(32)).tobytes()
    start = 0
    while start < len(clean):
        end = clean.find(b" ", start + limit)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def shingle_set(text: str, width: int, wanted: set[bytes] | None = None) -> set[bytes]:
    """Distinct shingles of a text, or those of them that are wanted."""
    found: set[bytes] = set()
    carry: list[bytes] = []
    for words in _words(text):
        words = carry + words
        made = map(b" ".join, zip(*(words[k:] for k in range(width))))
        found.update(made if wanted is None else wanted.intersection(made))
        carry = words[-(width - 1):] if width > 1 else []
    return found


def held_items(text: str, items: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(index, shingles, contained) of ``items`` (index, text) by exact shingles of the text."""
    by_width: dict[int, list[tuple[int, set[bytes]]]] = {}
    for i, item in items:
        width = min(SHINGLE, sum(len(w) for w in _words(item)))
        if width:
            by_width.setdefault(width, []).append((i, shingle_set(item, width)))
    out = []
    for width, sets in by_width.items():
        found = shingle_set(text, width, set().union(*(s for _, s in sets)))
        out.extend((i, len(s), len(s & found)) for i, s in sets)
    return out


def _asked_values(sketches: DataFrame, held: DataFrame) -> DataFrame:
    """(item, need, sketch): each item's sketch with the values that the fewest documents hold first.

    A document with ``need`` of k values has one of any k - need + 1, so the rarest of them are enough to find it: a stem that
    thousands of items and millions of documents share is looked up only for items that are hardly more than that stem.
    """
    counts = held.select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    rated = sketches.join(counts, "value", "left").select("item", "need", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "value").alias("rated"))
    ordered = rated.groupBy("item").agg(F.first("need").alias("need"), F.sort_array(F.collect_list("rated")).alias("rated"))
    return ordered.select("item", "need", F.transform("rated", lambda x: x["value"]).alias("sketch"))


@F.arrow_udf(T.ArrayType(T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("held", T.IntegerType())])))
def _verified(texts: pa.Array, items: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int32()), ("held", pa.int32())]))
    made = ([dict(zip(("i", "n", "held"), x)) for x in held_items(t.as_py(), list(enumerate(it.as_py())))]
            for t, it in zip(texts, items))
    return pa.array(made, kind)


def _matches(
    docs: DataFrame, items: DataFrame, threshold: float, text: str, doc_id: str, item_text: str, item_id: str
) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    sketches = written(item_sketches(items, item_text, item_id, threshold), "item-sketches")
    widths = [r["width"] for r in sketches.select("width").distinct().collect()]  # at most SHINGLE values
    bitmap = spark.sparkContext.broadcast(probe_filter(sketches))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_of(docs, text)).alias("th"), text_of(docs, text).alias("text"))
    held = _probed(rows, widths, bitmap).withColumn("row", F.monotonically_increasing_id())
    held = written(held, "probed")  # numbered once: the numbers are read, never made again
    asked = written(_asked_values(sketches, held), "asked-values")
    prefix = asked.select("item", F.explode(F.slice("sketch", 1, F.size("sketch") - F.col("need") + 1)).alias("value"))
    pairs = held.select("row", F.explode("values").alias("value")).join(prefix, "value").select("row", "item").distinct()
    texts = _items(items, item_text, item_id).withColumnRenamed("text", "item_text").join(asked, "item")
    listed = pairs.join(texts, "item").groupBy("row").agg(
        F.collect_list(F.struct("item", "item_text", "sketch", "need")).alias("items"))
    # Items of which the document has enough values share most of their shingles with it.
    enough = F.filter("items", lambda x: F.size(F.array_intersect("values", x["sketch"])) >= x["need"])
    both = held.select("row", "id", "th", "text", "values").join(listed, "row").withColumn("items", enough).where("size(items) > 0")
    checked = both.select("id", "th", "items", _verified("text", F.transform("items", lambda x: x["item_text"])).alias("found"))
    flat = checked.select("id", "th", "items", F.explode("found").alias("f")).where(
        F.col("f.held") >= F.ceil(F.round(F.col("f.n") * threshold, 9)))
    return flat.select("id", "th", F.get("items", F.col("f.i"))["item"]["id"].alias("item"), "f.n", "f.held")


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """Pairs (doc id, item id, n_shingles, n_contained, containment) with containment of ``threshold`` or more.

    Words are runs of digits, ASCII letters and anything beyond ASCII, A-Z lower-cased.  Shingles have five words; an item
    of fewer words is one shingle of all its words; an item without words is held by no document.  ``containment`` is
    the share of the item's distinct shingles that stand anywhere in the document.  Null texts are empty.  Repeated rows
    give repeated pairs; items equal in id and text count once.  Empty inputs give an empty result.
    """
    found = _matches(docs, items, threshold, text, doc_id, item_text, item_id)
    name = item_id if item_id != doc_id else f"item_{item_id}"
    return found.select(
        F.col("id").alias(doc_id), F.col("item").alias(name), F.col("n").alias("n_shingles"),
        F.col("held").alias("n_contained"), (F.col("held") / F.col("n")).alias("containment"))


def without_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """Rows of ``docs`` that hold no item; columns stay as they are."""
    found = _matches(docs, items, threshold, text, doc_id, item_text, item_id)
    gone = broadcast_if_small(written(found.select(F.col("id").alias("gone"), F.col("th").alias("gone_th")).distinct(), "leaks"))
    keyed = docs.select(packed(docs).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text_of(docs, text)).alias("th"))
    same = keyed["id"].eqNullSafe(gone["gone"]) & (keyed["th"] == gone["gone_th"])
    return keyed.join(gone, same, "left_anti").select(*unpacked("row", docs))


def contaminated_sql(threshold: float = THRESHOLD) -> str:
    """The same by comparing all shingles."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH i AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
d AS (SELECT doc_id, {words} AS w FROM documents),
widths AS (SELECT *, least(len(w), {SHINGLE}) AS k FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM widths)),
sizes AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id),
sd AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
       FROM (SELECT d.*, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS p FROM d, (SELECT DISTINCT k FROM widths))),
held AS (SELECT doc_id, item_id, count(*) AS c FROM sd JOIN si USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n::INT AS n_shingles, c::INT AS n_contained, c / n AS containment
FROM held JOIN sizes USING (item_id) WHERE c >= ceil(round(n * {threshold}, 9))"""
