"""Texts against a dictionary that is a table: every text is read once for a block of keywords, however many there are.

The keywords of a block form one Aho-Corasick automaton.  A block has a bounded size (``BLOCK_BYTES``, ``BLOCK_ROWS``), so what is
sent to the tasks is bounded too; a larger dictionary is parted by hash into blocks, and the texts pass once by each.  For tables of whole
passages, which would need many blocks, :mod:`loresmith.operators.containment` joins by hashes instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.session import broadcast_if_small, written

BLOCK_BYTES = 1 << 20  # of keywords: about a million states
BLOCK_ROWS = 200_000
_BUILT: dict[str, ahocorasick.Automaton] = {}  # in each Python worker: the automaton of the block at work


def _automaton(name: str, keywords: list[str]) -> ahocorasick.Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        automaton = ahocorasick.Automaton()
        for number, keyword in enumerate(keywords):
            automaton.add_word(keyword, number)
        automaton.make_automaton()
        _BUILT[name] = automaton
    return _BUILT[name]


def _block_labels(texts: DataFrame, block: DataFrame) -> DataFrame:
    by_keyword: dict[str, list[str]] = {}
    for keyword, label in block.toLocalIterator():
        by_keyword.setdefault(keyword, []).append(label)
    sent = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(by_keyword), list(by_keyword.values())))

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, keywords, labels = sent.value
        automaton = _automaton(name, keywords) if keywords else None
        for record in records:
            found = []
            for text in record.column(1):
                held = {number for _, number in automaton.iter(text.as_py())} if automaton and text.is_valid else ()
                found.append(sorted({label for number in held for label in labels[number]}))
            yield pa.RecordBatch.from_arrays([record.column(0), pa.array(found, pa.list_(pa.string()))], names=["text_id", "labels"])

    return texts.mapInArrow(run, texts.select("text_id").schema.add("labels", T.ArrayType(T.StringType())))


def labels_in(texts: DataFrame, dictionary: DataFrame, label: str) -> DataFrame:
    """(text_id, labels): for every row of ``texts`` and every block of the dictionary the sorted labels whose keywords the text contains.

    texts(text_id, text), dictionary(keyword, <label>).  Case is ignored; a keyword counts anywhere in a text, not as a whole
    word only.  Empty and null keywords and null labels are left out.  A text that is null or holds nothing has an empty list.
    """
    entries = dictionary.select(F.lower("keyword").alias("keyword"), F.col(label).cast("string").alias("label"))
    entries = written(entries.where("keyword <> '' AND label IS NOT NULL").distinct(), "dictionary")
    size = entries.agg(F.count("*").alias("n"), F.sum(F.octet_length("keyword") + F.octet_length("label")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ROWS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    lower = texts.select("text_id", F.lower("text").alias("text"))
    of_block = F.pmod(F.xxhash64("keyword"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_block_labels(lower, entries.where(of_block == b)) for b in range(blocks)])


def keywords_in(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(text_id, keyword): the distinct lower-cased keywords that each row of ``texts`` contains, without a shuffle."""
    found = labels_in(texts, dictionary.select("keyword", F.lower("keyword").alias("same")), "same")
    return found.select("text_id", F.explode("labels").alias("keyword"))  # a keyword is in one block only


def tags_in(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(text_id, tags): the distinct tags whose keywords occur in the text, by ``tag_no``, then by name; rows of one id are one text.

    dictionary(tag_no, tag, keyword).  A tag with several numbers has the smallest of them; null numbers come last.
    """
    order = dictionary.where("tag IS NOT NULL").groupBy("tag").agg(F.coalesce(F.min("tag_no"), F.lit((1 << 63) - 1)).alias("tag_no"))
    found = labels_in(texts, dictionary, "tag").select("text_id", F.explode_outer("labels").alias("tag"))
    placed = found.join(broadcast_if_small(order.select(F.col("tag").cast("string").alias("tag"), "tag_no")), "tag", "left")
    kept = F.sort_array(F.collect_set(F.when(F.col("tag").isNotNull(), F.struct("tag_no", "tag"))))
    return placed.groupBy("text_id").agg(F.transform(kept, lambda x: x["tag"]).alias("tags"))
