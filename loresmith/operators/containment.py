"""Which texts contain which passages, letter for letter: an equi-join on winnowed hashes, then a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresmith.functions.minimizers import minimizers
from loresmith.session import broadcast_if_small, written

# (width, window) of the hashes: passages of width + window - 1 code points or more, that is of 31 or more and of 12 to 30.
LEVELS = ((16, 16), (8, 5))


def _level_pairs(passages: DataFrame, texts: DataFrame, width: int, window: int) -> DataFrame:
    """Pairs that share the passage's rarest hash.  The texts are read once; only hashes that some passage has leave the scan."""
    asked = written(minimizers(passages, "passage_id", "passage", width, window).distinct(), "asked-hashes")
    hashes = broadcast_if_small(asked.select("hash").distinct())
    held = written(minimizers(texts, "text_id", "text", width, window).join(hashes, "hash", "left_semi"), "held-hashes")
    counts = held.groupBy("hash").agg(F.count("*").alias("n"))  # a hash of no text: no text contains the passage
    rated = asked.join(counts, "hash", "left").select("passage_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash").alias("best"))
    anchors = rated.groupBy("passage_id").agg(F.min("best")["hash"].alias("hash"))
    return held.join(broadcast_if_small(anchors), "hash").select("passage_id", "text_id")


def _grams(texts: DataFrame, width: int) -> DataFrame:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - width + 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr("text", i, F.lit(width))))
    return texts.select("text_id", F.explode_outer(grams).alias("anchor"))


def _begun_pairs(passages: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs in which the text holds the first ``width`` letters of the passage."""
    begun = broadcast_if_small(passages.select("passage_id", F.substring("passage", 1, width).alias("anchor")))
    return _grams(texts, width).join(begun, "anchor").select("passage_id", "text_id")


def candidate_pairs(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (passage_id, text_id) that hold every pair where the text contains the passage.

    A text that contains a passage has all of the passage's winnowed hashes, so the one that the fewest texts have is looked
    up.  A passage too short for a window is looked up by its first letters, as many as the shortest such passage has.
    Lengths for which there is no passage cost no pass over the texts.
    """
    least = [width + window - 1 for width, window in LEVELS]
    lengths = F.length("passage")
    sizes = passages.agg(F.max(lengths), F.min(lengths), *[F.max((lengths >= n) & (lengths < top)) for n, top in zip(least, [1 << 31, *least])])
    longest, shortest, *asked = sizes.first()
    if longest is None:
        return texts.limit(0).join(passages.limit(0)).select("passage_id", "text_id")
    found = []
    for (width, window), n, top, any_passage in zip(LEVELS, least, [1 << 31, *least], asked):
        if any_passage:
            found.append(_level_pairs(passages.where((lengths >= n) & (lengths < top)), texts, width, window))
    if shortest < least[-1]:
        found.append(_begun_pairs(passages.where(lengths < least[-1]), texts, shortest))
    return reduce(DataFrame.unionByName, found).distinct()


def containing_pairs(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (passage_id, text_id) where the text contains the passage.

    passages(passage_id, passage), texts(text_id, text); ids of any type.  Empty passages and null texts are left out.
    """
    passages = passages.where(F.length("passage") > 0).select("passage_id", "passage").distinct()
    texts = texts.where(F.col("text").isNotNull()).select("text_id", "text")
    pairs = written(candidate_pairs(passages, texts), "anchored").join(broadcast_if_small(passages), "passage_id")
    both = texts.join(broadcast_if_small(pairs), "text_id")
    return both.where(F.contains("text", F.col("passage"))).select("passage_id", "text_id").distinct()
