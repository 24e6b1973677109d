"""Periodic runs of words: maximal pairs of an LCP-interval tree, with the word to the left as a class.

The suffixes of a text's words are sorted and the intervals of equal common prefix are walked bottom-up.  An interval of
prefix length l holds all places of one string of l words, in order, each with the class of the word to its left.  Where two
intervals merge, places of different children differ in the word after the string, and places of different classes
differ in the word before it: they are a maximal pair.  A maximal pair at distance d <= l is a run of period d and d + l
words as it stands.  If d is the run's smallest period, the string has no place between the two: a place at distance e < d
would give the string the periods e and d - e, and so (it is at least d words long) a common divisor as a period of the whole
run.  Pairs are therefore sought among neighbours only, and no run is met twice.

A run of at least m words, repeated at least r times, holds two equal strings of at least m - m / r words at its period's
distance.  Texts in which no such string repeats have no run and need no suffix order; shorter prefixes need no interval.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.functions.lookup import let
from loresmith.llm.bytesweep import BASE
from loresmith.llm.common import bounded_batches, packed, text_of, unpacked

MIN_WORDS = 12  # words of a run, at least


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, different ones for different words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def may_repeat(words: list[bytes], width: int) -> bool:
    """Whether a string of ``width`` words may stand twice; never False if one does."""
    if len(words) <= width:
        return False
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - width + 1
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= BASE
        total += hashes[k : k + n]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def suffix_order(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the words that each has in common with the one before it (the first: none).

    Ranks by prefixes of 1, 2, 4, ... words are kept (4 bytes a word each) and walked down again for the common prefixes.
    """
    n = len(numbers)
    ranks = numbers.astype(np.int32)
    levels, step = [ranks], 1
    order = np.argsort(ranks, kind="stable")
    while step < n:
        following = np.zeros(n, np.int64)
        following[:-step] = ranks[step:] + 1
        key = ranks.astype(np.int64) * (n + 1) + following
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.zeros(n, np.int32)
        fresh[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        ranks, step = fresh, step * 2
        levels.append(ranks)
        if ranks[order[-1]] == n - 1:
            break
    common = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        width = 1 << level
        fits = (left + width <= n) & (right + width <= n)
        same = np.zeros(n - 1, bool)
        same[fits] = levels[level][left[fits]] == levels[level][right[fits]]
        common[1:][same] += width
        left[same] += width
        right[same] += width
        np.minimum(left, n, out=left)
        np.minimum(right, n, out=right)
    return order, common


def _merge(large: list[int], small: list[int], length: int, left: list[int], least: int, found: list[tuple[int, int, int]]) -> list[int]:
    """Both children's places in order; maximal pairs between neighbours of different children go to ``found``."""
    if len(large) < len(small):
        large, small = small, large
    if len(small) == 1 or len(small) * 16 < len(large):
        for place in small:
            at = bisect_left(large, place)
            large.insert(at, place)
        merged = large
    else:
        merged = large + small
        merged.sort()
    own = small[0] if len(small) == 1 else set(small)
    last = len(merged) - 1
    for place in small:
        at = bisect_left(merged, place)
        if at:
            near = merged[at - 1]
            distance = place - near
            if distance <= length and left[near] != left[place] and distance + length >= least and (len(small) == 1 or near not in own):
                found.append((near, distance + length, distance))
        if at < last:
            near = merged[at + 1]
            distance = near - place
            if distance <= length and left[near] != left[place] and distance + length >= least and (len(small) == 1 or near not in own):
                found.append((place, distance + length, distance))
    return merged


def runs_of(numbers: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``min_words`` or more, and of two periods or more, by start and period."""
    n = len(numbers)
    shortest = (min_words + 1) // 2  # a pair at distance d <= l with d + l >= min_words
    if n <= shortest:
        return []
    order, common = suffix_order(numbers)
    deep = common >= shortest
    if not deep.any():
        return []
    # Class of the word to the left; the first word has a class of its own.
    left = [-1, *numbers[:-1].tolist()]
    found: list[tuple[int, int, int]] = []
    begins = np.flatnonzero(deep & ~np.concatenate(([False], deep[:-1])))
    ends = np.flatnonzero(deep & ~np.concatenate((deep[1:], [False]))) + 1
    for begin, end in zip(begins.tolist(), ends.tolist()):
        places, shared = order[begin - 1 : end].tolist(), common[begin:end].tolist()
        stack: list[tuple[int, list[int]]] = []  # open intervals: common words, places of their children so far
        current = [places[0]]
        for place, length in zip(places[1:], shared):
            while stack and stack[-1][0] > length:
                depth, before = stack.pop()
                current = _merge(before, current, depth, left, min_words, found)
            if stack and stack[-1][0] == length:
                depth, before = stack.pop()
                current = _merge(before, current, depth, left, min_words, found)
            stack.append((length, current))
            current = [place]
        while stack:
            depth, before = stack.pop()
            current = _merge(before, current, depth, left, min_words, found)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    turns = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    return np.cumsum(turns[:-1]) == 0


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed`` added.

    Words are runs of anything but ASCII white space, numbered from 0.  A run is a stretch with smallest period q, of at least
    ``min_words`` and 2 q words, that no neighbouring word extends.  ``collapsed`` is the text without the words that a
    run holds after its first q, joined by one space.  A null or empty text has no words, no runs and '' as its
    collapsed text; every row is looked at by itself, so repeated rows, ties and null ids need no rule.  Input columns
    with the name of an added one are replaced.  A task holds one text at a time: its words, and 4 bytes a word and
    doubling step if a string of ``min_words / 2`` words stands in it twice.
    """
    if min_words < 2:
        raise ValueError("a run has at least two words")
    bounded_batches(docs.sparkSession)
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    @F.arrow_udf(schema)
    def find(texts: pa.Array) -> pa.Array:
        every, counts, collapsed = [], [0], []
        for value in texts:
            words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
            runs = runs_of(word_numbers(words), min_words) if may_repeat(words, (min_words + 1) // 2) else []
            if runs:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
            every.extend(runs)
            counts.append(len(every))
            collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        columns = np.array(every, np.int64).reshape(-1, 3).T
        items = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"])
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items), pa.array(collapsed, pa.string())],
            names=["runs", "collapsed"])

    rows = docs.select(packed(docs).alias("row"), find(text_of(docs, text)).alias("found"))
    return rows.select(*unpacked("row", docs, runs=F.col("found.runs"), collapsed=F.col("found.collapsed")))


def echoed(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by crc32 of the id, repeat the words from some word on with some period."""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", text_of(docs).alias("text"), number.alias("h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g = F.floor(F.col("h") / 10)

    def repeated(w):
        def place(i, a):
            return F.when(i < a, i).otherwise(a + (i - a) % (1 + F.floor((F.size(w) - a) / (3 + g % 8)))).cast("int")

        places = let(g % F.size(w), lambda a: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: place(i, a)))
        return F.when(F.size(w) > 0, F.array_join(F.transform(places, lambda i: F.get(w, i)), " ")).otherwise("")

    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and sha256 of all runs and of the collapsed text, after :func:`echoed`."""
    found = find_runs(echoed(docs))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    length, period = F.col("best.length"), -F.col("best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
