"""Near copies by Jaccard similarity of word shingles: SimHash and MinHash bands find candidates, whole shingle sets verify them.

Texts whose SimHash fingerprints lie within two bits are candidates by ``simhash.links``, which finds the nearly exact copies.  Pairs
at the threshold lie up to 17 bits apart, where no segments with small balls meet; those are found as follows.

A text's signature is 24 bands of four minima.  Two texts share a band with probability J ** 4, so a pair at J = 0.8 is met
in some band but for 3 in a million.  Texts of a small bucket are compared pairwise.  For the texts of full buckets, say the
pages of one form, shingles are counted, and those of few texts are rare.  A pair that shares a rare shingle shares one among
the rarest fifth of either text, so such pairs are listed shingle by shingle.  A pair that shares none has at most its common
shingles in common: of r and r' rare, c and c' common ones, J <= min(c, c') / (r + r' + max(c, c')).  Where that bound is below
the threshold nothing is compared; elsewhere one text has few rare shingles, and is compared with centres of its bucket in
a few rounds, then with all texts of the bucket that the bound allows and that are not yet in its component.  So no
pair is given up for the size of a bucket.  Copies of a text are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm import simhash
from loresmith.llm.bytesweep import BASE, LOWER, byte_class, chunks, mixed, shingle_hashes, word_hashes
from loresmith.llm.common import bounded_batches, text_of
from loresmith.llm.components import components
from loresmith.llm.simhash import first_of_groups
from loresmith.session import broadcast_if_small, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
BUCKET_MAX = 16  # texts of a bucket that are compared pairwise
RARE_MAX = 16  # texts that hold a rare shingle, at most
ROUNDS = 3  # centres that the texts of a fuller bucket are compared with before all of them are
BLOCK = 4096
SEED = 42
NOT_SPACE = byte_class(lambda b: b not in b" \t\n\v\f\r")
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingled(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For every text the hashes of its shingles; a text of fewer words is one shingle, one without words a shingle too."""
    for _, data, bounds in chunks(texts):
        words, firsts = word_hashes(LOWER[data], bounds, NOT_SPACE)
        for a, b in zip(firsts[:-1], firsts[1:]):
            hashes = shingle_hashes(words[a:b], np.array([0, b - a]), max(1, min(width, int(b - a))))[0]
            yield hashes if len(hashes) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the MinHash signature."""
    lowest = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), BLOCK):
        np.minimum(lowest, (hashes[start : start + BLOCK] * _FACTORS).min(axis=1), out=lowest)
    rows = lowest.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = total * BASE + rows[:, k]
    return mixed(total).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(docs: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(id, text_hash, keys, fp) per row, written."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(texts: pa.Array) -> pa.Array:
        return pa.array([band_keys(h) for h in shingled(texts, width)], pa.list_(pa.int64()))

    body = text_of(docs, text)
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), keys(body).alias("keys"),
                       simhash.fingerprint_of(body, width).alias("fp"))
    return written(rows, "signed")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the texts (text_hash, fp) whose fingerprints are linked, written.

    Texts of one fingerprint are paired with the smallest of them, those of linked fingerprints by their smallest.
    """
    heads = written(nodes.groupBy("fp").agg(F.min("text_hash").alias("th"), F.count("*").alias("n")), "fingerprints")
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("th").alias(f"t{side}"))
    linked = simhash.links(heads.select("fp")).join(of("a"), "a").join(of("b"), "b").select(*_ordered(F.col("ta"), F.col("tb")))
    shared = broadcast_if_small(heads.where("n > 1").select("fp", "th"))
    equal = nodes.join(shared, "fp").where("text_hash <> th").select(*_ordered(F.col("th"), F.col("text_hash")))
    return written(linked.union(equal).distinct(), "simhash-pairs")


def _verified(pairs: DataFrame, held: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts have a Jaccard similarity of ``threshold`` or more."""

    @F.arrow_udf(T.DoubleType())
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([jaccard(a, b) for a, b in zip(shingled(left, width), shingled(right, width))], pa.float64())

    both = pairs.join(held.toDF("a", "text_a"), "a").join(held.toDF("b", "text_b"), "b")
    judged = both.select("a", "b", similarity("text_a", "text_b").alias("j"))
    return written(judged.where(F.col("j") >= threshold).select("a", "b"), "near-links")


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _shingle_sets(held: DataFrame, width: int) -> DataFrame:
    """(th, s): the distinct shingles of every text, written."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(h).view(np.int64) for h in shingled(texts, width)], pa.list_(pa.int64()))

    return written(held.select("th", distinct("text").alias("s")), "shingles")


def _profiles(sets: DataFrame, threshold: float, rare_max: int) -> DataFrame:
    """(th, rare, common, first) of every text, written.

    ``rare`` and ``common`` are numbers of shingles; ``first`` holds the shared rare ones among the text's rarest, as many as
    a pair at the threshold has to share one of.
    """
    single = sets.select("th", F.size("s").alias("size"), F.explode("s").alias("s"))
    shared = written(single.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "shared-shingles")
    of_text = single.join(broadcast_if_small(shared), "s").groupBy("th", "size").agg(
        F.count_if(F.col("n") > rare_max).alias("common"), F.count("*").alias("shared"),
        F.array_sort(F.collect_list(F.when(F.col("n") <= rare_max, F.struct("n", "s")))).alias("few"))
    lead = F.floor(F.col("size") * (1 - threshold) + 1e-6) + 1  # a pair at the threshold shares one of so many rarest
    lead = F.greatest(F.lit(0), lead - (F.col("size") - F.col("shared"))).cast("int")
    first = F.transform(F.slice("few", F.lit(1), lead), lambda x: x["s"])
    made = of_text.select("th", "size", "common", first.alias("first"))
    every = sets.select("th", F.size("s").alias("size")).join(made.drop("size"), "th", "left")
    common = F.coalesce("common", F.lit(0))
    return written(every.select("th", (F.col("size") - common).alias("rare"), common.alias("common"), "first"), "profiles")


def _pairs_in(members: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of the texts ``th`` with an equal key; for keys that are known to have few texts."""
    groups = members.groupBy(key).agg(F.collect_set("th").alias("all")).where(F.size("all") > 1)
    return groups.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b").distinct()


def _may_link(threshold: float, r1: str, c1: str, r2: str, c2: str):
    """Whether two texts that share no rare shingle can reach the threshold."""
    both = F.col(r1) + F.col(r2) + F.greatest(c1, c2)
    return F.least(c1, c2) >= both * threshold - 1e-6


def _crowded(full: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """(key, th, rare, common, component) of the texts in full buckets that can be linked without a rare shingle."""
    room = 1 / threshold - 1
    rows = full.select("key", "th").join(profiles.drop("first"), "th").where(F.col("rare") <= room * F.col("common") + 1e-6)
    return rows.select("key", "th", "rare", "common", F.col("th").alias("component"))


def _placed(crowded: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """The same with components renewed, of buckets that hold several components and a text with few rare shingles."""
    rows = crowded.drop("component").join(roots, F.col("th") == F.col("node"), "left")
    rows = written(rows.select("key", "th", "rare", "common", F.coalesce("root", "th").alias("component")), "placed")
    least = F.min(F.col("rare") - (1 / threshold - 1) / 2 * F.col("common"))
    open_keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), least.alias("least"))
    open_keys = written(open_keys.where("low < high AND least <= 1e-6").select("key"), "open-buckets")
    return written(rows.join(broadcast_if_small(open_keys), "key", "left_semi"), "crowded")


def _star_pairs(crowded: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Pairs of each bucket's centre, first the text with the fewest rare shingles, with texts of other components."""
    rank = F.col("rare") / F.col("common") if turn == 0 else F.xxhash64("th", F.lit(turn))
    heads = crowded.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "th", "component", "rare", "common")).alias("head"))
    heads = broadcast_if_small(written(heads, "heads"))
    apart = crowded.join(heads, "key").where(F.col("head.component") != F.col("component"))
    apart = apart.where(_may_link(threshold, "rare", "common", "head.rare", "head.common"))
    return apart.select(*_ordered(F.col("head.th"), F.col("th"))).distinct()


def _open_pairs(crowded: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a bucket's texts that are in different components and that the bound allows."""
    other = crowded.select("key", *[F.col(c).alias(f"{c}2") for c in ("th", "rare", "common", "component")])
    few = crowded.where(F.col("rare") <= (1 / threshold - 1) / 2 * F.col("common") + 1e-6)
    apart = few.join(other, "key").where(F.col("component") != F.col("component2"))
    apart = apart.where(_may_link(threshold, "rare", "common", "rare2", "common2"))
    return apart.select(*_ordered(F.col("th"), F.col("th2"))).distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links: only the components that the links touch are contracted anew."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    merged = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    merged = merged.select(F.col("node").alias("old"), F.col("root").alias("new"))
    fresh = merged.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("old").alias("root"))
    every = roots.select("node", "root").union(fresh).join(merged, F.col("root") == F.col("old"), "left")
    return written(every.select("node", F.coalesce("new", "root").alias("root")), "joined-roots")


def _components(
    docs: DataFrame, rows: DataFrame, width: int, threshold: float, text: str, bucket_max: int, rare_max: int, rounds: int,
) -> DataFrame:
    """(node, root) for every text hash that has a near copy."""
    nodes = rows.select("text_hash", "keys", "fp").dropDuplicates(["text_hash"])
    close = _simhash_pairs(nodes.select("text_hash", "fp"))
    entries = nodes.select(F.col("text_hash").alias("th"), F.explode("keys").alias("key"))
    buckets = written(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(entries.join(broadcast_if_small(buckets), "key"), "members")
    found = members.select("th").union(close.select("a")).union(close.select("b"))
    met = broadcast_if_small(written(found.distinct(), "met"))
    body = text_of(docs, text)
    held = docs.select(F.xxhash64(body).alias("th"), body.alias("text")).join(met, "th", "left_semi").dropDuplicates(["th"])
    held, wanted = written(held, "held"), close.union(_pairs_in(members.where(F.col("n") <= bucket_max), "key")).distinct()
    full = written(members.where(F.col("n") > bucket_max), "full")
    if full.isEmpty():
        return components(_verified(written(wanted, "candidates"), held, width, threshold))
    crowd = written(full.select("th").distinct(), "crowd")
    sets = _shingle_sets(held.join(broadcast_if_small(crowd), "th", "left_semi"), width)
    profiles = _profiles(sets, threshold, rare_max)
    wanted = wanted.union(_pairs_in(profiles.select("th", F.explode("first").alias("s")), "s"))
    crowded = written(_crowded(full, profiles, threshold), "crowded")
    wanted = written(wanted.union(_star_pairs(crowded, 0, threshold)).distinct(), "candidates")
    roots, turn = components(_verified(wanted, held, width, threshold)), 1
    crowded = _placed(crowded, roots, threshold)
    while not crowded.isEmpty():
        wanted = _star_pairs(crowded, turn, threshold) if turn < rounds else _open_pairs(crowded, threshold)
        links = _verified(written(wanted, "candidates"), held, width, threshold)
        quiet = links.isEmpty()
        if not quiet:
            roots = _joined(roots, links)
        if turn >= rounds:
            break
        # Centres that link nothing any more won't help: the rest is compared at once.
        turn = rounds if quiet else turn + 1
        crowded = crowded if quiet else _placed(crowded, roots, threshold)
    return roots


def keep_first(
    docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id",
    bucket_max: int = BUCKET_MAX, rare_max: int = RARE_MAX, rounds: int = ROUNDS,
) -> DataFrame:
    """Rows of ``docs`` with one row of each near-copy component: the smallest (id, hash of the text), nulls first.

    A-Z are lower-cased; words are runs of anything but ASCII white space.  Two texts are linked if their distinct shingles of
    ``width`` words have a Jaccard similarity of ``threshold`` or more, by 64-bit hashes of the shingles; candidates, by SimHash
    and by MinHash, are described above.  Shorter texts are one shingle; texts without words are equal.  Rows that repeat in id and text are one
    document and are reduced to one row.  Columns stay as they are.
    """
    bounded_batches(docs.sparkSession)
    rows = _signed(docs, width, text, doc_id)
    roots = _components(docs, rows, width, threshold, text, bucket_max, rare_max, rounds)
    documents = rows.groupBy("id", "text_hash").agg(F.count("*").alias("n"))
    documents = documents.join(roots, documents["text_hash"] == roots["node"], "left")
    documents = written(documents.select("id", "text_hash", "n", F.coalesce("root", "text_hash").alias("group")), "documents")
    return first_of_groups(docs, documents, text, doc_id)
