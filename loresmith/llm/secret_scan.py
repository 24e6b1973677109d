"""Secrets by patterns and by who else holds the same value.

Every text gives its candidates: the base patterns' matches and bare tokens that might be keys.  Their values are counted over
the whole corpus by a hash of the value: in how many repositories and with how many owners does it stand?  A value of
several owners is an example that people copy; one of a single owner is its own, and looks live if a base pattern found it
somewhere or if it is shaped like a key.  The live bare tokens are the spans that this count adds to the base ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.bytesweep import chunks
from loresmith.llm.common import bounded_batches, text_of
from loresmith.session import broadcast_if_small, written

#: Kinds in the order of the result, patterns of the base kinds and their shortest matches.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)"  # on text in lower case
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

#: Bare tokens: letters and digits mixed.
TOKEN_MIN = 12
TOKEN = rb"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_MIN
KEY_MIN = 20  # characters of a token that is shaped like a key ...
KEY_BITS = 3.0  # ... the entropy of its characters ...
KEY_TURNS = 4  # ... and how often it changes between letters and digits
MAX_OWNERS = 1  # owners of a value that is not an example
HOT_ROWS = 10_000  # occurrences of a value that meet in one slice of the join

_ASSIGN, _ACCESS, _TOKEN = re.compile(ASSIGN), re.compile(ACCESS), re.compile(TOKEN)
_HEX = re.compile(HEX[:-1] + rb"{%d,}" % HEX_MIN)  # the same places as all runs, less those that are too short
_DIGIT, _LETTER, _TURN = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")

Span = tuple[int, int, int, bytes]  # kind, start and end in bytes, value


def shaped_like_key(value: bytes) -> bool:
    if len(value) < KEY_MIN or len(_TURN.findall(value)) < KEY_TURNS:
        return False
    share = np.bincount(np.frombuffer(value, np.uint8))
    share = share[share > 0] / len(value)
    return float(-(share * np.log2(share)).sum()) >= KEY_BITS


def candidates(data: bytes) -> Iterator[Span]:
    """Base matches and bare tokens of a text; tokens that overlap a base match of any kind are part of it and are left out."""
    base: list[Span] = []
    for m in _ASSIGN.finditer(data.lower()):
        if m.end(1) - m.start(1) >= ASSIGN_MIN:
            base.append((0, *m.span(), data[m.start(1) : m.end(1)]))
    base.extend((1, *m.span(), m[0]) for m in _ACCESS.finditer(data) if len(m[0]) >= ACCESS_MIN)
    base.extend((2, *m.span(), m[0]) for m in _HEX.finditer(data))
    yield from base
    taken = sorted((s, e) for _, s, e, _ in base)
    at, reach = 0, 0
    for m in _TOKEN.finditer(data):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start() and _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            yield (3, *m.span(), m[0])


def code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each of the byte offsets."""
    if data.isascii():
        return {o: o for o in offsets}
    array, upto, total, last = np.frombuffer(data, np.uint8), {}, 0, 0
    for o in sorted(set(offsets)):
        total += int(np.count_nonzero((array[last:o] & 0xC0) != 0x80))
        upto[o], last = total, o
    return upto


CANDIDATE = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("value", T.StringType()), T.StructField("shaped", T.BooleanType())]))


def _scanned(docs: DataFrame, text: str, doc_id: str, repository: str, owner: str) -> DataFrame:
    """(id, th, repository, owner, found) per row, written; ``found`` has the candidates by start and kind."""

    @F.arrow_udf(CANDIDATE)
    def find(texts: pa.Array) -> pa.Array:
        counts, every = [0], []
        for _, data, bounds in chunks(texts):
            for a, b in zip(bounds[:-1], bounds[1:]):
                body = data[a:b].tobytes()
                spans = list(candidates(body))
                place = code_points(body, [o for _, s, e, _ in spans for o in (s, e)])
                made = [(kind, place[s], place[e], hashlib.sha256(value).hexdigest()[:32], shaped_like_key(value))
                        for kind, s, e, value in spans]
                every.extend(sorted(made, key=lambda r: (r[1], r[0])))
                counts.append(len(every))
        columns = list(zip(*every)) or [[]] * 5
        types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        items = pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "start", "end", "value", "shaped"])
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items)

    body = text_of(docs, text)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(body).alias("th"), named(repository).alias("repository"),
        named(owner).alias("owner"), find(body).alias("found"))
    return written(rows, "secret-candidates")


def value_owners(spans: DataFrame) -> DataFrame:
    """For each value: occurrences, distinct repositories and owners, and whether it is live.  ``spans`` has one row a place.

    Repeats are added up before they are shuffled, first by place and then by value, so that no value is gathered.
    """
    live = (F.col("kind") < KINDS.index("owned")) | F.col("shaped")
    held = spans.groupBy("value", "repository", "owner").agg(F.count("*").alias("n"), F.max(live).alias("live"))
    counted = held.groupBy("value").agg(
        F.sum("n").alias("n"), F.max("live").alias("live"),
        F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    return counted.withColumn("live", F.col("live") & (F.col("owners") <= MAX_OWNERS))


def _judged(spans: DataFrame, values: DataFrame) -> DataFrame:
    """Spans with the counts of their value.  Values with very many places are dealt to slices on both sides of the join."""
    hot = values.where(F.col("n") > HOT_ROWS).select("value", F.ceil(F.col("n") / HOT_ROWS).alias("slices"))
    dealt = spans.join(broadcast_if_small(hot), "value", "left")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("id", "th", "start"), F.coalesce("slices", F.lit(1)))).drop("slices")
    copies = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / HOT_ROWS) - 1)
    return dealt.join(broadcast_if_small(values.withColumn("slice", F.explode(copies))), ["value", "slice"])


def scan_secrets(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "doc_id", owner: str = "source",
) -> DataFrame:
    """doc id and ``spans`` of every row of ``docs``: (start, kind, end, value, repositories, owners, verdict), by start and kind.

    Kinds are numbers in ``KINDS``; offsets are code points, ends exclusive.  ``value`` is the first half of the sha256 of the
    credential itself (of an assignment, the assigned part), so that no secret is copied into the result.  ``verdict`` is
    ``example`` for a value of more than ``MAX_OWNERS`` owners, ``live`` otherwise.  All base spans are there with either
    verdict; a bare token is there if it is live: of one owner, and found by a base pattern anywhere or shaped like a key.
    Null texts are empty, null owners and repositories count as ''.  Rows equal in id and text get equal spans, and
    each counts for its own owner.  Other columns are not read; empty input gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = _scanned(docs, text, doc_id, repository, owner)
    spans = rows.where(F.size("found") > 0).select("id", "th", "repository", "owner", F.explode("found").alias("c"))
    spans = spans.select("id", "th", "repository", "owner", "c.*")
    values = written(value_owners(spans), "secret-values")
    judged = _judged(spans.select("id", "th", "kind", "start", "end", "value"), values)
    judged = judged.where((F.col("kind") < KINDS.index("owned")) | F.col("live"))
    verdict = F.when(F.col("owners") > MAX_OWNERS, "example").otherwise("live").alias("verdict")
    # A set: rows equal in id and text give every span more than once.
    kept = judged.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct(
        "start", "kind", "end", "value", "repositories", "owners", verdict))).alias("spans"))
    kept = kept.select(F.col("id").alias("kid"), F.col("th").alias("kth"), "spans")
    out = rows.select("id", "th").join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("th") == F.col("kth")), "left")
    none = F.array().cast(kept.schema["spans"].dataType)
    return out.select(F.col("id").alias(doc_id), F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, places of each base kind, sha256 of the base spans, all spans, and how many are live or examples."""
    found = scan_secrets(docs)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    judged = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("owned"))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        judged("live").alias("n_live"), judged("example").alias("n_example"),
    )
