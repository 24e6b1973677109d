"""Fill-in-the-middle rewriting: cut points are drawn by rank from a Roaring-style set of unit boundaries.

The boundaries of a text (offset 0 and the end of every unit, in code points) are kept in containers of 65,536 offsets
each: an array of 16-bit numbers, a bitmap, or runs, whichever is smallest.  Cumulative cardinalities lead a rank to its
container, and a select inside the container gives the offset.  Only two offsets per text come back from Python; the text
is cut and put together by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.bytesweep import chunks
from loresmith.llm.common import bounded_batches, packed, text_of, unpacked

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SALT = "7"
SPM_PERCENT = 50
REWRITE_PERCENT = 100
UNITS = ("line", "char")
CONTAINER_BITS = 16
ARRAY_MAX = 4096  # values of an array container; more fill 8 kB, the size of a bitmap
BITMAP_BYTES = 8192
BLOCK_BYTES = 1 << 20


class ArrayContainer:
    """Few offsets: sorted 16-bit numbers."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class BitmapContainer:
    """Many scattered offsets: one bit each, with the number of bits before each 64-bit word."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(1 << CONTAINER_BITS, bool)
        bits[low] = True
        self.bytes = np.packbits(bits, bitorder="little")
        self.upto = np.cumsum(np.bitwise_count(self.bytes.view(np.uint64)), dtype=np.int64)

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.upto, rank, "right"))
        before = int(self.upto[word - 1]) if word else 0
        inside = np.flatnonzero(np.unpackbits(self.bytes[8 * word : 8 * word + 8], bitorder="little"))
        return 64 * word + int(inside[rank - before])


class RunContainer:
    """Offsets in consecutive stretches: first offset of each, with the number of offsets up to its end."""

    def __init__(self, low: np.ndarray) -> None:
        begins = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.starts = low[begins].astype(np.uint16)
        self.upto = np.append(begins[1:], len(low)).astype(np.int32)

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.upto, rank, "right"))
        return int(self.starts[run]) + rank - (int(self.upto[run - 1]) if run else 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted, distinct offsets below 65,536."""
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    if 4 * runs < min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low)
    return ArrayContainer(low) if len(low) <= ARRAY_MAX else BitmapContainer(low)


class BoundarySet:
    """Sorted offsets, given in blocks; ``select(rank)`` is the offset with ``rank`` smaller ones."""

    def __init__(self, blocks: Iterable[np.ndarray]) -> None:
        self.keys: list[int] = []
        self.containers: list[ArrayContainer | BitmapContainer | RunContainer] = []
        sizes: list[int] = []
        waiting: list[np.ndarray] = []

        def close() -> None:
            if waiting:
                low = np.concatenate(waiting)
                self.keys.append(int(low[0]) >> CONTAINER_BITS)
                self.containers.append(container(low & ((1 << CONTAINER_BITS) - 1)))
                sizes.append(len(low))
                waiting.clear()

        for block in blocks:
            if not len(block):
                continue
            high = block >> CONTAINER_BITS
            for part in np.split(block, np.flatnonzero(np.diff(high)) + 1):
                if waiting and waiting[-1][-1] >> CONTAINER_BITS != part[0] >> CONTAINER_BITS:
                    close()
                waiting.append(part)
        close()
        self.upto = np.cumsum(sizes, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.upto, rank, "right"))
        before = int(self.upto[at - 1]) if at else 0
        return (self.keys[at] << CONTAINER_BITS) + self.containers[at].select(rank - before)


def boundaries(data: np.ndarray, unit: str = "line") -> Iterator[np.ndarray]:
    """Offsets of a UTF-8 text in code points, block by block: 0, then the end of every unit."""
    yield np.zeros(1, np.int64)
    chars = 0
    for start in range(0, len(data), BLOCK_BYTES):
        part = data[start : start + BLOCK_BYTES]
        first = (part & 0xC0) != 0x80
        inside = int(np.count_nonzero(first))
        if unit == "char":
            yield np.arange(chars + 1, chars + inside + 1)
        else:
            ends = np.flatnonzero(part == 10)
            yield chars + (ends + 1 if inside == len(part) else np.cumsum(first)[ends])
        chars += inside
    if unit == "line" and len(data) and data[-1] != 10:
        yield np.array([chars])


def _distinguishable(marks: tuple[str, str, str]) -> None:
    """Marks have to be found again wherever they stand: none may hold another one or begin with the end of any."""
    for a in marks:
        for i, b in enumerate(marks):
            if not b or (a is not marks[i] and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marks {a!r} and {b!r} can't be told apart")
    if len(set(marks)) != 3:
        raise ValueError("marks have to be different")


def _number(digest: Column, group: int) -> Column:
    """The ``group``-th eight hexadecimal digits, from 0, as a number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, rebuilt from a rewritten one and its form."""
    p, s, m = marks
    at = {mark: F.instr(output, mark) for mark in marks}

    def between(mark: str, following: str | None) -> Column:
        start = at[mark] + len(mark)
        length = at[following] - start if following else F.length(output)
        return F.substr(output, start, length)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, unit: str = "line", spm_percent: int = SPM_PERCENT, rewrite_percent: int = REWRITE_PERCENT,
    salt: str = SALT, marks: tuple[str, str, str] = SENTINELS, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Rows of ``docs`` with ``fim_text``, ``form``, ``n_units``, ``prefix_chars`` and ``middle_chars`` added.

    A unit is a line with its line feed, or a code point.  Two boundaries among the n + 1 of a text are drawn from the sha256 of
    ``salt:id``; the prefix ends at the smaller, the middle at the larger.  psm is prefix, suffix, middle, each after its mark;
    spm is suffix, prefix, middle.  Texts that are empty or null, hold a mark, or are not drawn for rewriting are plain:
    ``fim_text`` is the text ('' for null) and both lengths are null.  Rows with equal id draw equal numbers, so
    repeated rows are rewritten alike; a null id counts as ''.  Input columns with the name of an added one are replaced.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    _distinguishable(marks)
    bounded_batches(docs.sparkSession)
    cut = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "a", "b")])

    @F.arrow_udf(cut)
    def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        draws = np.column_stack([first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)])
        rows = []
        for start, data, bounds in chunks(texts):
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]), start):
                known = BoundarySet(boundaries(data[a:b], unit))
                rows.append((len(known) - 1, *(known.select(int(r)) for r in sorted(draws[i] % len(known)))))
        columns = np.array(rows, np.int64).reshape(-1, 3).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["n", "a", "b"])

    body = text_of(docs, text)
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(packed(docs).alias("row"), body.alias("body"), digest.alias("digest"))
    rows = rows.withColumn("cut", cuts("body", _number(F.col("digest"), 0), _number(F.col("digest"), 1)))
    held = F.col("body") == ""
    for mark in marks:
        held = held | F.contains("body", F.lit(mark))
    plain = held | (_number(F.col("digest"), 2) % 100 >= rewrite_percent)
    spm = _number(F.col("digest"), 3) % 100 < spm_percent
    rows = rows.withColumn("form", F.when(plain, "plain").when(spm, "spm").otherwise("psm"))
    a, b = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    prefix, middle = F.substr("body", F.lit(1), a), F.substr("body", a + 1, b - a)
    suffix = F.substr("body", b + 1, F.length("body"))
    p, s, m = (F.lit(mark) for mark in marks)
    rewritten = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("body"))
    )
    cut_up = F.col("form") != "plain"
    return rows.select(*unpacked(
        "row", docs, fim_text=rewritten, form=F.col("form"), n_units=F.col("cut.n"),
        prefix_chars=F.when(cut_up, F.col("cut.a")), middle_chars=F.when(cut_up, F.col("cut.b") - F.col("cut.a")),
    ))


def fim_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the rewritten and of the rebuilt text."""
    made = fill_in_middle(docs)
    again = restored(F.col("fim_text"), F.col("form"))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


def fim_sql() -> str:
    p, s, m = SENTINELS
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SALT}:' || doc_id) AS h FROM documents),
units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS u,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
drawn AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}')
                   OR h3 % 100 >= {REWRITE_PERCENT} THEN 'plain'
              WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1 : b], ''), '') AS middle,
         coalesce(array_to_string(u[b + 1 : n], ''), '') AS suffix FROM drawn)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
                        ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts"""
