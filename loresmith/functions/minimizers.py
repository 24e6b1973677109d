"""Winnowed rolling hashes: of every ``window`` consecutive letter runs of ``width`` code points the smallest hash is kept.

A passage of ``width + window - 1`` code points or more has a window of its own, and the text around it has the very same
window, so a text that holds the passage keeps every hash that the passage keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20  # code points worked on at once; longer texts go in overlapping pieces
BASE = 0x9E3779B97F4A7C15  # odd, so that every letter of a run counts


def run_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` letters, for a width that is a power of two: runs of twice the length from two halves."""
    hashes, base, length = points.astype(np.uint64), BASE, 1
    while length < width:
        hashes = hashes[:-length] * np.uint64(base) + hashes[length:]
        base, length = base * base % (1 << 64), 2 * length
    hashes ^= hashes >> np.uint64(33)
    hashes *= np.uint64(0xFF51AFD7ED558CCD)
    return hashes ^ (hashes >> np.uint64(33))


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Smallest of every ``window`` consecutive values, from two overlapping windows of a power of two."""
    length = 1
    while 2 * length <= window:
        values, length = np.minimum(values[:-length], values[length:]), 2 * length
    rest = window - length
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _pieces(texts: pa.Array, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    for row in range(len(texts)):
        text = texts[row].as_py()
        if text is None:
            continue
        for start in range(0, max(1, len(text) - overlap), PIECE):
            yield row, np.frombuffer(text[start : start + PIECE + overlap].encode("utf-32-le"), dtype=np.uint32)


def _packs(texts: pa.Array, overlap: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    rows, pieces, size = [], [], 0
    for row, piece in _pieces(texts, overlap):
        rows.append(row)
        pieces.append(piece)
        size += len(piece)
        if size >= PIECE:
            yield rows, pieces
            rows, pieces, size = [], [], 0
    if rows:
        yield rows, pieces


def kept_hashes(texts: pa.Array, width: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, hashes) of the texts in packs of bounded size; a row's hash occurs once in a pack."""
    span = width + window - 1
    for rows, pieces in _packs(texts, span - 1):
        points = np.concatenate(pieces)
        if len(points) < span:
            continue
        minima = window_minima(run_hashes(points, width), window)
        lengths = np.array([len(p) for p in pieces])
        piece = np.repeat(np.arange(len(pieces)), lengths)[: len(minima)]
        inside = np.arange(len(minima)) + span <= np.cumsum(lengths)[piece]  # windows that cross into the next text are none
        row, kept = np.array(rows)[piece[inside]], minima[inside]
        order = np.lexsort((kept, row))
        row, kept = row[order], kept[order]
        fresh = np.ones(len(kept), dtype=bool)
        fresh[1:] = (kept[1:] != kept[:-1]) | (row[1:] != row[:-1])
        yield row[fresh], kept[fresh].view(np.int64)


def minimizers(df: DataFrame, key: str, text: str, width: int, window: int) -> DataFrame:
    """(key, hash): the winnowed hashes of every text.  Shorter texts and nulls have none; a hash may come more than once."""
    if width & (width - 1) or width < 1 or window < 1:
        raise ValueError("width has to be a power of two, window at least 1")
    slim = df.select(F.col(key), F.col(text).alias("text"))

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            keys = record.column(0)
            for row, kept in kept_hashes(record.column(1), width, window):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(kept)], names=[key, "hash"])

    schema = slim.drop("text").schema.add("hash", "long")
    return slim.mapInArrow(run, schema)
