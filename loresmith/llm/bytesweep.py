"""Whole batches of texts as one byte array: word boundaries and hashes by numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_class(chosen) -> np.ndarray:
    """Table of 256 booleans from a predicate on byte values."""
    return np.array([bool(chosen(b)) for b in range(256)])


#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, letters, everything beyond ASCII.
WORD_BYTES = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: (first row, bytes, row bounds in them).  Null texts are empty."""
    wide = pa.types.is_large_string(texts.type)
    buffers, n = texts.buffers(), len(texts)
    if not n:
        return
    bounds = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_valid()), np.diff(bounds), 0)
        if lengths.sum() != bounds[-1] - bounds[0]:  # bytes beneath nulls
            yield from chunks(pa.array([t or "" for t in texts.to_pylist()], pa.large_string()), limit)
            return
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a row bound always ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside, cut = is_word[data], np.zeros(n + 1, bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function of starts and ends: 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return lambda starts, ends: mixed((sums[ends] - sums[starts]) * inverses[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(data)(starts, ends)


def _blocks(data: np.ndarray, is_word: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut a long array at bytes outside words into blocks of about ``limit`` bytes."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + limit)
        while end < n and is_word[data[end - 1]]:
            stop = np.flatnonzero(~is_word[data[end : end + 65536]])
            end = min(n, end + (int(stop[0]) + 1 if len(stop) else 65536))
        yield start, end
        start = end


def word_hashes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each row, the position of its first word (with the total at the end).

    Only 8 bytes per word stay; a very long row is swept in blocks.
    """
    hashes, firsts = [], []
    for start, end in _blocks(data, is_word, CHUNK_BYTES):
        inner = bounds[(bounds > start) & (bounds < end)] - start
        begins, ends = word_spans(data[start:end], np.concatenate(([0], inner, [end - start])), is_word)
        hashes.append(span_hashes(data[start:end], begins, ends))
        firsts.append(begins + start)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), bounds)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a row, and the row of each."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = words[:n].copy()
    for k in range(1, width):
        total = total * BASE + words[k : k + n]
    rows = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    whole = rows[:n] == rows[width - 1 :]
    return mixed(total[whole] + np.uint64(width)), rows[:n][whole]


def pieces(texts: pa.Array, is_word: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``chunks``, but a row of more than ``limit`` bytes comes in parts that end outside words: (rows, bytes, bounds).

    For sums over words, which may be added up part by part.
    """
    for first, data, bounds in chunks(texts, limit):
        if len(data) <= limit:
            yield np.arange(first, first + len(bounds) - 1), data, bounds
            continue
        for start, end in _blocks(data, is_word, limit):
            yield np.array([first]), data[start:end], np.array([0, end - start])


def row_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (along the first axis) for each row, rows given by the position of their first value."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]
