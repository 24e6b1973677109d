"""Quality classifier on supervised subword embeddings.

Words and the character n-grams inside them are hashed to learned vectors; a document is the average of its vectors, a
softmax over the labels reads it.  All weights are learned by stochastic gradient descent in numpy on a bounded sample.
The average and the output layer are linear, so scoring needs one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.bytesweep import byte_class, pieces, row_sums, span_hashes, word_spans
from loresmith.llm.common import bounded_batches, held_out, text_of
from loresmith.llm.learning import gathered, sigmoid, training_rows

PER_LABEL = 1500  # labelled documents of each label that are learned from, at most
BITS = 17
GRAMS = (3, 4, 5)
DIMENSIONS = 16
EPOCHS = 8
RATE = 0.2
SEED = 1
THRESHOLD = 0.5
NOT_SPACE = byte_class(lambda b: b > 32)
STEP = 0x01000193
SPREAD = np.uint32(0x9E3779B1)


def hashed_features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of words, repeats and n-grams (by bytes, case kept) and each row's first position, kind by kind.

    An n-gram may take in the blank before or after its word.
    """
    starts, ends = word_spans(data, bounds, NOT_SPACE)
    words = span_hashes(data, starts, ends)
    yield (words >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(starts, bounds)
    # Whether a word repeats the one before it, whatever the word.
    if len(words):
        again, firsts = np.concatenate(([0], (words[1:] == words[:-1]).astype(np.int32))), np.searchsorted(starts, bounds)
        again[firsts[:-1][np.diff(firsts) > 0]] = 0  # a row's first word has none before it
        yield again, firsts
    # One blank around every row, so that the first and the last word have edges too.
    rows = len(bounds) - 1
    spaced = np.full(len(data) + rows + 1, 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(bounds))] = data
    edges = bounds + np.arange(rows + 1)  # a row begins at the blank before it
    solid = NOT_SPACE[spaced]
    values = np.where(solid, spaced, np.uint8(32)).astype(np.uint32)
    total, factor = values.copy(), 1
    blanks = np.concatenate(([0], np.cumsum(~solid)))
    for n in range(2, max(GRAMS) + 1):
        if len(spaced) < n:
            return
        factor = factor * STEP & 0xFFFFFFFF
        total = total[: len(spaced) - n + 1] + values[n - 1 :] * np.uint32(factor)
        if n not in GRAMS:
            continue
        # No blank inside, and not one at both ends.
        inner = blanks[n - 1 : -1] - blanks[1 : len(spaced) - n + 2]
        good = (inner == 0) & (solid[: len(total)] | solid[n - 1 :])
        numbers = ((total + np.uint32(n)) * SPREAD)[good] >> np.uint32(32 - BITS)
        yield numbers.astype(np.int32), np.searchsorted(np.flatnonzero(good), edges)


def document_features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct feature numbers and their shares."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for rows, data, bounds in pieces(texts, NOT_SPACE):
        for numbers, firsts in hashed_features(data, bounds):
            for row, a, b in zip(rows, firsts[:-1], firsts[1:]):
                parts[row].append(numbers[a:b])
    out = []
    for each in parts:
        numbers, times = np.unique(np.concatenate(each or [np.zeros(0, np.int32)]), return_counts=True)
        out.append((numbers, (times / max(1, times.sum())).astype(np.float32)))
    return out


def loss_error(shares: np.ndarray, vectors: np.ndarray, output: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    """Average vector of a document, and the gradient of its softmax loss by the logits.

    By the output layer the gradient is the outer product of both, by a feature's vector its share times output @ error.
    """
    hidden = shares @ vectors
    logits = hidden @ output
    p = np.exp(logits - logits.max())
    p /= p.sum()
    p[label] -= 1
    return hidden, p


def train(labels: list[int], features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Learn vectors and output layer; returns for each feature what it adds to the log-odds of label 1.

    Documents are visited in random order with a falling rate; each label weighs the same in all.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((DIMENSIONS, 2), np.float32)
    ones = sum(labels)
    if not ones or ones == len(labels):
        return np.zeros(1 << BITS, np.float32)
    weight = {1: len(labels) / (2 * ones), 0: len(labels) / (2 * (len(labels) - ones))}
    steps = EPOCHS * len(labels)
    for step in range(steps):
        if step % len(labels) == 0:
            order = rng.permutation(len(labels))
        i = order[step % len(labels)]
        numbers, shares = features[i]
        if not len(numbers):
            continue
        hidden, error = loss_error(shares, vectors[numbers], output, labels[i])
        error *= np.float32(min(4.0, weight[labels[i]]) * RATE * (1 - step / steps))
        back = output @ error
        output -= np.outer(hidden, error)
        # Normalized, so that the average moves by one step of the rate however long the text is.
        vectors[numbers] -= np.outer(shares / (shares @ shares), back)
    return vectors @ (output[:, 1] - output[:, 0])


def quality_model(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, per_label: int) -> np.ndarray:
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    return train(*gathered(training_rows(docs, known, per_label, text, doc_id), document_features))


def score_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    per_label: int = PER_LABEL,
) -> DataFrame:
    """(doc id, held_out, score, predicted) for every row of ``docs``.

    Learns from at most ``per_label`` labelled documents of each label, never from ids whose crc32 modulo 3 is 1
    (``held_out``).  The score uses the text alone: 0 to 1, higher if label 1 is likelier; ``predicted`` is 1 from 0.5 on.
    Null, empty and blank texts score 0; without training rows of both labels every other text scores 0.5.  Rows equal in
    text score the same.  Other columns are not read; empty input gives an empty result.
    """
    weights = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels, text, doc_id, label, per_label))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for rows, data, bounds in pieces(texts, NOT_SPACE):
            for numbers, firsts in hashed_features(data, bounds):
                np.add.at(total, rows, row_sums(weights.value[numbers], firsts))
                np.add.at(count, rows, np.diff(firsts))
        return pa.array(np.where(count > 0, sigmoid(total / np.maximum(count, 1)), 0.0))

    scored = docs.select(F.col(doc_id).alias("id"), score(text_of(docs, text)).alias("score"))
    return scored.select(
        F.col("id").alias(doc_id), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
