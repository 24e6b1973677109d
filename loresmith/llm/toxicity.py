"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers on hashed words and beginnings of words are trained from texts confirmed as toxic and from unlabelled texts.  With class prior p,
the risk is ``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))``: unlabelled texts stand for the negatives
after the share of positives among them is taken out, and a negative estimate is not followed but undone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.bytesweep import BASE, CHUNK_BYTES, LOWER, WORD_BYTES, mixed, pieces, span_hashes, word_spans
from loresmith.llm.common import bounded_batches, held_out, text_of
from loresmith.llm.learning import gathered, sigmoid, training_rows

POSITIVES = 2000  # confirmed texts that are learned from, at most
UNLABELLED = 6000  # and unlabelled texts, at most
BITS = 18
CLASSIFIERS = 3  # trained from different orders and averaged
EPOCHS = 60
BATCH = 256
RATE = 0.2
DECAY = 1e-4
MIN_POSITIVES = 5  # a feature is learned if so many confirmed texts hold it
MIN_LIFT = 1.5  # and they hold it so many times as often as unlabelled ones
LEARNED = 3000  # the features of highest gain, at most
BEGINNINGS = range(3, 10)  # bytes
THRESHOLD = 0.7
SEED = 7


def word_features(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature number) of every distinct word of a text, whole and by its beginnings, A-Z lower-cased."""
    last, seen = -1, np.zeros(0, np.uint64)  # the row whose pieces are coming and its words so far
    for rows, data, bounds in pieces(texts, WORD_BYTES, limit):
        data = LOWER[data]
        starts, ends = word_spans(data, bounds, WORD_BYTES)
        at = np.repeat(rows, np.diff(np.searchsorted(starts, bounds)))
        words = span_hashes(data, starts, ends)
        keys, first = np.unique(mixed(words + at.astype(np.uint64) * BASE), return_index=True)
        if len(rows) == 1:  # only such a piece can be a part of its row
            if rows[0] != last:
                last, seen = rows[0], np.zeros(0, np.uint64)
            new = ~np.isin(keys, seen)
            first, seen = first[new], np.concatenate([seen, keys[new]])
        starts, ends, at, words = starts[first], ends[first], at[first], words[first]
        yield at, (words >> np.uint64(64 - BITS)).astype(np.int64)
        for n in BEGINNINGS:
            longer = ends - starts > n
            starts, ends, at = starts[longer], ends[longer], at[longer]
            begun = mixed(span_hashes(data, starts, starts + n) + np.uint64(n))
            yield at, (begun >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, feature numbers and values: the logarithm of one more than the number of distinct words."""
    codes, times = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
    return codes >> BITS, codes & ((1 << BITS) - 1), np.log1p(times).astype(np.float32)


def document_features(texts: pa.Array, limit: int = CHUNK_BYTES) -> list[tuple[np.ndarray, np.ndarray]]:
    rows, numbers, values = _counted([at << BITS | n for at, n in word_features(texts, limit)])
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [(numbers[a:b].astype(np.int32), values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


Features = list[tuple[np.ndarray, np.ndarray]]


def _dense(features: Features, learned: np.ndarray) -> np.ndarray:
    """Matrix of the texts over the learned features, with a last column of ones."""
    place = np.full(1 << BITS, -1)
    place[learned] = np.arange(len(learned))
    out = np.zeros((len(features), len(learned) + 1), np.float32)
    out[:, -1] = 1
    for i, (numbers, values) in enumerate(features):
        at = place[numbers]
        out[i, at[at >= 0]] = values[at >= 0]
    return out


def risks(w: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk of the positives, and that of the negatives: of all unlabelled texts less the positives' share among them.

    Logistic loss: a positive costs log(1 + exp(-z)), a negative log(1 + exp(z)).
    """
    z_p, z_u = x_p @ w, x_u @ w
    return prior * np.logaddexp(0, -z_p).mean(), np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()


def risk_gradient(w: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the sum of both risks; where that of the negatives is below zero, of its opposite alone, to undo overfitting."""
    s_p, s_u = sigmoid(x_p @ w).astype(w.dtype), sigmoid(x_u @ w).astype(w.dtype)
    g_positive = prior * ((s_p - 1) @ x_p) / len(x_p)
    g_negative = s_u @ x_u / len(x_u) - prior * (s_p @ x_p) / len(x_p)
    return g_positive + g_negative if risks(w, x_p, x_u, prior)[1] >= 0 else -g_negative


def train(positives: Features, unlabelled: Features, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Learned features and their weights, the last of which is the constant."""
    held = [np.bincount(np.concatenate([n for n, _ in x]), minlength=1 << BITS) / len(x) for x in (positives, unlabelled)]
    lift = held[0] / (held[1] + 1 / len(unlabelled))
    gain = held[0] * np.log(np.maximum(lift, 1e-9))
    able = np.flatnonzero((held[0] * len(positives) >= MIN_POSITIVES) & (lift >= MIN_LIFT))
    learned = np.sort(able[np.argsort(-gain[able], kind="stable")][:LEARNED])
    p, u = _dense(positives, learned), _dense(unlabelled, learned)
    rng, models = np.random.default_rng(SEED), []
    for _ in range(CLASSIFIERS):
        w = np.zeros(p.shape[1], np.float32)
        m, v, t = np.zeros_like(w), np.zeros_like(w), 0
        w[-1] = np.log(prior / (1 - prior))
        late = np.zeros(len(w))
        for epoch in range(EPOCHS):
            order = rng.permutation(len(u))
            for a in range(0, len(u), BATCH):
                x_u = u[order[a : a + BATCH]]
                x_p = p[rng.integers(0, len(p), BATCH)]
                grad = risk_gradient(w, x_p, x_u, prior) + DECAY * w
                t += 1
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                w = (w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            if epoch >= EPOCHS // 2:
                late += w
        models.append(late / (EPOCHS - EPOCHS // 2))  # averaged over the second half of the epochs
    return learned, np.mean(models, axis=0)


def toxicity_model(
    docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, positives: int, unlabelled: int, prior: float | None
) -> np.ndarray:
    """Weight of each hashed word, with the constant at the end."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where("label IN (0, 1) AND id IS NOT NULL").where(~held_out(F.col("id")))
    if prior is None:
        prior = known.agg(F.avg("label")).first()[0]
    everything = docs.select(F.col(doc_id).alias("id"), F.lit(0).alias("label"))
    chosen = [
        training_rows(docs, known.where("label = 1"), positives, text, doc_id),
        training_rows(docs, everything, unlabelled, text, doc_id),
    ]
    p, u = (gathered(rows, document_features)[1] for rows in chosen)
    weights = np.zeros((1 << BITS) + 1, np.float32)
    if p and u and 0 < prior < 1:
        learned, values = train(p, u, prior)
        weights[learned], weights[-1] = values[:-1], values[-1]
    else:
        weights[-1] = -np.inf
    return weights


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None,
) -> DataFrame:
    """(doc id, held_out, score, predicted) for every row of ``docs``.

    Learns from at most ``positives`` texts labelled 1 and at most ``unlabelled`` texts whose labels are not looked at,
    none of them held out (crc32 of the id modulo 3 is 1).  ``prior`` is the share of toxic texts; by default that of the
    labels that may be learned from.  The score uses the distinct words of the whole text, 0 to 1; ``predicted`` is 1 from
    0.7 on.  Null, empty and wordless texts score as a text without any learned word; without positives all score 0.
    Rows equal in text score the same.  Other columns are not read; empty input gives an empty result.
    """
    weights = docs.sparkSession.sparkContext.broadcast(
        toxicity_model(docs, labels, text, doc_id, label, positives, unlabelled, prior))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        table = weights.value
        rows, numbers, values = _counted([at[k] << BITS | n[k] for at, n in word_features(texts) for k in [table[n] != 0]])
        total = np.bincount(rows, table[numbers] * values, minlength=len(texts)) + table[-1]
        return pa.array(sigmoid(total))

    scored = docs.select(F.col(doc_id).alias("id"), score(text_of(docs, text)).alias("score"))
    return scored.select(
        F.col("id").alias(doc_id), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
