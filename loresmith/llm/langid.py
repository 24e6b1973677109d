"""Language identification with a linear-chain conditional random field over words.

Every word is labelled with a language: its features are a lexicon (how often the word stood in texts of each language),
the word itself, its beginnings and endings and the n-grams inside it; transitions between the labels of neighbours are
learned as well, on sequences spliced from runs of different languages, as in code-switched text.  Forward-backward
gives the label probabilities of each word; a document has the language with the largest expected share of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith.llm.bytesweep import LOWER, WORD_BYTES, mixed, pieces, span_hasher, word_spans
from loresmith.llm.common import bounded_batches, held_out, packed, text_of, unpacked
from loresmith.llm.learning import training_rows

PER_LANG = 600  # documents of each language that are learned from, at most
RUNS = 6  # runs of words from random places of each
RUN_WORDS = 8
SPLICED = 4  # runs per training sequence
SWITCH = 0.3  # how often the next run of a training sequence is of a random language
BITS = 17
AFFIXES = (1, 2, 3, 4)  # bytes
GRAMS = (2, 3, 4)
EPOCHS = 6
BATCH = 64
RATE = 0.05
CHAIN = 64  # words per stretch of a text's chain that is gone through at once with others
SEED = 11
UNKNOWN = "und"
MIN_SCORE = 0.5  # of a document that is kept


def _numbers(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int32)


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of words given by their spans, kind by kind: (words that have any, position of their first, numbers)."""
    hashes, length, every = span_hasher(data), ends - starts, np.arange(len(starts))
    yield every, every, _numbers(hashes(starts, ends), 0)
    for n in AFFIXES:
        having = np.flatnonzero(length >= n)
        one = np.arange(len(having))
        yield having, one, _numbers(hashes(starts[having], starts[having] + n), n)
        yield having, one, _numbers(hashes(ends[having] - n, ends[having]), 16 + n)
    for n in GRAMS:
        having = np.flatnonzero(length >= n)
        times = length[having] - n + 1
        firsts = np.cumsum(times) - times
        at = np.repeat(starts[having] - firsts, times) + np.arange(times.sum())
        yield having, firsts, _numbers(hashes(at, at + n), 32 + n)


def emissions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: dict) -> np.ndarray:
    """Score of each language for each word."""
    out = None
    for having, firsts, numbers in word_numbers(data, starts, ends):
        if out is None:  # the words themselves
            out = model["table"][numbers] + model["lexicon_weight"] * model["lexicon"][numbers]
        elif len(having):
            out[having] += np.add.reduceat(model["table"][numbers], firsts, axis=0)
    return out


def marginals(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None,
) -> np.ndarray:
    """Label probabilities by forward-backward; ``scores`` [chains, words, labels], longest chain first.

    ``before`` and ``after`` [chains, labels] are the messages into the first and the last word of stretches of longer chains.
    """
    steps = scores.shape[1]
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]  # chains with more than t words
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.zeros_like(emit), np.ones_like(emit)
    if before is not None:
        beta[np.arange(len(lengths)), lengths - 1] = after
    for t in range(steps):
        n = active[t]
        alpha[:n, t] = emit[:n, t] * (1.0 if before is None else before[:n]) if t == 0 else (alpha[:n, t - 1] @ move) * emit[:n, t]
        alpha[:n, t] /= alpha[:n, t].sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        beta[:n, t] = (emit[:n, t + 1] * beta[:n, t + 1]) @ move.T
        beta[:n, t] /= beta[:n, t].sum(axis=1, keepdims=True)
    both = alpha * beta
    total = both.sum(axis=2, keepdims=True)
    return np.divide(both, total, out=np.zeros_like(both), where=total > 0)


def messages(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, row: np.ndarray, nth: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Messages into the stretches of longer chains, from the left and from the right.

    Stretch ``nth`` of chain ``row`` turns a message from the left into u @ S, with S = E(1) M E(2) M ... M of its words'
    scores E and the transitions M, and one from the right into M S' with S' the same without the last M.  The matrices
    are made for all stretches at once, the messages go from stretch to stretch, for all chains at once.
    """
    labels, move = len(transitions), np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    through = np.repeat(np.eye(labels)[None], len(lengths), axis=0)
    for t in range(scores.shape[1]):
        n = int(np.searchsorted(-lengths, -t, "left"))
        step = through[:n] * emit[:n, t][:, None, :]
        through[:n] = (step if t == 0 else (through[:n] @ move) * emit[:n, t][:, None, :])
        through[:n] /= through[:n].sum(axis=(1, 2), keepdims=True)
    before, after = np.ones((len(lengths), labels)), np.ones((len(lengths), labels))
    last, place = int(nth.max()), np.full((row.max() + 1, nth.max() + 1), -1)
    place[row, nth] = np.arange(len(row))
    for k in range(1, last + 1):
        here = place[place[:, k] >= 0]
        sent = np.einsum("ni,nij->nj", before[here[:, k - 1]], through[here[:, k - 1]]) @ move
        before[here[:, k]] = sent / sent.sum(axis=1, keepdims=True)
    for k in range(last, 0, -1):
        here = place[place[:, k] >= 0]
        sent = np.einsum("nij,nj->ni", through[here[:, k]], after[here[:, k]]) @ move.T
        after[here[:, k - 1]] = sent / sent.sum(axis=1, keepdims=True)
    return before, after


def pair_marginals(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Expected number of each transition over all chains (for training)."""
    steps, labels = scores.shape[1:]
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.zeros_like(emit), np.ones_like(emit)
    for t in range(steps):
        alpha[:, t] = emit[:, t] if t == 0 else (alpha[:, t - 1] @ move) * emit[:, t]
        alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
    expected = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        inside = lengths > t + 1
        step = (emit[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[inside, t] = step[inside] / step[inside].sum(axis=1, keepdims=True)
        pair = alpha[inside, t, :, None] * move * (emit[inside, t + 1] * beta[inside, t + 1])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return expected


def train(runs: list[tuple[int, list[np.ndarray]]], labels: int) -> dict:
    """``runs``: (label, feature numbers of each word, the word itself first).  Weights by stochastic gradient descent."""
    rng = np.random.default_rng(SEED)
    lexicon = np.zeros((1 << BITS, labels))
    for label, words in runs:
        for numbers in words:
            lexicon[numbers[0], label] += 1
    total = lexicon.sum(axis=1, keepdims=True)
    lexicon = np.where(total >= 2, np.log((lexicon + 0.5) / (total + 0.5 * labels)) + np.log(labels), 0.0).astype(np.float32)
    table = np.zeros((1 << BITS, labels), np.float32)
    transitions, weight = np.zeros((labels, labels)), 0.1
    by_label = [[i for i, (label, _) in enumerate(runs) if label == k] for k in range(labels)]
    filled = [k for k in range(labels) if by_label[k]]
    batches = EPOCHS * max(1, len(runs) // (SPLICED * BATCH))
    for batch in range(batches):
        rate = RATE * (1 - batch / batches)
        words, owner, truth, lengths = [], [], [], np.zeros(BATCH, int)
        for b in range(BATCH):
            label = filled[rng.integers(len(filled))]
            for _ in range(SPLICED):
                if rng.random() < SWITCH:
                    label = filled[rng.integers(len(filled))]
                run = runs[by_label[label][rng.integers(len(by_label[label]))]][1]
                words += run
                truth += [label] * len(run)
                owner += [b] * len(run)
                lengths[b] += len(run)
        owner, truth = np.array(owner), np.array(truth)
        at = np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]
        sizes = np.array([len(n) for n in words])
        numbers = np.concatenate(words)
        whole = np.array([n[0] for n in words])
        score = np.add.reduceat(table[numbers], np.cumsum(sizes) - sizes, axis=0) + weight * lexicon[whole]
        scores = np.zeros((BATCH, lengths.max(), labels))
        scores[owner, at] = score
        order = np.argsort(-lengths, kind="stable")
        gamma = np.zeros_like(scores)
        gamma[order] = marginals(scores[order], lengths[order], transitions)
        error = gamma[owner, at]
        error[np.arange(len(truth)), truth] -= 1
        step = np.repeat(error * rate, sizes, axis=0)
        for k in range(labels):
            table[:, k] -= np.bincount(numbers, step[:, k], minlength=1 << BITS).astype(np.float32)
        weight -= rate * (error * lexicon[whole]).sum() / len(truth)
        observed = np.zeros((labels, labels))
        inner = owner[1:] == owner[:-1]
        np.add.at(observed, (truth[:-1][inner], truth[1:][inner]), 1)
        transitions -= 4 * rate * (pair_marginals(scores, transitions, lengths) - observed) / BATCH
    return {"table": table, "lexicon": lexicon, "lexicon_weight": weight, "transitions": transitions}


def language_model(docs: DataFrame, text: str, doc_id: str, lang: str, per_lang: int) -> tuple[list[str], dict | None]:
    """Languages in order and the learned weights; the sample is bounded by the number of languages."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("label"))
    rows = training_rows(docs, known, per_lang, text, doc_id).withColumn("h", F.xxhash64("text"))

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lists = [], []
            for i, (body, h) in enumerate(zip(batch.column("text").to_pylist(), batch.column("h").to_pylist())):
                rng = np.random.default_rng(h % (1 << 63))
                found = []
                for _, data, bounds in pieces(pa.array([body], pa.large_string()), WORD_BYTES):
                    data = LOWER[data]
                    starts, ends = word_spans(data, bounds, WORD_BYTES)
                    for _ in range(RUNS if len(starts) else 0):
                        a = int(rng.integers(max(1, len(starts) - RUN_WORDS + 1)))
                        s, e = starts[a : a + RUN_WORDS], ends[a : a + RUN_WORDS]
                        words = [[] for _ in s]
                        for having, firsts, numbers in word_numbers(data, s, e):
                            for w, part in zip(having, np.split(numbers, firsts[1:])):
                                words[w].extend(part.tolist())
                        found.append(words)
                picked = rng.permutation(len(found))[:RUNS]
                lists += [found[k] for k in picked]
                kept += [i] * len(picked)
            label = batch.column("label").take(pa.array(kept, pa.int64()))
            h = batch.column("h").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [label, h, pa.array(lists, pa.list_(pa.list_(pa.int32())))], names=["label", "h", "words"])

    schema = T.StructType([
        rows.schema["label"], T.StructField("h", T.LongType()),
        T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType())))])
    table = rows.mapInArrow(runs_of, schema).toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    langs = sorted(set(table.column("label").to_pylist()))
    if not langs:
        return [], None
    runs = []
    for batch in table.to_batches():
        for label, words in zip(batch.column("label").to_pylist(), batch.column("words")):
            runs.append((langs.index(label), [w.values.to_numpy() for w in words]))
    return langs, train(runs, len(langs))


def shares(texts: pa.Array, model: dict) -> np.ndarray:
    """Expected share of each language among the words of each text; zeros without words.

    A text is one chain, gone through in stretches; only a text of more than ``CHUNK_BYTES`` is cut, at that many bytes.
    """
    labels = len(model["transitions"])
    total, count = np.zeros((len(texts), labels)), np.zeros(len(texts))
    for rows, data, bounds in pieces(texts, WORD_BYTES):
        data = LOWER[data]
        starts, ends = word_spans(data, bounds, WORD_BYTES)
        if not len(starts):
            continue
        firsts = np.searchsorted(starts, bounds)
        # Every different word is scored once.
        _, example, which = np.unique(span_hasher(data)(starts, ends), return_index=True, return_inverse=True)
        scores = emissions(data, starts[example], ends[example], model)
        sizes = np.diff(firsts)
        chains = -(-sizes // CHAIN)
        row = np.repeat(np.arange(len(sizes)), chains)
        nth = np.arange(chains.sum()) - np.repeat(np.cumsum(chains) - chains, chains)
        begin = firsts[:-1][row] + nth * CHAIN
        lengths = np.minimum(CHAIN, firsts[1:][row] - begin)
        order = np.argsort(-lengths, kind="stable")
        row, begin, lengths, nth = row[order], begin[order], lengths[order], nth[order]
        at = begin[:, None] + np.arange(lengths[0])
        inside = np.arange(lengths[0]) < lengths[:, None]
        chained = np.where(inside[:, :, None], scores[which[np.where(inside, at, 0)]], 0.0)
        ends = messages(chained, lengths, model["transitions"], row, nth) if nth.any() else (None, None)
        found = marginals(chained, lengths, model["transitions"], *ends)
        np.add.at(total, rows[row], (found * inside[:, :, None]).sum(axis=1))
        np.add.at(count, rows, sizes)
    return total / np.maximum(count, 1)[:, None]


def predictor(docs: DataFrame, text: str, doc_id: str, lang: str, per_lang: int) -> Callable[[Column], Column]:
    """Function from a text column without nulls to the struct (lang, score)."""
    bounded_batches(docs.sparkSession)
    langs, model = language_model(docs, text, doc_id, lang, per_lang)
    sent = docs.sparkSession.sparkContext.broadcast((langs, model))
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def label(texts: pa.Array) -> pa.Array:
        names, weights = sent.value
        if weights is None:
            return pa.StructArray.from_arrays(
                [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))], names=["lang", "score"])
        found = shares(texts, weights)
        best = found.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array([names[b] for b in best], pa.string()), pa.array(np.minimum(1.0, found[np.arange(len(best)), best]))],
            names=["lang", "score"])

    def judge(body: Column) -> Column:
        nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        return F.when(body.rlike(r"\p{L}"), label(body)).otherwise(nothing)

    return judge


def identify(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_lang: int = PER_LANG
) -> DataFrame:
    """(doc id, held_out, lang_pred, score) for every row of ``docs``.

    Learns from at most ``per_lang`` documents of each non-null language, never from held-out ids (crc32 modulo 3 is 1).
    The prediction reads the text alone: a learned language, or ``und`` with score 0 where the text is null or has no
    letter, or where nothing could be learned.  The score is the expected share of the language among the words, 0 to 1;
    ties go to the first language by name.  Rows equal in text are judged alike.  Empty input gives an empty result.
    """
    judge = predictor(docs, text, doc_id, lang, per_lang)
    judged = docs.select(F.col(doc_id).alias("id"), judge(text_of(docs, text)).alias("found"))
    return judged.select(
        F.col("id").alias(doc_id), held_out(F.col("id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


def with_language(
    docs: DataFrame, min_score: float = MIN_SCORE, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
    per_lang: int = PER_LANG,
) -> DataFrame:
    """Rows of ``docs`` whose language is found with ``min_score`` or more; columns stay as they are."""
    judge = predictor(docs, text, doc_id, lang, per_lang)
    # The text stands once in a row on its way past Python: inside the packed row.
    rows = docs.select(packed(docs).alias("row"))
    judged = rows.select("row", judge(F.coalesce(F.col("row")[text].cast("string"), F.lit(""))).alias("found"))
    kept = judged.where((F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= min_score))
    return kept.select(*unpacked("row", docs))
