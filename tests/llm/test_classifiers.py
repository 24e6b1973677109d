import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loresmith.llm import bytesweep, langid, quality, toxicity

DATA = "/root/testdata"


def out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 3 == 1


def tables(spark, size):
    return spark.read.parquet(f"{DATA}/{size}/documents.parquet"), spark.read.parquet(f"{DATA}/{size}/labels.parquet")


@pytest.mark.parametrize("score, label, size, least", [
    (quality.score_quality, "quality", "sf0.01", 0.95),
    (toxicity.score_toxicity, "toxic", "sf0.1", 0.97),  # the smaller tables have about 30 texts to learn toxicity from
])
def test_held_out_accuracy(spark, score, label, size, least):
    docs, labels = tables(spark, size)
    got = score(docs, labels).toPandas()
    assert len(got) == docs.count() and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert (got.held_out == [out(d) for d in got.doc_id]).all() and got.score.between(0, 1).all()
    held = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert len(held) > 80 and (held.predicted == held[label]).mean() >= least


@pytest.mark.parametrize("score, label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_labels_of_held_out_ids_change_nothing(spark, score, label):
    docs, labels = tables(spark, "sf0.001")
    turned = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label))
    got, again = (score(docs, x).toPandas().sort_values("doc_id") for x in (labels, labels.withColumn(label, turned)))
    assert np.allclose(got.score, again.score)


@pytest.mark.parametrize("score, at_null", [(quality.score_quality, 0.0), (toxicity.score_toxicity, None)])
def test_odd_rows_of_both_classifiers(spark, make_docs, score, at_null):
    good = [(i, f"plain words number {i} are here") for i in range(40)]
    bad = [(100 + i, f"WORSE!! WORDS!! stand {i} here") for i in range(40)]
    odd = [(None, "plain words"), (500, None), (501, ""), (502, "  \n"), (503, "x" * 3_000_000), (0, good[0][1])]
    docs = make_docs(good + bad + odd)
    labels = [(i, int(i < 100), int(i >= 100)) for i, _ in good + bad] + [(0, None, None), (None, 1, 1), (900, 1, 1), (1, 1, 0)]
    given = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    rows = score(docs, given).collect()
    assert len(rows) == len(good + bad + odd) and all(0 <= r["score"] <= 1 for r in rows)
    if at_null is not None:
        assert {r["score"] for r in rows if r["doc_id"] in (500, 501, 502)} == {at_null}
    nothing = score(docs, given.where(F.lit(False))).collect()
    assert len(nothing) == len(rows) and len({r["score"] for r in nothing}) <= 2
    assert score(docs.where(F.lit(False)), given).count() == 0


def test_average_of_shares_is_what_scoring_adds_up():
    rng = random.Random(3)
    texts = ["", "a", "ab  cd", "Été ab ab", " ".join(rng.choice(["one", "two!!", "THREE"]) for _ in range(500))]
    weights = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32)
    whole = [float(shares @ weights[numbers]) for numbers, shares in quality.document_features(pa.array(texts))]
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for rows, data, bounds in bytesweep.pieces(pa.array(texts), quality.NOT_SPACE, 64):
        for numbers, firsts in quality.hashed_features(data, bounds):
            np.add.at(total, rows, bytesweep.row_sums(weights[numbers], firsts))
            np.add.at(count, rows, np.diff(firsts))
    assert np.allclose((total / np.maximum(count, 1))[:4], whole[:4], atol=1e-4)


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(2)
    scores, lengths = rng.normal(size=(3, 5, 3)), np.array([5, 4, 1])
    moves = rng.normal(size=(3, 3))
    got = langid.marginals(scores, lengths, moves)
    pairs = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        want, total, pair = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[c, t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, k in enumerate(path):
                want[t, k] += w
            for a, b in zip(path, path[1:]):
                pair[a, b] += w
        assert np.allclose(got[c, :n], want / total)
        pairs += pair / total
    assert np.allclose(langid.pair_marginals(scores, moves, lengths), pairs)


def test_languages(spark):
    docs, _ = tables(spark, "sf0.01")
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [out(d) for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_code_switched_and_odd_rows(spark, make_docs):
    rng = random.Random(1)
    words = {"xx": ["alpha", "berta", "gamma", "delta"], "yy": ["ëins", "zwëi", "drëi", "vïer"]}
    made = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    mixed = " ".join(rng.choice(words["xx"]) for _ in range(70)) + " " + " ".join(rng.choice(words["yy"]) for _ in range(30))
    odd = [(500, None, "xx"), (501, "", None), (502, "12 34 !!", "yy"), (503, mixed, None), (504, "ëins " * 400_000, None), (None, "alpha", "xx"),
           (505, "12 alpha 34", None)]
    docs = make_docs(made + odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert [got[i][0] for i in (500, 501, 502)] == ["und"] * 3 and got[500][1] == 0.0
    assert got[503][0] == "xx" and got[503][1] == pytest.approx(0.7, abs=0.05)
    assert got[504][0] == "yy" and got[505][0] == "xx" and got[None][0] == "xx"
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(made) + 4
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(docs.where(F.lit(False))).count() == 0


def test_a_word_repeats_only_inside_its_row():
    def again(texts):
        _, data, bounds = next(bytesweep.chunks(pa.array(texts)))
        kinds = quality.hashed_features(data, bounds)
        next(kinds)
        numbers, firsts = next(kinds)
        return [numbers[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:])]

    texts = ["a b", "b c", "", "c", "c c"]
    assert again(texts) == [[0, 0], [0, 0], [], [0], [0, 1]] and again(["b c"]) == again(["a b", "b c"])[1:]


def test_distinct_words_of_a_long_text_do_not_depend_on_pieces():
    long = "alpha beta gamma " * 40_000
    texts = pa.array(["alpha", long, "beta alpha", long + "delta", ""])
    assert bytesweep.CHUNK_BYTES < len(long)
    whole = toxicity.document_features(texts, 1 << 30)
    for limit in (64, bytesweep.CHUNK_BYTES):
        given = texts if limit > 64 else pa.array([t.as_py()[:2000] for t in texts])
        want = whole if limit > 64 else toxicity.document_features(given, 1 << 30)
        for (a, v), (b, w) in zip(toxicity.document_features(given, limit), want, strict=True):
            assert a.tolist() == b.tolist() and v.tolist() == w.tolist()
    assert toxicity.document_features(pa.array([long]))[0][1].tolist() == toxicity.document_features(pa.array([long[:17]]))[0][1].tolist()


def test_labels_are_thinned_before_they_are_exchanged(spark):
    """With automatic broadcasts off, as for a large table, no row is shuffled by its label to be thinned."""
    from loresmith.llm import learning

    known = spark.range(1000).select("id", (F.col("id") % 2).alias("label"), F.xxhash64("id").alias("h"))
    sizes = known.groupBy("label").agg(F.count("*").alias("size"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = learning._thinned(known, learning.written(sizes, "sizes"), 50)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        n = kept.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and 200 < n < 600


def test_a_text_is_one_chain(monkeypatch):
    """Stretches of a few words give what the whole chain gives at once, whatever texts lie beside it."""
    rng = np.random.default_rng(4)
    model = {"table": rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32), "lexicon": np.zeros((1 << langid.BITS, 3), np.float32),
             "lexicon_weight": 0.1, "transitions": rng.normal(size=(3, 3)) * 3}
    texts = pa.array([" ".join(f"w{rng.integers(50)}" for _ in range(n)) for n in (1, 7, 300, 64, 0, 65, 128, 1000)])
    monkeypatch.setattr(langid, "CHAIN", 10**6)
    whole = langid.shares(texts, model)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "CHAIN", size)
        assert np.allclose(langid.shares(texts, model), whole, atol=1e-9)


def numeric(loss, at, step=1e-6):
    """Central differences of a loss by every entry of an array."""
    out = np.zeros_like(at)
    for i in np.ndindex(*at.shape):
        up, down = at.copy(), at.copy()
        up[i] += step
        down[i] -= step
        out[i] = (loss(up) - loss(down)) / (2 * step)
    return out


@pytest.mark.parametrize("apart", [0.0, 6.0])
def test_risk_gradient_in_both_branches(apart):
    """Positives far on the positive side make the risk of the negatives negative."""
    rng, prior = np.random.default_rng(1), 0.3
    for _ in range(8):
        w = rng.normal(size=5)
        x_p, x_u = rng.random((7, 5)) + apart * w / np.linalg.norm(w), rng.random((11, 5)) - apart * w / np.linalg.norm(w)
        below = toxicity.risks(w, x_p, x_u, prior)[1] < 0
        assert below == (apart > 0)
        stated = (lambda v: -toxicity.risks(v, x_p, x_u, prior)[1]) if below else (lambda v: sum(toxicity.risks(v, x_p, x_u, prior)))
        assert np.allclose(toxicity.risk_gradient(w, x_p, x_u, prior), numeric(stated, w), atol=1e-7)


def test_risks_by_hand():
    w, x_p, x_u = np.array([1.0, -0.5]), np.array([[1.0, 1.0]]), np.array([[0.0, 1.0], [2.0, 1.0]])
    positive, negative = toxicity.risks(w, x_p, x_u, 0.25)
    assert np.isclose(positive, 0.25 * np.log1p(np.exp(-0.5)))
    assert np.isclose(negative, (np.log1p(np.exp(-0.5)) + np.log1p(np.exp(1.5))) / 2 - 0.25 * np.log1p(np.exp(0.5)))


def test_gradient_of_the_softmax_loss():
    rng = np.random.default_rng(2)
    for label in (0, 1):
        shares, vectors, output = rng.random(4), rng.normal(size=(4, 3)), rng.normal(size=(3, 2))

        def loss(v, o):
            logits = shares @ v @ o
            return np.log(np.exp(logits).sum()) - logits[label]

        hidden, error = quality.loss_error(shares, vectors, output, label)
        assert np.allclose(np.outer(hidden, error), numeric(lambda o: loss(vectors, o), output), atol=1e-7)
        assert np.allclose(np.outer(shares, output @ error), numeric(lambda v: loss(v, output), vectors), atol=1e-7)
