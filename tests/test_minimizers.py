import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loresmith.functions import minimizers as winnow
from loresmith.operators import containment


def hashes(text, width, window):
    got = [h for _, kept in winnow.kept_hashes(pa.array([text], pa.string()), width, window) for h in kept.tolist()]
    return set(got)


def test_minima_against_brute_force():
    values = np.random.default_rng(1).integers(0, 50, 200)
    for window in (1, 2, 3, 5, 8, 13, 16):
        want = [min(values[i : i + window]) for i in range(len(values) - window + 1)]
        assert winnow.window_minima(values, window).tolist() == want


def test_equal_runs_have_equal_hashes():
    points = np.frombuffer("abcdefgh가나다라abcdefgh🙂".encode("utf-32-le"), dtype=np.uint32)
    h = winnow.run_hashes(points, 8)
    assert h[0] == h[12] and len(set(h.tolist())) == len(h) - 1


def test_text_keeps_all_hashes_of_a_passage(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab 가🙂\n") for _ in range(3000))
    for piece in (1 << 20, 64):  # whole, and in overlapping pieces
        monkeypatch.setattr(winnow, "PIECE", piece)
        for width, window in containment.LEVELS:
            whole = hashes(text, width, window)
            for _ in range(60):
                start, size = rng.randrange(2900), rng.randint(width + window - 1, 90)
                passage = text[start : start + size]
                if len(passage) >= width + window - 1:
                    kept = hashes(passage, width, window)
                    assert kept and kept <= whole


def test_texts_do_not_run_into_each_other():
    rows = [(r, h) for row, kept in winnow.kept_hashes(pa.array(["x" * 20 + "abc", None, "", "yz" * 9]), 8, 5) for r, h in zip(row, kept)]
    assert {h for r, h in rows if r == 0} == hashes("x" * 20 + "abc", 8, 5)
    assert {h for r, h in rows if r == 3} == hashes("yz" * 9, 8, 5)
    assert {r for r, _ in rows} == {0, 3}


def test_passages_of_stop_words_and_of_every_length(spark):
    rng = random.Random(9)
    stop = "of the and to in a is it that was 그리고 또한".split()
    texts = [(i, " ".join(rng.choice(stop) for _ in range(rng.randint(1, 120)))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, texts[0][1]), (303, "\n".join(["line of the"] * 400))]
    whole = [t for _, t in texts if t]
    passages = [(-1, ""), (-2, None), (-3, "nowhere at all, in no text whatever is this"), (-4, "line of the\n" * 20)]
    for n in range(200):
        text = rng.choice(whole)
        start = rng.randrange(len(text))
        passages.append((n, text[start : start + rng.choice([1, 3, 11, 12, 13, 30, 31, 32, 100, 400])]))
    p = spark.createDataFrame(passages, "passage_id long, passage string")
    t = spark.createDataFrame(texts, "text_id long, text string").repartition(5)
    want = {(i, j) for i, x in passages if x for j, y in texts if y is not None and x in y}
    assert {tuple(r) for r in containment.containing_pairs(p, t).collect()} == want
    long = p.where(F.length("passage") >= 31)
    candidates = containment.candidate_pairs(long, t).count()
    true = len([1 for i, _ in want if len(dict(passages)[i]) >= 31])
    assert candidates < 1.3 * true  # the words themselves are in nearly every text


def test_empty_tables(spark):
    p, t = spark.createDataFrame([], "passage_id long, passage string"), spark.createDataFrame([], "text_id string, text string")
    some = spark.createDataFrame([(1, "a passage that is long enough for a window")], "passage_id long, passage string")
    assert containment.containing_pairs(p, t).count() == 0 and containment.containing_pairs(some, t).count() == 0
    assert containment.containing_pairs(p, spark.createDataFrame([("a", "b")], "text_id string, text string")).count() == 0
