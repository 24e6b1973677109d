import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loresmith.llm import periods


def smallest_period(words):
    """By the failure function of the stretch."""
    fail, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fail[k - 1]
        k += words[i] == words[k]
        fail[i] = k
    return len(words) - fail[-1]


def brute_runs(words, least=12):
    """Stretch by stretch: for every period the longest stretches that keep it, if it is their smallest."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(least, 2 * q) and smallest_period(words[start : start + length]) == q:
                found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    letters = [f"w{i}" for i in range(rng.choice([1, 2, 2, 3, 4, 30]))]
    words = []
    for _ in range(rng.randrange(1, 6)):
        piece = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        words += piece * rng.choice([1, 1, 2, 3, 7]) + piece[: rng.randrange(0, len(piece) + 1)]
    return words


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_against_every_stretch():
    rng = random.Random(5)
    cases = [random_words(rng) for _ in range(600)] + [fibonacci(400), ["x"] * 300, ["x"] * 11, ["x"] * 12, [], ["one"]]
    cases += [[rng.choice("ab") for _ in range(rng.randrange(2, 300))] for _ in range(60)]
    for words in cases:
        for least in (2, 5, 12):
            numbers = periods.word_numbers([w.encode() for w in words])
            assert periods.runs_of(numbers, least) == brute_runs(words, least), (words, least)
            if brute_runs(words, least):
                assert periods.may_repeat([w.encode() for w in words], (least + 1) // 2)


def test_suffix_order():
    rng = random.Random(6)
    for _ in range(100):
        words = [rng.randrange(3) for _ in range(rng.randrange(2, 60))]
        order, common = periods.suffix_order(np.array(words))
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        for k in range(1, len(words)):
            a, b = words[order[k - 1] :], words[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == same


def test_many_places_with_different_left_words():
    """A form repeated thousands of times: every place has a class of its own."""
    words = []
    for i in range(3000):
        words += [f"n{i}", "a", "b", "c", "d", "e", "f", "g"]
    assert periods.runs_of(periods.word_numbers([w.encode() for w in words])) == []


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def spoken(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = spoken(doc_id, text)
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(brute_collapsed(words, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op13_periods"](spark, sf)
    assert got.columns == COLUMNS
    want = sorted(expected(r["doc_id"], r["text"]) for r in docs)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(1 for w in want if w[1]) > 10


def test_odd_rows(spark, make_docs):
    rng = random.Random(7)
    rows = [(i, " ".join(random_words(rng))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "x " * 2_000), (None, "x " * 30), (204, "é ß y " * 9),
             (203, "x " * 2_000), (205, " a b " * 8), (206, "a\x1cb " * 14), (207, "a\x0b\x0cb " * 7)]
    docs = make_docs(rows).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1))
    got = periods.run_digests(docs).collect()
    order = lambda r: (r[0] is not None, *(str(x) for x in r))
    assert sorted((tuple(r) for r in got), key=order) == sorted((expected(*r) for r in rows), key=order)
    made = periods.find_runs(docs)
    assert made.columns == docs.columns
    row = made.where("doc_id = 201").first()
    assert row["runs"] == [] and row["collapsed"] == "" and row["row"] == "extra"
    assert periods.find_runs(docs.where(F.lit(False))).count() == 0


def test_shorter_runs(spark, make_docs):
    got = periods.find_runs(make_docs([(1, "go go stop a b a b")]), min_words=2).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 2, 1), (3, 4, 2)] and got["collapsed"] == "go stop a b"
