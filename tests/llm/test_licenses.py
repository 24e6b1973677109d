import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresmith.llm import licenses


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w, places = words(text), []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def longest_runs(sequences, text):
    """Matching statistics by trying all lengths."""
    out = []
    for i in range(1, len(text) + 1):
        out.append(max(k for k in range(i + 1) if any(
            text[i - k : i] == s[j : j + k] for s in sequences for j in range(len(s) - k + 1)) or k == 0))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_matching_statistics_and_ends(seed):
    rng = random.Random(seed)
    sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
    text = [rng.randrange(5) for _ in range(60)]
    auto = licenses.Automaton(sequences)
    got = list(auto.stream(text))
    assert [n for _, n in got] == longest_runs(sequences, text)
    for i, (state, n) in enumerate(got, 1):
        run = text[i - n : i]
        where = {(k, j + n) for k, s in enumerate(sequences) for j in range(len(s) - n + 1) if s[j : j + n] == run}
        assert n == 0 or where == set(auto.ends[state])
        ending = sorted(k for k in auto.whole[state] if len(sequences[k]) <= n)
        assert ending == sorted(k for k, s in enumerate(sequences) if text[max(0, i - len(s)) : i] == s)


def test_base_columns_against_brute_force(spark, make_docs):
    rng = random.Random(1)
    parts = ["all rights reserved", "ALL Rights", "reserved", "cc-by", "CC BY cc by", "by", "GNU General Public License", "general public",
             "license", "été", "the", "Licensed under the", "MIT License", "4.0", "\n", "word"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", " .,", "cc by", "all rights reserved " * 50_000, "cc BY É"]
    got = licenses.scan_licenses(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute(text)
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


def test_templates_are_found_through_small_changes(spark, make_docs):
    mit = licenses.TEMPLATES[0][1]
    changed = mit.replace("free of charge", "wholly free of any charge")
    texts = [f"before {mit} after", changed, mit[: len(mit) // 3], "Released under the MIT license.", "nothing here",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    got = licenses.scan_licenses(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "mit", "", "mit", "", "gpl", "cc-by,cc-by-nc"]
    assert got[0]["score"] == 1.0 and 0.75 <= got[1]["score"] < 1 and got[4]["score"] == 0.0
    assert licenses.scan_licenses(make_docs([(1, "x")]).where(F.lit(False))).count() == 0


def test_runs_hold_every_match_of_two_words():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES)
    numbers = np.array([0, *scanner.sequences[0][:4], 0, 0, *scanner.sequences[-1]])
    assert scanner.runs(numbers) == [(1, 5), (7, 10)]


def test_phrases_of_one_word(spark, make_docs):
    texts = ["mit", "under MIT terms", "mit mit", "permit", "Released under the MIT License", ""]
    got = licenses.scan_licenses(make_docs(list(enumerate(texts))), phrases={"mit": "mit"}).orderBy("doc_id").collect()
    assert [(r["n_base"], r["first_word"], r["last_word"]) for r in got] == [
        (1, 0, 0), (1, 1, 1), (2, 0, 1), (0, None, None), (1, 3, 3), (0, None, None)]
    assert [r["base_labels"] for r in got] == ["mit", "mit", "mit", "", "mit", ""]
