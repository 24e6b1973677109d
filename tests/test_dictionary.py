import random

import pytest
from pyspark.sql import functions as F

from loresmith import vocab
from loresmith.functions.questions import query_topics
from loresmith.operators import dictionary as d


def words(n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abcdefg가나다") for _ in range(rng.randint(2, 9))) for _ in range(n)})


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 300}, {"BLOCK_BYTES": 900}])
def test_keywords_against_containment(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(d, name, value)
    keywords = words(900, 1) + ["ABC", "abc", "", None, "🙂x"]
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abcdefg가나다 ") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "is ABCDEF 🙂X"), (63, texts[0][1])]
    got = d.keywords_in(frame(spark, texts, "text_id long, text string"), frame(spark, [(k,) for k in keywords], "keyword string"))
    assert sorted(map(tuple, got.collect())) == sorted(
        {(i, k.lower()) for i, t in texts if t for k in keywords if k and k.lower() in t.lower()})


def test_large_dictionary_takes_one_block(spark):
    keywords = words(50_000, 3)
    assert len(keywords) > 30_000
    texts = [(i, " ".join(keywords[i * 37 : i * 37 + 20])) for i in range(40)]
    found = d.labels_in(frame(spark, texts, "text_id long, text string"), frame(spark, [(k, k) for k in keywords], "keyword string, name string"), "name")
    assert found.count() == 40  # one row of a text for every block
    known = set(keywords)
    for row in found.collect():
        text = texts[row["text_id"]][1]
        assert row["labels"] == sorted({text[a:b] for a in range(len(text)) for b in range(a + 2, a + 10)} & known)


def test_tags_in_order_and_edge_cases(spark):
    table = frame(spark, [(2, "late", "x"), (1, "early", "yy"), (1, "early", "x"), (5, "early", "q"), (None, "none", "z"), (0, None, "x"), (3, "empty", ""), (3, "null", None)],
                  "tag_no long, tag string, keyword string")
    texts = frame(spark, [(1, "aXb"), (2, "yyz"), (3, "nothing"), (4, None), (5, "z"), (5, "q")], "text_id long, text string")
    got = {r["text_id"]: r["tags"] for r in d.tags_in(texts, table).collect()}
    assert got == {1: ["early", "late"], 2: ["early", "none"], 3: [], 4: [], 5: ["early", "none"]}
    assert {r["text_id"]: r["tags"] for r in d.tags_in(texts, table.limit(0)).collect()} == {i: [] for i in range(1, 6)}
    assert d.tags_in(texts.limit(0), table).count() == 0


def test_equal_to_the_topics_of_a_question(spark):
    rows = [(i, tag, k) for i, (tag, ks) in enumerate(vocab.QUERY_TOPICS.items()) for k in ks]
    asked = [(i, f"{a} {b} 방법") for i, (a, b) in enumerate(zip([k for _, _, k in rows], [k.upper() for _, _, k in reversed(rows)]))] + [(-1, "")]
    questions = frame(spark, asked, "text_id long, text string")
    got = {r["text_id"]: r["tags"] for r in d.tags_in(questions, frame(spark, rows, "tag_no long, tag string, keyword string")).collect()}
    want = {r["text_id"]: r["t"] for r in questions.select("text_id", query_topics(F.lower("text")).alias("t")).collect()}
    assert got == want
