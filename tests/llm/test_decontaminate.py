import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loresmith.llm import bytesweep, decontaminate


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = set()
    for item, text in set(items):
        w = words(text)
        k = min(5, len(w))
        wanted = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for doc, body in docs:
            b = words(body)
            held = wanted & {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            if wanted and len(held) >= math.ceil(round(0.8 * len(wanted), 9)):
                out.add((doc, item, len(wanted), len(held)))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "ß", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 17, 40, 90])]
    items += [(20, ""), (21, None), (22, "w1 W2, w3."), (22, "w1 W2, w3."), (None, "w5 w6 w7 w8 w9 w10"), (3, "another text of the same number")]
    docs = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 50, 2000]))]
        item = words(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            if item:
                item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(body) + 1)
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body[:at] + item + body[at:]).upper()))
    return docs + [(500, None), (501, ""), (None, "w5-w6-w7-w8-w9-w10"), (7, "w1 w2 w3"), (7, "w1 w2 w3")], items


def test_pairs_against_brute_force(spark, make_docs):
    docs, items = cases()
    given = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(make_docs(docs), given)
    assert got.columns == ["doc_id", "item_id", "n_shingles", "n_contained", "containment"]
    assert {tuple(r)[:4] for r in got.collect()} == brute(docs, items)
    left = decontaminate.without_items(make_docs(docs), given)
    bad = {(d, t) for d, t in docs for x in brute([(d, t)], items)}
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(
        f"Row(doc_id={d!r}, text={t!r})" for d, t in docs if (d, t) not in bad)
    assert left.columns == make_docs([(1, "")]).columns


def test_items_of_one_stem_are_found_by_what_is_their_own(spark, make_docs):
    rng = random.Random(5)
    stem = " ".join(f"stem{i}" for i in range(9))
    items = [(i, stem + " " + " ".join(f"own{i}x{j}" for j in range(12))) for i in range(40)]
    docs = [(i, "before " + stem + " after " + " ".join(f"d{rng.randrange(500)}" for _ in range(60))) for i in range(200)]
    docs += [(1000 + i, "so it is: " + items[i][1] + " and so on") for i in range(5)]
    given = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in decontaminate.contaminated(make_docs(docs), given).collect()}
    assert got == brute(docs, items) and len(got) == 5
    sketches = decontaminate.item_sketches(given, "text", "item_id", 0.8).cache()
    values = {v for (v,) in sketches.where("item.id = 0").select("value").collect()}
    held = spark.createDataFrame([(i, sorted(values)[:3]) for i in range(4)], "row long, values array<long>")
    asked = decontaminate._asked_values(sketches, held).where("item.id = 0").first()
    assert set(asked["sketch"]) == values and asked["sketch"][-3:] == sorted(values)[:3]  # the held ones come last


def test_empty_tables(spark, make_docs):
    docs, items = make_docs([(1, "a b c")]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 1
    assert decontaminate.contaminated(docs, items.where(F.lit(False))).count() == 0
    assert decontaminate.contaminated(docs.where(F.lit(False)), items).count() == 0


def test_word_hashes_do_not_depend_on_blocks():
    text = ("abc " * 3_000_000) + "x" * 5_000_000 + " tail"
    rows = pa.array([text, None, "abc", "", "x y"])
    (a, data, bounds), *rest = bytesweep.chunks(rows)
    hashes, firsts = bytesweep.word_hashes(data, bounds)
    assert len(hashes) == 3_000_002 and len(set(hashes.tolist())) == 3
    first, data, bounds = rest[0]
    again, firsts = bytesweep.word_hashes(data, bounds)
    assert first == 1 and again[0] == hashes[0] and firsts.tolist() == [0, 0, 1, 1, 3]
    assert np.array_equal(bytesweep.shingle_hashes(again, firsts, 2)[1], [3])
