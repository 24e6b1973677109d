import random
import re

import xxhash
from pyspark.sql import functions as F

from loresmith.llm import simhash
from loresmith.llm.components import components


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """values: list of (id, unsigned fingerprint) -> {id: smallest reachable id}"""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i][1] ^ values[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(values):
        groups.setdefault(find(i), []).append(doc)
    return {doc: min(g) for g in groups.values() for doc in g}


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 300]))]
        rows.append(" ".join(words))
        if i % 3 == 0 and len(words) > 40:
            for _ in range(3):
                changed = list(words)
                changed[rng.randrange(len(words))] = "CHANGED"
                rows.append(" É ".join(changed[:1]) + " " + "\n\t".join(changed[1:]))
    return rows + ["", None, "   \n", "One", "one", "ONE two", "KK ÉÉ x", rows[0], "a b " * 300_000]


def test_whole_result_against_brute_force(spark, make_docs):
    rows = [(7 + 3 * i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs(rows)).collect()}
    values = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(values)
    assert len(got) == len(rows)
    for i, fp in values:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp:016x}", want[i])


def test_full_buckets_lose_no_link(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    values = {center}
    for _ in range(300):
        value = center
        for _ in range(rng.randrange(1, 5)):
            value ^= 1 << rng.randrange(64)
        values.add(value)
    values |= {rng.getrandbits(64) for _ in range(100)} | {rng.getrandbits(32) << 32 for _ in range(5)}
    pairs = [(i, v) for i, v in enumerate(sorted(values))]
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for _, v in pairs], "fp long")
    want = brute_components(pairs)
    for bucket_max in (1, 4, 64, 10_000):
        found = components(simhash.links(distinct, bucket_max))
        root = {r["node"] % (1 << 64): r["root"] for r in found.collect()}
        groups = {}
        for i, v in pairs:
            groups.setdefault(root.get(v, ("alone", v)), []).append(i)
        assert {i: min(g) for g in groups.values() for i in g} == want


def test_one_row_of_each_group_stays(spark, make_docs):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(5, long), (3, long + " end"), (3, long + " end"), (9, "other text of its own here"), (None, None), (None, ""), (2, "x"), (2, "x")]
    kept = simhash.keep_first(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    # One short change among 20,000 words leaves the fingerprint within two bits here; null and empty text are one group.
    assert simhash.near_duplicates(make_docs(rows[:2])).select("component_id").distinct().count() == 1
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "9", "None"]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (1, 2), (2, 1)]
    found = components(spark.createDataFrame(chain, "a long, b long"))
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[i] for i in range(1000, 1400)}) == 1
    assert roots[0] != roots[1000] and found.count() == 601


def test_empty(spark, make_docs):
    empty = make_docs([(1, "x")]).where(F.lit(False))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
