import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loresmith.llm import near_copies, simhash


def brute(rows):
    """rows of (id, text) with unique ids -> ids that stay, comparing all pairs by their exact shingles"""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both * 10 >= 8 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(min(g) for g in groups.values())


def varied(rng, words, edits):
    changed = list(words)
    for at in rng.sample(range(len(words)), edits):
        changed[at] = f"c{rng.randrange(10**6)}"
    return changed


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 5, 6, 60, 250]))]
        rows.append(" ".join(words))
        for _ in range(i % 3):
            rows.append("\n".join(varied(rng, words, min(len(words), rng.randrange(0, 1 + len(words) // 40)))))
    return rows + ["", None, " \n", "One Two", "one  two", "x " * 50_000, rows[0].upper()]


def test_against_all_pairs(spark, make_docs):
    rows = [(5 + 2 * i, t) for i, t in enumerate(cases())]
    for limits in ({"bucket_max": 1, "rare_max": 1}, {"bucket_max": 1, "rare_max": 3, "rounds": 1}, {}):
        kept = near_copies.keep_first(make_docs(rows), **limits)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
        assert sorted(r["doc_id"] for r in kept.collect()) == brute(rows)


def test_large_group_of_near_copies(spark, make_docs):
    """A text and 300 copies with edited words: most copies are near the text alone, and not near each other."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(varied(rng, words, 8) if i != 150 else words)) for i in range(301)]
    assert sorted(r["doc_id"] for r in near_copies.keep_first(make_docs(rows)).collect()) == brute(rows)


def test_pages_of_one_form(spark, make_docs):
    """Pairs of pages that share a few words besides a long form: each is a near copy of its partner alone."""
    rng = random.Random(8)
    fresh = lambda n, name: [f"{name}{rng.randrange(10**9)}" for _ in range(n)]
    form, rows = fresh(480, "f"), []
    for _ in range(100):
        partner = fresh(12, "p")
        rows += [(len(rows) + k, " ".join(form + partner + fresh(54, "o"))) for k in range(2)]
    kept = sorted(r["doc_id"] for r in near_copies.keep_first(make_docs(rows)).collect())
    assert kept == brute(rows) and len(kept) <= 101


def test_categories_of_one_form(spark, make_docs):
    """Pages of little own text: near copies inside a category, not across categories of the same form."""
    rng = random.Random(9)
    fresh = lambda n, name: [f"{name}{rng.randrange(10**9)}" for _ in range(n)]
    form, rows = fresh(300, "f"), []
    for _ in range(8):
        category = fresh(100, "c")
        rows += [(len(rows) + k, " ".join(form + category + fresh(10, "o"))) for k in range(25)]
    for rounds in (1, near_copies.ROUNDS):
        kept = sorted(r["doc_id"] for r in near_copies.keep_first(make_docs(rows), rounds=rounds).collect())
        assert kept == brute(rows) and len(kept) == 8


def test_stage_drops_copies_beyond_two_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == brute(rows) and not {145, 177} & set(kept)


def test_simhash_links_are_candidates(spark, make_docs, monkeypatch):
    """Without any pair by MinHash, texts within two bits are still linked, if their shingles say so."""
    rng = random.Random(11)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(varied(rng, words, 1)))]
    rows += [(500, "a b a b a b a b a b"), (501, "b a b a b a b a b a")]  # the same two shingles, in different numbers or places
    near = {a for a, text in rows[:80:2] if (simhash.fingerprint(text, 5) ^ simhash.fingerprint(rows[a + 1][1], 5)).bit_count() <= 2}
    assert 5 < len(near) < 40
    monkeypatch.setattr(near_copies, "_pairs_in", lambda members, key: members.sparkSession.createDataFrame([], "a long, b long"))
    kept = {r["doc_id"] for r in near_copies.keep_first(make_docs(rows)).collect()}
    assert {a for a in range(0, 80, 2) if a + 1 not in kept} == near and 500 in kept and 501 not in kept


def test_keys_do_not_depend_on_blocks(monkeypatch):
    hashes = next(near_copies.shingled(pa.array([" ".join(f"w{i}" for i in range(1000))]), 5))
    whole = near_copies.band_keys(hashes)
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    assert (near_copies.band_keys(hashes) == whole).all()


def test_empty(spark, make_docs):
    assert near_copies.keep_first(make_docs([(1, "x")]).where(F.lit(False))).count() == 0
