import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresmith.llm import fim


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100
    form = "plain" if plain else "spm" if h4 % 100 < 50 else "psm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lengths = (None, None) if plain else (len(prefix), len(middle))
    return (doc_id, n, form, *lengths, sha(out), sha(text))


def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(["a", "é", "漢", "😀", "\n", "<", "P>", "\r"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    return out + ["", None, "\n", "\n\n\n", "one line", "<P>", "a<S>\nb", "\n<M>", "x\n" * 40_000, "é\n" + "漢" * 200_000 + "\nz", "<\nS>\n"]


def test_against_brute_force(spark, make_docs):
    rows = list(enumerate(texts())) + [(None, "a\nb"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    docs = make_docs(rows).withColumn("form", F.lit("clash")).withColumn("n_units", F.lit("clash"))
    got = fim.fim_digests(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    order = lambda r: (r[0] is not None, *(str(x) for x in r))
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted((expected(*r) for r in rows), key=order)
    assert fim.fill_in_middle(docs).columns == [*docs.columns, "fim_text", "prefix_chars", "middle_chars"]
    assert fim.fim_digests(docs.where(F.lit(False))).count() == 0


def test_exact_round_trip(spark, make_docs):
    docs = make_docs(list(enumerate(texts())))
    for options in ({"unit": "char"}, {"unit": "char", "spm_percent": 0, "rewrite_percent": 50, "marks": ("[p]", "[s]", "[m]")}):
        made = fim.fill_in_middle(docs, salt="x", **options)
        marks = options.get("marks", fim.SENTINELS)
        again = made.select("text", "form", fim.restored(F.col("fim_text"), F.col("form"), marks).alias("again")).collect()
        assert all(r["again"] == (r["text"] or "") for r in again)
        assert {r["form"] for r in again} == ({"plain", "psm"} if "marks" in options else {"plain", "psm", "spm"})


def test_marks_that_can_not_be_told_apart(spark, make_docs):
    for marks in (("<P>", "<P>", "<M>"), ("ab", "ba", "x"), ("ab", "abc", "x"), ("", "a", "b"), ("aXa", "s", "m")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(make_docs([(1, "x")]), marks=marks)


@pytest.mark.parametrize("density", [0.001, 0.03, 0.2, 0.9, 1.0])
def test_select_in_every_container(density):
    rng = np.random.default_rng(2)
    offsets = np.flatnonzero(rng.random(300_000) < density)
    known = fim.BoundarySet(np.array_split(offsets, 37))
    kinds = {type(c) for c in known.containers}
    assert len(known) == len(offsets)
    assert kinds == {{0.001: fim.ArrayContainer, 0.03: fim.ArrayContainer, 0.2: fim.BitmapContainer, 0.9: fim.BitmapContainer,
                      1.0: fim.RunContainer}[density]}
    for rank in [0, len(offsets) - 1, *rng.integers(0, len(offsets), 500).tolist()]:
        assert known.select(rank) == offsets[rank]


def test_blocks_do_not_matter(monkeypatch):
    data = np.frombuffer("é漢\n😀x\n\nz".encode(), np.uint8)
    whole = {u: np.concatenate(list(fim.boundaries(data, u))).tolist() for u in fim.UNITS}
    assert whole == {"line": [0, 3, 6, 7, 8], "char": list(range(9))}
    for size in range(1, 8):
        monkeypatch.setattr(fim, "BLOCK_BYTES", size)
        assert {u: np.concatenate(list(fim.boundaries(data, u))).tolist() for u in fim.UNITS} == whole
