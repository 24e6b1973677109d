import random
from collections import Counter

from pyspark.sql import functions as F

from loresmith.llm import line_dedup


def brute(rows):
    """rows of unique ids -> {id: (text, lines, removed)}"""
    seen, gone = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines = (text or "").split("\n")
        gone[doc] = set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if not "".join(window).strip(" "):
                continue
            if window in seen:
                gone[doc] |= {p, p + 1, p + 2}
            seen.add(window)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone[doc])
        out[doc] = (kept if gone[doc] else text, len(lines), len(gone[doc]))
    return out


def test_against_brute_force(spark, make_docs):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(12)] + ["", " ", "été"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "a\nb"), (303, "a\nb"), (304, "\n\n\n\n"), (305, "\n\n\n\n"), (None, "line 1\nline 2\nline 3"),
             (306, "p\nq\nr"), (307, "x\np\nq\nr\ny"), (308, "p\nq\nr\n" * 3000)]
    docs = make_docs(rows)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()} == brute(rows)


def test_rows_that_share_an_id(spark, make_docs):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "z\na\nb\nc"), (2, "a\nb\nc\nd")]
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(make_docs(rows)).collect())
    # Equal rows are one document; of the two texts with id 1 one keeps the passage, and document 2 loses it.
    assert got[(2, "d")] == 1 and got in (Counter({(1, "a\nb\nc"): 2, (1, "z"): 1, (2, "d"): 1}),
                                          Counter({(1, ""): 2, (1, "z\na\nb\nc"): 1, (2, "d"): 1}))


def test_native_plan_and_empty(spark, make_docs):
    docs = make_docs([(1, "a\nb\nc")])
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.dedup_lines(docs.where(F.lit(False))).count() == 0
