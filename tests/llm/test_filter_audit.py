"""The filter audit against its definition, document by document and order by order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from reweight.llm import audit


def brute(rows, labels):
    """Every document through every order."""
    out = {}
    fails = []
    for i, text, part in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        f = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", text or "")) > 5 * len(text or "")) + "D" * bool(re.search(r"[#$%&*|]", text or ""))
        same = [j for j, t, _ in rows if (t or "") == (text or "") and j is not None and (i is None or j < i)]
        fails.append((part or "", set(f + "E" * bool(same)), max((q == 1 for j, q, _ in labels if j == i and i is not None), default=False), max((t == 1 for j, _, t in labels if j == i and i is not None), default=False)))
    for part in {p for p, *_ in fails}:
        shapley, here = Counter(), [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                prior = set(order[: step - 1])
                gone = [f for f in here if x in f[1] and not f[1] & prior]
                kept = sum(not f[1] & (prior | {x}) for f in here)
                redundant = sum(x in f[1] and bool(f[1] & prior) for f in here)
                shapley[x] += len(gone)
                out[part, order, step] = [kept, len(gone), redundant, sum(f[1] == {x} for f in here), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), r in out.items():
            if p == part:
                r.append(shapley[order[step - 1]])
    return {k: tuple(r) for k, r in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_every_order_of_awkward_rows(spark, documents, edge_rows, monkeypatch):
    plain = " ".join(f"word{i}" for i in range(60))
    rows = edge_rows + [(20, plain, "src1"), (21, plain, "src2"), (22, plain.upper(), "src1"), (23, plain + " #", "src1"), (None, plain, "src2")]
    rows += [(30, "a b " * 40, "src1"), (21, "a b " * 40, "src1"), (31, "A$", ""), (31, "A$", "")]
    rows = [r if len(r) == 3 else (*r, "src0") for r in rows]
    marks = [(20, 1, 0), (21, 1, 1), (21, 0, 0), (22, None, 1), (30, 0, 1), (None, 1, 1), (4, 1, None), (99, 1, 1), (31, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "0 AS good")
    want = brute(rows, marks)
    assert result(audit.audit(documents(rows), labels)) == want
    # Ranges of two ids, and every repeated text handled as one that holds much of the table.
    monkeypatch.setattr(audit, "RANGE_BITS", 1)
    monkeypatch.setattr(audit, "HEAVY", 10**6)
    assert result(audit.audit(documents(rows), labels)) == want


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(documents([]), labels).count() == 0
    rows = audit.audit(documents([(1, "one text")]), labels).collect()
    assert len(rows) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in rows)


def test_posting_lists_are_sorted_ids_of_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = audit.postings(documents([(1, "short", "s"), (2, "short", "s"), (2, "#", "s"), (3, None, "t")]), labels).collect()
    assert sorted((r.part, r.n, len(r.A), len(r.D), len(r.E), len(r.good)) for r in rows if r.n) and sum(r.n for r in rows) == 4
    assert all(list(r.A) == sorted(set(r.A)) for r in rows)
    assert sum(len(r.E) for r in rows) == 1 and sum(len(r.good) for r in rows) == 1


ids = st.sets(st.integers(0, 60)).map(lambda s: np.array(sorted(s), np.int64))


@given(ids, ids)
def test_merges(a, b):
    assert audit.merged(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))
    assert a[audit.found(a, b)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
