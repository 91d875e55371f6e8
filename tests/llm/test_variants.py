"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from reweight.llm import variants


def edits_apart(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if edits_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def result(df):
    return set(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def corpus(rng, letters, sizes, docs):
    """Texts of words that are edits of each other, with frequencies that fall steeply."""
    words = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(25)]
    for w in list(words):
        for _ in range(6):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:at] + rng.choice(letters) * (kind != 1) + w[at + (kind != 0) :]
            words.append(w)
    weights = [5.5 ** -(i % 7) for i in range(len(words))]
    return [(i, " ".join(w.title() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=600))) for i in range(docs)]


def test_all_pairs(spark, documents, edge_rows, monkeypatch):
    rng = random.Random(3)
    rows = corpus(rng, "abé", range(6, 10), 30) + corpus(rng, "abcdefgh", range(6, 14), 30)
    rows += [(i, t) for i, t, *_ in edge_rows] + [(9, "Ab×cde÷ ÉcoleÉ écoleé xxxxxx " * 5), (9, "x" * 70_000 + " " + "x" * 69_999)] * 5
    want = brute([r for r in rows if len(r[1] or "") < 60_000])
    got = variants.variants(documents(rows))
    long = {r for r in result(got) if len(r[0]) > 60_000}
    assert result(got) - long == want and {r[4] for r in long} <= {0, 1, 2} and long
    assert any(r[1] and r[2] != r[1] for r in want)
    # Blocks cut into indexes of three words.
    monkeypatch.setattr(variants, "SLAB", 3)
    assert result(variants.variants(documents([r for r in rows if len(r[1] or "") < 60_000]))) == want


def test_empty_tables(spark, documents):
    assert variants.variants(documents([])).count() == 0
    assert variants.variants(documents([(1, None), (2, "short words only, five or less")])).count() == 0


words = st.lists(st.text("abc", min_size=6, max_size=7), unique=True, min_size=1, max_size=40).map(sorted)


@settings(max_examples=200, deadline=None)
@given(words)
def test_bitsets(vocabulary):
    queries = [w for w in vocabulary if len(w) == 6]
    for q, replaced, more in variants.Index(vocabulary, 6).near(queries):
        got = {vocabulary[i] for i in variants.members(replaced | more)}
        assert got == {w for w in vocabulary if edits_apart(q, w)}


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=30).map(sorted), st.integers(1, 5))
def test_groups_over_batches(rows, size):
    import pyarrow as pa

    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p)], ["a", "b"]) for p in parts]
    got = list(variants.grouped(iter(batches), 1))
    assert [r for g in got for r in g] == rows and [g[0][0] for g in got] == sorted({r[0] for r in rows})
