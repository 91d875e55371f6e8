"""Interpolated scores against a plain model with dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from reweight.llm import interpolation


def plain(rows):
    """The same model, token by token."""
    data = []
    for i, text in rows:
        rest = zlib.crc32(str(i).encode()) % 7 if i is not None else 0
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = text.encode().split()
        data.append((i, rest, ["<", *words, ">"]))
    word, pair = {}, {}
    for name, keep in (("all", lambda r: r != 2), ("kept", lambda r: r not in (2, 3))):
        word[name], pair[name] = Counter(), Counter()
        for _, rest, t in data:
            if keep(rest):
                word[name].update(t[1:])
                pair[name].update(zip(t, t[1:]))
    n = {k: sum(v.values()) for k, v in word.items()}
    v = {k: len(x) for k, x in word.items()}

    def three(name, h, w):
        ch = word[name][">" if h == "<" else h]
        return ch, (pair[name][h, w] / ch if ch else 0.0, word[name][w] / n[name] if n[name] else 0.0, 1 / (v[name] + 1))

    bucket = lambda c: math.frexp(c)[1]
    weights = {b: (1 / 3, 1 / 3, 1 / 3) if b else (0, 0.5, 0.5) for b in range(interpolation.BUCKETS)}
    dev = Counter(three("kept", h, w) for _, rest, t in data if rest == 3 for h, w in zip(t, t[1:]))
    for _ in range(interpolation.ROUNDS):
        sums = {}
        for (ch, p), times in dev.items():
            b = bucket(ch)
            parts = [x * y for x, y in zip(weights[b], p)]
            s = sums.setdefault(b, [0.0] * 3)
            for k in range(3):
                s[k] += times * parts[k] / sum(parts)
        old = dict(weights)
        for b, s in sums.items():
            weights[b] = tuple(x / sum(s) for x in s)
        share = interpolation.SHARE
        weights = {b: tuple((x + share) / (1 + 3 * share) for x in w) if b else (w[0], *((x + share) / (1 + 2 * share) for x in w[1:])) for b, w in weights.items()}
        if max(abs(x - y) for b in weights for x, y in zip(weights[b], old[b])) < interpolation.SETTLED:
            break
    seen = sorted(b for b in {bucket(ch) for ch, _ in dev} if b)
    for b in range(1, interpolation.BUCKETS):
        if seen and b not in seen:
            weights[b] = weights[max([s for s in seen if s < b], default=seen[0])]
    if not n["all"]:
        weights[0] = (0, 0, 1)
    out = []
    for i, rest, t in data:
        base = sum(math.log10((word["all"][w] + 1) / (n["all"] + v["all"] + 1)) for w in t[1:])
        score = 0.0
        for h, w in zip(t, t[1:]):
            ch, p = three("all", h, w)
            score += math.log10(sum(x * y for x, y in zip(weights[bucket(ch)], p)))
        out.append((i, i is not None and rest == 2, len(t) - 1, sum(word["all"][w] > 0 for w in t[1:]), n["all"], base, score))
    return out


def compare(df, rows):
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key), sorted(plain(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-6, atol=1e-6)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    def line(k):
        out, at = [], rng.randrange(60)
        for _ in range(k):
            at = (at * 7 + rng.choice([1, 1, 1, 2, 5])) % 60 if rng.random() < 0.8 else rng.randrange(60)
            out.append(words[at] if rng.random() < 0.9 else f"rare{rng.randrange(400)}")
        return " ".join(out)
    return [(i, line(rng.randrange(0, 60))) for i in range(150)]


@pytest.mark.parametrize(("words", "pairs", "cut"), [(1 << 20, 1 << 20, 1 << 21), (20, 1 << 20, 40), (30, 0, 500), (0, 0, 70)])
def test_equals_a_plain_model(spark, documents, edge_rows, texts, monkeypatch, words, pairs, cut):
    """With all words frequent, few, and none but the end; with frequent pairs and without; in few and many packed rows."""
    monkeypatch.setattr(interpolation, "HOT_WORDS", words)
    if pairs == 0:
        monkeypatch.setattr(interpolation, "frequent", lambda table, most, real=interpolation.frequent: real(table, most) if most == words else 1 << 62)
    monkeypatch.setattr(interpolation, "CUT", cut)
    monkeypatch.setattr(interpolation, "MATCHED", 700)
    rows = texts + [(r[0], r[1]) for r in edge_rows if r[0] not in (8,)]
    compare(interpolation.score(documents(rows)), rows)


def test_small_tables(spark, documents):
    assert interpolation.score(documents([])).count() == 0
    out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    for rows in ([(out, "nothing to learn from")], [(out, None), (None, "")], [(1, "a b a b")]):
        compare(interpolation.score(documents(rows)), rows)


def test_probabilities_of_all_words_and_an_unseen_one_add_up():
    weights = np.random.default_rng(0).dirichlet(np.ones(3), interpolation.BUCKETS).T
    after, alone = np.array([3, 0, 2, 0]), np.array([6, 3, 4, 0])
    p = 10 ** interpolation.logs(weights, after, np.full(4, 5), alone, 13, 3)
    assert abs(p.sum() - 1) < 1e-12


def test_scores_of_held_out_texts_beat_the_base(spark):
    from reweight.llm import registry

    rows = registry.queries()["op12_interpolated_scores"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(rows) > 100 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_unseen_pairs_are_learnt_once_per_bucket_of_their_context():
    """Contexts 4 to 7 are one bucket; what follows them unseen is one row, what was seen keeps its context."""
    pair, context, word = (np.array(v) for v in ([0, 0, 0, 0, 2, 2], [4, 7, 6, 8, 4, 7], [3, 3, 5, 3, 3, 3]))
    aside, times = np.array([True] * 6), np.array([1, 2, 4, 8, 16, 32])
    rows = interpolation.developed(aside, times, pair, context, word).select(["rid", "doc_id", "p", "q"])
    got = sorted(tuple(r.values()) for r in rows.to_pylist())
    assert got == [(0, 4, 3, 3), (0, 4, 5, 4), (0, 8, 3, 8), (2, 4, 3, 16), (2, 7, 3, 32)]
    # A round of learning gives the same sums from these rows as from the plain ones.
    weights = np.random.default_rng(1).dirichlet(np.ones(3), interpolation.BUCKETS).T
    p = weights[:, interpolation.bucket(context)] * interpolation.parts_of(pair, context, word, 50, 9)
    want = np.stack([np.bincount(interpolation.bucket(context), v, interpolation.BUCKETS) for v in p * times / p.sum(0)])
    (sums,) = interpolation.expected(weights, 50, 9)(interpolation.together([rows]))
    assert np.allclose([sums.column(i).to_numpy() for i in (1, 2, 3)], want)
