"""Token counts, packing, SimHash, fingerprints and toxicity against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from reweight.llm import packing, parsing, simhash, tokens, toxicity
from reweight.llm.common import components


def key(r):
    return tuple((v is None, v) for v in r)


def test_token_counts(spark, documents, edge_rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _ in edge_rows), key=key)
    assert sorted(map(tuple, tokens.count_tokens(documents(edge_rows)).collect()), key=key) == want
    assert tokens.count_tokens(documents([])).count() == 0


def test_token_counts_without_a_hot_table(spark, documents, edge_rows, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_ENTRIES", 0)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    got = tokens.query(spark, documents(edge_rows)).collect()
    assert sum(r.n_tokens for r in got) == sum(len(sp.encode(t or "")) for _, t, _ in edge_rows)
    assert {r.doc_id for r in got if r.over_limit} == {i for i, t, _ in edge_rows if len(sp.encode(t or "")) > 4096}


def test_pre_tokens_of_an_unsafe_model_are_whole_texts():
    assert tokens.pre_tokens("a b", False) == Counter(["a b"])


def test_packing_places_every_token(spark, documents, edge_rows):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(packing.model_path())
    want = Counter()
    for i, t, _ in edge_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        cut = len(ids) % 2048 or 2048
        bounds = [0, *range(cut, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack(documents(edge_rows)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(documents([])).count() == 0


def test_packing_agrees_on_all_plain_code_points():
    path = packing.model_path()
    text = "".join(chr(c) + " a" + chr(c) + chr(c) + "1\n" for c in packing._plain)
    ids = packing.tokenizer(path)[0].encode(text, add_special_tokens=False).ids
    assert packing.PLAIN.fullmatch(text) and packing.ids_of(text, path) == np.array(ids, "<u4").tobytes()


def least_bins(items, capacity):
    """Fewest bins, by trying every place for each item."""
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            rest = list(bins)
            rest[rest.index(room)] -= items[i]
            place(i + 1, rest)
        place(i + 1, [*bins, capacity - items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    """The fixed bins plus the best packing of what is left are as few as the best packing of all."""
    rng = random.Random(seed)
    items = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
    left = dict(Counter(items))
    fixed = packing.reduced(left, 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert Counter(items) == Counter(rest) + Counter(s for held, n in fixed for s in held * n)
    assert sum(n for _, n in fixed) + (least_bins(rest, 20) if rest else 0) == least_bins(items, 20)


def test_plan_is_whole_and_near_the_bound():
    rng = random.Random(1)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000))
    places = packing.plan(counts)
    by_size = Counter()
    room = Counter()
    for size, lo, hi, first, _ in places:
        by_size[size] += hi - lo
        for s in range(first, first + hi - lo):
            room[s] += size
    assert by_size == counts and max(room.values()) <= 2048
    assert len(room) <= -(-sum(s * n for s, n in counts.items()) // 2048) * 1.01 + 1


def naive_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, documents, edge_rows):
    rng = random.Random(3)
    words = [rng.choice("alpha beta gamma delta epsilon zeta eta".split()) + str(rng.randint(0, 50)) for _ in range(400)]
    rows = list(edge_rows)
    for i in range(60):
        own = list(words)
        for _ in range(i % 4):
            own[rng.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(own), "src0"))
    rows = [r for r in rows if r[0] is not None]
    fps = [naive_fingerprint(t or "") for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {x: min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in label}
    want = sorted((r[0], f"{f:016x}", least[x]) for r, f, x in zip(rows, fps, label))
    got = sorted(tuple(r) for r in simhash.query(spark, documents(rows)).collect())
    assert got == want and len({g[2] for g in got}) < len(got)
    assert simhash.near_duplicates(documents([])).count() == 0
    alone = simhash.near_duplicates(documents([(None, "only rows without an id", "s")])).collect()
    assert [r.component_id for r in alone] == [None]


@pytest.mark.parametrize("limit", ["SHIFTED", "PAIRED", None])
def test_runs_of_any_size_give_the_same_links(limit, monkeypatch):
    """Shifts, blocks and neighbour look-up find the same components."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(16, 64, 30, dtype=np.uint64)) for b in base for _ in range(3)]))
    if limit:
        monkeypatch.setattr(simhash, "SHIFTED", 2)
    if limit == "PAIRED":
        monkeypatch.setattr(simhash, "PAIRED", 1)
    keys = np.array([(int(f) & 0xFFFF) for f in fps], np.int64)  # chain 0: the first two segments are equal
    order = np.lexsort((fps, keys))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[p]), pa.array(fps[p].view(np.int64))], ["key", "fp"]) for p in np.array_split(order, 4)]
    edges = [(a, b) for out in simhash.links(batches) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    got = simhash.least_labels(len(fps), np.array([at[a] for a, _ in edges], int), np.array([at[b] for _, b in edges], int))
    x = fps[:, None] ^ fps[None, :]
    a, b = np.nonzero((np.bitwise_count(x) <= 3) & (keys[:, None] == keys[None, :]))
    assert (got == simhash.least_labels(len(fps), a, b)).all()


def test_every_close_pair_shares_a_chain_key(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        rows.append((i, a - (a >> 63 << 64), b - (b >> 63 << 64)))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    shared = df.select(simhash.chain_keys("a").alias("x"), simhash.chain_keys("b").alias("y")).selectExpr("size(array_intersect(x, y)) AS n")
    assert shared.where("n = 0").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(5, 4), (4, 3), (3, 5), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {3: 3, 4: 3, 5: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parse_fingerprints(spark, documents, edge_rows):
    rows = [r for r in edge_rows if r[0] is not None and r[0] != 5 and r[0] != 4]
    order = sorted(rows)
    got = {r.doc_id: r for r in parsing.query(spark, documents(rows)).collect()}
    assert len(got) == len(rows)
    for n, (i, t, _) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1].near_next == 1.0  # two empty texts
    assert parsing.fingerprint(documents([])).count() == 0
    one = parsing.fingerprint(documents(["a text that is its own next document"])).collect()[0]
    assert one.near_next == 1.0
    assert parsing.fingerprint(documents(edge_rows)).count() == len(edge_rows)


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    a, b, c = text(400), text(400), text(37)
    own, moved, other = parsing.fingerprints([a, c + a, b])
    assert parsing.likeness(own, moved) > 0.75
    assert parsing.likeness(own, other) < 0.1
    assert parsing.fingerprints([a])[0] == own
    half = parsing.likeness(*parsing.fingerprints([a, a[: len(a) // 2] + b[len(b) // 2 :]]))
    assert 0.15 < half < 0.6


def test_toxicity_learns_pairs_and_keeps_out_the_held_out(spark, documents):
    """Neither the insult nor the group alone is toxic, only both together; held-out labels are all wrong."""
    rng = random.Random(4)
    common = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(common, k=30)
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["fool"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "src0"))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(insult and group) ^ held))
    docs, labels = documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.query(spark, docs, labels).collect()
    truth = {i: "fool" in t and "martians" in t for i, t, _ in rows}
    assert {r.doc_id for r in got if r.held_out} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    right = sum(r.predicted == truth[r.doc_id] for r in got) / len(got)
    assert right > 0.97
    model = toxicity.train(docs, labels)
    assert np.abs(model["v"]).max() > 0.1


@pytest.mark.parametrize("background", [0, 30])
def test_toxicity_learns_pairs_of_words_that_say_nothing_alone(spark, documents, background):
    """Two of four words per text, each as frequent in either label; only which two they are is toxic."""
    rng = random.Random(7)
    names = ["alphaone", "betatwo", "gammathree", "deltafour"]
    rows, labels = [], []
    for i in range(2400):
        one, two = rng.sample(range(4), 2)
        words = [names[one], names[two], *(f"plain{rng.randrange(300)}" for _ in range(background))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "src0"))
        labels.append((i, int({one, two} in ({0, 1}, {2, 3}))))
    got = toxicity.query(spark, documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    yes = [r.score for r in got if r.held_out and truth[r.doc_id]]
    no = [r.score for r in got if r.held_out and not truth[r.doc_id]]
    assert np.mean([(a > b) + (a == b) / 2 for a in yes for b in no]) > 0.99
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.97


def test_toxicity_has_no_pairs_in_noise():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 2000, 200)).astype(np.uint32) for _ in range(1500)]
    labels = (rng.random(1500) < 0.1).astype(float)
    assert len(toxicity.paired(rows, labels, np.full(1500, 0.1))) == 0


def test_toxicity_evidence_of_pairs_by_brute_force(monkeypatch):
    """Terms of pairs whose Poisson log likelihood ratio reaches the bar, pair by pair."""
    monkeypatch.setattr(toxicity, "EVIDENCE", 2.0)
    monkeypatch.setattr(toxicity, "FOLD", 50)
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.uint32) for _ in range(300)]
    labels, expected = (rng.random(300) < 0.3).astype(float), rng.uniform(0.1, 0.5, 300)
    want = set()
    for a in range(40):
        for b in range(a):
            both = [i for i, r in enumerate(rows) if a in r and b in r]
            k, mean = sum(labels[both]), max(1e-9, sum(expected[both]))
            if (k * np.log(k / mean) if k else 0.0) - k + mean >= 2.0:
                want |= {a, b}
    assert want and set(toxicity.paired(rows, labels, expected).tolist()) == want


def test_toxicity_scores_are_those_of_a_factorization_machine():
    rng = np.random.default_rng(1)
    words = ["fool", "martians", "plain", "other"]
    ids = np.array(sorted(set().union(*map(toxicity.terms, words[:3]))))
    model = {"ids": ids, "w": rng.normal(size=len(ids) + 1), "v": rng.normal(size=(len(ids) + 1, toxicity.FACTORS))}
    model["v"][0] = 0
    place = {int(t): i + 1 for i, t in enumerate(ids)}
    texts = ["", "Fool FOOL other", "plain martians", "fool martians plain"]
    for text, got in zip(texts, toxicity.scores(texts, model, place, {})):
        on = sorted({place[t] for w in text.lower().split() for t in toxicity.terms(w) if t in place})
        z = model["w"][0] + sum(model["w"][i] for i in on)
        z += sum(model["v"][i] @ model["v"][j] for i in on for j in on if i < j)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_gives_the_memory_of_its_sample_back(spark, documents, monkeypatch):
    docs = documents([(i, f"some words {i}", "s") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    times = []
    monkeypatch.setattr(toxicity, "release", lambda: times.append(1))
    toxicity.train(docs, labels)
    assert times == [1]


def test_toxicity_learns_from_one_text_of_an_id(spark, documents, monkeypatch):
    """Rows that repeat an id are reduced before they are collected; a column named like an own one does no harm."""
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels, seed=5: sizes.append(len(rows)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    rows = [(1, f"text number {i}", "src0") for i in range(200)] + [(i, "some text", "src0") for i in range(20)]
    docs = documents(rows)
    toxicity.train(docs, labels)
    toxicity.train(docs.selectExpr("*", "1 AS label", "'x' AS terms"), labels)
    want = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20))
    assert sizes == [want, want]


def test_toxicity_edges(spark, documents, edge_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.query(spark, documents(edge_rows), none).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score < 0.01 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(8, 1), (8, 1), (10, None), (None, 1), (77, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.query(spark, documents(edge_rows), some).count() == len(edge_rows)
    assert toxicity.query(spark, documents([]), some).count() == 0


def test_pairs_of_terms_are_counted_in_little_memory():
    """On the driver: 3,000 terms, whose whole matrices of pairs would be 36 MB each."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 3000, 60)).astype(np.uint32) for _ in range(1500)]
    labels = (rng.random(1500) < 0.5).astype(float)
    rows = [np.union1d(r, [3100, 3101]).astype(np.uint32) if y else r for r, y in zip(rows, labels)]
    rows[0] = np.zeros(0, np.uint32)
    tracemalloc.start()
    ids = toxicity.paired(rows, labels, np.full(1500, 0.3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {3100, 3101} <= set(ids.tolist())
    assert peak < 80e6
