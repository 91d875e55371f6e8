"""Mixing, sharding, neighbours, passages, personal data and the pipeline, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from reweight.llm import mixing, neighbours, packing, passages, pii, simhash, slots, toxicity


def test_period_stays_within_a_block():
    shares = {"a": 6, "b": 3, "c": 3, "d": 2, "e": 1}
    plan = mixing.period(shares)
    total = sum(shares.values())
    assert sorted((s, j) for s, j, _ in plan) == sorted((s, j) for s, n in shares.items() for j in range(n))
    drawn = Counter()
    for s, j, t in plan:
        drawn[s] += 1
        assert j * total // shares[s] <= t < -(-(j + 1) * total // shares[s])
        for x, n in shares.items():
            assert abs(drawn[x] - n * (t + 1) / total) < 1


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 0}, {"a": 200_000}])
def test_shares_are_checked(documents, shares):
    rows = documents([(1, "x", "a"), (2, "y", "b")])
    if shares["a"] == 1:
        assert mixing.mix(rows, shares).count() == 2
    else:
        with pytest.raises(ValueError):
            mixing.mix(rows, shares)


def test_mix_keeps_rows_and_proportions(spark, documents, edge_rows):
    rows = [(i, "x" * (50 + i % 37), f"s{0 if i % 3 else i % 4}") for i in range(3000)]
    got = mixing.mix(documents(rows), {"s0": 3}, 1, block_bytes=1000).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    blocks = defaultdict(set)
    for r in got:
        blocks[r.source].add((r.turn, r.block))
        assert r.release <= r.turn < r.deadline and r.block == r.start // 1000
    shares = {s: 3 if s == "s0" else 1 for s in blocks}
    last = min(max(t for t, _ in b) for b in blocks.values())
    for t in range(last):
        for s, b in blocks.items():
            assert abs(sum(x <= t for x, _ in b) - (t + 1) * shares[s] / sum(shares.values())) < 1
    edge = mixing.mix(documents(edge_rows)).collect()
    assert Counter(r.doc_id for r in edge) == Counter(i for i, _, _ in edge_rows)
    assert {r.source for r in edge} == {s or "" for _, _, s in edge_rows}
    assert mixing.mix(documents([])).count() == 0
    carried = mixing.mix(documents(edge_rows), carry=True)
    assert Counter(r.row.text for r in carried.collect()) == Counter(t for _, t, _ in edge_rows)


def test_slots(spark, documents, edge_rows, tmp_path):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}" * (i % 50), "s") for i in range(2000)] + edge_rows
    got = slots.query(spark, documents(rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    places, loads = defaultdict(list), Counter()
    for r in got:
        places[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) == set(range(8))
    assert slots.shard(documents([])).count() == 0
    even = [(i, f"text {i} " * 20, "s") for i in range(3000)]
    loads = Counter()
    for r in slots.shard(documents(even)).collect():
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.002 * sum(loads.values())


def test_rebalance_edits_the_map(spark, documents, tmp_path):
    docs = documents([(i, f"text {i} " * (1 + i % 30), "s") for i in range(3000)])
    sizes = slots.measured(docs).groupBy("vslot").agg(F.sum("size").alias("bytes"))
    v0 = slots.first_map(spark, 4)
    v1 = slots.rebalanced(v0, sizes, 4)
    v2 = slots.rebalanced(v1, sizes, 5)
    folder = str(tmp_path / "map")
    for v in (v0, v1, v2):
        slots.write_map(v, folder)
    maps = [{r.vslot: r.shard for r in slots.read_map(spark, folder, v).collect()} for v in (0, 1, 2)]
    assert all(len(m) == slots.SLOTS for m in maps)
    assert {r.vslot: r.shard for r in slots.read_map(spark, folder).collect()} == maps[2]
    size = {r.vslot: r.bytes for r in sizes.collect()}
    moved = sum(size.get(v, 0) for v in maps[1] if maps[1][v] != maps[2][v])
    assert sum(size.get(v, 0) for v in maps[1] if maps[1][v] != maps[2][v] == 4) > 0.97 * moved
    assert abs(moved / sum(size.values()) - 1 / 5) < 0.01
    placed = slots.shard(docs, 5, slot_map=v2)
    assert placed.count() == 3000 and {r.shard for r in placed.collect()} == set(range(5))


def brute_nearest(rows, query_id):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, float)
    if query_id not in usable:
        return []
    q = usable[query_id]
    scored = [(-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 12), i) for i, v in usable.items() if i != query_id and len(v) == len(q)]
    return [i for _, i in sorted(scored)[:5]]


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.2 * rng.normal(size=16)]) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 16) for i in range(60)]  # copies, queries 2000 and 2050 among them
    bad = [[], None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(3000 + 50 * i, v) for i, v in enumerate(bad)] + [(None, [1.0] * 16), (4000, [1.0, 2.0]), (4001, [2.0, 1.0])]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.query(spark, df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    hits = total = 0
    for q in [i for i, _ in rows if i is not None and i % 50 == 0]:
        want = brute_nearest(rows, q)
        mine = [v for _, v, _ in sorted(got.get(q, []))]
        assert len(mine) == len(want) and [k for k, _, _ in sorted(got.get(q, []))] == list(range(1, len(want) + 1))
        hits += len(set(want) & set(mine))
        total += len(want)
    assert hits / total >= 0.95
    assert [v for _, v, _ in sorted(got[2050])] == [2000, 2001, 2002, 2003, 2004] and got[4000] == [(1, 4001, pytest.approx(0.8))]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.query(spark, empty).count() == 0


def test_neighbours_in_cut_buckets(spark, monkeypatch):
    """Buckets larger than a task are cut, and searches with few finds go everywhere."""
    monkeypatch.setattr(neighbours, "TASK_ROWS", 40)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * 0.05 + 1]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.query(spark, df).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert all(got[q] == brute_nearest(rows, q) for q in range(0, 400, 50))


def test_probes_come_in_order_of_cost():
    inside = np.array([0.1, 0.45, 0.8])
    shifts = neighbours.probe_sequence(inside, 27)
    costs = [sum({0: 0.0, -1: f * f, 1: (1 - f) ** 2}[int(s)] for f, s in zip(inside, shift)) for shift in shifts]
    assert costs == sorted(costs) and len({tuple(s) for s in shifts}) == 27


def naive_edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_edits(seed):
    rng = random.Random(seed)
    for _ in range(60):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert passages.edits(x, y) == naive_edits(x, y)


@pytest.mark.parametrize("seed", range(5))
def test_best_chain(seed):
    rng = random.Random(seed)
    pts = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(25)})
    a, b = (np.array(c) for c in zip(*pts))
    best = []
    for i, (x, y) in enumerate(pts):
        before = [best[j] - passages.GAP_COST * (x - u + y - v) for j, (u, v) in enumerate(pts[:i]) if u < x and v < y]
        best.append(passages.SEED_WORDS + max([0, *before]))
    found = passages.chains(a, b)
    assert sorted(i for c in found for i in c) == list(range(len(pts)))
    for c in found:
        assert all(a[i] < a[j] and b[i] < b[j] for i, j in zip(c, c[1:]))
    score = lambda c: passages.SEED_WORDS * len(c) - passages.GAP_COST * (a[c[-1]] - a[c[0]] + b[c[-1]] - b[c[0]])
    if all(max(a[j] - a[i], b[j] - b[i]) - passages.SEED_WORDS <= passages.WIDEST_GAP for c in found for i, j in zip(c, c[1:])):
        assert max(map(score, found)) <= max(best) + 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_chain_ends_of_ascending_matches(seed, monkeypatch):
    """Without the tree the same scores and predecessors."""
    rng = random.Random(seed)
    for _ in range(40):
        a, b = (sorted(rng.sample(range(600), 30)) for _ in range(2))
        plain = passages.ends_of(a, b)
        with monkeypatch.context() as m:
            m.setattr(passages, "ascending", lambda c: False)
            assert passages.ends_of(a, b) == plain


@pytest.mark.parametrize("seed", range(3))
def test_words_as_characters_give_the_same_passages(seed, monkeypatch):
    """Texts with edits, against the same steps on the words themselves, by the general chains and without diagonals."""
    rng = random.Random(seed)
    for _ in range(25):
        x = [f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 260))]
        y = [f"v{rng.randrange(9)}" if rng.random() < 0.06 else w for w in x if rng.random() > 0.04]
        y = [f"u{rng.randrange(50)}" for _ in range(rng.randint(0, 40))] + y
        a, b = passages.coded(x, y)
        assert isinstance(a, str) and len(a) == len(x) and len(b) == len(y)
        got = passages.passages_of(x, y, (0, 5, 0, 5))
        with monkeypatch.context() as m:
            m.setattr(passages, "CHARACTERS", 0)
            m.setattr(passages, "joined", lambda a, b: None)
            m.setattr(passages, "few_edits", lambda x, y, most: None)
            assert passages.coded(x, y) == (x, y)
            assert passages.passages_of(x, y, (0, 5, 0, 5)) == got
        assert passages.edits(a, b) == passages.edits(x, y) == naive_edits(x, y)


def test_passages_name_both_documents(spark, documents):
    """The ids of both sides as a pair and as a list."""
    words = " ".join(f"w{i}" for i in range(70))
    (row,) = passages.query(spark, documents([(4, "one " + words, "s"), (9, "two " + words, "s")])).collect()
    assert (row.doc_a, row.doc_b) == (row.doc_id_a, row.doc_id_b) == tuple(row.doc_ids)
    assert sorted(row.doc_ids) == [4, 9]


def test_ends_without_three_equal_words_gain_nothing(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        x, y = ([rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))] for _ in range(2))
        i, j = rng.randrange(len(x)), rng.randrange(len(y))
        for step in (1, -1):
            got = [passages.grow(x, y, i, j, step, cost) for cost in passages.EDIT_COSTS]
            with monkeypatch.context() as m:
                # Never empty, so that every end is followed.
                m.setattr(passages, "set", lambda c: type("Any", (), {"isdisjoint": lambda self, d: False})(), raising=False)
                assert got == [passages.grow(x, y, i, j, step, cost) for cost in passages.EDIT_COSTS]


def test_seeds_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    for size in (2, 5, 3000):
        texts = [" ".join(str(rng.randrange(size)) for _ in range(rng.choice([0, 4, 5, 11, 12, 13, 60, 300]))) for _ in range(40)]
        text, seed, at, near = passages.seeds_of(texts, passages.Names())
        for i, t in enumerate(texts):
            _, *alone = passages.seeds_of([t], passages.Names())
            own = text == i
            assert all((c[own] == d).all() for c, d in zip((seed, at, near), alone))
            words, k, n = t.split(), passages.SEED_WORDS, len(t.split()) - passages.SEED_WORDS + 1
            grams = [tuple(words[j : j + k]) for j in range(max(0, n))]
            # Every window of SPREAD seeds holds one, be it at another place of a row of the same seed.
            held = {grams[j] for j in at[own]}
            assert all(held & set(grams[j : j + passages.SPREAD]) for j in range(max(min(n, 1), n - passages.SPREAD + 1)))


def test_partners_of_seeds_across_batches():
    """Whatever the batches, each occurrence meets the first of its seed and the one before it."""
    rng = random.Random(9)
    rows = sorted((rng.randrange(12), rng.choice([0, 1, 2, 1 << 24]), rng.randrange(4), rng.randrange(6)) for _ in range(150))
    want = []
    for (seed, near, rid, word), last in zip(rows[1:], rows):
        first = next(r for r in rows if r[0] == seed)
        same = last[0] == seed
        meets = same and last[2] != rid and last[2:] != first[2:]
        twin = same and last[1] == near and near & ((1 << 24) - 1) != 0
        begin = first[2:] if same and first[2] != rid else (None, None)
        if meets or twin or begin[0] is not None:
            want.append((rid, word, *begin, *(last[2:] if same else (None, None)), twin, meets))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    for cut in (1, 7, 150):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + cut]), kinds)], passages.SEED_NAMES) for i in range(0, len(rows), cut)]
        got = [tuple(r.values()) for b in passages.marking(batches) for r in b.to_pylist()]
        assert got == want


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_seeds_unpacked_are_the_repeated_ones(limit, monkeypatch):
    """Beyond the limit single ones come along; no repeated one is lost in either case."""
    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(40)) for _ in range(rng.randrange(60))) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(-25, 25), pa.int64()), pa.array(texts)], ["rid", "text"])
    text, seed, at, near = passages.seeds_of(texts, passages.Names())
    rows = Counter(zip(passages.mix(seed).view(np.int64).tolist(), near.view(np.int64).tolist(), (text - 25).tolist(), at.tolist()))
    count = Counter(r[0] for r in rows.elements())
    parts = defaultdict(list)
    monkeypatch.setattr(passages, "PACK_SEEDS", 100)
    for b in passages.seeding(3)([batch]):
        for r in range(b.num_rows):
            parts[b.column(0)[r].as_py()].append(b.slice(r, 1))
    monkeypatch.setattr(passages, "PART_SEEDS", limit)
    got = Counter(tuple(r.values()) for p in parts.values() for b in passages.unpacking(p) for r in b.to_pylist())
    repeated = Counter({r: n for r, n in rows.items() if count[r[0]] > 1})
    assert len(parts) == 3 and repeated <= got <= rows
    assert limit == 10 or got == repeated


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_seeds_meet_where_they_are_unpacked(limit, monkeypatch):
    """A part's worker finds the partners itself; beyond the limit it hands the seeds on, which are then sorted and marked."""
    rng = random.Random(4)
    seeds = sorted((rng.randrange(20), rng.choice([0, 1, 1 << 24]), rng.randrange(4), rng.randrange(6)) for _ in range(200))
    kinds = [np.uint64, np.uint64, np.int64, np.uint32]
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(np.array(c, k)) for c, k in zip(zip(*rows), passages.SEED_KINDS)], passages.SEED_NAMES)
    want = Counter(tuple(r.values()) for b in passages.marking([as_batch(seeds)]) for r in b.to_pylist())
    pack, rows = zstandard.ZstdCompressor(1).compress, []
    for i in range(3):
        seed, near, rid, word = (np.array(c, k) for c, k in zip(zip(*seeds[i::3]), kinds))
        rows.append(passages.packed_seeds(rid, seed, word, near, pack))
    packed = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], passages.PACKED)
    monkeypatch.setattr(passages, "PART_SEEDS", limit)
    out = [r for b in passages.unpacking([packed], met=True) for r in b.to_pylist()]
    names = [c.split()[0] for c in passages.MARKED.split(", ")]
    done = Counter(tuple(r[c] for c in names) for r in out if r["seed"] is None)
    rest = sorted(tuple(r[c] for c in passages.SEED_NAMES) for r in out if r["seed"] is not None)
    assert (rest == seeds and not done) if limit == 10 else (not rest and done == want)


def test_text_beside_its_chains_is_cut_for_each_of_them():
    """One row per text and lot of chains becomes one row per chain, with the words around it."""
    words = [f"w{i}" for i in range(400)]
    packed = zstandard.ZstdCompressor(1).compress(" ".join(words).encode())
    chain = lambda a, e: {"b": a, "a_word": a, "a_end": e, "b_word": 1, "b_end": 2}
    kind = pa.list_(pa.struct([("b", pa.int64()), *((c, pa.int32()) for c in ("a_word", "a_end", "b_word", "b_end"))]))
    lots = pa.array([[chain(5, 50), chain(100, 200)], [chain(390, 400)]], kind)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7]), lots, pa.array([3, 3]), pa.array([packed] * 2, pa.binary())], ["a", "chains", "doc_id", "packed"])
    (out,) = passages.cutting([batch])
    got = [(r["a"], r["b"], r["a_word"], r["doc_id"], r["part"].split(" ")) for r in out.to_pylist()]
    assert got == [(7, 5, 5, 3, words[:110]), (7, 100, 100, 3, words[40:260]), (7, 390, 390, 3, words[330:])]


def test_passages(spark, documents, edge_rows):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    text = lambda n: [word() for _ in range(n)]
    exact, fuzzy, short = text(60), text(80), text(45)
    rows = []
    for i in range(12):
        own = list(fuzzy)
        for k in rng.sample(range(80), 5):
            own[k] = word()
        if i % 2:
            del own[40]
        body = text(30) + (exact if i < 6 else own) + text(20) + short + text(15 + i)
        rows.append((i, " ".join(body), "s"))
    rows += [(50, " ".join(text(300)), "s"), (51, "ding " * 500, "s"), (52, "ding " * 400, "s")]
    got = passages.query(spark, documents(rows + edge_rows)).collect()
    sides = [(r.doc_a, r.doc_b) for r in got]
    linked = defaultdict(set)
    for a, b in sides:
        linked[a].add(b), linked[b].add(a)

    def reachable(start, among):
        seen, todo = {start}, [start]
        while todo:
            for x in linked[todo.pop()] & among - seen:
                seen.add(x), todo.append(x)
        return seen

    assert reachable(0, set(range(6))) == set(range(6))
    assert reachable(6, set(range(6, 12))) == set(range(6, 12))
    assert 50 not in linked and {51, 52} <= set(linked) and 5 in linked[4]
    words = {i: (t or "").lower().split() for i, t, _ in rows}
    for r in got:
        if r.doc_a in words and r.doc_b in words:
            x, y = words[r.doc_a][r.a_start : r.a_end], words[r.doc_b][r.b_start : r.b_end]
            assert min(len(x), len(y)) >= 50 and r.edits == passages.edits(x, y) and r.identity >= 0.8
    assert passages.repeated_passages(documents([])).count() == 0


def test_exact_passage_of_frequent_lines(spark, documents):
    """Every seed of the passage is frequent in texts that do not hold it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    lines = [" ".join(word() for _ in range(13)) for _ in range(24)]
    mixed = lambda: rng.sample(lines, 24)
    # 49 + 1 words: four lines but two words, and no more in common on either side.
    held = " ".join(lines[:4]).split()[2:]
    with_it = lambda: " ".join([word() for _ in range(10)] + held + [word() for _ in range(10)] + mixed())
    holders = {i: with_it() for i in (3, 77, 150, 222, 290)}
    rows = [(i, holders.get(i) or " ".join(mixed()), "s") for i in range(300)]
    got = passages.query(spark, documents(rows)).collect()
    linked = defaultdict(set)
    for r in got:
        if r.doc_a in holders and r.doc_b in holders and r.a_start <= 10 and r.b_start <= 10:
            linked[r.doc_a].add(r.doc_b), linked[r.doc_b].add(r.doc_a)
    seen, todo = {3}, [3]
    while todo:
        new = linked[todo.pop()] - seen
        seen |= new
        todo += new
    assert seen == set(holders)


def test_copies_are_one_class(spark, documents):
    """Hundreds of copies of two texts that share a passage: each copy meets the least id of its class, the classes each other."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = text(60)
    one, two = text(40) + " " + shared, shared + " " + text(45)
    rows = [(i, one, "s") for i in range(300)] + [(1000 + i, two, "s") for i in range(300)] + [(7, one, "s")] * 50 + [(None, two, "s")] * 2 + [(5000 + i, "too short", "s") for i in range(9)]
    got = Counter((r.doc_a, r.doc_b, r.a_end - r.a_start, r.edits) for r in passages.query(spark, documents(rows)).collect())
    want = [(0, i, 100, 0) for i in range(1, 300)] + [(1000, i, 105, 0) for i in [*range(1001, 1300), None]]
    between = [k for k in got if {k[0], k[1]} == {0, 1000}]
    assert len(between) == 1 and between[0][2:] == (60, 0)
    assert got == Counter(want) + Counter(between)


def test_passages_with_mixed_edits(spark, documents):
    """Replaced, inserted and deleted words, about one in eight, anywhere in 60 to 120 words."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    text = lambda n: [word() for _ in range(n)]
    rows, n = [], 0
    while n < 30:
        one = text(60 + 20 * (n % 4))
        other = []
        for w in one:
            kind = rng.random()
            other += [w] if kind > 0.12 else [word()] if kind > 0.08 else [word(), w] if kind > 0.04 else []
        cost = passages.edits(one, other)
        if len(other) >= 50 and cost >= len(one) // 12 and 1 - cost / max(len(one), len(other)) >= 0.8:
            rows += [(2 * n, " ".join(text(80) + one + text(90)), "s"), (2 * n + 1, " ".join(text(70) + other + text(100)), "s")]
            n += 1
    got = passages.query(spark, documents(rows)).collect()
    assert all(r.doc_a // 2 == r.doc_b // 2 for r in got)
    assert len({r.doc_a // 2 for r in got}) >= 28
    words = {i: t.split() for i, t, _ in rows}
    for r in got:
        x, y = words[r.doc_a][r.a_start : r.a_end], words[r.doc_b][r.b_start : r.b_end]
        assert min(len(x), len(y)) >= 50 and r.edits == passages.edits(x, y) and r.identity >= 0.8


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    kinds = zip(ok, (EMAIL, IP, CARD, PHONE))
    return [(k, m.start(), m.end()) for k, p in kinds for m in p.finditer(t) if ok[k](m.group())]


TRICKY = [
    "a@b.c d@e a.b@c.d..e@f.g x@y.z+q@r.s @p.q a@@b.c",
    "😀 é jo.do+x@mail-1.example.com, 1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.1 1.2.3 1.2.3.4444",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111 1111 1111 1111",
    "12  4111 1111 1111 1111-- 7 4111111111111111 - 4242424242424242",
    "+1 (262) 555-3752 +12 +1(2)3 ++44 20 7946 0958. +1 234 5678-9 +123456789012345678",
    "9" * 3000 + " " + "1 2-3 4" * 300 + " a@" + "b." * 40 + "c",
    "." * 500 + "@" + "-" * 300 + ".a " + "1." * 800,
]


def test_personal_data(spark, documents, edge_rows):
    rows = [(100 + i, t, "s") for i, t in enumerate(TRICKY)] + edge_rows
    rows += [(200 + i, f"some words, call +1 ({200 + i}) 555-{1000 + i} or mail u{i}@x{i}.org from 10.0.{i}.7 now", "s") for i in range(30)]
    got = pii.query(spark, documents(rows)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t or "")
    import hashlib

    for r in got:
        wants = [base_spans(t) for t in texts[r.doc_id]]
        lists = [",".join(f"{k}:{a}:{b}" for k, a, b in w) for w in wants]
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in lists]
        assert r.base_sha256 in sums
        own = wants[sums.index(r.base_sha256)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in own) for n in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(r.spans.split(","))
    assert pii.personal_data(documents([])).count() == 0


def test_learnt_spans_and_redaction(spark, documents):
    rows = [(i, f"please call +1 ({200 + i}) 555-{1000 + i} today, item {i}", "s") for i in range(60)]
    rows += [(100, "please call (262) 555-3752 today", "s"), (101, "release 4.0 of page 17", "s"), (102, None, "s"), (103, "Ω a@b.co 1.2.3.4!", "s")]
    docs = documents(rows)
    found = pii.find(docs, pii.train(docs), "doc_id").withColumn("new", pii.redacted(F.col("text"), F.col("spans")))
    new = {r.doc_id: r.new for r in found.collect()}
    assert new[100] == "please call <PHONE> today" and new[101] == "release 4.0 of page 17" and new[102] == ""
    assert new[103] == "Ω <EMAIL> <IP>!" and new[5] == "please call <PHONE> today, item 5"


def test_boosting_separates_cells():
    x = np.array([[k, d, 0, s, 0, 1, 0, 0] for k in range(4) for d in range(8) for s in (0, 1)])
    yes = np.where((x[:, 1] > 4) & (x[:, 3] == 1) & (x[:, 0] < 3), 50.0, 0)
    model = pii.boost(x, yes, 50 - yes)
    score = model["bias"] + sum(pii.value(t, x) for t in model["trees"])
    assert (score[yes > 0] > 0).all() and (score[yes == 0] < 0).all()
    assert model["least"][3] == 2.0 and model["least"][0] < 1


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        body = text(40) + (" awful fool" if toxic else "") + f" mail me{i}@host.org "
        rows.append((i, body, "en", f"src{i % 3}", len(body)))
        labels.append((i, 1, int(toxic)))
    copy = rows[1][1]
    rows += [(300, copy, "en", "src1", len(copy)), (301, None, None, None, None), (302, "", "en", "src0", 0)]
    rows += [(303, text(3000), "en", "src2", 1), (None, "a text without any id", "en", "src2", 5), (None, "a text without any id", "en", "src2", 5)]
    folder = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    assert [f for _, f in corpus_pipeline.STAGES[:1]] == [corpus_pipeline.remove_toxic]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.schema == docs.schema
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        kept.append({r.doc_id: r for r in now.collect()})
    clean = {i for i in range(160) if i % 4} | {300, 301, 302, 303, None}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - {300, 302}  # a copy, and an empty text beside a null one
    assert kept[2][2].text.endswith("<EMAIL> ") and kept[2][2].n_chars == len(kept[2][2].text) and kept[2][301].text is None
    assert set(kept[3]) == set(kept[2])
    packed = corpus_pipeline.pack(spark, now, folder).collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    files = sorted({r.f for r in now.select(F.col("_metadata.file_name").alias("f")).collect()})
    place = {r.doc_id: (files.index(r.f), r.i) for r in now.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()}
    turn = {r.row.doc_id: (r.turn, r.start) for r in mixing.mix(spark.read.parquet(f"{folder}/personal_data"), carry=True).collect()}
    assert sorted(place, key=place.get) == sorted(place, key=turn.get)
    first = {}
    for r in packed:
        first[r.sequence_id] = min(first.get(r.sequence_id, (9, 9, 9)), (*place[r.doc_id], r.piece))
    assert sorted(first, key=first.get) == sorted(first)
    run = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.length) for r in run.collect()) == Counter((r.doc_id, r.piece, r.length) for r in packed)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_personal_data_proposals_by_brute_force(spark, documents):
    """Proposals are the generators' matches that meet no base span, at the places where they match."""
    rng = random.Random(3)
    bits = ["+", "1", "22", "4444", " ", "-", ".", "@", "a", "ex.org", "(", ")", "[at]", " dot ", "phone: ", "4111 1111 1111 1111"]
    bits += ["  ", "10.0.0.1", "+44 20 7946 0958", "ü", "😀", "\n", "0"]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randrange(120))) for i in range(300)}
    for r in pii.candidates(documents([(i, t, "src0") for i, t in texts.items()]), "doc_id").collect():
        want = []
        for k, name in enumerate(pii.KINDS):
            for m in re.finditer(pii.MORE[name], r.text):
                if (name != "email" or re.search(pii.EMAIL_SIGN, r.text)) and not any(b.start < m.end() and m.start() < b.stop for b in r.base):
                    want.append((k, *m.span()))
        got = [(p.kind, p.start, p.stop) for p in r.proposed]
        assert got[len(got) - len(want) :] == want


def test_personal_data_of_a_text_with_20000_matches(spark, documents):
    text = " ".join(f"host 10.1.{i % 250}.{i // 250 % 250} mail user{i}@ex.org" for i in range(10_000))
    got = pii.personal_data(documents([(1, text, "src0"), (2, "nothing", "src0")])).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (10_000, 10_000, 0, 0)
    where = [("email", m) for m in re.finditer(r"user[0-9]+@ex\.org", text)] + [("ip", m) for m in re.finditer(r"10\.1\.[0-9]+\.[0-9]+", text)]
    want = ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in where)
    assert one.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
