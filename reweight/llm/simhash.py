"""SimHash fingerprints and their near-duplicate classes, candidates pruned by pigeonring chains."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.llm.common import components, reliable

# Fixed values of the contract.
SHINGLE = 3
MAX_BITS = 3
HASH_SEED = 42
# Eight segments of eight bits on a ring. Of any two fingerprints within 3 bits, some chain of segments starts so
# that its first l segments differ in at most l * 3 / 8 bits, for each l: the first two are equal, and the next
# three differ in one bit at most, so two of them are equal as well.
SEGMENTS = 8
BUDGET = [MAX_BITS * length // SEGMENTS for length in range(1, SEGMENTS + 1)]
# Runs of one key up to this size are compared by shifts of a batch, then by blocks, beyond the last size by
# looking up every neighbour within 3 bits; all three are exact.
SHIFTED = 64
PAIRED = 100_000
WORDS = 1 << 16


def fingerprint(text: str) -> int:
    """Bits that more than half of the shingles' hashes have; zero for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    begins, ends = starts[: 1 - SHINGLE].tolist(), (starts + sizes)[SHINGLE - 1 :].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in zip(begins, ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), WORDS):
        part = hashes[i : i + WORDS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def hash_texts(batches):
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column(1)]
        fps = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])


def chain_keys(fp: str = "fp"):
    """24 keys: the start of the chain, its two first segments, and two of the next three."""
    segment = [F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255)) for i in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        ring = [segment[(start + i) % SEGMENTS] for i in range(5)]
        for left_out in (2, 3, 4):
            key = F.lit(3 * start + left_out - 2).cast("long")
            for i in range(5):
                if i != left_out:
                    key = F.shiftleft(key, 8).bitwiseOR(ring[i])
            keys.append(key)
    return F.array(*keys)


def linked(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences stay within the budgets of a chain from `start`, the last one being the full distance."""
    ok = np.ones(len(x), bool)
    parts = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(-1, SEGMENTS))
    total = np.zeros(len(x), np.int64)
    for i, most in enumerate(BUDGET[:-1]):
        total += parts[np.arange(len(x)), (start + i) % SEGMENTS]
        ok &= total <= most
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def least_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For 0..n-1 joined by pairs, the least index that each is connected with."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def wide_run(fps: np.ndarray, start: int) -> np.ndarray:
    """Least labels of a run of equal keys."""
    n = len(fps)
    label = np.arange(n)
    if n <= PAIRED:
        step = max(1, (1 << 20) // n)
        for i in range(0, n, step):
            x = (fps[i : i + step, None] ^ fps[None, :]).ravel()
            at = np.flatnonzero(linked(x, np.full(len(x), start)))
            label = least_labels(n, i + at // n, at % n, label)
        return label
    # Every link's first two segments are equal, so 48 bits are free; distances of links are at most 3.
    order = np.argsort(fps)
    sorted_fps = fps[order]
    free = [8 * ((start + i) % SEGMENTS) + b for i in range(2, SEGMENTS) for b in range(8)]
    for k in (1, 2, 3):
        for bits in combinations(free, k):
            target = sorted_fps ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(sorted_fps, target), n - 1)
            hit = np.flatnonzero(sorted_fps[at] == target)
            if len(hit):
                label = least_labels(n, order[hit], order[at[hit]], label)
    return label


def links(batches):
    """(key, fp) sorted by key to (a, b): each fingerprint's link to the least it is connected with in its run."""

    def edges(fps, label):
        at = np.flatnonzero(label != np.arange(len(label)))
        cols = [pa.array(fps[at].view(np.int64)), pa.array(fps[label[at]].view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["a", "b"])

    def solve(keys, fps):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        sizes = np.diff(np.append(starts, len(keys)))
        chain = ((keys >> 32) // 3).astype(np.int64)
        small = np.repeat(sizes <= SHIFTED, sizes)
        pairs_a, pairs_b = [], []
        for d in range(1, min(SHIFTED, int(sizes.max()))):
            at = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
            at = at[linked(fps[at] ^ fps[at + d], chain[at])]
            pairs_a.append(at)
            pairs_b.append(at + d)
        label = np.arange(len(keys))
        if pairs_a:
            label = least_labels(len(keys), np.concatenate(pairs_a), np.concatenate(pairs_b))
        for s, n in zip(starts[sizes > SHIFTED], sizes[sizes > SHIFTED]):
            label[s : s + n] = s + wide_run(fps[s : s + n], int(chain[s]))
        return edges(fps, label)

    held_k, held_f = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy().view(np.uint64)
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (len(held_k[-1]) and held_k[-1][-1] != keys[0]):
            whole_k, whole_f = np.concatenate([*held_k, keys[:last]]), np.concatenate([*held_f, fps[:last]])
            if len(whole_k):
                yield solve(whole_k, whole_f)
            held_k, held_f = [], []
        held_k.append(keys[last:])
        held_f.append(fps[last:])
    keys, fps = np.concatenate(held_k), np.concatenate(held_f)
    if len(keys):
        yield solve(keys, fps)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, fp, component_id`: documents linked by fingerprints that differ in 3 bits or fewer.

    `docs` needs `doc_id LONG, text`; further columns are ignored. Texts without words, null texts among them,
    have fingerprint zero and are linked like any other. Rows are kept one for one; a null id never names a
    component unless it has no other. Copies collapse to their fingerprint before anything is paired; runs of one
    key give a forest, never all pairs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = reliable(texts.mapInArrow(hash_texts, "doc_id long, fp long"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    keys = classes.select(F.explode(chain_keys()).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    joined = components(keys.mapInArrow(links, "a long, b long"))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = near_duplicates(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
