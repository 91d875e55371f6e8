"""Toxicity scores from a factorization machine over hashed terms."""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.llm.common import release

# Rows that the model is fitted on at most: labelled documents in the order of a hash of their id.
TRAIN_ROWS = 20_000
BITS = 18
# Hashed terms that enter the model by themselves: those whose rate among toxic documents is so many deviations off.
DEVIATIONS = 4.0
# Terms that are also tried in pairs, the most frequent ones of toxic documents; and the log likelihood ratio at which the
# toxic documents with both terms are not what the single terms expect. It outweighs the number of pairs tried.
PAIR_TERMS = 3072
EVIDENCE = 20.0
# Rows whose terms are unfolded at a time for it, and terms whose pairs with all others are counted at a time.
FOLD = 1024
STRIP = 512
FACTORS = 8
EPOCHS = 30
THRESHOLD = 0.3
# Words that a task remembers at most.
CACHE = 500_000

WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> set[int]:
    """Hashed terms of a lower-case word: itself and its beginnings of four and five letters."""
    names = {word, word[:4] + "*", word[:5] + "*"}
    return {zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names}


def hashed(batches):
    """(doc_id, label, text) to (doc_id, label, terms), the terms as 32-bit numbers."""
    for batch in batches:
        out = []
        for text in batch.column(2):
            ids = set().union(*map(terms, set(WORD.findall(text.as_py().lower()))))
            out.append(np.array(sorted(ids), np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["doc_id", "label", "terms"])


def counts(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each hashed term is; some rows at a time, so that the terms are never copied at once."""
    out = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(rows), FOLD):
        out += np.bincount(np.concatenate(rows[start : start + FOLD]), minlength=1 << BITS)
    return out


def chosen(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Hashed terms whose rate differs between the labels by `DEVIATIONS` or more, in ascending order."""
    count = [counts([r for r, y in zip(rows, labels) if y == v]) for v in (0, 1)]
    n = [max(1, int((labels == v).sum())) for v in (0, 1)]
    share = (count[0] + count[1] + 1) / (n[0] + n[1] + 2)
    z = (count[1] / n[1] - count[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    return np.flatnonzero((np.abs(z) >= DEVIATIONS) & (count[0] + count[1] >= 3))


def flat(rows: list[np.ndarray]):
    """Rows of indices as one array with starts; every row ends with index 0, a feature that is always on."""
    ends = np.cumsum([len(r) + 1 for r in rows])
    return np.concatenate([np.append(r, 0) for r in rows]).astype(np.int64), np.concatenate([[0], ends[:-1]]).astype(np.int64)


def logits(w: np.ndarray, v: np.ndarray, at: np.ndarray, starts: np.ndarray):
    """w + pairwise products of the factors; the always-on feature 0 has no factors."""
    sums = np.add.reduceat(v[at], starts, axis=0)
    squares = np.add.reduceat(v[at] ** 2, starts, axis=0)
    return np.add.reduceat(w[at], starts) + 0.5 * (sums**2 - squares).sum(1), sums


def paired(rows: list[np.ndarray], labels: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Hashed terms of pairs that say more than `expected`, the chance by single terms, in ascending order.

    For each pair of the PAIR_TERMS terms: toxic documents that hold both against the sum of their chances, as Poisson counts.
    So a term enters that is equally frequent in both labels, if some other term beside it tells them apart. The pairs of STRIP
    terms are counted at a time, as this runs on the driver.
    """
    count = counts([r for r, y in zip(rows, labels) if y])
    ids = np.sort(np.argsort(-count, kind="stable")[:PAIR_TERMS])
    ids = ids[count[ids] > 0]
    place = np.full(1 << BITS, -1, np.int16)
    place[ids] = np.arange(len(ids))
    kept = [p[p >= 0] for p in (place[r] for r in rows)]
    strong = np.zeros(len(ids), bool)
    for low in range(0, len(ids), STRIP):
        strip = slice(low, min(low + STRIP, len(ids)))
        seen, hoped = (np.zeros((strip.stop - low, len(ids)), np.float32) for _ in range(2))
        for start in range(0, len(rows), FOLD):
            part = kept[start : start + FOLD]
            on = np.zeros((len(part), len(ids)), np.float32)
            on[np.repeat(np.arange(len(part)), [len(p) for p in part]), np.concatenate(part)] = 1
            toxic = on[labels[start : start + FOLD] == 1]
            seen += toxic[:, strip].T @ toxic
            hoped += (on[:, strip] * expected[start : start + FOLD, None].astype(np.float32)).T @ on
        for i in range(len(seen)):
            k, mean = seen[i].astype(float), np.maximum(hoped[i], 1e-9)
            ratio = k * np.log(np.maximum(k, 1e-9) / mean) - k + mean
            ratio[low + i] = 0
            strong[low + i] = ratio.max() >= EVIDENCE
    return ids[strong]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> dict:
    """A machine over the terms that tell labels apart by themselves, then one that has the terms of telling pairs as well.

    A sample of one label or none gives a constant score.
    """
    if len(rows) == 0 or labels.min() == labels.max():
        rate = (labels.sum() + 0.0) / max(1, len(labels))
        bias = 30.0 * (2 * rate - 1) if len(rows) else -30.0
        return {"ids": np.zeros(0, np.int64), "w": np.array([bias]), "v": np.zeros((1, FACTORS))}
    single = descend(rows, labels, chosen(rows, labels), seed)
    place = placed(single["ids"])
    # A part of the sample at a time, so that the factors of all its terms are never held at once.
    z = [logits(single["w"], single["v"], *flat(known(rows[i : i + FOLD], place)))[0] for i in range(0, len(rows), FOLD)]
    ids = np.union1d(single["ids"], paired(rows, labels, 1 / (1 + np.exp(-np.clip(np.concatenate(z), -40, 40)))))
    return single if len(ids) == len(single["ids"]) else descend(rows, labels, ids, seed)


def placed(ids: np.ndarray) -> np.ndarray:
    """For every hashed term its place in the model from 1, or 0."""
    place = np.zeros(1 << BITS, np.int32)
    place[ids] = np.arange(1, len(ids) + 1)
    return place


def known(rows: list[np.ndarray], place: np.ndarray) -> list[np.ndarray]:
    return [p[p > 0] for p in (place[r] for r in rows)]


def descend(rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, seed: int) -> dict:
    """Weights of the terms `ids` by AdaGrad on the log loss."""
    rows = known(rows, placed(ids))
    rng = np.random.default_rng(seed)
    w = np.zeros(len(ids) + 1)
    v = rng.normal(0, 0.02, (len(ids) + 1, FACTORS))
    v[0] = 0
    rate = labels.mean()
    w[0] = np.log(rate / (1 - rate))
    gw, gv = np.full_like(w, 1e-2), np.full_like(v, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(order) // 256)):
            at, starts = flat([rows[i] for i in part])
            z, sums = logits(w, v, at, starts)
            err = 1 / (1 + np.exp(-z)) - labels[part]
            sizes = np.diff(np.append(starts, len(at)))
            each = np.repeat(err, sizes)
            dw = np.bincount(at, each, len(w)) + 1e-3 * w
            dv = np.zeros_like(v)
            np.add.at(dv, at, each[:, None] * (np.repeat(sums, sizes, axis=0) - v[at]))
            dv += 1e-3 * v
            dv[0] = 0
            gw += dw**2
            gv += dv**2
            w -= 0.2 * dw / np.sqrt(gw)
            v -= 0.05 * dv / np.sqrt(gv)
    return {"ids": ids, "w": w, "v": v}


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Fit on at most `rows` labelled documents, the first in the order of a hash of their id.

    The sample of labels has a fixed bound, so it is broadcast and no text is shuffled; the driver gets hashed
    terms of the sample only. Of an id that repeats with different texts one text is learnt from, the least by a hash.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # A threshold on the hash leaves few more rows than wanted, so that the cut to `rows` stays small work.
    share = min(1.0, (1.2 * rows + 100) / max(1, marked.count()))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = drawn.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label")), "doc_id")
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    # An id counts once, however many rows repeat it: its least text by hash is reduced to before anything is collected.
    own = texts.mapInArrow(hashed, "doc_id long, label int, terms binary")
    got = own.groupBy("doc_id", "label").agg(F.min_by("terms", F.struct(F.xxhash64("terms"), "terms")).alias("terms")).select("label", "terms").toArrow()
    # Views of what came, without a copy of each row.
    data = [np.frombuffer(b.as_buffer(), np.uint32) for b in got.column("terms")]
    y = np.array(got.column("label").to_pylist(), float)
    # The order in which tasks end must not change the model.
    order = sorted(range(len(data)), key=lambda i: (zlib.crc32(data[i].tobytes()), y[i]))
    model = fit([data[i] for i in order], y[order])
    # The sample is not needed any more; what the driver freed of it would stay with the process.
    del data, got
    release()
    return model


def scores(texts: list[str], model: dict, place: dict, cache: dict) -> np.ndarray:
    rows = []
    for text in texts:
        on: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            got = cache.get(word)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = cache[word] = tuple(place[t] for t in terms(word) if t in place)
            if got:
                on.update(got)
        rows.append(np.array(sorted(on), np.int64))
    z = logits(model["w"], model["v"], *flat(rows))[0] if rows else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def scorer(shared, text_at: int, pick):
    """Batches through `pick(batch, scores)`."""

    def run(batches):
        model = shared.value
        place = {int(t): i + 1 for i, t in enumerate(model["ids"])}
        cache: dict[str, tuple] = {}
        for batch in batches:
            yield pick(batch, scores([t.as_py() or "" for t in batch.column(text_at)], model, place, cache))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """`doc_id, score`; every document, whole texts, a null text as the empty one.

    The score is a function of the text alone. Null ids and repeated rows are kept as they are; further columns
    are ignored. The model's size is bounded by the number of hashed terms.
    """

    def pick(batch, found):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(model), 1, pick), "doc_id long, score double")


def below(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns and no other."""

    def pick(batch, found):
        return batch.filter(pa.array(found < threshold))

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(scorer(shared, docs.columns.index("text"), pick), docs.schema)


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
