"""Document fingerprints by locally consistent parsing (deterministic coin tossing)."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.llm.common import tasks_for

# Phrases of a fingerprint, and the hexadecimal digits kept of each one's rank.
KEPT = 64
DIGITS = 10
# Levels whose phrases (about 9 and 27 bytes) count. Shorter ones say little about a text; a longer one depends on so
# much around it that texts with long passages in common share few. A text that ends in one phrase earlier has that one.
LEVELS = (2, 3)
CHUNK_BYTES = 1 << 20
MAX_BUCKETS = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)
BYTE_NAMES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * STEP)
PLACES = mix(np.arange(64, dtype=np.uint64) * STEP + np.uint64(7))


def tossed(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a symbol differs from the one before it, plus that bit: neighbours stay different."""
    before = np.empty_like(s)
    before[0] = 0
    before[1:] = s[:-1]
    x = s ^ before
    bit = np.bitwise_count((x & -x) - x.dtype.type(1))
    label = (bit << 1) | ((s >> bit.astype(s.dtype)) & s.dtype.type(1)).astype(np.uint8)
    label[first] = 0
    return label


def level(symbols: np.ndarray, names: np.ndarray, doc: np.ndarray, size: np.ndarray):
    """One level of the parse: equal neighbours are gathered, then blocks begin at local maxima of small labels.

    Whether a block begins depends on a few symbols to either side only, so equal substrings are cut alike but at
    their ends, wherever they stand. Returns the blocks' names, documents and sizes.
    """
    new = np.empty(len(symbols), bool)
    new[0] = True
    new[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(symbols)))
    s, d, name = symbols[at], doc[at], names[at]
    size = np.add.reduceat(size, at)
    many = runs > 1
    name[many] = mix(name[many] + runs[many].astype(np.uint64) * STEP)
    first = np.empty(len(s), bool)
    first[0] = True
    first[1:] = d[1:] != d[:-1]
    label = tossed(tossed(s, first), first)  # below 14
    begin = first.copy()
    # The last symbol of a text never begins a block of its own, whatever text stands behind it.
    begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    at = np.flatnonzero(begin)
    place = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    block = np.add.reduceat(mix(name + PLACES[place & 63]), at)
    return mix(block + STEP), d[at], np.add.reduceat(size, at)


def fingerprints(texts: list[str]) -> list[list[int]]:
    """The KEPT least ranks of each text's phrases, ascending.

    The rank of a phrase is an exponential variable of its name with a rate of its length, so a phrase is kept with
    a chance in proportion to the text that it covers, and kept in every text that has it or in none.
    """
    out: list[list[int]] = [[] for _ in texts]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return out
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    symbols, names, size = data, BYTE_NAMES[data], np.ones(len(data), np.int64)
    parts = []
    depth = 0
    while len(symbols):
        names, doc, size = level(symbols, names, doc, size)
        symbols = names
        depth += 1
        alone = np.ones(len(doc), bool)
        alone[1:] &= doc[1:] != doc[:-1]
        alone[:-1] &= doc[1:] != doc[:-1]
        counts = slice(None) if depth in LEVELS else alone
        parts.append((doc[counts], names[counts], size[counts]))
        more = ~alone
        symbols, names, doc, size = symbols[more], names[more], doc[more], size[more]
        if depth == LEVELS[-1]:
            break
    doc, name, size = (np.concatenate(c) for c in zip(*parts))
    u = ((mix(name ^ STEP) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    rank = (-np.log(u) / size).view(np.uint64) >> np.uint64(64 - 4 * DIGITS)
    order = np.lexsort((rank, doc))
    doc, rank = doc[order], rank[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rank[1:] != rank[:-1])
    doc, rank = doc[new], rank[new]
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.append(starts[1:], len(doc))
    for i, a, b in zip(doc[starts].tolist(), starts.tolist(), ends.tolist()):
        out[i] = rank[a : min(b, a + KEPT)].tolist()
    return out


def likeness(a: list[int], b: list[int]) -> float:
    """The share of common phrases among the least ranked of both texts; two empty texts are alike."""
    x, y = set(a), set(b)
    least = sorted(x | y)[: min(KEPT, max(len(x), len(y)))] if max(len(x), len(y)) == KEPT else sorted(x | y)
    return sum(r in x and r in y for r in least) / len(least) if least else 1.0


def as_text(ranks: list[int]) -> str:
    return "".join(f"{r:0{DIGITS}x}" for r in ranks)


def compared(batches):
    """(bucket, donor, doc_id, text), sorted, to one row for each row that is no donor, beside the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows():
        for batch in batches:
            for b, donor, i, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                yield b, donor, i, text.as_py()

    def solved(units, texts):
        edited = []
        for _, at, after in units:
            own = texts[at]
            half = len(own) // 2
            edited.append(own[: len(own) - half] + texts[after][:half])
        fps = fingerprints(texts + edited)
        out = []
        for (i, at, after), new, fp in zip(units, edited, fps[len(texts) :]):
            own = fps[at]
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((i, len(texts[at]), sha, as_text(own), as_text(fp), likeness(own, fp), likeness(own, fps[after])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    units, texts, total = [], [], 0
    bucket, donor, doc_id = None, True, None
    for b, is_donor, i, text in rows():
        if b != bucket or donor:  # nothing before it waits for this row
            if b == bucket:
                continue
        else:
            units.append((doc_id, len(texts) - 1, len(texts)))
        texts.append(text)
        total += len(text)
        if total > CHUNK_BYTES and units:
            yield solved(units, texts)
            units, texts, total = [], [text], len(text)
        bucket, donor, doc_id = b, is_donor, i
    if units:
        yield solved(units, texts)


def next_texts(docs: DataFrame) -> DataFrame:
    """`bucket, donor, doc_id, text`, each bucket a range of ids in one task, in order, with the row after it at its end.

    Cut points are quantiles of the ids, at most MAX_BUCKETS numbers; the first row of a bucket is also sent to the
    bucket before it. So one shuffle of the texts brings every document beside its successor.
    """
    least = -(1 << 63)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("at"),
    )
    want = min(MAX_BUCKETS, 8 * tasks_for(docs))
    cuts = rows.agg(F.percentile_approx("at", [i / want for i in range(1, want)], 10 * want).alias("c")).first()["c"] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]

    def cut(df):
        if len(splits) < 3:
            return df.withColumn("own", F.lit(0))
        cutter = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="error")
        return cutter.transform(df.withColumn("__x", F.col("at").cast("double"))).withColumn("own", F.col("__b").cast("int")).drop("__x", "__b")

    firsts = cut(rows.select("at")).groupBy("own").agg(F.min("at").alias("first")).orderBy("own").collect()
    pairs = [(r["first"], firsts[i - 1]["own"]) for i, r in enumerate(firsts)]
    donors = docs.sparkSession.createDataFrame(pairs, "at long, before int")
    bucket = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("donor"))
    also = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("donor"))
    both = cut(rows).join(F.broadcast(donors), "at", "left").withColumn("to", F.when(F.col("before").isNull(), F.array(bucket)).otherwise(F.array(bucket, also)))
    both = both.select(F.explode("to").alias("to"), "doc_id", "at", "text").select("to.bucket", "to.donor", "doc_id", "at", "text")
    parts = both.repartition(tasks_for(docs), "bucket")
    return parts.sortWithinPartitions("bucket", "donor", "at", F.xxhash64("text")).select("bucket", "donor", "doc_id", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to the edited and the next text.

    `docs` needs `doc_id LONG, text`; further columns are ignored. A null text is empty; an empty text has an empty
    fingerprint, alike to another empty one (1) and to nothing else (0). Null ids come first in the order of
    documents, equal ids in the order of a hash of their text; repeated rows each have a row. The document after
    the last is the first, for a single document itself.
    """
    return next_texts(docs).mapInArrow(
        compared,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return fingerprint(docs)
