"""Packing token ids into sequences: dominance reduction on size classes, then best fit."""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reweight.llm.common import reliable

MODEL = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
CHUNK_BITS = 14
# A string of at most 2 GB has no more pieces than this.
MOST_PIECES = 1 << 20

# Code points on whose classes all Unicode versions agree; texts with others go to the tokenizer as a whole.
_plain = [c for c in range(0x250) if c in (9, 10, 13) or 0x20 <= c < 0x7F or c >= 0xA0]
PLAIN = re.compile(f"[{''.join(re.escape(chr(c)) for c in _plain)}]*")
# The split of byte-level BPE (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_models: dict = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ranks(model: dict, special: set[str]) -> dict[bytes, int] | None:
    """Byte strings of a byte-level vocabulary with their ids, if the ids follow the order of the merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocab, merges = model["vocab"], model["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}


def tokenizer(path: str):
    """The tokenizer, a faster coder of the same vocabulary if there is one, and strings that are treated specially."""
    if path not in _models:
        import json

        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        special = [t["content"] for t in conf.get("added_tokens", [])]
        pre, model = conf.get("pre_tokenizer") or {}, conf["model"]
        plain = conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "end_of_word_suffix"))
        ranks = byte_ranks(model, set(special)) if plain else None
        coder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        _models[path] = (tokenizers.Tokenizer.from_file(path), coder, special)
    return _models[path]


def ids_of(text: str, path: str) -> bytes:
    """The text's ids as little-endian 32-bit numbers, equal to encoding it whole."""
    tok, coder, special = tokenizer(path)
    if coder and PLAIN.fullmatch(text) and not any(s in text for s in special):
        ids = coder.encode_ordinary(text)
    else:
        ids = tok.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes()


def cut(path: str, capacity: int):
    """(doc_id, text, rank) to (doc_id, piece, start, length, ids_crc32, rank); only a first piece may be shorter."""

    def run(batches):
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for i, text, rank in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = ids_of(text.as_py(), path) + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    out.append((i, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), rank))
                    at, piece = at + size, piece + 1
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
            )

    return run


def reduced(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take out bins that dominate every alternative for their largest item; `counts` keeps the rest.

    For a largest size a with room r, and k the largest size that fits into r: {a} alone if nothing fits; {a, k} if
    k = r, or if no two items fit into r, or if no three fit and k is at least as large as the best two that fit.
    Whatever set holds a, its other items fit into k's place elsewhere, so some optimum has this bin.
    """
    fixed = []
    for a in sorted(counts, reverse=True):
        while counts.get(a, 0):
            room = capacity - a
            counts[a] -= 1
            sizes = sorted(s for s, n in counts.items() if n and s <= room)
            counts[a] += 1
            if not sizes:
                fixed.append(((a,), counts.pop(a)))
                break
            k = sizes[-1]
            least = []
            for s in sizes[:3]:
                least += [s] * min(3, counts[s] - (s == a))
            none_of = lambda n: len(least) < n or sum(least[:n]) > room  # noqa: B023, E731
            best_two = 0
            if k != room and not none_of(2) and none_of(3):
                have = {s: counts[s] - (s == a) for s in sizes}
                low, high = 0, len(sizes) - 1
                while low <= high:
                    two = sizes[low] + sizes[high]
                    if two > room:
                        high -= 1
                    else:
                        if low != high or have[sizes[low]] > 1:
                            best_two = max(best_two, two)
                        low += 1
            if not (k == room or none_of(2) or (none_of(3) and k >= best_two)):
                break
            # While a and k both last the conditions hold: fewer items leave fewer alternatives.
            n = counts[a] // 2 if a == k else min(counts[a], counts[k])
            fixed.append(((a, k), n))
            for s in (a, k):
                counts[s] -= n
                if not counts[s]:
                    counts.pop(s)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest sizes first, with all items of one size and all bins of one content at a time."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            room = min((r for r, groups in bins.items() if r >= s and groups), default=None)
            if room is None:
                room, held, copies = capacity, (), -(-n // (capacity // s))
            else:
                held, copies = bins[room].pop()
            each = room // s
            full = min(copies, n // each)
            if full:
                bins.setdefault(room - each * s, []).append((held + (s,) * each, full))
                n -= full * each
            rest = copies - full
            if rest and n:
                bins.setdefault(room - n * s, []).append((held + (s,) * n, 1)) if n < each else None
                if n < each:
                    n, rest = 0, rest - 1
            if rest and held:
                bins.setdefault(room, []).append((held, rest))
    return [g for groups in bins.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, sequence, offset): the items of a length ranked from..to-1 go to consecutive sequences.

    Sizes are at most `capacity` different numbers, so the plan is made on their counts and does not grow with the
    number of documents.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    groups = reduced(counts, capacity)
    groups += best_fit(counts, capacity)
    used: dict[int, int] = {}
    out, sequence = [], 0
    for held, copies in groups:
        offset = 0
        for s in held:
            at = used.get(s, 0)
            out.append((s, at, at + copies, sequence, offset))
            used[s] = at + copies
            offset += s
        sequence += copies
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, rank: str | None = None) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset`: one row per piece of every document.

    `docs` needs `doc_id LONG, text`; further columns are ignored. A null or empty text is the end id alone, null
    ids and repeated rows are packed like others. With `rank`, a LONG column, a sequence is named after the least
    rank in it (and the piece), so that sequences read in the order of their names follow the ranks.

    Only counts of lengths reach the driver. Pieces of one length are ranked by counts of (length, chunk), a chunk
    being 16,384 rows of a stored file, so a length that a third of all pieces have is no single group.
    """
    spark = docs.sparkSession
    path = path or model_path()
    order = F.col(rank).cast("long") if rank else F.lit(0).cast("long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), order.alias("rank"))
    pieces = reliable(
        texts.mapInArrow(cut(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, rank long")
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(counts, capacity)
    row = F.monotonically_increasing_id()
    rows = pieces.withColumn("row", row).withColumn("chunk", F.shiftright("row", CHUNK_BITS))
    sizes = rows.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("row")) - 1
    rows = rows.withColumn("inside", inside).join(sizes, ["length", "chunk"]).withColumn("nth", F.col("first") + F.col("inside"))
    table = spark.createDataFrame(places, "length long, lo long, hi long, first_sequence long, offset long")
    # At most a few entries for each of `capacity` lengths.
    placed = rows.join(F.broadcast(table), "length").where("nth >= lo AND nth < hi")
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.col("nth") - F.col("lo"))
    if rank:
        least = placed.groupBy("sequence_id").agg(F.min(F.struct("rank", "doc_id", "piece")).alias("least"))
        placed = placed.join(least, "sequence_id").withColumn("sequence_id", F.col("least.rank") * MOST_PIECES + F.col("least.piece"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs)
