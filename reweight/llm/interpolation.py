"""Deleted interpolation: texts scored by maximum-likelihood estimates of word pairs and words, mixed per frequency of
the context with weights that expectation maximisation learns on documents set aside."""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.llm.common import reliable
from reweight.llm.parsing import mix

# 64-bit names of what is no word: a text's end, and what stands before its first word.
END, START = 0, 1
# Frequent words and pairs that are broadcast at most. A place among the words takes BITS bits, START's included.
HOT_WORDS = 1 << 20
HOT_PAIRS = 1 << 18
BITS = 21
NONE = (1 << BITS) - 1
# Tokens that a task counts, and that it cuts into pairs, before it hands them on; pairs in a task of the matching.
COUNTED = 2_000_000
CUT = 750_000
MATCHED = 4_000_000
# Pairs of one packed row with counts.
PIECE = 100_000
# Parts of a bucket that are counted one after the other, which bounds what sorting them takes.
LAYERS = 4
# Words whose names a task remembers.
CACHE = 250_000
# Documents by their part in the learning.
HELD_OUT, KEPT, ASIDE = 0, 1, 2
# Rounds of expectation maximisation at most, the change of a weight that ends them, and a share that every weight keeps.
ROUNDS = 25
SETTLED = 1e-4
SHARE = 1e-6
# Buckets of contexts: never seen, then powers of two.
BUCKETS = 48


class Names(dict):
    """64-bit names of words, remembered."""

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        name = self[word] = h if h > START else h + 2
        return name


def tokens_of(raw: bytes, names: Names) -> np.ndarray:
    """Names of a text's words, then the end; words are runs of bytes other than ASCII white space, A-Z in lower case."""
    if len(names) > CACHE:
        names.clear()
    words = raw.lower().split()
    out = np.full(len(words) + 1, END, np.uint64)
    out[:-1] = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
    return out


def chunks(batches, most: int, *more: int):
    """Texts in runs of about `most` tokens: all tokens, the tokens of each text, and further columns as arrays."""
    names, held, size = Names(), [], 0

    def cut():
        tokens, *cols = zip(*held)
        return np.concatenate(tokens), np.array([len(t) for t in tokens]), *[np.array(c) for c in cols]

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in more]
        for i, raw in enumerate(batch.column(0)):
            held.append((tokens_of(raw.as_py(), names), *[c[i] for c in cols]))
            size += len(held[-1][0])
            if size >= most:
                yield cut()
                held, size = [], 0
    if held:
        yield cut()


def before(tokens: np.ndarray, sizes: np.ndarray, first) -> np.ndarray:
    """What stands before each token in its text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(sizes) - sizes] = first
    return out


FACT = "pair boolean, a long, b long, n long, c long, r long"


def counting(batches):
    """(UTF-8 text, role) to words, and pairs that are frequent here: occurrences in all, in training and in kept documents.

    A pair that is an x-th of all pairs is at least that in some run of tokens, so no frequent pair is overlooked.
    """
    for tokens, sizes, roles in chunks(batches, COUNTED, 1):
        role = np.repeat(roles, sizes)
        order = np.argsort(tokens)
        at = np.flatnonzero(np.concatenate([[True], np.diff(tokens[order]) != 0]))
        n = np.diff(np.append(at, len(tokens)))
        c, r = (np.add.reduceat((x[order]).astype(np.int64), at) for x in (role != HELD_OUT, role == KEPT))
        zero = np.zeros(len(at), np.int64)
        yield facts(False, zero, tokens[order][at].view(np.int64), n, c, r)
        left = before(tokens, sizes, START)
        pair = mix(left) * np.uint64(3) + tokens
        kinds, n = np.unique(pair, return_counts=True)
        keep = n >= max(2, len(tokens) // HOT_PAIRS)
        kinds, n = kinds[keep], n[keep]
        # Only the few that are frequent are looked up again, for the words of one occurrence.
        first = np.zeros(len(n), np.int64)
        if len(n):
            at = np.minimum(np.searchsorted(kinds, pair), len(kinds) - 1)
            hit = np.flatnonzero(kinds[at] == pair)
            first[at[hit]] = hit
        zero = np.zeros(len(n), np.int64)
        yield facts(True, left[first].view(np.int64), tokens[first].view(np.int64), n, zero, zero)


def facts(pair: bool, *cols):
    flags = pa.array(np.full(len(cols[0]), pair))
    return pa.RecordBatch.from_arrays([flags, *map(pa.array, cols)], [c.split()[0] for c in FACT.split(", ")])


def frequent(table: DataFrame, most: int) -> int:
    """The least occurrences of rows of which there are at most `most`, from counts per quarter of a power of two."""
    level = F.floor(4 * F.log2(F.col("n").cast("double"))).cast("int")
    levels = table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()
    least, total = (1 << 62), 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["rows"]
        if total > most:
            break
        least = r["least"]
    return least


class Hot:
    """Frequent words, the most frequent first, with training and kept counts, and frequent pairs of them."""

    def __init__(self, names, c, r, left, right):
        order = np.argsort(names)
        self.names = names[order]
        place = np.argsort(-c[order], kind="stable")
        self.rank = np.empty(len(names), np.int32)
        self.rank[place] = np.arange(len(names), dtype=np.int32)
        self.c, self.r = np.append(c[order][place], 0), np.append(r[order][place], 0)
        # START is as frequent as END, which is among the words always.
        end = self.places(np.array([END], np.uint64))
        self.start = len(names)
        self.c[-1], self.r[-1] = self.c[end[0]], self.r[end[0]]
        a, b = self.places(left), self.places(right)
        a[left == START] = self.start
        known = (a >= 0) & (b >= 0)
        self.pairs = np.unique(pair_key(a[known], b[known]))

    def places(self, names: np.ndarray) -> np.ndarray:
        """Places of names among the frequent words, -1 for others."""
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.rank[at], -1).astype(np.int64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(BITS) | b.astype(np.uint64)


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, so that equal high bytes stand together, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()


# What the cutting hands to the matching: documents; pairs of frequent words; pairs that end in a rare word; pairs that begin
# with one; pairs of rare words; counts of frequent pairs. Then: counts in documents set aside, and sums of documents.
DOCUMENT, FREQUENT, RARE_END, RARE_START, RARE, TALLY, DEV, SUM = range(8)
ROW = "kind int, bucket int, rid long, doc_id long, role int, p long, q long, base double, x binary, y binary, z binary, t binary"
COLUMNS = {c.split()[0]: k for c, k in zip(ROW.split(", "), [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.float64()] + [pa.binary()] * 4)}


def rows_of(n: int, **given):
    """A batch of n rows; columns that are not given are null."""
    cols = [pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in COLUMNS.items()]
    return pa.RecordBatch.from_arrays(cols, list(COLUMNS))


def dealt(parts: int, kind: int, bucket: np.ndarray, doc: np.ndarray, rids: np.ndarray, roles: np.ndarray, z: np.ndarray, t: np.ndarray):
    """Pairs of documents (in ascending order) as one packed row per bucket."""
    # Numbers of 16 bits are sorted by their digits.
    order = np.argsort(bucket.astype(np.uint16) if parts <= 1 << 16 else bucket, kind="stable")
    bucket, doc, z, t = bucket[order], doc[order], z[order], t[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    xs, ys, zs, ts, at = [], [], [], [], []
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
        if s == e:
            continue
        first = np.flatnonzero(np.concatenate([[True], np.diff(doc[s:e]) != 0]))
        own = doc[s:e][first]
        xs.append(rids[own].astype("<i8").tobytes())
        ys.append(planes(np.diff(np.append(first, e - s)) * 4 + roles[own]))
        zs.append(planes(z[s:e]))
        ts.append(planes(t[s:e]))
        at.append(int(bucket[s]))
    return rows_of(len(at), kind=[kind] * len(at), bucket=at, x=xs, y=ys, z=zs, t=ts)


def cutting(shared, parts: int, most: int):
    """(UTF-8 text, role, rid, doc_id) to rows for the matching, packed per bucket of pairs."""

    def run(batches):
        hot = shared.value
        bucket_of = lambda key: (mix(key) % np.uint64(parts)).astype(np.int32)
        for tokens, sizes, roles, rids, ids in chunks(batches, most, 1, 2, 3):
            docs = len(sizes)
            doc = np.repeat(np.arange(docs), sizes)
            right = hot.places(tokens)
            left = before(right, sizes, hot.start)
            names = before(tokens, sizes, START)
            good = right >= 0
            c = hot.c[right[good]]
            base = np.bincount(doc[good], np.log10(c + 1.0), docs)
            known = np.bincount(doc[good], c > 0, docs).astype(np.int64)
            # Pairs of frequent words, once per document.
            both = good & (left >= 0)
            shift = np.uint64(2 * BITS)
            one, times = np.unique(doc[both].astype(np.uint64) << shift | pair_key(left[both], right[both]), return_counts=True)
            own, key = (one >> shift).astype(np.int64), one & np.uint64((1 << 2 * BITS) - 1)
            if len(hot.pairs):
                at = np.minimum(np.searchsorted(hot.pairs, key), len(hot.pairs) - 1)
                often = hot.pairs[at] == key
            else:
                at, often = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
            if not often.all():
                rest = ~often
                yield dealt(parts, FREQUENT, bucket_of(key[rest]), own[rest], rids, roles, key[rest], times[rest])
            at, own, times = at[often], own[often], times[often]
            ends = np.searchsorted(own, np.arange(docs + 1)).tolist()
            places, many = at.astype("<u4"), times.astype("<u4")
            slices = list(zip(ends, ends[1:]))
            yield rows_of(
                docs, kind=[DOCUMENT] * docs, bucket=document_bucket(rids, parts), rid=rids, role=roles, p=sizes, q=known, base=base,
                doc_id=ids.tolist(), x=[places[s:e].tobytes() for s, e in slices], t=[many[s:e].tobytes() for s, e in slices],
            )
            if len(at):
                order = np.argsort(at)
                at, own, times = at[order], own[order], times[order]
                first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0]))
                role = roles[own]
                sums = [np.add.reduceat(np.where(x, times, 0), first) for x in (role != HELD_OUT, role == KEPT)]
                some = sums[0] > 0
                at, sums = at[first][some], [s[some] for s in sums]
                slot = (at * parts // len(hot.pairs)).astype(np.int32)
                cut = np.flatnonzero(np.diff(slot)) + 1
                spans = [(s, e) for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(slot)]) if s < e]
                packed = [[planes(v[s:e]) for s, e in spans] for v in (at, *sums)]
                yield rows_of(len(spans), kind=[TALLY] * len(spans), bucket=[int(slot[s]) for s, _ in spans], x=packed[0], y=packed[1], z=packed[2])
            # Rare words: their counts, and those of their pairs, are found where all their occurrences meet.
            rare = ~good
            if rare.any():
                w = tokens[rare]
                yield dealt(parts, RARE_END, bucket_of(w), doc[rare], rids, roles, w, np.where(left[rare] < 0, NONE, left[rare]))
            rare = good & (left < 0)
            if rare.any():
                h = names[rare]
                yield dealt(parts, RARE_START, bucket_of(h), doc[rare], rids, roles, h, right[rare])
            rare = ~good & (left < 0)
            if rare.any():
                n, own = int(rare.sum()), doc[rare]
                pair = [names[rare].view(np.int64), tokens[rare].view(np.int64)]
                yield rows_of(n, kind=[RARE] * n, bucket=document_bucket(rids[own], parts), rid=rids[own], role=roles[own], p=pair[0], q=pair[1])

    return run


class Pairs:
    """Packed rows of one kind put together: rid and role per document, document, name and other part per pair."""

    def __init__(self, rows: list[tuple]):
        empty = np.zeros(0, np.uint64)
        sizes = np.concatenate([numbers(y) for _, y, _, _ in rows] or [empty])
        self.rids = np.concatenate([np.frombuffer(x, "<i8") for x, _, _, _ in rows] or [empty.astype(np.int64)])
        sizes, roles = (sizes >> np.uint64(2)).astype(np.int64), (sizes & np.uint64(3)).astype(np.int8)
        self.doc, self.role = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.repeat(roles, sizes)
        self.z = np.concatenate([numbers(z) for _, _, z, _ in rows] or [empty])
        self.t = np.concatenate([numbers(t).astype(np.int32) for _, _, _, t in rows] or [np.zeros(0, np.int32)])

    def totals(self, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per pair: occurrences of its key in training and in kept documents."""
        c, r = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        layer = (mix(key) >> np.uint64(40)).astype(np.uint8) % LAYERS
        for i in range(LAYERS):
            own = np.flatnonzero(layer == i)
            if not len(own):
                continue
            own = own[np.argsort(key[own])]
            group = np.cumsum(np.concatenate([[True], np.diff(key[own]) != 0])) - 1
            role, n = self.role[own], times[own]
            c[own] = np.bincount(group, n * (role != HELD_OUT))[group]
            r[own] = np.bincount(group, n * (role == KEPT))[group]
        return c, r

    def pieces(self):
        """Runs of pairs of bounded length."""
        return [slice(s, s + PIECE) for s in range(0, len(self.z), PIECE)]


def developed(aside: np.ndarray, times, pair, context, word):
    """Occurrences in documents set aside, once per (kept counts of pair, context and word).

    Where the pair was never seen its estimate is nought, and the context counts by its bucket only: all contexts of a bucket
    are one there.
    """
    if not aside.any():
        return rows_of(0)
    pair, context, word, times = (v[aside].astype(np.int64) for v in (pair, context, word, times))
    context = np.where(pair == 0, least_of(context), context)
    order = np.lexsort((word, context, pair))
    pair, context, word = pair[order], context[order], word[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(context) != 0) | (np.diff(word) != 0)]))
    n = np.add.reduceat(times[order], first)
    return rows_of(len(n), kind=[DEV] * len(n), rid=pair[first], doc_id=context[first], p=word[first], q=n)


def counted(pairs: Pairs, part: slice, keep, times, pair, context, word, base=None, known=None):
    """A run of pairs with their three training counts as a packed row, and what rare words add to their documents."""
    # Documents ascend.
    new = np.concatenate([[True], np.diff(pairs.doc[part]) != 0])
    own, at = pairs.doc[part][new], np.cumsum(new) - 1
    extra = np.zeros((2, len(own)))
    if base is not None:
        extra = np.stack([np.bincount(at, v, len(own)) for v in (base, known)])
    four = np.concatenate([v[keep] for v in (pair, context, word, times)])
    sizes = np.bincount(at[keep], minlength=len(own))
    return rows_of(1, kind=[FREQUENT], x=[pairs.rids[own].tobytes()], y=[planes(sizes)], z=[planes(four)], t=[extra.tobytes()])


def matching(shared):
    """Rows of one bucket, all in this task, to pairs with their counts. Documents and pairs of rare words pass through."""

    def run(batches):
        hot = shared.value
        held: dict[int, list[tuple]] = {FREQUENT: [], RARE_END: [], RARE_START: []}
        tally: dict[str, np.ndarray] = {}
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            through = np.isin(kinds, (DOCUMENT, RARE))
            if through.any():
                yield batch.filter(pa.array(through))
            for i in np.flatnonzero(~through).tolist():
                row = [batch.column(c)[i].as_py() for c in "xyzt"]
                if kinds[i] == TALLY:
                    if not tally:
                        tally = {c: np.zeros(len(hot.pairs), np.int64) for c in "cr"}
                    at = numbers(row[0]).astype(np.int64)
                    tally["c"][at] += numbers(row[1]).astype(np.int64)
                    tally["r"][at] += numbers(row[2]).astype(np.int64)
                else:
                    held[int(kinds[i])].append(tuple(row))
        if tally:
            at = np.flatnonzero(tally["c"])
            c, r = tally["c"][at], tally["r"][at]
            yield rows_of(1, kind=[TALLY], x=[planes(at)], y=[planes(c)])
            a, b = split(hot.pairs[at])
            yield developed(c > r, c - r, r, hot.r[a], hot.r[b])
        if held[FREQUENT]:
            pairs = Pairs(held.pop(FREQUENT))
            c, r = pairs.totals(pairs.z, pairs.t)
            for part in pairs.pieces():
                a, b = split(pairs.z[part])
                yield counted(pairs, part, slice(None), pairs.t[part], c[part], hot.c[a], hot.c[b])
                yield developed(pairs.role[part] == ASIDE, pairs.t[part], r[part], hot.r[a], hot.r[b])
            del pairs, c, r
        ends, starts = Pairs(held[RARE_END]), Pairs(held[RARE_START])
        ones = np.ones(max(len(ends.z), len(starts.z)), np.int64)
        word = ends.totals(ends.z, ones[: len(ends.z)])
        c, r = ends.totals(mix(ends.z) + ends.t.astype(np.uint64), ones[: len(ends.z)])
        for part in ends.pieces():
            alone, n = ends.t[part] != NONE, ones[: len(ends.t[part])]
            a, w = np.where(alone, ends.t[part], 0), word[0][part]
            yield counted(ends, part, alone, n, c[part], hot.c[a], w, np.log10(w + 1.0), w > 0)
            yield developed(alone & (ends.role[part] == ASIDE), n, r[part], hot.r[a], word[1][part])
        # Every occurrence of a rare word ends a pair in this bucket.
        names, first = np.unique(ends.z, return_index=True)
        c, r = starts.totals(mix(starts.z) + starts.t.astype(np.uint64), ones[: len(starts.z)])
        for part in starts.pieces():
            at, b, n = first[np.searchsorted(names, starts.z[part])], starts.t[part], ones[: len(starts.t[part])]
            yield counted(starts, part, slice(None), n, c[part], word[0][at], hot.c[b])
            yield developed(starts.role[part] == ASIDE, n, r[part], word[1][at], hot.r[b])

    return run


def split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64(NONE)).astype(np.int64)


def rare_pairs(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of two rare words with counts: `rid, role, c, ch, cw, r, rh, rw`. No word or pair of them is frequent."""
    rows = rows.where(F.col("kind") == RARE).select("rid", "role", F.col("p").alias("h"), F.col("q").alias("w"))
    once = rows.groupBy("h", "w").agg(F.sum((F.col("role") != HELD_OUT).cast("long")).alias("c"), F.sum((F.col("role") == KEPT).cast("long")).alias("r"))
    of = lambda key: words.select(F.col("b").alias(key), F.col("c").alias(f"c{key}"), F.col("r").alias(f"r{key}"))
    return rows.join(once.join(of("h"), "h").join(of("w"), "w"), ["h", "w"]).drop("h", "w")


def bucket(context: np.ndarray) -> np.ndarray:
    """Buckets of contexts by their frequency: 0 if never seen, else one more than the whole logarithm."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def least_of(context: np.ndarray) -> np.ndarray:
    """The least count in the bucket of each context."""
    b = bucket(context)
    return np.where(b > 0, np.int64(1) << np.maximum(b - 1, 0).astype(np.int64), 0)


def parts_of(pair, context, word, total: int, distinct: int):
    """The three estimates: of the word after its context, of the word, and one that all words and an unseen one share."""
    with np.errstate(divide="ignore", invalid="ignore"):
        after = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return np.stack([after, word / max(total, 1), np.full(len(after), 1.0 / (distinct + 1))])


def together(batches):
    """(pair, context, word, n) to packed rows of about PIECE of them, which every round of the learning reads."""
    held, size = [], 0

    def packed():
        four = np.concatenate([np.concatenate(c) for c in zip(*held)])
        return pa.RecordBatch.from_arrays([pa.array([planes(four)], pa.binary())], ["four"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= PIECE:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def expected(weights: np.ndarray, total: int, distinct: int):
    """Packed (pair, context, word, n) to each estimate's expected share of the occurrences, per bucket."""

    def run(batches):
        sums = np.zeros((3, BUCKETS))
        for batch in batches:
            for four in batch.column(0):
                pair, context, word, n = numbers(four.as_py()).astype(float).reshape(4, -1)
                b = bucket(context)
                p = weights[:, b] * parts_of(pair, context, word, total, distinct)
                p *= n / p.sum(0)
                sums += np.stack([np.bincount(b, v, BUCKETS) for v in p])
        at = [pa.array(np.arange(BUCKETS), pa.int32()), *[pa.array(s) for s in sums]]
        yield pa.RecordBatch.from_arrays(at, ["bucket", "s0", "s1", "s2"])

    return run


def learnt(dev: DataFrame, total: int, distinct: int) -> np.ndarray:
    """Weights of the three estimates per bucket, by expectation maximisation over packed (pair, context, word, n).

    Only sums per bucket come to the driver. A bucket without occurrences has the weights of the next lower one that has
    some, or else of the next higher; without any at all the weights are equal.
    """
    weights = np.full((3, BUCKETS), 1 / 3)
    # An unseen context has no estimate of its own.
    weights[:, 0] = 0, 1 / 2, 1 / 2
    seen = np.zeros(BUCKETS, bool)
    for _ in range(ROUNDS):
        sums = dev.mapInArrow(expected(weights, total, distinct), "bucket int, s0 double, s1 double, s2 double")
        rows = sums.groupBy("bucket").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(3)]).collect()
        new, old = np.zeros((3, BUCKETS)), weights
        for r in rows:
            new[:, r["bucket"]] = r["s0"], r["s1"], r["s2"]
        seen = new.sum(0) > 0
        weights = np.where(seen, new / np.maximum(new.sum(0), 1e-300), old)
        weights[:, 1:] = (weights[:, 1:] + SHARE) / (1 + 3 * SHARE)
        weights[1:, 0] = (weights[1:, 0] + SHARE) / (1 + 2 * SHARE)
        if np.abs(weights - old).max() < SETTLED:
            break
    known = np.flatnonzero(seen[1:]) + 1
    for b in range(1, BUCKETS):
        if len(known) and not seen[b]:
            weights[:, b] = weights[:, known[max(0, np.searchsorted(known, b) - 1)]]
    return weights


def logs(weights, pair, context, word, total: int, distinct: int) -> np.ndarray:
    """log10 of the mixture."""
    return np.log10((weights[:, bucket(context)] * parts_of(pair, context, word, total, distinct)).sum(0))


class Totals:
    """Sums per document, handed on as one packed row per bucket of documents."""

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, rids, score, base=None, known=None, copies=None):
        zero = np.zeros(len(rids))
        self.held.append((rids, *(zero if v is None else v for v in (score, base, known, copies))))
        self.size += len(rids)
        return self.rows() if self.size >= CUT else None

    def rows(self):
        if not self.size:
            return rows_of(0)
        rids, *sums = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.size = [], 0
        rids, at = np.unique(rids, return_inverse=True)
        sums = np.stack([np.bincount(at, v) for v in sums])
        bucket = document_bucket(rids, self.parts)
        order = np.argsort(bucket, kind="stable")
        bucket, rids, sums = bucket[order], rids[order], sums[:, order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        spans = list(zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]))
        packed = [rids[s:e].tobytes() for s, e in spans], [sums[:, s:e].tobytes() for s, e in spans]
        return rows_of(len(spans), kind=[SUM] * len(spans), bucket=[int(bucket[s]) for s, _ in spans], x=packed[0], y=packed[1])


def document_bucket(rids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(rids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def summing(weights: np.ndarray, total: int, distinct: int, parts: int):
    """Packed pairs with counts to sums per document."""

    def run(batches):
        totals = Totals(parts)
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, z, t = (c[i].as_py() for c in batch.columns)
                rids, sizes = np.frombuffer(x, "<i8"), numbers(y).astype(np.int64)
                pair, context, word, times = numbers(z).astype(float).reshape(4, -1)
                doc = np.repeat(np.arange(len(rids)), sizes)
                score = np.bincount(doc, times * logs(weights, pair, context, word, total, distinct), len(rids))
                if (full := totals.add(rids, score, *np.frombuffer(t).reshape(2, -1))) is not None:
                    yield full
        yield totals.rows()

    return run


def of_rare(weights: np.ndarray, total: int, distinct: int, parts: int):
    """(rid, c, ch, cw) of pairs of rare words to sums per document."""

    def run(batches):
        totals = Totals(parts)
        for batch in batches:
            if batch.num_rows:
                c, ch, cw = (batch.column(i).to_numpy().astype(float) for i in (1, 2, 3))
                if (full := totals.add(batch.column(0).to_numpy(), logs(weights, c, ch, cw, total, distinct))) is not None:
                    yield full
        yield totals.rows()

    return run


def of_copies(parts: int):
    """(rid) to how many documents have it, as a sum of its documents."""

    def run(batches):
        totals = Totals(parts)
        for batch in batches:
            if batch.num_rows:
                rids = batch.column(0).to_numpy()
                if (full := totals.add(rids, np.zeros(len(rids)), copies=np.ones(len(rids)))) is not None:
                    yield full
        yield totals.rows()

    return run


DONE = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def finishing(shared):
    """Sums of a bucket of documents, then its documents, to finished rows; frequent pairs are looked up."""

    def run(batches):
        table, held, rids, sums = shared.value, [], None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for i in np.flatnonzero(kinds == SUM).tolist():
                own = np.frombuffer(batch.column("x")[i].as_py(), "<i8")
                held.append((own, np.frombuffer(batch.column("y")[i].as_py()).reshape(4, -1)))
            docs = batch.filter(pa.array(kinds == DOCUMENT))
            if not docs.num_rows:
                continue
            if rids is None:
                rids, at = np.unique(np.concatenate([r for r, _ in held]), return_inverse=True)
                sums = np.stack([np.bincount(at, v) for v in np.concatenate([v for _, v in held], axis=1)])
                held = []
            score, base, known, copies = sums[:, np.searchsorted(rids, docs.column("rid").to_numpy())]
            score = score / copies
            for i, (x, t) in enumerate(zip(docs.column("x"), docs.column("t"))):
                score[i] += table[np.frombuffer(x.as_py(), "<u4")] @ np.frombuffer(t.as_py(), "<u4")
            known = docs.column("q").to_numpy() + np.rint(known / copies).astype(np.int64)
            base = docs.column("base").to_numpy() + base / copies
            held_out = pa.array(docs.column("role").to_numpy() == HELD_OUT)
            cols = [docs.column("doc_id"), held_out, docs.column("p"), pa.array(known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in DONE.split(", ")])

    return run


def role(doc_id: str = "doc_id"):
    """Held out if crc32 of the id as text leaves 2 modulo 7, set aside for the mixture's weights if it leaves 3. A null id
    is neither."""
    rest = F.crc32(F.col(doc_id).cast("string")) % 7
    return F.coalesce(F.when(rest == 2, HELD_OUT).when(rest == 3, ASIDE), F.lit(KEPT)).cast("int")


def score(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` for every document, whole texts.

    `docs` needs `doc_id LONG, text`; further columns are ignored. A null or empty text is its end alone. A null id is
    neither held out nor set aside; repeated rows are scored alike and count each; an empty table gives no rows. Without
    training tokens all of the probability goes to unseen words. Words are compared by 64-bit hashes.

    Frequent words and pairs, of bounded number, are broadcast; a document keeps its frequent pairs. Every other pair of a
    document goes, packed with others, to the one task where all its occurrences meet, and no such pair is frequent. Only
    sums per document come back.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.cast("binary").alias("raw"), role().alias("role"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"))
    seen = texts.select("raw", "role").mapInArrow(counting, FACT)
    seen = reliable(seen.groupBy("pair", "a", "b").agg(*[F.sum(c).alias(c) for c in "ncr"]))
    words, pairs = seen.where("NOT pair"), seen.where("pair")
    size = words.agg(*[F.coalesce(F.sum(v), F.lit(0)) for v in ("n", "c", "r", F.expr("int(c > 0)"), F.expr("int(r > 0)"))]).first()
    occurrences, total, kept, distinct, kept_distinct = size
    if not occurrences:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    often = (F.col("n") >= frequent(words, HOT_WORDS)) | (F.col("b") == END)
    got = words.where(often).select("b", "c", "r").toArrow()
    two = pairs.where(F.col("n") >= frequent(pairs, HOT_PAIRS)).select("a", "b").toArrow()
    column = lambda t, c: t.column(c).to_numpy()
    hot = Hot(column(got, "b").view(np.uint64), column(got, "c"), column(got, "r"), column(two, "a").view(np.uint64), column(two, "b").view(np.uint64))
    shared = spark.sparkContext.broadcast(hot)

    parts = max(spark.sparkContext.defaultParallelism, -(-occurrences // MATCHED))
    rows = texts.mapInArrow(cutting(shared, parts, CUT), ROW).repartitionById(parts, F.col("bucket"))
    rows = reliable(rows.mapInArrow(matching(shared), ROW))
    rare = reliable(rare_pairs(rows, words.where(~often)))
    dev = rows.where(F.col("kind") == DEV).select(F.col("rid").alias("pair"), F.col("doc_id").alias("context"), F.col("p").alias("word"), F.col("q").alias("n"))
    dev = dev.unionByName(rare.where(F.col("role") == ASIDE).select(F.col("r").alias("pair"), F.col("rh").alias("context"), F.col("rw").alias("word"), F.lit(1).cast("long").alias("n")))
    dev = dev.groupBy("pair", "context", "word").agg(F.sum("n").alias("n"))
    dev = reliable(dev.mapInArrow(together, "four binary"))
    weights = learnt(dev, kept, kept_distinct)
    if not total:
        weights[:, 0] = 0, 0, 1

    count = np.zeros(len(hot.pairs))
    for r in rows.where(F.col("kind") == TALLY).select("x", "y").toLocalIterator():
        count[numbers(bytes(r["x"])).astype(np.int64)] = numbers(bytes(r["y"]))
    a, b = split(hot.pairs)
    table = spark.sparkContext.broadcast(logs(weights, count, hot.c[a], hot.c[b], total, distinct))

    # Sums meet their documents in the documents' buckets, and come first there.
    sums = rows.where(F.col("kind") == FREQUENT).select("x", "y", "z", "t").mapInArrow(summing(weights, total, distinct, parts), ROW)
    alone = rare.select("rid", "c", "ch", "cw").mapInArrow(of_rare(weights, total, distinct, parts), ROW)
    own = rows.where(F.col("kind") == DOCUMENT)
    copies = own.select("rid").mapInArrow(of_copies(parts), ROW)
    full = own.unionByName(sums).unionByName(alone).unionByName(copies).repartitionById(parts, F.col("bucket"))
    done = full.sortWithinPartitions(F.desc("kind")).mapInArrow(finishing(table), DONE)
    floor = F.log10(F.lit(float(total + distinct + 1)))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score(docs)
