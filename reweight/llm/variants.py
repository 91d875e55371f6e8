"""Spelling variants: words one edit apart, found through bit-sliced position indexes over blocks of the vocabulary."""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.llm.common import reliable
from reweight.operators.lineage import broadcast_if

# Fixed values of the contract.
LEAST_LETTERS = 6
LEAST_COUNT = 5
SLIP = 199
TIMES = 5
# Maximal runs of at least LEAST_LETTERS letters in a text whose A-Z are lower case. A shorter run cannot become a word.
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
# Words that a task counts before it hands the counts on.
FLUSH = 300_000
# Words that one index holds; a larger block is cut into so many indexes.
SLAB = 16_384


def runs(doc_id, raw: bytes) -> Counter:
    """Words of a text with their frequencies: runs, of which every SLIP-th has lost a letter."""
    found = Counter(RUN.findall(raw.lower().decode("utf-8")))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    slipped = []
    for run in found:
        h = zlib.crc32(run.encode(), start)
        if h % SLIP == 0:
            at = h % len(run)
            slipped.append((run, run[:at] + run[at + 1 :]))
    out = [(new, found.pop(run)) for run, new in slipped]
    for new, n in out:
        if len(new) >= LEAST_LETTERS:
            found[new] += n
    return found


def counting(batches):
    """(doc_id, UTF-8 text) to (word, n), in parts of bounded size."""
    seen: Counter = Counter()

    def part():
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen.update(runs(doc_id, raw.as_py()))
            if len(seen) > FLUSH:
                yield part()
                seen = Counter()
    yield part()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """`word, n`: words of at least LEAST_LETTERS letters that occur at least `least` times, with their counts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    seen = texts.mapInArrow(counting, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """Bitsets over words of two lengths, one per (position, letter)."""

    def __init__(self, words: list[str], short: int):
        self.at: dict[tuple[int, str], int] = {}
        self.short = self.long = 0
        at = self.at
        for i, word in enumerate(words):
            bit = 1 << i
            if len(word) == short:
                self.short |= bit
            else:
                self.long |= bit
            for place in enumerate(word):
                at[place] = at.get(place, 0) | bit

    def near(self, queries):
        """For each sorted word of the shorter length, the set of words with one letter replaced, and with one more.

        Z is the set of words that agree so far, R those of the same length that agree but for one letter, M those that
        agree at positions shifted by one after one more letter. One letter of the query moves all three at once, each
        by a few operations on whole bitsets. Words that share their beginning share its states.
        """
        every = self.short | self.long
        states = [(every, 0, self.long)]
        last = ""
        for q in queries:
            same = 0
            while same < min(len(last), len(q)) and last[same] == q[same]:
                same += 1
            del states[same + 1 :]
            zero, replaced, more = states[-1]
            for i in range(same, len(q)):
                here, shifted = self.at.get((i, q[i]), 0), self.at.get((i + 1, q[i]), 0)
                short = zero & self.short
                replaced = (replaced & here) | (short ^ (short & here))
                zero &= here
                more = (more & shifted) | (zero & self.long)
                states.append((zero, replaced, more))
            last = q
            yield q, replaced, more


def members(bits: int):
    """Places of the ones."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


BEST = "word string, near long, most long, best string"


def grouped(batches, keys: int):
    """Rows as tuples of columns per run of equal values in the first `keys` columns; batches are sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def comparing(batches):
    """(block, slab, word, length, suffix, query, inside, n), sorted by block, slab and word, to one row per word with
    near words in the block: how many, and the most frequent with its count."""
    rows: list[tuple] = []

    def flush():
        cols = list(zip(*rows)) if rows else [()] * 4
        rows.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in BEST.split(", ")])

    for group in grouped(batches, 2):
        inside = [(r[2], r[7]) for r in group if r[6]]
        queries = [(r[2], r[7]) for r in group if r[5]]
        if not inside or not queries:
            continue
        short, suffix = group[0][3], group[0][4]
        count = dict(queries)
        # Words that share both halves of a block's class meet in the block of the first half as well.
        half = short // 2
        best: dict[str, list] = {}

        def meet(word, other, n):
            got = best.get(word)
            if got is None:
                best[word] = [1, n, other]
                return
            got[0] += 1
            if n > got[1] or (n == got[1] and other < got[2]):
                got[1], got[2] = n, other

        for q, replaced, more in Index([w for w, _ in inside], short).near([w for w, _ in queries]):
            for i in members(replaced):
                w, n = inside[i]
                if not suffix or w[:half] != q[:half]:
                    meet(q, w, n)
            for i in members(more):
                w, n = inside[i]
                if not suffix or w[:half] != q[:half]:
                    meet(q, w, n)
                    meet(w, q, count[q])
        rows.extend((w, *b) for w, b in best.items())
        if len(rows) > FLUSH:
            yield flush()
    yield flush()


def blocks(words: DataFrame) -> DataFrame:
    """Words by what two near words share, for a partition per (block, slab), in order.

    Of two words one edit apart, the shorter of length l (or both), the edit leaves the first l // 2 letters alone or the last
    l - l // 2. A word is so in four blocks: by its first and its last letters, as the shorter and as the longer one.
    The slabs of a large block hold its words in turn; those that are compared go to all slabs of the block.
    """
    size = F.length("word")
    rows = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("length"))
    rows = rows.where(F.col("length") >= LEAST_LETTERS).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("suffix"))
    half = F.floor(F.col("length") / 2).cast("int")
    shared = F.when(F.col("suffix"), F.expr("right(word, length - length div 2)")).otherwise(F.substring("word", F.lit(1), half))
    rows = rows.withColumn("block", F.xxhash64("length", "suffix", shared))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("words"), F.max(F.col("size") == F.col("length")).alias("asked"))
    sizes = reliable(sizes.where("words > 1 AND asked"))
    large = sizes.where(F.col("words") > SLAB).select("block", F.ceil(F.col("words") / SLAB).cast("int").alias("slabs"))
    rows = rows.join(sizes.select("block"), "block", "left_semi").join(broadcast_if(large, 24 * large.count()), "block", "left")
    rows = rows.withColumn("slabs", F.coalesce("slabs", F.lit(1))).withColumn("query", F.col("size") == F.col("length"))
    own = F.expr("int(pmod(xxhash64(word), slabs))")
    rows = rows.withColumn("own", own).withColumn("slab", F.explode(F.when(F.col("query"), F.expr("sequence(0, slabs - 1)")).otherwise(F.array("own"))))
    rows = rows.select("block", "slab", "word", "length", "suffix", "query", (F.col("slab") == F.col("own")).alias("inside"), "n")
    return rows.repartition("block", "slab").sortWithinPartitions("block", "slab", "word")


def near_words(words: DataFrame) -> DataFrame:
    """`word, near, most, best` for words with near words: how many, the largest count, and the word that has it."""
    found = blocks(words).mapInArrow(comparing, BEST)
    first = F.min(F.struct((-F.col("most")).alias("less"), "best")).alias("first")
    rows = found.groupBy("word").agg(F.sum("near").alias("near"), first)
    return rows.select("word", "near", (-F.col("first.less")).alias("most"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """`word, root` of `word, form`: the last form of the chain. Counts grow along a chain, so it ends; each round
    doubles how far a word sees, and the longest chain is as the logarithm of the largest count."""
    now = reliable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = reliable(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of the corpus: `word, form, root, n, n_near, form_n`.

    `docs` needs `doc_id, text`; further columns are ignored. A null text has no words, a null id counts as the empty
    string before the colon, repeated rows count each, an empty table has no words. Ties between near words go to the
    smallest in code-point order. Words of any length take part; very long texts cost time in proportion.
    """
    words = reliable(vocabulary(docs))
    near = reliable(near_words(words))
    rows = words.join(near, "word", "left")
    holds = F.col("most") >= TIMES * F.col("n")
    rows = reliable(rows.select("word", F.when(holds, F.col("best")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("most")).alias("form_n")))
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return variants(docs)
