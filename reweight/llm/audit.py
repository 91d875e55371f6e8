"""How quality filters interact: sorted posting lists of failing ids, merged for every order of the filters."""

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.llm.common import empty_text, reliable

FILTERS = "ABCDE"
# Fixed values of the contract.
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
MARKS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
# Bytes of UTF-8 that continue a code point.
CONTINUE = bytes(range(0x80, 0xC0))
# Ids of one range share all but so many low bits, so a posting list has at most 2^RANGE_BITS of them.
RANGE_BITS = 16
# Texts that more than a HEAVYth of all rows have number fewer than HEAVY and are broadcast.
HEAVY = 1000


def failing(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails; words are runs of bytes other than ASCII white space."""
    words = raw.split()
    n = len(words)
    bits = n < LEAST_WORDS
    bits |= (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    bits |= (100 * capitals > MOST_CAPITALS * len(raw.translate(None, CONTINUE))) << 2
    return bits | (len(raw.translate(None, MARKS)) < len(raw)) << 3


ROW = "id long, doc_id long, part string, h1 long, h2 long, fails int"


def examined(batches):
    """(id, doc_id, part, UTF-8 text) to rows with the text's 128-bit hash and the filters that it fails."""
    for batch in batches:
        fails, hashes = [], []
        for raw in batch.column(3):
            raw = raw.as_py()
            fails.append(failing(raw))
            hashes.append(xxhash.xxh3_128_digest(raw))
        two = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        cols = [pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), pa.array(fails, pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], [c.split()[0] for c in ROW.split(", ")])


def with_copies(rows: DataFrame) -> DataFrame:
    """Rows with `copy`: a smaller doc_id has the same text. A null id is larger than all others.

    Copies are found from the least id per text, which is combined before the shuffle. The few texts that hold a large
    share of the rows meet their rows by broadcast; no other text has more than a HEAVYth of them in one task.
    """
    repeated = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    repeated = reliable(repeated.where("copies > 1"))
    heavy = F.col("copies") * HEAVY > F.lit(rows.count())
    first = rows.join(F.broadcast(repeated.where(heavy)), ["h1", "h2"], "left")
    rest = first.where("copies IS NULL").drop("least", "copies").join(repeated.where(~heavy), ["h1", "h2"], "left")
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id")))
    return first.where("copies IS NOT NULL").unionByName(rest).withColumn("copy", copy).drop("least", "copies", "h1", "h2")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with `good` and `bad`: some label of the id has quality 1, or toxic 1. Null ids have no label."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    named = rows.where("doc_id IS NOT NULL").join(known.where("good OR bad"), "doc_id", "left")
    none = rows.where("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("bad"))
    return named.unionByName(none)


def postings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`part, range, n, A, B, C, D, E, good, bad`: per part and id range, how many documents, and the sorted ids that
    fail each filter or have a label.

    Ids number the rows as read: repeated or null doc_ids stay rows of their own. A range has 2^RANGE_BITS ids at most,
    so that no list grows with the table, and one part that holds most rows is as many lists as it has ranges.
    """
    text = empty_text().cast("binary").alias("raw")
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    own = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), part, text)
    rows = reliable(own.mapInArrow(examined, ROW))
    rows = with_labels(with_copies(rows), labels)
    lists = [F.col("fails").bitwiseAND(F.lit(1 << i)) != 0 for i in range(4)] + [F.col(c) for c in ("copy", "good", "bad")]
    names = [*FILTERS, "good", "bad"]
    each = [F.sort_array(F.collect_list(F.when(x, F.col("id")))).alias(c) for c, x in zip(names, lists, strict=True)]
    span = F.shiftright("id", RANGE_BITS).alias("range")
    return rows.groupBy("part", span).agg(F.count(F.lit(1)).alias("n"), *each)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sorted lists. A stable sort of two sorted runs is one merge that gallops through the longer run."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def found(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which ids of sorted a are in sorted b; the shorter list is searched for in the longer one."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    if len(a) <= len(b):
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return b[at] == a
    out = np.zeros(len(a), bool)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    out[at[a[at] == b]] = True
    return out


SIZES = "part string, filter int, prior int, n long, gone long, removed long, good long, bad long"


def sizes(batches):
    """Posting lists to, per filter and set of earlier filters: ids gone before, removed by it, and their labels."""
    every = (1 << len(FILTERS)) - 1
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            part, n = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
            fail = [batch.column(3 + i)[r].values.to_numpy() for i in range(len(FILTERS))]
            good, bad = (batch.column(3 + len(FILTERS) + i)[r].values.to_numpy() for i in range(2))
            union = [np.zeros(0, np.int64)]
            for mask in range(1, every + 1):
                low = (mask & -mask).bit_length() - 1
                union.append(merged(union[mask & (mask - 1)], fail[low]))
            for f, own in enumerate(fail):
                for prior in range(every + 1):
                    if not prior >> f & 1:
                        gone = union[prior]
                        left = own[~found(own, gone)]
                        labelled = [int(found(left, x).sum()) for x in (good, bad)]
                        out.append((part, f, prior, n, len(gone), len(left), *labelled))
        names = [c.split()[0] for c in SIZES.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        cols = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filter, prior): the filter at each step of each order, and the bits of those before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        prior = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, f, prior))
            prior |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (a source; null is the empty string), order of the filters and step, with document counts.

    `docs` needs `doc_id, text, source`, `labels` needs `doc_id, quality, toxic`; further columns are ignored. A null
    text is the empty one, which fails A only. Repeated rows count each; rows of one id are no copies of each other
    unless a smaller id has the text; a null id is larger than all others and has no label. Of labels that repeat an id
    any one counts. No documents give no rows. Very long texts cost time in proportion.

    Only sizes leave the posting lists: 80 numbers of a list row, summed per part, give all orders.
    """
    lists = postings(docs, labels).select("part", "range", "n", *FILTERS, "good", "bad")
    sums = lists.mapInArrow(sizes, SIZES).groupBy("part", "filter", "prior").agg(*[F.sum(c).alias(c) for c in ("n", "gone", "removed", "good", "bad")])
    # Per part and filter: all that fail it, those that fail nothing else, and the sum over orders of what it removes.
    sums = reliable(sums)
    others = F.lit((1 << len(FILTERS)) - 1) - F.expr("shiftleft(1, filter)")
    before = F.bit_count("prior")
    ways = F.element_at(F.array(*[F.lit(w) for w in (24, 6, 4, 6, 24)]), before + 1)
    per = sums.groupBy("part", "filter").agg(
        F.max(F.when(F.col("prior") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("prior") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    spark = docs.sparkSession
    plan = spark.createDataFrame(orders(), "filter_order string, step int, filter int, prior int")
    rows = sums.join(per, ["part", "filter"]).join(F.broadcast(plan), ["filter", "prior"])
    return rows.select(
        "part", "filter_order", "step",
        (F.col("n") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("bad").alias("toxic_lost"), "shapley",
    )


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


def sql() -> str:
    """The audit from its definition: every document taken through every order."""
    names = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    bits = " + ".join(f"(({c})::INT << {i})" for i, c in enumerate("abcde"))
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, len(words) < {LEAST_WORDS} AS a,
          100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) AS b,
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) AS c,
          regexp_matches(t, '[#$%&*|]') AS d, least < w.doc_id AS e FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    m AS (SELECT part, good, bad, {bits} AS fails, count(*) AS n FROM f GROUP BY ALL),
    o(filter_order) AS (VALUES {names}),
    s AS (SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 65 AS x,
          list_sum([0] || [1 << (ascii(substr(filter_order, i, 1)) - 65) for i in range(1, step)])::INT AS prior
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (SELECT part, filter_order, step, x, n, good, bad, (fails >> x) & 1 AS hit, (fails & prior) = 0 AS here, fails = (1 << x) AS alone FROM m, s),
    t AS (SELECT part, filter_order, step, x,
          sum(CASE WHEN here AND hit = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND hit = 1 THEN n ELSE 0 END) AS removed,
          sum(CASE WHEN NOT here AND hit = 1 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
          sum(CASE WHEN here AND hit = 1 AND good = 1 THEN n ELSE 0 END) AS good_lost,
          sum(CASE WHEN here AND hit = 1 AND bad = 1 THEN n ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
           unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM t
    """
