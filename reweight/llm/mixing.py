"""Interleaving sources to target weights by Pfair scheduling."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reweight.llm.common import empty_text, power_of_two
from reweight.operators.lineage import broadcast_if

# Production parameters: shares are whole numbers, a source that is not named has the default share.
SHARES = {"src0": 6, "src1": 3, "src2": 3}
SHARE = 2
BLOCK_BYTES = 1 << 20
SEED = 11
# The sum of all shares is the length of one period, whose table is broadcast; a row of it takes under 100 bytes.
MAX_PERIOD = 100_000
BUCKET_ROWS = 50_000


def period(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one period: earliest deadline first among released blocks.

    Block j of a source with weight w is released at floor(j / w) and due at ceil((j + 1) / w). Windows repeat
    with the sum of the shares, so one period is the whole schedule.
    """
    total = sum(shares.values())
    if total > MAX_PERIOD:
        raise ValueError(f"the shares sum to {total}, more than {MAX_PERIOD}")
    done, out = dict.fromkeys(shares, 0), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // n), s) for s, n in shares.items() if done[s] < n and done[s] * total // n <= t]
        source = min(ready)[1]
        out.append((source, done[source], t))
        done[source] += 1
    return out


def shares_of(docs: DataFrame, shares: dict[str, int], share: int) -> dict[str, int]:
    """The share of every source that the table has; null is the source with the empty name."""
    names = docs.select(F.coalesce("source", F.lit("")).alias("s")).distinct().limit(MAX_PERIOD + 1).collect()
    found = {r["s"]: int(shares.get(r["s"], share)) for r in names}
    if any(n < 1 for n in found.values()):
        raise ValueError("shares must be whole numbers of at least 1")
    return dict(sorted(found.items()))


def mix(
    docs: DataFrame, shares: dict[str, int] = SHARES, share: int = SHARE, block_bytes: int = BLOCK_BYTES, seed: int = SEED, carry: bool = False
) -> DataFrame:
    """A place in the mixture for every document: sort by `turn, start` to read the mixture.

    Each source is laid out in a seeded order and cut into blocks of `block_bytes`; a document belongs to the block
    in which it starts. While sources last, at any turn the blocks drawn from a source differ from its target
    share by less than one. A source that is used up leaves its turns empty, so the others keep their proportions
    and no document is dropped or repeated.

    Null texts have one byte, null sources share the empty name, null ids are ordered as the text "null", repeated
    rows each keep a place, further columns are ignored, an empty table gives no rows. A hot source is cut into
    buckets of its seeded order; only bucket sums are ordered per source. With `carry`, a column `row` holds all
    columns of `docs`.
    """
    spark = docs.sparkSession
    found = shares_of(docs, shares, share)
    total = sum(found.values())
    buckets = power_of_two(docs.count() // BUCKET_ROWS, least=64)
    # One turn of the 64-bit md5 prefix decides the order; the first four digits the bucket.
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    narrow = [
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        (F.octet_length(empty_text()) + 1).cast("long").alias("bytes"),
        key.alias("key"),
        F.shiftright(F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), 16 - (buckets.bit_length() - 1)).alias("bucket"),
    ]
    rows = docs.select(*narrow, *([F.struct("*").alias("row")] if carry else []))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.select(*narrow).groupBy("source", "bucket").agg(F.sum("bytes").alias("b"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    # A row of the sums takes under 100 bytes; their number is known.
    sums = broadcast_if(sums, 100 * buckets * max(1, len(found)))
    rows = rows.join(sums, ["source", "bucket"]).withColumn("start", F.col("inside") + F.col("offset"))
    table = [(s, found[s], j, t) for s, j, t in period(found)] if found else []
    turns = spark.createDataFrame(table, "source string, share int, j int, turn_in_period long")
    block = F.floor(F.col("start") / F.lit(block_bytes))
    share_table = spark.createDataFrame(list(found.items()), "source string, share int")
    rows = rows.withColumn("block", block).join(F.broadcast(share_table), "source")
    rows = rows.withColumn("j", F.pmod("block", "share").cast("int")).join(F.broadcast(turns.drop("share")), ["source", "j"])
    return rows.select(
        "doc_id",
        "source",
        "bytes",
        "start",
        "block",
        F.expr(f"(block * {total}) div share").alias("release"),
        F.expr(f"((block + 1) * {total} + share - 1) div share").alias("deadline"),
        F.expr(f"(block div share) * {total} + turn_in_period").alias("turn"),
        *(["row"] if carry else []),
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs)


def sql() -> str:
    """The same rows in SQL; the schedule of a period is found by recursion over its slots."""
    named = " ".join(f"WHEN '{s}' THEN {n}" for s, n in SHARES.items())
    return f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, coalesce(source, '') AS source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS bytes,
             md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
    s AS (SELECT source, CAST(CASE source {named} ELSE {SHARE} END AS BIGINT) AS share FROM (SELECT DISTINCT source FROM d)),
    h AS (SELECT CAST(sum(share) AS BIGINT) AS total FROM s),
    jobs AS (SELECT source, share, j, (j * total) // share AS release, ((j + 1) * total + share - 1) // share AS deadline
             FROM s, h, LATERAL (SELECT unnest(range(share)) AS j)),
    plan(t, done) AS (
      SELECT CAST(-1 AS BIGINT), CAST([] AS STRUCT(source VARCHAR, j BIGINT)[])
      UNION ALL
      SELECT t + 1, list_append(done, (SELECT {{'source': source, 'j': j}} FROM jobs
                                       WHERE release <= t + 1 AND NOT list_contains(done, {{'source': source, 'j': j}})
                                       ORDER BY deadline, source, j LIMIT 1))
      FROM plan, h WHERE t + 1 < total),
    slots AS (SELECT done[len(done)].source AS source, done[len(done)].j AS j, t FROM plan WHERE t >= 0),
    b AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY key, doc_id, bytes
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
    c AS (SELECT b.*, start // {BLOCK_BYTES} AS block, share, total FROM b JOIN s USING (source), h)
    SELECT doc_id, c.source, bytes, start, block, (block * total) // share AS release,
           ((block + 1) * total + share - 1) // share AS deadline, (block // share) * total + t AS turn
    FROM c JOIN slots ON slots.source = c.source AND slots.j = c.block % c.share
    """
