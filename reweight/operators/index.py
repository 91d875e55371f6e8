"""Dense positions and running sums over a global order, without a one-partition window.

The order is cut into buckets by a function of the leading key. One aggregation counts the buckets; after
that the window only has to order rows inside a bucket, and each bucket's offset is a literal.
"""

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows aimed at per bucket, and the most buckets (their counts are the only thing the driver holds).
BUCKET_ROWS = 10_000
MAX_BUCKETS = 100_000


def bucket_count(n: int) -> int:
    return int(min(MAX_BUCKETS, max(1, -(-n // BUCKET_ROWS))))


def bucket_by_key(df: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """Equal-frequency buckets of a numeric key; the cut points are literals, so retries agree."""
    buckets = bucket_count(n)
    value = F.col(key).cast("double")
    if buckets == 1:
        return df.withColumn(out, F.lit(0))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(value, shares, 10 * buckets).alias("cuts")).first()["cuts"] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    named = df.withColumn("__key", value)
    cutter = Bucketizer(splits=splits, inputCol="__key", outputCol="__cut", handleInvalid="error")
    return cutter.transform(named).withColumn(out, F.col("__cut").cast("int")).drop("__key", "__cut")


def number_rows(
    df: DataFrame, order: list[Column], *, bucket: str, n: int, out: str = "idx", suffix_sum: str | None = None
) -> DataFrame:
    """Add the 0-based position `out` in the order; `bucket` must not decrease along it.

    A table of one bucket needs no offsets, so nothing is counted.

    With ``suffix_sum`` also adds ``{out}_suffix``: the sum of that column from the row to the end, summed
    from the end so that small tails keep their digits.
    """
    w = Window.partitionBy(bucket).orderBy(*order)
    place = F.row_number().over(w).cast("long") - 1
    tail = w.rowsBetween(0, Window.unboundedFollowing)
    if bucket_count(n) == 1:
        res = df.withColumn(out, place)
        return res.withColumn(f"{out}_suffix", F.sum(suffix_sum).over(tail)) if suffix_sum else res
    aggs = [F.count(F.lit(1)).alias("rows")]
    if suffix_sum:
        aggs.append(F.sum(suffix_sum).alias("total"))
    sizes = df.groupBy(bucket).agg(*aggs).collect()
    width = 1 + max((r[bucket] for r in sizes), default=0)
    rows = np.zeros(width + 1, dtype=np.int64)
    for r in sizes:
        rows[r[bucket] + 1] = r["rows"]
    starts = F.lit(np.cumsum(rows)[:-1])
    res = df.withColumn(out, place + F.element_at(starts, F.col(bucket) + 1))
    if suffix_sum:
        totals = np.zeros(width + 1)
        for r in sizes:
            totals[r[bucket]] = r["total"]
        after = F.lit(np.cumsum(totals[::-1])[::-1][1:].copy())
        res = res.withColumn(
            f"{out}_suffix", F.sum(suffix_sum).over(tail) + F.element_at(after, F.col(bucket) + 1)
        )
    return res


def row_index(df: DataFrame, key: str = "row_id", out: str = "idx", n: int | None = None) -> DataFrame:
    """Dense positions 0..n-1 in the order of a unique numeric key."""
    n = df.count() if n is None else n
    cut = bucket_by_key(df, key, n, "__bucket")
    return number_rows(cut, [F.col(key)], bucket="__bucket", n=n, out=out).drop("__bucket")


def shuffle_index(
    df: DataFrame,
    u: Column,
    n: int,
    tie: str = "row_id",
    out: str = "idx",
    rep: str | None = None,
    reps: int = 1,
) -> DataFrame:
    """Dense positions in a random order given by a uniform column; equal-width buckets are even.

    With `rep`, an INT column 0..reps-1 over `reps` copies of the n rows, positions start anew in each copy.
    """
    per_copy = bucket_count(n)
    cut = F.floor(F.col("__u") * per_copy).cast("int")
    drawn = df.withColumn("__u", u).withColumn("__bucket", cut + F.col(rep) * per_copy if rep else cut)
    order = [F.col("__u"), F.col(tie)]
    if not rep or per_copy == 1:
        return number_rows(drawn, order, bucket="__bucket", n=n, out=out).drop("__u", "__bucket")
    placed = number_rows(drawn, order, bucket="__bucket", n=n * reps, out=out).drop("__u", "__bucket")
    return placed.withColumn(out, F.col(out) - F.col(rep).cast("long") * n)
