"""The k smallest rows of a table by exact distributed selection.

A sort with a limit sends k rows from every input partition to one task. Instead the k-th value is found
by counting: each pass histograms the range that still holds it and keeps one bin. The result is a plain
filter, so "the rest" is its negation.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
# Once this few rows share the bin of the k-th row, they are ordered directly.
DIRECT_ROWS = 250_000


@dataclass(frozen=True)
class Cut:
    """Boundary row of a selection: rows ordered up to and including it are in."""

    key: str
    tie: str
    value: float
    tie_value: int

    def inside(self) -> Column:
        k, t = F.col(self.key), F.col(self.tie)
        return (k < F.lit(self.value)) | ((k == F.lit(self.value)) & (t <= F.lit(self.tie_value)))


def _narrow(df: DataFrame, col: str, k: int):
    """Shrink the value range holding the k-th smallest `col`; returns rows in range and remaining k."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(F.lit(1))).first()
    part = df
    while n > DIRECT_ROWS and lo < hi:
        step = (hi - lo) / BINS
        if lo + step <= lo:
            break
        at = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(step)), F.lit(BINS - 1))
        bins = (
            part.groupBy(at.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
            .orderBy("bin")
            .collect()
        )
        for b in bins:
            if k <= b["n"]:
                lo, hi, n = b["lo"], b["hi"], b["n"]
                break
            k -= b["n"]
        part = df.where(F.col(col).between(F.lit(lo), F.lit(hi)))
    return part, k, lo, hi, n


def kth_cut(df: DataFrame, key: str, tie: str, k: int, n: int | None = None) -> Cut:
    """Boundary of the k smallest rows by (key, tie); `tie` is a unique LONG, `n` the row count if known."""
    part, lo, hi = df.select(key, tie), None, None
    if n is None or n > DIRECT_ROWS:
        part, k, lo, hi, n = _narrow(part, key, k)
    while n > DIRECT_ROWS and lo < hi:
        # Two neighbouring doubles share the last bin: step to the one that holds the k-th row.
        low = part.where(F.col(key) == F.lit(lo)).count()
        if k <= low:
            hi, n = lo, low
        else:
            k, n = k - low, n - low
            lo = part.where(F.col(key) > F.lit(lo)).agg(F.min(key)).first()[0]
        part = part.where(F.col(key).between(F.lit(lo), F.lit(hi)))
    if n > DIRECT_ROWS:
        part, k, *_ = _narrow(part, tie, k)
    row = part.orderBy(key, tie).limit(k).agg(F.max(F.struct(key, tie)).alias("m")).first()["m"]
    return Cut(key, tie, row[key], row[tie])


def first_n(df: DataFrame, size: int, order: str = "row_id") -> DataFrame:
    """The first `size` rows in row order; all of them when the table is shorter."""
    if size <= 0:
        return df.limit(0)
    n = df.count()
    if n <= size:
        return df
    cut = kth_cut(df.withColumn("__tie", F.col(order)), order, "__tie", size, n)
    return df.where(F.col(order) <= F.lit(cut.value))
