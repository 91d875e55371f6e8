"""Mean, spread and acceptance probability of a feature table.

A table holds its features as ``features ARRAY<DOUBLE>`` or, where most are zero, as ``entries MAP<INT,DOUBLE>``.
Sparse rows are never filled: a squared distance is that of the zero row plus a term for each entry.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweight.functions.vectors import sq_distance_to
from reweight.operators.bags import width_of


def is_sparse(df: DataFrame) -> bool:
    return "entries" in df.columns and "features" not in df.columns


def mean_vector(df: DataFrame) -> DataFrame:
    """(pos, mean): per-feature mean over all rows (vectors are zero-filled, so none is skipped).

    One partial vector per task is combined, so a row is never taken apart; no row, no means. For sparse rows,
    one row per feature that any row has.
    """
    if is_sparse(df):
        n = df.count()
        sums = df.select(F.explode("entries").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
        return sums.select("pos", (F.col("v") / F.lit(float(max(n, 1)))).alias("mean"))
    means = df.agg(Summarizer.mean(array_to_vector("features")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return means.select(F.posexplode(vector_to_array("m")).alias("pos", "mean"))


@dataclass(frozen=True)
class Spread:
    """Centre of a table and the population deviation of squared distances to it; model sized."""

    mean: tuple[float, ...]
    std: float
    rows: int
    sparse: bool = False

    def d2(self) -> Column:
        return sparse_distance_to(self.mean) if self.sparse else sq_distance_to("features", self.mean)


def sparse_distance_to(center: tuple[float, ...]) -> Column:
    """Squared distance of `entries` to a point: (x - m)^2 - m^2 for each entry, on top of the zero row's."""
    means = F.lit(np.asarray(center, dtype=float))
    rest = F.lit(float(np.square(center).sum()))
    term = lambda a, e: a + e["value"] * (e["value"] - 2.0 * F.element_at(means, e["key"] + 1))
    return F.aggregate(F.map_entries("entries"), rest, term)


def _center(df: DataFrame) -> tuple[float, ...]:
    means = dict(map(tuple, mean_vector(df).collect()))
    return tuple(means.get(i, 0.0) for i in range(max(means, default=-1) + 1))


def fit_spread(df: DataFrame) -> Spread:
    """Three aggregate passes, the first of which refuses missing and ragged vectors; the result is held as
    literals so every later pass uses the same numbers."""
    sparse = is_sparse(df)
    if sparse:
        missing = df.where(F.col("entries").isNull() | F.exists(F.map_values("entries"), lambda v: v.isNull())).count()
        if missing:
            raise ValueError(f"{missing} rows have no entries or null ones")
    else:
        width_of(df)
    fit = Spread(_center(df), 0.0, 0, sparse)
    std, n = df.agg(F.stddev_pop(fit.d2()), F.count(F.lit(1))).first()
    return Spread(fit.mean, std or 0.0, n, sparse)


def dispersion(df: DataFrame) -> DataFrame:
    """One row: population standard deviation of the squared distance to the mean."""
    return df.agg(F.stddev_pop(Spread(_center(df), 0.0, 0, is_sparse(df)).d2()).alias("std"))


def accept_prob(df: DataFrame, spread: Spread | None = None) -> DataFrame:
    """Add d2 and p = exp(-d2 / std); the divisor is the deviation, not the variance."""
    fit = spread or fit_spread(df)
    return df.withColumn("d2", fit.d2()).withColumn("p", F.exp(-F.col("d2") / F.lit(fit.std)))
