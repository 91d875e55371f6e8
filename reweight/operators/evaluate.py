"""Scoring estimated weights against the known ones."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align_truth(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """(row_id, beta, true_beta, other columns of the estimate): truth of the rows that have an estimate."""
    return estimate.join(truth.select("row_id", "true_beta"), "row_id")


def nmse(aligned: DataFrame, *keys: str, extra: Sequence[Column] = ()) -> DataFrame:
    """(keys, rows, nmse, extra aggregates): mean of (beta / sum(beta) - true_beta / sum(true_beta))^2.

    Both shares average 1/n, so the score is the variance of their difference and follows from streaming
    moments: one pass with partial aggregation, no totals sent back to the rows.
    """
    b, t = F.col("beta"), F.col("true_beta")
    moments = aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(b).alias("sb"),
        F.sum(t).alias("st"),
        F.var_pop(b).alias("vb"),
        F.var_pop(t).alias("vt"),
        F.covar_pop(b, t).alias("c"),
        *extra,
    )
    score = F.expr("greatest(0e0, vb / (sb * sb) + vt / (st * st) - 2e0 * c / (sb * st))")
    return moments.withColumn("nmse", score).drop("sb", "st", "vb", "vt", "c")
