"""Biased train/test splits with a known true weight per training row.

Drawing rows one at a time in proportion to p, without replacement, has the law of sorting independent
exponential clocks -ln(u)/p (Efraimidis and Spirakis, 2006). The logarithm ln(-ln u) + d2/std of the clock
is used, so p never underflows. The train side is then a filter on the clock and the test side its negation.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweight.functions.uniform import uniform
from reweight.operators.index import bucket_by_key, number_rows
from reweight.operators.lineage import reliable
from reweight.operators.select import kth_cut
from reweight.operators.stats import Spread, fit_spread


@dataclass(frozen=True)
class Split:
    """Both sides of a split; `train` has ``true_beta``."""

    train: DataFrame
    test: DataFrame
    train_rows: int
    test_rows: int


def _check(train_size: int, fit: Spread) -> None:
    if train_size > fit.rows:
        raise ValueError(f"train_size {train_size} is larger than the table ({fit.rows} rows)")
    if train_size > 0 and fit.std == 0.0:
        raise ValueError("all rows are at the same distance from the mean: no acceptance scale (std = 0)")


def clock(d2: Column, std: float, seed: int, *keys: Column | str) -> Column:
    """Log arrival time of a row; smaller is drawn earlier."""
    return F.log(-F.log(uniform("clock", seed, *keys))) + d2 / F.lit(std)


def true_weight(d2: Column, std: float | Column) -> Column:
    return F.exp(d2 / std)


def biased_split(df: DataFrame, train_size: int, seed: int, *, reverse: bool = False) -> Split:
    """`train_size` rows drawn in proportion to p at the fixed base scale.

    With ``reverse`` the size given is that of the test side. Unlike :func:`escalated_split` the scale never
    grows, so the two differ when a run of `train_size` rejections would have widened it.
    """
    fit = fit_spread(df)
    size = fit.rows - train_size if reverse else train_size
    _check(size, fit)
    if size <= 0:
        return Split(df.withColumn("true_beta", F.lit(0.0)).limit(0), df, 0, fit.rows)
    timed = df.withColumn("__d2", fit.d2()).withColumn("__clock", clock(F.col("__d2"), fit.std, seed, "row_id"))
    cut = kth_cut(timed, "__clock", "row_id", size, fit.rows)
    train = timed.where(cut.inside()).withColumn("true_beta", true_weight(F.col("__d2"), F.lit(fit.std)))
    test = timed.where(~cut.inside())
    return Split(train.drop("__d2", "__clock"), test.drop("__d2", "__clock"), size, fit.rows - size)


def escalated_split(df: DataFrame, train_size: int, seed: int) -> Split:
    """The full sampling law: after `train_size` rejections in a row the scale becomes std * (level + 1).

    Before the next accepted row there is a geometric number of rejections with success chance W/R (weight
    and count of the rows still there), whichever row is accepted next. So a level orders the remaining rows
    by clock, draws that gap for each of the first rows, and ends at the first gap of `train_size` or more.
    """
    fit = fit_spread(df)
    _check(train_size, fit)
    base = reliable(df.select("row_id", fit.d2().alias("d2")))
    taken, left, need, level = None, base, train_size, 1
    remaining = fit.rows
    while need > 0:
        std = fit.std * level
        timed = left.withColumn("p", F.exp(-F.col("d2") / F.lit(std))).withColumn(
            "clock", clock(F.col("d2"), std, seed, F.lit(level), "row_id")
        )
        cut = kth_cut(timed, "clock", "row_id", need, remaining)
        rest_weight = timed.where(~cut.inside()).agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0]
        head = bucket_by_key(timed.where(cut.inside()), "clock", need, "bucket")
        order = [F.col("clock"), F.col("row_id")]
        head = number_rows(head, order, bucket="bucket", n=need, out="j", suffix_sum="p")
        chance = (F.col("j_suffix") + F.lit(rest_weight)) / (F.lit(float(remaining)) - F.col("j"))
        gap = F.floor(F.log(uniform("gap", seed, F.lit(level), "j")) / F.log1p(-F.least(chance, F.lit(1.0))))
        # A chance of 1 has no rejections; a chance that underflows to 0 never accepts again.
        stops = F.when(chance >= 1.0, False).when(chance <= 0.0, True).otherwise(gap >= train_size)
        head = reliable(head.select("row_id", "d2", "j", stops.alias("stops")))
        stop_at = head.where("stops").agg(F.min("j")).first()[0]
        kept = need if stop_at is None else int(stop_at)
        if kept:
            rows = head.where(F.col("j") < kept).select("row_id", true_weight(F.col("d2"), F.lit(std)).alias("true_beta"))
            taken = rows if taken is None else taken.unionByName(rows)
            if kept < need:
                left = reliable(left.join(rows.select("row_id"), "row_id", "left_anti"))
        need, remaining, level = need - kept, remaining - kept, level + 1
        if level > 1_000_000 or not math.isfinite(std):
            raise RuntimeError("the acceptance scale no longer grows")
    if taken is None:
        return Split(df.withColumn("true_beta", F.lit(0.0)).limit(0), df, 0, fit.rows)
    return Split(df.join(taken, "row_id"), test_remainder(df, taken), train_size, fit.rows - train_size)


def test_remainder(df: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of the table that were not drawn."""
    return df.join(train.select("row_id"), "row_id", "left_anti")


test_remainder.__test__ = False
