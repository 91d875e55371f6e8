"""Combining the weights of many bags into one weight per training row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweight.operators.bags import (
    Bags,
    bootstrap_bags,
    cartesian_pairs,
    random_disjoint,
    unsampled_rows,
    whole_bag,
    width_of,
)
from reweight.operators.index import row_index
from reweight.operators.kernel import kernel_width
from reweight.operators.kmm import bag_weights
from reweight.operators.lineage import reliable

__all__ = [
    "bagged_ensemble_weights",
    "bagged_train_weights",
    "mean_weights",
    "share_weights",
    "test_split_weights",
    "train_split_weights",
    "unsampled_rows",
]


def mean_weights(weights: DataFrame) -> DataFrame:
    """(row_id, beta): plain mean over all occurrences of a row."""
    return weights.groupBy("row_id").agg(F.avg("beta").alias("beta"))


def share_weights(weights: DataFrame, te: Bags, *keys: str) -> DataFrame:
    """Sum of beta over test bags, each weighted by its share of the test rows."""
    share = te.rows("te_bag") / F.lit(float(te.total))
    return weights.groupBy(*keys).agg(F.sum(share * F.col("beta")).alias("beta"))


def _sizes(train: DataFrame, test: DataFrame, tr_rows: int | None, te_rows: int | None) -> tuple[int, int]:
    return (train.count() if tr_rows is None else tr_rows, test.count() if te_rows is None else te_rows)


def test_split_weights(
    train: DataFrame,
    test: DataFrame,
    split_size: int,
    seed: int,
    *,
    gamma: float | None = None,
    tr_rows: int | None = None,
    te_rows: int | None = None,
) -> DataFrame:
    """(row_id, beta): the whole train against random disjoint test splits, weighted by split size."""
    tr_rows, te_rows = _sizes(train, test, tr_rows, te_rows)
    width = width_of(train)
    gamma = kernel_width(train, tr_rows, width=width) if gamma is None else gamma
    te = random_disjoint(test, split_size, seed, te_rows, tag="split-test", width=width)
    tr = whole_bag(train, tr_rows, width=width)
    pairs = cartesian_pairs(train.sparkSession, 1, te.count)
    return share_weights(bag_weights(tr, te, pairs, gamma, n_pairs=te.count), te, "row_id")


test_split_weights.__test__ = False


def train_split_weights(
    train: DataFrame,
    test: DataFrame,
    split_size: int,
    seed: int,
    *,
    gamma: float | None = None,
    tr_rows: int | None = None,
    te_rows: int | None = None,
) -> DataFrame:
    """(row_id, beta): random disjoint train splits against the whole test, scaled to a mean of 1."""
    tr_rows, te_rows = _sizes(train, test, tr_rows, te_rows)
    width = width_of(train)
    gamma = kernel_width(train, tr_rows, width=width) if gamma is None else gamma
    tr = random_disjoint(train, split_size, seed, tr_rows, tag="split-train", width=width)
    te = whole_bag(test, te_rows, width=width)
    pairs = cartesian_pairs(train.sparkSession, tr.count, 1)
    return to_mean_one(bag_weights(tr, te, pairs, gamma, n_pairs=tr.count), tr_rows)


def to_mean_one(weights: DataFrame, n: int) -> DataFrame:
    """beta / sum(beta) * n. The weights are checkpointed, as the total would otherwise solve them again."""
    solved = reliable(weights.select("row_id", "beta"))
    total = solved.agg(F.sum("beta")).first()[0]
    return solved.withColumn("beta", F.col("beta") / F.lit(total) * F.lit(float(n)))


def bagged_train_weights(
    train: DataFrame,
    test: DataFrame,
    bag_size: int,
    bags: int,
    seed: int,
    *,
    gamma: float | None = None,
    tr_rows: int | None = None,
    te_rows: int | None = None,
) -> DataFrame:
    """(row_id, beta): bootstrap train bags against the whole test, mean per row; unsampled rows are absent."""
    tr_rows, te_rows = _sizes(train, test, tr_rows, te_rows)
    width = width_of(train)
    gamma = kernel_width(train, tr_rows, width=width) if gamma is None else gamma
    source = row_index(train, n=tr_rows)
    tr = bootstrap_bags(source, bag_size, bags, seed, tr_rows, tag="boot-train", width=width)
    pairs = cartesian_pairs(train.sparkSession, bags, 1)
    te = whole_bag(test, te_rows, width=width)
    return mean_weights(bag_weights(tr, te, pairs, gamma, n_pairs=bags, source=source))


def bagged_ensemble_weights(
    train: DataFrame,
    test: DataFrame,
    bag_size: int,
    bags: int,
    split_size: int,
    seed: int,
    *,
    gamma: float | None = None,
    tr_rows: int | None = None,
    te_rows: int | None = None,
) -> DataFrame:
    """(row_id, beta): bootstrap train bags against random test splits; size-weighted inside a bag, then mean."""
    tr_rows, te_rows = _sizes(train, test, tr_rows, te_rows)
    width = width_of(train)
    gamma = kernel_width(train, tr_rows, width=width) if gamma is None else gamma
    source = row_index(train, n=tr_rows)
    tr = bootstrap_bags(source, bag_size, bags, seed, tr_rows, tag="boot-train", width=width)
    te = random_disjoint(test, split_size, seed, te_rows, tag="split-test", width=width)
    pairs = cartesian_pairs(train.sparkSession, bags, te.count)
    solved = bag_weights(tr, te, pairs, gamma, n_pairs=bags * te.count, source=source)
    return mean_weights(share_weights(solved, te, "tr_bag", "pos", "row_id"))
