"""Whole weighting jobs: from a train and a test table to one weight per training row."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweight.operators.bags import (
    Bags,
    bag_strategy,
    cartesian_pairs,
    cut_bags,
    partition_bags,
    random_disjoint,
    resolve_bags,
    whole_bag,
    width_of,
)
from reweight.operators.ensemble import mean_weights, share_weights
from reweight.operators.index import row_index
from reweight.operators.kernel import kernel_width
from reweight.operators.kmm import bag_weights


def bagged_kmm(
    train: DataFrame,
    test: DataFrame,
    mode: int,
    seed: int,
    *,
    tr_size: int | None = None,
    tr_count: int | None = None,
    te_size: int | None = None,
    te_count: int | None = None,
    tr_rows: int | None = None,
    te_rows: int | None = None,
    gamma: str = "bag",
    tail: str = "drop",
) -> DataFrame:
    """(row_id, beta): bags by strategy, one problem per pair, plain mean per training row.

    ``gamma="bag"`` takes each train bag's own width, ``"global"`` that of the whole train table. Partitions leave
    out the rows beyond the last full one unless ``tail="keep"``.
    """
    tr_rows = train.count() if tr_rows is None else tr_rows
    te_rows = test.count() if te_rows is None else te_rows
    source, width = row_index(train, n=tr_rows), width_of(train)
    tr, te, pairs = bag_strategy(
        source,
        test,
        mode,
        seed,
        tr_size=tr_size,
        tr_count=tr_count,
        te_size=te_size,
        te_count=te_count,
        tr_rows=tr_rows,
        te_rows=te_rows,
        width=width,
        tail=tail,
    )
    n_pairs = min(tr.count, te.count) if mode == 4 else tr.count * te.count
    shared = kernel_width(train, tr_rows, width=width) if gamma == "global" else None
    return mean_weights(bag_weights(tr, te, pairs, shared, n_pairs=n_pairs, source=source))


def test_ensemble_kmm(
    train: DataFrame,
    test: DataFrame,
    seed: int,
    *,
    te_size: int | None = None,
    te_count: int | None = None,
    tr_rows: int | None = None,
    te_rows: int | None = None,
    tail: str = "drop",
) -> DataFrame:
    """(row_id, beta): whole train against contiguous test parts, plain mean over the parts.

    Inside each part the test rows are split at random into chunks of floor(n_test / parts) rows, which are
    combined by their share of the part; only a part larger than that size has more than one chunk.
    """
    tr_rows = train.count() if tr_rows is None else tr_rows
    te_rows = test.count() if te_rows is None else te_rows
    size, parts = resolve_bags(te_rows, te_size, te_count)
    chunk = te_rows // (te_count or parts)
    width = width_of(train)
    gamma = kernel_width(train, tr_rows, width=width)
    tr = whole_bag(train, tr_rows, width=width)
    te = partition_bags(test, size, parts, te_rows, width=width, tail=tail)
    if chunk >= size:
        pairs = cartesian_pairs(train.sparkSession, tr.count, te.count)
        return mean_weights(bag_weights(tr, te, pairs, gamma, n_pairs=te.count))
    return _split_parts(tr, te, chunk, seed, gamma)


test_ensemble_kmm.__test__ = False


def _split_parts(tr: Bags, te: Bags, chunk: int, seed: int, gamma: float) -> DataFrame:
    """Parts cut again into random chunks: share-weighted sum inside a part, then the mean over parts.

    All full parts are one job, keyed by part; a shorter last part has chunks of other sizes and is a second one.
    """
    spark = te.df.sparkSession
    full = min(te.count, te.total // te.size)
    by_part = []
    if full:
        whole = Bags(te.df.where(F.col("bag_id") < full), full, te.size, full * te.size, te.width)
        cut = cut_bags(whole, chunk, seed)
        rows = bag_weights(tr, cut, cartesian_pairs(spark, 1, cut.count), gamma, n_pairs=cut.count)
        share = cut.rows("te_bag") / F.lit(float(te.size))
        part = F.floor(F.col("te_bag") / cut.cycle).alias("part")
        by_part.append(rows.groupBy(part, "row_id").agg(F.sum(share * F.col("beta")).alias("beta")).select("row_id", "beta"))
    if full < te.count:
        own = te.df.where(F.col("bag_id") == full).select("row_id", "features")
        cut = random_disjoint(own, chunk, seed, te.total - full * te.size, tag="part-last", width=te.width)
        rows = bag_weights(tr, cut, cartesian_pairs(spark, 1, cut.count), gamma, n_pairs=cut.count)
        by_part.append(share_weights(rows, cut, "row_id"))
    return mean_weights(reduce(DataFrame.unionByName, by_part))
