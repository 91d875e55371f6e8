"""Running, scoring and comparing weighting methods."""

import time
from collections.abc import Mapping, Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reweight.operators.bags import (
    bootstrap_bags,
    cartesian_pairs,
    coverage_count,
    random_disjoint,
    resolve_bags,
    whole_bag,
    width_of,
)
from reweight.operators.ensemble import (
    bagged_ensemble_weights,
    bagged_train_weights,
    test_split_weights,
    train_split_weights,
)
from reweight.operators.evaluate import align_truth, nmse
from reweight.operators.index import row_index
from reweight.operators.kernel import kernel_width
from reweight.operators.kmm import bag_weights, kmm_whole
from reweight.operators.lineage import at_once, reliable
from reweight.operators.split import Split, biased_split, escalated_split
from reweight.plans.pipelines import bagged_kmm, test_ensemble_kmm

# Fixed values of the study.
COVERAGE_EPS = 0.01
SPLITS = (5, 10, 15, 20)
SAMPLES = (50, 100, 150, 200)
REPETITIONS = 5


def run_stats(
    split: Split,
    method: str,
    seed: int,
    *,
    mode: int = 1,
    tr_size: int | None = None,
    tr_count: int | None = None,
    te_size: int | None = None,
    te_count: int | None = None,
    tail: str = "drop",
) -> DataFrame:
    """Run one method and report one row of sizes, phase seconds and score.

    `method` is ``bagged`` (by `mode`), ``test_ensemble`` or ``whole``. The weights are written to checkpoint
    storage between the compute and the evaluate phase, so neither phase repeats the other. `train_left_out` and
    `test_left_out` count rows beyond the last full partition, which `tail="keep"` gives a bag of their own.
    """
    n, x = split.train_rows, split.test_rows
    start = time.perf_counter()
    if method == "bagged":
        s, m = resolve_bags(n, tr_size, tr_count)
        te_s, te_n = resolve_bags(x, te_size, te_count)
        lazy = bagged_kmm(
            split.train,
            split.test,
            mode,
            seed,
            tr_size=tr_size,
            tr_count=tr_count,
            te_size=te_size,
            te_count=te_count,
            tr_rows=n,
            te_rows=x,
            tail=tail,
        )
    elif method == "test_ensemble":
        s, m = n, 1
        te_s, te_n = resolve_bags(x, te_size, te_count)
        lazy = test_ensemble_kmm(
            split.train, split.test, seed, te_size=te_size, te_count=te_count, tr_rows=n, te_rows=x, tail=tail
        )
    elif method == "whole":
        s, m, te_s, te_n = n, 1, x, 1
        lazy = kmm_whole(split.train, split.test, tr_rows=n, te_rows=x).select("row_id", "beta")
    else:
        raise ValueError("method is bagged, test_ensemble or whole")
    cut_train, cut_test = method == "bagged" and mode == 2, method == "test_ensemble" or (method == "bagged" and mode == 1)
    left_out = [max(0, r - b * c) if cut and tail == "drop" else 0 for cut, r, b, c in ((cut_train, n, s, m), (cut_test, x, te_s, te_n))]
    planned = time.perf_counter()
    weights = reliable(lazy)
    solved = time.perf_counter()
    score = nmse(align_truth(weights, split.train)).first()["nmse"]
    scored = time.perf_counter()
    row = (
        method,
        mode if method == "bagged" else None,
        n,
        x,
        s,
        m,
        te_s,
        te_n,
        *left_out,
        planned - start,
        solved - planned,
        scored - solved,
        scored - start,
        score,
    )
    schema = (
        "method string, mode int, train_rows long, test_rows long, tr_bag_size long, tr_bags long, "
        "te_bag_size long, te_bags long, train_left_out long, test_left_out long, bagging_seconds double, compute_seconds double, "
        "evaluate_seconds double, total_seconds double, nmse double"
    )
    return split.train.sparkSession.createDataFrame([row], schema)


def method_weights(split: Split, size: int, bags: int, seed: int, *, full: bool = True) -> DataFrame:
    """(method, row_id, beta): the ensemble methods, and the whole-table one, on one split."""
    gamma = kernel_width(split.train, split.train_rows)
    how = {"gamma": gamma, "tr_rows": split.train_rows, "te_rows": split.test_rows}
    sides = (split.train, split.test)
    methods = {
        "test_split": partial(test_split_weights, *sides, size, seed, **how),
        "train_split": partial(train_split_weights, *sides, size, seed, **how),
        "train_bags": partial(bagged_train_weights, *sides, size, bags, seed, **how),
        "train_bags_test_split": partial(bagged_ensemble_weights, *sides, size, bags, size, seed, **how),
    }
    if full:
        methods["whole"] = lambda: kmm_whole(*sides, **how).select("row_id", "beta")
    out = None
    # Large bags are solved when they are asked for, each method by its own jobs.
    for name, weights in zip(methods, at_once(split.train.sparkSession, list(methods.values()))):
        named = weights.select(F.lit(name).alias("method"), "row_id", "beta")
        out = named if out is None else out.unionByName(named)
    return out


def compare_methods(split: Split, size: int, bags: int, seed: int, *, full: bool = True) -> DataFrame:
    """(method, rows, nmse) of every method on one split."""
    return nmse(align_truth(method_weights(split, size, bags, seed, full=full), split.train), "method")


def sweep(
    split: Split,
    ks: Sequence[int] = SPLITS,
    samples: Sequence[int] = SAMPLES,
    reps: int = REPETITIONS,
    seed: int = 0,
) -> DataFrame:
    """(method, k, s, rep, nmse, seconds) over a grid of split counts, bag counts and repetitions.

    For each k the bags of all (s, rep) settings form one bag table, so the grid is solved as one job whose
    problems are spread over the cluster. Methods without bootstrap bags do not depend on s and are reported
    for each s. `seconds` is the mean time of one problem.
    """
    n, x = split.train_rows, split.test_rows
    width = width_of(split.train)
    gamma = kernel_width(split.train, n, width=width)
    source = row_index(split.train, n=n)
    whole_tr, whole_te = whole_bag(source, n, width=width), whole_bag(split.test, x, width=width)
    spark = split.train.sparkSession
    parts = []
    for k in ks:
        size = n // k
        counts = sorted({coverage_count(n, COVERAGE_EPS, size), *samples})
        # Bags are numbered setting by setting; a setting is (rep, s).
        settings = [(r, s) for r in range(reps) for s in counts]
        ends = np.cumsum([s for _, s in settings])
        total = int(ends[-1])
        setting = F.size(F.filter(F.lit(ends), lambda e: e <= F.col("tr_bag")))
        rep_of = F.floor(setting / len(counts)).cast("int")
        s_of = F.element_at(F.lit(np.array(counts)), (setting % len(counts)).cast("int") + 1).cast("int")

        te = random_disjoint(split.test, size, seed, x, tag=f"sweep-test-{k}", width=width, reps=reps)
        tr = random_disjoint(split.train, size, seed, n, tag=f"sweep-train-{k}", width=width, reps=reps)
        boot = bootstrap_bags(source, size, total, seed, n, tag=f"sweep-boot-{k}", width=width)
        te_cycle = te.count // reps

        pairs = cartesian_pairs(spark, total, te_cycle).withColumn("te_bag", F.col("te_bag") + rep_of * te_cycle)
        by_test, by_train, bagged, both = at_once(spark, [
            partial(bag_weights, whole_tr, te, cartesian_pairs(spark, 1, te.count), gamma, n_pairs=te.count),
            partial(bag_weights, tr, whole_te, cartesian_pairs(spark, tr.count, 1), gamma, n_pairs=tr.count),
            partial(bag_weights, boot, whole_te, cartesian_pairs(spark, total, 1), gamma, n_pairs=total, source=source),
            partial(bag_weights, boot, te, pairs, gamma, n_pairs=total * te_cycle, source=source),
        ])
        by_test = by_test.withColumn("rep", F.floor(F.col("te_bag") / te_cycle).cast("int"))
        share = te.rows("te_bag") / F.lit(float(x))
        by_test = by_test.groupBy("rep", "row_id").agg(
            F.sum(share * F.col("beta")).alias("beta"), F.avg("seconds").alias("seconds")
        )
        tr_cycle = tr.count // reps
        by_train = by_train.select(
            F.floor(F.col("tr_bag") / tr_cycle).cast("int").alias("rep"), "row_id", "beta", "seconds"
        )
        every_s = F.explode(F.lit(np.array(counts, dtype=np.int32))).alias("s")
        for name, rows in (("test_split", by_test), ("train_split", by_train)):
            parts.append(rows.select(F.lit(name).alias("method"), F.lit(k).alias("k"), every_s, "rep", "row_id", "beta", "seconds"))

        both = both.groupBy("tr_bag", "pos", "row_id").agg(
            F.sum(share * F.col("beta")).alias("beta"), F.avg("seconds").alias("seconds")
        )
        for name, rows in (("train_bags", bagged), ("train_bags_test_split", both)):
            mean = rows.groupBy(s_of.alias("s"), rep_of.alias("rep"), "row_id").agg(
                F.avg("beta").alias("beta"), F.avg("seconds").alias("seconds")
            )
            parts.append(mean.select(F.lit(name).alias("method"), F.lit(k).alias("k"), "s", "rep", "row_id", "beta", "seconds"))
    weights = parts[0]
    for part in parts[1:]:
        weights = weights.unionByName(part)
    keys = ("method", "k", "s", "rep")
    return nmse(align_truth(weights, split.train), *keys, extra=[F.avg("seconds").alias("seconds")]).drop("rows")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """(method, k, s, nmse, seconds): means over repetitions."""
    return metrics.groupBy("method", "k", "s").agg(
        F.avg("nmse").alias("nmse"), F.avg("seconds").alias("seconds")
    )


def run_study(
    datasets: Mapping[str, DataFrame],
    train_size: int,
    ks: Sequence[int] = SPLITS,
    samples: Sequence[int] = SAMPLES,
    reps: int = REPETITIONS,
    seed: int = 0,
    *,
    escalate: bool = True,
) -> DataFrame:
    """(dataset, method, k, s, rep, nmse, seconds): a fresh biased split per dataset and repetition.

    The whole-table method is reported with k = 1 and s = 0. Each repetition's metrics, a handful of rows, are
    checkpointed, so the study restarts from the last finished one.
    """
    out = None
    for name, table in datasets.items():
        for rep in range(reps):
            cut = (escalated_split if escalate else biased_split)(table, train_size, seed + rep)
            metrics = sweep(cut, ks, samples, 1, seed + rep).withColumn("rep", F.lit(rep))
            start = time.perf_counter()
            full = kmm_whole(cut.train, cut.test, tr_rows=cut.train_rows, te_rows=cut.test_rows)
            score = reliable(nmse(align_truth(full, cut.train)))
            spent = time.perf_counter() - start
            whole = score.select(
                F.lit("whole").alias("method"),
                F.lit(1).alias("k"),
                F.lit(0).alias("s"),
                F.lit(rep).alias("rep"),
                "nmse",
                F.lit(spent).alias("seconds"),
            )
            both = reliable(metrics.unionByName(whole)).withColumn("dataset", F.lit(name))
            out = both if out is None else out.unionByName(both)
    return out


def study_report(metrics: DataFrame) -> DataFrame:
    """(dataset, method, k, s, nmse, seconds): the final comparison table."""
    return (
        metrics.groupBy("dataset", "method", "k", "s")
        .agg(F.avg("nmse").alias("nmse"), F.avg("seconds").alias("seconds"))
        .orderBy("dataset", "method", "k", "s")
    )
