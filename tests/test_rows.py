"""Positions, selection and bags."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reweight.functions.uniform import uniform
from reweight.operators import bags as B
from reweight.operators import index, select


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_row_index_is_dense_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 40)
    ids = random.Random(1).sample(range(10**9), 500)
    df = spark.createDataFrame([(i,) for i in ids], "row_id long").repartition(7)
    got = {r["row_id"]: r["idx"] for r in index.row_index(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_shuffle_index_restarts_in_every_copy(spark, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 20)
    df = spark.range(100).select(F.col("id").alias("row_id"))
    bags = B.random_disjoint(df, 30, 5, 100, reps=3)
    assert (bags.count, bags.cycle) == (12, 4)
    per_rep = bags.df.groupBy(F.floor(F.col("bag_id") / 4)).agg(F.countDistinct("row_id"), F.count(F.lit(1))).collect()
    assert [tuple(r)[1:] for r in per_rep] == [(100, 100)] * 3
    sizes = dict(bags.df.groupBy("bag_id").count().collect())
    assert [sizes[b] for b in range(12)] == [30, 30, 30, 10] * 3
    stated = spark.range(12).select("id", bags.rows(F.col("id").cast("int")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in stated} == sizes


def test_suffix_sums_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 25)
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") + 1.0).alias("p"))
    cut = index.bucket_by_key(df, "row_id", 100, "b")
    got = index.number_rows(cut, [F.col("row_id")], bucket="b", n=100, out="j", suffix_sum="p").collect()
    for r in got:
        assert r["j"] == r["row_id"]
        assert r["j_suffix"] == pytest.approx(sum(range(r["row_id"] + 1, 101)))


@pytest.mark.parametrize("k", [1, 17, 400, 999, 1000])
def test_selection_narrows_to_the_exact_row(spark, monkeypatch, k):
    monkeypatch.setattr(select, "DIRECT_ROWS", 8)
    monkeypatch.setattr(select, "BINS", 16)
    rng = random.Random(2)
    # A third of the rows share one value, and the rest has a long tail.
    values = [0.5 if i % 3 == 0 else rng.expovariate(1) ** 3 for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, v double").repartition(5)
    cut = select.kth_cut(df, "v", "row_id", k)
    want = {i for _, i in sorted((v, i) for i, v in enumerate(values))[:k]}
    assert {r["row_id"] for r in df.where(cut.inside()).collect()} == want
    assert df.where(~cut.inside()).count() == 1000 - k


def test_first_n(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("row_id"))
    assert rows_of(select.first_n(df, 4), "row_id") == [(0,), (3,), (6,), (9,)]
    assert select.first_n(df, 500).count() == 50
    assert select.first_n(df, 0).count() == 0


def test_uniform_does_not_depend_on_partitions(spark):
    df = spark.range(200)
    u = uniform("t", 3, "id").alias("u")
    assert rows_of(df.repartition(9).select("id", u), "id", "u") == rows_of(df.coalesce(1).select("id", u), "id", "u")
    mean = df.select(u).agg(F.avg("u")).first()[0]
    assert 0.4 < mean < 0.6


@pytest.mark.parametrize(
    "size,count,want", [(4, 3, (4, 3)), (4, None, (4, 2)), (None, 3, (3, 3)), (None, None, (10, 1)), (0, 0, (10, 1))]
)
def test_resolve_bags(size, count, want):
    assert B.resolve_bags(10, size, count) == want


def test_partition_drops_or_keeps_the_tail(points):
    df = points(np.arange(10)[:, None])
    drop = B.partition_bags(df, 4, 2)
    keep = B.partition_bags(df, 4, 2, tail="keep")
    assert rows_of(drop.df, "bag_id", "pos", "row_id") == [(i // 4, i % 4, i) for i in range(8)]
    assert rows_of(keep.df, "bag_id", "pos", "row_id") == [(i // 4, i % 4, i) for i in range(10)]
    assert (drop.count, keep.count, drop.table_rows, keep.table_rows) == (2, 3, 8, 10)


def test_bag_larger_than_the_table(points):
    df = points(np.arange(3)[:, None])
    assert B.partition_bags(df, 10, 1).df.count() == 3
    boot = B.bootstrap_bags(df, 10, 2, 1)
    assert boot.df.count() == 20 and boot.df.agg(F.max("idx")).first()[0] <= 2


def test_empty_table(points, spark):
    df = spark.createDataFrame([], "row_id long, features array<double>")
    assert B.partition_bags(df, 3, 2).df.count() == 0
    assert B.bootstrap_bags(df, 3, 2, 1).df.count() == 0
    assert B.random_disjoint(df, 3, 1).df.count() == 0


def test_bootstrap_is_invariant_to_partitions(points):
    x = np.arange(30)[:, None]
    a = B.bootstrap_bags(points(x, parts=1), 7, 5, 9).df
    b = B.bootstrap_bags(points(x, parts=6), 7, 5, 9).df
    assert rows_of(a, "bag_id", "pos", "row_id") == rows_of(b, "bag_id", "pos", "row_id")


def test_coverage_count():
    assert B.coverage_count(500, 0.01, 100) == math.ceil(math.log10(0.01) / (100 * math.log10(1 - 1 / 500)))


def test_random_pairs_use_each_bag_once(spark):
    got = B.random_pairs(spark, 9, 6, 5, 1).collect()
    assert sorted(r["pair_id"] for r in got) == list(range(5))
    assert len({r["tr_bag"] for r in got}) == 5 and len({r["te_bag"] for r in got}) == 5
    with pytest.raises(ValueError):
        B.random_pairs(spark, 3, 6, 5, 1)
