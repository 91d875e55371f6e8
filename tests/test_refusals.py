"""Inputs that would be misread are refused, and nothing is dropped silently."""

import pytest
from pyspark.sql import functions as F

from reweight.functions.vectors import densify
from reweight.operators import bags as B
from reweight.operators import split as S
from reweight.operators import stats as T
from reweight.plans import pipelines as P
from reweight.plans import study as Y
from reweight.sources import text as X


def test_an_index_beyond_the_width_is_an_error(spark):
    df = spark.createDataFrame([(1, {0: 1.0, 2: 3.0}), (2, {}), (3, None)], "row_id long, entries map<int,double>")
    got = {r.row_id: r.v for r in df.select("row_id", densify("entries", 3).alias("v")).collect()}
    assert got == {1: [1.0, 0.0, 3.0], 2: [0.0, 0.0, 0.0], 3: [0.0, 0.0, 0.0]}
    with pytest.raises(Exception, match="outside 0..1"):
        df.select(densify("entries", 2)).collect()


def test_rows_without_a_label_are_kept(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "row_id long, label string")
    assert {r.row_id: r.label_code for r in X.encode_label(df).collect()} == {0: 0.0, 1: None, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("bad", [[1.0], None, [1.0, None], [1.0, 2.0, 3.0]])
def test_ragged_vectors_are_refused(spark, bad):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "row_id long, features array<double>")
    with pytest.raises(ValueError, match="rows have a missing"):
        B.width_of(df)


def test_width_of_empty_tables(spark):
    assert B.width_of(spark.createDataFrame([], "row_id long, features array<double>")) == 0
    assert B.width_of(spark.createDataFrame([(1,)], "row_id long")) == 0


def test_the_tail_can_be_kept_and_is_reported(points):
    rows = [[0.1 * i, 0.05 * i * i % 1] for i in range(23)]
    cut = S.biased_split(points(rows), 7, 1)
    shape = {"mode": 2, "seed": 3, "tr_size": 2, "te_size": 5, "te_count": 2}
    args = {k: v for k, v in shape.items() if k not in ("mode", "seed")}
    assert P.bagged_kmm(cut.train, cut.test, 2, 3, **args).count() == 6
    assert P.bagged_kmm(cut.train, cut.test, 2, 3, tail="keep", **args).count() == 7
    row = Y.run_stats(cut, "bagged", 3, mode=2, **args).first()
    assert (row.train_left_out, row.test_left_out) == (1, 0)


def test_sparse_and_dense_rows_have_the_same_split(spark):
    rows = [(i, {j: float((i * 7 + j) % 5) for j in range(4) if (i + j) % 3}) for i in range(40)]
    sparse = spark.createDataFrame(rows, "row_id long, entries map<int,double>")
    dense = sparse.select("row_id", densify("entries", 4).alias("features"))
    a, b = T.fit_spread(sparse), T.fit_spread(dense)
    assert a.mean == pytest.approx(b.mean) and a.std == pytest.approx(b.std)
    assert T.dispersion(sparse).first()[0] == pytest.approx(b.std)
    sides = [sorted(r.row_id for r in S.biased_split(df, 9, 2).train.collect()) for df in (sparse, dense)]
    assert sides[0] == sides[1]
    with pytest.raises(ValueError, match="1 rows"):
        T.fit_spread(sparse.withColumn("entries", F.when(F.col("row_id") > 0, F.col("entries"))))
