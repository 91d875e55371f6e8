"""Kernel sums, bag weights, the whole-table iteration, ensembles and pipelines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reweight.functions import dense, qp
from reweight.operators import bags as B
from reweight.operators import ensemble as E
from reweight.operators import evaluate as V
from reweight.operators import interior
from reweight.operators import kernel as K
from reweight.operators import kmm as M
from reweight.plans import pipelines as P

RNG = np.random.default_rng(12)
X, Z = RNG.normal(size=(40, 2)), RNG.normal(size=(90, 2)) + 0.4


@pytest.fixture(scope="module")
def train(points):
    return points(X)


@pytest.fixture(scope="module")
def test(points):
    return points(Z, start=1000)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", (16, 16))


def direct(x, z, gamma=None):
    gamma = dense.median_distance(x) if gamma is None else gamma
    k = dense.gram_stack(x[None], np.array([gamma]))
    kappa = -(len(x) / len(z)) * dense.kernel_dot(x, z, None, gamma)[None]
    return qp.solve_stack(k, kappa)[0][0]


def weights(df):
    return {r["row_id"]: r["beta"] for r in df.collect()}


def test_kappa_over_many_blocks(spark, train, test, small_blocks):
    tr, te = B.partition_bags(train, 20, 2), B.partition_bags(test, 45, 2)
    got = K.kappa(tr, te, B.cartesian_pairs(spark, 2, 2)).collect()
    assert len(got) == 80
    for r in got:
        bag = X[r["tr_bag"] * 20 :][:20]
        part = Z[r["te_bag"] * 45 :][:45]
        gamma = dense.median_distance(bag)
        assert r["kappa"] == pytest.approx(-(20 / 45) * dense.kernel_dot(X[r["row_id"]][None], part, None, gamma)[0])


def test_gram_rows_in_pieces(train, small_blocks):
    rows = K.gram(B.partition_bags(train, 20, 2), 0.7).collect()
    for r in rows:
        bag = X[r["bag_id"] * 20 :][:20]
        piece = bag[r["blk"] * 16 :][:16]
        assert r["k"] == pytest.approx(np.exp(-0.7 * ((bag[r["pos"]] - piece) ** 2).sum(1)))
    assert len(rows) == 80


@pytest.mark.parametrize("n", [39, 40])
def test_width_by_selection_equals_the_median(points, small_blocks, n):
    x = np.round(X[:n], 1)
    assert K.kernel_width(points(x), bag_rows=0) == pytest.approx(dense.median_distance(x), abs=1e-12)


def test_width_with_copies_counts_zero_distances(points, small_blocks):
    x = np.repeat(X[:8], 5, axis=0)
    assert K.kernel_width(points(x), bag_rows=0) == pytest.approx(dense.median_distance(x), abs=1e-12)


def test_objective_and_residual_at_the_solution(spark, train, test):
    tr, te = B.whole_bag(train, 40), B.whole_bag(test, 90)
    pairs = B.cartesian_pairs(spark, 1, 1)
    solved = M.bag_weights(tr, te, pairs).select("row_id", "beta")
    with_beta = B.Bags(tr.df.join(solved, "row_id"), tr.count, tr.size, tr.total, tr.width)
    kappas = K.kappa(tr, te, pairs).select(F.col("tr_bag").alias("bag_id"), "pos", "kappa")
    grads = K.kmm_gradient(with_beta, kappas).cache()
    assert K.kmm_residual(grads, 0.02).first()["residual"] < 1e-7
    stepped = K.kmm_step(grads, 0.02)
    moved = stepped.join(solved.withColumnRenamed("beta", "old"), "row_id").agg(F.max(F.abs(F.col("beta") - F.col("old"))))
    assert moved.first()[0] < 1e-7
    beta = direct(X, Z)
    k = dense.gram_stack(X[None], np.array([dense.median_distance(X)]))[0]
    kappa = -(40 / 90) * dense.kernel_dot(X, Z, None, dense.median_distance(X))
    assert K.kmm_objective(grads).first()["objective"] == pytest.approx(0.5 * beta @ k @ beta + kappa @ beta)


def test_every_route_to_a_bag_weight_agrees(spark, train, test, monkeypatch):
    source = B.row_index(train)
    tr, te = B.bootstrap_bags(source, 12, 5, 3), B.random_disjoint(test, 30, 3)
    pairs = B.cartesian_pairs(spark, 5, 3)
    one_block = M.bag_weights(tr, te, pairs, 1.3).groupBy("row_id").agg(F.avg("beta").alias("beta"))
    base = weights(one_block)
    monkeypatch.setattr(K, "BLOCK_ROWS", (16, 16))
    many = M.bag_weights(tr, te, pairs, 1.3).groupBy("row_id").agg(F.avg("beta").alias("beta"))
    shared = M.bag_weights(tr, te, pairs, 1.3, source=source).groupBy("row_id").agg(F.avg("beta").alias("beta"))
    for other in (weights(many), weights(shared)):
        assert other.keys() == base.keys()
        assert max(abs(other[i] - base[i]) for i in base) < 1e-6


def test_shuffle_joins_give_the_broadcast_result(spark, train, test, monkeypatch):
    tr, te = B.partition_bags(train, 10, 4), B.partition_bags(test, 30, 3)
    pairs = B.cartesian_pairs(spark, 4, 3)
    key = lambda df: {(r["pair_id"], r["pos"]): r["beta"] for r in df.collect()}
    base = key(M.bag_weights(tr, te, pairs))
    monkeypatch.setattr("reweight.operators.lineage.BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = key(M.bag_weights(tr, te, pairs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.keys() == base.keys() and max(abs(got[k] - base[k]) for k in base) < 1e-9


def test_one_row_bags(spark, points, test):
    tr = B.partition_bags(points(X[:3]), 1, 3)
    got = M.bag_weights(tr, B.whole_bag(test, 90), B.cartesian_pairs(spark, 3, 1))
    assert set(weights(got).values()) == {1.0}


def test_whole_table_is_one_problem(train, test):
    got = weights(M.kmm_whole(train, test))
    want = direct(X, Z)
    assert max(abs(got[i] - want[i]) for i in range(40)) < 1e-9


def objective(x, z, gamma, w):
    k = dense.gram_stack(x[None], np.array([gamma]))[0]
    b = np.array([w[i] for i in range(len(x))])
    return 0.5 * b @ k @ b - len(x) / len(z) * dense.kernel_dot(x, z, None, gamma) @ b


def test_large_solver_reaches_the_small_solvers_optimum(points, monkeypatch):
    """The same table on either side of the size limit, over several blocks."""
    monkeypatch.setattr(K, "BLOCK_ROWS", (16, 16))
    small = weights(M.kmm_whole(points(X), points(Z, start=500), gamma=1.0))
    rows = M.kmm_whole(points(X), points(Z, start=500), gamma=1.0, bag_rows=0)
    assert rows.where("NOT converged").count() == 0
    want = objective(X, Z, 1.0, small)
    assert objective(X, Z, 1.0, weights(rows)) == pytest.approx(want, rel=1e-8)


def test_rows_without_a_factor_take_gradient_steps(points, monkeypatch):
    """Well-separated rows: the Gram matrix is nearly the identity."""
    monkeypatch.setattr(interior, "MAX_PIVOTS", 3)
    x, z = X[:12], Z[:20]
    small = weights(M.kmm_whole(points(x), points(z, start=500), gamma=1e4))
    got = weights(M.kmm_whole(points(x), points(z, start=500), gamma=1e4, bag_rows=0))
    assert objective(x, z, 1e4, got) == pytest.approx(objective(x, z, 1e4, small), rel=1e-8)
    with pytest.raises(RuntimeError, match="from optimal"):
        M.kmm_whole(points(x), points(z, start=500), gamma=1.0, bag_rows=0, max_steps=1).count()


def test_residual_and_width_of_bags_beyond_one_task(points, monkeypatch):
    bags = B.partition_bags(points(X), 20, 2)
    kappas = bags.df.select("bag_id", "pos", F.lit(-1.0).alias("kappa"))
    bags = B.Bags(bags.df.withColumn("beta", F.lit(0.9)), 2, 20, 40, bags.width)
    widths = {r.bag_id: r.gamma for r in K.bag_widths(bags).collect()}
    grads = K.kmm_gradient(bags, kappas)
    want = {r.bag_id: r.residual for r in K.kmm_residual(grads, 0.3).collect()}
    monkeypatch.setattr(K, "BAG_ROWS", 8)
    assert {r.bag_id: r.residual for r in K.kmm_residual(grads, 0.3).collect()} == pytest.approx(want, abs=1e-9)
    assert {r.bag_id: r.gamma for r in K.bag_widths(bags).distinct().collect()} == pytest.approx(widths, abs=1e-12)


def test_no_pairs_no_weights(points, monkeypatch):
    tr, te = B.whole_bag(points(X), 40), B.whole_bag(points(Z), 60)
    none = B.cartesian_pairs(tr.df.sparkSession, 1, 1).where("pair_id < 0")
    assert M.bag_weights(tr, te, none, 1.0, bag_rows=0).count() == 0


def test_wide_distances_keep_their_digits():
    x = 100 + 0.01 * np.random.default_rng(0).normal(size=(5, 64))
    d2 = dense.sq_dists(x, x)
    assert np.abs(np.diag(d2)).max() < 1e-15
    assert d2[0, 1] == pytest.approx(((x[0] - x[1]) ** 2).sum(), rel=1e-9)


def test_sum_shifts_meet_their_bounds(spark):
    v = np.array([3.0, -1.0, 0.5, 2.0, 9.0])
    bounds = {0: (1.0, 4.0), 1: (20.0, 30.0), 2: (0.0, 99.0)}
    df = spark.createDataFrame([(k, float(a)) for k in bounds for a in v], "k int, v double")
    lam = K.sum_shifts(df, "k", bounds)
    assert lam[2] == 0.0
    for k, (lo, hi) in bounds.items():
        assert lo - 1e-9 <= np.clip(v - lam[k], 0, qp.BOX).sum() <= hi + 1e-9


def test_problems_of_one_large_bag_step_together(spark, points, monkeypatch):
    """Five test bags against one train bag beyond a task: one sequence, weights as of a solve of its own."""
    monkeypatch.setattr(K, "BLOCK_ROWS", (16, 16))
    sequences = []
    monkeypatch.setattr(interior, "sequence", lambda *a, run=interior.sequence: sequences.append(a[-1]) or run(*a))
    tr, te = B.whole_bag(points(X), 40), B.partition_bags(points(Z, 500), 20, 5, tail="keep")
    pairs = B.cartesian_pairs(spark, 1, te.count)
    rows = M.bag_weights(tr, te, pairs, 0.7, bag_rows=0).collect()
    assert sequences == [5] and len(rows) == 200 and max(r.residual for r in rows) < 1e-6
    for bag in range(5):
        got = {r.row_id: r.beta for r in rows if r.te_bag == bag}
        z = Z[20 * bag :][:20]
        want = {i: b for i, b in enumerate(direct(X, z, 0.7))}
        assert objective(X, z, 0.7, got) == pytest.approx(objective(X, z, 0.7, want), rel=1e-8)
    # Fewer at once where their matrices are large, and some of the pairs only; the weights are the same.
    monkeypatch.setattr(interior, "SYSTEM_CELLS", 1)
    some = spark.createDataFrame([(0, 0, 3), (1, 0, 1)], "pair_id long, tr_bag int, te_bag int")
    again = {(r.te_bag, r.row_id): r.beta for r in M.bag_weights(tr, te, some, 0.7, bag_rows=0).collect()}
    assert sequences == [5, 1, 1] and len(again) == 80
    first = {(r.te_bag, r.row_id): r.beta for r in rows}
    assert max(abs(first[k] - b) for k, b in again.items()) < 1e-6


def exchanges(df):
    """Shuffles in the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


def test_kernel_sums_without_broadcasts_send_blocks_once(spark, points, monkeypatch):
    """Packing, then one exchange into the cells of the grid; sums by pair, with pairs of all bags and of some."""
    monkeypatch.setattr(K, "BLOCK_ROWS", (16, 16))
    tr, te = B.partition_bags(points(X), 20, 2), B.partition_bags(points(Z), 30, 3)
    every, some = B.cartesian_pairs(spark, 2, 3), spark.createDataFrame([(0, 1, 2), (1, 0, 0)], "pair_id long, tr_bag int, te_bag int")
    key = lambda df: {(r.pair_id, r.te_bag, r.row_id): r.kappa for r in df.collect()}
    want = [key(K.kappa(tr, te, p, 0.7)) for p in (every, some)]
    grams = {(r.bag_id, r.pos, r.blk): r.k for r in K.gram(tr, 0.7).collect()}
    monkeypatch.setattr("reweight.operators.lineage.BROADCAST_BYTES", 4096)
    monkeypatch.setattr(K, "small_enough", lambda size: False)
    for n, (pairs, right) in enumerate(zip((every, some), want)):
        got = key(K.kappa(tr, te, pairs, 0.7))
        assert got.keys() == right.keys() and max(abs(got[k] - right[k]) for k in got) < 1e-9
    assert {(r.bag_id, r.pos, r.blk): r.k for r in K.gram(tr, 0.7).collect()} == grams
    # At most: left and right blocks packed, dealt to the cells, sums added up; positions of the points aside.
    plan = exchanges(K.kappa(tr, te, every, 0.7, n_pairs=6))
    assert len(plan) <= len(exchanges(tr.df)) + len(exchanges(te.df)) + 4
    assert sum("tr_blk" in line or "te_blk" in line for line in plan) == 0 and sum("cell" in line for line in plan) == 1


def test_grids_cover_all_pairs_of_blocks_once(spark):
    from reweight.operators import tiles

    blocks = spark.range(7).select((F.col("id") % 1).alias("grp"), F.col("id").alias("at"))
    import pandas as pd

    def pair(a, b):
        return pd.DataFrame({"a": [a.at], "b": [b.at]})

    for shape in ((1, 1), (3, 2), (7, 7)):
        rows = [tuple(r) for r in tiles.tiled(blocks, blocks, shape, 1, "a long, b long", pair).collect()]
        assert sorted(rows) == [(a, b) for a in range(7) for b in range(7)]
        if shape[0] == shape[1]:
            rows = [tuple(r) for r in tiles.tiled(blocks, blocks, shape, 1, "a long, b long", pair, upper=True).collect()]
            assert sorted(rows) == [(a, b) for a in range(7) for b in range(a, 7)]
    assert tiles.grid(1, 100, 1000, 1e6, 1e8, 64) == (1, 64)
    assert tiles.grid(1, 10, 10, 20 * tiles.STRIPE_BYTES, 1.0, 1)[0] == 10


def test_half_grids_of_fewer_stripes_than_blocks_cover_all_pairs(spark):
    from reweight.operators import tiles

    blocks = spark.range(7).select((F.col("id") % 1).alias("grp"), F.col("id").alias("at"))

    def pair(a, b):
        return pd.DataFrame({"a": [min(a.at, b.at)], "b": [max(a.at, b.at)]})

    for side in (1, 3, 6):
        rows = tiles.tiled(blocks, blocks, (side, side), 1, "a long, b long", pair, upper=True).collect()
        assert sorted(map(tuple, rows)) == [(a, b) for a in range(7) for b in range(a, 7)]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_width_of_more_blocks_than_stripes(points, monkeypatch, width):
    """Many blocks, close first bounds around the middle, and rows in no order of place."""
    monkeypatch.setattr(K, "BLOCK_ROWS", (8, 8))
    monkeypatch.setattr(K, "task_count", lambda df, units: min(units, 4))
    x = RNG.normal(size=(400, width)) ** 3
    assert K.kernel_width(points(x), bag_rows=0) == pytest.approx(dense.median_distance(x), rel=1e-12)
    monkeypatch.setattr(K, "probe", lambda *a: (100.0, 101.0))
    assert K.kernel_width(points(x), bag_rows=0) == pytest.approx(dense.median_distance(x), rel=1e-12)


def test_sums_by_moments_are_those_by_pairs(spark, points, monkeypatch):
    x, z = RNG.uniform(-2, 3, size=(90, 2)), np.c_[RNG.normal(size=1500), np.full(1500, 0.5)]
    tr, te = B.bootstrap_bags(points(x), 20, 6, 3), B.random_disjoint(points(z, start=1000), 1100, 4)
    pairs = B.cartesian_pairs(spark, tr.count, te.count)
    routes = []
    for least in (0, 2**62):
        monkeypatch.setattr(K, "EXPAND_FROM", least)
        used = K.expansion(tr, te, None, 2, 12)
        assert (used is not None) == (least == 0)
        for gamma in (None, 0.8):
            sums = {(r["pair_id"], r["pos"]): r["kappa"] for r in K.kappa(tr, te, pairs, gamma).collect()}
            solved = {(r["pair_id"], r["pos"]): r["beta"] for r in M.bag_weights(tr, te, pairs, gamma).collect()}
            routes.append((sums, solved))
    for a, b in zip(routes[:2], routes[2:]):
        assert a[0].keys() == b[0].keys() and len(a[0]) == 240
        assert all(a[0][k] == pytest.approx(b[0][k], rel=1e-10) for k in a[0])
        assert all(a[1][k] == pytest.approx(b[1][k], abs=1e-5) for k in a[1])


def test_sampled_width_brackets_the_median(points):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 2)), 1)
    exact = dense.median_distance(x)
    r = K.sampled_width(points(x), 20_000, 5).first()
    assert r.low <= exact <= r.high and r.low <= r.gamma <= r.high and r.high - r.low < 0.1 and not r.exact and r.pairs == 20_000
    with pytest.raises(ValueError, match="two rows"):
        K.sampled_width(points(x[:1]))


def test_width_by_bins_of_equal_and_skewed_distances(points, small_blocks, monkeypatch):
    """A bin that keeps too many distances is cut again, down to one value."""
    monkeypatch.setattr(K, "SHIPPED", 3)
    monkeypatch.setattr(K, "BINS", 4)
    for x in (np.ones((40, 2)), np.repeat([[0.0], [1.0], [1e-6]], 14, axis=0), X[:33] ** 7):
        assert K.kernel_width(points(x), bag_rows=0) == pytest.approx(dense.median_distance(x), rel=1e-12, abs=1e-12)


def test_train_splits_have_mean_one(train, test):
    got = weights(E.train_split_weights(train, test, 13, 5))
    assert len(got) == 40 and sum(got.values()) == pytest.approx(40)


def test_single_test_split_is_the_whole_problem(train, test):
    got = weights(E.test_split_weights(train, test, 90, 1))
    want = direct(X, Z)
    assert max(abs(got[i] - want[i]) for i in range(40)) < 1e-9


def test_unsampled_rows_have_no_weight(train, test):
    got = weights(E.bagged_train_weights(train, test, 5, 3, 2))
    draws = B.bootstrap_bags(B.row_index(train), 5, 3, 2, tag="boot-train").df
    missing = {r["row_id"] for r in E.unsampled_rows(train, draws).collect()}
    assert missing and set(got) == set(range(40)) - missing


@pytest.mark.parametrize("mode", [1, 2, 3, 4])
def test_bagged_weights_are_invariant_to_partitions(points, mode):
    shape = {"tr_size": 10, "te_count": 3}
    a = weights(P.bagged_kmm(points(X, parts=1), points(Z, 1000, 1), mode, 7, **shape))
    b = weights(P.bagged_kmm(points(X, parts=5), points(Z, 1000, 4), mode, 7, **shape))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-7


def test_test_ensemble_with_chunked_parts(train, test):
    whole = weights(P.test_ensemble_kmm(train, test, 3, te_count=2))
    chunked = weights(P.test_ensemble_kmm(train, test, 3, te_size=45, te_count=6))
    assert len(whole) == len(chunked) == 40
    parts = [direct(X, Z[:45]), direct(X, Z[45:])]
    assert max(abs(whole[i] - (parts[0][i] + parts[1][i]) / 2) for i in range(40)) < 1e-7


def test_chunked_parts_by_definition(train, test):
    """Parts of 40 rows in chunks of 15, and the last 10 rows a part of their own."""
    got = weights(P.test_ensemble_kmm(train, test, 3, te_size=40, te_count=6))
    te = B.partition_bags(test, 40, 6, 90)
    full = B.cut_bags(B.Bags(te.df.where("bag_id < 2"), 2, 40, 80, 2), 15, 3)
    chunks = [(r.bag_id // 3, r.row_id - 1000) for r in full.df.orderBy("bag_id", "pos").collect()]
    ids = [r.bag_id for r in full.df.orderBy("bag_id", "pos").collect()]
    assert sorted(i for _, i in chunks) == list(range(80)) and all(i // 40 == p for p, i in chunks)
    total = np.zeros(40)
    for bag in range(6):
        rows = [i for b, (_, i) in zip(ids, chunks) if b == bag]
        total += direct(X, Z[rows]) * len(rows) / 40
    total += direct(X, Z[80:])
    assert max(abs(got[i] - total[i] / 3) for i in range(40)) < 1e-7


def test_nmse_by_definition(spark):
    rows = [(i, float(b), float(t)) for i, (b, t) in enumerate(RNG.uniform(0.5, 4, size=(30, 2)))]
    df = spark.createDataFrame(rows, "row_id long, beta double, true_beta double")
    b, t = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = ((b / b.sum() - t / t.sum()) ** 2).mean()
    got = V.nmse(V.align_truth(df.select("row_id", "beta"), df)).first()
    assert got["rows"] == 30 and got["nmse"] == pytest.approx(want)


@pytest.fixture(scope="module")
def sparse_rows():
    """Rows of few of 5,000 features, some of them shared by most rows, and an empty one."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(45):
        own = {int(j): float(v) for j, v in zip(rng.choice(5000, 12, replace=False), rng.normal(size=12))}
        rows.append({} if i == 7 else own | {int(j): float(rng.normal()) for j in rng.choice(6, 3, replace=False)})
    return rows


def tables(spark, rows):
    """The same rows with their entries, and filled, over the features that occur."""
    names = sorted({j for r in rows for j in r})
    sparse = spark.createDataFrame(list(enumerate(rows)), "row_id long, entries map<int,double>").repartition(3)
    filled = [(i, [r.get(j, 0.0) for j in names]) for i, r in enumerate(rows)]
    return sparse, spark.createDataFrame(filled, "row_id long, features array<double>").repartition(3)


@pytest.mark.parametrize("shuffled", [False, True])
def test_kernels_of_sparse_rows_equal_those_of_filled_rows(spark, sparse_rows, monkeypatch, shuffled):
    monkeypatch.setattr(K, "BLOCK_ROWS", (8, 8))
    monkeypatch.setattr(dense, "SLICE_CELLS", 50)
    if shuffled:
        monkeypatch.setattr(K, "small_enough", lambda size: False)
    found = []
    for df in tables(spark, sparse_rows):
        tr, te = B.partition_bags(df.where("row_id < 20"), 10, 2), B.partition_bags(df.where("row_id >= 20"), 13, 2, tail="keep")
        pairs = B.cartesian_pairs(spark, 2, 2)
        out = {("kappa", r.pair_id, r.row_id): r.kappa for r in K.kappa(tr, te, pairs, 0.05).collect()}
        out |= {("gram", r.bag_id, r.pos, r.blk, i): v for r in K.gram(tr).collect() for i, v in enumerate(r.k)}
        out |= {("width", r.bag_id): r.gamma for r in K.bag_widths(tr).collect()}
        out |= {("all", n): K.kernel_width(df, bag_rows=n) for n in (0, 100)}
        out |= {("beta", r.pair_id, r.row_id): r.beta for r in M.bag_weights(tr, te, pairs, 0.05).collect()}
        found.append(out)
    assert found[0].keys() == found[1].keys()
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-8


def test_sparse_rows_that_cannot_be_weighted(spark, sparse_rows):
    sparse, _ = tables(spark, sparse_rows)
    with pytest.raises(ValueError, match="1 rows have missing"):
        B.width_of(sparse.withColumn("entries", F.when(F.col("row_id") > 0, F.col("entries"))))
    with pytest.raises(ValueError, match="smaller bags"):
        M.bag_weights(B.whole_bag(sparse, 45), B.whole_bag(sparse, 45), B.cartesian_pairs(spark, 1, 1), 1.0, bag_rows=10)


MANY, OTHERS = np.random.default_rng(5).normal(size=(700, 2)), np.random.default_rng(6).normal(size=(300, 2)) + 0.4


def test_a_factor_of_few_columns_gives_the_dense_optimum():
    kappa = -(700 / 300) * dense.kernel_dot(MANY, OTHERS, None, 0.2)
    beta, residual, _ = M.solve_factored(MANY, 0.2, kappa)
    assert residual <= 1e-6 and beta.min() >= 0
    k = dense.gram_stack(MANY[None], np.array([0.2]))
    want = qp.solve_stack(k, kappa[None])[0][0]
    cost = lambda b: 0.5 * b @ k[0] @ b + kappa @ b
    assert cost(beta) == pytest.approx(cost(want), rel=1e-10)
    # Well-separated rows have no such factor.
    assert M.solve_factored(MANY, 1e6, kappa) is None


def test_bags_beyond_the_dense_solver_take_one_task_each(spark, points, monkeypatch):
    """Bags of 600 rows where 100 are the most of the dense solver: no iteration over the cluster, except without a factor."""
    monkeypatch.setattr(K, "BAG_ROWS", 100)
    monkeypatch.setattr(M, "BAG_ROWS", 100)
    iterated = []

    def large(tr, te, pairs, *rest):
        iterated.extend(sorted(r.pair_id for r in pairs.collect()))
        return spark.createDataFrame([], M.SOLVED)

    monkeypatch.setattr(M, "_large_bags", large)
    tr, te = B.partition_bags(points(MANY), 600, 2, tail="keep"), B.partition_bags(points(OTHERS, 5000), 150, 2)
    pairs = B.cartesian_pairs(spark, tr.count, te.count)
    rows = M.bag_weights(tr, te, pairs, 0.2, bag_rows=100).collect()
    assert len(rows) == 1400 and max(r.residual for r in rows) <= 1e-6
    # The second bag has 100 rows, which the dense solver takes; so nothing is iterated.
    assert iterated == []
    for bag in range(2):
        got = {r.row_id: r.beta for r in rows if r.tr_bag == 0 and r.te_bag == bag}
        z = OTHERS[150 * bag :][:150]
        want = dict(enumerate(direct(MANY[:600], z, 0.2)))
        assert objective(MANY[:600], z, 0.2, got) == pytest.approx(objective(MANY[:600], z, 0.2, want), rel=1e-9)
    # With this width the factor has too many columns; the pairs of that bag go on to the iteration.
    again = M.bag_weights(tr, te, pairs, 5.0, bag_rows=100).collect()
    assert iterated == [0, 1] and {r.pair_id for r in again} == {2, 3}


def test_large_bags_are_solved_side_by_side(spark, points, monkeypatch):
    import threading

    both = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(M, "_solve_large", lambda *a, run=M._solve_large: both.wait() is None or run(*a))
    tr, te = B.partition_bags(points(X), 20, 2), B.whole_bag(points(Z, 500), 90)
    rows = M.bag_weights(tr, te, B.cartesian_pairs(spark, 2, 1), 0.7, bag_rows=0).collect()
    assert len(rows) == 40 and max(r.residual for r in rows) < 1e-6


def test_sums_of_a_block_come_in_few_frames(monkeypatch):
    """A train block of two rows against 700 test bags."""
    monkeypatch.setattr(K, "SENT_CELLS", 1000)
    row = pd.DataFrame({"tr_bag": [3], "tr_blk": [0], "poss": [[0, 1]], "row_ids": [[5, 6]], "x": [[0.0] * 4], "gamma": [1.5]})
    block = K.Block(next(row.itertuples(index=False)), {})
    for bag in range(700):
        block.add(bag, np.array([bag, 2.0 * bag]))
    frames = list(K.sum_frames(block))
    assert [len(f) for f in frames] == [500, 200]
    got = pd.concat(frames)
    assert got["te_bag"].tolist() == list(range(700)) and [v.tolist() for v in got["ksum"]] == [[b, 2 * b] for b in range(700)]
    assert list(got.columns) == [c.split()[0] for c in K.SUMS.split(", ")] and set(got["tr_bag"]) == {3}


def test_moments_are_cut_by_rows(points, monkeypatch):
    """A test table in one partition, as adaptive execution leaves a small one, is spread before its moments."""
    monkeypatch.setattr(K, "EXPAND_FROM", 1)
    monkeypatch.setattr(K, "MOMENT_ROWS", 500)
    rng = np.random.default_rng(4)
    x, z = rng.uniform(size=(2000, 2)), rng.uniform(size=(2000, 2))
    tr, te = B.whole_bag(points(x), 2000), B.whole_bag(points(z, parts=1).coalesce(1), 2000)
    seen, real = [], K.bag_moments
    monkeypatch.setattr(K, "bag_moments", lambda rows, *how: seen.append(rows.rdd.getNumPartitions()) or real(rows, *how))
    pairs = B.cartesian_pairs(tr.df.sparkSession, 1, 1)
    got = {r["row_id"]: r["ksum"] for r in K.pair_sums(tr, te, pairs, 0.7, 2, n_pairs=1).collect()}
    assert seen == [4]
    assert np.allclose([got[i] for i in range(2000)], dense.kernel_dot(x, z, None, 0.7), rtol=1e-10)


def mixed_rows(rng, n, wide=True):
    """Packed sparse rows of features that most rows have and, if `wide`, of many that few have."""
    rows = [{int(j): float(v) for j, v in zip(range(20), rng.normal(size=20)) if rng.random() < 0.6} for _ in range(n)]
    for r in rows[1:] if wide else []:
        r.update({int(j): float(rng.normal()) for j in rng.choice(np.arange(20, 3000), 5, replace=False)})
    names = [sorted(r, reverse=True) for r in rows]
    return np.concatenate([[n], [len(r) for r in rows], [j for k in names for j in k], [r[j] for r, k in zip(rows, names) for j in k]]).astype(float)


@pytest.mark.parametrize("wide", [False, True])
def test_features_that_many_rows_have_are_one_product(wide):
    """Filled and listed features together are the products of filled rows, whole and in slices, and nothing is worked out twice."""
    rng = np.random.default_rng(3)
    a, b = dense.Sparse(mixed_rows(rng, 30, wide)), dense.Sparse(mixed_rows(rng, 41))
    names = np.arange(3000.0)
    want = a.filled(names) @ b.filled(names).T
    assert np.allclose(a.products(b), want, rtol=0, atol=1e-12) and np.allclose(b.products(a), want.T, rtol=0, atol=1e-12)
    assert len(a.grouped()[5]) >= 15 and a.grouped() is a.grouped() and a.slices(7) is a.slices(7)
    assert np.allclose(np.concatenate([s.products(b) for s in a.slices(7)]), want, rtol=0, atol=1e-12)
    rest = [dense.Sparse(mixed_rows(rng, 10, wide)) for _ in range(2)]
    assert dense.Stripe.fits([a, *rest]) == (not wide)
    gamma = rng.uniform(0.01, 0.1, 50)
    got = dense.Stripe([a, *rest], gamma).sums(b)
    full = np.concatenate([s.filled(names) for s in (a, *rest)])
    want = np.exp(-gamma[:, None] * ((full[:, None] - b.filled(names)[None]) ** 2).sum(2)).sum(1)
    assert np.allclose(got, want, rtol=1e-10)


def test_rows_of_a_stripe_have_their_own_rates():
    rng = np.random.default_rng(8)
    blocks, z = [rng.normal(size=(n, 3)) for n in (4, 1, 9)], rng.normal(size=(25, 3))
    gamma = np.repeat([0.5, 0.0, 2.0], [4, 1, 9])
    want = np.concatenate([dense.kernel_dot(b, z, None, g) for b, g in zip(blocks, (0.5, 0.0, 2.0))])
    assert np.allclose(dense.Stripe(blocks, gamma).sums(z), want, rtol=1e-13)


def test_sparse_width_begins_around_the_middle(spark, monkeypatch):
    """With enough rows the first pass bins few distances; where the middle is elsewhere all bounds are taken."""
    rng = np.random.default_rng(2)
    rows = [{int(j): float(v) for j, v in zip(rng.choice(9, 4, replace=False), rng.normal(size=4))} for _ in range(120)]
    df, filled = tables(spark, rows)
    want = dense.median_distance(np.array([r.features for r in filled.collect()]))
    found = []
    for wrong in (False, True):
        if wrong:
            monkeypatch.setattr(K, "sparse_probe", lambda *a: (0.0, 1e-3))
        seen, plain = [], K.PairDistances.bins
        monkeypatch.setattr(K.PairDistances, "bins", lambda self, *b, plain=plain: seen.append(b) or plain(self, *b))
        found.append(K.kernel_width(df, bag_rows=0))
        assert (seen[0][0] > 0) == (not wrong)
        monkeypatch.setattr(K.PairDistances, "bins", plain)
    assert found == pytest.approx([want, want], rel=1e-10)


def test_problems_of_a_bag_share_its_factor(monkeypatch):
    """One factor and one product with the matrix for all test bags; each problem is at its own optimum."""
    made, times = [], []
    monkeypatch.setattr(M.interior, "cholesky", lambda *a, run=M.interior.cholesky: made.append(a) or run(*a))
    monkeypatch.setattr(M, "kernel_times", lambda *a, run=M.kernel_times: times.append(a) or run(*a))
    kappas = np.stack([-(700 / 100) * dense.kernel_dot(MANY, OTHERS[i : i + 100], None, 0.2) for i in (0, 100, 200)])
    beta, residual, _ = M.solve_shared(MANY, 0.2, kappas)
    assert len(made) == len(times) == 1 and residual.max() <= 1e-6
    k = dense.gram_stack(MANY[None], np.array([0.2]))
    for b, kappa in zip(beta, kappas):
        want = qp.solve_stack(k, kappa[None])[0][0]
        assert 0.5 * b @ k[0] @ b + kappa @ b == pytest.approx(0.5 * want @ k[0] @ want + kappa @ want, rel=1e-10)


def test_the_matrix_times_columns_by_moments_is_that_by_pairs():
    x, w = np.random.default_rng(1).uniform(size=(2500, 2)), np.random.default_rng(2).uniform(size=(2500, 3))
    assert np.allclose(M.kernel_times(x, 1.5, w), dense.kernel_dot(x, x, w, 1.5), rtol=1e-11)


def test_bags_in_lots_are_at_their_optimum(spark, points, monkeypatch):
    """Bags of 350 and 150 rows, the second without a factor, against test bags whose moments are the cheaper way."""
    monkeypatch.setattr(K, "EXPAND_FROM", 1)
    seen = []
    monkeypatch.setattr(M, "solve_lots", lambda *a, run=M.solve_lots: seen.append(a[0].count()) or run(*a))
    x, z = np.random.default_rng(3).uniform(size=(500, 2)), np.random.default_rng(4).uniform(size=(2400, 2)) ** 1.2
    tr, te = B.partition_bags(points(x), 350, 2, tail="keep"), B.partition_bags(points(z, 5000), 1100, 3, tail="keep")
    pairs = B.cartesian_pairs(spark, tr.count, te.count)
    rows = M.bag_weights(tr, te, pairs, 0.4).collect()
    assert seen and len(rows) == 1500 and max(r.residual for r in rows) <= 1e-6 and {r.pair_id for r in rows} == set(range(6))
    for a in range(2):
        for b in range(3):
            some, others = x[350 * a :][:350], z[1100 * b :][:1100]
            got = [r.beta for r in sorted((r for r in rows if (r.tr_bag, r.te_bag) == (a, b)), key=lambda r: r.pos)]
            want = direct(some, others, 0.4)
            assert objective(some, others, 0.4, dict(enumerate(got))) == pytest.approx(objective(some, others, 0.4, dict(enumerate(want))), rel=1e-8)


def test_many_pairs_are_dealt_to_a_grid_and_numbered(spark, points, monkeypatch):
    """The same weights whether pairs of broadcast blocks are tasks or cells of a grid are, with the ids of the pairs by arithmetic."""
    tr, te = B.partition_bags(points(X), 10, 4), B.random_disjoint(points(Z, 1000), 9, 3)
    pairs = B.cartesian_pairs(spark, tr.count, te.count)
    key = lambda rows: {(r.pair_id, r.tr_bag, r.te_bag, r.pos): r.beta for r in rows.collect()}
    want = key(M.bag_weights(tr, te, pairs, n_pairs=40))
    monkeypatch.setattr(K, "SENT_BYTES", 0)
    monkeypatch.setattr(K, "small_enough", lambda size: size != 16 * 40)
    asked = []
    monkeypatch.setattr(K, "numbered", lambda *a, run=K.numbered: asked.append(run(*a)) or asked[-1])
    got = key(M.bag_weights(tr, te, pairs, n_pairs=40))
    assert asked == [True] and got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6
    # Pairs with other numbers keep them.
    other = pairs.withColumn("pair_id", F.col("pair_id") + 7)
    assert not K.numbered(pairs.where("pair_id > 0"), 4, 10, 40)
    got = key(M.bag_weights(tr, te, other, n_pairs=40))
    assert asked == [True, False, False] and {i[0] - 7 for i in got} == set(range(40))
