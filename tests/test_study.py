import numpy as np
import pytest
from pyspark.sql import functions as F

from reweight.operators import split as S
from reweight.operators.kmm import kmm_whole
from reweight.plans import study as Y


@pytest.fixture(scope="module")
def cut(points):
    return S.biased_split(points(np.random.default_rng(4).normal(size=(150, 2))), 40, 9)


def test_weights_move_train_towards_test(cut):
    """The weighted train spread is nearer to the test spread than the plain one.

    (The per-row score is no such guarantee: measured NMSE is often above that of equal weights.)
    """
    size = sum((F.get("features", F.lit(i)) * F.get("features", F.lit(i)) for i in range(2)), F.lit(0.0))
    rows = cut.train.join(kmm_whole(cut.train, cut.test), "row_id")
    plain, weighted = rows.agg(F.avg(size), F.sum(size * F.col("beta")) / F.sum("beta")).first()
    goal = cut.test.agg(F.avg(size)).first()[0]
    assert plain < goal and abs(weighted - goal) < abs(plain - goal)


def test_methods_are_scored_on_their_rows(cut):
    got = {r["method"]: r for r in Y.compare_methods(cut, 20, 3, 3).collect()}
    assert set(got) == {"test_split", "train_split", "train_bags", "train_bags_test_split", "whole"}
    assert all(np.isfinite(r["nmse"]) and r["nmse"] > 0 for r in got.values())
    assert got["whole"]["rows"] == got["train_split"]["rows"] == 40
    assert got["train_bags"]["rows"] == got["train_bags_test_split"]["rows"] <= 40


@pytest.mark.parametrize("method", ["bagged", "test_ensemble", "whole"])
def test_run_stats(cut, method):
    row = Y.run_stats(cut, method, 3, tr_size=10 if method == "bagged" else None, te_count=2).first()
    assert (row["train_rows"], row["test_rows"]) == (40, 110)
    assert row["tr_bags"] == (4 if method == "bagged" else 1)
    assert row["nmse"] > 0 and row["total_seconds"] >= row["compute_seconds"] > 0


def test_study_reports_every_setting(points):
    table = points(np.random.default_rng(5).normal(size=(80, 2)))
    metrics = Y.run_study({"d": table}, 20, ks=[2], samples=[3], reps=1, seed=1)
    rows = Y.study_report(metrics).collect()
    settings = {(r["method"], r["k"], r["s"]) for r in rows}
    cover = Y.coverage_count(20, Y.COVERAGE_EPS, 10)
    assert settings == {("whole", 1, 0)} | {
        (m, 2, s)
        for m in ("test_split", "train_split", "train_bags", "train_bags_test_split")
        for s in (3, cover)
    }
    assert all(r["nmse"] >= 0 and r["seconds"] > 0 for r in rows)
