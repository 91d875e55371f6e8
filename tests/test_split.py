import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reweight.operators import split as S
from reweight.operators import stats as T


@pytest.fixture(scope="module")
def cloud(points):
    return points(np.random.default_rng(0).normal(size=(120, 2)))


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


def test_split_parts_the_table(cloud):
    s = S.biased_split(cloud, 30, 4)
    assert len(ids(s.train)) == 30 and ids(s.train) + ids(s.test) != [] and sorted(ids(s.train) + ids(s.test)) == list(range(120))
    assert ids(S.test_remainder(cloud, s.train)) == ids(s.test)
    p = {r["row_id"]: r["p"] for r in T.accept_prob(cloud).collect()}
    for r in s.train.collect():
        assert r["true_beta"] == pytest.approx(1 / p[r["row_id"]])


def test_reverse_gives_the_test_size(cloud):
    s = S.biased_split(cloud, 30, 4, reverse=True)
    assert (s.train_rows, s.test_rows) == (90, 30) and s.test.count() == 30


def test_split_prefers_the_centre(cloud):
    fit = T.fit_spread(cloud)
    s = S.biased_split(cloud, 40, 11)
    near = s.train.agg(F.avg(fit.d2())).first()[0]
    far = s.test.agg(F.avg(fit.d2())).first()[0]
    assert near < far


def test_same_seed_same_split_on_other_partitions(points):
    x = np.random.default_rng(3).normal(size=(60, 2))
    assert ids(S.biased_split(points(x, parts=1), 20, 8).train) == ids(S.biased_split(points(x, parts=7), 20, 8).train)


def test_degenerate_tables_raise(points):
    same = points(np.ones((5, 2)))
    for cut in (S.biased_split, S.escalated_split):
        with pytest.raises(ValueError, match="std = 0"):
            cut(same, 2, 1)
        with pytest.raises(ValueError, match="larger than the table"):
            cut(same, 6, 1)


def test_incomplete_vectors_raise(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, None]), (2, [4.0, 5.0]), (3, [1.0])]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    with pytest.raises(ValueError, match="2 rows"):
        S.biased_split(df, 1, 1)


def test_escalated_split_takes_every_row(cloud):
    s = S.escalated_split(cloud, 120, 2)
    assert ids(s.train) == list(range(120)) and s.test.count() == 0


def test_escalated_weights_belong_to_a_level(points):
    # One tight cluster and rows far out: a draw of 2 keeps meeting runs of rejections.
    x = np.concatenate([np.zeros((3, 1)), np.linspace(5, 9, 20)[:, None]])
    df = points(x)
    fit = T.fit_spread(df)
    s = S.escalated_split(df, 2, 5)
    assert s.train.count() == 2 and s.test.count() == 21
    for d2, beta in s.train.select(fit.d2(), "true_beta").collect():
        level = d2 / (fit.std * math.log(beta)) if beta > 1 else 1
        assert abs(level - round(level)) < 1e-6


def by_clock(p, k, draw):
    clocks = sorted((-math.log(draw()) / w, i) for i, w in enumerate(p))
    return tuple(i for _, i in clocks[:k])


def by_rejection(p, k, rng):
    left, out = list(range(len(p))), []
    while len(out) < k:
        i = rng.randrange(len(left))
        if rng.random() < p[left[i]]:
            out.append(left.pop(i))
    return tuple(out)


def test_clock_order_has_the_law_of_rejection():
    p, runs, rng = [0.9, 0.5, 0.3, 0.2, 0.05], 20000, random.Random(6)
    a = collections.Counter(by_clock(p, 2, rng.random) for _ in range(runs))
    b = collections.Counter(by_rejection(p, 2, rng) for _ in range(runs))
    assert sum(abs(a[k] - b[k]) for k in {*a, *b}) / (2 * runs) < 0.03
