import numpy as np
import pytest

from reweight.functions import dense, qp


def problem(n, d, seed, shift=0.4, tests=50):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(n, d)), rng.normal(size=(tests, d)) + shift
    gamma = dense.median_distance(x)
    k = dense.gram_stack(x[None], np.array([gamma]))
    return k, -(n / tests) * dense.kernel_dot(x, z, None, gamma)[None]


def objective(k, kappa, b):
    return 0.5 * b @ k[0] @ b + kappa[0] @ b


def test_one_row_has_weight_one():
    beta, res, _ = qp.solve_stack(np.ones((2, 1, 1)), np.array([[-3.0], [0.0]]))
    assert beta.tolist() == [[1.0], [1.0]] and res.max() == 0


def test_two_rows_match_the_closed_form():
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(500, 2, 2)), rng.normal(size=(40, 2)) + 0.5
    d = np.sqrt(dense.sq_dists(x, x)[:, 0, 1])
    k = dense.gram_stack(x, d)
    kappa = np.stack([-(2 / 40) * dense.kernel_dot(x[i], z, None, d[i]) for i in range(500)])
    lo, hi = qp.sum_bounds(2)
    off = k[:, 0, 1]
    s = np.clip(-kappa.sum(1) / (1 + off), lo, hi)
    t = -(kappa[:, 0] - kappa[:, 1]) / (1 - off)
    first = np.where(t > s, np.clip(-kappa[:, 0], lo, hi), np.where(t < -s, 0, (s + t) / 2))
    second = np.where(t > s, 0, np.where(t < -s, np.clip(-kappa[:, 1], lo, hi), (s - t) / 2))
    beta, res, _ = qp.solve_stack(k, kappa)
    assert np.abs(beta - np.stack([first, second], 1)).max() < 1e-9
    assert res.max() < 1e-9


@pytest.mark.parametrize("n,d", [(3, 1), (20, 2), (120, 3), (300, 8)])
def test_solution_is_feasible_and_beats_feasible_probes(n, d):
    k, kappa = problem(n, d, n)
    beta, res, _ = qp.solve_stack(k, kappa)
    lo, hi = qp.sum_bounds(n)
    assert beta.min() >= 0 and lo - 1e-9 <= beta.sum() <= hi + 1e-9
    assert res[0] < 1e-7
    rng = np.random.default_rng(0)
    best = objective(k, kappa, beta[0])
    for scale in (1e-4, 1e-2, 1.0):
        for probe in qp.project(beta + scale * rng.normal(size=(50, n))):
            assert best <= objective(k, kappa, probe) + 1e-9


def test_three_rows_beat_a_grid():
    k, kappa = problem(3, 2, 7)
    beta, _, _ = qp.solve_stack(k, kappa)
    lo, hi = qp.sum_bounds(3)
    axis = np.linspace(0, hi, 60)
    grid = np.stack(np.meshgrid(axis, axis, axis), -1).reshape(-1, 3)
    grid = grid[(grid.sum(1) >= lo) & (grid.sum(1) <= hi)]
    values = 0.5 * np.einsum("gi,ij,gj->g", grid, k[0], grid) + grid @ kappa[0]
    assert objective(k, kappa, beta[0]) <= values.min() + 1e-12


def test_identical_rows_share_their_weight():
    k = np.ones((1, 2, 2))
    beta, _, _ = qp.solve_stack(k, np.array([[-1.8, -1.8]]))
    assert beta[0] == pytest.approx([0.9, 0.9], abs=1e-6)


def test_sum_bounds_bind():
    k = np.eye(4)[None]
    lo, hi = qp.sum_bounds(4)
    few, _, _ = qp.solve_stack(k, np.zeros((1, 4)))
    many, _, _ = qp.solve_stack(k, np.full((1, 4), -50.0))
    assert few.sum() == pytest.approx(lo) and many.sum() == pytest.approx(hi)


def test_projection_meets_bounds():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 5)) * 10
    p = qp.project(v)
    lo, hi = qp.sum_bounds(5)
    assert p.min() >= 0 and (p.sum(1) > lo - 1e-9).all() and (p.sum(1) < hi + 1e-9).all()
    assert np.abs(qp.project(p) - p).max() < 1e-9


def test_median_distance_of_a_line():
    assert dense.median_distance(np.array([[1.0, 2.0], [2.0, 3.0], [3.0, 4.0]])) == pytest.approx(2**0.5)
    assert np.isnan(dense.median_distance(np.ones((1, 2))))


def test_wide_and_narrow_distances_agree():
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(7, 40)), rng.normal(size=(5, 40))
    assert dense.sq_dists(x, z) == pytest.approx(((x[:, None] - z[None]) ** 2).sum(-1))


def test_last_systems_of_a_stack_are_solved_together(monkeypatch):
    """Two-row bags in thousands: a few calls of the solver for all of them, and the weights are those of each alone."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (2000, 2, 2)).astype(float)
    k = dense.gram_stack(x, np.full(2000, 1.3))
    kappa = -rng.uniform(0, 3, (2000, 2))
    assert (k[:, 0, 1] == 1).any()  # equal rows, whose systems are singular
    calls, real = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: calls.append(len(a)) or real(a, b))
    beta, res, _ = qp.solve_stack(k[k[:, 0, 1] < 1], kappa[k[:, 0, 1] < 1])
    assert len(calls) < 200
    monkeypatch.undo()
    beta, res, _ = qp.solve_stack(k, kappa)
    alone = [qp.solve_stack(k[i : i + 1], kappa[i : i + 1]) for i in range(0, 2000, 20)]
    assert np.array_equal(beta[::20], np.concatenate([a[0] for a in alone]))
    assert res.max() < 1e-9


def shared(rng, n, g, spread=1.0):
    """Problems of two bags, the second with equal rows, by turns."""
    k, kappas = [], []
    own = np.arange(g) % 2
    for bag in range(2):
        x = rng.normal(size=(n, 2))
        if bag:
            x[3] = x[5] = x[0]
        k.append(dense.gram_stack(x[None], np.array([1.1]))[0])
        kappas.append([-(n / 80) * spread * dense.kernel_dot(x, rng.normal(0.3, 1.0, size=(80, 2)), None, 1.1) for _ in range(g)])
    return np.stack(k), own, np.array([kappas[b][i] for i, b in enumerate(own)])


def test_problems_that_share_a_matrix_are_at_their_optimum(monkeypatch):
    k, own, kappa = shared(np.random.default_rng(4), 30, 60)
    want, _, _ = qp.solve_stack(k[own], kappa)
    alone = []
    monkeypatch.setattr(qp, "solve_stack", lambda a, b, run=qp.solve_stack: alone.append(len(b)) or run(a, b))
    beta, res, steps = qp.solve_together(k, own, kappa)
    # The barrier solves the mean problem of each bag and no other.
    assert alone == [2] and (steps > 0).all() and res.max() <= 1e-10 and beta.min() >= 0
    cost = lambda b: 0.5 * np.einsum("gi,gij,gj->g", b, k[own], b) + (b * kappa).sum(1)
    assert (cost(beta) <= cost(want) + 1e-10 * np.abs(cost(want))).all()
    assert np.allclose(res, qp.residual(k[own], kappa, beta), atol=1e-12)
    twins = beta[own == 1][:, [0, 3, 5]]
    assert (np.ptp(twins, 1) == 0).all() and twins.max() > 0


def test_shared_problems_beyond_the_bounds_of_the_sum_take_the_barrier():
    """With a linear term of a hundredth the sum is held at its lower bound; few problems, small and larger bags are stacks as well."""
    rng = np.random.default_rng(5)
    for n, g, spread in ((30, 40, 0.01), (30, 6, 1.0), (6, 40, 1.0), (70, 20, 1.0)):
        k, own, kappa = shared(rng, n, g, spread)
        beta, res, _ = qp.solve_together(k, own, kappa)
        want, other, _ = qp.solve_stack(k[own], kappa)
        assert np.array_equal(beta, want) and np.array_equal(res, other)
