"""Small dense quadratic programs of kernel mean matching, solved in stacks of equal size.

For each problem: minimise b'Kb/2 + k'b subject to 0 <= b <= BOX and lo <= sum(b) <= hi. A primal-dual
barrier iteration starts from the interior point b = 1, so it stays feasible; a linear solve on the variables
that ended off their bounds then removes the remaining barrier error where that helps.
"""

import numpy as np

# Fixed values of the estimator.
BOX = 1000.0
# Solver settings.
MAX_STEPS = 80
GAP = 1e-13
POLISH_ROUNDS = 6
# Problems that share a matrix start from the optimum of their mean: with so many rows, larger ones take as many rounds as they
# save, and from so many of them on. Rounds for each row, what counts as a gradient of 0 beside the linear term, and the largest move of a solution that is taken.
NEAR_ROWS = range(8, 65)
NEAR_PROBLEMS = 8
NEAR_ROUNDS = 3
NEAR_GRADIENT = 1e-11
NEAR_RESIDUAL = 1e-10


def sum_bounds(n: int) -> tuple[float, float]:
    """Allowed range of the sum of n weights: n(1 - eps) .. n(1 + eps) with eps = (sqrt(n)-1)/sqrt(n)."""
    return float(np.sqrt(n)), float(2 * n - np.sqrt(n))


def project(v: np.ndarray) -> np.ndarray:
    """Nearest feasible point for each row of v."""
    lo, hi = sum_bounds(v.shape[1])
    out = np.clip(v, 0.0, BOX)
    total = out.sum(1)
    bad = (total < lo) | (total > hi)
    if bad.any():
        vb = v[bad]
        target = np.where(total[bad] < lo, lo, hi)
        left, right = vb.min(1) - hi, vb.max(1)
        for _ in range(100):
            mid = 0.5 * (left + right)
            over = np.clip(vb - mid[:, None], 0.0, BOX).sum(1) > target
            left, right = np.where(over, mid, left), np.where(over, right, mid)
        out[bad] = np.clip(vb - right[:, None], 0.0, BOX)
    return out


def residual(k: np.ndarray, kappa: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Largest move of one projected gradient step; 0 exactly at a minimiser."""
    lip = np.abs(k).sum(2).max(1)
    grad = np.einsum("gij,gj->gi", k, beta) + kappa
    return np.abs(beta - project(beta - grad / lip[:, None])).max(1)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        jitter = 1e-12 * np.eye(a.shape[-1])
        return np.linalg.solve(a + jitter, b)


def _barrier(k: np.ndarray, kappa: np.ndarray):
    g, n = kappa.shape
    lo, hi = sum_bounds(n)
    b = np.ones((g, n))
    scale = 1.0 + np.abs(kappa).max(1)

    # Distances to the four kinds of bound: zero, BOX, lower sum, upper sum.
    s = np.tile(np.concatenate([np.ones(n), np.full(n, BOX - 1.0), [n - lo, hi - n]]), (g, 1))
    z = scale[:, None] / s
    diag = np.arange(n)
    live = np.ones(g, dtype=bool)
    steps = np.zeros(g, dtype=int)
    damp = np.full(g, 0.1)
    for _ in range(MAX_STEPS):
        at = np.flatnonzero(live)
        if not len(at):
            break
        bs, ss, zs = b[at], s[at], z[at]
        mu = (ss * zs).mean(1)
        goal = (damp[at] * mu)[:, None]
        grad = np.einsum("gij,gj->gi", k[at], bs) + kappa[at]
        ratio = zs / ss
        m = k[at].copy()
        m[:, diag, diag] += ratio[:, :n] + ratio[:, n : 2 * n]
        pull = goal / ss
        rhs = -grad + pull[:, :n] - pull[:, n : 2 * n]
        pq = _solve(m, np.stack([rhs, np.ones_like(rhs)], axis=2))
        p, q = pq[:, :, 0], pq[:, :, 1]
        # The two sum bounds add a rank-one term; eliminating it through its own multiplier keeps the
        # step accurate when one of those slacks is nearly zero.
        s_lo, s_hi, z_lo, z_hi = (v[:, j] for v in (ss, zs) for j in (2 * n, 2 * n + 1))
        weight = z_lo * s_hi + z_hi * s_lo
        soft, shift = s_lo * s_hi / weight, goal[:, 0] * (s_hi - s_lo) / weight
        nu = (p.sum(1) - shift) / (q.sum(1) + soft)
        db = p - nu[:, None] * q
        dsum = (nu * soft + shift)[:, None]
        ds = np.concatenate([db, -db, dsum, -dsum], axis=1)
        dz = pull - zs - ratio * ds
        with np.errstate(divide="ignore", invalid="ignore"):
            top = np.minimum(
                np.where(ds < 0, -ss / ds, np.inf).min(1), np.where(dz < 0, -zs / dz, np.inf).min(1)
            )
        a = np.minimum(1.0, 0.995 * top)[:, None]
        b[at] = bs + a * db
        z[at] = zs + a * dz
        s[at] = ss + a * ds
        steps[at] += 1
        damp[at] = np.where(a[:, 0] > 0.9, 0.02, np.where(a[:, 0] > 0.5, 0.2, 0.6))
        full = np.einsum("gij,gj->gi", k[at], b[at]) + kappa[at]
        dual = full - z[at][:, :n] + z[at][:, n : 2 * n] + (z[at][:, 2 * n + 1] - z[at][:, 2 * n])[:, None]
        gap = (s[at] * z[at]).mean(1)
        live[at] = (gap > GAP * scale[at]) | (np.abs(dual).max(1) > 1e-10 * scale[at])
    return b, s, z, steps


def _solved(a: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solutions of a stack of equal-sized systems; NaN for singular ones, which are found by halving."""
    try:
        return np.linalg.solve(a, rhs[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full(rhs.shape, np.nan)
    half = len(a) // 2
    return np.concatenate([_solved(a[:half], rhs[:half]), _solved(a[half:], rhs[half:])])


def _on_free(k, kappa, free, upper, total) -> np.ndarray:
    """Weights of the optimality systems on the free variables, the others at their bound; NaN where a system is singular.

    Problems with as many free variables, and a held sum or none, are one stack of systems.
    """
    out = np.where(upper, BOX, 0.0)
    count, held = free.sum(1), ~np.isnan(total)
    for m, sum_held in np.unique(np.stack([count, held], 1), axis=0):
        at = np.flatnonzero((count == m) & (held == sum_held))
        if not m:
            # Nothing can move; a sum that is held elsewhere has no solution.
            out[at[held[at] & (total[at] != out[at].sum(1))]] = np.nan
            continue
        size = m + sum_held
        var = np.nonzero(free[at])[1].reshape(len(at), m)
        a, rhs = np.zeros((len(at), size, size)), np.empty((len(at), size))
        a[:, :m, :m] = k[at[:, None, None], var[:, :, None], var[:, None, :]]
        rhs[:, :m] = -kappa[at[:, None], var]
        if (some := upper[at].any(1)).any():
            rhs[some, :m] -= np.einsum("gij,gj->gi", k[at[some]], out[at[some]])[np.arange(some.sum())[:, None], var[some]]
        if sum_held:
            a[:, :m, m] = a[:, m, :m] = 1.0
            rhs[:, m] = total[at] - out[at].sum(1)
        out[at[:, None], var] = _solved(a, rhs)[:, :m]
    return out


def _polish(k, kappa, b, s, z):
    """Solve the optimality systems of a stack on their free variables, the others fixed at their bound.

    A solution that leaves the bounds moves the offending variables onto them and is solved again; a problem
    that does not settle keeps the barrier's answer.
    """
    n = kappa.shape[1]
    lo, hi = sum_bounds(n)
    upper = s[:, n : 2 * n] <= z[:, n : 2 * n]
    free = (s[:, :n] > z[:, :n]) & ~upper
    total = np.where(s[:, 2 * n] < z[:, 2 * n], lo, np.where(s[:, 2 * n + 1] < z[:, 2 * n + 1], hi, np.nan))
    out, todo = b.copy(), np.arange(len(b))
    for _ in range(POLISH_ROUNDS):
        got = _on_free(k[todo], kappa[todo], free[todo], upper[todo], total[todo])
        fine = ~np.isnan(got).any(1)
        out[todo] = np.where(fine[:, None], got, b[todo])
        todo, got = todo[fine], got[fine]
        below, above = free[todo] & (got < 0.0), free[todo] & (got > BOX)
        moved, sums = (below | above).any(1), got.sum(1)
        free[todo] &= ~below & ~above
        upper[todo] |= above
        loose = ~moved & np.isnan(total[todo]) & ~((lo <= sums) & (sums <= hi))
        total[todo] = np.where(loose, np.where(sums < lo, lo, hi), total[todo])
        todo = todo[moved | loose]
        if not len(todo):
            break
    sums = out.sum(1)
    fits = np.abs(sums - np.clip(sums, lo, hi)) <= 1e-12 * hi
    fits &= (out.min(1) >= 0.0) & (out.max(1) <= BOX)
    return np.where(fits[:, None], out, b)


def solve_stack(k: np.ndarray, kappa: np.ndarray):
    """Weights, residual and step count for a stack of problems (g, n, n) and (g, n)."""
    g, n = kappa.shape
    if n == 1:
        return np.ones((g, 1)), np.zeros(g), np.zeros(g, dtype=int)
    b, s, z, steps = _barrier(k, kappa)
    res = residual(k, kappa, b)
    tidy = _polish(k, kappa, b, s, z)
    tidy_res = residual(k, kappa, tidy)
    better = tidy_res < res
    return np.where(better[:, None], tidy, b), np.where(better, tidy_res, res), steps


def _on_support(k: np.ndarray, own: np.ndarray, kappa: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Weights with a gradient of 0 on the free variables, 0 elsewhere; NaN where that has no solution."""
    out = np.zeros(kappa.shape)
    count = free.sum(1)
    for m in np.unique(count[count > 0]):
        at = np.flatnonzero(count == m)
        var = np.nonzero(free[at])[1].reshape(len(at), m)
        a = k[own[at, None, None], var[:, :, None], var[:, None, :]]
        out[at[:, None], var] = _solved(a, -kappa[at[:, None], var])
    return out


def _products(k: np.ndarray, own: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each row of b times its own matrix; `own` ascends."""
    out = np.empty(b.shape)
    ends = np.flatnonzero(np.diff(own, prepend=-1, append=-1)).tolist()
    for low, high in zip(ends, ends[1:]):
        np.matmul(b[low:high], k[own[low]], out=out[low:high])
    return out


def _near(k: np.ndarray, own: np.ndarray, kappa: np.ndarray, begin: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nonnegative minimisers from the nonnegative weights `begin`, and the rounds taken; problems that do not settle are NaN.

    A round moves to the minimiser on the variables in use, or as far towards it as the weights stay nonnegative; a variable that
    gets to 0 leaves, and at a minimiser the usable variable of the least gradient enters. The objective never grows.
    """
    beta, free, live = begin.copy(), begin > 0.0, np.arange(len(kappa))
    limit = NEAR_GRADIENT * (1.0 + np.abs(kappa).max(1))
    rounds = np.zeros(len(kappa), int)
    for _ in range(NEAR_ROUNDS * kappa.shape[1]):
        f, b, mine = free[live], beta[live], own[live]
        goal = _on_support(k, mine, kappa[live], f)
        below = f & (goal < 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(below, b / (b - goal), np.inf)
        part = np.minimum(room.min(1), 1.0)[:, None]
        inside = ~below.any(1)
        b = np.where(inside[:, None], goal, b + part * (goal - b))
        gone = below & (room <= part)
        b[gone] = 0.0
        f &= ~gone
        grad = np.where(f | ~usable[mine], 0.0, _products(k, mine, b) + kappa[live])
        least = grad.argmin(1)
        enters = inside & (grad[np.arange(len(live)), least] < -limit[live])
        f[enters, least[enters]] = True
        beta[live], free[live] = b, f
        rounds[live] += 1
        lost = np.isnan(b).any(1)
        beta[live[lost]] = np.nan
        live = live[(~inside | enters) & ~lost]
        if not len(live):
            break
    beta[live] = np.nan
    return beta, rounds


def solve_together(k: np.ndarray, own: np.ndarray, kappa: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, residuals and steps of problems (g, n) that share matrices (bags, n, n); `own` is the matrix of each.

    Where many problems share a matrix their optimum is looked for from that of their mean, without the bounds of the sum; if it
    is within them, it is theirs. Equal rows are one variable, whose weight they share alike, as in the barrier. What does not
    settle, or not within the bounds, is solved by the barrier.
    """
    g, n = kappa.shape
    beta, res, steps = np.empty((g, n)), np.full(g, np.inf), np.zeros(g, int)
    lo, hi = sum_bounds(n)
    twin = (k == 1.0).argmax(2)
    good = (np.bincount(own, minlength=len(k)) >= NEAR_PROBLEMS) & np.isfinite(k).all((1, 2)) & (np.take_along_axis(twin, twin, 1) == twin).all(1)
    at = np.flatnonzero(good[own] & np.isfinite(kappa).all(1)) if n in NEAR_ROWS else np.zeros(0, int)
    if len(at):
        at = at[np.argsort(own[at], kind="stable")]
        bags, mine, count = np.unique(own[at], return_inverse=True, return_counts=True)
        some, twin = k[bags], twin[bags]
        mean = np.add.reduceat(kappa[at], np.cumsum(count) - count) / count[:, None]
        begin = solve_stack(some, mean)[0]
        copies = np.zeros(begin.shape)
        np.add.at(copies, (np.arange(len(bags))[:, None], twin), 1.0)
        held = np.zeros(begin.shape)
        np.add.at(held, (np.arange(len(bags))[:, None], twin), begin)
        held[held <= 1e-9] = 0.0
        got, rounds = _near(some, mine, kappa[at], held[mine], twin == np.arange(n))
        got = np.take_along_axis(got / np.maximum(copies, 1.0)[mine], twin[mine], 1)
        fine = np.isfinite(got).all(1)
        got[~fine] = 1.0
        sums = got.sum(1)
        fine &= (lo <= sums) & (sums <= hi) & (got.max(1) <= BOX)
        lip = np.abs(some).sum(2).max(1)[mine, None]
        moved = np.abs(got - project(got - (_products(some, mine, got) + kappa[at]) / lip)).max(1)
        fine &= moved <= NEAR_RESIDUAL
        beta[at[fine]], res[at[fine]], steps[at[fine]] = got[fine], moved[fine], rounds[fine]
    rest = np.flatnonzero(np.isinf(res))
    if len(rest):
        beta[rest], res[rest], steps[rest] = solve_stack(k[own[rest]], kappa[rest])
    return beta, res, steps
