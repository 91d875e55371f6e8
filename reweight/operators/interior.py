"""Problems of one large train bag as one distributed interior-point iteration on a low-rank factor of its Gram matrix.

A Gaussian Gram matrix of many rows has, to machine precision, far fewer independent columns than rows. Pivot rows
are collected until the part of every row that they do not explain is below a tolerance; then each step of the same
primal-dual barrier that solves small bags needs sums over the rows of the size of the pivots, and one small linear
system per problem, solved in a task. Problems that differ in their linear term only, one per test bag, share the factor
and step together: a block of rows evaluates its factor once a pass for all of them. The number of steps does not grow
with the rows, and hardly with the problems.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reweight.functions.dense import sq_dists
from reweight.functions.qp import BOX, sum_bounds
from reweight.operators.lineage import drop_table, reliable

# Pivots at most: they and their square matrix are what the driver and each task hold.
MAX_PIVOTS = 2000
PIVOT_BATCH = 256
CANDIDATES = 64
UNEXPLAINED = 1e-11
MAX_STEPS = 120
GAP = 1e-12
# Numbers in the square matrices of all problems that step together, which is what a task holds of them.
SYSTEM_CELLS = 2**24
# Rows whose sums are taken at once inside a task.
SLICE_ROWS = 1024

# A block's rows and vectors cross between the JVM and Python in every pass, so they are bytes and not arrays of numbers.
VECTORS = ["x", "kappa", "b", "z0", "z1", "db", "dz0", "dz1"]
STATE = "blk int, " + ", ".join(f"{c} binary" for c in VECTORS) + ", tops array<double>"


class TooManyPivots(ValueError):
    """The Gram matrix has no factor of bounded rank."""


@dataclass(frozen=True)
class Factor:
    points: np.ndarray
    root: np.ndarray
    gamma: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Rows whose products with each other are the kernel."""
        return np.exp(-self.gamma * sq_dists(x, self.points)) @ self.root


def pick_pivots(left: np.ndarray, most: int) -> list[int]:
    """Pivoted Cholesky on what is unexplained among candidates: rows that explain most, one after the other."""
    diag, cols, out = np.diag(left).copy(), [], []
    while len(out) < most:
        i = int(diag.argmax())
        if diag[i] <= UNEXPLAINED:
            break
        col = left[:, i] - (np.stack(cols, 1) @ np.array([c[i] for c in cols]) if cols else 0.0)
        col = col / math.sqrt(diag[i])
        diag = np.maximum(diag - col * col, 0.0)
        diag[i] = 0.0
        cols.append(col)
        out.append(i)
    return out


def factor_of(points: np.ndarray, gamma: float) -> Factor:
    k = np.exp(-gamma * sq_dists(points, points))
    values, vectors = np.linalg.eigh(0.5 * (k + k.T))
    keep = values > values[-1] * 1e-15 * len(points)
    return Factor(points, vectors[:, keep] / np.sqrt(values[keep]), gamma)


def low_rank(blocks: DataFrame, width: int, gamma: float) -> Factor:
    """Pivots until no row has more than UNEXPLAINED left; one job per batch, each task names a few candidates."""
    spark = blocks.sparkSession
    points = np.zeros((0, width))
    factor = None
    while True:
        shared = spark.sparkContext.broadcast(factor)

        def worst(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, most = shared.value, 0.0
            best_x, best = np.zeros((0, width)), np.zeros(0)
            for pdf in batches:
                for r in pdf.itertuples():
                    x = r.x.reshape(-1, width)
                    left = 1.0 - (own.rows(x) ** 2).sum(1) if own else np.random.default_rng(r.blk).uniform(0.5, 1.0, len(x))
                    best_x, best = np.concatenate([best_x, x]), np.concatenate([best, left])
                    at = np.argsort(-best)[:CANDIDATES]
                    best_x, best, most = best_x[at], best[at], max(most, best.max())
            yield pd.DataFrame({"left": best, "x": list(best_x)})

        got = blocks.select("blk", "x").mapInPandas(worst, "left double, x array<double>").where(F.col("left") > UNEXPLAINED).collect()
        if not got:
            if factor is None:
                raise ValueError("no rows")
            return factor
        got.sort(key=lambda r: (-r["left"], r["x"]))
        x = np.unique(np.array([r["x"] for r in got[: 16 * PIVOT_BATCH]]).reshape(-1, width), axis=0)
        left = np.exp(-gamma * sq_dists(x, x))
        if factor:
            f = factor.rows(x)
            left = left - f @ f.T
        picks = pick_pivots(left, PIVOT_BATCH)
        if not picks:  # what is left is rounding
            return factor
        points = np.concatenate([points, x[picks]])
        if len(points) > MAX_PIVOTS:
            raise TooManyPivots(f"more than {MAX_PIVOTS} pivots")
        factor = factor_of(points, gamma)


@dataclass
class Problem:
    """What the driver knows of one problem: slack and multiplier of the bounds of the sum, and its next move."""

    at: int
    lower: list[float]
    upper: list[float]
    scale: float
    u: np.ndarray  # the factor's product with the weights
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    nu: float = 0.0
    goal: float = 0.0
    step: float = 0.0
    damp: float = 0.1
    steps: int = 0
    done: bool = False

    @property
    def bound(self) -> float:
        return self.upper[1] - self.lower[1]

    def turn(self, sums: "Sums", rows: int) -> None:
        """The next direction from the sums at the present weights, or the end."""
        s = sums.s
        gap = (s[3] + self.lower[0] * self.lower[1] + self.upper[0] * self.upper[1]) / (2 * rows + 2)
        if self.steps >= MAX_STEPS or (gap <= GAP * self.scale and math.sqrt(s[5]) <= 1e-7 * self.scale):
            self.done = True
            return
        self.goal = goal = self.damp * gap
        w1, w2 = sums.x[:, 0] + goal * sums.x[:, 1], sums.x[:, 2]
        sum_p, sum_q = s[0] + goal * s[1] - sums.g[2, 0] - goal * sums.g[2, 1], s[2] - sums.g[2, 2]
        weight = self.lower[1] * self.upper[0] + self.upper[1] * self.lower[0]
        soft, shift = self.lower[0] * self.upper[0] / weight, goal * (self.upper[0] - self.lower[0]) / weight
        self.nu = (sum_p - shift) / (sum_q + soft)
        self.w = w1 - self.nu * w2
        move = self.nu * soft + shift
        self.ends = [
            [move, goal / self.lower[0] - self.lower[1] - self.lower[1] / self.lower[0] * move],
            [-move, goal / self.upper[0] - self.upper[1] + self.upper[1] / self.upper[0] * move],
        ]
        self.exact = sums.u

    def go(self, room: float) -> None:
        """The step, once it is known how far all rows can go. The factor's product with the direction is w itself."""
        pairs = list(zip((self.lower, self.upper), self.ends))
        room = min([room, *(-x / d for pair, ds in pairs for x, d in zip(pair, ds) if d < 0)])
        self.step = min(1.0, 0.995 * room)
        self.u = self.exact + self.step * self.w
        for pair, ds in pairs:
            pair[0], pair[1] = pair[0] + self.step * ds[0], pair[1] + self.step * ds[1]
        self.damp = 0.02 if self.step > 0.9 else 0.2 if self.step > 0.5 else 0.6
        self.steps += 1


@dataclass
class Sums:
    """Sums over all rows of one problem: solutions x of its linear system, products g of them with its right sides,
    single sums s, and the factor's product u with the weights."""

    x: np.ndarray
    g: np.ndarray
    s: np.ndarray
    u: np.ndarray

    @staticmethod
    def unpack(raw: bytes, rank: int) -> "Sums":
        x, g, s, u = np.split(np.frombuffer(raw), np.cumsum([3 * rank, 9, 6]))
        return Sums(x.reshape(rank, 3), g.reshape(3, 3), s, u)


def opened(r) -> SimpleNamespace:
    """A row of the state with its vectors as numbers."""
    return SimpleNamespace(blk=r.blk, **{c: np.frombuffer(getattr(r, c)) for c in VECTORS})


def moved(r, part: slice, step: float):
    """A block's weights and multipliers of one problem after the step that its row proposes."""
    return r.b[part] + step * r.db[part], r.z0[part] + step * r.dz0[part], r.z1[part] + step * r.dz1[part]


def add_sums(to: tuple, f: np.ndarray, kappa: np.ndarray, b: np.ndarray, z0: np.ndarray, z1: np.ndarray, product: np.ndarray, bound: float) -> np.ndarray:
    """Add what some rows give to the barrier's linear system (matrix, right sides), single sums and the factor's product; their
    gradients. Rows are taken a slice at a time, which stays in the cache."""
    m, v, s, u = to
    grads = np.empty(len(f))
    for at in range(0, len(f), SLICE_ROWS):
        part = slice(at, at + SLICE_ROWS)
        some, b0, y0, y1 = f[part], b[part], z0[part], z1[part]
        room = BOX - b0
        grad = grads[part] = some @ product + kappa[part]
        inverse = 1.0 / (y0 / b0 + y1 / room)
        # A product with its own transpose costs half.
        root = some * np.sqrt(inverse)[:, None]
        m += root.T @ root
        rhs = np.stack([-grad, 1.0 / b0 - 1.0 / room, np.ones_like(b0)], 1)
        rhs *= inverse[:, None]
        both = some.T @ np.concatenate([rhs, b0[:, None]], 1)
        v += both[:, :3]
        u += both[:, 3]
        s[:3] += rhs.sum(0)
        s[3] += b0 @ y0 + room @ y1
        s[4] += b0.sum()
        s[5] += ((grad - y0 + y1 + bound) ** 2).sum()
    return grads


def heading(f, kappa, b, z0, z1, u, goal: float, nu: float, w, grad: np.ndarray | None = None) -> tuple:
    """The direction (db, dz0, dz1) of some rows, and how far it can go; `grad` if their gradients are known."""
    room = BOX - b
    grad = f @ u + kappa if grad is None else grad
    pull, push, low, high = goal / b, goal / room, z0 / b, z1 / room
    db = (pull - push - grad - nu - f @ w) / (low + high)
    dz0, dz1 = pull - z0 - low * db, push - z1 + high * db
    with np.errstate(divide="ignore", invalid="ignore"):
        top = min(np.where(d < 0, -v / d, np.inf).min() for v, d in ((b, db), (room, -db), (z0, dz0), (z1, dz1)))
    return db, dz0, dz1, min(float(top), 1e9)


def system(shared, todo: list[Problem], width: int):
    """Per task and problem: the sums of the barrier's linear system, and how far the state is from optimal."""
    asked = [(p.at, p.u, p.step, p.bound) for p in todo]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = shared.value
        n = factor.root.shape[1]
        m, v, s, u = (np.zeros((len(asked), *shape)) for shape in ((n, n), (n, 3), (6,), (n,)))
        some = False
        for pdf in batches:
            for r in map(opened, pdf.itertuples()):
                some = True
                f = factor.rows(r.x.reshape(-1, width))
                for k, (at, product, step, bound) in enumerate(asked):
                    part = slice(at * len(f), (at + 1) * len(f))
                    add_sums((m[k], v[k], s[k], u[k]), f, r.kappa[part], *moved(r, part, step), product, bound)
        if some:
            rows = [np.concatenate([x.ravel() for x in (m[k], v[k], s[k], u[k])]).tobytes() for k in range(len(asked))]
            yield pd.DataFrame({"k": np.arange(len(asked), dtype="int32"), "raw": rows})

    return run


def solving(rank: int):
    """Sums per task to one row per problem: its small linear system is solved where its sums meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, raw in zip(pdf["k"], pdf["raw"]):
                a = np.frombuffer(raw)
                sums[k] = sums[k] + a if k in sums else a.copy()
        for k, a in sums.items():
            m, v, s, u = np.split(a, np.cumsum([rank * rank, 3 * rank, 6]))
            m, v = m.reshape(rank, rank), v.reshape(rank, 3)
            x = np.linalg.solve(m + np.eye(rank), v)
            out = np.concatenate([x.ravel(), (v.T @ x).ravel(), s, u]).tobytes()
            yield pd.DataFrame({"k": [k], "raw": [out]}).astype({"k": "int32"})

    return run


def direction(shared, problems: list[Problem], width: int):
    """Blocks with the state after the last step, the next direction, and how far it can go; problems at their end stay."""
    asked = [(p.done, p.u, p.step, p.goal, p.nu, p.w) for p in problems]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = shared.value
        for pdf in batches:
            rows = []
            for r in map(opened, pdf.itertuples()):
                f = factor.rows(r.x.reshape(-1, width))
                parts, tops = [], []
                for at, (done, u, step, goal, nu, w) in enumerate(asked):
                    part = slice(at * len(f), (at + 1) * len(f))
                    b, z0, z1 = moved(r, part, step)
                    if done:
                        zero = np.zeros_like(b)
                        parts.append((b, z0, z1, zero, zero, zero))
                        tops.append(1e9)
                        continue
                    *ahead, top = heading(f, r.kappa[part], b, z0, z1, u, goal, nu, w)
                    parts.append((b, z0, z1, *ahead))
                    tops.append(top)
                vectors = [r.x, r.kappa, *map(np.concatenate, zip(*parts))]
                rows.append((r.blk, *(v.tobytes() for v in vectors), np.array(tops)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    return run


def started(shared, width: int, problems: int):
    """Per task: the factor's product with ones, and the largest entry of each linear term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, tops = np.zeros(shared.value.root.shape[1]), np.zeros(problems)
        for pdf in batches:
            for x, kappa in zip(pdf["x"], pdf["kappa"]):
                out += shared.value.rows(x.reshape(-1, width)).sum(0)
                tops = np.maximum(tops, np.abs(kappa.reshape(problems, -1)).max(1))
        yield pd.DataFrame({"raw": [out.tobytes()], "tops": [tops]})

    return run


def starting(scales: list[float]):
    """Blocks to the state at weights of 1, each problem with its own scale."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for blk, x, kappa in zip(pdf["blk"], pdf["x"], pdf["kappa"]):
                each, zero = np.repeat(scales, len(kappa) // len(scales)), np.zeros(len(kappa))
                vectors = [x, kappa, np.ones(len(kappa)), each, each / (BOX - 1.0), zero, zero, zero]
                rows.append((blk, *(v.tobytes() for v in vectors), np.zeros(0)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    return run


def ended(steps: list[float]):
    """The state to the weights after each problem's last step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            beta = []
            for r in map(opened, pdf.itertuples()):
                beta.append(r.b + np.repeat(steps, len(r.b) // len(steps)) * r.db)
            yield pd.DataFrame({"blk": pdf["blk"], "beta": beta})

    return run


def cholesky(x: np.ndarray, gamma: float, most: int) -> np.ndarray | None:
    """Rows whose products with each other are the kernel, by pivots, for rows that one task holds; None beyond `most` pivots."""
    out, left = np.zeros((most, len(x))), np.ones(len(x))
    for k in range(most):
        i = int(left.argmax())
        if left[i] <= UNEXPLAINED:
            return out[:k].T
        col = np.exp(-gamma * sq_dists(x, x[i : i + 1])[:, 0]) - out[:k, i] @ out[:k]
        out[k] = col / math.sqrt(left[i])
        left = np.maximum(left - out[k] ** 2, 0.0)
        left[i] = 0.0
    return None


def solve_here(f: np.ndarray, kappa: np.ndarray) -> tuple[np.ndarray, int]:
    """The weights of one problem from the rows of its factor, and the steps: the iteration of `sequence` inside a task."""
    n, rank = f.shape
    lo, hi = sum_bounds(n)
    scale = 1.0 + float(np.abs(kappa).max())
    p = Problem(0, [n - lo, scale / (n - lo)], [hi - n, scale / (hi - n)], scale, f.sum(0))
    b, z0, z1 = np.ones(n), np.full(n, scale), np.full(n, scale / (BOX - 1.0))
    while True:
        m, v, s, u = (np.zeros(shape) for shape in ((rank, rank), (rank, 3), (6,), (rank,)))
        grad = add_sums((m, v, s, u), f, kappa, b, z0, z1, p.u, p.bound)
        x = np.linalg.solve(m + np.eye(rank), v)
        p.turn(Sums(x, v.T @ x, s, u), n)
        if p.done:
            return b, p.steps
        db, dz0, dz1, top = heading(f, kappa, b, z0, z1, p.u, p.goal, p.nu, p.w, grad)
        p.go(top)
        b, z0, z1 = b + p.step * db, z0 + p.step * dz0, z1 + p.step * dz1


def solve(blocks: DataFrame, n: int, width: int, gamma: float, problems: int = 1) -> tuple[DataFrame, list[int]]:
    """(problem, pos, row_id, kappa, beta) for blocks (blk, poss, row_ids, x, kappa) of one bag of n rows, and the steps taken.

    `kappa` holds a block's linear terms problem by problem. All problems are one iteration sequence, unless their square
    matrices exceed SYSTEM_CELLS together; then as many as fit step together.
    """
    factor = low_rank(blocks, width, gamma)
    together = max(1, SYSTEM_CELLS // max(1, factor.root.shape[1] ** 2))
    out, steps = None, []
    for low in range(0, problems, together):
        count = min(together, problems - low)
        own = F.slice("kappa", F.lit(low) * F.size("poss") + 1, F.lit(count) * F.size("poss"))
        some = blocks.withColumn("kappa", own) if count < problems else blocks
        rows, taken = sequence(some, factor, n, width, count)
        rows = rows.withColumn("problem", F.col("problem") + low)
        out, steps = rows if out is None else out.unionByName(rows), steps + taken
    return out, steps


def sequence(blocks: DataFrame, factor: Factor, n: int, width: int, count: int) -> tuple[DataFrame, list[int]]:
    """One iteration for all problems of the blocks.

    The state is a table that each step writes anew; the one before it is then removed. A step is two passes over the
    rows: sums that end in one small system per problem, and the directions, whose least room is observed as they are
    written. The driver holds vectors of the size of the pivots.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(factor)
    rank = factor.root.shape[1]
    lo, hi = sum_bounds(n)
    u, tops = np.zeros(rank), np.zeros(count)
    for r in blocks.select("x", "kappa").mapInPandas(started(shared, width, count), "raw binary, tops array<double>").toLocalIterator():
        u, tops = u + np.frombuffer(r["raw"]), np.maximum(tops, r["tops"])
    scales = (1.0 + tops).tolist()
    problems = [Problem(i, [n - lo, s / (n - lo)], [hi - n, s / (hi - n)], s, u) for i, s in enumerate(scales)]
    state, table = blocks.select("blk", "x", "kappa").mapInPandas(starting(scales), STATE), None
    while todo := [p for p in problems if not p.done]:
        sums = state.mapInPandas(system(shared, todo, width), "k int, raw binary")
        sums = sums.repartitionById(len(todo), F.col("k")).mapInPandas(solving(rank), "k int, raw binary")
        for r in sums.toLocalIterator():
            todo[r["k"]].turn(Sums.unpack(bytes(r["raw"]), rank), n)
        todo = [p for p in todo if not p.done]
        if not todo:
            break
        seen = Observation()
        new = state.mapInPandas(direction(shared, problems, width), STATE)
        new = reliable(new.observe(seen, *[F.min(F.get("tops", F.lit(p.at))).alias(f"top{p.at}") for p in todo]))
        if table is not None:
            drop_table(table)
        state = table = new
        for p in problems:
            if p.done:
                p.step = 0.0
            else:
                p.go(seen.get[f"top{p.at}"])
    part = lambda c: F.slice(c, F.col("problem") * F.size("poss") + 1, F.size("poss"))
    rows = state.mapInPandas(ended([p.step for p in problems]), "blk int, beta array<double>").join(blocks.drop("x"), "blk")
    rows = rows.select("poss", "row_ids", "kappa", "beta", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("problem"))
    rows = rows.select("problem", F.explode(F.arrays_zip("poss", "row_ids", part("kappa").alias("kappa"), part("beta").alias("beta"))).alias("r"))
    rows = rows.select("problem", F.col("r.poss").alias("pos"), F.col("r.row_ids").alias("row_id"), "r.kappa", "r.beta")
    return rows, [p.steps for p in problems]
