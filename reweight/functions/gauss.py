"""Sums of Gaussian kernels over many rows of few features, by interpolation in a box.

Inside a box the kernel exp(-gamma * (x - z)^2) is, feature by feature, a polynomial in z to machine precision. So the sum
over many z needs only their Chebyshev moments, whose number depends on gamma and the box and not on the rows. The
moments hold for every x, inside the box or not, and for every gamma up to the one they were planned for.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
from numpy.polynomial.chebyshev import chebvander

# Bound of the error of one kernel value, and how many rows are expanded at once.
ERROR = 1e-14
ROWS = 4096
# Nodes of one feature at most.
MAX_NODES = 512


def node_count(spread: float) -> int | None:
    """Nodes that a feature needs, where `spread` is gamma times the squared half of the box; None beyond MAX_NODES.

    On the ellipse of radius e^u the kernel is at most exp(spread * sinh(u)^2), which bounds the error of interpolation.
    """
    if not np.isfinite(spread):
        return None
    if spread == 0.0:
        return 1
    u = np.geomspace(1e-3, 30.0, 400)
    with np.errstate(over="ignore"):
        need = (np.log(4.0 / ERROR) + spread * np.sinh(u) ** 2 - np.log(np.expm1(u))) / u
    count = int(np.ceil(need.min())) + 1
    return count if count <= MAX_NODES else None


@dataclass(frozen=True)
class Box:
    """Where the rows of the sums are, and the nodes of each feature."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    counts: tuple[int, ...]

    @property
    def shape(self) -> tuple[int, int]:
        """Moments as a matrix: the first feature by all others."""
        return self.counts[0], int(np.prod(self.counts[1:], dtype=np.int64))

    def _crossed(self, parts: list[np.ndarray]) -> np.ndarray:
        """Row by row the products of the parts of all features but the first."""
        ones = np.ones((len(parts[0]), 1))
        return reduce(lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(a), -1), parts[1:], ones)

    def moments(self, z: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """(sets, *shape): sums of products of Chebyshev polynomials over the rows, for each column of weights."""
        out = np.zeros((1 if w is None else w.shape[1], *self.shape))
        for at in range(0, len(z), ROWS):
            part = z[at : at + ROWS]
            parts = []
            for k, (low, high, count) in enumerate(zip(self.low, self.high, self.counts)):
                half = 0.5 * (high - low)
                place = (part[:, k] - 0.5 * (low + high)) / half if half else np.zeros(len(part))
                parts.append(chebvander(np.clip(place, -1.0, 1.0), count - 1))
            rest = self._crossed(parts)
            if w is None:
                out[0] += parts[0].T @ rest
            else:
                for s in range(w.shape[1]):
                    out[s] += parts[0].T @ (rest * w[at : at + ROWS, s, None])
        return out

    def nodes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of a feature, and the Chebyshev coefficients of the polynomial that is 1 at one of them."""
        count = self.counts[k]
        x = np.cos(np.pi * (np.arange(count) + 0.5) / count)
        coefficients = chebvander(x, count - 1) * (2.0 / count)
        coefficients[:, 0] *= 0.5
        return 0.5 * (self.low[k] + self.high[k]) + 0.5 * (self.high[k] - self.low[k]) * x, coefficients

    def at_nodes(self, moments: np.ndarray) -> np.ndarray:
        """Moments (sets, *shape) as weights of the nodes: the sum of a function is that of its values there."""
        tensor = moments.reshape(len(moments), *self.counts)
        for k in range(len(self.counts)):
            tensor = np.moveaxis(np.tensordot(self.nodes(k)[1], tensor, (1, k + 1)), 0, k + 1)
        return tensor.reshape(moments.shape)

    def sums(self, x: np.ndarray, gamma: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(rows, sets): kernel sums of each row of x with its own gamma, from the weights of the nodes."""
        nodes = [self.nodes(k)[0] for k in range(len(self.counts))]
        out = np.empty((len(x), len(weights)))
        for at in range(0, len(x), ROWS):
            part, g = x[at : at + ROWS], gamma[at : at + ROWS, None]
            parts = [np.exp(-g * (part[:, k, None] - t) ** 2) for k, t in enumerate(nodes)]
            rest = self._crossed(parts)
            for s, w in enumerate(weights):
                out[at : at + ROWS, s] = np.einsum("ij,ij->i", parts[0] @ w, rest)
        return out


def box_for(low, high, gamma: float) -> Box | None:
    """The box with enough nodes for kernels up to that gamma; None without finite bounds or with too many nodes."""
    low, high = [float(v) for v in low], [float(v) for v in high]
    if not np.isfinite([*low, *high, gamma]).all():
        return None
    counts = [node_count(gamma * (0.5 * (b - a)) ** 2) for a, b in zip(low, high)]
    return None if None in counts else Box(tuple(low), tuple(high), tuple(counts))
