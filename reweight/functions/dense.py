"""NumPy helpers that run inside one task on one bounded block of rows."""

import numpy as np

# Kernel entries evaluated per slice, so that a slice stays cache sized.
SLICE_CELLS = 2**17
# Beyond this width the distance matrix comes from a matrix product instead of a loop over features.
LOOP_WIDTH = 32
# A feature that so many rows in one have, at least, is a filled column of a sparse block; and a set of sparse rows is filled
# over the features that it has if that makes so many numbers for an entry, at most.
FILLED = 4


def matrix(x: np.ndarray, width: int):
    """Rows of a packed block: an array of so many columns, or sparse rows where `width` is a :class:`SparseRows`."""
    return Sparse(x) if isinstance(width, SparseRows) else x.reshape(-1, width)


def sq_dists(x, z) -> np.ndarray:
    """Squared Euclidean distances; works on (n, d), on stacks (g, n, d), and on sparse rows."""
    if isinstance(x, Sparse):
        return np.maximum(x.norms()[:, None] + z.norms()[None, :] - 2.0 * x.products(z), 0.0)
    if x.shape[-1] > LOOP_WIDTH:
        # Around a common centre the products keep their digits.
        centre = z.mean(-2, keepdims=True)
        x, z = x - centre, z - centre
        xx = (x * x).sum(-1)[..., :, None]
        zz = (z * z).sum(-1)[..., None, :]
        return np.maximum(xx + zz - 2.0 * x @ np.swapaxes(z, -1, -2), 0.0)
    out = np.zeros(x.shape[:-1] + (z.shape[-2],))
    for k in range(x.shape[-1]):
        diff = x[..., :, None, k] - z[..., None, :, k]
        np.square(diff, out=diff)
        out += diff
    return out


def gram_stack(x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Gaussian Gram matrices of a stack of bags (g, n, d), or a list of sparse ones, with one gamma per bag."""
    k = np.exp(-gamma[:, None, None] * (np.stack([sq_dists(b, b) for b in x]) if isinstance(x, list) else sq_dists(x, x)))
    k = 0.5 * (k + np.swapaxes(k, -1, -2))
    i = np.arange(k.shape[1])
    k[:, i, i] = 1.0
    return k


def kernel_dot(x: np.ndarray, z: np.ndarray, w: np.ndarray | None, gamma: float) -> np.ndarray:
    """For each row of x: the w-weighted sum of exp(-gamma * squared distance) over the rows of z.

    `w` may have several columns, each with weights of its own; so has the result then. The exponent is one matrix product of widened vectors, around a common centre so that it keeps its digits.
    """
    if isinstance(x, Sparse):
        parts = [np.exp(-gamma * sq_dists(rows, z)) for rows in x.slices(max(1, SLICE_CELLS // len(z)))]
        return np.concatenate([k.sum(1) if w is None else k @ w for k in parts])
    centre = z.mean(0)
    x, z = x - centre, z - centre
    xx, zz = -gamma * (x * x).sum(1, keepdims=True), -gamma * (z * z).sum(1, keepdims=True)
    left = np.hstack([2.0 * gamma * x, xx, np.ones_like(xx)])
    right = np.hstack([z, np.ones_like(zz), zz]).T
    out = np.empty((len(x), *(() if w is None else w.shape[1:])))
    step = max(1, SLICE_CELLS // len(z))
    for lo in range(0, len(x), step):
        k = left[lo : lo + step] @ right
        np.exp(k, out=k)
        out[lo : lo + step] = k.sum(1) if w is None else k @ w
    return out


class Stripe:
    """Rows of several blocks, each with its own gamma, against one block after the other."""

    def __init__(self, blocks: list, gamma: np.ndarray):
        self.gamma = gamma[:, None]
        self.names = None
        if isinstance(blocks[0], Sparse):
            self.names = np.unique(np.concatenate([b.index for b in blocks]))
            self.x = np.concatenate([b.filled(self.names) for b in blocks])
            xx = np.concatenate([b.norms() for b in blocks])[:, None]
            self.left = np.hstack([2.0 * self.gamma * self.x, -self.gamma * xx, -self.gamma])
        else:
            self.x = np.concatenate(blocks)

    @staticmethod
    def fits(blocks: list) -> bool:
        """Whether the blocks are filled rows, or sparse ones that have few features for their entries."""
        if not isinstance(blocks[0], Sparse):
            return True
        entries = sum(len(b.index) for b in blocks)
        return sum(map(len, blocks)) * len(np.unique(np.concatenate([b.index for b in blocks]))) <= FILLED * entries

    def sums(self, z) -> np.ndarray:
        """For each row the sum of exp(-gamma * squared distance) over the rows of z."""
        if self.names is not None:
            left, zz = self.left, z.norms()[:, None]
            z = z.filled(self.names)
        else:
            centre = z.mean(0)
            x, z = self.x - centre, z - centre
            left = np.hstack([2.0 * self.gamma * x, -self.gamma * (x * x).sum(1, keepdims=True), -self.gamma])
            zz = (z * z).sum(1, keepdims=True)
        right = np.hstack([z, np.ones_like(zz), zz]).T
        out = np.empty(len(left))
        step = max(1, SLICE_CELLS // len(z))
        for lo in range(0, len(left), step):
            k = left[lo : lo + step] @ right
            np.exp(k, out=k)
            out[lo : lo + step] = k.sum(1)
        return out


def median_distance(x: np.ndarray) -> float:
    """Median Euclidean distance over unordered pairs of rows; NaN below two rows."""
    if len(x) < 2:
        return float("nan")
    d2 = sq_dists(x, x)[np.triu_indices(len(x), 1)]
    return float(np.median(np.sqrt(d2)))


class SparseRows(int):
    """In place of a width: the table has `entries`, about so many a row."""


class Sparse:
    """Rows of a block by their entries: row lengths, feature numbers and values, packed in one array after the row count."""

    def __init__(self, packed: np.ndarray):
        n = int(packed[0])
        self.sizes = packed[1 : n + 1].astype(np.int64)
        self.index, self.value = np.split(packed[n + 1 :], 2)
        self.known = self.cut = None

    def __len__(self) -> int:
        return len(self.sizes)

    def rows(self, low: int, high: int) -> "Sparse":
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        part = slice(ends[low], ends[min(high, len(self))])
        out = object.__new__(Sparse)
        out.sizes, out.index, out.value = self.sizes[low:high], self.index[part], self.value[part]
        out.known = out.cut = None
        return out

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)

    def slices(self, step: int) -> list["Sparse"]:
        """The rows in slices, which keep what they know of their entries."""
        if step >= len(self):
            return [self]
        if self.cut is None or self.cut[0] != step:
            self.cut = step, [self.rows(lo, lo + step) for lo in range(0, len(self), step)]
        return self.cut[1]

    def norms(self) -> np.ndarray:
        return np.bincount(self.row(), self.value**2, len(self))

    def filled(self, names: np.ndarray) -> np.ndarray:
        """The rows as an array over these features, in ascending order; entries of others are left out."""
        out = np.zeros((len(self), len(names)))
        if len(names):
            at = np.minimum(np.searchsorted(names, self.index), len(names) - 1)
            there = names[at] == self.index
            out[self.row()[there], at[there]] = self.value[there]
        return out

    def grouped(self) -> tuple:
        """Features with the place of their first entry and the number of them, rows and values by feature; the features that
        many rows have, and those as filled columns."""
        if self.known is None:
            order = np.argsort(self.index, kind="stable")
            names, first, count = np.unique(self.index[order], return_index=True, return_counts=True)
            common = names[count * FILLED >= len(self)]
            self.known = names, first, count, self.row()[order], self.value[order], common, self.filled(common)
        return self.known

    def products(self, other: "Sparse") -> np.ndarray:
        """Inner products of all rows with all rows of the other block, from features that both blocks have.

        Features that many rows of both blocks have are one matrix product. Entries of the others are grouped by feature; each
        shared feature adds the products of its entries on either side. They are spelled out in runs of at most SLICE_CELLS, or
        of one feature where it has more, and summed by pair of rows.
        """
        names, first, count, row, value, common, columns = self.grouped()
        names2, first2, count2, row2, value2, common2, columns2 = other.grouped()
        if np.array_equal(common, common2):
            both, product = common, columns @ columns2.T
        else:
            both, i, j = np.intersect1d(common, common2, assume_unique=True, return_indices=True)
            product = columns[:, i] @ columns2[:, j].T
        if len(both) == len(names) or len(both) == len(names2):
            return product
        rest, i, j = np.intersect1d(names, names2, assume_unique=True, return_indices=True)
        if len(both):
            apart = ~np.isin(rest, both, assume_unique=True)
            i, j = i[apart], j[apart]
        if not len(i):
            return product
        out = np.zeros(len(self) * len(other))
        first, count, first2, count2 = first[i], count[i], first2[j], count2[j]
        work = np.cumsum(count * count2)
        low = 0
        while low < len(work):
            done = work[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(work, done + SLICE_CELLS, side="right")))
            c, c2 = count[low:high], count2[low:high]
            feature = np.repeat(np.arange(high - low), c * c2)
            place = np.arange(len(feature)) - np.repeat(np.cumsum(c * c2) - c * c2, c * c2)
            left, right = first[low:high][feature] + place // c2[feature], first2[low:high][feature] + place % c2[feature]
            out += np.bincount(row[left] * len(other) + row2[right], value[left] * value2[right], len(out))
            low = high
        return product + out.reshape(len(self), len(other))
