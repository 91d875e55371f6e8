"""Blocks of one side against blocks of the other, cut into a grid of cells so that a block crosses the network once.

The left blocks of a group are dealt into `down` stripes, the right ones into `across`; a cell is a left stripe with a right
stripe. A left block is sent to the `across` cells of its row and a right one to the `down` cells of its column, all by one
exchange; the pairs of blocks are a loop inside the task, which holds one left stripe and reads right blocks as they come.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweight.functions.dense import matrix
from reweight.operators.lineage import task_count

# A left stripe that a task holds has at most so many bytes, unless one block is larger.
STRIPE_BYTES = 64 * 1024 * 1024


def grid(groups: int, left: int, right: int, left_bytes: float, right_bytes: float, tasks: int) -> tuple[int, int]:
    """(down, across): about `tasks` cells in all, as little as possible sent, left stripes of bounded size.

    With c cells a group, left * across + right * down bytes are sent, which is least at down = sqrt(c * left / right).
    """
    cells = max(1.0, tasks / max(groups, 1))
    down = math.sqrt(cells * max(left_bytes, 1.0) / max(right_bytes, 1.0))
    down = max(math.ceil(left_bytes / STRIPE_BYTES), round(down), 1)
    down = min(down, max(left, 1))
    across = min(max(1, math.ceil(cells / down)), max(right, 1))
    down = min(max(down, math.ceil(cells / across)), max(left, 1))
    return down, across


def tiled(
    left: DataFrame,
    right: DataFrame,
    shape: tuple[int, int],
    groups: int,
    schema: str,
    visit: Callable,
    finish: Callable | None = None,
    *,
    upper: bool = False,
    every: Callable | None = None,
) -> DataFrame:
    """Rows of `visit(left_row, right_row)` for all pairs of blocks of a group, and of `finish(left_row)` per cell.

    Both sides have `grp` (0..groups-1) and `at`, the number of the block in its group; other columns of either side
    are seen as attributes. `visit` gives data frames or None; it may keep sums of a left block with `left_row.add`, and of
    the cell in the dict `left_row.shared`. With `every` a right row is seen once in a cell, by `every(left_rows, right_row)`,
    which keeps sums and gives nothing; where it returns False `visit` sees the pairs. `upper`: both sides are the same blocks, and each pair of them is wanted once,
    in either order.
    """
    down, across = shape
    if upper and down != across:
        raise ValueError("an upper half needs a square grid")

    def cell(i: Column, j: Column) -> Column:
        return ((F.col("grp").cast("long") * down + i) * across + j).cast("long")

    row, column = F.pmod(F.col("at"), F.lit(down)).cast("int"), F.pmod(F.col("at"), F.lit(across)).cast("int")
    spread = lambda low, high: F.explode(F.sequence(low, high))
    one = left.withColumn("other", spread(row if upper else F.lit(0), F.lit(across - 1))).withColumn("cell", cell(row, F.col("other")))
    two = right.withColumn("other", spread(F.lit(0), column if upper else F.lit(down - 1))).withColumn("cell", cell(F.col("other"), column))
    both = one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)), allowMissingColumns=True).drop("other")
    cells = max(1, groups * down * across)
    parts = task_count(left, cells)
    both = both.repartitionById(parts, F.pmod(F.col("cell"), F.lit(parts)).cast("int")).sortWithinPartitions("cell", "side", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, shared, half = [], None, {}, False

        def ended():
            for a in held:
                if finish is not None:
                    yield from finish(a)

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.cell != now:
                    yield from ended()
                    held, now, shared = [], r.cell, {}
                    # Two different stripes meet in one cell only; a stripe meets itself on the diagonal.
                    half = upper and r.cell // across % down == r.cell % across
                if r.side == 0:
                    held.append(Block(r, shared))
                    continue
                b = Block(r, shared)
                if every is not None and held and every(held, b) is not False:
                    continue
                for a in held:
                    if not half or a.at <= b.at:
                        out = visit(a, b)
                        if out is not None:
                            yield out
        yield from ended()

    return both.mapInPandas(run, schema)


class Block:
    """A block that a task holds, with the sums that belong to it and those of its cell."""

    def __init__(self, row, shared: dict):
        self.__dict__.update(row._asdict())
        self.sums: dict = {}
        self.shared = shared

    def matrix(self, column: str, width: int):
        """The rows of a packed column, made once."""
        name = f"{column}_rows"
        if name not in self.__dict__:
            self.__dict__[name] = matrix(getattr(self, column), width)
        return self.__dict__[name]

    def add(self, key, values: np.ndarray) -> None:
        got = self.sums.get(key)
        self.sums[key] = values if got is None else got + values
