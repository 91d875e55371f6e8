"""Column expressions over ``ARRAY<DOUBLE>`` feature vectors."""

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this width the distance to a fixed point is unrolled, which keeps it inside whole-stage codegen;
# higher-order functions are interpreted.
UNROLL_WIDTH = 64


def sq_distance(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences of two arrays of the same length."""
    diff = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v)


def sq_distance_to(features: Column | str, center: Sequence[float]) -> Column:
    """Squared distance of each row to one fixed point."""
    col = F.col(features) if isinstance(features, str) else features
    if len(center) > UNROLL_WIDTH:
        return sq_distance(col, F.lit(np.asarray(center, dtype=float)))
    parts = [F.get(col, F.lit(i)) - F.lit(float(c)) for i, c in enumerate(center)]
    return reduce(add, [p * p for p in parts], F.lit(0.0))


def densify(entries: Column | str, width: int) -> Column:
    """Zero-filled array of ``width`` values from a 0-based ``MAP<INT,DOUBLE>``; an index outside it is an error."""
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0)),
    )
    outside = F.exists(F.map_keys(entries), lambda k: (k < 0) | (k >= width))
    wrong = F.raise_error(F.concat(F.lit(f"an index is outside 0..{width - 1}: "), F.map_keys(entries).cast("string")))
    return F.when(outside, wrong.cast("array<double>")).otherwise(filled)
