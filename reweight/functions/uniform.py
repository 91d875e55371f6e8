"""Reproducible uniforms: a hash of (tag, seed, keys) instead of a stateful generator.

A draw depends only on its keys, so a task that is retried on another executor, or a plan that runs with
another partition count, sees the same numbers.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits, which a double holds together with the half-step offset.
HEX_DIGITS = 13
STEPS = 2.0**52


def uniform(tag: str, seed: int, *keys: Column | str) -> Column:
    """Uniform in (0, 1), never 0 or 1, from md5 of ``tag|seed|key|...``."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(tag), F.lit(str(seed)), *[c.cast("string") for c in cols])
    whole = F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")
    return (whole + F.lit(0.5)) / F.lit(STEPS)
