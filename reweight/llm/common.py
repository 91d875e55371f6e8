"""Helpers shared by the training-data operators."""

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweight.operators.lineage import reliable, shared_folder

__all__ = ["components", "empty_text", "power_of_two", "release", "reliable", "returning", "shared_folder", "tasks_for"]


def empty_text(text: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(text), F.lit(""))


def power_of_two(n: int, least: int = 1, most: int = 1 << 16) -> int:
    """The smallest power of two that is at least n, within limits."""
    return max(least, min(most, 1 << max(0, int(n) - 1).bit_length()))


def release() -> None:
    """Give the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def returning(task):
    """A function for mapInArrow that gives the memory it has freed back to the system at its end; a worker that waits for
    its next task would keep it."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def tasks_for(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `a LONG, b LONG` as `node, root`, root being the smallest node.

    Alternates star steps: each node hands its larger (then its smaller) neighbours to the smallest node it
    knows. Every round is one or two shuffles by node with map-side minima and is written to the shared folder,
    so lost executors cost one round. Nodes without an edge do not appear.
    """
    now = reliable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def state(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        return row["n"], row["h"]

    def star(df, small):
        both = df.select("a", "b") if small else df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        to = both.join(least, "a")
        if small:
            out = to.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = to.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.where("m < a").select("a", F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    seen = state(now)
    while seen[0]:
        now = reliable(star(star(now, False), True))
        if (new := state(now)) == seen:
            break
        seen = new
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
