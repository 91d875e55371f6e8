"""Cutting tables into bags, and pairing train bags with test bags.

A :class:`Bags` carries the bag rows and the geometry of the bags in closed form (how many, how large), so
later steps plan their work without counting the bag table again.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.functions.dense import SparseRows
from reweight.functions.uniform import uniform
from reweight.operators.index import row_index, shuffle_index

# Draws made per partition when bags are generated.
DRAWS_PER_PARTITION = 250_000


@dataclass(frozen=True)
class Bags:
    """Bag rows (bag_id INT, pos INT, row_id LONG, idx LONG, features or entries) with ids 0..count-1.

    `repeats`: drawn with replacement, every bag full. `cycle`: bags per repetition when several independent
    cuts of the same table are held side by side, numbered repetition by repetition.
    """

    df: DataFrame
    count: int
    size: int
    total: int
    width: int = 0
    repeats: bool = False
    cycle: int = 0

    def rows(self, bag_id: Column | str) -> Column:
        """Number of rows of a bag: every bag is full except the last one of a cut."""
        if self.repeats:
            return F.lit(self.size).cast("long")
        col = F.col(bag_id) if isinstance(bag_id, str) else bag_id
        at = (col % self.cycle if self.cycle else col).cast("long")
        return F.least(F.lit(self.size).cast("long"), F.lit(self.total) - at * self.size)

    @property
    def table_rows(self) -> int:
        if self.cycle:
            return self.total * (self.count // self.cycle)
        return self.count * self.size if self.repeats else min(self.total, self.count * self.size)


def resolve_bags(n: int, size: int | None = None, count: int | None = None) -> tuple[int, int]:
    """(size, count) of bags over n rows; what is not given follows from the other, or is one whole bag."""
    if size:
        return size, count or n // size
    return (n // count, count) if count else (n, 1)


def bag_geometry(df: DataFrame, size: int | None = None, count: int | None = None) -> DataFrame:
    """One row (n, bag_size, bag_count): :func:`resolve_bags` on the counted table."""
    n = F.count(F.lit(1))
    if size:
        bag_size, bags = F.lit(size).cast("long"), F.lit(count).cast("long") if count else F.floor(n / size)
    elif count:
        bag_size, bags = F.floor(n / count), F.lit(count).cast("long")
    else:
        bag_size, bags = n, F.lit(1).cast("long")
    return df.agg(n.alias("n"), bag_size.alias("bag_size"), bags.alias("bag_count"))


def _indexed(df: DataFrame, n: int | None) -> DataFrame:
    return df if "idx" in df.columns else row_index(df, n=n)


def width_of(df: DataFrame) -> int:
    """Length of the feature vectors; 0 for an empty table or one without features.

    Blocks are cut by this length, so vectors that are missing, of another length or with null components are an
    error. One aggregate over the features. For sparse rows, `entries` without `features`, it is the mean number of
    entries, marked as such; missing entries or null values are an error as well.
    """
    if "features" not in df.columns:
        return entries_of(df) if "entries" in df.columns else 0
    size = F.coalesce(F.size("features"), F.lit(-1))
    holes = F.coalesce(F.exists("features", lambda v: v.isNull()), F.lit(False))
    low, high, bad = df.agg(F.min(size), F.max(size), F.max(holes.cast("int"))).first()
    if low is None:
        return 0
    if low != high or low < 0 or bad:
        wrong = df.where((size != high) | holes | (size < 0)).count()
        raise ValueError(f"{wrong} rows have a missing, shorter or incomplete feature vector, beside a length of {high}")
    return low


def entries_of(df: DataFrame) -> int:
    holes = F.col("entries").isNull() | F.exists(F.map_values("entries"), lambda v: v.isNull())
    mean, wrong = df.agg(F.avg(F.size("entries")), F.sum(holes.cast("int"))).first()
    if wrong:
        raise ValueError(f"{wrong} rows have missing or incomplete entries")
    return SparseRows(math.ceil(mean)) if mean is not None else 0


def _place(df: DataFrame, size: int, *first: str) -> DataFrame:
    """bag_id and pos of a row from its position."""
    rest = [c for c in df.columns if c not in ("idx", *first)]
    return df.select(
        F.floor(F.col("idx") / size).cast("int").alias("bag_id"),
        (F.col("idx") % size).cast("int").alias("pos"),
        "idx",
        *first,
        *rest,
    )


def whole_bag(df: DataFrame, n: int, *, width: int | None = None) -> Bags:
    """The table as its single bag."""
    width = width_of(df) if width is None else width
    return Bags(_place(_indexed(df, n), max(n, 1)), min(n, 1), n, n, width)


def one_bag(bags: Bags, bag: int) -> Bags:
    """One bag as the only bag of its own table."""
    at = bag % bags.cycle if bags.cycle else bag
    rows = bags.size if bags.repeats else min(bags.size, bags.total - at * bags.size)
    df = bags.df.where(F.col("bag_id") == bag).withColumn("bag_id", F.lit(0))
    return Bags(df.withColumn("idx", F.col("pos").cast("long")), 1, rows, rows, bags.width)


def partition_bags(
    df: DataFrame, size: int, count: int, n: int | None = None, *, tail: str = "drop", width: int | None = None
) -> Bags:
    """Contiguous chunks by position; rows beyond `count` chunks are left out unless ``tail="keep"``."""
    if size < 1:
        raise ValueError("a bag needs at least one row")
    n = df.count() if n is None else n
    width = width_of(df) if width is None else width
    whole = -(-n // size)
    used = min(count, whole) if tail == "drop" else whole
    placed = _place(_indexed(df, n), size).where(F.col("bag_id") < used)
    return Bags(placed, used, size, n, width)


def bootstrap_bags(
    df: DataFrame,
    size: int,
    count: int,
    seed: int,
    n: int | None = None,
    *,
    tag: str = "boot",
    width: int | None = None,
) -> Bags:
    """`count` bags of `size` draws with replacement."""
    if size < 1:
        raise ValueError("a bag needs at least one row")
    n = df.count() if n is None else n
    width = width_of(df) if width is None else width
    if n == 0:
        return Bags(_place(_indexed(df, n), size).limit(0), 0, size, 0, width, repeats=True)
    draws = draw_positions(df.sparkSession, size, count, seed, n, tag)
    rest = [c for c in df.columns if c != "idx"]
    rows = draws.join(_indexed(df, n), "idx").select("bag_id", "pos", "idx", *rest)
    return Bags(rows, count, size, n, width, repeats=True)


def draw_positions(spark: SparkSession, size: int, count: int, seed: int, n: int, tag: str = "boot") -> DataFrame:
    """(bag_id, pos, idx): uniform positions, one hash per draw."""
    parts = max(1, -(-count * size // DRAWS_PER_PARTITION))
    ids = spark.range(0, count * size, 1, parts).select(
        F.floor(F.col("id") / size).cast("int").alias("bag_id"), (F.col("id") % size).cast("int").alias("pos")
    )
    return ids.withColumn("idx", F.floor(uniform(tag, seed, "bag_id", "pos") * F.lit(float(n))).cast("long"))


def random_disjoint(
    df: DataFrame,
    size: int,
    seed: int,
    n: int | None = None,
    *,
    tag: str = "disjoint",
    width: int | None = None,
    reps: int = 1,
) -> Bags:
    """Random chunks without replacement that cover every row; the last may be short.

    With ``reps`` the table is cut that many times independently, all in one shuffle.
    """
    if size < 1:
        raise ValueError("a bag needs at least one row")
    n = df.count() if n is None else n
    width = width_of(df) if width is None else width
    base, chunks = df.drop("idx"), -(-n // size)
    if reps == 1:
        mixed = shuffle_index(base, uniform(tag, seed, "row_id"), n)
        return Bags(_place(mixed, size), chunks, size, n, width)
    many = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    mixed = shuffle_index(many, uniform(tag, seed, "rep", "row_id"), n, rep="rep", reps=reps)
    placed = _place(mixed, size, "rep").withColumn("bag_id", F.col("bag_id") + F.col("rep") * chunks)
    return Bags(placed.drop("rep"), chunks * reps, size, n, width, cycle=chunks)


def cut_bags(bags: Bags, size: int, seed: int, *, tag: str = "part") -> Bags:
    """Every bag, all of them full, cut again into random chunks that cover its rows, in one shuffle."""
    chunks = -(-bags.size // size)
    rows = bags.df.drop("idx", "pos").withColumnRenamed("bag_id", "rep")
    mixed = shuffle_index(rows, uniform(tag, seed, "rep", "row_id"), bags.size, rep="rep", reps=bags.count)
    placed = _place(mixed, size, "rep").withColumn("bag_id", F.col("bag_id") + F.col("rep") * chunks)
    return Bags(placed.drop("rep"), chunks * bags.count, size, bags.size, bags.width, cycle=chunks)


def coverage_count(n: int, eps: float, size: int) -> int:
    """Bootstrap bags of `size` needed so that a given row is in none with probability at most eps."""
    if n == 1:
        return 1
    return math.ceil(math.log10(eps) / (size * math.log10(1.0 - 1.0 / n)))


def coverage_table(df: DataFrame, eps: float, size: int) -> DataFrame:
    """One row (n, bags): :func:`coverage_count` on the counted table."""
    n = F.count(F.lit(1))
    need = F.ceil(F.log10(F.lit(eps)) / (F.lit(size) * F.log10(1.0 - 1.0 / n.cast("double"))))
    return df.agg(n.alias("n"), F.when(n == 1, F.lit(1).cast("long")).otherwise(need).alias("bags"))


def cartesian_pairs(spark: SparkSession, tr_count: int, te_count: int) -> DataFrame:
    """(pair_id, tr_bag, te_bag): every train bag with every test bag, by arithmetic on one range of ids."""
    parts = max(1, -(-tr_count * te_count // DRAWS_PER_PARTITION))
    pair = F.col("id")
    return spark.range(0, tr_count * te_count, 1, parts).select(
        pair.alias("pair_id"),
        F.floor(pair / te_count).cast("int").alias("tr_bag"),
        (pair % te_count).cast("int").alias("te_bag"),
    )


def random_pairs(spark: SparkSession, tr_count: int, te_count: int, k: int = 10, seed: int = 0) -> DataFrame:
    """(pair_id, tr_bag, te_bag): k bags of each side without replacement, matched by random rank."""
    if k > min(tr_count, te_count):
        raise ValueError("cannot draw more bags than there are without replacement")

    def ranked(count: int, side: str) -> DataFrame:
        ids = spark.range(0, count, 1, max(1, -(-count // DRAWS_PER_PARTITION))).withColumnRenamed("id", "row_id")
        order = shuffle_index(ids, uniform(f"pair-{side}", seed, "row_id"), count, out="pair_id")
        return order.where(F.col("pair_id") < k).select("pair_id", F.col("row_id").cast("int").alias(f"{side}_bag"))

    return ranked(tr_count, "tr").join(ranked(te_count, "te"), "pair_id")


def bag_strategy(
    train: DataFrame,
    test: DataFrame,
    mode: int,
    seed: int,
    *,
    tr_size: int | None = None,
    tr_count: int | None = None,
    te_size: int | None = None,
    te_count: int | None = None,
    tr_rows: int | None = None,
    te_rows: int | None = None,
    width: int | None = None,
    tail: str = "drop",
) -> tuple[Bags, Bags, DataFrame]:
    """Train bags, test bags and their pairs; `tail` says what becomes of rows beyond full partitions.

    1: bootstrap train, partition test; 2: partition train, bootstrap test; 3: bootstrap both, all pairs;
    4: bootstrap both, random one-to-one pairs.
    """
    if mode not in (1, 2, 3, 4):
        raise ValueError("mode is 1, 2, 3 or 4")
    tr_rows = train.count() if tr_rows is None else tr_rows
    te_rows = test.count() if te_rows is None else te_rows
    width = width_of(train) if width is None else width
    s, m = resolve_bags(tr_rows, tr_size, tr_count)
    x, n = resolve_bags(te_rows, te_size, te_count)

    def cut(df, size, count, rows, side):
        bootstrap = mode in (3, 4) or (mode == 1) == (side == "train")
        if bootstrap:
            return bootstrap_bags(df, size, count, seed, rows, tag=f"boot-{side}", width=width)
        return partition_bags(df, size, count, rows, width=width, tail=tail)

    tr, te = cut(train, s, m, tr_rows, "train"), cut(test, x, n, te_rows, "test")
    spark = train.sparkSession
    if mode == 4:
        return tr, te, random_pairs(spark, tr.count, te.count, min(m, n), seed)
    return tr, te, cartesian_pairs(spark, tr.count, te.count)


def gather(bags: DataFrame, df: DataFrame, columns: Sequence[str] = ("features",)) -> DataFrame:
    """Fetch columns of the table for bag rows that only hold row ids; bags and pairs keep duplicates."""
    return bags.join(df.select("row_id", *columns), "row_id")


def unsampled_rows(df: DataFrame, bags: DataFrame) -> DataFrame:
    """Rows of the table that no bag holds."""
    return df.join(bags.select("row_id"), "row_id", "left_anti")
