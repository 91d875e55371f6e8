"""Gaussian kernel sums between bags, as joins of bounded row blocks.

Bag rows are packed into blocks; a pair of bags becomes a set of (train block, test block) tasks whose ids
come from arithmetic on the bag sizes. Each task evaluates one small matrix in NumPy and returns only its row
sums, so no pair of rows ever becomes a row, and a test bag that holds most of the table is spread over as
many tasks as it has blocks. Where the blocks of a side are too large to broadcast, both sides are dealt to the
cells of a grid by one exchange instead (tiles.py).
"""

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweight.functions.dense import Sparse, SparseRows, Stripe, kernel_dot, matrix, median_distance, sq_dists
from reweight.functions.gauss import Box, box_for
from reweight.functions.qp import BOX, project, sum_bounds
from reweight.functions.uniform import uniform
from reweight.functions.vectors import sq_distance
from reweight.operators.bags import DRAWS_PER_PARTITION, Bags, one_bag, whole_bag, width_of
from reweight.operators.index import row_index
from reweight.operators.lineage import broadcast_if, reliable, small_enough, task_count
from reweight.operators.tiles import STRIPE_BYTES, Block, grid, tiled

# Bytes and rows of a block; a bag that is solved in one task may have at most BAG_ROWS rows.
BLOCK_BYTES = 256 * 1024
BLOCK_ROWS = (64, 1024)
BAG_ROWS = 4096
# Rows of at most so many features are summed by moments of the test bags once there are more kernel values than
# EXPAND_FROM; the moments of all test bags together are at most so many numbers, as each task holds them.
EXPAND_WIDTH = 3
EXPAND_FROM = 2**27
EXPAND_CELLS = 2**21
# Test rows whose moments a task adds up, where there are fewer than the cluster has tasks for.
MOMENT_ROWS = 2**13
# Rows and pairs of them whose distances say where the middle of all distances is looked for first, and the share of the
# pairs looked at on either side of it.
PROBE_ROWS = 2**16
PROBE_PAIRS = 2**22
PROBE_SHARE = 0.006
SPARSE_PROBE_ROWS = 2**11
SPARSE_PROBE_SHARE = 0.03
# Kernel sums that a cell of the grid hands on at once.
SENT_CELLS = 2**16
# Blocks that are small enough to be broadcast are dealt to a grid as well where pair by pair they were so many bytes.
SENT_BYTES = 2**30
# Bins of a pass over pair distances, and how many distances of one bin come to the driver.
BINS = 1 << 16
SHIPPED = 1_000_000


def row_bytes(width: int) -> int:
    """Bytes of a row in a block; on average for sparse rows."""
    return 16 * int(width) + 32 if isinstance(width, SparseRows) else 8 * (width + 2)


def block_rows(width: int) -> int:
    low, high = BLOCK_ROWS
    return int(min(high, max(low, BLOCK_BYTES // max(8, row_bytes(width) - 16))))


def feature_width(df: DataFrame) -> DataFrame:
    """One row (width): length of the longest feature vector."""
    return df.agg(F.max(F.size("features")).alias("width"))


def pack(rows: DataFrame, bag: str, rows_per_block: int, *extra: str) -> DataFrame:
    """(bag, blk, row_ids, x, extra...): at most `rows_per_block` rows per block, by `pos`; x row-major, or sparse rows."""
    if "features" not in rows.columns:
        rows = rows.withColumn("features", F.array_sort(F.map_entries("entries")))
        flat = lambda c: F.flatten(F.transform("rows.features", lambda r: F.transform(r, lambda e: e[c].cast("double"))))
        sizes = F.transform("rows.features", lambda r: F.size(r).cast("double"))
        x = F.concat(F.array(F.size("rows").cast("double")), sizes, flat("key"), flat("value"))
    else:
        x = F.flatten("rows.features")
    item = F.struct("pos", "row_id", "features", *extra)
    return (
        rows.withColumn("blk", F.floor(F.col("pos") / rows_per_block).cast("int"))
        .groupBy(bag, "blk")
        .agg(F.sort_array(F.collect_list(item)).alias("rows"))
        .select(
            bag,
            "blk",
            F.col("rows.pos").alias("poss"),
            F.col("rows.row_id").alias("row_ids"),
            x.alias("x"),
            *[F.col(f"rows.{e}").alias(e) for e in extra],
        )
    )


def kernel_sums(x: np.ndarray, z: np.ndarray, w: np.ndarray | None, width: int, gamma: float) -> np.ndarray:
    """Kernel row sums of one block pair. `w` holds weights of the right-hand rows, set by set; so does the result."""
    return set_sums(matrix(x, width), matrix(z, width), w, gamma)


def set_sums(a, b, w: np.ndarray | None, gamma: float) -> np.ndarray:
    if w is None or len(w) == len(b):
        return kernel_dot(a, b, w, gamma)
    return kernel_dot(a, b, w.reshape(-1, len(b)).T, gamma).T.ravel()


def sum_udf(width: int, weighted: bool):
    """Kernel row sums of one block pair, optionally weighted by the right-hand row."""

    def plain(x: pd.Series, z: pd.Series, gamma: pd.Series) -> pd.Series:
        return pd.Series([kernel_sums(a, b, None, width, g) for a, b, g in zip(x, z, gamma, strict=True)])

    def with_weight(x: pd.Series, z: pd.Series, gamma: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([kernel_sums(a, b, c, width, g) for a, b, g, c in zip(x, z, gamma, w, strict=True)])

    return F.pandas_udf(with_weight if weighted else plain, "array<double>")


def width_udf(width: int):
    """Median pair distance of one packed bag."""

    def median(x: pd.Series) -> pd.Series:
        return x.map(lambda a: median_distance(matrix(a, width)))

    return F.pandas_udf(median, "double")


def holder(df: DataFrame) -> str:
    """The column that holds a row's features."""
    return "features" if "features" in df.columns else "entries"


def left_rows(tr: Bags, width: int) -> int:
    """Rows per block on the train side: a bag that fits one task stays whole."""
    return max(tr.size, 1) if tr.size <= BAG_ROWS else block_rows(width)


def packed_left(tr: Bags, width: int, gamma: float | None, *extra: str, rows: int | None = None) -> DataFrame:
    """Train blocks (tr_bag, tr_blk, poss, row_ids, x, gamma) of `rows` rows; gamma is global or each bag's own width."""
    blocks = pack(tr.df.withColumnRenamed("bag_id", "tr_bag"), "tr_bag", left_rows(tr, width) if rows is None else rows, *extra)
    blocks = blocks.withColumnRenamed("blk", "tr_blk")
    if gamma is not None:
        return blocks.withColumn("gamma", F.lit(float(gamma)))
    if tr.size > BAG_ROWS:
        # Few bags, each with its own selection over block pairs.
        own = [one_bag(tr, b) for b in range(tr.count)]
        rows = [b.df.select(F.col("idx").alias("row_id"), "idx", holder(b.df)) for b in own]
        widths = [(b, kernel_width(r, o.total, width=width, bag_rows=BAG_ROWS)) for b, (r, o) in enumerate(zip(rows, own, strict=True))]
        table = tr.df.sparkSession.createDataFrame(widths, "tr_bag int, gamma double")
        return blocks.join(broadcast_if(table, 16 * len(widths)), "tr_bag")
    return blocks.withColumn("gamma", width_udf(width)("x"))


def packed_right(te: Bags, width: int, *extra: str) -> DataFrame:
    """Test blocks (te_bag, te_blk, z, extra...)."""
    blocks = pack(te.df.withColumnRenamed("bag_id", "te_bag"), "te_bag", block_rows(width), *extra)
    return blocks.select("te_bag", F.col("blk").alias("te_blk"), F.col("x").alias("z"), *extra)


def block_tasks(tr: Bags, te: Bags, pairs: DataFrame, n_pairs: int, width: int) -> tuple[DataFrame, int]:
    """One row per (pair, train block, test block), spread over the cluster, and the number of them.

    `pair_id` counts from 0, so a task's place in the sequence of all tasks is arithmetic. Partitions are equal
    runs of that sequence: a pair with many blocks is split, while neighbouring blocks of a pair meet in one
    partition, where their sums combine before the shuffle.
    """
    left, right = left_rows(tr, width), block_rows(width)

    def blocks(bags: Bags, bag: str, rows: int):
        last = F.ceil(bags.rows(bag) / rows).cast("int") - 1
        return F.explode(F.sequence(F.lit(0), last))

    per_side = -(-max(tr.size, 1) // left), -(-max(te.size, 1) // right)
    units = n_pairs * per_side[0] * per_side[1]
    parts = task_count(pairs, units)
    place = (F.col("pair_id") * per_side[0] + F.col("tr_blk")) * per_side[1] + F.col("te_blk")
    part = F.least(F.floor(place * (parts / max(units, 1))), F.lit(parts - 1)).cast("int")
    tasks = (
        pairs.withColumn("tr_blk", blocks(tr, "tr_bag", left))
        .withColumn("te_blk", blocks(te, "te_bag", right))
        .repartitionById(parts, part)
    )
    return tasks, units


def bounds_of(df: DataFrame, width: int) -> tuple[list, list]:
    """Least and largest value of each feature; one aggregate."""
    values = [F.get("features", F.lit(k)) for k in range(width)]
    row = df.agg(*[F.min(v) for v in values], *[F.max(v) for v in values]).first()
    return list(row[:width]), list(row[width:])


def expansion(tr: Bags, te: Bags, gamma: float | None, width: int, n_pairs: int, sets: int = 1) -> Box | None:
    """The box of the test rows if moments are the cheaper way to the kernel sums, else None.

    Moments cost rows times nodes on either side, instead of rows times rows. Each train bag's own width is at most the
    diameter of the train rows.
    """
    if isinstance(width, SparseRows) or not 1 <= width <= EXPAND_WIDTH:
        return None
    rows = te.table_rows, n_pairs * max(tr.size, 1)
    work = rows[1] * te.size * sets
    if work < EXPAND_FROM or te.size <= BLOCK_ROWS[1]:
        return None
    low, high = bounds_of(te.df, width)
    if None in low:
        return None
    if gamma is None:
        first, last = bounds_of(tr.df, width)
        if None in first:
            return None
        gamma = math.sqrt(sum((b - a) ** 2 for a, b in zip(first, last)))
    box = box_for(low, high, gamma)
    if box is None:
        return None
    cells = sets * math.prod(box.counts)
    return box if te.count * cells <= EXPAND_CELLS and cells * sum(rows) <= work else None


def bag_moments(te: DataFrame, box: Box, width: int) -> dict[int, np.ndarray]:
    """Per test bag the weights of the nodes, from rows (te_bag, z) or (te_bag, z, w) of one or more test rows each.

    Each task adds up its rows, whatever their bags, and sends one matrix per bag.
    """
    weighted = "w" in te.columns

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for bag, rows in pdf.groupby("te_bag"):
                z = np.concatenate(rows["z"].to_list()).reshape(-1, width)
                w = None
                if weighted:
                    sizes = [len(v) // width for v in rows["z"]]
                    w = np.concatenate([v.reshape(-1, n).T for v, n in zip(rows["w"], sizes)])
                got = box.moments(z, w)
                sums[bag] = sums[bag] + got if bag in sums else got
        yield from packed(sums)

    def packed(sums: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        for bag, a in sums.items():
            yield pd.DataFrame({"te_bag": [bag], "raw": [a.tobytes()]}).astype({"te_bag": "int32"})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for bag, raw in zip(pdf["te_bag"], pdf["raw"]):
                a = np.frombuffer(raw)
                sums[bag] = sums[bag] + a if bag in sums else a.copy()
        yield from packed(sums)

    parts = te.mapInPandas(partial, "te_bag int, raw binary")
    rows = parts.repartition(task_count(te, 64), "te_bag").mapInPandas(total, "te_bag int, raw binary")
    return {r["te_bag"]: box.at_nodes(np.frombuffer(r["raw"]).reshape(-1, *box.shape)) for r in rows.toLocalIterator()}


def moments_of_bags(tr: Bags, te: Bags, gamma: float | None, width: int, *, n_pairs: int, right: DataFrame | None = None, sets: int = 1):
    """The box and, broadcast, the moments of each test bag; None where pairs of blocks are to be summed."""
    box = expansion(tr, te, gamma, width, n_pairs, sets)
    if box is None:
        return None
    if right is None:
        right = te.df.select(F.col("bag_id").alias("te_bag"), F.col("features").alias("z"))
    # Cut by work: adaptive execution would cut by bytes, and give most of a table to one task.
    parts = min(task_count(right, te.table_rows), -(-te.table_rows // MOMENT_ROWS))
    right = right.repartition(parts) if parts > 1 else right
    return box, te.df.sparkSession.sparkContext.broadcast(bag_moments(right, box, width))


def expanded_sums(
    tr: Bags, te: Bags, pairs: DataFrame, gamma: float | None, width: int, *, n_pairs: int, left: DataFrame | None = None, right: DataFrame | None = None, sets: int = 1
) -> DataFrame | None:
    """Packed train blocks with `ksum` over their whole test bag, by moments; None where pairs of blocks are to be summed.

    `right` are packed test blocks with weights `w`, `sets` of them for each row.
    """
    found = moments_of_bags(tr, te, gamma, width, n_pairs=n_pairs, right=right, sets=sets)
    if found is None:
        return None
    box, shared = found
    left = packed_left(tr, width, gamma) if left is None else left

    def sums(x: pd.Series, g: pd.Series, bag: pd.Series) -> pd.Series:
        sizes = [len(v) // width for v in x]
        rows, each = np.concatenate(x.to_list()).reshape(-1, width), np.repeat(g.to_numpy(), sizes)
        bags = np.repeat(bag.to_numpy(), sizes)
        out = np.empty((len(rows), sets))
        for b in np.unique(bags):
            at = np.flatnonzero(bags == b)
            out[at] = box.sums(rows[at], each[at], shared.value[b])
        return pd.Series([v.T.ravel() for v in np.split(out, np.cumsum(sizes)[:-1])])

    joined = left.join(broadcast_if(pairs, 16 * n_pairs), "tr_bag")
    joined = joined.repartition(task_count(pairs, n_pairs * blocks_of(tr, left_rows(tr, width))), "pair_id", "tr_blk")
    return joined.withColumn("ksum", F.pandas_udf(sums, "array<double>")("x", "gamma", "te_bag"))


def block_sums(
    tr: Bags,
    te: Bags,
    pairs: DataFrame,
    gamma: float | None,
    width: int,
    *,
    weight: str | None = None,
    n_pairs: int | None = None,
    left: DataFrame | None = None,
    right: DataFrame | None = None,
) -> DataFrame:
    """Packed train blocks with `ksum`, their kernel row sums over one test block or a stripe of them.

    `left` and `right` take blocks that are already packed.
    """
    n_pairs = pairs.count() if n_pairs is None else n_pairs
    extra = [weight] if weight else []
    left = packed_left(tr, width, gamma) if left is None else left
    right = packed_right(te, width, *extra) if right is None else right
    sizes = tr.table_rows * row_bytes(width), te.table_rows * row_bytes(width)
    # What tasks would be sent of the blocks, pair by pair.
    units = n_pairs * blocks_of(tr, left_rows(tr, width)) * blocks_of(te, block_rows(width))
    sent = units * row_bytes(width) * (min(tr.size, left_rows(tr, width)) + min(te.size, block_rows(width)))
    if not all(map(small_enough, sizes)) or sent > SENT_BYTES:
        return tiled_sums(tr, te, pairs, width, left, right, sizes, n_pairs=n_pairs, weight=weight)
    tasks, _ = block_tasks(tr, te, pairs, n_pairs, width)
    joined = tasks.join(F.broadcast(left), ["tr_bag", "tr_blk"]).join(F.broadcast(right), ["te_bag", "te_blk"])
    return joined.withColumn("ksum", sum_udf(width, bool(weight))("x", "z", "gamma", *extra)).drop("z", "te_blk", *extra)


SUMS = "tr_bag int, te_bag int, tr_blk int, poss array<int>, row_ids array<long>, x array<double>, gamma double, ksum array<double>"


def blocks_of(bags: Bags, rows: int) -> int:
    """Blocks of a full bag."""
    return max(1, -(-bags.size // rows))


def grouped_sides(tr: Bags, te: Bags, pairs: DataFrame, left: DataFrame, right: DataFrame, width: int, n_pairs: int):
    """Both sides with `grp` and `at` for the grid, the number of groups, and blocks a group on either side.

    Where every train bag meets every test bag all blocks are one group; else a group is a pair.
    """
    rows = blocks_of(tr, left_rows(tr, width)), blocks_of(te, block_rows(width))
    if n_pairs == tr.count * te.count:
        one, two = left.withColumn("grp", F.lit(0).cast("long")), right.withColumn("grp", F.lit(0).cast("long"))
        counts = 1, tr.count * rows[0], te.count * rows[1]
    else:
        known = broadcast_if(pairs.select(F.col("pair_id").alias("grp"), "tr_bag", "te_bag"), 16 * n_pairs)
        one, two = left.join(known.drop("te_bag"), "tr_bag"), right.join(known.drop("tr_bag"), "te_bag")
        counts = n_pairs, rows[0], rows[1]
    at = lambda bag, blk, n: (F.col(bag).cast("long") * n + F.col(blk)).alias("at")
    return one.select("*", at("tr_bag", "tr_blk", rows[0])), two.select("*", at("te_bag", "te_blk", rows[1])), *counts


def sum_frames(a: Block) -> Iterator[pd.DataFrame]:
    """The sums of a left block as rows of SUMS, many in a frame: a frame for each would cost more than small sums do."""
    found = iter(a.sums.items())
    while some := list(islice(found, max(1, SENT_CELLS // len(a.poss)))):
        rows = [(a.tr_bag, te_bag, a.tr_blk, a.poss, a.row_ids, a.x, a.gamma, ksum) for te_bag, ksum in some]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMS.split(", ")])


def tiled_sums(
    tr: Bags, te: Bags, pairs: DataFrame, width: int, left: DataFrame, right: DataFrame, sizes: tuple, *, n_pairs: int, weight: str | None
) -> DataFrame:
    """:func:`block_sums` by cells of a grid: the blocks of either side cross the network once per stripe of the other."""
    one, two, groups, down, across = grouped_sides(tr, te, pairs, left, right, width, n_pairs)
    shape = grid(groups, down, across, *sizes, task_count(pairs, groups * down * across))

    def visit(a, b):
        w = getattr(b, weight) if weight else None
        a.add(b.te_bag, set_sums(a.matrix("x", width), b.matrix("z", width), w, a.gamma))

    def every(held, b):
        shared = held[0].shared
        if "stripe" not in shared:
            rows = [a.matrix("x", width) for a in held]
            sizes = [len(r) for r in rows]
            shared["ends"] = np.cumsum([0, *sizes]).tolist()
            shared["stripe"] = Stripe(rows, np.repeat([a.gamma for a in held], sizes)) if Stripe.fits(rows) else None
        if shared["stripe"] is None:
            return False
        sums, ends = shared["stripe"].sums(b.matrix("z", width)), shared["ends"]
        for a, lo, hi in zip(held, ends, ends[1:]):
            a.add(b.te_bag, sums[lo:hi])

    rows = tiled(one, two, shape, groups, SUMS, visit, sum_frames, every=None if weight else every)
    if not small_enough(16 * n_pairs) and numbered(pairs, tr.count, te.count, n_pairs):
        return rows.withColumn("pair_id", F.col("tr_bag").cast("long") * te.count + F.col("te_bag"))
    return rows.join(broadcast_if(pairs, 16 * n_pairs), ["tr_bag", "te_bag"])


def numbered(pairs: DataFrame, down: int, across: int, n_pairs: int) -> bool:
    """Whether the pairs are all of so many bags with so many, numbered row by row, so that their ids need no join."""
    if n_pairs != down * across:
        return False
    place = F.col("tr_bag").cast("long") * across + F.col("te_bag")
    known = (F.col("pair_id") == place) & F.col("tr_bag").between(0, down - 1) & F.col("te_bag").between(0, across - 1)
    rows, wrong = pairs.agg(F.count(F.lit(1)), F.sum(F.when(known, 0).otherwise(1))).first()
    return rows == n_pairs and not wrong


def pair_sums(tr: Bags, te: Bags, pairs: DataFrame, gamma: float | None, width: int, **how) -> DataFrame:
    """(pair_id, tr_bag, te_bag, pos, row_id, ksum): block sums added up per train bag row."""
    whole = None
    if how.get("weight") is None:
        n_pairs = pairs.count() if how.get("n_pairs") is None else how["n_pairs"]
        how = {**how, "n_pairs": n_pairs}
        whole = expanded_sums(tr, te, pairs, gamma, width, n_pairs=n_pairs, left=how.get("left"))
    sums = block_sums(tr, te, pairs, gamma, width, **how) if whole is None else whole
    rows = sums.select(
        "pair_id", "tr_bag", "te_bag", F.explode(F.arrays_zip("poss", "row_ids", "ksum")).alias("r")
    ).select("pair_id", "tr_bag", "te_bag", "r.*")
    keys = ["pair_id", "tr_bag", "te_bag", F.col("poss").alias("pos"), F.col("row_ids").alias("row_id")]
    if whole is not None or te.size <= block_rows(width):
        return rows.select(*keys, "ksum")
    return rows.groupBy(*keys).agg(F.sum("ksum").alias("ksum"))


def kappa(
    tr: Bags, te: Bags, pairs: DataFrame, gamma: float | None = None, *, n_pairs: int | None = None
) -> DataFrame:
    """(pair_id, tr_bag, te_bag, pos, row_id, kappa): -(n_tr / n_te) times the kernel sum over the test bag."""
    sums = pair_sums(tr, te, pairs, gamma, tr.width, n_pairs=n_pairs)
    return sums.withColumn("kappa", kappa_scale(tr, te) * F.col("ksum")).drop("ksum")


def kappa_scale(tr: Bags, te: Bags) -> Column:
    return -(tr.rows("tr_bag") / te.rows("te_bag"))


def self_pairs(tr: Bags) -> DataFrame:
    """Each bag with itself."""
    bag = F.col("id").cast("int")
    return tr.df.sparkSession.range(tr.count).select(
        F.col("id").alias("pair_id"), bag.alias("tr_bag"), bag.alias("te_bag")
    )


GRAM = "bag_id int, pos int, blk int, k array<double>"


def gram(tr: Bags, gamma: float | None = None) -> DataFrame:
    """(bag_id, pos, blk, k): rows of each bag's Gram matrix, cut into array pieces of one block."""
    width = tr.width
    pairs, left, right = self_pairs(tr), packed_left(tr, width, gamma), packed_right(tr, width)
    size = tr.table_rows * row_bytes(width)

    def piece(a, b) -> pd.DataFrame:
        k = np.exp(-a.gamma * sq_dists(*((r.matrix(c, width) if isinstance(r, Block) else matrix(getattr(r, c), width)) for r, c in ((a, "x"), (b, "z")))))
        return pd.DataFrame({"bag_id": a.tr_bag, "pos": a.poss, "blk": b.te_blk, "k": list(k)})

    if not small_enough(size):
        one, two, groups, down, across = grouped_sides(tr, tr, pairs, left, right, width, tr.count)
        shape = grid(groups, down, across, size, size, task_count(pairs, groups * down * across))
        return tiled(one, two, shape, groups, GRAM, piece)
    tasks, _ = block_tasks(tr, tr, pairs, tr.count, width)
    joined = tasks.join(F.broadcast(left), ["tr_bag", "tr_blk"]).join(F.broadcast(right), ["te_bag", "te_blk"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield piece(r, r)

    return joined.select("tr_bag", "te_blk", "poss", "x", "z", "gamma").mapInPandas(rows, GRAM)


def kmm_bounds(bags: DataFrame) -> DataFrame:
    """(bag_id, n, eps, sum_lo, sum_hi, box): limits of the weights of each bag."""
    n = F.col("n").cast("double")
    return (
        bags.groupBy("bag_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("eps", (F.sqrt(n) - 1.0) / F.sqrt(n))
        .withColumn("sum_lo", n * (1.0 - F.col("eps")))
        .withColumn("sum_hi", n * (1.0 + F.col("eps")))
        .withColumn("box", F.lit(BOX))
    )


def kmm_gradient(tr: Bags, kappas: DataFrame, gamma: float | None = None) -> DataFrame:
    """(bag_id, pos, row_id, beta, kappa, kbeta, grad); `tr.df` has `beta`, `kappas` is per (bag_id, pos)."""
    width = tr.width
    prod = pair_sums(tr, tr, self_pairs(tr), gamma, width, weight="beta", n_pairs=tr.count)
    prod = prod.select(F.col("tr_bag").alias("bag_id"), "pos", F.col("ksum").alias("kbeta"))
    here = tr.df.select("bag_id", "pos", "row_id", "beta").join(kappas.select("bag_id", "pos", "kappa"), ["bag_id", "pos"])
    return here.join(prod, ["bag_id", "pos"]).withColumn("grad", F.col("kbeta") + F.col("kappa"))


def kmm_step(grads: DataFrame, rate: float) -> DataFrame:
    """(bag_id, pos, row_id, beta): one gradient step of the given rate, clipped to the box."""
    moved = F.col("beta") - F.lit(float(rate)) * F.col("grad")
    return grads.select("bag_id", "pos", "row_id", F.least(F.greatest(moved, F.lit(0.0)), F.lit(BOX)).alias("beta"))


def kmm_objective(grads: DataFrame) -> DataFrame:
    """(bag_id, objective): beta'K beta / 2 + kappa'beta."""
    term = F.col("beta") * (0.5 * F.col("kbeta") + F.col("kappa"))
    return grads.groupBy("bag_id").agg(F.sum(term).alias("objective"))


def clipped(v):
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(BOX))


def sum_shifts(moved: DataFrame, key: str, bounds: dict[int, tuple[float, float]]) -> dict[int, float]:
    """Per key the number to subtract from its `v` before clipping so that the sum meets its nearer bound.

    Safeguarded Newton on piecewise linear functions: each pass is one aggregate for all keys that are not there yet, and
    on the last piece the step is exact.
    """
    lam = dict.fromkeys(bounds, 0.0)
    state = {}
    for r in moved.groupBy(key).agg(F.sum(clipped(F.col("v"))).alias("total"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        lo, hi = bounds[r[key]]
        if not lo <= r["total"] <= hi:
            state[r[key]] = [lo if r["total"] < lo else hi, r["low"] - hi, r["high"]]
    for _ in range(60):
        if not state:
            break
        now = F.create_map(*[F.lit(x) for k in state for x in (k, lam[k])])
        v = F.col("v") - F.element_at(now, F.col(key))
        inner = (v > 0.0) & (v < BOX)
        some = moved.where(F.col(key).isin(list(state)))
        for r in some.groupBy(key).agg(F.sum(clipped(v)).alias("now"), F.sum(inner.cast("double")).alias("slope")).collect():
            k = r[key]
            target, low, high = state[k]
            if abs(r["now"] - target) <= 1e-12 * max(1.0, target):
                del state[k]
                continue
            low, high = (lam[k], high) if r["now"] > target else (low, lam[k])
            step = lam[k] + (r["now"] - target) / r["slope"] if r["slope"] else math.nan
            state[k] = [target, low, high]
            lam[k] = step if low < step < high else 0.5 * (low + high)
    return lam


def kmm_residual(grads: DataFrame, rate: float) -> DataFrame:
    """(bag_id, residual): largest move of one projected step.

    Bags of at most BAG_ROWS rows are projected in one task each. Larger ones are projected by passes of sums, all of them
    in each pass, so none is gathered; there are at most rows / BAG_ROWS of those.
    """
    moved = F.col("beta") - F.lit(float(rate)) * F.col("grad")
    rows = grads.select("bag_id", "beta", moved.alias("v"))
    large = {r["bag_id"]: r["n"] for r in rows.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BAG_ROWS).collect()}
    small = rows.where(~F.col("bag_id").isin(list(large))) if large else rows
    packed = small.groupBy("bag_id").agg(F.collect_list(F.struct("beta", "v")).alias("r"))

    def largest(beta: pd.Series, moved: pd.Series) -> pd.Series:
        return pd.Series([np.abs(b - project(m[None])[0]).max() for b, m in zip(beta, moved, strict=True)])

    out = packed.select("bag_id", F.pandas_udf(largest, "double")(F.col("r.beta"), F.col("r.v")).alias("residual"))
    if not large:
        return out
    own = reliable(rows.where(F.col("bag_id").isin(list(large))))
    return out.unionByName(moves(own, "bag_id", {b: sum_bounds(n) for b, n in large.items()}))


def moves(rows: DataFrame, key: str, bounds: dict[int, tuple[float, float]]) -> DataFrame:
    """(key, residual): per key the largest difference between `beta` and the feasible point nearest to `v`."""
    lam = sum_shifts(rows, key, bounds)
    shift = F.element_at(F.create_map(*[F.lit(x) for k in lam for x in (k, lam[k])]), F.col(key))
    return rows.groupBy(key).agg(F.max(F.abs(clipped(F.col("v") - shift) - F.col("beta"))).alias("residual"))


def bag_widths(bags: Bags) -> DataFrame:
    """(bag_id, gamma): median distance over pairs of positions; copies of a row are at distance 0."""
    return packed_left(bags, bags.width, None).select(F.col("tr_bag").alias("bag_id"), "gamma")


def kernel_width(
    df: DataFrame, n: int | None = None, *, width: int | None = None, bag_rows: int = BAG_ROWS
) -> float:
    """Exact median distance over all pairs of rows of the table.

    Beyond one block the middle order statistics of the squared distances are found by passes over all pairs of blocks,
    cut into cells of a grid: a pass counts the distances in equal bins between known bounds, and once a bin with a wanted
    rank has few distances, the next pass ships those. Two passes are usual; nothing but counts leaves a task before.
    Rows of few features are packed by place, and the bounds are first set close around the middle of the distances of
    some rows: pairs of blocks whose boxes are nearer or farther are counted without their distances. The ranks show if
    the middle is not there; then the bounds of all distances are taken.
    """
    n = df.count() if n is None else n
    if n < 2:
        return float("nan")
    width = width_of(df) if width is None else width
    if n <= bag_rows:
        return packed_left(whole_bag(df, n, width=width), width, None).first()["gamma"]
    rows = block_rows(width)
    # Read by every pass, on both sides of the grid.
    if not isinstance(width, SparseRows) and 1 <= width <= EXPAND_WIDTH:
        placed, count = packed_by_place(df, n, width)
        pairs = PairDistances(reliable(placed), n, width, count, probe(df, n, width))
    else:
        blocks = pack(whole_bag(df, n, width=width).df, "bag_id", rows).select(F.lit(0).cast("long").alias("grp"), F.col("blk").cast("long").alias("at"), "x")
        start = sparse_probe(df, n) if isinstance(width, SparseRows) else None
        pairs = PairDistances(reliable(blocks), n, width, -(-n // rows), start)
    ranks = sorted({(n * (n - 1) // 2 - 1) // 2, n * (n - 1) // 2 // 2})
    return float(np.sqrt([pairs.order_statistic(r) for r in ranks]).mean())


def packed_by_place(df: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """Blocks (grp, at, x, low, high) of rows that are near each other, with their range in each feature, and their number.

    Quantiles of each feature cut the table into cells of about a quarter of a block. A cell with more rows than a block is dealt
    by a hash of the row number.
    """
    most = block_rows(width)
    wide = [k for k, (a, b) in enumerate(zip(*bounds_of(df, width))) if a != b]
    cuts = min(2**12, math.ceil((4 * n / most) ** (1 / max(1, len(wide)))))
    placed, cell = df.select("row_id", "features"), F.lit(0).cast("long")
    if wide and cuts > 1:
        values = [F.get("features", F.lit(k)) for k in wide]
        shares = [i / cuts for i in range(1, cuts)]
        found = placed.agg(*[F.percentile_approx(v, shares, 10 * cuts) for v in values]).first()
        for k, v, at in zip(wide, values, found):
            splits = [-float("inf"), *sorted(set(at)), float("inf")]
            cutter = Bucketizer(splits=splits, inputCol=f"v{k}", outputCol=f"c{k}", handleInvalid="keep")
            placed = cutter.transform(placed.withColumn(f"v{k}", v))
            cell = cell * len(splits) + F.col(f"c{k}").cast("long")
    placed = placed.select("row_id", "features", cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted(map(tuple, sizes.collect()))
    first, known = 0, []
    for c, rows in sizes:
        parts = -(-rows // most)
        known.append((c, first, parts))
        first += parts
    table = df.sparkSession.createDataFrame(known, "cell long, first long, parts long")
    at = F.col("first") + F.pmod(F.xxhash64("row_id", "features"), F.col("parts"))
    rows = placed.join(broadcast_if(table, 24 * len(known)), "cell").withColumn("at", at)
    ends = [F.array(*[f(F.get("features", F.lit(k))) for k in range(width)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    blocks = rows.groupBy("at").agg(F.flatten(F.collect_list("features")).alias("x"), *ends)
    return blocks.withColumn("grp", F.lit(0).cast("long")), max(1, first)


def probe(df: DataFrame, n: int, width: int) -> tuple[float, float] | None:
    """Bounds of squared distances around the middle, from the distances among some rows; where passes begin."""
    some = df.where(uniform("width-probe", 0, "row_id") < PROBE_ROWS / n).select("features").limit(2 * PROBE_ROWS).toArrow()
    if some.num_rows < 64:
        return None
    x = some.column(0).combine_chunks().flatten().to_numpy().reshape(-1, width)
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, len(x), PROBE_PAIRS), rng.integers(0, len(x) - 1, PROBE_PAIRS)
    d2 = ((x[i] - x[j + (j >= i)]) ** 2).sum(1)
    low, high = np.quantile(d2, [0.5 - PROBE_SHARE, 0.5 + PROBE_SHARE])
    return (float(low), float(high)) if np.isfinite([low, high]).all() and low < high else None


def sparse_probe(df: DataFrame, n: int) -> tuple[float, float] | None:
    """The same for rows with entries, from all distances among fewer rows."""
    some = df.where(uniform("width-probe", 0, "row_id") < SPARSE_PROBE_ROWS / n).select("entries").limit(SPARSE_PROBE_ROWS * 5 // 4).toArrow()
    if some.num_rows < 64:
        return None
    sizes, names, values = [], [], []
    for c in some.column(0).chunks:
        ends = c.offsets.to_numpy()
        inside = slice(ends[0], ends[-1])
        sizes.append(np.diff(ends))
        names.append(c.keys.to_numpy(zero_copy_only=False)[inside])
        values.append(c.items.to_numpy(zero_copy_only=False)[inside])
    x = Sparse(np.concatenate([[float(some.num_rows)], *sizes, *names, *values]))
    d2 = sq_dists(x, x)[np.triu_indices(len(x), 1)]
    low, high = np.quantile(d2, [0.5 - SPARSE_PROBE_SHARE, 0.5 + SPARSE_PROBE_SHARE])
    return (float(low), float(high)) if np.isfinite([low, high]).all() and low < high else None


def box_distances(a, b) -> tuple[float, float]:
    """Bounds of the squared distances between rows of two blocks."""
    near = far = 0.0
    for low, high, low2, high2 in zip(a.low, a.high, b.low, b.high):
        gap = max(low - high2, low2 - high, 0.0)
        reach = max(high - low2, high2 - low)
        near, far = near + gap * gap, far + reach * reach
    return near, far


class PairDistances:
    """Squared distances of all pairs of rows of packed blocks (grp, at, x), by their order.

    Blocks with `low` and `high`, their range in each feature, are compared by these first. `start` are bounds within
    which the wanted distances probably are.
    """

    def __init__(self, blocks: DataFrame, n: int, width: int, count: int, start: tuple[float, float] | None = None):
        self.blocks, self.width, self.start = blocks, width, start
        self.boxed = "low" in blocks.columns
        size = n * row_bytes(width)
        tasks = task_count(blocks, count * (count + 1) // 2)
        side = max(math.ceil(size / STRIPE_BYTES), math.ceil(math.sqrt(2 * tasks)))
        self.side = max(1, min(side, count))
        # Of each range that was counted: how many are below, and bins with how many distances, the least and the largest.
        self.counted: dict[tuple[float, float], tuple[int, list]] = {}
        self.shipped: dict[tuple[float, float], np.ndarray] = {}

    def spans(self) -> tuple[float, float]:
        """Bounds of all squared distances, from the range of each feature, or for sparse rows from the largest norm."""
        width = self.width

        def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"norm": [max(matrix(x, width).norms().max() for x in pdf["x"])]})

        if isinstance(width, SparseRows):
            norm = self.blocks.select("x").mapInPandas(norms, "norm double").agg(F.max("norm")).first()[0]
            return 0.0, 4.0 * norm * (1 + 1e-9)

        def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.concatenate(pdf["x"].to_list()).reshape(-1, width)
                yield pd.DataFrame({"at": np.arange(width, dtype="int32"), "low": x.min(0), "high": x.max(0)})

        rows = self.blocks.select("x").mapInPandas(ranges, "at int, low double, high double")
        rows = rows.groupBy("at").agg((F.max("high") - F.min("low")).alias("d")).collect()
        return 0.0, sum(r["d"] ** 2 for r in rows) * (1 + 1e-9)

    def each(self, schema: str, low: float, high: float, one, ended) -> DataFrame:
        """`one(shared, distances, all)` for each pair of blocks with distances from `low` to `high`, which get the distances
        in that range and the number below it; `ended(shared)` once per cell."""
        width, boxed = self.width, self.boxed

        def visit(a, b):
            if boxed:
                near, far = box_distances(a, b)
                if near * (1 - 1e-12) > high:
                    return
                if far * (1 + 1e-12) < low:
                    n = len(a.x) // width
                    one(a.shared, NOTHING, n * (n - 1) // 2 if a.at == b.at else n * (len(b.x) // width))
                    return
            d2 = sq_dists(a.matrix("x", width), b.matrix("x", width))
            d2 = d2[np.triu_indices(len(d2), 1)] if a.at == b.at else d2.ravel()
            one(a.shared, d2[(d2 >= low) & (d2 <= high)], int(np.count_nonzero(d2 < low)))

        def finish(a):
            if a.shared:
                yield ended(a.shared)
                a.shared.clear()

        side = (self.side, self.side)
        return tiled(self.blocks, self.blocks, side, 1, schema, visit, finish, upper=True)

    def bins(self, low: float, high: float) -> tuple[int, list]:
        if (low, high) in self.counted:
            return self.counted[low, high]
        scale = BINS / (high - low)

        def one(shared, d2, below):
            if not shared:
                shared |= {"below": 0, "n": np.zeros(BINS, np.int64), "low": np.full(BINS, np.inf), "high": np.full(BINS, -np.inf)}
            shared["below"] += below
            if not len(d2):
                return
            at = np.minimum(((d2 - low) * scale).astype(np.int64), BINS - 1)
            shared["n"] += np.bincount(at, minlength=BINS)
            np.minimum.at(shared["low"], at, d2)
            np.maximum.at(shared["high"], at, d2)

        def ended(shared):
            at = np.flatnonzero(shared["n"])
            found = pd.DataFrame({"bin": at.astype("int32"), **{c: shared[c][at] for c in ("n", "low", "high")}})
            under = pd.DataFrame({"bin": np.array([-1], "int32"), "n": [shared["below"]], "low": [low], "high": [low]})
            return pd.concat([under, found])

        rows = self.each("bin int, n long, low double, high double", low, high, one, ended)
        rows = rows.groupBy("bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        found = sorted(map(tuple, rows.collect()))
        self.counted[low, high] = sum(r[1] for r in found if r[0] < 0), [r for r in found if r[0] >= 0]
        return self.counted[low, high]

    def values(self, low: float, high: float) -> np.ndarray:
        """All distances of a range that has few, in order."""
        if (low, high) not in self.shipped:

            def one(shared, d2, below):
                if len(d2):
                    shared.setdefault("d2", []).append(d2)

            rows = self.each("d2 double", low, high, one, lambda shared: pd.DataFrame({"d2": np.concatenate(shared["d2"])}))
            self.shipped[low, high] = np.sort(rows.toArrow().column(0).to_numpy())
        return self.shipped[low, high]

    def order_statistic(self, rank: int) -> float:
        """The squared distance of that rank, from 0."""
        if self.start is not None:
            below, found = self.bins(*self.start)
            if below <= rank < below + sum(r[1] for r in found):
                return self.narrowed(rank, *self.start)
        return self.narrowed(rank, *self.spans())

    def narrowed(self, rank: int, low: float, high: float) -> float:
        """The squared distance of that rank among all, which is known to be within the bounds."""
        while low < high:
            below, found = self.bins(low, high)
            rest = rank - below
            for _, n, first, last in found:
                if rest < n:
                    break
                rest -= n
            if n <= SHIPPED:
                return float(self.values(first, last)[rest])
            low, high = first, last
        return low


NOTHING = np.zeros(0)


def sampled_width(df: DataFrame, pairs: int = 1_000_000, seed: int = 0, *, n: int | None = None, z: float = 3.29) -> DataFrame:
    """One row (gamma, low, high, pairs, exact): the median distance of pairs drawn with replacement, with bounds.

    A cheap width for tables whose pairs are too many; nothing uses it unless asked, and `exact` is false. A pair is two
    different positions, each drawn by a hash of its number; no other pairs are listed. `low` and `high` are order
    statistics of the draws, `z` deviations of a fair coin away from the middle: the exact median is between them with
    the probability of the normal law (0.999 at 3.29), whatever the distances are.
    """
    if "features" not in df.columns:
        raise ValueError("pairs are drawn from rows with features")
    rows = row_index(df, n=n) if "idx" not in df.columns else df
    n = df.count() if n is None else n
    if n < 2:
        raise ValueError("a pair needs two rows")
    spark = df.sparkSession
    parts = max(1, -(-pairs // DRAWS_PER_PARTITION))
    draw = spark.range(0, pairs, 1, parts).withColumnRenamed("id", "draw")
    first = F.floor(uniform("width-a", seed, "draw") * n)
    draw = draw.withColumn("i", first).withColumn("j", F.floor(uniform("width-b", seed, "draw") * (n - 1)))
    draw = draw.withColumn("j", F.col("j") + F.when(F.col("j") >= F.col("i"), 1).otherwise(0))
    side = lambda c, f: rows.select(F.col("idx").alias(c), F.col("features").alias(f))
    drawn = draw.join(side("i", "a"), "i").join(side("j", "b"), "j").select(F.sqrt(sq_distance("a", "b")).alias("d"))
    away = z * math.sqrt(pairs) / 2
    ranks = [max(0, math.floor((pairs - 1) / 2 - away)), min(pairs - 1, math.ceil((pairs - 1) / 2 + away))]
    at = [0.5, *[r / max(1, pairs - 1) for r in ranks]]
    cut = drawn.agg(F.percentile("d", F.array(*[F.lit(float(p)) for p in at])).alias("p"))
    names = [F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("gamma", "low", "high"))]
    return cut.select(*names, F.lit(pairs).cast("long").alias("pairs"), F.lit(False).alias("exact"))
