"""Nearest neighbours by cosine: p-stable hashing with multiprobe, exact scores inside the probed buckets."""

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reweight.llm.common import reliable

TABLES = 4
FUNCTIONS = 8
# Width of a hash cell, for vectors of length 1.
WIDTH = 2.5
PROBES = 160
NEAREST = 5
SEED = 23
# Index rows of one task that are held at a time, and rows of a bucket from which it is cut.
TASK_ROWS = 20_000
QUERY_BATCH = 512


@lru_cache(maxsize=16)
def hash_functions(dim: int):
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(TABLES, dim, FUNCTIONS)), rng.uniform(0, WIDTH, (TABLES, FUNCTIONS))


def cells(unit: np.ndarray):
    """Cell coordinates of unit vectors and the places inside the cells: (table, row, function)."""
    a, b = hash_functions(unit.shape[1])
    at = (np.einsum("nd,tdk->tnk", unit, a) + b[:, None, :]) / WIDTH
    low = np.floor(at)
    return low.astype(np.int64), at - low


def bucket_keys(cell: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One 64-bit number for a bucket; vectors of other lengths are in other buckets."""
    key = np.full(cell.shape[:-1], table * 1_000_003 + dim, np.uint64)
    for i in range(cell.shape[-1]):
        key = (key ^ cell[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def probe_sequence(inside: np.ndarray, probes: int) -> list[np.ndarray]:
    """Shifts of the cell, in the order of their estimated chance of success.

    Crossing to the cell below costs the squared distance to it, likewise above; sets of shifts come from a heap in
    the order of their total, each set leading to the two that follow it (last move replaced, or one more added).
    """
    k = len(inside)
    cost = np.concatenate([inside**2, (1 - inside) ** 2])
    order = np.argsort(cost)
    z = cost[order].tolist()
    where, sign = (order % k).tolist(), np.where(order < k, -1, 1).tolist()
    out = [np.zeros(k, np.int64)]
    heap = [(z[0], (0,))]
    while heap and len(out) < probes:
        total, moves = heapq.heappop(heap)
        if len({where[i] for i in moves}) == len(moves):
            shift = np.zeros(k, np.int64)
            for i in moves:
                shift[where[i]] = sign[i]
            out.append(shift)
        last = moves[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - z[last] + z[last + 1], moves[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + z[last + 1], moves + (last + 1,)))
    return out


def matrix(column) -> np.ndarray:
    """Binary vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def by_length(raw: list[bytes]):
    """Positions and matrix of the vectors of each length."""
    sizes = np.array([len(r) for r in raw])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, matrix([raw[i] for i in at])


def packed(batches):
    """(cid, embedding, ...) to (cid, vec, ...): doubles as bytes."""
    for batch in batches:
        vec = [np.asarray(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
        names = ["cid", "vec", *batch.schema.names[2:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary()), *batch.columns[2:]], names)


def indexed(batches):
    """(cid, vec, ids) to (bucket, cid, vec, ids), one row per table."""
    for batch in batches:
        raw = batch.column(1).to_pylist()
        for at, x in by_length(raw):
            cell, _ = cells(x / np.linalg.norm(x, axis=1, keepdims=True))
            own = batch.take(pa.array(at))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(cell[t], t, x.shape[1])), *own.columns], ["bucket", *own.schema.names])


def probing(parts: int, cut: dict):
    """(cid, vec) to (part, cid, vec, buckets): each task's share of a query's probes."""

    def run(batches):
        for batch in batches:
            cids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for at, x in by_length(raw):
                cell, inside = cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                for j, i in enumerate(at):
                    keys = [
                        bucket_keys(cell[t, j] + np.array(probe_sequence(inside[t, j], PROBES)), t, x.shape[1]) for t in range(TABLES)
                    ]
                    by_part: dict[int, list[int]] = {}
                    for key in np.concatenate(keys).tolist():
                        for part in parts_of(key, parts, cut):
                            by_part.setdefault(part, []).append(key)
                    out += [(p, cids[i], raw[i], k) for p, k in by_part.items()]
            cols = list(zip(*out)) if out else [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "cid", "vec", "buckets"])

    return run


def parts_of(key: int, parts: int, cut: dict) -> list[int]:
    """Tasks that hold rows of the bucket: one, or as many as it is cut into."""
    return sorted({(key + i) % parts for i in range(cut.get(key, 1))})


def placing(parts: int, cut: dict):
    """(bucket, cid, vec, ids) to (part, bucket, cid, vec, ids); rows of a cut bucket go to one of its tasks."""

    def run(batches):
        for batch in batches:
            part = [
                (key + (cid * 0x9E3779B1 >> 7) % cut[key]) % parts if key in cut else key % parts
                for key, cid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    return run


def best_of(query, row, score, cid_of, nearest):
    """Of pairs, the first `nearest` of each query by score; a pair met in several tables counts once."""
    order = np.lexsort((cid_of[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])
    query, row, score = query[new], row[new], score[new]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[place < nearest], row[place < nearest], score[place < nearest]


def searching(batches):
    """(part, kind, cid, vec, bucket, buckets, ids), index rows of a part before its queries, to (cid, vec_id, score).

    Inside a bucket all its vectors meet the queries that probe it in one matrix product; the nearest of those get
    their scores anew, pair by pair, so that equal vectors have equal scores.
    """
    want = NEAREST + 1

    def solve(queries, index, buckets):
        x, cids, ids, norm = index
        at_q, at_x, scores = [], [], []
        q = np.stack([v for _, v, _ in queries])
        qn = np.linalg.norm(q, axis=1)
        probing_of: dict[int, list[int]] = {}
        for j, (_, _, keys) in enumerate(queries):
            for key in buckets if keys is None else dict.fromkeys(keys):
                if key in buckets:
                    probing_of.setdefault(key, []).append(j)
        for key, js in probing_of.items():
            rows, js = buckets[key], np.array(js)
            s = (q[js] @ x[rows].T) / qn[js, None] / norm[rows][None, :]
            if len(rows) > want:
                top = np.argpartition(-s, want, axis=1)[:, : want + 1]
                at_q.append(np.repeat(js, top.shape[1]))
                at_x.append(rows[top].ravel())
                scores.append(np.take_along_axis(s, top, 1).ravel())
            else:
                at_q.append(np.repeat(js, len(rows)))
                at_x.append(np.tile(rows, len(js)))
                scores.append(s.ravel())
        if not at_q:
            return None
        a, b, _ = best_of(np.concatenate(at_q), np.concatenate(at_x), np.concatenate(scores), cids, want + 1)
        score = (q[a] * x[b]).sum(1) / (qn[a] * norm[b])
        out = [(queries[i][0], v, float(s)) for i, r, s in zip(a.tolist(), b.tolist(), score.tolist()) for v in ids[r]]
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["cid", "vec_id", "score"]
        )

    part, rows, waiting, groups = None, [], [], None

    def groups_of(rows):
        """Index rows by vector length: matrix, class ids, member ids, norms, and rows by bucket."""
        out = {}
        seen: dict[int, int] = {}
        for cid, vec, bucket, ids in rows:
            g = out.setdefault(len(vec), ([], [], [], {}))
            n = seen.setdefault(cid, len(g[0]))
            if n == len(g[0]):
                g[0].append(vec), g[1].append(cid), g[2].append(ids)
            g[3].setdefault(bucket, []).append(n)
        return {
            n: ((m := matrix(v), np.array(c), i, np.linalg.norm(m, axis=1)), {b: np.array(r) for b, r in by.items()})
            for n, (v, c, i, by) in out.items()
        }

    def flush():
        for n, (index, buckets) in (groups or {}).items():
            own = [(c, np.frombuffer(v, "<f8"), k) for c, v, k in waiting if len(v) == n]
            if own and (got := solve(own, index, buckets)):
                yield got

    for batch in batches:
        for p, kind, cid, vec, bucket, keys, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                yield from flush()
                part, rows, waiting, groups = p, [], [], None
            if kind == 0:
                rows.append((cid, vec, bucket, ids))
            else:
                groups = groups or groups_of(rows)
                waiting.append((cid, vec, keys))
                if len(waiting) >= QUERY_BATCH:
                    yield from flush()
                    waiting = []
    yield from flush()


def usable(rows: DataFrame) -> DataFrame:
    """Vectors without null or non-finite components that are not zero."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall("embedding", lambda v: v == 0)
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad & ~zero)


def nearest(vectors: DataFrame, queries: DataFrame, exhaustive: bool = False) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each query its five nearest found among all vectors but its own id.

    Both tables have `vec_id LONG, embedding ARRAY<FLOAT or DOUBLE>`; further columns are ignored. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors of another
    length than the query's are no candidates. Equal vectors are one class with its six least ids, which is all
    that a list of five can need, so copies cost nothing and ties go to the smaller id. Repeated rows of one id
    count once.

    Every vector is in the index, once per table. A task holds about TASK_ROWS of its rows; larger buckets are cut
    over several tasks. A query goes to a task once, with all buckets that it probes there. Queries that found too
    few are searched again in all buckets.
    """
    spark = vectors.sparkSession
    kind = "array<double>"
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")))
    rows = rows.where("vec_id IS NOT NULL").distinct()
    wanted = usable(queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast(kind).alias("embedding")))
    wanted = wanted.where("query_id IS NOT NULL").distinct()
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= NEAREST + 1)
    classes = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = classes.select(F.element_at("ids", 1).alias("cid"), "embedding", "ids")
    classes = reliable(classes.mapInArrow(packed, "cid long, vec binary, ids array<long>"))
    asked = wanted.groupBy("embedding").agg(F.min("query_id").alias("cid"))

    index = classes.mapInArrow(indexed, "bucket long, cid long, vec binary, ids array<long>")
    total = classes.count()
    parts = max(1, -(-total * TABLES // TASK_ROWS))
    sizes = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_ROWS).collect()
    cut = {r["bucket"]: -(-r["n"] // TASK_ROWS) for r in sizes}  # at most total * TABLES / TASK_ROWS entries

    placed = index.mapInArrow(placing(parts, cut), "part int, bucket long, cid long, vec binary, ids array<long>")
    placed = placed.select("part", F.lit(0).alias("kind"), "cid", "vec", "bucket", F.lit(None).cast("array<long>").alias("buckets"), "ids")
    ask = asked.select("cid", "embedding").mapInArrow(packed, "cid long, vec binary")

    def search(ask, everywhere):
        if everywhere:
            probes = ask.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cid", "vec", F.lit(None).cast("array<long>").alias("buckets"))
        else:
            probes = ask.mapInArrow(probing(parts, cut), "part int, cid long, vec binary, buckets array<long>")
        probes = probes.select("part", F.lit(1).alias("kind"), "cid", "vec", F.lit(0).cast("long").alias("bucket"), "buckets", F.array().cast("array<long>").alias("ids"))
        both = placed.unionByName(probes).repartition(parts, "part").sortWithinPartitions("part", "kind", "cid")
        found = both.mapInArrow(searching, "cid long, vec_id long, score double")
        return found.groupBy("cid", "vec_id").agg(F.max("score").alias("score"))

    def ranked(found):
        order = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= NEAREST + 1)
        lists = best.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
        own = wanted.join(asked, "embedding").select("query_id", "cid").join(lists, "cid", "left")
        near = F.slice(F.filter(F.coalesce("near", F.array().cast("array<struct<s:double,vec_id:bigint>>")), lambda x: x["vec_id"] != F.col("query_id")), 1, NEAREST)
        return own.select("query_id", "cid", near.alias("near"))

    # Read twice below, and what it took to find should not be done again for that.
    first = reliable(ranked(search(ask, exhaustive)))
    if not exhaustive:
        lacking = first.where(F.size("near") < NEAREST).select("cid").distinct()
        again = ask.join(lacking, "cid", "left_semi")
        if total <= NEAREST * 4 or not lacking.isEmpty():
            more = ranked(search(again, True)).where(F.size("near") > 0)
            first = first.join(lacking, "cid", "left_anti").unionByName(more.join(lacking, "cid", "left_semi"))
    out = first.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
