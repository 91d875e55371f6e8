"""Sharding through fixed virtual slots and a versioned slot-to-shard map."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reweight.llm.common import empty_text, reliable

SLOTS = 4096
CHUNKS = 16


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`doc_id, size, text_crc32, vslot, chunk`: UTF-8 bytes plus 1, checksum, and the record's fixed slot."""
    text = empty_text()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    h = F.xxhash64("doc_id", "size", "text_crc32")
    return rows.select("*", F.pmod(h, F.lit(slots)).cast("int").alias("vslot"), F.pmod(F.xxhash64(h), F.lit(CHUNKS)).cast("int").alias("chunk"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slot v belongs to shard v mod shards, whatever the data."""
    v = F.col("id").cast("int")
    return spark.range(slots).select(v.alias("vslot"), F.pmod(v, F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for `shards` shards; only slots beyond a shard's fair share move.

    A shard keeps its largest slots up to total / shards bytes; the others form a pool that goes, largest first,
    to whichever shard holds least. The pool is an array of at most one entry per slot, so its fold is bounded by
    the slot count and not by the data. Works for bulk loads (few moves), more shards and fewer shards alike.
    """
    known = slot_map.join(slot_bytes.select("vslot", F.col("bytes")), "vslot", "left").fillna(0, ["bytes"])
    fair = known.agg(F.ceil(F.sum("bytes") / shards)).first()[0]
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    cut = known.withColumn("held", held).withColumn("stays", (F.col("held") <= F.lit(fair)) & (F.col("shard") < shards))
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate("slots", F.lit(0).cast("long"), lambda a, x: a + F.when(x["stays"] & (x["shard"] == s), x["bytes"]).otherwise(F.lit(0))),
    )
    pool = F.array_sort(
        F.transform(F.filter("slots", lambda x: ~x["stays"]), lambda x: F.struct((-x["bytes"]).alias("less"), x["vslot"].alias("vslot")))
    )
    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("moved"))

    def give(acc, x):
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda v, i: v + F.when(i == least, -x["less"]).otherwise(F.lit(0))).alias("loads"),
            F.concat(acc["moved"], F.array(F.struct(x["vslot"].alias("vslot"), least.alias("shard")))).alias("moved"),
        )

    one = cut.agg(
        F.collect_list(F.struct("vslot", "shard", "bytes", "stays")).alias("slots"), F.max("version").alias("version")
    )
    one = one.select("*", loads.alias("loads"), pool.alias("pool"))
    one = one.select("*", F.aggregate("pool", start, give)["moved"].alias("moved"))
    kept = F.transform(F.filter("slots", lambda x: x["stays"]), lambda x: F.struct(x["vslot"].alias("vslot"), x["shard"].alias("shard")))
    rows = one.select(F.explode(F.concat(kept, "moved")).alias("m"), (F.col("version") + 1).alias("version"))
    return rows.select("m.vslot", "m.shard", "version")


def write_map(slot_map: DataFrame, folder: str) -> None:
    """Store a version beside the earlier ones; readers pick a version, so a rebalance never edits in place."""
    slot_map.write.mode("append").partitionBy("version").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The named version of a stored map, or the newest."""
    df = spark.read.parquet(folder)
    version = df.agg(F.max("version")).first()[0] if version is None else version
    return df.where(F.col("version") == version).select("vslot", "shard", "version")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, slot_map: DataFrame | None = None) -> DataFrame:
    """One row per document: its fixed slot, shard and gapless place in the shard, shard sizes near equal in bytes.

    `docs` needs `doc_id, text`; further columns are ignored, whatever their names. A null text counts one byte,
    a null doc_id is hashed like any other value, repeated rows each get a row, an empty table gives no rows. A
    slot is a hash of id and text, so copies of one text spread over all slots. Places come from counts per
    (slot, chunk): a window never spans more than one chunk of a slot, and the counts number slots x CHUNKS.

    Pass the stored `slot_map` to place new rows by it; otherwise version 0 is balanced by the bytes of `docs`.
    """
    rows = reliable(measured(docs, slots))
    if slot_map is None:
        sizes = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
        slot_map = rebalanced(first_map(docs.sparkSession, shards, slots), sizes, shards)
    counts = rows.groupBy("vslot", "chunk").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(slot_map), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("vslot", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("place", place).join(F.broadcast(counts.drop("n")), ["vslot", "chunk"])
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "vslot", "version"
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = shard(docs)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version"
    )
