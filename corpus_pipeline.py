"""The corpus pipeline: toxic documents go, near-duplicates go, personal data is masked, sources are mixed, packed.

Every stage works on whole texts of all that its predecessor kept, is written as Parquet and read again, and shuffles
the texts at most twice. The mixture is an order: the fourth stage writes its rows in that order, and the last names
sequences by the place of their first row in those files.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import reweight
from reweight.llm import mixing, packing, pii, simhash, toxicity
from reweight.llm.common import reliable, tasks_for

# No SQL: hashing, tokens and the learnt models have none. The tests follow the stages by brute force.
ORACLE_SQL = None
# A file of the mixture has fewer rows than this, see `pack`.
FILE_ROWS = 1 << 26


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold, with all their columns."""
    reweight.attach(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of SimHash links. A document without an id stands behind all others
    of its class; rows that repeat an id count as one document."""
    reweight.attach(spark)
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    own = F.coalesce(F.col("doc_id").cast("long"), stand_in)
    rows = reliable(simhash.near_duplicates(docs.select(own.alias("doc_id"), "text")))
    stay = rows.where("doc_id = component_id").select(F.col("doc_id").alias("__own"))
    kept = docs.withColumn("__own", own).join(stay.distinct(), "__own", "left_semi")
    if stay.count() != stay.distinct().count():
        kept = kept.dropDuplicates(["__own"])
    return kept.select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans replaced by the name of their kind and the length counted anew."""
    reweight.attach(spark)
    model = pii.train(docs)
    rows = pii.find(docs.select(F.struct("*").alias("row"), "text"), model, "row")
    text = F.when(F.col("row.text").isNotNull(), pii.redacted(F.col("text"), F.col("spans")))
    rows = rows.select("row", text.alias("new"))
    new = {"text": F.col("new"), "n_chars": F.coalesce(F.length("new").cast("long"), F.col("row.n_chars"))}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture: files by number, rows inside a file."""
    reweight.attach(spark)
    rows = mixing.mix(docs, carry=True).select("turn", "start", "row")
    ordered = rows.repartitionByRange(tasks_for(docs), "turn", "start").sortWithinPartitions("turn", "start")
    return ordered.select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences; in the order of their names, sequences follow the rows of the files."""
    reweight.attach(spark)
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    try:
        docs = docs.withColumn("__rank", number * FILE_ROWS + F.col("_metadata.row_index"))
    except AnalysisException:  # rows that come from no file have no place to follow
        return packing.pack(docs)
    return packing.pack(docs, rank="__rank")


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = reliable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
