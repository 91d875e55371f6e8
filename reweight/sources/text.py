"""ARFF and sparse text files as feature tables.

A row's id is built from where the row sits: rank of its file, byte offset of its scan split, and its place
inside that split. It is unique and increases in file order, without a shuffle or a sort.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.functions.vectors import densify
from reweight.operators.index import row_index
from reweight.operators.lineage import broadcast_if
from reweight.operators.select import first_n

# A line number inside a task takes the low 33 bits of the generated id; files get 2**41 ids each, two for each
# byte. More files or larger ones than that leaves room for are refused.
TASK_BITS = 33
FILE_BITS = 41
MAX_FILES = 1 << (63 - FILE_BITS)
# Bytes of a row that names a file, at most.
FILE_ROW_BYTES = 1024


def one_slash(path: Column) -> Column:
    """The two ways Spark reports a path differ in the slashes after the scheme."""
    return F.regexp_replace(path, ":/+", ":/")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, file, line): lines of a text file or folder in file order."""
    text = spark.read.text(path).select(
        F.col("value").alias("line"),
        one_slash(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Every line before this one takes a byte, so the next split's ids start above this split's.
    place = 2 * F.col("start") + F.col("at").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    files = sorted(text.select("line").inputFiles())
    if len(files) > MAX_FILES:
        raise ValueError(f"{len(files)} files are more than the {MAX_FILES} that line ids have room for")
    too_large = F.col("size") >= F.lit(1 << (FILE_BITS - 1))
    place = F.when(too_large, F.raise_error(F.concat(F.lit("too large for line ids: "), "file")).cast("long")).otherwise(place)
    if len(files) < 2:
        return text.select(place.alias("row_id"), "file", "line")
    ranks = spark.createDataFrame([(f, i << FILE_BITS) for i, f in enumerate(files)], "file string, base long")
    ranks = ranks.withColumn("file", one_slash(F.col("file")))
    ranks = broadcast_if(ranks, FILE_ROW_BYTES * len(files))
    return text.join(ranks, "file").select((F.col("base") + place).alias("row_id"), "file", "line")


def read_arff(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(row_id, features, label): numeric rows after the ``@data`` line; the last column is the label."""
    lines = read_lines(spark, path)
    marks = lines.where(F.lower("line").contains("@data")).groupBy("file").agg(F.min("row_id").alias("mark"))
    marks = broadcast_if(marks, FILE_ROW_BYTES * len(spark.read.text(path).inputFiles()))
    body = lines.join(marks, "file").where(F.col("row_id") > F.col("mark"))
    items = F.split(F.trim("line"), ",")
    rows = body.where(F.trim("line") != "").select("row_id", items.alias("items"))
    numbers = F.transform(F.slice("items", 1, F.size("items") - 1), lambda v: F.trim(v).cast("double"))
    res = rows.select("row_id", numbers.alias("features"), F.element_at("items", -1).alias("label"))
    return res if size is None else first_n(res, size)


def read_sparse(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(row_id, entries MAP<INT,DOUBLE>, label) from ``label i:v i:v``; indexes become 0-based."""
    lines = read_lines(spark, path).where(F.trim("line") != "")
    rows = lines.select("row_id", F.split(F.trim("line"), " ").alias("items"))
    pairs = F.transform(F.slice("items", 2, F.size("items")), lambda v: F.split(v, ":"))
    entries = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct((p[0].cast("int") - 1).alias("i"), p[1].cast("double").alias("v")))
    )
    res = rows.select("row_id", entries.alias("entries"), F.element_at("items", 1).alias("label"))
    return res if size is None else first_n(res, size)


def sparse_width(df: DataFrame) -> DataFrame:
    """One row (width): largest 0-based index + 1."""
    return df.agg((F.max(F.array_max(F.map_keys("entries"))) + 1).alias("width"))


def to_dense(df: DataFrame, width: int | None = None) -> DataFrame:
    """Replace `entries` by zero-filled `features`."""
    width = sparse_width(df).first()["width"] if width is None else width
    return df.withColumn("features", densify("entries", width)).drop("entries")


def encode_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Add `label_code` 0.0, 1.0, ... in the order in which labels first appear; a null label has none.

    The codes are counted first and broadcast while they are small, so that a label which most rows have is no
    hot key.
    """
    seen = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min("row_id").alias("first"))
    count, text = seen.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(label).cast("string")))).first()
    codes = row_index(seen, "first", out="code", n=count).select(label, F.col("code").cast("double").alias("label_code"))
    return df.join(broadcast_if(codes, (text or 0) + 64 * count), label, "left")


def project_features(df: DataFrame, row_id: str, columns: list) -> DataFrame:
    """(row_id, features): chosen columns as one vector; the scan reads only those."""
    return df.select(F.col(row_id).cast("long").alias("row_id"), F.array(*[F.expr(c).cast("double") for c in columns]).alias("features"))
