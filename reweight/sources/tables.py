"""Hand-off tables and reports."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.operators.split import Split


def write_split(split: Split, folder: str) -> None:
    """Train (with true_beta) and test as Parquet; later jobs read these instead of splitting again."""
    split.train.write.mode("overwrite").parquet(f"{folder}/train")
    split.test.write.mode("overwrite").parquet(f"{folder}/test")


def read_split(spark: SparkSession, folder: str) -> Split:
    train, test = spark.read.parquet(f"{folder}/train"), spark.read.parquet(f"{folder}/test")
    return Split(train, test, train.count(), test.count())


def append_report(df: DataFrame, folder: str, run: str | None = None) -> None:
    """Add rows of run statistics to a JSON report.

    With the key of a `run` its rows have a folder of their own, which a repeated append of the same run replaces: a job
    that is retried counts once. Read such a report with :func:`read_report`.
    """
    if run is None:
        df.write.mode("append").json(folder)
        return
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
        raise ValueError(f"a run is named by letters, digits, - and _: {run!r}")
    df.write.mode("overwrite").json(f"{folder.rstrip('/')}/run={run}")


def read_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all runs whose append was completed, with the key in `run`; what a failed append left is not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/run=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    done = sorted(str(f.getPath().getParent()) for f in found or [])
    if not done:
        return spark.createDataFrame([], f"{schema}, run string")
    rows = spark.read.schema(f"{schema}, run string").option("basePath", folder).json(done)
    return rows.withColumn("run", F.col("run").cast("string"))


def write_column(df: DataFrame, column: str, folder: str) -> bool:
    """One value per line, replacing what was there; writes nothing for an empty table."""
    if df.isEmpty():
        return False
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(folder)
    return True
