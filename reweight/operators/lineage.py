"""Cutting lineage through reliable storage, and size-checked broadcasts."""

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is only hinted for broadcast when its computed size stays below this bound.
BROADCAST_BYTES = 32 * 1024 * 1024

# Iterations that run side by side: each is a row of small jobs, which leave most of a cluster idle.
SIDE_BY_SIDE = 8

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="reweight-")
    return _local[app]


def reliable(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back; survives the loss of executors.

    Unlike a checkpointed plan, which keeps the size estimate of the plan it replaces (a product over joins,
    so it explodes in a loop), the written table is planned with its real size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/reweight-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that :func:`reliable` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/reweight-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(size_bytes: float) -> bool:
    return size_bytes <= BROADCAST_BYTES


def broadcast_if(df: DataFrame, size_bytes: float) -> DataFrame:
    """Broadcast hint only under a proven size; otherwise the join stays a shuffle join."""
    return F.broadcast(df) if small_enough(size_bytes) else df


def task_count(df: DataFrame, units: int) -> int:
    """Partitions for `units` independent heavy pieces of work: enough to fill the cluster, no more."""
    spark = df.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return max(1, min(int(units), wide))


def at_once(spark: SparkSession, calls: list[Callable]) -> list:
    """The results of calls that start Spark jobs of their own, some of them side by side, in the order of the calls."""
    if len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(min(SIDE_BY_SIDE, len(calls))) as pool:
        return [one.result() for one in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]
