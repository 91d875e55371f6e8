import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import reweight  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    reweight.attach(session)
    return session


@pytest.fixture(scope="session")
def points(spark):
    """Make a (row_id, features) table from an array."""

    def make(x, start=0, parts=3):
        x = np.asarray(x, dtype=float)
        rows = [(i + start, [float(v) for v in r]) for i, r in enumerate(x)]
        return spark.createDataFrame(rows, "row_id long, features array<double>").repartition(parts)

    return make
