"""Covariate-shift re-weighting on Spark DataFrames.

Train and test tables go in as ``row_id LONG, features ARRAY<DOUBLE>``; one importance weight per
training row comes out as ``row_id LONG, beta DOUBLE``.
"""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_attached: set[str] = set()


def attach(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once per application; not needed where it is installed."""
    sc = spark.sparkContext
    if sc.applicationId in _attached:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="reweight-package-")) / "reweight.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("reweight") / path.relative_to(root))
    sc.addPyFile(str(target))
    _attached.add(sc.applicationId)
