"""Session settings the operators expect."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "panelflow", **extra: str) -> SparkSession:
    """Create a session. On a cluster leave ``master`` unset and let spark-submit choose it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets its own bound. Rows may hold long
#: texts or whole blocks of values, so Spark's 64 MB are too much for small executors.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application (as ``--py-files`` would), and bound Arrow batches."""
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="panelflow-ship-")) / "panelflow.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"panelflow/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
