"""Materialised stage boundaries.

Operators read their input more than once (rows, block summaries), so a chain of them multiplies the
logical plan. ``stage`` writes an intermediate table to the shared checkpoint folder and reads it
back: the plan is cut, lost executors do not force a recompute from the source, and the parquet file
keeps column pruning and size statistics for the planner.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="panelflow-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
