"""Stage snapshots and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
    ]
)
RESULT_COLUMNS = (
    "series_id",
    "result_type",
    "is_stationary",
    "adf_statistic",
    "p_value",
    "model_summary",
    "forecast",
    "interpretation",
)


def write_stage(df: DataFrame, root: str, run_id: str, step: int, name: str, fmt: str | None = None) -> DataFrame:
    """Write a numbered snapshot and return the input, so calls chain.

    Flat tables go to csv and tables with nested columns to json unless ``fmt`` says otherwise. An
    existing snapshot is never overwritten.
    """
    nested = any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema.fields)
    fmt = fmt or ("json" if nested else "csv")
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(f"{root}/{run_id}/{step:03d}--{name}.{fmt}")
    return df


def write_run(spark: SparkSession, root: str, run_id: str, name: str, status: str, **info: str) -> None:
    """Append one status event to the run log."""
    if status not in ("running", "completed", "failed"):
        raise ValueError(f"unknown status {status!r}")
    row = (run_id, name, status, info.get("source_type"), info.get("start_date"), info.get("end_date"), None)
    event = spark.createDataFrame([row], RUN_SCHEMA).withColumn("event_ts", F.current_timestamp())
    event.write.mode("append").partitionBy("run_id").parquet(f"{root}/runs")


def write_results(results: DataFrame, root: str, run_id: str) -> None:
    """Append per-series result rows of one run."""
    rows = results.select(*RESULT_COLUMNS).withColumn("run_id", F.lit(run_id))
    rows.write.mode("append").partitionBy("run_id").parquet(f"{root}/results")


def result_rows(df: DataFrame, result_type: str, **columns: str) -> DataFrame:
    """Shape any per-series table into result rows; ``columns`` maps result column -> source column."""
    kinds = {"is_stationary": "boolean", "adf_statistic": "double", "p_value": "double"}
    cols = []
    for c in RESULT_COLUMNS:
        if c == "series_id":
            cols.append(F.col("series_id"))
        elif c == "result_type":
            cols.append(F.lit(result_type).alias(c))
        else:
            source = F.col(columns[c]) if c in columns else F.lit(None)
            cols.append(source.cast(kinds.get(c, "string")).alias(c))
    return df.select(*cols)


def run_status(events: DataFrame) -> DataFrame:
    """Latest status and start/end time of every run."""
    finished = F.col("status").isin("completed", "failed")
    return events.groupBy("run_id").agg(
        F.max_by("status", "event_ts").alias("status"),
        F.min("event_ts").alias("start_time"),
        F.max(F.when(finished, F.col("event_ts"))).alias("end_time"),
        F.count(F.lit(1)).alias("n_events"),
    )
