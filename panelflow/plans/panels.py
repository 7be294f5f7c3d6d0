"""Panels and bars derived from the given tables.

Averages are taken over whole cents (integers), so a panel is the same to the last bit whatever the
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators.blocks import DAY
from panelflow.operators.fill import align_outer, complete_dates, drop_incomplete, fill
from panelflow.operators.transform import log_returns
from panelflow.plans.staging import stage
from panelflow.sources.bars import resample_bars

# Block widths that suit the frequency of each panel.
MONTHLY, DAILY, HOURLY = 1461 * DAY, 256 * DAY, 7 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean_cents(col: str) -> Column:
    cents = F.sum(F.round(F.col(col) * 100).cast("long"))
    return (cents.cast("double") / (F.count(F.lit(1)) * 100)).alias("value")


def _panel(df: DataFrame, series: Column, unit: str, ts: str, value: str) -> DataFrame:
    return df.groupBy(series.alias("series_id"), F.date_trunc(unit, ts).alias("ts")).agg(_mean_cents(value))


def orders_panel(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """Five priorities; average order value per month or day."""
    return _panel(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), unit, "o_orderdate", "o_totalprice")


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: all orders per month."""
    return _panel(table(spark, sf_dir, "orders"), F.lit("all"), "month", "o_orderdate", "o_totalprice")


def status_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series: line status per month."""
    return _panel(table(spark, sf_dir, "lineitem"), F.col("l_linestatus"), "month", "l_shipdate", "l_extendedprice")


def supplier_panel(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """Many series: suppliers per month, or short ones: suppliers per year."""
    items = table(spark, sf_dir, "lineitem")
    return _panel(items, F.col("l_suppkey").cast("string"), unit, "l_shipdate", "l_extendedprice")


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 nations per month, for pair operators."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    homes = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    joined = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    return _panel(joined, F.col("n_name"), "month", "o_orderdate", "o_totalprice")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five event types; average value per hour."""
    return _panel(table(spark, sf_dir, "events"), F.col("event_type"), "hour", "ts", "value")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")


def event_bars(spark: SparkSession, sf_dir: str, every: str = "1d") -> DataFrame:
    return resample_bars(ticks(spark, sf_dir), every, tie="event_id")


def orders_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete monthly log returns of the five priorities, written once."""
    panel = stage(orders_panel(spark, sf_dir), "orders")
    return stage(log_returns(complete_dates(panel), MONTHLY), "returns")


def nation_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stage(nation_panel(spark, sf_dir), "nations")
    return stage(log_returns(complete_dates(panel), MONTHLY), "returns")


def status_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stage(status_panel(spark, sf_dir), "status")
    return stage(log_returns(complete_dates(panel), MONTHLY), "returns")


def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event panel aligned and filled forward, then without the leading hours that stay null."""
    panel = stage(events_panel(spark, sf_dir), "events")
    return drop_incomplete(stage(fill(align_outer(panel, HOURLY), "ffill", HOURLY), "filled"))


def event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(log_returns(event_levels(spark, sf_dir), HOURLY), "returns")
