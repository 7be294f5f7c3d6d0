"""Calendar alignment and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.operators.blocks import DEFAULT_WIDTH, block_id, neighbours, with_block
from panelflow.sources.bars import expand_range

#: Parts of the dates of a time block.
PARTS = 8
STRATEGIES = ("drop", "forward_fill", "ffill", "backward_fill", "bfill", "interpolate")


def cell_grid(panel: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Every series paired with every date of the panel (the cells of the wide table).

    Dates are dealt into a few parts of each time block and paired with the series by an equi-join on
    block and part, so the grid is built in parallel, never by a cross join, and no row holds all dates.
    """
    dates = panel.select(block_id(width).alias("blk"), _part(F.col("ts")).alias("part"), "ts").distinct()
    series = panel.select("series_id").distinct()
    span = panel.agg(F.struct(F.min(block_id(width)), F.max(block_id(width))).alias("s"))
    bounds = span.scalar()
    slots = series.withColumn("blk", F.explode(F.sequence(bounds.getField("col1"), bounds.getField("col2"))))
    slots = slots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return slots.join(dates, ["blk", "part"]).select("series_id", "ts")


def _part(ts: Column) -> Column:
    return F.pmod(F.xxhash64(ts), F.lit(PARTS).cast("long"))


def align_outer(panel: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Full outer alignment: missing cells become explicit null rows."""
    return cell_grid(panel, width).join(panel, ["series_id", "ts"], "left").select("series_id", "ts", "value")


def regularize(panel: DataFrame, step: str = "day", width: int = DEFAULT_WIDTH) -> DataFrame:
    """The rows of each series on a regular grid that starts at its first row; missing steps are null rows.

    The grid keeps the time of day of the first row. Rows beside the grid are left out (``off_grid``).
    """
    return _grid(panel, step, width).join(panel, ["series_id", "ts"], "left").select("series_id", "ts", "value")


def off_grid(panel: DataFrame, step: str = "day", width: int = DEFAULT_WIDTH) -> DataFrame:
    """The rows that ``regularize`` leaves out."""
    return panel.join(_grid(panel, step, width), ["series_id", "ts"], "left_anti").select("series_id", "ts", "value")


def _grid(panel: DataFrame, step: str, width: int) -> DataFrame:
    ranges = panel.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return expand_range(ranges, step, width)


def drop_incomplete(panel: DataFrame) -> DataFrame:
    """Drop every date on which some series is null. Missing rows count only after ``align_outer``."""
    bad = panel.groupBy("ts").agg(F.bool_or(F.col("value").isNull()).alias("_bad")).filter("_bad")
    return panel.join(bad, "ts", "left_anti").select("series_id", "ts", "value")


def complete_dates(panel: DataFrame) -> DataFrame:
    """Keep the dates on which every series of the panel has a value.

    Same rows as ``drop_incomplete(align_outer(panel))``, from counts per date instead of the full grid.
    """
    n_series = panel.select("series_id").distinct().agg(F.count(F.lit(1))).scalar()
    full = panel.groupBy("ts").agg(F.count("value").alias("_c")).filter(F.col("_c") == n_series)
    return panel.join(full, "ts", "left_semi").select("series_id", "ts", "value")


def fill(panel: DataFrame, strategy: str = "drop", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Fill gaps. Unknown strategies fall back to ``drop``.

    ``interpolate`` is linear in row position; leading nulls stay and trailing nulls repeat the last value.
    """
    if strategy not in STRATEGIES or strategy == "drop":
        return drop_incomplete(panel)
    near = neighbours(panel, width)
    if strategy in ("forward_fill", "ffill"):
        value = F.col("prev")
    elif strategy in ("backward_fill", "bfill"):
        value = F.col("next")
    else:
        step = (F.col("pos") - F.col("prev_pos")) / (F.col("next_pos") - F.col("prev_pos"))
        between = F.col("prev") + (F.col("next") - F.col("prev")) * step
        value = (
            F.when(F.col("value").isNotNull(), F.col("value"))
            .when(F.col("prev").isNull(), F.lit(None))
            .when(F.col("next").isNull(), F.col("prev"))
            .otherwise(between)
        )
    return near.select("series_id", "ts", value.alias("value"))


def missing_report(panel: DataFrame) -> DataFrame:
    """Nulls, observations, completeness and first/last date per series."""
    return panel.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.count_if(F.col("value").isNull()).alias("missing_values"),
        (1 - F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("completeness"),
        F.min("ts").alias("first_date"),
        F.max("ts").alias("last_date"),
    )


def panel_report(panel: DataFrame) -> DataFrame:
    """The same report for the whole panel."""
    return panel.agg(
        F.count(F.lit(1)).alias("total_cells"),
        F.count_if(F.col("value").isNull()).alias("missing_values"),
        (1 - F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("completeness"),
        F.min("ts").alias("first_date"),
        F.max("ts").alias("last_date"),
    )


def require_min_obs(panel: DataFrame, n: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Keep the series that have at least ``n`` non-null rows."""
    return only(panel, panel.groupBy("series_id").agg(F.count("value").alias("_n")).filter(F.col("_n") >= n), width)


def only(panel: DataFrame, ids: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The rows of the series in ``ids``, joined per series and block so that a long series is spread."""
    rows = with_block(panel, width)
    keep = rows.select("series_id", "blk").distinct().join(ids.select("series_id"), "series_id", "left_semi")
    return rows.join(keep, ["series_id", "blk"], "left_semi").drop("blk")


def order_limits(panel: DataFrame, max_lag: int = 5, p: int = 2, q: int = 4, var_lags: int = 5, full_from: int = 30) -> DataFrame:
    """Per series: enough rows for the causality test, and model orders of at most 1 under ``full_from`` rows."""
    n = F.col("n_obs")
    short = n < full_from
    return (
        panel.groupBy("series_id")
        .agg(F.count("value").alias("n_obs"))
        .select(
            "series_id",
            "n_obs",
            (n >= 3 * max_lag).alias("granger_ok"),
            F.when(short, F.least(F.lit(p), F.lit(1))).otherwise(p).alias("arima_p"),
            F.when(short, F.least(F.lit(q), F.lit(1))).otherwise(q).alias("arima_q"),
            F.greatest(F.lit(1), F.least(F.lit(var_lags), F.floor(n / 3).cast("int"))).alias("var_max_lag"),
        )
    )


def filter_range(panel: DataFrame, start: str | None = None, end: str | None = None, symbols=None) -> DataFrame:
    from panelflow.sources.bars import in_range

    out = panel.filter(in_range(start, end))
    return out.filter(F.col("series_id").isin(list(symbols))) if symbols is not None else out
