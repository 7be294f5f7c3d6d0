"""Returns, scaling, differencing and path reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.operators.blocks import DEFAULT_WIDTH, attach_series, lagged, running_sum
from panelflow.operators.quantiles import exact_quantiles

KEYS = ("series_id", "ts")


def log_returns(panel: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """ln(P_t / P_{t-1}) by row order; the first row of a series is removed, P <= 0 gives null."""
    rows = lagged(panel, [1], width)
    ok = (F.col("value") > 0) & (F.col("lag_1") > 0)
    return rows.filter(F.col("pos") > 1).select(
        *KEYS, F.when(ok, F.log(F.col("value")) - F.log(F.col("lag_1"))).alias("value")
    )


def scale_stats(panel: DataFrame, method: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Per-series centre and spread of a scaling method (keep them to undo the scaling)."""
    grouped = panel.groupBy("series_id")
    if method == "standardize":
        return grouped.agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("spread"))
    if method == "minmax":
        return grouped.agg(F.min("value").alias("center"), (F.max("value") - F.min("value")).alias("spread"))
    if method == "robust":
        q = exact_quantiles(panel, [0.25, 0.5, 0.75], width)
        return q.select("series_id", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("spread"))
    raise ValueError(f"unknown scaling method {method!r}")


def scale(
    panel: DataFrame, method: str = "standardize", convert_to_returns: bool = False, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Scale each series; a series without spread becomes null."""
    base = log_returns(panel, width) if convert_to_returns else panel
    rows = attach_series(base, scale_stats(base, method, width), width)
    z = (F.col("value") - F.col("center")) / F.col("spread")
    return rows.select(*KEYS, F.when(F.col("spread") > 0, z).alias("value"))


def scale_for_garch(
    panel: DataFrame, target_std: float = 1.0, center: bool = True, width: int = DEFAULT_WIDTH, method: str = "standardize"
) -> DataFrame:
    """Row-preserving rescale before volatility models; ``shift`` and ``factor`` undo it. ``method`` as in ``scale``."""
    rows = attach_series(panel, scale_stats(panel, method, width), width)
    shift = F.col("center") if center else F.lit(0.0)
    factor = F.when(F.col("spread") > 0, F.lit(target_std) / F.col("spread"))
    return rows.select(*KEYS, ((F.col("value") - shift) * factor).alias("value"), shift.alias("shift"), factor.alias("factor"))


def stationarize(panel: DataFrame, method: str = "difference", enabled: bool = True, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``difference``, ``log`` or ``percentage_change``; rows without a result are dropped."""
    if not enabled:
        return panel
    if method == "log":
        out = panel.select(*KEYS, F.when(F.col("value") > 0, F.log("value")).alias("value"))
        return out
    rows = lagged(panel, [1], width).filter(F.col("pos") > 1)
    if method == "difference":
        value: Column = F.col("value") - F.col("lag_1")
    elif method == "percentage_change":
        value = F.try_divide(F.col("value"), F.col("lag_1")) - 1
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.select(*KEYS, value.alias("value"))


def difference(panel: DataFrame, d: int = 1, width: int = DEFAULT_WIDTH) -> DataFrame:
    """d-th difference from one pass over d lags with binomial weights; drops the first d rows."""
    if d == 0:
        return panel.select(*KEYS, "value")
    rows = lagged(panel, list(range(1, d + 1)), width).filter(F.col("pos") > d)
    value, weight = F.col("value"), 1
    for k in range(1, d + 1):
        weight = -weight * (d - k + 1) // k
        value = value + F.lit(float(weight)) * F.col(f"lag_{k}")
    return rows.select(*KEYS, value.alias("value"))


def cumulative_path(increments: DataFrame, anchors: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Level = anchor + running sum of increments, with the first level equal to the anchor.

    ``anchors(series_id, anchor)`` has one row per series.
    """
    summed = running_sum(increments, width, out="_run", reset_first=True)
    rows = attach_series(summed, anchors.select("series_id", "anchor"), width)
    return rows.select(*KEYS, (F.col("anchor") + F.col("_run")).alias("value"))


def undifference(diffs: DataFrame, start: DataFrame, width: int = DEFAULT_WIDTH, d: int = 1) -> DataFrame:
    """Inverse of a difference of order ``d``.

    ``start`` holds what came before the first row: the value as ``anchor``, or for ``d`` above 1 the value
    and its differences of order 1 to ``d - 1`` as an array ``anchors``.
    """
    anchors = F.col("anchors") if "anchors" in start.columns else F.array("anchor")
    out = diffs
    for order in range(d - 1, -1, -1):
        rows = attach_series(running_sum(out, width, out="_run"), start.select("series_id", anchors[order].alias("_a")), width)
        out = rows.select(*KEYS, (F.col("_a") + F.col("_run")).alias("value"))
    return out


def explode_forecast(df: DataFrame, col: str = "forecast") -> DataFrame:
    """Scalar or array forecast -> one row per step (1-based)."""
    is_array = df.schema[col].dataType.typeName() == "array"
    values = F.col(col) if is_array else F.array(F.col(col))
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(values).alias("_i", "value")).select(
        *rest, (F.col("_i") + 1).alias("step"), F.col("value").cast("double").alias("value")
    )


def collect_forecast(df: DataFrame, by: str = "series_id") -> DataFrame:
    """One row per step -> ordered array (its length is the forecast horizon)."""
    packed = F.array_sort(F.collect_list(F.struct("step", "value")))
    return df.groupBy(by).agg(packed.alias("_p")).select(by, F.col("_p.value").alias("forecast"))


def mean_component(panel: DataFrame, residuals: DataFrame) -> DataFrame:
    """Conditional mean = value - residual, aligned on series and time."""
    r = residuals.select(*KEYS, F.col("value").alias("residual"))
    return panel.join(r, list(KEYS)).select(*KEYS, (F.col("value") - F.col("residual")).alias("value"))
