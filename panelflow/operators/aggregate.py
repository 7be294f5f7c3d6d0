"""Per-series statistics and label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.scalar import unbiased_kurtosis, unbiased_skew
from panelflow.operators.blocks import DEFAULT_WIDTH, lagged
from panelflow.operators.quantiles import exact_quantiles

PERIODS_PER_YEAR = 252


def _moment_aggs(col: str = "value") -> list[Column]:
    n = F.count(col)
    flat = F.min(col) == F.max(col)
    return [
        n.alias("n"),
        F.avg(col).alias("mean"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.when(n > 1, F.stddev_samp(col)).alias("std"),
        F.when(~flat, unbiased_skew(F.skewness(col), n)).alias("skew"),
        F.when(~flat, unbiased_kurtosis(F.kurtosis(col), n)).alias("kurt"),
    ]


def series_stats(
    panel: DataFrame, periods: int = PERIODS_PER_YEAR, exact_median: bool = True, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """n, mean, median, min, max, std, bias-corrected skew and excess kurtosis, annualised volatility."""
    stats = panel.groupBy("series_id").agg(*_moment_aggs())
    stats = stats.withColumn("annualized_vol", F.col("std") * F.sqrt(F.lit(periods)))
    if not exact_median:
        return stats
    median = exact_quantiles(panel, [0.5], width).select("series_id", F.col("q")[0].alias("median"))
    return stats.join(median, "series_id", "left")


def autocorr(panel: DataFrame, lag: int = 1, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Pearson correlation of x_t and x_{t-lag}; 0 for a series of one row or fewer."""
    rows = lagged(panel, [lag], width)
    return rows.groupBy("series_id").agg(
        F.count("value").alias("n"),
        F.when(F.count("value") <= 1, F.lit(0.0)).otherwise(F.corr("value", f"lag_{lag}")).alias("autocorr"),
    )


def residual_stats(residuals: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Moments and lag-1 autocorrelation in the same aggregation."""
    rows = lagged(residuals, [1], width)
    return rows.groupBy("series_id").agg(
        *_moment_aggs(),
        F.var_samp("value").alias("variance"),
        F.when(F.count("value") <= 1, F.lit(0.0)).otherwise(F.corr("value", "lag_1")).alias("autocorr_lag1"),
    )


def error_metrics(residuals: DataFrame) -> DataFrame:
    x = F.col("value")
    return residuals.filter(x.isNotNull() & ~F.isnan(x)).groupBy("series_id").agg(
        F.avg(F.abs(x)).alias("mae"), F.sqrt(F.avg(x * x)).alias("rmse"), F.avg(x).alias("mean_error")
    )


def forecast_stats(forecast: DataFrame) -> DataFrame:
    """Summary of ``forecast(series_id, step, value)``: population std, first/last, change, variation."""
    first, last = F.min_by("value", "step"), F.max_by("value", "step")
    mean, std = F.avg("value"), F.stddev_pop("value")
    return forecast.groupBy("series_id").agg(
        mean.alias("mean"),
        std.alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        first.alias("first"),
        last.alias("last"),
        F.when(first == 0, F.lit(0.0)).otherwise(F.try_divide(last - first, first)).alias("change"),
        F.when(F.abs(mean) > 1e-6, F.try_divide(std, F.abs(mean))).otherwise(F.lit(0.0)).alias("cv"),
    )


def corr_bucket(rho: Column) -> Column:
    return F.when(F.abs(rho) > 0.7, "high").when(F.abs(rho) > 0.3, "moderate").otherwise("low")


def corr_buckets(pairs: DataFrame) -> DataFrame:
    """Number of pairs and mean correlation per strength bucket (``row_id, col_id, value`` with row < col)."""
    return (
        pairs.filter((F.col("row_id") < F.col("col_id")) & F.col("value").isNotNull())
        .groupBy(corr_bucket(F.col("value")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("value").alias("mean_corr"))
    )


def labelled_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair with its bucket: the pair lists, one row per pair instead of one array."""
    return pairs.filter(F.col("row_id") < F.col("col_id")).select(
        "row_id", "col_id", "value", corr_bucket(F.col("value")).alias("bucket")
    )


def cov_sign_split(pairs: DataFrame) -> DataFrame:
    """Off-diagonal covariances labelled by sign; exact zeros belong to neither side."""
    return (
        pairs.filter((F.col("row_id") < F.col("col_id")) & (F.col("value") != 0))
        .select("row_id", "col_id", "value", F.when(F.col("value") > 0, "positive").otherwise("negative").alias("sign"))
    )


def corr_series_profile(rho: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Profile of a correlation path ``(series_id, ts, value)``; ``std`` is the population deviation."""
    from panelflow.operators.blocks import attach_series

    stats = rho.groupBy("series_id").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.stddev_samp("value").alias("std_sample"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("n"),
    )
    rows = attach_series(rho, stats.select("series_id", F.col("mean").alias("_m"), F.col("std").alias("_s")), width)
    tails = rows.groupBy("series_id").agg(
        F.count_if(F.col("value") > F.col("_m") + F.col("_s")).alias("n_high"),
        F.count_if(F.col("value") < F.col("_m") - F.col("_s")).alias("n_low"),
    )
    median = exact_quantiles(rho, [0.5], width).select("series_id", F.col("q")[0].alias("median"))
    return (
        stats.join(tails, "series_id")
        .join(median, "series_id")
        .withColumn("share_high", F.col("n_high") / F.col("n"))
        .withColumn("share_low", F.col("n_low") / F.col("n"))
    )


def stationarity_flags(adf: DataFrame) -> DataFrame:
    """Whether any series is stationary and whether any is not."""
    return adf.agg(
        F.bool_or("is_stationary").alias("any_stationary"),
        F.bool_or(~F.col("is_stationary")).alias("any_non_stationary"),
        F.count(F.lit(1)).alias("n_series"),
    )


def granger_summary(granger: DataFrame) -> DataFrame:
    """Pairs tested and pairs significant at 1% and at 5%."""
    return granger.agg(
        F.count(F.lit(1)).alias("pairs_tested"),
        F.count_if("causality_1pct").alias("significant_1pct"),
        F.count_if("causality_5pct").alias("significant_5pct"),
    )


def best_lag(lags: DataFrame, keys: list[str], by: str = "p_value", largest: bool = False) -> DataFrame:
    """Of each group of ``keys``, the ``lag`` whose ``by`` (a p-value or an information criterion) is smallest, and that value.

    Ties go to the shorter lag; with ``largest`` the largest value counts. Lags whose value is null or NaN do not count, and
    a group without any has nulls.
    """
    known = F.col(by).isNotNull() & ~F.isnan(F.col(by).cast("double"))
    order = F.when(known, F.struct((-F.col(by) if largest else F.col(by)).alias("v"), F.col("lag").alias("lag")))
    best = lags.groupBy(*keys).agg(F.min(order).alias("_best"))
    return best.select(*keys, F.col("_best.lag").alias("best_lag"), (-F.col("_best.v") if largest else F.col("_best.v")).alias(by))
