"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def significance_label(p: Column) -> Column:
    return (
        F.when(p < 0.01, "Significant at 1% level")
        .when(p < 0.05, "Significant at 5% level")
        .when(p < 0.10, "Significant at 10% level")
        .otherwise("Not significant")
    )


def variance_to_vol(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def is_stationary(p: Column, threshold: float = 0.05) -> Column:
    return p < F.lit(threshold)


def unbiased_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population moment ratio."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population moment ratio."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def information_criteria(llf: Column, k: Column, n_eff: Column) -> dict[str, Column]:
    return {
        "aic": 2 * k - 2 * llf,
        "bic": k * F.log(n_eff) - 2 * llf,
        "hqic": F.when(n_eff > 1, 2 * k * F.log(F.log(n_eff)) - 2 * llf),
    }


def adf_critical_values(n: Column) -> dict[str, Column]:
    """MacKinnon (2010) response surface, constant, no trend."""
    return {
        name: F.lit(c[0]) + F.lit(c[1]) / n + F.lit(c[2]) / (n * n) + F.lit(c[3]) / (n * n * n)
        for name, c in ADF_SURFACE.items()
    }


# Published response-surface coefficients (b0 + b1/n + b2/n^2 + b3/n^3).
ADF_SURFACE = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
# The table used when no sample size is known.
ADF_FALLBACK = {"crit_1": -3.75, "crit_5": -3.0, "crit_10": -2.63}


def garch_diagnostics(alpha: Column, beta: Column, omega: Column) -> dict[str, Column]:
    persistence = alpha + beta
    inside = (persistence > 0) & (persistence < 1)
    return {
        "persistence": persistence,
        "unconditional_variance": F.when(inside, omega / (1 - persistence)),
        "half_life": F.when(inside, F.log(F.lit(0.5)) / F.log(persistence)),
    }


def var_param_count(lag: Column, n_vars: Column) -> Column:
    return lag * n_vars * n_vars + n_vars


def _clean(c: Column, kind: T.DataType, decimals: int) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        return F.when(finite, F.round(c.cast("double"), decimals) + F.lit(0.0))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType, decimals))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: _clean(v, kind.valueType, decimals))
    if isinstance(kind, T.StructType):
        fields = [_clean(c[f.name], f.dataType, decimals).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def finalize(
    df: DataFrame, decimals: int = 6, places: dict[str, int] | None = None, unbounded: tuple[str, ...] = ()
) -> DataFrame:
    """Round every float, turn NaN and infinities into null and times into ISO text, at any depth.

    ``places`` overrides the number of decimals for single columns; the double columns ``unbounded`` keep NaN and infinities.
    """
    places = places or {}

    def column(f: T.StructField) -> Column:
        c, n = F.col(f"`{f.name}`"), places.get(f.name, decimals)
        return (F.round(c, n) + F.lit(0.0) if f.name in unbounded else _clean(c, f.dataType, n)).alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])
