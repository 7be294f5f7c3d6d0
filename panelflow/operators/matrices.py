"""Operators on labelled square matrices in long form ``(row_id, col_id, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Column that keeps the matrices of several panels apart; optional.
PANEL = "panel_id"


def _by(df: DataFrame) -> list[str]:
    return [PANEL] if PANEL in df.columns else []


def _off() -> Column:
    return F.col("row_id") != F.col("col_id")


def exclude_self(pairs: DataFrame, a: str = "row_id", b: str = "col_id") -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b))


def row_check(fevd: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Row sums of a decomposition, which should be 100."""
    total = F.sum("value")
    return fevd.groupBy(*_by(fevd), "row_id").agg(total.alias("row_sum"), (F.abs(total - 100) < tolerance).alias("ok"))


def directional(fevd: DataFrame) -> DataFrame:
    """``from`` (received from others), ``to`` (given to others) and ``net = to - from`` per variable.

    One aggregation: each off-diagonal cell counts once for its row and once for its column.
    """
    by = _by(fevd)
    parts = fevd.filter(_off()).select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("row_id").alias("id"), F.col("value").alias("f"), F.lit(0.0).alias("t")),
                F.struct(F.col("col_id").alias("id"), F.lit(0.0).alias("f"), F.col("value").alias("t")),
            )
        ).alias("p"),
    )
    return (
        parts.groupBy(*by, F.col("p.id").alias("series_id"))
        .agg(F.sum("p.f").alias("from_others"), F.sum("p.t").alias("to_others"))
        .withColumn("net", F.col("to_others") - F.col("from_others"))
    )


def total_spillover(fevd: DataFrame) -> DataFrame:
    """Off-diagonal share of the decomposition, in percent: one row for each panel."""
    by = _by(fevd)
    return (fevd.groupBy(*by) if by else fevd).agg((F.try_divide(F.sum(F.when(_off(), F.col("value")).otherwise(0.0)), F.sum("value")) * 100).alias("total"))


def pairwise(fevd: DataFrame) -> DataFrame:
    """``(source, target, value)``: the share of target explained by source."""
    return fevd.filter(_off()).select(*_by(fevd), F.col("col_id").alias("source"), F.col("row_id").alias("target"), "value")


def fill_identity(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Give every variable its own cell: the matrix with 100 on a missing diagonal.

    Off-diagonal cells that are absent mean 0 in the long form and stay absent.
    """
    diagonal = ids.select(F.col("series_id").alias("row_id"), F.col("series_id").alias("col_id"))
    missing = diagonal.join(pairs, ["row_id", "col_id"], "left_anti").withColumn("value", F.lit(100.0))
    return pairs.select("row_id", "col_id", "value").unionByName(missing)


def complete_matrix(pairs: DataFrame, ids: DataFrame, diagonal: float = 100.0, off: float = 0.0, size: int = 256) -> DataFrame:
    """Every ordered pair of ``ids(series_id)`` with its value or the default (100 on the diagonal, 0 off).

    The grid is the result, so it is built in parallel: ids are hashed into buckets of about ``size``,
    and each id meets one bounded bucket at a time by an equi-join.
    """
    count = ids.agg(F.approx_count_distinct("series_id")).scalar()
    named = ids.select("series_id").distinct().withColumn("_n", F.greatest(F.ceil(count / F.lit(size)), F.lit(1)))
    packed = named.groupBy(F.pmod(F.xxhash64("series_id"), F.col("_n")).alias("_b")).agg(F.collect_list("series_id").alias("_ids"))
    rows = named.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    grid = rows.join(packed, "_b").select(F.col("series_id").alias("row_id"), F.explode("_ids").alias("col_id"))
    default = F.when(F.col("row_id") == F.col("col_id"), diagonal).otherwise(off)
    return grid.join(pairs.select("row_id", "col_id", "value"), ["row_id", "col_id"], "left").select(
        "row_id", "col_id", F.coalesce("value", default).alias("value")
    )


def rank_contributors(fevd: DataFrame, k: int | None = None) -> DataFrame:
    """External contributors of each variable, largest first, ties by name."""
    w = Window.partitionBy(*_by(fevd), "row_id").orderBy(F.desc("value"), "col_id")
    ranked = fevd.filter(_off()).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def top_net(net: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` largest transmitters and the ``k`` largest receivers; ties (to 9 decimals) by name."""
    size = F.round("net", 9)

    def top(order: list[Column], role: str) -> DataFrame:
        return net.orderBy(*order).limit(k).select("series_id", "net", F.lit(role).alias("role"))

    return top([size.desc(), F.col("series_id")], "transmitter").unionByName(
        top([size.asc(), F.col("series_id")], "receiver")
    )


def equal_weights(cov: DataFrame) -> DataFrame:
    ids = cov.select(F.col("row_id").alias("series_id")).distinct()
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ids.withColumn("weight", F.lit(1.0) / n)


def portfolio_risk(cov: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Risk per asset and for the portfolio. ``cov`` holds the full matrix (both triangles).

    One row per asset: volatility, weight, marginal risk (row of cov times weights), share of the
    portfolio variance, plus the portfolio columns repeated.
    """
    w = (weights if weights is not None else equal_weights(cov)).select("series_id", "weight")
    wi = w.select(F.col("series_id").alias("row_id"), F.col("weight").alias("wi"))
    wj = w.select(F.col("series_id").alias("col_id"), F.col("weight").alias("wj"))
    per_asset = (
        cov.join(wj, "col_id")
        .groupBy("row_id")
        .agg(
            F.sum(F.col("value") * F.col("wj")).alias("marginal_risk"),
            F.sqrt(F.max(F.when(F.col("row_id") == F.col("col_id"), F.col("value")))).alias("volatility"),
        )
        .join(wi, "row_id")
    )
    totals = per_asset.agg(
        F.struct(
            F.sum(F.col("wi") * F.col("marginal_risk")).alias("variance"),
            F.sum(F.col("wi") * F.col("volatility")).alias("average"),
        ).alias("t")
    ).scalar()
    variance, average = totals.getField("variance"), totals.getField("average")
    return per_asset.select(
        F.col("row_id").alias("series_id"),
        F.col("wi").alias("weight"),
        "volatility",
        "marginal_risk",
        (F.col("wi") * F.col("marginal_risk") / variance).alias("risk_share"),
        F.sqrt(variance).alias("portfolio_vol"),
        average.alias("weighted_avg_vol"),
        (average / F.sqrt(variance)).alias("diversification_ratio"),
    )


def risk_extremes(risk: DataFrame) -> DataFrame:
    """Largest and smallest risk contributor, ties by name."""
    high = F.struct(F.col("risk_share"), F.col("series_id"))
    return risk.agg(
        F.min_by("series_id", F.struct((-F.col("risk_share")).alias("s"), F.col("series_id"))).alias("max_contributor"),
        F.max("risk_share").alias("max_share"),
        F.min_by("series_id", high).alias("min_contributor"),
        F.min("risk_share").alias("min_share"),
    )
