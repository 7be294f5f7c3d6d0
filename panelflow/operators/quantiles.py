"""Exact quantiles per series without holding a series in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.operators.blocks import DEFAULT_WIDTH, attach_series

ACCURACY = 10_000
MARGIN = 2e-4
SMALL = 50_000


def exact_quantiles(panel: DataFrame, probs: Sequence[float], width: int = DEFAULT_WIDTH) -> DataFrame:
    """``(series_id, q array<double>)`` of a panel with linear interpolation between order statistics.

    The built-in exact ``percentile`` keeps a map of all values of a key in one task. Here a mergeable
    sketch first brackets each wanted rank (its rank error is at most 1/10000, the bracket is wider),
    then rows below a bracket are only counted, equal values inside are merged, and only a bracket
    (under 0.1% of a large key) is sorted. The bracket of a key with fewer than 50,000 rows is its full
    range; a rank outside its bracket would be an error, never a null.
    """
    base = panel.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("series_id", "ts", F.col("value").alias("v"))
    cuts = [max(p - MARGIN, 0.0) for p in probs] + [min(p + MARGIN, 1.0) for p in probs]
    sketch = base.groupBy("series_id").agg(
        F.count("v").alias("n"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.percentile_approx("v", cuts, ACCURACY).alias("cut"),
    )
    small = F.col("n") < SMALL
    m = len(probs)

    def bracket(i: int, p: float) -> Column:
        open_low = small if p - MARGIN > 0 else F.lit(True)
        open_high = small if p + MARGIN < 1 else F.lit(True)
        return F.struct(
            F.lit(i).alias("i"),
            F.when(open_low, F.col("lo")).otherwise(F.col("cut")[i]).alias("lo"),
            F.when(open_high, F.col("hi")).otherwise(F.col("cut")[m + i]).alias("hi"),
            ((F.col("n") - 1) * F.lit(float(p))).alias("h"),
        )

    brackets = sketch.select("series_id", F.array(*[bracket(i, p) for i, p in enumerate(probs)]).alias("br"))
    rows = attach_series(base, brackets, width)
    below = [F.count_if(F.col("v") < F.col("br")[i]["lo"]).alias(f"below_{i}") for i in range(m)]
    counts = rows.groupBy("series_id").agg(*below)
    inside = (
        rows.select("series_id", "v", F.explode(F.filter("br", lambda b: F.col("v").between(b["lo"], b["hi"]))).alias("b"))
        .groupBy("series_id", F.col("b.i").alias("i"), F.col("b.h").alias("h"), "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    order = Window.partitionBy("series_id", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.withColumn("at", F.coalesce(F.sum("c").over(order), F.lit(0))).join(counts, "series_id")
    offset = F.coalesce(*[F.when(F.col("i") == i, F.col(f"below_{i}")) for i in range(m)])
    at = F.col("at") + offset
    hit_low = (F.floor("h") >= at) & (F.floor("h") < at + F.col("c"))
    hit_high = (F.ceil("h") >= at) & (F.ceil("h") < at + F.col("c"))
    picked = ranked.groupBy("series_id", "i", "h").agg(
        F.max(F.when(hit_low, F.col("v"))).alias("lo"), F.max(F.when(hit_high, F.col("v"))).alias("hi")
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))
    # Both ranks have to lie in the bracket that was counted.
    missed = F.raise_error(F.concat(F.lit("rank outside its bracket: "), F.col("series_id").cast("string")))
    value = F.when(F.col("lo").isNull() | F.col("hi").isNull(), missed).otherwise(value)
    packed = F.array_sort(F.collect_list(F.struct("i", value.alias("q"))))
    return picked.groupBy("series_id").agg(packed.alias("p")).select("series_id", F.col("p.q").alias("q"))
