"""Search for strongly correlated series without comparing all pairs.

A centred series is a vector, and the correlation of two series is the cosine of their angle. Signs of random
projections agree for two vectors with a probability that grows with the cosine. So each series gets bands of
signs, series that share a band are candidates, and the correlation of candidates is computed exactly. A band
and its opposite are one key, so that strong negative correlations are found as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.operators.blocks import DEFAULT_WIDTH
from panelflow.operators.scoring import BLOCK, pack
from panelflow.plans.staging import stage

#: Projections that a series has at most.
MOST = 8192


def bands_for(n_series: int, at_least: float, recall: float) -> tuple[int, int]:
    """``(bits, bands)``: keys so long that chance meetings stay about linear, and enough of them for the recall at ``at_least``."""
    same = 1 - math.acos(min(at_least, 1.0)) / math.pi
    for bits in range(min(max(math.ceil(math.log2(max(n_series, 2))), 1), 60), 0, -1):
        meet = same**bits + (1 - same) ** bits
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meet))
        if bits * bands <= MOST or bits == 1:
            return bits, bands
    raise AssertionError


def _project(batches: Iterator[pd.DataFrame], size: int, seed: int) -> Iterator[pd.DataFrame]:
    """Partial projections of blocks; blocks at the same place meet the same random numbers."""
    for pdf in batches:
        out = []
        for first, own in pdf.groupby("first"):
            values = [np.asarray(y, dtype=float) - m for y, m in zip(own["y"], own["mean"])]
            made = np.zeros((len(values), size))
            for at in range(0, max(map(len, values)), 1024):
                noise = np.random.default_rng([seed, int(first) + at]).normal(size=(1024, size))
                part = np.zeros((len(values), 1024))
                for row, v in zip(part, values):
                    row[: len(v[at : at + 1024])] = v[at : at + 1024]
                made += part @ noise
            out.append(pd.DataFrame({"series_id": own["series_id"].to_numpy(), "p": list(made)}))
        yield pd.concat(out, ignore_index=True)


def _keys(batches: Iterator[pd.DataFrame], bits: int, bands: int) -> Iterator[pd.DataFrame]:
    weight = 1 << np.arange(bits, dtype=np.int64)
    for pdf in batches:
        signs = np.stack([np.asarray(p, dtype=float) for p in pdf["p"]]).reshape(len(pdf), bands, bits) > 0
        signs ^= signs[:, :, :1]
        yield pd.DataFrame({"series_id": pdf["series_id"], "keys": list((signs * weight).sum(axis=2))})


def correlated_pairs(
    panel: DataFrame, at_least: float = 0.9, recall: float = 0.999, top: int | None = None, width: int = DEFAULT_WIDTH, block: int = BLOCK, seed: int = 1
) -> DataFrame:
    """``row_id, col_id, corr`` for pairs of series whose correlation is at least ``at_least`` or at most its negative.

    For a complete panel (every series has every date; use ``align_outer`` and ``fill`` first). Each such pair is
    found with probability ``recall`` or more, and what is returned is exact. With ``top``, only the pairs among the ``top``
    strongest ones of either series stay. Series without variance have no pairs. Rows are never paired: candidates
    meet once, as blocks of values.
    """
    squares = F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")))
    blocks = stage(pack(panel, 0, {"squares": squares}, width, block), "search").filter("squares is not null")
    spread = blocks.groupBy("series_id").agg(F.sum("squares").alias("ss")).filter("ss > 0")
    spread = stage(spread, "spread")
    n_series = spread.count()
    bits, bands = bands_for(n_series, at_least, recall)
    size = bits * bands

    parts = blocks.select("series_id", "first", "mean", "y").mapInPandas(lambda b: _project(b, size, seed), "series_id string, p array<double>")
    zero = F.array_repeat(F.lit(0.0), size)
    whole = parts.groupBy("series_id").agg(F.aggregate(F.collect_list("p"), zero, lambda s, p: F.zip_with(s, p, lambda a, b: a + b)).alias("p"))
    signed = whole.join(spread, "series_id", "left_semi").mapInPandas(lambda b: _keys(b, bits, bands), "series_id string, keys array<long>")
    at = stage(signed.select("series_id", F.posexplode("keys").alias("band", "key")), "bands")
    other = at.select(F.col("series_id").alias("col_id"), "band", "key")
    pairs = at.withColumnRenamed("series_id", "row_id").join(other, ["band", "key"]).filter("row_id < col_id").select("row_id", "col_id").distinct()
    pairs = stage(pairs, "candidates")

    # One row per pair and block, with the block of either series.
    left = blocks.select(F.col("series_id").alias("row_id"), "blk", F.col("y").alias("x"), F.col("mean").alias("mx"))
    right = blocks.select(F.col("series_id").alias("col_id"), "blk", "y", F.col("mean").alias("my"))
    met = pairs.join(left, "row_id").join(right, ["col_id", "blk"])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dots = [float((np.asarray(x) - mx) @ (np.asarray(y) - my)) for x, mx, y, my in zip(pdf["x"], pdf["mx"], pdf["y"], pdf["my"])]
            yield pd.DataFrame({"row_id": pdf["row_id"], "col_id": pdf["col_id"], "dot": dots})

    dots = met.mapInPandas(multiply, "row_id string, col_id string, dot double").groupBy("row_id", "col_id").agg(F.sum("dot").alias("dot"))
    one = spread.select(F.col("series_id").alias("row_id"), F.col("ss").alias("sx"))
    two = spread.select(F.col("series_id").alias("col_id"), F.col("ss").alias("sy"))
    exact = dots.join(one, "row_id").join(two, "col_id").select("row_id", "col_id", (F.col("dot") / F.sqrt(F.col("sx") * F.col("sy"))).alias("corr"))
    found = exact.filter(F.abs("corr") >= at_least)
    if top is None:
        return found
    found = stage(found, "found")
    both = found.select(F.explode(F.array("row_id", "col_id")).alias("of"), "row_id", "col_id", "corr")
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc(F.abs("corr")), "row_id", "col_id"))
    return both.withColumn("_r", rank).filter(F.col("_r") <= top).select("row_id", "col_id", "corr").distinct()
