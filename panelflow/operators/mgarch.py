"""Constant and exponentially weighted dynamic conditional correlations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators.blocks import DEFAULT_WIDTH
from panelflow.operators.moments import BLOCK_ROWS, mirrored, pair_correlations, positioned, tile_groups
from panelflow.plans.staging import stage


def last_volatility(filtered: DataFrame) -> DataFrame:
    """Volatility of each series at its last date."""
    return filtered.groupBy("series_id").agg(F.max_by("volatility", "ts").alias("volatility"))


def ccc(filtered: DataFrame, width: int = DEFAULT_WIDTH) -> dict[str, DataFrame]:
    """Correlation of standardized residuals and covariance D R D at the last date.

    ``filtered`` is the output of ``garch_filter``.
    """
    z = filtered.select("series_id", "ts", F.col("std_resid").alias("value"))
    upper = stage(pair_correlations(z, width), "ccc")
    corr = mirrored(upper, "corr")
    vol = last_volatility(filtered)
    vi = vol.select(F.col("series_id").alias("row_id"), F.col("volatility").alias("vi"))
    vj = vol.select(F.col("series_id").alias("col_id"), F.col("volatility").alias("vj"))
    cov = corr.join(vi, "row_id").join(vj, "col_id").select(
        "row_id", "col_id", (F.col("value") * F.col("vi") * F.col("vj")).alias("value")
    )
    return {"correlation": corr, "covariance": cov}


#: Series of a tile of dynamic correlations, whose task holds the paths of all its pairs over one block.
DCC_TILE = 64


def dcc_ewma(z: DataFrame, lam: float = 0.95, width: int = DEFAULT_WIDTH, size: int = BLOCK_ROWS, tile: int = DCC_TILE) -> DataFrame:
    """Dynamic correlation of every pair and date: ``(ts, row_id, col_id, q, rho)``, row_id < col_id.

    Q_t = lam Q_{t-1} + (1 - lam) z_{t-1} z_{t-1}', starting from the sample correlation, on complete
    ``z(series_id, ts, value)``. Inside a block all pairs of two tiles advance together as one matrix.
    The state at a block start is a fold over all earlier block summaries of the pair: one number per
    block. A task returns one row for each pair of two small tiles, with the paths over its block as
    arrays that Spark takes apart.
    """
    rows = stage(positioned(z, "panel_id", width), "dcc")
    groups = tile_groups(rows.select("panel_id", "series_id", "pos", "value"), "panel_id", size, tile=tile)
    decay = lam**size

    def matrices(pdf: pd.DataFrame):
        ti, tj = pdf["ti"].iloc[0], pdf["tj"].iloc[0]
        left = pdf[pdf["tile"] == ti].pivot(index="pos", columns="series_id", values="value").sort_index()
        right = left if ti == tj else pdf[pdf["tile"] == tj].pivot(index="pos", columns="series_id", values="value").sort_index()
        return left, right

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = matrices(pdf)
        if left.empty or right.empty:
            return pd.DataFrame([], columns=["pblk", "ti", "tj", "a", "b", "v", "n"])
        weight = (1 - lam) * lam ** np.arange(len(left) - 1, -1, -1.0)
        out = []
        blocks = [(left, right)] if left is right else [(left, right), (left, left), (right, right)]
        for x, y in blocks:
            v = (x.to_numpy() * weight[:, None]).T @ y.to_numpy()
            a = np.repeat(np.asarray(x.columns, dtype=object), v.shape[1])
            b = np.tile(np.asarray(y.columns, dtype=object), v.shape[0])
            keep = a == b if x is y and left is not right else np.ones(len(a), bool)
            out.append(pd.DataFrame({"a": a[keep], "b": b[keep], "v": v.ravel()[keep]}))
        res = pd.concat(out, ignore_index=True)
        for c in ("pblk", "ti", "tj"):
            res[c] = pdf[c].iloc[0]
        res["n"] = len(left)
        return res[["pblk", "ti", "tj", "a", "b", "v", "n"]]

    summary = groups.groupBy("pblk", "ti", "tj").applyInPandas(
        summarize, "pblk long, ti long, tj long, a string, b string, v double, n long"
    )
    start = pair_correlations(z, width)
    start = start.select("row_id", "col_id", "corr")
    none = F.struct(F.lit(0.0).alias("q"), F.array().cast("array<struct<pblk:bigint,carried:double>>").alias("done"))

    def step(acc, x):
        here = F.struct(x["pblk"].alias("pblk"), acc["q"].alias("carried"))
        return F.struct((acc["q"] * F.lit(decay) + x["v"]).alias("q"), F.array_append(acc["done"], here).alias("done"))

    blocks = F.sort_array(F.collect_list(F.struct("pblk", "v")))
    states = (
        summary.groupBy("ti", "tj", "a", "b")
        .agg(F.explode(F.aggregate(blocks, none, step)["done"]).alias("x"))
        .select("ti", "tj", "a", "b", "x.*")
        .withColumn("row_id", F.least("a", "b"))
        .withColumn("col_id", F.greatest("a", "b"))
        .join(start, ["row_id", "col_id"], "left")
        .select("pblk", "ti", "tj", "a", "b", (F.col("carried") + F.pow(F.lit(decay), F.col("pblk")) * F.col("corr")).alias("q"))
    )

    def advance(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        columns = ["pos", "row_id", "col_id", "q", "rho"]
        if pdf.empty or at.empty:
            return pd.DataFrame([], columns=columns)
        left, right = matrices(pdf)
        lookup = dict(zip(zip(at["a"], at["b"]), at["q"]))
        q = np.array([[lookup[a, b] for b in right.columns] for a in left.columns])
        qa = np.array([lookup[a, a] for a in left.columns])
        qb = np.array([lookup[b, b] for b in right.columns])
        x, y = left.to_numpy(), right.to_numpy()
        path, rho = np.empty((len(x), *q.shape)), np.empty((len(x), *q.shape))
        for t in range(len(x)):
            path[t] = q
            rho[t] = q / np.sqrt(np.outer(qa, qb))
            q = lam * q + (1 - lam) * np.outer(x[t], y[t])
            qa = lam * qa + (1 - lam) * x[t] ** 2
            qb = lam * qb + (1 - lam) * y[t] ** 2
        a = np.repeat(np.asarray(left.columns, dtype=object), y.shape[1])
        b = np.tile(np.asarray(right.columns, dtype=object), x.shape[1])
        keep = a < b if left.columns.equals(right.columns) else np.ones(len(a), bool)
        low, high = np.where(a < b, a, b)[keep], np.where(a < b, b, a)[keep]
        # A pair is one row with its whole paths over the block.
        flat, r = path.reshape(len(x), -1).T[keep], rho.reshape(len(x), -1).T[keep]
        first = np.full(len(low), left.index.to_numpy()[0])
        return pd.DataFrame({"pos": first, "row_id": low, "col_id": high, "q": list(flat), "rho": list(r)})

    key = ["pblk", "ti", "tj"]
    moved = groups.groupBy(*key).cogroup(states.groupBy(*key)).applyInPandas(
        advance, "pos long, row_id string, col_id string, q array<double>, rho array<double>"
    )
    paths = moved.select("pos", "row_id", "col_id", F.posexplode(F.arrays_zip("q", "rho")).alias("i", "v"))
    dates = rows.groupBy("pos").agg(F.min("ts").alias("ts"))
    return paths.select((F.col("pos") + F.col("i")).alias("pos"), "row_id", "col_id", "v.q", "v.rho").join(dates, "pos").select("ts", "row_id", "col_id", "q", "rho")


def dcc_covariance(dcc: DataFrame, filtered: DataFrame) -> DataFrame:
    """Dynamic covariance per pair and date: correlation times the two volatilities of that date."""
    vol = filtered.select("series_id", "ts", "volatility")
    vi = vol.select(F.col("series_id").alias("row_id"), "ts", F.col("volatility").alias("vi"))
    vj = vol.select(F.col("series_id").alias("col_id"), "ts", F.col("volatility").alias("vj"))
    return dcc.join(vi, ["ts", "row_id"]).join(vj, ["ts", "col_id"]).select(
        "ts", "row_id", "col_id", "rho", (F.col("rho") * F.col("vi") * F.col("vj")).alias("cov")
    )


def as_paths(dcc: DataFrame) -> DataFrame:
    """Correlation paths as a panel with one series per pair."""
    return dcc.select(F.concat_ws("|", "row_id", "col_id").alias("series_id"), "ts", F.col("rho").alias("value"))
