"""Lag cross-products: the one set of statistics behind every regression.

For a series with n rows, the products C_d = sum_t y_t * y_{t-d} for d = 0..P, the sum, and the first
and last P values are enough to rebuild the exact normal equations of any regression on up to P lags,
on that regression's own sample (products over a shifted range differ from C_d only in terms that
touch the edges). So a series of any length is reduced to 3P + 3 numbers by one partial/final
aggregation and only those reach Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.operators.blocks import DEFAULT_WIDTH, halo_blocks, lagged
from panelflow.operators.scoring import BLOCK, pack
from panelflow.plans.staging import stage

TILE = 256
BLOCK_ROWS = 512


def _edge(keep: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(keep, F.struct("pos", F.col("x").alias("v")))))["v"]


def lag_moments(panel: DataFrame, depth: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``(series_id, n, mean, s, prod[depth+1], head[depth], tail[depth])`` of the mean-centred series.

    A series with a null has no lag products by position; its first product is NaN, which every solver
    reports as degenerate.
    """
    rows = lagged(panel, list(range(1, depth + 1)), width)
    rows = rows.withColumn("x", F.col("value") - F.col("mean"))
    gapless = F.count("x") == F.count(F.lit(1))
    products = [F.when(gapless, F.sum(F.col("x") * F.col("x"))).otherwise(F.lit(float("nan")))]
    products += [F.sum(F.col("x") * (F.col(f"lag_{d}") - F.col("mean"))) for d in range(1, depth + 1)]
    return rows.groupBy("series_id").agg(
        F.count("x").alias("n"),
        F.first("mean").alias("mean"),
        F.sum("x").alias("s"),
        F.array(*[F.coalesce(p, F.lit(0.0)) for p in products]).alias("prod"),
        _edge(F.col("pos") <= max(depth, 1)).alias("head"),
        _edge(F.col("pos") > F.col("n") - max(depth, 1)).alias("tail"),
    )


def deep_moments(panel: DataFrame, depth: Callable[[int], int], most: int, width: int = DEFAULT_WIDTH, block: int = BLOCK) -> DataFrame:
    """The columns of ``lag_moments``, but each series has the lags that ``depth(n)`` of its length asks for (up to ``most``).

    Products are taken inside blocks of rows, one dot product a lag, so a short series does not pay for the lags of the
    longest and no lag is a column of its own. Values must not be null.
    """
    blocks = pack(panel, most, {}, width, block)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                d, lead = min(depth(int(r.n)), most), len(r.past)
                z = np.concatenate([np.asarray(r.past, dtype=float), np.asarray(r.y, dtype=float)]) - r.mean
                own, at = z[lead:], r.first + np.arange(len(z) - lead)
                prod = [float(z[max(lead, k) :] @ z[max(lead, k) - k : len(z) - k]) if k < len(z) else 0.0 for k in range(d + 1)]
                edge = max(d, 1)
                out.append((r.series_id, r.blk, int(r.n), r.mean, own[at <= edge], own[at > r.n - edge], [float(own.sum()), *prod]))
            yield pd.DataFrame(out, columns=["series_id", "blk", "n", "mean", "head", "tail", "sums"])

    schema = "series_id string, blk long, n long, mean double, head array<double>, tail array<double>, sums array<double>"
    # Only the first and last blocks of a series have edges.
    parts = stage(blocks.mapInPandas(multiply, schema), "products")
    added = parts.select("series_id", F.posexplode("sums").alias("i", "v")).groupBy("series_id", "i").agg(F.sum("v").alias("v"))
    sums = added.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))

    def joined(col: str) -> Column:
        filled = F.collect_list(F.when(F.size(col) > 0, F.struct("blk", F.col(col).alias("v"))))
        return F.flatten(F.transform(F.array_sort(filled), lambda s: s["v"])).alias(col)

    ends = parts.groupBy("series_id").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), joined("head"), joined("tail"))
    size = F.size("sums")
    return ends.join(sums, "series_id").select("series_id", "n", "mean", F.col("sums")[0].alias("s"), F.slice("sums", 2, size - 1).alias("prod"), "head", "tail")


def nested_residuals(g: np.ndarray) -> np.ndarray:
    """Sums of squares of the last variable after regression on the first 0, 1, 2, .. ones, from one Cholesky factor.

    ``g`` is a Gram matrix or a stack of them. What is singular beyond some variable is NaN from there on.
    """
    scale = np.sqrt(np.einsum("...ii->...i", g))
    with np.errstate(all="ignore"):
        scaled = g / (scale[..., :, None] * scale[..., None, :])
        m = g.shape[-1]
        rest = scaled.copy()
        out = np.full(g.shape[:-1], np.nan)
        out[..., 0] = 1.0
        for j in range(m - 1):
            pivot = rest[..., j, j].copy()
            pivot[pivot < 1e-12] = np.nan
            rest = rest - rest[..., :, j, None] * rest[..., None, j, :] / pivot[..., None, None]
            out[..., j + 1] = rest[..., m - 1, m - 1]
        return out * g[..., -1, -1, None]


def lag_gram(prod, s, head, tail, n: int, lags: int) -> np.ndarray:
    """Gram matrix of ``[1, y_t, y_{t-1}, .., y_{t-lags}]`` over t = lags+1..n for k series.

    ``prod[d]`` is k x k with entry (a, b) = sum_t a_t b_{t-d}; ``s`` has k sums; ``head`` and ``tail``
    hold the first and last rows (at least ``lags`` of them), k columns. Columns run lag by lag.
    """
    k = len(s)
    m = lags + 1
    g = np.empty((1 + k * m, 1 + k * m))
    g[0, 0] = n - lags
    tail = tail[len(tail) - lags :] if lags else tail[:0]
    for i in range(m):
        ci = slice(1 + i * k, 1 + (i + 1) * k)
        sums = s - head[: lags - i].sum(axis=0) - tail[lags - i :].sum(axis=0)
        g[0, ci] = g[ci, 0] = sums
        for j in range(i, m):
            d = j - i
            block = prod[d].copy()
            if lags - i > d:
                block -= head[d : lags - i].T @ head[: lags - i - d]
            if i:
                block -= tail[lags - i :].T @ tail[lags - j : lags - d]
            cj = slice(1 + j * k, 1 + (j + 1) * k)
            g[ci, cj] = block
            g[cj, ci] = block.T
    return g


def lag_grams(prod, s, head, tail, n: np.ndarray, lags: int) -> np.ndarray:
    """``lag_gram`` for many systems of k series at once; every argument has one more axis in front."""
    count, k = s.shape
    m = lags + 1
    g = np.empty((count, 1 + k * m, 1 + k * m))
    g[:, 0, 0] = n - lags
    tail = tail[:, tail.shape[1] - lags :]
    for i in range(m):
        ci = slice(1 + i * k, 1 + (i + 1) * k)
        g[:, 0, ci] = g[:, ci, 0] = s - head[:, : lags - i].sum(axis=1) - tail[:, lags - i :].sum(axis=1)
        for j in range(i, m):
            d = j - i
            block = prod[:, d].copy()
            if lags - i > d:
                block -= head[:, d : lags - i].transpose(0, 2, 1) @ head[:, : lags - i - d]
            if i:
                block -= tail[:, lags - i :].transpose(0, 2, 1) @ tail[:, lags - j : lags - d]
            cj = slice(1 + j * k, 1 + (j + 1) * k)
            g[:, ci, cj] = block
            g[:, cj, ci] = block.transpose(0, 2, 1)
    return g


def regress(g: np.ndarray, y: int, x: list[int]):
    """OLS from a Gram matrix: coefficients, residual sum of squares and (X'X)^-1; None when singular."""
    a, b = g[np.ix_(x, x)], g[x, y]
    scale = np.sqrt(np.diag(a))
    if not np.all(np.isfinite(a)) or np.any(scale <= 0):
        return None
    scaled = a / np.outer(scale, scale)
    if np.linalg.cond(scaled) > 1e12:
        return None
    inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
    beta = inverse @ b
    return beta, max(float(g[y, y] - beta @ b), 0.0), inverse


def date_axis(panel: DataFrame, by: str = "panel_id", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Dates of each panel with their 1-based position and the number of dates."""
    dates = panel.groupBy(by, "ts").agg(F.count(F.lit(1)).cast("double").alias("value"))
    ordered = lagged(dates.withColumnRenamed(by, "series_id"), [], width)
    return ordered.select(F.col("series_id").alias(by), "ts", "pos", "n")


def positioned(panel: DataFrame, by: str = "panel_id", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Panel rows with the position of their date. Input must be complete (see ``drop_incomplete``)."""
    rows = panel if by in panel.columns else panel.withColumn(by, F.lit("all"))
    return rows.join(date_axis(rows, by, width), [by, "ts"])


def with_mean(panel: DataFrame, by: str = "panel_id", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add the mean of each series; regressions work on ``value - mean`` so that levels cost no digits."""
    rows = panel if by in panel.columns else panel.withColumn(by, F.lit("all"))
    keyed = rows.select(F.concat_ws("\u001f", by, "series_id").alias("series_id"), F.col("series_id").alias("_s"), by, "ts", "value")
    out = lagged(keyed, [], width)
    return out.select(by, F.col("_s").alias("series_id"), "ts", "value", "mean")


def _centred(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.col("value") - F.col("mean")) if "mean" in rows.columns else rows


def tile_groups(rows: DataFrame, by: str = "panel_id", size: int = BLOCK_ROWS, halo: int = 0, tile: int = TILE) -> DataFrame:
    """Cut positioned rows into (panel, position block, tile pair) groups of bounded size.

    Series are hashed into tiles of about ``tile``; a group holds the rows of one block and two tiles. The
    number of tiles follows from a count of the series inside the same query.
    """
    n_series = rows.agg(F.approx_count_distinct("series_id")).scalar()
    tiles = F.greatest(F.ceil(n_series / F.lit(tile)), F.lit(1))
    cut = halo_blocks(rows, max(size, halo, 1), halo).withColumn("_tiles", tiles)
    cut = cut.withColumn("_tile", F.pmod(F.xxhash64("series_id"), F.col("_tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))
    cut = cut.withColumn("_other", other)
    return cut.select(
        by,
        "pblk",
        F.least("_tile", "_other").alias("ti"),
        F.greatest("_tile", "_other").alias("tj"),
        F.col("_tile").alias("tile"),
        "series_id",
        "pos",
        "value",
        "is_halo",
    )


def _wide(pdf: pd.DataFrame, tile: int):
    part = pdf[pdf["tile"] == tile]
    wide = part.pivot(index="pos", columns="series_id", values="value").sort_index()
    return wide


def cross_products(rows: DataFrame, depth: int, by: str = "panel_id", size: int = BLOCK_ROWS) -> DataFrame:
    """``(by, a, b, prod[depth+1])`` with prod[d] = sum_t a_t b_{t-d}, for every ordered pair of series.

    Each group multiplies two small matrices, so what is shuffled is one partial row per pair and
    block instead of one row per pair and date.
    """

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = pdf["ti"].iloc[0], pdf["tj"].iloc[0]
        left = _wide(pdf, ti)
        right = left if ti == tj else _wide(pdf, tj)
        out = []
        if left.empty or right.empty or pdf["is_halo"].all():
            return pd.DataFrame(out, columns=[by, "a", "b", "prod"])
        first = int(pdf.loc[~pdf["is_halo"], "pos"].min())
        pos = left.index.union(right.index)
        for top, low in [(left, right)] if ti == tj else [(left, right), (right, left)]:
            x, y = top.reindex(pos).to_numpy(), low.reindex(pos).to_numpy()
            home = int(np.searchsorted(pos, first))
            stack = []
            for d in range(depth + 1):
                start = max(home, d)
                stack.append(x[start:].T @ y[start - d : len(pos) - d])
            cube = np.stack(stack, axis=-1)
            a = np.repeat(np.asarray(top.columns, dtype=object), y.shape[1])
            b = np.tile(np.asarray(low.columns, dtype=object), x.shape[1])
            out.append(pd.DataFrame({by: pdf[by].iloc[0], "a": a, "b": b, "prod": list(cube.reshape(-1, depth + 1))}))
        return pd.concat(out, ignore_index=True)

    kind = dict(rows.dtypes)[by]
    partial = (
        tile_groups(_centred(rows), by, size, depth)
        .groupBy(by, "pblk", "ti", "tj")
        .applyInPandas(multiply, f"{by} {kind}, a string, b string, prod array<double>")
    )
    sums = [F.sum(F.col("prod")[d]) for d in range(depth + 1)]
    return partial.groupBy(by, "a", "b").agg(F.array(*sums).alias("prod"))


def series_edges(rows: DataFrame, depth: int, by: str = "panel_id") -> DataFrame:
    """``(by, series_id, n, mean, s, head, tail)`` of positioned rows."""
    x = _centred(rows).withColumn("x", F.col("value"))
    mean = F.first("mean") if "mean" in rows.columns else F.lit(0.0)
    return x.groupBy(by, "series_id").agg(
        F.first("n").alias("n"),
        mean.alias("mean"),
        F.sum("x").alias("s"),
        _edge(F.col("pos") <= max(depth, 1)).alias("head"),
        _edge(F.col("pos") > F.col("n") - max(depth, 1)).alias("tail"),
    )


def pair_correlations(panel: DataFrame, width: int = DEFAULT_WIDTH, size: int = BLOCK_ROWS) -> DataFrame:
    """Pairwise-complete sample covariance and correlation: ``(row_id, col_id, n, cov, corr)``.

    Rows may be missing or null: each pair uses the dates both have. Values are shifted by the series
    mean first, so large levels lose no digits.
    """
    shifted = lagged(panel.filter(F.col("value").isNotNull()), [], width).select(
        F.lit("all").alias("panel_id"), "series_id", "ts", (F.col("value") - F.col("mean")).alias("value")
    )
    rows = stage(positioned(shifted, "panel_id", width), "pairs")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = pdf["ti"].iloc[0], pdf["tj"].iloc[0]
        left = _wide(pdf, ti)
        right = left if ti == tj else _wide(pdf, tj)
        if left.empty or right.empty:
            return pd.DataFrame([], columns=["a", "b", "m"])
        pos = left.index.union(right.index)
        x, y = left.reindex(pos).to_numpy(), right.reindex(pos).to_numpy()
        mx, my = ~np.isnan(x), ~np.isnan(y)
        x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
        fx, fy = mx.astype(float), my.astype(float)
        cube = np.stack(
            [fx.T @ fy, x.T @ fy, fx.T @ y, x.T @ y, (x * x).T @ fy, fx.T @ (y * y)], axis=-1
        ).reshape(-1, 6)
        a = np.repeat(np.asarray(left.columns, dtype=object), y.shape[1])
        b = np.tile(np.asarray(right.columns, dtype=object), x.shape[1])
        swap = a > b
        cube[swap] = cube[swap][:, [0, 2, 1, 3, 5, 4]]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = pd.DataFrame({"a": a, "b": b, "m": list(cube)})
        return out if ti != tj else out[~swap]

    partial = tile_groups(rows, "panel_id", size).groupBy("panel_id", "pblk", "ti", "tj").applyInPandas(
        multiply, "a string, b string, m array<double>"
    )
    names = ["n", "sx", "sy", "sxy", "sxx", "syy"]
    total = partial.groupBy("a", "b").agg(*[F.sum(F.col("m")[i]).alias(c) for i, c in enumerate(names)])
    n = F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    ok = (n > 1) & (cxx > 0) & (cyy > 0)
    return total.filter(n > 0).select(
        F.col("a").alias("row_id"),
        F.col("b").alias("col_id"),
        n.cast("long").alias("n"),
        F.when(n > 1, cxy / (n - 1)).alias("cov"),
        F.when(ok, F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(cxy / F.sqrt(cxx * cyy))).alias("corr"),
    )


def mirrored(pairs: DataFrame, value: str) -> DataFrame:
    """Upper triangle -> full matrix ``(row_id, col_id, value)``."""
    both = F.when(
        F.col("row_id") == F.col("col_id"), F.array(F.struct("row_id", "col_id"))
    ).otherwise(
        F.array(
            F.struct("row_id", "col_id"),
            F.struct(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id")),
        )
    )
    return pairs.withColumn("p", F.explode(both)).select("p.row_id", "p.col_id", F.col(value).alias("value"))


def series_pairs(panel: DataFrame, ordered: bool = True, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Pairs of different series with their number of common dates, correlation and covariance."""
    pairs = pair_correlations(panel, width).filter(F.col("row_id") != F.col("col_id"))
    if ordered:
        both = F.array(
            F.struct(F.col("row_id").alias("source"), F.col("col_id").alias("target")),
            F.struct(F.col("col_id").alias("source"), F.col("row_id").alias("target")),
        )
        return pairs.withColumn("p", F.explode(both)).select("p.source", "p.target", "n", "corr", "cov")
    return pairs.select(F.col("row_id").alias("a"), F.col("col_id").alias("b"), "n", "corr", "cov")
