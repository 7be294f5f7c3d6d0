"""Vector autoregression, variance decomposition, spillover and causality from lag cross-products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.distributions import f_sf, t_sf
from panelflow.operators import matrices
from panelflow.operators.blocks import DEFAULT_WIDTH, halo_blocks
from panelflow.operators.moments import BLOCK_ROWS, cross_products, lag_gram, lag_grams, nested_residuals, positioned, series_edges, with_mean
from panelflow.plans.staging import stage

BY = "panel_id"
MODEL_SCHEMA = (
    f"{BY} string, lag int, max_lag int, ic string, n_obs long, names array<string>, coef array<double>, se array<double>, "
    "sigma array<double>, ic_values array<double>, status string"
)
_MODEL_COLUMNS = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]


def prepared(panel: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Complete panel with date positions, written once because the statistics read it several times."""
    return stage(positioned(with_mean(panel, BY, width), BY, width), "positioned")


def solve_var(g: np.ndarray, k: int, lag: int):
    """Coefficients (rows: constant, then lag by lag), residual cross-product and (X'X)^-1."""
    x = [0] + list(range(1 + k, 1 + k * (lag + 1)))
    y = list(range(1, 1 + k))
    a, b = g[np.ix_(x, x)], g[np.ix_(x, y)]
    scale = np.sqrt(np.maximum(np.diag(a), 0))
    if not np.isfinite(a).all() or np.any(scale <= 0):
        return None
    unit = a / np.outer(scale, scale)
    if np.linalg.cond(unit) > 1e12:
        return None
    inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    coef = inverse @ b
    return coef, g[np.ix_(y, y)] - coef.T @ b, inverse


def _model_row(panel_id, names, means, prod, s, head, tail, n, max_lag, ic):
    k = len(names)
    empty = (panel_id, None, max_lag, ic, n, names, None, None, None, None, "degenerate")
    max_lag = max(1, min(max_lag, n // 3))
    values, best, best_value = [], 1, np.inf
    full = lag_gram(prod, s, head, tail, n, max_lag)
    t = n - max_lag
    for lag in range(1, max_lag + 1):
        fit = solve_var(full, k, lag) if t > k * lag + 1 else None
        sign, logdet = np.linalg.slogdet(fit[1] / t) if fit is not None else (0, 0)
        if sign <= 0:
            values.append(None)
            continue
        size = lag * k * k + k
        penalty = {"aic": 2.0, "bic": np.log(t), "hqic": 2 * np.log(np.log(t))}[ic]
        values.append(float(logdet + penalty * size / t))
        if values[-1] < best_value - 1e-12:
            best, best_value = lag, values[-1]
    fit = solve_var(lag_gram(prod, s, head, tail, n, best), k, best)
    t = n - best
    dof = t - k * best - 1
    if fit is None or dof <= 0 or not np.isfinite(best_value):
        return empty
    coef, resid, inverse = fit
    # Back from centred values: the constant absorbs mean - sum(A_i mean).
    back = np.eye(len(coef))
    back[0, 1:] = -np.tile(means, best)
    coef, inverse = back @ coef, back @ inverse @ back.T
    coef[0] += means
    sigma = resid / dof
    se = np.sqrt(np.maximum(np.outer(np.diag(inverse), np.diag(sigma)), 0))
    return (panel_id, best, max_lag, ic, t, names, coef.ravel(), se.ravel(), sigma.ravel(), values, "ok")


def var_fit(rows: DataFrame, max_lags: int = 5, ic: str = "aic") -> DataFrame:
    """One model row per panel. ``rows`` comes from ``prepared``.

    Lags 1..max_lags (at most a third of the dates) are compared on their common sample; the chosen
    lag is refitted on its own. Only k x k x lag numbers per panel reach the solving task, whatever the
    number of dates; the dense solve suits panels of up to a few thousand series times lags.
    """
    cross = cross_products(rows, max_lags, BY)
    edges = series_edges(rows, max_lags, BY)

    def solve(stats: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("series_id")
        names = ends["series_id"].tolist()
        index = {v: i for i, v in enumerate(names)}
        k = len(names)
        cube = np.zeros((max_lags + 1, k, k))
        cube[:, stats["a"].map(index), stats["b"].map(index)] = np.stack(stats["prod"].to_numpy()).T
        head, tail = (np.stack([np.asarray(v, dtype=float) for v in ends[c]]).T for c in ("head", "tail"))
        row = _model_row(
            ends[BY].iloc[0], names, ends["mean"].to_numpy(float), cube, ends["s"].to_numpy(float), head, tail, int(ends["n"].iloc[0]), max_lags, ic
        )
        return pd.DataFrame([row], columns=_MODEL_COLUMNS)

    return cross.groupBy(BY).cogroup(edges.groupBy(BY)).applyInPandas(solve, MODEL_SCHEMA)


def _p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(2 * t_sf(np.abs(t.to_numpy(float)), df.to_numpy(float)))


def var_coefficients(models: DataFrame) -> DataFrame:
    """Long coefficients: equation, term (``const`` or a series), lag, estimate, error, t and p."""
    k = F.size("names")
    rows = models.filter(F.col("coef").isNotNull()).select(
        BY, "names", "n_obs", "lag", k.alias("k"), F.posexplode(F.arrays_zip("coef", "se")).alias("i", "v")
    )
    row, col = F.floor(F.col("i") / F.col("k")), F.col("i") % F.col("k")
    term = F.when(row == 0, "const").otherwise(F.element_at("names", (((row - 1) % F.col("k")) + 1).cast("int")))
    out = rows.select(
        BY,
        F.element_at("names", (col + 1).cast("int")).alias("equation"),
        term.alias("term"),
        F.when(row == 0, 0).otherwise(F.floor((row - 1) / F.col("k")) + 1).cast("int").alias("lag"),
        F.col("v.coef").alias("estimate"),
        F.col("v.se").alias("std_err"),
        (F.col("n_obs") - F.col("k") * F.col("lag") - 1).alias("_dof"),
    )
    out = out.withColumn("t_stat", F.try_divide("estimate", "std_err"))
    return out.withColumn("p_value", F.pandas_udf(_p_t, "double")("t_stat", F.col("_dof").cast("double"))).drop("_dof")


def var_sigma(models: DataFrame) -> DataFrame:
    rows = models.filter(F.col("sigma").isNotNull()).select(
        BY, "names", F.size("names").alias("k"), F.posexplode("sigma").alias("i", "value")
    )
    return rows.select(
        BY,
        F.element_at("names", (F.floor(F.col("i") / F.col("k")) + 1).cast("int")).alias("row_id"),
        F.element_at("names", (F.col("i") % F.col("k") + 1).cast("int")).alias("col_id"),
        "value",
    )


def var_lag_table(models: DataFrame) -> DataFrame:
    """Information criterion of every lag that was compared."""
    return models.select(BY, F.col("lag").alias("selected"), F.posexplode("ic_values").alias("i", "value")).select(
        BY, (F.col("i") + 1).alias("lag"), "value", (F.col("i") + 1 == F.col("selected")).alias("is_selected")
    )


def var_residuals(rows: DataFrame, models: DataFrame, max_lag: int = 5, size: int = BLOCK_ROWS) -> DataFrame:
    """Fitted value and residual per panel, series and date. ``max_lag`` is the largest lag a model has.

    The model row of a panel is sent to each of its position blocks and meets the rows there.
    """
    cut = halo_blocks(rows.select(BY, "series_id", "ts", "pos", "value"), max(size, max_lag), max_lag)
    # Fresh column identities keep the two sides of the cogroup apart.
    blocks = cut.select(BY, "pblk").distinct().join(models.filter(F.col("coef").isNotNull()), BY)
    blocks = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])

    def evaluate(data: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        columns = [BY, "series_id", "ts", "value", "fitted", "residual"]
        if data.empty or model.empty or data["is_halo"].all():
            return pd.DataFrame([], columns=columns)
        m = model.iloc[0]
        names, lag = list(m["names"]), int(m["lag"])
        k = len(names)
        coef = np.asarray(m["coef"], dtype=float).reshape(1 + k * lag, k)
        wide = data.pivot(index="pos", columns="series_id", values="value").sort_index()[names]
        when = data.drop_duplicates("pos").set_index("pos")["ts"]
        y = wide.to_numpy(float)
        if len(y) <= lag:
            return pd.DataFrame([], columns=columns)
        x = np.ones((len(y) - lag, 1 + k * lag))
        for i in range(1, lag + 1):
            x[:, 1 + (i - 1) * k : 1 + i * k] = y[lag - i : len(y) - i]
        fitted = x @ coef
        first = data.loc[~data["is_halo"], "pos"].min()
        pos = wide.index[lag:]
        keep = pos >= first
        out = pd.DataFrame(
            {
                BY: m[BY],
                "series_id": np.tile(np.asarray(names, dtype=object), int(keep.sum())),
                "ts": np.repeat(when.loc[pos[keep]].to_numpy(), k),
                "value": y[lag:][keep].ravel(),
                "fitted": fitted[keep].ravel(),
            }
        )
        out["residual"] = out["value"] - out["fitted"]
        return out[columns]

    schema = f"{BY} string, series_id string, ts timestamp, value double, fitted double, residual double"
    return cut.groupBy(BY, "pblk").cogroup(blocks.groupBy(BY, "pblk")).applyInPandas(evaluate, schema)


def decompose(coef: np.ndarray, sigma: np.ndarray, k: int, lag: int, horizon: int, identification: str) -> np.ndarray:
    """Forecast-error variance shares in percent; rows (explained variables) sum to 100."""
    a = [coef[1 + i * k : 1 + (i + 1) * k].T for i in range(lag)]
    psi = [np.eye(k)]
    for h in range(1, horizon):
        psi.append(sum(a[i] @ psi[h - 1 - i] for i in range(min(lag, h))))
    if identification == "cholesky":
        impact, weight = np.linalg.cholesky(sigma), np.ones(k)
    elif identification == "generalized":
        impact, weight = sigma, 1.0 / np.diag(sigma)
    else:
        raise ValueError("identification must be 'cholesky' or 'generalized'")
    top = sum((m @ impact) ** 2 for m in psi) * weight
    bottom = sum(np.diag(m @ sigma @ m.T) for m in psi)
    theta = top / bottom[:, None]
    return theta / theta.sum(axis=1, keepdims=True) * 100


def fevd(models: DataFrame, horizon: int = 10, identification: str = "generalized") -> DataFrame:
    """Long decomposition ``(panel_id, row_id, col_id, value)``: share of row explained by shocks to col."""

    def expand(batches):
        for pdf in batches:
            out = []
            for m in pdf.itertuples(index=False):
                names = list(m.names)
                k = len(names)
                theta = decompose(
                    np.asarray(m.coef, dtype=float).reshape(-1, k),
                    np.asarray(m.sigma, dtype=float).reshape(k, k),
                    k,
                    int(m.lag),
                    horizon,
                    identification,
                )
                out.append(
                    pd.DataFrame({BY: m.panel_id, "row_id": np.repeat(names, k), "col_id": np.tile(names, k), "value": theta.ravel()})
                )
            if out:
                yield pd.concat(out, ignore_index=True)

    ready = models.filter(F.col("coef").isNotNull())
    return ready.mapInPandas(expand, f"{BY} string, row_id string, col_id string, value double")


def spillover(
    panel: DataFrame,
    method: str = "diebold_yilmaz",
    horizon: int = 10,
    max_lags: int = 5,
    identification: str = "generalized",
    volatility: DataFrame | None = None,
    width: int = DEFAULT_WIDTH,
) -> dict[str, DataFrame]:
    """Spillover tables: model, table, total, directional (with net) and pairwise.

    With a column ``panel_id`` every panel has a model and tables of its own, and all tables carry it.
    ``method='garch_spillover'`` uses conditional volatilities instead of returns when given.
    """
    source = volatility if method == "garch_spillover" and volatility is not None else panel
    models = stage(var_fit(prepared(source, width), max_lags), "var")
    by = [BY] if BY in source.columns else []
    table = fevd(models, horizon, identification).select(*by, "row_id", "col_id", "value")
    return {
        "model": models,
        "table": table,
        "total": matrices.total_spillover(table),
        "directional": matrices.directional(table),
        "pairwise": matrices.pairwise(table),
    }


def rolling_spillover(
    panel: DataFrame,
    window_size: int = 100,
    horizon: int = 10,
    step: int = 1,
    lag: int = 1,
    identification: str = "generalized",
    width: int = DEFAULT_WIDTH,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Spillover of every window of ``window_size`` dates: ``(panel_id, ts, series_id, total, from_others, to_others, net, status)``.

    ``ts`` is the last date of the window. A window that cannot be solved has NaN in all measures and the status
    ``degenerate``, or ``short`` if it has too few dates for its coefficients. Position blocks carry ``window_size - 1``
    earlier dates and run in parallel. Inside a block the Gram matrix of a window is that of the window before plus the row that comes and less
    the row that goes, so a longer window costs no more; many windows are solved at once.
    """
    rows = prepared(panel, width).select(BY, "series_id", "ts", "pos", "value")
    cut = halo_blocks(rows, max(size, window_size - 1), window_size - 1)
    measures = ["total", "from_others", "to_others", "net"]
    columns = [BY, "ts", "series_id", *measures, "status"]

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["is_halo"].all():
            return pd.DataFrame([], columns=columns)
        wide = pdf.pivot(index="pos", columns="series_id", values="value").sort_index()
        when = pdf.drop_duplicates("pos").set_index("pos")["ts"]
        names, y, pos = list(wide.columns), wide.to_numpy(float), wide.index.to_numpy()
        y = y - y.mean(axis=0)
        k, n_rows = len(names), window_size - lag
        z = np.ones((max(len(y) - lag, 0), 1 + k * (lag + 1)))
        for i in range(lag + 1):
            z[:, 1 + i * k : 1 + (i + 1) * k] = y[lag - i : len(y) - i]
        first = int(pdf.loc[~pdf["is_halo"], "pos"].min())
        ends = np.flatnonzero((pos >= max(first, window_size)) & ((pos - window_size) % step == 0))
        long_enough = n_rows > k * lag + 1
        out = []
        at_once = max(1, 4_000_000 // z.shape[1] ** 2)
        gram, last = None, None
        for i in range(0, len(ends), at_once):
            part, grams = ends[i : i + at_once], []
            for end in part if long_enough else ():
                if gram is None:
                    own = z[end - window_size + 1 : end + 1 - lag]
                    gram = own.T @ own
                else:
                    come, go = z[last + 1 - lag : end + 1 - lag], z[last - window_size + 1 : end - window_size + 1]
                    gram = gram + come.T @ come - go.T @ go
                last = end
                grams.append(gram)
            theta = window_shares(np.stack(grams), k, lag, n_rows - k * lag - 1, horizon, identification) if grams else np.full((len(part), k, k), np.nan)
            own = np.einsum("wii->wi", theta)
            got, given = theta.sum(axis=2) - own, theta.sum(axis=1) - own
            total = got.sum(axis=1) / theta.sum(axis=(1, 2)) * 100
            status = np.where(np.isfinite(total), "ok", "degenerate" if long_enough else "short")
            out.append(
                pd.DataFrame(
                    {
                        BY: pdf[BY].iloc[0],
                        "ts": np.repeat(when.loc[pos[part]].to_numpy(), k),
                        "series_id": np.tile(np.asarray(names, dtype=object), len(part)),
                        "total": np.repeat(total, k),
                        "from_others": got.ravel(),
                        "to_others": given.ravel(),
                        "net": (given - got).ravel(),
                        "status": np.repeat(status, k),
                    }
                )
            )
        return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame([], columns=columns)

    schema = f"{BY} string, ts timestamp, series_id string, total double, from_others double, to_others double, net double, status string"
    return cut.groupBy(BY, "pblk").applyInPandas(evaluate, schema)


def window_shares(grams: np.ndarray, k: int, lag: int, dof: int, horizon: int, identification: str) -> np.ndarray:
    """``decompose`` for a stack of Gram matrices of ``[1, y_t, y_{t-1}, ..]`` at once; NaN where one is singular."""
    x = [0] + list(range(1 + k, 1 + k * (lag + 1)))
    a, b, c = grams[:, x][:, :, x], grams[:, x, 1 : 1 + k], grams[:, 1 : 1 + k, 1 : 1 + k]
    with np.errstate(all="ignore"):
        scale = np.sqrt(np.einsum("wii->wi", a))
        unit = a / (scale[:, :, None] * scale[:, None, :])
        good = np.isfinite(unit).all(axis=(1, 2))
        unit[~good] = np.eye(len(x))
        good &= np.linalg.cond(unit) <= 1e12
        unit[~good] = np.eye(len(x))
        coef = np.linalg.solve(unit, b / scale[:, :, None]) / scale[:, :, None]
        sigma = (c - coef.transpose(0, 2, 1) @ b) / dof
        turns = [coef[:, 1 + i * k : 1 + (i + 1) * k].transpose(0, 2, 1) for i in range(lag)]
        psi = [np.broadcast_to(np.eye(k), sigma.shape)]
        for h in range(1, horizon):
            psi.append(sum(turns[i] @ psi[h - 1 - i] for i in range(min(lag, h))))
        if identification == "cholesky":
            good &= np.isfinite(sigma).all(axis=(1, 2)) & (np.linalg.eigvalsh(np.where(np.isfinite(sigma), sigma, 0.0)).min(axis=1) > 0)
            sigma = np.where(good[:, None, None], sigma, np.eye(k))
            impact, weight = np.linalg.cholesky(sigma), np.ones((len(sigma), 1, k))
        elif identification == "generalized":
            impact, weight = sigma, 1.0 / np.einsum("wii->wi", sigma)[:, None, :]
        else:
            raise ValueError("identification must be 'cholesky' or 'generalized'")
        top = sum((m @ impact) ** 2 for m in psi) * weight
        bottom = sum(np.einsum("wij,wjk,wik->wi", m, sigma, m) for m in psi)
        theta = top / bottom[:, :, None]
        theta = theta / theta.sum(axis=2, keepdims=True) * 100
    return np.where(good[:, None, None], theta, np.nan)


def granger(rows: DataFrame, max_lag: int = 5, alpha: float = 0.05) -> DataFrame:
    """Causality F-tests of every ordered pair and lag 1..max_lag, from ``prepared`` rows.

    Each pair needs a dozen short arrays whatever the series length. All pairs of a batch are solved together: one
    factorisation for each lag and direction gives the residuals without and with the other series.
    """
    cross = stage(cross_products(rows, max_lag, BY), "cross")
    edges = series_edges(rows, max_lag, BY)
    own = cross.filter(F.col("a") == F.col("b")).select(BY, F.col("a").alias("series_id"), F.col("prod").alias("own"))
    side = edges.join(own, [BY, "series_id"])

    def named(tag: str) -> DataFrame:
        return side.select(BY, F.col("series_id").alias(tag), F.struct("s", "head", "tail", "own").alias(f"f_{tag}"), F.col("n").alias(f"n_{tag}"))

    back = cross.select(BY, F.col("b").alias("a"), F.col("a").alias("b"), F.col("prod").alias("ba"))
    pairs = (
        cross.filter(F.col("a") < F.col("b"))
        .withColumnRenamed("prod", "ab")
        .join(back, [BY, "a", "b"])
        .join(named("a"), [BY, "a"])
        .join(named("b"), [BY, "b"])
        .drop("n_b")
    )

    def test(batches):
        for pdf in batches:
            n = pdf["n_a"].to_numpy()
            whole = np.flatnonzero(n >= 3 * max_lag)
            stats = {effect: np.full((len(pdf), max_lag), np.nan) for effect in (0, 1)}
            if len(whole):
                part, size = pdf.iloc[whole], n[whole].astype(float)
                of = lambda col, key: np.stack([np.asarray(v[key], dtype=float) for v in part[col]])
                ab, ba = (np.stack([np.asarray(v, dtype=float) for v in part[c]]) for c in ("ab", "ba"))
                prod = np.stack([of("f_a", "own"), ab, ba, of("f_b", "own")], axis=-1).reshape(len(whole), max_lag + 1, 2, 2)
                s, head, tail = (np.stack([of("f_a", c), of("f_b", c)], axis=-1) for c in ("s", "head", "tail"))
                for lag in range(1, max_lag + 1):
                    g = lag_grams(prod, s, head, tail, size, lag)
                    dof = size - 3 * lag - 1
                    for effect in (0, 1):
                        mine = [1 + 2 * i + effect for i in range(1, lag + 1)]
                        other = [1 + 2 * i + 1 - effect for i in range(1, lag + 1)]
                        order = [0, *mine, *other, 1 + effect]
                        left = nested_residuals(g[:, order][:, :, order])
                        small, big = left[:, 1 + lag], left[:, 1 + 2 * lag]
                        with np.errstate(all="ignore"):
                            f = (small - big) / lag / (big / dof)
                        stats[effect][whole, lag - 1] = np.where((dof > 0) & (big > 0), np.maximum(f, 0), np.nan)
            both = [(r, e) for e in (1, 0) for r in range(len(pdf))]
            first, second = pdf["a"].tolist(), pdf["b"].tolist()
            out = [(pdf[BY].iloc[r], first[r] if e else second[r], second[r] if e else first[r], int(n[r]), stats[e][r]) for r, e in both]
            res = pd.DataFrame(out, columns=[BY, "source", "target", "n_obs", "f_stats"])
            if len(res):
                f = np.stack(res["f_stats"].to_numpy())
                lags = np.arange(1, max_lag + 1)[None, :]
                p = f_sf(f, lags, res["n_obs"].to_numpy()[:, None] - 3 * lags - 1)
                res["f_stats"] = [[None if not np.isfinite(v) else float(v) for v in x] for x in f]
                res["p_values"] = [[None if not np.isfinite(v) else float(v) for v in x] for x in p]
                yield res

    schema = f"{BY} string, source string, target string, n_obs long, f_stats array<double>, p_values array<double>"
    tested = pairs.mapInPandas(test, schema)
    low = F.array_min("p_values")

    def optimal(level: float):
        return F.when(low < level, F.array_position("p_values", low).cast("int"))

    return tested.select(
        "*",
        low.alias("min_p_value"),
        F.coalesce(low < 0.01, F.lit(False)).alias("causality_1pct"),
        F.coalesce(low < 0.05, F.lit(False)).alias("causality_5pct"),
        optimal(alpha).alias("optimal_lag"),
        optimal(0.01).alias("optimal_lag_1pct"),
        optimal(0.05).alias("optimal_lag_5pct"),
        F.concat("source", F.lit("->"), "target").alias("pair"),
    )


def granger_long(tests: DataFrame) -> DataFrame:
    """One row per pair and lag."""
    zipped = F.arrays_zip("f_stats", "p_values")
    return tests.select(BY, "source", "target", "n_obs", F.posexplode(zipped).alias("i", "v")).select(
        BY, "source", "target", "n_obs", (F.col("i") + 1).alias("lag"), F.col("v.f_stats").alias("f_stat"), F.col("v.p_values").alias("p_value")
    )
