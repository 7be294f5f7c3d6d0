"""Augmented Dickey-Fuller test for many series at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.distributions import dickey_fuller_p
from panelflow.functions.scalar import adf_critical_values, is_stationary
from panelflow.operators.blocks import DEFAULT_WIDTH
from panelflow.operators.moments import deep_moments, lag_gram, nested_residuals, regress
from panelflow.operators.scoring import BLOCK


def level_gram(row, lags: int) -> np.ndarray:
    """Gram matrix of one ``lag_moments`` row."""
    prod = [np.array([[p]]) for p in row.prod[: lags + 1]]
    head, tail = np.asarray(row.head, dtype=float)[:, None], np.asarray(row.tail, dtype=float)[:, None]
    return lag_gram(prod, np.array([row.s]), head, tail, int(row.n), lags)


def _adf_gram(g: np.ndarray, lags: int) -> np.ndarray:
    """Change variables from levels to ``[dy_t, 1, y_{t-1}, dy_{t-1}, .., dy_{t-lags}]``."""
    r = np.zeros((lags + 3, lags + 3))
    r[0, 1], r[0, 2] = 1, -1
    r[1, 0] = 1
    r[2, 2] = 1
    for i in range(1, lags + 1):
        r[2 + i, 1 + i], r[2 + i, 2 + i] = 1, -1
    return r @ g @ r.T


def _adf_at(row, lags: int):
    if row.n - lags - 1 <= lags + 2:
        return None
    g = _adf_gram(level_gram(row, lags + 1), lags)
    x = list(range(1, lags + 3))
    fit = regress(g, 0, x)
    t = int(row.n) - lags - 1
    if fit is None or fit[1] <= 1e-12 * max(g[0, 0], 1e-300):
        return None
    beta, ssr, inverse = fit
    return beta[1] / np.sqrt(ssr / (t - len(x)) * inverse[1, 1]), t


def _best_lag(row, most: int):
    """Lag with the smallest AIC on the sample that the longest lag allows: one factorisation serves all lags."""
    full = _adf_gram(level_gram(row, most + 1), most)
    t = int(row.n) - most - 1
    ssr = nested_residuals(np.roll(full, (-1, -1), (0, 1)))[2:]
    with np.errstate(all="ignore"):
        aic = np.where(ssr > 0, t * (np.log(2 * np.pi * ssr / t) + 1) + 2 * (np.arange(most + 1) + 2), np.inf)
    aic[~np.isfinite(aic)] = np.inf
    best = 0
    for lags in range(1, most + 1):
        if aic[lags] < aic[best] - 1e-12:
            best = lags
    return best


def _schwert(n: int) -> int:
    return int(12 * (n / 100) ** 0.25)


def _longest_lag(present: DataFrame, max_lag: int | None) -> int:
    """Lags that the search of the longest series may reach."""
    n = present.groupBy("series_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    most = _schwert(n)
    return most if max_lag is None else min(most, max_lag)


def adf_test(
    panel: DataFrame, lags: int | str = "aic", threshold: float = 0.05, max_lag: int | None = None, width: int = DEFAULT_WIDTH, block: int = BLOCK
) -> DataFrame:
    """Test with a constant. ``lags`` is a number or ``aic`` (best of 0..floor(12 (n/100)^(1/4)), or of
    0..``max_lag`` where that is given and smaller). The length of a series decides how many of its lag products are
    gathered; the greatest length takes one count. Series that cannot be tested get nulls and a ``status``."""
    present = panel.filter(F.col("value").isNotNull())
    depth = (_longest_lag(present, max_lag) if lags == "aic" else int(lags)) + 1
    stats = deep_moments(present, (lambda n: _schwert(n) + 1) if lags == "aic" else (lambda n: depth), depth, width, block)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n = int(row.n)
                used, found = 0, None
                if lags == "aic":
                    most = max(min(depth - 1, _schwert(n), (n - 1) // 2 - 2), 0)
                    used = _best_lag(row, most) if n > 4 else 0
                else:
                    used = int(lags)
                found = _adf_at(row, used) if n > 4 else None
                if found is None:
                    out.append((row.series_id, None, None, used, None, "short" if n <= 4 else "degenerate"))
                else:
                    tau, t = found
                    out.append((row.series_id, tau, float(dickey_fuller_p(tau)), used, t, "ok"))
            yield pd.DataFrame(out, columns=["series_id", "adf_statistic", "p_value", "used_lag", "n_obs", "status"])

    schema = "series_id string, adf_statistic double, p_value double, used_lag int, n_obs long, status string"
    tested = stats.mapInPandas(solve, schema)
    crit = adf_critical_values(F.col("n_obs").cast("double"))
    return tested.select(
        "series_id",
        "adf_statistic",
        "p_value",
        "used_lag",
        "n_obs",
        *[c.alias(k) for k, c in crit.items()],
        is_stationary(F.col("p_value"), threshold).alias("is_stationary"),
        "status",
    )
