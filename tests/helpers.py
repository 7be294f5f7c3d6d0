"""Values and functions that several test modules share."""

import numpy as np

from panelflow.operators import garch
from panelflow.operators.recursion import run

DAY = 86_400


def frame(df):
    return df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)


def css_residuals(w: np.ndarray, beta: np.ndarray, p: int, q: int, has_const: bool) -> np.ndarray:
    """Errors with zero before the sample and zero for the first p rows."""
    c = int(has_const)
    x = w - (beta[0] if has_const else 0.0)
    for i in range(1, p + 1):
        x[i:] = x[i:] - beta[c + i - 1] * w[:-i]
    x[:p] = 0.0
    if q == 0:
        return x
    e = np.zeros(len(w))
    e[p:] = run(x[p:], -np.asarray(beta[c + p :]), np.zeros(q))
    return e


def variance_path(e: np.ndarray, omega, alpha, beta, start: float) -> np.ndarray:
    x = np.full(len(e), float(omega))
    e2 = e * e
    for i, a in enumerate(alpha, start=1):
        x[i:] += a * e2[:-i]
        x[:i] += a * start
    return run(x, np.asarray(beta, dtype=float), np.full(len(beta), start)) if len(beta) else x


def start_variance(values: np.ndarray, mean_model: str) -> float:
    e = (values - (values.mean() if mean_model == "constant" else 0.0))[:garch.BACKCAST_ROWS]
    w = garch.BACKCAST_DECAY ** np.arange(len(e))
    return float((w * e * e).sum() / w.sum())


def loglik(values: np.ndarray, theta, spec: garch.Spec, start: float) -> float:
    mu, omega, alpha, beta, nu, skew = spec.unpack(theta)
    e = values - mu
    s2 = variance_path(e, omega, alpha, beta, start)
    with np.errstate(all="ignore"):
        total = garch.log_density(e, s2, spec.dist, nu, skew).sum()
    return float(total) if np.isfinite(total) else -np.inf
