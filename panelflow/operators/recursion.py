"""Linear recursions y_t = a_1 y_{t-1} + .. + a_m y_{t-m} + x_t over long series.

A block's last m outputs are an affine function of the m outputs before the block, so blocks are
reduced to (row count, zero-start response) in parallel, start states are folded over the block
summaries, and each block is then run once from its true start state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.operators.blocks import DEFAULT_WIDTH, attach, with_block
from panelflow.plans.staging import stage


#: Rows that one matrix product advances.
CHUNK = 64


def run(x: np.ndarray, coef: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Outputs for inputs ``x``; ``state`` holds the latest previous output first.

    One lag: partial sums over 1, 2, 4, .. rows until the weight vanishes. More lags: chunks are
    multiplied with the matrix of impulse responses at once, and only their end states are chained.
    Growing inputs go row by row. From the first undefined input on, all outputs are undefined, wherever blocks
    begin and however small the weights have become.
    """
    if not len(x):
        return np.empty(0)
    wrong = ~np.isfinite(x)
    if wrong.any() or not np.isfinite(state).all():
        out = np.full(len(x), np.nan)
        if np.isfinite(state).all():
            first = int(wrong.argmax())
            out[:first] = run(x[:first], coef, state)
        return out
    if len(coef) == 1 and abs(coef[0]) <= 1:
        y, weight, step = np.array(x, dtype=float), float(coef[0]), 1
        y[0] += weight * state[0]
        while step < len(y) and weight != 0:
            y[step:] += weight * y[:-step]
            weight, step = weight * weight, 2 * step
        return y
    m = len(coef)
    if m == 1 or m > CHUNK or len(x) < 2 * CHUNK:
        return _by_row(x, coef, state)
    powers = companion_power(coef, 1)[None]
    while len(powers) < CHUNK:
        powers = np.concatenate([powers, powers @ powers[-1]])
    free = powers[:, 0]
    impulse = np.r_[1.0, free[:-1, 0]]
    if not np.abs(free).max() < 1e6:
        return _by_row(x, coef, state)
    at = np.subtract.outer(np.arange(CHUNK), np.arange(CHUNK))
    response = np.where(at >= 0, impulse[at], 0.0)
    chunks = -(-len(x) // CHUNK)
    base = np.concatenate([x, np.zeros(chunks * CHUNK - len(x))]).reshape(chunks, CHUNK) @ response.T
    ends, turn = base[:, : -m - 1 : -1], free[: -m - 1 : -1]
    states = np.empty((chunks, m))
    now = np.asarray(state, dtype=float)
    for i in range(chunks):
        states[i] = now
        now = ends[i] + turn @ now
    return (base + states @ free.T).ravel()[: len(x)]


def _by_row(x: np.ndarray, coef: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    past = list(map(float, state))
    coef = list(map(float, coef))
    for i, v in enumerate(x.tolist()):
        y = v + sum(c * p for c, p in zip(coef, past))
        out[i] = y
        past = [y, *past[:-1]]
    return out


def last_state(y: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Latest-first state after a block, reaching into the earlier state for short blocks."""
    m = len(before)
    return np.concatenate([y[::-1], before])[:m]


def companion_power(coef: np.ndarray, n: int) -> np.ndarray:
    m = len(coef)
    c = np.zeros((m, m))
    c[0] = coef
    c[1:, :-1] = np.eye(m - 1)
    return np.linalg.matrix_power(c, n)


def linear_recursion(rows: DataFrame, channels: dict[str, tuple[str, str]], coef: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add one output column per channel: ``{out: (input column, initial state column)}``.

    ``coef`` and the initial states are array columns that are constant within a series, all of the
    same length m; a state lists the latest value first.
    """
    # Both passes over the rows read this table, so the work before it is done once.
    blocked = stage(with_block(rows, width), "recursion")
    key = ["series_id", "blk"]
    names = list(channels)

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        a = np.asarray(pdf[coef].iloc[0], dtype=float)
        zero = np.zeros(len(a))
        out = {"series_id": pdf["series_id"].iloc[0], "blk": pdf["blk"].iloc[0], "n": len(pdf), coef: a}
        for c in names:
            x, init = channels[c]
            out[f"_v_{c}"] = last_state(run(pdf[x].to_numpy(float), a, zero), zero)
            out[f"_s_{c}"] = np.asarray(pdf[init].iloc[0], dtype=float)
        return pd.DataFrame({k: [v] for k, v in out.items()})

    arrays = ", ".join(f"_v_{c} array<double>, _s_{c} array<double>" for c in names)
    inputs = [x for x, _ in channels.values()] + [i for _, i in channels.values()]
    needed = list(dict.fromkeys([*key, "ts", coef, *inputs]))
    summary = (
        blocked.select(*needed)
        .groupBy(*key)
        .applyInPandas(summarize, f"series_id string, blk long, n long, {coef} array<double>, {arrays}")
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk").reset_index(drop=True)
        a = np.asarray(pdf[coef].iloc[0], dtype=float)
        out = {"series_id": pdf["series_id"], "blk": pdf["blk"]}
        powers = {n: companion_power(a, int(n)) for n in pdf["n"].unique()}
        for c in names:
            state = np.asarray(pdf[f"_s_{c}"].iloc[0], dtype=float)
            starts = []
            for n, v in zip(pdf["n"], pdf[f"_v_{c}"]):
                starts.append(state)
                state = powers[n] @ state + np.asarray(v, dtype=float)
            out[f"_at_{c}"] = starts
        return pd.DataFrame(out)

    starts_schema = "series_id string, blk long, " + ", ".join(f"_at_{c} array<double>" for c in names)
    starts = summary.groupBy("series_id").applyInPandas(fold, starts_schema)
    ready = attach(blocked, starts)
    schema = T.StructType(list(rows.schema.fields) + [T.StructField(c, T.DoubleType()) for c in names])

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        a = np.asarray(pdf[coef].iloc[0], dtype=float)
        for c in names:
            x, _ = channels[c]
            pdf[c] = run(pdf[x].to_numpy(float), a, np.asarray(pdf[f"_at_{c}"].iloc[0], dtype=float))
        return pdf[schema.fieldNames()]

    return ready.groupBy(*key).applyInPandas(evaluate, schema)


def ewma(panel: DataFrame, lam: float = 0.95, start: float = 0.0, width: int = DEFAULT_WIDTH) -> DataFrame:
    """q_t = lam * q_{t-1} + (1 - lam) * x_t with q before the first row equal to ``start``."""
    rows = panel.select(
        "series_id",
        "ts",
        "value",
        (F.col("value") * (1 - lam)).alias("_x"),
        F.array(F.lit(float(lam))).alias("_a"),
        F.array(F.lit(float(start))).alias("_i"),
    )
    return linear_recursion(rows, {"ewma": ("_x", "_i")}, "_a", width).select("series_id", "ts", "value", "ewma")
