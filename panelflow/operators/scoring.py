"""Maximum likelihood and least squares by scoring over blocks of rows, for series of any length.

Both GARCH variances and moving-average errors are linear recursions y_t = a_1 y_{t-1} + .. + a_m y_{t-m} + x_t
whose inputs and coefficients depend on the parameters. The derivatives of y follow the same recursion with
inputs of their own, so scores are exact and need no extra evaluations.

A series is cut into blocks of rows, one table row each. In a round every block returns the objective, its
score and an information matrix at the trial parameters; the sums over the blocks of a series give its next
trial. Parameters, damping and the last sums live in a staged table, one row per series, and steps are taken
by tasks; the driver only asks whether any series is still moving. A series of a single block goes through the
same rounds inside the task that holds the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.operators.blocks import DEFAULT_WIDTH, attach, halo_blocks, lagged
from panelflow.operators.recursion import companion_power, run
from panelflow.plans.staging import stage

#: Rows of a block.
BLOCK = 32_768
ROUNDS = 100
#: Relative gain below which a step does not count.
TINY = 1e-10


class Model(Protocol):
    """What the rounds need to know about a model with ``k`` free parameters and ``m`` lags in its recursion."""

    k: int
    m: int
    #: Gains are relative to the objective plus this: 1 for a log-likelihood, 0 for a sum of squares.
    floor: float

    def inputs(self, u, y, past, first, extra):
        """``x, dx, a, da, s0``: inputs (n), their slopes (n, k), coefficients (m), their slopes (m, k), state before the first row."""

    def sums(self, u, y, path, slopes, first, extra) -> np.ndarray:
        """Objective to be raised, its score (k) and an information matrix (k * k) of a block."""


def pack(panel: DataFrame, lags: int, extras: dict[str, Column], width: int = DEFAULT_WIDTH, size: int = BLOCK) -> DataFrame:
    """One row per block: ``series_id, blk, n, mean, first, past, y`` and the aggregates ``extras``.

    ``y`` has the values of rows ``first``, ``first`` + 1, .. of the series, ``past`` the ``lags`` values before
    them; ``n`` and ``mean`` belong to the whole series. ``extras`` are aggregates over ``pos``, ``value`` and
    ``mean`` of the block's own rows, null elsewhere.
    """
    size = max(size, lags, 1)
    rows = halo_blocks(lagged(panel.select("series_id", "ts", "value"), [], width), size, lags)
    own = ~F.col("is_halo")
    rows = rows.select("series_id", F.col("pblk").alias("blk"), "n", "mean", "is_halo", F.col("pos").alias("at"), F.col("value").alias("v"),
                       F.when(own, F.col("pos")).alias("pos"), F.when(own, F.col("value")).alias("value"))
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", "v")))), lambda s: s["v"])
    blocks = rows.groupBy("series_id", "blk").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.min("pos").alias("first"), listed(F.col("is_halo")).alias("past"), listed(own).alias("y"),
        *[c.alias(name) for name, c in extras.items()],
    )
    # The last block of a series has no successor for its copies.
    return blocks.filter("first is not null")


class Climb:
    """State of one ascent: place, trial place, and objective, score and information at the place."""

    def __init__(self, vector: np.ndarray, k: int):
        self.best, self.damp, self.done, self.rounds = vector[:4]
        self.u, self.trial, self.score = vector[4 : 4 + k], vector[4 + k : 4 + 2 * k], vector[4 + 2 * k : 4 + 3 * k]
        self.info, self.k = vector[4 + 3 * k :].reshape(k, k), k

    @classmethod
    def start(cls, u: np.ndarray) -> np.ndarray:
        k = len(u)
        return np.concatenate([[-np.inf, 1e-3, 0, 0], u, u, np.zeros(k + k * k)])

    def advance(self, sums: np.ndarray, floor: float) -> np.ndarray:
        """Take the sums at the trial place and set the next one (Levenberg-Marquardt); returns the new state."""
        k, value = self.k, sums[0]
        self.rounds += 1
        if np.isfinite(sums).all() and value > self.best:
            gain = (value - self.best) / max(floor + min(abs(value), abs(self.best)), 1e-300)
            self.u, self.best, self.score, self.info = self.trial, value, sums[1 : 1 + k], sums[1 + k :].reshape(k, k)
            # Two gains in a row that do not count, or a model without parameters.
            self.done = 1.0 if k == 0 else min(self.done + 0.5, 1.0) if gain < TINY else 0.0
            self.damp = max(self.damp / 10, 1e-12)
        else:
            self.damp *= 10
            # No step raises the objective any more, or the start itself is undefined.
            if self.damp > 1e8 or not np.isfinite(self.best):
                self.done = 1.0
        if self.done < 1:
            h = self.info + self.damp * np.diag(np.maximum(np.diag(self.info), 1e-12))
            step = np.linalg.lstsq(h, self.score, rcond=None)[0]
            self.trial = self.u + step
            if abs(self.score @ step) < TINY / 100 * (floor + abs(self.best)):
                self.done = 1.0
        return self.vector()

    def vector(self) -> np.ndarray:
        return np.concatenate([[self.best, self.damp, self.done, self.rounds], self.u, self.trial, self.score, self.info.ravel()])


def _paths(model: Model, u, y, past, first, extra, state=None):
    """Path of the recursion and its slopes; ``state`` has the values before the block and their slopes (m, 1 + k)."""
    x, dx, a, da, s0 = model.inputs(u, y, past, first, extra)
    k, m = model.k, model.m
    if not m:
        return x, dx
    if state is None:
        state = np.column_stack([s0, np.zeros((m, k))])
    path = run(x, a, state[:, 0])
    before = np.concatenate([state[::-1, 0], path])
    slopes = np.empty((len(x), k))
    for i in range(k):
        own = dx[:, i]
        for j in np.flatnonzero(da[:, i]).tolist():
            own = own + da[j, i] * before[m - 1 - j : len(before) - 1 - j]
        slopes[:, i] = run(own, a, state[:, 1 + i])
    return path, slopes


def _turn(model: Model, u, n: int, a, da) -> tuple[np.ndarray, np.ndarray]:
    """What ``n`` rows without input do to a state (m, m), and the slopes of that (k, m, m)."""
    m, k = model.m, model.k
    c = companion_power(a, 1)
    slopes = np.zeros((k, m, m))
    for i in range(k):
        e = np.zeros((m, m))
        e[0] = da[:, i]
        if e.any():
            both = np.block([[c, e], [np.zeros((m, m)), c]])
            slopes[i] = np.linalg.matrix_power(both, n)[:m, m:]
    return np.linalg.matrix_power(c, n), slopes


def block_sums(model: Model, u, y, past, first, extra, state=None) -> np.ndarray:
    with np.errstate(all="ignore"):
        path, slopes = _paths(model, u, y, past, first, extra, state)
        return model.sums(u, y, path, slopes, first, extra)


def _floats(x) -> np.ndarray:
    return np.asarray(x, dtype=float)


def _points(row_points) -> list[np.ndarray]:
    return [_floats(p) for p in row_points]


def evaluate(blocks: DataFrame, points: DataFrame, model: Model) -> DataFrame:
    """``series_id, sums``: at each of a series' ``points``, the sums over all its blocks.

    ``points`` has ``series_id, extra array<double>, points array<array<double>>``. Two passes over the blocks: one
    finds what each does to a state, the other uses the true state before each. Between them, the states of a series are
    folded over its blocks, a few numbers each.
    """
    k, m = model.k, model.m
    spread = blocks.select("series_id", "blk").join(points, "series_id")
    ready = blocks.select("series_id", "blk", "first", "past", "y").join(spread, ["series_id", "blk"])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                y, past, extra, own = _floats(r.y), _floats(r.past), _floats(r.extra), []
                for u in _points(r.points):
                    _, _, a, da, s0 = model.inputs(u, y, past, r.first, extra)
                    with np.errstate(all="ignore"):
                        path, slopes = _paths(model, u, y, past, r.first, extra, np.zeros((m, 1 + k)))
                        turn, bend = _turn(model, u, len(y), a, da)
                    end = np.column_stack([path, slopes])[::-1][:m]
                    end = np.concatenate([end, np.zeros((m - len(end), 1 + k))])
                    own.append(np.concatenate([s0, end.ravel(), turn.ravel(), bend.ravel()]))
                out.append((r.series_id, r.blk, np.concatenate(own)))
            yield pd.DataFrame(out, columns=["series_id", "blk", "w"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", ignore_index=True)
        size = m + m * (1 + k) + m * m + k * m * m
        w = np.stack([_floats(v) for v in pdf["w"]]).reshape(len(pdf), -1, size)
        cuts = np.cumsum([m, m * (1 + k), m * m])
        states = np.empty((len(pdf), w.shape[1], m, 1 + k))
        for c in range(w.shape[1]):
            state = np.column_stack([w[0, c, :m], np.zeros((m, k))])
            for b in range(len(pdf)):
                states[b, c] = state
                _, end, turn, bend = np.split(w[b, c], cuts)
                turn, bend = turn.reshape(m, m), bend.reshape(k, m, m)
                moved = turn @ state
                moved[:, 1:] += (bend @ state[:, 0]).T
                state = moved + end.reshape(m, 1 + k)
        return pd.DataFrame({"series_id": pdf["series_id"], "blk": pdf["blk"], "at": list(states.reshape(len(pdf), -1))})

    if m:
        summary = ready.mapInPandas(ends, "series_id string, blk long, w array<double>")
        starts = summary.groupBy("series_id").applyInPandas(fold, "series_id string, blk long, at array<double>")
        ready = attach(ready, starts)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                at = _points(r.points)
                states = _floats(r.at).reshape(len(at), m, 1 + k) if m else [None] * len(at)
                own = [block_sums(model, u, _floats(r.y), _floats(r.past), r.first, _floats(r.extra), s) for u, s in zip(at, states)]
                out.append((r.series_id, np.concatenate(own)))
            yield pd.DataFrame(out, columns=["series_id", "s"])

    parts = ready.mapInPandas(totals, "series_id string, s array<double>").select("series_id", F.posexplode("s").alias("i", "v"))
    added = parts.groupBy("series_id", "i").agg(F.sum("v").alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return added.groupBy("series_id").agg(listed.alias("sums"))


def fit(
    blocks: DataFrame, table: DataFrame, model: Model, finish: Callable, schema: str, error_model: Model | None = None, errors_at: Callable | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """Fit every series of staged ``blocks`` and return the rows of ``finish``.

    ``table`` has one row per series: ``series_id``, the arrays ``extra`` and ``climbs`` (one start vector of ``Climb`` for each
    start; none if the series cannot be fitted), and whatever ``finish`` needs. ``finish(row, climb, sums)`` makes a row of
    the result; ``climb`` is None without a fit. ``sums`` are those of ``error_model`` at the points ``errors_at(climb)``.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    k, width = model.k, 1 + model.k + model.k * model.k

    def best_of(climbs) -> Climb | None:
        found = [Climb(_floats(c), k) for c in climbs]
        found = [c for c in found if np.isfinite(c.best)]
        return max(found, key=lambda c: c.best) if found else None

    # One block: all rounds inside the task.
    single = blocks.groupBy("series_id").agg(F.count(F.lit(1)).alias("_blocks"))
    table = stage(table.join(single, "series_id"), "climbs")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                y, past, extra, climbs = _floats(r.y), _floats(r.past), _floats(r.extra), []
                for vector in _points(r.climbs):
                    climb = Climb(vector, k)
                    while climb.done < 1 and climb.rounds < rounds:
                        climb.advance(block_sums(model, climb.trial, y, past, r.first, extra), model.floor)
                    climbs.append(climb.vector())
                best = best_of(climbs)
                near = None if best is None or errors_at is None else [block_sums(error_model, x, y, past, r.first, extra) for x in errors_at(best)]
                out.append(finish(r, best, near))
            yield pd.DataFrame(out, columns=names).astype(object)

    short = table.filter("_blocks = 1").join(blocks.select("series_id", "first", "past", "y"), "series_id")
    fitted = short.mapInPandas(whole, schema)
    state = table.filter("_blocks > 1")
    if state.isEmpty():
        return fitted

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for climbs, sums in zip(pdf["climbs"], pdf["sums"]):
                moved = []
                for i, vector in enumerate(_points(climbs)):
                    climb = Climb(vector, k)
                    moved.append(vector if climb.done == 1 or sums is None else climb.advance(_floats(sums)[i * width : (i + 1) * width], model.floor))
                out.append(moved)
            pdf = pdf.drop(columns=["climbs", "sums"])
            pdf["climbs"] = out
            yield pdf

    others = [f for f in state.schema if f.name != "climbs"]
    stepped = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", climbs array<array<double>>"
    spread = blocks.select("series_id", "blk").join(state.select("series_id"), "series_id")
    rest = stage(blocks.join(spread, ["series_id", "blk"], "left_semi"), "long-blocks")
    moving = F.exists("climbs", lambda c: c[2] < 1)
    for _ in range(rounds):
        trial = F.transform("climbs", lambda c: F.slice(c, 5 + k, k))
        sums = evaluate(rest, state.filter(moving).select("series_id", "extra", trial.alias("points")), model)
        state = stage(state.join(sums, "series_id", "left").mapInPandas(step, stepped), "climbs")
        if state.filter(moving).isEmpty():
            break

    def closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                best, sums = best_of(r.climbs), getattr(r, "sums", None)
                out.append(finish(r, best, None if best is None or sums is None else list(_floats(sums).reshape(-1, width))))
            yield pd.DataFrame(out, columns=names).astype(object)

    if errors_at is None:
        return fitted.unionByName(state.mapInPandas(closed, schema))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = [best_of(c) for c in pdf["climbs"]]
            pdf = pdf[["series_id", "extra"]].assign(points=[errors_at(b) if b is not None else [] for b in best])
            yield pdf[pdf["points"].map(len) > 0]

    at = state.mapInPandas(near, "series_id string, extra array<double>, points array<array<double>>")
    sums = evaluate(rest, stage(at, "near"), error_model)
    return fitted.unionByName(state.join(sums, "series_id", "left").mapInPandas(closed, schema))
