"""ARIMA by conditional sum of squares, one regression or one small solve per series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.distributions import two_sided_normal_p
from panelflow.functions.scalar import significance_label
from panelflow.operators import scoring
from panelflow.operators.blocks import DEFAULT_WIDTH, attach_series, lagged
from panelflow.operators.moments import lag_moments, regress
from panelflow.operators.recursion import linear_recursion
from panelflow.operators.stationarity import level_gram
from panelflow.operators.transform import difference
from panelflow.plans.staging import stage

Z95 = 1.959964
#: Share of a series' sum of squares below which errors are rounding noise: the fit is exact, not a model.
EXACT = 1e-20
MODEL_SCHEMA = (
    "series_id string, p int, d int, q int, const double, phi array<double>, theta array<double>, sigma2 double, "
    "n_eff long, k int, llf double, aic double, bic double, hqic double, se array<double>, status string"
)
_COLUMNS = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]


def fit_row(series_id, p, d, q, beta, se, sse, n_eff, status="ok"):
    """One model row. ``beta`` is ordered const (only when d = 0), phi, theta."""
    c = 1 if d == 0 else 0
    if beta is None or n_eff <= 0 or not sse > 0:
        return (series_id, p, d, q, None, None, None, None, n_eff, None, None, None, None, None, None, status if status != "ok" else "degenerate")
    k = len(beta) + 1
    sse = float(sse)
    sigma2 = sse / n_eff
    llf = -0.5 * n_eff * (math.log(2 * math.pi * sigma2) + 1)
    hqic = 2 * k * math.log(math.log(n_eff)) - 2 * llf if n_eff > 2 else None
    const = float(beta[0]) if c else 0.0
    return (
        series_id, p, d, q, const, list(map(float, beta[c : c + p])), list(map(float, beta[c + p :])), sigma2, n_eff, k,
        llf, 2 * k - 2 * llf, k * math.log(n_eff) - 2 * llf, hqic, list(map(float, se)), status,
    )


def _fit_ar(w: DataFrame, p: int, d: int, width: int) -> DataFrame:
    """q = 0: ordinary regression on own lags, from the lag cross-products (any series length)."""

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n = int(row.n)
                beta = se = sse = None
                if n - p > p + 2:
                    g = level_gram(row, p)
                    back = np.eye(p + 1)
                    if d == 0:
                        # Solve on centred values; the constant absorbs mean * (1 - sum of phi).
                        x = [0, *range(2, 2 + p)]
                        back[0, 1:] = -row.mean
                    else:
                        # No constant to absorb the mean, so the columns themselves are shifted back.
                        shift = np.eye(len(g))
                        shift[1:, 0] = row.mean
                        g, x, back = shift @ g @ shift.T, list(range(2, 2 + p)), np.eye(p)
                    fit = regress(g, 1, x) if x else (np.zeros(0), float(g[1, 1]), np.zeros((0, 0)))
                    if fit is not None:
                        beta, sse, inverse = fit
                        beta, inverse = back @ beta, back @ inverse @ back.T
                        if d == 0:
                            beta[0] += row.mean
                        se = np.sqrt(np.diag(inverse) * sse / (n - p))
                out.append(fit_row(row.series_id, p, d, 0, beta, se, sse, n - p))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return lag_moments(w, max(p, 1), width).mapInPandas(solve, MODEL_SCHEMA)


class MovingAverage:
    """Conditional sum of squares for ``scoring``: errors are zero before the sample and for the first p rows."""

    def __init__(self, p: int, q: int, has_const: bool):
        self.p, self.q, self.c = p, q, int(has_const)
        self.k, self.m, self.floor = self.c + p + q, q, 0.0

    def inputs(self, u, y, past, first, extra):
        p, q, c, n = self.p, self.q, self.c, len(y)
        whole = np.concatenate([np.zeros(max(p - len(past), 0)), past[len(past) - p :] if p else past[:0], y])
        dx = np.zeros((n, self.k))
        dx[:, :c] = -1.0
        for i in range(1, p + 1):
            dx[:, c + i - 1] = -whole[p - i : p - i + n]
        x = y + dx[:, : c + p] @ u[: c + p]
        early = first + np.arange(n) <= p
        x[early], dx[early] = 0.0, 0.0
        da = np.zeros((q, self.k))
        da[np.arange(q), c + p + np.arange(q)] = -1.0
        return x, dx, -u[c + p :], da, np.zeros(q)

    def sums(self, u, y, path, slopes, first, extra):
        return np.concatenate([[-0.5 * (path @ path)], -(slopes.T @ path), (slopes.T @ slopes).ravel()])


def _solve(g: np.ndarray, x: list[int]) -> np.ndarray | None:
    fit = regress(g, 0, x) if x else (np.zeros(0),)
    return None if fit is None else fit[0]


def hannan_rissanen(blocks: DataFrame, w: DataFrame, p: int, d: int, q: int, long: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``series_id, start``: estimates ``[const], phi, theta`` by two regressions (null if one of them is singular).

    First an autoregression with ``long`` lags, from the lag cross-products; then the values on their own ``p`` lags and
    ``q`` lags of its errors, from sums over ``blocks`` (``scoring.pack`` with at least ``long + max(p, q)`` lags). Values
    are taken less their mean if the model has a constant.
    """
    centred = d == 0

    def first(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                phi = None
                if row.n > 2 * long + p + q + 2:
                    g = level_gram(row, long)
                    if not centred:
                        shift = np.eye(len(g))
                        shift[1:, 0] = row.mean
                        g = shift @ g @ shift.T
                    phi = _solve(g[1:, 1:], list(range(1, long + 1)))
                out.append((row.series_id, phi))
            yield pd.DataFrame(out, columns=["series_id", "ar"]).astype(object)

    ar = lag_moments(w, long, width).mapInPandas(first, "series_id string, ar array<double>").filter("ar is not null")
    reach, depth = long + max(p, q), max(p, q)

    def products(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                z = np.concatenate([np.asarray(r.past, dtype=float)[-reach:], np.asarray(r.y, dtype=float)]) - (r.mean if centred else 0.0)
                # Errors exist from the row after the first ``long`` ones that are at hand.
                e = z[long:].copy() if len(z) > long else z[:0]
                for i, a in enumerate(r.ar, start=1):
                    e -= a * z[long - i : len(z) - i]
                # Own rows whose lagged errors are all of rows with ``long`` predecessors in the series.
                lead = len(z) - len(r.y)
                rows = np.arange(max(lead, 0), len(z))
                rows = rows[r.first + rows - lead > long + depth]
                cols = [z[rows]] + [z[rows - i] for i in range(1, p + 1)] + [e[rows - j - long] for j in range(1, q + 1)]
                x = np.column_stack(cols)
                out.append((r.series_id, np.append((x.T @ x).ravel(), len(rows))))
            yield pd.DataFrame(out, columns=["series_id", "g"])

    spread = blocks.select("series_id", "blk").join(ar, "series_id")
    ready = blocks.select("series_id", "blk", "first", "mean", "past", "y").join(spread, ["series_id", "blk"])
    parts = ready.mapInPandas(products, "series_id string, g array<double>").select("series_id", F.posexplode("g").alias("i", "v"))
    sums = parts.groupBy("series_id", "i").agg(F.sum("v").alias("v")).groupBy("series_id")
    sums = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("g"))
    means = blocks.filter("blk = 0").select("series_id", "mean")

    def second(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g, k = np.asarray(r.g, dtype=float), 1 + p + q
                beta = _solve(g[:-1].reshape(k, k), list(range(1, k))) if g[-1] > p + q + 1 else None
                if beta is not None and centred:
                    beta = np.append(r.mean * (1 - beta[:p].sum()), beta)
                out.append((r.series_id, beta))
            yield pd.DataFrame(out, columns=["series_id", "start"]).astype(object)

    return sums.join(means, "series_id").mapInPandas(second, "series_id string, start array<double>")


def _invertible(theta: np.ndarray) -> np.ndarray:
    """Moving-average weights with their roots drawn inside the unit circle, where errors stay bounded."""
    largest = np.abs(np.roots(np.append(1.0, theta))).max(initial=0.0)
    return theta if largest < 0.98 else theta * (0.95 / largest) ** np.arange(1, len(theta) + 1)


def arima_fit(panel: DataFrame, p: int = 2, d: int = 1, q: int = 4, width: int = DEFAULT_WIDTH, block: int = scoring.BLOCK) -> DataFrame:
    """One model row per series. Orders are those of the call; nulls must be filled before.

    Pure autoregressions need only the lag cross-products. With a moving-average part, the two regressions of
    ``hannan_rissanen`` and a start at zero are improved by Gauss-Newton steps over blocks of ``block`` rows; the better end counts.
    """
    w = difference(panel, d, width)
    if q == 0:
        return _fit_ar(w, p, d, width)
    w, has_const = stage(w, "arima"), d == 0
    model = MovingAverage(p, q, has_const)
    long = max(2 * (p + q), 8)
    extras = {"known": F.count("value"), "squares": F.sum(F.col("value") * F.col("value"))}
    blocks = stage(scoring.pack(w, long + max(p, q), extras, width, block), "blocks")
    stats = blocks.groupBy("series_id").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum("known").alias("known"), F.sum("squares").alias("squares"))
    stats = stats.join(hannan_rissanen(blocks, w, p, d, q, long, width), "series_id", "left")

    def begin(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                climbs = []
                if r.known == r.n and r.n - p > model.k + 1 and r.squares > 0:
                    zero = np.zeros(model.k)
                    zero[: model.c] = r.mean
                    climbs.append(scoring.Climb.start(zero))
                    if r.start is not None:
                        near = np.array(r.start, dtype=float)
                        near[model.c + p :] = _invertible(near[model.c + p :])
                        climbs.append(scoring.Climb.start(near))
                out.append((r.series_id, int(r.n), float(r.squares) if r.squares == r.squares else None, [0.0], climbs))
            yield pd.DataFrame(out, columns=["series_id", "n", "squares", "extra", "climbs"]).astype({"climbs": object})

    table = stats.mapInPandas(begin, "series_id string, n long, squares double, extra array<double>, climbs array<array<double>>")

    def finish(r, climb, _):
        n_eff = max(int(r.n) - p, 0)
        sse = None if climb is None else -2 * climb.best
        if climb is None or sse <= EXACT * r.squares:
            return fit_row(r.series_id, p, d, q, None, None, None, n_eff)
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(climb.info)) * sse / n_eff, 0))
        return fit_row(r.series_id, p, d, q, climb.u, se, sse, n_eff, "ok" if climb.done == 1 else "not converged")

    return scoring.fit(blocks, table, model, finish, MODEL_SCHEMA)


def arima_sse(panel: DataFrame, candidates: DataFrame, p: int, d: int, q: int, width: int = DEFAULT_WIDTH, block: int = scoring.BLOCK) -> DataFrame:
    """Conditional sum of squares of every candidate for its series: ``series_id, cand, sse, n_eff``.

    ``candidates`` has several rows per series: ``series_id, cand, const, phi, theta`` (arrays; ``const`` only counts if d = 0).
    All candidates of a series are scored in one pass over its blocks.
    """
    model = MovingAverage(p, q, d == 0)
    point = F.concat(F.array("const") if d == 0 else F.array().cast("array<double>"), "phi", "theta")
    packed = candidates.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("cand", point.alias("point")))).alias("c"))
    blocks = stage(scoring.pack(difference(panel, d, width), p, {}, width, block), "scored")
    table = packed.join(blocks.filter("blk = 0").select("series_id", "n"), "series_id")
    table = stage(table.select("series_id", "n", "c.cand", F.col("c.point").alias("points"), F.array(F.lit(0.0)).alias("extra")), "candidates")
    sums = scoring.evaluate(blocks, table.select("series_id", "extra", "points"), model)
    size = 1 + model.k + model.k**2
    each = sums.join(table.select("series_id", "n", F.posexplode("cand").alias("i", "cand")), "series_id")
    sse = -2 * F.element_at("sums", F.col("i") * size + 1)
    return each.select("series_id", "cand", sse.alias("sse"), (F.col("n") - p).alias("n_eff"))


def arima_params(models: DataFrame) -> DataFrame:
    """Long parameter table: estimate, standard error, z, p-value and significance label."""
    has_const = F.col("d") == 0

    def named(col: str, prefix: str):
        return F.transform(
            col, lambda x, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")).alias("param"), x.alias("estimate"))
        )

    const = F.array(F.struct(F.lit("const").alias("param"), F.col("const").alias("estimate")))
    terms = F.concat(F.when(has_const, const).otherwise(F.slice(const, 1, 0)), named("phi", "ar.L"), named("theta", "ma.L"))
    rows = (
        models.filter(F.col("phi").isNotNull())
        .select("series_id", F.posexplode(terms).alias("i", "t"), "se")
        .select("series_id", "t.param", "t.estimate", F.try_element_at("se", F.col("i") + 1).alias("std_err"))
    )
    return with_p_values(rows)


def _p_normal(z: pd.Series) -> pd.Series:
    return pd.Series(two_sided_normal_p(z.to_numpy(float)))


def with_p_values(params: DataFrame) -> DataFrame:
    rows = params.withColumn("z", F.try_divide("estimate", "std_err")).withColumn("p_value", F.pandas_udf(_p_normal, "double")("z"))
    return rows.withColumn("significance", significance_label(F.col("p_value")))


def arima_filter(panel: DataFrame, models: DataFrame, p: int, d: int, q: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Residual and fitted value of every differenced row at given parameters.

    ``models`` needs ``series_id, const, phi, theta``. The first p rows have residual 0.
    """
    w = difference(panel, d, width)
    lagged_rows = lagged(w, list(range(1, p + 1)), width)
    rows = attach_series(lagged_rows, models.filter(F.col("phi").isNotNull()).select("series_id", "const", "phi", "theta"), width)
    x = F.col("value") - F.col("const")
    for i in range(1, p + 1):
        x = x - F.col("phi")[i - 1] * F.col(f"lag_{i}")
    x = F.when(F.col("pos") <= p, 0.0).otherwise(x)
    if q == 0:
        out = rows.withColumn("residual", x)
    else:
        ready = rows.select(
            "series_id",
            "ts",
            "value",
            x.alias("_x"),
            F.transform("theta", lambda t: -t).alias("_a"),
            F.array(*[F.lit(0.0)] * q).alias("_i"),
        )
        out = linear_recursion(ready, {"residual": ("_x", "_i")}, "_a", width)
    return out.select("series_id", "ts", "value", "residual", (F.col("value") - F.col("residual")).alias("fitted"))


def forecast_state(panel: DataFrame, residuals: DataFrame, p: int, d: int, q: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Last levels, differences and residuals of each series: all a forecast needs."""

    def latest(df: DataFrame, col: str, k: int, name: str) -> DataFrame:
        rows = lagged(df.select("series_id", "ts", F.col(col).alias("value")), [], width)
        keep = rows.filter(F.col("pos") > F.col("n") - max(k, 1))
        packed = F.array_sort(F.collect_list(F.struct("ts", "value")))
        return keep.groupBy("series_id").agg(F.reverse(packed["value"]).alias(name))

    levels = latest(panel, "value", p + d + 1, "levels")
    errors = latest(residuals, "residual", q, "errors")
    return levels.join(errors, "series_id")


def psi_weights(phi: np.ndarray, theta: np.ndarray, d: int, steps: int) -> np.ndarray:
    """Moving-average weights of the undifferenced process."""
    ar = np.concatenate([[1.0], -np.asarray(phi, dtype=float)])
    for _ in range(d):
        ar = np.convolve(ar, [1.0, -1.0])
    psi = np.zeros(steps)
    for j in range(steps):
        value = 1.0 if j == 0 else (theta[j - 1] if j <= len(theta) else 0.0)
        for i in range(1, min(j, len(ar) - 1) + 1):
            value -= ar[i] * psi[j - i]
        psi[j] = value
    return psi


def arima_forecast(models: DataFrame, state: DataFrame, steps: int = 20) -> DataFrame:
    """``(series_id, step, mean, se, lower, upper)`` with 95% bounds."""
    rows = models.filter(F.col("sigma2").isNotNull()).join(state, "series_id")

    def project(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                phi, theta = np.asarray(r.phi, dtype=float), np.asarray(r.theta, dtype=float)
                levels = np.asarray(r.levels, dtype=float)[::-1]
                anchors = [np.diff(levels, i)[-1] for i in range(r.d)]
                w = list(np.diff(levels, r.d)[::-1][: len(phi)]) if r.d else list(levels[::-1][: len(phi)])
                e = list(np.asarray(r.errors, dtype=float)[: len(theta)])
                path = []
                for _ in range(steps):
                    nxt = r.const + sum(a * b for a, b in zip(phi, w)) + sum(a * b for a, b in zip(theta, e))
                    path.append(nxt)
                    w = [nxt, *w][: len(phi)]
                    e = [0.0, *e][: len(theta)]
                mean = np.asarray(path)
                for anchor in reversed(anchors):
                    mean = anchor + np.cumsum(mean)
                se = np.sqrt(r.sigma2 * np.cumsum(psi_weights(phi, theta, r.d, steps) ** 2))
                out.append(
                    pd.DataFrame(
                        {
                            "series_id": r.series_id,
                            "step": np.arange(1, steps + 1, dtype="int32"),
                            "mean": mean,
                            "se": se,
                            "lower": mean - Z95 * se,
                            "upper": mean + Z95 * se,
                        }
                    )
                )
            if out:
                yield pd.concat(out, ignore_index=True)

    return rows.mapInPandas(project, "series_id string, step int, mean double, se double, lower double, upper double")
