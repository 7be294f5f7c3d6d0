"""GARCH(p, q) with p ARCH and q GARCH terms: filter, likelihood, fit and forecast."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions.scalar import garch_diagnostics
from panelflow.operators import scoring
from panelflow.operators.blocks import DEFAULT_WIDTH, attach_series, lagged
from panelflow.operators.recursion import linear_recursion
from panelflow.plans.staging import stage

BACKCAST_DECAY = 0.94
BACKCAST_ROWS = 75
DISTRIBUTIONS = ("normal", "t", "skewt")
MODEL_SCHEMA = (
    "series_id string, p int, q int, dist string, mean_model string, mu double, omega double, alpha array<double>, "
    "beta array<double>, nu double, skew double, backcast double, n long, k int, llf double, aic double, bic double, "
    "hqic double, se array<double>, status string"
)
COLUMNS = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]


def backcast(panel: DataFrame, mean_model: str = "constant", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Starting variance per series: exponentially weighted squares of its first 75 rows."""
    rows = lagged(panel, [], width).filter(F.col("pos") <= BACKCAST_ROWS)
    e = F.col("value") - (F.col("mean") if mean_model == "constant" else F.lit(0.0))
    weight = F.pow(F.lit(BACKCAST_DECAY), F.col("pos") - 1)
    return rows.groupBy("series_id").agg((F.sum(weight * e * e) / F.sum(weight)).alias("backcast"))


def garch_filter(panel: DataFrame, params: DataFrame, p: int = 1, q: int = 1, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Conditional variance, volatility and standardized residual of each row at given parameters.

    ``params`` has one row per series: ``mu, omega, alpha array, beta array, backcast``.
    """
    rows = lagged(panel, list(range(1, p + 1)), width)
    need = params.filter(F.col("omega").isNotNull()).select("series_id", "mu", "omega", "alpha", "beta", "backcast")
    rows = attach_series(rows, need, width)
    x = F.col("omega")
    for i in range(1, p + 1):
        e = F.col(f"lag_{i}") - F.col("mu")
        x = x + F.col("alpha")[i - 1] * F.when(F.col("pos") <= i, F.col("backcast")).otherwise(e * e)
    ready = rows.select("series_id", "ts", "value", (F.col("value") - F.col("mu")).alias("residual"), x.alias("_x"), "beta",
                        F.array(*[F.col("backcast")] * max(q, 1)).alias("_i"))
    if q == 0:
        out = ready.withColumn("variance", F.col("_x"))
    else:
        out = linear_recursion(ready, {"variance": ("_x", "_i")}, "beta", width)
    vol = F.sqrt("variance")
    return out.select(
        "series_id", "ts", "value", "residual", "variance", vol.alias("volatility"), (F.col("residual") / vol).alias("std_resid")
    )


def log_density(e: np.ndarray, s2: np.ndarray, dist: str, nu: float = 0.0, skew: float = 0.0) -> np.ndarray:
    """Log density of residuals with variance ``s2`` under a unit-variance distribution."""
    if dist == "normal":
        return -0.5 * (math.log(2 * math.pi) + np.log(s2) + e * e / s2)
    base = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    if dist == "t":
        return base - 0.5 * np.log(s2) - (nu + 1) / 2 * np.log1p(e * e / (s2 * (nu - 2)))
    a = 4 * skew * math.exp(base) * (nu - 2) / (nu - 1)
    b = math.sqrt(1 + 3 * skew * skew - a * a)
    z = e / np.sqrt(s2)
    side = 1 + np.where(z < -a / b, -1.0, 1.0) * skew
    return base + math.log(b) - 0.5 * np.log(s2) - (nu + 1) / 2 * np.log1p(((b * z + a) / side) ** 2 / (nu - 2))


class Spec:
    """Parameter layout of one model: ``[mu] omega alpha.. beta.. [nu] [skew]`` and its free form."""

    def __init__(self, p: int, q: int, dist: str, mean_model: str):
        if dist not in DISTRIBUTIONS:
            raise ValueError(f"dist must be one of {DISTRIBUTIONS}")
        if mean_model not in ("constant", "zero"):
            raise ValueError("mean_model must be 'constant' or 'zero'")
        self.p, self.q, self.dist, self.mean_model = p, q, dist, mean_model
        self.has_mu = mean_model == "constant"
        self.k = int(self.has_mu) + 1 + p + q + (dist != "normal") + (dist == "skewt")

    def unpack(self, theta):
        i = int(self.has_mu)
        p, q = self.p, self.q
        mu = theta[0] if self.has_mu else 0.0
        omega, alpha, beta = theta[i], theta[i + 1 : i + 1 + p], theta[i + 1 + p : i + 1 + p + q]
        nu = theta[i + 1 + p + q] if self.dist != "normal" else 0.0
        skew = theta[-1] if self.dist == "skewt" else 0.0
        return mu, omega, alpha, beta, nu, skew

    def from_free(self, u):
        """Unbounded numbers -> omega > 0, alpha and beta >= 0 with sum < 1, nu > 2.05, |skew| < 1."""
        i, m = int(self.has_mu), self.p + self.q
        parts = [u[:i], [math.exp(min(max(u[i], -60), 60))]]
        w = np.exp(np.clip(u[i + 1 : i + 1 + m], -40, 40))
        parts.append(w / (1 + w.sum()))
        if self.dist != "normal":
            parts.append([2.05 + math.exp(min(max(u[i + 1 + m], -20), 6))])
        if self.dist == "skewt":
            parts.append([math.tanh(u[-1])])
        return np.concatenate([np.asarray(x, dtype=float) for x in parts])

    def jacobian(self, u):
        """Slopes of the parameters in the free numbers."""
        i, m = int(self.has_mu), self.p + self.q
        theta, out = self.from_free(u), np.zeros((self.k, self.k))
        out[:i, :i] = 1.0
        out[i, i] = theta[i]
        w = theta[i + 1 : i + 1 + m]
        out[i + 1 : i + 1 + m, i + 1 : i + 1 + m] = np.diag(w) - np.outer(w, w)
        if self.dist != "normal":
            out[i + 1 + m, i + 1 + m] = theta[i + 1 + m] - 2.05
        if self.dist == "skewt":
            out[-1, -1] = 1 - theta[-1] ** 2
        return out

    def to_free(self, theta):
        i, m = int(self.has_mu), self.p + self.q
        w = np.asarray(theta[i + 1 : i + 1 + m], dtype=float)
        free = [*theta[:i], math.log(theta[i]), *np.log(w / (1 - w.sum()))]
        if self.dist != "normal":
            free.append(math.log(theta[i + 1 + m] - 2.05))
        if self.dist == "skewt":
            free.append(math.atanh(theta[-1]))
        return np.asarray(free)

    def start(self, mean: float, variance: float):
        """Variance-targeting start: persistence 0.95, a twentieth of it in the ARCH terms."""
        alpha = [0.05 / self.p] * self.p
        beta = [0.90 / self.q] * self.q if self.q else []
        theta = [mean] if self.has_mu else []
        theta += [variance * (1 - sum(alpha) - sum(beta)), *alpha, *beta]
        if self.dist != "normal":
            theta.append(8.0)
        if self.dist == "skewt":
            theta.append(0.0)
        return np.asarray(theta)


def density_slopes(e: np.ndarray, s2: np.ndarray, dist: str, nu: float = 0.0, skew: float = 0.0) -> tuple[np.ndarray, ...]:
    """Log density, its slopes in the residual and in the variance, and in ``nu`` and ``skew`` where there are any."""
    z = e / np.sqrt(s2)
    if dist == "normal":
        by_z = -z
    elif dist == "t":
        by_z = -(nu + 1) * z / (nu - 2 + z * z)
    else:
        a = 4 * skew * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))) * (nu - 2) / (nu - 1)
        b = math.sqrt(1 + 3 * skew * skew - a * a)
        side = 1 + np.where(z < -a / b, -1.0, 1.0) * skew
        w = (b * z + a) / side
        by_z = -(nu + 1) * w * (b / side) / (nu - 2 + w * w)
    shape = []
    if dist != "normal":
        h = 1e-5 * (nu - 2)
        shape.append((log_density(e, s2, dist, nu + h, skew) - log_density(e, s2, dist, nu - h, skew)) / (2 * h))
    if dist == "skewt":
        h = 1e-5 * (1 - abs(skew))
        shape.append((log_density(e, s2, dist, nu, skew + h) - log_density(e, s2, dist, nu, skew - h)) / (2 * h))
    return log_density(e, s2, dist, nu, skew), by_z / np.sqrt(s2), -(1 + by_z * z) / (2 * s2), *shape


class Likelihood:
    """A GARCH likelihood for ``scoring``; ``extra`` holds the unit of the values and the start variance in it.

    Points are parameters, or with ``free`` unbounded numbers. ``scores=False`` gives the likelihood alone.
    """

    def __init__(self, spec: Spec, free: bool = False, scores: bool = True):
        self.spec, self.free, self.scores = spec, free, scores
        self.k, self.m, self.floor = spec.k if scores else 0, spec.q, 1.0

    def inputs(self, u, y, past, first, extra):
        spec, (unit, back), n = self.spec, extra, len(y)
        mu, omega, alpha, beta, _, _ = spec.unpack(spec.from_free(u) if self.free else u)
        whole = np.concatenate([np.zeros(max(spec.p - len(past), 0)), past[len(past) - spec.p :] if spec.p else past[:0], y]) / unit - mu
        at, i = first + np.arange(n), int(spec.has_mu)
        x, dx = np.full(n, float(omega)), np.zeros((n, spec.k))
        dx[:, i] = 1.0
        for lag in range(1, spec.p + 1):
            e = whole[spec.p - lag : spec.p - lag + n]
            early = at <= lag
            dx[:, i + lag] = np.where(early, back, e * e)
            x += alpha[lag - 1] * dx[:, i + lag]
            if spec.has_mu:
                dx[:, 0] -= np.where(early, 0.0, 2 * alpha[lag - 1] * e)
        da = np.zeros((spec.q, spec.k))
        da[np.arange(spec.q), i + 1 + spec.p + np.arange(spec.q)] = 1.0
        if not self.scores:
            dx, da = dx[:, :0], da[:, :0]
        elif self.free:
            turn = spec.jacobian(u)
            dx, da = dx @ turn, da @ turn
        return x, dx, np.asarray(beta, dtype=float), da, np.full(spec.q, float(back))

    def sums(self, u, y, path, slopes, first, extra):
        spec = self.spec
        mu, _, _, _, nu, skew = spec.unpack(spec.from_free(u) if self.free else u)
        e = y / extra[0] - mu
        if not self.scores:
            return np.array([log_density(e, path, spec.dist, nu, skew).sum()])
        value, by_e, by_s2, *shape = density_slopes(e, path, spec.dist, nu, skew)
        direct = np.zeros((len(y), spec.k))
        if spec.has_mu:
            direct[:, 0] = -by_e
        for j, column in enumerate(shape):
            direct[:, spec.k - len(shape) + j] = column
        rows = direct @ spec.jacobian(u) if self.free else direct
        rows = rows + by_s2[:, None] * slopes
        return np.concatenate([[value.sum()], rows.sum(axis=0), (rows.T @ rows).ravel()])


def _steps(theta: np.ndarray) -> np.ndarray:
    return 1e-4 * np.maximum(np.abs(theta), 1e-3)


def errors_from(scores: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Standard errors from the scores a step above and a step below ``theta`` in each parameter."""
    k, h = len(theta), _steps(theta)
    m = (scores[:k] - scores[k:]) / (2 * h[:, None])
    m = -(m + m.T) / 2
    if not np.isfinite(m).all():
        return np.full(k, np.nan)
    var = np.diag(np.linalg.pinv(m))
    return np.sqrt(np.where(var > 0, var, np.nan))


def model_row(series_id, spec: Spec, theta, start, n, llf, se, status="ok"):
    if theta is None:
        empty = [None] * (len(COLUMNS) - 6)
        return (series_id, spec.p, spec.q, spec.dist, spec.mean_model, *empty, status if status != "ok" else "degenerate")
    mu, omega, alpha, beta, nu, skew = spec.unpack(theta)
    k = spec.k
    return (
        series_id, spec.p, spec.q, spec.dist, spec.mean_model, float(mu), float(omega), list(map(float, alpha)),
        list(map(float, beta)), float(nu) if spec.dist != "normal" else None, float(skew) if spec.dist == "skewt" else None,
        start, n, k, llf, 2 * k - 2 * llf, k * math.log(n) - 2 * llf, 2 * k * math.log(math.log(n)) - 2 * llf,
        [None if not np.isfinite(v) else float(v) for v in se], status,
    )


#: Persistence of the two starts, as a share of that of ``Spec.start``.
START_SHARES = (1.0, 0.3)


def first_guess(spec: Spec, mean: float, share: float) -> np.ndarray:
    """Start for a series of unit variance."""
    theta = spec.start(mean, 1.0)
    i, m = int(spec.has_mu), spec.p + spec.q
    theta[i + 1 : i + 1 + m] *= share
    theta[i] = max(1 - theta[i + 1 : i + 1 + m].sum(), 0.01)
    return theta


def rescale(theta, se, spec: Spec, unit: float):
    """Parameters and errors of ``value / unit`` -> those of ``value``."""
    factor = np.ones(len(theta))
    i = int(spec.has_mu)
    factor[:i] = unit
    factor[i] = unit * unit
    return theta * factor, se * factor


def _extras(mean_model: str) -> dict:
    """What a fit needs to know of a series beforehand, as aggregates of its blocks."""
    e = F.col("value") - (F.col("mean") if mean_model == "constant" else F.lit(0.0))
    weight = F.when(F.col("pos") <= BACKCAST_ROWS, F.pow(F.lit(BACKCAST_DECAY), F.col("pos") - 1))
    centred = F.col("value") - F.col("mean")
    return {"squares": F.sum(centred * centred), "top": F.max(F.abs("value")), "early": F.sum(weight * e * e), "weights": F.sum(weight)}


def garch_fit(
    panel: DataFrame,
    p: int = 1,
    q: int = 1,
    dist: str = "t",
    mean_model: str = "constant",
    width: int = DEFAULT_WIDTH,
    block: int = scoring.BLOCK,
) -> DataFrame:
    """Maximum likelihood per series, one model row each, by scoring over blocks of ``block`` rows.

    Values are divided by their deviation, and parameters are free numbers that keep variances positive and
    stationary. Two starts are improved side by side; standard errors come from differences of the scores.
    """
    spec = Spec(p, q, dist, mean_model)
    rows = panel.filter(F.col("value").isNotNull())
    blocks = stage(scoring.pack(rows, p, _extras(mean_model), width, block), "blocks")
    stats = blocks.groupBy("series_id").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.max("top").alias("top"),
        *[F.sum(c).alias(c) for c in ("squares", "early", "weights")],
    )

    def begin(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                spread, climbs, extra = (r.squares / (r.n - 1) if r.n > 1 else 0.0), [], [1.0, 1.0]
                if r.n >= spec.k + 3 and np.isfinite(spread) and spread > 1e-14 * max(1.0, r.top**2):
                    unit = math.sqrt(spread)
                    extra = [unit, r.early / r.weights / spread]
                    climbs = [scoring.Climb.start(spec.to_free(first_guess(spec, r.mean / unit, share))) for share in START_SHARES]
                out.append((r.series_id, int(r.n), extra, climbs))
            yield pd.DataFrame(out, columns=["series_id", "n", "extra", "climbs"]).astype({"climbs": object})

    table = stats.mapInPandas(begin, "series_id string, n long, extra array<double>, climbs array<array<double>>")

    def errors_at(climb):
        theta = spec.from_free(climb.u)
        h = np.diag(_steps(theta))
        return [*(theta + h), *(theta - h)]

    def finish(r, climb, near):
        if climb is None:
            return model_row(r.series_id, spec, None, None, int(r.n), None, None)
        (unit, back), theta = r.extra, spec.from_free(climb.u)
        se = np.full(spec.k, np.nan)
        if near:
            se = errors_from(np.stack([s[1 : 1 + spec.k] for s in near]), theta)
        theta, se = rescale(theta, se, spec, unit)
        return model_row(r.series_id, spec, theta, float(back * unit * unit), int(r.n), climb.best - int(r.n) * math.log(unit), se, "ok" if climb.done == 1 else "not converged")

    return scoring.fit(blocks, table, Likelihood(spec, free=True), finish, MODEL_SCHEMA, Likelihood(spec), errors_at)


def garch_params(models: DataFrame) -> DataFrame:
    """Long parameter table with z tests."""
    from panelflow.operators.arima import with_p_values

    def one(name: str, col: str):
        return F.array(F.struct(F.lit(name).alias("param"), F.col(col).alias("estimate")))

    def many(name: str, col: str):
        return F.transform(
            col,
            lambda x, i: F.struct(F.format_string(f"{name}[%d]", i + 1).alias("param"), x.alias("estimate")),
        )

    has_mu = F.col("mean_model") == "constant"
    none = F.slice(one("mu", "mu"), 1, 0)
    terms = F.concat(
        F.when(has_mu, one("mu", "mu")).otherwise(none),
        one("omega", "omega"),
        many("alpha", "alpha"),
        many("beta", "beta"),
        F.when(F.col("nu").isNotNull(), one("nu", "nu")).otherwise(none),
        F.when(F.col("skew").isNotNull(), one("lambda", "skew")).otherwise(none),
    )
    rows = (
        models.filter(F.col("omega").isNotNull())
        .select("series_id", F.posexplode(terms).alias("i", "t"), "se")
        .select("series_id", "t.param", "t.estimate", F.try_element_at("se", F.col("i") + 1).alias("std_err"))
    )
    return with_p_values(rows)


def garch_loglik(panel: DataFrame, candidates: DataFrame, width: int = DEFAULT_WIDTH, dist: str = "normal", p: int = 1, q: int = 1) -> DataFrame:
    """Log-likelihood of every candidate for its series: ``series_id, cand, llf, n``.

    ``candidates`` has several rows per series: ``series_id, cand, mu, omega, alpha, beta``, and ``nu`` and
    ``skew`` where the distribution needs them; ``alpha`` and ``beta`` are numbers or, for more lags, arrays. All
    candidates of a series are scored in one pass over its blocks.
    """
    spec = Spec(p, q, dist, "constant")
    lags = [F.col(c) if candidates.schema[c].dataType.typeName() == "array" else F.array(c) for c in ("alpha", "beta")]
    shape = {"normal": [], "t": ["nu"], "skewt": ["nu", "skew"]}[dist]
    theta = F.concat(F.array("mu", "omega"), *lags, *[F.array(c) for c in shape])
    packed = candidates.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.col("cand").cast("string").alias("cand"), theta.alias("theta")))).alias("c"))
    blocks = stage(scoring.pack(panel, p, _extras("constant"), width), "scored")
    starts = blocks.groupBy("series_id").agg(F.first("n").alias("n"), (F.sum("early") / F.sum("weights")).alias("back"))
    table = packed.join(starts, "series_id")
    table = stage(table.select("series_id", "n", F.col("c.theta").alias("points"), F.array(F.lit(1.0), "back").alias("extra"), "c.cand"), "candidates")
    sums = scoring.evaluate(blocks, table.select("series_id", "extra", "points"), Likelihood(spec, scores=False))
    each = sums.join(table.select("series_id", "n", "cand"), "series_id").select("series_id", "n", F.explode(F.arrays_zip("cand", "sums")).alias("c"))
    return each.select("series_id", "c.cand", F.col("c.sums").alias("llf"), "n")


def best_candidate(scores: DataFrame) -> DataFrame:
    order = F.struct((-F.col("llf")).alias("l"), F.col("cand"))
    return scores.groupBy("series_id").agg(F.min_by("cand", order).alias("cand"), F.max("llf").alias("llf"))


def last_state(filtered: DataFrame, k: int = 1, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Last ``k`` squared residuals and variances per series, latest first."""
    pair = F.struct("residual", "variance").alias("_rv")
    rows = lagged(filtered.select("series_id", "ts", pair, F.col("variance").alias("value")), [], width)
    keep = rows.filter(F.col("pos") > F.col("n") - k)
    packed = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "_rv"))))
    return keep.groupBy("series_id").agg(packed.alias("_p")).select(
        "series_id",
        F.transform("_p", lambda s: s["_rv"]["residual"] * s["_rv"]["residual"]).alias("e2"),
        F.transform("_p", lambda s: s["_rv"]["variance"]).alias("s2"),
    )


def garch_forecast(models: DataFrame, state: DataFrame, steps: int = 3) -> DataFrame:
    """``(series_id, step, variance, volatility)`` for any p and q.

    The variance recursion runs inside one ``aggregate`` per series: future squared residuals are
    replaced by their expected variance.
    """
    m = F.struct(F.col("e2").alias("e2"), F.col("s2").alias("s2"), F.array().cast("array<double>").alias("path"))

    def dot(coef, values):
        products = F.zip_with(coef, F.slice(values, 1, F.size(coef)), lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    def advance(acc, _):
        nxt = F.col("omega") + dot(F.col("alpha"), acc["e2"]) + dot(F.col("beta"), acc["s2"])
        return F.struct(
            F.concat(F.array(nxt), acc["e2"]).alias("e2"),
            F.concat(F.array(nxt), acc["s2"]).alias("s2"),
            F.concat(acc["path"], F.array(nxt)).alias("path"),
        )

    rows = models.filter(F.col("omega").isNotNull()).join(state, "series_id")
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), m, advance)["path"]
    return rows.select("series_id", F.posexplode(path).alias("i", "variance")).select(
        "series_id", (F.col("i") + 1).alias("step"), "variance", F.sqrt("variance").alias("volatility")
    )


def diagnostics(models: DataFrame) -> DataFrame:
    """Persistence, unconditional variance and half-life per series."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    cols = garch_diagnostics(total("alpha"), total("beta"), F.col("omega"))
    return models.select("series_id", *[c.alias(k) for k, c in cols.items()])
