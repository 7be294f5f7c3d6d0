"""Model operators against direct numpy solutions."""

import math

import numpy as np
import pytest

import helpers
from helpers import DAY, frame

from panelflow.functions import distributions as dist
from panelflow.operators import arima, garch, matrices, mgarch, moments, stationarity, var_model
from panelflow.plans.staging import stage

W = 40 * DAY


def ols(y, x):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return b, y - x @ b


def test_distributions():
    assert dist.norm_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert dist.t_sf(2.228139, 10) == pytest.approx(0.025, abs=1e-6)
    assert dist.f_sf(3.708265, 3, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.dickey_fuller_p(-0.031362) == pytest.approx(0.95586, abs=1e-5)
    assert dist.dickey_fuller_p(-20.0) == 0 and dist.dickey_fuller_p(3.0) == 1


def test_lag_gram(system_panel, system):
    stats = moments.lag_moments(system_panel, 6, W).toPandas()
    for row in stats.itertuples(index=False):
        x = system[:, "abc".index(row.series_id)]
        x = x - x.mean()
        for lags in (0, 1, 4, 6):
            z = np.column_stack([np.ones(300 - lags)] + [x[lags - i : 300 - i] for i in range(lags + 1)])
            assert np.allclose(stationarity.level_gram(row, lags), z.T @ z)


def test_adf(system_panel, system, make_panel):
    for row in stationarity.adf_test(system_panel, width=W).toPandas().itertuples():
        x = system[:, "abc".index(row.series_id)]
        d, lags = np.diff(x), row.used_lag
        y = d[lags:]
        z = np.column_stack([np.ones(len(y)), x[lags:-1]] + [d[lags - i : len(d) - i] for i in range(1, lags + 1)])
        b, e = ols(y, z)
        s2 = e @ e / (len(y) - z.shape[1])
        assert row.adf_statistic == pytest.approx(b[1] / math.sqrt(s2 * np.linalg.inv(z.T @ z)[1, 1]), abs=1e-6)
        assert row.n_obs == len(y)
    odd = stationarity.adf_test(make_panel({"flat": [3] * 40, "line": range(40), "one": [1], "none": [None] * 5}), width=W)
    assert set(odd.toPandas()["status"]) <= {"degenerate", "short"}


def test_cross_products_over_blocks(system_panel, system):
    rows = moments.positioned(system_panel, width=W)
    got = moments.cross_products(rows, 3, size=37).toPandas().set_index(["a", "b"])["prod"]
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            want = [system[d:, i] @ system[: 300 - d, j] for d in range(4)]
            assert np.allclose(got[a, b], want)


def test_cross_products_over_tiles(make_panel, monkeypatch):
    monkeypatch.setattr(moments, "TILE", 3)
    x = np.random.default_rng(2).normal(size=(50, 10))
    panel = make_panel({f"s{i}": x[:, i] for i in range(10)})
    got = moments.cross_products(moments.positioned(panel, width=W), 2, size=16).toPandas().set_index(["a", "b"])["prod"]
    assert len(got) == 100
    for i in range(10):
        for j in range(10):
            assert np.allclose(got[f"s{i}", f"s{j}"], [x[d:, i] @ x[: 50 - d, j] for d in range(3)])
    pairs = moments.pair_correlations(panel, W, 16).toPandas().set_index(["row_id", "col_id"])
    assert len(pairs) == 55
    for (a, b), r in pairs.iterrows():
        assert r["corr"] == pytest.approx(np.corrcoef(x[:, int(a[1])], x[:, int(b[1])])[0, 1])
    z = mgarch.dcc_ewma(panel, 0.9, W, 16).toPandas()
    assert len(z) == 45 * 50


def test_var_granger(system_panel, system):
    rows = var_model.prepared(system_panel, W)
    models = stage(var_model.var_fit(rows, 4))
    m = models.toPandas().iloc[0]
    lag, t = m.lag, 300
    x = np.column_stack([np.ones(t - lag)] + [system[lag - i : t - i] for i in range(1, lag + 1)])
    b, e = ols(system[lag:], x)
    assert np.allclose(np.array(m.coef).reshape(b.shape), b, atol=1e-8)
    sigma = e.T @ e / (t - lag - 3 * lag - 1)
    assert np.allclose(np.array(m.sigma).reshape(3, 3), sigma, atol=1e-10)
    inverse = np.linalg.inv(x.T @ x)
    assert np.allclose(np.array(m.se).reshape(b.shape), np.sqrt(np.outer(np.diag(inverse), np.diag(sigma))), rtol=1e-5)
    aic = []
    for p in range(1, 5):
        xs = np.column_stack([np.ones(t - 4)] + [system[4 - i : t - i] for i in range(1, p + 1)])
        _, u = ols(system[4:], xs)
        aic.append(np.log(np.linalg.det(u.T @ u / (t - 4))) + 2 * (9 * p + 3) / (t - 4))
    assert np.allclose(m.ic_values, aic, atol=1e-8) and lag == int(np.argmin(aic)) + 1
    got = var_model.var_residuals(rows, models, 4, size=50).toPandas().pivot(index="ts", columns="series_id", values="residual")
    assert np.allclose(got.sort_index().to_numpy(), e, atol=1e-8)
    for r in var_model.granger(rows, 3).toPandas().itertuples():
        s, y = system[:, "abc".index(r.source)], system[:, "abc".index(r.target)]
        for p in (1, 2, 3):
            own = [np.ones(t - p)] + [y[p - i : t - i] for i in range(1, p + 1)]
            other = [s[p - i : t - i] for i in range(1, p + 1)]
            small = (ols(y[p:], np.column_stack(own))[1] ** 2).sum()
            big = (ols(y[p:], np.column_stack(own + other))[1] ** 2).sum()
            f = (small - big) / p / (big / (t - p - 2 * p - 1))
            assert r.f_stats[p - 1] == pytest.approx(f, rel=1e-6, abs=1e-8)


def test_fevd_properties(system_panel, make_panel, system):
    models = stage(var_model.var_fit(var_model.prepared(system_panel, W), 2))
    for kind in ("generalized", "cholesky"):
        table = stage(var_model.fevd(models, 10, kind).select("row_id", "col_id", "value"))
        check = matrices.row_check(table).toPandas()
        assert check["ok"].all()
        assert matrices.directional(table).toPandas()["net"].sum() == pytest.approx(0, abs=1e-9)
    renamed = make_panel({n: system[:, i] for i, n in enumerate("zyx")})
    other = var_model.fevd(var_model.var_fit(var_model.prepared(renamed, W), 2)).toPandas().set_index(["row_id", "col_id"])["value"]
    mine = var_model.fevd(models).toPandas().set_index(["row_id", "col_id"])["value"]
    names = dict(zip("abc", "zyx"))
    for (a, b), v in mine.items():
        assert other[names[a], names[b]] == pytest.approx(v, abs=1e-8)


def test_many_panels_solve_together(make_panel, system):
    from pyspark.sql import functions as F

    one = make_panel({"a": system[:, 0], "b": system[:, 1]})
    two = one.withColumn("panel_id", F.lit("p1")).unionByName(one.withColumn("panel_id", F.lit("p2")).withColumn("value", F.col("value") * 2))
    m = var_model.var_fit(var_model.prepared(two, W), 2).toPandas().set_index("panel_id")
    assert len(m) == 2 and np.allclose(m.loc["p1", "coef"][3:], m.loc["p2", "coef"][3:])


def test_rolling_spillover(make_panel, system):
    panel = make_panel({"a": system[:120, 0], "b": system[:120, 1]})
    roll = var_model.rolling_spillover(panel, 60, 10, 7, 1, width=W, size=64).toPandas()
    ends = list(range(60, 121, 7))
    assert roll["ts"].nunique() == len(ends)
    for end, ts in zip(ends, sorted(roll["ts"].unique())):
        y = system[end - 60 : end, :2]
        x = np.column_stack([np.ones(59), y[:-1]])
        b, e = ols(y[1:], x)
        theta = var_model.decompose(b, e.T @ e / (59 - 3), 2, 1, 10, "generalized")
        want = (theta.sum() - np.trace(theta)) / theta.sum() * 100
        assert roll[roll["ts"] == ts]["total"].iloc[0] == pytest.approx(want, abs=1e-8)


def simulate(n, omega, alpha, beta, seed):
    rng = np.random.default_rng(seed)
    s2, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        x = math.sqrt(s2) * rng.standard_t(7) * math.sqrt(5 / 7)
        out.append(x)
        s2 = omega + alpha * x * x + beta * s2
    return np.array(out)


def test_garch_reference_value(make_panel):
    m = garch.garch_fit(make_panel({"g": np.arange(100, 110.0)}), 1, 1, "normal").toPandas().iloc[0]
    assert m.llf == pytest.approx(-23.0974, abs=2e-3) and m.k == 4
    assert m.aic == pytest.approx(54.1948, abs=4e-3)


def test_garch_fit_filter_and_blocks(make_panel):
    data = {"g": simulate(700, 0.05, 0.1, 0.85, 3), "flat": np.ones(50)}
    panel = make_panel(data)
    models = stage(garch.garch_fit(panel, 1, 1, "t"))
    m = models.toPandas().set_index("series_id")
    assert m.loc["flat", "status"] == "degenerate"
    g = m.loc["g"]
    spec = garch.Spec(1, 1, "t", "constant")
    theta = np.array([g.mu, g.omega, *g.alpha, *g.beta, g.nu])
    for i in range(5):
        for step in (-1e-2, 1e-2):
            near = theta.copy()
            near[i] *= 1 + step
            assert helpers.loglik(data["g"], near, spec, g.backcast) <= g.llf + 1e-6
    got = frame(garch.garch_filter(panel, models, 1, 1, W))
    assert set(got["series_id"]) == {"g"}
    want = helpers.variance_path(data["g"] - g.mu, g.omega, g.alpha, g.beta, g.backcast)
    assert np.allclose(got["variance"], want)
    blocks = garch.garch_fit(panel, 1, 1, "t", block=100, width=300 * DAY).toPandas().set_index("series_id").loc["g"]
    assert blocks.llf == pytest.approx(g.llf, abs=1e-4)
    assert np.allclose([blocks.omega, blocks.alpha[0], blocks.beta[0]], [g.omega, g.alpha[0], g.beta[0]], rtol=0.02)
    assert blocks.status == g.status == "ok" and np.allclose(blocks.se, g.se, rtol=0.02)
    other = garch.garch_fit(panel, 1, 1, "t", block=100, width=170 * DAY).toPandas().set_index("series_id").loc["g"]
    assert np.allclose([other.omega, *other.se], [blocks.omega, *blocks.se], rtol=1e-4)


def test_garch_without_beta_is_arch(make_panel):
    x = simulate(300, 0.5, 0.3, 0.0, 8)
    models = stage(garch.garch_fit(make_panel({"g": x}), 1, 0, "normal"))
    m = models.toPandas().iloc[0]
    out = frame(garch.garch_filter(make_panel({"g": x}), models, 1, 0, W))
    e = x - m.mu
    assert np.allclose(out["variance"][1:], m.omega + m.alpha[0] * e[:-1] ** 2)


def test_arima(make_panel):
    rng = np.random.default_rng(5)
    e, w = rng.normal(size=550), np.zeros(550)
    for t in range(2, 550):
        w[t] = 0.5 * w[t - 1] - 0.2 * w[t - 2] + e[t] + 0.4 * e[t - 1]
    x = np.cumsum(w[50:])
    panel = make_panel({"x": x, "line": np.arange(100.0)})
    models = stage(arima.arima_fit(panel, 2, 1, 1))
    m = models.toPandas().set_index("series_id")
    assert m.loc["line", "status"] == "degenerate"
    fit = m.loc["x"]
    assert np.allclose([*fit.phi, *fit.theta], [0.5, -0.2, 0.4], atol=0.25)
    diffs = np.diff(x)
    resid = helpers.css_residuals(diffs.copy(), np.array([*fit.phi, *fit.theta]), 2, 1, False)
    filtered = stage(arima.arima_filter(panel, models, 2, 1, 1, W))
    got = frame(filtered.filter("series_id = 'x'"))
    assert np.allclose(got["residual"], resid) and np.allclose(got["fitted"] + got["residual"], diffs)
    fc = arima.arima_forecast(models, arima.forecast_state(panel, filtered, 2, 1, 1, W), 3).toPandas().sort_values("step")
    one = fit.phi[0] * diffs[-1] + fit.phi[1] * diffs[-2] + fit.theta[0] * resid[-1]
    two = fit.phi[0] * one + fit.phi[1] * diffs[-1]
    assert np.allclose(fc["mean"][:2], [x[-1] + one, x[-1] + one + two])
    assert fc["se"].iloc[0] == pytest.approx(math.sqrt(fit.sigma2))
    blocks = arima.arima_fit(panel, 2, 1, 1, block=200, width=200 * DAY).toPandas().set_index("series_id").loc["x"]
    assert blocks.llf == pytest.approx(fit.llf, abs=1e-4) and blocks.status == fit.status == "ok"
    assert np.allclose([*blocks.phi, *blocks.theta, *blocks.se], [*fit.phi, *fit.theta, *fit.se], rtol=2e-3)
    names = arima.arima_params(models).toPandas()["param"].tolist()
    assert names == ["ar.L1", "ar.L2", "ma.L1"]


def test_ar_by_statistics_equals_least_squares(make_panel):
    x = np.random.default_rng(9).normal(size=200).cumsum() * 0.1 + 500
    got = arima.arima_fit(make_panel({"x": x}), 2, 0, 0, W).toPandas().iloc[0]
    b, e = ols(x[2:], np.column_stack([np.ones(198), x[1:-1], x[:-2]]))
    assert np.allclose([got.const, *got.phi], b, rtol=1e-5) and got.sigma2 == pytest.approx(e @ e / 198, rel=1e-6)


def test_series_with_gaps_are_reported(make_panel):
    rng = np.random.default_rng(10)
    x = list(rng.normal(size=60))
    gaps = [v if i % 7 else None for i, v in enumerate(x)]
    panel = make_panel({"full": x, "gaps": gaps, "empty": [None] * 20})
    for q in (0, 1):
        got = arima.arima_fit(panel, 1, 0, q, W).toPandas().set_index("series_id")["status"]
        assert got["full"] == "ok" and set(got.drop("full")) == {"degenerate"}


def test_dcc_matches_loop(system_panel, system):
    z = system - system.mean(axis=0)
    from pyspark.sql import functions as F

    means = {n: float(m) for n, m in zip("abc", system.mean(axis=0))}
    shift = F.create_map(*[v for n, m in means.items() for v in (F.lit(n), F.lit(m))])
    panel = stage(system_panel.withColumn("value", F.col("value") - shift[F.col("series_id")]))
    got = mgarch.dcc_ewma(panel, 0.95, W, 64).toPandas().sort_values("ts")
    q, want = np.corrcoef(z.T), []
    for row in z:
        want.append(q[0, 1] / math.sqrt(q[0, 0] * q[1, 1]))
        q = 0.95 * q + 0.05 * np.outer(row, row)
    ab = got[(got["row_id"] == "a") & (got["col_id"] == "b")]
    assert np.allclose(ab["rho"], want)
