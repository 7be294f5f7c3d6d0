"""Cases that used to give wrong answers."""

import datetime

import numpy as np
import pandas as pd
import pytest

import helpers

from panelflow.operators import arima, fill, mgarch, quantiles, stationarity, var_model
from panelflow.plans.run import fit_by_length, full_orders
from panelflow.sources import records

DAY = 86_400


def stamped(spark, rows):
    return spark.createDataFrame([(s, datetime.datetime.fromisoformat(t), v) for s, t, v in rows], "series_id string, ts timestamp, value double")


def test_grid_keeps_the_time_of_day(spark):
    panel = stamped(spark, [("a", "2024-01-30T16:00", 1.0), ("a", "2024-02-02T16:00", 2.0), ("a", "2024-02-01T09:30", 3.0), ("b", "2024-01-31T08:15", 4.0)])
    got = [(r.series_id, r.ts.isoformat(), r.value) for r in fill.regularize(panel, "day", 2 * DAY).orderBy("series_id", "ts").collect()]
    days = ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"]
    assert got == [("a", f"{d}T16:00:00", v) for d, v in zip(days, [1.0, None, None, 2.0])] + [("b", "2024-01-31T08:15:00", 4.0)]
    assert [r.value for r in fill.off_grid(panel, "day", 2 * DAY).collect()] == [3.0]


@pytest.mark.parametrize("step,freq", [("hour", "h"), ("week", "7D"), ("bday", "B"), ("month", None)])
def test_grid_steps(spark, step, freq):
    lo, hi = pd.Timestamp("2023-01-31T13:20"), pd.Timestamp("2023-06-30T13:20")
    panel = stamped(spark, [("a", lo.isoformat(), 1.0), ("a", hi.isoformat(), 2.0)])
    got = [r.ts for r in fill.regularize(panel, step, 20 * DAY).orderBy("ts").collect()]
    want = pd.date_range(lo, hi, freq=freq) if freq else [lo + pd.DateOffset(months=k) for k in range(6)]
    assert got == [t.to_pydatetime() for t in want]


def test_adf_depth_follows_the_longest_series(spark, make_panel):
    rng = np.random.default_rng(4)
    x = np.zeros(3000)
    e = rng.normal(size=3000)
    for t in range(24, 3000):
        x[t] = 0.6 * x[t - 1] + 0.35 * x[t - 23] + e[t]
    panel = make_panel({"long": x.tolist(), "short": x[:60].tolist()})
    free = {r.series_id: r for r in stationarity.adf_test(panel).collect()}
    capped = {r.series_id: r for r in stationarity.adf_test(panel, max_lag=20).collect()}
    assert free["long"].used_lag > 20 >= capped["long"].used_lag
    assert free["short"].adf_statistic == pytest.approx(capped["short"].adf_statistic)


def test_short_series_errors_belong_to_their_parameters(spark, make_panel):
    rng = np.random.default_rng(6)
    panel = make_panel({"short": rng.normal(size=25).cumsum().tolist(), "long": rng.normal(size=90).cumsum().tolist()})
    models = fit_by_length(panel, 2, 1, 1, 400 * DAY)
    alone = {r.param: r for r in arima.arima_params(arima.arima_fit(panel.filter("series_id = 'short'"), 1, 1, 1, 400 * DAY)).collect()}
    got = {(r.series_id, r.param): r for r in arima.arima_params(models).collect()}
    assert {p for s, p in got if s == "short"} == {"ar.L1", "ma.L1"} and {p for s, p in got if s == "long"} == {"ar.L1", "ar.L2", "ma.L1"}
    for p, r in alone.items():
        assert got["short", p].estimate == pytest.approx(r.estimate) and got["short", p].std_err == pytest.approx(r.std_err)
    assert {len(r.phi) for r in full_orders(models, 2, 1).collect()} == {2}


def test_panels_stay_apart(spark, make_panel, system):
    one = make_panel({n: system[:, i] for i, n in enumerate("abc")})
    two = make_panel({n: system[150:, i] for i, n in enumerate("abc")})
    from pyspark.sql import functions as F

    both = one.withColumn("panel_id", F.lit("1")).unionByName(two.withColumn("panel_id", F.lit("2")))
    got = var_model.spillover(both, max_lags=1)
    for name, single in (("1", one), ("2", two)):
        want = var_model.spillover(single, max_lags=1)
        assert got["total"].filter(f"panel_id = '{name}'").first()["total"] == pytest.approx(want["total"].first()["total"])
        a = got["directional"].filter(f"panel_id = '{name}'").drop("panel_id").toPandas().sort_values("series_id", ignore_index=True)
        pd.testing.assert_frame_equal(a, want["directional"].toPandas().sort_values("series_id", ignore_index=True))
    assert got["pairwise"].count() == 12


@pytest.mark.parametrize("lam", [0.6, 1.0])
def test_dcc_state_is_exact(make_panel, lam):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(90, 2))
    z[3] *= 1e9  # so large that its trace matters for as long as doubles can tell
    got = mgarch.dcc_ewma(make_panel({"a": z[:, 0], "b": z[:, 1]}), lam, size=16).toPandas().sort_values("ts")
    q, want = np.corrcoef(z.T), []
    for row in z:
        want.append(q[0, 1])
        q = lam * q + (1 - lam) * np.outer(row, row)
    np.testing.assert_allclose(got["q"], want, rtol=1e-9)


def test_points_take_the_last_number(spark):
    df = spark.createDataFrame([("d", "no", 1.0, "2.5"), ("d", None, None, "x"), ("d", "7", None, None)], "date string, `my.return` string, returns double, Return2 string")
    assert [r.returns for r in records.map_points(df).collect()] == [2.5, None, 7.0]


def test_target_with_a_dot(spark):
    df = spark.createDataFrame([("2024-01-01", 3)], "date string, `a.b` int")
    assert records.pick_target(df, "a.b").first()["value"] == 3.0


def test_quantile_of_few_values(make_panel):
    got = {r.series_id: r.q for r in quantiles.exact_quantiles(make_panel({"a": [1, 2], "b": [5]}), [0.25, 0.5]).collect()}
    assert got == {"a": [1.25, 1.5], "b": [5.0, 5.0]}


@pytest.mark.parametrize("coef", [[0.9], [-1.0], [1.5], [0.5, 0.3], [1.2, -0.5], [0.3, 0.2, -0.4, 0.1], [1.1, 0.2]])
def test_recursion_without_rows(coef):
    from panelflow.operators.recursion import _by_row, run

    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 200, 1000):
        x, state = rng.normal(size=n), rng.normal(size=len(coef))
        np.testing.assert_allclose(run(x, np.array(coef), state), _by_row(x, np.array(coef), state), rtol=1e-9, atol=1e-9)
    x = np.ones(300)
    x[150] = np.nan
    got = run(x, np.array(coef), np.zeros(len(coef)))
    assert np.isfinite(got[:150]).all() and np.isnan(got[150:]).all()


def test_undefined_rows_do_not_depend_on_blocks(make_panel):
    """A series that is undefined from its first row on, one from the middle on, and one that is whole."""
    from panelflow.operators import recursion

    rng = np.random.default_rng(8)
    values = {k: rng.normal(size=1500).tolist() for k in "abc"}
    values["a"][0] = values["b"][700] = None
    panel = make_panel(values)
    for lam in (0.3, 0.95):
        got = [recursion.ewma(panel, lam, width=w * DAY).toPandas().sort_values(["series_id", "ts"])["ewma"].to_numpy().reshape(3, -1) for w in (40, 100, 5000)]
        for one in got:
            assert np.isnan(one[0]).all() and np.isnan(one[1, 700:]).all() and np.isfinite(one[1, :700]).all() and np.isfinite(one[2]).all()
            np.testing.assert_allclose(one, got[0], rtol=1e-9)


@pytest.mark.parametrize("dist,p,q", [("normal", 1, 1), ("t", 2, 1), ("skewt", 1, 2)])
def test_loglik_of_candidates(spark, make_panel, dist, p, q):
    from panelflow.operators import garch

    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=150), "b": rng.standard_t(6, 90)}
    rows = [(s, c, 0.01 * c, 0.3, [0.1] * p, [0.3] * q, 6.0 + c, 0.1) for s in values for c in range(3)]
    cands = spark.createDataFrame(rows, "series_id string, cand int, mu double, omega double, alpha array<double>, beta array<double>, nu double, skew double")
    spec = garch.Spec(p, q, dist, "constant")
    for width in (40 * DAY, 400 * DAY):
        got = {(r.series_id, int(r.cand)): r for r in garch.garch_loglik(make_panel(values), cands, width, dist, p, q).collect()}
        for s, c, mu, omega, alpha, beta, nu, skew in rows:
            theta = np.array([mu, omega, *alpha, *beta, *{"normal": [], "t": [nu], "skewt": [nu, skew]}[dist]])
            want = helpers.loglik(values[s], theta, spec, helpers.start_variance(values[s], "constant"))
            assert got[s, c].llf == pytest.approx(want) and got[s, c].n == len(values[s])


def test_second_difference_comes_back(spark, make_panel):
    from panelflow.operators import transform

    x = np.random.default_rng(3).normal(size=60).cumsum().cumsum()
    second = transform.difference(make_panel({"a": x}), 2, 20 * DAY)
    start = spark.createDataFrame([("a", [float(x[1]), float(x[1] - x[0])])], "series_id string, anchors array<double>")
    got = transform.undifference(second, start, 20 * DAY, d=2).toPandas().sort_values("ts")["value"]
    np.testing.assert_allclose(got, x[2:])
