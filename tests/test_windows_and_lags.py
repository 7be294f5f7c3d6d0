"""Windows, lag products and nested regressions against direct computations."""

import numpy as np
import pandas as pd
import pytest
from helpers import DAY, frame

from panelflow.operators import blocks, moments, stationarity, var_model


@pytest.mark.parametrize("window", [1, 2, 7, 100, 3000, 5000])
def test_rolling_of_any_window(make_panel, window):
    rng = np.random.default_rng(window)
    level = np.r_[np.zeros(4000), np.full(3000, 1e6), np.full(2000, 5.0)] + rng.normal(size=9000)
    level[7000:8000] = 5.0
    data = {"a": level, "b": rng.normal(size=50)}
    data["b"][20] = np.nan
    got = frame(blocks.rolling(make_panel(data), window, 900 * DAY))
    for name, values in data.items():
        want = pd.Series(values).rolling(window)
        own = got[got["series_id"] == name]
        np.testing.assert_allclose(own["rolling_mean"], want.mean(), rtol=1e-6, atol=1e-6)
        if window > 1:
            exact = np.array([values[i + 1 - window : i + 1].std(ddof=1) if i + 1 >= window else np.nan for i in range(len(values))])
            np.testing.assert_allclose(own["rolling_std"], exact, rtol=1e-9, atol=1e-12)
        else:
            assert own["rolling_std"].isna().all()


def test_rolling_cost_does_not_depend_on_the_window(make_panel):
    """Every frame of the plan begins at an end of its partition; the only other one is an offset."""
    plan = blocks.rolling(make_panel({"a": range(30)}), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unboundedpreceding") >= 6


@pytest.mark.parametrize("block", [64, 4096])
def test_deep_moments(make_panel, block):
    rng = np.random.default_rng(2)
    data = {"long": rng.normal(size=700) + 3, "short": rng.normal(size=40), "tiny": np.array([1.0, 2.0, 4.0])}
    depth = lambda n: n // 20 + 2
    rows = {r.series_id: r for r in moments.deep_moments(make_panel(data), depth, 30, 200 * DAY, block).collect()}
    for name, x in data.items():
        r, d = rows[name], min(depth(len(x)), 30)
        z = x - x.mean()
        assert r.n == len(x) and len(r.prod) == d + 1
        want = [z[k:] @ z[: len(z) - k] if k < len(z) else 0.0 for k in range(d + 1)]
        np.testing.assert_allclose(r.prod, want, atol=1e-9)
        np.testing.assert_allclose(r.head, z[:d], atol=1e-12)
        np.testing.assert_allclose(r.tail, z[-d:], atol=1e-12)


def test_nested_residuals_of_a_stack():
    x = np.random.default_rng(0).normal(size=(4, 60, 6)) + 2
    x[3, :, 2] = x[3, :, 1]
    got = moments.nested_residuals(np.einsum("bti,btj->bij", x, x))
    for b in range(4):
        for j in range(6):
            if b == 3 and j >= 3:
                assert np.isnan(got[b, j])
                continue
            y, left = x[b, :, 5], x[b, :, :j]
            r = y - left @ np.linalg.lstsq(left, y, rcond=None)[0] if j else y
            assert got[b, j] == pytest.approx(r @ r)


def test_stacked_grams():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3):
        y = rng.normal(size=(40, 2))
        y -= y.mean(axis=0)
        prod = [y[d:].T @ y[: 40 - d] for d in range(4)]
        rows.append((np.stack(prod), y.sum(axis=0), y[:3], y[-3:]))
    stacked = [np.stack(c) for c in zip(*rows)]
    for lag in (1, 2, 3):
        many = moments.lag_grams(*stacked, np.full(3, 40.0), lag)
        for b, (prod, s, head, tail) in enumerate(rows):
            np.testing.assert_allclose(many[b], moments.lag_gram(list(prod), s, head, tail, 40, lag), atol=1e-9)


def test_adf_search_finds_the_same_in_blocks(make_panel):
    rng = np.random.default_rng(5)
    data = {k: rng.normal(size=n).cumsum() for k, n in (("a", 500), ("b", 60), ("c", 6))}
    panel = make_panel(data)
    one = stationarity.adf_test(panel, width=200 * DAY).toPandas().sort_values("series_id")
    cut = stationarity.adf_test(panel, width=200 * DAY, block=50).toPandas().sort_values("series_id")
    assert one["used_lag"].tolist() == cut["used_lag"].tolist()
    np.testing.assert_allclose(one["adf_statistic"].astype(float), cut["adf_statistic"].astype(float), rtol=1e-8)


@pytest.mark.parametrize("identification", ["generalized", "cholesky"])
def test_rolling_spillover_of_any_block(make_panel, system, identification):
    panel = make_panel({n: system[:, i] for i, n in enumerate("abc")})
    got = [var_model.rolling_spillover(panel, 60, 10, 3, 2, identification, 400 * DAY, size).toPandas().sort_values(["ts", "series_id"]) for size in (60, 4096)]
    assert (got[0]["status"] == "ok").all() and len(got[0]) == len(got[1]) == 3 * 81
    for c in ("total", "from_others", "to_others", "net"):
        np.testing.assert_allclose(got[0][c], got[1][c], rtol=1e-7, atol=1e-9)
    # The last window by itself.
    y = system[-60:] - system[-60:].mean(axis=0)
    z = np.column_stack([np.ones(58), y[2:], y[1:-1], y[:-2]])
    fit = var_model.solve_var(z.T @ z, 3, 2)
    theta = var_model.decompose(fit[0], fit[1] / (58 - 7), 3, 2, 10, identification)
    assert theta.sum() - np.trace(theta) == pytest.approx(got[0]["total"].iloc[-1] * 3, rel=1e-6)


def test_windows_without_a_solution_say_so(make_panel):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    flat = make_panel({"a": x, "b": 2 * x})
    assert set(var_model.rolling_spillover(flat, 20, 5).toPandas()["status"]) == {"degenerate"}
    both = make_panel({"a": x, "b": rng.normal(size=40)})
    got = var_model.rolling_spillover(both, 4, 5).toPandas()
    assert set(got["status"]) == {"short"} and got["total"].isna().all()


def test_correlated_pairs_are_found(spark):
    from panelflow.operators import correlated
    from panelflow.plans.staging import stage

    rng = np.random.default_rng(11)
    n, days = 400, 300
    x = rng.normal(size=(n, days))
    for g in range(0, 120, 6):
        base = rng.normal(size=days)
        for i in range(6):
            x[g + i] = (-1) ** i * base + rng.normal(size=days) * rng.choice([0.1, 0.3, 0.5]) + 50
    x[200] = 3.0
    start = pd.Timestamp("2020-01-01")
    pdf = pd.DataFrame({"series_id": np.repeat([f"s{i:03d}" for i in range(n)], days), "ts": np.tile(pd.date_range(start, periods=days), n), "value": x.ravel()})
    panel = stage(spark.createDataFrame(pdf, "series_id string, ts timestamp, value double"))
    with np.errstate(all="ignore"):
        c = np.corrcoef(x)
    a, b = np.where(np.triu(np.abs(np.nan_to_num(c)), 1) >= 0.85)
    want = {(f"s{i:03d}", f"s{j:03d}"): c[i, j] for i, j in zip(a, b)}
    assert len(want) > 100
    for block in (64, 32_768):
        got = {(r.row_id, r.col_id): r["corr"] for r in correlated.correlated_pairs(panel, 0.85, width=90 * DAY, block=block).collect()}
        assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    best = correlated.correlated_pairs(panel, 0.85, top=1, width=90 * DAY).collect()
    assert {(r.row_id, r.col_id) for r in best} <= set(want) and len(best) <= 121


def test_bands_follow_the_recall():
    from panelflow.operators.correlated import MOST, bands_for

    for n in (2, 100, 100_000):
        for rho in (0.3, 0.8, 0.95, 1.0):
            bits, bands = bands_for(n, rho, 0.99)
            same = 1 - np.arccos(rho) / np.pi
            meet = same**bits + (1 - same) ** bits
            assert 1 - (1 - meet) ** bands >= 0.98 and (bits * bands <= MOST or bits == 1)


def test_leading_equals_lag_from_the_other_end(make_panel):
    x = np.arange(1.0, 48.0)
    panel = make_panel({"a": x, "b": x[:2]})
    for width in (3, 10, 400):
        got = frame(blocks.leading(panel, [1, 2, 7], width * DAY))
        a = got[got["series_id"] == "a"]
        for k in (1, 2, 7):
            np.testing.assert_array_equal(a[f"lead_{k}"], np.r_[x[k:], np.full(k, np.nan)])
        b = got[got["series_id"] == "b"]
        np.testing.assert_array_equal(b["lead_1"], [2.0, np.nan])
        assert b["lead_7"].isna().all()
