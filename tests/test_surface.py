"""Sources, sinks, labels, cleanup and the staged run on small fixtures."""

import math

import numpy as np
import pytest
from helpers import DAY, frame
from pyspark.sql import functions as F

from panelflow.functions import scalar
from panelflow.operators import aggregate, fill, interpret, matrices, transform
from panelflow.plans.run import run_stages
from panelflow.sources import bars, records, sinks


def test_standardize_reference_values(make_panel):
    z = frame(transform.scale(make_panel({"p": [100, 101, 102, 103, 104]}), "standardize"))
    assert np.allclose(z["value"], [-1.264911, -0.632456, 0, 0.632456, 1.264911], atol=1e-6)


def test_scaling_of_flat_series_is_null(make_panel):
    for method in ("standardize", "minmax", "robust"):
        assert transform.scale(make_panel({"p": [5, 5, 5]}), method).filter("value is not null").count() == 0


def test_returns_telescope(make_panel):
    p = [10.0, 12.0, 9.0, 15.0]
    r = frame(transform.log_returns(make_panel({"p": p}), 2 * DAY))
    assert len(r) == 3 and r["value"].sum() == pytest.approx(math.log(15 / 10))
    assert frame(transform.log_returns(make_panel({"p": [1, -1, 2]})))["value"].isna().all()


def test_moments_reference_values(make_panel):
    s = aggregate.series_stats(make_panel({"p": [1, 2, 4, 8, 9, 3]})).toPandas().iloc[0]
    assert s["skew"] == pytest.approx(0.617132, abs=1e-6)
    assert s["kurt"] == pytest.approx(-1.637698, abs=1e-6)
    assert s["std"] == pytest.approx(3.271085, abs=1e-6) and s["median"] == 3.5
    one = aggregate.series_stats(make_panel({"p": [1]})).toPandas().iloc[0]
    assert math.isnan(one["std"]) and one["autocorr" if "autocorr" in one else "mean"] == 1


def test_information_criteria_reference_values(spark):
    cols = scalar.information_criteria(F.lit(74.158), F.lit(3), F.lit(7))
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    assert row["aic"] == pytest.approx(-142.316, abs=1e-3) and row["bic"] == pytest.approx(-142.478, abs=1e-3)


def test_business_calendar(spark):
    days = [r.ts.day for r in bars.calendar_spine(spark, "2023-01-01", "2023-01-10").orderBy("ts").collect()]
    assert days == [2, 3, 4, 5, 6, 9, 10]
    assert bars.calendar_spine(spark, "2019-12-30", "2021-01-02", "D").count() == 370


def test_cleanup(spark):
    df = spark.createDataFrame([(1.23456789, float("nan"), float("inf"))], "a double, b double, c double")
    assert tuple(scalar.finalize(df).first()) == (1.234568, None, None)
    nested = df.select(F.array("a", "b").alias("l"), F.create_map(F.lit("k"), F.col("c")).alias("m"), F.struct("a").alias("s"))
    row = scalar.finalize(nested, 2).first()
    assert row["l"] == [1.23, None] and row["m"] == {"k": None} and row["s"]["a"] == 1.23


def test_schema_inference(spark):
    df = spark.createDataFrame([("2024-01-02", 1, 2.5, "x")], "Date string, n int, price double, tag string")
    assert records.time_column(df) == "Date" and records.numeric_columns(df) == ["n", "price"]
    assert records.target_column(df) == "price" and records.target_column(df.drop("price")) == "n"
    assert {(r.series_id, r.value) for r in records.infer_panel(df).collect()} == {("n", 1.0), ("price", 2.5)}
    with pytest.raises(ValueError):
        records.target_column(df.select("tag"))
    bad = spark.createDataFrame([("7",), ("x",), (None,)], "v string")
    assert [(r.v, r.is_bad) for r in records.coerce_numeric(bad, "v").collect()] == [(7.0, False), (None, True), (None, False)]
    with pytest.raises(Exception, match="not numeric"):
        records.coerce_numeric(bad, "v", strict=True).collect()


def test_bars_formats_and_pruning(spark, tmp_path):
    rows = [("A", "2024-01-02", 1.0, 2.0, 0.5, 1.5, 1.4, 10), ("B", "2024-01-03", 2.0, 3.0, 1.5, 2.5, 2.4, 20)]
    df = spark.createDataFrame(rows, "symbol string, d string, open double, high double, low double, close double, adj_close double, volume long")
    df = df.select("symbol", F.to_timestamp("d").alias("ts"), "open", "high", "low", "close", "adj_close", "volume")
    for fmt in ("csv", "json", "parquet", "orc"):
        path = str(tmp_path / fmt)
        writer = df.write.format(fmt)
        (writer.option("header", "true") if fmt == "csv" else writer).save(path)
        got = bars.read_bars(spark, path, fmt, ["A"], "2024-01-01", "2024-01-03").collect()
        assert [(r.symbol, r.close, r.volume) for r in got] == [("A", 1.5, 10)]
    nested = bars.nested_bars(df.unionByName(df.limit(1).withColumns({c: F.lit(None).cast("double") for c in bars.PRICE_FIELDS}).withColumn("volume", F.lit(None).cast("long"))))
    assert nested.count() == 2 and bars.unnest_bars(nested).count() == 2
    df.write.partitionBy("symbol").parquet(str(tmp_path / "parts"))
    plan = bars.read_bars(spark, str(tmp_path / "parts"), "parquet", ["A"], "2024-01-01", None)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_write_stage_chains_and_refuses_overwrite(spark, tmp_path):
    df = spark.range(3)
    assert sinks.write_stage(df, str(tmp_path), "r", 1, "ids") is df
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_stage(df, str(tmp_path), "r", 1, "ids")
    sinks.write_stage(df.select(F.array("id").alias("a")), str(tmp_path), "r", 2, "arrays")
    assert spark.read.json(str(tmp_path / "r" / "002--arrays.json")).count() == 3
    with pytest.raises(ValueError):
        sinks.write_run(spark, str(tmp_path), "r", "n", "odd")


def test_forecast_shapes(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "series_id string, forecast array<double>")
    long = transform.explode_forecast(df)
    assert [(r.step, r.value) for r in long.orderBy("step").collect()] == [(1, 1.0), (2, 2.0)]
    assert transform.collect_forecast(long).first()["forecast"] == [1.0, 2.0]
    scalar_one = spark.createDataFrame([("a", 3.0)], "series_id string, forecast double")
    assert transform.explode_forecast(scalar_one).first()["value"] == 3.0


def test_labels_at_thresholds(spark):
    df = spark.createDataFrame([(0.03,), (0.0301,), (0.015,), (0.02,)], "last double")
    df = df.withColumns({"first": F.lit(0.02), "persistence": F.lit(0.99)})
    rows = interpret.interpret_garch(df).collect()
    assert [r.volatility_level for r in rows] == ["moderate", "high", "low", "moderate"]
    assert rows[0].persistence_level == "high" and rows[0].forecast_confidence == "Low"
    adf = spark.createDataFrame([(-4.0, 0.001), (-3.5, 0.04), (-2.7, 0.06), (-1.0, 0.5), (None, None)], "adf_statistic double, p_value double")
    got = interpret.interpret_adf(adf).collect()
    assert [r.evidence for r in got] == ["Strong", "Moderate", "Weak", "None", None] and got[-1].verdict == "error"
    arima = spark.createDataFrame([(1.0, 1.2, 1.1, 0.01, 0.009, None)], "first double, last double, mean double, std double, cv double, mae double")
    r = interpret.interpret_arima(arima).first()
    assert (r.trend, r.movement, r.quality, r.forecast_confidence) == ("increasing", "substantial", "Unknown", "High")
    pairs = spark.createDataFrame([("a", "b", 4.9), ("a", "c", 5.0), ("b", "c", 20.0)], "source string, target string, value double")
    assert [r.strength for r in interpret.interpret_pairwise(pairs).collect()] == ["minimal", "moderate", "strong"]


def test_matrix_operators(spark):
    m = spark.createDataFrame([("a", "a", 80.0), ("a", "b", 20.0), ("b", "a", 30.0), ("b", "b", 70.0)], "row_id string, col_id string, value double")
    assert matrices.total_spillover(m).first()["total"] == pytest.approx(25.0)
    net = {r.series_id: r.net for r in matrices.directional(m).collect()}
    assert net == {"a": 10.0, "b": -10.0}
    assert {(r.source, r.target): r.value for r in matrices.pairwise(m).collect()} == {("b", "a"): 20.0, ("a", "b"): 30.0}
    cov = spark.createDataFrame([("a", "a", 4.0), ("a", "b", 1.0), ("b", "a", 1.0), ("b", "b", 9.0)], "row_id string, col_id string, value double")
    risk = {r.series_id: r for r in matrices.portfolio_risk(cov).collect()}
    assert risk["a"].portfolio_vol == pytest.approx(math.sqrt(15 / 4)) and risk["a"].risk_share + risk["b"].risk_share == pytest.approx(1)
    assert matrices.risk_extremes(matrices.portfolio_risk(cov)).first()["max_contributor"] == "b"
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "series_id string, weight double")
    assert matrices.portfolio_risk(cov, weights).first()["portfolio_vol"] == pytest.approx(2.0)


def test_order_limits(make_panel):
    got = {r.series_id: r for r in fill.order_limits(make_panel({"a": range(10), "b": range(40)})).collect()}
    assert (got["a"].arima_p, got["a"].arima_q, got["a"].var_max_lag, got["a"].granger_ok) == (1, 1, 3, False)
    assert (got["b"].arima_p, got["b"].arima_q, got["b"].var_max_lag, got["b"].granger_ok) == (2, 4, 5, True)


def test_staged_run(make_panel):
    rng = np.random.default_rng(7)
    prices = {s: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90))) for s in "abc"}
    out = run_stages(make_panel(prices), arima_q=1, arima_p=1, garch_dist="normal", garch_steps=2, window_size=60, width=30 * DAY)
    assert out["returns"].count() == 3 * 89
    assert out["stationarity"].filter("verdict = 'Stationary'").count() == 3
    assert out["garch_forecast"].count() == 6 and out["granger"].count() == 6
    assert out["rolling_spillover"].select("ts").distinct().count() == 30
    assert out["spillover_interpretation"].first()["level"] in ("low", "moderate", "high")
    assert out["portfolio_risk"].first()["diversification_ratio"] > 1
    assert out["dcc"].count() == 3 * 88


def test_tables_are_made_on_demand(make_panel):
    rng = np.random.default_rng(7)
    prices = make_panel({s: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90))) for s in "abc"})
    out = run_stages(prices, granger_max_lag=2, width=30 * DAY, scaling_method="minmax")
    assert not out._made and "portfolio_risk" in out and "rolling_spillover" not in out
    assert out["granger"].count() == 6
    assert {"filled", "returns", "granger"} <= set(out._made) and not {"garch_models", "arima_models", "volatility"} & set(out._made)
    scaled = out["scaled"].groupBy().agg({"value": "min"}).first()[0], out["scaled"].groupBy().agg({"value": "max"}).first()[0]
    assert scaled == pytest.approx((0.0, 1.0)) and out["scaled"].select("shift", "factor").count() == 3 * 89
    assert "granger" not in run_stages(prices, spillover_enabled=False)
