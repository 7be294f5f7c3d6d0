"""Blocked windows against plain pandas, for several block widths."""

import numpy as np
import pandas as pd
import pytest
from helpers import DAY, frame

from panelflow.operators import blocks, fill, quantiles, recursion, transform


def pandas_panel(data):
    rows = [(s, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), np.nan if v is None else v) for s, vs in data.items() for i, v in enumerate(vs)]
    return pd.DataFrame(rows, columns=["series_id", "ts", "value"])


@pytest.mark.parametrize("days", [1, 20, 10_000])
def test_lags(make_panel, holes, days):
    pdf = pandas_panel(holes)
    g = pdf.groupby("series_id")["value"]
    got = frame(blocks.lagged(make_panel(holes), [1, 2, 25], days * DAY))
    for k in (1, 2, 25):
        assert np.allclose(got[f"lag_{k}"], g.shift(k), equal_nan=True)
    assert (got["pos"] == pdf.groupby("series_id").cumcount() + 1).all()
    assert np.allclose(got["mean"], g.transform("mean"), equal_nan=True)


@pytest.mark.parametrize("strategy", ["ffill", "bfill", "interpolate"])
@pytest.mark.parametrize("days", [7, 10_000])
def test_fills(make_panel, holes, strategy, days):
    g = pandas_panel(holes).groupby("series_id")["value"]
    want = {"ffill": g.ffill(), "bfill": g.bfill(), "interpolate": g.transform(lambda x: x.interpolate())}[strategy]
    got = frame(fill.fill(make_panel(holes), strategy, days * DAY))
    assert np.allclose(got["value"], want, equal_nan=True)


def test_hand_made_fills(make_panel):
    panel = make_panel({"s": [None, 1, None, None, 4, None]})
    want = {
        "interpolate": [np.nan, 1, 2, 3, 4, 4],
        "forward_fill": [np.nan, 1, 1, 1, 4, 4],
        "backward_fill": [1, 1, 4, 4, 4, np.nan],
    }
    for strategy, values in want.items():
        assert np.allclose(frame(fill.fill(panel, strategy, 2 * DAY))["value"], values, equal_nan=True)


def test_unknown_strategy_drops(make_panel):
    panel = make_panel({"a": [1, None, 3], "b": [1, 2, 3]})
    assert fill.fill(panel, "nonsense").count() == 4


def test_complete_dates_equals_align_and_drop(make_panel, holes):
    panel = make_panel({k: v[:37] for k, v in holes.items() if k != "c"}).filter("value is not null or dayofmonth(ts) < 9")
    want = frame(fill.drop_incomplete(fill.align_outer(panel, 20 * DAY)))
    got = frame(fill.complete_dates(panel))
    assert len(want) > 0 and want.equals(got)


def test_align_and_regularize(make_panel, holes):
    panel = make_panel(holes)
    aligned = fill.align_outer(panel, 20 * DAY)
    assert aligned.count() == 900
    gappy = panel.filter("dayofmonth(ts) <> 3")
    assert fill.regularize(gappy, "day", 20 * DAY).groupBy("series_id").count().count() == 3
    assert fill.regularize(gappy, "day", 20 * DAY).filter("series_id = 'a'").count() == 300


def test_rolling_running_difference(make_panel):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=300), "b": rng.normal(size=40)}
    pdf, panel = pandas_panel(data), make_panel(data)
    g = pdf.groupby("series_id")["value"]
    roll = frame(blocks.rolling(panel, 10, 20 * DAY))
    assert np.allclose(roll["rolling_mean"], g.rolling(10).mean().values, equal_nan=True)
    assert np.allclose(roll["rolling_std"], g.rolling(10).std().values, equal_nan=True)
    assert np.allclose(frame(blocks.running_sum(panel, 20 * DAY))["running"], g.cumsum())
    second = g.transform(lambda x: x.diff().diff()).dropna()
    assert np.allclose(frame(transform.difference(panel, 2, 20 * DAY))["value"], second)
    start = panel.groupBy("series_id").agg({"value": "first"}).selectExpr("series_id", "0.0D as anchor")
    back = frame(transform.undifference(panel, start, 20 * DAY))
    assert np.allclose(back["value"], g.cumsum())


def test_quantiles_with_ties_and_bracket(make_panel, monkeypatch):
    rng = np.random.default_rng(4)
    data = {"flat": [5.0] * 50, "mixed": list(rng.normal(size=4000).round(2)), "one": [1.5]}
    panel = make_panel(data)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    for small in (quantiles.SMALL, 100):
        monkeypatch.setattr(quantiles, "SMALL", small)
        monkeypatch.setattr(quantiles, "MARGIN", 2e-4 if small > 100 else 0.02)
        got = quantiles.exact_quantiles(panel, probs).toPandas().set_index("series_id")["q"]
        for name, values in data.items():
            assert np.allclose(got[name], np.quantile(values, probs)), name


@pytest.mark.parametrize("a", [0.05, 0.9999, -0.4])
def test_recursion_matches_loop(make_panel, a):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    rows = make_panel({"s": x}).select("*", F.array(F.lit(a)).alias("c"), F.array(F.lit(0.7)).alias("i"))
    want, y = [], 0.7
    for v in x:
        y = a * y + v
        want.append(y)
    for days in (7, 64):
        got = frame(recursion.linear_recursion(rows, {"y": ("value", "i")}, "c", days * DAY))
        assert np.allclose(got["y"], want, rtol=1e-12, atol=1e-12)


def test_second_and_third_order_recursion(make_panel):
    from pyspark.sql import functions as F

    x = np.random.default_rng(6).normal(size=150)
    for coef, start in (([0.5, 0.3], [1.0, 2.0]), ([0.2, 0.1, 0.4], [1.0, 2.0, 3.0])):
        rows = make_panel({"s": x}).select("*", F.array(*map(F.lit, coef)).alias("c"), F.array(*map(F.lit, start)).alias("i"))
        past, want = list(start), []
        for v in x:
            y = v + sum(c * p for c, p in zip(coef, past))
            want.append(y)
            past = [y, *past[:-1]]
        got = frame(recursion.linear_recursion(rows, {"y": ("value", "i")}, "c", 2 * DAY))
        assert np.allclose(got["y"], want)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partition_count_does_not_matter(make_panel, holes, partitions):
    panel = make_panel(holes)
    base = frame(transform.log_returns(fill.fill(panel, "ffill", 20 * DAY), 20 * DAY))
    moved = frame(transform.log_returns(fill.fill(panel.repartition(partitions), "ffill", 20 * DAY), 20 * DAY))
    assert np.array_equal(base["value"], moved["value"], equal_nan=True)


def test_width_suggestion(make_panel):
    panel = make_panel({"a": range(100)})
    assert blocks.suggest_width(panel, 50) == 50 * DAY
    dense = panel.selectExpr("series_id", "timestamp_micros(unix_micros(ts) div 1000) as ts", "value")
    assert blocks.suggest_width(dense, 10) == DAY // 10


def test_hot_series_is_split_over_tasks(spark):
    """A series with nearly all rows must not end in one window partition."""
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(
        F.when(F.col("id") % 100 == 0, "small").otherwise("hot").alias("series_id"),
        F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
        F.col("id").cast("double").alias("value"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = blocks.lagged(rows, [1], 30 * DAY)
        sizes = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert len(sizes) >= 6 and sizes.max() < 20_000 * 0.5
