"""Streams in several micro-batches against the batch operators."""

import duckdb
import numpy as np
import pandas as pd
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelflow.operators import recursion, transform
from panelflow.sources.bars import resample_bars
from panelflow.streaming.bars import drain, read_ticks, stream_bars, stream_returns


def tick_files(spark, folder, n=240):
    rng = np.random.default_rng(1)
    start = pd.Timestamp("2024-01-01")
    rows = [
        (s, (start + pd.Timedelta(minutes=37 * i)).to_pydatetime(), i, float(100 + rng.normal())) for i in range(n) for s in ("a", "b")
    ]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, event_id long, value double")
    for part in range(4):
        low, high = part * n // 4, (part + 1) * n // 4
        df.filter(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
    return df


def test_returns_keep_state_between_batches(spark, tmp_path):
    df = tick_files(spark, str(tmp_path / "in"))
    stream = read_ticks(spark, str(tmp_path / "in"), files_per_batch=1)
    got = drain(stream_returns(stream.select("series_id", "ts", "value"), 0.9, "0 seconds"), str(tmp_path)).toPandas()
    returns = transform.log_returns(df.select("series_id", "ts", "value"))
    want = recursion.ewma(returns.withColumn("value", F.col("value") * F.col("value")), 0.9).toPandas()
    assert len(got) == len(want) == 2 * 239
    both = got.merge(want, on=["series_id", "ts"])
    assert len(both) == len(want) and np.allclose(both["ewma_variance"], both["ewma"])


def test_late_rows_are_dropped(spark, tmp_path):
    tick_files(spark, str(tmp_path / "in"))
    late = [("a", pd.Timestamp("2024-01-01 00:05").to_pydatetime(), 999, 5000.0)]
    spark.createDataFrame(late, "series_id string, ts timestamp, event_id long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_ticks(spark, str(tmp_path / "in"), files_per_batch=1).select("series_id", "ts", "value")
    got = drain(stream_returns(stream, 0.9, "0 seconds"), str(tmp_path)).toPandas()
    assert len(got) == 2 * 239 and got["log_return"].abs().max() < 1


def batch_returns(spark, rows, lam):
    """Returns and variance of rows in order of time and value, one by one."""
    out, last = [], {}
    for name, ts, value in sorted(rows, key=lambda x: (x[0], x[1], x[2] is None, x[2])):
        before, variance = last.get(name, (None, 0.0))
        if before is not None and value is not None and value > 0 and before > 0:
            change = np.log(value) - np.log(before)
            variance = lam * variance + (1 - lam) * change * change
            out.append((name, ts, change, variance))
        last[name] = (value, variance)
    return out


def write_batches(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, "series_id string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)


def shuffled_ticks(n=200):
    """Minutes 0..n in four batches; inside a window of 30 minutes, rows come in any order and batch. Ties and bad prices too."""
    rng = np.random.default_rng(4)
    start = pd.Timestamp("2024-01-01")
    rows = [(s, (start + pd.Timedelta(minutes=int(i))).to_pydatetime(), float(100 + rng.normal())) for i in range(n) for s in ("a", "b")]
    rows += [("a", rows[k][1], float(90 + k)) for k in range(0, 2 * n, 9)]
    rows += [("c", rows[3][1], None), ("c", rows[5][1], 5.0), ("c", rows[7][1], -1.0), ("c", rows[9][1], 6.0), ("c", rows[11][1], 7.0)]
    arrival = [(r[1] - start.to_pydatetime()).total_seconds() / 60 + rng.uniform(0, 30) for r in rows]
    order = np.argsort(arrival, kind="stable")
    return [[rows[i] for i in part] for part in np.array_split(order, 4)]


def same_returns(got, want):
    got = sorted(got.itertuples(index=False, name=None))
    want = sorted(want)
    assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want])


def test_rows_out_of_order_equal_the_batch_result(spark, tmp_path):
    batches = shuffled_ticks()
    write_batches(spark, str(tmp_path / "in"), batches)
    got = drain(stream_returns(read_ticks(spark, str(tmp_path / "in"), files_per_batch=1), 0.9, "30 minutes"), str(tmp_path)).toPandas()
    rows = [r for b in batches for r in b]
    reached = max(r[1] for r in rows) - pd.Timedelta(minutes=30)
    same_returns(got, [w for w in batch_returns(spark, rows, 0.9) if w[1] <= reached])


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    batches = shuffled_ticks()
    folder = str(tmp_path / "in")
    write_batches(spark, folder, batches[:2])
    first = drain(stream_returns(read_ticks(spark, folder, files_per_batch=1), 0.9, "30 minutes"), str(tmp_path)).count()
    write_batches(spark, folder, batches[2:])
    got = drain(stream_returns(read_ticks(spark, folder, files_per_batch=1), 0.9, "30 minutes"), str(tmp_path)).toPandas()
    rows = [r for b in batches for r in b]
    reached = max(r[1] for r in rows) - pd.Timedelta(minutes=30)
    assert 0 < first < len(got)
    same_returns(got, [w for w in batch_returns(spark, rows, 0.9) if w[1] <= reached])


def test_idle_series_start_anew(spark, tmp_path):
    at = lambda h: pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(hours=h)
    batches = [[("a", at(0), 1.0), ("a", at(1), 2.0), ("b", at(0), 1.0)], [("b", at(3), 2.0)], [("b", at(9), 3.0)], [("a", at(10), 8.0), ("a", at(11), 9.0), ("b", at(12), 4.0)]]
    write_batches(spark, str(tmp_path / "in"), batches)
    got = drain(stream_returns(read_ticks(spark, str(tmp_path / "in"), files_per_batch=1), 0.5, "0 seconds", idle="5 hours"), str(tmp_path)).toPandas()
    r = lambda x: np.log(x) ** 2 / 2
    want = [("a", at(1), np.log(2.0), r(2)), ("a", at(11), np.log(9 / 8), r(9 / 8)), ("b", at(3), np.log(2.0), r(2)), ("b", at(12), np.log(4 / 3), r(4 / 3))]
    same_returns(got, want)
    whole = drain(stream_returns(read_ticks(spark, str(tmp_path / "in")), 0.5, "0 seconds", idle="5 hours"), str(tmp_path / "once")).toPandas()
    same_returns(whole, want)


def test_bars_close_with_the_watermark(spark, tmp_path):
    df = tick_files(spark, str(tmp_path / "in"))
    bars = drain(stream_bars(read_ticks(spark, str(tmp_path / "in"), files_per_batch=1), "1d", "1 hour", tie="event_id"), str(tmp_path))
    whole = resample_bars(df, "1d", tie="event_id").toPandas().set_index(["symbol", "ts"])
    got = bars.toPandas().set_index(["symbol", "ts"])
    last_day = whole.index.get_level_values("ts").max()
    assert len(got) == len(whole) - 2 and last_day not in got.index.get_level_values("ts")
    for c in ("open", "high", "low", "close", "volume"):
        assert np.allclose(got[c], whole.loc[got.index, c])


def events_with_gaps(spark, folder):
    """Zeros alone, in a row and after a negative price; equal times with different prices; a series that ends in a missing price."""
    series = {"a": [3, 2, 0, 5, 4, 6], "b": [1, 0, 0, 2, 3, 4], "c": [2, 3, -1, 5, 0, 1], "d": [7, 6, 5, 8, None, 9], "e": [None, 1, 2, 0, 3, 4]}
    at = lambda i: pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(hours=i - (i == 5))
    rows = [(10 * i + k, at(i), n, None if v[i] is None else float(v[i])) for k, (n, v) in enumerate(series.items()) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").orderBy("event_id")
    df.toPandas().to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


def test_returns_of_zero_prices_equal_the_sql(spark, tmp_path):
    con = events_with_gaps(spark, tmp_path)
    name = "str02_stream_returns"
    ok, message = compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name])
    assert ok and message == "25 rows", message


def test_reached_returns_of_zero_prices_equal_the_sql(spark, tmp_path):
    con = events_with_gaps(spark, tmp_path)
    name = "str02_stream_returns_watermark"
    ok, message = compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name])
    assert ok and message == "15 rows", message


def test_undefined_variance_is_kept_between_batches(spark, tmp_path):
    at = lambda m: pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(minutes=m)
    prices = {"zero": [1.0, 0.0, 2.0, 3.0], "zeros": [0.0, 0.0, 2.0, 3.0], "gone": [1.0, None, 2.0, 3.0], "late": [1.0, 2.0, 3.0, None]}
    write_batches(spark, str(tmp_path / "in"), [[(n, at(i), v[i]) for n, v in prices.items()] for i in range(4)])
    stream = stream_returns(read_ticks(spark, str(tmp_path / "in"), files_per_batch=1), 0.5, "0 seconds", keep_undefined=True)
    got = {(x.series_id, (x.ts - at(0)).total_seconds() // 60): (x.log_return, x.ewma_variance) for x in drain(stream, str(tmp_path)).collect()}
    inf, two, three = np.inf, np.log(2.0), np.log(3.0)
    want = {
        "zero": [(-inf, inf), (inf, inf), (three - two, inf)],
        "zeros": [(np.nan, np.nan), (inf, np.nan), (three - two, np.nan)],
        "gone": [(None, None), (None, None), (three - two, None)],
        "late": [(two, two**2 / 2), (three - two, two**2 / 4 + (three - two) ** 2 / 2), (None, None)],
    }
    assert len(got) == 12
    for name, rows in want.items():
        for i, row in enumerate(rows, start=1):
            for g, w in zip(got[name, i], row):
                assert (g is None) == (w is None) and (w is None or np.isclose(g, w, equal_nan=True)), (name, i, g, w)
