"""Queries of the source, projection, filter, fill and transform operators."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelflow.functions.scalar import finalize, is_stationary, significance_label, variance_to_vol
from panelflow.operators import fill as fl
from panelflow.operators import stationarity, transform
from panelflow.operators.blocks import lagged
from panelflow.plans import panels as pn
from panelflow.plans.catalog import query
from panelflow.plans.panels import DAILY, HOURLY, MONTHLY
from panelflow.plans.sqltext import (
    EVENTS_H,
    LEVEL_EVENTS,
    ORDERS_D,
    ORDERS_M,
    RET_EVENTS,
    RET_ORDERS,
    SUPPLIER_M,
    W,
    cells,
    cents,
    chain,
    complete,
    ffill,
    iso,
    label_p,
    phi,
    r,
    returns,
)
from panelflow.plans.staging import checkpoint_root, stage
from panelflow.sources import bars, records, sinks

def bars_sql(unit: str, name: str = "b") -> str:
    order = "{'t': ts, 'i': event_id}"
    return (
        f"{name} AS (SELECT event_type AS symbol, date_trunc('{unit}', ts) AS ts, arg_min(value, {order}) AS open, "
        f"max(value) AS high, min(value) AS low, arg_max(value, {order}) AS close, arg_max(value, {order}) AS adj_close, "
        "count(*) AS volume FROM events GROUP BY 1, 2)"
    )


BAR_COLS = f"symbol, {iso()} AS ts, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, {r('adj_close')} AS adj_close, volume"
DAILY_BARS = bars_sql("day")


def folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def landed_bars(spark: SparkSession, sf_dir: str, fmt: str = "parquet") -> str:
    path = folder(spark, "bars")
    pn.event_bars(spark, sf_dir).write.partitionBy("symbol").format(fmt).save(path)
    return path


def symbols(bars_: DataFrame) -> list[str]:
    """Column names come from the data: one entry per event type."""
    return [x["symbol"] for x in bars_.select("symbol").distinct().orderBy("symbol").collect()]


@query("src01_read_bars", chain(DAILY_BARS) + f" SELECT {BAR_COLS} FROM b WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
def read_bars(spark, sf_dir):
    path = landed_bars(spark, sf_dir)
    return finalize(bars.read_bars(spark, path, "parquet", None, "2024-01-01", "2024-02-01"))


@query(
    "src02_close_panel",
    chain(DAILY_BARS, "p AS (SELECT symbol AS series_id, ts, close AS value FROM b)", cells())
    + f" SELECT series_id, {iso()} AS ts, {r('value')} AS value FROM c",
)
def close_panel(spark, sf_dir):
    path = landed_bars(spark, sf_dir)
    panel, _ = bars.read_close_panel(spark, path, [*symbols(spark.read.parquet(path)), "absent"], width=HOURLY)
    return finalize(panel)


@query(
    "src02_fetch_status",
    chain(DAILY_BARS)
    + " SELECT symbol AS series_id, count(close) AS rows, 'ok' AS status FROM b GROUP BY 1 UNION ALL SELECT 'absent', 0, 'missing'",
)
def fetch_status(spark, sf_dir):
    path = landed_bars(spark, sf_dir)
    return bars.read_close_panel(spark, path, [*symbols(spark.read.parquet(path)), "absent"], width=HOURLY)[1]


@query("src03_resample_day", chain(DAILY_BARS) + f" SELECT {BAR_COLS} FROM b")
def resample_day(spark, sf_dir):
    return finalize(pn.event_bars(spark, sf_dir, "1d"))


@query("src03_resample_week", chain(bars_sql("week")) + f" SELECT {BAR_COLS} FROM b")
def resample_week(spark, sf_dir):
    return finalize(pn.event_bars(spark, sf_dir, "1wk"))


@query(
    "src04_calendar",
    f"""WITH s AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders),
    d AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM s),
    o AS (SELECT date_trunc('day', o_orderdate) AS ts, count(*) AS n FROM orders GROUP BY 1)
    SELECT {iso('d.ts')} AS ts, coalesce(n, 0) AS n_orders FROM d LEFT JOIN o ON o.ts = d.ts WHERE isodow(d.ts) <= 5""",
)
def calendar(spark, sf_dir):
    orders = pn.table(spark, sf_dir, "orders")
    lo, hi = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    spine = bars.calendar_spine(spark, f"{lo:%Y-%m-%d}", f"{hi:%Y-%m-%d}", "B")
    per_day = orders.groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return finalize(spine.join(per_day, "ts", "left").select("ts", F.coalesce("n", F.lit(0)).alias("n_orders")))


@query(
    "src05_infer_panel",
    f"""SELECT 'o_totalprice' AS series_id, {iso('o_orderdate')} AS ts, {r('o_totalprice', 2)} AS value FROM orders
    UNION ALL SELECT 'o_custkey', {iso('o_orderdate')}, {r('CAST(o_custkey AS DOUBLE)', 2)} FROM orders""",
)
def infer_panel(spark, sf_dir):
    wide = pn.table(spark, sf_dir, "orders").select(
        "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), "o_totalprice", "o_custkey"
    )
    return finalize(records.infer_panel(wide), 2)


@query("src06_records", chain(DAILY_BARS) + f" SELECT symbol, {iso()} AS ts, {r('close')} AS close, volume FROM b")
def records_round_trip(spark, sf_dir):
    text = records.to_records(pn.event_bars(spark, sf_dir).select("ts", "symbol", "close", "volume"))
    parsed = records.parse_records(text, "date string, symbol string, close double, volume long")
    return finalize(parsed.select("symbol", "ts", "close", "volume"))


@query("src06_read_records", chain(DAILY_BARS) + f" SELECT symbol, {iso()} AS ts, {r('close')} AS close FROM b")
def read_records(spark, sf_dir):
    path = folder(spark, "records")
    records.to_records(pn.event_bars(spark, sf_dir).select("ts", "symbol", "close")).write.text(path)
    rows = records.read_records(spark, path, "date string, symbol string, close double")
    return finalize(rows.select("symbol", "ts", "close"))


@query("src07_nested_bars", chain(DAILY_BARS) + f" SELECT {BAR_COLS} FROM b")
def nested_bars(spark, sf_dir):
    return finalize(bars.unnest_bars(bars.nested_bars(pn.event_bars(spark, sf_dir))))


@query("src08_flatten_bars", chain(DAILY_BARS) + f" SELECT symbol, {iso()} AS ts, {r('close')} AS close, volume FROM b")
def flatten_bars(spark, sf_dir):
    daily = stage(pn.event_bars(spark, sf_dir), "bars")
    wide = bars.widen_bars(daily, symbols(daily), ("close", "volume"))
    return finalize(bars.flatten_bars(wide).select("symbol", "ts", "close", "volume"))


@query("snk01_write_stage", chain(ORDERS_M) + f" SELECT series_id, {iso()} AS ts, {r('value', 9)} AS value FROM p")
def write_stage(spark, sf_dir):
    root = folder(spark, "run")
    panel = finalize(pn.orders_panel(spark, sf_dir), 9)
    sinks.write_stage(panel, root, "r1", 1, "prices")
    back = spark.read.schema(panel.schema).option("header", "true").csv(f"{root}/r1/001--prices.csv")
    return finalize(back, 9)


ADF0 = f"""d AS (SELECT series_id, value - lag(value) OVER w AS dy, lag(value) OVER w AS y1 FROM x {W}),
g AS (SELECT series_id, count(*) AS t, regr_slope(dy, y1) AS b, regr_sxx(dy, y1) AS sxx,
      regr_syy(dy, y1) - regr_slope(dy, y1) * regr_sxy(dy, y1) AS ssr FROM d WHERE dy IS NOT NULL GROUP BY 1),
a AS (SELECT series_id, t, b / sqrt(ssr / (t - 2) / sxx) AS tau FROM g),
z AS (SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau
      ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END AS q FROM a),
adf AS (SELECT series_id, t, tau, CASE WHEN tau < -18.83 THEN 0.0 WHEN tau > 2.74 THEN 1.0 ELSE {phi('q')} END AS p_value FROM z)"""


@query(
    "snk02_run_log",
    chain(*RET_ORDERS, ADF0)
    + f""", o AS (SELECT series_id, {r('tau')} AS adf_statistic, {r('p_value')} AS p_value, p_value < 0.05 AS is_stationary FROM adf)
    SELECT 'completed' AS status, 2 AS n_events, 'stationarity' AS result_type, * FROM o""",
)
def run_log(spark, sf_dir):
    root = folder(spark, "log")
    adf = stage(stationarity.adf_test(pn.orders_returns(spark, sf_dir), 0, width=MONTHLY), "adf")
    sinks.write_run(spark, root, "r1", "orders", "running", source_type="table")
    rows = sinks.result_rows(adf, "stationarity", is_stationary="is_stationary", adf_statistic="adf_statistic", p_value="p_value")
    sinks.write_results(rows, root, "r1")
    sinks.write_run(spark, root, "r1", "orders", "completed", source_type="table")
    status = sinks.run_status(spark.read.parquet(f"{root}/runs"))
    results = spark.read.parquet(f"{root}/results")
    return finalize(
        results.join(status, "run_id").select(
            "status", F.col("n_events").cast("int"), "result_type", "series_id", "adf_statistic", "p_value", "is_stationary"
        )
    )


@query(
    "snk03_finalize",
    chain(ORDERS_M)
    + f""" SELECT series_id, {iso()} AS ts, {r('value', 6)} AS value, CAST(NULL AS DOUBLE) AS not_number, CAST(NULL AS DOUBLE) AS infinite,
    {r('value / 7', 6)} AS first_item, CAST(NULL AS DOUBLE) AS second_item, {r('value / 3', 6)} AS mapped FROM p""",
)
def finalize_query(spark, sf_dir):
    v = F.col("value")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    df = pn.orders_panel(spark, sf_dir).select(
        "series_id",
        "ts",
        "value",
        (v * nan).alias("not_number"),
        (v * -inf).alias("infinite"),
        F.struct(F.array(v / 7, nan).alias("items"), F.create_map(F.lit("k"), v / 3).alias("m")).alias("s"),
    )
    out = finalize(df, 6)
    return out.select(
        "series_id", "ts", "value", "not_number", "infinite", out.s["items"][0].alias("first_item"),
        out.s["items"][1].alias("second_item"), out.s["m"]["k"].alias("mapped"),
    )


@query("prj01_select_numeric", f"SELECT c_custkey, c_nationkey, {r('c_acctbal', 2)} AS c_acctbal FROM customer")
def select_numeric(spark, sf_dir):
    return finalize(records.select_numeric(pn.table(spark, sf_dir, "customer")), 2)


@query("prj02_pick_target", f"SELECT {iso('o_orderdate')} AS ts, {r('o_totalprice', 2)} AS value FROM orders")
def pick_target(spark, sf_dir):
    df = pn.table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").alias("date"), F.col("o_totalprice").cast("string").alias("price")
    )
    return finalize(records.pick_target(df), 2)


MIXED = "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE substr(o_orderpriority, 1, 1) END"


@query(
    "prj03_coerce_numeric",
    f"""SELECT o_orderkey, TRY_CAST({MIXED} AS DOUBLE) + 0.0 AS v, TRY_CAST({MIXED} AS DOUBLE) IS NULL AS is_bad FROM orders""",
)
def coerce_numeric(spark, sf_dir):
    df = pn.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(MIXED).alias("v"))
    return finalize(records.coerce_numeric(df, "v"))


@query(
    "prj04_map_points",
    chain(DAILY_BARS)
    + f""" SELECT {iso()} AS date, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume,
    {r('close - open')} AS returns, {r('close / 100')} AS scaled FROM b""",
)
def map_points(spark, sf_dir):
    df = pn.event_bars(spark, sf_dir).select(
        F.col("ts").alias("date"),
        F.col("open").alias("Open"),
        F.col("high").alias("High"),
        F.col("low").alias("LOW"),
        "close",
        F.col("volume").cast("double").alias("Volume"),
        (F.col("close") - F.col("open")).alias("Daily_Return"),
        (F.col("close") / 100).alias("close_scaled"),
        F.col("symbol").alias("other"),
    )
    return finalize(records.map_points(df))


@query("prj05_select_close", chain(DAILY_BARS) + f" SELECT symbol AS series_id, {iso()} AS ts, {r('adj_close')} AS value FROM b")
def select_close(spark, sf_dir):
    return finalize(bars.select_close(pn.event_bars(spark, sf_dir), "adj_close"))


@query(
    "flt01_filter_range",
    chain(ORDERS_D)
    + f" SELECT series_id, {iso()} AS ts, {r('value', 9)} AS value FROM p WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2001-08-01'",
)
def filter_range(spark, sf_dir):
    return finalize(fl.filter_range(pn.orders_panel(spark, sf_dir, "day"), "1995-01-01", "2001-08-01"), 9)


@query(
    "flt02_order_limits",
    chain(SUPPLIER_M)
    + """, n AS (SELECT series_id, count(value) AS n_obs FROM p GROUP BY 1)
    SELECT series_id, n_obs, n_obs >= 15 AS granger_ok, CASE WHEN n_obs < 30 THEN 1 ELSE 2 END AS arima_p,
    CASE WHEN n_obs < 30 THEN 1 ELSE 4 END AS arima_q, CAST(greatest(1, least(5, n_obs // 3)) AS INTEGER) AS var_max_lag FROM n""",
)
def order_limits(spark, sf_dir):
    return fl.order_limits(pn.supplier_panel(spark, sf_dir))


@query(
    "flt02_require_min_obs",
    chain(SUPPLIER_M)
    + f" SELECT series_id, {iso()} AS ts, {r('value', 9)} AS value FROM p WHERE series_id IN (SELECT series_id FROM p GROUP BY 1 HAVING count(value) >= 80)",
)
def require_min_obs(spark, sf_dir):
    return finalize(fl.require_min_obs(stage(pn.supplier_panel(spark, sf_dir)), 80, MONTHLY), 9)


@query(
    "flt03_is_stationary",
    chain(SUPPLIER_M, returns("p", "x"), ADF0) + f" SELECT series_id, {r('p_value')} AS p_value, p_value < 0.05 AS is_stationary FROM adf",
)
def stationary_flag(spark, sf_dir):
    x = stage(transform.log_returns(stage(pn.supplier_panel(spark, sf_dir)), MONTHLY))
    adf = stationarity.adf_test(x, 0, width=MONTHLY)
    return finalize(adf.select("series_id", "p_value", is_stationary(F.col("p_value"), 0.05).alias("is_stationary")))


LONG = f"series_id, {iso()} AS ts, {r('value', 9)} AS value"


@query("fil01_drop", chain(ORDERS_D, cells(), complete()) + f" SELECT {LONG} FROM k")
def fill_drop(spark, sf_dir):
    return finalize(fl.fill(fl.align_outer(stage(pn.orders_panel(spark, sf_dir, "day")), DAILY), "drop"), 9)


def filled(strategy: str, places: int = 9):
    def run(spark, sf_dir):
        aligned = stage(fl.align_outer(stage(pn.orders_panel(spark, sf_dir, "day")), DAILY))
        return finalize(fl.fill(aligned, strategy, DAILY), places)

    return run


query("fil02_ffill", chain(ORDERS_D, cells(), ffill()) + f" SELECT {LONG} FROM f")(filled("forward_fill"))
query(
    "fil03_bfill",
    chain(
        ORDERS_D,
        cells(),
        "f AS (SELECT series_id, ts, first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts "
        "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM c)",
    )
    + f" SELECT {LONG} FROM f",
)(filled("backward_fill"))
INTERPOLATE = f"""n AS (SELECT *, row_number() OVER w AS i FROM c {W}),
u AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS j FROM n),
m AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(j IGNORE NULLS) OVER b AS pj,
  first_value(value IGNORE NULLS) OVER a AS nv, first_value(j IGNORE NULLS) OVER a AS nj FROM u
  WINDOW b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT series_id, ts, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
  ELSE pv + (nv - pv) * ((i - pj) / (nj - pj)) END AS value FROM m)"""
query("fil04_interpolate", chain(ORDERS_D, cells(), INTERPOLATE) + f" SELECT series_id, {iso()} AS ts, {r('value')} AS value FROM f")(filled("interpolate", 6))

REGULAR = """s AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY 1),
g AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM s),
c AS (SELECT g.series_id, g.ts, p.value FROM g LEFT JOIN p ON p.series_id = g.series_id AND p.ts = g.ts)"""


@query("fil05_regularize", chain(ORDERS_D, REGULAR) + f" SELECT {LONG} FROM c")
def regularize(spark, sf_dir):
    return finalize(fl.regularize(stage(pn.orders_panel(spark, sf_dir, "day")), "day", DAILY), 9)


AT_FOUR = f"""p AS (SELECT event_type AS series_id, date_trunc('day', ts) + INTERVAL 16 HOUR AS ts, {cents('value')} AS value
FROM events GROUP BY 1, 2)"""


def closes_at_four(spark, sf_dir):
    """Daily values stamped 16:00, with missing days."""
    at = (F.date_trunc("day", "ts") + F.expr("INTERVAL 16 HOURS")).alias("ts")
    ticks = pn.table(spark, sf_dir, "events").select("event_type", at, "value")
    return stage(ticks.groupBy(F.col("event_type").alias("series_id"), "ts").agg(pn._mean_cents("value")))


@query("fil05_regularize_at_four", chain(AT_FOUR, REGULAR) + f" SELECT {LONG} FROM c")
def regularize_at_four(spark, sf_dir):
    return finalize(fl.regularize(closes_at_four(spark, sf_dir), "day", DAILY), 9)


@query(
    "fil05_regularize_week",
    chain(
        AT_FOUR,
        """s AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY 1),
        g AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS ts FROM s),
        c AS (SELECT g.series_id, g.ts, p.value FROM g LEFT JOIN p ON p.series_id = g.series_id AND p.ts = g.ts)""",
    )
    + f" SELECT {LONG} FROM c",
)
def regularize_week(spark, sf_dir):
    return finalize(fl.regularize(closes_at_four(spark, sf_dir), "week", DAILY), 9)


@query(
    "fil06_missing_report",
    chain(ORDERS_D, REGULAR)
    + f""" SELECT series_id, count(*) AS total_observations, count(*) FILTER (value IS NULL) AS missing_values,
    {r('1 - count(*) FILTER (value IS NULL) / count(*)')} AS completeness, {iso('min(ts)')} AS first_date, {iso('max(ts)')} AS last_date FROM c GROUP BY 1""",
)
def missing_report(spark, sf_dir):
    return finalize(fl.missing_report(fl.regularize(stage(pn.orders_panel(spark, sf_dir, "day")), "day", DAILY)))


@query(
    "fil06_panel_report",
    chain(ORDERS_D, cells())
    + f""" SELECT count(*) AS total_cells, count(*) FILTER (value IS NULL) AS missing_values,
    {r('1 - count(*) FILTER (value IS NULL) / count(*)')} AS completeness, {iso('min(ts)')} AS first_date, {iso('max(ts)')} AS last_date FROM c""",
)
def panel_report(spark, sf_dir):
    return finalize(fl.panel_report(fl.align_outer(stage(pn.orders_panel(spark, sf_dir, "day")), DAILY)))


@query(
    "fil07_refill",
    chain(ORDERS_D, cells(), ffill(), returns("f", "x"), complete("x", "y")) + f" SELECT series_id, {iso()} AS ts, {r('value')} AS value FROM y",
)
def refill(spark, sf_dir):
    aligned = stage(fl.align_outer(stage(pn.orders_panel(spark, sf_dir, "day")), DAILY))
    returns_ = stage(transform.log_returns(stage(fl.fill(aligned, "ffill", DAILY)), DAILY))
    return finalize(fl.fill(returns_, "drop"))


@query("fil08_align_outer", chain(EVENTS_H, cells()) + f" SELECT {LONG} FROM c")
def align_outer(spark, sf_dir):
    return finalize(fl.align_outer(stage(pn.events_panel(spark, sf_dir)), HOURLY), 9)


RET = f"series_id, {iso()} AS ts, {r('value')} AS value"


@query("xf01_log_returns", chain(SUPPLIER_M, returns("p", "x")) + f" SELECT {RET} FROM x")
def log_returns(spark, sf_dir):
    return finalize(transform.log_returns(stage(pn.supplier_panel(spark, sf_dir)), MONTHLY))


def scaled(method: str, to_returns: bool = False):
    def run(spark, sf_dir):
        return finalize(transform.scale(stage(pn.events_panel(spark, sf_dir)), method, to_returns, HOURLY))

    return run


def scale_sql(center: str, spread: str, src: str = "p") -> str:
    return f", s AS (SELECT series_id, {center} AS c, {spread} AS d FROM {src} GROUP BY 1) SELECT {src}.series_id, {iso(src + '.ts')} AS ts, {r(f'CASE WHEN d > 0 THEN (value - c) / d END')} AS value FROM {src} JOIN s USING (series_id)"


query("xf02_standardize", chain(EVENTS_H) + scale_sql("avg(value)", "stddev_samp(value)"))(scaled("standardize"))
query("xf03_minmax", chain(EVENTS_H) + scale_sql("min(value)", "max(value) - min(value)"))(scaled("minmax"))
query("xf04_robust", chain(EVENTS_H) + scale_sql("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"))(scaled("robust"))
query("xf05_scaled_returns", chain(EVENTS_H, returns("p", "x")) + scale_sql("avg(value)", "stddev_samp(value)", "x"))(scaled("standardize", True))


@query(
    "xf06_scale_for_garch",
    chain(*RET_EVENTS)
    + f""", s AS (SELECT series_id, avg(value) AS m, 10.0 / stddev_samp(value) AS f FROM x GROUP BY 1)
    SELECT x.series_id, {iso('x.ts')} AS ts, {r('(value - m) * f')} AS value, {r('m')} AS shift, {r('f')} AS factor FROM x JOIN s USING (series_id)""",
)
def scale_for_garch(spark, sf_dir):
    return finalize(transform.scale_for_garch(pn.event_returns(spark, sf_dir), 10.0, True, HOURLY))


def stationarized(method: str):
    def run(spark, sf_dir):
        return finalize(transform.stationarize(stage(pn.supplier_panel(spark, sf_dir)), method, width=MONTHLY), 9 if method == "difference" else 6)

    return run


STEP = f"x AS (SELECT * FROM (SELECT series_id, ts, value - lag(value) OVER w AS dv, value / lag(value) OVER w - 1 AS pc, row_number() OVER w AS rn FROM p {W}) WHERE rn > 1)"
query("xf07_difference", chain(SUPPLIER_M, STEP) + f" SELECT series_id, {iso()} AS ts, {r('dv', 9)} AS value FROM x")(stationarized("difference"))
query("xf08_log", chain(SUPPLIER_M) + f" SELECT series_id, {iso()} AS ts, {r('ln(value)')} AS value FROM p")(stationarized("log"))
query("xf09_percentage_change", chain(SUPPLIER_M, STEP) + f" SELECT series_id, {iso()} AS ts, {r('pc')} AS value FROM x")(stationarized("percentage_change"))


@query(
    "xf10_second_difference",
    chain(
        SUPPLIER_M,
        f"x AS (SELECT series_id, ts, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS v, row_number() OVER w AS rn FROM p {W})",
    )
    + f" SELECT series_id, {iso()} AS ts, {r('v', 7)} AS value FROM x WHERE rn > 2",
)
def second_difference(spark, sf_dir):
    return finalize(transform.difference(stage(pn.supplier_panel(spark, sf_dir)), 2, MONTHLY), 7)


@query("xf10_undifference", chain(SUPPLIER_M, STEP) + f" SELECT p.series_id, {iso('p.ts')} AS ts, {r('p.value', 6)} AS value FROM p JOIN x USING (series_id, ts)")
def undifference(spark, sf_dir):
    panel = stage(pn.supplier_panel(spark, sf_dir))
    start = panel.groupBy("series_id").agg(F.min_by("value", "ts").alias("anchor"))
    return finalize(transform.undifference(transform.difference(panel, 1, MONTHLY), start, MONTHLY), 6)


@query(
    "xf11_cumulative_path",
    chain(
        *RET_EVENTS,
        f"t AS (SELECT series_id, ts, value, sum(value) OVER w AS s, first_value(value) OVER w AS f0 FROM x {W})",
        "a AS (SELECT event_type AS series_id, CAST(count(*) AS DOUBLE) AS anchor FROM events GROUP BY 1)",
    )
    + f" SELECT t.series_id, {iso('t.ts')} AS ts, {r('anchor + s - f0')} AS value FROM t JOIN a USING (series_id)",
)
def cumulative_path(spark, sf_dir):
    anchors = pn.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id")).agg(
        F.count(F.lit(1)).cast("double").alias("anchor")
    )
    return finalize(transform.cumulative_path(pn.event_returns(spark, sf_dir), anchors, HOURLY))


@query("xf12_significance_label", f"SELECT l_orderkey, l_linenumber, {label_p('l_tax')} AS label FROM lineitem")
def labels(spark, sf_dir):
    return pn.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", significance_label(F.col("l_tax")).alias("label"))


@query("xf13_variance_to_vol", f"SELECT event_id, {r('sqrt(value)')} AS volatility FROM events")
def vol(spark, sf_dir):
    return finalize(pn.table(spark, sf_dir, "events").select("event_id", variance_to_vol(F.col("value")).alias("volatility")))


@query(
    "xf14_forecast_lists",
    chain(SUPPLIER_M, f"n AS (SELECT series_id, value, row_number() OVER w AS step FROM p {W})")
    + f" SELECT series_id, CAST(step AS INTEGER) AS step, {r('value', 9)} AS value FROM n",
)
def forecast_lists(spark, sf_dir):
    rows = lagged(stage(pn.supplier_panel(spark, sf_dir)), [], MONTHLY).select("series_id", F.col("pos").alias("step"), "value")
    return finalize(transform.explode_forecast(transform.collect_forecast(rows)), 9)


@query(
    "xf15_mean_component",
    chain(*LEVEL_EVENTS, f"e AS (SELECT series_id, ts, value - lag(value) OVER w AS d, lag(value) OVER w AS m FROM k {W})")
    + f" SELECT series_id, {iso()} AS ts, {r('m', 6)} AS value FROM e WHERE d IS NOT NULL",
)
def mean_component(spark, sf_dir):
    level = pn.event_levels(spark, sf_dir)
    return finalize(transform.mean_component(level, transform.difference(level, 1, HOURLY)), 6)
