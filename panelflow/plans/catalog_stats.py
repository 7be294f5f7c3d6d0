"""Queries of the aggregation, window, join and top-k operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.functions.scalar import finalize, var_param_count
from panelflow.operators import aggregate, correlated, matrices, moments, recursion, stationarity, transform
from panelflow.operators.blocks import lagged, leading, neighbours, rolling
from panelflow.plans import panels as pn
from panelflow.plans.catalog import query
from panelflow.plans.catalog_data import ADF0
from panelflow.plans.panels import DAILY, HOURLY, MONTHLY
from panelflow.plans.sqltext import (
    EVENTS_H,
    LEVEL_EVENTS,
    ORDERS_D,
    RET_EVENTS,
    RET_NATION,
    RET_ORDERS,
    SUPPLIER_M,
    W,
    cells,
    chain,
    iso,
    numbered,
    r,
    recursive,
    returns,
)
from panelflow.plans.staging import stage

MOMENTS = f"""count(value) AS n, {r('avg(value)')} AS mean, {r('min(value)')} AS min, {r('max(value)')} AS max,
{r('stddev_samp(value)')} AS std, {r('skewness(value)')} AS skew, {r('kurtosis(value)')} AS kurt"""


@query(
    "agg01_series_stats",
    chain(*RET_ORDERS, "s AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS d FROM x GROUP BY 1)",
          "z AS (SELECT x.series_id, (value - m) / d AS value FROM x JOIN s USING (series_id))")
    + f" SELECT series_id, {MOMENTS}, {r('stddev_samp(value) * sqrt(252)')} AS annualized_vol, {r('median(value)')} AS median FROM z GROUP BY 1",
)
def series_stats(spark, sf_dir):
    scaled = stage(transform.scale(pn.orders_returns(spark, sf_dir), "standardize", width=MONTHLY), "scaled")
    return finalize(aggregate.series_stats(scaled, width=MONTHLY))


@query(
    "agg01_supplier_stats",
    chain(SUPPLIER_M, returns("p", "x"))
    + f" SELECT series_id, {MOMENTS}, {r('stddev_samp(value) * sqrt(252)')} AS annualized_vol, {r('median(value)')} AS median FROM x GROUP BY 1",
)
def supplier_stats(spark, sf_dir):
    x = stage(transform.log_returns(stage(pn.supplier_panel(spark, sf_dir)), MONTHLY))
    return finalize(aggregate.series_stats(x, width=MONTHLY))


@query(
    "agg02_residual_stats",
    chain(*RET_EVENTS, f"l AS (SELECT *, lag(value) OVER w AS b FROM x {W})")
    + f" SELECT series_id, {MOMENTS}, {r('var_samp(value)')} AS variance, {r('corr(value, b)')} AS autocorr_lag1 FROM l GROUP BY 1",
)
def residual_stats(spark, sf_dir):
    return finalize(aggregate.residual_stats(pn.event_returns(spark, sf_dir), HOURLY))


@query(
    "agg03_autocorr",
    chain(SUPPLIER_M, f"l AS (SELECT *, lag(value, 2) OVER w AS b FROM p {W})")
    + f" SELECT series_id, count(value) AS n, {r('corr(value, b)')} AS autocorr FROM l GROUP BY 1",
)
def autocorr(spark, sf_dir):
    return finalize(aggregate.autocorr(stage(pn.supplier_panel(spark, sf_dir)), 2, MONTHLY))


@query(
    "agg04_error_metrics",
    chain(SUPPLIER_M, returns("p", "x"))
    + f" SELECT series_id, {r('avg(abs(value))')} AS mae, {r('sqrt(avg(value * value))')} AS rmse, {r('avg(value)')} AS mean_error FROM x GROUP BY 1",
)
def error_metrics(spark, sf_dir):
    return finalize(aggregate.error_metrics(transform.log_returns(stage(pn.supplier_panel(spark, sf_dir)), MONTHLY)))


FORECAST = f"n AS (SELECT series_id, value, row_number() OVER w AS step FROM p {W})"
FSTATS = """fs AS (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
arg_min(value, step) AS first, arg_max(value, step) AS last FROM n GROUP BY 1)"""
FSTAT_COLS = f"""series_id, {r('mean')} AS mean, {r('std')} AS std, {r('min')} AS min, {r('max')} AS max, {r('first')} AS first,
{r('last')} AS last, {r('(last - first) / first')} AS change, {r('std / abs(mean)')} AS cv"""


def step_table(spark, sf_dir):
    return lagged(stage(pn.supplier_panel(spark, sf_dir)), [], MONTHLY).select("series_id", F.col("pos").alias("step"), "value")


@query("agg05_forecast_stats", chain(SUPPLIER_M, FORECAST, FSTATS) + f" SELECT {FSTAT_COLS} FROM fs")
def forecast_stats(spark, sf_dir):
    return finalize(aggregate.forecast_stats(step_table(spark, sf_dir)))


def pair_sql(op: str, src: str = "x", diagonal: bool = True) -> str:
    cond = "<=" if diagonal else "<"
    return f"pr AS (SELECT a.series_id AS row_id, b.series_id AS col_id, count(*) AS n, {op} FROM {src} a JOIN {src} b ON a.ts = b.ts AND a.series_id {cond} b.series_id GROUP BY 1, 2)"


CORR = pair_sql("corr(a.value, b.value) AS value")
COV = pair_sql("covar_samp(a.value, b.value) AS value")


def nation_pairs(spark, sf_dir):
    return moments.pair_correlations(pn.nation_returns(spark, sf_dir), MONTHLY)


def as_value(pairs, name):
    return pairs.select("row_id", "col_id", F.col(name).alias("value"))


@query("agg06_corr_matrix", chain(*RET_NATION, CORR) + f" SELECT row_id, col_id, n, {r('value')} AS value FROM pr")
def corr_matrix(spark, sf_dir):
    return finalize(nation_pairs(spark, sf_dir).select("row_id", "col_id", "n", F.col("corr").alias("value")))


@query("agg07_cov_matrix", chain(*RET_NATION, COV) + f" SELECT row_id, col_id, {r('value', 8)} AS value FROM pr")
def cov_matrix(spark, sf_dir):
    return finalize(as_value(nation_pairs(spark, sf_dir), "cov"), 8)


@query(
    "agg07_ragged_panel",
    chain(EVENTS_H, "x AS (SELECT * FROM p)", pair_sql("covar_samp(a.value, b.value) AS cov, corr(a.value, b.value) AS corr"))
    + f" SELECT row_id, col_id, n, {r('cov')} AS cov, {r('corr')} AS corr FROM pr",
)
def ragged_pairs(spark, sf_dir):
    return finalize(moments.pair_correlations(stage(pn.events_panel(spark, sf_dir)), HOURLY))


BUCKET = "CASE WHEN abs(value) > 0.7 THEN 'high' WHEN abs(value) > 0.3 THEN 'moderate' ELSE 'low' END"


@query(
    "agg08_corr_buckets",
    chain(*RET_NATION, CORR) + f" SELECT {BUCKET} AS bucket, count(*) AS n_pairs, {r('avg(value)')} AS mean_corr FROM pr WHERE row_id < col_id GROUP BY 1",
)
def corr_buckets(spark, sf_dir):
    return finalize(aggregate.corr_buckets(as_value(nation_pairs(spark, sf_dir), "corr")))


@query("agg08_labelled_pairs", chain(*RET_NATION, CORR) + f" SELECT row_id, col_id, {r('value')} AS value, {BUCKET} AS bucket FROM pr WHERE row_id < col_id")
def labelled_pairs(spark, sf_dir):
    return finalize(aggregate.labelled_pairs(as_value(nation_pairs(spark, sf_dir), "corr")))


PROFILE = """st AS (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS std, stddev_samp(value) AS std_sample, min(value) AS min,
  max(value) AS max, count(value) AS n, median(value) AS median FROM {src} GROUP BY 1),
pf AS (SELECT st.*, h.n_high, h.n_low FROM st JOIN (SELECT {src}.series_id, count(*) FILTER (value > mean + std) AS n_high,
  count(*) FILTER (value < mean - std) AS n_low FROM {src} JOIN st USING (series_id) GROUP BY 1) h USING (series_id))"""
PROFILE_COLS = f"""series_id, {r('mean')} AS mean, {r('std')} AS std, {r('std_sample')} AS std_sample, {r('min')} AS min, {r('max')} AS max,
n, n_high, n_low, {r('median')} AS median, {r('n_high / n')} AS share_high, {r('n_low / n')} AS share_low"""


@query("agg09_series_profile", chain(*RET_EVENTS, PROFILE.format(src="x")) + f" SELECT {PROFILE_COLS} FROM pf")
def profile(spark, sf_dir):
    return finalize(aggregate.corr_series_profile(pn.event_returns(spark, sf_dir), HOURLY))


# A row-normalised matrix made from the trade between regions: the shape every matrix operator takes.
TRADE = """t AS (SELECT a.n_name AS row_id, b.n_name AS col_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2),
fv AS (SELECT row_id, col_id, v / sum(v) OVER (PARTITION BY row_id) * 100 AS value FROM t)"""


def trade_matrix(spark, sf_dir):
    """Share of each customer nation's purchases by supplier nation, rows sum to 100."""
    nation = pn.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyers = pn.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("row_id"))
    sellers = pn.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("col_id"))
    orders = pn.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    items = pn.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    by_order = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    cells_ = stage(by_order.groupBy("row_id", "col_id").agg(F.sum("cents").cast("double").alias("v")), "trade")
    totals = cells_.groupBy("row_id").agg(F.sum("v").alias("t"))
    return stage(cells_.join(totals, "row_id").select("row_id", "col_id", (F.col("v") / F.col("t") * 100).alias("value")), "shares")


@query("flt04_exclude_self", chain(TRADE) + f" SELECT row_id, col_id, {r('value')} AS value FROM fv WHERE row_id <> col_id")
def exclude_self(spark, sf_dir):
    return finalize(matrices.exclude_self(trade_matrix(spark, sf_dir)))


@query("agg10_pairwise", chain(TRADE) + f" SELECT col_id AS source, row_id AS target, {r('value')} AS value FROM fv WHERE row_id <> col_id")
def pairwise(spark, sf_dir):
    return finalize(matrices.pairwise(trade_matrix(spark, sf_dir)))


NET = """nt AS (SELECT n.n_name AS series_id, coalesce((SELECT sum(value) FROM fv WHERE row_id = n.n_name AND col_id <> n.n_name), 0) AS from_others,
  coalesce((SELECT sum(value) FROM fv WHERE col_id = n.n_name AND row_id <> n.n_name), 0) AS to_others FROM nation n
  WHERE n.n_name IN (SELECT row_id FROM fv WHERE row_id <> col_id UNION SELECT col_id FROM fv WHERE row_id <> col_id)),
nn AS (SELECT *, to_others - from_others AS net FROM nt)"""


@query("agg10_directional", chain(TRADE, NET) + f" SELECT series_id, {r('from_others')} AS from_others, {r('to_others')} AS to_others, {r('net')} AS net FROM nn")
def directional(spark, sf_dir):
    return finalize(matrices.directional(trade_matrix(spark, sf_dir)))


@query("agg10_total", chain(TRADE) + f" SELECT {r('sum(CASE WHEN row_id <> col_id THEN value ELSE 0 END) / sum(value) * 100')} AS total FROM fv")
def total(spark, sf_dir):
    return finalize(matrices.total_spillover(trade_matrix(spark, sf_dir)))


@query("agg11_row_check", chain(TRADE) + f" SELECT row_id, {r('sum(value)')} AS row_sum, abs(sum(value) - 100) < 0.000001 AS ok FROM fv GROUP BY 1")
def row_check(spark, sf_dir):
    return finalize(matrices.row_check(trade_matrix(spark, sf_dir)))


@query(
    "agg12_significance_counts",
    chain(*RET_NATION, pair_sql("corr(a.value, b.value) AS value", diagonal=False))
    + " SELECT count(*) AS pairs_tested, count(*) FILTER (abs(value) > 0.3) AS significant_1pct, count(*) FILTER (abs(value) > 0.2) AS significant_5pct FROM pr",
)
def significance_counts(spark, sf_dir):
    pairs = nation_pairs(spark, sf_dir).filter(F.col("row_id") < F.col("col_id"))
    flags = pairs.select((F.abs("corr") > 0.3).alias("causality_1pct"), (F.abs("corr") > 0.2).alias("causality_5pct"))
    return aggregate.granger_summary(flags)


@query(
    "agg13_stationarity_flags",
    chain(SUPPLIER_M, "x AS (SELECT * FROM p)", ADF0)
    + " SELECT bool_or(p_value < 0.05) AS any_stationary, bool_or(NOT p_value < 0.05) AS any_non_stationary, count(*) AS n_series FROM adf",
)
def stationarity_flags(spark, sf_dir):
    return aggregate.stationarity_flags(stationarity.adf_test(stage(pn.supplier_panel(spark, sf_dir)), 0, width=MONTHLY))


RISK = """fc AS (SELECT row_id, col_id, value FROM pr UNION ALL SELECT col_id, row_id, value FROM pr WHERE row_id < col_id),
wt AS (SELECT DISTINCT row_id AS id, 1.0 / (SELECT count(DISTINCT row_id) FROM fc) AS w FROM fc),
mr AS (SELECT row_id, sum(value * w) AS marginal_risk, sqrt(max(CASE WHEN row_id = col_id THEN value END)) AS volatility FROM fc JOIN wt ON wt.id = col_id GROUP BY 1),
pt AS (SELECT sum(w * marginal_risk) AS v, sum(w * volatility) AS a FROM mr JOIN wt ON wt.id = row_id),
rk AS (SELECT row_id AS series_id, w AS weight, volatility, marginal_risk, w * marginal_risk / v AS risk_share, sqrt(v) AS portfolio_vol,
  a AS weighted_avg_vol, a / sqrt(v) AS diversification_ratio FROM mr JOIN wt ON wt.id = row_id CROSS JOIN pt)"""


def nation_risk(spark, sf_dir):
    cov = stage(moments.mirrored(nation_pairs(spark, sf_dir), "cov"), "cov")
    return matrices.portfolio_risk(cov)


@query(
    "agg14_portfolio_risk",
    chain(*RET_NATION, COV, RISK)
    + f""" SELECT series_id, {r('weight')} AS weight, {r('volatility')} AS volatility, {r('marginal_risk')} AS marginal_risk, {r('risk_share')} AS risk_share,
    {r('portfolio_vol')} AS portfolio_vol, {r('weighted_avg_vol')} AS weighted_avg_vol, {r('diversification_ratio')} AS diversification_ratio FROM rk""",
)
def portfolio_risk(spark, sf_dir):
    return finalize(nation_risk(spark, sf_dir))


@query(
    "agg15_param_count",
    chain(SUPPLIER_M, "n AS (SELECT series_id, count(*) AS n_obs FROM p GROUP BY 1)") + " SELECT series_id, (n_obs // 3) * 25 + 5 AS n_params FROM n",
)
def param_count(spark, sf_dir):
    n = pn.supplier_panel(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("series_id", var_param_count(F.floor(F.col("n") / 3), F.lit(5)).alias("n_params"))


@query(
    "agg16_cov_signs",
    chain(*RET_NATION, COV) + f" SELECT row_id, col_id, {r('value', 8)} AS value, CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS sign FROM pr WHERE row_id < col_id AND value <> 0",
)
def cov_signs(spark, sf_dir):
    return finalize(aggregate.cov_sign_split(as_value(nation_pairs(spark, sf_dir), "cov")), 8)


@query(
    "agg17_lag_cross_products",
    chain(SUPPLIER_M, returns("p", "x"), "m AS (SELECT series_id, avg(value) AS mean FROM x GROUP BY 1)",
          "v AS (SELECT x.series_id, ts, value - mean AS value, mean FROM x JOIN m USING (series_id))",
          f"l AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v {W})")
    + f""" SELECT series_id, count(value) AS n, {r('any_value(mean)')} AS mean, {r('sum(value)')} AS s, {r('sum(value * value)')} AS c0, {r('sum(value * l1)')} AS c1,
    {r('sum(value * l2)')} AS c2, {r('max(value) FILTER (i = 1)')} AS h1, {r('max(value) FILTER (i = 2)')} AS h2,
    {r('max(value) FILTER (i = n - 1)')} AS t1, {r('max(value) FILTER (i = n)')} AS t2 FROM l GROUP BY 1""",
)
def lag_cross_products(spark, sf_dir):
    x = stage(transform.log_returns(stage(pn.supplier_panel(spark, sf_dir)), MONTHLY))
    m = moments.lag_moments(x, 2, MONTHLY)
    cells_ = [F.col("prod")[i].alias(f"c{i}") for i in range(3)]
    edges = [F.col(c)[i].alias(f"{c[0]}{i + 1}") for c in ("head", "tail") for i in range(2)]
    return finalize(m.select("series_id", "n", "mean", "s", *cells_, *edges))


@query(
    "win01_lag_lead",
    chain(SUPPLIER_M, f"l AS (SELECT *, lag(value, 1) OVER w AS lag_1, lag(value, 3) OVER w AS lag_3, row_number() OVER w AS pos FROM p {W})")
    + f" SELECT series_id, {iso()} AS ts, {r('value', 9)} AS value, pos, {r('lag_1', 9)} AS lag_1, {r('lag_3', 9)} AS lag_3 FROM l",
)
def lag_lead(spark, sf_dir):
    rows = lagged(stage(pn.supplier_panel(spark, sf_dir)), [1, 3], MONTHLY)
    return finalize(rows.drop("n", "mean"), 9)


@query(
    "win01_lead",
    chain(SUPPLIER_M, f"l AS (SELECT *, lead(value, 1) OVER w AS lead_1, lead(value, 3) OVER w AS lead_3 FROM p {W})")
    + f" SELECT series_id, {iso()} AS ts, {r('value', 9)} AS value, {r('lead_1', 9)} AS lead_1, {r('lead_3', 9)} AS lead_3 FROM l",
)
def lead(spark, sf_dir):
    return finalize(leading(stage(pn.supplier_panel(spark, sf_dir)), [1, 3], MONTHLY), 9)


@query(
    "win02_neighbours",
    chain(
        ORDERS_D,
        cells(),
        """f AS (SELECT series_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev,
        first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM c)""",
    )
    + f" SELECT series_id, {iso()} AS ts, {r('prev', 9)} AS prev, {r('next', 9)} AS next FROM f",
)
def neighbour_values(spark, sf_dir):
    from panelflow.operators.fill import align_outer

    aligned = stage(align_outer(stage(pn.orders_panel(spark, sf_dir, "day")), DAILY))
    return finalize(neighbours(aligned, DAILY).select("series_id", "ts", "prev", "next"), 9)


@query(
    "win03_rolling",
    chain(
        *RET_EVENTS,
        """y AS (SELECT series_id, ts, CASE WHEN count(value) OVER f = 24 THEN avg(value) OVER f END AS m, CASE WHEN count(value) OVER f = 24 THEN stddev_samp(value) OVER f END AS s
        FROM x WINDOW f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""",
    )
    + f" SELECT series_id, {iso()} AS ts, {r('m')} AS rolling_mean, {r('s')} AS rolling_std FROM y",
)
def rolling_stats(spark, sf_dir):
    return finalize(rolling(pn.event_returns(spark, sf_dir), 24, HOURLY).select("series_id", "ts", "rolling_mean", "rolling_std"))


EWMA = """e AS (SELECT series_id, i, ts, 0.05 * value * value AS q FROM n WHERE i = 1
UNION ALL SELECT n.series_id, n.i, n.ts, 0.95 * e.q + 0.05 * n.value * n.value FROM e JOIN n ON n.series_id = e.series_id AND n.i = e.i + 1)"""


@query("win04_ewma", recursive(*RET_EVENTS, numbered(), EWMA) + f" SELECT series_id, {iso()} AS ts, {r('q')} AS ewma FROM e")
def ewma(spark, sf_dir):
    squares = pn.event_returns(spark, sf_dir).withColumn("value", F.col("value") * F.col("value"))
    return finalize(recursion.ewma(squares, 0.95, 0.0, HOURLY).select("series_id", "ts", "ewma"))


RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, col_id) AS rank FROM fv WHERE row_id <> col_id)"


@query("win05_contributor_rank", chain(TRADE, RANKED) + f" SELECT row_id, col_id, {r('value')} AS value, CAST(rank AS INTEGER) AS rank FROM rk")
def contributor_rank(spark, sf_dir):
    return finalize(matrices.rank_contributors(trade_matrix(spark, sf_dir)))


@query(
    "win06_trend",
    chain(SUPPLIER_M, FORECAST, FSTATS)
    + f" SELECT series_id, {r('first')} AS first, {r('last')} AS last, CASE WHEN last > first THEN 'increasing' WHEN last < first THEN 'decreasing' ELSE 'stable' END AS trend FROM fs",
)
def trend(spark, sf_dir):
    s = aggregate.forecast_stats(step_table(spark, sf_dir))
    label = F.when(F.col("last") > F.col("first"), "increasing").when(F.col("last") < F.col("first"), "decreasing").otherwise("stable")
    return finalize(s.select("series_id", "first", "last", label.alias("trend")))


@query(
    "joi01_outer_join",
    """WITH o AS (SELECT date_trunc('month', o_orderdate) AS ts, count(*) AS n_orders FROM orders GROUP BY 1),
    l AS (SELECT date_trunc('month', l_shipdate) AS ts, count(*) AS n_items FROM lineitem GROUP BY 1)
    SELECT strftime(coalesce(o.ts, l.ts), '%Y-%m-%dT%H:%M:%S') AS ts, n_orders, n_items FROM o FULL OUTER JOIN l ON o.ts = l.ts""",
)
def outer_join(spark, sf_dir):
    o = pn.table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("ts")).agg(F.count(F.lit(1)).alias("n_orders"))
    i = pn.table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("ts")).agg(F.count(F.lit(1)).alias("n_items"))
    return finalize(o.join(i, "ts", "full_outer"))


ORDERED = "pr AS (SELECT a.series_id AS source, b.series_id AS target, count(*) AS n, corr(a.value, b.value) AS corr, covar_samp(a.value, b.value) AS cov FROM x a JOIN x b ON a.ts = b.ts AND a.series_id <> b.series_id GROUP BY 1, 2)"


@query("joi02_ordered_pairs", chain(*RET_NATION, ORDERED) + f" SELECT source, target, n, {r('corr')} AS corr, {r('cov', 8)} AS cov FROM pr")
def ordered_pairs(spark, sf_dir):
    return finalize(moments.series_pairs(pn.nation_returns(spark, sf_dir), True, MONTHLY), places={"cov": 8})


@query(
    "joi03_unordered_pairs",
    chain(*RET_NATION, ORDERED) + f" SELECT source AS a, target AS b, n, {r('corr')} AS corr, {r('cov', 8)} AS cov FROM pr WHERE source < target",
)
def unordered_pairs(spark, sf_dir):
    return finalize(moments.series_pairs(pn.nation_returns(spark, sf_dir), False, MONTHLY), places={"cov": 8})


@query(
    "joi04_parameter_lookup",
    chain(SUPPLIER_M) + f" SELECT p.series_id, {iso('p.ts')} AS ts, {r('p.value / s_acctbal')} AS ratio FROM p JOIN supplier ON CAST(s_suppkey AS VARCHAR) = p.series_id",
)
def parameter_lookup(spark, sf_dir):
    from panelflow.operators.blocks import attach_series

    weights = pn.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("series_id"), "s_acctbal")
    rows = attach_series(stage(pn.supplier_panel(spark, sf_dir)), weights, MONTHLY)
    return finalize(rows.select("series_id", "ts", (F.col("value") / F.col("s_acctbal")).alias("ratio")))


@query(
    "joi05_identity_default",
    """WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS row_id, CAST(c_custkey AS VARCHAR) AS col_id FROM customer),
    o AS (SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)
    SELECT row_id, col_id, coalesce(v, 100.0) AS value FROM s LEFT JOIN o ON o.id = s.row_id""",
)
def identity_default(spark, sf_dir):
    ids = pn.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("series_id"))
    counts = pn.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("row_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return matrices.fill_identity(counts.withColumn("col_id", F.col("row_id")), ids)


@query(
    "joi05_complete_matrix",
    chain(TRADE)
    + f""" SELECT a.n_name AS row_id, b.n_name AS col_id, {r('coalesce(value, CASE WHEN a.n_name = b.n_name THEN 100.0 ELSE 0.0 END)')} AS value
    FROM nation a CROSS JOIN nation b LEFT JOIN fv ON fv.row_id = a.n_name AND fv.col_id = b.n_name""",
)
def complete_matrix(spark, sf_dir):
    ids = pn.table(spark, sf_dir, "nation").select(F.col("n_name").alias("series_id"))
    return finalize(matrices.complete_matrix(trade_matrix(spark, sf_dir), ids))


@query(
    "joi06_summary_join",
    chain(SUPPLIER_M, FORECAST, FSTATS, returns("p", "x"), "e AS (SELECT series_id, avg(abs(value)) AS mae FROM x GROUP BY 1)")
    + f" SELECT series_id, {r('mean')} AS mean, {r('cv')} AS cv, {r('mae')} AS mae FROM (SELECT *, std / abs(mean) AS cv FROM fs) JOIN e USING (series_id)",
)
def summary_join(spark, sf_dir):
    panel = stage(pn.supplier_panel(spark, sf_dir))
    steps = lagged(panel, [], MONTHLY).select("series_id", F.col("pos").alias("step"), "value")
    errors = aggregate.error_metrics(transform.log_returns(panel, MONTHLY))
    return finalize(aggregate.forecast_stats(steps).join(errors, "series_id").select("series_id", "mean", "cv", "mae"))


@query(
    "joi07_align_residuals",
    chain(*LEVEL_EVENTS, returns())
    + f" SELECT k.series_id, {iso('k.ts')} AS ts, {r('k.value', 9)} AS value, {r('x.value')} AS residual FROM k JOIN x ON x.series_id = k.series_id AND x.ts = k.ts",
)
def align_residuals(spark, sf_dir):
    level = pn.event_levels(spark, sf_dir)
    resid = transform.log_returns(level, HOURLY).withColumnRenamed("value", "residual")
    return finalize(level.join(resid, ["series_id", "ts"]), places={"value": 9})


@query("top01_sorted_panel", chain(EVENTS_H) + f" SELECT series_id, {iso()} AS ts, {r('value', 9)} AS value FROM p ORDER BY ts, series_id")
def sorted_panel(spark, sf_dir):
    return finalize(pn.events_panel(spark, sf_dir).orderBy("ts", "series_id"), 9)


@query(
    "agg07_correlated_pairs",
    chain(*RET_NATION, "cp AS (SELECT a.series_id AS row_id, b.series_id AS col_id, corr(a.value, b.value) AS rho FROM x a JOIN x b ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY 1, 2)")
    + f" SELECT row_id, col_id, {r('rho')} AS corr FROM cp WHERE abs(rho) >= 0.3",
)
def correlated_pairs(spark, sf_dir):
    return finalize(correlated.correlated_pairs(pn.nation_returns(spark, sf_dir), 0.3, 0.99999, width=MONTHLY))


@query(
    "top02_net_extremes",
    chain(TRADE, NET)
    + f""" SELECT series_id, {r('net')} AS net, 'transmitter' AS role FROM (SELECT * FROM nn ORDER BY round(net, 9) DESC, series_id LIMIT 2)
    UNION ALL SELECT series_id, {r('net')}, 'receiver' FROM (SELECT * FROM nn ORDER BY round(net, 9), series_id LIMIT 2)""",
)
def net_extremes(spark, sf_dir):
    return finalize(matrices.top_net(stage(matrices.directional(trade_matrix(spark, sf_dir))), 2))


@query("top03_top_contributors", chain(TRADE, RANKED) + f" SELECT row_id, col_id, {r('value')} AS value, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 2")
def top_contributors(spark, sf_dir):
    return finalize(matrices.rank_contributors(trade_matrix(spark, sf_dir), 2))


@query(
    "top04_risk_extremes",
    chain(*RET_NATION, COV, RISK)
    + f""" SELECT arg_min(series_id, {{'s': -risk_share, 'i': series_id}}) AS max_contributor, {r('max(risk_share)')} AS max_share,
    arg_min(series_id, {{'s': risk_share, 'i': series_id}}) AS min_contributor, {r('min(risk_share)')} AS min_share FROM rk""",
)
def risk_extremes(spark, sf_dir):
    return finalize(matrices.risk_extremes(nation_risk(spark, sf_dir)))


@query(
    "top05_best_lag",
    chain(SUPPLIER_M, f"l AS (SELECT *, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c FROM p {W})",
          "s AS (SELECT series_id, 1 AS lag, corr(value, a) AS rho FROM l GROUP BY 1 UNION ALL SELECT series_id, 2, corr(value, b) FROM l GROUP BY 1 UNION ALL SELECT series_id, 3, corr(value, c) FROM l GROUP BY 1)")
    + f" SELECT series_id, arg_min(lag, {{'r': -abs(rho), 'l': lag}}) AS best_lag, {r('max(abs(rho))')} AS strength FROM s WHERE rho IS NOT NULL GROUP BY 1",
)
def best_lag(spark, sf_dir):
    rows = lagged(stage(pn.supplier_panel(spark, sf_dir)), [1, 2, 3], MONTHLY)
    stats = rows.groupBy("series_id").agg(*[F.corr("value", f"lag_{k}").alias(f"r{k}") for k in (1, 2, 3)])
    long = stats.select("series_id", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.abs(f"r{k}").alias("strength")) for k in (1, 2, 3)])).alias("s"))
    found = aggregate.best_lag(long.select("series_id", "s.*"), ["series_id"], "strength", largest=True)
    return finalize(found.filter("best_lag is not null"))
