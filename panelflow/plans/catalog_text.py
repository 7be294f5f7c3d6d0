"""Queries of the interpretation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.functions.scalar import finalize
from panelflow.operators import aggregate, garch, interpret, matrices, mgarch, stationarity, transform, var_model
from panelflow.plans import panels as pn
from panelflow.plans.catalog import query
from panelflow.plans.catalog_data import ADF0
from panelflow.plans.catalog_models import (
    CRIT,
    DCC,
    GARCH_SQL,
    GFORE,
    GRANGER1,
    dcc_events,
    forecast_events,
)
from panelflow.plans.catalog_stats import COV, FORECAST, FSTATS, NET, PROFILE, RANKED, RISK, TRADE, nation_risk, step_table, trade_matrix
from panelflow.plans.panels import HOURLY, MONTHLY
from panelflow.plans.sqltext import RET_NATION, SUPPLIER_M, chain, r, recursive, returns
from panelflow.plans.staging import stage


def steps(x: str, limits: list[tuple[float, str]], otherwise: str, op: str = ">") -> str:
    return "CASE " + " ".join(f"WHEN {x} {op} {v} THEN '{label}'" for v, label in limits) + f" ELSE '{otherwise}' END"


DIRECTION = "CASE WHEN last > first THEN 'increasing' WHEN last < first THEN 'decreasing' ELSE 'stable' END"


@query(
    "int01_adf",
    chain(SUPPLIER_M, "x AS (SELECT * FROM p)", ADF0, f"q AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in CRIT.items())} FROM adf)")
    + f""" SELECT series_id, {r('tau')} AS adf_statistic, CASE WHEN p_value < 0.05 THEN 'Stationary' ELSE 'Non-stationary' END AS verdict,
    CASE WHEN tau < crit_1 THEN 'Strong' WHEN tau < crit_5 THEN 'Moderate' WHEN tau < crit_10 THEN 'Weak' ELSE 'None' END AS evidence,
    CASE WHEN tau < crit_1 THEN '1%' WHEN tau < crit_5 THEN '5%' WHEN tau < crit_10 THEN '10%' ELSE 'none' END AS significance_level,
    {r('(1 - p_value) * 100')} AS confidence, CASE WHEN p_value < 0.05 THEN 'model as is' ELSE 'difference or transform first' END AS action FROM q""",
)
def int_adf(spark, sf_dir):
    adf = stationarity.adf_test(stage(pn.supplier_panel(spark, sf_dir)), 0, width=MONTHLY)
    out = interpret.interpret_adf(stage(adf))
    return finalize(out.select("series_id", "adf_statistic", "verdict", "evidence", "significance_level", "confidence", "action"))


CHANGE = "abs((last - first) / first)"


@query(
    "int02_arima",
    chain(SUPPLIER_M, FORECAST, FSTATS, returns("p", "x"), "e AS (SELECT series_id, avg(abs(value)) AS mae FROM x GROUP BY 1)",
          "j AS (SELECT *, std / abs(mean) AS cv FROM fs JOIN e USING (series_id))")
    + f""" SELECT series_id, {DIRECTION} AS trend, {r(CHANGE)} AS magnitude_change, {steps(CHANGE, [(0.1, 'substantial'), (0.05, 'moderate')], 'stable')} AS movement,
    {steps('mae', [(0.01, 'Excellent'), (0.05, 'Good'), (0.1, 'Fair')], 'Poor', '<')} AS quality, {steps('cv', [(0.02, 'High'), (0.05, 'Moderate')], 'Low', '<')} AS forecast_confidence FROM j""",
)
def int_arima(spark, sf_dir):
    panel = stage(pn.supplier_panel(spark, sf_dir))
    errors = aggregate.error_metrics(transform.log_returns(panel, MONTHLY))
    stats = aggregate.forecast_stats(step_table(spark, sf_dir)).join(errors, "series_id")
    out = interpret.interpret_arima(stats)
    return finalize(out.select("series_id", "trend", "magnitude_change", "movement", "quality", "forecast_confidence"))


@query(
    "int03_garch",
    recursive(*GARCH_SQL, GFORE, "j AS (SELECT series_id, arg_min(sqrt(v), step) AS first, arg_max(sqrt(v), step) AS last, 0.1::DOUBLE + 0.8::DOUBLE AS persistence FROM gf GROUP BY 1)")
    + f""" SELECT series_id, {steps('last', [(0.03, 'high'), (0.015, 'moderate')], 'low')} AS volatility_level, {DIRECTION} AS trend,
    {steps('persistence', [(0.99, 'very high'), (0.95, 'high'), (0.85, 'moderate'), (0.5, 'low')], 'very low')} AS persistence_level,
    {steps('persistence', [(0.98, 'Low'), (0.9, 'Moderate')], 'High')} AS forecast_confidence, {r('(last - first) / first')} AS change,
    {steps('abs((last - first) / first)', [(0.2, 'substantial'), (0.1, 'moderate')], 'minimal')} AS change_size FROM j""",
)
def int_garch(spark, sf_dir):
    params, forecast = forecast_events(spark, sf_dir)
    stats = aggregate.forecast_stats(forecast.select("series_id", "step", F.col("volatility").alias("value")))
    out = interpret.interpret_garch(stats.join(garch.diagnostics(params), "series_id"))
    return finalize(
        out.select("series_id", "volatility_level", "trend", "persistence_level", "forecast_confidence", "change", "change_size")
    )


TOTAL = "tt AS (SELECT sum(CASE WHEN row_id <> col_id THEN value ELSE 0 END) / sum(value) * 100 AS total FROM fv)"
KEYS = """ks AS (SELECT 'total' AS key, total / 100 AS value FROM tt UNION ALL SELECT 'from_' || series_id, from_others / 100 FROM nn UNION ALL SELECT 'to_' || series_id, to_others / 100 FROM nn)"""


def spill(spark, sf_dir):
    m = trade_matrix(spark, sf_dir)
    return m, matrices.total_spillover(m), stage(matrices.directional(m))


def key_values(spark, sf_dir):
    _, total, net = spill(spark, sf_dir)
    both = F.array(
        F.struct(F.concat(F.lit("from_"), "series_id").alias("key"), (F.col("from_others") / 100).alias("value")),
        F.struct(F.concat(F.lit("to_"), "series_id").alias("key"), (F.col("to_others") / 100).alias("value")),
    )
    return total.select(F.lit("total").alias("key"), (F.col("total") / 100).alias("value")).unionByName(
        net.select(F.explode(both).alias("k")).select("k.*")
    )


@query(
    "int04_spillover_index",
    chain(TRADE, NET, TOTAL, KEYS)
    + f""" SELECT key, {r('value')} AS value, split_part(key, '_', 1) AS kind, CASE WHEN key <> 'total' THEN substr(key, position('_' IN key) + 1) END AS series_id,
    CASE WHEN value > 0.5 THEN 'strong' ELSE 'limited' END AS strength FROM ks""",
)
def int_spillover_index(spark, sf_dir):
    return finalize(interpret.interpret_spillover_index(key_values(spark, sf_dir)).drop("text"))


@query(
    "int05_granger",
    chain(*RET_NATION, GRANGER1)
    + f""" SELECT source, target, {r('p')} AS min_p_value, CASE WHEN p < 0.01 THEN 'highly significant' WHEN p < 0.05 THEN 'significant' ELSE 'none' END AS causality,
    CASE WHEN p < 0.05 THEN 1 END AS best_lag FROM gt""",
)
def int_granger(spark, sf_dir):
    tests = var_model.granger(var_model.prepared(pn.nation_returns(spark, sf_dir), MONTHLY), 1)
    return finalize(interpret.interpret_granger(tests).select("source", "target", "min_p_value", "causality", "best_lag"))


FRACTION = """fr AS (SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS series_id, total / 100 AS value FROM tt UNION ALL SELECT 'to', series_id, to_others / 100 FROM nn
UNION ALL SELECT 'from', series_id, from_others / 100 FROM nn UNION ALL SELECT 'net', series_id, net / 100 FROM nn)"""


@query(
    "int06_spillover_fraction",
    chain(TRADE, NET, TOTAL, FRACTION)
    + f""" SELECT kind, series_id, {r('value')} AS value, CASE WHEN kind = 'total' THEN {steps('value', [(0.5, 'strong'), (0.3, 'moderate')], 'weak')}
    WHEN kind = 'net' THEN CASE WHEN abs(value) < 0.1 THEN 'balanced' WHEN value > 0 THEN 'transmitter' ELSE 'receiver' END
    ELSE CASE WHEN value > 0.1 THEN 'significant' ELSE 'minimal' END END AS label FROM fr""",
)
def int_spillover_fraction(spark, sf_dir):
    _, total, net = spill(spark, sf_dir)
    parts = F.array(
        *[F.struct(F.lit(k).alias("kind"), "series_id", (F.col(c) / 100).alias("value")) for k, c in (("to", "to_others"), ("from", "from_others"), ("net", "net"))]
    )
    rows = net.select(F.explode(parts).alias("k")).select("k.*").unionByName(
        total.select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("series_id"), (F.col("total") / 100).alias("value"))
    )
    return finalize(interpret.interpret_spillover_fraction(rows).drop("text"))


@query(
    "int07_spillover_pct",
    chain(TRADE, NET, TOTAL)
    + f""" SELECT {r('total')} AS total, {steps('total', [(50, 'high'), (25, 'moderate')], 'low')} AS level,
    (SELECT string_agg(series_id, ', ' ORDER BY round(net, 9) DESC, series_id) FROM (SELECT * FROM nn ORDER BY round(net, 9) DESC, series_id LIMIT 2)) AS transmitters,
    (SELECT string_agg(series_id, ', ' ORDER BY round(net, 9), series_id) FROM (SELECT * FROM nn ORDER BY round(net, 9), series_id LIMIT 2)) AS receivers FROM tt""",
)
def int_spillover_pct(spark, sf_dir):
    _, total, net = spill(spark, sf_dir)
    return finalize(interpret.interpret_spillover_pct(total, net).drop("text"))


PAIR_LEVEL = steps("value", [(5, "minimal"), (20, "moderate")], "strong", "<")


@query(
    "int08_pairwise",
    chain(TRADE) + f" SELECT col_id AS source, row_id AS target, {r('value')} AS value, {PAIR_LEVEL} AS strength, printf('%s explains %.2f%% of %s: %s.', col_id, value, row_id, {PAIR_LEVEL}) AS text FROM fv WHERE row_id <> col_id",
)
def int_pairwise(spark, sf_dir):
    return finalize(interpret.interpret_pairwise(matrices.pairwise(trade_matrix(spark, sf_dir))))


@query(
    "int09_var",
    chain(TRADE, RANKED, """tp AS (SELECT row_id, max(col_id) FILTER (rank = 1) AS first_source, max(value) FILTER (rank = 1) AS first_share,
    max(col_id) FILTER (rank = 2) AS second_source, max(value) FILTER (rank = 2) AS second_share FROM rk GROUP BY 1)""")  # fmt: skip
    + f""" SELECT fv.row_id, {r('value')} AS own_share, first_source, {r('first_share')} AS first_share, second_source, {r('second_share')} AS second_share,
    {steps('value', [(70, 'autonomous'), (50, 'balanced')], 'interconnected')} AS role FROM fv LEFT JOIN tp USING (row_id) WHERE row_id = col_id""",
)
def int_var(spark, sf_dir):
    return finalize(interpret.interpret_var(trade_matrix(spark, sf_dir)).drop("text"))


@query(
    "int09_var_memory",
    chain(SUPPLIER_M, "n AS (SELECT series_id, count(*) % 6 + 1 AS lag FROM p GROUP BY 1)")
    + " SELECT series_id, CASE WHEN lag = 1 THEN 'short' WHEN lag <= 3 THEN 'moderate' ELSE 'long' END AS memory FROM n",
)
def int_var_memory(spark, sf_dir):
    n = pn.supplier_panel(spark, sf_dir).groupBy("series_id").agg((F.count(F.lit(1)) % 6 + 1).alias("lag"))
    return n.select("series_id", interpret.memory_label(F.col("lag")).alias("memory"))


@query("int10_net", chain(TRADE, NET) + f" SELECT series_id, {r('net')} AS net, CASE WHEN net > 0 THEN 'transmitter' ELSE 'receiver' END AS role, printf('%s is a net %s (%.2f%%).', series_id, CASE WHEN net > 0 THEN 'transmitter' ELSE 'receiver' END, net) AS text FROM nn")
def int_net(spark, sf_dir):
    net = matrices.directional(trade_matrix(spark, sf_dir)).select("series_id", "net")
    return finalize(interpret.interpret_net(net))


PATHS = "dp AS (SELECT a || '|' || b AS series_id, q / sqrt(qa * qb) AS value FROM dc)"


def dcc_profile(spark, sf_dir):
    return stage(aggregate.corr_series_profile(mgarch.as_paths(stage(dcc_events(spark, sf_dir))), HOURLY))


@query(
    "int11_mgarch",
    recursive(*GARCH_SQL, DCC, PATHS, PROFILE.format(src="dp"))
    + f""" SELECT series_id, {r('mean')} AS mean, {r('std_sample')} AS std_sample, {steps('std_sample', [(0.15, 'highly variable'), (0.08, 'moderately variable')], 'relatively stable')} AS stability,
    {steps('mean', [(0.6, 'high'), (0.3, 'moderate')], 'low')} AS level FROM pf""",
)
def int_mgarch(spark, sf_dir):
    return finalize(interpret.interpret_mgarch(dcc_profile(spark, sf_dir)).select("series_id", "mean", "std_sample", "stability", "level"))


@query(
    "int12_corr_dynamics",
    recursive(*GARCH_SQL, DCC, PATHS, PROFILE.format(src="dp"))
    + f""" SELECT series_id, {r('median')} AS median, n_high, n_low, {steps('std', [(0.15, 'high'), (0.08, 'moderate')], 'low')} AS variability,
    CASE WHEN n_high = 0 AND n_low = 0 THEN 'none' WHEN n_high > n_low THEN 'high correlation' WHEN n_low > n_high THEN 'low correlation' ELSE 'balanced' END AS regime,
    {steps('mean', [(0.7, 'high'), (0.3, 'moderate')], 'low')} AS level FROM pf""",
)
def int_corr_dynamics(spark, sf_dir):
    out = interpret.interpret_corr_dynamics(dcc_profile(spark, sf_dir))
    return finalize(out.select("series_id", "median", "n_high", "n_low", "variability", "regime", "level"))


@query(
    "int13_portfolio",
    chain(*RET_NATION, COV, RISK)
    + f""" SELECT series_id, {r('risk_share')} AS risk_share, {r('diversification_ratio')} AS diversification_ratio,
    {steps('diversification_ratio', [(1.5, 'excellent'), (1.2, 'good'), (1.05, 'moderate')], 'limited')} AS benefit,
    {steps('diversification_ratio', [(1.3, 'keep the allocation'), (1.1, 'reduce the largest contributors')], 'add uncorrelated assets')} AS advice FROM rk""",
)
def int_portfolio(spark, sf_dir):
    out = interpret.interpret_portfolio(nation_risk(spark, sf_dir))
    return finalize(out.select("series_id", "risk_share", "diversification_ratio", "benefit", "advice"))

