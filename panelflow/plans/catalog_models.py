"""Queries of the model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.functions.scalar import adf_critical_values, finalize, information_criteria
from panelflow.operators import aggregate, arima, garch, mgarch, scoring, stationarity, transform, var_model
from panelflow.plans import panels as pn
from panelflow.plans.catalog import query
from panelflow.plans.catalog_data import ADF0
from panelflow.plans.catalog_stats import pair_sql
from panelflow.plans.panels import HOURLY, MONTHLY
from panelflow.plans.run import RunConfig, fit_by_length, run_configuration, run_stages
from panelflow.plans.sqltext import (
    MARKET_M,
    ORDERS_M,
    RET_EVENTS,
    RET_NATION,
    RET_ORDERS,
    RET_STATUS,
    SUPPLIER_M,
    W,
    chain,
    iso,
    numbered,
    panel,
    partialled,
    r,
    recursive,
    returns,
)
from panelflow.plans.staging import stage

CRIT = {
    "crit_1": "-3.43035 - 6.5393 / t - 16.786 / (t * t) - 79.433 / (t * t * t)",
    "crit_5": "-2.86154 - 2.8903 / t - 4.234 / (t * t) - 40.040 / (t * t * t)",
    "crit_10": "-2.56677 - 1.5384 / t - 2.809 / (t * t)",
}
CRIT_COLS = ", ".join(f"{r(v)} AS {k}" for k, v in CRIT.items())


@query(
    "mod01_adf_lag0",
    chain(SUPPLIER_M, "x AS (SELECT * FROM p)", ADF0)
    + f""" SELECT series_id, {r('tau')} AS adf_statistic, {r('p_value')} AS p_value, 0 AS used_lag, t AS n_obs, {CRIT_COLS},
    p_value < 0.05 AS is_stationary, 'ok' AS status FROM adf""",
)
def adf_lag0(spark, sf_dir):
    return finalize(stationarity.adf_test(stage(pn.supplier_panel(spark, sf_dir)), 0, width=MONTHLY))


@query("mod01_adf_auto")
def adf_auto(spark, sf_dir):
    return finalize(stationarity.adf_test(pn.orders_returns(spark, sf_dir), "aic", width=MONTHLY))


STEPS = f"""dl AS (SELECT series_id, value - lag(value) OVER w AS d, lag(value) OVER w AS y1, ts FROM p {W}),
dd AS (SELECT series_id, d, y1, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM dl {W})"""
TAU = [partialled("dd", [*["d1", "d2"][:k], "y1"], "d", f"t{k}") for k in range(3)]


def tau(k: int) -> str:
    return f"slope / sqrt(ssr_{k + 1} / (t - {k + 2}) / sxx)"


@query("mod01_adf_lag2", chain(SUPPLIER_M, STEPS, *TAU[2]) + f" SELECT series_id, {r(tau(2), 5)} AS adf_statistic, 2 AS used_lag, t AS n_obs FROM t2")
def adf_lag2(spark, sf_dir):
    tested = stationarity.adf_test(stage(pn.supplier_panel(spark, sf_dir)), 2, width=MONTHLY, block=32)
    return finalize(tested.select("series_id", "adf_statistic", "used_lag", "n_obs"), 5)


CHOSEN = """aic AS (SELECT series_id, t * ln(ssr_1 / t) + 4 AS a0, t * ln(ssr_2 / t) + 6 AS a1, t * ln(ssr_3 / t) + 8 AS a2 FROM nest),
pick AS (SELECT series_id, CASE WHEN a2 < least(a0, a1) THEN 2 WHEN a1 < a0 THEN 1 ELSE 0 END AS used_lag FROM aic)"""


@query(
    "mod01_adf_search",
    chain(SUPPLIER_M, STEPS, *partialled("dd", ["y1", "d1", "d2"], "d", "nest"), *[c for t in TAU for c in t], CHOSEN)
    + " UNION ALL ".join(f" SELECT series_id, {r(tau(k), 5)} AS adf_statistic, used_lag, t AS n_obs FROM t{k} JOIN pick USING (series_id) WHERE used_lag = {k}" for k in range(3)),
)
def adf_search(spark, sf_dir):
    """Best of 0 to 2 lags, and the test at that lag on its own sample."""
    tested = stationarity.adf_test(stage(pn.supplier_panel(spark, sf_dir)), "aic", max_lag=2, width=MONTHLY)
    return finalize(tested.select("series_id", "adf_statistic", "used_lag", "n_obs"), 5)


@query("mod02_critical_values", chain(SUPPLIER_M, "n AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS t FROM p GROUP BY 1)") + f" SELECT series_id, {CRIT_COLS} FROM n")
def critical_values(spark, sf_dir):
    n = pn.supplier_panel(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).cast("double").alias("t"))
    return finalize(n.select("series_id", *[c.alias(k) for k, c in adf_critical_values(F.col("t")).items()]))


AR1 = f"""l AS (SELECT series_id, value AS y, lag(value) OVER w AS y1 FROM p {W}),
g AS (SELECT series_id, count(*) AS t, regr_slope(y, y1) AS phi, regr_intercept(y, y1) AS c, regr_sxx(y, y1) AS sxx, avg(y1) AS m,
  regr_syy(y, y1) - regr_slope(y, y1) * regr_sxy(y, y1) AS sse FROM l WHERE y1 IS NOT NULL GROUP BY 1),
fit AS (SELECT *, sse / t AS s2, -0.5 * t * (ln(2 * pi() * sse / t) + 1) AS llf FROM g)"""


@query(
    "mod03_ar_fit",
    chain(SUPPLIER_M, AR1)
    + f""" SELECT series_id, t AS n_eff, {r('c', 4)} AS const, {r('phi')} AS phi, {r('s2 / 1e6')} AS sigma2_m, {r('llf', 4)} AS llf, {r('6 - 2 * llf', 4)} AS aic,
    {r('3 * ln(t) - 2 * llf', 4)} AS bic, {r('6 * ln(ln(t)) - 2 * llf', 4)} AS hqic, {r('sqrt(s2 * (1.0 / t + m * m / sxx))', 4)} AS se_const,
    {r('sqrt(s2 / sxx)')} AS se_phi FROM fit""",
)
def ar_fit(spark, sf_dir):
    m = arima.arima_fit(stage(pn.supplier_panel(spark, sf_dir)), 1, 0, 0, MONTHLY)
    out = m.select(
        "series_id", "n_eff", "const", F.col("phi")[0].alias("phi"), (F.col("sigma2") / 1e6).alias("sigma2_m"), "llf", "aic", "bic", "hqic",
        F.col("se")[0].alias("se_const"), F.col("se")[1].alias("se_phi"),
    )
    return finalize(out, places={c: 4 for c in ("const", "llf", "aic", "bic", "hqic", "se_const")})


@query(
    "mod03_ar_diff_fit",
    chain(
        SUPPLIER_M,
        f"d AS (SELECT series_id, ts, value - lag(value) OVER w AS w0 FROM p {W})",
        f"l AS (SELECT series_id, w0, lag(w0) OVER w AS w1 FROM (SELECT * FROM d WHERE w0 IS NOT NULL) {W})",
        """g AS (SELECT series_id, count(*) AS t, sum(w0 * w1) / sum(w1 * w1) AS phi, sum(w1 * w1) AS q, sum(w0 * w0) - sum(w0 * w1) * sum(w0 * w1) / sum(w1 * w1) AS sse
        FROM l WHERE w1 IS NOT NULL GROUP BY 1)""",
        "fit AS (SELECT *, sse / t AS s2, -0.5 * t * (ln(2 * pi() * sse / t) + 1) AS llf FROM g)",
    )
    + f" SELECT series_id, t AS n_eff, {r('phi')} AS phi, {r('sqrt(s2 / q)')} AS se_phi, {r('llf', 4)} AS llf, {r('4 - 2 * llf', 4)} AS aic FROM fit",
)
def ar_diff_fit(spark, sf_dir):
    m = arima.arima_fit(stage(pn.supplier_panel(spark, sf_dir)), 1, 1, 0, MONTHLY)
    out = m.select("series_id", "n_eff", F.col("phi")[0].alias("phi"), F.col("se")[0].alias("se_phi"), "llf", "aic")
    return finalize(out, places={"llf": 4, "aic": 4})


SUPPLIER_Y = panel("CAST(l_suppkey AS VARCHAR)", "year", "l_shipdate", "l_extendedprice", "lineitem")


@query(
    "mod03_short_series",
    chain(
        SUPPLIER_Y,
        f"d AS (SELECT series_id, ts, value - lag(value) OVER w AS w0 FROM p {W})",
        f"l AS (SELECT series_id, w0, lag(w0) OVER w AS w1 FROM (SELECT * FROM d WHERE w0 IS NOT NULL) {W})",
        """g AS (SELECT series_id, count(*) AS t, sum(w0 * w1) / sum(w1 * w1) AS phi, sum(w1 * w1) AS q, sum(w0 * w0) - sum(w0 * w1) * sum(w0 * w1) / sum(w1 * w1) AS sse
        FROM l WHERE w1 IS NOT NULL GROUP BY 1)""",
    )
    + f" SELECT series_id, 1 AS p, 'ar.L1' AS param, {r('phi')} AS estimate, {r('sqrt(sse / t / q)')} AS std_err FROM g WHERE t > 3",
)
def short_series(spark, sf_dir):
    """ARIMA(2,1,0) asked for, but a handful of years allows for one lag only."""
    models = stage(fit_by_length(stage(pn.supplier_panel(spark, sf_dir, "year")), 2, 1, 0, MONTHLY))
    rows = arima.arima_params(models).join(models.select("series_id", "p"), "series_id")
    return finalize(rows.select("series_id", "p", "param", "estimate", "std_err"))


@query("mod03_arima_params")
def arima_params(spark, sf_dir):
    scaled = stage(transform.scale(pn.orders_returns(spark, sf_dir), "standardize", width=MONTHLY))
    return finalize(arima.arima_params(stage(arima.arima_fit(scaled, 2, 1, 1, MONTHLY))), 4)


HANNAN = (
    "z AS (SELECT series_id, i, value - avg(value) OVER (PARTITION BY series_id) AS z, avg(value) OVER (PARTITION BY series_id) AS m FROM n)",
    "z2 AS (SELECT *, lag(z, 1) OVER w AS a, lag(z, 2) OVER w AS b FROM z WINDOW w AS (PARTITION BY series_id ORDER BY i))",
    "g AS (SELECT series_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(z * a) AS za, sum(z * b) AS zb FROM z2 WHERE b IS NOT NULL GROUP BY 1)",
    "ar AS (SELECT series_id, (za * bb - zb * ab) / (aa * bb - ab * ab) AS p1, (zb * aa - za * ab) / (aa * bb - ab * ab) AS p2 FROM g)",
    "er AS (SELECT z2.*, z - p1 * a - p2 * b AS e FROM z2 JOIN ar USING (series_id))",
    "er1 AS (SELECT *, lag(e) OVER (PARTITION BY series_id ORDER BY i) AS f FROM er)",
    "h AS (SELECT series_id, any_value(m) AS m, sum(a * a) AS aa, sum(a * f) AS af, sum(f * f) AS ff, sum(z * a) AS za, sum(z * f) AS zf FROM er1 WHERE f IS NOT NULL GROUP BY 1)",
    "hr AS (SELECT series_id, m, (za * ff - zf * af) / (aa * ff - af * af) AS phi, (zf * aa - za * af) / (aa * ff - af * af) AS theta FROM h)",
)


@query(
    "mod03_hannan_rissanen",
    recursive(*RET_EVENTS, numbered(), *HANNAN) + f" SELECT series_id, {r('m * (1 - phi)')} AS const, {r('phi', 5)} AS phi, {r('theta', 5)} AS theta FROM hr",
)
def hannan_rissanen(spark, sf_dir):
    """The two regressions that start an ARMA(1, 1) fit, with a first stage of two lags."""
    x = pn.event_returns(spark, sf_dir)
    blocks = stage(scoring.pack(x, 3, {}, HOURLY, 256), "blocks")
    rows = arima.hannan_rissanen(blocks, x, 1, 0, 1, 2, HOURLY)
    return finalize(rows.select("series_id", *[F.col("start")[i].alias(c) for i, c in enumerate(("const", "phi", "theta"))]), places={"phi": 5, "theta": 5})


GRID = """cd AS (SELECT a.v || '/' || b.v AS cand, CAST(a.v AS DOUBLE) AS phi, CAST(b.v AS DOUBLE) AS theta
FROM (VALUES ('-0.4'), ('0.0'), ('0.3')) a(v), (VALUES ('-0.9'), ('-0.6'), ('-0.3')) b(v))"""
GRID_E = """ge AS (SELECT n.series_id, cand, i, value, 0.0::DOUBLE AS e FROM n CROSS JOIN cd WHERE i = 1
UNION ALL SELECT n.series_id, g.cand, n.i, n.value, n.value - phi * g.value - theta * g.e FROM ge g JOIN n ON n.series_id = g.series_id AND n.i = g.i + 1 JOIN cd USING (cand)),
gs AS (SELECT series_id, cand, sum(e * e) AS sse FROM ge GROUP BY 1, 2)"""
DIFFED = "dx AS (SELECT series_id, ts, value FROM (SELECT series_id, ts, value - lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS value FROM x) WHERE value IS NOT NULL)"


@query(
    "mod03_arima_reached",
    recursive(*RET_EVENTS, DIFFED, numbered("dx"), GRID, GRID_E) + f" SELECT series_id, arg_min(cand, sse) AS cand, {r('min(sse)', 5)} AS sse, true AS reached FROM gs GROUP BY 1",
)
def arima_reached(spark, sf_dir):
    """Best of a grid of ARIMA(1, 1, 1) models, and whether the fit has a sum of squares not above it."""
    x = pn.event_returns(spark, sf_dir)
    grid = [(f"{a}/{b}", a, b) for a in (-0.4, 0.0, 0.3) for b in (-0.9, -0.6, -0.3)]
    options = F.explode(F.array(*[F.struct(F.lit(c).alias("cand"), F.array(F.lit(a)).alias("phi"), F.array(F.lit(b)).alias("theta")) for c, a, b in grid]))
    cands = x.select("series_id").distinct().select("series_id", options.alias("o")).select("series_id", "o.cand", F.lit(0.0).alias("const"), "o.phi", "o.theta")
    best = arima.arima_sse(x, cands, 1, 1, 1, HOURLY).groupBy("series_id").agg(F.min_by("cand", "sse").alias("cand"), F.min("sse").alias("sse"))
    fitted = arima.arima_fit(x, 1, 1, 1, HOURLY).select("series_id", (F.col("sigma2") * F.col("n_eff")).alias("fit_sse"))
    rows = best.join(fitted, "series_id")
    return finalize(rows.select("series_id", "cand", "sse", (F.col("fit_sse") <= F.col("sse") * (1 + 1e-9)).alias("reached")), 5)


ARMA = """e AS (SELECT n.series_id, i, ts, value, 0.0::DOUBLE AS e FROM n WHERE i = 1
UNION ALL SELECT n.series_id, n.i, n.ts, n.value, n.value - 0.01 - 0.3 * e.value - 0.2 * e.e FROM e JOIN n ON n.series_id = e.series_id AND n.i = e.i + 1)"""


@query("mod04_arima_filter", recursive(*RET_EVENTS, numbered(), ARMA) + f" SELECT series_id, {iso()} AS ts, {r('value')} AS value, {r('e')} AS residual, {r('value - e')} AS fitted FROM e")
def arima_filter(spark, sf_dir):
    x = pn.event_returns(spark, sf_dir)
    fixed = x.select("series_id").distinct().select(
        "series_id", F.lit(0.01).alias("const"), F.array(F.lit(0.3)).alias("phi"), F.array(F.lit(0.2)).alias("theta")
    )
    return finalize(arima.arima_filter(x, fixed, 1, 0, 1, HOURLY))


@query(
    "mod05_arima_forecast",
    chain(SUPPLIER_M, AR1, "y AS (SELECT series_id, arg_max(value, ts) AS yt FROM p GROUP BY 1)", "h AS (SELECT unnest(range(1, 21)) AS step)",
          """f AS (SELECT series_id, step, c * (1 - pow(phi, step)) / (1 - phi) + pow(phi, step) * yt AS mean, sqrt(s2 * (1 - pow(phi, 2 * step)) / (1 - phi * phi)) AS se
          FROM fit JOIN y USING (series_id) CROSS JOIN h)""")  # fmt: skip
    + f" SELECT series_id, CAST(step AS INTEGER) AS step, {r('mean', 4)} AS mean, {r('se', 4)} AS se, {r('mean - 1.959964 * se', 4)} AS lower, {r('mean + 1.959964 * se', 4)} AS upper FROM f",
)
def arima_forecast(spark, sf_dir):
    panel = stage(pn.supplier_panel(spark, sf_dir))
    m = stage(arima.arima_fit(panel, 1, 0, 0, MONTHLY))
    resid = stage(arima.arima_filter(panel, m, 1, 0, 0, MONTHLY))
    state = arima.forecast_state(panel, resid, 1, 0, 0, MONTHLY)
    return finalize(arima.arima_forecast(m, state, 20), 4)


@query(
    "mod06_information_criteria",
    chain(SUPPLIER_M, returns("p", "x"),
          "g AS (SELECT series_id, count(*) AS n, -0.5 * count(*) * (ln(2 * pi() * var_pop(value)) + 1) AS llf FROM x GROUP BY 1)")
    + f" SELECT series_id, {r('llf')} AS llf, {r('4 - 2 * llf')} AS aic, {r('2 * ln(n) - 2 * llf')} AS bic, {r('4 * ln(ln(n)) - 2 * llf')} AS hqic FROM g",
)
def criteria(spark, sf_dir):
    x = transform.log_returns(stage(pn.supplier_panel(spark, sf_dir)), MONTHLY)
    g = x.groupBy("series_id").agg(
        F.count("value").alias("n"), (-0.5 * F.count("value") * (F.log(2 * F.pi() * F.var_pop("value")) + 1)).alias("llf")
    )
    return finalize(g.select("series_id", "llf", *[c.alias(k) for k, c in information_criteria(F.col("llf"), F.lit(2), F.col("n")).items()]))


GPARAM = """pm AS (SELECT series_id, avg(value) AS mu, 0.1 * var_samp(value) AS omega FROM x GROUP BY 1),
bc AS (SELECT n.series_id, sum(pow(0.94, i - 1) * (value - mu) * (value - mu)) / sum(pow(0.94, i - 1)) AS back FROM n JOIN pm USING (series_id) WHERE i <= 75 GROUP BY 1)"""
GARCH = """gv AS (SELECT n.series_id, i, ts, value - mu AS e, omega + 0.1 * back + 0.8 * back AS s2 FROM n JOIN pm USING (series_id) JOIN bc USING (series_id) WHERE i = 1
UNION ALL SELECT n.series_id, n.i, n.ts, n.value - pm.mu, pm.omega + 0.1 * g.e * g.e + 0.8 * g.s2 FROM gv g JOIN n ON n.series_id = g.series_id AND n.i = g.i + 1 JOIN pm ON pm.series_id = g.series_id)"""
GARCH_SQL = (*RET_EVENTS, numbered(), GPARAM, GARCH)


def fixed_params(x):
    """Parameters that follow from the data: persistence 0.9 with the sample variance."""
    stats = x.groupBy("series_id").agg(F.avg("value").alias("mu"), (F.var_samp("value") * 0.1).alias("omega"))
    return stats.join(garch.backcast(x, "constant", HOURLY), "series_id").select(
        "*", F.array(F.lit(0.1)).alias("alpha"), F.array(F.lit(0.8)).alias("beta")
    )


def filtered_events(spark, sf_dir):
    x = pn.event_returns(spark, sf_dir)
    return stage(garch.garch_filter(x, stage(fixed_params(x)), 1, 1, HOURLY), "filtered")


@query("mod07_garch_fit")
def garch_fit(spark, sf_dir):
    m = garch.garch_fit(pn.event_returns(spark, sf_dir), 1, 1, "t", width=HOURLY)
    return finalize(m.select("series_id", "mu", "omega", F.col("alpha")[0].alias("alpha"), F.col("beta")[0].alias("beta"), "nu", "llf", "aic", "bic", "status"), 3)


@query(
    "mod08_garch_filter",
    recursive(*GARCH_SQL) + f" SELECT series_id, {iso()} AS ts, {r('e')} AS residual, {r('s2')} AS variance, {r('sqrt(s2)')} AS volatility, {r('e / sqrt(s2)')} AS std_resid FROM gv",
)
def garch_filter(spark, sf_dir):
    return finalize(filtered_events(spark, sf_dir).drop("value"))


CAND = """cd AS (SELECT pm.series_id, a.v || '/' || b.v AS cand, mu, omega, CAST(a.v AS DOUBLE) AS alpha, CAST(b.v AS DOUBLE) AS beta
FROM pm, (VALUES ('0.05'), ('0.1'), ('0.2')) a(v), (VALUES ('0.6'), ('0.7'), ('0.75')) b(v))"""
SCORE = """gc AS (SELECT n.series_id, cand, i, value - mu AS e, omega + (alpha + beta) * back AS s2 FROM n JOIN cd USING (series_id) JOIN bc USING (series_id) WHERE i = 1
UNION ALL SELECT n.series_id, g.cand, n.i, n.value - cd.mu, cd.omega + cd.alpha * g.e * g.e + cd.beta * g.s2 FROM gc g JOIN n ON n.series_id = g.series_id AND n.i = g.i + 1
  JOIN cd ON cd.series_id = g.series_id AND cd.cand = g.cand),
sc AS (SELECT series_id, cand, sum(-0.5 * (ln(2 * pi()) + ln(s2) + e * e / s2)) AS llf, count(*) AS n FROM gc GROUP BY 1, 2)"""


def scored_events(spark, sf_dir):
    x = pn.event_returns(spark, sf_dir)
    base = fixed_params(x).select("series_id", "mu", "omega")
    grid = [(a, b) for a in (0.05, 0.1, 0.2) for b in (0.6, 0.7, 0.75)]
    options = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("cand"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in grid])
    cands = base.withColumn("o", F.explode(options)).select("series_id", "o.cand", "mu", "omega", "o.alpha", "o.beta")
    return garch.garch_loglik(x, cands, HOURLY)


@query("mod09_garch_loglik", recursive(*RET_EVENTS, numbered(), GPARAM, CAND, SCORE) + f" SELECT series_id, cand, {r('llf', 5)} AS llf, n FROM sc")
def garch_loglik(spark, sf_dir):
    return finalize(scored_events(spark, sf_dir), 5)


@query("mod09_best_candidate", recursive(*RET_EVENTS, numbered(), GPARAM, CAND, SCORE) + f" SELECT series_id, arg_max(cand, llf) AS cand, {r('max(llf)', 5)} AS llf FROM sc GROUP BY 1")
def best_candidate(spark, sf_dir):
    return finalize(garch.best_candidate(scored_events(spark, sf_dir)), 5)


@query(
    "mod07_garch_reached",
    recursive(*RET_EVENTS, numbered(), GPARAM, CAND, SCORE) + f" SELECT series_id, arg_max(cand, llf) AS cand, {r('max(llf)', 5)} AS llf, true AS reached FROM sc GROUP BY 1",
)
def garch_reached(spark, sf_dir):
    """Best of a grid of GARCH(1, 1) models, and whether the fit has a likelihood not below it."""
    best = garch.best_candidate(scored_events(spark, sf_dir))
    fitted = garch.garch_fit(pn.event_returns(spark, sf_dir), 1, 1, "normal", width=HOURLY).select("series_id", F.col("llf").alias("fit_llf"))
    rows = best.join(fitted, "series_id")
    return finalize(rows.select("series_id", "cand", "llf", (F.col("fit_llf") >= F.col("llf") - 1e-6).alias("reached")), 5)


GFORE = """ls AS (SELECT series_id, arg_max(e * e, i) AS e2, arg_max(s2, i) AS s2 FROM gv GROUP BY 1),
h AS (SELECT unnest(range(1, 6)) AS step),
gf AS (SELECT series_id, step, omega / 0.1 + pow(0.1 + 0.8, step - 1) * (omega + 0.1 * e2 + 0.8 * s2 - omega / 0.1) AS v FROM ls JOIN pm USING (series_id) CROSS JOIN h)"""


def forecast_events(spark, sf_dir):
    x = pn.event_returns(spark, sf_dir)
    params = stage(fixed_params(x))
    state = garch.last_state(garch.garch_filter(x, params, 1, 1, HOURLY), 1, HOURLY)
    return params, garch.garch_forecast(params, state, 5)


@query(
    "mod10_garch_forecast",
    recursive(*GARCH_SQL, GFORE) + f" SELECT series_id, CAST(step AS INTEGER) AS step, {r('v')} AS variance, {r('sqrt(v)')} AS volatility FROM gf",
)
def garch_forecast(spark, sf_dir):
    return finalize(forecast_events(spark, sf_dir)[1])


# Shape parameters that differ by series, from the data: alpha by tax, beta by discount.
SHAPE = "SELECT CAST(l_suppkey AS VARCHAR) AS series_id, avg(l_tax) AS a, 0.9 + avg(l_discount) AS b, avg(l_discount) AS o FROM lineitem GROUP BY 1"


@query(
    "mod11_garch_diagnostics",
    f"""WITH s AS ({SHAPE}) SELECT series_id, {r('a + b')} AS persistence, {r('CASE WHEN a + b < 1 THEN o / (1 - a - b) END')} AS unconditional_variance,
    {r('CASE WHEN a + b < 1 THEN -ln(2) / ln(a + b) END', 4)} AS half_life FROM s""",
)
def garch_diagnostics(spark, sf_dir):
    items = pn.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("series_id"))
    s = items.agg(
        F.array(F.avg("l_tax")).alias("alpha"), F.array(0.9 + F.avg("l_discount")).alias("beta"), F.avg("l_discount").alias("omega")
    )
    return finalize(garch.diagnostics(s), places={"half_life": 4})


# Two-variable VAR(1) by group g: F is variable 1, O is variable 2.
PAIRS = f"""yy AS (SELECT a.ts, a.value AS y1, b.value AS y2 FROM x a JOIN x b ON a.ts = b.ts WHERE a.series_id = 'F' AND b.series_id = 'O'),
zz AS (SELECT ts, y1, y2, lag(y1) OVER (ORDER BY ts) AS l1, lag(y2) OVER (ORDER BY ts) AS l2, row_number() OVER (ORDER BY ts) AS i FROM yy)"""
ONE = "z AS (SELECT 'all' AS g, * FROM zz WHERE l1 IS NOT NULL)"
VAR1 = """mo AS (SELECT g, count(*) AS t, avg(y1) AS m1, avg(y2) AS m2, avg(l1) AS n1, avg(l2) AS n2, var_pop(l1) AS p11, covar_pop(l1, l2) AS p12, var_pop(l2) AS p22,
  covar_pop(l1, y1) AS q11, covar_pop(l2, y1) AS q21, covar_pop(l1, y2) AS q12, covar_pop(l2, y2) AS q22,
  var_pop(y1) AS v11, covar_pop(y1, y2) AS v12, var_pop(y2) AS v22 FROM z GROUP BY g),
co AS (SELECT *, p11 * p22 - p12 * p12 AS d, (p22 * q11 - p12 * q21) / (p11 * p22 - p12 * p12) AS a11, (p11 * q21 - p12 * q11) / (p11 * p22 - p12 * p12) AS a12,
  (p22 * q12 - p12 * q22) / (p11 * p22 - p12 * p12) AS a21, (p11 * q22 - p12 * q12) / (p11 * p22 - p12 * p12) AS a22 FROM mo),
cf AS (SELECT *, m1 - a11 * n1 - a12 * n2 AS c1, m2 - a21 * n1 - a22 * n2 AS c2, (v11 - a11 * q11 - a12 * q21) * t / (t - 3) AS s11,
  (v12 - a11 * q12 - a12 * q22) * t / (t - 3) AS s12, (v22 - a21 * q12 - a22 * q22) * t / (t - 3) AS s22 FROM co)"""
PSI = """ps AS (SELECT g, 0 AS h, 1.0::DOUBLE AS w11, 0.0::DOUBLE AS w12, 0.0::DOUBLE AS w21, 1.0::DOUBLE AS w22 FROM cf
UNION ALL SELECT ps.g, h + 1, a11 * w11 + a12 * w21, a11 * w12 + a12 * w22, a21 * w11 + a22 * w21, a21 * w12 + a22 * w22 FROM ps JOIN cf ON cf.g = ps.g WHERE h < 9)"""
GENERAL = """th AS (SELECT ps.g, sum(pow(w11 * s11 + w12 * s12, 2)) / any_value(s11) AS t11, sum(pow(w11 * s12 + w12 * s22, 2)) / any_value(s22) AS t12,
  sum(pow(w21 * s11 + w22 * s12, 2)) / any_value(s11) AS t21, sum(pow(w21 * s12 + w22 * s22, 2)) / any_value(s22) AS t22 FROM ps JOIN cf ON cf.g = ps.g GROUP BY ps.g)"""
CHOLESKY = """th AS (SELECT ps.g, sum(pow(w11 * sqrt(s11) + w12 * s12 / sqrt(s11), 2)) AS t11, sum(pow(w12, 2) * (s22 - s12 * s12 / s11)) AS t12,
  sum(pow(w21 * sqrt(s11) + w22 * s12 / sqrt(s11), 2)) AS t21, sum(pow(w22, 2) * (s22 - s12 * s12 / s11)) AS t22 FROM ps JOIN cf ON cf.g = ps.g GROUP BY ps.g)"""
FEVD2 = """fe AS (SELECT g, 'F' AS row_id, 'F' AS col_id, t11 / (t11 + t12) * 100 AS value FROM th UNION ALL SELECT g, 'F', 'O', t12 / (t11 + t12) * 100 FROM th
UNION ALL SELECT g, 'O', 'F', t21 / (t21 + t22) * 100 FROM th UNION ALL SELECT g, 'O', 'O', t22 / (t21 + t22) * 100 FROM th)"""


def status_model(spark, sf_dir):
    rows = var_model.prepared(pn.status_returns(spark, sf_dir), MONTHLY)
    return rows, stage(var_model.var_fit(rows, 1), "var")


@query(
    "mod12_var_fit",
    chain(*RET_STATUS, PAIRS, ONE, VAR1)
    + f""", u AS (SELECT 'F' AS equation, 'const' AS term, 0 AS lag, c1 AS b, sqrt(s11 * (1.0 / t + (n1 * n1 * p22 - 2 * n1 * n2 * p12 + n2 * n2 * p11) / d / t)) AS se FROM cf
    UNION ALL SELECT 'F', 'F', 1, a11, sqrt(s11 * p22 / d / t) FROM cf UNION ALL SELECT 'F', 'O', 1, a12, sqrt(s11 * p11 / d / t) FROM cf
    UNION ALL SELECT 'O', 'const', 0, c2, sqrt(s22 * (1.0 / t + (n1 * n1 * p22 - 2 * n1 * n2 * p12 + n2 * n2 * p11) / d / t)) FROM cf
    UNION ALL SELECT 'O', 'F', 1, a21, sqrt(s22 * p22 / d / t) FROM cf UNION ALL SELECT 'O', 'O', 1, a22, sqrt(s22 * p11 / d / t) FROM cf)
    SELECT equation, term, CAST(lag AS INTEGER) AS lag, {r('b')} AS estimate, {r('se')} AS std_err, {r('b / se')} AS t_stat FROM u""",
)
def var_fit(spark, sf_dir):
    _, m = status_model(spark, sf_dir)
    return finalize(var_model.var_coefficients(m).drop("panel_id", "p_value"))


@query(
    "mod12_var_sigma",
    chain(*RET_STATUS, PAIRS, ONE, VAR1)
    + f""" SELECT 'F' AS row_id, 'F' AS col_id, {r('s11', 8)} AS value FROM cf UNION ALL SELECT 'F', 'O', {r('s12', 8)} FROM cf
    UNION ALL SELECT 'O', 'F', {r('s12', 8)} FROM cf UNION ALL SELECT 'O', 'O', {r('s22', 8)} FROM cf""",
)
def var_sigma(spark, sf_dir):
    _, m = status_model(spark, sf_dir)
    return finalize(var_model.var_sigma(m).drop("panel_id"), 8)


@query(
    "mod12_var_residuals",
    chain(*RET_STATUS, PAIRS, ONE, VAR1)
    + f""", u AS (SELECT 'F' AS series_id, ts, y1 AS y, c1 + a11 * l1 + a12 * l2 AS f FROM z JOIN cf USING (g) UNION ALL SELECT 'O', ts, y2, c2 + a21 * l1 + a22 * l2 FROM z JOIN cf USING (g))
    SELECT series_id, {iso()} AS ts, {r('y')} AS value, {r('f')} AS fitted, {r('y - f')} AS residual FROM u""",
)
def var_residuals(spark, sf_dir):
    rows, m = status_model(spark, sf_dir)
    return finalize(var_model.var_residuals(rows, m, 1).drop("panel_id"))


THREE = {"a": "1-URGENT", "b": "3-MEDIUM", "c": "5-LOW"}
WIDE3 = (
    f"w3 AS (SELECT 'all' AS series_id, ts, {', '.join(f"max(CASE WHEN series_id = '{n}' THEN value END) AS {v}" for v, n in THREE.items())} FROM x GROUP BY ts)",
    f"l3 AS (SELECT *, {', '.join(f'lag({v}) OVER w AS l{v}' for v in THREE)} FROM w3 {W})",
)


def var_terms() -> tuple[list[str], str]:
    """One chain of regressions for each equation and term, with that term last."""
    parts, rows = [], []
    for y in THREE:
        for x in THREE:
            parts += partialled("l3", [*(f"l{v}" for v in THREE if v != x), f"l{x}"], y, f"v{y}{x}")
            rows.append(f"SELECT '{THREE[y]}' AS equation, '{THREE[x]}' AS term, 1 AS lag, {r('slope')} AS estimate, {r('sqrt(ssr_3 / (t - 4) / sxx)')} AS std_err FROM v{y}{x}")
    return parts, " UNION ALL ".join(rows)


@query("mod12_var_three", chain(*RET_ORDERS, *WIDE3, *var_terms()[0]) + " " + var_terms()[1])
def var_three(spark, sf_dir):
    """Slopes of a model of three variables."""
    panel = pn.orders_returns(spark, sf_dir).filter(F.col("series_id").isin(*THREE.values()))
    found = var_model.var_coefficients(stage(var_model.var_fit(var_model.prepared(panel, MONTHLY), 1)))
    return finalize(found.filter("term <> 'const'").select("equation", "term", "lag", "estimate", "std_err"))


@query("mod12_var_system")
def var_system(spark, sf_dir):
    rows = var_model.prepared(pn.nation_returns(spark, sf_dir), MONTHLY)
    return finalize(var_model.var_coefficients(stage(var_model.var_fit(rows, 2))).drop("panel_id"))


@query(
    "mod13_lag_select",
    chain(MARKET_M, returns("p", "x"),
          f"l AS (SELECT value AS y, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b FROM x {W})",
          """s AS (SELECT count(*) AS t, var_pop(y) AS v, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS vab, covar_pop(y, a) AS ca, covar_pop(y, b) AS cb FROM l WHERE b IS NOT NULL)""",
          """u AS (SELECT 1 AS lag, ln(v - ca * ca / va) + 2.0 * 2 / t AS ic FROM s
          UNION ALL SELECT 2, ln(v - (ca * (vb * ca - vab * cb) + cb * (va * cb - vab * ca)) / (va * vb - vab * vab)) + 2.0 * 3 / t FROM s)""")  # fmt: skip
    + f" SELECT CAST(lag AS INTEGER) AS lag, {r('ic')} AS value, ic = (SELECT min(ic) FROM u) AS is_selected FROM u",
)
def lag_select(spark, sf_dir):
    x = transform.log_returns(stage(pn.market_panel(spark, sf_dir)), MONTHLY)
    m = var_model.var_fit(var_model.prepared(x, MONTHLY), 2)
    return finalize(var_model.var_lag_table(m).drop("panel_id"))


def fevd_query(identification: str):
    def run(spark, sf_dir):
        _, m = status_model(spark, sf_dir)
        return finalize(var_model.fevd(m, 10, identification).drop("panel_id"))

    return run


FE_COLS = f" SELECT row_id, col_id, {r('value')} AS value FROM fe"
query("mod14_fevd_generalized", recursive(*RET_STATUS, PAIRS, ONE, VAR1, PSI, GENERAL, FEVD2) + FE_COLS)(fevd_query("generalized"))
query("mod14_fevd_cholesky", recursive(*RET_STATUS, PAIRS, ONE, VAR1, PSI, CHOLESKY, FEVD2) + FE_COLS)(fevd_query("cholesky"))

SPILL2 = """sp AS (SELECT g, (t12 / (t11 + t12) + t21 / (t21 + t22)) / 2 * 100 AS total, t12 / (t11 + t12) * 100 AS f_from, t21 / (t21 + t22) * 100 AS o_from FROM th),
su AS (SELECT g, 'F' AS series_id, total, f_from AS from_others, o_from AS to_others, o_from - f_from AS net FROM sp
  UNION ALL SELECT g, 'O', total, o_from, f_from, f_from - o_from FROM sp)"""
SPILL_COLS = f"series_id, {r('total')} AS total, {r('from_others')} AS from_others, {r('to_others')} AS to_others, {r('net')} AS net"


@query("mod15_spillover", recursive(*RET_STATUS, PAIRS, ONE, VAR1, PSI, GENERAL, SPILL2) + f" SELECT {SPILL_COLS} FROM su")
def spillover(spark, sf_dir):
    s = var_model.spillover(pn.status_returns(spark, sf_dir), horizon=10, max_lags=1, width=MONTHLY)
    total = s["total"].scalar()
    return finalize(s["directional"].withColumn("total", total))


TWO = """z AS (SELECT 'all' AS g, * FROM zz WHERE l1 IS NOT NULL
UNION ALL SELECT 'late', * FROM zz WHERE i > (SELECT min(i) FROM zz WHERE ts >= TIMESTAMP '1995-01-01'))"""


@query("mod15_two_panels", recursive(*RET_STATUS, PAIRS, TWO, VAR1, PSI, GENERAL, SPILL2) + f" SELECT g AS panel_id, {SPILL_COLS} FROM su")
def two_panels(spark, sf_dir):
    """The same series in two panels of one job: all dates, and the later ones."""
    x = pn.status_returns(spark, sf_dir)
    late = x.filter(F.col("ts") >= F.lit("1995-01-01").cast("timestamp"))
    both = x.withColumn("panel_id", F.lit("all")).unionByName(late.withColumn("panel_id", F.lit("late")))
    s = var_model.spillover(stage(both), horizon=10, max_lags=1, width=MONTHLY)
    return finalize(s["directional"].join(s["total"], "panel_id"))


@query("mod15_garch_spillover")
def garch_spillover(spark, sf_dir):
    vol = filtered_events(spark, sf_dir).select("series_id", "ts", F.col("volatility").alias("value"))
    s = var_model.spillover(vol, "garch_spillover", 10, 2, volatility=vol, width=HOURLY)
    return finalize(s["pairwise"])


ROLL = "z AS (SELECT strftime(e.ts, '%Y-%m-%dT%H:%M:%S') AS g, zz.* FROM zz JOIN zz e ON zz.i BETWEEN e.i - 22 AND e.i WHERE e.i >= 24)"


@query("mod16_rolling_spillover", recursive(*RET_STATUS, PAIRS, ROLL, VAR1, PSI, GENERAL, SPILL2) + f" SELECT g AS ts, {SPILL_COLS}, 'ok' AS status FROM su")
def rolling_spillover(spark, sf_dir):
    x = pn.status_returns(spark, sf_dir)
    return finalize(var_model.rolling_spillover(x, 24, 10, 1, 1, width=MONTHLY, size=32).drop("panel_id"))


# Two-sided tail of Student's t by its finite sum in the angle whose tangent is t / sqrt(dof).
def t_tail(t: str, dof: str) -> str:
    theta = f"atan(({t}) / sqrt({dof}))"
    even = f"sin({theta}) * list_sum([exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)) * pow(cos({theta}), 2 * j) FOR j IN range(0, CAST({dof} AS BIGINT) // 2)])"
    odd = (
        f"2 / pi() * ({theta} + sin({theta}) * list_sum([exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos({theta}), 2 * j + 1) "
        f"FOR j IN range(0, (CAST({dof} AS BIGINT) - 1) // 2)]))"
    )
    return f"1 - CASE WHEN CAST({dof} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END"


GRANGER1 = f"""lg AS (SELECT *, lag(value) OVER w AS l FROM x {W}),
gr AS (SELECT s.series_id AS source, t.series_id AS target, count(*) AS n, corr(t.value, s.l) AS rx, corr(t.value, t.l) AS ro, corr(s.l, t.l) AS rc
  FROM lg t JOIN lg s ON s.ts = t.ts AND s.series_id <> t.series_id WHERE t.l IS NOT NULL GROUP BY 1, 2),
gp AS (SELECT *, pow(rx - ro * rc, 2) / ((1 - ro * ro) * (1 - rc * rc)) AS r2, n - 3 AS dof FROM gr),
gs AS (SELECT source, target, n + 1 AS n_obs, dof, r2 / (1 - r2) * dof AS f FROM gp),
gt AS (SELECT *, {t_tail('sqrt(f)', 'dof')} AS p FROM gs)"""


@query("mod17_granger", chain(*RET_NATION, GRANGER1) + f" SELECT source, target, n_obs, 1 AS lag, {r('f')} AS f_stat, {r('p')} AS p_value FROM gt")
def granger(spark, sf_dir):
    rows = var_model.prepared(pn.nation_returns(spark, sf_dir), MONTHLY)
    return finalize(var_model.granger_long(var_model.granger(rows, 1)).drop("panel_id"))


@query(
    "agg12_granger_summary",
    chain(*RET_NATION, GRANGER1)
    + " SELECT count(*) AS pairs_tested, count(*) FILTER (p < 0.01) AS significant_1pct, count(*) FILTER (p < 0.05) AS significant_5pct FROM gt",
)
def granger_counts(spark, sf_dir):
    rows = var_model.prepared(pn.nation_returns(spark, sf_dir), MONTHLY)
    return aggregate.granger_summary(var_model.granger(rows, 1))


GRANGER2 = (
    f"""lg AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM x {W}),
pairs2 AS (SELECT s.series_id || '->' || t.series_id AS series_id, s.series_id AS source, t.series_id AS target, t.value AS y, t.l1 AS o1, t.l2 AS o2, s.l1 AS x1, s.l2 AS x2
  FROM lg t JOIN lg s ON s.ts = t.ts AND s.series_id <> t.series_id)""",
    *partialled("pairs2", ["o1", "o2", "x1", "x2"], "y", "g2"),
)


@query(
    "mod17_granger_lag2",
    chain(*RET_NATION, *GRANGER2)
    + f" SELECT split_part(series_id, '->', 1) AS source, split_part(series_id, '->', 2) AS target, t + 2 AS n_obs, {r('(ssr_2 - ssr_4) / 2 / (ssr_4 / (t - 5))')} AS f_stat FROM g2",
)
def granger_lag2(spark, sf_dir):
    rows = var_model.prepared(pn.nation_returns(spark, sf_dir), MONTHLY)
    tests = var_model.granger_long(var_model.granger(rows, 3)).filter("lag = 2")
    return finalize(tests.select("source", "target", "n_obs", "f_stat"))


# With two restrictions the F tail is a power.
BEST_P = f"""g1 AS (SELECT source || '->' || target AS series_id, p FROM gt),
tails AS (SELECT series_id, p AS p1, pow(1 + 2 * ((ssr_2 - ssr_4) / 2 / (ssr_4 / (t - 5))) / (t - 5), -(t - 5) / 2.0) AS p2 FROM g2 JOIN g1 USING (series_id))"""


@query(
    "top05_best_lag_by_p",
    chain(*RET_NATION, GRANGER1, *[c.replace("lg AS", "lg2 AS").replace("FROM lg t JOIN lg s", "FROM lg2 t JOIN lg2 s") for c in GRANGER2], BEST_P)
    + f" SELECT split_part(series_id, '->', 1) AS source, split_part(series_id, '->', 2) AS target, CASE WHEN p2 < p1 THEN 2 ELSE 1 END AS best_lag, {r('least(p1, p2)')} AS p_value FROM tails",
)
def best_lag_by_p(spark, sf_dir):
    rows = var_model.prepared(pn.nation_returns(spark, sf_dir), MONTHLY)
    return finalize(aggregate.best_lag(var_model.granger_long(var_model.granger(rows, 2)), ["source", "target"]))


@query("mod17_granger_lags")
def granger_lags(spark, sf_dir):
    rows = var_model.prepared(pn.nation_returns(spark, sf_dir), MONTHLY)
    return finalize(var_model.granger(rows, 5).drop("f_stats", "p_values", "panel_id"))


CCC_PAIRS = pair_sql("corr(a.value, b.value) AS value", "zs", diagonal=False)
CCC = f"""zs AS (SELECT series_id, ts, e / sqrt(s2) AS value FROM gv), {CCC_PAIRS},
lv AS (SELECT series_id, arg_max(sqrt(s2), i) AS v FROM gv GROUP BY 1),
cc AS (SELECT row_id, col_id, value FROM pr UNION ALL SELECT col_id, row_id, value FROM pr UNION ALL SELECT series_id, series_id, 1.0 FROM lv)"""


@query(
    "mod18_ccc",
    recursive(*GARCH_SQL, CCC)
    + f" SELECT row_id, col_id, {r('value')} AS corr, {r('value * a.v * b.v')} AS cov FROM cc JOIN lv a ON a.series_id = row_id JOIN lv b ON b.series_id = col_id",
)
def ccc(spark, sf_dir):
    c = mgarch.ccc(filtered_events(spark, sf_dir), HOURLY)
    corr = c["correlation"].withColumnRenamed("value", "corr")
    return finalize(corr.join(c["covariance"].withColumnRenamed("value", "cov"), ["row_id", "col_id"]))


DCC = """zn AS (SELECT series_id, ts, i, e / sqrt(s2) AS value FROM gv),
cr AS (SELECT a.series_id AS a, b.series_id AS b, corr(a.value, b.value) AS rho FROM zn a JOIN zn b ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY 1, 2),
zp AS (SELECT x1.series_id AS a, x2.series_id AS b, x1.i, x1.ts, x1.value AS za, x2.value AS zb FROM zn x1 JOIN zn x2 ON x1.i = x2.i AND x1.series_id < x2.series_id),
dc AS (SELECT zp.a, zp.b, i, ts, za, zb, rho AS q, 1.0::DOUBLE AS qa, 1.0::DOUBLE AS qb FROM zp JOIN cr ON cr.a = zp.a AND cr.b = zp.b WHERE i = 1
UNION ALL SELECT zp.a, zp.b, zp.i, zp.ts, zp.za, zp.zb, 0.95 * d.q + 0.05 * d.za * d.zb, 0.95 * d.qa + 0.05 * d.za * d.za, 0.95 * d.qb + 0.05 * d.zb * d.zb
FROM dc d JOIN zp ON zp.a = d.a AND zp.b = d.b AND zp.i = d.i + 1)"""


def dcc_events(spark, sf_dir, size=512):
    z = filtered_events(spark, sf_dir).select("series_id", "ts", F.col("std_resid").alias("value"))
    return mgarch.dcc_ewma(z, 0.95, HOURLY, size)


@query("mod19_dcc_ewma", recursive(*GARCH_SQL, DCC) + f" SELECT {iso()} AS ts, a AS row_id, b AS col_id, {r('q')} AS q, {r('q / sqrt(qa * qb)')} AS rho FROM dc")
def dcc_ewma(spark, sf_dir):
    return finalize(dcc_events(spark, sf_dir, 128))


@query(
    "mod19_dcc_covariance",
    recursive(*GARCH_SQL, DCC, "sv AS (SELECT series_id, i, sqrt(s2) AS v FROM gv)")
    + f""" SELECT {iso('dc.ts')} AS ts, a AS row_id, b AS col_id, {r('q / sqrt(qa * qb)')} AS rho, {r('q / sqrt(qa * qb) * va.v * vb.v')} AS cov FROM dc
    JOIN sv va ON va.series_id = a AND va.i = dc.i JOIN sv vb ON vb.series_id = b AND vb.i = dc.i""",
)
def dcc_covariance(spark, sf_dir):
    vol = filtered_events(spark, sf_dir)
    z = vol.select("series_id", "ts", F.col("std_resid").alias("value"))
    return finalize(mgarch.dcc_covariance(mgarch.dcc_ewma(z, 0.95, HOURLY, 256), vol))


STAGES = ("prices", "filled", "returns", "scaled", "stationarity", "arima_forecast", "garch_forecast", "spillover_table", "spillover_pairwise", "granger", "ccc_covariance")


@query(
    "mod20_full_run",
    chain(*RET_ORDERS)
    + """, n AS (SELECT count(DISTINCT series_id) AS s, count(*) AS r FROM x)
    SELECT 'prices' AS stage, count(*) AS n_rows, round(avg(value), 4) + 0.0 AS mean_value FROM p UNION ALL SELECT 'filled', count(*), round(avg(value), 4) + 0.0 FROM k
    UNION ALL SELECT 'returns', count(*), round(avg(value), 4) + 0.0 FROM x UNION ALL SELECT 'scaled', r, NULL FROM n
    UNION ALL SELECT 'stationarity', s, NULL FROM n UNION ALL SELECT 'arima_forecast', s * 20, NULL FROM n UNION ALL SELECT 'garch_forecast', s * 3, NULL FROM n
    UNION ALL SELECT 'spillover_table', s * s, 100.0 / s FROM n UNION ALL SELECT 'spillover_pairwise', s * (s - 1), NULL FROM n UNION ALL SELECT 'granger', s * (s - 1), NULL FROM n
    UNION ALL SELECT 'ccc_covariance', s * s, NULL FROM n""",
)
def full_run(spark, sf_dir):
    out = run_stages(stage(pn.orders_panel(spark, sf_dir)), RunConfig(width=MONTHLY))
    # The mean of a decomposition is known too: its rows sum to 100.
    valued = ("prices", "filled", "returns", "spillover_table")
    mean = lambda s: (F.avg("value") if s in valued else F.lit(None).cast("double")).alias("mean_value")
    counts = [finalize(out[s].groupBy().agg(F.count(F.lit(1)).alias("n_rows"), mean(s)), 4).select(F.lit(s).alias("stage"), "n_rows", "mean_value") for s in STAGES]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


@query(
    "mod21_run_configuration",
    chain(ORDERS_M)
    + f""" SELECT count(DISTINCT series_id) AS n_series, count(*) AS n_observations, {iso('min(ts)')} AS start_date, {iso('max(ts)')} AS end_date,
    'drop' AS fill_strategy, 'standardize' AS scaling_method, {r('0.05::DOUBLE')} AS adf_threshold, 'fill, log returns, stationarity test, volatility scaling' AS transformations,
    'ARIMA(2,1,4), GARCH(1,1), spillover, granger causality, CCC and DCC correlations' AS models, 10 AS spillover_horizon, 5 AS var_max_lags FROM p""",
)
def configuration(spark, sf_dir):
    return finalize(run_configuration(pn.orders_panel(spark, sf_dir)))
