"""The staged run: prices to interpretation, each stage a table that is made on demand."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators import aggregate, arima, fill, garch, interpret, matrices, mgarch, stationarity, transform, var_model
from panelflow.operators.blocks import DEFAULT_WIDTH
from panelflow.plans.staging import stage


@dataclass(frozen=True)
class RunConfig:
    """Defaults of one run; pass keyword arguments to change any of them."""

    fill_strategy: str = "drop"
    scaling_method: str = "standardize"
    adf_lags: int | str = "aic"
    adf_threshold: float = 0.05
    arima_p: int = 2
    arima_d: int = 1
    arima_q: int = 4
    arima_steps: int = 20
    garch_p: int = 1
    garch_q: int = 1
    garch_dist: str = "t"
    garch_steps: int = 3
    spillover_enabled: bool = True
    spillover_method: str = "diebold_yilmaz"
    spillover_horizon: int = 10
    identification: str = "generalized"
    var_max_lags: int = 5
    granger_max_lag: int = 5
    dcc_lambda: float = 0.95
    window_size: int | None = None
    width: int = DEFAULT_WIDTH


class Run(Mapping):
    """Stage tables of one panel by name. A table, and what it needs, is made when it is first asked for.

    Tables that several others read are written once (``stage``) at that moment; tables that nobody asks for cost
    nothing. Each public method below ``_shared`` is one table.
    """

    def __init__(self, prices: DataFrame, cfg: RunConfig):
        self._prices, self.cfg, self._made = prices, cfg, {}
        skipped = set() if cfg.spillover_enabled else set(_SPILLOVER)
        if not cfg.window_size:
            skipped.add("rolling_spillover")
        self._names = [n for n in _TABLES if n not in skipped]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = getattr(self, name)()
        return self._made[name]

    def _shared(self, label: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is written once, under a name of its own."""
        if label not in self._made:
            self._made[label] = stage(make(), label)
        return self._made[label]

    def prices(self) -> DataFrame:
        return self._prices

    def _aligned(self) -> DataFrame:
        return self._shared("aligned", lambda: fill.align_outer(self._prices, self.cfg.width))

    def missing_report(self) -> DataFrame:
        return fill.missing_report(self._aligned())

    def filled(self) -> DataFrame:
        return stage(fill.fill(self._aligned(), self.cfg.fill_strategy, self.cfg.width), "filled")

    def returns(self) -> DataFrame:
        raw = stage(transform.log_returns(self["filled"], self.cfg.width), "returns")
        return stage(fill.fill(raw, self.cfg.fill_strategy, self.cfg.width), "clean")

    def stationarity(self) -> DataFrame:
        adf = stationarity.adf_test(self["returns"], self.cfg.adf_lags, self.cfg.adf_threshold, width=self.cfg.width)
        return interpret.interpret_adf(stage(adf, "adf"), self.cfg.adf_threshold)

    def stationarity_flags(self) -> DataFrame:
        return aggregate.stationarity_flags(self["stationarity"])

    def series_stats(self) -> DataFrame:
        return aggregate.series_stats(self["returns"], width=self.cfg.width)

    def scaled(self) -> DataFrame:
        return stage(transform.scale_for_garch(self["returns"], width=self.cfg.width, method=self.cfg.scaling_method), "scaled")

    def _values(self) -> DataFrame:
        return self["scaled"].select("series_id", "ts", "value")

    def arima_models(self) -> DataFrame:
        c = self.cfg
        return stage(fit_by_length(self._values(), c.arima_p, c.arima_d, c.arima_q, c.width), "arima-models")

    def arima_params(self) -> DataFrame:
        return arima.arima_params(self["arima_models"])

    def arima_residuals(self) -> DataFrame:
        c = self.cfg
        models = full_orders(self["arima_models"], c.arima_p, c.arima_q)
        return stage(arima.arima_filter(self._values(), models, c.arima_p, c.arima_d, c.arima_q, c.width), "residuals")

    def arima_forecast(self) -> DataFrame:
        c = self.cfg
        state = arima.forecast_state(self._values(), self["arima_residuals"], c.arima_p, c.arima_d, c.arima_q, c.width)
        return stage(arima.arima_forecast(self["arima_models"], state, c.arima_steps), "forecast")

    def _residuals(self) -> DataFrame:
        return self["arima_residuals"].select("series_id", "ts", F.col("residual").alias("value"))

    def residual_stats(self) -> DataFrame:
        return aggregate.residual_stats(self._residuals(), self.cfg.width)

    def arima_interpretation(self) -> DataFrame:
        stats = aggregate.forecast_stats(self["arima_forecast"].select("series_id", "step", F.col("mean").alias("value")))
        return interpret.interpret_arima(stats.join(aggregate.error_metrics(self._residuals()), "series_id", "left"))

    def garch_models(self) -> DataFrame:
        c = self.cfg
        return stage(garch.garch_fit(self._residuals(), c.garch_p, c.garch_q, c.garch_dist, width=c.width), "garch-models")

    def garch_params(self) -> DataFrame:
        return garch.garch_params(self["garch_models"])

    def volatility(self) -> DataFrame:
        c = self.cfg
        return stage(garch.garch_filter(self._residuals(), self["garch_models"], c.garch_p, c.garch_q, c.width), "volatility")

    def garch_forecast(self) -> DataFrame:
        c = self.cfg
        state = garch.last_state(self["volatility"], max(c.garch_p, c.garch_q), c.width)
        return stage(garch.garch_forecast(self["garch_models"], state, c.garch_steps), "garch-forecast")

    def garch_interpretation(self) -> DataFrame:
        stats = aggregate.forecast_stats(self["garch_forecast"].select("series_id", "step", F.col("volatility").alias("value")))
        return interpret.interpret_garch(stats.join(garch.diagnostics(self["garch_models"]), "series_id"))

    def _source(self) -> DataFrame:
        if self.cfg.spillover_method == "garch_spillover":
            return self["volatility"].select("series_id", "ts", F.col("volatility").alias("value"))
        return self["returns"]

    def _system(self) -> DataFrame:
        if "system" not in self._made:
            self._made["system"] = var_model.prepared(self._source(), self.cfg.width)
        return self._made["system"]

    def var_model(self) -> DataFrame:
        return stage(var_model.var_fit(self._system(), self.cfg.var_max_lags), "var-model")

    def spillover_table(self) -> DataFrame:
        table = stage(var_model.fevd(self["var_model"], self.cfg.spillover_horizon, self.cfg.identification), "fevd")
        return table.select("row_id", "col_id", "value")

    def spillover_total(self) -> DataFrame:
        return matrices.total_spillover(self["spillover_table"])

    def spillover_net(self) -> DataFrame:
        return stage(matrices.directional(self["spillover_table"]), "net")

    def spillover_pairwise(self) -> DataFrame:
        return interpret.interpret_pairwise(matrices.pairwise(self["spillover_table"]))

    def granger(self) -> DataFrame:
        return stage(var_model.granger(self._system(), self.cfg.granger_max_lag), "granger")

    def granger_interpretation(self) -> DataFrame:
        return interpret.interpret_granger(self["granger"])

    def spillover_interpretation(self) -> DataFrame:
        return interpret.interpret_spillover_pct(self["spillover_total"], self["spillover_net"], aggregate.granger_summary(self["granger"]))

    def var_interpretation(self) -> DataFrame:
        return interpret.interpret_var(self["spillover_table"], self["var_model"])

    def rolling_spillover(self) -> DataFrame:
        return var_model.rolling_spillover(self._source(), self.cfg.window_size, self.cfg.spillover_horizon, width=self.cfg.width)

    def _constant(self) -> dict[str, DataFrame]:
        if "constant" not in self._made:
            self._made["constant"] = mgarch.ccc(self["volatility"], self.cfg.width)
        return self._made["constant"]

    def ccc_correlation(self) -> DataFrame:
        return self._constant()["correlation"]

    def ccc_covariance(self) -> DataFrame:
        return stage(self._constant()["covariance"], "ccc")

    def _dcc(self) -> DataFrame:
        z = self["volatility"].select("series_id", "ts", F.col("std_resid").alias("value"))
        return self._shared("dcc-paths", lambda: mgarch.dcc_ewma(z, self.cfg.dcc_lambda, self.cfg.width))

    def dcc(self) -> DataFrame:
        return mgarch.dcc_covariance(self._dcc(), self["volatility"])

    def _profile(self) -> DataFrame:
        return self._shared("profile", lambda: aggregate.corr_series_profile(mgarch.as_paths(self._dcc()), self.cfg.width))

    def mgarch_interpretation(self) -> DataFrame:
        return interpret.interpret_mgarch(self._profile())

    def correlation_dynamics(self) -> DataFrame:
        return interpret.interpret_corr_dynamics(self._profile())

    def portfolio_risk(self) -> DataFrame:
        return interpret.interpret_portfolio(matrices.portfolio_risk(self["ccc_covariance"]))


_TABLES = [n for n, v in vars(Run).items() if not n.startswith("_")]
_SPILLOVER = _TABLES[_TABLES.index("var_model") :]


def run_stages(prices: DataFrame, config: RunConfig | None = None, **changes) -> Run:
    """Stage tables of one panel, by name and made on demand: ``run_stages(prices)["granger"]`` fits no volatility model."""
    return Run(prices, RunConfig(**{**asdict(config or RunConfig()), **changes}))


def fit_by_length(values: DataFrame, p: int, d: int, q: int, width: int, full_from: int = 30) -> DataFrame:
    """Fit with full orders, or with p and q of at most 1 for series under ``full_from`` rows.

    Each model row has the orders, coefficients and errors that were really fitted.
    """
    if p <= 1 and q <= 1:
        return arima.arima_fit(values, p, d, q, width)
    limits = fill.order_limits(values, p=p, q=q, full_from=full_from)
    short = fill.only(values, limits.filter(F.col("n_obs") < full_from), width)
    full = arima.arima_fit(fill.require_min_obs(values, full_from, width), p, d, q, width)
    return full.unionByName(arima.arima_fit(short, min(p, 1), d, min(q, 1), width))


def full_orders(models: DataFrame, p: int, q: int) -> DataFrame:
    """Models with zeros for the lags that were not fitted, for a filter that runs one order for all."""

    def padded(col: str, size: int):
        zeros = F.array_repeat(F.lit(0.0), size)
        return F.when(F.col(col).isNotNull(), F.slice(F.concat(F.col(col), zeros), 1, size))

    return models.withColumns({"phi": padded("phi", p), "theta": padded("theta", q)})


def run_configuration(prices: DataFrame, config: RunConfig | None = None) -> DataFrame:
    """One row that describes a run: data range, number of series and the models it fits."""
    cfg = config or RunConfig()
    models = [f"ARIMA({cfg.arima_p},{cfg.arima_d},{cfg.arima_q})", f"GARCH({cfg.garch_p},{cfg.garch_q})"]
    if cfg.spillover_enabled:
        models += ["spillover", "granger causality", "CCC and DCC correlations"]
    steps = ["fill", "log returns", "stationarity test", "volatility scaling"]
    return prices.agg(
        F.count_distinct("series_id").alias("n_series"),
        F.count(F.lit(1)).alias("n_observations"),
        F.min("ts").alias("start_date"),
        F.max("ts").alias("end_date"),
    ).withColumns(
        {
            "fill_strategy": F.lit(cfg.fill_strategy),
            "scaling_method": F.lit(cfg.scaling_method),
            "adf_threshold": F.lit(cfg.adf_threshold),
            "transformations": F.lit(", ".join(steps)),
            "models": F.lit(", ".join(models)),
            "spillover_horizon": F.lit(cfg.spillover_horizon),
            "var_max_lags": F.lit(cfg.var_max_lags),
        }
    )
