"""Rule tables that label model results. Thresholds are strict unless a comment says otherwise.

Every function adds label columns and one ``text`` column and works on any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.scalar import ADF_FALLBACK, significance_label, var_param_count
from panelflow.operators.matrices import rank_contributors, top_net


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str, below: bool = False) -> Column:
    """First label whose threshold ``x`` exceeds (or, with ``below``, is under); null stays null."""
    out = None
    for limit, label in steps:
        cond = x < F.lit(limit) if below else x > F.lit(limit)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.when(x.isNotNull(), out.otherwise(otherwise))


def _direction(first: Column, last: Column, up: str, down: str, flat: str) -> Column:
    return F.when(last > first, up).when(last < first, down).otherwise(flat)


def interpret_adf(adf: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Needs ``adf_statistic, p_value``; critical values default to the fixed table."""

    def crit(name: str) -> Column:
        fallback = F.lit(ADF_FALLBACK[name])
        return F.coalesce(F.col(name), fallback) if name in adf.columns else fallback

    stat, p = F.col("adf_statistic"), F.col("p_value")
    missing = stat.isNull() | p.isNull()
    stationary = p < threshold
    evidence = (
        F.when(stat < crit("crit_1"), "Strong")
        .when(stat < crit("crit_5"), "Moderate")
        .when(stat < crit("crit_10"), "Weak")
        .otherwise("None")
    )
    level = (
        F.when(stat < crit("crit_1"), "1%").when(stat < crit("crit_5"), "5%").when(stat < crit("crit_10"), "10%").otherwise("none")
    )
    text = F.format_string(
        "ADF %.4f with p-value %.4f: %s evidence against a unit root, series is %s.",
        stat, p, F.lower(evidence), F.when(stationary, "stationary").otherwise("non-stationary"),
    )
    return adf.withColumns(
        {
            "verdict": F.when(missing, "error").when(stationary, "Stationary").otherwise("Non-stationary"),
            "evidence": F.when(~missing, evidence),
            "significance_level": F.when(~missing, level),
            "confidence": F.when(~missing, (1 - p) * 100),
            "action": F.when(missing, None).when(stationary, "model as is").otherwise("difference or transform first"),
            "text": F.when(missing, "statistic or p-value is missing").otherwise(text),
        }
    )


def interpret_arima(stats: DataFrame) -> DataFrame:
    """Needs ``forecast_stats`` columns ``first, last, mean, std, cv``; ``mae`` may be absent or null."""
    first, last = F.col("first"), F.col("last")
    change = F.when(first == 0, F.lit(0.0)).otherwise(F.abs((last - first) / first))
    mae = F.col("mae") if "mae" in stats.columns else F.lit(None).cast("double")
    trend = _direction(first, last, "increasing", "decreasing", "stable")
    movement = ladder(change, [(0.1, "substantial"), (0.05, "moderate")], "stable")
    quality = F.coalesce(ladder(mae, [(0.01, "Excellent"), (0.05, "Good"), (0.10, "Fair")], "Poor", below=True), F.lit("Unknown"))
    return stats.withColumns(
        {
            "trend": trend,
            "magnitude_change": change,
            "movement": movement,
            "quality": quality,
            "forecast_confidence": ladder(F.col("cv"), [(0.02, "High"), (0.05, "Moderate")], "Low", below=True),
            "text": F.format_string("Forecast goes from %.4f to %.4f (%s, %s); fit quality %s.", first, last, trend, movement, quality),
        }
    )


def interpret_garch(rows: DataFrame) -> DataFrame:
    """Needs ``first, last`` of the volatility forecast and ``persistence``."""
    first, last, persistence = F.col("first"), F.col("last"), F.col("persistence")
    change = F.when(first == 0, F.lit(0.0)).otherwise((last - first) / first)
    level = ladder(last, [(0.03, "high"), (0.015, "moderate")], "low")
    lasting = ladder(persistence, [(0.99, "very high"), (0.95, "high"), (0.85, "moderate"), (0.5, "low")], "very low")
    trend = _direction(first, last, "increasing", "decreasing", "stable")
    return rows.withColumns(
        {
            "volatility_level": level,
            "trend": trend,
            "persistence_level": lasting,
            "forecast_confidence": ladder(persistence, [(0.98, "Low"), (0.9, "Moderate")], "High"),
            "change": change,
            "change_size": ladder(F.abs(change), [(0.2, "substantial"), (0.1, "moderate")], "minimal"),
            "text": F.format_string("Volatility is %s and %s; persistence %.3f is %s.", level, trend, persistence, lasting),
        }
    )


def interpret_spillover_index(indices: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(key, value)`` with keys ``total``, ``from_<id>`` and ``to_<id>``."""
    strong = F.col("value") > threshold
    kind = F.when(F.col("key").startswith("from_"), "from").when(F.col("key").startswith("to_"), "to").otherwise("total")
    name = F.when(kind == "total", F.lit(None)).otherwise(F.regexp_replace("key", "^(from|to)_", ""))
    strength = F.when(strong, "strong").otherwise("limited")
    return indices.withColumns(
        {
            "kind": kind,
            "series_id": name,
            "strength": strength,
            "text": F.format_string("%s spillover %.4f is %s.", F.col("key"), F.col("value"), strength),
        }
    )


def interpret_granger(tests: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("causality_1pct"), "highly significant").when(F.col("causality_5pct"), "significant").otherwise("none")
    )
    lag = F.when(F.col("causality_1pct"), F.col("optimal_lag_1pct")).when(F.col("causality_5pct"), F.col("optimal_lag_5pct"))
    p = F.coalesce("min_p_value", F.lit(1.0))
    found = F.format_string("%s helps predict %s (%s, lag %d, p %.4f).", F.col("source"), F.col("target"), level, lag, p)
    none = F.format_string("%s does not help predict %s (smallest p %.4f).", F.col("source"), F.col("target"), p)
    return tests.withColumns({"causality": level, "best_lag": lag, "text": F.when(lag.isNull(), none).otherwise(found)})


def interpret_spillover_fraction(rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``(kind, series_id, value)`` on a 0-1 scale; kind is total, to, from or net."""
    kind, v = F.col("kind"), F.col("value")
    label = (
        F.when(kind == "total", ladder(v, [(0.5, "strong"), (0.3, "moderate")], "weak"))
        .when(kind == "net", F.when(F.abs(v) < threshold, "balanced").when(v > 0, "transmitter").otherwise("receiver"))
        .otherwise(F.when(v > threshold, "significant").otherwise("minimal"))
    )
    return rows.withColumns(
        {"label": label, "text": F.format_string("%s %s: %.4f, %s.", kind, F.coalesce("series_id", F.lit("system")), v, label)}
    )


def interpret_spillover_pct(total: DataFrame, net: DataFrame, granger_counts: DataFrame | None = None) -> DataFrame:
    """One row for the system: level, top-2 transmitters and receivers, and significant causality pairs."""
    tops = top_net(net).groupBy().agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "transmitter", F.struct((-F.round("net", 9)).alias("o"), "series_id")))), lambda s: s["series_id"]), ", "
        ).alias("transmitters"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "receiver", F.struct(F.round("net", 9).alias("o"), "series_id")))), lambda s: s["series_id"]), ", "
        ).alias("receivers"),
    )
    tops_row = tops.select(F.struct("transmitters", "receivers").alias("t")).scalar()
    out = total.select(
        "total",
        ladder(F.col("total"), [(50.0, "high"), (25.0, "moderate")], "low").alias("level"),
        tops_row.getField("transmitters").alias("transmitters"),
        tops_row.getField("receivers").alias("receivers"),
    )
    if granger_counts is not None:
        counts = granger_counts.select(F.struct("significant_1pct", "significant_5pct").alias("c")).scalar()
        out = out.withColumns({c: counts.getField(c) for c in ("significant_1pct", "significant_5pct")})
    text = F.format_string("Total spillover %.2f%% is %s; transmitters: %s; receivers: %s.", F.col("total"), F.col("level"), F.col("transmitters"), F.col("receivers"))
    return out.withColumn("text", text)


def interpret_pairwise(pairs: DataFrame) -> DataFrame:
    """``(source, target, value)`` in percent."""
    strength = ladder(F.col("value"), [(5.0, "minimal"), (20.0, "moderate")], "strong", below=True)
    return pairs.withColumns(
        {
            "strength": strength,
            "text": F.format_string("%s explains %.2f%% of %s: %s.", F.col("source"), F.col("value"), F.col("target"), strength),
        }
    )


def interpret_var(fevd: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Own share and the two largest external contributors per variable; lag memory when a model row is given."""
    own = fevd.filter(F.col("row_id") == F.col("col_id")).select("row_id", F.col("value").alias("own_share"))
    ranked = rank_contributors(fevd, 2)
    top = ranked.groupBy("row_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("col_id"))).alias("first_source"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("first_share"),
        F.max(F.when(F.col("rank") == 2, F.col("col_id"))).alias("second_source"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("second_share"),
    )
    role = ladder(F.col("own_share"), [(70.0, "autonomous"), (50.0, "balanced")], "interconnected")
    out = own.join(top, "row_id", "left").withColumn("role", role)
    if model is not None:
        info = model.select(F.struct("lag", F.size("names").alias("k")).alias("m")).scalar()
        lag = info.getField("lag")
        out = out.withColumn("memory", memory_label(lag)).withColumn("n_params", var_param_count(lag, info.getField("k")))
    return out.withColumn(
        "text",
        F.format_string("%s keeps %.1f%% of its own variance (%s); largest source %s.", F.col("row_id"), F.col("own_share"), F.col("role"), F.coalesce("first_source", F.lit("none"))),
    )


def memory_label(lag: Column) -> Column:
    return F.when(lag == 1, "short").when(lag <= 3, "moderate").when(lag > 3, "long")


def interpret_net(net: DataFrame) -> DataFrame:
    """``(series_id, net)``; zero counts as receiver."""
    role = F.when(F.col("net") > 0, "transmitter").otherwise("receiver")
    return net.withColumns({"role": role, "text": F.format_string("%s is a net %s (%.2f%%).", F.col("series_id"), role, F.col("net"))})


def interpret_mgarch(profile: DataFrame) -> DataFrame:
    """Correlation paths: ``(series_id, mean, std_sample, ..)`` with the sample deviation."""
    stability = ladder(F.col("std_sample"), [(0.15, "highly variable"), (0.08, "moderately variable")], "relatively stable")
    level = ladder(F.col("mean"), [(0.6, "high"), (0.3, "moderate")], "low")
    return profile.withColumns(
        {
            "stability": stability,
            "level": level,
            "text": F.format_string("%s: correlation %.3f on average (%s), %s.", F.col("series_id"), F.col("mean"), level, stability),
        }
    )


def interpret_corr_dynamics(profile: DataFrame) -> DataFrame:
    """Same profile with the population deviation and the high/low regime majority."""
    variability = ladder(F.col("std"), [(0.15, "high"), (0.08, "moderate")], "low")
    regime = (
        F.when((F.col("n_high") == 0) & (F.col("n_low") == 0), "none")
        .when(F.col("n_high") > F.col("n_low"), "high correlation")
        .when(F.col("n_low") > F.col("n_high"), "low correlation")
        .otherwise("balanced")
    )
    level = ladder(F.col("mean"), [(0.7, "high"), (0.3, "moderate")], "low")
    return profile.withColumns(
        {
            "variability": variability,
            "regime": regime,
            "level": level,
            "text": F.format_string(
                "%s: mean %.3f, median %.3f, variability %s, regime %s.", F.col("series_id"), F.col("mean"), F.col("median"), variability, regime
            ),
        }
    )


def interpret_portfolio(summary: DataFrame) -> DataFrame:
    """Needs ``diversification_ratio``; extremes add to the text when present."""
    ratio = F.col("diversification_ratio")
    benefit = ladder(ratio, [(1.5, "excellent"), (1.2, "good"), (1.05, "moderate")], "limited")
    advice = ladder(ratio, [(1.3, "keep the allocation"), (1.1, "reduce the largest contributors")], "add uncorrelated assets")
    return summary.withColumns(
        {"benefit": benefit, "advice": advice, "text": F.format_string("Diversification ratio %.3f: %s; %s.", ratio, benefit, advice)}
    )
