"""Common pieces of the checking SQL (DuckDB dialect)."""

from __future__ import annotations


def r(expr: str, n: int = 6) -> str:
    return f"round({expr}, {n}) + 0.0"


def iso(expr: str = "ts") -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S')"


def cents(col: str) -> str:
    return f"CAST(sum(CAST(round({col} * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100)"


def panel(series: str, unit: str, ts: str, value: str, source: str, name: str = "p") -> str:
    return f"{name} AS (SELECT {series} AS series_id, date_trunc('{unit}', {ts}) AS ts, {cents(value)} AS value FROM {source} GROUP BY 1, 2)"


ORDERS_M = panel("o_orderpriority", "month", "o_orderdate", "o_totalprice", "orders")
ORDERS_D = panel("o_orderpriority", "day", "o_orderdate", "o_totalprice", "orders")
MARKET_M = panel("'all'", "month", "o_orderdate", "o_totalprice", "orders")
STATUS_M = panel("l_linestatus", "month", "l_shipdate", "l_extendedprice", "lineitem")
SUPPLIER_M = panel("CAST(l_suppkey AS VARCHAR)", "month", "l_shipdate", "l_extendedprice", "lineitem")
EVENTS_H = panel("event_type", "hour", "ts", "value", "events")
NATION_M = panel(
    "n_name",
    "month",
    "o_orderdate",
    "o_totalprice",
    "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)

W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"


def cells(src: str = "p", name: str = "c") -> str:
    return (
        f"{name} AS (SELECT s.series_id, d.ts, {src}.value FROM (SELECT DISTINCT series_id FROM {src}) s "
        f"CROSS JOIN (SELECT DISTINCT ts FROM {src}) d LEFT JOIN {src} ON {src}.series_id = s.series_id AND {src}.ts = d.ts)"
    )


def ffill(src: str = "c", name: str = "f") -> str:
    return (
        f"{name} AS (SELECT series_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {src})"
    )


def complete(src: str = "c", name: str = "k") -> str:
    return f"{name} AS (SELECT * FROM {src} WHERE ts NOT IN (SELECT ts FROM {src} WHERE value IS NULL))"


def returns(src: str = "k", name: str = "x") -> str:
    return (
        f"{name} AS (SELECT series_id, ts, value FROM (SELECT series_id, ts, ln(value) - ln(lag(value) OVER w) AS value, "
        f"row_number() OVER w AS rn FROM {src} {W}) WHERE rn > 1)"
    )


def chain(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts)


RET_ORDERS = (ORDERS_M, cells(), complete(), returns())
RET_NATION = (NATION_M, cells(), complete(), returns())
RET_STATUS = (STATUS_M, cells(), complete(), returns())
LEVEL_EVENTS = (EVENTS_H, cells(), ffill(), complete("f", "k"))
RET_EVENTS = (*LEVEL_EVENTS, returns())


def numbered(src: str = "x", name: str = "n", extra: str = "") -> str:
    """Rows with their position in the series."""
    return f"{name} AS (SELECT *, row_number() OVER w AS i{extra} FROM {src} {W})"


# Normal distribution function by its power series; below -8 it is under 1e-15.
def phi(z: str) -> str:
    term = f"exp((2 * j + 1) * ln(abs({z})) - (lgamma(2 * j + 2) - j * ln(2) - lgamma(j + 1)))"
    body = f"list_sum([{term} FOR j IN range(0, 150)])"
    return (
        f"CASE WHEN {z} < -8 THEN 0.0 WHEN {z} > 8 THEN 1.0 WHEN {z} = 0 THEN 0.5 "
        f"ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {body} END"
    )


def label_p(p: str) -> str:
    return (
        f"CASE WHEN {p} < 0.01 THEN 'Significant at 1% level' WHEN {p} < 0.05 THEN 'Significant at 5% level' "
        f"WHEN {p} < 0.1 THEN 'Significant at 10% level' ELSE 'Not significant' END"
    )


def partialled(src: str, regressors: list[str], target: str, name: str) -> list[str]:
    """CTEs that take the mean and then each regressor out of what follows it.

    ``{name}`` has per series ``t`` rows, ``ssr_0 ..`` (squares of the target left after the first regressors), and ``slope``
    and ``sxx`` of the last regressor.
    """
    w = "OVER (PARTITION BY series_id)"
    rest = [*regressors, target]
    out = [f"{name}_0 AS (SELECT series_id, {', '.join(f'{c} - avg({c}) {w} AS {c}' for c in rest)} FROM {src} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in rest)})"]
    ssr = [f"s0 AS (SELECT series_id, count(*) AS t, sum({target} * {target}) AS ssr_0 FROM {name}_0 GROUP BY 1)".replace("s0", f"{name}_s0", 1)]
    for k, x in enumerate(regressors):
        left = rest[k + 1 :]
        cols = ", ".join(f"{c} - {x} * (sum({c} * {x}) {w}) / (sum({x} * {x}) {w}) AS {c}" for c in left)
        last = f", (sum({target} * {x}) {w}) / (sum({x} * {x}) {w}) AS slope, sum({x} * {x}) {w} AS sxx" if k + 1 == len(regressors) else ""
        out.append(f"{name}_{k + 1} AS (SELECT series_id, {cols}{last} FROM {name}_{k})")
        more = ", any_value(slope) AS slope, any_value(sxx) AS sxx" if last else ""
        ssr.append(f"{name}_s{k + 1} AS (SELECT series_id, sum({target} * {target}) AS ssr_{k + 1}{more} FROM {name}_{k + 1} GROUP BY 1)")
    joins = " ".join(f"JOIN {name}_s{k + 1} USING (series_id)" for k in range(len(regressors)))
    return [*out, *ssr, f"{name} AS (SELECT * FROM {name}_s0 {joins})"]
