"""Scans of landed vendor files, bar resampling, calendars and shape conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.operators.blocks import DAY, DEFAULT_WIDTH, block_id

BARS_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close")]
    + [T.StructField("volume", T.LongType())]
)
PRICE_FIELDS = ("open", "high", "low", "close", "adj_close")
# Column titles in vendor files -> bar fields.
FIELD_TITLES = {
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
}
INTERVALS = {"1d": "day", "1wk": "week", "1mo": "month"}


def in_range(start: str | None, end: str | None, ts: str = "ts") -> Column:
    """Half-open range test ``[start, end)``; a missing bound is open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        cond = cond & (F.col(ts) < F.lit(end).cast("timestamp"))
    return cond


def read_bars(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    symbols: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Scan OHLCV files. Symbol and date filters reach the scan (and prune ``symbol=`` folders)."""
    reader = spark.read.schema(BARS_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true")
    bars = reader.format(fmt).load(path).filter(in_range(start, end))
    return bars.filter(F.col("symbol").isin(list(symbols))) if symbols is not None else bars


def select_close(bars: DataFrame, field: str = "close") -> DataFrame:
    """Pick the one bar field that becomes the panel value."""
    if field not in PRICE_FIELDS:
        raise ValueError(f"field must be one of {PRICE_FIELDS}")
    return bars.select(F.col("symbol").alias("series_id"), "ts", F.col(field).alias("value"))


def read_close_panel(
    spark: SparkSession,
    path: str,
    symbols: Sequence[str],
    fmt: str = "parquet",
    start: str | None = None,
    end: str | None = None,
    width: int = DEFAULT_WIDTH,
) -> tuple[DataFrame, DataFrame]:
    """Close prices aligned on the union of dates, and one status row per requested symbol."""
    from panelflow.operators.fill import align_outer

    closes = select_close(read_bars(spark, path, fmt, symbols, start, end))
    wanted = spark.createDataFrame([(s,) for s in symbols], "series_id string")
    found = closes.groupBy("series_id").agg(F.count("value").alias("rows"))
    status = wanted.join(found, "series_id", "left").select(
        "series_id",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("rows").isNull(), "missing").otherwise("ok").alias("status"),
    )
    return align_outer(closes, width), status


def resample_bars(
    ticks: DataFrame,
    every: str = "1d",
    series: str = "series_id",
    ts: str = "ts",
    tie: str | None = None,
    price: str = "value",
    volume: str | None = None,
) -> DataFrame:
    """OHLCV bars from ticks in one partial/final aggregation. ``tie`` orders ticks of equal time."""
    unit = INTERVALS[every]
    order = F.struct(*[c for c in (ts, tie) if c])
    return ticks.groupBy(F.col(series).alias("symbol"), F.date_trunc(unit, ts).alias("bar_ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.max_by(price, order).alias("adj_close"),
        (F.sum(volume) if volume else F.count(price)).cast("long").alias("volume"),
    ).withColumnRenamed("bar_ts", "ts")


def calendar_spine(spark: SparkSession, start: str, end: str, freq: str = "B") -> DataFrame:
    """Daily (``D``) or business-day (``B``) calendar, both ends included.

    Years are generated first and spread, then each task expands its own years into days.
    """
    if freq not in ("B", "D"):
        raise ValueError("freq must be 'B' or 'D'")
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    years = spark.range(1).select(F.explode(F.sequence(F.year(first), F.year(last))).alias("y"))
    lo = F.greatest(first, F.make_date("y", F.lit(1), F.lit(1)))
    hi = F.least(last, F.make_date("y", F.lit(12), F.lit(31)))
    days = years.select(F.explode(F.sequence(lo, hi)).alias("d"))
    if freq == "B":
        days = days.filter(F.weekday("d") < 5)
    return days.select(F.col("d").cast("timestamp").alias("ts"))


STEPS = {"hour": 3600, "day": DAY, "week": 7 * DAY}


def expand_range(ranges: DataFrame, step: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``lo`` and every ``step`` after it up to ``hi`` of each ``series_id`` row, built block by block.

    Steps are ``hour``, ``day``, ``week``, ``month`` (the same day of each month, or its last day) and
    ``bday`` (the days of ``day`` that are not on a weekend). A long range is first cut into blocks,
    which are spread over tasks, so no single task or row holds the whole calendar of a series.
    """
    rough = STEPS.get(step, 31 * DAY if step == "month" else DAY)
    width = max(width // rough, 1) * rough
    blocks = ranges.withColumn("blk", F.explode(F.sequence(block_id(width, "lo"), block_id(width, "hi"))))
    blocks = blocks.repartition("series_id", "blk")
    start, stop = F.timestamp_seconds(F.col("blk") * width), F.timestamp_seconds((F.col("blk") + 1) * width)
    if step == "month":
        first, last = F.floor(F.months_between(start, "lo")) - 1, F.ceil(F.months_between(stop, "lo")) + 1
        at = F.expr("lo + make_interval(0, cast(k as int))")
    else:
        seconds = STEPS["day" if step == "bday" else step]
        since = lambda t: (F.unix_micros(t) - F.unix_micros("lo")) / F.lit(seconds * 1_000_000)
        first, last = F.ceil(since(start)), F.ceil(since(stop))
        at = F.timestamp_micros(F.unix_micros("lo") + F.col("k") * F.lit(seconds * 1_000_000))
    cells = blocks.withColumn("k", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0))))).withColumn("ts", at)
    cells = cells.filter((F.col("ts") >= start) & (F.col("ts") < stop) & (F.col("ts") <= F.col("hi")))
    return (cells.filter(F.weekday("ts") < 5) if step == "bday" else cells).select("series_id", "ts")


def nested_bars(bars: DataFrame) -> DataFrame:
    """One row per date: map symbol -> bar struct. Symbols without any price that day are left out.

    The map holds one entry per symbol of the date, so use it at the output edge.
    """
    fields = [*PRICE_FIELDS, "volume"]
    has_any = F.greatest(*[F.col(f).isNotNull().cast("int") for f in fields]) == 1
    entry = F.struct(F.col("symbol"), F.struct(*fields).alias("bar"))
    return (
        bars.filter(has_any).groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("bars"))
    )


def unnest_bars(nested: DataFrame) -> DataFrame:
    return nested.select("ts", F.explode("bars").alias("symbol", "bar")).select("symbol", "ts", "bar.*")


def flatten_bars(wide: DataFrame, time_col: str = "ts") -> DataFrame:
    """Columns named ``{symbol}_{Field}`` -> one row per symbol and date."""
    rows = []
    symbols: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        symbol, _, title = c.rpartition("_")
        if symbol and title in FIELD_TITLES:
            symbols.setdefault(symbol, {})[FIELD_TITLES[title]] = c
    for symbol, have in symbols.items():
        cols = [
            (F.col(f"`{have[f]}`") if f in have else F.lit(None)).cast("long" if f == "volume" else "double").alias(f)
            for f in (*PRICE_FIELDS, "volume")
        ]
        rows.append(F.struct(F.lit(symbol).alias("symbol"), *cols))
    long = wide.select(F.col(time_col).alias("ts"), F.explode(F.array(*rows)).alias("b"))
    any_value = F.greatest(*[F.col(f"b.{f}").isNotNull().cast("int") for f in (*PRICE_FIELDS, "volume")]) == 1
    return long.filter(any_value).select("b.symbol", "ts", *[f"b.{f}" for f in (*PRICE_FIELDS, "volume")])


def widen_bars(bars: DataFrame, symbols: Sequence[str], fields: Sequence[str] = ("close",)) -> DataFrame:
    """Long bars -> one column per ``{symbol}_{Field}``, for the given symbols, one aggregation."""
    titles = {v: k for k, v in FIELD_TITLES.items()}
    cols = [
        F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{s}_{titles[f]}") for s in symbols for f in fields
    ]
    return bars.filter(F.col("symbol").isin(list(symbols))).groupBy("ts").agg(*cols)
