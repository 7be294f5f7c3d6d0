"""List-of-records form and schema inference for wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_NAMES = ("date", "time", "datetime")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def time_column(df: DataFrame) -> str:
    """First column whose lower-cased name is date, time or datetime."""
    for c in df.columns:
        if c.lower() in TIME_NAMES:
            return c
    raise ValueError(f"no time column in {df.columns}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in numeric_columns(df)])


def target_column(df: DataFrame, prefer: str = "price") -> str:
    """``prefer`` when present, else the first numeric column."""
    if prefer in df.columns:
        return prefer
    numeric = numeric_columns(df)
    if not numeric:
        raise ValueError("no numeric column")
    return numeric[0]


def pick_target(df: DataFrame, prefer: str = "price") -> DataFrame:
    """Time column and target column as ``ts``, ``value``; bad numbers raise at run time."""
    name = target_column(df, prefer)
    return coerce_numeric(
        df.select(F.to_timestamp(F.col(f"`{time_column(df)}`")).alias("ts"), F.col(f"`{name}`").alias("value")), "value", strict=True
    ).drop("is_bad")


def coerce_numeric(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """Cast to double and flag rows that had text which is not a number; ``strict`` raises on them."""
    number = F.col(col).try_cast("double")
    bad = F.col(col).isNotNull() & number.isNull()
    if strict:
        number = F.when(bad, F.raise_error(F.concat(F.lit(f"{col} is not numeric: "), F.col(col).cast("string")))).otherwise(
            number
        )
    return df.withColumn("is_bad", bad).withColumn(col, number)


def infer_panel(df: DataFrame) -> DataFrame:
    """Wide table -> panel: find the time column, keep numeric columns, melt to long form."""
    when = time_column(df)
    values = [c for c in numeric_columns(df) if c != when]
    wide = df.select(F.to_timestamp(F.col(f"`{when}`")).alias("ts"), *[F.col(f"`{c}`").cast("double") for c in values])
    return wide.unpivot("ts", values, "series_id", "value").select("series_id", "ts", "value")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of records with a ``date`` text field -> rows with a timestamp ``ts``."""
    rows = spark.read.schema(schema).json(path)
    return parse_dates(rows)


def parse_records(df: DataFrame, schema: str, col: str = "record") -> DataFrame:
    """Same as ``read_records`` for JSON text already in a column."""
    return parse_dates(df.select(F.from_json(col, schema).alias("r")).select("r.*"))


def parse_dates(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_timestamp("date", "yyyy-MM-dd").alias("ts"), *[c for c in rows.columns if c != "date"])


def to_records(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows -> one JSON object per row, time first as ``date`` in YYYY-MM-DD."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != ts]
    return df.select(F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd").alias("date"), *rest)).alias("record"))


def map_points(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Route columns to typed point fields by name.

    Of several columns for one field the last that holds a number in a row wins; text that is no number
    counts as null.
    """
    found: dict[str, list[str]] = {}
    for c in df.columns:
        low = c.lower()
        if c == date_col:
            continue
        if low in ("open", "high", "low", "close", "volume"):
            found.setdefault(low, []).append(c)
        elif "return" in low:
            found.setdefault("returns", []).append(c)
        elif "scaled" in low:
            found.setdefault("scaled", []).append(c)
    fields = ("open", "high", "low", "close", "volume", "returns", "scaled")

    def field(name: str):
        kind = "long" if name == "volume" else "double"
        numbers = [n for c in reversed(found.get(name, [])) for n in (F.col(f"`{c}`").try_cast(kind), F.col(f"`{c}`").try_cast("double").try_cast(kind))]
        return F.coalesce(*numbers, F.lit(None).cast(kind)).alias(name)

    return df.select(F.col(f"`{date_col}`").alias("date"), *[field(f) for f in fields])
