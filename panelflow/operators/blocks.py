"""Ordered operators that split a long series into time blocks.

A plain ``Window.partitionBy(series_id)`` puts a whole series in one task, so a series holding a
third of the rows stalls the job. Here every ordered operator has the same three steps:

1. rows are hash-partitioned by ``(series_id, blk)``, where ``blk`` is a fixed-width time bucket, and
   the window runs inside a block;
2. each block is reduced to one summary row, and a window over those summaries carries state from
   block to block. Their number per series is bounded by calendar span / block width, not by rows;
3. the carried state is joined back on ``(series_id, blk)``, the partitioning the rows already have.

``width`` (seconds) is the only knob: pick it so that one block of one series fits a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

DAY = 86_400
DEFAULT_WIDTH = 90 * DAY

# Looking forward is done in descending order: frames that end at "unbounded following" are
# re-evaluated from every row, which is quadratic in the block.


def _in_block(back: bool = False) -> WindowSpec:
    return Window.partitionBy("series_id", "blk").orderBy(F.desc("ts") if back else F.asc("ts"))


def _blocks(back: bool = False) -> WindowSpec:
    return Window.partitionBy("series_id").orderBy(F.desc("blk") if back else F.asc("blk"))


def _before() -> WindowSpec:
    return _blocks().rowsBetween(Window.unboundedPreceding, -1)


def _after() -> WindowSpec:
    return _blocks(back=True).rowsBetween(Window.unboundedPreceding, -1)


def _all() -> WindowSpec:
    return Window.partitionBy("series_id")


def block_id(width: int, ts: str = "ts") -> Column:
    """Index of the time bucket a timestamp falls in."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(width * 1_000_000)).cast("long")


def suggest_width(panel: DataFrame, target_rows: int = 1_000_000) -> int:
    """Block width in seconds that keeps every (series, block) near ``target_rows`` rows.

    One aggregation over (series, day) finds the busiest day of any series; the answer is a multiple
    of a day for sparse panels and a fraction of a day for dense ticks.
    """
    per_day = with_block(panel, DAY).groupBy("series_id", "blk").agg(F.count(F.lit(1)).alias("c"))
    busiest = per_day.agg(F.max("c")).first()[0] or 1
    if busiest <= target_rows:
        return DAY * min(max(target_rows // busiest, 1), 3660)
    return max(DAY * target_rows // busiest, 1)


def with_block(panel: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    return panel.withColumn("blk", block_id(width))


def attach(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Join block state back to the rows of the block."""
    return rows.join(carry, ["series_id", "blk"], "left")


def attach_series(panel: DataFrame, per_series: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Join one-row-per-series columns to the rows without shuffling the rows by series alone.

    The per-series table is first spread over the blocks each series has, so the large join runs on
    ``(series_id, blk)`` and a hot series stays split over many tasks.
    """
    rows = with_block(panel, width)
    spread = rows.select("series_id", "blk").distinct().join(per_series, "series_id")
    return rows.join(spread, ["series_id", "blk"]).drop("blk")


def lagged(panel: DataFrame, lags: Sequence[int], width: int = DEFAULT_WIDTH, col: str = "value") -> DataFrame:
    """Add ``lag_k`` for every k, the 1-based row position ``pos``, the series length ``n`` and its ``mean``.

    Lags go by row position, as in ``lag(value, k) over (partition by series_id order by ts)``.
    """
    depth = max(lags, default=0)
    rows = with_block(panel, width).withColumn("_rn", F.row_number().over(_in_block()))
    local = rows
    for k in lags:
        local = local.withColumn(f"_in_{k}", F.lag(col, k).over(_in_block()))
    summary_aggs = [F.count(F.lit(1)).alias("_cnt"), F.count(col).alias("_c"), F.sum(col).alias("_s")]
    marked = rows
    if depth:
        marked = rows.withColumn("_tail", F.lead("ts", depth).over(_in_block()).isNull())
        tail = F.collect_list(F.when(F.col("_tail"), F.struct("ts", F.col(col).alias("v"))))
        summary_aggs.append(F.sort_array(tail).alias("_tails"))
    summary = marked.groupBy("series_id", "blk").agg(*summary_aggs)
    carried = [
        F.coalesce(F.sum("_cnt").over(_before()), F.lit(0)).alias("_before"),
        F.sum("_cnt").over(_all()).alias("n"),
        F.try_divide(F.sum("_s").over(_all()), F.sum("_c").over(_all())).alias("mean"),
    ]
    if depth:
        past = F.flatten(F.collect_list("_tails").over(_blocks().rowsBetween(-depth, -1)))
        carried.append(past.alias("_past"))
    carry = summary.select("series_id", "blk", *carried)
    joined = attach(local, carry)
    lag_cols = [
        F.when(F.col("_rn") > k, F.col(f"_in_{k}"))
        .otherwise(F.try_element_at(F.col("_past"), (F.col("_rn") - F.lit(k + 1)).cast("int"))["v"])
        .alias(f"lag_{k}")
        for k in lags
    ]
    return joined.select(*panel.columns, (F.col("_before") + F.col("_rn")).alias("pos"), "n", "mean", *lag_cols)


def leading(panel: DataFrame, leads: Sequence[int], width: int = DEFAULT_WIDTH, col: str = "value") -> DataFrame:
    """Add ``lead_k`` for every k >= 1: the value k rows later in the series, null beyond its end.

    The first rows of the blocks after a block are carried to it, as ``lagged`` carries the last rows of those before.
    """
    depth = max(leads)
    rows = with_block(panel, width).withColumn("_rn", F.row_number().over(_in_block()))
    local = rows
    for k in leads:
        local = local.withColumn(f"_in_{k}", F.lead(col, k).over(_in_block()))
    head = F.collect_list(F.when(F.col("_rn") <= depth, F.struct("_rn", F.col(col).alias("v"))))
    summary = rows.groupBy("series_id", "blk").agg(F.count(F.lit(1)).alias("_cnt"), F.sort_array(head).alias("_heads"))
    future = F.flatten(F.collect_list("_heads").over(_blocks().rowsBetween(1, depth)))
    joined = attach(local, summary.select("series_id", "blk", "_cnt", future.alias("_future")))
    beyond = lambda k: (F.col("_rn") + F.lit(k) - F.col("_cnt")).cast("int")
    columns = [F.when(beyond(k) <= 0, F.col(f"_in_{k}")).otherwise(F.try_element_at(F.col("_future"), F.greatest(beyond(k), F.lit(1)))["v"]).alias(f"lead_{k}") for k in leads]
    return joined.select(*panel.columns, *columns)


def neighbours(panel: DataFrame, width: int = DEFAULT_WIDTH, col: str = "value") -> DataFrame:
    """Add the nearest non-null value at or before each row (``prev``, ``prev_pos``) and at or after
    it (``next``, ``next_pos``), plus the row position ``pos``."""
    rows = with_block(panel, width).withColumn("_rn", F.row_number().over(_in_block()))
    known = F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"), F.col("_rn").cast("long").alias("at")))
    local = rows.withColumn(
        "_p", F.last(known, ignorenulls=True).over(_in_block().rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_q", F.last(known, ignorenulls=True).over(_in_block(back=True).rowsBetween(Window.unboundedPreceding, 0)))
    when_known = F.when(F.col(col).isNotNull(), F.col("_rn"))
    summary = (
        rows.groupBy("series_id", "blk")
        .agg(
            F.count(F.lit(1)).alias("_cnt"),
            F.min_by(known, when_known).alias("_first"),
            F.max_by(known, when_known).alias("_last"),
        )
        .withColumn("_before", F.coalesce(F.sum("_cnt").over(_before()), F.lit(0)))
    )

    def shifted(name: str) -> Column:
        s = F.col(name)
        return F.when(s.isNotNull(), F.struct(s["v"].alias("v"), (s["at"] + F.col("_before")).alias("at")))

    carry = summary.select(
        "series_id",
        "blk",
        "_before",
        F.last(shifted("_last"), ignorenulls=True).over(_before()).alias("_cp"),
        F.last(shifted("_first"), ignorenulls=True).over(_after()).alias("_cq"),
    )
    joined = attach(local, carry)

    def pick(inside: str, outside: str, value: str, position: str) -> list[Column]:
        here, there = F.col(inside), F.col(outside)
        return [
            F.coalesce(here["v"], there["v"]).alias(value),
            F.coalesce(here["at"] + F.col("_before"), there["at"]).alias(position),
        ]

    return joined.select(
        *panel.columns,
        (F.col("_before") + F.col("_rn")).alias("pos"),
        *pick("_p", "_cp", "prev", "prev_pos"),
        *pick("_q", "_cq", "next", "next_pos"),
    )


def running_sum(
    panel: DataFrame, width: int = DEFAULT_WIDTH, col: str = "value", out: str = "running", reset_first: bool = False
) -> DataFrame:
    """Cumulative sum per series. ``reset_first`` treats the first row of each series as zero."""
    rows = with_block(panel, width)
    inside = F.sum(col).over(_in_block().rowsBetween(Window.unboundedPreceding, 0))
    summary = rows.groupBy("series_id", "blk").agg(F.sum(col).alias("_s"), F.min_by(col, "ts").alias("_f"))
    carry = summary.select(
        "series_id",
        "blk",
        F.coalesce(F.sum("_s").over(_before()), F.lit(0.0)).alias("_before"),
        F.min_by("_f", "blk").over(_all()).alias("_first"),
    )
    total = F.col("_inside") + F.col("_before")
    if reset_first:
        total = total - F.col("_first")
    return attach(rows.withColumn("_inside", inside), carry).select(*panel.columns, total.alias(out))


def rolling(panel: DataFrame, window: int, width: int = DEFAULT_WIDTH, col: str = "value") -> DataFrame:
    """Rolling mean and sample deviation over exactly ``window`` rows (null until the window is full).

    Positions are cut into segments of ``window`` rows. A window is then the end of one segment and the beginning of
    the next, so running moments from both ends of every segment give it by one merge: no sum is taken away from
    another, and the cost does not depend on the window. Position blocks of whole segments get the last
    ``window - 1`` rows of the block before as a halo, so no task holds a whole series.
    """
    size = window * max(1, -(-4096 // window))
    halo = halo_blocks(lagged(panel, [], width, col), size, window - 1).repartition("series_id", "pblk")
    segment = halo.withColumn("_seg", F.floor((F.col("pos") - 1) / window))
    inside = Window.partitionBy("series_id", "pblk", "_seg")

    def moments(back: bool) -> Column:
        w = inside.orderBy(F.desc("pos") if back else F.asc("pos")).rowsBetween(Window.unboundedPreceding, 0)
        return F.struct(F.count(col).over(w).alias("n"), F.avg(col).over(w).alias("m"), F.var_pop(col).over(w).alias("v"))

    rows = segment.withColumn("_head", moments(False))
    # The window starts in the segment before, unless it is the whole own segment.
    whole = F.col("pos") % window == 0
    if window > 1:
        start = F.lag("_tail", window - 1).over(Window.partitionBy("series_id", "pblk").orderBy("pos"))
        rows = rows.withColumn("_tail", moments(True)).withColumn("_from", F.when(~whole, start))
        a, b = F.col("_head"), F.col("_from")
        count = a["n"] + F.when(whole, 0).otherwise(b["n"])
        mean = F.when(whole, a["m"]).otherwise((a["n"] * a["m"] + b["n"] * b["m"]) / window)
        apart = a["m"] - b["m"]
        squares = F.when(whole, a["n"] * a["v"]).otherwise(a["n"] * a["v"] + b["n"] * b["v"] + apart * apart * a["n"] * b["n"] / window)
        std = F.sqrt(squares / (window - 1))
    else:
        count, mean, std = F.col("_head.n"), F.col("_head.m"), F.lit(None).cast("double")
    full = (F.col("pos") >= window) & (count == window)
    return (
        rows.withColumn("rolling_mean", F.when(full, mean))
        .withColumn("rolling_std", F.when(full, std))
        .filter(~F.col("is_halo"))
        .select(*panel.columns, "pos", "rolling_mean", "rolling_std")
    )


def halo_blocks(rows: DataFrame, size: int, halo: int) -> DataFrame:
    """Assign rows to position blocks ``pblk`` and copy the last ``halo`` rows of each block to the next.

    Needs ``pos`` (1-based, dense) and ``halo <= size``; copies carry ``is_halo = true``.
    """
    if halo > size:
        raise ValueError("halo must not exceed the block size")
    home = F.floor((F.col("pos") - 1) / size).cast("long")
    near_end = ((F.col("pos") - 1) % size) >= size - halo
    targets = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return rows.withColumn("_home", home).withColumn("pblk", F.explode(targets)).select(
        *rows.columns, "pblk", (F.col("pblk") != F.col("_home")).alias("is_halo")
    )
