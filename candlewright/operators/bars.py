"""Bars: cleaning, resampling from ticks or finer bars, and wide frames to rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.functions.blocks import unit_of
from candlewright.functions.scalar import PRICES, nan_as_null

FIELDS = (*PRICES, "volume")
#: Rows that a task takes where bars are dealt out for windows by symbol, and where ticks are dealt out to be made bars.
TASK_ROWS, TASK_TICKS = 200_000, 1_200_000


def clean_bars(bars: DataFrame, newest: Column | None = None) -> DataFrame:
    """Doubles without NaN, no bar without any value, and one bar per (symbol, ts).

    Of several it is the one with the greatest `newest` (a batch number, say), then the one greatest by fields. The
    window is by symbol and time, as those of the indicators are, so that cleaning takes no exchange of its own.
    """
    order = [] if newest is None else [newest.alias("_newest")]
    bars = bars.select("symbol", "ts", *(F.col(c).cast("double").alias(c) for c in FIELDS), *order)
    bars = nan_as_null(bars, *FIELDS).dropna("all", subset=list(FIELDS))
    w = Window.partitionBy("symbol").orderBy("ts", *(F.desc(c) for c in [*(["_newest"] if order else []), *reversed(FIELDS)]))
    before = F.lag("ts").over(w)
    return bars.withColumn("_again", F.coalesce(before == F.col("ts"), F.lit(False))).filter("not _again").select("symbol", "ts", *FIELDS)


def ohlcv(price: Column, volume: Column, order: Column) -> list[Column]:
    """Aggregates of one bar; `order` tells which price comes first."""
    return [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume")]


def resample_ticks(ticks: DataFrame, unit: str, order: Sequence[str], parts: int | None = None, within: str | None = None) -> DataFrame:
    """Bars of symbol, ts, price, volume ticks per `unit` (day, week, month).

    Partial sums are made before the shuffle, for which a task sorts all that it has read. With `parts`, ticks are dealt
    out by symbol and bar over so many tasks before anything is sorted, so that a task's memory goes by its share of
    ticks and not by the split that it reads: for many ticks, of which a bar has few. `within` is a unit of time whose
    bars are to be numbered together (`Blocks.unit`): ticks are dealt out by that, and bars keep it in _u, so that they
    are in place for it.
    """
    bar, aggregates = F.date_trunc(unit, "ts").cast("timestamp"), ohlcv(F.col("price"), F.col("volume"), F.struct(*order))
    if within:
        rows = ticks.repartition(parts, unit_of(within, bar)) if parts else ticks
        bars = rows.groupBy(unit_of(within, bar).alias("_u"), bar.alias("_ts")).agg(*aggregates)
        return bars.withColumn("symbol", F.col("_u.symbol")).withColumnRenamed("_ts", "ts")
    ticks = ticks.withColumn("_ts", bar)
    rows = (ticks.repartition(parts, "symbol", "_ts") if parts else ticks).groupBy("symbol", "_ts")
    return rows.agg(*aggregates).withColumnRenamed("_ts", "ts")


def parts_of(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """Tasks for so many rows: one per core at least, and none with many more than `each` (TASK_ROWS)."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / (each or TASK_ROWS)))


def dealt(bars: DataFrame, rows: int) -> DataFrame:
    """Bars by symbol in tasks of bounded size; `rows` is their number or more. Windows by symbol take no further exchange.

    Windows hold and widen a task's rows many times over, so that a task by the size of
    its shuffled bars alone would need many times its memory.
    """
    return bars.repartition(parts_of(bars.sparkSession, rows), "symbol")


def resample_bars(bars: DataFrame, unit: str) -> DataFrame:
    """Coarser bars from finer ones."""
    bucket = F.date_trunc(unit, "ts").cast("timestamp").alias("ts")
    agg = [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")]
    return bars.groupBy("symbol", bucket).agg(*agg)


def wide_to_long(wide: DataFrame, separator: str = "|", ts_col: str = "ts") -> DataFrame:
    """Columns named ticker|Field become rows of symbol, ts and the five fields; rows without any value go."""
    names = [c for c in wide.columns if c != ts_col]
    rows = wide.unpivot(ts_col, names, "name", "value")
    part = F.split("name", F.lit(f"\\Q{separator}\\E"))
    rows = rows.select(F.col(ts_col).alias("ts"), part[0].alias("symbol"), F.lower(part[1]).alias("field"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("symbol", "ts").pivot("field", list(FIELDS)).agg(F.first("value", ignorenulls=True)).dropna("all", subset=list(FIELDS))


def last_bars(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return bars.withColumn("_k", newest).filter("_k = 1").drop("_k")
