"""Full-history expectancy: every bar in a trend with a setup is a trade, held for some bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.scalar import half_up
from candlewright.functions.settings import DEFAULTS, Settings
from candlewright.functions.windows import by_symbol
from candlewright.operators import indicators, setups


def trades(bars: DataFrame, settings: Settings = DEFAULTS, long: bool = False) -> DataFrame:
    """symbol, date, setup_type, entry, exit, return_pct, win of each trade; trades may overlap.

    Indicators look back only, so that one pass gives every prefix's values. Symbols need the warm-up, the holding time
    and ten bars more; entries start after the warm-up.
    """
    hold, everything = settings.hold, Window.partitionBy("symbol")
    df = setups.verdicts(indicators.bundle(bars, long))
    df = df.withColumns({"_n": F.row_number().over(by_symbol()), "_all": F.count("*").over(everything), "exit": F.lead("close", hold).over(by_symbol())})
    eligible = (F.col("_all") >= settings.min_bars + hold + 10) & (F.col("_n") > settings.min_bars) & (F.col("_n") + hold <= F.col("_all"))
    df = df.filter(eligible & F.col("trend_ok") & F.col("setup_type").isNotNull())
    gain = F.try_divide("exit", "close") - 1
    rows = df.select("symbol", F.col("ts").alias("date"), "setup_type", F.col("close").alias("entry"), "exit", half_up(100 * gain, 2).alias("return_pct"), (gain > 0).alias("win"))
    return rows.filter("return_pct is not null")


def expectancy(traded: DataFrame) -> DataFrame:
    """setup_type (null: all), count, win_rate, avg_win_pct, avg_loss_pct, expectancy_pct; all trades even if none."""
    wins, losses = F.avg(F.when(F.col("win"), F.col("return_pct"))), F.avg(F.when(~F.col("win"), F.col("return_pct")))
    rows = traded.select("setup_type", "return_pct", "win", F.lit(1).alias("n"))
    # a row that counts nothing keeps the total where there is no trade
    rows = rows.unionByName(traded.sparkSession.range(1).select(F.lit(0).alias("n")), allowMissingColumns=True)
    figures = [F.sum("n").alias("count"), F.avg(F.col("win").cast("double")).alias("w"), wins.alias("a"), losses.alias("b")]
    rows = rows.groupingSets([["setup_type"], []], "setup_type").agg(*figures, F.grouping_id().alias("_g")).filter("_g = 1 or count > 0")
    zero = F.lit(0.0)
    w, a, b = (F.coalesce(c, zero) for c in ("w", "a", "b"))
    return rows.select("setup_type", "count", half_up(w, 3).alias("win_rate"), half_up(a, 2).alias("avg_win_pct"), half_up(b, 2).alias("avg_loss_pct"), half_up(a * w + b * (1 - w), 2).alias("expectancy_pct"))


def expectancy_map(rows: DataFrame) -> DataFrame:
    """One row: the totals, and by_setup as a map from setup to its figures."""
    figures = F.struct("count", "win_rate", "expectancy_pct")
    by = F.map_from_entries(F.collect_list(F.when(F.col("setup_type").isNotNull(), F.struct("setup_type", figures))))
    total = F.first(F.when(F.col("setup_type").isNull(), F.struct("count", "win_rate", "avg_win_pct", "avg_loss_pct", "expectancy_pct")), ignorenulls=True)
    one = rows.agg(total.alias("t"), by.alias("by_setup"))
    return one.select("t.*", "by_setup", F.when(F.col("t.count") == 0, "no trades").alias("error"))
