"""The first version's rules: a valuation gate, four signals, and a score from their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.ranges import with_places
from candlewright.functions.windows import by_symbol
from candlewright.operators.setups import continuation


def sector_median(fundamentals: DataFrame) -> DataFrame:
    """sector, sector_pe_median over known ratios; null where a sector has none.

    Distinct ratios are counted and dealt out by their size, and the one or two in the middle are picked by their places,
    so that a sector of any size is never in one task or in one aggregate's memory.
    """
    known = fundamentals.filter("pe_ratio is not null")
    counts = with_places(known.groupBy("sector", "pe_ratio").agg(F.count("*").alias("n")), "pe_ratio", "sector")
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("n") <= place)
    middle = counts.filter(holds(low) | holds(high)).groupBy("sector").agg(((F.min("pe_ratio") + F.max("pe_ratio")) / 2).alias("_m"))
    middle = middle.withColumnRenamed("sector", "_of")
    sectors = fundamentals.select("sector").distinct()
    return sectors.join(middle, F.col("sector").eqNullSafe(F.col("_of")), "left").select("sector", F.col("_m").alias("sector_pe_median"))


def fundamental_gate(fundamentals: DataFrame, default: float = 30.0, growth: float = 0.10) -> DataFrame:
    """Rows whose ratio is at most the sector's median and whose revenue grows by more than `growth`; nulls fail."""
    rows = fundamentals.join(sector_median(fundamentals), "sector", "left")
    return rows.filter((F.col("pe_ratio") <= F.coalesce("sector_pe_median", F.lit(default))) & (F.col("revenue_growth") > growth))


def signals(df: DataFrame) -> DataFrame:
    """v1_cross, v1_rsi, v1_macd, v1_breakout, v1_signals, v1_ok, v1_score beside the indicator bundle."""
    w = by_symbol()
    df = continuation(df, bars=3, momentum=False).withColumnRenamed("continuation", "v1_cross").drop("continuation_pivot")
    in_band = F.max(F.col("rsi14").between(40, 50).cast("int")).over(w.rowsBetween(-2, 0)) == 1
    flip = (F.lag("macd_hist").over(w) <= 0) & (F.col("macd_hist") > 0)
    df = df.withColumn("_flip", F.coalesce(flip, F.lit(False)).cast("int"))
    broke = F.lit(False)
    for n in range(20, 41, 5):
        before = w.rowsBetween(-n, -1)
        high, low, rows = F.max("high").over(before), F.min("low").over(before), F.count("*").over(before)
        broke = broke | F.coalesce((rows == n) & (F.try_divide(high - low, low) < 0.20) & (F.col("close") > high), F.lit(False))
    no = F.lit(False)
    df = df.withColumns({
        "v1_rsi": F.coalesce(in_band & (F.col("rsi14") > F.lag("rsi14").over(w)), no),
        "v1_macd": F.max("_flip").over(w.rowsBetween(-1, 0)) == 1,
        "v1_breakout": F.coalesce(broke & (F.col("volume") > 1.5 * F.col("vol_avg20")), no),
    }).drop("_flip")
    df = df.withColumn("v1_signals", sum((F.col(c).cast("int") for c in ("v1_cross", "v1_rsi", "v1_macd", "v1_breakout")), F.lit(0)))
    ok = F.coalesce(F.col("close") > F.col("ema50"), no) & (F.col("v1_signals") >= 2)
    return df.withColumns({"v1_ok": ok, "v1_score": F.when(ok, F.col("v1_signals") + 1)})


def promoter(rows: DataFrame, holdings: DataFrame) -> DataFrame:
    """Attach promoter_holding and promoter_trend by symbol; a missing trend is "unknown" and excludes nothing."""
    return rows.join(holdings, "symbol", "left").withColumn("promoter_trend", F.coalesce("promoter_trend", F.lit("unknown")))
