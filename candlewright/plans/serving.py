"""What is served from stored tables: the latest run's results, run states, chart series and index snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.scalar import half_up
from candlewright.functions.settings import DEFAULTS, Settings
from candlewright.operators import indicators
from candlewright.sources.tables import window_of

SERIES = {"ema9": "ema9", "ema21": "ema21", "ema50": "ema50", "rsi14": "rsi", "macd_hist": "macd_hist"}


def latest_run(runs: DataFrame) -> DataFrame:
    """run_id of the last run that is done; no row if none is."""
    return runs.filter("status = 'done'").agg(F.max_by("id", "finished_at").alias("run_id")).filter("run_id is not null")


def latest_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the last run that is done, best score first."""
    return results.join(F.broadcast(latest_run(runs)), "run_id").orderBy(F.desc("score"), "symbol")


def run_status(runs: DataFrame, run_id: str) -> DataFrame:
    """A run's state; unknown counts are 0, an unknown id has no row."""
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("total", "scanned", "passed")}
    return runs.filter(F.col("id") == run_id).withColumns(counts)


def results_of_runs(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results whose run is still there."""
    return results.join(runs, results["run_id"] == runs["id"], "left_semi")


def setup_counts(results: DataFrame) -> DataFrame:
    kinds = {"breakout": "breakout", "pullback": "pullback", "trend_continuation": "continuation"}
    return results.agg(F.count("*").alias("total"), *(F.count_if(F.col("setup_type") == k).alias(v) for k, v in kinds.items()))


def index_snapshot(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """sector, ticker, price, prev_close, change, pct_change at each ticker's last bar; a ticker may serve two sectors."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumns({"prev_close": F.lag("close").over(w), "_k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))})
    change = F.col("close") - F.col("prev_close")
    rows = rows.filter("_k = 1").select(F.col("symbol").alias("ticker"), F.col("close").alias("price"), "prev_close", change.alias("change"), (100 * F.try_divide(change, F.col("prev_close"))).alias("pct_change"))
    return sectors.join(rows, "ticker", "left").select("sector", "ticker", "price", "prev_close", "change", "pct_change")


def chart_rows(bars: DataFrame, as_of: str, settings: Settings = DEFAULTS, days: int | None = None) -> DataFrame:
    """Bars with indicators that warm up on the chart's own days only; bars without a close go afterwards."""
    df = window_of(bars, as_of, days or settings.chart_days)
    df = indicators.ema(df, 9, 21, 50)
    df = indicators.macd(indicators.rsi(df)).dropna(subset=["close"])
    return df.withColumn("time", F.unix_timestamp("ts"))


def chart_series(rows: DataFrame) -> DataFrame:
    """symbol, series, time, value: long form, without nulls."""
    rows = rows.select("symbol", "time", *(half_up(c, 4).alias(n) for c, n in SERIES.items()))
    return rows.unpivot(["symbol", "time"], list(SERIES.values()), "series", "value").dropna(subset=["value"])


def chart_payload(rows: DataFrame) -> DataFrame:
    """One row per symbol: candles and the five series as arrays in order of time."""
    fields = [half_up(c, 4).alias(c) for c in ("open", "high", "low", "close")]
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()
    candle = F.when(whole, F.struct("time", *fields, F.coalesce(half_up("volume", 4), F.lit(0.0)).alias("volume")))
    points = [F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("time", half_up(c, 4).alias("value"))))).alias(n) for c, n in SERIES.items()]
    return rows.groupBy("symbol").agg(F.sort_array(F.collect_list(candle)).alias("candles"), *points)
