"""Streaming: bars from a tick stream, and the scan run again as new bars arrive."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candlewright.functions.blocks import Blocks
from candlewright.functions.settings import DEFAULTS, Settings
from candlewright.operators.bars import clean_bars, ohlcv
from candlewright.plans.scan import Counts, found
from candlewright.sources.tables import BARS, window_of, write_results, write_run_event

#: A calendar bar on its way: the first and the last tick (micros and price), high, low, volume.
STATE = "first_at long, first double, last_at long, last double, high double, low double, volume double"
#: Stands for the time at which an event is written.
NOW = object()


def stream_bars(ticks: DataFrame, width: str = "1 day", delay: str = "1 hour", start: str | None = None) -> DataFrame:
    """Bars of a stream of symbol, ts, price, volume; a bar is out once the watermark passes it, later ticks drop.

    `start` moves the bars' limits: widths of whole weeks begin on a Thursday, and "4 days" later on a Monday.
    """
    span = F.window("ts", width, startTime=start)
    rows = ticks.withWatermark("ts", delay).groupBy(span, "symbol").agg(*ohlcv(F.col("price"), F.col("volume"), F.struct("ts", "price")))
    return rows.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_calendar_bars(ticks: DataFrame, unit: str = "month", delay: str = "1 hour") -> DataFrame:
    """Bars of a stream by calendar unit (week, month, quarter, year), which has no fixed width.

    A symbol's bar is a state of seven numbers with a timer at the end of its unit; it is out once the watermark passes
    that, and goes. Ticks behind the watermark drop.
    """
    known = F.col("price").isNotNull() & F.col("ts").isNotNull()
    rows = ticks.withWatermark("ts", delay).filter(known)
    begin = F.date_trunc(unit, "ts")
    ends = F.date_trunc(unit, begin + F.expr({"week": "INTERVAL 10 DAYS", "month": "INTERVAL 40 DAYS", "quarter": "INTERVAL 100 DAYS", "year": "INTERVAL 380 DAYS"}[unit]))
    rows = rows.select("symbol", begin.alias("begin"), F.unix_millis(ends.cast("timestamp")).alias("until"), "ts", F.unix_micros("ts").alias("at"), "price", F.coalesce("volume", F.lit(0.0)).alias("volume"))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol, begin, until = key
        if state.hasTimedOut:
            _, first, _, last, high, low, volume = state.get
            state.remove()
            yield pd.DataFrame({"symbol": [symbol], "ts": [begin], "open": [first], "high": [high], "low": [low], "close": [last], "volume": [volume]})
            return
        own = state.get if state.exists else None
        for part in parts:
            ordered = part.sort_values(["at", "price"])
            one, two = ordered.iloc[0], ordered.iloc[-1]
            new = (int(one["at"]), float(one["price"]), int(two["at"]), float(two["price"]), float(part["price"].max()), float(part["price"].min()), float(part["volume"].sum()))
            if own is not None:
                new = (*min(own[:2], new[:2]), *max(own[2:4], new[2:4]), max(own[4], new[4]), min(own[5], new[5]), own[6] + new[6])
            own = new
        if own is not None and until > state.getCurrentWatermarkMs():
            state.update(own)
            state.setTimeoutTimestamp(int(until))

    return rows.groupBy("symbol", "begin", "until").applyInPandasWithState(update, BARS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def store_batch(batch: DataFrame, stored: str, number: int) -> dt.date | None:
    """Write a batch's bars by day under its own name and return the last day, found while writing; None without bars."""
    seen = Observation()
    rows = batch.observe(seen, F.max("ts").cast("date").alias("last")).withColumn("day", F.col("ts").cast("date"))
    # a day's bars go to one file, or to several where there are many
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{stored}/batch={number}")
    return seen.get["last"]


def stored_history(spark: SparkSession, stored: str, last: dt.date, days: int) -> DataFrame:
    """Clean bars of the `days` before the end of day `last`, of each (symbol, ts) the newest batch's. Dates are pruned
    before cleaning, so that other days' files are not read."""
    rows = spark.read.schema(f"{BARS}, batch long, day date").parquet(stored)
    rows = rows.filter(F.col("day").between(last - dt.timedelta(days), last))
    return clean_bars(window_of(rows, f"{last} 23:59:59", days), F.col("batch"))


def incremental_scan(
    spark: SparkSession,
    arriving: str,
    stored: str,
    results: str,
    checkpoint: str,
    constituents: DataFrame,
    settings: Settings = DEFAULTS,
    run: Callable[[str], str] = lambda day: f"scan-{day}",
    benchmark: bool | DataFrame = True,
    earnings: DataFrame | None = None,
    events: str | None = None,
    files: int | None = None,
    long: bool | Blocks = False,
) -> StreamingQuery:
    """Take bar files that arrived, store them, and scan as of their last day; the nightly job as an incremental batch.

    Each batch writes its bars and its results under names made from the batch and its day, so that a batch that is
    played again replaces what it wrote before. Of several bars of a (symbol, ts) the last batch's counts. A night reads
    the days of its trailing history and no others. With `events` a run is entered there as running, then as done with
    the number of constituents, of symbols with bars, and of results, which are counted while the results are written,
    or as in error with what went wrong. `files` bounds the files of one batch; for `long`, see `scan.signals`.
    """

    def step(batch: DataFrame, number: int) -> None:
        last = store_batch(batch, stored, number)
        if last is None:
            return
        history = stored_history(spark, stored, last, settings.history_days)
        key = run(str(last))

        def tell(**what) -> None:
            if events:
                now = dt.datetime.now()
                write_run_event(spark, events, id=key, event_ts=now, **{k: now if v is NOW else v for k, v in what.items()})

        tell(status="running", started_at=NOW)
        try:
            counts = Counts()
            rows = found(history, constituents, f"{last} 23:59:59", earnings, settings, benchmark, counts, long)
            write_results(rows, results, key)
            tell(status="done", finished_at=NOW, **counts.get())
        except Exception as e:
            tell(status="error", error=str(e)[:1000], finished_at=NOW)
            raise

    reader = spark.readStream.schema(BARS)
    bars = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(arriving)
    return bars.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
