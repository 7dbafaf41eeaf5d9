import datetime as dt

from pyspark.sql import functions as F

from candlewright.functions.blocks import cut
from candlewright.functions.settings import Settings
from candlewright.operators.bars import resample_ticks
from candlewright.queries import _bars, _bench, _constituents, _earnings, _ticks
from candlewright.plans.scan import scan
from candlewright.plans.serving import run_status
from candlewright.sources.tables import current_runs
from candlewright.streaming.live import incremental_scan, store_batch, stored_history, stream_bars, stream_calendar_bars

TICKS = "symbol string, ts timestamp, price double, volume double"


def test_stream_gives_the_batch_bars_and_drops_late_ticks(spark, tmp_path):
    at = lambda d, h: dt.datetime(2020, 1, d, h)
    first = [("A", at(1, 9), 5.0, 1.0), ("A", at(1, 10), 7.0, 2.0), ("B", at(1, 9), 1.0, 1.0), ("A", at(2, 9), 6.0, 1.0), ("A", at(4, 9), 6.0, 1.0)]
    late = [("A", at(1, 11), 99.0, 1.0), ("A", at(9, 9), 1.0, 1.0)]
    path = str(tmp_path / "ticks")
    for rows in (first, late):
        spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(path)
        if rows is first:
            q = stream_bars(spark.readStream.schema(TICKS).parquet(path)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q.start().awaitTermination()
    got = {(r.symbol, r.ts): tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = resample_ticks(spark.createDataFrame(first, TICKS), "day", ["ts", "price"]).filter(F.col("ts") < at(9, 0))
    assert got == {(r.symbol, r.ts): tuple(r)[2:] for r in want.collect()}


def test_streamed_weeks_and_months_equal_the_batch_bars(spark, tmp_path):
    """Weeks from Monday by windows, months and weeks by timers; ticks behind the watermark drop."""
    ticks = _ticks(spark, "/root/testdata/sf0.001").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "price", "volume").filter("ts < timestamp'1997-06-01'")
    path, last = str(tmp_path / "ticks"), dt.datetime(1999, 1, 1)
    end = spark.createDataFrame([("A", last, 1.0, 1.0)], TICKS)
    for k, part in enumerate((ticks.filter("ts < timestamp'1996-10-10'"), ticks.filter("ts >= timestamp'1996-10-10'").union(end), spark.createDataFrame([("1", dt.datetime(1996, 5, 5), 1e9, 1.0)], TICKS))):
        part.coalesce(1).write.mode("append").parquet(path)
        for name, build in (("week", lambda s: stream_bars(s, "7 days", "1 day", start="4 days")), ("month", lambda s: stream_calendar_bars(s, "month", "1 day")), ("weeks", lambda s: stream_calendar_bars(s, "week", "1 day"))):
            rows = build(spark.readStream.schema(TICKS).parquet(path))
            rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
    show = lambda df: sorted((r.symbol, r.ts, r.open, r.high, r.low, r.close, round(r.volume, 6)) for r in df.collect())
    for name, unit in (("week", "week"), ("month", "month"), ("weeks", "week")):
        got = show(spark.read.parquet(str(tmp_path / name)))
        assert got == show(resample_ticks(ticks, unit, ["ts", "price"])) and len(got) > 50, name


def test_twenty_nights_and_a_replay(spark, tmp_path):
    """After each night the trailing history equals that of all bars so far, and only its days' files are read."""
    data, days, stored = "/root/testdata/sf0.001", 200, str(tmp_path / "bars")
    every = cut(_bars(spark, data))
    weeks = [r.ts for r in every.filter("ts >= timestamp'1996-07-01'").select("ts").distinct().orderBy("ts").limit(20).collect()]
    store_batch(every.filter(F.col("ts") < weeks[0]), stored, 0)
    for n, at in enumerate(weeks, 1):
        again = every.filter(F.col("ts") == weeks[n - 2]).withColumn("volume", F.lit(0.0)) if n == 7 else every.limit(0)  # a corrected week
        assert store_batch(every.filter(F.col("ts") == at).unionByName(again), stored, n) == at.date()
    assert store_batch(every.limit(0), stored, 21) is None
    history = stored_history(spark, stored, weeks[-1].date(), days)
    want = every.filter((F.col("ts") <= weeks[-1]) & (F.col("ts") >= weeks[-1] + dt.timedelta(hours=24, seconds=-1) - dt.timedelta(days)))
    want = want.withColumn("volume", F.when(F.col("ts") == weeks[5], 0.0).otherwise(F.col("volume")))
    plain = lambda df: sorted(map(str, df.select("symbol", "ts", "open", "close", "volume").collect()))
    assert plain(history) == plain(want) and len(plain(want)) > 50
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(ts" in plan.split("PushedFilters: [")[1]
    kept, read = spark.read.parquet(stored).select("day").distinct().count(), history.select("ts").distinct().count()
    assert kept > 1.5 * read
    store_batch(every.filter(F.col("ts") == weeks[-1]), stored, 20)  # played again
    assert plain(stored_history(spark, stored, weeks[-1].date(), days)) == plain(want)


def test_incremental_scan_stores_each_day_once(spark, tmp_path):
    data, s = "/root/testdata/sf0.001", Settings(benchmark="^BENCH", min_turnover=5e4, history_days=3650)
    arriving, stored, results, events = (str(tmp_path / x) for x in ("in", "bars", "results", "events"))
    every = _bars(spark, data).unionByName(_bench(spark, data))
    bars, more = every.filter("ts <= timestamp'2001-05-28'"), every.filter("ts > timestamp'2001-05-21' and ts <= timestamp'2001-06-04'")
    bars.coalesce(1).write.mode("append").parquet(arriving)
    how = dict(earnings=_earnings(spark, data), events=events)
    args = (spark, arriving, stored, results, str(tmp_path / "check"), _constituents(spark, data), s)
    incremental_scan(*args, **how).awaitTermination()
    assert spark.read.parquet(stored).count() == bars.count()
    more.coalesce(1).write.mode("append").parquet(arriving)  # one week comes again
    incremental_scan(*args, **how).awaitTermination()
    found = spark.read.parquet(results).filter("run_id = 'scan-2001-06-04'")
    want = scan(every.filter("ts <= timestamp'2001-06-04'"), _constituents(spark, data), "2001-06-04", _earnings(spark, data), s)
    plain = lambda df: sorted(map(str, df.select("symbol", "score", "rs_rank", "setup_type", "earnings_flag", "stop").collect()))
    assert plain(found) == plain(want) and found.count() >= 1
    run = run_status(current_runs(spark.read.parquet(events)), "scan-2001-06-04").first()
    with_bars = every.filter("ts <= timestamp'2001-06-04'").join(_constituents(spark, data), "symbol", "left_semi").select("symbol").distinct().count()
    assert (run.status, run.passed, run.total, run.scanned) == ("done", found.count(), _constituents(spark, data).count(), with_bars)
    n = spark.read.parquet(results).count()
    incremental_scan(*args, **how).awaitTermination()  # nothing new
    assert spark.read.parquet(results).count() == n
    incremental_scan(*args[:4], str(tmp_path / "again"), *args[5:], **how).awaitTermination()  # all files once more, as one batch
    assert plain(spark.read.parquet(results).filter("run_id = 'scan-2001-06-04'")) == plain(want)
