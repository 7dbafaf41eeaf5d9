"""Reading bars and constituents, and writing runs and results."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.functions.scalar import plain_symbol, provider_symbol, title_case
from candlewright.operators.bars import clean_bars

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
#: Sector labels and the index ticker of each. Fixed values.
SECTORS = (
    ("Technology", "^CNXIT"), ("Financial Services", "^CNXFIN"), ("Healthcare", "^CNXPHARMA"), ("Energy", "^CNXENERGY"),
    ("Consumer Discretionary", "^CNXAUTO"), ("Industrials", "^CNXINFRA"), ("FMCG", "^CNXFMCG"), ("Metals", "^CNXMETAL"),
    ("Nifty 50", "^NSEI"), ("Bank Nifty", "^NSEBANK"), ("Fin Nifty", "^CNXFIN"), ("Sensex", "^BSESN"),
)
RUNS = "id string, status string, universe string, total int, scanned int, passed int, error string, started_at timestamp, finished_at timestamp"

MANIFEST = "run_id string, version string, at timestamp"


def sectors(spark: SparkSession) -> DataFrame:
    """sector, ticker of the indices; a ticker may serve two sectors."""
    return spark.createDataFrame(list(SECTORS), "sector string, ticker string")


def read_bars(spark: SparkSession, path: str, symbols: DataFrame | None, as_of: str | Column | None = None, days: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Clean bars of the symbols over the `days` before `as_of`; both filters reach the scan. Symbols lose the provider
    suffix, NaN becomes null, empty bars go, and a (symbol, ts) has one bar; see `clean_bars`.
    """
    reader = spark.read.schema(BARS).option("header", True)
    bars = reader.format(fmt).load(path)
    if as_of is not None:
        bars = window_of(bars, as_of, days)
    bars = bars.withColumn("symbol", plain_symbol(F.col("symbol")))
    return clean_bars(bars if symbols is None else bars.join(symbols.select("symbol"), "symbol", "left_semi"))


def window_of(bars: DataFrame, as_of: str | Column, days: int | None) -> DataFrame:
    end = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
    bars = bars.filter(F.col("ts") <= end)
    return bars if days is None else bars.filter(F.col("ts") >= end - F.make_dt_interval(F.lit(days)))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """pos, symbol, name, yf_symbol of a constituents file, read by column names; further columns play no part.

    pos is the place in the file. Such a list has a row per symbol, so that numbering it in one task is no burden.
    """
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    place = ["_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()]
    rows = rows.select(*(c for c in rows.columns if c in ("Company Name", "Symbol", "Series")), F.struct(*(F.col(c) if isinstance(c, str) else c for c in place)).alias("place"))
    return universe(rows.withColumn("pos", F.row_number().over(Window.orderBy("place")) - 1))


def universe(rows: DataFrame, series: str = "EQ") -> DataFrame:
    """Constituents of the wanted series (all, where there is no such column), trimmed and named; needs pos."""
    if "Series" in rows.columns:
        rows = rows.filter(F.trim("Series") == series)
    symbol = F.trim("Symbol")
    return rows.select("pos", symbol.alias("symbol"), title_case(F.trim("Company Name")).alias("name"), provider_symbol(symbol).alias("yf_symbol"))


def read_list(constituents: DataFrame, benchmark: str) -> DataFrame:
    """The provider symbols to read: constituents and the benchmark, each once."""
    one = constituents.sparkSession.range(1).select(F.lit(benchmark).alias("yf_symbol"))
    return constituents.select("yf_symbol").union(one).distinct()


def available(bars: DataFrame, constituents: DataFrame) -> DataFrame:
    """Bars of constituents only."""
    return bars.join(constituents.select("symbol"), "symbol", "left_semi")


def missing(constituents: DataFrame, bars: DataFrame) -> DataFrame:
    """Constituents without any bar."""
    return constituents.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def write_results(results: DataFrame, path: str, run_id: str) -> None:
    """Write a run's results under its id, each file in order of falling score. A second write of the same run replaces
    the first, also where it has no rows.
    """
    rows = results.drop("run_id").sortWithinPartitions(F.desc("score"))
    rows.write.mode("overwrite").parquet(f"{path}/run_id={quote(run_id, safe=' ')}")


def write_bars_by_symbol(bars: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Bars as a table in buckets by symbol, sorted by symbol and ts. What is computed by symbol from `spark.table(table)`
    needs no exchange. Rows are dealt out first, so that a bucket is one file."""
    rows = bars.repartition(buckets, "symbol")
    rows.write.mode(mode).bucketBy(buckets, "symbol").sortBy("symbol", "ts").format("parquet").saveAsTable(table)


def read_evolved_results(spark: SparkSession, path: str) -> DataFrame:
    """Results in files of several versions: all their columns, null where a file lacks one; no flag means false."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    if "earnings_flag" not in rows.columns:
        rows = rows.withColumn("earnings_flag", F.lit(None).cast("boolean"))
    return rows.withColumn("earnings_flag", F.coalesce("earnings_flag", F.lit(False)))


def commit_results(results: DataFrame, path: str, run_id: str) -> None:
    """Write a run's results beside those that are there, then enter them into the manifest, which makes them the run's.

    A job that ends in between leaves what was there before; so does one that fails while it writes.
    """
    version = uuid.uuid4().hex
    write_results(results, f"{path}/data/version={version}", run_id)
    _enter(results.sparkSession, path, [(run_id, version)])


def drop_runs(spark: SparkSession, path: str, run_ids: Iterable[str]) -> None:
    """Enter runs as gone; `tidy_results` deletes their files."""
    _enter(spark, path, [(run_id, None) for run_id in run_ids])


def _enter(spark: SparkSession, path: str, rows: list[tuple[str, str | None]]) -> None:
    now = dt.datetime.now()
    spark.createDataFrame([(*r, now) for r in rows], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _current(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("version"), "at").alias("v")).select("run_id", F.col("v.version").alias("version")).filter("version is not null")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The results of each run's version in the manifest; partitions of others are pruned when the join runs."""
    return spark.read.parquet(f"{path}/data").join(F.broadcast(_current(spark, path)), ["run_id", "version"]).drop("version")


def tidy_results(spark: SparkSession, path: str) -> int:
    """Delete the folders of versions that the manifest no longer names, and return their number. Not beside a writer."""
    keep = {r.version for r in _current(spark, path).collect()}  # a row for each run
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in files.listStatus(folder) if f.isDirectory() and f.getPath().getName().removeprefix("version=") not in keep]
    for p in gone:
        files.delete(p, True)
    return len(gone)


def results_to_text(results: DataFrame) -> DataFrame:
    """Results for a store without arrays: signals_triggered as JSON text, null as it is."""
    return results.withColumn("signals_triggered", F.to_json("signals_triggered"))


def results_from_text(results: DataFrame) -> DataFrame:
    """The reverse: JSON text as an array; text that is no array of strings raises an error."""
    return results.withColumn("signals_triggered", F.from_json("signals_triggered", "array<string>", {"mode": "FAILFAST"}))


def write_run_event(spark: SparkSession, path: str, **event) -> None:
    """Append one lifecycle event of a run: running, done or error; files are never changed."""
    row = [tuple(event.get(c.split()[0]) for c in RUNS.split(", ")) + (event.get("event_ts"),)]
    spark.createDataFrame(row, RUNS + ", event_ts timestamp").coalesce(1).write.mode("append").parquet(path)


def current_runs(events: DataFrame) -> DataFrame:
    """The present state of each run: every column's latest value that is not null, by event time."""
    w = Window.partitionBy("id").orderBy("event_ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = [c for c in events.columns if c not in ("id", "event_ts")]
    rows = events.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return rows.drop("event_ts").distinct()


def union_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results of both versions together; what one lacks is null, and no flag means false."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.withColumn("earnings_flag", F.coalesce("earnings_flag", F.lit(False)))
