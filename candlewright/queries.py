"""The registered queries of the screener over the driver's tables, and the same in DuckDB SQL.

Bars are made of `lineitem`: a supplier is a symbol, a shipment a tick, a week a bar; all suppliers together are the
benchmark. Figures are rounded to four places the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.functions.blocks import Blocks, cut, in_blocks
from candlewright.functions.scalar import in_session
from candlewright.functions.settings import Settings
from candlewright.operators import indicators, legacy, setups, strength
from candlewright.operators.bars import TASK_TICKS, dealt, parts_of, resample_bars, resample_ticks, wide_to_long
from candlewright.plans import backtest, scan, serving
from candlewright.sources import tables

SETTINGS = Settings(benchmark="^BENCH", min_turnover=5e4, history_days=3650)
AS_OF = "2001-06-04"
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What tells which of a bar's ticks comes first.
ORDER = ("ts", "l_orderkey", "l_linenumber")


def _ticks(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("double").alias("volume"), "l_orderkey", "l_linenumber", *also)


def _size(spark: SparkSession, sf_dir: str) -> int:
    return _read(spark, sf_dir, "lineitem").count()


def _bars(spark: SparkSession, sf_dir: str, unit: str = "week", size: int | None = None, within: str | None = None) -> DataFrame:
    size = _size(spark, sf_dir) if size is None else size
    return resample_ticks(_ticks(spark, sf_dir), unit, ORDER, parts_of(spark, size, TASK_TICKS), within)


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars for windows by symbol; there are no more of them than ticks."""
    size = _size(spark, sf_dir)
    return dealt(_bars(spark, sf_dir, size=size), size)


def _pooled(spark: SparkSession, sf_dir: str, symbol: Column, *columns: str) -> DataFrame:
    """Weekly bars of ticks of all suppliers: few bars, of which each task makes partial sums over its share of ticks."""
    ticks = _ticks(spark, sf_dir, *columns).repartition(parts_of(spark, _size(spark, sf_dir), TASK_TICKS), "l_orderkey")
    return resample_ticks(ticks.withColumn("symbol", symbol), "week", ORDER)


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, F.lit(SETTINGS.benchmark))


def _constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier")
    series = F.when(F.col("s_suppkey") % 10 == 0, "BE").otherwise("EQ")
    return tables.universe(rows.select(F.col("s_suppkey").alias("pos"), F.col("s_suppkey").cast("string").alias("Symbol"), F.col("s_name").alias("Company Name"), series.alias("Series")))


def _earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    rows = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").crossJoin(F.broadcast(n))
    return rows.select((F.col("o_custkey") % F.col("n") + 1).cast("string").alias("symbol"), F.col("o_orderdate").cast("date").alias("earnings_date"))


def r4(c: Column | str) -> Column:
    """Rounded to four places by arithmetic that DuckDB does alike."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10000 + 0.5) / 10000


def _show(df: DataFrame, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select("symbol", F.to_date("ts").alias("ts"), *keep, *(r4(c).alias(c) for c in columns))


def _indicator(build: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf_dir: _show(build(_dealt(spark, sf_dir)), *columns)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.signals(_dealt(spark, sf_dir), SETTINGS)


def _detector(name: str) -> Query:
    build = {"breakout": setups.breakout, "pullback": setups.pullback, "continuation": setups.continuation}[name]
    return lambda spark, sf_dir: _show(build(indicators.bundle(_dealt(spark, sf_dir))), f"{name}_pivot", keep=(name,))


#: Short blocks, so that the symbols of small tables have several.
BLOCKS = Blocks(rows=70, lead=45, unit="month")


def _spread(spark: SparkSession, sf_dir: str, how: Blocks) -> Blocks:
    """`how` with as many tasks as rows and lead-ins of the table ask for."""
    rows = _size(spark, sf_dir) * (how.span + how.lead) // how.span
    return replace(how, parts=parts_of(spark, rows))


def _split(build: Callable[[DataFrame, Blocks], DataFrame], *columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        how = _spread(spark, sf_dir, BLOCKS)
        return _show(in_blocks(_bars(spark, sf_dir, within=how.unit), how, lambda b: build(b, how)), *columns)

    return query


def psar_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(indicators.parabolic_sar(_bars(spark, sf_dir), long=_spread(spark, sf_dir, BLOCKS)), "sar", keep=("sar_trend",))


def setups_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = _spread(spark, sf_dir, Blocks(rows=30, lead=320, unit="month"))
    return _levels(scan.signals(_bars(spark, sf_dir, within=how.unit), SETTINGS, how))


def bars(unit: str) -> Query:
    return lambda spark, sf_dir: _show(_bars(spark, sf_dir, unit), "open", "high", "low", "close", "volume")


def bars_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months from daily bars."""
    return _show(resample_bars(_bars(spark, sf_dir, "day"), "month"), "open", "high", "low", "close", "volume")


def psar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(indicators.parabolic_sar(_dealt(spark, sf_dir)), "sar", keep=("sar_trend",))


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setups.trend(indicators.bundle(_dealt(spark, sf_dir))).select("symbol", F.to_date("ts").alias("ts"), "trend_score", "trend_ok")


def setup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(_signals(spark, sf_dir))


def _levels(rows: DataFrame) -> DataFrame:
    rows = rows.filter("setup_type is not null").withColumn("pivot_price", F.col("pivot"))
    return _show(rows, "pivot_price", keep=("setup_type", "n_signals", "risk_ok", "entry_pivot", "stop", "target", "rr", "atr"))


def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setups.liquidity(_dealt(spark, sf_dir), SETTINGS).select("symbol", F.to_date("ts").alias("ts"), "liquid")


def _rank(benchmark: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bench = strength.returns(_bench(spark, sf_dir), SETTINGS).drop("symbol") if benchmark else None
        rows = strength.strength(strength.returns(_dealt(spark, sf_dir), SETTINGS), bench, "ts", settings=SETTINGS, parts=parts_of(spark, _size(spark, sf_dir)))
        return _show(rows, "rs_score", keep=("rs_rank",))

    return query


def rs_rank_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars' scores as one field of competitors."""
    rows = strength.returns(_dealt(spark, sf_dir), SETTINGS).withColumn("rs_score", r4(strength.composite(SETTINGS, benchmark=False)))
    return strength.rank(rows, spread=True).select("symbol", F.to_date("ts").alias("ts"), "rs_score", "rs_rank")


_RESULT = ("symbol", "name", "score", "setup_type", "rs_rank", "trend_score", "adx", "entry_pivot", "stop", "target", "rr", "atr", "earnings_flag", "last_close", "week52_high", "week52_low", "avg_turnover")


def _history(spark: SparkSession, sf_dir: str, benchmark: bool | None = None) -> DataFrame:
    """Results at all bars, against the pooled benchmark (None) or as scan_history does with `benchmark`."""
    bench = _bench(spark, sf_dir) if benchmark is None else benchmark
    return scan.scan_history(_dealt(spark, sf_dir), _constituents(spark, sf_dir), _earnings(spark, sf_dir), SETTINGS, bench, parts=parts_of(spark, _size(spark, sf_dir)))


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select(F.to_date("ts").alias("ts"), *_RESULT, F.array_join("signals_triggered", ",").alias("signals_triggered"), "rs_ratio")


def scan_history_benchmark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars lack the benchmark that is asked for: strength is absolute."""
    return _history(spark, sf_dir, True).select(F.to_date("ts").alias("ts"), *_RESULT, "rs_ratio")


def _asof(spark: SparkSession, sf_dir: str, as_of: str) -> DataFrame:
    rows = scan.scan(_dealt(spark, sf_dir), _constituents(spark, sf_dir), as_of, _earnings(spark, sf_dir), SETTINGS, _bench(spark, sf_dir))
    return rows.select(F.to_date("as_of_bar").alias("ts"), *_RESULT, F.array_join("signals_triggered", ",").alias("signals_triggered"), "rs_ratio")


def scan_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, AS_OF)


def scan_asof_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day with several results and scores, and each one's place among them."""
    rows = scan.scan(_dealt(spark, sf_dir), _constituents(spark, sf_dir), "1996-10-14", _earnings(spark, sf_dir), SETTINGS, _bench(spark, sf_dir))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "pos"))  # a row per symbol that passed
    return rows.select("symbol", "score", "rs_rank", "setup_type", "earnings_flag", place.alias("place"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.funnel(scan.judged(_dealt(spark, sf_dir), _constituents(spark, sf_dir), AS_OF, SETTINGS, _bench(spark, sf_dir)), SETTINGS)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.trades(_dealt(spark, sf_dir), SETTINGS)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trades(spark, sf_dir)
    return rows.select("symbol", F.to_date("date").alias("date"), "setup_type", r4("entry").alias("entry"), r4("exit").alias("exit"), "return_pct", "win")


def expectancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.expectancy(_trades(spark, sf_dir))


def setup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.setup_counts(_history(spark, sf_dir))


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_name").alias("sector"), (F.col("n_nationkey") % 10 + 1).cast("string").alias("ticker"))


def index_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serving.index_snapshot(_bars(spark, sf_dir), _sectors(spark, sf_dir))
    return rows.select("sector", "ticker", *(r4(c).alias(c) for c in ("price", "prev_close", "change", "pct_change")))


def earnings_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.earnings_flag(_bars(spark, sf_dir), _earnings(spark, sf_dir), F.col("ts"), SETTINGS.earnings_days)
    return rows.select("symbol", F.to_date("ts").alias("ts"), "earnings_flag")


def missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constituents that shipped nothing in the last weeks of the data."""
    late = tables.window_of(_bars(spark, sf_dir), "2001-12-01", 10)
    return tables.missing(_constituents(spark, sf_dir), late).select("symbol", "name")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _constituents(spark, sf_dir)


def read_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_list(_constituents(spark, sf_dir), SETTINGS.benchmark)


def _runs(results: DataFrame) -> DataFrame:
    """A run for each date with results: failed in December, running on the last."""
    rows = results.groupBy("ts").agg(F.count("*").cast("int").alias("passed"))
    last = F.max("ts").over(Window.partitionBy())
    status = F.when(F.col("ts") == last, "running").when(F.month("ts") == 12, "error").otherwise("done")
    return rows.select(F.concat(F.lit("run-"), F.to_date("ts").cast("string")).alias("id"), status.alias("status"), F.lit(None).cast("int").alias("total"), F.lit(None).cast("int").alias("scanned"), F.when(status == "done", F.col("passed")).alias("passed"), F.col("ts").alias("finished_at"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = cut(_history(spark, sf_dir))  # written once; runs and results are read from them apart
    return _runs(rows), rows.withColumn("run_id", F.concat(F.lit("run-"), F.to_date("ts").cast("string")))


def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.latest_results(*_results(spark, sf_dir)).select("run_id", "symbol", "score", "setup_type", "rs_rank")


def sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.rank_results(_results(spark, sf_dir)[1], "adx").select("run_id", "symbol", "score", "adx")


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, _ = _results(spark, sf_dir)
    every = runs.select(F.min("id").over(Window.partitionBy()).alias("x"), *runs.columns)
    return serving.run_status(every, F.col("x")).select("id", "status", "total", "scanned", "passed")


def orphan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, results = _results(spark, sf_dir)
    return serving.results_of_runs(results, runs.filter("status <> 'error'")).select("run_id", "symbol", "score")


def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, results = _results(spark, sf_dir)
    old = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_acctbal").cast("double").alias("pe_ratio"))
    return tables.union_results(old, results.select("symbol", "score", "earnings_flag"))


def _charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.chart_rows(_bars(spark, sf_dir, "day"), AS_OF, SETTINGS, days=400)


def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _charts(spark, sf_dir).select("symbol", "time", *(r4(c).alias(c) for c in serving.SERIES))
    return serving.chart_series(df)


def chart_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested payload: its candles and series as text, each point once, in order."""
    text = lambda points, *fields: F.array_join(F.transform(points, lambda p: F.concat_ws(":", p["time"].cast("string"), *(F.floor(p[f] * 100 + 0.5).cast("long").cast("string") for f in fields))), ",")
    rows = serving.chart_payload(_charts(spark, sf_dir))
    return rows.select("symbol", F.size("candles").alias("n_candles"), text(F.col("candles"), "open", "high", "low", "close", "volume").alias("candles"), *(text(F.col(n), "value").alias(n) for n in serving.SERIES.values()))


def session_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").filter(in_session(F.col("ts")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), r4(F.sum("value")).alias("value"))


def wide_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as bars by line status, spread into columns and brought back to rows."""
    return _there_and_back(_pooled(spark, sf_dir, F.col("l_linestatus"), "l_linestatus"))


def _there_and_back(bars: DataFrame) -> DataFrame:
    fields = ("open", "high", "low", "close", "volume")
    wide = bars.groupBy("ts").pivot("symbol").agg(*(F.first(c).alias(c.title()) for c in fields))
    wide = wide.toDF(*(c if c == "ts" else "|".join(c.rsplit("_", 1)) for c in wide.columns))
    return _show(wide_to_long(wide), *fields)


def wide_long_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by return flag."""
    return _there_and_back(_pooled(spark, sf_dir, F.col("l_returnflag"), "l_returnflag"))


def v1_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.signals(indicators.bundle(_dealt(spark, sf_dir)))
    return rows.select("symbol", F.to_date("ts").alias("ts"), "v1_cross", "v1_rsi", "v1_macd", "v1_breakout", "v1_signals", "v1_ok", "v1_score")


def v1_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    facts = rows.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("n_name").alias("sector"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 100).cast("double").alias("pe_ratio"), (F.col("s_suppkey") % 7 / 20).alias("revenue_growth"))
    held = facts.filter("pe_ratio > 50").select("symbol", F.lit("rising").alias("promoter_trend"), r4("pe_ratio").alias("promoter_holding"))
    passed = legacy.promoter(legacy.fundamental_gate(facts), held)
    return passed.select("symbol", "sector", *(r4(c).alias(c) for c in ("pe_ratio", "sector_pe_median", "revenue_growth")), "promoter_trend", "promoter_holding")


QUERIES: dict[str, Query] = {
    "expectancy": expectancy, "trades": trades, "scan_history": scan_history, "scan_asof": scan_asof, "scan_asof_ranked": scan_asof_ranked, "funnel": funnel,
    "scan_history_benchmark_missing": scan_history_benchmark_missing,
    "bars_weekly": bars("week"), "bars_daily": bars("day"), "bars_monthly": bars_monthly,
    "ema": _indicator(lambda b: indicators.ema(b, 9, 20, 21, 50, 200), "ema9", "ema20", "ema21", "ema50", "ema200"),
    "ema_blocks": _indicator(lambda b: indicators.ema(b, 9, 50, long=True), "ema9", "ema50"),
    "ema_exact": _indicator(lambda b: indicators.exact_ewm(b, "ema21", "close", 2 / 22, 21), "ema21"),
    "macd": _indicator(indicators.macd, "macd", "macd_signal", "macd_hist"),
    "atr": _indicator(indicators.atr, "atr14"), "rsi": _indicator(indicators.rsi, "rsi14"),
    "sma": _indicator(lambda b: indicators.sma(b, 20), "sma20"),
    "bollinger": _indicator(lambda b: indicators.band_ratio(indicators.bollinger(b)), "bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_width"),
    "adx": _indicator(indicators.adx, "plus_di", "minus_di", "adx"),
    "stochastic": _indicator(indicators.stochastic, "stoch_k", "stoch_d"), "obv": _indicator(indicators.obv, "obv"),
    "vwap": _indicator(indicators.vwap, "vwap"), "cci": _indicator(indicators.cci, "cci"), "psar": psar,
    "ema_split": _split(lambda b, how: indicators.ema(b, 9, 20, 21, 50, 200, long=how), "ema9", "ema20", "ema21", "ema50", "ema200"),
    "obv_split": _split(lambda b, how: indicators.obv(b, long=how), "obv"), "adx_split": _split(lambda b, _: indicators.adx(b), "plus_di", "minus_di", "adx"),
    "macd_split": _split(lambda b, how: indicators.macd(b, long=how), "macd", "macd_signal", "macd_hist"), "psar_split": psar_split, "setups_split": setups_split,
    "range_52w": _indicator(indicators.year_range, "year_high", "year_low"),
    "trend": trend, "breakout": _detector("breakout"), "pullback": _detector("pullback"), "continuation": _detector("continuation"),
    "setups": setup_levels, "liquidity": liquidity, "rs_rank": _rank(True), "rs_rank_no_benchmark": _rank(False),
    "rs_rank_spread": rs_rank_spread, "setup_counts": setup_counts, "index_snapshot": index_snapshot, "earnings_flag": earnings_flag,
    "missing_symbols": missing_symbols, "universe": universe, "read_list": read_list, "latest_results": latest_results,
    "sorted_results": sorted_results, "run_status": run_status, "orphan_results": orphan_results, "schema_union": schema_union,
    "chart_series": chart_series, "chart_nested": chart_nested, "session_ticks": session_ticks, "wide_to_long": wide_long, "wide_to_long_all": wide_long_all,
    "v1_signals": v1_signals, "v1_fundamentals": v1_fundamentals,
}
