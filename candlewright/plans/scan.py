"""The nightly scan: liquid, strong symbols in a trend with a setup, ranked by score."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from candlewright.functions.blocks import Blocks, in_blocks
from candlewright.functions.settings import DEFAULTS, Settings
from candlewright.functions.windows import by_symbol, upto
from candlewright.operators import indicators, setups, strength
from candlewright.sources.tables import available, window_of

COLUMNS = ("symbol", "name", "score", "setup_type", "signals_triggered", "rs_ratio", "rs_rank", "trend_score", "adx", "entry_pivot", "stop", "target", "rr", "atr", "earnings_flag", "last_close", "week52_high", "week52_low", "avg_turnover")

#: Bars of the year's range.
YEAR = 252


class Counts:
    """A run's total (constituents), scanned (those with bars) and passed (results), counted while a scan's rows are made."""

    def __init__(self) -> None:
        self.listed, self.judged, self.rows = Observation(), Observation(), None

    def of_list(self, constituents: DataFrame) -> DataFrame:
        self.rows = constituents
        return constituents.observe(self.listed, F.count(F.lit(1)).alias("total"))

    def of_verdicts(self, verdicts: DataFrame, passing: Column) -> DataFrame:
        return verdicts.observe(self.judged, F.count(F.lit(1)).alias("scanned"), F.count_if(F.coalesce(passing, F.lit(False))).alias("passed"))

    def get(self) -> dict[str, int]:
        """The counts, once the scan's rows have been written or collected."""
        listed = _observed(self.listed) or {"total": self.rows.count()}
        return listed | {"scanned": 0, "passed": 0} | _observed(self.judged)


def _observed(seen: Observation) -> dict[str, int]:
    """What was observed; nothing, where Spark found at run time that a part of the plan has no rows and left it out."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def signals(bars: DataFrame, settings: Settings = DEFAULTS, long: bool | Blocks = False) -> DataFrame:
    """Indicators, trend, setups, risk and liquidity at every bar: the one table that scan and backtest read.

    `long` is for histories beyond some 3,000 bars: True weighs rows in groups, `Blocks` cuts each symbol into blocks of
    rows, so that a symbol of any length spreads over tasks. A detector whose complete rows are fewer in a lead-in than
    it looks at raises an error there, as its verdict would depend on rows further back.
    """
    if isinstance(long, Blocks):
        return in_blocks(bars, long, lambda rows: _checked(_signals(rows, settings, long)))
    return _signals(bars, settings, long)


def _checked(rows: DataFrame, closes: int = 0) -> DataFrame:
    """Rows of blocks with their true n_bars; an error where a lead-in has too few complete rows or known closes, or is
    shorter than the year's range."""
    count = lambda test: F.count(F.when(test, 1)).over(upto())
    seen = F.least(*(count(setups.complete(*columns)) for columns in setups.COMPLETE))
    rows = rows.withColumn("n_bars", F.col("_g"))
    short = ~F.col("_lead") & (F.col("_g") > F.col("_k")) & ((F.col("_k") < YEAR) | (seen < setups.LOOK_BACK) | (count(F.col("close").isNotNull()) <= closes))
    return rows.withColumn("n_bars", F.when(short, F.raise_error(F.lit("too few complete rows lead in to a block: use a longer lead")).cast("long")).otherwise(F.col("n_bars")))


def _signals(bars: DataFrame, settings: Settings, long: bool | Blocks) -> DataFrame:
    early = lambda df: setups.liquidity(indicators.year_range(setups.turnover(df), YEAR), settings)
    df = indicators.bundle(early(bars), long)  # what is made of bars alone comes first
    df = setups.result_columns(setups.risk(setups.verdicts(df), settings))
    return df.drop(*(f"_last_{c}" for c in setups.LATEST)).withColumn("n_bars", F.row_number().over(by_symbol()))


def earnings_flag(rows: DataFrame, earnings: DataFrame, as_of: Column, days: int = 10) -> DataFrame:
    """earnings_flag: some date from `as_of` to `days` calendar days later. `as_of` may be a column of `rows`.

    Days are put into bins of the interval's length, and an interval meets two of them. A bin's dates and those of the
    next become one array, of at most twice as many as the interval has days, so that `rows` are read once and stay one
    row each, and a symbol with any number of dates keeps small arrays.
    """
    day, bin_ = as_of.cast("date"), lambda d: F.floor(F.unix_date(d) / (days + 1))
    dates = earnings.select(F.col("symbol").alias("_of"), "earnings_date", F.explode(F.array(bin_(F.col("earnings_date")), bin_(F.col("earnings_date")) - 1)).alias("_bin"))
    dates = dates.groupBy("_of", "_bin").agg(F.collect_set("earnings_date").alias("_dates"))
    due = F.exists("_dates", lambda d: d.between(day, F.date_add(day, days)))
    out = rows.join(dates, (F.col("symbol") == F.col("_of")) & (bin_(day) == F.col("_bin")), "left")
    return out.withColumn("earnings_flag", F.coalesce(due, F.lit(False))).drop("_of", "_bin", "_dates")


def _steady(settings: Settings) -> Column:
    """Whether a row passes the gates that its rank has no part in."""
    return (F.col("n_bars") >= settings.min_bars) & F.col("trend_ok") & F.col("setup_type").isNotNull() & F.col("risk_ok")


def _good(settings: Settings) -> Column:
    """Whether a row passes every gate."""
    return (F.col("rs_rank") >= settings.rs_floor) & _steady(settings) & setups.qualified(settings)


def _passing(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows that pass every gate, scored."""
    rows = rows.filter(_good(settings))
    rows = rows.withColumn("score", setups.score(F.col("rs_rank"), F.col("trend_score"), F.col("rr"), F.col("setup_type")))
    return rows.withColumn("signals_triggered", F.array("setup_type"))


def _named(rows: DataFrame, constituents: DataFrame, earnings: DataFrame | None, as_of: Column, settings: Settings) -> DataFrame:
    """Name (the symbol where there is none) and earnings flag."""
    rows = rows.join(constituents.select("symbol", "name", "pos"), "symbol", "left")
    rows = rows.withColumn("name", F.coalesce("name", "symbol"))
    if earnings is None:
        return rows.withColumn("earnings_flag", F.lit(False))
    return earnings_flag(rows, earnings, as_of, settings.earnings_days)


def scan(bars: DataFrame, constituents: DataFrame, as_of: str, earnings: DataFrame | None = None, settings: Settings = DEFAULTS, benchmark: bool | DataFrame = True, top: int | None = None, long: bool | Blocks = False) -> DataFrame:
    """Ranked results at `as_of`, from each symbol's last bar in the trailing history; ties keep the universe's order."""
    rows = found(bars, constituents, as_of, earnings, settings, benchmark, long=long).orderBy(F.desc("score"), "pos")
    return rows.limit(top) if top else rows


def found(bars: DataFrame, constituents: DataFrame, as_of: str, earnings: DataFrame | None = None, settings: Settings = DEFAULTS, benchmark: bool | DataFrame = True, counts: Counts | None = None, long: bool | Blocks = False) -> DataFrame:
    """The same without an order. With `counts`, what it counts is known once the rows were written or collected, and no
    job is run for that; an order would have Spark look at them twice.
    """
    verdicts = judged(bars, counts.of_list(constituents) if counts else constituents, as_of, settings, benchmark, long)
    verdicts = verdicts.withColumn("rs_rank", F.coalesce("rs_rank", F.lit(0.0)))
    rows = _passing(counts.of_verdicts(verdicts, _good(settings)) if counts else verdicts, settings)
    rows = _named(rows, constituents, earnings, F.lit(as_of).cast("date"), settings)
    return rows.drop("adx", "atr14").withColumnRenamed("adx_shown", "adx").select(*COLUMNS, F.col("ts").alias("as_of_bar"), "pos")


def _measured(bars: DataFrame, settings: Settings, long: bool | Blocks = False) -> DataFrame:
    """Signals and look-back returns at every bar: all of it in windows over one exchange by symbol, or by block."""
    if isinstance(long, Blocks):
        far = max(k for k, _ in settings.lookbacks)
        return in_blocks(bars, long, lambda rows: _checked(strength.with_returns(_signals(rows, settings, long), settings), far))
    return strength.with_returns(_signals(bars, settings, long), settings)


def _benchmark(bars: DataFrame, benchmark: bool | DataFrame, settings: Settings) -> DataFrame | None:
    """Returns of the benchmark's bars: those given apart, or those among `bars`."""
    if benchmark is False:
        return None
    own = bars.filter(F.col("symbol") == settings.benchmark) if benchmark is True else benchmark
    return strength.returns(own, settings).drop("symbol")


def judged(bars: DataFrame, constituents: DataFrame, as_of: str, settings: Settings = DEFAULTS, benchmark: bool | DataFrame = True, long: bool | Blocks = False) -> DataFrame:
    """One row per constituent with bars: its signals at its last bar, and its strength among those that are liquid.

    Bars are read once: gates, returns and indicators share the windows, and only each symbol's last bar goes on.
    `benchmark`: its bars, or whether to take them from `bars`; strength is absolute where it has no bar. `long`: see
    `signals`; without it, more bars of a symbol in the trailing history than weights can tell apart are an error.
    """
    history = window_of(bars, as_of, settings.history_days)
    own = _measured(available(history, constituents), settings, long)
    if isinstance(long, Blocks):  # no window over a whole symbol: the last of each task's rows, then of these
        last = own.groupBy("symbol").agg(F.max_by(F.struct(*(c for c in own.columns if c != "symbol")), "ts").alias("_row")).select("symbol", "_row.*")
    else:
        last = own.withColumn("_next", F.lead("ts").over(by_symbol())).filter("_next is null").drop("_next")
    if not isinstance(benchmark, bool):
        benchmark = window_of(benchmark, as_of, settings.history_days)
    bench = _benchmark(history, benchmark, settings)
    if bench is not None:
        bench = bench.agg(F.max_by(F.struct(*bench.columns), "ts").alias("x")).filter("x is not null").select("x.*")
    return strength.strength(last, bench, settings=settings, among=F.col("liquid"))


def scan_history(bars: DataFrame, constituents: DataFrame, earnings: DataFrame | None = None, settings: Settings = DEFAULTS, benchmark: bool | DataFrame = True, long: bool | Blocks = False, parts: int | None = None) -> DataFrame:
    """Results at every bar: symbols compete with those that have a bar at the same time.

    All liquid rows compete, but few pass the other gates: only these keep their columns where rows meet by time. `parts`:
    tasks that the times are dealt out over.
    """
    rows = _measured(available(bars, constituents), settings, long).filter("liquid")
    competing = ("ts", *(f"ret{k}" for k, _ in settings.lookbacks))
    shown = [c for c in rows.columns if c not in competing]
    rows = rows.select(*competing, F.when(_steady(settings), F.struct(*shown)).alias("_row"))
    rows = strength.strength(rows, _benchmark(bars, benchmark, settings), "ts", settings=settings, parts=parts).filter("_row is not null")
    rows = _passing(rows.select("ts", "rs_ratio", "rs_rank", "_row.*"), settings)
    rows = _named(rows, constituents, earnings, F.col("ts"), settings)
    return rows.drop("adx").withColumnRenamed("adx_shown", "adx").select("ts", *COLUMNS)


def funnel(verdicts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """How many symbols there are, are liquid, pass strength, pass trend, and have a result."""
    strong = F.coalesce(F.col("rs_rank") >= settings.rs_floor, F.lit(False))
    steady = strong & (F.col("n_bars") >= settings.min_bars) & F.col("trend_ok")
    found = steady & F.coalesce(setups.qualified(settings), F.lit(False)) & F.col("risk_ok")
    return verdicts.agg(F.count("*").alias("total"), F.count_if("liquid").alias("liquid"), F.count_if(strong).alias("strong"), F.count_if(steady).alias("trending"), F.count_if(found).alias("passed"))


def rank_results(results: DataFrame, column: str = "score", descending: bool = True, top: int | None = None) -> DataFrame:
    """Results by any sortable column; missing numbers count as 0, ties go by symbol."""
    if column not in ("symbol", "score", "rs_rank", "last_close", "entry_pivot", "rr", "adx"):
        raise ValueError(f"cannot sort by {column}")
    key = F.col(column) if column == "symbol" else F.coalesce(F.col(column), F.lit(0))
    rows = results.orderBy(key.desc() if descending else key.asc(), "symbol")
    return rows.limit(top) if top else rows
