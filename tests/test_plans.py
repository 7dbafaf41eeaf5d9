"""Scan, backtest, strength, serving, tables and the driver's oracle at the smallest scale."""

import datetime as dt
import math
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from candlewright import oracles, queries
from candlewright.functions.scalar import plain_symbol, title_case
from candlewright.functions.settings import Settings
from candlewright.operators import bars, legacy, strength
from candlewright.plans import backtest, scan, serving
from candlewright.sources import tables

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUICK = ("bars_weekly", "bars_monthly", "ema", "ema_blocks", "adx", "cci", "psar", "ema_split", "obv_split", "adx_split", "macd_split", "psar_split", "setups_split", "trend", "breakout", "setups", "trades", "expectancy", "rs_rank", "rs_rank_spread", "scan_asof", "scan_asof_ranked", "scan_history", "scan_history_benchmark_missing", "latest_results", "funnel", "earnings_flag", "chart_series", "chart_nested", "wide_to_long", "v1_signals", "v1_fundamentals", "missing_symbols", "universe", "read_list", "session_ticks")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return x.isoformat()[:10] if isinstance(x, dt.date) else str(x)


@pytest.mark.parametrize("name", QUICK)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = con.sql(oracles.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_wide_to_long_of_all_rows(spark):
    test_oracle(spark, "wide_to_long_all")
    total = spark.read.parquet(f"{DATA}/lineitem.parquet").agg({"l_quantity": "sum"}).first()[0]
    assert queries.QUERIES["wide_to_long_all"](spark, DATA).agg({"volume": "sum"}).first()[0] == pytest.approx(total)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLE_SQL)
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], tables.BARS)
    names = spark.createDataFrame([], "pos int, symbol string, name string")
    assert scan.scan(empty, names, "2020-01-01").count() == 0
    assert scan.funnel(scan.judged(empty, names, "2020-01-01")).first()["total"] == 0
    rows = backtest.expectancy(backtest.trades(empty))
    assert rows.first()["count"] == 0 and backtest.expectancy_map(rows).first()["error"] == "no trades"


def test_expectancy_totals(spark):
    rows = queries.expectancy(spark, DATA)
    got = {r.setup_type: r["count"] for r in rows.collect()}
    assert got[None] == sum(v for k, v in got.items() if k)
    one = backtest.expectancy_map(rows).first()
    assert one["count"] == got[None] and set(one["by_setup"]) == set(got) - {None}


def test_percentile_ties_and_weights(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 0.5), ("D", 2.0), ("E", None)], "symbol string, rs_score double")
    assert {r.symbol: r.rs_rank for r in strength.rank(df).collect()} == {"A": 75.0, "B": 75.0, "C": 25.0, "D": 100.0}
    one = spark.createDataFrame([(0.1, 0.2, None, 0.0, 0.4, 0.5)], "ret21 double, ret63 double, ret126 double, bench21 double, bench63 double, bench126 double")
    assert one.select(strength.composite()).first()[0] == pytest.approx(0.5)  # one window is left
    assert one.select(strength.composite(benchmark=False)).first()[0] == pytest.approx((0.2 * 0.1 + 0.35 * 0.2) / 0.55)


def test_spread_percentile_equals_the_window(spark):
    """Ties, both signs, zeros, tiny and endless scores, with and without a key; no window over all rows."""
    draw = random.Random(2)
    odd = [0.0, -0.0, 1.0, 1.0, float("inf"), float("-inf"), 5e-324, -1e300, float("nan"), None]
    scores = [draw.choice([round(draw.gauss(0, 1), 2), 0.5, draw.gauss(0, 1e-4), draw.choice(odd)]) for _ in range(3000)]
    df = spark.createDataFrame([(str(k), k % 3, x) for k, x in enumerate(scores)], "symbol string, day int, rs_score double").repartition(5)
    key = lambda rows: {r.symbol: r.rs_rank for r in rows.collect()}
    odd_days = F.col("day") != 1
    for by in ((), ("day",)):
        assert key(strength.rank(df, *by, spread=True)) == key(strength.rank(df, *by))
    assert key(strength.rank(df, among=odd_days, spread=True)) == key(strength.rank(df, among=odd_days))
    assert strength.rank(df.limit(0), spread=True).count() == 0


def test_sector_median(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ABC"), draw.choice([None, round(draw.gauss(5, 30), 1), 7.0])) for _ in range(2001)] + [("D", None), ("E", 4.0), ("E", 5.5), (None, 2.0)]
    df = spark.createDataFrame(rows, "sector string, pe_ratio double").repartition(4)
    got = {r.sector: r.sector_pe_median for r in legacy.sector_median(df).collect()}
    assert got == {r[0]: r[1] for r in df.groupBy("sector").agg(F.median("pe_ratio")).collect()} and got["E"] == 4.75 and got["D"] is None


def test_many_dates_of_a_symbol(spark):
    """A calendar with a date every third day for centuries keeps small arrays."""
    day = dt.date(1800, 1, 1)
    earnings = spark.range(40_000).select(F.lit("A").alias("symbol"), F.date_add(F.lit(day), (3 * F.col("id")).cast("int")).alias("earnings_date"))
    rows = spark.createDataFrame([("A", dt.date(1799, 12, d)) for d in range(20, 32)] + [("A", dt.date(2000, 1, 1)), ("A", dt.date(2500, 1, 1)), ("B", day)], "symbol string, ts date")
    got = {(r.symbol, r.ts): r.earnings_flag for r in scan.earnings_flag(rows, earnings, F.col("ts")).collect()}
    assert got == {(s, d): s == "A" and d >= dt.date(1799, 12, 22) and d.year < 2100 for s, d in got} and len(got) == 15


def test_bars_stored_by_symbol_need_no_exchange(spark):
    rows = queries._bars(spark, DATA)
    tables.write_bars_by_symbol(rows, "bars_by_symbol", 4)
    try:
        stored = spark.table("bars_by_symbol")
        plan = scan.signals(stored)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.collect()))
    finally:
        spark.sql("DROP TABLE bars_by_symbol")


def test_committed_results_outlive_a_failed_rewrite(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("S", 7), ("T", 9)], "symbol string, score int")
    for run in ("a", "b"):
        tables.commit_results(rows, path, run)
    tables.commit_results(rows.filter("score > 8"), path, "a")
    got = lambda: sorted((r.run_id, r.symbol) for r in tables.read_committed(spark, path).collect())
    assert got() == [("a", "T"), ("b", "S"), ("b", "T")]
    with pytest.raises(Exception, match="broken"):  # fails while it writes
        tables.commit_results(rows.withColumn("score", F.raise_error(F.lit("broken")).cast("int")), path, "b")
    tables.write_results(rows.limit(0), f"{path}/data/version=killed", "b")  # ends before the manifest
    assert got() == [("a", "T"), ("b", "S"), ("b", "T")]
    tables.drop_runs(spark, path, ["b"])
    assert got() == [("a", "T")] and tables.tidy_results(spark, path) >= 3 and got() == [("a", "T")]
    tables.commit_results(rows.limit(0), path, "a")
    assert got() == []


def test_files_of_both_versions(spark, tmp_path):
    path = str(tmp_path / "results")
    old = spark.createDataFrame([("A", 11.5)], "symbol string, pe_ratio double")
    new = spark.createDataFrame([("B", 7, True), ("C", 5, None)], "symbol string, score int, earnings_flag boolean")
    old.write.parquet(path)
    assert tables.read_evolved_results(spark, path).first().earnings_flag is False
    new.write.mode("append").parquet(path)
    show = lambda df: sorted(map(str, df.select("symbol", "pe_ratio", "score", "earnings_flag").collect()))
    assert show(tables.read_evolved_results(spark, path)) == show(tables.union_results(old, new))


def test_earnings_days_are_inclusive(spark):
    day = dt.datetime(2020, 1, 1)
    rows = spark.createDataFrame([(s, day) for s in "ABCDE"], "symbol string, ts timestamp")
    due = [("A", day), ("B", day + dt.timedelta(10)), ("C", day + dt.timedelta(11)), ("E", day + dt.timedelta(-1)), ("B", day)]
    earnings = spark.createDataFrame([(s, d.date()) for s, d in due], "symbol string, earnings_date date")
    got = scan.earnings_flag(rows, earnings, F.lit("2020-01-01").cast("date"))
    assert {r.symbol: r.earnings_flag for r in got.collect()} == {"A": True, "B": True, "C": False, "D": False, "E": False}


def test_universe_file_and_names(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("Company Name,Symbol,Series\n3M INDIA , MMM ,EQ\no'neil,ONE, EQ \nL&T,LT,BE\nX,XX,\n")
    got = tables.read_universe(spark, str(path)).orderBy("pos").collect()
    assert [(r.symbol, r.name, r.yf_symbol) for r in got] == [("MMM", "3M India", "MMM.NS"), ("ONE", "O'Neil", "ONE.NS")]
    path.write_text("Company Name,Industry,Symbol,ISIN Code\n" + "".join(f"name {k},x, S{k} ,I\n" for k in range(500)))
    got = tables.read_universe(spark, str(path)).collect()
    assert [(r.pos, r.symbol, r.name) for r in sorted(got)] == [(k, f"S{k}", f"Name {k}") for k in range(500)]
    names = spark.createDataFrame([("L&T o'neil",)], "n string").select(title_case(F.col("n"))).first()[0]
    assert names == "L&T O'Neil"


def test_cleaning(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("A", t, 1.0, 2.0, 0.5, 1.5, 10.0), ("A", t, 1.0, 2.0, 0.5, 1.5, 11.0), ("B", t, None, None, None, None, None), ("C", t, float("nan"), 2.0, 1.0, 1.0, 1.0)]
    got = {r.symbol: r for r in bars.clean_bars(spark.createDataFrame(rows, tables.BARS)).collect()}
    assert set(got) == {"A", "C"} and got["A"].volume == 11.0 and got["C"].open is None


def test_read_bars_cleans_and_filters(spark, tmp_path):
    t, path = dt.datetime(2020, 1, 10), str(tmp_path / "bars")
    rows = [("A.NS", t, 1.0, 2.0, 0.5, 1.5, 10.0), ("A.NS", t, 1.0, 2.0, 0.5, 1.5, 11.0), ("A.NS", t - dt.timedelta(1), float("nan"), 2.0, 1.0, 1.0, 1.0), ("A.NS", t - dt.timedelta(2), *[None] * 5), ("A.NS", t - dt.timedelta(40), *[1.0] * 5), ("A.NS", t + dt.timedelta(1), *[1.0] * 5), ("B.NS", t, *[1.0] * 5)]
    spark.createDataFrame(rows, tables.BARS).write.parquet(path)
    got = tables.read_bars(spark, path, spark.createDataFrame([("A",)], "symbol string"), "2020-01-10", 30)
    assert [(r.symbol, r.ts.day, r.open, r.volume) for r in got.orderBy("ts").collect()] == [("A", 9, None, 1.0), ("A", 10, 1.0, 11.0)]
    assert tables.read_bars(spark, path, None).count() == 5
    newest = [("A", t, 9.0, 9.0, 9.0, 9.0, 9.0, 1), ("A", t, 1.0, 1.0, 1.0, 1.0, 1.0, 2)]
    assert bars.clean_bars(spark.createDataFrame(newest, tables.BARS + ", batch long"), F.col("batch")).first().volume == 1.0


def test_plain_symbols(spark):
    df = spark.createDataFrame([("A.NS",), ("B",), ("C.NS.NS",)], "s string")
    assert [r[0] for r in df.select(plain_symbol(F.col("s"))).collect()] == ["A", "B", "C"]


def test_strength_without_benchmark_rows(spark):
    """No bar of the benchmark: absolute strength. A benchmark too short for any window: no score."""
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(k) for k in range(30)]
    rows = [(s, d, *[100.0 + k * step] * 4, 1e6) for s, step in (("A", 1.0), ("B", 2.0), ("C", -1.0)) for k, d in enumerate(days)]
    names = spark.createDataFrame([(k, s, s) for k, s in enumerate("ABC")], "pos int, symbol string, name string")
    own, short = spark.createDataFrame(rows, tables.BARS), spark.createDataFrame([("^NSEI", days[-1], *[5.0] * 5)], tables.BARS)
    s = Settings(min_turnover=1.0)
    ranks = lambda bars, b: {r.symbol: r.rs_rank for r in scan.judged(bars, names, "2020-01-30", s, b).collect()}
    want = ranks(own, False)
    assert want == {"B": 100.0, "A": 66.7, "C": 33.3} and ranks(own, True) == ranks(own, short.limit(0)) == want
    assert ranks(own.union(short), True) == ranks(own, short) == {"A": None, "B": None, "C": None}
    history = lambda b: strength.strength(strength.returns(own, s), None if b is None else strength.returns(b, s).drop("symbol"), "ts", settings=s).count()
    assert history(None) == history(short.limit(0)) == 27 and history(short) == 24


def test_scan_reads_its_bars_once(spark):
    """One scan of the bars and one of the benchmark's; as-of and all-bar scans alike, also after a query that writes results."""
    queries.QUERIES["run_status"](spark, DATA).collect()
    for name in ("scan_asof", "scan_history"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") <= 2 and plan.count("Exchange hashpartitioning") <= 9, name


def test_tasks_of_indicators_keep_their_size(spark, monkeypatch):
    """Twice the rows are dealt over twice the tasks, whatever Spark would put together; more than one core has work."""
    monkeypatch.setattr(bars, "TASK_ROWS", 500)
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    for name in ("setups", "trades", "v1_signals", "ema_blocks", "scan_history"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert f", {math.ceil(n / 500)}), REPARTITION_BY_NUM" in plan, name
    assert bars.parts_of(spark, 1) == spark.sparkContext.defaultParallelism and bars.parts_of(spark, 10_000) == 20


def test_ticks_are_dealt_out_before_they_are_sorted(spark, monkeypatch):
    """What a task sorts for bars goes by the number of ticks, not by the split of the file that it reads."""
    monkeypatch.setattr(queries, "TASK_TICKS", 500)
    n = math.ceil(spark.read.parquet(f"{DATA}/lineitem.parquet").count() / 500)
    for name in ("trades", "expectancy", "bars_weekly", "scan_history", "scan_asof", "wide_to_long"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        scans = plan.count("lineitem.parquet")
        assert len(re.findall(rf"Exchange hashpartitioning\((symbol#\d+, _ts#\d+|l_orderkey#\d+L), {n}\), REPARTITION_BY_NUM", plan)) == scans > 0, name


def test_dealt_ticks_make_the_same_bars(spark):
    """Ties of time, and prices that are not there."""
    draw = random.Random(5)
    rows = [(draw.choice("ABC"), dt.datetime(2020, 1, draw.randint(1, 20)), draw.choice([None, float(draw.randint(1, 99))]), float(draw.randint(1, 9)), k) for k in range(500)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double, k int").repartition(3)
    show = lambda df: sorted(map(str, df.select("symbol", "ts", *bars.FIELDS).collect()))
    for unit in ("day", "week"):
        assert show(bars.resample_ticks(ticks, unit, ["ts", "k"], 7)) == show(bars.resample_ticks(ticks, unit, ["ts", "k"]))


def test_rows_that_cannot_pass_meet_by_time_as_few_columns(spark, monkeypatch):
    """All liquid rows compete at a time, in tasks by their number; what is shown of a row goes along if it can pass."""
    monkeypatch.setattr(bars, "TASK_ROWS", 500)
    n = math.ceil(spark.read.parquet(f"{DATA}/lineitem.parquet").count() / 500)
    for name in ("scan_history", "scan_history_benchmark_missing", "rs_rank"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"Exchange hashpartitioning\(_?ts#\d+, {n}\), REPARTITION_BY_NUM", plan), name
    ranked = strength.rank

    def narrow(rows, *by, **how):
        if by:
            kept, all_of = rows.filter("_row is not null").count(), rows.count()
            assert 0 < kept < all_of / 5 and set(rows.columns) == {"ts", "ret21", "ret63", "ret126", "_row", "rs_score"}
        return ranked(rows, *by, **how)

    monkeypatch.setattr(strength, "rank", narrow)
    queries.QUERIES["scan_history"](spark, DATA)


def test_runs_and_results(spark, tmp_path):
    at = lambda h: dt.datetime(2020, 1, 1, h)
    events = str(tmp_path / "runs")
    for e in (dict(id="a", status="running", started_at=at(1), event_ts=at(1)), dict(id="a", status="done", passed=2, finished_at=at(2), event_ts=at(2)), dict(id="b", status="running", event_ts=at(3)), dict(id="b", status="error", error="x", event_ts=at(4))):
        tables.write_run_event(spark, events, **e)
    runs = tables.current_runs(spark.read.parquet(events))
    assert {(r.id, r.status) for r in runs.collect()} == {("a", "done"), ("b", "error")}
    assert serving.run_status(runs, "a").first()["scanned"] == 0 and serving.run_status(runs, "c").count() == 0
    results = str(tmp_path / "results")
    rows = spark.createDataFrame([("S", 7), ("T", 9)], "symbol string, score int")
    for _ in range(2):  # played again
        tables.write_results(rows, results, "a")
    tables.write_results(rows, results, "gone")
    tables.write_results(rows, results, "2020:01")
    assert spark.read.parquet(results).filter("run_id = '2020:01'").count() == 2
    tables.write_results(rows.limit(0), results, "2020:01")  # nothing found this time
    stored = spark.read.parquet(results)
    assert stored.filter("run_id = '2020:01'").count() == 0
    assert [r.symbol for r in serving.latest_results(runs, stored).collect()] == ["T", "S"]
    assert serving.results_of_runs(stored, runs).count() == 2
    with pytest.raises(ValueError):
        scan.rank_results(stored, "run_id")


def test_signals_as_text(spark):
    rows = spark.createDataFrame([("A", ["breakout"]), ("B", []), ("C", None)], "symbol string, signals_triggered array<string>")
    text = tables.results_to_text(rows)
    assert [r.signals_triggered for r in text.orderBy("symbol").collect()] == ['["breakout"]', "[]", None]
    assert tables.results_from_text(text).collect() == rows.collect()


def test_index_snapshot_serves_a_ticker_twice(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("^CNXFIN", t, 1.0, 1.0, 1.0, 8.0, 1.0), ("^CNXFIN", t + dt.timedelta(1), 1.0, 1.0, 1.0, 10.0, 1.0)]
    got = {r.sector: r for r in serving.index_snapshot(spark.createDataFrame(rows, tables.BARS), tables.sectors(spark)).collect()}
    assert len(got) == 12 and got["Fin Nifty"].pct_change == got["Financial Services"].pct_change == 25.0
    assert got["Sensex"].price is None


def test_promoter_default(spark):
    rows = spark.createDataFrame([("A",), ("B",)], "symbol string")
    held = spark.createDataFrame([("A", 10.0, "up")], "symbol string, promoter_holding double, promoter_trend string")
    assert {r.symbol: r.promoter_trend for r in legacy.promoter(rows, held).collect()} == {"A": "up", "B": "unknown"}


def test_one_exchange_for_stored_bars(spark):
    """From bars, indicators and setups share one exchange by symbol."""
    df = spark.createDataFrame(pd.DataFrame({"symbol": ["A"], "ts": [dt.datetime(2020, 1, 1)], "open": [1.0], "high": [1.0], "low": [1.0], "close": [1.0], "volume": [1.0]}))
    plan = scan.signals(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
