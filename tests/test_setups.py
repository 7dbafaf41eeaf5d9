"""Detector branches and boundaries on series made by hand; indicator columns are given, not computed."""

import pytest
from pyspark.sql import functions as F

from candlewright.functions.settings import Settings
from candlewright.operators import setups
from candlewright.plans import scan

COLUMNS = "symbol string, ts timestamp, high double, low double, close double, volume double, vol_avg20 double, ema9 double, ema20 double, ema21 double, ema50 double, ema200 double, adx double, macd_hist double, atr14 double"


def rows(spark, n, **of):
    """n bars; each keyword is a value or a function of the bar's number."""
    base = dict(high=11.0, low=9.0, close=10.0, volume=100.0, vol_avg20=100.0, ema9=10.0, ema20=10.0, ema21=10.0, ema50=10.0, ema200=None, adx=10.0, macd_hist=1.0, atr14=1.0) | of
    names = [c.split()[0] for c in COLUMNS.split(", ")][2:]
    data = [("A", None, *(None if (v := base[c](k) if callable(base[c]) else base[c]) is None else float(v) for c in names)) for k in range(n)]
    df = spark.createDataFrame([(s, k, *r) for k, (s, _, *r) in enumerate(data)], COLUMNS.replace("ts timestamp", "k int"))
    return df.withColumn("ts", F.timestamp_seconds(F.col("k") * 86400)).drop("k")


def last(df, *columns):
    return tuple(df.orderBy(F.desc("ts")).select(*columns).first())


@pytest.mark.parametrize(("n", "of", "want"), [
    (5, {}, 0),
    (6, dict(close=12, ema20=11, ema50=lambda k: 10 + k / 10, adx=20.5), 3),
    (6, dict(close=12, ema20=11, ema50=lambda k: 10 + k / 10, adx=20.0), 2),
    (6, dict(close=12, ema20=11, ema50=lambda k: 10 + k / 10, adx=20.5, ema200=13), 2),
    (6, dict(close=9, ema200=13), 0),
])
def test_trend(spark, n, of, want):
    assert last(setups.trend(rows(spark, n, **of)), "trend_score", "trend_ok") == (want, want >= 2)


def test_trend_takes_the_last_complete_row(spark):
    df = rows(spark, 9, close=12, ema20=11, ema50=lambda k: 10 + k / 10, adx=lambda k: None if k == 8 else 25)
    assert last(setups.trend(df), "trend_score") == (3,)


def vcp(tight=0.79, dry=0.89, surge=1.51, over=0.01):
    """50 bars: a base of 20 wide and 20 tight ones, then today's."""
    base = lambda k: 9 <= k < 29
    return dict(
        high=lambda k: 20.0 if base(k) else 10 + 10 * tight if k < 49 else 30.0,
        low=10.0, volume=lambda k: 100.0 if k < 29 else 100 * dry if k < 49 else 100 * surge,
        close=lambda k: 12.0 if k < 49 else 10 + 10 * tight + over,
    )


@pytest.mark.parametrize(("of", "want"), [({}, True), ({"tight": 0.8}, False), ({"dry": 0.9}, False), ({"surge": 1.5}, False), ({"over": 0.0}, False)])
def test_breakout_boundaries(spark, of, want):
    fired, pivot = last(setups.breakout(rows(spark, 50, **vcp(**of))), "breakout", "breakout_pivot")
    assert fired is want and (pivot == pytest.approx(17.9) if want else pivot is None)
    assert last(setups.breakout(rows(spark, 49, **vcp(**of))), "breakout") == (False,)


def dip(touch=7, factor=1.02, quiet=0.84, average=100.0):
    return dict(
        ema20=lambda k: 10 + k / 100, close=12.0, vol_avg20=average, volume=lambda k: 100 * quiet if 6 <= k < 9 else 100.0,
        low=lambda k: (10 + k / 100) * factor if k == touch else 11.5,
    )


@pytest.mark.parametrize(("of", "want"), [({}, True), ({"touch": 4}, True), ({"touch": 3}, False), ({"factor": 1.021}, False), ({"quiet": 0.85}, False), ({"quiet": 5, "average": 0.0}, True)])
def test_pullback_boundaries(spark, of, want):
    fired, pivot = last(setups.pullback(rows(spark, 10, **dip(**of))), "pullback", "pullback_pivot")
    assert fired is want and pivot == (pytest.approx(10.09) if want else None)


def cross(*at, n=12):
    """EMA9 is above EMA21 on the bars `at` only; their volume is high."""
    return dict(ema9=lambda k: 11 if k in at else 9, ema21=lambda k: 10 + k / 1000, volume=lambda k: 151 if k in at else 100)


@pytest.mark.parametrize(("at", "want"), [((11,), 10.011), ((7,), 10.007), ((6,), None), ((8, 10), 10.008)])
def test_continuation_takes_the_oldest_cross(spark, at, want):
    fired, pivot = last(setups.continuation(rows(spark, 12, **cross(*at))), "continuation", "continuation_pivot")
    assert fired is (want is not None) and pivot == (None if want is None else pytest.approx(want))
    assert last(setups.continuation(rows(spark, 12, **cross(*at), macd_hist=0)), "continuation") == (False,)


def test_priority(spark):
    df = rows(spark, 50, **(dip() | vcp() | dict(ema20=lambda k: 10 + k / 100, low=10.0)))
    df = setups.setups(df)
    assert last(df, "setup_type", "breakout", "pullback") == ("breakout", True, True) or last(df, "setup_type", "breakout") == ("breakout", True)


@pytest.mark.parametrize(("close", "atr", "pivot", "ok"), [(11.0, 1.0, 10.0, True), (11.01, 1.0, 10.0, False), (10.0, 0.0, 10.0, False), (10.0, 1.0, 0.0, False), (10.0, None, 10.0, False)])
def test_risk(spark, close, atr, pivot, ok):
    df = setups.risk(rows(spark, 3, close=close, atr14=atr).withColumn("pivot", F.lit(pivot)))
    got = last(df, "risk_ok", "stop", "target", "rr")
    assert got[0] is ok
    if ok:
        assert got[1:] == (8.0, 13.0, 1.5)


@pytest.mark.parametrize(("rank", "trend", "rr", "kind", "want"), [(85, 3, 1.5, "breakout", 9), (84.9, 2, 1.5, "trend_continuation", 7), (60, 2, 2.5, "pullback", 8), (59, 0, 1.0, "x", 1)])
def test_score(spark, rank, trend, rr, kind, want):
    got = spark.range(1).select(setups.score(F.lit(rank), F.lit(trend), F.lit(rr), F.lit(kind))).first()[0]
    assert got == want


def test_liquidity_needs_twenty_bars_and_strict_floors(spark):
    s = Settings(min_turnover=1000.0, min_price=9.0)
    assert last(setups.liquidity(rows(spark, 20, volume=101), s), "liquid") == (True,)
    assert last(setups.liquidity(rows(spark, 19, volume=101), s), "liquid") == (False,)
    assert last(setups.liquidity(rows(spark, 20, volume=100), s), "liquid") == (False,)


def test_detectors_look_back_over_complete_rows_only(spark):
    """Bars without a value between complete rows change nothing, and their own verdict is that of the row before."""
    whole = dip() | vcp() | dict(ema20=lambda k: 10 + k / 100, low=10.0)
    holed = {c: (lambda k, f=f: (f(k - k // 3 - 1) if callable(f) else f) if k % 3 else None) for c, f in whole.items()}
    names = ("breakout", "breakout_pivot", "pullback", "pullback_pivot", "continuation", "continuation_pivot")
    for build in (setups.setups, setups.verdicts):
        want = [tuple(r) for r in build(rows(spark, 50, **whole)).orderBy("ts").select(*names).collect()]
        got = [tuple(r) for r in build(rows(spark, 75, **holed)).orderBy("ts").select(*names).collect()]
        assert got[1::3] == want[::2] and got[2::3] == want[1::2] and got[3::3] == got[2:-1:3] and any(w[0] for w in want)


def test_signals_sort_a_symbol_once(spark):
    """Complete rows had been sorted apart for each detector and back again, 12 sorts of ever wider rows in a task."""
    bars = rows(spark, 2).withColumn("open", F.col("close")).select("symbol", "ts", "open", "high", "low", "close", "volume")
    plan = scan.signals(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") <= 14
