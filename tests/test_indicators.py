"""Indicators against plain pandas, on walks with and without holes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.functions import windows
from candlewright.operators import indicators as ind
from candlewright.sources.tables import BARS


def walk(n, seed=1, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    span = rng.uniform(0.1, 2, (2, n))
    ts = pd.date_range("2020-01-01", periods=n)
    return pd.DataFrame({"symbol": symbol, "ts": ts, "open": close, "high": close + span[0], "low": close - span[1], "close": close, "volume": rng.uniform(50, 150, n).round()})


def frame(spark, *parts):
    plain = lambda x: x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if isinstance(x, float) and np.isnan(x) else x
    rows = [tuple(map(plain, r)) for p in parts for r in p.itertuples(index=False)]
    return spark.createDataFrame(rows, BARS)


def values(df, *columns):
    return df.orderBy("symbol", "ts").select(*columns).toPandas().astype(float)


def same(got, want):
    np.testing.assert_allclose(got.to_numpy(), np.column_stack([np.asarray(w, float) for w in want]), rtol=1e-9, atol=1e-9)


def test_averages(spark):
    p = walk(260)
    got = values(ind.sma(ind.macd(ind.ema(frame(spark, p), 9, 200)), 20), "ema9", "ema200", "macd", "macd_signal", "macd_hist", "sma20")
    ewm = lambda x, s: x.ewm(span=s, min_periods=s).mean()
    macd = ewm(p.close, 12) - ewm(p.close, 26)
    same(got, [ewm(p.close, 9), ewm(p.close, 200), macd, ewm(macd, 9), macd - ewm(macd, 9), p.close.rolling(20).mean()])
    first = got.notna().to_numpy().argmax(axis=0)
    assert list(first) == [8, 199, 25, 33, 33, 19]


def test_holes_do_not_shift_weights(spark):
    p = walk(120)
    p.loc[[0, 30, 31, 77], "close"] = np.nan
    got = values(ind.ema(frame(spark, p), 9), "ema9")
    same(got, [p.close.ewm(span=9, min_periods=9).mean()])


def test_strength_and_range(spark):
    p = walk(260, 3)
    got = values(ind.rsi(ind.atr(frame(spark, p))), "rsi14", "atr14")
    d = p.close.diff()
    up, down = d.where(d > 0, 0.0).fillna(0), (-d).where(d < 0, 0.0).fillna(0)
    g, l_ = (x.ewm(alpha=1 / 14, min_periods=14).mean() for x in (up, down))
    tr = pd.concat([p.high - p.low, (p.high - p.close.shift()).abs(), (p.low - p.close.shift()).abs()], axis=1).max(axis=1, skipna=False)
    same(got, [100 * g / (g + l_), tr.ewm(com=14, min_periods=0).mean()])
    assert list(got.notna().to_numpy().argmax(axis=0)) == [13, 1]


def test_bands_direction_volume(spark):
    p = walk(120, 5)
    df = ind.cci(ind.vwap(ind.obv(ind.stochastic(ind.adx(ind.band_ratio(ind.bollinger(frame(spark, p))))))))
    got = values(df, "bb_upper", "bb_bandwidth", "bb_width", "plus_di", "adx", "stoch_k", "stoch_d", "obv", "vwap", "cci")
    sd, mid = p.close.rolling(14).std(ddof=0), p.close.rolling(14).mean()
    up, dn = p.high.diff(), -p.low.diff()
    plus, minus = np.where((up > dn) & (up > 0), up, 0.0), np.where((dn > up) & (dn > 0), dn, 0.0)
    tr = pd.concat([p.high - p.low, (p.high - p.close.shift()).abs(), (p.low - p.close.shift()).abs()], axis=1).max(axis=1, skipna=False)
    t = tr.rolling(20).sum()
    pdi, mdi = (100 * pd.Series(x).rolling(20).sum() / t for x in (plus, minus))
    adx = (100 * (pdi - mdi).abs() / (pdi + mdi)).rolling(20).mean()
    k = 100 * (p.close - p.low.rolling(14).min()) / (p.high.rolling(14).max() - p.low.rolling(14).min())
    tp = (p.high + p.low + p.close) / 3
    cci = (tp - tp.rolling(20).mean()) / (0.015 * tp.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True))
    same(got, [mid + 2 * sd, 4 * sd, p.close.rolling(20).std(ddof=0) * 2 / p.close.rolling(20).mean(), pdi, adx, k, k.rolling(3).mean(), (np.sign(p.close.diff()) * p.volume).fillna(0).cumsum(), (tp * p.volume).rolling(20).sum() / p.volume.rolling(20).sum(), cci])
    assert list(got[["plus_di", "adx"]].notna().to_numpy().argmax(axis=0)) == [20, 39]


def test_flat_prices_are_null_not_errors(spark):
    p = walk(60)
    for c in ("open", "high", "low", "close"):
        p[c] = 10.0
    p["volume"] = 0.0
    df = ind.cci(ind.vwap(ind.stochastic(ind.adx(ind.rsi(frame(spark, p))))))
    assert values(df, "rsi14", "stoch_k", "adx", "cci", "vwap").isna().all().all()


def test_rising_prices(spark):
    p = walk(60)
    p["close"] = np.arange(60) + 10.0
    assert np.allclose(values(ind.rsi(frame(spark, p)), "rsi14").dropna(), 100)


def test_long_histories(spark):
    p = walk(5000, 7)
    df = frame(spark, p)
    want = p.close.ewm(span=9, min_periods=9).mean()
    same(values(ind.ema(df, 9, long=True), "ema9"), [want])
    same(values(ind.exact_ewm(df, "e", "close", 0.2, 9), "e"), [want])
    with pytest.raises(Exception, match="long=True"):
        ind.ema(df, 9).agg(F.sum("ema9")).collect()


def test_sar_turns_both_ways(spark):
    close = np.concatenate([np.arange(100, 115), np.arange(114, 96, -1.5), np.arange(97, 112)]).astype(float)
    p = walk(len(close))
    p["high"], p["low"], p["close"] = close + 1, close - 1, close
    got = values(ind.parabolic_sar(frame(spark, p)), "sar", "sar_trend")
    assert set(got.sar_trend) == {1.0, -1.0} and np.abs(np.diff(got.sar_trend)).sum() == 4
    assert got.sar[0] == p.low[0] and (got.sar[got.sar_trend == 1] <= p.high[got.sar_trend == 1]).all()


def test_causal_and_independent_of_order(spark):
    p, q = walk(150, 11), walk(90, 12, "B")
    whole = ind.bundle(frame(spark, p, q).repartition(5)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    part = ind.bundle(frame(spark, p[:100], q[:100])).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    cut = pd.concat([whole[whole.symbol == "A"][:100], whole[whole.symbol == "B"]]).reset_index(drop=True)
    pd.testing.assert_frame_equal(part, cut, rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 252])
def test_extremes_of_short_windows_equal_the_sliding_one(spark, n):
    p = walk(400, 3)
    p.loc[[0, 5, 60, 61, 62], "high"] = np.nan
    df = frame(spark, p)
    got = windows.extreme(df, n, top=(F.max, F.greatest, "high"), bottom=(F.min, F.least, "low"))
    want = df.withColumns({"top": F.max("high").over(windows.trailing(n)), "bottom": F.min("low").over(windows.trailing(n))})
    pick = lambda rows: rows.select("ts", "top", "bottom").orderBy("ts").collect()
    assert pick(got) == pick(want)


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_sums_of_short_windows_equal_the_sliding_one(spark, n):
    p = walk(120, 3)
    p.loc[[0, 40, 41, 90], "volume"] = np.nan
    df = frame(spark, p)
    got = values(windows.full_sums(df, n, "volume"), "_sum_volume")
    same(got, [p.volume.rolling(n).sum()])
