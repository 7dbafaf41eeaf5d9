"""Technical indicators as columns beside the bars. All read rows of the same symbol up to their own and no later ones.

Every function takes and returns a DataFrame with symbol, ts and bar columns; they share one window specification, so
that one exchange and one sort by symbol serve them all. Nulls stand for warm-up and for divisions by zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.blocks import Blocks, cut, numbered, running
from candlewright.functions.scalar import true_range, typical_price
from candlewright.functions.windows import by_symbol, extreme, full, full_sums, near_sums, trailing, upto, with_ewm

#: Rows of a side that was counted and is broadcast.
BROADCAST = 500_000
#: Columns of `_moves` that the directional index sums up.
MOVES = ("_tr", "_pdm", "_mdm")


def _ema(column: str, period: int) -> tuple:
    return F.col(column), 2 / (period + 1), period


def ema(df: DataFrame, *periods: int, column: str = "close", long: bool | Blocks = False) -> DataFrame:
    """ema{p} for each period; the first value is at row p."""
    return with_ewm(df, long, **{f"ema{p}": _ema(column, p) for p in periods})


def sma(df: DataFrame, period: int, column: str = "close") -> DataFrame:
    return df.withColumn(f"sma{period}", full(F.avg, F.col(column), period))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, long: bool | Blocks = False) -> DataFrame:
    """macd, macd_signal, macd_hist of the close."""
    df = with_ewm(df, long, _fast=_ema("close", fast), _slow=_ema("close", slow))
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = with_ewm(df, long, macd_signal=_ema("macd", signal))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def atr(df: DataFrame, period: int = 14, long: bool | Blocks = False) -> DataFrame:
    """atr{p}: the true range weighted with alpha 1 / (p + 1), from the second bar on."""
    df = df.withColumn("_tr", true_range(F.lag("close").over(by_symbol())))
    return with_ewm(df, long, **{f"atr{period}": (F.col("_tr"), 1 / (period + 1), 1)}).drop("_tr")


def rsi(df: DataFrame, period: int = 14, long: bool | Blocks = False) -> DataFrame:
    """rsi{p}; the first bar counts as neither gain nor loss. Without any change it is null."""
    change = F.col("close") - F.lag("close").over(by_symbol())
    df = df.withColumn("_ch", change)
    gain, loss = F.when(F.col("_ch") > 0, F.col("_ch")).otherwise(0.0), F.when(F.col("_ch") < 0, -F.col("_ch")).otherwise(0.0)
    df = with_ewm(df, long, _up=(gain, 1 / period, period), _down=(loss, 1 / period, period))
    return df.withColumn(f"rsi{period}", F.try_divide(100 * F.col("_up"), F.col("_up") + F.col("_down"))).drop("_ch", "_up", "_down")


def bollinger(df: DataFrame, period: int = 14, width: float = 2) -> DataFrame:
    """bb_middle, bb_upper, bb_lower, bb_bandwidth with the population's standard deviation."""
    df = df.withColumns({"bb_middle": full(F.avg, F.col("close"), period), "_sd": full(F.stddev_pop, F.col("close"), period)})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + width * F.col("_sd"), "bb_lower": F.col("bb_middle") - width * F.col("_sd")})
    return df.withColumn("bb_bandwidth", F.col("bb_upper") - F.col("bb_lower")).drop("_sd")


def band_ratio(df: DataFrame, period: int = 20) -> DataFrame:
    """bb_width: two standard deviations over the mean."""
    return df.withColumn("bb_width", F.try_divide(2 * full(F.stddev_pop, F.col("close"), period), full(F.avg, F.col("close"), period)))


def _moves(df: DataFrame) -> DataFrame:
    """Add _tr, _ch, _pdm, _mdm: true range, change of the close, and moves up and down, from the bar before."""
    w = by_symbol()
    df = df.withColumns({f"_before_{c}": F.lag(c).over(w) for c in ("close", "high", "low")})
    up, down = F.col("high") - F.col("_before_high"), F.col("_before_low") - F.col("low")
    df = df.withColumns({
        "_tr": true_range(F.col("_before_close")), "_ch": F.col("close") - F.col("_before_close"),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    return df.drop("_before_close", "_before_high", "_before_low")


def _directions(df: DataFrame, period: int) -> DataFrame:
    """plus_di, minus_di, adx from sums of `_moves`; these go."""
    df = df.withColumns({f"{n}_di": F.try_divide(100 * F.col(f"_sum_{c}"), F.col("_sum__tr")) for n, c in (("plus", "_pdm"), ("minus", "_mdm"))})
    df = df.withColumn("_dx", F.try_divide(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    df = full_sums(df, period, "_dx").withColumn("adx", F.col("_sum__dx") / period)
    return df.drop(*MOVES, *(f"_sum_{c}" for c in MOVES), "_ch", "_dx", "_sum__dx")


def adx(df: DataFrame, period: int = 20) -> DataFrame:
    """plus_di, minus_di, adx from plain rolling sums. Where both directions are 0 the index has no value."""
    return _directions(full_sums(_moves(df), period, *MOVES), period)


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    """stoch_k, stoch_d; a range of zero gives null."""
    low, high = full(F.min, F.col("low"), k), full(F.max, F.col("high"), k)
    df = df.withColumn("stoch_k", F.try_divide(100 * (F.col("close") - low), high - low))
    return df.withColumn("stoch_d", full(F.avg, F.col("stoch_k"), d))


def obv(df: DataFrame, long: bool | Blocks = False) -> DataFrame:
    """obv: the running sum of volume with the sign of the close's change; 0 where either is unknown."""
    df = df.withColumn("_s", F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_symbol())) * F.col("volume"), F.lit(0.0)))
    df = running(df, long, obv=(F.col("_s"), 0.0)) if isinstance(long, Blocks) else df.withColumn("obv", F.sum("_s").over(upto()))
    return df.drop("_s")


def vwap(df: DataFrame, period: int = 20) -> DataFrame:
    return df.withColumn("vwap", F.try_divide(full(F.sum, typical_price() * F.col("volume"), period), full(F.sum, F.col("volume"), period)))


def cci(df: DataFrame, period: int = 20) -> DataFrame:
    """cci; the deviation is the mean distance from the window's own mean. A deviation of zero gives null."""
    df = df.withColumn("_tp", typical_price())
    df = df.withColumns({"_ma": full(F.avg, F.col("_tp"), period), "_all": F.collect_list("_tp").over(trailing(period))})
    away = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_ma"))) / period
    # distances that are only noise of the mean count as zero
    away = F.when(away > 1e-9 * F.abs("_ma"), away)
    return df.withColumn("cci", F.try_divide(F.col("_tp") - F.col("_ma"), 0.015 * away)).drop("_tp", "_ma", "_all")


def year_range(df: DataFrame, bars: int = 252, least: int = 50) -> DataFrame:
    """year_high, year_low of the last `bars` rows, once there are `least`."""
    known = F.row_number().over(by_symbol()) >= least
    df = extreme(df, bars, year_high=(F.max, F.greatest, "high"), year_low=(F.min, F.least, "low"))
    return df.withColumns({c: F.when(known, F.col(c)) for c in ("year_high", "year_low")})


def bundle(df: DataFrame, long: bool | Blocks = False) -> DataFrame:
    """All indicators that the setups read: EMA 9/20/21/50/200, RSI, MACD histogram, ATR, ADX, band ratio, volume.

    Windows whose inputs are there at the same time stand next to each other, so that they share a pass over the rows.
    """
    df = full_sums(_means(_moves(df), long, *MOVES, "volume"), 20, *MOVES, "volume")
    return band_ratio(_directions(df.withColumn("vol_avg20", F.col("_sum_volume") / 20).drop("_sum_volume"), 20))


def _means(df: DataFrame, long: bool | Blocks, *summed: str) -> DataFrame:
    """The bundle's means from `_moves`, all that are made of bars alone in one pass; with the first step of sums of 20."""
    gain, loss = F.when(F.col("_ch") > 0, F.col("_ch")).otherwise(0.0), F.when(F.col("_ch") < 0, -F.col("_ch")).otherwise(0.0)
    means = {f"ema{p}": _ema("close", p) for p in (9, 20, 21, 50, 200)} | {"_fast": _ema("close", 12), "_slow": _ema("close", 26)}
    df = with_ewm(df, long, **means, atr14=(F.col("_tr"), 1 / 15, 1), _up=(gain, 1 / 14, 14), _down=(loss, 1 / 14, 14))
    df = near_sums(df, 20, *summed)
    df = df.withColumns({"macd": F.col("_fast") - F.col("_slow"), "rsi14": F.try_divide(100 * F.col("_up"), F.col("_up") + F.col("_down"))})
    df = with_ewm(df.drop("_fast", "_slow", "_up", "_down"), long, macd_signal=_ema("macd", 9))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def _sar(high: Sequence[float], low: Sequence[float], step: float, most: float, state: Sequence[float] | None = None) -> tuple[list[float], list[int], list[float]]:
    """Stops, signs, and the state after the last bar. The stop trails the extreme of the running trend, never nearer than
    the last two bars, and turns when crossed. `state` is that of the bar before: sign, stop, extreme, pace, two lows,
    two highs; without it the first bar begins."""
    stops, signs, begin = [], [], 0
    if state is None:
        state, begin = (1, low[0], high[0], step, low[0], low[0], high[0], high[0]), 1
        stops.append(low[0])
        signs.append(1)
    sign, stop, reach, pace, low1, low2, high1, high2 = state
    for h, lo in zip(high[begin:], low[begin:], strict=True):
        stop = stop + pace * (reach - stop)
        stop = min(stop, low1, low2) if sign > 0 else max(stop, high1, high2)
        crossed = lo < stop if sign > 0 else h > stop
        if crossed:
            sign, stop, pace = -sign, reach, step
            reach = h if sign > 0 else lo
        elif (best := h if sign > 0 else lo) * sign > reach * sign:
            reach, pace = best, min(pace + step, most)
        low1, low2, high1, high2 = lo, low1, h, high1
        stops.append(stop)
        signs.append(int(sign))
    return stops, signs, [float(x) for x in (sign, stop, reach, pace, low1, low2, high1, high2)]


def parabolic_sar(df: DataFrame, step: float = 0.02, most: float = 0.2, long: Blocks | None = None) -> DataFrame:
    """sar and sar_trend (1 up, -1 down). The fold is sequential, so each symbol's bars go through Python once; with
    `Blocks`, a block at a time, see `_sar_in_blocks`."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    if long:
        return _sar_in_blocks(df, step, most, long, types)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        stops, signs, _ = _sar(rows["high"].tolist(), rows["low"].tolist(), step, most)
        return rows.assign(sar=stops, sar_trend=signs)

    return df.groupBy("symbol").applyInPandas(fold, f"{types}, sar double, sar_trend int")


def _sar_in_blocks(df: DataFrame, step: float, most: float, how: Blocks, types: str) -> DataFrame:
    """The same by speculation: each block is folded from the state that its lead-in gives when it is begun afresh.

    Trends turn again and again, and what went before is forgotten in a few turns, so that most guesses are right to the
    last bit. A block whose guess differs from the state in which the block before ended is folded again from that
    state, until all agree: the first block needs no guess, so that each round makes one block more of a symbol right
    at least. The states are a row for each block; the rows are folded once more at the end, from the right states.
    """
    rows = numbered(df, how.unit).drop("_of").withColumn("_b", F.floor((F.col("_g") - 1) / how.rows))
    rows = cut(rows)
    lead = rows.withColumn("_b", F.explode(F.sequence(F.col("_b") + 1, F.floor((F.col("_g") - 1 + how.lead) / how.rows)))) if how.lead >= how.rows else rows.filter((F.col("_g") - 1) % how.rows >= how.rows - how.lead).withColumn("_b", F.col("_b") + 1)
    bars = lambda rows, own: rows.select("symbol", "_b", "_g", "high", "low", F.lit(own).alias("own"))
    state = "symbol string, _b long, entry array<double>, exit array<double>"

    def guess(part: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        high, low, leads = part["high"].tolist(), part["low"].tolist(), np.cumsum([0, *~part["own"]])
        states = []
        for i, j in pairwise([*starts, len(part)]):
            k = i + int(leads[j] - leads[i])  # lead-ins come first
            if k == j:
                continue
            entry = _sar(high[i:k], low[i:k], step, most)[2] if k > i else None
            states.append((part["symbol"].iat[i], part["_b"].iat[i], entry, _sar(high[k:j], low[k:j], step, most, entry)[2]))
        return pd.DataFrame(states, columns=["symbol", "_b", "entry", "exit"])

    def again(part: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        high, low, states = part["high"].tolist(), part["low"].tolist(), []
        for i, j in pairwise([*starts, len(part)]):
            entry = part["entry"].iat[i]
            states.append((part["symbol"].iat[i], part["_b"].iat[i], entry, _sar(high[i:j], low[i:j], step, most, entry)[2]))
        return pd.DataFrame(states, columns=["symbol", "_b", "entry", "exit"])

    def fold(part: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        high, low, stops, signs = part["high"].tolist(), part["low"].tolist(), [], []
        for i, j in pairwise([*starts, len(part)]):
            got = _sar(high[i:j], low[i:j], step, most, part["entry"].iat[i])
            stops += got[0]
            signs += got[1]
        return part.drop(columns=["_b", "_g", "entry"]).assign(sar=stops, sar_trend=signs)

    states = cut(_by_block(bars(rows, True).unionByName(bars(lead, False)), guess, state, how))
    while True:
        before = F.lag("exit").over(Window.partitionBy("symbol").orderBy("_b"))
        right = states.withColumn("before", before)
        wrong = cut(right.filter("before is not null and not (entry <=> before)").select("symbol", "_b", F.col("before").alias("entry")))
        n = wrong.count()
        if not n:
            break
        wrong = F.broadcast(wrong) if n <= BROADCAST else wrong
        redone = _by_block(bars(rows, True).join(wrong, ["symbol", "_b"]), again, state, how)
        states = cut(states.join(wrong, ["symbol", "_b"], "left_anti").unionByName(redone))

    both = rows.join(states.select("symbol", "_b", "entry"), ["symbol", "_b"]).select(*df.columns, "_b", "_g", "entry")
    return _by_block(both, fold, f"{types}, sar double, sar_trend int", how)


def _by_block(rows: DataFrame, fold: Callable[[pd.DataFrame, list[int]], pd.DataFrame], types: str, how: Blocks) -> DataFrame:
    """`fold` over all rows of some blocks, in order, and where each block starts. A call takes the whole blocks of an Arrow
    batch, as short ones would each need a call and frames of their own; the last one waits for the rest of its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def starts(part: pd.DataFrame) -> list[int]:
            symbol, block = part["symbol"].to_numpy(), part["_b"].to_numpy()
            return [0, *(np.flatnonzero((symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]

        for batch in batches:
            if not len(batch):
                continue
            ends = rest[-1] if rest else batch
            at = starts(batch)
            goes_on = ends["symbol"].iat[-1] == batch["symbol"].iat[0] and ends["_b"].iat[-1] == batch["_b"].iat[0]
            if rest and goes_on and len(at) == 1:
                rest.append(batch)
                continue
            part = pd.concat([*rest, batch], ignore_index=True)
            at = starts(part)
            if len(at) > 1:
                yield fold(part.iloc[: at[-1]], at[:-1])
            rest = [part.iloc[at[-1] :]]
        if rest:
            part = pd.concat(rest, ignore_index=True)
            yield fold(part, starts(part))

    dealt = rows.repartition(how.parts, "symbol", "_b") if how.parts else rows.repartition("symbol", "_b")
    return dealt.sortWithinPartitions("symbol", "_b", "_g").mapInPandas(run, types)


def exact_ewm(df: DataFrame, out: str, column: str, alpha: float, least: int) -> DataFrame:
    """The same mean as `with_ewm` by the pandas recursion, for histories of any length."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        return rows.assign(**{out: rows[column].ewm(alpha=alpha, min_periods=least, adjust=True, ignore_na=False).mean()})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy("symbol").applyInPandas(fold, f"{types}, `{out}` double")
