"""Trend filter, setup archetypes, risk levels and score, at every bar.

A detector looks at positions among complete rows: those where all columns that it needs have values. It keeps what it
needs of a complete row in one column that other rows lack, looks back by rows that have it, and each bar takes the
verdict of the last complete row up to it. So all windows are by symbol and time, and complete rows take no sort of
their own; detectors that are asked together share their windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.scalar import half_up, rounded
from candlewright.functions.settings import DEFAULTS, Settings
from candlewright.functions.windows import back, by_symbol, full_sums, latest, near_sums, upto

#: In order of priority.
ARCHETYPES = ("breakout", "pullback", "continuation")
LABELS = ("breakout", "pullback", "trend_continuation")

#: Columns of the detectors' complete rows, and the most complete rows that one of them looks at.
COMPLETE = (
    ("close", "ema20", "ema50", "adx"), ("high", "low", "close", "volume", "vol_avg20"), ("close", "low", "ema20", "volume", "vol_avg20"),
    ("ema9", "ema21", "volume", "vol_avg20", "macd_hist"),
)
LOOK_BACK = 50
#: Columns whose latest values the trend, risk and results read.
LATEST = ("close", "atr14", "ema200", "vol_avg20", "adx")


def complete(*columns: str) -> Column:
    """Whether a row has all columns."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


@dataclass(frozen=True)
class Detector:
    """`kept` of rows that have all `columns` is in the column _`name`, and the row's place among them in _`name`_n.

    `steps` are columns made one after the other, in turn with windows and without; `verdict` is a struct.
    """

    name: str
    columns: tuple[str, ...]
    kept: Column
    verdict: Column
    steps: list[dict[str, Column]] = field(default_factory=list)


def _judged(df: DataFrame, *detectors: Detector, carried: Sequence[str] = ()) -> DataFrame:
    """Add each detector's verdict at the last complete row, under its name, and _last_{c} of columns `carried` on."""
    df = df.withColumns({f"_{d.name}": F.when(complete(*d.columns), d.kept) for d in detectors})
    helpers = [f"_{d.name}{end}" for d in detectors for end in ("", "_n", "_v")]
    places = {f"_{d.name}_n": F.count(f"_{d.name}").over(upto()) for d in detectors}
    for made in zip_longest(*(d.steps for d in detectors), fillvalue={}):
        step = {name: column for columns in made for name, column in columns.items()}
        helpers += step
        df, places = df.withColumns(places | step), {}
    df = df.withColumns({f"_{d.name}_v": F.when(F.col(f"_{d.name}").isNotNull(), d.verdict) for d in detectors})
    last = {d.name: latest(f"_{d.name}_v") for d in detectors}
    return df.withColumns(last | _latest(df, *carried)).drop(*helpers)


def _latest(df: DataFrame, *columns: str) -> dict[str, Column]:
    """_last_{c} for those that are not there yet."""
    return {f"_last_{c}": latest(c) for c in columns if f"_last_{c}" not in df.columns}


def _bool(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _trend() -> Detector:
    point = lambda test: _bool(test).cast("int")
    stacked = point((F.col("close") > F.col("ema20")) & (F.col("ema20") > F.col("ema50")))
    score = stacked + point(F.col("ema50") > F.col("_trend_5")) + point(F.col("adx") > 20)
    verdict = F.struct((F.col("_trend_n") >= 6).alias("known"), score.alias("score"), F.col("close").alias("close"))
    return Detector("trend", COMPLETE[0], F.col("ema50"), verdict, [{"_trend_5": back("_trend", 5)}])


def _scored(df: DataFrame) -> DataFrame:
    under = _bool(F.col("trend.close") < F.col("_last_ema200")).cast("int")
    score = F.when(F.col("trend.known"), F.greatest(F.col("trend.score") - under, F.lit(0))).otherwise(0)
    return df.withColumn("trend_score", score).drop("trend").withColumn("trend_ok", F.col("trend_score") >= 2)


def trend(df: DataFrame) -> DataFrame:
    """trend_score 0 to 3 and trend_ok (at least 2).

    A point each for close > EMA20 > EMA50, for EMA50 above its value five complete rows ago, and for ADX over 20; one
    off, not below 0, if the close is under the latest EMA200, where there is one. Needs six complete rows.
    """
    own = _latest(df, "ema200")
    return _scored(_judged(df, _trend(), carried=["ema200"])).drop(*own)


def _breakout() -> Detector:
    def over(column: str, *offsets: int) -> Column:
        rows = [F.col(column), *(F.col(f"{column}_{k}") for k in offsets)]
        volume = sum((r["volume"] for r in rows[1:]), rows[0]["volume"])
        return F.when(F.col(column).isNotNull(), F.struct(F.greatest(*(r["high"] for r in rows)).alias("high"), F.least(*(r["low"] for r in rows)).alias("low"), volume.alias("volume")))

    steps = [  # four rows, twenty of them, and the twenty up to the row before and the twenty before these
        {f"_breakout_{k}": back("_breakout", k) for k in (1, 2, 3)}, {"_breakout_four": over("_breakout", 1, 2, 3)},
        {f"_breakout_four_{k}": back("_breakout_four", k) for k in (4, 8, 12, 16)}, {"_breakout_all": over("_breakout_four", 4, 8, 12, 16)},
        {"_breakout_one": back("_breakout_all", 21), "_breakout_two": back("_breakout_all", 1)},
    ]
    one, two = F.col("_breakout_one"), F.col("_breakout_two")
    range1, range2, volume1, volume2 = one["high"] - one["low"], two["high"] - two["low"], one["volume"] / 20, two["volume"] / 20
    tight = (range1 != 0) & (range2 < range1 * 0.80) & (volume1 != 0) & (volume2 < volume1 * 0.90)
    broke = (F.col("close") > two["high"]) & (F.col("vol_avg20") > 0) & (F.col("volume") > 1.5 * F.col("vol_avg20"))
    fired = (F.col("_breakout_n") >= 50) & tight & broke
    return Detector("breakout", COMPLETE[1], F.struct("high", "low", "volume"), _verdict(fired, two["high"]), steps)


def breakout(df: DataFrame) -> DataFrame:
    """breakout, breakout_pivot: a base of 40 rows whose second half is tighter on less volume, then a close above it.

    The second half's range is under 0.8 of the first's and its mean volume under 0.9; the pivot is its high; today
    closes above that on more than 1.5 times the average volume. Needs 50 complete rows.
    """
    return _fired(_judged(df, _breakout()), "breakout")


def _pullback() -> Detector:
    before = {k: F.col(f"_pullback_{k}") for k in range(1, 6)}
    touched = F.greatest(*(row["touch"] for row in before.values()))
    quiet = (before[1]["volume"] + before[2]["volume"] + before[3]["volume"]) / 3
    loud = (F.col("vol_avg20") > 0) & (quiet >= F.col("vol_avg20") * 0.85)
    fired = (F.col("_pullback_n") >= 10) & (F.col("ema20") > before[5]["ema20"]) & touched & ~_bool(loud) & (F.col("close") > F.col("ema20"))
    kept = F.struct((F.col("low") <= F.col("ema20") * 1.02).alias("touch"), "volume", "ema20")
    return Detector("pullback", COMPLETE[2], kept, _verdict(fired, F.col("ema20")), [{f"_pullback_{k}": back("_pullback", k) for k in before}])


def pullback(df: DataFrame) -> DataFrame:
    """pullback, pullback_pivot: a dip to a rising EMA20 on low volume, and a close above it again.

    EMA20 is above its value five rows ago; one of the five rows before has a low within 2% of its EMA20 or below;
    the three rows before have under 0.85 of the average volume, unless that is 0. Needs ten complete rows.
    """
    return _fired(_judged(df, _pullback()), "pullback")


def _continuation(bars: int = 5, momentum: bool = True) -> Detector:
    one = F.col("_continuation_1")
    crossed = (one["ema9"] <= one["ema21"]) & (F.col("ema9") > F.col("ema21"))
    strong = (F.col("vol_avg20") > 0) & (F.col("volume") > 1.5 * F.col("vol_avg20"))
    crosses = F.when(F.col("_continuation").isNotNull(), F.struct(F.when(crossed & strong, F.col("ema21")).alias("at")))
    steps = [{"_continuation_1": back("_continuation", 1)}, {"_continuation_x": crosses}, {f"_continuation_x{k}": back("_continuation_x", k) for k in range(1, bars)}]
    oldest = F.coalesce(*(F.col(f"_continuation_x{k}")["at"] for k in reversed(range(1, bars))), F.col("_continuation_x")["at"])
    fired = (F.col("_continuation_n") > bars) & oldest.isNotNull()
    columns = COMPLETE[3] if momentum else COMPLETE[3][:-1]
    return Detector("continuation", columns, F.struct("ema9", "ema21"), _verdict(fired & (F.col("macd_hist") > 0) if momentum else fired, oldest), steps)


def continuation(df: DataFrame, bars: int = 5, momentum: bool = True) -> DataFrame:
    """continuation, continuation_pivot: EMA9 crossed above EMA21 within `bars` rows on high volume, MACD histogram > 0.

    The pivot is EMA21 at the oldest such cross. Needs one complete row more than `bars`.
    """
    return _fired(_judged(df, _continuation(bars, momentum)), "continuation")


def _verdict(fired: Column, pivot: Column) -> Column:
    fired = _bool(fired)
    return F.struct(fired.alias("fired"), F.when(fired, pivot).alias("pivot"))


def _fired(df: DataFrame, *names: str) -> DataFrame:
    df = df.withColumnsRenamed({name: f"_f_{name}" for name in names})
    shown = {name: _bool(F.col(f"_f_{name}.fired")) for name in names} | {f"{name}_pivot": F.col(f"_f_{name}.pivot") for name in names}
    return df.withColumns(shown).drop(*(f"_f_{name}" for name in names))


def _chosen(df: DataFrame) -> DataFrame:
    df = _fired(df, *ARCHETYPES)
    first = F.coalesce(*(F.when(F.col(a), F.struct(F.lit(name).alias("setup_type"), F.col(f"{a}_pivot").alias("pivot"))) for a, name in zip(ARCHETYPES, LABELS, strict=True)))
    count = sum((F.col(a).cast("int") for a in ARCHETYPES), F.lit(0))
    return df.withColumns({"n_signals": count, "_s": first}).withColumns({"setup_type": F.col("_s.setup_type"), "pivot": F.col("_s.pivot")}).drop("_s")


def setups(df: DataFrame) -> DataFrame:
    """The three archetypes, n_signals, and setup_type and pivot of the first that fired, by priority."""
    return _chosen(_judged(df, _breakout(), _pullback(), _continuation()))


def verdicts(df: DataFrame) -> DataFrame:
    """`trend` and `setups` together, in shared windows, and _last_{c} of LATEST for `risk` and `result_columns`."""
    return _chosen(_scored(_judged(df, _trend(), _breakout(), _pullback(), _continuation(), carried=LATEST)))


def risk(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """entry_pivot, stop, target, rr, atr, and risk_ok: the levels hold and the close is not too far above the pivot."""
    own = _latest(df, "atr14", "close")
    df = df.withColumns(own) if own else df
    df = df.withColumns({"_a": F.col("_last_atr14"), "_c": F.col("_last_close")})
    stop, target = F.col("pivot") - settings.stop_atr * F.col("_a"), F.col("pivot") + settings.target_atr * F.col("_a")
    rr = F.try_divide(target - F.col("pivot"), F.col("pivot") - stop)
    good = (F.col("pivot") > 0) & (F.col("_a") > 0) & (F.col("_c") <= F.col("pivot") + settings.extended_atr * F.col("_a")) & (rr >= settings.min_rr)
    return df.withColumns({
        "entry_pivot": half_up("pivot", 2), "stop": half_up(stop, 2), "target": half_up(target, 2), "rr": half_up(rr, 2),
        "atr": half_up("_a", 2), "risk_ok": F.coalesce(good, F.lit(False)),
    }).drop("_a", "_c", *own)


def score(rs_rank: Column, trend_score: Column, rr: Column, setup_type: Column) -> Column:
    """1 to 10: relative strength up to 4 points, trend, setup and reward to risk up to 2 each."""
    strength = F.when(rs_rank >= 85, 4).when(rs_rank >= 70, 3).when(rs_rank >= 60, 2).otherwise(1)
    kind = F.when(setup_type.isin("breakout", "pullback"), 2).when(setup_type == "trend_continuation", 1).otherwise(0)
    reward = F.when(rr >= 2.5, 2).when(rr >= 1.5, 1).otherwise(0)
    return F.least(F.lit(10), F.greatest(F.lit(1), strength + F.least(trend_score, F.lit(2)) + kind + reward))


def turnover(df: DataFrame) -> DataFrame:
    """The first step of `liquidity`, which may be taken earlier, where it shares a window with others."""
    x = F.col("close") * F.col("volume")
    df = df.withColumns({"_turnover": F.coalesce(x, F.lit(0.0)), "_known": x.isNotNull().cast("int")})
    return near_sums(df, 20, "_turnover", "_known")


def liquidity(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """liquid: 20 bars or more, mean of close * volume over the last 20 and latest close above their floors."""
    df = df if "_turnover" in df.columns else turnover(df)
    df = full_sums(df, 20, "_turnover", "_known").withColumns({"_bars": F.row_number().over(by_symbol()), "_close": latest("close")})
    good = (F.col("_bars") >= 20) & (F.try_divide("_sum__turnover", "_sum__known") > settings.min_turnover) & (F.col("_close") > settings.min_price)
    return df.withColumn("liquid", _bool(good)).drop("_turnover", "_known", "_sum__turnover", "_sum__known", "_bars", "_close")


def qualified(settings: Settings = DEFAULTS) -> Column:
    """Some archetype fired, and two of them where relative strength is under the single-signal floor."""
    return F.col("setup_type").isNotNull() & (F.col("n_signals") >= F.when(F.col("rs_rank") < settings.rs_single, 2).otherwise(1))


def result_columns(df: DataFrame) -> DataFrame:
    """The shown figures: last_close, adx, year's range and turnover, rounded."""
    own = _latest(df, "close", "vol_avg20", "adx")
    df = df.withColumns(own) if own else df
    turnover = F.col("_last_close") * F.col("_last_vol_avg20")
    return df.withColumns({
        "last_close": rounded(F.col("_last_close"), 2), "adx_shown": rounded(F.col("_last_adx"), 1),
        "week52_high": rounded(F.col("year_high"), 2), "week52_low": rounded(F.col("year_low"), 2), "avg_turnover": rounded(turnover, 0),
    }).drop(*own)
