"""Window helpers: one specification per symbol, full rolling windows, exponential averages, latest values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlewright.functions.blocks import FOLDS as _FOLDS
from candlewright.functions.blocks import Blocks, ewm


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def upto() -> WindowSpec:
    """All rows of the symbol up to this one."""
    return by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last `n` rows with this one."""
    return (w or by_symbol()).rowsBetween(1 - n, 0)


def full(agg: Callable[[Column], Column], x: Column, n: int) -> Column:
    """`agg` over the last `n` rows; null unless all of them have a value."""
    return F.when(F.count(x).over(trailing(n)) == n, agg(x).over(trailing(n)))


def back(column: str, k: int) -> Column:
    """`column` of the k-th row before this one among the symbol's rows that have it; it takes no sort of these rows."""
    return F.expr(f"lag({column}, {k}) ignore nulls over (partition by symbol order by ts)")


def near_sums(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The first step of `full_sums`, which may be taken earlier, where it shares a window with others: _near_{c}."""
    w = by_symbol()
    near = {f"_near_{c}": sum((F.lag(c, k).over(w) for k in range(1, math.isqrt(n))), F.col(c)) for c in columns}
    return df.withColumns(near)


def full_sums(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """Add _sum_{c} over the last `n` rows; null unless all of them have a value.

    A sliding window takes as many steps at a row as it is long. Here a row adds up about sqrt(n) rows, and as many of
    these sums further back.
    """
    df = near_sums(df, n, *(c for c in columns if f"_near_{c}" not in df.columns))
    w, size = by_symbol(), math.isqrt(n)
    whole = n - n % size
    far = lambda c: [*((f"_near_{c}", k) for k in range(size, whole, size)), *((c, k) for k in range(whole, n))]
    sums = {f"_sum_{c}": sum((F.lag(x, k).over(w) for x, k in far(c)), F.col(f"_near_{c}")) for c in columns}
    return df.withColumns(sums).drop(*(f"_near_{c}" for c in columns))


def extreme(df: DataFrame, n: int, **of: tuple[Callable, Callable, str]) -> DataFrame:
    """Add extremes over the last `n` rows: name=(F.max, F.greatest, column), or least ones.

    A sliding window takes as many steps at a row as it is long. Here it is a sixteenth of them, over a short window,
    whose extremes meet those of three windows further back, and these again of three.
    """
    width = max(1, -(-n // 16))
    df = df.withColumns({name: agg(column).over(trailing(width)) for name, (agg, _, column) in of.items()})
    while width < n:
        to = min(4 * width, n)
        back = [*range(width, to - width, width), to - width]
        df = df.withColumns({name: pick(name, *(F.lag(name, k).over(by_symbol()) for k in back)) for name, (_, pick, _) in of.items()})
        width = to
    return df


def latest(x: Column | str) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(x, ignorenulls=True).over(upto())


def with_ewm(df: DataFrame, long: bool | Blocks = False, **of: tuple[Column, float, int]) -> DataFrame:
    """Add exponentially weighted means: name=(x, alpha, least values).

    y_t is the sum of (1 - alpha)^(t - i) x_i over the sum of these weights, over rows i up to t whose x is not null; null
    until so many values were seen. Weights grow with the row number, so that one running sum serves all rows; a symbol
    with more rows than doubles can weigh raises an error. With `long`, rows are weighed in blocks: a row needs its own
    block's running sum and the block before, as older ones have decayed below a double's precision. That takes any
    length and one more sort. With `Blocks`, inside `in_blocks`, sums are carried from block to block.
    """
    if isinstance(long, Blocks):
        return ewm(df, long, **of)
    df = df.withColumn("_n", F.row_number().over(by_symbol()))
    out, extra = {}, {}
    for name, (x, alpha, least) in of.items():
        fold = -math.log1p(-alpha)
        enough = F.count(x).over(upto()) >= least
        if not long:
            row = F.when(F.col("_n") * fold > _FOLDS, F.raise_error(F.lit(f"too many rows of a symbol to weigh {name}: use long=True")).cast("int")).otherwise(F.col("_n"))
            weight = F.pow(F.lit(1 / (1 - alpha)), row)
            out[name] = F.when(enough, F.sum(x * weight).over(upto()) / F.sum(F.when(x.isNotNull(), weight)).over(upto()))
            continue
        size = int(_FOLDS / 2 / fold)
        block, place = F.floor(F.col("_n") / size), F.col("_n") % size
        extra[f"_b_{name}"] = block
        weight = F.pow(F.lit(1 / (1 - alpha)), place)
        own = Window.partitionBy("symbol", f"_b_{name}").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("symbol").orderBy(f"_b_{name}").rangeBetween(-1, -1)

        def total(y: Column, own=own, before=before, decay=math.exp(-fold * size)) -> Column:
            return F.coalesce(F.sum(y).over(own), F.lit(0.0)) + decay * F.coalesce(F.sum(y).over(before), F.lit(0.0))

        out[name] = F.when(enough, F.try_divide(total(x * weight), total(F.when(x.isNotNull(), weight))))
    return df.withColumns(extra).withColumns(out).drop("_n", *extra)
