"""Long symbols in blocks: rows are numbered without a window over a whole symbol, each block of rows gets the rows that
lead in to it, and running sums go from block to block through a small table.

Inside `in_blocks` a row's symbol is a struct of symbol, block and the symbol's last block, so that every function with
windows by symbol works on one block with its lead-in. Windows that look back by the lead-in or less are exact there.
What looks back without an end is a sum, which `running` carries over.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Powers beyond this many e-folds leave the range of doubles.
FOLDS = 690.0
#: First rows of a lead-in, in which values made of the row before are not there yet.
GUARD = 2


@dataclass(frozen=True)
class Blocks:
    """`rows` of a block, `lead` rows that lead in to it, and the `unit` of time whose rows of a symbol are numbered together.

    `parts`: over how many tasks blocks are dealt where they are shuffled for windows; None leaves it to Spark.
    """

    rows: int = 100_000
    lead: int = 320
    unit: str = "day"
    parts: int | None = None

    def __post_init__(self) -> None:
        if self.rows < 1 or self.lead < GUARD:
            raise ValueError(f"a block has a row, and {GUARD} rows of lead-in, at least")

    @property
    def span(self) -> int:
        """Rows of a block in `in_blocks`: half a lead-in at least, so that a row is in four blocks at most."""
        return max(self.rows, self.lead // 2)


def cut(df: DataFrame) -> DataFrame:
    """`df` written once as a checkpoint in the shared folder, so that what reads it again does not compute it again and
    its rows survive lost executors. The folder is the one in spark.checkpoint.dir; local mode gets a scratch one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-cut-"))
    return df.checkpoint()


def unit_of(unit: str, ts: str | Column = "ts") -> Column:
    """A row's symbol and unit of time, as one struct: structs are equal where the same parts are null."""
    return F.struct("symbol", F.date_trunc(unit, ts).alias("unit"))


def numbered(bars: DataFrame, unit: str) -> DataFrame:
    """Add _g, the place of a row among its symbol's by ts, from 1, and _of, the number of the symbol's rows.

    Rows are counted per unit of time, a small table sums these counts up, and rows are numbered within their unit. Rows
    that have their `unit_of` in _u, and are dealt out by it, are not shuffled for that.
    """
    rows = bars if "_u" in bars.columns else bars.withColumn("_u", unit_of(unit))
    counts = rows.groupBy("_u").agg(F.count("*").alias("_n"))
    every = Window.partitionBy("_u.symbol")
    earlier = F.sum("_n").over(every.orderBy("_u.unit").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("_u").alias("_t"), F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_of"))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_u").orderBy("ts")))
    rows = rows.join(counts, F.col("_u") == F.col("_t"))
    return rows.withColumn("_g", F.col("_before") + F.col("_place")).drop("_u", "_t", "_before", "_place")


def in_blocks(bars: DataFrame, how: Blocks, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`build` over blocks with their lead-ins; the rows of the lead-ins go afterwards. `build` keeps the rows' columns.

    In it, _g is a row's number, _k its place in block and lead-in, and _lead tells lead-ins apart. The numbered rows are
    written once, each as one row and with bars alone: what `running` reads again begins there, and takes the columns
    that it needs. A row leads in to blocks that have rows of their own and to no others.
    """
    rows = cut(numbered(bars, how.unit))
    block = lambda g: F.floor((g - 1) / how.span)
    last = F.least(block(F.col("_g") + how.lead), block(F.col("_of")))
    rows = rows.withColumn("_b", F.explode(F.sequence(block(F.col("_g")), last)))
    rows = rows.withColumn("symbol", F.struct("symbol", F.col("_b").alias("block"), block(F.col("_of")).alias("last"))).drop("_b", "_of")
    rows = rows.repartition(how.parts, "symbol") if how.parts else rows
    first = F.col("symbol.block") * how.span
    out = build(rows.withColumns({"_k": F.col("_g") - first + how.lead, "_lead": F.col("_g") <= first}))
    return out.filter("not _lead").withColumn("symbol", F.col("symbol.symbol")).drop("_g", "_k", "_lead")


def decayed(y: Column, index: Column, fold: float, keys: list, order: Column | str, most: int) -> Column:
    """At each row the sum of y over rows of equal `keys` up to it, weighted by e^(-fold) for each step of `index` between.

    Where doubles can weigh all of `index`, which is `most` at most, it is one running sum, and sums of all folds share
    their window and its sort. Beyond that rows are weighed in groups: a row needs its own group's running sum and the
    group before, as older ones have decayed below a double's precision.
    """
    every = Window.partitionBy(*keys)
    if fold * most <= FOLDS:
        weight = F.exp(fold * index) if fold else F.lit(1.0)
        return F.coalesce(F.sum(y * weight).over(every.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) / weight
    size = max(1, int(FOLDS / 2 / fold))
    group, weight = F.floor(index / size), F.exp(fold * (index % size))
    own = Window.partitionBy(*keys, group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = every.orderBy(group).rangeBetween(-1, -1)
    return (F.coalesce(F.sum(y * weight).over(own), F.lit(0.0)) + math.exp(-fold * size) * F.coalesce(F.sum(y * weight).over(before), F.lit(0.0))) / weight


def running(df: DataFrame, how: Blocks, **of: tuple[Column, float]) -> DataFrame:
    """Inside `in_blocks`, add sums over all of a symbol's rows up to each: name=(y, fold), as `decayed` has them.

    Every block gives the sums over its first rows after the guard, as many as blocks are long, so that these segments
    meet without a gap; a row for each block goes into a table that sums them up, and each block adds what went before.
    Blocks that no other comes after, or whose segment ends before their symbol begins, give nothing; as that goes by
    `symbol` alone, which all windows are by, their rows are not even shuffled for the table.
    The table is written once, as its last block tells how its sums are weighed; the rows are not, as `in_blocks` has
    written what they are made of. A null y counts as nothing.
    """
    k, plain, block, end = F.col("_k") - GUARD, F.col("symbol.symbol"), F.col("symbol.block"), F.col("symbol.last")
    here = df.filter((block < end) & ((block + 1) * how.span + GUARD > how.lead) & k.between(1, how.span))
    sums = cut(here.groupBy("symbol").agg(*(F.sum(y * F.exp(-fold * (how.span - k))).alias(name) for name, (y, fold) in of.items())))
    most = sums.agg(F.max(block)).first()[0] or 0
    upto = [decayed(F.col(name), block, fold * how.span, [plain], block, most).alias(f"_in_{name}") for name, (_, fold) in of.items()]
    carry = sums.select(F.struct(plain.alias("symbol"), (block + 1).alias("block"), end.alias("last")).alias("_at"), *upto)
    carry = carry.repartition(how.parts, "_at") if how.parts else carry  # as the rows are
    df = df.join(carry, F.col("symbol") == F.col("_at"), "left")
    longest = how.span + how.lead
    seen = {name: F.when(k >= 1, decayed(F.when(k >= 1, y), k, fold, ["symbol"], "ts", longest) + F.coalesce(f"_in_{name}", F.lit(0.0)) * F.exp(-fold * k)) for name, (y, fold) in of.items()}
    return df.withColumns(seen).drop("_at", *(f"_in_{name}" for name in of))


def ewm(df: DataFrame, how: Blocks, **of: tuple[Column, float, int]) -> DataFrame:
    """Inside `in_blocks`, the exponentially weighted means of `windows.with_ewm`."""
    sums = {}
    for name, (x, alpha, _) in of.items():
        fold, known = -math.log1p(-alpha), F.when(x.isNotNull(), 1.0)
        sums |= {f"_x_{name}": (x, fold), f"_w_{name}": (known, fold), f"_n_{name}": (known, 0.0)}
    df = running(df, how, **sums)
    means = {name: F.when(F.col(f"_n_{name}") >= least, F.try_divide(F.col(f"_x_{name}"), F.col(f"_w_{name}"))) for name, (_, _, least) in of.items()}
    return df.withColumns(means).drop(*sums)
