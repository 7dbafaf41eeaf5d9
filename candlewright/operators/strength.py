"""Relative strength: look-back returns, a benchmark-relative composite, and its percentile across symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.blocks import cut
from candlewright.functions.ranges import with_places
from candlewright.functions.scalar import half_up
from candlewright.functions.settings import DEFAULTS, Settings
from candlewright.functions.windows import back, latest


def with_returns(bars: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ret{k}: the change over k closes that are there, carried to bars without a close."""
    offsets = sorted({k + more for k, _ in settings.lookbacks for more in (0, 1)})
    df = bars.withColumns({"_c": latest("close")} | {f"_c{k}": back("close", k) for k in offsets})
    before = lambda k: F.when(F.col("close").isNotNull(), F.col(f"_c{k}")).otherwise(F.col(f"_c{k + 1}"))
    return df.withColumns({f"ret{k}": F.try_divide("_c", before(k)) - 1 for k, _ in settings.lookbacks}).drop("_c", *(f"_c{k}" for k in offsets))


def returns(bars: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """symbol, ts and ret{k} of `with_returns`."""
    return with_returns(bars, settings).select("symbol", "ts", *(f"ret{k}" for k, _ in settings.lookbacks))


def composite(settings: Settings = DEFAULTS, benchmark: bool = True) -> Column:
    """Weighted mean of ret{k}, each over the size of bench{k} if there is a benchmark; windows without a value drop out."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for k, weight in settings.lookbacks:
        term = F.try_divide(F.col(f"ret{k}"), F.abs(F.col(f"bench{k}"))) if benchmark else F.col(f"ret{k}")
        total = total + F.coalesce(weight * term, F.lit(0.0))
        weights = weights + F.when(term.isNotNull(), weight).otherwise(0.0)
    return F.try_divide(total, weights)


def rank(rows: DataFrame, *by: str, among: Column | None = None, spread: bool = False) -> DataFrame:
    """rs_ratio (4 places) and rs_rank (1 place): the share of rows with a score of at most one's own, in percent.

    One row per symbol enters for each value of `by`; without `by` all rows meet in one task, a row per symbol. Rows
    without a score go; with `among`, all rows stay and only those it holds for, with a score, have a rank. `spread` is
    for many rows that compete with each other: distinct scores are counted first and dealt out by their size, so that
    no task sees them all and ties of any number are one row; rows are written once, as they are read twice.
    """
    if spread:
        return _spread_rank(rows, by, among)
    if among is None:
        rows = rows.filter("rs_score is not null")
        share = F.cume_dist().over(Window.partitionBy(*by).orderBy("rs_score"))
    else:
        ok = F.coalesce(among & F.col("rs_score").isNotNull(), F.lit(False))
        share = F.when(ok, F.cume_dist().over(Window.partitionBy(*by, ok).orderBy("rs_score")))
    return rows.withColumns({"rs_rank": half_up(share * 100, 1), "rs_ratio": half_up("rs_score", 4)})


def _spread_rank(rows: DataFrame, by: tuple[str, ...], among: Column | None) -> DataFrame:
    ok = F.coalesce((F.lit(True) if among is None else among) & F.col("rs_score").isNotNull(), F.lit(False))
    rows = cut(rows if among is not None else rows.filter(ok))
    counts = with_places(rows.filter(ok).groupBy(*by, "rs_score").agg(F.count("*").alias("n")), "rs_score", *by)
    on = ok & (F.col("rs_score") == F.col("_score"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    places = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("rs_score").alias("_score"), (F.col("_upto") / F.col("_all")).alias("_share"))
    rows = rows.join(places, on, "left")
    return rows.withColumns({"rs_rank": half_up(F.col("_share") * 100, 1), "rs_ratio": half_up("rs_score", 4)}).drop("_score", "_share", *(f"_{c}" for c in by))


def strength(returned: DataFrame, benchmark: DataFrame | None, *by: str, settings: Settings = DEFAULTS, among: Column | None = None, parts: int | None = None) -> DataFrame:
    """Add rs_score, rs_ratio and rs_rank to rows with ret{k}, against the benchmark's row of equal `by` (without `by`,
    its one row). Where the benchmark has no row, scores are those without a benchmark; where its row has no usable
    return, there is no score. See `rank` for `among`. `parts`: tasks that rows are dealt out over by `by`, so that few values of
    `by` share one.
    """
    if parts and by:
        returned = returned.repartition(parts, *by)
    if benchmark is None:
        return rank(returned.withColumn("rs_score", composite(settings, benchmark=False)), *by, among=among)
    names = [f"bench{k}" for k, _ in settings.lookbacks]
    one = benchmark.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(f"ret{k}").alias(n) for n, (k, _) in zip(names, settings.lookbacks, strict=True)), F.lit(True).alias("_has"))
    if by:
        both = returned.join(one, [F.col(c) == F.col(f"_{c}") for c in by], "left")
    else:  # one row in any case, so that none is lost
        both = returned.crossJoin(F.broadcast(one.agg(*(F.first(c).alias(c) for c in [*names, "_has"]))))
    score = F.when(F.col("_has"), composite(settings)).otherwise(composite(settings, benchmark=False))
    return rank(both.withColumn("rs_score", score).drop("_has", *names, *(f"_{c}" for c in by)), *by, among=among)
