"""Ordered doubles dealt out by their size, so that ranks and quantiles need no window over all of them.

`fine` and `coarse` are buckets that rise with the value: steps of 1/4096 and 1/16 of an e-fold. There are at most some
50,000 coarse buckets and 256 fine ones in each, whatever the values are, and no sample is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS, _IN = 4_096, 256


def fine(x: Column) -> Column:
    """A bucket of `x` that is never smaller for a greater value; NaN is greater than all, as Spark orders it."""
    size = F.floor(_STEPS * F.greatest(F.least(F.log(F.abs(x)), F.lit(710.0)), F.lit(-746.0))) + 1_000 * _STEPS
    return F.when(F.isnan(x), F.lit(2_000 * _STEPS)).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def coarse(bucket: Column) -> Column:
    return F.floor(bucket / _IN)


def with_places(counts: DataFrame, value: str, *keys: str) -> DataFrame:
    """`counts` (distinct values of each `keys`, with their number n) and _upto, _all: rows up to each value, and all of them.

    Counts are summed up over coarse buckets, then over fine ones inside these, then over values inside those, so that
    every window but the first is over a small part, and the first has at most a row for each coarse bucket.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rows = counts.withColumn("_fine", fine(F.col(value))).withColumn("_coarse", coarse(F.col("_fine")))
    small = rows.groupBy(*keys, "_coarse", "_fine").agg(F.sum("n").alias("_n"))
    large = small.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n"))
    every = Window.partitionBy(*keys)
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = large.select(*(F.col(k).alias(f"_l_{k}") for k in keys), F.col("_coarse").alias("_c"), earlier(every.orderBy("_coarse")).alias("_first"), F.sum("_n").over(every).alias("_all"))
    small = small.withColumn("_second", earlier(Window.partitionBy(*keys, "_coarse").orderBy("_fine")))
    on = F.col("_coarse") == F.col("_c")
    for k in keys:
        on = on & same(k, f"_l_{k}")
    places = small.join(large, on).select(*(F.col(k).alias(f"_p_{k}") for k in keys), F.col("_fine").alias("_f"), (F.col("_first") + F.col("_second")).alias("_before"), "_all")
    on = F.col("_fine") == F.col("_f")
    for k in keys:
        on = on & same(k, f"_p_{k}")
    inside = F.sum("n").over(Window.partitionBy(*keys, "_fine").orderBy(value))
    return rows.join(places, on).withColumn("_upto", F.col("_before") + inside).drop("_fine", "_coarse", "_f", "_before", *(f"_p_{k}" for k in keys))
