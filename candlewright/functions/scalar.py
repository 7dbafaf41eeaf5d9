"""Scalar helpers: symbols, names, prices, rounding and the market session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def title_case(name: Column) -> Column:
    """Title case as Python has it: a letter after anything but a letter is upper case. initcap differs after marks."""

    @F.pandas_udf("string")
    def title(names: pd.Series) -> pd.Series:
        return names.str.title()

    return title(name)


def plain_symbol(symbol: Column, suffix: str = ".NS") -> Column:
    return F.replace(symbol, F.lit(suffix), F.lit(""))


def provider_symbol(symbol: Column, suffix: str = ".NS") -> Column:
    return F.concat(symbol, F.lit(suffix))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def true_range(before: Column) -> Column:
    """The largest of high - low and the distances of both from the close `before`; null if any input is."""
    known = F.col("high").isNotNull() & F.col("low").isNotNull() & before.isNotNull()
    return F.when(known, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def half_up(x: Column | str, places: int) -> Column:
    """Rounded with ties upwards, by plain arithmetic on doubles, so that other engines can do the same."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def rounded(x: Column, places: int) -> Column:
    """Rounded, with 0 as null, as results show it."""
    return F.nullif(half_up(x, places), F.lit(0.0))


def in_session(ts: Column, zone: str = "Asia/Kolkata", opens: int = 555, closes: int = 930) -> Column:
    """Monday to Friday, from `opens` to `closes` minutes of the day in `zone`, both included; `ts` is in UTC."""
    local = F.from_utc_timestamp(ts, zone)
    return (F.weekday(local) <= 4) & (F.hour(local) * 60 + F.minute(local)).between(opens, closes)


def nan_as_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN is greater than all numbers in Spark's comparisons; nulls fail them, as the rules want."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
