"""Long symbols in blocks equal the plain forms, whatever the blocks."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright import queries
from candlewright.functions import blocks
from candlewright.functions.blocks import Blocks, in_blocks, numbered
from candlewright.operators import indicators as ind
from candlewright.operators.bars import resample_ticks
from candlewright.plans import scan
from tests.test_indicators import frame, walk


@pytest.fixture(scope="module")
def bars(spark):
    """Two walks, one with holes and a flat stretch, and a symbol of three bars."""
    p, q = walk(230, 4), walk(150, 5, "B")
    q.loc[[0, 3, 50, 51, 90], "close"] = np.nan
    q.loc[[20, 77, 78], "volume"] = np.nan
    q.loc[100:112, ["high", "low", "close"]] = 50.0
    return frame(spark, p, q, walk(3, 6, "C")).cache()


def values(df, *columns):
    rows = df.select("symbol", "ts", *columns).toPandas().sort_values(["symbol", "ts"])
    return rows.symbol.tolist(), rows[list(columns)].astype(float).to_numpy()


def equal(got, want):
    assert got[0] == want[0]
    np.testing.assert_allclose(got[1], want[1], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("how", [Blocks(9, 60, "week"), Blocks(64, 60, "month"), Blocks(1000, 60, "year")])
def test_indicators(spark, bars, how):
    def build(df, long):
        df = ind.atr(ind.rsi(ind.ema(df, 9, 50, long=long), long=long), long=long)
        return ind.cci(ind.stochastic(ind.adx(ind.obv(df, long))))

    names = ("ema9", "ema50", "rsi14", "atr14", "obv", "adx", "stoch_d", "cci")
    equal(values(in_blocks(bars, how, lambda df: build(df, how)), *names), values(build(bars, False), *names))


@pytest.mark.parametrize("how", [Blocks(17, 5, "week"), Blocks(10, 30, "month"), Blocks(500, 50, "month")])
def test_parabolic_sar(spark, bars, how):
    whole = bars.filter("high is not null")
    equal(values(ind.parabolic_sar(whole, long=how), "sar", "sar_trend"), values(ind.parabolic_sar(whole), "sar", "sar_trend"))


def test_means_of_many_rows_equal_the_recursion(spark):
    """Blocks shorter than the weights' range and longer ones; no task sees more than a block and its lead-in."""
    p = frame(spark, walk(5000, 7))
    how = Blocks(700, 50, "month")
    got = values(in_blocks(p, how, lambda df: ind.ema(df, 9, 200, long=how)), "ema9", "ema200")
    want = ind.exact_ewm(ind.exact_ewm(p, "ema9", "close", 0.2, 9), "ema200", "close", 2 / 201, 200)
    equal(got, values(want, "ema9", "ema200"))
    sizes = in_blocks(p, how, lambda df: df.withColumn("part", F.col("symbol"))).groupBy("part").count()
    assert sizes.count() == 8 and max(r["count"] for r in sizes.collect()) == 700
    plan = numbered(p, "month")._jdf.queryExecution().executedPlan().toString()
    assert "_u#" in plan.split("row_number() windowspecdefinition(")[1].split("ASC")[0]


def test_too_short_a_lead_is_an_error(spark):
    p = walk(400, 8)
    how = Blocks(100, 40, "month")
    with pytest.raises(Exception, match="longer lead"):
        scan.signals(frame(spark, p), long=how).select("n_bars").collect()
    with pytest.raises(ValueError):
        Blocks(0, 40)


def test_scan_in_blocks(spark):
    """A ranked day with long histories in blocks has the results of the plain scan, counts included."""
    data, as_of = "/root/testdata/sf0.01", "1996-10-14"
    bars, names = queries._bars(spark, data).cache(), queries._constituents(spark, data)
    s = dataclasses.replace(queries.SETTINGS, lookbacks=((5, 0.2), (10, 0.35), (20, 0.45)))
    counts = scan.Counts()
    got = scan.found(bars, names, as_of, None, s, False, counts, Blocks(25, 90, "month")).collect()
    want = scan.found(bars, names, as_of, None, s, False).collect()
    # ema200 is null and the year's range is short in these weeks, so that a short lead-in tells all
    show = lambda rows: sorted((r.symbol, r.score, r.rs_rank, r.setup_type, r.stop, r.adx, r.avg_turnover) for r in rows)
    assert show(got) == show(want) and len(want) >= 2
    assert counts.get()["passed"] == len(got) and counts.get()["total"] == names.count()
    bars.unpersist()


def test_sums_of_all_folds_share_a_sort(spark, bars):
    """Blocks that doubles can weigh need one window for all their means; a long lead-in makes no more than four rows of one."""
    how = Blocks(70, 45, "month", parts=3)
    plan = in_blocks(bars, how, lambda df: ind.ema(df, 9, 20, 21, 50, 200, long=how)).select("symbol", "ts", *(f"ema{p}" for p in (9, 20, 21, 50, 200)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("+- Window") + text.count("- Window") <= 8 and text.count("Sort [") <= 5
    assert "REPARTITION_BY_NUM" in text
    wide = Blocks(5, 90, "month")
    assert in_blocks(bars, wide, lambda df: df.withColumn("part", F.col("symbol"))).count() == bars.count()
    assert wide.span == 45 and Blocks(700, 50).span == 700
    copies = []
    in_blocks(bars, wide, lambda df: copies.append(df.count()) or df)
    assert copies[0] <= 4 * bars.count()


def test_short_blocks_share_a_call(spark):
    """Many short blocks in batches smaller and larger than they are, dealt over counted tasks; none is a call of its own."""
    many = frame(spark, *(walk(60 + k, k, f"S{k}") for k in range(8))).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = ind.parabolic_sar(many, long=Blocks(10, 15, "month", parts=2))
            assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
            equal(values(got, "sar", "sar_trend"), values(ind.parabolic_sar(many), "sar", "sar_trend"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_are_written_once_without_lead_ins(spark, bars, monkeypatch):
    """Means of means in blocks write each bar once and with its own columns; all else that is written has a row for a block."""
    written, cut = [], blocks.cut

    def spy(df):
        out = cut(df)
        written.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(blocks, "cut", spy)
    how = Blocks(20, 60, "month", parts=3)
    got = in_blocks(bars, how, lambda df: ind.macd(ind.obv(df, how), long=how))
    equal(values(got, "macd", "macd_signal", "obv"), values(ind.macd(ind.obv(bars)), "macd", "macd_signal", "obv"))
    assert written[0] == ({*bars.columns, "_g", "_of"}, bars.count())
    assert len(written) == 4 and max(n for _, n in written[1:]) <= 8 + 5  # 230 and 150 rows in blocks of 30


def test_lead_ins_have_blocks_to_lead_in_to(spark):
    """Some 290 rows under a lead-in of 320 are two blocks, the first of which leads in to the second and to no third."""
    p = frame(spark, walk(290, 3))
    rows = []
    in_blocks(p, Blocks(30, 320, "month"), lambda df: rows.append(df.groupBy("symbol.block").count().collect()) or df)
    assert sorted(map(tuple, rows[0])) == [(0, 160), (1, 290)]


def test_blocks_around_their_edges(spark):
    """Blocks that give no sums to others are needed by none, however a symbol's length falls on blocks and lead-ins."""
    many = frame(spark, *(walk(n, n, f"S{n}") for n in (1, 2, 3, 44, 45, 46, 47, 48, 89, 90, 91, 92, 93, 94, 135, 136, 137, 138, 180, 181, 270, 271)))
    for how in (Blocks(5, 90, "month", parts=3), Blocks(45, 47, "week"), Blocks(90, 3, "month")):
        got = in_blocks(many, how, lambda df, how=how: ind.ema(ind.obv(df, how), 9, 50, long=how))
        equal(values(got, "ema9", "ema50", "obv"), values(ind.ema(ind.obv(many), 9, 50), "ema9", "ema50", "obv"))


def test_bars_of_ticks_are_in_place_to_be_numbered(spark):
    """Ticks dealt out by the unit make the same bars, which take no shuffle to be numbered; unknown symbols and times are numbered too."""
    ticks = spark.sql("""
        SELECT nullif(cast(id % 4 AS string), '3') AS symbol, timestamp_micros(if(id % 97 = 5, null, id * 7919000000 * 11)) AS ts, cast(id % 13 AS double) AS price, 1.0 AS volume, id
        FROM range(3000)""")
    want, got = (resample_ticks(ticks, "week", ["ts", "id"], 3, within).drop("_u") for within in (None, "month"))
    show = lambda rows, *also: sorted(map(repr, rows.select("symbol", "ts", "open", "high", "low", "close", "volume", *also).collect()))
    assert show(got) == show(want) and show(resample_ticks(ticks, "week", ["ts", "id"], None, "month")) == show(want)
    rows = numbered(resample_ticks(ticks, "week", ["ts", "id"], 3, "month"), "month")
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 2 and text.count("ENSURE_REQUIREMENTS") == 1  # two readings, and counts by symbol
    assert show(rows, "_g", "_of") == show(numbered(want, "month"), "_g", "_of") == show(numbered(want, "year"), "_g", "_of")
    key = lambda r: (str(r.symbol), r.ts is not None, r.ts)
    bars = sorted(rows.collect(), key=key)
    for s in {r.symbol for r in bars}:
        own = [r for r in bars if r.symbol == s]
        assert [r._g for r in own] == list(range(1, len(own) + 1)) and {r._of for r in own} == {len(own)}
