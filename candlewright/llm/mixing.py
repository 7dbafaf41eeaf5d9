"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target of words. A document's expected number of copies is its source's target over its source's
size; the whole part is given to all, and the fraction is an inclusion probability. The flight phase moves these
probabilities along vectors of the constraints' null-space, which keep the source's totals of words and of documents
exactly, until they are 0 or 1. Groups of a source's documents fly apart from each other; each leaves two undecided at
most, and these fly together on the next level, until two are left of a source: the landing.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.shared import WORD, discard, sized, stored

_NEAR = 1e-9


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Add `target` to source, source_size: shares by weight of all sizes, at most `most` times the source's size.

    Sources take the weights in turn by code point, null last. Excess goes to the others by weight. With the sources
    in order of most * size / weight, those before some place are at their limit and the others share the rest.
    `sources` has one row per source, the result of an aggregation.
    """
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    out = sources.withColumn("weight", F.element_at(cycle, (turn % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * most
    order = Window.orderBy("reach", F.col("source").isNull(), "source")
    out = out.withColumn("reach", limit / F.col("weight"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    out = out.withColumn("level", level)
    share = F.min_by("level", F.when(F.col("reach") >= F.col("level") - _NEAR, F.col("reach"))).over(every)
    return out.withColumn("target", F.least(limit.cast("double"), F.col("weight") * share)).drop("weight", "reach", "level")


def flight(size: list[float], share: list[float], draw: random.Random, land: bool) -> list[float]:
    """Move shares to 0 or 1, keeping their sum and their sum weighted by size; two are left, or none if `land`."""
    share, before = list(share), share
    held: list[int] = []
    for k in range(len(share)):
        if not _NEAR < share[k] < 1 - _NEAR:
            share[k] = float(round(share[k]))
            continue
        held.append(k)
        if len(held) == 3:
            i, j, m = held
            way = (size[m] - size[j], size[i] - size[m], size[j] - size[i])
            _move(share, held, way if any(way) else (1.0, -1.0, 0.0), draw)
            held = [x for x in held if _NEAR < share[x] < 1 - _NEAR]
    if land and len(held) == 2:  # words count for more than documents
        i, j = held
        _move(share, held, (size[j], -size[i]) if size[i] or size[j] else (1.0, -1.0), draw)
    if land:
        for k in held:
            share[k] = float(share[k] >= 0.5)
        _settle(size, share, before)
    return share


def _settle(size: list[float], share: list[float], before: list[float], swaps: int = 3) -> None:
    """Landing moves words by one document's size at most; exchange pairs of documents, in for out, to undo that."""
    free = [k for k, x in enumerate(before) if _NEAR < x < 1 - _NEAR]
    gap = sum(size[k] * (share[k] - before[k]) for k in free)
    for _ in range(swaps):
        out = sorted((size[k], k) for k in free if share[k] == 0)
        best = (abs(gap), -1, -1)
        for k in free:
            if share[k] == 1 and out:
                at = bisect.bisect_left(out, (size[k] - gap, -1))
                best = min([best, *((abs(gap - size[k] + out[j][0]), k, out[j][1]) for j in (at - 1, at) if 0 <= j < len(out))])
        if best[1] < 0:
            return
        _, k, j = best
        share[k], share[j] = 0.0, 1.0
        gap += size[j] - size[k]


def _move(share: list[float], at: list[int], way: Sequence[float], draw: random.Random) -> None:
    """One step along `way`, up or down by chance so that shares keep their expectation, until one is 0 or 1."""
    up = min((1 - share[k]) / w if w > 0 else -share[k] / w for k, w in zip(at, way, strict=True) if w)
    down = min(share[k] / w if w > 0 else (share[k] - 1) / w for k, w in zip(at, way, strict=True) if w)
    step = up if draw.random() * (up + down) < down else -down
    for k, w in zip(at, way, strict=True):
        share[k] = min(1.0, max(0.0, share[k] + step * w))
        if share[k] < _NEAR or share[k] > 1 - _NEAR:
            share[k] = float(round(share[k]))


def _planned(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, group: int = 4_096, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, times, whole, extra: `times` rows are equal in the first three; each is
    taken `whole` times, and `extra` of them once more. See `mix_sources`.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), _words(docs[text_col]).alias("size"))
    units = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "mix-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n"))
    plan = stored(source_targets(sources, weights, most), "mix-sources")
    plan = plan.withColumnRenamed("source", "of").withColumn("parts", F.greatest(F.ceil(F.col("n") / group), F.lit(1)))
    each = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    state = units.join(sized(plan.drop("n")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # of equal rows as many as their shares add up to are taken for certain; one more flies for the rest
    sum_ = F.greatest(each - F.floor(each + _NEAR), F.lit(0.0)) * F.col("times")
    state = state.withColumns({"whole": F.floor(each + _NEAR), "sure": F.floor(sum_ + _NEAR), "share": F.greatest(sum_ - F.floor(sum_ + _NEAR), F.lit(0.0))})
    n, level, done = plan.agg(F.max("n")).head()[0] or 0, 0, []
    while True:
        state = stored(_fly(state, level, seed), f"mix-level{level}")
        parts = max(1, -(-n // group))
        if parts == 1:
            done.append(state)
            break
        open_ = (F.col("share") > 0) & (F.col("share") < 1)
        done.append(state.filter(~open_))
        state = state.filter(open_).withColumn("parts", F.greatest(F.ceil(2 * F.col("parts") / group), F.lit(1)))
        n, level = 2 * parts, level + 1
    discard(units, plan)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("extra", (F.col("sure") + F.col("share")).cast("long"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row.

    size: words `[^\\x20\\x09-\\x0D]+`, 0 for a null text. Of rows equal in doc_id, source and size as many are taken once
    more than the others as their shares add up to, rounded down, and one of the rest flies for what is left; a null
    doc_id or source is a value like others, null sources last in turn. A source of size 0 has target 0 and no copies;
    an empty table gives no rows. Other columns play no part. Reruns agree, however the rows are spread: groups, their
    order and chance follow from hashes of the rows.

    Parameters: weights=(5, 2, 1), most=3, seed="mix", the columns' names id_col, text_col, source_col, and group=4096,
    which bounds the rows that fly together and nothing else.
    """
    out = _planned(docs, **how).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    out = out.withColumn("copies", F.col("whole") + (F.col("time") <= F.col("extra")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _fly(state: DataFrame, level: int, seed: str) -> DataFrame:
    """One level: documents of a source in `parts` groups by hash; a source's only group lands."""
    key = F.xxhash64("doc_id", "size", F.lit(f"{seed} {level}"))
    state = state.withColumn("key", key).withColumn("part", F.pmod("key", "parts"))
    # as text, since pandas makes doubles of longs beside a null
    state = state.withColumn("doc_id", F.col("doc_id").cast("string"))

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents fly first, so that those left at the end are small
        rows = rows.assign(words=-rows["size"]).sort_values(["words", "key", "doc_id"]).drop(columns="words")
        first = rows.iloc[0]
        draw = random.Random(f"{seed} {level} {first.source} {first.part}")
        rows["share"] = flight(rows["size"].tolist(), rows["share"].tolist(), draw, bool(first.parts == 1))
        return rows

    types = state.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return state.groupBy("source", "part").applyInPandas(move, types).withColumn("doc_id", F.col("doc_id").cast("long")).drop("key", "part")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` themselves, each as often as `mix_sources` says; columns as they are, whatever their names.

    Copies are known by (doc_id, source, size) for every document, so that they are as many as the rows of `docs` and
    never broadcast: rows and copies meet by a hash of doc_id and size, at any size of the table alike. Where some of
    several equal rows are taken once more than the others, these rows are numbered by a hash of all their columns.
    """
    id_col, text_col, source_col = how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("source_col", "source")
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumns({"size": _words(F.col(of[text_col])), "doc_id": F.col(of[id_col]).cast("long"), "source": F.col(of[source_col]).cast("string")})
    plan = _planned(docs, **how).select(*(F.col(c).alias(f"{c}_") for c in ("doc_id", "source", "size", "times", "whole", "extra")))
    rows, plan = (x.withColumn(f"key{end}", F.xxhash64(f"doc_id{end}", f"size{end}")) for x, end in ((rows, ""), (plan, "_")))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_"))
    some = (F.col("extra_") > 0) & (F.col("extra_") < F.col("times_"))

    def taken(part: DataFrame, more: Column) -> DataFrame:
        out = rows.join(part.hint("merge"), (F.col("key") == F.col("key_")) & same)
        out = out.withColumn("copies", F.col("whole_") + more).filter("copies > 0")
        return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(n).alias(c) for c, n in of.items()))

    out = taken(plan.filter(~some & (F.col("whole_") + F.col("extra_") > 0)), (F.col("extra_") > 0).cast("long"))
    apart = plan.filter(some)
    if apart.isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy("key_", "doc_id_", "source_", "size_").orderBy(F.xxhash64(*names)))
    return out.unionAll(taken(apart, (place <= F.col("extra_")).cast("long")))
