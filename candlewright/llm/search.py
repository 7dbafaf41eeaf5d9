"""Exact search for the vectors with the greatest inner products, by a table of distances to pivots.

Components are integers, floor(scale * x). A vector's distances to some pivots are computed once and stored beside it. By
the triangle inequality no query is nearer to a vector than their distances to any pivot differ, and as
2 q.x = |q|^2 + |x|^2 - |q - x|^2, the greatest of these lower bounds, over all pivots, is an upper bound of the inner
product. Candidates are evaluated in the order of their bounds until the next bound is below the worst score that still
counts; the search is exact whatever the pivots are.

Equal vectors have equal scores, so that of each distinct vector only the few smallest ids can be among the best: these
are chosen before the shuffle, and a hot vector is one row from there on. The table is dealt by nearest pivot and the
distance to it, so that neighbouring rows have like distances and whole blocks are passed over by their least bound.
Queries go to all rows in chunks of a bounded size, a pass over the table for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.centroids import finite
from candlewright.llm.shared import discard, stored

#: Rows that are bounded together, and queries whose bounds of a block are in memory together.
BLOCK, GROUP = 2_048, 256
#: Candidates of a query that are evaluated at first before its worst score is looked at again; doubled each time.
STRIDE = 64
_EXACT, _MOST = 2**52, 2**60


class Pivots(NamedTuple):
    """Pivots, and a bounded sample of vectors whose scores give every query a first floor."""

    points: np.ndarray
    sample: np.ndarray


def rectangle(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to `dims`."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def squares(x: np.ndarray) -> np.ndarray:
    if len(x) and (x.astype(float) ** 2).sum(axis=1).max() >= _MOST:
        raise ValueError("vectors of a squared length of 2^60 or more have scores beyond a long")
    return (x * x).sum(axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of `a` with all of `b`; by doubles where these hold every sum exactly."""
    longest = max(squares(a).max(initial=0), squares(b).max(initial=0))
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if longest < _EXACT else a @ b.T


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt((squares(x)[:, None] + squares(points) - 2 * products(x, points)).astype(float))


def choose_pivots(sample: np.ndarray, m: int) -> Pivots:
    """The origin, and from the sample the vector farthest from the pivots so far, again and again."""
    points = np.zeros((1, sample.shape[1]), np.int64)
    near = np.full(len(sample), np.inf)
    while len(points) < m and len(sample):
        near = np.minimum(near, distances(sample, points[-1:])[:, 0])
        if not near.max() > 0:
            break
        points = np.vstack([points, sample[near.argmax()]])
    return Pivots(points, sample)


class Queries(NamedTuple):
    """A chunk of queries: numbers, components, squared lengths, distances to pivots, and floors of scores that count."""

    number: np.ndarray
    x: np.ndarray
    square: np.ndarray
    away: np.ndarray
    floor: np.ndarray


def floors(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest score of each row; where there are fewer, the least long."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def bounds(q_square: np.ndarray, x_square: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products from squared lengths and lower bounds of distances, rounding errors included."""
    both = (q_square + x_square).astype(float)
    return (both - gap * gap) / 2 + 1e-12 * both + 1


def probe(queries: Queries, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """number, score, vec_id, same: of each query the k best rows of this task that reach its floor. same: equal vectors."""
    floor, best = queries.floor.copy(), {}
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            _probe(queries, floor, best, batch.slice(at, BLOCK), k)
    rows = [(queries.number[q], -score, vec_id, same) for q, own in best.items() for score, vec_id, same in own]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["number", "score", "vec_id", "same"])


def _probe(queries: Queries, floor: np.ndarray, best: dict[int, list], block: pa.RecordBatch, k: int) -> None:
    square, dims = block.column("square").to_numpy(), queries.x.shape[1]
    away = block.column("away").flatten().to_numpy().reshape(len(square), -1)
    gap = np.maximum(away.min(axis=0) - queries.away, queries.away - away.max(axis=0)).max(axis=1, initial=0)
    open_ = np.flatnonzero(bounds(queries.square, square.max(), gap) >= floor)
    if not len(open_):
        return
    x, ids = rectangle(block.column("x"), dims), block.column("ids")
    first = pc.list_element(ids, 0).to_numpy()
    plain = max(int(square.max()), int(queries.square[open_].max())) < _EXACT
    values = x.astype(float) if plain else x
    for at in range(0, len(open_), GROUP):
        some = open_[at : at + GROUP]
        gaps = np.zeros((len(some), len(square)))
        for p in range(away.shape[1]):
            np.maximum(gaps, np.abs(queries.away[some, p, None] - away[:, p]), out=gaps)
        most = bounds(queries.square[some, None], square, gaps)
        for q, own in zip(some.tolist(), most, strict=True):
            reach = np.flatnonzero(own >= floor[q])
            reach = reach[np.argsort(-own[reach], kind="stable")]
            query, done, stride = queries.x[q].astype(values.dtype), 0, STRIDE
            while done < len(reach) and own[reach[done]] >= floor[q]:
                some_rows = reach[done : done + stride]
                score = (values[some_rows] @ query).astype(np.int64)
                hit = np.flatnonzero(score >= floor[q])
                if len(hit):  # a vector's first id is its least, so that later ones than the first k add nothing
                    hit = hit[np.lexsort((first[some_rows[hit]], -score[hit]))[:k]]
                    new = [(-s, i, s == queries.square[q] == square[r]) for s, r in zip(score[hit].tolist(), some_rows[hit].tolist(), strict=True) for i in ids[r].as_py()]
                    best[q] = sorted([*best.get(q, ()), *new])[:k]
                    if len(best[q]) == k:
                        floor[q] = max(floor[q], -best[q][-1][0])
                done, stride = done + stride, 2 * stride


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256, pivots: int = 16, sample: int = 1_024, chunk: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other rows with the greatest
    inner products; fewer where there are fewer. Ties go to the smaller id.

    Rows without id, null vectors and vectors with a null, NaN or infinite component take no part. A vector with fewer
    components than another counts as filled up with zeros. Every other row is a candidate, also one that repeats the
    query's id or vector; repeated query rows give their results as often as they stand. An empty table gives no rows.
    Vectors of a squared length of 2^60 or more after scaling raise an error, as scores are longs. `sample` bounds the
    vectors (those with the smallest hashes) that pivots and first floors are taken from; neither changes a result.
    `chunk` is about the number of distinct query vectors that go to all rows in one pass. Other columns play no part.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("v"))).select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("x"))
    least = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    distinct = rows.withColumn("n", least).filter(F.col("n") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = stored(distinct, "vectors")
    dims = distinct.agg(F.max(F.size("x"))).head()[0] or 0
    drawn = [r.x for r in distinct.orderBy(F.xxhash64("x"), "x").limit(sample).collect()]
    drawn = rectangle(pa.array(drawn, pa.list_(pa.int64())), dims) if drawn else np.zeros((0, dims), np.int64)
    chosen = choose_pivots(drawn, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = rectangle(batch.column("x"), dims)
                away = distances(x, chosen.points)
                lists = pa.ListArray.from_arrays(np.arange(len(away) + 1, dtype=np.int32) * away.shape[1], away.ravel())
                extra = {"square": squares(x), "away": lists, "cell": away.argmin(axis=1).astype(np.int32), "near": away.min(axis=1)}
                yield pa.record_batch({n: batch.column(n) for n in batch.schema.names} | extra)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in measure(batches):
            floor = floors(products(rectangle(batch.column("x"), dims), chosen.sample), k + 1)
            yield batch.append_column("floor", pa.array(floor))

    extra = "square long, away array<double>, cell int, near double"
    table = distinct.mapInArrow(measure, f"x array<long>, ids array<long>, {extra}").repartitionByRange("cell", "near").sortWithinPartitions("cell", "near")
    table = stored(table, "pivot-table")
    asked = rows.filter(F.col("vec_id") % every == 0)
    number = F.monotonically_increasing_id().alias("number")
    queries = stored(asked.select("x").distinct().mapInArrow(floored, f"x array<long>, {extra}, floor long").select("*", number), "queries")
    parts = -(-queries.count() // chunk)
    tops = [stored(_pass(table, queries.filter(F.pmod(F.xxhash64("x"), F.lit(parts)) == part), dims, k + 1), "tops") for part in range(parts)]
    discard(table, distinct)
    found = queries.limit(0).select("number", F.lit(None).cast("array<struct<score:bigint,vec_id:bigint,same:boolean>>").alias("best"))
    for top in tops:
        found = found.unionByName(top)
    found = found.join(queries.select("number", "x"), "number").select("x", "best")
    own = F.array_position(F.transform("best", lambda r: r["same"] & (r["vec_id"] == F.col("query_id"))), True)
    out = asked.withColumnRenamed("vec_id", "query_id").join(found, "x").withColumn("own", own)
    others = F.slice(F.filter("best", lambda r, i: i + 1 != F.col("own")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("place", "r"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def _pass(table: DataFrame, chunk: DataFrame, dims: int, k: int) -> DataFrame:
    """number, best: the k best rows of a bounded chunk of queries, in order."""
    got = chunk.select("number", "x", "square", "away", "floor").toArrow().combine_chunks()
    column = lambda n: got.column(n).combine_chunks() if got.num_rows else pa.array([], got.schema.field(n).type)
    away = column("away").flatten().to_numpy().reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 1))
    queries = Queries(column("number").to_numpy(), rectangle(column("x"), dims), column("square").to_numpy(), away, column("floor").to_numpy())
    rows = table.select("x", "ids", "square", "away").mapInArrow(lambda batches: probe(queries, batches, k), "number long, score long, vec_id long, same boolean")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id", "same"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= k)
    best = F.sort_array(F.collect_list(F.struct("place", "score", "vec_id", "same")))
    return rows.groupBy("number").agg(best.alias("best")).select("number", F.transform("best", lambda r: F.struct(r["score"].alias("score"), r["vec_id"].alias("vec_id"), r["same"].alias("same"))).alias("best"))


#: The same for DuckDB.
SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
