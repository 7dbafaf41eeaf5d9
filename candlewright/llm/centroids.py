"""Clustering of vectors of 64 components around centroids, by bit planes.

Components are integers, floor(scale * x). Plane b of a vector is one uint64 whose bit i is bit b of component i, in two's
complement, so that the last plane weighs -2^b. The inner product of a vector and a centroid is then the sum over pairs
of planes of 2^(a + b) times the number of ones in their AND, and a squared distance |x|^2 - 2 x.c + |c|^2 is exact.
Vectors are packed and stored once; a round reads the packed table, and only sums of each task's clusters (a row for a
cluster and component) are shuffled. What comes to the driver is as large as the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.llm.shared import discard, stored

#: Components of a vector: the bits of a plane.
WIDTH = 64
#: Components of more bits have squared distances beyond a long.
MOST_BITS = 28


def finite(vector: Column) -> Column:
    """Whether an array is there and all its elements are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64 integers: rows of as many uint64 as the longest integer has bits, sign included."""
    longest = max(int(values.max(initial=0)), ~int(values.min(initial=0))).bit_length() + 1
    if longest > MOST_BITS:
        raise ValueError(f"components of {longest} bits; squared distances of more than {MOST_BITS} bits each are beyond a long")
    bits = [np.packbits((values >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(longest)]
    return np.hstack(bits)


def weights(n: int) -> np.ndarray:
    out = np.int64(1) << np.arange(n, dtype=np.int64)
    out[-1:] *= -1
    return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of planes `x` with all of `c`, by weighted AND-popcounts."""
    out = np.zeros((len(x), len(c)), np.int64)
    inner = weights(c.shape[1])
    for a, weight in enumerate(weights(x.shape[1])):
        for k, planes in enumerate(c):
            out[:, k] += weight * (np.bitwise_count(x[:, a, None] & planes).astype(np.int64) @ inner)
    return out


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sums of components over each cluster's rows: ones of each plane by place, weighted."""
    of = (np.arange(k)[:, None] == cluster).astype(np.float32)  # counts of a batch are exact in float32
    out = np.zeros((k, WIDTH), np.int64)
    for a, weight in enumerate(weights(x.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(x[:, a]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += weight * (of @ bits.astype(np.float32)).astype(np.int64)
    return out


def _planes(column: pa.Array) -> np.ndarray:
    """Rows of a batch with as many planes as the longest has: shorter ones repeat their sign."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat[(np.cumsum(size) - size)[:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)]


def packed(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, planes, square (the sum of squared components) of the rows that are kept."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.floor(scale * batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
                values = np.clip(values, -(2.0**62), 2.0**62).astype(np.int64)
                planes = planes_of(values)
                lists = pa.ListArray.from_arrays(np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1], planes.ravel().view(np.int64))
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "planes": lists, "square": (values * values).sum(axis=1)})

    return stored(_kept(vectors, id_col, vector_col).mapInArrow(pack, "vec_id long, planes array<long>, square long"), "bit-planes")


def _kept(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    return rows.filter((F.size("vector") == WIDTH) & finite(F.col("vector")))


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of a batch's rows, their nearest centroid (ties: the smaller number), and the squared distance."""
    x = _planes(batch.column("planes"))
    away = batch.column("square").to_numpy()[:, None] - 2 * dots(x, planes) + (centroids * centroids).sum(axis=1)
    cluster = away.argmin(axis=1)
    return x, cluster, away[np.arange(len(x)), cluster]


def fit(table: DataFrame, start: Sequence[Sequence[int]], rounds: int) -> np.ndarray:
    """Centroids after `rounds` rounds over the packed table, or sooner once a round changes none."""
    centroids = np.array(start, np.int64).reshape(-1, WIDTH)
    k = len(centroids)
    for _ in range(rounds if k else 0):
        planes = planes_of(centroids)

        def add(batches: Iterator[pa.RecordBatch], centroids=centroids, planes=planes) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, WIDTH + 1), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x, cluster, _ = _nearest(batch, centroids, planes)
                    total[:, :WIDTH] += sums(x, cluster, k)
                    total[:, WIDTH] += np.bincount(cluster, minlength=k)
            yield pa.record_batch({"cluster": np.repeat(np.arange(k, dtype=np.int32), WIDTH + 1), "place": np.tile(np.arange(WIDTH + 1, dtype=np.int32), k), "total": total.ravel()})

        # decimals, as the sums of all tasks may be beyond a long
        got = table.mapInArrow(add, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        total = {(r.cluster, r.place): int(r.total) for r in got}
        moved = np.array([[total[c, i] // n for i in range(WIDTH)] if (n := total.get((c, WIDTH), 0)) else centroids[c].tolist() for c in range(k)], np.int64)
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row that is kept.

    Kept are rows whose vector has exactly 64 components, none null, NaN or infinite; others, null vectors among them,
    give no row. Centroids start as the `k` kept rows with the smallest sha256 of "seed:id" in hash order, and as fewer
    where fewer are kept. Equal rows count as often as they stand; of rows with one id the smaller vector comes first,
    and rows without id, which count like others, come last. Empty clusters keep their centroid. An empty table gives
    no rows. Components of more than 28 bits after scaling raise an error, as their squared distance is beyond a long.
    Other columns play no part.
    """
    table = packed(vectors, scale, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = _kept(vectors, id_col, vector_col).orderBy(order, "vector").limit(k).collect()
    centroids = fit(table, np.floor(scale * np.array([r.vector for r in first], float).reshape(-1, WIDTH)).astype(np.int64), rounds)
    planes = planes_of(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cluster, away = _nearest(batch, centroids, planes)
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": cluster.astype(np.int32), "distance": away})

    rows = stored(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    discard(table)
    inertia = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()]
    facts = rows.sparkSession.createDataFrame(facts, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(k: int, rounds: int) -> str:
    """Common table expressions a0, c1, a1, ...: assignments to centroids and the next centroids."""
    out = []
    for r in range(rounds + 1):
        if r:
            out.append(f"""f{r} AS (
  SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f
  FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{r - 1}) GROUP BY ALL)),
c{r} AS MATERIALIZED (
  SELECT cluster, coalesce(g.c, o.c) AS c
  FROM c{r - 1} o LEFT JOIN (SELECT cluster, list(f ORDER BY i) AS c FROM f{r} GROUP BY cluster) g USING (cluster))""")
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT id, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(cluster, d * {k} + cluster) AS cluster, min(d) AS distance
  FROM (SELECT id, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r})
  GROUP BY id)""")
    return ",\n".join(out)


#: The same for DuckDB.
SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c
  FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h, x LIMIT 8)),
{_rounds(8, 10)}
SELECT vec_id, CAST(a.cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 a JOIN c10 c ON a.cluster = c.cluster
"""
