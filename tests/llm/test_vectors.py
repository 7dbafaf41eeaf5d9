"""Clustering and search of vectors against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from candlewright.llm import centroids, queries, search
from candlewright.llm.centroids import cluster_vectors
from candlewright.llm.search import top_products

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string, square int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, "clash", 1) for k, v in rows], SCHEMA).repartition(3)


def odd_rows(seed, n, dims=64):
    """Vectors with exact copies, ties, large values, nulls and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(0, rng.choice([0.05, 1, 40]), dims).astype(np.float32).tolist()) for k in range(n)]
    rows += [(1000 + 10 * k, rows[7][1]) for k in range(30)] + [(2000 + k, [0.0] * dims) for k in range(5)]
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1]), (50, rows[1][1]), (-50, rows[2][1]), (100, [-0.001] * dims)]
    bad = [(3000, None), (3050, [None] * dims), (3100, [math.nan] + [1.0] * (dims - 1)), (3150, [1.0] * (dims - 1) + [math.inf])]
    return rows, bad


def clusters_brute(rows, k, rounds):
    x = [(i, [math.floor(1024 * c) for c in map(float, v)]) for i, v in rows]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    for r in range(rounds + 1):
        away = [[sum((a - b) ** 2 for a, b in zip(v, o)) for o in c] for _, v in x]
        at = [min(range(len(c)), key=lambda j: (d[j], j)) for d in away]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), a in zip(x, at) if a == j]
                c[j] = [sum(z) // len(own) for z in zip(*own)] if own else c[j]
    near = [d[a] for d, a in zip(away, at)]
    by = [sum(d for d, a in zip(near, at) if a == j) for j in range(len(c))]
    return [(i, a, d, by[a], sum(near), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, d in zip(x, at, near)]


def test_clusters(spark):
    rows, bad = odd_rows(1, 60)
    rows += [(None, rows[0][1])]
    got = cluster_vectors(table(spark, rows + bad + [(4000, [1.0] * 63), (4001, [1.0] * 65), (4002, [])]), rounds=3).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, clusters_brute(rows, 8, 3)))
    few = rows[:3] + rows[-1:]
    assert sorted(map(str, map(tuple, cluster_vectors(table(spark, few + bad)).collect()))) == sorted(map(str, clusters_brute(few, 8, 10)))
    assert cluster_vectors(table(spark, bad)).count() == cluster_vectors(table(spark, [])).count() == 0


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(2)
    for top in (1, 7, 900, 2**27 - 1):
        x, c = rng.integers(-top - 1, top + 1, (50, 64)), rng.integers(-top - 1, top + 1, (5, 64))
        assert (centroids.dots(centroids.planes_of(x), centroids.planes_of(c)) == x @ c.T).all()
        of = rng.integers(0, 5, 50)
        assert (centroids.sums(centroids.planes_of(x), of, 5) == [x[of == k].sum(axis=0) for k in range(5)]).all()
    with pytest.raises(ValueError):
        centroids.planes_of(np.full((1, 64), 2**27))


def products_brute(rows, every=50, k=5):
    x = [(i, [math.floor(256 * c) for c in map(float, v)]) for i, v in rows if i is not None]
    out = []
    for a, (q, u) in enumerate(x):
        if q % every == 0:
            scores = sorted((-sum(y * z for y, z in zip(u, v)), i) for b, (i, v) in enumerate(x) if b != a)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("dims", [64, 3])
def test_search(spark, dims):
    rows, bad = odd_rows(3, 250, dims)
    rows += [(None, rows[0][1]), (150, [1.0, 2.0]), (151, []), (200, []), (250, [9.0] * (dims + 2))]
    got = top_products(table(spark, rows + bad), chunk=7, sample=40).collect()
    assert sorted(map(tuple, got)) == sorted(products_brute(rows))
    few = [r for r in rows if r[0] in (0, 50, 3, 1010)]
    assert sorted(map(tuple, top_products(table(spark, few)).collect())) == sorted(products_brute(few))
    assert top_products(table(spark, bad)).count() == top_products(table(spark, [])).count() == top_products(table(spark, rows[1:3])).count() == 0


def test_long_vectors_stay_exact():
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**26), 2**26, (40, 64))
    assert (search.products(a, a) == a @ a.T).all()
    with pytest.raises(ValueError):
        search.squares(np.full((1, 64), 2**28))


def test_bounds_hold_and_stop_early():
    """No score is above its bound, and with vectors in groups most candidates are never evaluated."""
    rng = np.random.default_rng(6)
    x = (rng.normal(0, 300, (8, 64))[rng.integers(0, 8, 3000)] + rng.normal(0, 20, (3000, 64))).astype(np.int64)
    p = search.choose_pivots(x[:200], 16)
    away, square = search.distances(x, p.points), search.squares(x)
    gap = np.abs(away[:100, None] - away).max(axis=2)
    most = search.bounds(square[:100, None], square, gap)
    scores = search.products(x[:100], x)
    assert (scores <= most).all() and (most >= np.sort(scores)[:, -6, None]).mean() < 0.3


@pytest.mark.parametrize("name", ["op11_centroids", "op13_top_products"])
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    sort = lambda d: d.sort_values(list(d.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want))
