import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratamap.operators import matching, search


def frame(spark, v):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "id long, x double, y double, z double").repartition(3)


def crowd(seed, n, m):
    """Points of which many share places, planes and coordinates, with some apart from all others."""
    r = np.random.default_rng(seed)
    v = np.concatenate([r.integers(0, 4, (n, 3)) * [1.0, 4.0, 1.0], r.uniform(0, 12, (m, 3)), r.uniform(0, 12, (m, 3)) * [1.0, 0.0, 0.0], [[500.0, 0.0, 0.0]]])
    return v[r.permutation(len(v))]


@pytest.mark.parametrize("distance", [0.4, 2.0, 30.0])
def test_nearest_of_points_that_share_places(spark, distance):
    a, b = crowd(1, 60, 40), crowd(2, 300, 60)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    got = {r.lid: (r.rid, r.d) for r in matching.nearest(frame(spark, a), frame(spark, b), distance).collect()}
    assert got == {i: (int(d[i].argmin()), pytest.approx(d[i].min())) for i in range(len(a)) if d[i].min() < distance}


def test_pairs_of_one_place_are_not_listed(spark):
    """A hundred thousand points at each of two places: by pairs these would be twenty thousand million."""
    n = 100_000
    at = spark.range(2 * n).select("id", (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    near = matching.nearest(at, at, 0.5)
    assert near.groupBy("rid", "d").count().orderBy("rid").collect() == [(0, 0.0, n), (1, 0.0, n)]
    assert matching.count_in_band(at, at, 3.0, -1.0, 1.0).groupBy("n").count().collect() == [(2 * n, 2 * n)]
    # All have their neighbours in their own place but one point, which is far from all.
    far = at.unionByName(at.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit(40.0).alias("x"), "y", "z"))
    assert [tuple(r) for r in matching.outliers(far, 4, 2.0, 1e-6).collect()] == [(-1, 2.0)]
    assert [tuple(r) for r in matching.outliers_exact(far, 24, 1e-6, 2.0).collect()] == [(-1, 39.0)]


def test_k_nearest_in_parts(monkeypatch):
    monkeypatch.setattr(search, "AT_ONCE", 50)
    a, b = crowd(3, 40, 30), np.unique(crowd(4, 100, 100), axis=0)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    got = [(i, round(x, 9)) for i, _, d in search.k_nearest(a, b, 5, 6.0) for i, x in zip(i.tolist(), d.tolist(), strict=True)]
    assert sorted(got) == sorted((i, round(x, 9)) for i in range(len(a)) for x in np.sort(d[i])[:5].tolist() if x < 6.0)


@pytest.mark.parametrize("k, share", [(4, 0.05), (7, 0.5)])
def test_outliers_of_points_that_share_places(spark, k, share):
    v = crowd(5, 200, 60)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, :k]
    for exact in (False, True):
        mean = np.where(exact | (near < 2.0), near, 2.0).mean(1)
        got = {r.id: r.mean_distance for r in (matching.outliers_exact(frame(spark, v), k, share, 2.0) if exact else matching.outliers(frame(spark, v), k, 2.0, share)).collect()}
        assert got == {i: pytest.approx(mean[i]) for i in np.flatnonzero(mean > np.quantile(mean, 1 - share) + 1e-12).tolist()}


@pytest.mark.parametrize("turned", [False, True])
def test_counts_by_the_rule_of_squares(spark, turned):
    """Many pairs lie on the rim, some with a square just under the distance's whose root rounds to the distance."""
    r = np.random.default_rng(6)
    b = np.array([(x, y, z) for x in np.arange(0, 20, 0.7) for y in (0.0, 4.0, 8.0) for z in (0.0, 3.0)])
    a = np.concatenate([b[::5] + [0.0, 0.0, 1.0], b[1::7] + [3.0, 4.0, -2.0], b[2::7] + [4.1999999999999993, 0.0, 2.0], r.uniform(0, 20, (40, 3))])
    if turned:
        a, b = a[:, [1, 0, 2]], b[:, [1, 0, 2]]
    v = b[None] - a[:, None]
    want = ((v[..., 0] ** 2 + v[..., 1] ** 2 < 25.0) & (v[..., 2] >= -2.0) & (v[..., 2] <= 2.0)).sum(1)
    got = {x.lid: x.n for x in matching.count_in_band(frame(spark, a), frame(spark, b), 5.0, -2.0, 2.0).collect()}
    assert [got.get(i, 0) for i in range(len(a))] == want.tolist()
    root = np.nextafter(25.0, 0.0)
    x = np.sqrt(root)
    step = next(y for y in np.nextafter(x, 0.0) + np.arange(-4, 5) * 1e-16 if y * y < 25.0)
    assert search.counts_in_band(np.zeros((1, 3)), np.array([[step, 0.0, 0.0]]), np.array([7]), 5.0, 0.0, 0.0).tolist() == [7]


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_quantiles_are_exact(spark, n):
    v = np.random.default_rng(n).integers(0, 50, n) / 7
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3)
    for share in (0.0, 0.3, 0.95, 1.0):
        assert search.quantile(d, "v", share) == pytest.approx(np.quantile(v, share))
    assert search.quantile(d.filter("v is null"), "v", 0.5) is None


def test_odd_places(spark):
    """Places that are not finite have no neighbours, and are not searched for without end."""
    nan, inf = float("nan"), float("inf")
    d = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, -0.0, 0.0, 1.0), (3, nan, 0.0, 0.0), (4, inf, 0.0, 0.0), (5, None, 0.0, 0.0)], "id long, x double, y double, z double")
    assert sorted(map(tuple, matching.nearest(d, d, 5.0).collect())) == [(1, 1, 0.0), (2, 2, 0.0)]
    assert {r.lid: r.n for r in matching.count_in_band(d, d, 5.0, -2.0, 2.0).collect()} == {1: 2, 2: 2}
    assert {r.id: r.mean_distance for r in matching.outliers(d, 1, 5.0, 0.9).collect()} == {3: 5.0, 4: 5.0, 5: 5.0}
    assert matching.outliers_exact(d, 24, 0.5, 5.0).collect() == []
    empty = d.limit(0)
    assert not any(f.take(1) for f in (matching.nearest(empty, d, 5.0), matching.nearest(d, empty, 5.0), matching.outliers(empty, 4, 5.0, 0.1), matching.outliers_exact(empty)))
    assert list(itertools.chain(*(p[0] for p in search.k_nearest(np.zeros((1, 3)), np.full((1, 3), 9.0), 1, 5.0)))) == []
