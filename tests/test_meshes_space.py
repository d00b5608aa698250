import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamap.geometry import GridSpec, Uncertain, affine, rotation
from stratamap.operators import matching, points, poses, raster, surfaces
from stratamap.operators.surfaces import HORIZONTAL, NEGATIVE, VERTICAL


def cells(spark, rows, band="top"):
    return spark.createDataFrame(rows, f"xi long, yi long, {band} double")


def test_meshes_of_scans(spark):
    d = spark.createDataFrame([(k, 0.01 * k, [2000] * 8, [5000] * 8) for k in range(3)], "line int, phi double, ranges array<int>, remissions array<int>")
    p = points.mesh_points(d, -0.04, 0.01, 0.1, 10.0, 1.5)
    assert p.count() == 24 and p.filter("is_edge").count() == 18 and p.first().grey == 0.5
    assert points.mesh_faces(p, 0.5).count() == 2 * 7 * 2
    turned = points.mesh_points(d, -0.04, 0.01, 0.1, 10.0, 1.5, x_forward=False, centre=(0.0, 1.0, 0.0)).filter("line = 2 and beam = 4").first()
    assert (turned.x, turned.y, turned.z) == (pytest.approx(0), pytest.approx(3 * math.cos(0.02)), pytest.approx(3 * math.sin(0.02)))
    jump = spark.createDataFrame([(0, 0.0, [2000, 2000, 9000, 9000], [1])], d.schema)
    assert sorted(r.beam for r in points.mesh_points(jump, 0.0, 0.01, 0.1, 10.0, 1.4).collect()) == [0, 3]


def test_faces_turn_round_behind_the_sensor(spark):
    d = spark.createDataFrame([(line, beam, psi, float(beam), float(line), 0.0) for line in range(2) for beam in range(2) for psi in [2.0 if beam else 1.9]], "line int, beam int, psi double, x double, y double, z double")
    got = {tuple((r[k].line, r[k].beam) for k in "abc") for r in points.mesh_faces(d, 2.0).collect()}
    assert got == {((0, 1), (1, 0), (1, 1)), ((0, 0), (1, 0), (0, 1))}
    three = points.mesh_faces(d.filter("not (line = 1 and beam = 1)"), 2.0).collect()
    assert [tuple((r[k].line, r[k].beam) for k in "abc") for r in three] == [((0, 0), (1, 0), (0, 1))]


def test_marks_are_met_in_order(spark):
    rows = [(1, 0, 0, 0.0, 99), (1, 0, 1, 0.04, 99), (1, 0, 2, 0.08, 99), (1, 1, 0, 0.05, 99), (1, 1, 1, 0.5, 5), (2, 0, 0, 0.0, 99)]
    d = spark.createDataFrame([(s, line, beam, x, 0.0, 0.0, r) for s, line, beam, x, r in rows], "scan int, line int, beam int, x double, y double, z double, remission int")
    got = {(r.scan, r.marker): (round(r.x, 6), r.n) for r in points.markers(d, 50).collect()}
    assert got == {(1, 0): (0.03, 3), (1, 1): (0.065, 2), (2, 0): (0.0, 1)}


def test_steps_with_deviations_and_counts(spark):
    g = GridSpec(3, 3, 1.0, 1.0)
    d = spark.createDataFrame([(x, y, 1.0 if (x, y) == (1, 1) else 0.0, 0.25, 9 if (x, y) != (0, 0) else 2) for x in range(3) for y in range(3)], "xi long, yi long, top double, sd double, n long")
    assert raster.steps(d, g, sd="sd").first().max_step == 1.5 and raster.steps(d, g).first().max_step == 1.0
    assert raster.steps(d, g, least=5).count() == 1 and raster.steps(d, g, least=10).count() == 0 and raster.slope(d, g, least=10).count() == 0


def test_pose_variance_is_that_of_the_covariance(spark):
    draw = np.random.default_rng(3)
    a = draw.normal(size=(6, 6))
    pose = Uncertain(affine((3.0, -1.0, 2.0), rotation(0.1, 0.2, 0.3)), a @ a.T)
    g = GridSpec(4, 4, 1.0, 2.0, 0.5, 0.5)
    got = cells(spark, [(2, 3, 5.0)]).select(surfaces.pose_variance(g, pose).alias("v")).first().v
    seen = np.linalg.inv(pose.m) @ [3.0, 7.5, 5.0, 1.0]
    assert got == pytest.approx(pose.point(seen[:3])[1][2, 2])
    assert cells(spark, [(2, 3, 5.0)]).select(surfaces.pose_variance(g, Uncertain(pose.m)).alias("v")).first().v == 0


def test_free_space_leads_to_the_sensor(spark):
    g = GridSpec(10, 10, 1.0, 1.0)
    d = spark.createDataFrame([(8, 4, 0, 1.0, 0.2, 0.0), (2, 2, 0, 1.0, 0.2, 0.0)], "xi long, yi long, ord int, mean double, stdev double, height double")
    got = surfaces.free_space(d, g, (2.5, 2.5, 4.0)).orderBy("fx", "k").collect()
    assert [(r.xi, r.yi) for r in got] == [(7, 4), (6, 3), (5, 3), (4, 3), (3, 2), (2, 2)]
    assert got[-1].mean == pytest.approx(4.0) and got[-1].height == 0 and got[2].stdev == pytest.approx(0.1)
    with pytest.raises(ValueError):
        surfaces.free_space(d, g, (-1.0, 2.5, 4.0))
    p = spark.createDataFrame([(1, 8.5, 4.5, 1.0, 0.1)], "vid long, x double, y double, z double, sd double")
    out = surfaces.project_with_free_space(p, g, ["vid"], (2.5, 2.5, 4.0)).collect()
    assert sorted((r.xi, r.type) for r in out) == [(2, NEGATIVE), (3, NEGATIVE), (4, NEGATIVE), (5, NEGATIVE), (6, NEGATIVE), (7, NEGATIVE), (8, HORIZONTAL)]


def test_the_first_patch_near_enough_matches(spark):
    kind = "xi long, yi long, ord int, mean double, stdev double, height double, type int"
    p = spark.createDataFrame([(0, 0, 0, 9.0, 0.1, 0.0, HORIZONTAL), (0, 0, 1, 5.0, 0.1, 3.0, VERTICAL), (0, 0, 2, 2.1, 0.1, 0.0, HORIZONTAL), (1, 0, 0, 5.0, 0.1, 3.0, NEGATIVE)], kind)
    q = spark.createDataFrame([(1, 0, 0, 1.9, 0.1, 0.0, HORIZONTAL), (2, 0, 0, 4.0, 0.1, 0.0, HORIZONTAL), (3, 0, 0, 7.0, 0.1, 0.0, HORIZONTAL), (4, 1, 0, 3.0, 0.1, 0.0, HORIZONTAL)], "id long, " + kind.replace("ord int, ", ""))
    assert {r.id: r.ord for r in surfaces.first_match(p, q).collect()} == {1: 1, 2: 1, 4: 0}
    assert {r.id for r in surfaces.first_match(p, q, skip_free=True).collect()} == {1, 2}


def test_paths_follow_surfaces(spark):
    p = spark.createDataFrame([(0, 0, 0.0), (0, 0, 5.0), (1, 0, 0.4), (1, 0, 4.0)], "xi long, yi long, mean double")
    w = spark.createDataFrame([("a", k, k, 0, 0.1) for k in range(3)] + [("b", k, k, 0, 9.0) for k in range(3)], "path string, seq long, xi long, yi long, start double")
    got = {(r.path, r.seq): r.height for r in surfaces.follow_paths(w, p).collect()}
    assert [got[("a", k)] for k in range(3)] == [0.0, 0.4, 0.4] and [got[("b", k)] for k in range(3)] == [5.0, 4.0, 4.0]


def test_weights_scale(spark):
    d = spark.createDataFrame([(2.0, 8.0, 4.0)], "w double, wz double, ww double")
    r = surfaces.scale_sums(d, 0.5, ["w", "wz"], ["ww"]).first()
    assert (r.w, r.wz, r.ww) == (1.0, 4.0, 1.0)


def test_incompatible_pairs_do_not_count(spark):
    kind = "id long, x double, y double, z double, nx double, ny double, nz double, is_edge boolean"
    draw = np.random.default_rng(5)
    rows = [(i, *map(float, v), 0.0, 0.0, 1.0, i % 10 == 0) for i, v in enumerate(draw.uniform(0, 5, (200, 3)))]
    model = spark.createDataFrame(rows, kind)
    cloud = spark.createDataFrame([(i, x + 0.03, y, z, 0.0, 0.0 if i % 3 else 1.0, 1.0 if i % 3 else 0.0, e) for i, x, y, z, *_, e in rows], kind)
    t, mse, n = matching.align(model, cloud, 0.5, overlap=1.0, rounds=3, turn=math.pi / 8)
    assert n == sum(1 for i in range(200) if i % 10 and i % 3) and t[0, 3] == pytest.approx(-0.03, abs=1e-6) and mse < 1e-9


def test_draws_have_their_moments(spark):
    cov = [[2.0, 1.0], [1.0, 1.0]]
    d = poses.sample_normal(spark, 40_000, ["x", "y"], [1.0, -1.0], cov).select("x", "y").toPandas()
    assert np.allclose(d.mean(), [1, -1], atol=0.05) and np.allclose(np.cov(d.T), cov, atol=0.08)
    m = poses.sample_mixture(spark, 20_000, ["x"], [(1.0, [0.0], [[0.0]]), (3.0, [5.0], [[1.0]])])
    assert {r.component: (round(r.n / 20_000, 1), round(r.x)) for r in m.groupBy("component").agg(F.count("*").alias("n"), F.avg("x").alias("x")).collect()} == {0: (pytest.approx(0.25, abs=0.06), 0), 1: (pytest.approx(0.75, abs=0.06), 5)}


def test_windows_of_shapes(spark):
    g = GridSpec(4, 4, 1.0, 1.0)
    d = raster.within(raster.empty(g, spark, h=0.0), g, "h", lambda c: raster.add_const(c, "h", 2.0), 1.0, 1.0, 2.0, 2.0)
    assert d.columns == ["xi", "yi", "h"] and {(r.xi, r.yi) for r in d.filter("h = 2").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_weights_move_centres(spark):
    d = spark.createDataFrame([(0.0, 100.0), (1.0, 1.0), (50.0, 1.0), (51.0, 1.0)], "x double, weight double")
    got = {r.x: r.cluster for r in poses.kmeans(d, ["x"], 2, weight="weight").collect()}
    assert got[0.0] == got[1.0] != got[50.0] == got[51.0]


@pytest.mark.parametrize("seed", range(6))
def test_rows_within_blocks_are_taken_together(seed):
    """The patches are the same as by one update after the other, though most rows are not looked at one by one."""
    draw = np.random.default_rng(seed)
    n = 3000
    z = np.where(draw.random(n) < 0.1, draw.uniform(0, 60, n), draw.choice([5.0, 30.0, 55.0], n) + draw.uniform(-4, 4, n))
    kind = draw.choice([surfaces.HORIZONTAL, surfaces.VERTICAL, surfaces.NEGATIVE], n, p=[0.9, 0.08, 0.02] if seed % 2 else [1.0, 0.0, 0.0])
    height = np.where(kind == surfaces.HORIZONTAL, 0.0, draw.uniform(0, 3, n))
    rows = [z, draw.uniform(0.05, 0.2, n), height, draw.choice([1.0, 0.3], n), z - 0.1, z + 0.1, draw.integers(0, 3, n), kind]
    one, all_, calls = [], [], []
    for r in zip(*(c.tolist() for c in rows), strict=True):
        surfaces.update(one, surfaces.Patch(*r), 0.05, 0.5)
    real = surfaces.update
    surfaces.update = lambda *a: (calls.append(1), real(*a))
    try:
        for s in range(0, n, 700):
            surfaces.update_all(all_, [c[s : s + 700] for c in rows], 0.05, 0.5)
    finally:
        surfaces.update = real
    assert all_ == one
    assert seed % 2 or len(calls) < n / 5
