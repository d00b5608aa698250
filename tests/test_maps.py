import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratamap import catalogue
from stratamap.geometry import GridSpec, Uncertain, affine, line_cells, rotation, voxel_path
from stratamap.operators import matching, points, polygons, poses, raster, surfaces, traversability
from stratamap.operators.surfaces import HORIZONTAL, NEGATIVE, VERTICAL, Patch

UNIT = GridSpec(10, 10, 1.0, 1.0)


def cells(spark, rows, band="top"):
    return spark.createDataFrame(rows, f"xi long, yi long, {band} double")


def test_cells_of_points(spark):
    g = GridSpec(4, 3, 0.5, 2.0, 1.0, -1.0)
    d = spark.createDataFrame([(1.0, -1.0), (0.99, 0.0), (2.99, 4.99), (3.0, 0.0), (1.6, 1.5)], "x double, y double")
    assert sorted((r.xi, r.yi) for r in raster.to_cells(d, g).collect()) == [(0, 0), (1, 1), (3, 2)]


def test_alignment():
    a, b, c = GridSpec(100, 100, 0.1, 0.1), GridSpec(100, 100, 0.1, 0.1), GridSpec(200, 100, 0.1, 0.1)
    assert a.fully_aligned(b) and not a.fully_aligned(c)
    assert a.aligned(c, (0.1, 0.0)) and not a.aligned(c, (0.15, 0.0))


def test_uncertain_transforms_are_recovered():
    a = Uncertain(affine((0, 0, 1), rotation(roll=math.pi / 2)), np.diag([0, 0, 0.1, 0, 0, 0.0]))
    b = Uncertain(affine((0, 1, 3), rotation(pitch=math.pi / 2)), np.diag([0, 0.1, 0, 1, 0, 0.0]))
    c = a @ b
    for got, want in ((c.without_last(b), a), (c.without_first(a), b)):
        assert np.allclose(got.m, want.m, atol=1e-12) and np.allclose(got.cov, want.cov, atol=1e-12)
    assert np.allclose((a @ a.inverse()).m, np.eye(4))
    draw = np.random.default_rng(1)
    r = draw.multivariate_normal(np.zeros(6), np.eye(6) * 1e-6, 4000)
    from_ = lambda v, m: affine(tuple(m[:3, 3] + v[3:]), rotation(*v[:3]) @ m[:3, :3])
    p = np.array([1.0, 2.0, 3.0])
    seen = np.array([(from_(v, b.m) @ [*p, 1])[:3] for v in r])
    assert np.allclose(np.cov(seen.T), Uncertain(b.m, np.eye(6) * 1e-6).point(p)[1], atol=2e-6)


def test_lines_and_voxels():
    assert line_cells(0, 0, 4, 2)[0] == (0, 0) and line_cells(0, 0, 4, 2)[-1] == (4, 2) and len(line_cells(5, 1, 0, 0)) == 6
    path = voxel_path(np.array([0.05, 0.05, 0.05]), np.array([0.95, 0.45, -0.35]), 0.1)
    assert path[0] == (0, 0, 0) and path[-1] == (9, 4, -4) and len(path) == 18
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:]))


def test_elevation_normal(spark):
    g = GridSpec(3, 3, 0.5, 0.5)
    n = raster.normals(cells(spark, [(1, 1, 1.0), (0, 1, 0.5), (2, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0)]), g, "top").first()
    want = np.array([-0.5, -1.0, 1.0])
    assert np.allclose([n.nx, n.ny, n.nz], want / np.linalg.norm(want))


def test_steps_and_slope_of_a_plane(spark):
    g = GridSpec(6, 6, 2.0, 1.0)
    d = cells(spark, [(x, y, 0.5 * 2 * x - 0.25 * y) for x in range(6) for y in range(6)])
    s = raster.slope(d, g).collect()
    assert len(s) == 16 and all(r.slope == pytest.approx(math.acos(1 / math.sqrt(1 + 0.25 + 0.0625))) for r in s)
    t = raster.steps(d, g, threshold=10).collect()
    assert all(r.max_step == pytest.approx(1.25) and r.corrected_step == pytest.approx(0.625) for r in t)


def test_neighbourhood_operators_against_plain_loops(spark):
    r = random.Random(4)
    h = {(x, y): r.uniform(0, 3) for x in range(10) for y in range(10) if r.random() < 0.85}
    d = cells(spark, [(*k, v) for k, v in h.items()])
    got = {(x.xi, x.yi): x.max_step for x in raster.steps(d, UNIT).collect()}
    for (x, y), v in h.items():
        near = [abs(v - h[x + a, y + b]) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (x + a, y + b) in h]
        known = 1 <= x <= 8 and 1 <= y <= 8 and len(near) >= 5
        assert known == ((x, y) in got) and (not known or got[x, y] == pytest.approx(max(near)))
    mean = {(x.xi, x.yi): x.top for x in raster.box_mean(d, "top", 3).collect()}
    for x, y in h:
        assert mean[x, y] == pytest.approx(np.mean([h[a, b] for a in range(x - 2, x + 2) for b in range(y - 2, y + 2) if (a, b) in h]))


def test_quantisation(spark):
    d = spark.createDataFrame([(p,) for p in (0.0, 0.3, 0.5, 0.999, 1.0, 1.5)], "p double").select("p", raster.quantise(F.col("p")).alias("q")).collect()
    assert all(abs(r.q / 255 - min(r.p, 1)) <= 1 / 255 for r in d)


def test_classes_need_a_table(spark):
    d = cells(spark, [(0, 0, 1.0), (1, 0, 2.0)])
    with pytest.raises(Exception, match="no class"):
        raster.classify(d, "top", spark.createDataFrame([(1.0, 7)], "value double, class int")).collect()


def test_points(spark):
    d = spark.createDataFrame([("a", 1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "cloud string, vid long, x double, y double, z double, nx double, ny double, nz double")
    m = affine((0, 0, 5), rotation(roll=math.pi / 2))
    p = points.transform(d, m, normals=True).first()
    assert np.allclose([p.x, p.y, p.z, p.nx, p.ny, p.nz], [1, 0, 5, 0, -1, 0])
    with pytest.raises(ValueError):
        points.merge([(d, m), (d.drop("nx"), m)])
    box = ((0.0, 2.0), (-1.0, 1.0), (4.0, 6.0))
    assert points.cut(d, exclude=[((0.0, 2.0), (-1.0, 1.0), (-1.0, 1.0))]).count() == 0
    assert d.filter(points.bounds_before(m, box)).count() == 1


def test_scan_becomes_points_and_faces(spark):
    d = spark.createDataFrame([(k, 0.01 * k, [2000] * 8, [5000] * 8) for k in range(3)], "line int, phi double, ranges array<int>, remissions array<int>")
    p = points.scan_points(d, -0.04, 0.01, 0.1, 10.0, math.radians(95))
    assert p.count() == 24 and p.filter("is_edge").count() == 6 and p.first().grey == 0.5
    assert p.filter("beam = 4 and line = 0").first().x == pytest.approx(2.0)
    assert points.scan_faces(p, 0.5).count() == 2 * 7 * 2
    assert points.scan_points(d, -0.04, 0.01, 0.1, 1.0, 1.6).count() == 0


def test_patches_to_points(spark):
    g = GridSpec(20, 20, 0.5, 0.5)
    schema = "xi long, yi long, mean double, height double, type int"
    d = spark.createDataFrame([(3, 4, 2.0, 0.0, HORIZONTAL), (5, 5, 3.0, 1.2, VERTICAL), (1, 1, 1.0, 5.0, NEGATIVE)], schema)
    got = sorted((r.x, r.y, r.z) for r in surfaces.to_points(d, g).collect())
    assert got == [(1.75, 2.25, 2.0), (2.75, 2.75, pytest.approx(1.8)), (2.75, 2.75, pytest.approx(2.3)), (2.75, 2.75, pytest.approx(2.8))]


def test_plane_of_samples(spark):
    g = GridSpec(1, 1, 10.0, 10.0)
    d = spark.createDataFrame([(x, y, 2 * x - y + 3, 1.0) for x in (1.0, 2.0, 4.0) for y in (1.0, 3.0)], "x double, y double, z double, sd double")
    p = surfaces.planes(d, g).first()
    assert (p.a, p.b, p.c) == (pytest.approx(2), pytest.approx(-1), pytest.approx(3))
    s = surfaces.weighted(spark.createDataFrame([(0.1, 0.1, 1.0, 1.0), (0.2, 0.1, 1.0, 1.0), (0.1, 0.2, 1.5, 1.0)], "x double, y double, z double, sd double"), g).first()
    assert (s.low, s.high, s.mean) == (1.0, 1.5, pytest.approx(3.5 / 3))


def test_patch_rules():
    p = Patch(1.0, 0.1)
    assert p.absorb(Patch(1.02, 0.1), 0.05, 1.0) and p.type == HORIZONTAL and p.mean == pytest.approx(1.01) and p.n == 2
    assert p.absorb(Patch(1.9, 0.1), 0.05, 1.0) and p.type == VERTICAL and p.mean == 1.9 and p.height == pytest.approx(0.89)
    assert not p.absorb(Patch(9.0, 0.1), 0.05, 1.0)
    free = Patch(3.0, 0.1, 2.5, idx=1, type=NEGATIVE)
    assert not free.absorb(Patch(2.5, 0.1, idx=2), 0.05, 1.0) and free.height == pytest.approx(0.5)
    cell = []
    for z in (1.0, 2.0, 9.0, 1.01):
        surfaces.update(cell, Patch(z, 0.01), 0.05, 0.5)
    assert [round(c.mean, 3) for c in cell] == [9.0, 2.0, 1.005]


def test_fold_equals_a_sequential_run(spark):
    r = random.Random(2)
    rows = [(i, r.uniform(0, 5), r.uniform(0, 5), r.uniform(0, 6), r.uniform(0.01, 0.2)) for i in range(600)]
    d = spark.createDataFrame(rows, "vid long, x double, y double, z double, sd double")
    want = collections.defaultdict(list)
    for _, x, y, z, sd in rows:
        surfaces.update(want[int(x), int(y)], Patch(z, sd, low=z, high=z), 0.05, 0.3)
    got = surfaces.project(d.repartition(5), UNIT, ["vid"], gap=0.3).collect()
    assert sorted((x.xi, x.yi, x.ord, x.mean, x.height, x.n) for x in got) == [(*k, i, p.mean, p.height, p.n) for k in sorted(want) for i, p in enumerate(want[k])]
    one = surfaces.kalman(d, UNIT).join(surfaces.project(d, UNIT, ["vid"], thickness=100.0, gap=100.0).select("xi", "yi", F.col("mean").alias("m2")), ["xi", "yi"]).collect()
    assert all(x.mean == pytest.approx(x.m2) for x in one) and len(one) == len(want)


def test_match_of_a_map_with_itself(spark):
    d = spark.createDataFrame([(x, y, 0, float(x), 0.1) for x in range(5) for y in range(5)], "xi long, yi long, ord int, mean double, stdev double")
    up = d.withColumn("mean", F.col("mean") + 0.3)
    assert surfaces.match_ratio(d, d).first().ratio == 1.0 and surfaces.match_ratio(d, d.limit(0)).first().ratio == 1.0
    assert surfaces.match_height(up, d).first().diff == pytest.approx(0.3)


def random_classes(seed, n=12):
    r = random.Random(seed)
    return {(x, y): r.choice([0, 1, 2, 3, 4, 5, 6, 7]) if r.random() < 0.7 else 7 for x in range(n) for y in range(n)}


def test_growing_and_closing_against_plain_loops(spark):
    c = random_classes(1)
    drive = traversability.drivability(5)
    d = spark.createDataFrame([(*k, v, 0 if v == 0 else 255) for k, v in c.items()], "xi long, yi long, class int, probability int")
    got = {(x.xi, x.yi): x["class"] for x in traversability.grow_classes(d, 2.5, drive).collect()}
    for (x, y), own in c.items():
        near = [(drive[v], int((a, b) != (x, y)), b, a, v) for (a, b), v in c.items() if v and ((a - x) ** 2 + (b - y) ** 2 < 6.25)]
        assert got[x, y] == (min(near)[-1] if near else own)
    got = {(x.xi, x.yi): x["class"] for x in traversability.grow_obstacles(d, 2.0).collect()}
    for (x, y), own in c.items():
        assert got[x, y] == (1 if any(v == 1 and (a - x) ** 2 + (b - y) ** 2 <= 4 for (a, b), v in c.items()) else own)
    g = GridSpec(12, 12, 1.0, 1.0)
    got = {(x.xi, x.yi) for x in traversability.close_passages(d, g, 3.5).filter("class = 1").collect()}
    hit = [k for k, v in c.items() if v == 1]
    want = set(hit)
    for a in hit:
        for b in hit:
            if (b[1], b[0]) > (a[1], a[0]) and math.hypot(a[0] - b[0], a[1] - b[1]) < 3.5:
                want |= {(a[0] + x, a[1] + y) for x, y in line_cells(0, 0, b[0] - a[0], b[1] - a[1])[1:-1]}
    assert got == want


def test_classes(spark):
    d = spark.createDataFrame([(0, 0, 0.0, 0.1), (1, 0, 0.5, 0.1), (2, 0, 1.1, 0.1), (3, 0, None, 0.1), (4, 0, 0.0, 9.0)], "xi long, yi long, slope double, step double")
    got = {r.xi: r["class"] for r in traversability.classes(d, 4, 1.0, 1.0).collect()}
    assert got == {0: 6, 1: 4, 2: 1, 3: 0, 4: 1}
    assert traversability.mean_class(traversability.classes(d, 4, 1.0, 1.0)).first().mean_class == 3


def test_flood_stops_at_walls(spark):
    wall = {(4, y) for y in range(10)} - {(4, 7)}
    rows = [(x, y, 0, 0.9 if (x, y) in wall else 0.1 * x, 0.01, 1.0) for x in range(10) for y in range(10)]
    d = spark.createDataFrame(rows, "xi long, yi long, ord int, mean double, stdev double, n double")
    got = {(r.xi, r.yi): r.is_obstacle for r in traversability.flood(d, (1, 1, 0.1), 1.0, 0.3).collect()}
    assert len(got) == 100 and {k for k, v in got.items() if v} == wall
    closed = d.filter("not (xi = 4 and yi = 7)")
    got = {(r.xi, r.yi) for r in traversability.flood(closed, (1, 1, 0.1), 1.0, 0.3).collect()}
    assert got == {(x, y) for x in range(5) for y in range(10) if (x, y) != (4, 7)}
    k = traversability.classify_flood(traversability.flood(closed, (1, 1, 0.1), 1.0, 0.3), UNIT, 0.3, 1.0, 5)
    assert k.filter("xi = 1 and yi = 5").first()["class"] == 1 + math.ceil((1 - math.atan(0.1) - 0.00001) * 5)


def test_nearest_and_bands_against_brute_force(spark):
    r = np.random.default_rng(3)
    a, b = r.uniform(-1, 1, (120, 3)), r.uniform(-1, 1, (200, 3))
    frame = lambda v: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "id long, x double, y double, z double")
    dist = np.linalg.norm(a[:, None] - b[None], axis=2)
    got = {x.lid: (x.rid, x.d) for x in matching.nearest(frame(a), frame(b), 0.3).collect()}
    for i in range(120):
        assert (dist[i].min() < 0.3) == (i in got)
        if i in got:
            assert got[i] == (int(dist[i].argmin()), pytest.approx(dist[i].min()))
    flat = np.linalg.norm(a[:, None, :2] - b[None, :, :2], axis=2)
    near = ((flat < 0.3) & (np.abs(b[None, :, 2] - a[:, None, 2]) <= 0.2)).sum(1)
    got = {x.lid: x.n for x in matching.count_in_band(frame(a), frame(b), 0.3, -0.2, 0.2).collect()}
    assert [got.get(i, 0) for i in range(120)] == near.tolist()


def test_registration_recovers_a_transform(spark):
    u = np.linspace(-1, 1, 15)
    v = np.array([(x, y, 0.3 * math.sin(3 * x) + 0.2 * math.cos(2 * y)) for x in u for y in u])
    frame = lambda p: spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    m = affine((0.02, -0.03, 0.02), rotation(0.02, -0.01, 0.03))
    t, mse, n = matching.align(frame(v), frame((v - m[:3, 3]) @ m[:3, :3]), 0.3, rounds=8)
    assert np.allclose(t, m, atol=1e-3) and mse < 1e-5 and n > 150
    turn = affine((0.1, 0.2, 0.3), rotation(0.6))
    p = v @ turn[:3, :3].T + turn[:3, 3]
    sums = {"n": len(v), **{f"{s}{a}": w[:, i].sum() for s, w in (("p", v), ("q", p)) for i, a in enumerate("xyz")}, **{f"c{a}{b}": (v[:, i] * p[:, j]).sum() for i, a in enumerate("xyz") for j, b in enumerate("xyz")}}
    assert np.allclose(matching.rigid(sums), turn)
    p[::2] += np.random.default_rng(1).uniform(1, 3, p[::2].shape)
    t, good = matching.consensus(v, p, 0.05)
    assert np.allclose(t, turn, atol=1e-6) and good.sum() == len(v) // 2
    assert abs(matching.best_overlap(lambda x: (x - 0.7) ** 2) - 0.7) < 0.02


def test_outliers_against_brute_force(spark):
    v = np.vstack([np.random.default_rng(3).normal(size=(150, 3)), np.random.default_rng(4).uniform(-90, 90, (30, 3))])
    d = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "id long, x double, y double, z double")
    mean = np.sort(np.linalg.norm(v[:, None] - v[None], axis=2), axis=1)[:, 1:25].mean(axis=1)
    got = {r.id: r.mean_distance for r in matching.outliers_exact(d, 24, 0.05, 1.5).collect()}
    want = set(np.flatnonzero(mean > np.percentile(mean, 95)).tolist())
    assert set(got) == want and len(want) == 9 and all(math.isclose(mean[i], m) for i, m in got.items())


@pytest.mark.parametrize("light, diameter", [((3.3, 4.2, 9.0), 0.0), ((3.3, 4.2, 9.0), 6.0), ((40.0, 3.1, 20.0), 0.0), ((-9.0, 20.0, 12.0), 8.0)])
def test_light_walks_every_cell(spark, light, diameter):
    g, draw = GridSpec(12, 8, 2.0, 1.0), np.random.default_rng(6)
    h = draw.uniform(0, 8, (12, 8))
    at = math.floor(light[0] / 2), math.floor(light[1])
    want = {}
    for x, y in np.ndindex(12, 8):
        dx, dy = light[0] - (x + 0.5) * 2, light[1] - (y + 0.5)
        far, most, cx, cy = math.hypot(dx, dy), 0.0, x, y
        mx, my = far * 2 / abs(dx) / 2, far / abs(dy) / 2
        low, ax, ay = (light[2] - h[x, y] - diameter / 2) / far, 2 * mx, 2 * my
        while (cx, cy) != at:
            if mx < my:
                mx, cx = mx + ax, cx + (1 if dx > 0 else -1)
            else:
                my, cy = my + ay, cy + (1 if dy > 0 else -1)
            if not (0 <= cx < 12 and 0 <= cy < 8) or (cx, cy) == at:
                break
            over = (h[cx, cy] - h[x, y]) / math.hypot((cx - x) * 2, cy - y) - low
            most = max(most, over / (diameter / far) if diameter else float(over > 0))
        want[x, y] = 1 - min(most, 1)
    got = {(r.xi, r.yi): r.illumination for r in raster.illumination_walk(cells(spark, [(x, y, float(h[x, y])) for x, y in np.ndindex(12, 8)]), g, "top", light, diameter).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())
    assert 0 < sum(v < 1 for v in want.values()) < 96


def test_projection_query_has_all_touched_cells(spark):
    d = "/root/testdata/sf0.001"
    touched = {tuple(r) for r in catalogue.q_touched_cells(spark, d).collect()}
    got = {(r.xi, r.yi) for r in catalogue.q_mls_projection_full(spark, d).select("xi", "yi").distinct().collect()}
    assert got == touched and min(x for x, _ in got) < 5 and max(x for x, _ in got) > 15


def test_consensus_reads_all_pairs_and_adapts(spark):
    draw = np.random.default_rng(2)
    v = draw.uniform(-5, 5, (600, 3))
    turn = affine((0.1, 0.2, 0.3), rotation(0.6))
    p = v @ turn[:3, :3].T + turn[:3, 3]
    p[:480] += draw.uniform(1, 3, (480, 3))
    pairs = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(v, p, strict=True))], "id long, px double, py double, pz double, qx double, qy double, qz double")
    t, n, tried, enough = matching.consensus_pairs(pairs, 0.05)
    assert np.allclose(t, turn, atol=1e-6) and n == 120 and enough and tried > 200
    assert not matching.consensus_pairs(pairs.filter("id < 480"), 1e-9, most=64)[3]


def test_consensus_query_counts_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    want = catalogue.pts(spark, d).filter("vid % 3 <> 0").count()
    got = catalogue.q_consensus(spark, d).collect()
    assert {r.agreeing for r in got} == {want} and want > 60
    assert np.allclose([[r.a, r.b, r.c, r.t] for r in got], catalogue.TURN[:3], atol=1e-5)


def test_polygons(spark):
    square = lambda x, y: [(x + a, y + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    d = spark.createDataFrame([(1, square(0.0, 0.0))], "id long, pts array<struct<x:double,y:double>>")
    e = spark.createDataFrame([(1, square(2.0, 2.0)), (2, square(0.5, 0.5)), (3, [(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)]), (4, square(30.0, 0.0))], "id long, pts array<struct<x:double,y:double>>")
    got = {r.rid: (r.distance, r.contains) for r in polygons.near_pairs(d, e, 5.0, bucket=1.5).collect()}
    assert got == {1: (pytest.approx(math.sqrt(2)), False), 2: (0.0, False), 3: (0.0, True)}


def test_poses(spark):
    r = np.random.default_rng(5)
    rows = [("a", *map(float, p), 1.0) for p in r.normal(0, 1, (200, 2))] + [("a", 90.0, 90.0, 1.0)]
    d = spark.createDataFrame(rows, "g string, x double, y double, weight double")
    m = poses.weighted_moments(d, ["x", "y"], "g").first()
    v = np.array([x[1:3] for x in rows])
    assert m.mean_x == pytest.approx(v[:, 0].mean()) and m.cov_x_y == pytest.approx(np.cov(v.T, bias=True)[0, 1])
    assert poses.cleaned(d, ["x", "y"], "g", 5.0).count() == 200
    h = poses.histogram(d, F.col("x"), -1.0, 1.0, 4)
    assert h.agg(F.sum("n")).first()[0] == 201 and poses.linear_score(h, [1.0] * 6, 0.5).first().score == pytest.approx(1.5)
    assert poses.kmeans(d, ["x", "y"], 2).select("cluster").distinct().count() == 2


def test_terrain_is_slope_and_steps(spark):
    rows = [(x, y, float((x * 7 + y * 3) % 5)) for x in range(6) for y in range(6) if (x, y) != (2, 3)]
    cells, spec = spark.createDataFrame(rows, "xi long, yi long, top double"), GridSpec(6, 6, 0.5, 1.0)
    one = {(r.xi, r.yi): (r.slope, r.max_step) for r in raster.terrain(cells, spec).collect()}
    slope = {(r.xi, r.yi): r.slope for r in raster.slope(cells, spec).collect()}
    step = {(r.xi, r.yi): r.max_step for r in raster.steps(cells, spec).collect()}
    assert one.keys() == slope.keys() == step.keys() and all(one[k] == pytest.approx((slope[k], step[k])) for k in one)


def test_gated_sums_equal_an_update_by_rising_height(spark):
    import random

    r = random.Random(4)
    rows = [(r.uniform(0, 2), r.uniform(0, 2), r.choice([0, 5, 11]) + r.uniform(0, 3), r.choice([0.5, 1.0])) for _ in range(120)]
    grid = GridSpec(2, 2, 1.0, 1.0)
    got = {}
    for x in surfaces.gated_sums(spark.createDataFrame(rows, "x double, y double, z double, sd double"), grid, 0.8).orderBy("xi", "yi", "ord").collect():
        got.setdefault((x.xi, x.yi), []).append((x.low, x.high, x.n, pytest.approx(x.mean), pytest.approx(x.w)))
    for cell, have in got.items():
        patches = []
        for _, _, z, sd in sorted((p for p in rows if (int(p[0]), int(p[1])) == cell), key=lambda p: p[2]):
            # The patch widened by the gap reaches over the measurement, an interval of no length.
            at = next((p for p in patches if p[0] - 0.8 < z < p[1] + 0.8), None)
            if at is None:
                patches.append(at := [z, z, 0, 0.0, 0.0])
            at[0], at[1], at[2], at[3], at[4] = min(at[0], z), max(at[1], z), at[2] + 1, at[3] + z / sd**2, at[4] + 1 / sd**2
        assert [(p[0], p[1], p[2], p[3] / p[4], p[4]) for p in patches] == have


def test_planes_of_few_measurements_lie_flat(spark):
    rows = [(0.1, 0.1, 1.0, 1.0), (0.9, 0.2, 2.0, 1.0), (0.5, 0.8, 3.0, 1.0)] + [(1 + a, b, 5 + a + 2 * b, 1.0) for a in (0.1, 0.6, 0.9) for b in (0.2, 0.7)]
    p = {x.xi: x for x in surfaces.gated_planes(spark.createDataFrame(rows, "x double, y double, z double, sd double"), GridSpec(2, 1, 1.0, 1.0), 3.0).withColumn("slope", surfaces.plane_slope()).withColumn("h", surfaces.plane_height(F.lit(0.5), F.lit(0.5))).collect()}
    assert (p[0].a, p[0].b, p[0].c) == (0, 0, pytest.approx(2)) and p[0].slope == 0
    assert (p[1].a, p[1].b, p[1].c, p[1].h) == pytest.approx((1, 2, 5, 6.5))


def test_moved_maps_merge(spark):
    grid = GridSpec(4, 4, 1.0, 1.0)
    a = spark.createDataFrame([(1, 2, 0, 5.0, 0.1, 0.0, 1.0, 5.0, 5.0, 0, 1)], surfaces.PATCH)
    got = surfaces.moved(a, grid, GridSpec(4, 4, 1.0, 1.0, -4.0, 0.0), affine((0, 0, 1), rotation(yaw=np.pi / 2)), 0.04).collect()
    # (1.5, 2.5) turns to (-2.5, 1.5).
    assert [(r.xi, r.yi, r.mean, r.low, round(r.stdev, 6)) for r in got] == [(1, 1, 6.0, 6.0, round(0.05**0.5, 6))]
    assert surfaces.moved(a, grid, grid, affine((10, 0, 0))).count() == 0
    assert surfaces.merge([a, surfaces.moved(a, grid, grid, affine())]).first().n == 2


def test_interval_overlap(spark):
    d = spark.createDataFrame([(0.0, 2.0, 1.0, 3.0), (1.0, 3.0, 0.0, 2.0), (0.0, 3.0, 1.0, 2.0), (1.0, 2.0, 0.0, 3.0), (1.0, 2.0, 1.0, 2.0), (0.0, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert [r[0] for r in d.select(surfaces.overlap(*(F.col(n) for n in "abcd"))).collect()] == [True, True, True, False, False, False]


def test_flood_starts_in_the_nearest_ring(spark):
    rows = [(x, y, 0, 0.0, 0.1, 1.0) for x in range(5, 9) for y in range(5, 9)] + [(3, 3, 0, 50.0, 0.1, 1.0)]
    p = spark.createDataFrame(rows, "xi long, yi long, ord int, mean double, stdev double, n double")
    got = traversability.flood(p, (2, 6, 0.0), 2.0, 0.5)
    assert got.count() == 16 and got.filter("level = 0").select("xi").first().xi == 5
    with pytest.raises(ValueError):
        traversability.flood(p, (60, 60, 0.0), 2.0, 0.5)


def test_rectangles_at_the_rim_equal_their_coordinates(spark):
    """Distances and containment of rectangles are decided by their coordinates as they are, as in the query's SQL."""
    draw = np.random.default_rng(8)
    at = draw.integers(0, 400, (150, 1)) / 100
    s, c = np.hstack([at, draw.integers(0, 3, (150, 1)) * 4.0]), np.hstack([at + draw.choice([-3.0, 0.0, 2.0, 5.0], (150, 1)), draw.integers(0, 3, (150, 1)) * 4.0])
    box = lambda p, size: [(float(p[0] + a), float(p[1] + b)) for a, b in ((0, 0), (size, 0), (size, size), (0, size))]
    shape = lambda v, size: spark.createDataFrame([(i, box(p, size)) for i, p in enumerate(v)] * 2, "id long, pts array<struct<x:double,y:double>>").repartition(3)
    got = sorted(map(tuple, polygons.near_pairs(shape(s, 3.0), shape(c, 1.0), 2.0, bucket=1.0).collect()))
    gap = lambda a: np.maximum(0.0, np.maximum(s[:, None, a] - (c[None, :, a] + 1), c[None, :, a] - (s[:, None, a] + 3)))
    far = np.sqrt(gap(0) ** 2 + gap(1) ** 2)
    has = ((c[None] >= s[:, None]) & (c[None] + 1 <= s[:, None] + 3)).all(-1)
    # Every id is there twice, so each pair is there four times.
    assert got == sorted((i, j, pytest.approx(far[i, j], abs=1e-12), bool(has[i, j])) for i in range(150) for j in range(150) if far[i, j] <= 2 for _ in range(4))
