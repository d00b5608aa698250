import pytest
from pyspark.sql import functions as F

from stratamap import cli
from stratamap.geometry import GridSpec
from stratamap.operators import points, raster, surfaces
from stratamap.plans.catalog import Catalog, Item
from stratamap.sources import scene


def test_lookup_takes_the_newest_grid(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.5, 0.5), (3, 50.0, 0.5)], "vid long, x double, y double")
    old = spark.createDataFrame([(0, 0, 1.0), (5, 0, 2.0)], "xi long, yi long, h double")
    new = spark.createDataFrame([(0, 0, 9.0), (5, 0, None)], "xi long, yi long, h double")
    g = GridSpec(10, 1, 1.0, 1.0)
    assert {r.vid: r.value for r in raster.lookup(p, [(old, g), (new, g)], "h").collect()} == {1: 9.0, 2: 2.0}


def test_height_between_centres(spark):
    g = GridSpec(3, 3, 0.5, 0.5)
    d = spark.createDataFrame([(x, y, 2.0 * (x + 0.5) * 0.5 + 1.0) for x in range(3) for y in range(3)], "xi long, yi long, top double")
    p = spark.createDataFrame([(0.9, 0.7)], "x double, y double")
    assert raster.height_at(p, d, g, "top").first().height == pytest.approx(2.8)


def test_bands(spark):
    g = GridSpec(4, 4, 1.0, 1.0)
    d = raster.empty(g, spark, h=0.0)
    assert d.count() == 16 and raster.shift(d, g, 1, 0).count() == 12
    small = raster.empty(GridSpec(2, 2, 2.0, 2.0), spark).withColumn("k", F.col("xi") + 10 * F.col("yi"))
    assert raster.copy_band(d, small, "k", 2).filter("xi = 3 and yi = 2").first().k == 11
    assert raster.add_slope(d, g, "h", 1.0, 0.0).agg(F.max("h")).first()[0] == 3.5
    assert raster.add_sphere(d, g, "h", 2.5, 2.5, 1.0).agg(F.max("h")).first()[0] == 1.0
    assert raster.add_bump(d, g, "h", 3.0, 0.5, 0.5, 1.0).agg(F.max("h")).first()[0] == 3.0
    assert raster.add_noise(d, "h", 1.0, 5).collect() == raster.add_noise(d, "h", 1.0, 5).collect()


def test_last_face_gives_the_normal(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 3, 1)], "fid long, a long, b long, c long")
    n = {r.vid: (r.nx, r.ny, r.nz) for r in points.vertex_normals(v, f).collect()}
    assert n[2] == (0, 0, 1) and n[0] == (0, 1, 0) == n[3]


def test_surface_following_and_grid_choice():
    cells = {(0, 0): [0.0, 5.0], (1, 0): [0.4, 4.0], (2, 0): []}
    assert surfaces.follow([(0, 0), (1, 0), (2, 0)], cells, 0.1) == [0.0, 0.4, 0.4]
    assert surfaces.choose_grid({"a": (0, 0), "b": (5, 5)}, 4, 9, 4.5) == "b" and surfaces.choose_grid({"a": (0, 0)}, 9, 0, 4.0) is None


def test_command_line(spark, tmp_path):
    c = Catalog()
    m = c.attach(Item("map", "cloud", frame=spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 3.0, 1.0, 2.0)], "vid long, x double, y double, z double")))
    scene.save(c, spark, f"{tmp_path}/a")
    assert m in cli.main(["info", f"{tmp_path}/a"], spark) and "digraph" in cli.main(["graphviz", f"{tmp_path}/a"], spark)
    cli.main(["elevation", f"{tmp_path}/a", f"{tmp_path}/b", m, "1.0"], spark)
    cli.main(["surface", f"{tmp_path}/b", f"{tmp_path}/c", m, "1.0"], spark)
    back = scene.load(spark, f"{tmp_path}/c")
    assert sorted(x.label for x in back.items.values() if x.kind == "map") == ["cloud", "elevation", "surface"]
    cli.main(["delete", f"{tmp_path}/c", f"{tmp_path}/d", m], spark)
    assert m not in scene.load(spark, f"{tmp_path}/d").items
