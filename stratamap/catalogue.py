"""The registered queries over the driver's tables and their SQL, where SQL can express them.

The tables have no maps, so a few views give them the shape of some: line items are points of three clouds, nations a frame tree,
events a change log, customers and suppliers points of interest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .geometry import GridSpec, Uncertain, affine, line_cells, rotation
from .lineage import cut
from .operators import matching, points, polygons, poses, raster, surfaces, traversability
from .streaming import changes

GRID = GridSpec(26, 11, 2.0, 1.0)
COARSE = GridSpec(13, 3, 4.0, 5.0)
TURN = affine((1.0, -2.0, 0.5), rotation(0.1, -0.2, 0.5))
SHIFTS = {"A": affine((1.0, 0.0, 0.0)), "N": affine((0.0, 2.0, 0.0), rotation(yaw=0.25)), "R": affine((0.0, 0.0, -3.0))}
INCLUDE, EXCLUDE = ((5.0, 40.0), (1.0, 9.0), (10.0, 60.0)), ((10.0, 20.0), (2.0, 5.0), (20.0, 40.0))
LIGHT = (60.0, 5.0, 250.0)
COUNT, MAX_SLOPE, CLEARANCE, RADIUS, WIDTH = 5, 1.55, 45.0, 2.0, 5.0
DRIVE = traversability.drivability(COUNT)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _t(spark, d, "lineitem").select(c("l_returnflag").alias("cloud"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("vid"), c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), (c("l_extendedprice") / 1000).alias("z"), (c("l_tax") + 0.05).alias("sd"))


def tops(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their highest and lowest point."""
    return raster.elevation(pts(spark, d), GRID).select("xi", "yi", F.col("elevation_max").alias("top"), F.col("elevation_min").alias("low"), "n")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


P = "pts AS (SELECT l_returnflag AS cloud, l_orderkey * 8 + l_linenumber AS vid, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z, l_tax + 0.05 AS sd FROM lineitem)"
C = P + ", cells AS (SELECT CAST(floor(x / 2) AS BIGINT) AS xi, CAST(floor(y) AS BIGINT) AS yi, max(z) AS top, min(z) AS low, count(*) AS n FROM pts GROUP BY 1, 2)"
N = C + """, o(dx, dy) AS (VALUES (0, 1), (0, -1), (-1, -1), (1, 1), (-1, 0), (1, 0), (-1, 1), (1, -1)),
nb AS (SELECT a.xi, a.yi, a.top AS own, o.dx, o.dy, b.top AS other FROM cells a CROSS JOIN o JOIN cells b ON b.xi = a.xi + o.dx AND b.yi = a.yi + o.dy)"""
_dirs = raster.OPPOSITE
_slots = ", ".join(f"coalesce(max(CASE WHEN dx = {a} AND dy = {b} THEN abs(own - other) END), 0) AS s{i}" for i, (a, b) in enumerate(_dirs))
_level = ", ".join(f"s{i} - (s{i} + s{i + 1}) / 4, s{i} - (s{i} + s{i + 1}) * 3 / 4" for i in range(0, 8, 2))
INNER = "xi BETWEEN 1 AND 24 AND yi BETWEEN 1 AND 9"


def _steps(threshold: float) -> str:
    return f"""sl AS (SELECT xi, yi, count(*) AS k, {_slots} FROM nb WHERE {INNER} GROUP BY 1, 2 HAVING count(*) >= 5),
st AS (SELECT xi, yi, greatest(s0, s1, s2, s3, s4, s5, s6, s7) AS max_step, greatest({_level}) AS level FROM sl),
steps AS (SELECT xi, yi, max_step, CASE WHEN max_step < {threshold} THEN level ELSE max_step END AS corrected_step FROM st)"""


SLOPE = f"""su AS (SELECT xi, yi, count(*) + 1 AS n, sum(dx * 2.0) AS x, sum(dy * 1.0) AS y, sum(own - other) AS z, sum(dx * dx * 4.0) AS xx, sum(dx * dy * 2.0) AS xy, sum(dy * dy * 1.0) AS yy, sum(dx * 2.0 * (own - other)) AS xz, sum(dy * 1.0 * (own - other)) AS yz FROM nb WHERE {INNER} GROUP BY 1, 2 HAVING count(*) >= 5),
de AS (SELECT *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) AS det FROM su),
ab AS (SELECT xi, yi, (xz * (yy * n - y * y) - xy * (yz * n - y * z) + x * (yz * y - yy * z)) / det AS a, (xx * (yz * n - z * y) - xz * (xy * n - y * x) + x * (xy * z - yz * x)) / det AS b FROM de),
slopes AS (SELECT xi, yi, acos(1 / sqrt(a * a + b * b + 1)) AS slope FROM ab)"""
T = f"""{N}, {_steps(0.25)}, {SLOPE}, joined AS (SELECT cells.xi, cells.yi, slope, max_step AS step FROM cells LEFT JOIN slopes USING (xi, yi) LEFT JOIN steps USING (xi, yi)),
tr AS (SELECT xi, yi, CAST(CASE WHEN step > {CLEARANCE} THEN 1 WHEN slope IS NULL THEN 0 WHEN abs(slope) > {MAX_SLOPE} THEN 1 ELSE {2 + COUNT} - round_even(abs(slope) / {MAX_SLOPE} * {COUNT}, 0) END AS INTEGER) AS class FROM joined),
trav AS (SELECT xi, yi, class, CASE WHEN class = 0 THEN 0 ELSE 255 END AS probability FROM tr)"""
_drive = "CASE class " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in DRIVE.items()) + " END"


def trav(spark: SparkSession, d: str) -> DataFrame:
    cells = tops(spark, d)
    both = cells.select("xi", "yi").join(raster.terrain(cells, GRID).withColumnRenamed("max_step", "step"), ["xi", "yi"], "left")
    return traversability.classes(both, COUNT, MAX_SLOPE, CLEARANCE)


def _affine_sql(m: np.ndarray, digits: int = 6) -> str:
    return ", ".join(f"round({float(r[0])!r} * x + {float(r[1])!r} * y + {float(r[2])!r} * z + {float(r[3])!r}, {digits}) AS {n}" for n, r in zip("xyz", m, strict=False))


@query(f"WITH {C} SELECT xi, yi, low AS elevation_min, top AS elevation_max, n FROM cells")
def q_elevation_minmax(spark, d):
    return raster.elevation(pts(spark, d), GRID)


@query(f"WITH {P} SELECT cloud, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts GROUP BY cloud")
def q_cloud_extents(spark, d):
    return points.extents(pts(spark, d), ["cloud"])


@query(f"WITH {C} SELECT xi, yi FROM cells")
def q_touched_cells(spark, d):
    return raster.to_cells(pts(spark, d), GRID).select("xi", "yi").distinct()


@query(f"WITH {P} SELECT cloud, CAST(floor(x / 2) AS BIGINT) AS xi, CAST(floor(y) AS BIGINT) AS yi, count(*) AS n FROM pts GROUP BY 1, 2, 3")
def q_cell_counts(spark, d):
    return raster.to_cells(pts(spark, d), GRID).groupBy("cloud", "xi", "yi").agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT cloud, vid, {_affine_sql(TURN)} FROM pts")
def q_transform_points(spark, d):
    return rounded(points.transform(pts(spark, d), TURN), 6, "x", "y", "z").select("cloud", "vid", "x", "y", "z")


@query(f"WITH {P} " + " UNION ALL ".join(f"SELECT cloud, vid, {_affine_sql(m)} FROM pts WHERE cloud = '{k}'" for k, m in SHIFTS.items()))
def q_merge_clouds(spark, d):
    p = pts(spark, d).select("cloud", "vid", "x", "y", "z")
    return rounded(points.merge([(p.filter(F.col("cloud") == k), m) for k, m in SHIFTS.items()]), 6, "x", "y", "z")


def _box_sql(box) -> str:
    return " AND ".join(f"{n} BETWEEN {lo} AND {hi}" for n, (lo, hi) in zip("xyz", box, strict=True))


@query(f"WITH {P} SELECT cloud, vid, x, y, z FROM pts WHERE {_box_sql(INCLUDE)} AND NOT ({_box_sql(EXCLUDE)})")
def q_cut_boxes(spark, d):
    return points.cut(pts(spark, d), [INCLUDE], [EXCLUDE]).select("cloud", "vid", "x", "y", "z")


@query(f"WITH {P} SELECT CAST(floor(x / 2) AS BIGINT) AS xi, CAST(floor(y) AS BIGINT) AS yi, min(z) AS elevation_min, max(z) AS elevation_max, count(*) AS n FROM pts WHERE x BETWEEN 10 AND 30 AND y BETWEEN 2 AND 8 GROUP BY 1, 2")
def q_area_of_interest(spark, d):
    return raster.elevation(pts(spark, d).filter("x between 10 and 30 and y between 2 and 8"), GRID)


_c, _s = float(np.cos(0.4)), float(np.sin(0.4))


@query(f"WITH {C}, uv AS (SELECT xi, yi, (((xi + 0.5) * 2 - 24) * {_c!r} + (yi + 0.5 - 5) * {_s!r}) AS u, ((yi + 0.5 - 5) * {_c!r} - ((xi + 0.5) * 2 - 24) * {_s!r}) AS v FROM cells) SELECT xi, yi, round(CAST(u AS DOUBLE), 6) AS u, round(CAST(v AS DOUBLE), 6) AS v, abs(u) <= 5 AND abs(v) <= 1.5 AS inside FROM uv WHERE abs(u) <= 10 AND abs(v) <= 3")
def q_rotated_rect(spark, d):
    r = raster.ring(tops(spark, d).select("xi", "yi"), GRID, 24.0, 5.0, 0.4, (20.0, 6.0), (10.0, 3.0))
    return rounded(r.withColumnRenamed("inner", "inside"), 6, "u", "v")


@query(f"WITH {P} SELECT CAST(floor(x / 5) AS BIGINT) AS vx, CAST(floor(y / 5) AS BIGINT) AS vy, CAST(floor(z / 5) AS BIGINT) AS vz, min(vid) AS vid, arg_min(x, vid) AS x, arg_min(y, vid) AS y, arg_min(z, vid) AS z FROM pts GROUP BY 1, 2, 3")
def q_voxel_first(spark, d):
    return points.voxel_first(pts(spark, d).select("vid", "x", "y", "z"), 5.0)


@query(f"WITH {P} SELECT cloud, vid, x, y, z FROM pts WHERE vid % 7 = 0")
def q_density_sample(spark, d):
    return points.every(pts(spark, d), 7).select("cloud", "vid", "x", "y", "z")


KAL = "SELECT {by} CAST(floor(x / 2) AS BIGINT) AS xi, CAST(floor(y) AS BIGINT) AS yi, sum(z / (sd * sd)) / sum(1 / (sd * sd)) AS mean, 1 / sqrt(sum(1 / (sd * sd))) AS stdev, count(*) AS n FROM pts {where} GROUP BY ALL"


@query(f"WITH {P}, k AS ({KAL.format(by='', where='')}) SELECT xi, yi, round(mean, 6) AS mean, round(stdev, 6) AS stdev, n FROM k")
def q_kalman_fuse(spark, d):
    return rounded(surfaces.kalman(pts(spark, d), GRID), 6, "mean", "stdev")


@query(f"WITH {P}, s AS (SELECT CAST(floor(x / 2) AS BIGINT) AS xi, CAST(floor(y) AS BIGINT) AS yi, sum(1 / (sd * sd)) AS w, sum(1 / (sd * sd) * z) AS wz, sum(1 / (sd * sd) * z * z) AS wzz, sum(1 / (sd * sd) * (1 / (sd * sd))) AS ww, min(z) AS low, max(z) AS high, count(*) AS n FROM pts GROUP BY 1, 2) SELECT xi, yi, round(wz / w, 5) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest((wzz / w - (wz / w) * (wz / w)) * w * w / (w * w - ww), 1e-6)) ELSE 1 / sqrt(w) END, 5) AS stdev, low, high, n FROM s")
def q_sum_patch(spark, d):
    return rounded(surfaces.weighted(pts(spark, d), GRID), 5, "mean", "stdev")


@query(f"""WITH {P}, q AS (SELECT CAST(floor(x / 4) AS BIGINT) AS xi, CAST(floor(y / 5) AS BIGINT) AS yi, x - floor(x / 4) * 4 AS px, y - floor(y / 5) * 5 AS py, z, 1 / (sd * sd) AS w FROM pts),
s AS (SELECT xi, yi, count(*) AS k, sum(w) AS n, sum(w * px) AS x, sum(w * py) AS y, sum(w * z) AS z, sum(w * px * px) AS xx, sum(w * px * py) AS xy, sum(w * py * py) AS yy, sum(w * px * z) AS xz, sum(w * py * z) AS yz FROM q GROUP BY 1, 2 HAVING count(*) > 3),
e AS (SELECT *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) AS det FROM s)
SELECT xi, yi, k, round((xz * (yy * n - y * y) - xy * (yz * n - y * z) + x * (yz * y - yy * z)) / det, 4) AS a, round((xx * (yz * n - z * y) - xz * (xy * n - y * x) + x * (xy * z - yz * x)) / det, 4) AS b, round((xx * (yy * z - y * yz) - xy * (xy * z - yz * x) + xz * (xy * y - yy * x)) / det, 4) AS c FROM e WHERE det > 1e-3 * xx * yy * n""")
def q_plane_patch(spark, d):
    # A cell whose points are on one line has no plane.
    p = surfaces.planes(pts(spark, d), COARSE, least=1e-3)
    return rounded(p, 4, "a", "b", "c")


def kalman_by_cloud(spark, d) -> DataFrame:
    w = 1 / (F.col("sd") * F.col("sd"))
    s = raster.to_cells(pts(spark, d), GRID).groupBy("cloud", "xi", "yi").agg(F.sum(F.col("z") * w).alias("wz"), F.sum(w).alias("w"), F.count("*").alias("n"))
    ord_ = (F.instr(F.lit("ANR"), F.col("cloud")) - 1).cast("int")
    p = s.select("xi", "yi", (F.col("wz") / F.col("w")).alias("mean"), (1 / F.sqrt("w")).alias("stdev"), "n", ord_.alias("ord"))
    return p.withColumns({"height": F.lit(0.0), "type": F.lit(1), "low": F.col("mean"), "high": F.col("mean"), "idx": F.col("ord").cast("long")})


_WZ = "1 / (sd * sd)"
ISLANDS = f"""{P}, q AS (SELECT *, CAST(floor(x / 2) AS BIGINT) AS xi, CAST(floor(y) AS BIGINT) AS yi, x - floor(x / 2) * 2 AS px, y - floor(y) AS py, {_WZ} AS w FROM pts),
g AS (SELECT *, CASE WHEN z - lag(z) OVER (PARTITION BY xi, yi ORDER BY z) >= {{gap}} THEN 1 ELSE 0 END AS fresh FROM q),
i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY xi, yi ORDER BY z ROWS UNBOUNDED PRECEDING) AS INTEGER) AS ord FROM g)"""


@query(f"""WITH {ISLANDS.format(gap=0.5)}, s AS (SELECT xi, yi, ord, sum(w) AS w, sum(w * z) AS wz, sum(w * z * z) AS wzz, sum(w * w) AS ww, min(z) AS low, max(z) AS high, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT xi, yi, ord, round(wz / w, 9) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(greatest(0.0, wzz / w - (wz / w) * (wz / w)) * w * w / nullif(w * w - ww, 0), 1e-6)) ELSE 1 / sqrt(w) END, 4) AS stdev, low, high, n FROM s""")
def q_gated_sums(spark, d):
    s = surfaces.gated_sums(pts(spark, d), GRID, 0.5).drop("w")
    return rounded(rounded(s, 9, "mean"), 4, "stdev")


@query(f"""WITH {ISLANDS.format(gap=5.0)}, s AS (SELECT xi, yi, ord, count(*) AS k, sum(w) AS n, min(z) AS low, max(z) AS high, sum(w * px) AS x, sum(w * py) AS y, sum(w * z) AS z, sum(w * px * px) AS xx, sum(w * px * py) AS xy, sum(w * py * py) AS yy, sum(w * px * z) AS xz, sum(w * py * z) AS yz FROM i GROUP BY 1, 2, 3),
e AS (SELECT *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) AS det FROM s), f AS (SELECT *, k > 3 AND det > 1e-3 * xx * yy * n AS solid FROM e)
SELECT xi, yi, ord, k, low, high, round(CASE WHEN solid THEN (xz * (yy * n - y * y) - xy * (yz * n - y * z) + x * (yz * y - yy * z)) / det ELSE 0 END, 6) AS a, round(CASE WHEN solid THEN (xx * (yz * n - z * y) - xz * (xy * n - y * x) + x * (xy * z - yz * x)) / det ELSE 0 END, 6) AS b, round(CASE WHEN solid THEN (xx * (yy * z - y * yz) - xy * (xy * z - yz * x) + xz * (xy * y - yy * x)) / det ELSE z / n END, 6) AS c FROM f""")
def q_gated_planes(spark, d):
    return rounded(surfaces.gated_planes(pts(spark, d), GRID, 5.0), 6, "a", "b", "c").select("xi", "yi", "ord", "k", "low", "high", "a", "b", "c")


@query(f"WITH {C} SELECT a.xi, a.yi, (a.low < b.top AND a.top > b.top) OR (a.low < b.low AND a.top > b.low) AS over FROM cells a JOIN cells b ON b.xi = a.xi + 1 AND b.yi = a.yi")
def q_interval_overlap(spark, d):
    """Whether a cell's span of heights reaches over an end of that of the cell to its right."""
    c = tops(spark, d)
    right = c.select((F.col("xi") - 1).alias("xi"), "yi", F.col("low").alias("low2"), F.col("top").alias("top2"))
    return c.join(right, ["xi", "yi"]).select("xi", "yi", surfaces.overlap(F.col("low"), F.col("top"), F.col("low2"), F.col("top2")).alias("over"))


SLOW_TURN = affine((3.0, -1.0, 2.0), rotation(0.02, -0.01, 0.3))
WIDE = GridSpec(40, 30, 2.0, 1.0, -12.0, -6.0)
_to = ", ".join(f"{float(r[0])!r} * ((xi + 0.5) * 2) + {float(r[1])!r} * (yi + 0.5) + {float(r[2])!r} * mean + {float(r[3])!r} AS {n}" for n, r in zip("uvw", SLOW_TURN, strict=False))


@query(f"WITH {P}, k AS ({KAL.format(by='cloud,', where='')}), t AS (SELECT cloud, {_to}, stdev, n FROM k), c AS (SELECT cloud, CAST(floor((u + 12.0) / 2) AS BIGINT) AS xi, CAST(floor(v + 6.0) AS BIGINT) AS yi, w, stdev, n FROM t) SELECT xi, yi, CAST(CASE cloud WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS ord, round(w, 6) AS mean, round(sqrt(stdev * stdev + 0.04), 6) AS stdev, n FROM c WHERE xi BETWEEN 0 AND 39 AND yi BETWEEN 0 AND 29")
def q_moved_patches(spark, d):
    return rounded(surfaces.moved(kalman_by_cloud(spark, d), GRID, WIDE, SLOW_TURN, 0.04).select("xi", "yi", "ord", "mean", "stdev", "n"), 6, "mean", "stdev")


@query()
def q_merge_moved(spark, d):
    """One cloud's map and another's, which is turned against it, in one map."""
    k = kalman_by_cloud(spark, d)
    still, turned = (surfaces.moved(k.filter(F.col("ord") == i), GRID, WIDE, m, v) for i, m, v in ((0, affine(), 0.0), (1, SLOW_TURN, 0.04)))
    return rounded(surfaces.merge([still, turned], gap=20.0), 6, "mean", "stdev", "height")


@query(f"WITH {P}, k AS ({KAL.format(by='cloud,', where='')}) SELECT xi, yi, round(max(mean), 6) AS mean, round(arg_max(stdev, mean), 6) AS stdev FROM k GROUP BY 1, 2")
def q_top_patch(spark, d):
    return rounded(surfaces.top(kalman_by_cloud(spark, d)).select("xi", "yi", "mean", "stdev"), 6, "mean", "stdev")


@query(f"WITH {C}, p AS (SELECT xi, yi, top, top - low AS h FROM cells), v AS (SELECT xi, yi, top - h + 1.5 * unnest(generate_series(0, CAST(floor(h / 1.5) AS BIGINT))) AS z FROM p WHERE h > 20 UNION ALL SELECT xi, yi, top FROM p WHERE h <= 20) SELECT xi, yi, CAST((xi + 0.5) * 2 AS DOUBLE) AS x, CAST(yi + 0.5 AS DOUBLE) AS y, round(z, 6) AS z FROM v")
def q_mls_to_points(spark, d):
    h = F.col("top") - F.col("low")
    patches = tops(spark, d).select("xi", "yi", F.col("top").alias("mean"), h.alias("height"), F.when(h > 20, surfaces.VERTICAL).otherwise(surfaces.HORIZONTAL).alias("type"))
    return rounded(surfaces.to_points(patches, GRID), 6, "z").select("xi", "yi", F.col("x").cast("double"), F.col("y").cast("double"), "z")


@query(f"WITH {C}, t AS (SELECT a.range AS xi, b.range AS yi FROM range(13) a, range(6) b) SELECT t.xi, t.yi, c.top + 2.0 AS mean, CAST(0 AS DOUBLE) AS stdev FROM t JOIN cells c ON c.xi = CAST(floor((t.xi * 4.0 - 1.0) / 2) AS BIGINT) AND c.yi = CAST(floor(t.yi * 2.0 - 0.5) AS BIGINT)")
def q_grid_to_mls(spark, d):
    return surfaces.from_grid(tops(spark, d), GRID, GridSpec(13, 6, 4.0, 2.0), "top", (1.0, 0.5, 2.0))


@query()
def q_mls_projection_full(spark, d):
    return rounded(surfaces.project(pts(spark, d), GRID, ["cloud", "vid"], gap=1.0), 6, "mean", "stdev", "height")


@query()
def q_merge_mls(spark, d):
    return rounded(surfaces.merge([kalman_by_cloud(spark, d).filter(F.col("ord") == i) for i in range(3)], gap=20.0), 6, "mean", "stdev", "height")


AB = f"a AS ({KAL.format(by='', where=chr(39).join(['WHERE cloud = ', 'A', '']))}), b AS ({KAL.format(by='', where=chr(39).join(['WHERE cloud = ', 'N', '']))})"


def _ab(spark, d) -> tuple[DataFrame, DataFrame]:
    k = kalman_by_cloud(spark, d)
    return k.filter("ord = 0"), k.filter("ord = 1")


@query(f"WITH {P}, {AB} SELECT round(avg(CASE WHEN abs(a.mean - b.mean) < 300.0 * sqrt(a.stdev * a.stdev + b.stdev * b.stdev) THEN 1 ELSE 0 END), 9) AS ratio, count(*) AS cells FROM a JOIN b USING (xi, yi)")
def q_match_ratio(spark, d):
    return rounded(surfaces.match_ratio(*_ab(spark, d), k=300.0), 9, "ratio")


@query(f"WITH {P}, {AB} SELECT round(sum((a.mean - b.mean) / (a.stdev * a.stdev + b.stdev * b.stdev)) / sum(1 / (a.stdev * a.stdev + b.stdev * b.stdev)), 6) AS diff, round(1 / sum(1 / (a.stdev * a.stdev + b.stdev * b.stdev)), 9) AS variance FROM a JOIN b USING (xi, yi)")
def q_match_height(spark, d):
    return rounded(rounded(surfaces.match_height(*_ab(spark, d)), 6, "diff"), 9, "variance")


@query(f"WITH {N}, {_steps(15.0)} SELECT xi, yi, round(max_step, 9) AS max_step, round(corrected_step, 9) AS corrected_step FROM steps")
def q_max_step(spark, d):
    return rounded(raster.steps(tops(spark, d), GRID, threshold=15.0), 9, "max_step", "corrected_step")


@query(f"WITH {N}, {SLOPE} SELECT xi, yi, round(slope, 6) AS slope FROM slopes")
def q_plane_slope(spark, d):
    return rounded(raster.slope(tops(spark, d), GRID), 6, "slope")


@query(f"WITH {C} SELECT a.xi, a.yi, round(avg(b.top), 10) AS top FROM cells a JOIN cells b ON b.xi BETWEEN a.xi - 2 AND a.xi + 1 AND b.yi BETWEEN a.yi - 2 AND a.yi + 1 GROUP BY 1, 2")
def q_box_mean(spark, d):
    return rounded(raster.box_mean(tops(spark, d), "top", 3), 10, "top")


@query(f"WITH {C}, g AS (SELECT c.xi, c.yi, (w.top - e.top) / 4.0 AS gx, (s.top - n.top) / 2.0 AS gy FROM cells c JOIN cells e ON e.xi = c.xi + 1 AND e.yi = c.yi JOIN cells w ON w.xi = c.xi - 1 AND w.yi = c.yi JOIN cells n ON n.xi = c.xi AND n.yi = c.yi + 1 JOIN cells s ON s.xi = c.xi AND s.yi = c.yi - 1) SELECT xi, yi, round(gx / sqrt(gx * gx + gy * gy + 1), 6) AS nx, round(gy / sqrt(gx * gx + gy * gy + 1), 6) AS ny, round(1 / sqrt(gx * gx + gy * gy + 1), 6) AS nz FROM g")
def q_normals(spark, d):
    return rounded(raster.normals(tops(spark, d), GRID, "top"), 6, "nx", "ny", "nz")


@query(f"WITH {C} SELECT min(top) AS low, max(top) AS high FROM cells")
def q_band_bounds(spark, d):
    return raster.bounds(tops(spark, d).select("xi", "yi", "top"), "top")


@query("SELECT l_orderkey, l_linenumber, CAST(floor(least(255.0, greatest(0.0, l_discount * 10 * 255))) AS INTEGER) AS p FROM lineitem")
def q_quantise(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raster.quantise(F.col("l_discount") * 10).alias("p"))


@query(f"WITH {C} SELECT xi, yi, round(top / 13 * ((xi + 0.5) * 2), 9) AS x, round(top / 13 * (yi + 0.5), 9) AS y, round(top / 13, 9) AS z, round(top / 130, 9) AS variance FROM cells WHERE top / 13 < 8")
def q_distance_points(spark, d):
    cells = tops(spark, d).select("xi", "yi", (F.col("top") / 13).alias("distance"))
    return rounded(points.from_distances(cells, GRID, affine(), farthest=8.0), 9, "x", "y", "z", "variance").select("xi", "yi", "x", "y", "z", "variance")


@query(f"WITH {T} SELECT xi, yi, class, probability FROM trav")
def q_trav_classes(spark, d):
    return trav(spark, d)


@query(f"WITH {T} SELECT CAST(floor(avg(class) + 0.5) AS INTEGER) AS mean_class FROM trav WHERE class <> 0")
def q_trav_mean_class(spark, d):
    return traversability.mean_class(trav(spark, d))


@query(f"WITH {T} SELECT class, count(*) AS n, round(min(sqrt(((xi + 0.5) * 2 - 25) * ((xi + 0.5) * 2 - 25) + (yi + 0.5 - 5) * (yi + 0.5 - 5))), 6) AS nearest FROM trav GROUP BY class")
def q_trav_stat(spark, d):
    return rounded(traversability.statistic(trav(spark, d), GRID, 25.0, 5.0), 6, "nearest")


@query(f"WITH {T} SELECT arg_min(class, CAST({_drive} AS DOUBLE) * 1000 + class) AS class, min(probability) AS probability FROM trav WHERE class <> 0 AND abs((xi + 0.5) * 2 - 25) <= 8 AND abs(yi + 0.5 - 5) <= 3")
def q_worst_class(spark, d):
    return traversability.worst(raster.in_rectangle(trav(spark, d), GRID, 25.0, 5.0, 0.0, 16.0, 6.0), DRIVE)


@query(f"WITH {T} SELECT a.xi, a.yi, CASE WHEN EXISTS (SELECT 1 FROM trav b WHERE b.class = 1 AND (a.xi - b.xi) * (a.xi - b.xi) + (a.yi - b.yi) * (a.yi - b.yi) <= {RADIUS**2}) THEN 1 ELSE a.class END AS class FROM trav a")
def q_grow_obstacles(spark, d):
    return traversability.grow_obstacles(trav(spark, d), RADIUS)


_drive_b = _drive.replace("CASE class", "CASE b.class")


@query(f"""WITH {T}, r AS (SELECT a.xi, a.yi, b.class, b.probability, row_number() OVER (PARTITION BY a.xi, a.yi ORDER BY {_drive_b}, CASE WHEN a.xi = b.xi AND a.yi = b.yi THEN 0 ELSE 1 END, b.yi, b.xi) AS k FROM trav a JOIN trav b ON (a.xi = b.xi AND a.yi = b.yi) OR (a.xi - b.xi) * (a.xi - b.xi) + (a.yi - b.yi) * (a.yi - b.yi) < {RADIUS**2} WHERE b.class <> 0 AND b.probability > 0)
SELECT trav.xi, trav.yi, coalesce(r.class, trav.class) AS class, coalesce(r.probability, trav.probability) AS probability FROM trav LEFT JOIN r ON r.xi = trav.xi AND r.yi = trav.yi AND r.k = 1""")
def q_grow_classes(spark, d):
    return traversability.grow_classes(trav(spark, d), RADIUS, DRIVE)


_reach = [(a, b) for a, b in traversability.disc(WIDTH) if np.hypot(a * 2.0, b) < WIDTH and (b, a) > (0, 0) and max(abs(a), abs(b)) > 1]
_way = ", ".join(f"({a}, {b}, {x}, {y})" for a, b in _reach for x, y in line_cells(0, 0, a, b)[1:-1])


@query(f"WITH {T}, way(dx, dy, px, py) AS (VALUES {_way}), f AS (SELECT DISTINCT a.xi + px AS xi, a.yi + py AS yi FROM trav a CROSS JOIN way JOIN trav b ON b.xi = a.xi + dx AND b.yi = a.yi + dy WHERE a.class = 1 AND b.class = 1) SELECT trav.xi, trav.yi, CASE WHEN f.xi IS NOT NULL THEN 1 ELSE class END AS class FROM trav LEFT JOIN f ON f.xi = trav.xi AND f.yi = trav.yi")
def q_close_passages(spark, d):
    return traversability.close_passages(trav(spark, d), GRID, WIDTH)


@query()
def q_flood(spark, d):
    patches = kalman_by_cloud(spark, d).filter("ord = 0")
    return rounded(traversability.flood(patches, (12, 5, 40.0), 30.0, 25.0), 6, "mean", "stdev")


@query()
def q_flood_classes(spark, d):
    patches = kalman_by_cloud(spark, d).filter("ord = 0")
    return traversability.classify_flood(traversability.flood(patches, (12, 5, 40.0), 30.0, 25.0), GRID, 25.0, MAX_SLOPE, COUNT)


@query(f"WITH {C} SELECT xi, yi, CASE least(3, CAST(floor(low) AS BIGINT)) WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE 40 END AS class FROM cells")
def q_class_projection(spark, d):
    cells = tops(spark, d).select("xi", "yi", F.least(F.lit(3).cast("long"), F.floor("low")).alias("band"))
    table = spark.createDataFrame([(0, 10), (1, 20), (2, 30), (3, 40)], "value long, class int")
    return raster.classify(cells, "band", table)


@query(f"""WITH {C}, w AS (SELECT xi, yi, top + ({LIGHT[2]} - top) * (k.range / 16.0) AS line, CAST(floor(((xi + 0.5) * 2.0 + ({LIGHT[0]} - (xi + 0.5) * 2.0) * (k.range / 16.0)) / 2.0) AS BIGINT) AS wx, CAST(floor((yi + 0.5) + ({LIGHT[1]} - (yi + 0.5)) * (k.range / 16.0)) AS BIGINT) AS wy FROM cells, range(1, 16) k),
dark AS (SELECT DISTINCT w.xi, w.yi FROM w JOIN cells c ON c.xi = wx AND c.yi = wy WHERE (w.xi <> wx OR w.yi <> wy) AND c.top > line) SELECT cells.xi, cells.yi, CASE WHEN dark.xi IS NULL THEN 1 ELSE 0 END AS illumination FROM cells LEFT JOIN dark USING (xi, yi)""")
def q_illumination(spark, d):
    return raster.illumination(tops(spark, d), GRID, "top", LIGHT)


@query()
def q_illumination_walk(spark, d):
    """As q_illumination, whose SQL looks at 15 places of each line; here all cells on it count."""
    return rounded(raster.illumination_walk(tops(spark, d), GRID, "top", LIGHT), 6, "illumination")


def _customers(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_nationkey") * 4.0).alias("y"), (F.col("c_custkey") % 50 * 1.0).alias("z"))


def _suppliers(spark, d) -> DataFrame:
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") * 4.0).alias("y"), (F.col("s_suppkey") % 50 * 1.0).alias("z"))


CS = "c AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey * 4.0 AS y, c_custkey % 50 * 1.0 AS z FROM customer), s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey * 4.0 AS y, s_suppkey % 50 * 1.0 AS z FROM supplier)"


@query(f"WITH {CS}, p AS (SELECT c.id AS lid, s.id AS rid, sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2 + (c.z - s.z) ** 2) AS d FROM c, s), r AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d, rid) AS k FROM p WHERE d < 12) SELECT lid, rid, round(d, 6) AS d FROM r WHERE k = 1")
def q_nn_lookup(spark, d):
    return rounded(matching.nearest(_customers(spark, d), _suppliers(spark, d), 12.0), 6, "d")


@query(f"WITH {CS} SELECT c.id AS lid, count(*) AS n FROM c, s WHERE (c.x - s.x) ** 2 + (c.y - s.y) ** 2 < 100 AND s.z - c.z BETWEEN -10 AND 10 GROUP BY c.id")
def q_range_lookup(spark, d):
    return matching.count_in_band(_customers(spark, d), _suppliers(spark, d), 10.0, -10.0, 10.0)


@query(f"WITH {CS}, p AS (SELECT a.id AS lid, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, b.id AS rid FROM c a, c b WHERE a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d, rid) AS k FROM p WHERE d < 12), m AS (SELECT c.id, (coalesce(sum(r.d), 0) + (4 - count(r.d)) * 12) / 4 AS mean_distance FROM c LEFT JOIN r ON r.lid = c.id AND r.k <= 4 GROUP BY c.id) SELECT id, round(mean_distance, 6) AS mean_distance FROM m WHERE mean_distance > (SELECT quantile_cont(mean_distance, 0.95) FROM m)")
def q_knn_outliers(spark, d):
    return rounded(matching.outliers(_customers(spark, d), 4, 12.0, 0.05), 6, "mean_distance")


@query()
def q_knn_outliers_exact(spark, d):
    """As q_knn_outliers, whose SQL takes 4 neighbours within 12; here the 24 nearest, however far."""
    return rounded(matching.outliers_exact(_customers(spark, d), 24, 0.05, 12.0), 6, "mean_distance")


def _pairs(spark, d) -> DataFrame:
    p = pts(spark, d).select(*[F.col(a).alias(f"p{a}") for a in "xyz"], "x", "y", "z")
    return points.transform(p, TURN).select(*[f"p{a}" for a in "xyz"], *[F.col(a).alias(f"q{a}") for a in "xyz"])


_q = ", ".join(f"{float(r[0])!r} * x + {float(r[1])!r} * y + {float(r[2])!r} * z + {float(r[3])!r} AS q{n}" for n, r in zip("xyz", TURN, strict=False))
_mom = ", ".join([*[f"round(sum({s}{a}), 2) AS {s}{a}" for s in "pq" for a in "xyz"], *[f"round(sum(p{a} * q{b}), 1) AS c{a}{b}" for a in "xyz" for b in "xyz"], "round(sum((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2), 1) AS dd"])


@query(f"WITH {P}, pq AS (SELECT x AS px, y AS py, z AS pz, {_q} FROM pts) SELECT count(*) AS n, {_mom} FROM pq")
def q_icp_moments(spark, d):
    m = matching.moments(_pairs(spark, d))
    m = rounded(m, 2, *[f"{s}{a}" for s in "pq" for a in "xyz"])
    return rounded(m, 1, *[f"c{a}{b}" for a in "xyz" for b in "xyz"], "dd")


@query()
def q_icp_align(spark, d):
    model = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40 * 1.0).alias("x"), (F.floor(F.col("p_partkey") / 40) % 40 * 1.0).alias("y"), (F.col("p_size") / 5.0).alias("z"))
    move = affine((0.1, -0.05, 0.08), rotation(0.004, -0.003, 0.005))
    t, mse, n = matching.align(model, points.transform(model, np.linalg.inv(move)), 3.0, rounds=4)
    return spark.createDataFrame([(i, *[float(round(v, 4)) for v in t[i]], float(round(mse, 6)), int(n)) for i in range(3)], "row int, a double, b double, c double, t double, mse double, pairs long")


_ax = ["x", "y", "z"]
_cov = ", ".join(f"round(sum(w * {a} * {b}) / sum(w) - (sum(w * {a}) / sum(w)) * (sum(w * {b}) / sum(w)), 4) AS cov_{a}_{b}" for i, a in enumerate(_ax) for b in _ax[i:])


@query(f"WITH {P}, v AS (SELECT *, 1 / sd AS w FROM pts) SELECT cloud, " + ", ".join(f"round(sum(w * {a}) / sum(w), 6) AS mean_{a}" for a in _ax) + f", {_cov} FROM v GROUP BY cloud")
def q_pose_mean_cov(spark, d):
    m = poses.weighted_moments(pts(spark, d).withColumn("weight", 1 / F.col("sd")), _ax, "cloud")
    return rounded(rounded(m, 6, *[f"mean_{a}" for a in _ax]), 4, *[f"cov_{a}_{b}" for i, a in enumerate(_ax) for b in _ax[i:]])


@query("WITH r AS (SELECT c_nationkey AS segment, c_custkey AS part_id, c_acctbal AS weight, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT segment, part_id, weight FROM r WHERE k = 1")
def q_best_part(spark, d):
    return poses.best(_t(spark, d, "customer").select(F.col("c_nationkey").alias("segment"), F.col("c_custkey").alias("part_id"), F.col("c_acctbal").alias("weight")), "segment")


@query(f"WITH {P}, h AS (SELECT CAST(CASE WHEN z < 10 THEN 0 WHEN z >= 90 THEN 17 ELSE floor((z - 10) / 5.0) + 1 END AS INTEGER) AS bin FROM pts) SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM pts), 9) AS share FROM h GROUP BY bin")
def q_histogram(spark, d):
    return rounded(poses.histogram(pts(spark, d), F.col("z"), 10.0, 90.0, 16), 9, "share")


@query()
def q_kmeans(spark, d):
    return poses.kmeans(_customers(spark, d), ["x", "y"], 4).select("id", "cluster")


@query()
def q_mixture(spark, d):
    return poses.mixture(_customers(spark, d), ["x", "y"], 3).select("id", "component")


@query()
def q_consensus(spark, d):
    """The transform of all points onto their turned places, of which about one in three is off by 25."""
    p = pts(spark, d).select(F.col("vid").alias("id"), *[F.col(a).alias(f"p{a}") for a in "xyz"], "x", "y", "z")
    off = F.when(F.pmod("id", F.lit(3)) == 0, 25.0).otherwise(0.0)
    pairs = points.transform(p, TURN).select("id", *[f"p{a}" for a in "xyz"], *[(F.col(a) + off).alias(f"q{a}") for a in "xyz"])
    t, good, tried, enough = matching.consensus_pairs(pairs, 0.01)
    if not enough:
        raise ValueError(f"no consensus after {tried} trials")
    return spark.createDataFrame([(i, *[float(round(v, 6)) for v in t[i]], int(good)) for i in range(3)], "row int, a double, b double, c double, t double, agreeing long")


FRAMES = "SELECT 'r' || r_regionkey AS frame, CAST(NULL AS VARCHAR) AS parent, CAST(r_regionkey AS DOUBLE) AS tx FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey * 10 AS DOUBLE) FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CAST(s_suppkey * 100 AS DOUBLE) FROM supplier"
CHAIN = f"WITH RECURSIVE f AS ({FRAMES}), up AS (SELECT frame, frame AS here, parent, tx, 0 AS depth FROM f UNION ALL SELECT up.frame, f.frame, f.parent, up.tx + f.tx, up.depth + 1 FROM up JOIN f ON f.frame = up.parent) SELECT frame, here AS root, tx, depth FROM up WHERE parent IS NULL"


@query(CHAIN)
def q_frame_chain(spark, d):
    """Each frame's shift to its root; the tree is as deep as the catalog nests, so are the joins."""
    c = F.col
    key = lambda p, k: F.concat(F.lit(p), c(k).cast("string"))
    f = _t(spark, d, "region").select(key("r", "r_regionkey").alias("frame"), F.lit(None).cast("string").alias("parent"), (c("r_regionkey") * 1.0).alias("tx"))
    f = f.unionByName(_t(spark, d, "nation").select(key("n", "n_nationkey").alias("frame"), key("r", "n_regionkey").alias("parent"), (c("n_nationkey") * 10.0).alias("tx")))
    f = f.unionByName(_t(spark, d, "supplier").select(key("s", "s_suppkey").alias("frame"), key("n", "s_nationkey").alias("parent"), (c("s_suppkey") * 100.0).alias("tx")))
    up = f.select("frame", c("frame").alias("root"), "parent", "tx", F.lit(0).alias("depth"))
    done = up.filter("parent is null")
    while not (up := cut(up.filter("parent is not null"))).isEmpty():
        up = up.join(f.select(c("frame").alias("parent"), c("parent").alias("grand"), c("tx").alias("more")), "parent").select("frame", c("parent").alias("root"), c("grand").alias("parent"), (c("tx") + c("more")).alias("tx"), (c("depth") + 1).alias("depth"))
        done = done.unionByName(up.filter("parent is null"))
    return done.select("frame", "root", "tx", "depth")


@query("SELECT o_custkey AS layer, l_suppkey AS made, count(*) AS operators FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def q_layer_lineage(spark, d):
    """Orders as operators from a customer's layer to suppliers' layers: what is generated from what, and by how many."""
    o, i = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    return o.join(i, o.o_orderkey == i.l_orderkey).groupBy(F.col("o_custkey").alias("layer"), F.col("l_suppkey").alias("made")).agg(F.count("*").alias("operators"))


LOG = "log AS (SELECT event_id AS seq, 'item' AS type, CAST(user_id AS VARCHAR) AS id_a, '' AS id_b, CASE event_id % 3 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' ELSE 'REMOVE' END AS op FROM events)"


def log(spark, d) -> DataFrame:
    op = F.element_at(F.array(F.lit("ADD"), F.lit("UPDATE"), F.lit("REMOVE")), (F.col("event_id") % 3 + 1).cast("int"))
    return _t(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("item").alias("type"), F.col("user_id").cast("string").alias("id_a"), F.lit("").alias("id_b"), op.alias("op"))


@query(f"WITH {LOG} SELECT type, id_a, id_b, max(seq) AS seq, arg_max(op, seq) AS op FROM log GROUP BY 1, 2, 3 HAVING arg_max(op, seq) <> 'REMOVE'")
def q_event_net_state(spark, d):
    return changes.net_state(log(spark, d))


@query(f"""WITH {LOG}, m AS (SELECT *, lag(op) OVER (PARTITION BY id_a ORDER BY seq) AS before FROM log WHERE op <> 'UPDATE'),
e AS (SELECT type, id_a, id_b, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(op, CASE WHEN before IS NULL OR before = op THEN seq END) AS settled FROM m GROUP BY 1, 2, 3),
u AS (SELECT type, id_a, id_b, max(CASE WHEN op = 'UPDATE' THEN seq END) AS seq, max(CASE WHEN op = 'REMOVE' THEN seq END) AS gone FROM log GROUP BY 1, 2, 3)
SELECT type, id_a, id_b, seq, op FROM e WHERE op = settled UNION ALL SELECT type, id_a, id_b, seq, 'UPDATE' FROM u WHERE seq IS NOT NULL AND (gone IS NULL OR seq > gone)""")
def q_event_compaction(spark, d):
    return changes.compact(log(spark, d))


@query("SELECT event_id, user_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def q_scan_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return _t(spark, d, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.count("*").over(w).alias("n"))


def _scan(spark, d) -> DataFrame:
    mm = F.transform("embedding", lambda v: (F.abs(v) * 20000 + 500).cast("int"))
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("line"), (F.col("vec_id") * 0.01).alias("phi"), mm.alias("ranges"), F.transform(mm, lambda r: r % 12000).alias("remissions"))


@query()
def q_scan_points(spark, d):
    return rounded(points.scan_points(_scan(spark, d), -0.5, 0.016, 0.1, 5.0, 1.48), 6, "x", "y", "z", "variance", "grey")


@query()
def q_scan_faces(spark, d):
    f = points.scan_faces(points.scan_points(_scan(spark, d), -0.5, 0.016, 0.1, 5.0, 1.48), 1.5)
    return f.select(*[F.col(f"{n}.{k}").alias(f"{n}_{k}") for n in "abc" for k in ("line", "beam")])


_gap = lambda a: f"greatest(0.0, s.{a} - (c.{a} + 1), c.{a} - (s.{a} + 3))"


@query(f"WITH {CS}, g AS (SELECT s.id AS lid, c.id AS rid, sqrt({_gap('x')} ** 2 + {_gap('y')} ** 2) AS distance, c.x >= s.x AND c.x + 1 <= s.x + 3 AND c.y >= s.y AND c.y + 1 <= s.y + 3 AS contains FROM s, c) SELECT lid, rid, round(distance, 6) AS distance, contains FROM g WHERE distance <= 2")
def q_poly_distance(spark, d):
    def shape(df: DataFrame, size: float) -> DataFrame:
        at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
        return df.select("id", F.array(at(0.0, 0.0), at(size, 0.0), at(size, size), at(0.0, size)).alias("pts"))

    return rounded(polygons.near_pairs(shape(_suppliers(spark, d), 3.0), shape(_customers(spark, d), 1.0), 2.0), 6, "distance")


START, STEP, NEAR, FAR, GRAZE = -2.0, 0.064, 0.6, 8.0, 1.4
BEAMS = """b AS (SELECT vec_id AS line, vec_id * 0.01 AS phi, generate_subscripts(embedding, 1) - 1 AS beam, len(embedding) AS beams, trunc(abs(CAST(unnest(embedding) AS DOUBLE)) * 20000 + 500) / 1000.0 AS r FROM embeddings)"""
MESH = f"""{BEAMS}, n AS (SELECT *, lead(r) OVER (PARTITION BY line ORDER BY beam) AS n FROM b),
c AS (SELECT *, sqrt(r * r + n * n - 2 * r * n * {float(np.cos(2 * STEP))!r}) AS c FROM n), m AS (SELECT *, CASE WHEN n IS NULL THEN pi() / 2 ELSE acos(least(1.0, greatest(-1.0, (r * r - n * n + c * c) / (2 * r * c)))) END AS met FROM c),
k AS (SELECT *, coalesce(lag(met) OVER (PARTITION BY line ORDER BY beam), pi() / 2) AS last, {START} + beam * {STEP} AS psi FROM m),
p AS (SELECT line, beam, beams, psi, r, cos(phi) * cos(psi) * r + 0.1 AS x, sin(psi) * r + 0.2 * cos(phi) - 0.3 * sin(phi) AS y, sin(phi) * cos(psi) * r + 0.2 * sin(phi) + 0.3 * cos(phi) AS z FROM k WHERE r > {NEAR} AND r < {FAR} AND abs(met - pi() / 2) < {GRAZE} AND abs(last - pi() / 2) < {GRAZE})"""


def _mesh(spark, d) -> DataFrame:
    mm = F.transform("embedding", lambda v: (F.abs(v.cast("double")) * 20000 + 500).cast("int"))
    scan = _t(spark, d, "embeddings").select(F.col("vec_id").alias("line"), (F.col("vec_id") * 0.01).alias("phi"), mm.alias("ranges"), mm.alias("remissions"))
    return points.mesh_points(scan, START, STEP, NEAR, FAR, GRAZE, centre=(0.1, 0.2, 0.3))


@query(f"WITH {MESH} SELECT line, CAST(beam AS INTEGER) AS beam, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(least(0.01 * r, 0.02) ** 2, 12) AS variance, round(least(1.0, r * 1000 / 10000), 6) AS grey, beam = 0 OR beam = beams - 1 OR line = (SELECT min(line) FROM b) OR line = (SELECT max(line) FROM b) AS is_edge FROM p")
def q_mesh_points(spark, d):
    p = _mesh(spark, d).select("line", "beam", "x", "y", "z", "variance", "grey", "is_edge")
    return rounded(rounded(p, 6, "x", "y", "z", "grey"), 12, "variance")


_corners = ((-1, -1), (-1, 0), (0, 0), (0, -1))
_tri = lambda n: ("123", "023", "013", "012")[n]
_side = lambda i, j: f"coalesce(sqrt((p{i}.x - p{j}.x) ** 2 + (p{i}.y - p{j}.y) ** 2 + (p{i}.z - p{j}.z) ** 2) < 2.5, false)"
_good = ", ".join(f"{_side(a, b)} AND {_side(b, c)} AND {_side(a, c)} AS g{n}" for n in range(4) for a, b, c in [_tri(n)])
_line = lambda k: f"line{_corners[int(k)][0]:+d}"
_beam = lambda k: f"beam{_corners[int(k)][1]:+d}"
_pick = " UNION ALL ".join(
    f"SELECT {_line(a)} AS a_line, {_beam(a)} AS a_beam, CASE WHEN back THEN {_line(c)} ELSE {_line(b)} END AS b_line, CASE WHEN back THEN {_beam(c)} ELSE {_beam(b)} END AS b_beam, CASE WHEN back THEN {_line(b)} ELSE {_line(c)} END AS c_line, CASE WHEN back THEN {_beam(b)} ELSE {_beam(c)} END AS c_beam FROM g WHERE g{n} AND {('true', 'NOT g0', '(g0 OR NOT g1)', 'NOT g0 AND (g1 OR NOT g2)')[n]}"
    for n in range(4) for a, b, c in [_tri(n)]
)


@query(f"WITH {MESH}, q AS (SELECT b.line, CAST(b.beam AS INTEGER) AS beam, abs({START} + b.beam * {STEP}) > pi() / 2 AS back, {_good} FROM b " + " ".join(f"LEFT JOIN p p{k} ON p{k}.line = b.line{dl:+d} AND p{k}.beam = b.beam{db:+d}" for k, (dl, db) in enumerate(_corners)) + f"), g AS (SELECT * FROM q) {_pick}")
def q_mesh_faces(spark, d):
    f = points.mesh_faces(_mesh(spark, d), 2.5)
    return f.select(*[F.col(f"{n}.{k}").alias(f"{n}_{k}") for n in "abc" for k in ("line", "beam")])


@query()
def q_markers(spark, d):
    """Bright marks of scans of fifty lines each."""
    p = _mesh(spark, d).withColumn("scan", F.floor(F.col("line") / 50))
    return rounded(points.markers(p, 6500.0, 0.5), 6, "x", "y", "z")


_slots_sd = _slots.replace("abs(own - other)", "abs(own - other) + (osd + tsd)")


@query(f"""WITH {C}, f AS (SELECT *, (top - low) / 10 AS sd FROM cells WHERE n >= 200), o(dx, dy) AS (VALUES (0, 1), (0, -1), (-1, -1), (1, 1), (-1, 0), (1, 0), (-1, 1), (1, -1)),
nb AS (SELECT a.xi, a.yi, a.top AS own, a.sd AS osd, o.dx, o.dy, b.top AS other, b.sd AS tsd FROM f a CROSS JOIN o JOIN f b ON b.xi = a.xi + o.dx AND b.yi = a.yi + o.dy), {_steps(30.0).replace(_slots, _slots_sd)} SELECT xi, yi, round(max_step, 9) AS max_step, round(corrected_step, 9) AS corrected_step FROM steps""")
def q_max_step_spread(spark, d):
    """Steps between cells of 200 measurements or more that reach a deviation beyond either end."""
    t = tops(spark, d).withColumn("sd", (F.col("top") - F.col("low")) / 10)
    return rounded(raster.steps(t, GRID, threshold=30.0, sd="sd", least=200), 9, "max_step", "corrected_step")


@query(f"WITH {C}, cells2 AS (SELECT * FROM cells WHERE n >= 200), {N[len(C) + 2:].replace('cells', 'cells2')}, {SLOPE} SELECT xi, yi, round(slope, 6) AS slope FROM slopes")
def q_slope_measured(spark, d):
    return rounded(raster.slope(tops(spark, d), GRID, least=200), 6, "slope")


UNSURE = Uncertain(affine((10.0, 4.0, 1.0)), np.diag([1e-4, 2e-4, 3e-4, 0.01, 0.02, 0.04]) + np.diag([1e-5] * 3, 3) + np.diag([1e-5] * 3, -3))
_lever = {0: "((yi + 0.5) - 4.0)", 1: "(10.0 - (xi + 0.5) * 2)", 5: "1.0"}
_smear = " + ".join(f"{_lever[a]} * {_lever[b]} * {float(UNSURE.cov[a, b])!r}" for a in _lever for b in _lever)


@query(f"WITH {P}, k AS ({KAL.format(by='', where='')}) SELECT xi, yi, round(mean, 6) AS mean, round(sqrt(stdev * stdev + {_smear}), 6) AS stdev FROM k")
def q_pose_smear(spark, d):
    """Patches with the uncertainty of the pose that they were seen from."""
    k = surfaces.kalman(pts(spark, d), GRID)
    return rounded(k.select("xi", "yi", "mean", F.sqrt(F.col("stdev") * F.col("stdev") + surfaces.pose_variance(GRID, UNSURE)).alias("stdev")), 6, "mean", "stdev")


SENSOR = (25.0, 5.5, 120.0)
CLOUD_A = KAL.format(by="", where="WHERE cloud = 'A'")


@query(f"""WITH {P}, s AS ({CLOUD_A}), n AS (SELECT *, greatest(abs(12 - xi), abs(5 - yi)) AS n, {SENSOR[2]} - mean AS up, sqrt(((12 - xi) * 2.0) ** 2 + ((5 - yi) * 1.0) ** 2) AS far FROM (SELECT xi, yi, mean, stdev FROM s)),
r AS (SELECT *, unnest(generate_series(1, n)) AS k FROM n WHERE n > 0), f AS (SELECT *, 1 - k / CAST(n AS DOUBLE) AS f, 2.0 / far * up AS seen FROM r)
SELECT xi AS fx, yi AS fy, k, xi + CAST(sign(12 - xi) AS BIGINT) * CAST(ceil((2 * k * abs(12 - xi) - n) / (2.0 * n)) AS BIGINT) AS xi, yi + CAST(sign(5 - yi) AS BIGINT) * CAST(ceil((2 * k * abs(5 - yi) - n) / (2.0 * n)) AS BIGINT) AS yi, round(mean + seen * f + up * (1 - f), 6) AS mean, round(stdev * f, 6) AS stdev, round(abs(seen * f), 6) AS height FROM f""")
def q_free_space(spark, d):
    k = kalman_by_cloud(spark, d).filter("ord = 0")
    return rounded(surfaces.free_space(k, GRID, SENSOR).drop("ord"), 6, "mean", "stdev", "height")


@query()
def q_projection_free_space(spark, d):
    """All points projected, with what is free between them and the sensor."""
    return rounded(surfaces.project_with_free_space(pts(spark, d), GRID, ["cloud", "vid"], SENSOR, UNSURE), 6, "mean", "stdev", "height")


@query(f"""WITH {C}, k AS ({KAL.format(by='cloud,', where='')}),
p AS (SELECT xi, yi, CAST(CASE cloud WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS ord, mean, stdev, CASE cloud WHEN 'N' THEN 6.0 ELSE 0.0 END AS height, CASE cloud WHEN 'N' THEN 0 WHEN 'R' THEN 2 ELSE 1 END AS type FROM k),
q AS (SELECT xi * 100 + yi AS id, xi, yi, (top + low) / 2 AS z FROM cells), d AS (SELECT id, p.*, CASE WHEN type = 1 THEN abs(mean - z) WHEN z > mean THEN z - mean ELSE greatest(0.0, mean - height - z) END AS far FROM q JOIN p USING (xi, yi) WHERE type <> 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM d WHERE far < 3.0 * sqrt(stdev * stdev + 1.0)) SELECT id, ord, round(mean, 6) AS mean, round(stdev, 6) AS stdev FROM r WHERE k = 1""")
def q_interval_match(spark, d):
    """The first patch in each cell that is near half its height; blocks from their ends, free space never."""
    c = F.col("ord")
    k = kalman_by_cloud(spark, d).withColumns({"height": F.when(c == 1, 6.0).otherwise(0.0), "type": F.when(c == 1, surfaces.VERTICAL).when(c == 2, surfaces.NEGATIVE).otherwise(surfaces.HORIZONTAL)})
    probes = tops(spark, d).select((F.col("xi") * 100 + F.col("yi")).alias("id"), "xi", "yi", ((F.col("top") + F.col("low")) / 2).alias("mean"), F.lit(1.0).alias("stdev"), F.lit(0.0).alias("height"), F.lit(surfaces.HORIZONTAL).alias("type"))
    return rounded(surfaces.first_match(k, probes, 3.0, skip_free=True), 6, "mean", "stdev")


@query(f"""WITH RECURSIVE {P}, k AS ({KAL.format(by='cloud,', where='')}), w AS (SELECT c_nationkey AS path, c_custkey AS seq, c_custkey % 26 AS xi, c_custkey % 11 AS yi, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
h AS (SELECT path, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS xi, CAST(0 AS BIGINT) AS yi, CAST(50.0 AS DOUBLE) AS height FROM (SELECT DISTINCT path FROM w)
UNION ALL SELECT w.path, w.seq, w.i, w.xi, w.yi, coalesce((SELECT arg_min(mean, abs(mean - h.height)) FROM k WHERE k.xi = w.xi AND k.yi = w.yi), h.height) FROM h JOIN w ON w.path = h.path AND w.i = h.i + 1) SELECT path, seq, xi, yi, round(height, 6) AS height FROM h WHERE i > 0""")
def q_surface_paths(spark, d):
    """Heights along each nation's path through its customers: the patch nearest to the height before."""
    c = F.col("c_custkey")
    paths = _t(spark, d, "customer").select(F.col("c_nationkey").alias("path"), c.alias("seq"), (c % 26).alias("xi"), (c % 11).alias("yi"), F.lit(50.0).alias("start"))
    return rounded(surfaces.follow_paths(paths, kalman_by_cloud(spark, d)), 6, "height")


@query(f"WITH {C} SELECT xi, yi, round(CASE WHEN abs((xi + 0.5) * 2 - 25) < 10 AND abs(yi + 0.5 - 5) < 3 THEN top + 2 + 0.5 * ((xi + 0.5) * 2) - 0.25 * (yi + 0.5) ELSE top END, 6) AS top FROM cells")
def q_shape_window(spark, d):
    """A slope and a constant added to the cells of a window."""
    shape = lambda c: raster.add_slope(raster.add_const(c, "top", 2.0), GRID, "top", 0.5, -0.25)
    return rounded(raster.within(tops(spark, d).select("xi", "yi", "top"), GRID, "top", shape, 25.0, 5.0, 20.0, 6.0), 6, "top")


@query(f"WITH {CS}, p AS (SELECT c.id AS lid, s.id AS rid, sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2 + (c.z - s.z) ** 2) AS d FROM c, s), r AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d, rid) AS k FROM p WHERE d < 12) SELECT lid, rid, round(d, 6) AS d FROM r WHERE k = 1 AND lid % 7 <> 0 AND rid % 5 <> 0 AND abs(lid % 30 - rid % 30) * 0.05 < pi() / 8 - 1e-9")
def q_compatible_pairs(spark, d):
    """Nearest neighbours, neither on an edge and with normals less than an eighth of a half turn apart."""
    def side(f: DataFrame, every: int) -> DataFrame:
        a = F.col("id") % 30 * 0.05
        return f.withColumns({"nx": F.sin(a), "ny": F.lit(0.0), "nz": F.cos(a), "is_edge": F.col("id") % every == 0})

    c, s = side(_customers(spark, d), 7), side(_suppliers(spark, d), 5)
    return rounded(matching.compatible(matching.nearest(c, s, 12.0), c, s), 6, "d")
