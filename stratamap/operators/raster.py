"""Operators on grids: rows of (xi, yi, bands). Missing values are nulls; neighbourhoods are equi-joins on shifted cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..geometry import GridSpec

CELL = ["xi", "yi"]
#: Directions in opposite pairs: ahead, behind along y; the diagonals; along x.
OPPOSITE = [(0, 1), (0, -1), (-1, -1), (1, 1), (-1, 0), (1, 0), (-1, 1), (1, -1)]


def to_cells(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Adds the cell of each point and drops those outside the grid."""
    xi, yi = spec.cell(F.col("x"), F.col("y"))
    return points.withColumns({"xi": xi, "yi": yi}).filter(spec.inside(F.col("xi"), F.col("yi")))


def elevation(points: DataFrame, spec: GridSpec) -> DataFrame:
    return to_cells(points, spec).groupBy(*CELL).agg(F.min("z").alias("elevation_min"), F.max("z").alias("elevation_max"), F.count("*").alias("n"))


def empty(spec: GridSpec, spark, **bands) -> DataFrame:
    """All cells of a grid with constant bands."""
    d = spark.range(spec.nx * spec.ny).select((F.col("id") % spec.nx).alias("xi"), F.floor(F.col("id") / spec.nx).cast("long").alias("yi"))
    return d.withColumns({k: F.lit(v) for k, v in bands.items()})


def spread(cells: DataFrame, offsets: list[tuple[int, int]], bands: list[str]) -> DataFrame:
    """Each cell's bands at the cells that have it as a neighbour: (xi, yi, dx, dy, bands); (dx, dy) leads to the neighbour."""
    o = F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy")) for a, b in offsets])
    d = cells.select(*CELL, *bands, F.explode(o).alias("o"))
    return d.select((F.col("xi") - F.col("o.dx")).alias("xi"), (F.col("yi") - F.col("o.dy")).alias("yi"), F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"), *bands)


def with_neighbours(cells: DataFrame, offsets: list[tuple[int, int]], band: str) -> DataFrame:
    """(xi, yi, own, dx, dy, other) of each cell and neighbour that has the band."""
    near = spread(cells.filter(F.col(band).isNotNull()), offsets, [band]).withColumnRenamed(band, "other")
    return cells.select(*CELL, F.col(band).alias("own")).join(near, CELL)


def inner(spec: GridSpec) -> Column:
    return F.col("xi").between(1, spec.nx - 2) & F.col("yi").between(1, spec.ny - 2)


def measured_often(cells: DataFrame, least: int, count: str = "n") -> DataFrame:
    """Cells whose patch is of at least so many measurements."""
    return cells.filter(F.col(count) >= least)


def terrain(cells: DataFrame, spec: GridSpec, band: str = "top") -> DataFrame:
    """slope and max_step of each cell, as slope() and steps() give them, from one join with the eight neighbours."""
    n = with_neighbours(cells, OPPOSITE, band).filter(inner(spec)).withColumns({"px": F.col("dx") * spec.sx, "py": F.col("dy") * spec.sy, "pz": F.col("own") - F.col("other")})
    px, py, pz = F.col("px"), F.col("py"), F.col("pz")
    s = n.groupBy(*CELL).agg(F.count("*").alias("k"), F.max(F.abs("pz")).alias("max_step"), *[F.sum(e).alias(f"m_{k}") for k, e in (("x", px), ("y", py), ("z", pz), ("xx", px * px), ("xy", px * py), ("yy", py * py), ("xz", px * pz), ("yz", py * pz))])
    a, b, _ = plane({"n": F.col("k") + 1, **{k: F.col(f"m_{k}") for k in ("x", "y", "z", "xx", "xy", "yy", "xz", "yz")}})
    return s.filter("k >= 5").select(*CELL, F.acos(1 / F.sqrt(a * a + b * b + 1)).alias("slope"), "max_step")


def steps(cells: DataFrame, spec: GridSpec, band: str = "top", threshold: float = 0.25, sd: str | None = None, least: int = 0, count: str = "n") -> DataFrame:
    """max_step and corrected_step: the largest difference to the eight neighbours, and the same less the even slope between
    opposite neighbours where it is under the threshold. Unknown (absent) at borders and with under five neighbours. sd: a band
    of deviations, by which a step reaches beyond both its ends; least: cells of fewer measurements take no part."""
    cells = measured_often(cells, least, count) if least else cells
    n = with_neighbours(cells, OPPOSITE, band).filter(inner(spec))
    step = F.abs(F.col("own") - F.col("other"))
    if sd:
        spread_ = spread(cells, OPPOSITE, [sd]).withColumnRenamed(sd, "_other_sd")
        n = n.join(cells.select(*CELL, F.col(sd).alias("_own_sd")), CELL).join(spread_, [*CELL, "dx", "dy"])
        step = step + F.col("_own_sd") + F.col("_other_sd")
    slot = [F.coalesce(F.max(F.when((F.col("dx") == a) & (F.col("dy") == b), step)), F.lit(0.0)).alias(f"s{i}") for i, (a, b) in enumerate(OPPOSITE)]
    d = n.groupBy(*CELL).agg(F.count("*").alias("n"), *slot).filter("n >= 5")
    d = d.withColumn("max_step", F.greatest(*[F.col(f"s{i}") for i in range(8)]))
    pairs = [(F.col(f"s{i}"), F.col(f"s{i + 1}")) for i in range(0, 8, 2)]
    level = F.greatest(*[F.greatest(a - (a + b) / 4, a - (a + b) * 3 / 4) for a, b in pairs])
    return d.select(*CELL, "max_step", F.when(F.col("max_step") < threshold, level).otherwise(F.col("max_step")).alias("corrected_step"))


def plane(sums: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(a, b, c) of the least squares plane z = a x + b y + c from n, x, y, z, xx, xy, yy, xz, yz, by Cramer's rule."""
    n, x, y, z, xx, xy, yy, xz, yz = (sums[k] for k in ("n", "x", "y", "z", "xx", "xy", "yy", "xz", "yz"))
    det = xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x)
    a = (xz * (yy * n - y * y) - xy * (yz * n - y * z) + x * (yz * y - yy * z)) / det
    b = (xx * (yz * n - z * y) - xz * (xy * n - y * x) + x * (xy * z - yz * x)) / det
    c = (xx * (yy * z - y * yz) - xy * (xy * z - yz * x) + xz * (xy * y - yy * x)) / det
    return a, b, c


def slope(cells: DataFrame, spec: GridSpec, band: str = "top", window: int = 1, least: int = 0, count: str = "n") -> DataFrame:
    """The angle of the least squares plane through a cell and its neighbours; unknown at borders and with under five. Cells of
    fewer than ``least`` measurements take no part."""
    cells = measured_often(cells, least, count) if least else cells
    around = [(a, b) for a in range(-window, window + 1) for b in range(-window, window + 1) if (a, b) != (0, 0)]
    n = with_neighbours(cells, around, band).filter(inner(spec)).withColumns({"px": F.col("dx") * spec.sx, "py": F.col("dy") * spec.sy, "pz": F.col("own") - F.col("other")})
    s = n.groupBy(*CELL).agg(F.count("*").alias("k"), *[F.sum(e).alias(f"m_{name}") for name, e in (("x", F.col("px")), ("y", F.col("py")), ("z", F.col("pz")), ("xx", F.col("px") * F.col("px")), ("xy", F.col("px") * F.col("py")), ("yy", F.col("py") * F.col("py")), ("xz", F.col("px") * F.col("pz")), ("yz", F.col("py") * F.col("pz")))])
    # The cell itself is a point at the origin: it counts, and adds nothing to the sums.
    a, b, _ = plane({"n": F.col("k") + 1, **{k: F.col(f"m_{k}") for k in ("x", "y", "z", "xx", "xy", "yy", "xz", "yz")}})
    return s.filter("k >= 5").select(*CELL, F.acos(1 / F.sqrt(a * a + b * b + 1)).alias("slope"))


def box_mean(cells: DataFrame, band: str, size: int) -> DataFrame:
    """The mean over [-ceil(size/2), ceil(size/2)) in both axes, as far as there are cells."""
    k = math.ceil(size / 2)
    near = spread(cells, [(a, b) for a in range(-k, k) for b in range(-k, k)], [band])
    return cells.select(*CELL).join(near.groupBy(*CELL).agg(F.avg(band).alias(band)), CELL)


def normals(cells: DataFrame, spec: GridSpec, band: str) -> DataFrame:
    """Unit normals by central differences, where all four neighbours are."""
    n = spread(cells, [(1, 0), (-1, 0), (0, 1), (0, -1)], [band])
    at = lambda a, b: F.max(F.when((F.col("dx") == a) & (F.col("dy") == b), F.col(band)))
    d = n.groupBy(*CELL).agg(at(1, 0).alias("e"), at(-1, 0).alias("w"), at(0, 1).alias("n"), at(0, -1).alias("s")).join(cells.select(*CELL), CELL)
    gx, gy = (F.col("w") - F.col("e")) / (2 * spec.sx), (F.col("s") - F.col("n")) / (2 * spec.sy)
    norm = F.sqrt(gx * gx + gy * gy + 1)
    return d.filter("e is not null and w is not null and n is not null and s is not null").select(*CELL, (gx / norm).alias("nx"), (gy / norm).alias("ny"), (1 / norm).alias("nz"))


def bounds(cells: DataFrame, band: str) -> DataFrame:
    return cells.agg(F.min(band).alias("low"), F.max(band).alias("high"))


def classify(cells: DataFrame, band: str, classes: DataFrame) -> DataFrame:
    """Each cell's value replaced by its class (value, class); a value without one is an error. The class table is
    a parameter of few rows, not data; Spark decides how to join it by its size."""
    d = cells.join(classes.withColumnRenamed("value", band), band, "left")
    known = F.when(F.col("class").isNull(), F.raise_error(F.concat(F.lit("no class for "), F.col(band).cast("string")))).otherwise(F.col("class"))
    return d.select(*CELL, known.alias("class"))


def in_rectangle(cells: DataFrame, spec: GridSpec, x: float, y: float, turn: float, width: float, height: float) -> DataFrame:
    """Cells whose centre lies in a turned rectangle around (x, y); u, v: its place in the rectangle."""
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    c, s = math.cos(turn), math.sin(turn)
    u, v = (cx - x) * c + (cy - y) * s, (cy - y) * c - (cx - x) * s
    return cells.withColumns({"u": u, "v": v}).filter((F.abs("u") <= width / 2) & (F.abs("v") <= height / 2))


def ring(cells: DataFrame, spec: GridSpec, x: float, y: float, turn: float, outer: tuple[float, float], hole: tuple[float, float]) -> DataFrame:
    """Cells of an outer rectangle with whether they also lie in the inner one."""
    return in_rectangle(cells, spec, x, y, turn, *outer).withColumn("inner", (F.abs("u") <= hole[0] / 2) & (F.abs("v") <= hole[1] / 2))


def shift(cells: DataFrame, spec: GridSpec, dx: int, dy: int) -> DataFrame:
    return cells.withColumns({"xi": F.col("xi") + dx, "yi": F.col("yi") + dy}).filter(spec.inside(F.col("xi"), F.col("yi")))


def quantise(p: Column) -> Column:
    """A probability in a byte, truncating."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), p * 255))).cast("int")


def probability(byte: Column) -> Column:
    """Back from quantise(), to within one step."""
    return byte / 255.0


def add_bump(cells: DataFrame, spec: GridSpec, band: str, height: float, x: float, y: float, sigma: float) -> DataFrame:
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    return cells.withColumn(band, F.col(band) + height * F.exp(-((cx - x) * (cx - x) + (cy - y) * (cy - y)) / (2 * sigma * sigma)))


def illumination(cells: DataFrame, spec: GridSpec, band: str, light: tuple[float, float, float], samples: int = 16) -> DataFrame:
    """Whether a cell sees a light: no cell on the way to it rises above the line of sight. The way is taken at ``samples``
    even steps, each an equi-join on the cell that it falls in."""
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    d = cells.select(*CELL, F.col(band).alias("h")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples - 1))))
    f = F.col("k") / float(samples)
    px, py, pz = cx + (light[0] - cx) * f, cy + (light[1] - cy) * f, F.col("h") + (light[2] - F.col("h")) * f
    wx, wy = spec.cell(px, py)
    way = d.select(F.col("xi").alias("ax"), F.col("yi").alias("ay"), pz.alias("line"), wx.alias("xi"), wy.alias("yi"))
    way = way.filter((F.col("ax") != F.col("xi")) | (F.col("ay") != F.col("yi")))
    dark = way.join(cells.select(*CELL, F.col(band).alias("top")), CELL).filter("top > line").select(F.col("ax").alias("xi"), F.col("ay").alias("yi"), F.lit(0).alias("dark")).distinct()
    return cells.select(*CELL).join(dark, CELL, "left").select(*CELL, F.coalesce("dark", F.lit(1)).alias("illumination"))


def illumination_walk(cells: DataFrame, spec: GridSpec, band: str, light: tuple[float, float, float], diameter: float = 0.0) -> DataFrame:
    """The share of a light that a cell sees: every cell that the line from its centre to the light crosses hides what it
    covers of the light's height, the most of them counts. Each boundary crossed is a row, joined on the cell behind it;
    of two crossed at once, that in y comes first."""
    lx, ly = math.floor((light[0] - spec.ox) / spec.sx), math.floor((light[1] - spec.oy) / spec.sy)
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    d = cells.select(*CELL, F.col(band).alias("h"), (light[0] - cx).alias("dx"), (light[1] - cy).alias("dy"), F.abs(lx - F.col("xi")).alias("kx"), F.abs(ly - F.col("yi")).alias("ky"))
    d = d.withColumns({"a": spec.sx / F.nullif(F.abs("dx"), F.lit(0.0)), "b": spec.sy / F.nullif(F.abs("dy"), F.lit(0.0)), "far": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))})
    steps = lambda n, most: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.least(F.col(n), F.lit(most)) - 1)).otherwise(F.array().cast("array<long>"))
    k = F.col("k")
    # Behind the k-th boundary in x lie the boundaries in y that are not farther, and the other way round.
    over_x = d.withColumn("k", F.explode(steps("kx", spec.nx))).withColumns({"mx": k + 1, "my": F.least("ky", F.coalesce(F.floor((k + 0.5) * F.col("a") / F.col("b") + 0.5), F.lit(0)))})
    over_y = d.withColumn("k", F.explode(steps("ky", spec.ny))).withColumns({"my": k + 1, "mx": F.least("kx", F.coalesce(F.ceil((k + 0.5) * F.col("b") / F.col("a") - 0.5), F.lit(0)))})
    way = over_x.unionByName(over_y).select(F.col("xi").alias("ax"), F.col("yi").alias("ay"), "h", "far", (F.col("xi") + F.signum("dx").cast("long") * F.col("mx")).alias("xi"), (F.col("yi") + F.signum("dy").cast("long") * F.col("my")).alias("yi"))
    way = way.filter(spec.inside(F.col("xi"), F.col("yi")) & ~((F.col("xi") == lx) & (F.col("yi") == ly)))
    met = way.join(cells.select(*CELL, F.col(band).alias("top")), CELL)
    dist = F.sqrt(F.pow((F.col("xi") - F.col("ax")) * spec.sx, 2) + F.pow((F.col("yi") - F.col("ay")) * spec.sy, 2))
    over = (F.col("top") - F.col("h")) / dist - (light[2] - diameter / 2 - F.col("h")) / F.col("far")
    hidden = over / (diameter / F.col("far")) if diameter > 0 else (over > 0).cast("double")
    dark = met.groupBy(F.col("ax").alias("xi"), F.col("ay").alias("yi")).agg(F.max(hidden).alias("hidden"))
    return cells.select(*CELL).join(dark, CELL, "left").select(*CELL, (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("hidden", F.lit(0.0))))).alias("illumination"))


def lookup(points: DataFrame, grids: list[tuple[DataFrame, GridSpec]], band: str, order: str = "vid") -> DataFrame:
    """Each point's value in the last grid that has one at its place (a grid is (cells, spec); later ones are newer)."""
    from functools import reduce

    found = [to_cells(points, spec).join(cells.select(*CELL, F.col(band).alias("value")).filter("value is not null"), CELL).select(order, F.lit(i).alias("grid"), "value") for i, (cells, spec) in enumerate(grids)]
    return reduce(DataFrame.unionByName, found).groupBy(order).agg(F.max(F.struct("grid", "value")).alias("f")).select(order, "f.*")


def height_at(points: DataFrame, cells: DataFrame, spec: GridSpec, band: str) -> DataFrame:
    """Heights at points, between cell centres: the plane through the point's cell with its central differences."""
    n = spread(cells, [(1, 0), (-1, 0), (0, 1), (0, -1)], [band])
    at = lambda a, b: F.max(F.when((F.col("dx") == a) & (F.col("dy") == b), F.col(band)))
    d = n.groupBy(*CELL).agg(((at(1, 0) - at(-1, 0)) / (2 * spec.sx)).alias("gx"), ((at(0, 1) - at(0, -1)) / (2 * spec.sy)).alias("gy")).join(cells.select(*CELL, band), CELL)
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    p = to_cells(points, spec).join(d, CELL)
    return p.withColumn("height", F.col(band) + F.coalesce("gx", F.lit(0.0)) * (F.col("x") - cx) + F.coalesce("gy", F.lit(0.0)) * (F.col("y") - cy)).drop("gx", "gy", band)


def copy_band(target: DataFrame, source: DataFrame, band: str, scale: int = 1) -> DataFrame:
    """Adds a band of another grid, of which one cell stands for scale by scale cells of the target."""
    s = source.select(F.col("xi").alias("_sx"), F.col("yi").alias("_sy"), band)
    on = (F.floor(F.col("xi") / scale) == F.col("_sx")) & (F.floor(F.col("yi") / scale) == F.col("_sy"))
    return target.join(s, on, "left").drop("_sx", "_sy")


def add_noise(cells: DataFrame, band: str, sigma: float, seed: int) -> DataFrame:
    return cells.withColumn(band, F.col(band) + F.randn(seed) * sigma)


def add_slope(cells: DataFrame, spec: GridSpec, band: str, gx: float, gy: float) -> DataFrame:
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    return cells.withColumn(band, F.col(band) + gx * cx + gy * cy)


def add_sphere(cells: DataFrame, spec: GridSpec, band: str, x: float, y: float, radius: float) -> DataFrame:
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    return cells.withColumn(band, F.col(band) + F.sqrt(F.greatest(F.lit(0.0), radius * radius - (cx - x) * (cx - x) - (cy - y) * (cy - y))))


def add_const(cells: DataFrame, band: str, value: float) -> DataFrame:
    return cells.withColumn(band, F.col(band) + value)


def within(cells: DataFrame, spec: GridSpec, band: str, shape, x: float, y: float, width: float, height: float) -> DataFrame:
    """A synthesis (cells to cells, as add_slope()) for cells whose centres lie in a window around (x, y) alone."""
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    inside = (F.abs(cx - x) < width / 2) & (F.abs(cy - y) < height / 2)
    made = shape(cells.withColumn("_was", F.col(band)))
    return made.withColumn(band, F.when(inside, F.col(band)).otherwise(F.col("_was"))).drop("_was")
