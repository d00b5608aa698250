"""Traversability: classes of cells (0 unknown, 1 obstacle, 2 and up by falling slope), closing, growing, flooding, statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..geometry import GridSpec, line_cells
from ..lineage import cut, numbered
from .raster import CELL, OPPOSITE, plane, spread, with_neighbours

UNKNOWN, OBSTACLE = 0, 1


def classes(cells: DataFrame, count: int, max_slope: float, clearance: float = 0.0) -> DataFrame:
    """Class and probability of (slope, step): too high a step or too steep a slope is an obstacle, a missing slope unknown."""
    s = F.abs("slope")
    step = (F.col("step") > clearance) if clearance else F.lit(False)
    c = F.when(F.coalesce(step, F.lit(False)), OBSTACLE).when(F.col("slope").isNull(), UNKNOWN).when(s > max_slope, OBSTACLE).otherwise(2 + count - F.rint(s / max_slope * count).cast("int"))
    return cells.select(*CELL, c.cast("int").alias("class")).withColumn("probability", F.when(F.col("class") == UNKNOWN, 0).otherwise(255))


def drivability(count: int) -> dict[int, float]:
    """By class: none for obstacles, then in even steps up to one."""
    return {OBSTACLE: 0.0, **{2 + i: 1 / count + (1 - 1 / count) / count * i for i in range(count + 1)}}


def mean_class(cells: DataFrame) -> DataFrame:
    """The mean class of the known cells, rounded by truncating half more."""
    return cells.filter(F.col("class") != UNKNOWN).agg(F.floor(F.avg("class") + 0.5).cast("int").alias("mean_class"))


def disc(radius: float, strict: bool = False) -> list[tuple[int, int]]:
    """Offsets within a radius in cells, without the origin."""
    r = math.ceil(radius)
    ok = (lambda d: d < radius * radius) if strict else (lambda d: d <= radius * radius)
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if (a, b) != (0, 0) and ok(a * a + b * b)]


def grow_obstacles(cells: DataFrame, radius: float) -> DataFrame:
    """Known cells within a radius of an obstacle become obstacles."""
    near = spread(cells.filter(F.col("class") == OBSTACLE), disc(radius), ["class"]).select(*CELL, F.lit(1).alias("near")).distinct()
    return cells.join(near, CELL, "left").select(*CELL, F.when(F.col("near").isNotNull(), OBSTACLE).otherwise(F.col("class")).alias("class"))


def grow_classes(cells: DataFrame, radius: float, drive: dict[int, float]) -> DataFrame:
    """Each cell takes the class least drivable among its own and those of known cells under a radius; ties keep its own, then
    the first source by row and column."""
    value = F.create_map(*[F.lit(v) for kv in drive.items() for v in kv])
    known = cells.filter((F.col("class") != UNKNOWN) & (F.col("probability") > 0))
    near = spread(known, disc(radius, True), ["class", "probability"]).withColumns({"other": F.lit(1), "sy": F.col("yi") + F.col("dy"), "sx": F.col("xi") + F.col("dx")}).drop("dx", "dy")
    own = known.select(*CELL, "class", "probability", F.lit(0).alias("other"), F.col("yi").alias("sy"), F.col("xi").alias("sx"))
    best = near.unionByName(own).groupBy(*CELL).agg(F.min_by(F.struct("class", "probability"), F.struct(value[F.col("class")], "other", "sy", "sx")).alias("b"))
    d = cells.select(*CELL, F.col("class").alias("c0"), F.col("probability").alias("p0")).join(best, CELL, "left")
    return d.select(*CELL, F.coalesce("b.class", "c0").alias("class"), F.coalesce("b.probability", "p0").alias("probability"))


def grow_objects(cells: DataFrame, radius: float, rank: dict[int, int]) -> DataFrame:
    """As grow_classes, by a total order of classes (rank: the larger wins)."""
    return grow_classes(cells, radius, {c: -float(r) for c, r in rank.items()})


def close_passages(cells: DataFrame, spec: GridSpec, width: float) -> DataFrame:
    """Cells on the straight line between two obstacles closer than a width become obstacles. Offsets, and the cells on the way
    to each, are a fixed table; obstacles meet by an equi-join."""
    reach = width / min(spec.sx, spec.sy)
    offsets = [(a, b) for a, b in disc(reach) if math.hypot(a * spec.sx, b * spec.sy) < width and (b, a) > (0, 0) and max(abs(a), abs(b)) > 1]
    if not offsets:
        return cells.select(*CELL, "class")
    spark = cells.sparkSession
    hit = cells.filter(F.col("class") == OBSTACLE).select(*CELL)
    pairs = spread(hit, offsets, []).join(hit, CELL)
    way = spark.createDataFrame([(a, b, px, py) for a, b in offsets for px, py in line_cells(0, 0, a, b)[1:-1]], "dx long, dy long, px long, py long")
    filled = pairs.join(F.broadcast(way), ["dx", "dy"]).select((F.col("xi") + F.col("px")).alias("xi"), (F.col("yi") + F.col("py")).alias("yi"), F.lit(1).alias("fill")).distinct()
    return cells.join(filled, CELL, "left").select(*CELL, F.when(F.col("fill").isNotNull(), OBSTACLE).otherwise(F.col("class")).alias("class"))


def statistic(cells: DataFrame, spec: GridSpec, x: float, y: float) -> DataFrame:
    """Per class: how many cells and how far the nearest is from a place."""
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    return cells.groupBy("class").agg(F.count("*").alias("n"), F.min(F.sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y))).alias("nearest"))


def worst(cells: DataFrame, drive: dict[int, float]) -> DataFrame:
    """The least drivable known class and the least probability."""
    value = F.create_map(*[F.lit(v) for kv in drive.items() for v in kv])
    known = cells.filter(F.col("class") != UNKNOWN)
    return known.agg(F.min_by("class", F.struct(value[F.col("class")], "class")).alias("class"), F.min("probability").alias("probability"))


def flood(patches: DataFrame, start: tuple[int, int, float], robot_height: float, max_step: float, outlier_n: float = 0.0, outlier_sd: float = float("inf"), rings: int = 9) -> DataFrame:
    """The patches that a robot can reach from a start (xi, yi, height), level by level. The start is the patch where the robot
    fits and whose height is nearest, in the first ring of cells around the start cell that has one, up to ``rings``; it is a
    ValueError if none has. Each round, the cells next to the last
    level's are reached from the earliest of these, and choose a patch where the robot fits. (xi, yi, mean, stdev, level,
    is_obstacle); what blocks the way is in the result but not walked from. Lineage is cut every round."""
    p = patches.filter(~((F.col("n") < outlier_n) & (F.col("stdev") > outlier_sd)))
    tops = p.withColumns({"up": F.col("mean") + F.col("stdev"), "down": F.col("mean") - F.col("stdev")})
    xi, yi, height = start
    near = tops.withColumn("ring", F.greatest(F.abs(F.col("xi") - xi), F.abs(F.col("yi") - yi))).filter(F.col("ring") <= rings)
    # The start cell's own nearest patch serves whatever stands above it; further out the robot has to fit.
    fits = choose(near.filter("ring > 0").withColumns({"floor": F.lit(float(height)), "turn": F.col("ring")}), robot_height, max_step).filter(~F.col("is_obstacle"))
    at = near.filter("ring = 0").select(*CELL, "mean", "stdev", "up", "ring", "ord").unionByName(fits.select(*CELL, "mean", "stdev", "up", F.col("turn").alias("ring"), F.lit(0).alias("ord")))
    at = at.orderBy("ring", F.abs(F.col("up") - height), "ord", "yi", "xi").limit(1)
    keep = [*CELL, "mean", "stdev", "up", "level", "seq", "is_obstacle"]
    seen = cut(at.withColumns({"level": F.lit(0), "seq": F.lit(0).cast("long"), "is_obstacle": F.lit(False)}).select(*keep))
    if seen.isEmpty():
        raise ValueError("no patch to start from")
    last, level = seen, 0
    sides = [(a, b) for b in (-1, 0, 1) for a in (-1, 0, 1) if (a, b) != (0, 0)]
    o = F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy"), F.lit(i).alias("side")) for i, (a, b) in enumerate(sides)])
    while True:
        level += 1
        asked = last.filter(~F.col("is_obstacle")).select("xi", "yi", "up", "seq", F.explode(o).alias("o"))
        asked = asked.select((F.col("xi") + F.col("o.dx")).alias("xi"), (F.col("yi") + F.col("o.dy")).alias("yi"), F.col("up").alias("floor"), (F.col("seq") * 8 + F.col("o.side")).alias("turn"))
        # The first to ask, in the order in which a queue would have asked.
        asked = asked.join(seen.select(*CELL), CELL, "left_anti").groupBy(*CELL).agg(F.min_by(F.struct("floor", "turn"), "turn").alias("a")).select(*CELL, "a.*")
        found = choose(asked.join(tops, CELL), robot_height, max_step)
        step = numbered(found.withColumn("level", F.lit(level)), "turn", "seq").select(*keep)
        if step.isEmpty():
            return seen.select(*CELL, "mean", "stdev", "level", "is_obstacle")
        seen, last = cut(seen.unionByName(step)), step


def choose(candidates: DataFrame, robot_height: float, max_step: float) -> DataFrame:
    """Per cell (with floor, turn): the patch the robot gets to. Patches out of reach above go; the first one in order that
    stands in the way at head or step height blocks; else the nearest top, climbing to any patch above it that leaves too
    low a gap; too high a rise is an obstacle."""
    floor = F.col("floor")
    c = candidates.filter(F.col("down") <= floor + robot_height + max_step)
    across = lambda level: (F.col("down") < level) & (F.col("up") > level)
    c = c.withColumn("blocks", across(floor + robot_height) | across(floor + max_step))
    patch = F.struct("mean", "stdev", "up", "down")
    g = c.groupBy(*CELL, "floor", "turn").agg(F.min_by(patch, F.when(F.col("blocks"), F.col("ord"))).alias("b"), F.max("blocks").alias("blocked"), F.min_by(patch, F.struct(F.abs(F.col("up") - floor), "ord")).alias("near"), F.array_sort(F.collect_list(F.struct("ord", "mean", "stdev", "up", "down"))).alias("all"))

    def climb(at, p):
        low = (at["up"] < p["down"]) & (p["down"] - at["up"] < robot_height) & (at["up"] - floor <= max_step)
        return F.when(low, F.struct(p["mean"].alias("mean"), p["stdev"].alias("stdev"), p["up"].alias("up"), p["down"].alias("down"))).otherwise(at)

    # Patches by rising bottom: one pass meets each gap that climbing leads to.
    rising = F.transform(F.array_sort(F.transform("all", lambda p: F.struct(p["down"].alias("by"), p.alias("p")))), lambda x: x["p"])
    top = F.aggregate(rising, F.col("near"), climb)
    p = F.when(F.col("blocked"), F.col("b")).otherwise(top)
    d = g.select(*CELL, "floor", "turn", "blocked", p.alias("p"))
    return d.select(*CELL, "turn", "p.mean", "p.stdev", "p.up", (F.col("blocked") | (F.col("p.up") - floor > max_step)).alias("is_obstacle"))


def classify_flood(reached: DataFrame, spec: GridSpec, max_step: float, max_slope: float, count: int) -> DataFrame:
    """Classes of reached cells from their neighbours' heights: a step too high or slope too steep is an obstacle."""
    h = reached.select(*CELL, (F.col("mean") + F.col("stdev")).alias("top"))
    n = with_neighbours(h, OPPOSITE, "top").withColumns({"px": F.col("dx") * spec.sx, "py": F.col("dy") * spec.sy, "pz": F.col("own") - F.col("other")})
    px, py, pz = F.col("px"), F.col("py"), F.col("pz")
    s = n.groupBy(*CELL).agg(F.count("*").alias("k"), F.max(F.abs("pz")).alias("step"), *[F.sum(e).alias(f"m_{k}") for k, e in (("x", px), ("y", py), ("z", pz), ("xx", px * px), ("xy", px * py), ("yy", py * py), ("xz", px * pz), ("yz", py * pz))])
    a, b, _ = plane({"n": F.col("k") + 1, **{k: F.col(f"m_{k}") for k in ("x", "y", "z", "xx", "xy", "yy", "xz", "yz")}})
    slope = F.acos(1 / F.sqrt(a * a + b * b + 1))
    drive = 1 - slope / max_slope
    c = F.when(F.col("step") > max_step, OBSTACLE).when(F.col("k") < 5, UNKNOWN).when(slope > max_slope, OBSTACLE).otherwise(OBSTACLE + F.ceil((drive - 0.00001) * count))
    return h.select(*CELL).join(s.select(*CELL, c.cast("int").alias("class")), CELL, "left").select(*CELL, F.coalesce("class", F.lit(UNKNOWN)).alias("class"))
