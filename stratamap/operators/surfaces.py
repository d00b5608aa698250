"""Multi-level surface maps: rows of (xi, yi, ord, patch), a patch being mean (its top), stdev, height, type and more.

Where every measurement of a cell belongs to one patch, fusion has closed forms that are combined before the shuffle. The
general update looks at patches in order and is a fold over each cell's measurements in their order; cells are
independent, so the fold runs per cell in a grouped map, and a cell's rows come sorted from the shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..geometry import GridSpec, Uncertain
from .raster import CELL, plane, to_cells

VERTICAL, HORIZONTAL, NEGATIVE = 0, 1, 2
PATCH = "xi long, yi long, ord int, mean double, stdev double, height double, n double, low double, high double, idx long, type int"


def kalman(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Inverse-variance fusion of (x, y, z, sd) per cell."""
    w = 1 / (F.col("sd") * F.col("sd"))
    s = to_cells(points, spec).groupBy(*CELL).agg(F.sum(F.col("z") * w).alias("wz"), F.sum(w).alias("w"), F.count("*").alias("n"))
    return s.select(*CELL, (F.col("wz") / F.col("w")).alias("mean"), (1 / F.sqrt("w")).alias("stdev"), "n")


def weighted(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Weighted mean and spread, and bounds, of a cell's measurements."""
    w = 1 / (F.col("sd") * F.col("sd"))
    z = F.col("z")
    s = to_cells(points, spec).groupBy(*CELL).agg(F.sum(w).alias("w"), F.sum(w * z).alias("wz"), F.sum(w * z * z).alias("wzz"), F.sum(w * w).alias("ww"), F.min(z).alias("low"), F.max(z).alias("high"), F.count("*").alias("n"))
    mean = F.col("wz") / F.col("w")
    spread = (F.col("wzz") / F.col("w") - mean * mean) * F.col("w") * F.col("w") / (F.col("w") * F.col("w") - F.col("ww"))
    return s.select(*CELL, mean.alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(1e-6)))).otherwise(1 / F.sqrt("w")).alias("stdev"), "low", "high", "n")


def planes(points: DataFrame, spec: GridSpec, least: float = 1e-3) -> DataFrame:
    """The weighted least squares plane of a cell's measurements over their place in the cell; cells of over three whose
    places are not (nearly) on a line."""
    px, py = spec.rest(F.col("x"), F.col("y"))
    d = to_cells(points, spec).withColumns({"px": px, "py": py, "w": 1 / (F.col("sd") * F.col("sd"))})
    w, x, y, z = (F.col(c) for c in ("w", "px", "py", "z"))
    s = d.groupBy(*CELL).agg(F.count("*").alias("k"), F.sum(w).alias("n"), *[F.sum(w * e).alias(f"m_{k}") for k, e in (("x", x), ("y", y), ("z", z), ("xx", x * x), ("xy", x * y), ("yy", y * y), ("xz", x * z), ("yz", y * z))])
    a, b, c = plane({"n": F.col("n"), **{k: F.col(f"m_{k}") for k in ("x", "y", "z", "xx", "xy", "yy", "xz", "yz")}})
    m = {k: F.col(f"m_{k}") for k in ("x", "y", "xx", "xy", "yy")}
    det = m["xx"] * (m["yy"] * F.col("n") - m["y"] * m["y"]) - m["xy"] * (m["xy"] * F.col("n") - m["y"] * m["x"]) + m["x"] * (m["xy"] * m["y"] - m["yy"] * m["x"])
    return s.filter("k > 3").filter(det > least * m["xx"] * m["yy"] * F.col("n")).select(*CELL, a.alias("a"), b.alias("b"), c.alias("c"), "k")


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether an interval reaches over an end of another. It is not symmetric: one that lies wholly inside another, or has both
    its ends in common with it, reaches over none."""
    return ((a1 < b2) & (a2 > b2)) | ((a1 < b1) & (a2 > b1))


def islands(points: DataFrame, spec: GridSpec, gap: float) -> DataFrame:
    """Measurements with their cell and island: by rising z, one begins a new island if it lies a gap or more above the one
    before. That is how gated updates group a cell's measurements that come by rising z: a measurement joins a patch if
    the patch, widened by the gap, reaches over it."""
    w = Window.partitionBy(*CELL).orderBy("z")
    d = to_cells(points, spec).withColumn("_new", F.coalesce((F.col("z") - F.lag("z").over(w) >= gap).cast("int"), F.lit(0)))
    return d.withColumn("ord", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_new")


def gated_sums(points: DataFrame, spec: GridSpec, gap: float = 1.0) -> DataFrame:
    """The gated SUM update: patches (xi, yi, ord by rising height) with weighted mean and spread, bounds, n and weight."""
    w, z = 1 / (F.col("sd") * F.col("sd")), F.col("z")
    s = islands(points, spec, gap).groupBy(*CELL, "ord").agg(F.sum(w).alias("w"), F.sum(w * z).alias("wz"), F.sum(w * z * z).alias("wzz"), F.sum(w * w).alias("ww"), F.min(z).alias("low"), F.max(z).alias("high"), F.count("*").alias("n"))
    mean, weight = F.col("wz") / F.col("w"), F.col("w")
    spread = F.greatest(F.lit(0.0), F.col("wzz") / weight - mean * mean) * weight * weight / F.nullif(weight * weight - F.col("ww"), F.lit(0.0))
    return s.select(*CELL, "ord", mean.alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(1e-6)))).otherwise(1 / F.sqrt("w")).alias("stdev"), "low", "high", "n", "w")


def gated_planes(points: DataFrame, spec: GridSpec, gap: float = 1.0, least: float = 1e-3) -> DataFrame:
    """The gated SLOPE update: as gated_sums(), and the weighted plane z = a x + b y + c over places in the cell. Patches of three
    measurements or fewer, or whose places are (nearly) on a line, lie flat at their weighted mean."""
    px, py = spec.rest(F.col("x"), F.col("y"))
    d = islands(points, spec, gap).withColumns({"px": px, "py": py, "w": 1 / (F.col("sd") * F.col("sd"))})
    w, x, y, z = (F.col(c) for c in ("w", "px", "py", "z"))
    s = d.groupBy(*CELL, "ord").agg(F.count("*").alias("k"), F.sum(w).alias("n"), F.min(z).alias("low"), F.max(z).alias("high"), *[F.sum(w * e).alias(f"m_{k}") for k, e in (("x", x), ("y", y), ("z", z), ("xx", x * x), ("xy", x * y), ("yy", y * y), ("xz", x * z), ("yz", y * z))])
    m = {k: F.col(f"m_{k}") for k in ("x", "y", "z", "xx", "xy", "yy", "xz", "yz")} | {"n": F.col("n")}
    det = m["xx"] * (m["yy"] * m["n"] - m["y"] * m["y"]) - m["xy"] * (m["xy"] * m["n"] - m["y"] * m["x"]) + m["x"] * (m["xy"] * m["y"] - m["yy"] * m["x"])
    solid = (F.col("k") > 3) & (det > least * m["xx"] * m["yy"] * m["n"])
    s = s.withColumn("_solid", solid)
    a, b, c = (F.when(F.col("_solid"), e) for e in plane(m))
    return s.select(*CELL, "ord", F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"), F.coalesce(c, m["z"] / m["n"]).alias("c"), "low", "high", "k")


def moved(patches: DataFrame, source: GridSpec, target: GridSpec, m: np.ndarray, variance: float = 0.0) -> DataFrame:
    """Patches of a map in another frame: each one's centre, at its mean, goes by the affine m (source frame into target
    frame) into a target cell, with the variance of the transform in z added. Patches that leave the target go; so maps that
    are not aligned can be merged and matched."""
    cx, cy = source.centre(F.col("xi"), F.col("yi"))
    at = [cx * float(r[0]) + cy * float(r[1]) + F.col("mean") * float(r[2]) + float(r[3]) for r in np.asarray(m)[:3]]
    xi, yi = target.cell(F.col("_x"), F.col("_y"))
    d = patches.withColumns({"_x": at[0], "_y": at[1], "_z": at[2]})
    d = d.withColumns({"xi": xi, "yi": yi, **{c: F.col(c) + F.col("_z") - F.col("mean") for c in ("low", "high") if c in patches.columns}})
    d = d.withColumn("mean", F.col("_z")).drop("_x", "_y", "_z").filter(target.inside(F.col("xi"), F.col("yi")))
    return d.withColumn("stdev", F.sqrt(F.col("stdev") * F.col("stdev") + variance)) if variance else d


def min_z(k: float = 2.0) -> Column:
    """The lowest height of a patch, k deviations below its bottom."""
    return F.col("mean") - F.col("height") - k * F.col("stdev")


def max_z(k: float = 2.0) -> Column:
    return F.col("mean") + k * F.col("stdev")


def plane_height(x: Column, y: Column) -> Column:
    """Height of a patch's plane (a, b, c) at a place in its cell."""
    return F.col("a") * x + F.col("b") * y + F.col("c")


def plane_slope() -> Column:
    """The angle of a patch's plane."""
    return F.acos(1 / F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + 1))


def plane_normal() -> Column:
    """The unit normal of a patch's plane, as a struct (nx, ny, nz)."""
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + 1)
    return F.struct((-F.col("a") / norm).alias("nx"), (-F.col("b") / norm).alias("ny"), (1 / norm).alias("nz"))


@dataclass
class Patch:
    mean: float
    stdev: float
    height: float = 0.0
    n: float = 1.0
    low: float = 0.0
    high: float = 0.0
    idx: int = 0
    type: int = HORIZONTAL

    def absorb(self, o: Patch, thickness: float, gap: float) -> bool:
        """Merges o into this patch if they belong together; may change either otherwise (age decides what free space
        gives way)."""
        d = math.hypot(self.stdev, o.stdev)
        if not (self.mean - self.height - gap - d < o.mean and self.mean + gap + d > o.mean - o.height):
            return False
        flat = self.type == HORIZONTAL and o.type == HORIZONTAL
        if flat and self.mean - self.height - thickness - d < o.mean < self.mean + thickness + d:
            a, b = self.stdev**2, o.stdev**2
            self.mean, self.stdev = (b * self.mean + a * o.mean) / (a + b), math.sqrt(a * b / (a + b))
        else:
            if flat:
                self.type = VERTICAL
            free = (self.type == NEGATIVE) + (o.type == NEGATIVE)
            if free == 1 and not self._age(o):
                return False
            if free == 0 and self.type == HORIZONTAL and o.type == VERTICAL:
                self.type = VERTICAL
            if free != 1:
                bottom = min(self.mean - self.height, o.mean - o.height)
                if o.mean > self.mean:
                    self.mean, self.stdev = o.mean, o.stdev
                self.height = max(self.height, self.mean - bottom)
            else:
                self.idx = max(self.idx, o.idx)
                return True
        self.n += o.n
        self.low, self.high, self.idx = min(self.low, o.low), max(self.high, o.high), max(self.idx, o.idx)
        return True

    def _age(self, o: Patch) -> bool:
        """Of one patch of free and one of occupied space the newer one prevails: wholly (True), or it cuts the older."""
        if self.idx == o.idx:
            return False
        old, new = (self, o) if self.idx < o.idx else (o, self)
        bottom = new.mean - new.height
        if new.mean > old.mean and bottom < old.mean - old.height:
            self.__dict__.update(new.__dict__)
            return True
        if new.mean < old.mean:
            old.height = old.mean - new.mean
        elif bottom < old.mean:
            old.height -= old.mean - bottom
            old.mean = bottom
        return False


def update(cell: list[Patch], new: Patch, thickness: float, gap: float) -> None:
    """One measurement into a cell's patches (newest first)."""
    o = replace(new)
    took = [p for p in cell if p.absorb(o, thickness, gap)]
    if not took:
        cell.insert(0, o)
    while took:
        head, rest = took[0], []
        for p in took[1:]:
            if head.absorb(p, thickness, gap):
                cell[:] = [q for q in cell if q is not p]
            else:
                rest.append(p)
        took = rest


FIELDS = ["mean", "stdev", "height", "n", "low", "high", "idx", "type"]


def swallowed(cell: list[Patch], rows: list[np.ndarray], gap: float) -> int:
    """How many of the first rows (FIELDS) lie each within one block, whose bounds they leave, and out of reach of all other patches;
    they are added to their blocks. For these update() comes to that, in any number."""
    mean, sd, height, n, low, high, idx, kind = rows
    bottom = mean - height
    ok, reached, within = (kind != NEGATIVE) & np.isfinite(sd + low + high), np.zeros(len(mean), np.int64), []
    for p in cell:
        # A little further than its reach is, so that rounding leaves no doubt.
        d = np.hypot(p.stdev, sd) + gap + 1e-9 * (1 + abs(p.mean) + p.height)
        reached += ~((p.mean - p.height - d >= mean) | (p.mean + d <= bottom))
        if p.type == VERTICAL:
            within.append((p, (mean <= p.mean) & (bottom >= p.mean - p.height)))
    ok &= (reached == 1) & np.any([i for _, i in within], axis=0)
    first = len(ok) if ok.all() else int(ok.argmin())
    for p, i in within:
        i = np.flatnonzero(i[:first])
        if len(i):
            # One after the other, as update() adds.
            p.n = float(np.cumsum(np.r_[p.n, n[i]])[-1])
            p.low, p.high, p.idx = min(p.low, float(low[i].min())), max(p.high, float(high[i].max())), max(p.idx, int(idx[i].max()))
            for _ in i:
                again = p.mean - (p.mean - p.height)
                if again <= p.height:
                    break
                p.height = again
    return first


def update_all(cell: list[Patch], rows: list[np.ndarray], thickness: float, gap: float) -> None:
    """update() for each row (FIELDS) in order; rows within blocks are taken together, as many as there may be."""
    at, ahead, wait, end = 0, 16, 0, len(rows[0])
    while at < end:
        if wait <= 0 and gap > 1e-6 and any(p.type == VERTICAL for p in cell):
            to = min(end, at + ahead)
            n = swallowed(cell, [c[at:to] for c in rows], gap)
            at += n
            if at == to:
                ahead = min(2 * ahead, 1 << 16)
                continue
            ahead, wait = max(16, ahead // 2), 0 if n > 4 else 8
        update(cell, Patch(*(c[at].item() for c in rows)), thickness, gap)
        at, wait = at + 1, wait - 1


def dealt(patches: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a cell adjacent and in order, after one shuffle and sort."""
    return patches.repartition(*CELL).sortWithinPartitions(*CELL, *order)


def fold(patches: DataFrame, order: list[str], thickness: float = 0.05, gap: float = 1.0) -> DataFrame:
    """The general update: (xi, yi, order, mean, stdev, height, n, low, high, idx, type) into patches per cell. Rows
    of a cell are adjacent and in order after one shuffle and sort, and are folded as they stream by; a cell keeps its
    patches only, not its rows."""
    return folded(dealt(patches, order), thickness, gap)


def folded(rows: DataFrame, thickness: float, gap: float) -> DataFrame:
    """fold() of rows that were dealt()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cell, done = None, [], []
        emit = lambda: [(*at, i, *(getattr(p, f) for f in FIELDS)) for i, p in enumerate(cell)]
        names = [*CELL, "ord", *FIELDS]
        for d in batches:
            xi, yi, *columns = (d[c].to_numpy() for c in [*CELL, *FIELDS])
            starts = np.flatnonzero(np.r_[True, (np.diff(xi) != 0) | (np.diff(yi) != 0)]) if len(d) else []
            for s, e in zip(starts, [*starts[1:], len(d)], strict=False):
                if (xi[s], yi[s]) != at:
                    if at is not None:
                        done += emit()
                    at, cell = (xi[s], yi[s]), []
                update_all(cell, [c[s:e] for c in columns], thickness, gap)
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=names)
                done = []
        if at is not None:
            done += emit()
        yield pd.DataFrame(done, columns=names)

    return rows.select(*CELL, *FIELDS).mapInPandas(run, PATCH)


def measured(points: DataFrame, idx: int = 0) -> DataFrame:
    """Points with their cell as patches of one measurement."""
    z = F.col("z")
    return points.withColumns({"mean": z, "stdev": F.col("sd"), "height": F.lit(0.0), "n": F.lit(1.0), "low": z, "high": z, "idx": F.lit(idx).cast("long"), "type": F.lit(HORIZONTAL)})


def project(points: DataFrame, spec: GridSpec, order: list[str], area: Column | None = None, default_sd: float = 0.1, pose_var: Column | None = None, thickness: float = 0.05, gap: float = 1.0) -> DataFrame:
    """Points into patches. pose_var: the variance in z of the points' frame at a cell, added once per patch."""
    p = points if area is None else points.filter(area)
    p = p.withColumn("sd", F.coalesce("sd", F.lit(default_sd)))
    # Only what differs by point is shuffled.
    rows = dealt(to_cells(p, spec).select(*dict.fromkeys([*CELL, *order, "z", "sd"])), order)
    out = folded(measured(rows), thickness, gap)
    return out if pose_var is None else out.withColumn("stdev", F.sqrt(F.col("stdev") * F.col("stdev") + pose_var))


def merge(maps: list[DataFrame], reverse: bool = False, thickness: float = 0.05, gap: float = 1.0) -> DataFrame:
    """Patches of several aligned maps into one, map by map."""
    from functools import reduce

    maps = maps[::-1] if reverse else maps
    every = reduce(DataFrame.unionByName, [m.withColumn("map_seq", F.lit(i)) for i, m in enumerate(maps)])
    return fold(every, ["map_seq", "ord"], thickness, gap)


def top(patches: DataFrame) -> DataFrame:
    """The highest patch of each cell."""
    return patches.groupBy(*CELL).agg(F.max_by(F.struct("mean", "stdev", "height", "type"), F.struct("mean", "stdev")).alias("p")).select(*CELL, "p.*")


def to_points(patches: DataFrame, spec: GridSpec) -> DataFrame:
    """A horizontal patch as its centre; a vertical one as points from bottom to top; free space as none."""
    step = (spec.sx + spec.sy) / 2 if spec.sx + spec.sy > 0 else 0.1
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("height") / step).cast("long")), lambda k: F.col("mean") - F.col("height") + k * step)
    z = F.when(F.col("type") == HORIZONTAL, F.array("mean")).when(F.col("type") == VERTICAL, many)
    return patches.select(*CELL, cx.alias("x"), cy.alias("y"), F.explode(z).alias("z"))


def from_grid(cells: DataFrame, source: GridSpec, target: GridSpec, band: str, shift: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """A patch at each target cell whose corner falls into a source cell, in a frame shifted against the target's."""
    spark = cells.sparkSession
    t = spark.range(target.nx * target.ny).select((F.col("id") % target.nx).alias("xi"), F.floor(F.col("id") / target.nx).cast("long").alias("yi"))
    gx, gy = source.cell(F.col("xi") * target.sx + target.ox - shift[0], F.col("yi") * target.sy + target.oy - shift[1])
    on = t.withColumns({"gx": gx, "gy": gy}).join(cells.select(F.col("xi").alias("gx"), F.col("yi").alias("gy"), band), ["gx", "gy"])
    return on.select(*CELL, (F.col(band) + shift[2]).alias("mean"), F.lit(0.0).alias("stdev"))


def matches(a: DataFrame, b: DataFrame, k: float = 3.0) -> DataFrame:
    """(xi, yi, aord, hit): each patch of a with whether one of b in its cell is within k joint deviations."""
    l = a.select(*CELL, F.col("ord").alias("aord"), F.col("mean").alias("am"), F.col("stdev").alias("asd"))
    r = b.select(*CELL, F.col("mean").alias("bm"), F.col("stdev").alias("bsd"))
    near = F.abs(F.col("am") - F.col("bm")) < k * F.sqrt(F.col("asd") * F.col("asd") + F.col("bsd") * F.col("bsd"))
    return l.join(r, CELL).groupBy(*CELL, "aord").agg(F.max(near.cast("int")).alias("hit"))


def match_ratio(a: DataFrame, b: DataFrame, every: int = 1, k: float = 3.0) -> DataFrame:
    """Cells with a match over cells that have patches in both; one if there are none."""
    m = matches(a, b, k).groupBy(*CELL).agg(F.max("hit").alias("hit")).filter((F.col("xi") % every == 0) & (F.col("yi") % every == 0))
    return m.agg(F.coalesce(F.avg("hit"), F.lit(1.0)).alias("ratio"), F.count("*").alias("cells"))


def match_height(a: DataFrame, b: DataFrame) -> DataFrame:
    """The inverse-variance weighted mean distance of nearest patches of equal cells, and its variance."""
    d = a.select(*CELL, F.col("mean").alias("am"), F.col("stdev").alias("asd")).join(b.select(*CELL, F.col("mean").alias("bm"), F.col("stdev").alias("bsd")), CELL)
    d = d.withColumns({"diff": F.col("am") - F.col("bm"), "var": F.col("asd") * F.col("asd") + F.col("bsd") * F.col("bsd")})
    near = d.groupBy(*CELL, "am", "asd").agg(F.min_by(F.struct("diff", "var"), F.struct(F.abs("diff"), "diff")).alias("m")).select("m.*")
    return near.agg((F.sum(F.col("diff") / F.col("var")) / F.sum(1 / F.col("var"))).alias("diff"), (1 / F.sum(1 / F.col("var"))).alias("variance"))


def scale_weights(patches: DataFrame, factor: float) -> DataFrame:
    """As if every measurement had had factor times its weight."""
    return patches.withColumn("stdev", F.col("stdev") / math.sqrt(factor))


def follow(path: list[tuple[int, int]], cells: dict[tuple[int, int], list[float]], height: float) -> list[float]:
    """Heights along a path of cells: in each the patch nearest to the height before; where there is none it stays."""
    out = []
    for c in path:
        height = min(cells[c], key=lambda m: (abs(m - height), m)) if cells.get(c) else height
        out.append(height)
    return out


def choose_grid(grids: dict[str, tuple[float, float]], x: float, y: float, threshold: float) -> str | None:
    """Of grids' centres, the one nearest by the larger of both distances, if it is within a threshold."""
    if not grids:
        return None
    d, name = min((max(abs(cx - x), abs(cy - y)), name) for name, (cx, cy) in grids.items())
    return name if d <= threshold else None


def follow_paths(paths: DataFrame, patches: DataFrame) -> DataFrame:
    """As follow(), for many paths: rows (path, seq, xi, yi, start) get a height, start being that before the first. A path's
    rows stream by in order with the heights in their cells; only the last height is held."""
    here = patches.groupBy(*CELL).agg(F.sort_array(F.collect_list("mean")).alias("_heights"))
    d = paths.select("path", "seq", *CELL, "start").join(here, CELL, "left").repartition("path").sortWithinPartitions("path", "seq")
    kind = paths.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, height = None, 0.0
        for d in batches:
            out = []
            for path, start, heights in zip(d["path"], d["start"], d["_heights"], strict=True):
                at, height = path, start if path != at else height
                if heights is not None and len(heights):
                    height = min(heights, key=lambda m: (abs(m - height), m))
                out.append(height)
            yield d[["path", "seq", *CELL]].assign(height=np.array(out, float))

    return d.mapInPandas(run, f"path {kind}, seq long, xi long, yi long, height double")


def pose_variance(spec: GridSpec, pose: Uncertain) -> Column:
    """The variance in z that an uncertain pose of the sensor gives a patch at its cell's centre: the rotation's by the lever
    about the pose's place, and the translation's."""
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    if pose.cov is None:
        return F.lit(0.0)
    j = {0: cy - float(pose.m[1, 3]), 1: float(pose.m[0, 3]) - cx, 5: F.lit(1.0)}
    return sum((j[a] * j[b] * float(pose.cov[a, b]) for a in j for b in j), F.lit(0.0))


def free_space(patches: DataFrame, spec: GridSpec, origin: tuple[float, float, float]) -> DataFrame:
    """Patches of free space on the lines of sight from a sensor to the patches that it saw: (fx, fy, ord, k) of the patch seen
    and the step from it, the cell, and the mean, stdev and height of what is free there, which narrow towards the sensor."""
    ox, oy = (int(math.floor((o - a) / s)) for o, a, s in ((origin[0], spec.ox, spec.sx), (origin[1], spec.oy, spec.sy)))
    if not (0 <= ox < spec.nx and 0 <= oy < spec.ny):
        raise ValueError("the sensor must be within the grid")
    dx, dy = ox - F.col("fx"), oy - F.col("fy")
    d = patches.select(F.col("xi").alias("fx"), F.col("yi").alias("fy"), "ord", F.col("mean").alias("_mean"), F.col("stdev").alias("_sd"), F.col("height").alias("_h"))
    d = d.withColumn("_n", F.greatest(F.abs(dx), F.abs(dy))).filter("_n > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    k, n = F.col("k"), F.col("_n")
    go = lambda at, by: F.col(at) + F.signum(by).cast("long") * F.ceil((2 * k * F.abs(by) - n) / (2 * n))
    up = F.lit(origin[2]) - F.col("_mean")
    far = F.sqrt(F.pow(dx * spec.sx, 2) + F.pow(dy * spec.sy, 2))
    f, seen = 1 - k / n, spec.sx / far * up
    return d.select("fx", "fy", "ord", "k", go("fx", dx).alias("xi"), go("fy", dy).alias("yi"), (F.col("_mean") + seen * f + up * (1 - f)).alias("mean"), (F.col("_sd") * f).alias("stdev"), F.abs((F.col("_h") + seen) * f).alias("height"))


def project_with_free_space(points: DataFrame, spec: GridSpec, order: list[str], origin: tuple[float, float, float], pose: Uncertain | None = None, thickness: float = 0.05, gap: float = 1.0, **options) -> DataFrame:
    """project(), with what the sensor at origin saw to be free: first the patches, then the free space of each in their order."""
    seen = project(points, spec, order, pose_var=pose_variance(spec, pose) if pose else None, thickness=thickness, gap=gap, **options)
    known = seen.withColumns({"fx": F.col("xi"), "fy": F.col("yi"), "k": F.lit(0).cast("long"), "_free": F.lit(0)})
    free = free_space(seen, spec, origin).withColumns({"n": F.lit(1.0), "low": F.col("mean"), "high": F.col("mean"), "idx": F.lit(0).cast("long"), "type": F.lit(NEGATIVE), "_free": F.lit(1)})
    # Patches of a cell are put back oldest first, as each new one is put in front of those before it.
    both = known.withColumn("ord", -F.col("ord")).unionByName(free)
    return fold(both, ["_free", "fx", "fy", "ord", "k"], thickness, gap)


def apart(mean: Column, height: Column, type_: Column, mean2: Column, height2: Column, type2: Column) -> Column:
    """The distance in z of two patches: of a block, from its nearer end (none inside it); two blocks are not told apart."""
    to = lambda m, h, z: F.when(z > m, z - m).otherwise(F.greatest(F.lit(0.0), m - h - z))
    flat, flat2 = type_ == HORIZONTAL, type2 == HORIZONTAL
    return F.when(~flat & ~flat2, 0.0).when(~flat, to(mean, height, mean2)).when(~flat2, to(mean2, height2, mean)).otherwise(F.abs(mean - mean2))


def first_match(patches: DataFrame, probes: DataFrame, k: float = 3.0, skip_free: bool = False) -> DataFrame:
    """For each probe (id, xi, yi, mean, stdev, height, type) the first patch of its cell, in the order of ord, that is
    nearer than k joint deviations: (id, ord, mean, stdev). skip_free: patches of free space match none."""
    p = patches.filter(F.col("type") != NEGATIVE) if skip_free else patches
    p = p.select(*CELL, "ord", "mean", "stdev", "height", "type")
    q = probes.select("id", *CELL, *[F.col(c).alias(f"_{c}") for c in ("mean", "stdev", "height", "type")])
    near = apart(*[F.col(c) for c in ("mean", "height", "type", "_mean", "_height", "_type")]) < k * F.sqrt(F.col("stdev") * F.col("stdev") + F.col("_stdev") * F.col("_stdev"))
    return q.join(p, CELL).filter(near).groupBy("id").agg(F.min(F.struct("ord", "mean", "stdev")).alias("m")).select("id", "m.*")


def scale_sums(patches: DataFrame, factor: float, sums: list[str], squares: list[str] = ()) -> DataFrame:
    """Patches kept as weighted sums, with all weights times factor; squares: sums of squared weights. Means and deviations
    that come from them stay."""
    return patches.withColumns({**{c: F.col(c) * factor for c in sums}, **{c: F.col(c) * factor * factor for c in squares}})
