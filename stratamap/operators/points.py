"""Operators on point clouds: rows of (cloud, vid, x, y, z, ...)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..geometry import GridSpec

Box = tuple[tuple[float, float], tuple[float, float], tuple[float, float]]


def transform(points: DataFrame, m: np.ndarray, normals: bool = False) -> DataFrame:
    """Points under an affine 4x4 matrix; normals (nx, ny, nz), if asked for, are turned only."""
    rows = [[float(v) for v in r] for r in np.asarray(m)[:3]]
    apply = lambda r, names, shift: sum((F.col(n) * r[i] for i, n in enumerate(names)), F.lit(r[3] if shift else 0.0))
    out = points.withColumns({n: apply(r, "xyz", True) for n, r in zip("xyz", rows, strict=True)})
    return out.withColumns({n: apply(r, ("nx", "ny", "nz"), False) for n, r in zip(("nx", "ny", "nz"), rows, strict=True)}) if normals else out


def merge(clouds: list[tuple[DataFrame, np.ndarray]]) -> DataFrame:
    """All clouds in one frame. They must have the same columns: an attribute of one is one of all."""
    names = {tuple(sorted(c.columns)) for c, _ in clouds}
    if len(names) > 1:
        raise ValueError("clouds differ in their attributes")
    return reduce(DataFrame.unionByName, [transform(c, m, normals="nx" in c.columns) for c, m in clouds])


def in_box(box: Box) -> Column:
    return reduce(Column.__and__, [F.col(n).between(lo, hi) for n, (lo, hi) in zip("xyz", box, strict=True)])


def cut(points: DataFrame, include: list[Box] = (), exclude: list[Box] = (), m: np.ndarray | None = None) -> DataFrame:
    """Points inside all boxes to include and outside all to exclude; then moved by m."""
    keep = reduce(Column.__and__, [*map(in_box, include), *(~in_box(b) for b in exclude)], F.lit(True))
    out = points.filter(keep)
    return out if m is None else transform(out, m)


def bounds_before(m: np.ndarray, box: Box) -> Column:
    """A filter on untransformed columns that no point of the box (after m) fails, so that it can reach the scan."""
    corners = np.array([[x, y, z, 1.0] for x in box[0] for y in box[1] for z in box[2]]) @ np.linalg.inv(m).T
    lo, hi = corners[:, :3].min(axis=0) - 1e-9, corners[:, :3].max(axis=0) + 1e-9
    return in_box(tuple((float(a), float(b)) for a, b in zip(lo, hi, strict=True)))


def extents(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(*[f(n).alias(f"{k}_{n}") for n in "xyz" for k, f in (("min", F.min), ("max", F.max))])


def voxel_first(points: DataFrame, size: float, order: str = "vid") -> DataFrame:
    """One point of each voxel, the first in order (a grouped minimum of whole rows, so it is combined before the shuffle)."""
    voxel = [F.floor(F.col(n) / size).cast("long").alias(f"v{n}") for n in "xyz"]
    rest = [c for c in points.columns if c != order]
    first = points.groupBy(*voxel).agg(F.min(F.struct(order, *rest)).alias("p"))
    return first.select("vx", "vy", "vz", "p.*")


def every(points: DataFrame, k: int, order: str = "vid") -> DataFrame:
    return points.filter(F.pmod(order, F.lit(k)) == 0)


def from_distances(cells: DataFrame, spec: GridSpec, m: np.ndarray, factor: float = 0.1, farthest: float = 10.0) -> DataFrame:
    """Points of a distance image (xi, yi, distance): a cell's centre is the direction, its distance the depth."""
    cx, cy = spec.centre(F.col("xi"), F.col("yi"))
    d = F.col("distance")
    good = d.isNotNull() & ~F.isnan(d) & (F.abs(d) >= 2.2250738585072014e-308) & (d < farthest)
    return transform(cells.filter(good).withColumns({"x": d * cx, "y": d * cy, "z": d, "variance": d * factor}), m)


def scan_points(scan: DataFrame, start: float, step: float, near: float, far: float, edge: float) -> DataFrame:
    """Points of scan lines (line, phi, ranges in mm, remissions): beams out of range or grazing an edge (an angle above
    ``edge`` between the beam and the line to the next reading) go; each line is turned by its phi about the y axis."""
    beams = scan.select("line", "phi", F.posexplode(F.arrays_zip("ranges", "remissions")).alias("beam", "b"))
    beams = beams.select("line", "phi", "beam", (F.col("b.ranges") / 1000.0).alias("r"), F.col("b.remissions").alias("remission"))
    w = Window.partitionBy("line").orderBy("beam")
    psi, r = F.lit(start) + F.col("beam") * F.lit(step), F.col("r")
    after, before = F.lead("r").over(w), F.lag("r").over(w)
    slant = lambda other: F.atan2(F.abs(other * F.cos(F.lit(step)) - r), other * F.sin(F.lit(abs(step))))
    p = beams.withColumns({"psi": psi, "angle": F.greatest(F.coalesce(slant(after), F.lit(0.0)), F.coalesce(slant(before), F.lit(0.0))), "is_edge": after.isNull() | before.isNull()})
    p = p.filter(r.between(near, far) & (F.col("angle") <= edge))
    u, v = r * F.cos("psi"), r * F.sin("psi")
    p = p.withColumns({"x": u * F.cos("phi"), "y": v, "z": -u * F.sin("phi"), "variance": F.pow(F.least(0.01 * r, F.lit(0.02)), 2), "grey": F.least(F.greatest(F.col("remission") / 10000.0, F.lit(0.0)), F.lit(1.0))})
    return p.select("line", "beam", "x", "y", "z", "variance", "grey", "is_edge")


def scan_faces(points: DataFrame, longest: float) -> DataFrame:
    """Triangles between neighbouring beams of neighbouring lines whose three edges are shorter than longest."""
    corner = lambda n, dl, db: points.select((F.col("line") - dl).alias("line"), (F.col("beam") - db).alias("beam"), F.struct((F.col("beam")).alias("beam"), (F.col("line")).alias("line"), "x", "y", "z").alias(n))
    quads = corner("a", 0, 0)
    for n, dl, db in (("b", 0, 1), ("c", 1, 0), ("d", 1, 1)):
        quads = quads.join(corner(n, dl, db), ["line", "beam"], "left")
    far = lambda p, q: F.sqrt(sum((F.pow(F.col(f"{p}.{n}") - F.col(f"{q}.{n}"), 2) for n in "xyz"), F.lit(0.0)))
    short = lambda t: reduce(Column.__and__, [far(t[i], t[i - 1]) < longest for i in range(3)])
    two = F.array(*[F.when(short(t), F.struct(*[F.struct(f"{p}.line", f"{p}.beam").alias(n) for n, p in zip("abc", t, strict=True)])) for t in ("abc", "bdc")])
    return quads.select(F.explode(two).alias("f")).filter("f is not null").select("f.*")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """A vertex's normal is that of the last face (fid, a, b, c) that it is a corner of; (vid, nx, ny, nz)."""
    f = faces
    for corner in "abc":
        f = f.join(vertices.select(F.col("vid").alias(corner), *[F.col(n).alias(f"{corner}{n}") for n in "xyz"]), corner)
    u, v = ([F.col(f"{k}{n}") - F.col(f"a{n}") for n in "xyz"] for k in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    f = f.withColumns({n: e for n, e in zip(("nx", "ny", "nz"), cross, strict=True)})
    norm = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    f = f.select("fid", F.explode(F.array("a", "b", "c")).alias("vid"), *[(F.col(n) / norm).alias(n) for n in ("nx", "ny", "nz")])
    return f.groupBy("vid").agg(F.max_by(F.struct("nx", "ny", "nz"), "fid").alias("n")).select("vid", "n.*")


def mesh_points(scan: DataFrame, start: float, step: float, near: float, far: float, edge: float, x_forward: bool = True, centre: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Points of scan lines as a scanner's mesh takes them, from (line, phi, ranges in mm, remissions), lines numbered through.

    A beam goes if it or the one before meets the surface at an angle to the next reading that is ``edge`` or more off a right
    one. x_forward: whether the sensor looks along x or along y; centre: its offset from the axis, turned with phi about
    x. is_edge: the first or last beam of a line, or of the first or last line."""
    beams = scan.select("line", "phi", F.size("ranges").alias("beams"), F.posexplode("ranges").alias("beam", "mm"), "remissions")
    remission = F.when(F.size("remissions") == F.col("beams"), F.get("remissions", F.col("beam")))
    beams = beams.select("line", "phi", "beams", "beam", (F.col("mm") / 1000.0).alias("r"), remission.alias("remission"))
    w, right = Window.partitionBy("line").orderBy("beam"), math.pi / 2
    r, n = F.col("r"), F.lead("r").over(w)
    c = F.sqrt(r * r + n * n - 2 * r * n * math.cos(2 * step))
    met = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (r * r - n * n + c * c) / (2 * r * c))))
    p = beams.withColumn("_met", F.when(n.isNull(), right).otherwise(met))
    p = p.withColumns({"_last": F.coalesce(F.lag("_met").over(w), F.lit(right)), "psi": F.lit(start) + F.col("beam") * step})
    p = p.filter((r > near) & (r < far) & (F.abs(F.col("_met") - right) < edge) & (F.abs(F.col("_last") - right) < edge))
    # One row of bounds.
    ends = scan.agg(F.min("line").alias("_first"), F.max("line").alias("_final"))
    xx, yy = F.cos("psi") * r, F.sin("psi") * r
    x, y = (F.cos("phi") * xx, yy) if x_forward else (-yy, F.cos("phi") * xx)
    a, b, d = centre
    place = {"x": x + a, "y": y + b * F.cos("phi") - d * F.sin("phi"), "z": F.sin("phi") * xx + b * F.sin("phi") + d * F.cos("phi")}
    rim = (F.col("beam") == 0) | (F.col("beam") == F.col("beams") - 1) | (F.col("line") == F.col("_first")) | (F.col("line") == F.col("_final"))
    p = p.join(F.broadcast(ends), F.lit(True)).withColumns({**place, "variance": F.pow(F.least(0.01 * r, F.lit(0.02)), 2), "is_edge": rim})
    grey = F.least(F.greatest(F.col("remission") / 10000.0, F.lit(0.0)), F.lit(1.0))
    return p.select("line", "beam", "psi", "x", "y", "z", "variance", grey.alias("grey"), "remission", "is_edge")


#: Corners of a quad (the line before: beam before, beam; this line: beam, beam before) that its four triangles leave out in turn.
_TRIANGLES = [(1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2)]


def mesh_faces(points: DataFrame, longest: float) -> DataFrame:
    """Triangles of mesh_points(): of a quad's four, the first whose edges are all shorter than longest, and of the others
    that are, the one which doesn't overlap it; turned round where the beam points backwards. A point goes to the four quads it
    is a corner of, so quads meet by one shuffle."""
    role = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dl"), F.lit(b).alias("db")) for k, (a, b) in enumerate(((1, 1), (1, 0), (0, 0), (0, 1)))]))
    corner = F.struct("line", "beam", "x", "y", "z", (F.col("psi")).alias("psi"))
    d = points.select(corner.alias("p"), role.alias("r")).select((F.col("p.line") + F.col("r.dl")).alias("_l"), (F.col("p.beam") + F.col("r.db")).alias("_b"), "r.k", "p")
    q = d.groupBy("_l", "_b").agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}") for k in range(4)])
    # Every triangle has a corner at the quad's own beam.
    far = lambda i, j: F.sqrt(sum((F.pow(F.col(f"p{i}.{n}") - F.col(f"p{j}.{n}"), 2) for n in "xyz"), F.lit(0.0)))
    good = [F.coalesce((far(a, b) < longest) & (far(b, c) < longest) & (far(a, c) < longest), F.lit(False)) for a, b, c in _TRIANGLES]
    q = q.withColumn("_first", reduce(lambda rest, k: F.when(good[k], k).otherwise(rest), (3, 2, 1, 0), F.lit(None).cast("int"))).filter("_first is not null")
    at = lambda k: F.struct(F.col(f"p{k}.line"), F.col(f"p{k}.beam"))
    back = F.abs(F.coalesce("p1.psi", "p2.psi")) > math.pi / 2
    tri = [F.when(good[n] & (F.pmod(F.lit(n) - F.col("_first"), F.lit(2)) == 0), F.struct(at(a).alias("a"), F.when(back, at(c)).otherwise(at(b)).alias("b"), F.when(back, at(b)).otherwise(at(c)).alias("c"))) for n, (a, b, c) in enumerate(_TRIANGLES)]
    return q.select(F.explode(F.array(*tri)).alias("f")).filter("f is not null").select("f.*")


def markers(points: DataFrame, threshold: float, radius: float = 0.05, scan: str = "scan") -> DataFrame:
    """Bright marks of each scan: (scan, marker, x, y, z, n). Points of a remission above the threshold join, in order of
    (line, beam), every mark whose centre so far is nearer than radius, or else begin one. That depends on order, so a scan's
    bright points stream by sorted, and only its marks are held."""
    bright = points.filter(F.col("remission") > threshold).select(scan, "line", "beam", "x", "y", "z")
    kind = bright.schema[scan].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums, n = None, np.zeros((0, 3)), np.zeros(0)
        made = lambda: pd.DataFrame({scan: [at] * len(n), "marker": range(len(n)), **{a: sums[:, i] / n for i, a in enumerate("xyz")}, "n": n.astype("int64")})
        for d in batches:
            for key, *p in d[[scan, "x", "y", "z"]].itertuples(index=False, name=None):
                if key != at:
                    if len(n):
                        yield made()
                    at, sums, n = key, np.zeros((0, 3)), np.zeros(0)
                near = np.linalg.norm(sums / n[:, None] - p, axis=1) < radius
                if near.any():
                    sums[near] += p
                    n[near] += 1
                else:
                    sums, n = np.vstack([sums, p]), np.append(n, 1.0)
        if len(n):
            yield made()

    return bright.repartition(scan).sortWithinPartitions(scan, "line", "beam").mapInPandas(run, f"`{scan}` {kind}, marker int, x double, y double, z double, n long")
