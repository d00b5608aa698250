"""Command line: load an environment's folder, do one thing, save or print.

    python -m stratamap.cli info ENV | graphviz ENV | delete ENV OUT ID | elevation ENV OUT MAP SIZE | surface ENV OUT MAP SIZE
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .geometry import GridSpec
from .operators import points, raster, surfaces
from .plans.catalog import Item
from .sources import scene


def _around(cloud, size: float) -> GridSpec:
    e = points.extents(cloud.withColumn("one", F.lit(1)), ["one"]).first()
    return GridSpec(int((e.max_x - e.min_x) // size) + 1, int((e.max_y - e.min_y) // size) + 1, size, size, e.min_x, e.min_y)


def main(args: list[str], spark: SparkSession | None = None) -> str:
    spark = spark or SparkSession.builder.getOrCreate()
    what, env, *rest = args
    c = scene.load(spark, env)
    match what:
        case "info":
            return "\n".join(f"{i}\t{x.kind}\t{x.label}" for i, x in sorted(c.items.items()))
        case "graphviz":
            return c.graphviz()
        case "delete":
            out, item = rest
            c.detach(item, deep=True)
        case "elevation" | "surface":
            out, item, size = rest
            cloud, frame = c.items[item].frame, c.at[item]
            spec = _around(cloud, float(size))
            made = raster.elevation(cloud, spec) if what == "elevation" else surfaces.project(cloud.withColumn("sd", F.lit(0.1)) if "sd" not in cloud.columns else cloud, spec, ["vid"])
            grid = {k: getattr(spec, k) for k in ("nx", "ny", "sx", "sy", "ox", "oy")}
            c.bind(c.attach(Item("map", what, frame=made, metadata={"grid": grid})), frame)
        case _:
            raise SystemExit(__doc__)
    scene.save(c, spark, out)
    return out


if __name__ == "__main__":
    print(main(sys.argv[1:]))
