"""An environment on disk: a folder with one Parquet table per layer and a scene file of items and links."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from ..geometry import Uncertain
from ..plans.catalog import ROOT, Catalog, Item, file_name


def save(catalog: Catalog, spark: SparkSession, path: str) -> None:
    rows = []
    for i, x in sorted(catalog.items.items()):
        pose = x.pose and {"m": x.pose.m.ravel().tolist(), "cov": None if x.pose.cov is None else x.pose.cov.ravel().tolist()}
        rows.append(json.dumps({"id": i, "class": x.kind, "label": x.label, "pose": pose, "layer": x.frame is not None, "metadata": x.metadata}))
        if x.frame is not None:
            x.frame.write.parquet(f"{path}/{file_name(i)}")
    rows += [json.dumps({"link": k, "a": a, "b": b}) for k, a, b in catalog.state() if k != "item"]
    # A scene's metadata is one small file, in order.
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{path}/scene")


def load(spark: SparkSession, path: str, functions: dict | None = None) -> Catalog:
    """The catalog; operators get their functions by id."""
    out = Catalog()
    found = [json.loads(r.value) for r in spark.read.text(f"{path}/scene").collect()]
    for r in [r for r in found if "id" in r]:
        pose = r["pose"] and Uncertain(np.array(r["pose"]["m"]).reshape(4, 4), None if r["pose"]["cov"] is None else np.array(r["pose"]["cov"]).reshape(6, 6))
        item = Item(r["class"], r["label"], r["id"], spark.read.parquet(f"{path}/{file_name(r['id'])}") if r["layer"] else None, pose, (functions or {}).get(r["id"]), (0, 99), r["metadata"])
        if r["id"] == ROOT:
            out.items[ROOT] = item
        else:
            out.items[r["id"]] = item
    for r in [r for r in found if "link" in r]:
        a, b = r["a"], r["b"]
        match r["link"]:
            case "frame_tree":
                out.parent[a] = b
            case "layer_tree":
                out.layers.add((a, b))
            case "op_input":
                out.inputs.setdefault(a, []).append(b)
            case "op_output":
                out.outputs.setdefault(a, []).append(b)
            case "map_frame":
                out.at[a] = b
    return out
