"""Nearest neighbours and registration of point clouds.

Neighbours are searched in buckets no smaller than the largest distance allowed (see search.py), so that a neighbour is in one of
the buckets around: an equi-join on shifted buckets, never a comparison of all with all."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..geometry import affine, quaternion
from ..lineage import cut
from .points import transform
from .search import band_counts, k_sums, nearest_place, placed, places, quantile


def nearest(left: DataFrame, right: DataFrame, distance: float, axes: str = "xyz") -> DataFrame:
    """The nearest of right to each point (id, x, y[, z]) of left within a distance (ties: the smaller id): (lid, rid, d)."""
    found = placed(left, axes).join(nearest_place(left, right, distance, axes), list(axes))
    return found.groupBy(F.col("id").alias("lid")).agg(F.min(F.struct("d", "rid")).alias("m")).select("lid", "m.rid", "m.d")


def count_in_band(left: DataFrame, right: DataFrame, distance: float, low: float, high: float) -> DataFrame:
    """How many of right lie within a distance in the plane and a band of heights about each point of left, where any do."""
    found = placed(left).join(band_counts(left, right, distance, low, high), list("xyz"))
    return found.groupBy(F.col("id").alias("lid")).agg(F.sum("n").alias("n"))


def outliers(points: DataFrame, k: int, distance: float, share: float) -> DataFrame:
    """Points whose mean distance to their k nearest (within a distance; missing ones count as that far) is in the top share."""
    at = places(points)
    m = placed(points).join(k_sums(at, at, k, distance), list("xyz"), "left")
    m = cut(m.select("id", ((F.coalesce("s", F.lit(0.0)) + (k - F.coalesce("c", F.lit(0))) * distance) / k).alias("mean_distance")))
    return m.filter(F.col("mean_distance") > F.lit(quantile(m, "mean_distance", 1 - share)))


def outliers_exact(points: DataFrame, k: int = 24, share: float = 0.05, distance: float = 1.0) -> DataFrame:
    """Points whose mean distance to their k nearest, however far these are, is in the top share. The distance is where the
    search begins: places with fewer than k others within it are searched again within twice as much, until none is left."""
    p = cut(placed(points))
    at = cut(places(p))
    k, left, done = min(k, (at.agg(F.sum("n")).first()[0] or 0) - 1), at, []
    if k < 1:
        return p.select("id", F.lit(0.0).alias("mean_distance")).limit(0)
    while left.take(1):
        done.append(cut(k_sums(left, at, k, distance).filter(F.col("c") == k).select(*"xyz", (F.col("s") / k).alias("mean_distance"))))
        left, distance = cut(left.join(done[-1], list("xyz"), "left_anti")), 2 * distance
    m = cut(p.join(functools.reduce(DataFrame.unionByName, done), list("xyz")).select("id", "mean_distance"))
    return m.filter(F.col("mean_distance") > F.lit(quantile(m, "mean_distance", 1 - share)))


MOMENTS = ["n", *(f"p{a}" for a in "xyz"), *(f"q{a}" for a in "xyz"), *(f"c{a}{b}" for a in "xyz" for b in "xyz"), "dd"]


def moments(pairs: DataFrame) -> DataFrame:
    """One row of sums over (px, py, pz, qx, qy, qz): all that a rigid fit needs."""
    sums = [F.count("*").alias("n"), *[F.sum(f"{s}{a}").alias(f"{s}{a}") for s in "pq" for a in "xyz"], *[F.sum(F.col(f"p{a}") * F.col(f"q{b}")).alias(f"c{a}{b}") for a in "xyz" for b in "xyz"], F.sum(sum((F.pow(F.col(f"p{a}") - F.col(f"q{a}"), 2) for a in "xyz"), F.lit(0.0))).alias("dd")]
    return pairs.agg(*sums)


def rigid(m) -> np.ndarray:
    """The rigid transform of p onto q from their moments (the unit quaternion that maximises the covariance's trace)."""
    n = m["n"]
    p, q = np.array([m[f"p{a}"] for a in "xyz"]) / n, np.array([m[f"q{a}"] for a in "xyz"]) / n
    c = np.array([[m[f"c{a}{b}"] for b in "xyz"] for a in "xyz"]) / n - np.outer(p, q)
    w, x, y, z = quaternion(c.T)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    return affine(tuple(q - turn @ p), turn)


def compatible(pairs: DataFrame, left: DataFrame, right: DataFrame, turn: float = math.pi / 8) -> DataFrame:
    """Pairs (lid, rid, ...) of which neither point lies on an edge and whose normals (nx, ny, nz) are less than an angle apart."""
    side = lambda d, s: d.select(F.col("id").alias(f"{s}id"), F.struct("nx", "ny", "nz", "is_edge").alias(f"_{s}"))
    d = pairs.join(side(left, "l"), "lid").join(side(right, "r"), "rid")
    dot = sum((F.col(f"_l.{n}") * F.col(f"_r.{n}") for n in ("nx", "ny", "nz")), F.lit(0.0))
    same = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) < turn
    return d.filter(~F.col("_l.is_edge") & ~F.col("_r.is_edge") & same).select(*pairs.columns)


def align(model: DataFrame, cloud: DataFrame, distance: float, overlap: float = 0.9, rounds: int = 10, least: float = 1e-6, turn: float | None = None) -> tuple[np.ndarray, float, int]:
    """Trimmed iterative closest points: the transform of cloud onto model, its mean squared error and pairs. Each round joins
    the moved cloud with the model, keeps the closest share of the pairs (its limit is one percentile) and fits. turn: only
    pairs that are compatible() by it count, for which both have normals and is_edge."""
    total, mse, used = np.eye(4), math.inf, 0
    for _ in range(rounds):
        moved = transform(cloud, total, normals=turn is not None)
        near = nearest(moved, model, distance)
        near = cut(near if turn is None else compatible(near, moved, model, turn))
        limit = quantile(near, "d", overlap)
        if limit is None:
            break
        near = near.filter(F.col("d") <= limit)
        side = lambda d, s, key: d.select(F.col("id").alias(key), *[F.col(a).alias(f"{s}{a}") for a in "xyz"])
        m = moments(near.join(side(moved, "p", "lid"), "lid").join(side(model, "q", "rid"), "rid")).first()
        if not m or m["n"] < 3:
            break
        total, before, mse, used = rigid(m) @ total, mse, m["dd"] / m["n"], m["n"]
        if mse < least or abs(before - mse) < least * least:
            break
        distance = max(2 * limit, least)
    return total, mse, used


def best_overlap(score, low: float = 0.4, high: float = 1.0, steps: int = 8) -> float:
    """The overlap that minimises a score (as mse / overlap**3), by golden sections."""
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = score(a), score(b)
    for _ in range(steps):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = score(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = score(b)
    return a if fa < fb else b


def fitted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rigid transform of points a onto points b."""
    m = {"n": len(a), **{f"p{k}": s for k, s in zip("xyz", a.sum(0), strict=True)}, **{f"q{k}": s for k, s in zip("xyz", b.sum(0), strict=True)}}
    return rigid(m | {f"c{i}{j}": (a[:, u] * b[:, v]).sum() for u, i in enumerate("xyz") for v, j in enumerate("xyz")})


def needed(share: float, sure: float) -> float:
    """Trials until one sample of three has no outlier with the given probability, where that share of the pairs agrees."""
    clean = share**3
    return math.inf if clean <= 0 else 1 if clean >= 1 else math.log(1 - sure) / math.log1p(-clean)


def consensus_pairs(pairs: DataFrame, threshold: float, batch: int = 64, most: int = 4096, sure: float = 1 - 1e-9, seed: int = 1) -> tuple[np.ndarray, int, int, bool]:
    """As consensus(), of all rows of (id, px, py, pz, qx, qy, qz): the transform of p onto q, the rows that agree with
    its best sample, the trials made, and whether these were enough. Only samples come to the driver: each pass draws a batch
    of them from all rows and counts the rows that agree with each. Passes end when, by the share of rows that agree with
    the best, a clean sample was drawn almost surely; if that takes more than ``most`` trials, the last value is False."""
    columns = [f"{s}{a}" for s in "pq" for a in "xyz"]
    n, best, top, tried = pairs.count(), None, 0, 0
    good = lambda t: F.sqrt(sum((F.pow(sum((float(r[i]) * F.col(f"p{a}") for i, a in enumerate("xyz")), F.lit(float(r[3]))) - F.col(f"q{b}"), 2) for b, r in zip("xyz", t, strict=False)), F.lit(0.0))) < threshold
    if n < 3:
        return np.eye(4), 0, 0, False
    while tried < most and tried < needed(top / n, sure):
        # Rows in the order of a hash that differs by pass are a random draw, the same whatever the partitions.
        drawn = pairs.withColumn("_h", F.xxhash64("id", F.lit(seed * 1_000_003 + tried))).orderBy("_h", "id", *columns).limit(3 * batch)
        v = np.array(drawn.select(*columns).collect(), float)
        v = v[np.random.default_rng((seed, tried)).permutation(len(v))]
        trials = [fitted(v[i : i + 3, :3], v[i : i + 3, 3:]) for i in range(0, len(v) - 2, 3)]
        m = np.stack(trials)

        def agree(batches: Iterator[pd.DataFrame], m: np.ndarray = m) -> Iterator[pd.DataFrame]:
            n = np.zeros(len(m), np.int64)
            for d in batches:
                p, q = d[columns[:3]].to_numpy(float), d[columns[3:]].to_numpy(float)
                n += [int((np.linalg.norm(p @ t[:3, :3].T + t[:3, 3] - q, axis=1) < threshold).sum()) for t in m]
            yield pd.DataFrame({"trial": np.arange(len(m)), "n": n})

        # One row per trial and partition.
        counts = pairs.select(*columns).mapInPandas(agree, "trial int, n long").groupBy("trial").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "trial").first()
        if counts.n > top:
            best, top = trials[counts.trial], counts.n
        tried += len(trials)
    if top < 3:
        return np.eye(4), top, tried, False
    m = moments(pairs.filter(good(best))).first()
    return rigid(m), m["n"], tried, tried >= needed(top / n, sure)


def consensus(x: np.ndarray, p: np.ndarray, threshold: float, trials: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The rigid transform of x onto p that most pairs agree with, from minimal samples of three, fitted again to all of them."""
    draw = np.random.default_rng(seed)

    off = lambda t: np.linalg.norm(x @ t[:3, :3].T + t[:3, 3] - p, axis=1)
    best = np.zeros(len(x), bool)
    for _ in range(trials):
        i = draw.choice(len(x), 3, replace=False)
        good = off(fitted(x[i], p[i])) < threshold
        if good.sum() > best.sum():
            best = good
    t = fitted(x[best], p[best]) if best.sum() >= 3 else np.eye(4)
    return t, best
