"""Exact searches of points among points that stay near-linear where points are dense or many share a place.

Places are searched, not points: rows of one place are one row with their number. Places go to buckets by a shuffle, those searched
among to all buckets within reach, and a bucket is searched in numpy: by cells that widen until enough is found, or line by line."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut

#: Places of the left side that a bucket has by intent, and candidates that are compared at once.
BUCKET, AT_ONCE = 20_000, 1_000_000
WIDER = 1 + 1e-9


def placed(points: DataFrame, axes: str = "xyz") -> DataFrame:
    return points.select("id", *[F.col(a).cast("double").alias(a) for a in axes])


def places(points: DataFrame, axes: str = "xyz", *more: Column) -> DataFrame:
    """The distinct finite places (x, y, ...) of points, with their number n and more aggregates."""
    finite = functools.reduce(Column.__and__, [F.abs(a) < math.inf for a in axes])
    return placed(points, axes).filter(finite).groupBy(*axes).agg(F.count("*").alias("n"), *more)


def bucket_edge(left: DataFrame, reach: float, axes: str) -> float:
    """The edge of buckets of which most hold about BUCKET rows of left, and which are no smaller than the reach."""
    ends = [F.percentile_approx(a, F.array(F.lit(0.02), F.lit(0.98)), F.lit(1000)).alias(a) for a in axes]
    r = left.agg(F.count("*").alias("n"), *ends).first()
    if not r.n:
        return reach
    spans = [r[a][1] - r[a][0] for a in axes]
    edge, want = max(*spans, reach), max(r.n / BUCKET, min(32.0, r.n / 500))
    while edge > reach and math.prod(math.ceil(s / edge) or 1 for s in spans) < want:
        edge /= 1.25
    return max(edge, reach)


def by_buckets(left: DataFrame, right: DataFrame, reach: float, axes: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run() over the rows of left in each bucket, and all those of right that may be within reach of one of these."""
    edge = bucket_edge(left, reach, axes)
    at = lambda a, by: F.floor((F.col(a) + by) / edge).cast("long")
    keys = [f"_b{a}" for a in axes]
    l, r, wide = left, right, reach * WIDER + edge * 1e-9
    for a, k in zip(axes, keys, strict=True):
        l, r = l.withColumn(k, at(a, 0.0)), r.withColumn(k, F.explode(F.sequence(at(a, -wide), at(a, wide))))

    def bucket(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return run(a.slice(0, 0), b.slice(0, 0))
        return run(a, b)

    return l.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(bucket, schema)


def _xyz(t: pa.Table, axes: str) -> np.ndarray:
    return np.stack([t[a].to_numpy() for a in axes], axis=1) if t.num_rows else np.zeros((0, len(axes)))


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all positions first, first + 1, ... of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def k_nearest(q: np.ndarray, p: np.ndarray, k: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d): of each place q[i] the k nearest places p[j] nearer than limit, in the order of i, d and j, in parts. Cells
    begin as small as p is dense, and are doubled for the places that have too few within an edge."""
    low = np.minimum(q.min(0), p.min(0))
    axes = p.shape[1]
    most = float((np.maximum(q.max(0), p.max(0)) - low).max())

    def cells(v: np.ndarray, h: float) -> np.ndarray:
        return np.floor((v - low) / (h * WIDER)).astype(np.int64) + 1

    def code(c: np.ndarray, n: np.ndarray) -> np.ndarray:
        return functools.reduce(lambda s, a: s * n[a] + c[:, a], range(1, axes), c[:, 0])

    def sized(h: float) -> np.ndarray:
        return np.maximum(cells(q, h).max(0), cells(p, h).max(0)) + 2

    h = limit if most <= 0 else min(limit, most * 2)
    # One cell holds the whole bucket at first; a place's own cell is then made to hold few.
    while most / h < 2**18:
        each = np.unique(code(cells(p, h), sized(h)), return_counts=True)[1]
        if (each.astype(float) ** 2).sum() / len(p) <= max(2.0, k / 2):
            break
        h /= 2
    left = np.arange(len(q))
    while len(left):
        last = h >= limit or h > most * 2
        n = sized(h)
        c = code(cells(p, h), n)
        order = np.argsort(c, kind="stable")
        c, mine = c[order], cells(q[left], h)
        first, count = [], []
        for o in itertools.product((-1, 0, 1), repeat=axes - 1):
            side = code(np.concatenate([mine[:, :-1] + o, mine[:, -1:]], axis=1) if axes > 1 else mine, n)
            a, b = np.searchsorted(c, side - 1), np.searchsorted(c, side + 1, "right")
            first.append(a)
            count.append(b - a)
        first, count = np.stack(first, axis=1), np.stack(count, axis=1)
        ends, again, at = np.cumsum(count.sum(1)), [], 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            row, pos = spread(first[at:to].ravel(), count[at:to].ravel())
            row, j = row // first.shape[1], order[pos]
            v = q[left[at:to]][row] - p[j]
            d = np.sqrt(functools.reduce(lambda s, a: s + v[:, a] * v[:, a], range(1, axes), v[:, 0] * v[:, 0]))
            near = d < min(h, limit)
            row, j, d = row[near], j[near], d[near]
            o = np.lexsort((j, d, row))
            row, j, d = row[o], j[o], d[o]
            found = np.bincount(row, minlength=to - at)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(found) - found, found)
            full = (found >= k) | last
            take = full[row] & (rank < k)
            yield left[at:to][row[take]], j[take], d[take]
            again.append(left[at:to][~full])
            at = to
        left, h = np.concatenate(again), min(2 * h, limit)


def nearest_place(left: DataFrame, right: DataFrame, distance: float, axes: str) -> DataFrame:
    """(x, y, ..., rid, d) of the places of left that have one of right within a distance: the nearest (of several that are,
    the smallest id)."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        # By id, so that the first of equals has the smallest.
        b = b.take(pc.sort_indices(b["rid"]))
        parts = list(k_nearest(_xyz(a, axes), _xyz(b, axes), 1, distance)) if a.num_rows else []
        i, j, d = (np.concatenate([np.zeros(0, t), *(x[m] for x in parts)]) for m, t in enumerate((np.int64, np.int64, float)))
        return pa.table({**{n: a[n].take(pa.array(i)) for n in axes}, "rid": b["rid"].take(pa.array(j)), "d": d})

    schema = ", ".join([*[f"{a} double" for a in axes], f"rid {right.schema['id'].dataType.simpleString()}", "d double"])
    return by_buckets(places(left, axes), places(right, axes, F.min("id").alias("rid")), distance, axes, run, schema)


def k_sums(left: DataFrame, right: DataFrame, k: int, distance: float) -> DataFrame:
    """(x, y, z, c, s): for each of places (x, y, z, n) that are among those of right, how many of the k points nearest to a
    point there, itself left out, are within a distance, and the sum of their distances."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        s, c = np.zeros(a.num_rows), np.zeros(a.num_rows, np.int64)
        if a.num_rows:
            n = b["n"].to_numpy()
            # A place is one of its own k + 1 nearest.
            for i, j, d in k_nearest(_xyz(a, "xyz"), _xyz(b, "xyz"), k + 1, distance):
                many = n[j].copy()
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                many[starts] -= 1
                before = np.cumsum(many) - many
                before -= np.repeat(before[starts], np.diff(starts, append=len(i)))
                many = np.clip(k - before, 0, many)
                np.add.at(s, i, many * d)
                np.add.at(c, i, many)
        return pa.table({**{m: a[m] for m in "xyz"}, "c": c, "s": s})

    return by_buckets(left, right, distance, "xyz", run, "x double, y double, z double, c long, s double")


def counts_in_band(q: np.ndarray, p: np.ndarray, n: np.ndarray, distance: float, low: float, high: float) -> np.ndarray:
    """For each place q how many of n points at p are nearer than distance in the plane and from low to high above it. Points on
    a line along x (or along y, if these are fewer) are counted by their ends within the circle."""
    if len(np.unique(p[:, ::2], axis=0)) < len(np.unique(p[:, 1:], axis=0)):
        q, p = q[:, [1, 0, 2]], p[:, [1, 0, 2]]
    out, square = np.zeros(len(q), np.int64), distance * distance
    by_z, order = np.argsort(q[:, 2], kind="stable"), np.lexsort((p[:, 0], p[:, 1], p[:, 2]))
    q, p, n = q[by_z], p[order], n[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(p[:, 1:], axis=0) != 0).any(1)])
    slack = 1e-9 * (1 + np.abs(p[:, 2]).max() + max(abs(low), abs(high)))
    for s, e in zip(starts, np.r_[starts[1:], len(p)], strict=True):
        y, z = p[s, 1:]
        at = slice(*np.searchsorted(q[:, 2], (z - high - slack, z - low + slack)))
        rise, dy = z - q[at, 2], q[at, 1] - y
        i = np.flatnonzero((rise >= low) & (rise <= high) & (dy * dy < square)) + at.start
        if not len(i):
            continue
        x, qx, dy2 = p[s:e, 0], q[i, 0], (q[i, 1] - y) ** 2
        if e - s <= 4:
            for m in range(e - s):
                out[i] += n[s + m] * ((qx - x[m]) ** 2 + dy2 < square)
            continue
        inside = lambda m, x=x, qx=qx, dy2=dy2: (qx - x[np.clip(m, 0, len(x) - 1)]) ** 2 + dy2 < square
        w = np.sqrt(square - dy2)
        a, b = np.searchsorted(x, qx - w), np.searchsorted(x, qx + w, "right")
        # The ends by the rule itself, which rounding may put a place further on.
        while (m := (a > 0) & inside(a - 1)).any():
            a -= m
        while (m := (a < b) & ~inside(a)).any():
            a += m
        b = np.maximum(a, b)
        while (m := (b < len(x)) & inside(b)).any():
            b += m
        while (m := (b > a) & ~inside(b - 1)).any():
            b -= m
        total = np.r_[0, np.cumsum(n[s:e])]
        out[i] += total[b] - total[a]
    back = np.empty_like(out)
    back[by_z] = out
    return back


def band_counts(left: DataFrame, right: DataFrame, distance: float, low: float, high: float) -> DataFrame:
    """(x, y, z, n) of the places of left that have n > 0 points of right nearer than a distance in the plane and in a band
    of heights about them."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        n = counts_in_band(_xyz(a, "xyz"), _xyz(b, "xyz"), b["n"].to_numpy(), distance, low, high) if a.num_rows else np.zeros(0, np.int64)
        return pa.table({**{m: a[m] for m in "xyz"}, "n": n}).filter(pa.array(n > 0))

    return by_buckets(places(left), places(right), distance, "xy", run, "x double, y double, z double, n long")


def quantile(values: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a column, interpolated: equal values are put together, the others sorted by ranges, and only the
    ranges' sizes and two values come to the driver."""
    v = values.select(F.col(column).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    v = cut(v.repartitionByRange("v").sortWithinPartitions("v")).withColumn("p", F.spark_partition_id())
    # One row per partition.
    sizes = sorted((r.p, r.n) for r in v.groupBy("p").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return None

    def at(i: int) -> float:
        for p, n in sizes:
            if i < n:
                w = Window.partitionBy("p").orderBy("v")
                return v.filter(F.col("p") == p).withColumn("to", F.sum("n").over(w)).filter(F.col("to") > i).agg(F.min("v")).first()[0]
            i -= n
        raise IndexError(i)

    place = (total - 1) * share
    i = math.floor(place)
    a = at(i)
    b = a if place == i else at(i + 1)
    return a if a == b else (i + 1 - place) * a + (place - i) * b
