"""Connected components of a link table, and contraction of a partition's links to a forest before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task takes at most: two nodes each, of some 100 bytes.
TOGETHER = 200_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps a link only if it joins two trees of its batch: at most nodes - 1 links with the same components."""
    for d in batches:
        up: dict[int, int] = {}
        a, b = [], []

        def root(x: int, up: dict = up) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in zip(d["a"].tolist(), d["b"].tolist(), strict=True):
            if (p := root(x)) != (q := root(y)):
                up[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})


def forest(links: DataFrame) -> DataFrame:
    return links.select("a", "b").mapInPandas(_forest, "a long, b long")


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all links of a task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for d in batches:
        for x, y in zip(d["a"].tolist(), d["b"].tolist(), strict=True):
            if (p := root(x)) != (q := root(y)):
                up[max(p, q)] = min(p, q)
    yield pd.DataFrame({"node": pd.Series(list(up), dtype="int64"), "root": pd.Series([root(x) for x in up], dtype="int64")})


def components(links: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Of links (a, b), a row (node, root) per node with root the smallest node of its component.

    Links that partitions' forests have left are few where most nodes are alone. Up to ``together`` of them go through one
    task, whose size that bounds: a round of stages over hundreds of partitions costs the driver more than such links are
    worth. More of them take rounds, with the same result, which no task holds.

    A round alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one, then its
    smaller neighbours too. Both are a grouped minimum and an equi-join on links, so no neighbourhood is gathered in
    a task; each round's links are checkpointed in the shared folder. Rounds grow with the logarithm of the size."""
    up = forest(links).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    up = cut(up)
    if up.count() <= together:
        return up.coalesce(1).mapInPandas(_roots, "node long, root long")
    last = None
    while True:
        both = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = large.filter("a <> b").distinct()
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        small = up.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        up = cut(small.filter("a <> b").distinct())
        now = up.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    nodes = up.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
