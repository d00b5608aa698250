"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) are sized by a partial aggregation. Groups above a grain (the mean shard's size
over ``grains``) stay items of their own: at most shards * grains of them exist. Smaller groups are put together, whole,
into bundles of at most two grains, in hash buckets and in parallel, so that there are at most shards * grains + buckets
bundles. Only these items, whose number does not depend on the table, are packed on the driver: by falling size,
each into the bin with the least remaining capacity that still holds it, found in a balanced tree.

Nulls: a null text has no bytes and stands with the empty texts; null and repeated doc_ids are rows like others. An
empty table gives no rows. Ties of size are broken by the group's hash.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BUCKETS, cut, ranked, table

SHARDS, GRAINS, ROW_BYTES = 40, 500, 16


class CapacityTree:
    """A treap of (remaining capacity, bin): balanced in expectation, by priorities of a fixed seed."""

    def __init__(self) -> None:
        self.root, self.draw = None, random.Random(5)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [self.draw.random(), key, None, None]), high)

    def pop_at_least(self, size: int) -> tuple[int, int] | None:
        """Takes out the smallest key whose capacity is size or more."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(low, high)
        return node[1]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[1] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if a[0] > b[0]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size (given in falling order); as many bins as it takes. A size above capacity has a bin alone."""
    tree, bins, out = CapacityTree(), 0, []
    for s in sizes:
        at = tree.pop_at_least(s)
        if at is None:
            at, bins = (max(capacity, s), bins), bins + 1
        out.append(at[1])
        tree.add((at[0] - s, at[1]))
    return out


def balanced_bins(sizes: list[int], bins: int) -> list[int]:
    """Bins of falling sizes, at the least capacity (found by halving) at which best fit decreasing needs no more than
    ``bins``. A size of at least the mean of what is left takes a bin alone."""
    rest, alone = sum(sizes), 0
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) >= rest:
        rest -= sizes[alone]
        alone += 1
    left, n = sizes[alone:], bins - alone
    if not left:
        return list(range(alone))
    low, high = max(-(-rest // n), left[0]), max(-(-rest // n), left[0]) + left[0]
    best = None
    while low < high or best is None:
        c = (low + high) // 2
        got = best_fit_decreasing(left, c)
        if max(got) < n:
            best, high = got, c
            if low == high:
                break
        else:
            low = c + 1
            if low >= high:
                high = max(high, low)
                if best is None:
                    high = low + left[0]
    return [*range(alone), *(alone + x for x in best)]


def shard_groups(groups: DataFrame, shards: int = SHARDS, grains: int = GRAINS) -> DataFrame:
    """From (gkey, gsize), a row per group: gkey, gsize, shard."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("gsize")).first()[0] or 0
    grain = max(1, total // (shards * grains))
    big = F.col("gsize") > grain
    w = Window.partitionBy("_b").orderBy(F.desc("gsize"), "gkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = groups.filter(~big).withColumn("_b", F.pmod(F.xxhash64("gkey"), F.lit(BUCKETS)))
    small = small.withColumn("_i", F.floor((F.sum("gsize").over(w) - F.col("gsize")) / grain))
    small = small.withColumn("item", F.concat_ws("-", "_b", "_i")).drop("_b", "_i")
    # Both item lists are bounded by shards * grains (+ buckets), whatever the table's size.
    items = [(r[0], r[1]) for r in groups.filter(big).select(F.hex("gkey"), "gsize").collect()]
    items += [(r[0], r[1]) for r in small.groupBy("item").agg(F.sum("gsize").alias("s")).collect()]
    items.sort(key=lambda x: (-x[1], x[0]))
    where = balanced_bins([x[1] for x in items], shards)
    plan = spark.createDataFrame([(k, b) for (k, _), b in zip(items, where, strict=True)], "item string, shard int")
    both = groups.filter(big).withColumn("item", F.hex("gkey")).unionByName(small.select("gkey", "gsize", "item"))
    return both.join(F.broadcast(plan), "item").select("gkey", "gsize", "shard")


def shard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard to rows with gkey (binary: rows with an equal one stay together) and size, and slot, gapless in it."""
    groups = cut(rows.groupBy("gkey").agg(F.sum("size").alias("gsize")))
    plan = shard_groups(groups, shards).select("gkey", "shard")
    out = rows.join(plan, "gkey")
    return ranked(out, ["shard"], ["doc_id", "gkey", "size"], "slot", F.pmod(F.xxhash64("doc_id", "gkey"), F.lit(BUCKETS)))


def op6_shard_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts share a shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("gkey"))
    out = shard(cut(rows))  # narrow rows; the texts are read once
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
