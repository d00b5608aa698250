"""Statistics of poses and segments: weighted moments, cleaned clusters, best hypotheses, histograms, mixtures."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut


def weighted_moments(poses: DataFrame, axes: list[str], by: str, weight: str = "weight") -> DataFrame:
    """Weighted mean and covariance of the axes per group, from sums that are combined before the shuffle."""
    w = F.col(weight)
    s = poses.groupBy(by).agg(F.sum(w).alias("w"), *[F.sum(w * F.col(a)).alias(f"s_{a}") for a in axes], *[F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(axes) for b in axes[i:]])
    mean = {a: F.col(f"s_{a}") / F.col("w") for a in axes}
    return s.select(by, *[mean[a].alias(f"mean_{a}") for a in axes], *[(F.col(f"s_{a}_{b}") / F.col("w") - mean[a] * mean[b]).alias(f"cov_{a}_{b}") for i, a in enumerate(axes) for b in axes[i:]])


def cleaned(poses: DataFrame, axes: list[str], by: str, limit: float, rounds: int = 10) -> DataFrame:
    """Groups without the members that lie further than limit deviations from their mean; mean and deviation are taken anew
    until none does (or rounds are over)."""
    left = poses
    for _ in range(rounds):
        m = left.groupBy(by).agg(*[F.avg(a).alias(f"m_{a}") for a in axes], *[F.stddev_pop(a).alias(f"d_{a}") for a in axes])
        off = F.sqrt(sum((F.pow((F.col(a) - F.col(f"m_{a}")) / F.greatest(F.col(f"d_{a}"), F.lit(1e-9)), 2) for a in axes), F.lit(0.0)))
        marked = cut(left.join(m, by).withColumn("_off", off).select(*left.columns, "_off"))
        if marked.filter(F.col("_off") > limit).isEmpty():
            return left
        left = marked.filter(F.col("_off") <= limit).drop("_off")
    return left


def best(parts: DataFrame, by: str, weight: str = "weight", key: str = "part_id") -> DataFrame:
    """The hypothesis of the largest weight per segment (ties: the smaller key)."""
    return parts.groupBy(by).agg(F.min_by(F.struct(key, weight), F.struct(-F.col(weight), key)).alias("b")).select(by, "b.*")


def closest(parts: DataFrame, by: str, axes: list[str], to: list[float], key: str = "part_id") -> DataFrame:
    d = F.sqrt(sum((F.pow(F.col(a) - v, 2) for a, v in zip(axes, to, strict=True)), F.lit(0.0)))
    return parts.groupBy(by).agg(F.min(F.struct(d.alias("distance"), key)).alias("b")).select(by, f"b.{key}", "b.distance")


def histogram(values: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Shares per bin; bin 0 is below and bins + 1 above the range."""
    b = F.when(value < low, 0).when(value >= high, bins + 1).otherwise(F.floor((value - low) / ((high - low) / bins)).cast("int") + 1)
    h = values.select(b.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = values.agg(F.count("*").alias("total"))
    return h.join(F.broadcast(total), F.lit(True)).select("bin", "n", (F.col("n") / F.col("total")).alias("share"))


def linear_score(shares: DataFrame, weights: list[float], constant: float) -> DataFrame:
    """The linear classifier's score of a histogram."""
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("bin") + 1)
    return shares.agg((F.sum(F.col("share") * w) + constant).alias("score"))


def _weighed(weight: str | None) -> dict[str, str]:
    return {"weightCol": weight} if weight else {}


def kmeans(rows: DataFrame, axes: list[str], k: int, seed: int = 42, weight: str | None = None) -> DataFrame:
    d = rows.withColumn("features", array_to_vector(F.array(*[F.col(a).cast("double") for a in axes])))
    return KMeans(k=k, seed=seed, **_weighed(weight)).fit(d).transform(d).drop("features").withColumnRenamed("prediction", "cluster")


def mixture(rows: DataFrame, axes: list[str], k: int, seed: int = 42, weight: str | None = None) -> DataFrame:
    """Expectation maximisation of a Gaussian mixture; adds the likeliest component."""
    d = rows.withColumn("features", array_to_vector(F.array(*[F.col(a).cast("double") for a in axes])))
    return GaussianMixture(k=k, seed=seed, **_weighed(weight)).fit(d).transform(d).drop("features", "probability").withColumnRenamed("prediction", "component")


def _drawn(rows: DataFrame, axes: list[str], mean, cov, seed: int) -> DataFrame:
    """Adds the axes, drawn from a normal distribution: its root times independent draws. A covariance may be singular."""
    values, vectors = np.linalg.eigh(np.asarray(cov, float))
    root = vectors * np.sqrt(np.clip(values, 0, None))
    free = [f"_r{i}" for i in range(len(axes))]
    d = rows.withColumns({c: F.randn(seed * 1000 + i) for i, c in enumerate(free)})
    return d.withColumns({a: sum((F.col(c) * float(root[i, j]) for j, c in enumerate(free)), F.lit(float(mean[i]))) for i, a in enumerate(axes)}).drop(*free)


def sample_normal(spark: SparkSession, n: int, axes: list[str], mean, cov, seed: int = 42) -> DataFrame:
    """n draws (id, axes) of a normal distribution, as poses of an uncertain frame. Each task draws its own."""
    return _drawn(spark.range(n), axes, mean, cov, seed)


def sample_mixture(spark: SparkSession, n: int, axes: list[str], parts: list[tuple[float, list[float], list[list[float]]]], seed: int = 42) -> DataFrame:
    """n draws (id, component, axes) of a mixture of normal distributions (weight, mean, covariance)."""
    ends = np.cumsum([w for w, _, _ in parts]) / sum(w for w, _, _ in parts)
    pick = F.lit(len(parts) - 1)
    for i in range(len(parts) - 2, -1, -1):
        pick = F.when(F.col("_u") < float(ends[i]), i).otherwise(pick)
    d = spark.range(n).withColumn("_u", F.rand(seed)).withColumn("component", pick).drop("_u")
    for i, (_, mean, cov) in enumerate(parts):
        d = _drawn(d, [f"_{i}_{a}" for a in axes], mean, cov, seed + 1 + i)
    chosen = {a: F.coalesce(*[F.when(F.col("component") == i, F.col(f"_{i}_{a}")) for i in range(len(parts))]) for a in axes}
    return d.select("id", "component", *[c.alias(a) for a, c in chosen.items()])
