"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of its text's shingle hashes have. Equal fingerprints are one class. Classes
within ``RADIUS`` differing bits are linked: a fingerprint is cut into two segments of 32 bits, of which one differs in
at most one bit if all 64 differ in at most three. So the Hamming ball of radius one around each segment is enumerated,
its members are looked up in the segment's table by an equi-join, and whole distances are verified in the join.
(A ball's members have the other parity than its centre, so only centres of even parity enumerate them.)

A group of near copies may have very many links. Links at distance one are taken first (at most 64 to a fingerprint, by
enumerating the whole ball); then links are wanted only between classes that the first ones have not yet put in one
component, so that a dense group yields about as many links as it has members. No link between components is lost.

Nulls: a null or blank text has no shingles and fingerprint zero, linked like any other. Rows with null or repeated
doc_ids are rows like others; a component of null doc_ids only has component_id null. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, cut, pair_key, table
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: For a byte, its bits spread to the bytes of an integer: sums of up to 255 of them don't overflow.
SPREAD = np.array([sum((v >> i & 1) << 8 * i for i in range(8)) for v in range(256)], np.uint64)
HASHES = 1 << 18


def shingle_hashes(text: str | None, k: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of k words; bytes' own lower() and split() know ASCII letters and white space only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    if len(words) <= k:
        return [h(joined, SEED)]
    return [h(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[k - 1 :], strict=False)]


def majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """A fingerprint for each run of counts[i] hashes (zero for none)."""
    n, out = np.array(counts, np.int64), np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    first = np.cumsum(n) - n
    cuts = np.concatenate([np.arange(f, f + c, 255) for f, c in zip(first.tolist(), n.tolist(), strict=True) if c])
    lanes = np.add.reduceat(SPREAD[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    bits = lanes.view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    full = n > 0
    sums = np.add.reduceat(bits, np.searchsorted(cuts, first[full]), axis=0)
    out[full] = np.packbits(sums * 2 > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_texts(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    done, counts, parts, held = [], [], [], 0
    for t in texts:
        h = shingle_hashes(t, k)
        counts.append(len(h))
        parts.append(np.array(h, np.uint64))
        held += len(h)
        if held > HASHES:
            done.append(majority(np.concatenate(parts), counts))
            counts, parts, held = [], [], 0
    done.append(majority(np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts))
    return np.concatenate(done)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", k: int = SHINGLE) -> DataFrame:
    """Replaces the text column by its fingerprint (a signed long with the same bits)."""

    def work(texts):
        yield None, [fingerprint_texts(texts.to_pylist(), k).view(np.int64)]

    return arrow_map(df, [c for c in df.columns if c != text], [text], work, f"`{out}` long")


def _segments(fp: str) -> Column:
    """The two segments with their number."""
    half = [F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(fp), 32)]
    return F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), x.alias("key")) for i, x in enumerate(half))))


def _flips(key: Column, bits: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: key.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between nodes (fp, root) of different roots within the radius (at most 3)."""
    entries = nodes.select("fp", "root", _segments("fp").alias("s")).select("fp", "root", "s.*")
    even = F.bit_count("key") % 2 == 0
    probes = entries.select("fp", "root", "seg", F.explode(F.when(even, F.array_append(_flips(F.col("key"), 32), F.col("key"))).otherwise(F.array("key"))).alias("key"), F.col("key").alias("own"))
    l, r = probes.alias("l"), entries.alias("r")
    exact = F.col("l.own") == F.col("l.key")
    on = (F.col("l.seg") == F.col("r.seg")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root"))
    on &= (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius) & (~exact | (F.col("l.fp") < F.col("r.fp")))
    return l.join(r, on).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def neighbour_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) at distance one, by enumerating the ball around each fingerprint of even parity."""
    even = F.bit_count("fp") % 2 == 0
    balls = classes.filter(even).select(F.col("fp").alias("a"), F.explode(_flips(F.col("fp"), 64)).alias("b"))
    return balls.join(classes.filter(~even).select(F.col("fp").alias("b")), "b").select("a", "b")


def rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) of every class; a class without links is its own root."""
    found = components(links)
    return classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def linked_classes(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From distinct fingerprints (fp), each with the root of its component (its smallest fingerprint)."""
    first = cut(neighbour_links(classes))
    nodes = cut(rooted(classes, first))
    second = near_links(nodes, radius)
    return rooted(classes, first.unionByName(second))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """A row per document: doc_id, fp and component_id, the smallest doc_id that links lead to."""
    fps = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k=k))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = cut(linked_classes(classes.select("fp"), radius))
    roots = classes.join(roots, "fp")
    ids = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(roots.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the component of near duplicates."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, k: int = 5) -> DataFrame:
    """The documents without near duplicates: of each component the row of smallest doc_id stays (nulls last, then by
    the text's hash; of rows with equal doc_id and text any one), with all its columns. Texts are shuffled once."""
    at = "_stratamap_key"
    slim = docs.select(F.col(doc_id).alias("doc_id"), pair_key(doc_id, text).alias(at), F.col(text).alias("text"))
    fps = cut(fingerprints(slim, k=k))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", at)
    classes = cut(fps.groupBy("fp").agg(F.min(order).alias("low")))
    kept = classes.join(linked_classes(classes.select("fp"), radius), "fp").groupBy("root").agg(F.min("low").alias("low")).select(F.col(f"low.{at}").alias(at))
    both = docs.withColumn(at, pair_key(doc_id, text)).join(kept, at, "left_semi")
    first = F.row_number().over(Window.partitionBy(at).orderBy(F.lit(1)))
    return both.withColumn("_stratamap_n", first).filter("_stratamap_n = 1").drop("_stratamap_n", at)
