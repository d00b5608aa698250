"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest permitted length are cut into pieces of it and a remainder. The pieces are dealt by hash
into packs of about ``pack_rows`` pieces, and each pack is packed by itself (its waste is at most a bin or two):
pieces, longest first, enter the open bin with the least remaining room that holds them; when none does, the bin size is
opened that costs least per token that it can be filled with from the pieces still to come. Opening sizes are optimised
jointly: each set of permitted opening lengths that keeps the largest is tried, and the cheapest outcome is kept.
Finally each bin shrinks to the smallest permitted length that holds its contents.

Nulls: a null or empty text has no tokens and stands in no bin (bin null); a null or repeated doc_id is a row like
others. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, table, with_fields, word_count

LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length (its start, its row of the batch).
OVERHEAD = 16
PACK_ROWS = 20_000


def cost(length: int) -> int:
    return length + OVERHEAD


def fill(sizes: list[int], lengths: tuple[int, ...]) -> list[list[int]]:
    """Best fit with falling sizes; bins as lists of indices. Bins opened are of the given lengths."""
    open_bins: list[tuple[int, int]] = []  # (remaining room, bin), sorted
    bins: list[list[int]] = []
    rest = sum(sizes)
    for i, s in enumerate(sizes):
        rest -= s
        k = bisect_left(open_bins, (s, -1))
        if k < len(open_bins):
            room, b = open_bins.pop(k)
        else:
            room = min((c for c in lengths if c >= s), key=lambda c: (cost(c) / min(c, s + rest), c))
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        if room > s:
            insort(open_bins, (room - s, b))
    return bins


def downsized(used: int, lengths: tuple[int, ...]) -> int:
    return min(c for c in lengths if c >= used)


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[list[int]], list[int]]:
    """The cheapest packing over the sets of opening lengths: bins (indices into sizes, in falling order) and lengths."""
    best = None
    for n in range(len(lengths)):
        for less in combinations(lengths[:-1], n):
            bins = fill(sizes, (*less, lengths[-1]))
            caps = [downsized(sum(sizes[i] for i in b), lengths) for b in bins]
            total = sum(map(cost, caps))
            if best is None or total < best[0]:
                best = total, bins, caps
    return best[1], best[2]


def pack_sequences(docs: DataFrame, keys: list[str], lengths: tuple[int, ...] = LENGTHS, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Packs (keys, n_tokens): a row per piece with piece, first (its first token in the document), tokens, and its
    bin (unique string), capacity (the bin's permitted length) and start (where the piece begins in the bin). A column
    of these whose name a key has gets underscores behind it."""
    lengths = tuple(sorted(lengths))
    big = lengths[-1]
    last = F.greatest(F.floor((F.col("n_tokens") - 1) / big), F.lit(0))
    p = docs.select(F.struct(*keys).alias("keys"), "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0)).cast("long"))).alias("piece"))
    p = p.withColumn("first", F.col("piece") * big).withColumn("tokens", F.coalesce(F.least(F.col("n_tokens") - F.col("first"), F.lit(big)), F.lit(0)).cast("long")).drop("n_tokens")
    p = cut(p.withColumn("tie", F.xxhash64("keys.*", "piece")))
    packs = max(1, -(-p.count() // pack_rows))
    p = p.withColumn("pack", F.pmod("tie", F.lit(packs)).cast("long"))

    def one(t: pa.Table) -> pa.Table:
        tokens, tie, piece = (t[c].to_numpy() for c in ("tokens", "tie", "piece"))
        order = np.lexsort((piece, tie, -tokens))
        t, sizes = t.take(pa.array(order)), tokens[order]
        n = int((sizes > 0).sum())
        bins, caps = pack(sizes[:n].tolist(), lengths) if n else ([], [])
        name, cap, start = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
        for k, (b, c) in enumerate(zip(bins, caps, strict=True)):
            at = 0
            for i in b:
                name[i], cap[i], start[i] = f"{t['pack'][0]}-{k}", c, at
                at += int(sizes[i])
        t = t.select(["keys", "piece", "first", "tokens"])
        return t.append_column("bin", pa.array(name, pa.string())).append_column("capacity", pa.array(cap, pa.int32())).append_column("start", pa.array(start, pa.int64()))

    out = p.groupBy("pack").applyInArrow(one, with_fields(p.select("keys", "piece", "first", "tokens"), "bin string, capacity int, start long"))
    made = out.columns[1:]
    return out.select("keys.*", *[F.col(c).alias(n) for c, n in zip(made, free(made, keys), strict=True)])


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by words into sequences of 512 to 4,096."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("n_tokens"))
    return pack_sequences(docs, ["doc_id", "text_hash"]).drop("text_hash")
